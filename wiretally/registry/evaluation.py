"""Evidence, evaluation, metric and check queries."""

from pyspark.sql import functions as F

from wiretally.operators import evidence as ev
from wiretally.operators import metrics as mt
from wiretally.operators.readmodels import first_per_key
from wiretally.functions import text
from wiretally.registry.base import query

# --- gateway evidence -------------------------------------------------------


def _spis(c):
    as_text = lambda n: F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(n)), 8, "0"))
    return (c.withColumn("spis", F.array_compact(F.array(as_text("spi_in"), as_text("spi_out"))))
            .filter(F.size("spis") > 0)
            .withColumns({"enc": text.gateway_enc("proposal"), "key_bits": text.gateway_bits("proposal"),
                          "integ": text.gateway_integ("proposal"), "mode": F.lower("mode")}))


def _sas(p):
    return p.select("session_id", F.concat(F.lit("0x"), F.lpad(F.lower(F.hex("spi")), 8, "0")).alias("spi"))


def _state_text(c):
    """Status text of every child, with lines that must be ignored around it."""
    body = F.concat(
        F.lit("s: #29, ESTABLISHED, IKEv2\n  AES_CBC-128/PRF\n  s-child: #41, reqid 1, "),
        F.when(F.col("spi_in") % 5 == 0, "REKEYED, ").otherwise("INSTALLED, "), "mode", F.lit(", ESP:"), "proposal", F.lit("\n    in  "),
        F.lpad(F.lower(F.hex("spi_in")), 8, "0"), F.lit(", 100 bytes\n    out "), F.lpad(F.lower(F.hex("spi_out")), 8, "0"), F.lit(", 9 bytes\nother: #3\n    in  ffffffff, 1 bytes\n"))
    return c.filter("spi_in IS NOT NULL").select("session_id", "spi_in", body.alias("sa_state"))


ALGO = """concat('AES-', CASE WHEN proposal LIKE '%GCM%' THEN 'GCM-16' ELSE 'CBC' END) AS enc, CAST(right(proposal, 3) AS BIGINT) AS key_bits,
      CASE WHEN proposal LIKE '%GCM%' THEN 'AEAD' END AS integ"""
HEXES = "concat('0x', lpad(lower(to_hex(spi_in)), 8, '0'), ',0x', lpad(lower(to_hex(spi_out)), 8, '0')) AS spis"

query("p26_parse_gateway_state", f"SELECT spi_in, lower(mode) AS mode, {ALGO}, {HEXES} FROM children_fx WHERE spi_in IS NOT NULL AND spi_in % 5 <> 0", ["children_fx"])(
    lambda c: ev.parse_gateway_state(_state_text(c), key="spi_in").drop("child_no").withColumn("spis", F.array_join("spis", ",")))


def _raw_text(c):
    return c.filter("spi_in IS NOT NULL").select("spi_in", F.concat(
        F.lit("list-sa event {s {dh-group=MODP_2048 child-sas {s-child-1\n{name=s-child state="), F.when(F.col("spi_in") % 5 == 0, "REKEYING").otherwise("INSTALLED"),
        F.lit(" mode="), "mode", F.lit(" protocol=ESP spi-in="), F.lower(F.hex("spi_in")), F.lit("\nspi-out="), F.lower(F.hex("spi_out")),
        F.lit(" encr-alg="), F.substring_index("proposal", "-", 1), F.lit(" encr-keysize="), F.substring_index("proposal", "-", -1),
        F.when(F.col("spi_in") % 2 == 0, " integ-alg=HMAC_SHA2_256_128 dh-group=CURVE25519").otherwise(""), F.lit("}}}}\nlist-sas reply {}\n")).alias("raw"))


query("p27_parse_gateway_raw", """SELECT spi_in, 's-child' AS name, lower(mode) AS mode, concat('AES-', CASE WHEN proposal LIKE '%GCM%' THEN 'GCM-16' ELSE 'CBC' END) AS enc,
      CAST(right(proposal, 3) AS BIGINT) AS key_bits, CASE WHEN spi_in % 2 = 0 THEN 'sha256' WHEN proposal LIKE '%GCM%' THEN 'AEAD' END AS integ,
      CAST(CASE WHEN spi_in % 2 = 0 THEN 31 END AS BIGINT) AS dh_group, """ + HEXES + " FROM children_fx WHERE spi_in IS NOT NULL AND spi_in % 5 <> 0", ["children_fx"])(
    lambda c: ev.parse_gateway_raw(_raw_text(c), key="spi_in").drop("child_no").withColumn("spis", F.array_join("spis", ",")))


def _split(c):
    rows = _spis(c)
    return rows.filter("snapshot = 'before'").drop("snapshot"), rows.filter("snapshot = 'after'").drop("snapshot")


query("u2_union_children", "SELECT session_id, snapshot, spi_in FROM children_fx WHERE spi_in IS NOT NULL", ["children_fx"])(
    lambda c: ev.union_children(_split(c)[1], _split(c)[0]).select("session_id", "snapshot", "spi_in"))
query("u3_new_rekey_child", """WITH k AS (SELECT * FROM children_fx WHERE spi_in IS NOT NULL),
    n AS (SELECT * FROM k a WHERE snapshot = 'after' AND NOT EXISTS (SELECT 1 FROM k b WHERE b.snapshot = 'before' AND b.session_id = a.session_id AND b.spi_in = a.spi_in))
    SELECT session_id, min(spi_in) AS spi_in FROM n GROUP BY 1 HAVING count(*) = 1""", ["children_fx"])(
    lambda c: ev.new_rekey_child(*_split(c)).select("session_id", "spi_in"))
query("u4_common_spis", """SELECT DISTINCT c.session_id, concat('0x', lpad(lower(to_hex(p.spi)), 8, '0')) AS spi FROM children_fx c
      JOIN predictions_fx p ON p.session_id = c.session_id AND (p.spi = c.spi_in OR p.spi = c.spi_out)""", ["children_fx", "predictions_fx"])(
    lambda c, p: ev.common_spis(_spis(c), _sas(p).groupBy("session_id").agg(F.collect_set("spi").alias("spis"))))
query("j7_match_gateway", f"""SELECT DISTINCT c.session_id, c.snapshot, c.spi_in, {ALGO} FROM children_fx c
      JOIN predictions_fx p ON p.session_id = c.session_id AND (p.spi = c.spi_in OR p.spi = c.spi_out)""", ["children_fx", "predictions_fx"])(
    lambda c, p: ev.match_gateway(_spis(c), _sas(p)).select("session_id", "snapshot", "spi_in", "enc", "key_bits", "integ"))

STATUS = "CASE WHEN esp_packets % 7 = 0 THEN 'running' ELSE 'completed' END"


def _labels(s):
    return s.select("session_id", "mode", text.proposal_cipher("esp_proposal").alias("enc"), "key_bits", text.proposal_integ("esp_proposal").alias("integ"),
                    "pfs", text.dh_from_proposal("esp_proposal").alias("dh_group"), "traffic_type", (1 + F.length("session_id") % 2).alias("ike_version"))


@query("j8_verify_sessions", f"""WITH done AS (SELECT session_id FROM (SELECT *, {STATUS} AS st FROM sessions_fx) WHERE st = 'completed'),
    m AS (SELECT DISTINCT c.session_id, c.spi_in, lower(c.mode) AS mode, {ALGO.replace('proposal', 'c.proposal')} FROM children_fx c JOIN done USING (session_id)
      JOIN predictions_fx p ON p.session_id = c.session_id AND (p.spi = c.spi_in OR p.spi = c.spi_out)),
    v AS (SELECT session_id, field, min(value) AS value FROM (
        SELECT session_id, 'mode' AS field, mode AS value FROM m UNION ALL SELECT session_id, 'enc', enc FROM m
        UNION ALL SELECT session_id, 'key_bits', CAST(key_bits AS VARCHAR) FROM m UNION ALL SELECT session_id, 'integ', integ FROM m)
      WHERE value IS NOT NULL GROUP BY 1, 2 HAVING min(value) = max(value)),
    l AS (SELECT session_id, mode, CASE WHEN esp_proposal LIKE '%gcm%' THEN 'gcm' WHEN esp_proposal LIKE '%cbc%' THEN 'cbc' END AS enc, CAST(key_bits AS VARCHAR) AS key_bits,
      CASE WHEN esp_proposal LIKE '%gcm%' THEN 'aead' ELSE nullif(regexp_extract(esp_proposal, '(sha[0-9]+)', 1), '') END AS integ FROM sessions_fx),
    e AS (SELECT session_id, 'mode' AS field, mode AS expected FROM l UNION ALL SELECT session_id, 'enc', enc FROM l
      UNION ALL SELECT session_id, 'key_bits', key_bits FROM l UNION ALL SELECT session_id, 'integ', integ FROM l)
    SELECT session_id, CAST(count(expected) AS BIGINT) AS eligible_plain, CAST(count(*) FILTER (WHERE expected IS NOT NULL AND value IS NOT NULL) AS BIGINT) AS compared,
      CAST(count(*) FILTER (WHERE expected = CASE WHEN field = 'enc' THEN CASE WHEN value LIKE '%GCM%' THEN 'gcm' WHEN value LIKE '%CBC%' THEN 'cbc' END ELSE lower(value) END) AS BIGINT) AS matched
    FROM e LEFT JOIN v USING (session_id, field) GROUP BY 1""", ["sessions_fx", "children_fx", "predictions_fx"])
def _j8(s, c, p):
    st = s.withColumn("status", F.when(F.col("esp_packets") % 7 == 0, "running").otherwise("completed"))
    out = ev.verify_sessions(st, _spis(c), _sas(p), _labels(s)).filter(F.col("field").isin("mode", "enc", "key_bits", "integ"))
    return ev.verification_totals(out).withColumnRenamed("eligible", "eligible_plain")


@query("j8_verified_fields", f"""WITH s AS (SELECT *, esp_packets % 7 = 0 AS running, esp_packets % 3 = 0 AS legacy FROM sessions_fx),
    c AS (SELECT session_id, snapshot, spi_in, spi_out, lower(mode) AS mode, {ALGO} FROM children_fx WHERE spi_in IS NOT NULL),
    k AS (SELECT c.*, s.legacy FROM c JOIN s USING (session_id) WHERE NOT s.running AND NOT (s.legacy AND c.spi_in % 5 = 0)),
    m AS (SELECT k.* FROM k WHERE EXISTS (SELECT 1 FROM predictions_fx p WHERE p.session_id = k.session_id AND p.spi IN (k.spi_in, k.spi_out))),
    v AS (SELECT session_id, field, min(value) AS value, CASE WHEN bool_or(legacy) THEN 'legacy_sa_state' ELSE 'gateway_vici' END AS source FROM (
        SELECT session_id, legacy, 'mode' AS field, mode AS value FROM m UNION ALL SELECT session_id, legacy, 'enc', enc FROM m
        UNION ALL SELECT session_id, legacy, 'key_bits', CAST(key_bits AS VARCHAR) FROM m UNION ALL SELECT session_id, legacy, 'integ', integ FROM m)
      WHERE value IS NOT NULL GROUP BY 1, 2 HAVING min(value) = max(value)),
    fresh AS (SELECT * FROM k a WHERE NOT legacy AND snapshot = 'after' AND NOT EXISTS (
        SELECT 1 FROM k b WHERE b.snapshot = 'before' AND b.session_id = a.session_id AND b.spi_in = a.spi_in)),
    one AS (SELECT session_id, min(spi_in) AS spi_in, min(spi_out) AS spi_out FROM fresh GROUP BY 1 HAVING count(*) = 1),
    r AS (SELECT session_id, CASE spi_in % 4 WHEN 1 THEN 14 WHEN 2 THEN 20 WHEN 3 THEN 2 END AS dh FROM one o
      WHERE EXISTS (SELECT 1 FROM predictions_fx p WHERE p.session_id = o.session_id AND p.spi IN (o.spi_in, o.spi_out))),
    known AS (SELECT * FROM v UNION ALL SELECT session_id, 'pfs', CASE WHEN dh IS NULL THEN 'false' ELSE 'true' END, 'gateway_vici_rekey' FROM r
      UNION ALL SELECT session_id, 'dh_group', CAST(dh AS VARCHAR), 'gateway_vici_rekey' FROM r WHERE dh IS NOT NULL
      UNION ALL SELECT session_id, 'pfs', CASE WHEN pfs THEN 'true' ELSE 'false' END, 'configured' FROM s WHERE legacy
      UNION ALL SELECT session_id, 'dh_group', CASE WHEN esp_proposal LIKE '%ecp384' THEN '20' WHEN esp_proposal LIKE '%1024' THEN '2' ELSE '14' END, 'configured' FROM s WHERE legacy),
    e AS (SELECT session_id, unnest(['mode', 'enc', 'key_bits', 'integ', 'pfs', 'dh_group']) AS field,
      unnest([mode, CASE WHEN esp_proposal LIKE '%gcm%' THEN 'GCM' WHEN esp_proposal LIKE '%cbc%' THEN 'CBC' END, CAST(key_bits AS VARCHAR),
        CASE WHEN esp_proposal LIKE '%gcm%' THEN 'AEAD' ELSE nullif(regexp_extract(esp_proposal, '(sha[0-9]+)', 1), '') END, CASE WHEN pfs THEN 'true' ELSE 'false' END,
        CASE WHEN esp_proposal LIKE '%ecp384' THEN '20' WHEN esp_proposal LIKE '%1024' THEN '2' ELSE '14' END]) AS expected FROM s)
    SELECT session_id, field, expected, value, coalesce(source, 'unavailable') AS source,
      CASE WHEN source <> 'configured' AND expected IS NOT NULL THEN lower(expected) = CASE WHEN field = 'enc' THEN CASE WHEN value LIKE '%GCM%' THEN 'gcm' ELSE 'cbc' END ELSE lower(value) END END AS "match"
    FROM e LEFT JOIN known USING (session_id, field)""", ["sessions_fx", "children_fx", "predictions_fx"])
def _j8_fields(s, c, p):
    """All six fields: a third of the sessions hold a status text only, the others parsed children and a rekey child."""
    st = s.withColumn("status", F.when(F.col("esp_packets") % 7 == 0, "running").otherwise("completed"))
    old = st.filter("esp_packets % 3 = 0").select("session_id")
    state = (_state_text(c).join(old, "session_id", "left_semi").groupBy("session_id")
             .agg(F.concat_ws("", F.array_sort(F.collect_list("sa_state"))).alias("sa_state")))
    legacy = old.join(state, "session_id", "left")
    children = c.join(old, "session_id", "left_anti")
    group = F.when(F.col("spi_in") % 4 == 1, 14).when(F.col("spi_in") % 4 == 2, 20).when(F.col("spi_in") % 4 == 3, 2)
    rekeyed = ev.new_rekey_child(*_split(children)).withColumn("dh_group", group)
    return ev.verify_sessions(st, _spis(children), _sas(p), _labels(s), rekeyed, legacy=legacy)


# --- predictions against labels ---------------------------------------------

KNOWN = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END" for c in ("ike_version", "mode", "enc", "key_bits", "integ", "traffic_top"))
BEST_SQL = f"""best AS (SELECT * FROM predictions_fx QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY {KNOWN} DESC, spi) = 1)"""
query("t6_best_evidence_sa", f"WITH {BEST_SQL} SELECT session_id, spi, mode, enc, integ, traffic_top FROM best", ["predictions_fx"])(
    lambda p: ev.best_evidence_sa(p).select("session_id", "spi", "mode", "enc", "integ", "traffic_top"))

MATCH_SQL = BEST_SQL + """,
    lab AS (SELECT session_id, mode, CASE WHEN esp_proposal LIKE '%gcm%' THEN 'gcm' WHEN esp_proposal LIKE '%cbc%' THEN 'cbc' END AS enc, key_bits,
      CASE WHEN esp_proposal LIKE '%gcm%' THEN 'aead' ELSE nullif(regexp_extract(esp_proposal, '(sha[0-9]+)', 1), '') END AS integ, traffic_type, 1 + len(session_id) % 2 AS ike_version FROM sessions_fx),
    long AS (SELECT l.session_id, unnest(['mode', 'enc', 'key_bits', 'integ', 'ike_version', 'traffic']) AS field,
      unnest([l.mode, l.enc, CAST(l.key_bits AS VARCHAR), l.integ, CAST(l.ike_version AS VARCHAR), l.traffic_type]) AS expected,
      unnest([b.mode, CASE WHEN b.enc LIKE '%GCM%' THEN 'gcm' WHEN b.enc LIKE '%CBC%' THEN 'cbc' END, CAST(b.key_bits AS VARCHAR),
        CASE WHEN b.integ = 'sha1' THEN 'sha1' END, CAST(b.ike_version AS VARCHAR), b.traffic_top]) AS actual
      FROM lab l JOIN best b USING (session_id)),
    m AS (SELECT session_id, field, CASE WHEN actual IS NOT NULL THEN actual = expected END AS match FROM long WHERE expected IS NOT NULL)"""

query("a27_session_accuracy", f"""WITH {MATCH_SQL} SELECT session_id, CAST(count(*) AS BIGINT) AS eligible, CAST(count(match) AS BIGINT) AS compared,
      CAST(count(*) FILTER (WHERE match) AS BIGINT) AS matched, CAST(count(*) FILTER (WHERE match IS NULL) AS BIGINT) AS missing,
      round(count(*) FILTER (WHERE match) / count(*)::DOUBLE, 6) AS match_rate FROM m GROUP BY 1""", ["predictions_fx", "sessions_fx"])(
    lambda p, s: ev.session_accuracy(ev.best_evidence_sa(p), _labels(s)))
query("a28_lab_accuracy", f"""WITH {MATCH_SQL} SELECT field, CAST(count(*) FILTER (WHERE match) AS BIGINT) AS hit, CAST(count(match) AS BIGINT) AS seen,
      CAST(count(*) AS BIGINT) AS eligible FROM m GROUP BY GROUPING SETS ((field), ())""", ["predictions_fx", "sessions_fx"])(
    lambda p, s: ev.lab_accuracy(ev.field_matches(ev.best_evidence_sa(p), _labels(s))))
query("a26_sanity_report", """WITH b AS (SELECT p.session_id, unnest(['mode', 'key_bits']) AS field, unnest([p.mode, CAST(p.key_bits AS VARCHAR)]) AS value,
      unnest([s.mode, CAST(s.key_bits AS VARCHAR)]) AS truth FROM predictions_fx p JOIN sessions_fx s USING (session_id))
    SELECT field, CAST(count(*) FILTER (WHERE lower(value) = lower(coalesce(truth, 'none'))) AS BIGINT) AS hit, CAST(count(*) AS BIGINT) AS seen
    FROM b WHERE value IS NOT NULL GROUP BY GROUPING SETS ((field), ())""", ["predictions_fx", "sessions_fx"])(
    lambda p, s: ev.sanity_report(p, s, fields=("mode", "key_bits")))

REASON = "CASE WHEN esp_packets < 20 OR ike_packets < 1 THEN concat(esp_packets, ' ESP, ', ike_packets, ' IKE') END"
query("a25_session_gate", f"SELECT session_id, {REASON} AS reason FROM sessions_fx", ["sessions_fx"])(lambda s: ev.session_gate(s).select("session_id", "reason"))
query("a24_dataset_summary", f"""SELECT 'sessions' AS item, CAST(count(*) FILTER (WHERE {REASON} IS NULL) AS BIGINT) AS rows FROM sessions_fx
    UNION ALL SELECT 'rejected', count(*) FILTER (WHERE {REASON} IS NOT NULL) FROM sessions_fx
    UNION ALL SELECT 'sa_rows', count(*) FROM predictions_fx UNION ALL SELECT 'windows', count(*) FROM windows_fx""", ["sessions_fx", "predictions_fx", "windows_fx"])(
    lambda s, p, w: ev.dataset_summary(ev.session_gate(s), p, w))


@query("j6_session_listing", """WITH r AS (SELECT session_id, concat(esp_packets, ' ESP, ', ike_packets, ' IKE') AS reason, esp_packets AS rejected_at FROM sessions_fx WHERE esp_packets < 20),
    a AS (SELECT concat('s', capture_id) AS session_id, analysis_id, created, status FROM analyses_fx
      QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY created DESC, analysis_id DESC) = 1)
    SELECT s.session_id, a.analysis_id, a.status, CASE WHEN s.ike_packets * 4 <= r.rejected_at THEN r.reason END AS capture_issue
    FROM sessions_fx s LEFT JOIN a USING (session_id) LEFT JOIN r USING (session_id)""", ["sessions_fx", "analyses_fx"])
def _j6(s, a):
    rejected = ev.session_gate(s, 20).filter("esp_packets < 20").select("session_id", "reason", F.col("esp_packets").alias("rejected_at"))
    an = a.withColumn("session_id", F.concat(F.lit("s"), F.col("capture_id").cast("string")))
    return ev.session_listing(s.withColumn("manifest_at", F.col("ike_packets") * 4), an, rejected).select("session_id", "analysis_id", "status", "capture_issue")


@query("j9_missing_sessions", """WITH p AS (SELECT DISTINCT profile FROM sessions_fx),
    plan AS (SELECT profile, t AS traffic_type, CAST(n AS BIGINT) AS repetition, printf('%s-%s-%04d', profile, t, n) AS session_id FROM p,
      (VALUES ('icmp'), ('web'), ('email'), ('voip'), ('video'), ('messaging'), ('bulk')) v(t), range(1, 6) r(n))
    SELECT * FROM plan WHERE session_id NOT IN (SELECT printf('%s-%s-%04d', profile, traffic_type, 1 + CAST(esp_packets % 5 AS INT)) FROM sessions_fx)""", ["sessions_fx"])
def _j9(s):
    valid = s.select(F.format_string("%s-%s-%04d", "profile", "traffic_type", 1 + F.col("esp_packets") % 5).alias("session_id"))
    return ev.missing_sessions(s.select("profile").distinct(), valid=valid)


# --- metrics ----------------------------------------------------------------

query("a23_class_profile_counts", "SELECT CAST(label AS BIGINT) AS label, CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT profile) AS BIGINT) AS profiles FROM scored_fx GROUP BY 1", ["scored_fx"])(mt.class_profile_counts)
query("a29_classification_metrics", """WITH d AS (SELECT label AS l, CASE WHEN p1 >= 0.6 THEN 1 ELSE 0 END AS p FROM scored_fx),
    c AS (SELECT k, count(*) FILTER (WHERE l = k AND p = k) AS tp, count(*) FILTER (WHERE l = k) AS s, count(*) FILTER (WHERE p = k) AS y FROM d, (VALUES (0), (1)) v(k) GROUP BY k)
    SELECT round(sum(tp)/sum(s)::DOUBLE, 6) AS accuracy, round(avg(2*tp/(s + y)::DOUBLE), 6) AS macro_f1, CAST(sum(s) AS BIGINT) AS rows FROM c WHERE s + y > 0""", ["scored_fx"])(
    lambda s: mt.classification_metrics(s.withColumn("pred", (F.col("p1") >= 0.6).cast("int"))))
query("a30_binary_metrics", """WITH c AS (SELECT count(*) FILTER (WHERE p1 >= 0.75 AND label = 1) AS tp, count(*) FILTER (WHERE p1 >= 0.75 AND label = 0) AS fp,
      count(*) FILTER (WHERE p1 < 0.75 AND label = 1) AS fn FROM scored_fx)
    SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(coalesce(tp/nullif(tp + fp, 0), 0), 6) AS precision,
      round(coalesce(tp/nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2*tp/nullif(2*tp + fp + fn, 0), 0), 6) AS f1 FROM c""", ["scored_fx"])(mt.binary_metrics)
query("a31_average_precision", """WITH g AS (SELECT p1, sum(label) AS pos, count(*) AS n FROM scored_fx GROUP BY 1),
    c AS (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM g WINDOW w AS (ORDER BY p1 DESC))
    SELECT round(sum(pos * (tp/seen::DOUBLE))/sum(pos), 6) AS pr_auc FROM c""", ["scored_fx"])(mt.average_precision)
query("a32_ece", """WITH c AS (SELECT greatest(p1, 1 - p1) AS conf, CASE WHEN (CASE WHEN p1 > 1 - p1 THEN 1 ELSE 0 END) = label THEN 1.0 ELSE 0.0 END AS ok FROM scored_fx),
    b AS (SELECT ceil(conf*15) AS b, count(*) AS n, avg(ok) AS acc, avg(conf) AS conf FROM c WHERE ceil(conf*15) > 0 GROUP BY 1)
    SELECT round(sum(n*abs(acc - conf))/(SELECT count(*) FROM c), 6) AS ece FROM b""", ["scored_fx"])(
    lambda s: mt.ece(s.withColumn("conf", F.greatest(F.col("p1"), 1 - F.col("p1"))).withColumn("correct", (F.col("p1") > 1 - F.col("p1")).cast("int") == F.col("label"))))
SCORES = "(SELECT 1 - CASE WHEN label = 1 THEN p1 ELSE 1 - p1 END AS score FROM scored_fx)"
query("a33_conformal_q", f"""WITH s AS {SCORES}, n AS (SELECT count(*) AS n FROM s),
    r AS (SELECT score, row_number() OVER (ORDER BY score) AS rn FROM s)
    SELECT round(min(score), 6) AS q FROM r, n WHERE rn >= ceil(round(least(1.0, ceil((n + 1)*(1 - 0.1::DOUBLE))/n)*(n - 1), 9)) + 1""", ["scored_fx"])(
    lambda s: mt.conformal_q(s.withColumn("score", 1 - F.when(F.col("label") == 1, F.col("p1")).otherwise(1 - F.col("p1")))))
query("a34_conformal_coverage", """SELECT round(avg(CASE WHEN CASE WHEN label = 1 THEN p1 ELSE 1 - p1 END >= 1 - 0.75 THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM scored_fx""", ["scored_fx"])(
    lambda s: mt.conformal_coverage(s.withColumn("p_true", F.when(F.col("label") == 1, F.col("p1")).otherwise(1 - F.col("p1"))), q=0.75))

query("v1_check_binary_label", "SELECT event_id AS row_no, event_id % 3 AS label FROM events WHERE event_id % 3 NOT IN (0, 1)", ["domains_fx"])(
    lambda d: mt.check_binary_label(d.withColumn("label", F.col("row_no") % 3)).select("row_no", "label"))
query("v2_conflicting_labels", """SELECT domain, CAST(count(*) AS BIGINT) AS rows FROM domains_fx GROUP BY 1 HAVING count(DISTINCT (row_no % 7) % 2) > 1""", ["domains_fx"])(
    lambda d: mt.conflicting_labels(d.withColumn("label", (F.col("row_no") % 7) % 2)))
query("v3_head_gate", """WITH d AS (SELECT * FROM scored_fx WHERE label IS NOT NULL AND rekey_count > 0), c AS (SELECT label, count(DISTINCT profile) AS seen FROM d GROUP BY 1)
    SELECT *, rows >= 100 AND classes >= 2 AND profiles >= 5 AND (classes <> 2 OR least_profiles >= 4) AS trainable FROM (
      SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT label) AS BIGINT) AS classes, CAST((SELECT coalesce(min(seen), 0) FROM c) AS BIGINT) AS least_profiles,
        CAST(count(DISTINCT profile) AS BIGINT) AS profiles FROM d)""", ["scored_fx"])(
    lambda s: mt.head_gate(s, rekey_only=True))
query("v4_threat_gate", """SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT scenario_id) AS BIGINT) AS scenarios, count(DISTINCT label) = 2 AS both_labels,
      count(*) >= 200 AND count(DISTINCT scenario_id) >= 5 AND count(DISTINCT label) = 2 AS trainable FROM domains_fx""", ["domains_fx"])(mt.threat_gate)
query("v5_manifest_violations", """SELECT session_id, unnest(list_filter([CASE WHEN ike_packets = 0 THEN 'missing keys' END, CASE WHEN esp_packets % 10 = 0 THEN 'profile pattern' END,
      CASE WHEN esp_packets % 11 = 0 THEN 'traffic_type' END, CASE WHEN esp_packets % 13 = 0 THEN 'mode' END], lambda x: x IS NOT NULL)) AS violation FROM sessions_fx""", ["sessions_fx"])(
    lambda s: mt.manifest_violations(s.select(
        "session_id", F.when(F.col("esp_packets") % 10 == 0, "q1").otherwise(F.col("profile")).alias("profile"),
        F.when(F.col("esp_packets") % 11 == 0, "game").otherwise(F.col("traffic_type")).alias("traffic_type"),
        F.when(F.col("ike_packets") > 0, "k").alias("keys"),
        F.struct(F.when(F.col("esp_packets") % 13 == 0, "both").otherwise(F.col("mode")).alias("mode"), "key_bits").alias("labels"))))
query("v6_drop_incomplete", "SELECT session_id, spi FROM predictions_fx WHERE mode IS NOT NULL AND enc IS NOT NULL AND key_bits IS NOT NULL", ["predictions_fx"])(
    lambda p: mt.drop_incomplete(p, ["mode", "enc", "key_bits"]).select("session_id", "spi"))
query("t9_first_per_key", "SELECT domain, label, scenario_id, row_no FROM domains_fx QUALIFY row_number() OVER (PARTITION BY domain ORDER BY row_no) = 1", ["domains_fx"])(
    lambda d: first_per_key(d, "domain", "row_no"))

# --- gates and cards --------------------------------------------------------

TASKS = "CASE doc_id % 6 WHEN 0 THEN 'mode' WHEN 1 THEN 'cipher' WHEN 2 THEN 'integ' WHEN 3 THEN 'pfs' WHEN 4 THEN 'dh_group' ELSE 'traffic' END"


def _metrics(s):
    task = F.element_at(F.array(*[F.lit(t) for t in ("mode", "cipher", "integ", "pfs", "dh_group", "traffic")]), (F.col("doc_id") % 6 + 1).cast("int"))
    return s.select("doc_id", task.alias("task"), F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("version"), (0.7 + F.col("p1") * 0.3).alias("macro_f1"),
                    (F.col("p1") * 0.12).alias("ece"), (0.8 + (1 - F.col("p1")) * 0.2).alias("coverage"))


METRICS_SQL = f"met AS (SELECT doc_id, {TASKS} AS task, concat('v', doc_id) AS version, 0.7::DOUBLE + p1*0.3::DOUBLE AS macro_f1, p1*0.12::DOUBLE AS ece, 0.8::DOUBLE + (1 - p1)*0.2::DOUBLE AS coverage FROM scored_fx)"
FLOOR = "CASE task WHEN 'mode' THEN 0.9 WHEN 'cipher' THEN 0.95 WHEN 'integ' THEN 0.95 WHEN 'pfs' THEN 0.9 ELSE 0.8 END"
query("m8_promote", f"WITH {METRICS_SQL} SELECT doc_id, task, macro_f1 >= {FLOOR} AND ece <= 0.08 AND coverage >= 0.85 AS promoted FROM met", ["scored_fx"])(
    lambda s: mt.promote(_metrics(s), mt.HEAD_PROMOTION).select("doc_id", "task", "promoted"))

REPORT_SQL = f"""{METRICS_SQL}, reg AS (SELECT task, arg_max(version, doc_id) AS version FROM met WHERE macro_f1 >= 0.9 GROUP BY 1),
    att AS (SELECT task, arg_max(macro_f1, doc_id) AS macro_f1, arg_max(ece, doc_id) AS ece, arg_max(coverage, doc_id) AS coverage FROM met GROUP BY 1),
    rep AS (SELECT task, coalesce(reg.version, 'untrained') AS version, CASE WHEN met.macro_f1 IS NOT NULL THEN 'promoted' ELSE 'not_promoted' END AS status,
      coalesce(met.macro_f1, att.macro_f1) AS macro_f1, coalesce(met.ece, att.ece) AS ece, coalesce(met.coverage, att.coverage) AS coverage
      FROM att LEFT JOIN reg USING (task) LEFT JOIN met USING (task, version))"""


def _report(s):
    m = _metrics(s)
    reg = m.filter("macro_f1 >= 0.9").groupBy("task").agg(F.max_by("version", "doc_id").alias("version"))
    att = m.groupBy("task").agg(*[F.max_by(c, "doc_id").alias(c) for c in ("macro_f1", "ece", "coverage")])
    return mt.metrics_report(reg, m.drop("doc_id"), att)


query("j12_metrics_report", f"WITH {REPORT_SQL} SELECT task, version, status, round(macro_f1, 6) AS macro_f1, round(ece, 6) AS ece, round(coverage, 6) AS coverage FROM rep", ["scored_fx"])(_report)
query("m10_model_card", f"""WITH {REPORT_SQL} SELECT task, concat('| ', task, ' | ', version, ' | ', round(macro_f1, 4), ' | ', round(ece, 4), ' | ', round(coverage, 4), ' |') AS line FROM rep""", ["scored_fx"])(
    lambda s: mt.model_card(_report(s).withColumns({c: F.round(c, 4) for c in ("macro_f1", "ece", "coverage")})))
