"""Inference and posture queries."""

from pyspark.sql import functions as F

from wiretally import constants as C
from wiretally.operators import sa
from wiretally.plans import analysis, inference, posture, serving
from wiretally.registry.base import query
from wiretally.registry.features import STRUCTURE_SQL
from wiretally.session import stage

RULES = posture.load_pack("baseline")
CNSA = posture.load_pack("cnsa2")


def with_conf(sas):
    """The SA view gives one confidence for all known fields."""
    return sas.withColumns({f"{f}_conf": F.when(F.col(f).isNotNull(), F.col("conf")) for f in posture.RULE_FIELDS})


def _sql_conf(rule, exact=False):
    names = posture._named_fields(rule["when"], exact)
    confs = [f"CASE WHEN {f} IS NOT NULL THEN conf END" for f in names]
    if "traffic" in rule["when"]:
        confs.append("traffic_confidence")
    return f"coalesce(round(least({', '.join(confs)}, NULL), 4), 0.5)" if confs else "0.5"


def findings_sql(rules, exact=False):
    return " UNION ALL ".join(
        f"SELECT analysis_id, spi, '{r['id']}' AS rule_id, '{r['severity']}' AS severity, CAST({r['likelihood']} AS DOUBLE) AS likelihood, "
        f"CAST({_sql_conf(r, exact)} AS DOUBLE) AS confidence FROM sa_fx WHERE {r['when']}" for r in rules)


COLS = ["analysis_id", "spi", "rule_id", "severity", "likelihood", "confidence"]
query("j1_evaluate_rules", findings_sql(RULES), ["sa_fx"])(lambda s: posture.evaluate_rules(with_conf(s), RULES).select(*COLS))
query("i14_rule_predicates_cnsa2", findings_sql(CNSA), ["sa_fx"])(lambda s: posture.evaluate_rules(with_conf(s), CNSA).select(*COLS))
query("i15_finding_confidence_exact", findings_sql(RULES, True), ["sa_fx"])(
    lambda s: posture.evaluate_rules(with_conf(s), RULES, exact_fields=True).select(*COLS))

query("i14_rule_predicates", "SELECT analysis_id, spi, " + ", ".join(f"({r['when']}) AS \"{r['id']}\"" for r in RULES) + " FROM sa_fx", ["sa_fx"])(
    lambda s: s.select("analysis_id", "spi", *[c.alias(k) for k, c in posture.rule_predicates(RULES).items()]))

WEIGHT = "CASE severity WHEN 'low' THEN 1.0::DOUBLE WHEN 'medium' THEN 3 WHEN 'high' THEN 6 WHEN 'critical' THEN 10 ELSE 0 END"
# Half-to-even at two places on the exact decimal sum.
SCORE_SQL = f"""risk AS (SELECT {{by}} AS analysis_id, sum(CAST({WEIGHT} * likelihood * confidence AS DECIMAL(18,8))) AS r FROM {{src}} GROUP BY 1),
    scored AS (SELECT analysis_id, CAST((floor(r*100) + CASE WHEN r*100 - floor(r*100) > 0.5 OR (r*100 - floor(r*100) = 0.5 AND floor(r*100) % 2 = 1) THEN 1 ELSE 0 END) AS DOUBLE)/100 AS risk_score,
      CAST(trunc(greatest(0, 100 - r*4)) AS BIGINT) AS security_score FROM risk)"""
GRADE = "CASE WHEN {0} >= 90 THEN 'A' WHEN {0} >= 80 THEN 'B' WHEN {0} >= 70 THEN 'C' WHEN {0} >= 55 THEN 'D' WHEN {0} IS NOT NULL THEN 'E' END"
FEW = "per_sa AS (SELECT concat(analysis_id, ':', spi) AS analysis_id, severity, likelihood, confidence FROM f)"
query("a15_posture_score", f"WITH f AS ({findings_sql(RULES)}), {FEW}, {SCORE_SQL.format(by='analysis_id', src='per_sa')} SELECT *, {GRADE.format('security_score')} AS grade FROM scored",
      ["sa_fx"])(lambda s: posture.posture_score(posture.evaluate_rules(with_conf(s), RULES).withColumn(
          "analysis_id", F.concat_ws(":", "analysis_id", F.col("spi").cast("string")))))
query("a16_ai_confidence", "SELECT analysis_id, round(max(traffic_confidence), 4) AS ai_confidence FROM sa_fx GROUP BY 1", ["sa_fx"])(posture.ai_confidence)


@query("a17_threat_matrix", """WITH g AS (SELECT analysis_id, b AS bucket, s AS impact FROM (SELECT DISTINCT analysis_id FROM findings_fx),
      range(1, 6) t(b), (VALUES ('info'), ('low'), ('medium'), ('high'), ('critical')) v(s)),
    f AS (SELECT analysis_id, least(5, greatest(1, CAST(trunc(likelihood*5) AS INT) + 1)) AS bucket, severity AS impact, count(*) AS n,
      array_to_string(list_sort(list(DISTINCT rule_id)), ',') AS rules FROM findings_fx GROUP BY 1, 2, 3)
    SELECT g.analysis_id, g.bucket, g.impact, CAST(coalesce(n, 0) AS BIGINT) AS findings, coalesce(rules, '') AS rules
    FROM g LEFT JOIN f USING (analysis_id, bucket, impact)""", ["findings_fx"])
def _a17(f):
    return posture.threat_matrix(f).withColumn("rules", F.array_join("rules", ","))


query("i16_compliance", """SELECT analysis_id, spi, CASE WHEN ok THEN 'pass' ELSE 'fail' END AS rfc_8221, CASE WHEN ok THEN 'pass' ELSE 'fail' END AS rfc_8247,
      CASE WHEN ok AND dh NOT IN ('MODP-1024', 'MODP-1536') THEN 'pass' ELSE 'fail' END AS nist_800_77r1,
      CASE WHEN enc LIKE '%AES-GCM%' AND enc LIKE '%256%' AND dh IN ('ECP-384', 'ECP-521') THEN 'pass' ELSE 'fail' END AS cnsa_2_0
    FROM (SELECT *, coalesce(dh_group, '') AS dh, coalesce(enc, '') NOT LIKE '%DES%' AND coalesce(integ, '') NOT LIKE '%SHA1%' AS ok FROM sa_fx)""", ["sa_fx"])(
    lambda s: posture.compliance(s).select("analysis_id", "spi", "rfc_8221", "rfc_8247", "nist_800_77r1", "cnsa_2_0"))
query("i17_exposure", """SELECT analysis_id, spi, concat_ws(',', CASE WHEN mode = 'transport' THEN 'endpoints' END, CASE WHEN ike_version = 1 THEN 'ikev1_aggressive' END,
      'traffic_fingerprint') AS exposure, traffic_top AS exposed_class, round(traffic_confidence, 6) AS exposure_confidence FROM sa_fx""", ["sa_fx"])(
    lambda s: posture.exposure(s).select("analysis_id", "spi", F.array_join("exposure", ",").alias("exposure"), "exposed_class", "exposure_confidence"))

SNIPPETS_SQL = ", ".join("('%s', '%s')" % (k, v.replace("'", "''")) for k, v in C.REMEDIATION.items())
query("i18_remediation", f"""WITH f AS (SELECT rule_id, count(*) AS n FROM findings_fx GROUP BY 1)
    SELECT f.rule_id, CAST(n AS BIGINT) AS n, coalesce(s, '{C.REMEDIATION_DEFAULT}') AS snippet FROM f LEFT JOIN (VALUES {SNIPPETS_SQL}) v(r, s) ON r = rule_id""", ["findings_fx"])(
    lambda f: posture.remediation(f).groupBy("rule_id", "snippet").agg(F.count(F.lit(1)).alias("n")))

TAGS = "CASE WHEN {0} IS NULL THEN 'unknown' ELSE '{1}' END"
query("i1_cipher_mode", f"""WITH {STRUCTURE_SQL} SELECT capture_id, spi, CASE WHEN sure THEN 'GCM' END AS enc, CASE WHEN sure THEN 'inferred' ELSE 'unknown' END AS tag,
      CASE WHEN sure THEN round(consistency, 4) ELSE 0 END AS confidence FROM (SELECT *, consistency >= 0.95 AND cipher_mode = 'GCM' AS sure FROM structure)""", ["esp_fx"])(
    lambda e: sa.esp_structure(e).withColumn("t", inference.cipher_mode()).select("capture_id", "spi", F.col("t.value").alias("enc"), "t.tag", "t.confidence"))
query("i2_integrity", f"""WITH {STRUCTURE_SQL} SELECT capture_id, spi, CASE WHEN consistency >= 0.95 AND cipher_mode = 'GCM' THEN 'AEAD' END AS integ FROM structure""", ["esp_fx"])(
    lambda e: sa.esp_structure(e).withColumn("t", inference.integrity()).select("capture_id", "spi", F.col("t.value").alias("integ")))
query("i3_key_size", """SELECT session_id, CAST(CASE WHEN esp_proposal LIKE '%-256%' THEN 256 WHEN esp_proposal LIKE '%-128%' THEN 128 END AS BIGINT) AS key_bits,
      CASE WHEN esp_proposal LIKE '%-256%' OR esp_proposal LIKE '%-128%' THEN CAST(0.7 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS confidence
    FROM (SELECT session_id, replace(replace(esp_proposal, 'aes256', 'AES-256'), 'aes128', 'AES-128') AS esp_proposal FROM sessions_fx)""", ["sessions_fx"])(
    lambda s: s.withColumn("ike_enc", F.replace(F.replace("esp_proposal", F.lit("aes256"), F.lit("AES-256")), F.lit("aes128"), F.lit("AES-128")))
    .withColumn("t", inference.key_size()).select("session_id", F.col("t.value").alias("key_bits"), "t.confidence"))
query("i4_nat_t", "SELECT capture_id, spi, bool_or(udp_encapsulated) AS nat_t, 'observed' AS tag FROM esp_fx GROUP BY 1, 2", ["esp_fx"])(
    lambda e: sa.sa_tracks(e).withColumn("t", inference.nat_t()).select("capture_id", "spi", F.col("t.value").alias("nat_t"), "t.tag"))
query("i7_tunnel_mode", """SELECT doc_id, CASE WHEN p >= 0.5 THEN 'tunnel' ELSE 'transport' END AS mode, round(p, 4) AS confidence
    FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 0.7*p1 + 0.3*0.4 ELSE p1 END AS p FROM scored_fx)""", ["scored_fx"])(
    lambda s: s.withColumn("t", inference.tunnel_mode(F.col("p1"), F.when(F.col("doc_id") % 2 == 0, 0.4))).select("doc_id", F.col("t.value").alias("mode"), "t.confidence"))
query("i8_gate_on_rekey", """SELECT doc_id, CASE WHEN rekey_count > 0 THEN label = 1 END AS pfs, CASE WHEN rekey_count > 0 THEN 'inferred' ELSE 'unknown' END AS tag FROM scored_fx""", ["scored_fx"])(
    lambda s: s.withColumn("t", inference.gate_on_rekey(F.struct((F.col("label") == 1).alias("value"), F.lit("inferred").alias("tag"), F.col("p1").alias("confidence"))))
    .select("doc_id", F.col("t.value").alias("pfs"), "t.tag"))


def _probs(s):
    return s.withColumn("probs", F.array((F.col("p1") * 0.5), (1 - F.col("p1")) * 0.7, F.col("p1") * 0.5 + (1 - F.col("p1")) * 0.3))


PROBS = "(SELECT doc_id, [('a', p1*0.5), ('b', (1-p1)*0.7), ('c', p1*0.5 + (1-p1)*0.3)] AS pr FROM scored_fx)"
CLASSES = ("a", "b", "c")


@query("i11_conformal_sets", f"""WITH l AS (SELECT doc_id, unnest(pr)[1] AS c, unnest(pr)[2] AS p FROM {PROBS}),
    g AS (SELECT doc_id, arg_max(c, (p, -ascii(c))) AS prediction, max(p) AS p_top, array_to_string(list_sort(list(c) FILTER (WHERE p >= 1.0 - 0.6)), ',') AS s FROM l GROUP BY 1)
    SELECT doc_id, prediction, round(p_top, 6) AS p_top, coalesce(s, prediction) AS prediction_set,
      round(p_top / greatest(1, len(string_split(coalesce(s, prediction), ','))), 6) AS set_confidence FROM g""", ["scored_fx"])
def _i11(s):
    out = inference.conformal_sets(_probs(s), 0.6, CLASSES)
    return out.select("doc_id", "prediction", "p_top", F.array_join("prediction_set", ",").alias("prediction_set"), "set_confidence")


query("i12_aps_sets", f"""WITH l AS (SELECT doc_id, unnest(pr)[1] AS c, unnest(pr)[2] AS p FROM {PROBS}),
    r AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY doc_id ORDER BY p DESC, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l)
    SELECT doc_id, string_agg(c, ',' ORDER BY p DESC, c) AS aps_set FROM r WHERE before < 1.0 - 0.3 GROUP BY 1""", ["scored_fx"])(
    lambda s: inference.aps_sets(_probs(s), 0.3, CLASSES).select("doc_id", F.array_join("aps_set", ",").alias("aps_set")))

VOTE_SQL = """v AS (SELECT spi, pred, count(*) AS n, avg(p) AS p, min(win) AS first FROM windows_fx GROUP BY 1, 2)"""
query("a13_majority_vote", f"WITH {VOTE_SQL} SELECT spi, arg_max(pred, (n, -first)) AS traffic_top, round(arg_max(p, (n, -first)), 4) AS traffic_confidence FROM v GROUP BY 1", ["windows_fx"])(
    inference.aggregate_votes)
query("a14_union_of_sets", "SELECT spi, string_agg(DISTINCT pred, ',' ORDER BY pred) AS conformal_set FROM windows_fx GROUP BY 1", ["windows_fx"])(
    lambda w: inference.union_of_sets(w.withColumn("prediction_set", F.array("pred"))).withColumn("conformal_set", F.array_join("conformal_set", ",")))

# One statement for the whole ESP slice: structure, lifetime, replay, rules, score.
SLICE_SQL = f"""WITH {STRUCTURE_SQL},
    tr AS (SELECT capture_id, spi, min(ts_us) AS f, max(ts_us) AS l, bool_or(udp_encapsulated) AS nat, bool_or(seq > 4294967295) AS esn0 FROM esp_fx GROUP BY 1, 2),
    sq AS (SELECT capture_id, spi, seq, lag(seq) OVER (PARTITION BY capture_id, spi ORDER BY packet_no, seq) AS prev FROM esp_fx),
    rp AS (SELECT capture_id, spi, count(*) FILTER (WHERE prev - seq > 2147483647) AS resets FROM sq GROUP BY 1, 2),
    flat AS (SELECT capture_id AS analysis_id, spi, CASE WHEN consistency >= 0.95 AND cipher_mode = 'GCM' THEN 'AES-GCM-16' END AS enc,
      CASE WHEN consistency >= 0.95 AND cipher_mode = 'GCM' THEN round(consistency, 4) END AS enc_conf,
      CASE WHEN consistency >= 0.95 AND cipher_mode = 'GCM' THEN 'AEAD' END AS integ,
      CASE WHEN l - f >= 1000000 THEN CAST(round_even((l - f)/1e6, 0) AS BIGINT) END AS rekey_interval_s,
      CASE WHEN resets > 0 THEN 0 END AS replay_window, CASE WHEN esn0 THEN true END AS esn,
      NULL::VARCHAR AS dh_group, NULL::BOOLEAN AS pfs, NULL::VARCHAR AS mode, NULL::INT AS key_bits, NULL::INT AS ike_version, 0.0 AS traffic_confidence
      FROM structure JOIN tr USING (capture_id, spi) JOIN rp USING (capture_id, spi)),
    hits AS (""" + " UNION ALL ".join(
    f"SELECT analysis_id, spi, '{r['id']}' AS rule_id, '{r['severity']}' AS severity, {r['likelihood']} AS likelihood, "
    + ("coalesce(enc_conf, 0.5)" if "enc" in r["when"] and "traffic" not in r["when"] else
       "CASE WHEN true THEN 1.0 END" if any(x in r["when"] for x in ("rekey_interval_s", "replay_window", "esn")) else
       "coalesce(CASE WHEN integ IS NOT NULL THEN enc_conf END, 0.5)" if "integ" in r["when"] else "0.5")
    + f" AS confidence FROM flat WHERE {r['when']}" for r in RULES) + ")"

query("i9_sa_evidence", SLICE_SQL + " SELECT analysis_id, spi, enc, enc_conf, integ, rekey_interval_s, CAST(replay_window AS BIGINT) AS replay_window, esn FROM flat", ["esp_fx"])(
    lambda e: analysis.analyse_esp(e, RULES)["sas"].select("analysis_id", "spi", "enc", "enc_conf", "integ", "rekey_interval_s", "replay_window", "esn"))
# Probabilities that stand in for served heads, from the SPI and the window; the other side of each is the rest to one.
HEADS = {"mode": ("transport", "tunnel", "CAST(spi % 11 AS DOUBLE)/10.5"), "cipher": ("AES-CBC", "AES-GCM-16", "CAST(spi % 13 AS DOUBLE)/12.5"),
         "pfs": ("false", "true", "CAST(spi % 7 AS DOUBLE)/6.5"), "dh_group": ("14", "19", "CAST(spi % 9 AS DOUBLE)/8.5")}
TRAFFIC_HEAD = ("bulk", "web", "CAST((spi + win_us/5000000) % 17 AS DOUBLE)/16.5")
Q = 0.4


def _head(no, yes, text):
    p = F.expr(text.replace("win_us/5000000", "win_us div 5000000"))
    return serving.Head(lambda df: df.withColumn("probs", F.array(1 - p, p)), [no, yes], Q, "v1")


def _pick(no, yes, text, name):
    size = f"(CASE WHEN p{name} >= 1.0 - {Q} THEN 1 ELSE 0 END + CASE WHEN 1 - p{name} >= 1.0 - {Q} THEN 1 ELSE 0 END)"
    return (f"CASE WHEN p{name} > 1 - p{name} THEN '{yes}' ELSE '{no}' END AS {name}_pred, greatest(p{name}, 1 - p{name}) / greatest({size}, 1) AS {name}_p")


_SERVED = ", ".join(f"{h[2]} AS p{n}" for n, h in HEADS.items())
SCORES_SQL = f"""{SLICE_SQL}, hp AS (SELECT DISTINCT capture_id, spi, {_SERVED} FROM esp_fx),
    hs AS (SELECT capture_id AS analysis_id, spi, {', '.join(_pick(*h, n) for n, h in HEADS.items())} FROM hp),
    wp AS (SELECT *, {TRAFFIC_HEAD[2].replace('win_us/5000000', 'win_us//5000000')} AS pw FROM (SELECT DISTINCT capture_id, spi, ts_us - ts_us % 5000000 AS win_us FROM esp_fx)),
    ws AS (SELECT *, {_pick(*TRAFFIC_HEAD, 'w')}, list_filter([CASE WHEN pw >= 1.0 - {Q} THEN 'web' END, CASE WHEN 1 - pw >= 1.0 - {Q} THEN 'bulk' END], lambda x: x IS NOT NULL) AS s0 FROM wp),
    wv AS (SELECT capture_id, spi, w_pred, count(*) AS n, avg(w_p) AS p, min(win_us) AS first FROM ws GROUP BY 1, 2, 3),
    wt AS (SELECT capture_id AS analysis_id, spi, arg_max(w_pred, (n, -first)) AS top, arg_max(p, (n, -first)) AS p FROM wv GROUP BY 1, 2),
    wu AS (SELECT analysis_id, spi, array_to_string(list_sort(list(DISTINCT c)), ',') AS sets FROM (SELECT capture_id AS analysis_id, spi, unnest(CASE WHEN len(s0) > 0 THEN s0 ELSE [w_pred] END) AS c FROM ws) GROUP BY 1, 2),
    rk AS (SELECT DISTINCT capture_id AS analysis_id, CAST(right(capture_id, 1) AS INT) % 2 AS rekeyed FROM esp_fx)
    SELECT analysis_id, spi, mode_pred AS mode, round(mode_p, 6) AS mode_conf, cipher_pred AS enc, round(cipher_p, 6) AS enc_conf, integ,
      CASE WHEN rekeyed = 1 THEN pfs_pred = 'true' END AS pfs, CASE WHEN rekeyed = 1 THEN dh_group_pred END AS dh_group,
      top AS traffic_top, round(wt.p, 4) AS traffic_confidence, sets AS conformal_set
    FROM flat JOIN hs USING (analysis_id, spi) JOIN wt USING (analysis_id, spi) JOIN wu USING (analysis_id, spi) JOIN rk USING (analysis_id)"""


@query("i9_with_scores", SCORES_SQL, ["esp_fx"])
def _i9_scored(e):
    """Every head served: SA scores and window votes flow into the evidence; rekeys open pfs and dh_group in half of the captures."""
    heads = {n: _head(*h) for n, h in HEADS.items()} | {"traffic": _head(*TRAFFIC_HEAD)}
    # Staged, so that heads score a window and an SA once: filters on their results would be moved down to the packets, in a scan for each use.
    cut = stage(e.select("capture_id", "spi", (F.col("ts_us") - F.pmod("ts_us", F.lit(5_000_000))).alias("win_us")).distinct())
    sas = stage(cut.select("capture_id", "spi").distinct())
    rekeys = sas.select("capture_id").distinct().withColumn("rekey_count", F.substring("capture_id", -1, 1).cast("long") % 2)
    traffic = serving.traffic_of(serving.score_windows(cut, heads))
    out = analysis.analyse_esp(e, RULES, rekeys=rekeys, scores=serving.score_sas(sas, heads), traffic=traffic)
    sets = out["evidence"].select(F.col("capture_id").alias("analysis_id"), "spi", F.array_join("conformal_set", ",").alias("conformal_set"))
    return out["sas"].join(sets, ["analysis_id", "spi"]).select("analysis_id", "spi", "mode", "mode_conf", "enc", "enc_conf", "integ", "pfs", "dh_group",
                                                               "traffic_top", "traffic_confidence", "conformal_set")


POSTURE_SQL = SLICE_SQL + f""", padded AS (SELECT analysis_id, severity, likelihood, confidence FROM hits
      UNION ALL SELECT DISTINCT analysis_id, 'info', 0, 0 FROM flat), {SCORE_SQL.format(by='analysis_id', src='padded')}
    SELECT *, {GRADE.format('security_score')} AS grade FROM scored"""
query("entry_esp_posture", POSTURE_SQL, ["esp_fx"])(
    lambda e: analysis.analyse_esp(e, RULES)["posture"])


@query("i19_report_context", views=["sa_fx"])
def _i19(s):
    sas = with_conf(s)
    out = posture.report_context(posture.evaluate_rules(sas, RULES), sas)
    return out.select("analysis_id", "risk_score", "security_score", "grade", "ai_confidence", F.to_json("severity_counts").alias("severity_counts"),
                      F.to_json("top_findings").alias("top_findings"), F.to_json("threat_matrix").alias("threat_matrix"))


@query("i19_report_counts", f"""WITH f AS ({findings_sql(RULES)}), {SCORE_SQL.format(by='analysis_id', src='f')},
    sev AS (SELECT analysis_id, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high,
      count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low FROM f GROUP BY 1),
    c AS (SELECT analysis_id, coalesce(enc, '') NOT LIKE '%DES%' AND coalesce(integ, '') NOT LIKE '%SHA1%' AS ok, coalesce(dh_group, '') AS dh, coalesce(enc, '') AS enc,
      traffic_confidence FROM sa_fx),
    k AS (SELECT analysis_id, round(max(traffic_confidence), 4) AS ai_confidence, count(*) AS sas, count(*) FILTER (WHERE ok) AS rfc, count(*) FILTER (WHERE ok AND dh NOT IN ('MODP-1024', 'MODP-1536')) AS nist,
      count(*) FILTER (WHERE enc LIKE '%AES-GCM%' AND enc LIKE '%256%' AND dh IN ('ECP-384', 'ECP-521')) AS cnsa FROM c GROUP BY 1)
    SELECT analysis_id, coalesce(risk_score, 0) AS risk_score, coalesce(security_score, 100) AS security_score, {GRADE.format('coalesce(security_score, 100)')} AS grade, ai_confidence,
      CAST(coalesce(critical, 0) AS BIGINT) AS critical, CAST(coalesce(high, 0) AS BIGINT) AS high, CAST(coalesce(medium, 0) AS BIGINT) AS medium, CAST(coalesce(low, 0) AS BIGINT) AS low,
      CAST(rfc AS BIGINT) AS rfc_pass, CAST(sas - rfc AS BIGINT) AS rfc_fail, CAST(nist AS BIGINT) AS nist_pass, CAST(sas - nist AS BIGINT) AS nist_fail, CAST(cnsa AS BIGINT) AS cnsa_pass
    FROM k LEFT JOIN scored USING (analysis_id) LEFT JOIN sev USING (analysis_id)""", ["sa_fx"])
def _i19_counts(s):
    """The numbers of each report."""
    sas = with_conf(s)
    out = posture.report_context(posture.evaluate_rules(sas, RULES), sas)
    suite = lambda name, verdict: F.col(f"compliance.{name}.{verdict}")
    return out.select("analysis_id", "risk_score", "security_score", "grade", "ai_confidence", *[F.col(f"severity_counts.{n}").alias(n) for n in ("critical", "high", "medium", "low")],
                      suite("rfc_8221", "pass").alias("rfc_pass"), suite("rfc_8247", "fail").alias("rfc_fail"), suite("nist_800_77r1", "pass").alias("nist_pass"),
                      suite("nist_800_77r1", "fail").alias("nist_fail"), suite("cnsa_2_0", "pass").alias("cnsa_pass"))
