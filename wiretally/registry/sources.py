"""Source and sink queries: the row work of readers and writers on data derived from the tables."""

import uuid

from pyspark.sql import functions as F

from wiretally.functions.net import spi_text
from wiretally.operators import evidence as ev
from wiretally.plans import posture
from wiretally.registry.base import query
from wiretally.registry.packets import FEATURES_SQL, _frames, _h
from wiretally.registry.posture import RULES, findings_sql, with_conf
from wiretally.session import checkpoint_folder, stage
from wiretally.sources import captures, ranges, tables


def _pcap_files(spark, d):
    """Every frame of the events table as a little pcap file of two records."""
    fr = _frames(spark, d).withColumn("_f", F.hex("frame"))
    head = F.concat(F.lit("A1B2C3D4" + "00020004" + "00000000" * 2 + "00040000"), _h(F.col("linktype"), 8))
    n = (F.length("_f") / 2).cast("long")
    rec = lambda extra: F.concat(_h(F.floor(F.col("ts_us") / 1_000_000) + extra, 8), _h(F.pmod("ts_us", F.lit(1_000_000)), 8), _h(n, 8), _h(n, 8), "_f")
    return fr.select(F.col("frame_no").cast("string").alias("capture_id"), F.concat(F.lit("/x/"), F.col("frame_no").cast("string")).alias("path"),
                     F.unhex(F.concat(head, rec(0), rec(1))).alias("content"))


query("s1_split_frames", """SELECT CAST(event_id AS VARCHAR) AS capture_id, n AS frame_no, event_id*1000 + n*1000000 AS ts_us,
      CAST(CASE WHEN event_id % 12 = 0 THEN 101 ELSE 1 END AS BIGINT) AS linktype FROM events, range(2) r(n)""")(
    lambda spark, d: captures.split_frames(_pcap_files(spark, d)).select("capture_id", "frame_no", "ts_us", "linktype"))


@query("s1_capture_ranges", """SELECT event_id*1000 AS ts_us, CAST(CASE WHEN event_id % 12 = 0 THEN 101 ELSE 1 END AS BIGINT) AS linktype, event_id - min(event_id) OVER () AS place FROM events""")
def _ranges(spark, d):
    """Every frame written to capture files in the shared folder and read back in ranges of 64 KB; a frame's number orders it within its file."""
    folder = f"{checkpoint_folder(spark).rstrip('/')}/captures-{uuid.uuid4().hex}"
    stage(ranges.write_frames(_frames(spark, d).orderBy("ts_us"), folder))
    frames = stage(captures.read_frames(spark, folder, 1 << 16))
    parts = frames.select("*", F.regexp_extract("capture_id", "part-([0-9]+)", 1).cast("int").alias("part_no"),
                          F.regexp_extract("capture_id", "captures-([0-9a-f]+)", 1).alias("session_id"))
    return captures.merge_parts(parts).select("ts_us", "linktype", F.col("packet_no").alias("place"))


query("s4_capture_catalog", "SELECT text AS content_text, min(doc_id) AS first_doc, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, concat(sha256(text), '.pcapng') AS stored_name FROM documents GROUP BY text", ["documents"])(
    lambda docs: captures.capture_catalog(docs.select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.encode("text", "utf-8").alias("content")))
    .select(F.col("path").cast("long").alias("first_doc"), "bytes", "stored_name").join(
        docs.select(F.col("doc_id").alias("first_doc"), F.col("text").alias("content_text")), "first_doc"))
query("u5_merge_parts", """WITH f AS (SELECT user_id AS session_id, event_id % 3 AS part_no, row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY event_id) - 1 AS frame_no, event_id FROM events)
    SELECT session_id, part_no, frame_no, row_number() OVER (PARTITION BY session_id ORDER BY part_no, frame_no) - 1 AS packet_no FROM f""", ["events"])(
    lambda e: captures.merge_parts(_parts(e)).select("session_id", "part_no", "frame_no", "packet_no"))


def _parts(e):
    from wiretally.operators import scan
    rows = e.select(F.col("user_id").alias("session_id"), (F.col("event_id") % 3).alias("part_no"), "event_id", F.lit(1).cast("long").alias("one"))
    return scan.running(rows, ["session_id", "part_no"], ["event_id"], {"n": ("sum", "one")}, width=100_000).withColumn("frame_no", F.col("n") - 1)


query("s10_findings_csv", f"""WITH f AS ({findings_sql(RULES)}), m(rule_id, title, category, refs, fix) AS (VALUES """ + ", ".join(
    "('%s', '%s', '%s', '%s', '%s')" % tuple(str(x).replace("'", "''") for x in (r["id"], r["title"], r["category"], "; ".join(r["refs"]), r["fix"])) for r in RULES) + """)
    SELECT rule_id, title, category, severity, likelihood, confidence, refs, fix FROM f JOIN m USING (rule_id)""", ["sa_fx"])(
    lambda s: tables.findings_csv(posture.evaluate_rules(with_conf(s), RULES)))
query("s12_new_alerts", "SELECT DISTINCT user_id AS id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)", ["events", "customer"])(
    lambda e, c: tables.new_alerts(e.select(F.col("user_id").alias("id"), "event_type"), c.filter("c_acctbal < 0").select(F.col("c_custkey").alias("id"))).select("id"))


@query("s13_report_tables", """SELECT concat('an_', o_orderkey, '-0x', lpad(lower(to_hex(o_custkey)), 8, '0')) AS sa_id, o_orderkey % 7 AS t0 FROM orders""", ["orders"])
def _s13(o):
    doc = F.to_json(F.struct(F.concat(F.lit("an_"), F.col("o_orderkey").cast("string")).alias("analysis_id"), F.lit(80.0).alias("security_score"),
                             F.array(F.struct(spi_text("o_custkey").alias("spi"))).alias("sas"),
                             F.array(F.struct(spi_text("o_custkey").alias("sa_id"), (F.col("o_orderkey") % 7).cast("double").alias("t0"))).alias("traffic_windows")))
    reports = o.select(F.from_json(doc, tables.REPORT_SCHEMA).alias("r")).select("r.*")
    parts = tables.report_tables(reports)
    return parts["sa"].select(F.col("id").alias("sa_id")).join(parts["flow_window"].select("sa_id", F.col("t0").cast("long").alias("t0")), "sa_id")


@query("s13_report_rows", """WITH o AS (SELECT concat('an_', o_orderkey) AS id, o_orderkey AS n, concat('0x', lpad(lower(to_hex(o_custkey)), 8, '0')) AS spi,
      concat('0x', lpad(lower(to_hex(o_custkey + 1)), 8, '0')) AS other FROM orders)
    SELECT 'analysis' AS part, id, id AS analysis_id, 'completed' AS name, CAST(n % 101 AS DOUBLE) AS a, CAST(n % 251 AS DOUBLE) / 10 AS b, CAST(NULL AS VARCHAR) AS said FROM o
    UNION ALL SELECT 'sa', concat(id, '-', spi), id, 'AES-GCM-16', CAST(256 AS DOUBLE), NULL, concat('{"spi":"', spi, '","peers":["10.0.0.1"],"enc":"AES-GCM-16","key_bits":256}') FROM o
    UNION ALL SELECT 'sa', concat(id, '-', other), id, 'AES-CBC', CAST(128 AS DOUBLE), NULL, concat('{"spi":"', other, '","peers":["10.0.0.1"],"enc":"AES-CBC","key_bits":128}') FROM o
    UNION ALL SELECT 'window', concat(id, '-', spi), id, 'web', CAST(n % 7 AS DOUBLE), CAST(0.5 AS DOUBLE), concat('{"packets":', n % 9, '.0}') FROM o
    UNION ALL SELECT 'finding', concat(id, '-', r, '-', i), id, s, CAST(l AS DOUBLE), CAST(0.5 AS DOUBLE), concat('{"spi":"', spi, '"}') FROM o,
      (VALUES ('R-1', 0, 'high', 0.25), ('R-2', 1, 'low', 0.75), ('R-1', 2, 'info', 1.0)) v(r, i, s, l)""", ["orders"])
def _s13_rows(o):
    """All four tables of every report; a report names its first SA twice and one rule twice."""
    first, other = spi_text("o_custkey"), spi_text(F.col("o_custkey") + 1)
    sa = lambda spi, enc, bits: F.struct(spi.alias("spi"), F.array(F.lit("10.0.0.1")).alias("peers"), F.lit(enc).alias("enc"), F.lit(bits).alias("key_bits"))
    found = lambda rule, sev, likely: F.struct(F.lit(rule).alias("rule_id"), F.lit(sev).alias("severity"), F.lit(likely).alias("likelihood"),
                                               F.lit(0.5).alias("confidence"), F.struct(first.alias("spi")).alias("evidence"))
    window = F.struct(first.alias("sa_id"), (F.col("o_orderkey") % 7).cast("double").alias("t0"), F.lit("web").alias("pred"), F.lit(0.5).alias("p"),
                      F.struct((F.col("o_orderkey") % 9).cast("double").alias("packets")).alias("features"))
    doc = F.to_json(F.struct(
        F.concat(F.lit("an_"), F.col("o_orderkey").cast("string")).alias("analysis_id"), (F.col("o_orderkey") % 101).cast("double").alias("security_score"),
        ((F.col("o_orderkey") % 251).cast("double") / 10).alias("risk_score"),
        F.array(sa(first, "AES-CBC", 128), sa(first, "AES-GCM-16", 256), sa(other, "AES-CBC", 128)).alias("sas"), F.array(window).alias("traffic_windows"),
        F.array(found("R-1", "high", 0.25), found("R-2", "low", 0.75), found("R-1", "info", 1.0)).alias("findings")))
    parts = tables.report_tables(o.select(F.from_json(doc, tables.REPORT_SCHEMA).alias("r")).select("r.*"))
    none = F.lit(None).cast("double")
    own = parts["flow_window"]
    shaped = [
        parts["analysis"].select(F.lit("analysis").alias("part"), "id", F.col("id").alias("analysis_id"), F.col("status").alias("name"),
                                 F.col("score").alias("a"), F.col("risk").alias("b"), F.lit(None).cast("string").alias("said")),
        parts["sa"].select(F.lit("sa"), "id", "analysis_id", "enc", F.col("key_bits").cast("double"), none, "params"),
        own.select(F.lit("window"), "sa_id", "analysis_id", "pred", "t0", "p", F.to_json("features")),
        parts["finding"].select(F.lit("finding"), "id", "analysis_id", "severity", "likelihood", "confidence", F.to_json("evidence"))]
    out = shaped[0]
    for rows in shaped[1:]:
        out = out.union(rows)
    return out


query("s14_import_domains", f"""WITH o AS (SELECT domain AS name, arg_min(label, row_no) AS label, arg_min(scenario_id, row_no) AS scenario_id, split_part(domain, '.', 1) AS lab FROM domains_fx GROUP BY domain)
    SELECT CAST(label AS BIGINT) AS label, scenario_id, {FEATURES_SQL}, CAST(0 AS DOUBLE) AS qps FROM o""", ["domains_fx"])(tables.import_domains)
query("s15_provenance", """SELECT session_id, concat('/captures/', session_id) AS path, sha256(session_id) AS sha256, 'lab' AS source, esp_packets, ike_packets FROM sessions_fx
    WHERE esp_packets >= 20 AND ike_packets >= 1""", ["sessions_fx"])(
    lambda s: captures.provenance(s.select("session_id", F.concat(F.lit("/captures/"), "session_id").alias("path"), F.sha2("session_id", 256).alias("sha256")), ev.session_gate(s)))


# --- round trips through the sinks ------------------------------------------

def _folder(spark):
    import uuid
    from wiretally.session import checkpoint_folder
    return f"{checkpoint_folder(spark)}/sink-{uuid.uuid4().hex}"


@query("s8_features_round_trip", "SELECT spi, capture_id, CAST(count(*) AS BIGINT) AS packet_count FROM esp_fx GROUP BY 1, 2", ["esp_fx"])
def _s8(esp):
    from wiretally.operators import sa
    folder = _folder(esp.sparkSession)
    tables.write_features(sa.sa_profile(esp).drop("src", "dst"), folder, "capture_id")
    return tables.read_features(esp.sparkSession, folder).select("spi", "capture_id", "packet_count")


@query("s9_report_round_trip", "SELECT analysis_id, CAST(count(*) AS BIGINT) AS findings FROM (" + findings_sql(RULES) + ") GROUP BY 1", ["sa_fx"])
def _s9(s):
    sas = with_conf(s)
    found = posture.evaluate_rules(sas, RULES)
    folder = _folder(s.sparkSession)
    tables.write_report(posture.report_context(found, sas), folder, found, sas)
    return s.sparkSession.read.json(f"{folder}/findings").groupBy("analysis_id").agg(F.count(F.lit(1)).alias("findings"))


@query("s11_labels_round_trip", """SELECT session_id, profile, CASE WHEN esp_proposal LIKE '%gcm%' THEN 'GCM' WHEN esp_proposal LIKE '%cbc%' THEN 'CBC' END AS cipher, traffic_type AS traffic FROM sessions_fx""", ["sessions_fx"])
def _s11(s):
    folder = _folder(s.sparkSession)
    tables.write_labels(ev.proposal_labels(s).select("session_id", "profile", "cipher", "traffic"), folder)
    return s.sparkSession.read.option("header", "true").schema("session_id string, profile string, cipher string, traffic string").csv(folder)


@query("s5_manifests_round_trip", "SELECT session_id, profile, mode, CAST(key_bits AS BIGINT) AS key_bits, pfs FROM sessions_fx", ["sessions_fx"])
def _s5(s):
    """Manifests as JSON documents, one per line of the files Spark writes."""
    doc = s.select("session_id", "profile", "traffic_type", F.struct("mode", "key_bits", "pfs").alias("labels"))
    folder = _folder(s.sparkSession)
    doc.write.json(folder)
    read = s.sparkSession.read.schema(tables.MANIFEST_SCHEMA).json(folder)
    return read.select("session_id", "profile", "labels.mode", "labels.key_bits", "labels.pfs")
