"""Listing, summary and dashboard queries."""

from pyspark.sql import functions as F

from wiretally.operators import readmodels as rm
from wiretally.plans import posture
from wiretally.registry.base import query
from wiretally.registry.posture import GRADE

RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"
COUNTS = ", ".join(f"CAST(count(*) FILTER (WHERE severity = '{s}') AS BIGINT) AS {s}" for s in ("critical", "high", "medium", "low", "info"))

query("a18_severity_counts", f"SELECT analysis_id, {COUNTS} FROM findings_fx GROUP BY 1", ["findings_fx"])(rm.severity_counts)
query("t1_recent_analyses", "SELECT analysis_id, status FROM analyses_fx ORDER BY created DESC, analysis_id DESC LIMIT 50", ["analyses_fx"])(
    lambda a: rm.recent_analyses(a).select("analysis_id", "status"))
TOP = f"""cnt AS (SELECT analysis_id, rule_id, severity, count(*) AS count FROM findings_fx GROUP BY 1, 2, 3),
    top AS (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY {RANK}, count DESC, rule_id) AS position FROM cnt QUALIFY position <= 5)"""
query("t2_top_findings", f"WITH {TOP} SELECT analysis_id, rule_id, severity, CAST(count AS BIGINT) AS count, position FROM top", ["findings_fx"])(rm.top_findings)
query("t3_report_top", f"""SELECT analysis_id, severity, round(likelihood*confidence, 6) AS weight, position FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id
      ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 2 END, likelihood*confidence DESC, rule_id) AS position FROM findings_fx) WHERE position <= 5""", ["findings_fx"])(
    lambda f: rm.report_top(f).select("analysis_id", "severity", (F.col("likelihood") * F.col("confidence")).alias("weight"), "position"))
query("t5_findings_by", "SELECT analysis_id, rule_id, severity, likelihood, confidence FROM (SELECT analysis_id, rule_id, severity, round(likelihood, 6) AS likelihood, round(confidence, 6) AS confidence FROM findings_fx) WHERE rule_id = 'PFS-001' AND severity = 'high'", ["findings_fx"])(
    lambda f: rm.findings_by(f, rule_id="PFS-001", severity="high"))
TOTALS = f"""per AS (SELECT analysis_id, rule_id, count(*) AS c, min({RANK}) AS rank FROM findings_fx GROUP BY 1, 2),
    tot AS (SELECT rule_id, CAST(sum(c) AS BIGINT) AS count, CAST(count(*) AS BIGINT) AS analyses, ['critical', 'high', 'medium', 'low', 'info'][1 + min(rank)] AS severity, min(rank) AS rank FROM per GROUP BY 1)"""
query("a36_findings_totals", f"WITH {TOTALS} SELECT rule_id, count, analyses, severity FROM tot", ["findings_fx"])(rm.findings_totals)
query("t7_overview_top", f"WITH {TOTALS} SELECT rule_id, count, analyses, severity FROM tot ORDER BY rank, count DESC, rule_id LIMIT 6", ["findings_fx"])(rm.overview_top)
query("w16_score_trend", """SELECT * FROM (SELECT analysis_id, created, score, round(risk, 6) AS risk FROM analyses_fx WHERE score IS NOT NULL ORDER BY created DESC, analysis_id DESC LIMIT 20)""", ["analyses_fx"])(rm.score_trend)
query("w17_latest_completed", """SELECT analysis_id, capture_id FROM analyses_fx WHERE status = 'completed' AND analysis_id IN (SELECT analysis_id FROM sa_fx)
    ORDER BY created DESC, analysis_id DESC LIMIT 1""", ["analyses_fx", "sa_fx"])(lambda a, s: rm.latest_completed(a, s).select("analysis_id", "capture_id"))
query("a35_overview_kpis", """SELECT round(avg(score), 6) AS avg_score, round(avg(risk), 6) AS avg_risk,
      (SELECT count(*) FROM findings_fx WHERE severity IN ('critical', 'high') AND analysis_id IN (SELECT analysis_id FROM analyses_fx)) AS critical_high,
      (SELECT count(*) FROM sa_fx WHERE analysis_id IN (SELECT analysis_id FROM analyses_fx)) AS sa_total,
      round(avg(confidence) FILTER (WHERE confidence > 0), 6) AS avg_confidence FROM analyses_fx""", ["analyses_fx", "findings_fx", "sa_fx"])(rm.overview_kpis)
query("a19_analysis_summary", f"""WITH {TOP}, sev AS (SELECT analysis_id, {COUNTS} FROM findings_fx GROUP BY 1), n AS (SELECT analysis_id, count(*) AS c FROM sa_fx GROUP BY 1),
    tf AS (SELECT analysis_id, string_agg(rule_id, ',' ORDER BY position) AS t FROM top GROUP BY 1)
    SELECT a.analysis_id, a.status, a.score AS security_score, {GRADE.format('a.score')} AS grade, round(a.risk, 6) AS risk_score, a.confidence AS ai_confidence,
      CAST(coalesce(n.c, 0) AS BIGINT) AS sa_count, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, t AS top_findings
    FROM analyses_fx a LEFT JOIN sev USING (analysis_id) LEFT JOIN n USING (analysis_id) LEFT JOIN tf USING (analysis_id)""", ["analyses_fx", "findings_fx", "sa_fx"])(
    lambda a, f, s: rm.analysis_summary(a, f, s).withColumn("top_findings", F.array_join("top_findings", ",")))


@query("j2_with_rule_meta", """WITH m(rule_id, title, category) AS (VALUES """ + ", ".join(
    "('%s', '%s', '%s')" % (r["id"], r["title"].replace("'", "''"), r["category"]) for r in posture.load_pack("baseline")) + """)
    SELECT rule_id, coalesce(title, rule_id) AS title, coalesce(category, 'unknown') AS category, CAST(count(*) AS BIGINT) AS findings
    FROM findings_fx LEFT JOIN m USING (rule_id) GROUP BY 1, 2, 3""", ["findings_fx"])
def _j2(f):
    out = rm.with_rule_meta(f, posture.read_rules(f.sparkSession, "baseline"))
    return out.groupBy("rule_id", "title", "category").agg(F.count(F.lit(1)).alias("findings"))


query("a37_traffic_mix", """SELECT pred, CAST(count(*) AS BIGINT) AS count, round(count(*) / (SELECT count(*) FROM windows_fx)::DOUBLE, 6) AS share FROM windows_fx GROUP BY 1""", ["windows_fx"])(rm.traffic_mix)
query("a38_histogram", """WITH m AS (SELECT min(length) AS lo, (max(length) - min(length))/20.0::DOUBLE AS w FROM packets_fx),
    c AS (SELECT least(19, CAST(floor((length - lo)/w) AS BIGINT)) AS bin, count(*) AS n FROM packets_fx, m GROUP BY 1)
    SELECT r.bin, round(lo + r.bin*w, 6) AS start, CAST(coalesce(n, 0) AS BIGINT) AS count FROM range(20) r(bin) LEFT JOIN c USING (bin), m""", ["packets_fx"])(
    lambda p: rm.histogram(p, "length"))
query("a39_sessions_by_type", "SELECT traffic_type, CAST(count(*) AS BIGINT) AS sessions FROM sessions_fx GROUP BY 1", ["sessions_fx"])(rm.sessions_by_type)
query("j4_analysis_traffic", """SELECT win AS t0, w.spi AS sa_id, analysis_id, pred, p FROM windows_fx w JOIN sa_fx s ON s.spi = w.spi""", ["windows_fx", "sa_fx"])(
    lambda w, s: rm.analysis_traffic(w.select(F.col("win").alias("t0"), F.col("spi").alias("sa_id"), "pred", "p"), s.withColumnRenamed("spi", "sa_id")))
query("j10_annotate_windows", """SELECT win, w.spi, pred, traffic_top AS sa_pred, round(traffic_confidence, 6) AS sa_p FROM windows_fx w LEFT JOIN sa_fx s ON s.spi = w.spi""", ["windows_fx", "sa_fx"])(
    lambda w, s: rm.annotate_windows(w.drop("p"), s, ["spi"]))
