"""Read models: listings, summaries and dashboard aggregates."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretally import constants as C
from wiretally.functions.text import grade

RANK = {s: i for i, s in enumerate(reversed(C.SEVERITIES))}


def severity_rank(col="severity") -> Column:
    """0 for critical up to 4 for info."""
    col = F.col(col) if isinstance(col, str) else col
    pairs = [F.lit(x) for s, i in RANK.items() for x in (s, i)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col), F.lit(4))


def severity_counts(findings: DataFrame, by="analysis_id", levels=C.SEVERITIES) -> DataFrame:
    counts = findings.groupBy(by).pivot("severity", list(levels)).agg(F.count(F.lit(1)))
    return counts.fillna(0, subset=list(levels))


def recent_analyses(analyses: DataFrame, limit: int = 50) -> DataFrame:
    limit = max(1, min(limit, 200))
    return analyses.orderBy(F.desc("created"), F.desc("analysis_id")).limit(limit)


def _finding_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("analysis_id", "rule_id", "severity").agg(F.count(F.lit(1)).alias("count"))


def top_findings(findings: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` most severe, then most frequent, rules of each analysis.

    Counting first leaves at most one row per rule and severity in an analysis.
    """
    w = Window.partitionBy("analysis_id").orderBy(severity_rank(), F.desc("count"), "rule_id")
    return _finding_counts(findings).withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)


def report_top(findings: DataFrame, n: int = 5, tie=("rule_id",)) -> DataFrame:
    """The ``n`` findings for the report: critical, then high, then likelihood x confidence."""
    w = Window.partitionBy("analysis_id").orderBy(
        F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).otherwise(2),
        F.desc(F.col("likelihood") * F.col("confidence")), *tie)
    return findings.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)


def alert_feed(alerts: DataFrame, threat_class: str = None, limit: int = 100) -> DataFrame:
    rows = alerts if threat_class is None else alerts.filter(F.col("threat_class") == threat_class)
    return rows.orderBy(F.desc("timestamp"), F.desc("id")).limit(max(1, min(limit, 500)))


def findings_by(findings: DataFrame, rule_id=None, analysis_id=None, severity=None) -> DataFrame:
    for name, value in (("rule_id", rule_id), ("analysis_id", analysis_id), ("severity", severity)):
        if value is not None:
            findings = findings.filter(F.col(name) == value)
    return findings


def analysis_summary(analyses: DataFrame, findings: DataFrame, sas: DataFrame) -> DataFrame:
    """One row per analysis; counts are aggregated first and joined, never looked up per row."""
    levels = [s for s in reversed(C.SEVERITIES) if s != "info"]
    sev = severity_counts(findings, levels=levels)
    n_sas = sas.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("sa_count"))
    top = top_findings(findings).groupBy("analysis_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "rule_id"))).alias("_t"))
    out = (analyses.join(sev, "analysis_id", "left").join(n_sas, "analysis_id", "left").join(top, "analysis_id", "left"))
    return out.select("analysis_id", "status", F.col("score").alias("security_score"), grade("score").alias("grade"),
                      F.col("risk").alias("risk_score"), F.col("confidence").alias("ai_confidence"),
                      F.coalesce("sa_count", F.lit(0)).alias("sa_count"),
                      *[F.coalesce(s, F.lit(0)).alias(s) for s in levels], F.col("_t.rule_id").alias("top_findings"))


def with_rule_meta(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Titles, categories, references and fixes; a rule pack is a handful of rows, the plan sees its size."""
    meta = rules.select("rule_id", "title", "category", "refs", "fix")
    out = findings.join(meta, "rule_id", "left")
    return out.withColumns({"title": F.coalesce("title", "rule_id"), "category": F.coalesce("category", F.lit("unknown")),
                            "refs": F.coalesce("refs", F.array().cast("array<string>")), "fix": F.coalesce("fix", F.lit(""))})


def overview_kpis(analyses: DataFrame, findings: DataFrame, sas: DataFrame) -> DataFrame:
    sev = findings.groupBy("analysis_id").agg(F.count_if(F.col("severity").isin("critical", "high")).alias("_ch"))
    n = sas.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("_sas"))
    rows = analyses.join(sev, "analysis_id", "left").join(n, "analysis_id", "left")
    return rows.agg(F.avg("score").alias("avg_score"), F.avg("risk").alias("avg_risk"),
                    F.coalesce(F.sum("_ch"), F.lit(0)).alias("critical_high"), F.coalesce(F.sum("_sas"), F.lit(0)).alias("sa_total"),
                    F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))).alias("avg_confidence"))


def findings_totals(findings: DataFrame) -> DataFrame:
    """Per rule: findings over all analyses and the number of analyses, worst severity kept."""
    per = findings.groupBy("analysis_id", "rule_id").agg(F.count(F.lit(1)).alias("count"), F.min(severity_rank()).alias("_rank"))
    levels = F.array(*[F.lit(s) for s in reversed(C.SEVERITIES)])
    return per.groupBy("rule_id").agg(F.sum("count").alias("count"), F.count(F.lit(1)).alias("analyses"),
                                      F.element_at(levels, F.min("_rank") + 1).alias("severity"))


def overview_top(findings: DataFrame, n: int = 6) -> DataFrame:
    return findings_totals(findings).orderBy(severity_rank(), F.desc("count"), "rule_id").limit(n)


def traffic_mix(windows: DataFrame, by=()) -> DataFrame:
    """Rows per class with their share; the share window is over at most one row per class."""
    counts = windows.filter(F.col("pred").isNotNull()).groupBy(*by, "pred").agg(F.count(F.lit(1)).alias("count"))
    if by:
        total = F.sum("count").over(Window.partitionBy(*by))
        return counts.withColumn("share", F.col("count") / total)
    total = windows.filter(F.col("pred").isNotNull()).agg(F.count(F.lit(1)))
    return counts.withColumn("share", F.col("count") / total.scalar())


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """``bins`` equal bins over [min, max]; the last is closed, the width is 1 for flat data."""
    spread = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    width = F.when(F.col("hi") == F.col("lo"), F.lit(1.0)).otherwise((F.col("hi") - F.col("lo")) / bins)
    lo, w = spread.select("lo").scalar(), spread.select(width.alias("w")).scalar()
    place = F.least(F.lit(bins - 1), F.floor((F.col(col) - lo) / w)).cast("long")
    counts = df.filter(F.col(col).isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    every = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return (every.join(counts, "bin", "left").select("bin", (lo + F.col("bin") * w).alias("start"),
                                                     F.coalesce("count", F.lit(0)).alias("count")))


def sessions_by_type(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("traffic_type").agg(F.count(F.lit(1)).alias("sessions"))


def in_range(df: DataFrame, hours: int, now: DataFrame = None, ts="created") -> DataFrame:
    """Rows of the last ``hours`` before ``now`` (a one-value DataFrame); 0 keeps all."""
    if not hours:
        return df
    at = now.scalar() if now is not None else F.current_timestamp()
    return df.filter(F.col(ts) >= at - F.make_dt_interval(hours=F.lit(hours)))


def score_trend(analyses: DataFrame, n: int = 20) -> DataFrame:
    """The last ``n`` scored analyses in ascending time: a top-k, then a sort of k rows."""
    last = analyses.filter(F.col("score").isNotNull()).orderBy(F.desc("created"), F.desc("analysis_id")).limit(n)
    return last.select("analysis_id", "created", "score", "risk").orderBy("created", "analysis_id")


def latest_completed(analyses: DataFrame, sas: DataFrame) -> DataFrame:
    with_sas = sas.select("analysis_id").distinct()
    return (analyses.filter(F.col("status") == "completed").join(with_sas, "analysis_id", "left_semi")
            .orderBy(F.desc("created"), F.desc("analysis_id")).limit(1))


def analysis_traffic(windows: DataFrame, sas: DataFrame, analysis_id=None) -> DataFrame:
    own = sas.select("sa_id", "analysis_id")
    if analysis_id is not None:
        own = own.filter(F.col("analysis_id") == analysis_id)
    return windows.join(own, "sa_id").orderBy("analysis_id", "t0")


def annotate_windows(windows: DataFrame, sas: DataFrame, key) -> DataFrame:
    """Windows with the traffic class of their SA where there is one."""
    pred = sas.select(*key, F.col("traffic_top").alias("sa_pred"), F.col("traffic_confidence").alias("sa_p"))
    return windows.join(pred, list(key), "left")


def first_per_key(df: DataFrame, key, order) -> DataFrame:
    """First row per key by ``order``: an aggregate, so duplicates of a hot key meet map-side."""
    key = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r")).select(*key, "_r.*")
