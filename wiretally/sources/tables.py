"""Tables in and out: manifests, profiles, features, reports, labels, alerts."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretally import constants as C
from wiretally.session import stage

CHILD = "struct<mode:string,enc:string,key_bits:int,integ:string,dh_group:int,spis:array<string>,name:string>"
MANIFEST_SCHEMA = f"""session_id string, profile string, traffic_type string, start string, end string, gateways array<string>,
    labels struct<ike_version:int,mode:string,enc:string,key_bits:int,integ:string,dh_group:int,ike_dh_group:int,pfs:boolean,
      nat_t:boolean,child_rekey_s:int,replay_window:int,ike_proposal:string,esp_proposal:string>,
    pcap string, keys string, sa_state string,
    gateway_evidence struct<before:array<{CHILD}>,after:array<{CHILD}>,rekey:struct<status:string,child:struct<dh_group:int,spis:array<string>>>>"""
PROFILE_SCHEMA = """id string, ike_version int, mode string, ip_family string, nat_t boolean, ike_proposal string, esp_proposal string,
    pfs boolean, ike_lifetime string, child_rekey_time string, replay_window int, traffic array<string>, duration_per_traffic string"""


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """Session manifests, one JSON document per session directory."""
    return (spark.read.schema(MANIFEST_SCHEMA).option("multiLine", "true").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "manifest.json").json(root)
            .withColumn("manifest_at", F.unix_micros(F.col("_metadata.file_modification_time"))))


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profile catalogue by id; a profile with an unknown field fails."""
    known = {f.split()[0] for f in PROFILE_SCHEMA.replace("\n", " ").split(",") for f in [f.strip()]}
    raw = spark.read.option("multiLine", "true").json(path)
    odd = sorted(set(raw.columns) - known)
    if odd:
        raise ValueError(f"profiles have unknown fields {odd}")
    return spark.read.schema(PROFILE_SCHEMA).option("multiLine", "true").json(path).orderBy("id")


def write_features(df: DataFrame, path: str, partition: str = None, mode="overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_report(context: DataFrame, path: str, findings: DataFrame = None, sas: DataFrame = None, windows: DataFrame = None) -> None:
    """A report per analysis: one nested JSON row, and its long parts as JSON rows beside it."""
    for name, part in (("context", context), ("findings", findings), ("sas", sas), ("windows", windows)):
        if part is not None:
            part.write.mode("overwrite").partitionBy("analysis_id").json(f"{path}/{name}")


def findings_csv(findings: DataFrame) -> DataFrame:
    return findings.withColumn("refs", F.array_join("refs", "; ")).select(*C.REPORT_COLUMNS)


def write_findings_csv(findings: DataFrame, path: str) -> None:
    findings_csv(findings).write.mode("overwrite").option("header", "true").csv(path)


def write_labels(labels: DataFrame, path: str) -> None:
    labels.write.mode("overwrite").option("header", "true").csv(path)


def write_provenance(rows: DataFrame, rejected: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(f"{path}/provenance")
    rejected.write.mode("overwrite").json(f"{path}/rejected")


def new_alerts(alerts: DataFrame, stored: DataFrame = None) -> DataFrame:
    """Alerts whose id is not stored yet, each id once."""
    first = alerts.dropDuplicates(["id"])
    return first if stored is None else first.join(stored.select("id"), "id", "left_anti")


def _with_day(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("day", F.floor(F.col("timestamp") / 86400).cast("long"))


def read_alerts(spark: SparkSession, path: str, days=None) -> DataFrame:
    """Stored alerts with their ``day`` (whole days since 1970), all or those of ``days``; None where there are none."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    fs = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if days is None:
        return spark.read.parquet(path) if fs.exists(place(path)) else None
    paths = [f"{path}/day={d}" for d in days if fs.exists(place(f"{path}/day={d}"))]
    return spark.read.option("basePath", path).parquet(*paths) if paths else None


def append_alerts(alerts: DataFrame, path: str) -> DataFrame:
    """Insert-or-ignore by alert id; returns what was new.

    An id holds the alert's second, so a stored alert of that id lies in the same day: alerts are stored by
    day, and an append reads the ids of the days it writes. An append that is run again adds nothing.
    """
    rows = stage(_with_day(alerts))
    days = [r["day"] for r in rows.select("day").distinct().collect()]
    fresh = stage(new_alerts(rows, read_alerts(alerts.sparkSession, path, days)))
    fresh.write.mode("append").partitionBy("day").parquet(path)
    return fresh


REPORT_SCHEMA = """analysis_id string, security_score double, risk_score double, ai_confidence double,
    sas array<struct<spi:string,peers:array<string>,mode:string,enc:string,key_bits:int,integ:string,dh_group:string,pfs:boolean>>,
    traffic_windows array<struct<sa_id:string,t0:double,pred:string,p:double,features:map<string,double>>>,
    findings array<struct<rule_id:string,severity:string,likelihood:double,confidence:double,evidence:map<string,string>>>"""


def report_tables(reports: DataFrame) -> dict:
    """The analysis, SA, window and finding rows of parsed reports.

    An SA that a report names twice is one row, the later one; ``params`` holds all that the report says of it.
    Window features and finding evidence stay with their rows as maps.
    """
    sa_id = F.concat_ws("-", "analysis_id", "spi")
    named = reports.select("analysis_id", F.posexplode("sas").alias("_n", "_sa"))
    sas = (named.groupBy("analysis_id", F.col("_sa.spi").alias("_spi")).agg(F.max_by("_sa", "_n").alias("_sa"))
           .select("analysis_id", "_sa.*", F.to_json("_sa").alias("params")).withColumn("id", sa_id))
    windows = reports.select("analysis_id", F.inline("traffic_windows")).withColumn("sa_id", F.concat_ws("-", "analysis_id", "sa_id"))
    findings = reports.select("analysis_id", F.posexplode("findings").alias("_n", "_f")).select("analysis_id", "_n", "_f.*")
    findings = findings.withColumn("id", F.concat_ws("-", "analysis_id", "rule_id", F.col("_n").cast("string"))).drop("_n")
    analysis = reports.select(F.col("analysis_id").alias("id"), F.lit("completed").alias("status"), F.col("security_score").alias("score"),
                              F.col("risk_score").alias("risk"), F.col("ai_confidence").alias("confidence"))
    return {"analysis": analysis, "sa": sas, "flow_window": windows, "finding": findings}


def refresh_tables(reports: DataFrame, path: str) -> None:
    """Replaces the stored rows of the analyses in ``reports``, and only those."""
    for name, rows in report_tables(reports).items():
        key = "id" if name == "analysis" else "analysis_id"
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(f"{path}/{name}")


def import_domains(df: DataFrame) -> DataFrame:
    """Labelled domains to DGA training rows; fails on a label outside 0/1 or on conflicting labels.

    Domains are unique afterwards (the first row wins), and the conflict check
    rides on the same aggregate.
    """
    from wiretally.functions.binary import bind
    from wiretally.functions.text import dns_name_features, first_label
    from wiretally.operators.metrics import require_binary_label
    order = F.col("row_no") if "row_no" in df.columns else F.monotonically_increasing_id()
    one = (require_binary_label(df.withColumn("_o", order)).groupBy("domain")
           .agg(F.min_by(F.struct("label", "scenario_id"), "_o").alias("_r"), F.min("label").alias("_lo"), F.max("label").alias("_hi")))
    same = F.when(F.col("_lo") != F.col("_hi"), F.raise_error(F.concat(F.lit("conflicting labels for "), "domain")).cast("int")).otherwise(F.col("_r.label").cast("int"))
    rows = bind(one.withColumn("label", same), _label=first_label("domain"))
    return rows.select("label", F.col("_r.scenario_id").alias("scenario_id"), *[c.alias(k) for k, c in dns_name_features("domain", label="_label").items()])


def read_domains(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("domain string, label int, scenario_id string").option("header", "true").csv(path)
