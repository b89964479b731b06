"""Streaming input, and native stateful queries on packets."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKET_SCHEMA = """capture_id string, packet_no long, ts_us long, src string, dst string, ip_proto int, sport int, dport int,
    ip_version int, length int, tcp_flags int"""


def stream_packets(spark: SparkSession, path: str, schema: str = PACKET_SCHEMA, files_per_trigger: int = 8) -> DataFrame:
    """Packet tables of closed capture segments as they appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def with_event_time(packets: DataFrame, watermark: str) -> DataFrame:
    return packets.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", watermark)


def window_counts(packets: DataFrame, window: str = "10 seconds", watermark: str = "10 seconds") -> DataFrame:
    """Packets per capture and tumbling window, as windows close."""
    return (with_event_time(packets, watermark).groupBy("capture_id", F.window("ts", window).alias("w"))
            .agg(F.count(F.lit(1)).alias("packets")).select("capture_id", F.unix_micros("w.start").alias("window_us"), "packets"))


def session_flows(packets: DataFrame, gap: str = "60 seconds", watermark: str = None) -> DataFrame:
    """Flow counters by session window; works on batch and streaming input alike.

    Session windows merge partial sessions map-side only in batch; a streaming
    flow is one state entry.
    """
    from wiretally.functions.net import flow_id, is_internal, is_syn
    rows = with_event_time(packets, watermark) if watermark else packets.withColumn("ts", F.timestamp_micros("ts_us"))
    out, back = is_internal("src") & ~is_internal("dst"), is_internal("dst") & ~is_internal("src")
    n = F.col("length").cast("long")
    zero = F.lit(0).cast("long")
    grouped = rows.groupBy(flow_id().alias("flow_id"), F.session_window("ts", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("packets"), F.sum(F.when(out, n).otherwise(zero)).alias("bytes_out"),
        F.sum(F.when(back, n).otherwise(zero)).alias("bytes_in"), F.count_if(is_syn()).alias("syns"))
    return grouped.select("flow_id", F.unix_micros("w.start").alias("epoch_us"), "packets", "bytes_out", "bytes_in", "syns")


def dedup_stream(alerts: DataFrame, watermark: str = "1 minute", ts="timestamp") -> DataFrame:
    """Each alert id once within the watermark."""
    timed = alerts.withColumn("alert_time", F.timestamp_seconds(ts)).withWatermark("alert_time", watermark)
    return timed.dropDuplicatesWithinWatermark(["id"]).drop("alert_time")


def stream_metrics(df: DataFrame, name: str = "packets") -> DataFrame:
    """Packet and byte counters that every batch reports to query progress."""
    return df.observe(name, F.count(F.lit(1)).alias("packets"), F.sum(F.col("length").cast("long")).alias("bytes"),
                      F.count_if(F.col("ts_us").isNull()).alias("without_time"))
