"""Capture files: frames, catalogue and rotated parts."""

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretally.sources import ranges
from wiretally.sources.ranges import FRAME_SCHEMA


def records(data: bytes):
    """(ts_us, linktype, frame) of one file's bytes; it ends at the first record that can't be read."""
    src = ranges.Local(data)
    walk = ranges.walker(src)
    if walk is not None and not walk.stopped:
        for _, ts, link, begin, length in walk.walk(walk.first, src.size):
            yield ts, link, src.get(begin, length)


def split_frames(files: DataFrame, batch: int = 20_000, batch_bytes: int = 32 << 20) -> DataFrame:
    """(capture_id, content) to frames; one file is one row. Frames leave in batches, of many small files or of a part of a large one."""
    names = ["capture_id", "frame_no", "ts_us", "linktype", "frame"]

    def body(batches):
        rows, held = [], 0
        for pdf in batches:
            for name, content in zip(pdf["capture_id"], pdf["content"]):
                for i, (ts, link, frame) in enumerate(records(content)):
                    rows.append((name, i, ts, link, frame))
                    held += len(frame)
                    if len(rows) >= batch or held >= batch_bytes:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)
    return files.select("capture_id", "content").mapInPandas(body, schema=FRAME_SCHEMA)


def read_frames(spark: SparkSession, path: str, range_bytes: int = ranges.RANGE_BYTES) -> DataFrame:
    """Frames of all capture files under ``path``; ``capture_id`` is the file's path.

    Files of any size are read in byte ranges (see ``ranges``); ``ranges.capture_report`` tells what could
    not be read. Frames of simple packet blocks have no time (``ts_us`` is null). Rotated parts of one
    session are captures of their own; give them a session and a part number and number their frames
    with ``merge_parts``.
    """
    return ranges.frames_of(ranges.read_index(spark, path, range_bytes))


def read_packets(spark: SparkSession, path: str, range_bytes: int = ranges.RANGE_BYTES) -> DataFrame:
    """Packets of all capture files under ``path``; frames without a time are left out, as no operator can place them."""
    from wiretally.operators.packets import decode_packets
    return decode_packets(read_frames(spark, path, range_bytes).filter(F.col("ts_us").isNotNull()))


def capture_catalog(files: DataFrame) -> DataFrame:
    """Path, size and digest per distinct content, with a content-addressed name.

    ``files`` has path, content (as from the binaryFile source); the content is
    digested before the shuffle and never moves.
    """
    return _catalog(files.select("path", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256")))


def _catalog(digests: DataFrame) -> DataFrame:
    return digests.groupBy("sha256").agg(F.min("path").alias("path"), F.first("bytes").alias("bytes")).withColumn(
        "stored_name", F.concat("sha256", F.lit(".pcapng")))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue of all files under ``path``; a file of any size is digested block by block."""
    spark.dataSource.register(ranges.CaptureRanges)
    names = spark.read.format("capture_ranges").load(path).where("range_no = 0").select("path", "bytes")

    def body(batches):
        for pdf in batches:
            digests = []
            for name in pdf["path"]:
                src, sha = ranges.Remote(name), hashlib.sha256()
                for at in range(0, src.size, ranges.BLOCK_BYTES):
                    sha.update(src.get(at, min(ranges.BLOCK_BYTES, src.size - at)))
                digests.append(sha.hexdigest())
            yield pdf.assign(sha256=digests)

    return _catalog(names.mapInPandas(body, "path string, bytes long, sha256 string"))


def merge_parts(frames: DataFrame, session="session_id", part="part_no", width: int = 1_000_000) -> DataFrame:
    """Numbers the frames of rotated parts as one stream, without ordering a session in one task.

    A frame's number is its position in its part plus the frames of earlier
    parts, and there is one count per part.
    """
    from pyspark.sql import Window
    sizes = frames.groupBy(session, part).agg((F.max("frame_no") + 1).alias("_n"))
    before = Window.partitionBy(session).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    start = sizes.select(session, part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return frames.join(start, [session, part]).withColumn("packet_no", F.col("_start") + F.col("frame_no")).drop("_start")


def provenance(catalog: DataFrame, gated: DataFrame, source="lab") -> DataFrame:
    """One row per accepted session: path, digest, source and packet counts."""
    ok = gated.filter("reason IS NULL").select("session_id", "esp_packets", "ike_packets")
    return catalog.join(ok, "session_id").select("session_id", "path", "sha256", F.lit(source).alias("source"), "esp_packets", "ike_packets")
