"""What several operators share: table access, staging in the shared folder, ranks in a global order."""

import atexit
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretally.session import checkpoint_folder

#: White space of the word rules: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(name="text"):
    """UTF-8 bytes of a string column, null as no bytes."""
    return F.coalesce(F.col(f"`{name}`"), F.lit("")).cast("binary")


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder and continue from the files.

    The files go when the Python process ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark, path):
    try:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the session has ended before the process
        pass


def parts_for(df: DataFrame, size, bytes_each: int) -> int:
    """How many parts of about ``bytes_each`` hold ``df``; ``size`` is a column of bytes."""
    total = df.agg(F.sum(size.cast("double")).alias("n")).first()["n"] or 0
    return max(1, math.ceil(total / bytes_each))


def ranked(df: DataFrame, within: str, order: list, rank="rank") -> DataFrame:
    """Number the rows of each ``within`` value from 1 in ``order``, however many rows one value holds.

    Rows are range-partitioned by (within, order) and numbered in place; the first number of each
    (partition, value) then gives the rank. Only one row per partition and value is gathered.
    The result is staged, since ranks need a second pass over the same numbering.
    """
    keys = [F.col(within), *order]
    spread = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    numbered = staged(spread.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    starts = numbered.groupBy(within, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    from pyspark.sql import Window
    before = Window.partitionBy(within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    same = F.col(f"_l.{within}").eqNullSafe(F.col(f"_r.{within}")) & (F.col("_l._part") == F.col("_r._part"))
    return (numbered.alias("_l").join(starts.alias("_r"), same)
            .select(*[F.col(f"_l.`{c}`") for c in df.columns],
                    (F.col("_l._at") - F.col("_r._first") + F.col("_r._before") + 1).alias(rank)))
