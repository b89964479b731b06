"""Session defaults and lineage control."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores="*", name="wiretally", **conf) -> SparkSession:
    """A session for tests and the bench; on a cluster use the one provided."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(name)
               .config("spark.sql.shuffle.partitions", "8")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "12g")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The reliable checkpoint folder of the session.

    It is the one the cluster names in ``spark.checkpoint.dir``; a machine-local
    folder is used only when a session on a local master (a test) names none.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="wiretally-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


#: Lets Spark delete the shuffle files of an execution when it ends. They are kept until the driver's memory is cleaned otherwise.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_end(spark: SparkSession):
    """Within, an execution deletes its shuffle files as it ends; for tables that are written once and read from the folder."""
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder once and continue from there."""
    checkpoint_folder(df.sparkSession)
    with _shuffles_end(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a plan of its own, as an execution is marked when it is planned


@contextmanager
def scratch(df: DataFrame):
    """``df`` written as compressed Parquet to the checkpoint folder, for what is read within; the files go at the end."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        df.write.option("compression", "zstd").parquet(path)
        spark._jvm.System.gc()  # a write keeps the shuffle files of its plan until the driver's memory is cleaned
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
