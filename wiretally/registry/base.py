from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wiretally.fixtures import table, view, with_views

QUERIES = {}
ORACLES = {}


def tidy(df: DataFrame) -> DataFrame:
    """Counts as BIGINT and doubles at six places, the form the comparison uses."""
    cols = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, sql: str = None, views=()):
    """Register ``fn(*views)`` or ``fn(spark, sf_dir)`` under ``name``."""
    def wrap(fn):
        @wraps(fn)
        def run(spark, sf_dir):
            if views:
                return tidy(fn(*[(view if v.endswith("_fx") else table)(spark, sf_dir, v) for v in views]))
            return tidy(fn(spark, sf_dir))
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql:
            ORACLES[name] = with_views(sql)
        return fn
    return wrap
