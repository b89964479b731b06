"""Mixing sources to target weights by systematic sampling."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wiretally.llm.common import WORD, ranked

#: Weights by position of a source in code point order, null last; they repeat.
WEIGHTS = (5, 2, 1)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) to (source, source_size, target): ``share`` of all sizes, dealt by weight.

    No target exceeds ``most`` times its source's size; what is cut off goes to the others by
    weight, again until none is above. That is one level: a source gets weight x level or its
    limit. Sources are taken in order of limit / weight, so the level follows from running sums.
    One row per source is ordered in one place.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    dealt = sizes.withColumn("_weight", weight).withColumn("_limit", F.col("source_size") * F.lit(float(most)))
    dealt = dealt.withColumn("_at", F.col("_limit") / F.col("_weight"))
    every = Window.partitionBy()
    before = Window.orderBy("_at", F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))
    rest = F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    level = dealt.withColumn("_level", left / rest)
    found = F.min(F.when(F.col("_level") <= F.col("_at"), F.struct("_at", "_level"))).over(every)["_level"]
    return (level.withColumn("_found", found)
            .select("source", "source_size", F.coalesce(F.least("_limit", F.col("_weight") * F.col("_found")), F.col("_limit")).alias("target")))


def offset(source, seed: int):
    """The random offset in [0, 1) of a source: a fixed function of its name and the seed."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\0null")))
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """How often the mix takes each document: (doc_id, source, size, source_size, target, copies, taken).

    ``size`` counts words (null text: 0). Each document of a source expects target / source_size
    copies. Documents stand in order of size (then by a hash of doc_id) within their source, their
    expected copies are summed from the source's offset on, and one copy is emitted per whole
    number passed. Neighbours in that order are of like size, so the words taken come near the
    target; a document gets the floor or the ceiling of what it expects, so never more than
    ``most`` rounded up. A source without words takes nothing. Rows that repeat a doc_id count as
    documents of their own; a null source is a source, a null doc_id is kept. Equal seeds give
    equal results. An empty table gives an empty result.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select("doc_id", "source", size.alias("size"))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("size"), F.md5(F.col("doc_id").cast("string").cast("binary")), F.col("doc_id")]
    placed = ranked(sized, "source", order).alias("d")
    dealt = targets(sizes, weights, share, most).alias("t")
    joined = placed.join(dealt, F.col("d.source").eqNullSafe(F.col("t.source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = offset(F.col("d.source"), seed)
    copies = (F.floor(start + F.col("rank") * rate) - F.floor(start + (F.col("rank") - 1) * rate)).cast("long")
    return joined.select("doc_id", "d.source", "size", "source_size", "target", copies.alias("copies"),
                         (copies * F.col("size")).alias("taken"))


def repeated(docs: DataFrame, **how) -> DataFrame:
    """``docs`` as the mix has them: each row as often as it is taken, columns unchanged.

    Rows that repeat a doc_id are told apart by their place among equal (doc_id, source, size).
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    held = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    at = {n: f"_c{i}" for i, n in enumerate(docs.columns)}
    plan = mixed(docs, **how).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("_all"), F.count(F.lit(1)).alias("_rows"))
    size = F.coalesce(F.regexp_count(F.col(at["text"]), F.lit(WORD)), F.lit(0)).cast("long")
    rows = held.withColumn("_size", size)
    same = (F.col(at["doc_id"]).eqNullSafe(plan["doc_id"]) & F.col(at["source"]).eqNullSafe(plan["source"]) & (F.col("_size") == plan["size"]))
    taken = rows.join(plan, same)
    alone = taken.where("_rows = 1").withColumn("_times", F.col("_all"))
    tied = taken.where("_rows > 1")
    turn = F.row_number().over(Window.partitionBy(at["doc_id"], at["source"], "_size").orderBy(F.xxhash64(*held.columns)))
    tied = tied.withColumn("_times", F.floor(turn * F.col("_all") / F.col("_rows")) - F.floor((turn - 1) * F.col("_all") / F.col("_rows")))
    every = alone.unionByName(tied)
    return (every.where("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times").cast("long"))))
            .select(*[F.col(at[n]).alias(n) for n in docs.columns]))


def digest(docs: DataFrame) -> DataFrame:
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
dealt AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT]::DOUBLE AS w,
         source_size * 2.0::DOUBLE AS lim FROM sizes),
levels AS (
  SELECT *, lim / w AS edge,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(lim) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lev
  FROM dealt WINDOW b AS (ORDER BY lim / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, coalesce(least(lim, w * (SELECT arg_min(lev, edge) FROM levels WHERE lev <= edge)), lim) AS target FROM levels),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
         ('0x' || substr(md5('7:' || coalesce(s.source, chr(0) || 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start,
         row_number() OVER (PARTITION BY s.source ORDER BY s.size, md5(s.doc_id::VARCHAR), s.doc_id) AS rank
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       ((floor(start + rank * rate) - floor(start + (rank - 1) * rate))::BIGINT * size)::BIGINT AS taken
FROM placed
"""
