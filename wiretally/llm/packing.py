"""Packing documents to batches under a token budget, in length buckets that waste least padding."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.llm.common import WORD, ranked

#: Lengths up to this are told apart; beyond, they are rounded up by less than 1 part in 2048.
EXACT = 4096


def bin_top(length, exact: int = EXACT):
    """The largest length of the histogram bin of ``length``; there are 2048 bins per doubling beyond ``exact``."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(length, F.lit(1)) / exact)) + 1).cast("long")
    return F.when(length <= exact, length.cast("long")).otherwise(F.ceil(length / step) * step)


def best_buckets(lengths, counts, buckets: int):
    """Upper bounds of at most ``buckets`` ranges of ``lengths`` (sorted, different) that minimise the padding.

    Least sum over bins of counts x (bound of its range), by dynamic programming over the bins:
    cost[k][j] = min over i of cost[k-1][i] + lengths[j] x (documents in bins i+1..j). The padding
    is that sum less the lengths themselves, which no choice changes.
    """
    lengths, counts = np.asarray(lengths, float), np.asarray(counts, float)
    n = len(lengths)
    if not n:
        return []
    upto = np.concatenate([[0.0], np.cumsum(counts)])
    cost = np.concatenate([[0.0], np.full(n, np.inf)])
    choice = []
    for _ in range(min(buckets, n)):
        now, came = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        now[0] = 0.0
        for j in range(1, n + 1):
            tried = cost[:j] + lengths[j - 1] * (upto[j] - upto[:j])
            came[j] = int(np.argmin(tried))
            now[j] = tried[came[j]]
        cost = now
        choice.append(came)
    bounds, j = [], n
    for came in reversed(choice):
        if j == 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = came[j]
    return bounds[::-1]


def packed(docs: DataFrame, budget: int = 8192, buckets: int = 16) -> DataFrame:
    """Batch of every row: (doc_id, n_tokens, bucket, batch, slot, padding).

    ``n_tokens`` counts words (null or blank text: 0). ``bucket`` is the padded length: the least
    of the chosen bounds that holds the row. A batch holds rows of one bucket, as many as fit
    ``budget`` when each is padded to the bucket, one if the bucket exceeds it; only the last batch
    of a bucket may hold fewer. Every row is in one batch, whole. Bounds come from the histogram of
    all rows; it has at most a few thousand bins (see ``bin_top``) and is all that reaches the
    driver. Repeated rows are packed one by one, extra columns are ignored, an empty table gives an
    empty result.
    """
    length = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select("doc_id", length.alias("n_tokens")).withColumn("_top", bin_top(F.col("n_tokens")))
    histogram = sized.groupBy("_top").count().orderBy("_top").collect()
    bounds = best_buckets([r["_top"] for r in histogram], [r["count"] for r in histogram], buckets) or [0]
    bucket = F.lit(bounds[-1])
    for b in reversed(bounds[:-1]):
        bucket = F.when(F.col("_top") <= b, F.lit(b)).otherwise(bucket)
    placed = ranked(sized.withColumn("bucket", bucket.cast("long")), "bucket", [F.xxhash64("doc_id"), F.col("doc_id"), F.col("n_tokens")])
    room = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(F.col("bucket"), F.lit(1))))
    return placed.select("doc_id", "n_tokens", "bucket", F.floor((F.col("rank") - 1) / room).cast("long").alias("batch"),
                         F.pmod(F.col("rank") - 1, room).alias("slot"), (F.col("bucket") - F.col("n_tokens")).alias("padding"))
