"""Benchmark decontamination: a broadcast set of benchmark word windows, scanned over all windows of every text.

Expressions only: no Python code runs on rows.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.llm.common import staged

#: What parts words: all of ASCII but digits and letters; characters outside ASCII belong to words.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: Bytes of windows that one broadcast may hold; a larger set is met in several blocks.
BLOCK_BYTES = 64_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text):
    """The words of a text with A-Z in lower case; ``lower`` would change other letters, so it is left to words in plain ASCII."""
    plain = lambda w: F.length(w) == F.octet_length(w)
    return F.transform(F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), ""),
                       lambda w: F.when(plain(w), F.lower(w)).otherwise(F.translate(w, _UPPER, _LOWER)))


def _bound(df: DataFrame, **columns) -> DataFrame:
    """Add columns behind a one-row generator, so that later expressions read them instead of computing them anew."""
    made = F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()])))
    return df.select("*", made.alias("_bound")).select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"_bound.{k}").alias(k) for k in columns])


def _hash_at(words, at, size: int):
    """Hash of the ``size`` words from number ``at``; in generated code this only reads the array in place."""
    return F.xxhash64(*[F.element_at(words, at + k) for k in range(size)])


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(n, hash, gram, items): the different word windows of the items and the ids of the items that hold each.

    A window is ``size`` words in a row; an item of fewer words, but not none, is one window of ``n``
    words. Items without words give none. Ids are text and sorted; a null id names no item.
    """
    words = _bound(benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text")), w=_words(F.col("text")))
    n = F.least(F.size("w"), F.lit(size))
    held = words.where(F.size("w") > 0).select("item", "w", n.alias("n"))
    runs = held.select("item", "w", "n", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)).alias("at"))
    grams = runs.select("item", "n", F.slice("w", F.col("at"), F.col("n")).alias("gram"))
    out = grams.groupBy("n", "gram").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hashed = F.coalesce(*[F.when(F.col("n") == n, _hash_at("gram", F.lit(1), n)) for n in range(1, size + 1)])
    return out.select("n", hashed.alias("hash"), F.concat_ws(" ", "gram").alias("gram"), "items")


def matched(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """What the benchmark covers in each row of ``docs``: (doc_id, n_words, runs, items).

    ``runs`` are the covered stretches of words, sorted and apart, as (first, last) counted from 1;
    ``items`` the sorted ids, as text, of the items with a window in the row. A window is looked up by
    its hash in the broadcast set and counts only if its words are the same. The set is broadcast in
    as many blocks as keep each below ``block_bytes``; every block meets every window of the texts.
    Each row is its own: rows that repeat a doc_id, and rows without one, are judged by their texts.
    Texts are not shuffled, only one small row per text and match.
    """
    known = windows(benchmark, size)
    weight = F.length("gram") + F.size("items") * 24 + 64
    sizes = known.groupBy("n").agg(F.sum(weight).alias("bytes")).collect()
    blocks = max(1, -(-sum(r["bytes"] for r in sizes) // block_bytes))
    lengths = sorted(r["n"] for r in sizes)
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row"))
    words = _bound(numbered, _w=_words(F.col("text")))
    # Places of a row: 0 stands for the row itself, so that rows without a match stay; then come the windows of each length.
    n, at, ends = F.lit(0), F.lit(0), [F.lit(0)]
    key, place = F.lit(None).cast("long"), F.col("_place")
    for size_ in lengths:
        begin = ends[-1]
        ends.append(begin + F.greatest(F.size("_w") - (size_ - 1), F.lit(0)))
        here = (place > begin) & (place <= ends[-1])
        n, at = F.when(here, F.lit(size_)).otherwise(n), F.when(here, place - begin).otherwise(at)
        key = F.when(here, _hash_at("_w", place - begin, size_)).otherwise(key)
    marked = words.select("doc_id", "_row", "_w", F.explode(F.sequence(F.lit(0), ends[-1])).alias("_place")).select(
        "doc_id", "_row", "_w", n.alias("n"), at.alias("at"), key.alias("hash"))

    def met(block):
        part = known if blocks == 1 else known.where(F.pmod(F.xxhash64("gram"), F.lit(blocks)) == block)
        found = marked.join(F.broadcast(part.select("hash", "gram", "items")), "hash", "left")
        same = F.concat_ws(" ", F.slice("_w", F.col("at"), F.col("n"))) == F.col("gram")
        row = (F.col("n") == 0) if block == 0 else F.lit(False)
        return found.where(row | F.when(F.col("gram").isNotNull(), same)).select(
            "doc_id", "_row", F.when(row, F.size("_w")).alias("n_words"), F.when(F.col("n") > 0, F.struct("at", (F.col("at") + F.col("n") - 1).alias("to"))).alias("hit"), "items")

    hits = reduce(DataFrame.unionByName, [met(b) for b in range(blocks)])
    rows = hits.groupBy("doc_id", "_row").agg(F.max("n_words").cast("long").alias("n_words"), F.array_sort(F.collect_set("hit")).alias("hits"),
                                              F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return rows.select("doc_id", "n_words", _merged(F.col("hits")).alias("runs"), "items")


def _merged(hits):
    """Sorted (at, to) stretches with those that touch or overlap made one."""
    kind = "array<struct<first:int,last:int>>"
    pair = lambda a, b: F.struct(a.alias("first"), b.alias("last"))

    def add(done, hit):
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(pair(last["first"], F.greatest(last["last"], hit["to"]))))
        return F.when((F.size(done) > 0) & (hit["at"] <= last["last"] + 1), joined).otherwise(F.concat(done, F.array(pair(hit["at"], hit["to"])))).cast(kind)

    return F.aggregate(hits, F.array().cast(kind), add)


def digest(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, **limits) -> DataFrame:
    """One row per row of ``docs``: words, words hit, and the items found.

    Words are runs of digits, a-z and characters outside ASCII, once A-Z are lower case; a null text has
    none. ``n_hit`` counts the words inside a window of the benchmark, each once. ``items_sha256`` is
    the hash of the ids of ``n_items`` items, sorted as text and joined by commas. An item without an
    id marks words but is not counted; rows that share an item_id are one item. Empty tables on
    either side give no rows, or rows without hits. Extra columns are ignored.
    """
    found = matched(docs, benchmark, size, **limits)
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + (r["last"] - r["first"] + 1))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated"))


def _without(text, runs):
    """The text without the words of ``runs`` and what stands between them; the rest stays as it is."""
    words = F.array_remove(F.split(text, GAP), "")
    gaps = F.split(text, "[^" + GAP[1:])
    kept = F.zip_with(words, F.slice(gaps, F.lit(2), F.size(words)), lambda w, g: F.concat(w, g))

    def piece(i):
        begin = F.when(i == 0, F.lit(0)).otherwise(F.try_element_at(runs, i)["last"])
        end = F.when(i == F.size(runs), F.size(words) + 1).otherwise(F.try_element_at(runs, i + 1)["first"])
        return F.concat(F.element_at(gaps, begin + 1), F.array_join(F.slice(kept, begin + 1, F.greatest(end - begin - 1, F.lit(0))), ""))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.size(runs)), piece), "")


def cleaned(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", size: int = WINDOW, **limits) -> DataFrame:
    """``docs`` without what the benchmark covers; columns are unchanged.

    ``remove="spans"`` cuts the covered words out of the texts, ``"documents"`` drops every row with a
    match. Rows without a match, null texts too, stay as they are. The rows are numbered in a table in
    the shared folder, so that both readings see the same numbers.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(f"cannot remove {remove}")
    rows = staged(docs.withColumn("_number", F.monotonically_increasing_id()))
    found = matched(rows.select(F.col("_number").alias("doc_id"), "text"), benchmark, size, **limits)
    hit = found.where(F.size("runs") > 0).select(F.col("doc_id").alias("_number"), F.col("runs").alias("_runs"))
    if remove == "documents":
        return rows.join(hit, "_number", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    text = F.when(F.col("_runs").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("_runs")))
    return rows.join(hit, "_number", "left").select(*[(text.alias(c) if c == "text" else F.col(f"`{c}`")) for c in docs.columns])


SQL = r"""
WITH said AS (
  SELECT doc_id, row_number() OVER () AS r,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
asked AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
grams AS (
  SELECT DISTINCT item, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS gram
  FROM (SELECT item, w, least(len(w), 10) AS n FROM asked WHERE len(w) > 0)),
places AS (
  SELECT r, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS gram,
         unnest(range(1, len(w) - n + 2)) AS p
  FROM said, (SELECT DISTINCT n FROM grams) WHERE len(w) >= n),
hits AS (SELECT DISTINCT r, p, n, item FROM places JOIN grams USING (n, gram)),
covered AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS k FROM hits) GROUP BY r),
found AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM said LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""
