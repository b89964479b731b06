"""Document fingerprints: a Merkle tree over spans, paragraphs and sections."""

from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.llm.common import parts_for, text_bytes

#: A span ends where the hash of its last 8 bytes is a multiple of this, or with its paragraph.
SPAN = 32
#: A section ends with a paragraph whose digest is a multiple of this.
SECTION = 4


def spans(data: bytes):
    """Where spans end: at line feeds and at places that the last 8 bytes choose, so an edit moves only ends near it."""
    a = np.frombuffer(data, np.uint8)
    ends = [np.flatnonzero(a == 10) + 1]
    if len(a) >= 8:
        w = a.astype(np.uint64)
        for step in (1, 2, 4):
            w = w[:-step] | (w[step:] << np.uint64(8 * step))
        w *= np.uint64(0x9E3779B97F4A7C15)
        ends.append(np.flatnonzero((w >> np.uint64(40)) % np.uint64(SPAN) == 0) + 8)
    return np.unique(np.append(np.concatenate(ends), len(a))) if len(a) else np.zeros(0, np.int64)


def fingerprint(text: str) -> str:
    """``root:sections`` in hex. Sections stand apart by ``/``, paragraphs by ``.``; a span has 6 digits.

    A paragraph's digest is that of its spans' digests, a section's that of its paragraphs', the
    root's that of the sections'. Equal roots say equal texts; else the branches tell what differs.
    """
    data, start = text.encode("utf-8", "surrogatepass"), 0
    digest = xxhash.xxh64_digest
    sections, paragraphs, leaves, shown, tree = [], [], [], [], []
    for end in spans(data).tolist():
        leaf = digest(data[start:end])
        leaves.append(leaf)
        shown.append(leaf[:3].hex())
        if data[end - 1] == 10 or end == len(data):
            node = digest(b"".join(leaves))
            paragraphs.append(node)
            tree.append("".join(shown))
            leaves, shown = [], []
            if node[-1] % SECTION == 0 or end == len(data):
                sections.append((digest(b"".join(paragraphs)), ".".join(tree)))
                paragraphs, tree = [], []
        start = end
    root = xxhash.xxh3_128_hexdigest(b"".join(d for d, _ in sections))
    return f"{root}:{'/'.join(t for _, t in sections)}"


def _spans_of(print_):
    body = print_[33:].replace("/", "").replace(".", "")
    return Counter(body[i:i + 6] for i in range(0, len(body), 6))


def likeness(a: str, b: str) -> float:
    """Shared spans as a part of the longer side's spans, repeats counted; 1 exactly where the roots agree."""
    if a[:32] == b[:32]:
        return 1.0
    left, right = _spans_of(a), _spans_of(b)
    most = max(sum(left.values()), sum(right.values()))
    return min(sum((left & right).values()) / most, 1 - 1e-9) if most else 0.0


def differing_sections(a: str, b: str) -> list:
    """Numbers of sections of ``a`` that ``b`` doesn't hold: where an edit lies."""
    if a[:32] == b[:32]:
        return []
    held = set(b[33:].split("/"))
    return [i for i, s in enumerate(a[33:].split("/")) if s not in held]


def edited(text: str, other: str) -> str:
    """The last third of a text (rounded down) replaced by as much of the start of another."""
    n = len(text) // 3
    return text[:len(text) - n] + other[:n]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row; a null text is empty. Extra columns are ignored."""
    def run(batches):
        for b in batches:
            b["fingerprint"] = [fingerprint(t) for t in b["text"]]
            yield b[["doc_id", "fingerprint"]]
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id string, fingerprint string").select(F.col("doc_id").cast("long").alias("doc_id"), "fingerprint")


def compared(docs: DataFrame, part_bytes: int = 32 << 20) -> DataFrame:
    """Every document with its edited version and the next document, compared by fingerprint.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    The next document has the next smaller doc_id, the first follows the last. Equal ids stand in
    order of a hash of the text, null ids after all others; a null text is empty. Documents are
    dealt out by ranges of doc_id, each range with the first document of the following one, so
    every text moves once. The bounds of the ranges and their first ids are all that the driver
    sees. Extra columns are ignored, an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = parts_for(docs, F.octet_length(text_bytes()) + 64, part_bytes)
    chances = [i / parts for i in range(1, parts)]
    bounds = np.unique(np.array(rows.approxQuantile("doc_id", chances, 0.25 / parts) if parts > 1 else [], np.int64))

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        known = ids.notna()
        place = pd.Series(len(bounds) + 1, index=ids.index, dtype="int32")
        place[known] = len(bounds) - np.searchsorted(bounds, ids[known].astype("int64"), side="right")
        return place
    placed = rows.withColumns({"part": part_of("doc_id"), "tie": F.xxhash64("text")})
    order = F.struct(F.col("doc_id").isNull().alias("none"), (-F.col("doc_id")).alias("down"), F.col("tie"))
    heads = sorted((r["part"], r["head"]["down"], r["head"]["tie"]) for r in
                   placed.select("part", order.alias("o")).groupBy("part").agg(F.min("o").alias("head")).collect())
    spark = docs.sparkSession
    links = [(heads[i - 1][0], part, None if down is None else -down, tie) for i, (part, down, tie) in enumerate(heads)]
    first = spark.createDataFrame(links, "before int, at int, head long, head_tie long")
    led = placed.join(F.broadcast(first), (F.col("part") == F.col("at")) & F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("tie") == F.col("head_tie")), "left")
    own = F.struct(F.col("part"), F.lit(0).alias("follows"))
    lent = F.struct(F.col("before").alias("part"), F.lit(1).alias("follows"))
    dealt = led.select("doc_id", "text", "tie", F.explode(F.when(F.col("at").isNull(), F.array(own)).otherwise(F.array(own, lent))).alias("to"))
    dealt = dealt.select(F.col("doc_id").cast("string").alias("id"), "text", "to.part", "to.follows", "doc_id", "tie")
    ordered = dealt.repartition("part").sortWithinPartitions("part", "follows", F.desc_nulls_last("doc_id"), "tie").drop("doc_id", "tie")
    kind = "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    found = ordered.mapInPandas(_walk, kind)
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def _walk(batches):
    """Rows in order, each compared with the one after it; the last of a range with the row it was lent."""
    import hashlib

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    held = None
    for b in batches:
        out = []
        for doc_id, text, part, follows in zip(b["id"], b["text"], b["part"], b["follows"]):
            mark = None
            if held is not None and held[2] == part:
                mark = fingerprint(text)
                was, before, _, old = held
                new = edited(before, text)
                other = old if new == before else fingerprint(new)
                out.append((was, len(before), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), old, other, likeness(old, other), likeness(old, mark)))
            held = None if follows else (doc_id, text, part, mark or fingerprint(text))
        yield pd.DataFrame(out, columns=names)
