"""Toxicity by compression: windows of text against a toxic and an ordinary zstandard dictionary."""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.llm.common import text_bytes

CODE = 8
#: ASCII letters in lower case, ASCII marks as spaces; other bytes stay.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


class _Codes(dict):
    """Words to codes of fixed length, so that a dictionary matches whole words and nothing less."""

    def __missing__(self, word):
        if len(self) > 1_000_000:
            self.clear()
        code = self[word] = xxhash.xxh64_digest(word)
        return code


def words_of(text: bytes):
    return text.translate(_PLAIN).split()


@dataclass(frozen=True)
class Model:
    """Two dictionaries of word codes, the window size in words, the gain in bytes that counts, and the calibration."""
    ordinary: bytes
    toxic: bytes
    lead: bytes
    window: int
    gain: int
    weights: tuple


class Scorer:
    """Compares the compressed lengths of a text's windows under both dictionaries."""

    def __init__(self, model: Model):
        self.model, self.codes = model, _Codes()
        self.plain, self.bad = _compressor(model.ordinary), _compressor(model.toxic)

    def gains(self, text: bytes):
        """Per window, how many bytes shorter the toxic dictionary makes it."""
        coded = b"".join(map(self.codes.__getitem__, words_of(text)))
        step, lead = CODE * self.model.window, self.model.lead
        plain, bad = self.plain.compress, self.bad.compress
        return [len(plain(part)) - len(bad(part)) for part in (lead + coded[i:i + step] for i in range(0, len(coded), step))]

    def features(self, text: bytes):
        """Windows whose gain counts, the bytes they gain, and windows in all."""
        gains = self.gains(text)
        hits = [g for g in gains if g >= self.model.gain]
        return len(hits), sum(hits), len(gains)

    def score(self, text: bytes) -> float:
        return float(_logistic(_inputs(*self.features(text)), np.array(self.model.weights)))


def _compressor(content):
    held = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
    how = zs.ZstdCompressionParameters(compression_level=3, window_log=18, hash_log=17, chain_log=17, search_log=4, min_match=5,
                                       strategy=zs.STRATEGY_GREEDY, format=zs.FORMAT_ZSTD1_MAGICLESS, write_content_size=0,
                                       write_checksum=0, write_dict_id=0)
    held.precompute_compress(compression_params=how)
    return zs.ZstdCompressor(dict_data=held, compression_params=how)


def _inputs(hits, gained, windows):
    return np.array([1.0, float(hits > 0), math.log1p(gained), math.log1p(gained / max(windows, 1))])


def _logistic(x, w):
    return 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))


def _fitted(x, y, n, ridge=1.0, rounds=50):
    """Logistic weights of rows that stand for ``n`` documents each, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = _logistic(x, w)
        slope = x.T @ (n * (y - p)) - ridge * w
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learnable(doc_id):
    """The rows whose labels may be learnt from; the others are held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) != 1


def train(docs: DataFrame, labels: DataFrame, sample: int = 50_000, window: int = 32, common: int = 2048, lexicon: int = 4096) -> Model:
    """A model from labelled documents.

    It learns from at most ``sample`` labelled documents, those of least hash among the learnable.
    Two thirds of them give the dictionaries: both hold the ``common`` most frequent ordinary words;
    the toxic one goes on with up to ``lexicon`` words that toxic documents hold more often than
    chance allows, the ordinary one with as many further ordinary words. The rest calibrates the
    gain that counts and the scores. Word counts are made in Spark; what reaches the driver is
    bounded by ``common``, ``lexicon`` and the few different results of a document. Without labels
    of both kinds every score is the share of toxic labels (0 without any).
    """
    chosen = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(learnable(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
              .select(F.col("doc_id").alias("_id"), "_toxic", (F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)) == 0).alias("_calibrates")))
    known = docs.select("doc_id", text_bytes().alias("raw")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("raw", "_toxic", "_calibrates")
    counted = known.where("not _calibrates").select("raw", "_toxic").mapInPandas(_count_words, "word binary, kind int, n long")
    totals = counted.groupBy("word").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(name) for k, name in ((0, "plain"), (1, "bad"))])
    ends = {r["kind"]: r["n"] for r in known.where("not _calibrates").groupBy(F.col("_toxic").alias("kind")).agg(F.count(F.lit(1)).alias("n")).collect()}
    plain_docs, bad_docs = ends.get(0, 0), ends.get(1, 0)
    if not plain_docs or not bad_docs:
        share = bad_docs / max(plain_docs + bad_docs, 1)
        return Model(b"\0" * CODE, b"\0" * CODE, b"", window, 1, (math.log(max(share, 1e-6) / max(1 - share, 1e-6)), 0.0, 0.0, 0.0))
    share = bad_docs / (plain_docs + bad_docs)
    both = F.col("plain") + F.col("bad")
    part = lambda n, p: F.when(n > 0, n * F.log(n / (both * F.lit(p)))).otherwise(0.0)
    rated = totals.withColumn("surprise", 2 * (part(F.col("bad"), share) + part(F.col("plain"), 1 - share)))
    toxic_more = F.col("bad") * F.lit(float(plain_docs)) > F.lit(2.7 * bad_docs) * F.col("plain")
    tries = rated.where("bad >= 2").count()
    # Words tried make some look toxic by chance; the bound lets less than one in seven trainings hold such a word.
    suspects = [bytes(r["word"]) for r in rated.where(toxic_more & (F.col("surprise") > 2 * math.log(max(tries, 2)) + 4))
                .orderBy(F.desc("surprise"), "word").limit(lexicon).select("word").collect()]
    usual = [bytes(r["word"]) for r in totals.orderBy(F.desc("plain"), "word").limit(common + 2 * lexicon).select("word").collect()]
    apart = set(suspects)
    usual = [w for w in usual if w not in apart]
    code = lambda words: b"".join(xxhash.xxh64_digest(w) for w in reversed(words))
    base = code(usual[:common])
    model = Model(base + code(usual[common:common + len(suspects)]), base + code(suspects), base[-8 * CODE:], window, 1, (0.0,) * 4)
    # Gains of calibration documents, told apart only by what the thresholds need.
    seen = known.where("_calibrates").mapInPandas(_measure(model, range(1, 13)), "toxic int, gain int, hits long, gained long, windows long")
    table = seen.groupBy("gain", "toxic", "hits", "gained", "windows").count().collect()
    best = None
    for gain in range(1, 13):
        rows = [r for r in table if r["gain"] == gain]
        if not rows:
            continue
        x = np.array([_inputs(r["hits"], r["gained"], r["windows"]) for r in rows])
        y, n = np.array([r["toxic"] for r in rows], float), np.array([r["count"] for r in rows], float)
        w = _fitted(x, y, n)
        p = _logistic(x, w)
        loss = -float((n * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())
        if best is None or loss < best[0]:
            best = (loss, gain, tuple(w.tolist()))
    if best is None:
        return Model(model.ordinary, model.toxic, model.lead, window, 4, (-3.0, 4.0, 0.5, 0.0))
    return Model(model.ordinary, model.toxic, model.lead, window, best[1], best[2])


def _count_words(batches):
    """Document counts of words, by label, summed over a task's rows as far as memory allows."""
    def out(counts):
        return pd.DataFrame([(w, k, n) for (w, k), n in counts.items()], columns=["word", "kind", "n"])
    counts = {}
    for b in batches:
        for raw, kind in zip(b["raw"], b["_toxic"]):
            for w in set(words_of(raw)):
                counts[w, kind] = counts.get((w, kind), 0) + 1
            if len(counts) > 500_000:
                yield out(counts)
                counts = {}
    if counts:
        yield out(counts)


def _measure(model, tried):
    def run(batches):
        scorer = Scorer(model)
        for b in batches:
            rows = []
            for raw, kind in zip(b["raw"], b["_toxic"]):
                gains = scorer.gains(raw)
                for t in tried:
                    hits = [g for g in gains if g >= t]
                    # Few different values: gains are rounded up to twos beyond 32 bytes, windows to powers of two.
                    gained = sum(hits)
                    gained = gained if gained <= 32 else 1 << math.ceil(math.log2(gained))
                    rows.append((kind, t, min(len(hits), 1), gained, 1 << max(len(gains) - 1, 0).bit_length()))
            yield pd.DataFrame(rows, columns=["toxic", "gain", "hits", "gained", "windows"])
    return run


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row: 0 to 1, higher where a toxic label is likelier.

    Only the text counts; null and empty texts have no windows and get the score of a text without
    any sign. Repeated rows and ids come out one by one, extra columns are ignored. A row without a
    doc_id is never learned from and, having no remainder, not marked as held out.
    """
    def run(batches):
        scorer = Scorer(model)
        for b in batches:
            b["score"] = [scorer.score(raw) for raw in b["raw"]]
            yield b[["doc_id", "score"]]
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_bytes().alias("raw"))
    return rows.mapInPandas(run, "doc_id string, score double").select(F.col("doc_id").cast("long").alias("doc_id"), "score")


def digest(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    found = scored(docs, train(docs, labels))
    return found.select("doc_id", (~F.coalesce(learnable(F.col("doc_id")), F.lit(True))).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``docs`` without rows that score ``threshold`` or more; columns are unchanged."""
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for raw in batches:
            yield raw.map(scorer.score).astype("float64")
    return docs.where(F.pandas_udf(score, "double")(text_bytes()) < threshold)
