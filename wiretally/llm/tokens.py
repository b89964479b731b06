"""Token counts of whole texts with a public tokenizer; huge texts in overlapping chunks that are spliced."""

import json
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.llm.common import text_bytes

#: Characters of which one that a text lacks marks its cuts.
_MARKS = "\0\ue000\ue001\uf8ff"
_RUN = re.compile(r"\s ")


class Counter:
    """Counts tokens as the tokenizer gives them for a whole text.

    Texts of more than ``chunk`` characters are encoded in chunks that overlap by ``overlap``. Two
    neighbours are spliced where both begin a pre-token: the rules that cut a text to pre-tokens read
    it from left to right, so two readings that start a pre-token at one place go on alike. The last
    pre-tokens of a chunk may depend on what follows it and don't count as common; where no common
    start is left the overlap doubles, up to the whole rest.
    """

    def __init__(self, path: str, chunk: int = 1 << 16, overlap: int = 1 << 10, margin: int = 4):
        from tokenizers import Tokenizer
        if overlap >= chunk:
            raise ValueError("overlap must be smaller than chunk")
        self.tokenizer, self.chunk, self.overlap, self.margin = Tokenizer.from_file(path), chunk, overlap, margin
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        rules = json.loads(self.tokenizer.to_str())
        self.cuts = (rules["normalizer"] is None and rules["pre_tokenizer"] is not None
                     and rules["pre_tokenizer"]["type"] == "ByteLevel" and not rules["pre_tokenizer"]["add_prefix_space"]
                     and rules["pre_tokenizer"]["use_regex"] and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] for t in rules["added_tokens"]))
        self.known = {}

    def counts(self, texts):
        """Token counts of many texts; short ones are encoded together in lots of bounded size."""
        return [self.spliced(t) if len(t) > self.chunk else self.pieced(t) for t in texts]

    def pieced(self, text) -> int:
        """Tokens of a text by its pieces, each different piece encoded once.

        A space after a character that is no white space always begins a pre-token: no rule of the
        byte-level pattern has a space anywhere but in front or within a run of white space. So a
        text may be cut there. Tokenizers with other pre-tokens are given the whole text.
        """
        if not self.cuts:
            return len(self.tokenizer.encode(text, add_special_tokens=False))
        mark = next((m for m in _MARKS if m not in text), None)
        if mark is None:
            return len(self.tokenizer.encode(text, add_special_tokens=False))
        marked = text.replace(" ", mark + " ")
        if _RUN.search(text):
            marked = re.sub(rf"(?<=\s){mark}", "", marked)
        pieces = marked.split(mark)
        new = list(set(pieces).difference(self.known))
        if new:
            if len(self.known) > 1_000_000:
                self.known.clear()
                new = list(set(pieces))
            self.known.update(zip(new, map(len, self.tokenizer.encode_batch_fast(new, add_special_tokens=False))))
        return sum(map(self.known.__getitem__, pieces))

    def _starts(self, text, at):
        """Where pre-tokens begin in an encoded chunk, in the whole text's characters, and their token numbers."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        words = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
        first = np.ones(len(words), bool)
        # Added tokens stand alone and have no place in the order of pre-tokens.
        first[1:] = (words[1:] != words[:-1]) | (words[1:] < 0)
        number, places = np.flatnonzero(first), e.offsets
        return np.array([places[i][0] for i in number], np.int64) + at, number, len(words)

    def spliced(self, text) -> int:
        total, at, skip = 0, 0, 0
        starts, number, held = self._starts(text[:self.chunk], 0)
        end = min(self.chunk, len(text))
        while end < len(text):
            overlap = self.overlap
            while True:
                begin = max(end - overlap, at + 1)
                nxt = self._starts(text[begin:end + self.chunk], begin)
                known = starts[:-self.margin] if len(starts) > self.margin else starts[:0]
                common, here, there = np.intersect1d(known, nxt[0], return_indices=True)
                ok = (common > begin) & (number[here] >= skip)
                if ok.any():
                    k = np.flatnonzero(ok)[-1]
                    total += int(number[here[k]]) - skip
                    at, skip = begin, int(nxt[1][there[k]])
                    starts, number, held = nxt
                    end = min(end + self.chunk, len(text))
                    break
                if begin <= at + 1:  # no common start in the whole chunk: take it together with the next
                    end = min(end + self.chunk, len(text))
                    starts, number, held = self._starts(text[at:end], at)
                    break
                overlap *= 2
        return total + held - skip


def counted(docs: DataFrame, path: str, **how) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row: bytes of UTF-8 and tokens of the tokenizer file at ``path``.

    No special tokens are added, nothing is cut or padded; strings of added tokens inside a text
    are read as the tokenizer's default has it. Null is empty: no bytes, no tokens. Repeated rows
    are counted one by one, extra columns ignored. The file must be at ``path`` on every executor.
    """
    def run(batches):
        counter = Counter(path, **how)
        for b in batches:
            b["n_tokens"] = np.array(counter.counts([t or "" for t in b["text"]]), np.int64)
            yield b[["doc_id", "n_bytes", "n_tokens"]]
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
                       F.octet_length(text_bytes()).cast("long").alias("n_bytes"))
    return (rows.mapInPandas(run, "doc_id string, n_bytes long, n_tokens long")
            .select(F.col("doc_id").cast("long").alias("doc_id"), "n_bytes", "n_tokens"))


def digest(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    return counted(docs, path).withColumn("over_limit", F.col("n_tokens") > limit)
