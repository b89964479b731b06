"""Removal of repeated passages with a family of suffix arrays.

Every string of ``length`` bytes is looked up in a suffix array whose suffixes are cut at that
length, which is all that a match of ``length`` bytes needs. The arrays are dealt out by content:
a string belongs to the place of its least-hashed 16-byte gram (its anchor), so equal strings meet
in one bucket, and neighbouring strings that share an anchor travel as one short window of text.

1. Each group of documents sends the anchors it holds; a bucket answers which of them occur in
   two documents or more. Strings of any other anchor can't repeat.
2. Each group sends its windows of those anchors, every different window once with its least
   doc_id. A bucket takes them in batches. A batch is sorted to a suffix array, merge-scanned
   against the levels of the bucket's family for the least doc_id of each string, and becomes a
   level itself; levels of like size merge, so that their sizes grow geometrically.
3. Each group takes the least doc_id of its strings and marks what a smaller one covers.

Groups and buckets hold a bounded amount of text and there are as many as the table needs. A
passage in any number of documents costs a bucket one window per group. A frequent line stands in
ever other surroundings, so the windows of its anchors differ; step 1 counts them, and the windows
of an anchor with more than ``CROWD`` are cut to single strings, each dealt by its own hash.
"""

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wiretally.llm.common import parts_for, text_bytes

GRAM = 16
PIECE = 1 << 20
#: How many different windows of an anchor, beyond one per group, may go to one bucket.
CROWD = 1 << 13
NO_ID = np.iinfo(np.int64).max
MIXED = np.iinfo(np.int64).min
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _words(a):
    """The 8 bytes from each place of a byte array as one number."""
    w = a.astype(np.uint64)
    for step in (1, 2, 4):
        w = w[:-step] | (w[step:] << np.uint64(8 * step))
    return w


def _gram_hashes(a):
    w = _words(a)
    h = (w[:-8] * _MIX[0]) ^ (w[8:] * _MIX[1])
    h ^= h >> np.uint64(29)
    h *= _MIX[2]
    return h ^ (h >> np.uint64(32))


def _least(h, span):
    """For each place the leftmost place of the least value among ``span`` from it on."""
    at, val, size = np.arange(len(h), dtype=np.int32), h, 1

    def join(step):
        nonlocal at, val
        right = val[step:] < val[:-step]
        at, val = np.where(right, at[step:], at[:-step]), np.where(right, val[step:], val[:-step])
    while 2 * size <= span:
        join(size)
        size *= 2
    if span > size:
        join(span - size)
    return at


class Windows:
    """The anchor windows of some texts: ``doc`` index, ``start`` and ``end`` in ``data``, ``key`` of the anchor.

    ``offset`` is where ``data`` holds the text of the window's document less its place there.
    """

    def __init__(self, texts, length):
        self.length, cols, kept, at = length, [], [], 0
        span = length - GRAM + 1
        for data, docs, begins, ends, froms in _blocks(texts, length):
            a = np.frombuffer(data, np.uint8)
            h = _gram_hashes(a)
            anchor = _least(h, span)
            owner = np.searchsorted(begins, np.arange(len(anchor), dtype=np.int64), side="right") - 1
            valid = np.arange(len(anchor), dtype=np.int64) + length <= ends[owner]
            new = np.ones(len(anchor), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
            first = np.flatnonzero(new & valid)
            if not len(first):
                continue
            stop = np.append(np.flatnonzero(new), len(anchor))
            last = np.minimum(stop[np.searchsorted(stop, first, side="right")], ends[owner[first]] - length + 1)
            own = owner[first]
            cols.append((docs[own], first + at, last - 1 + length + at, (h[anchor[first]] * _MIX[1]) | np.uint64(1),
                         first - begins[own] + froms[own]))
            kept.append(data)
            at += len(data)
        empty = np.zeros(0, np.int64)
        cols = cols or [(empty, empty, empty, empty.astype(np.uint64), empty)]
        self.data = b"".join(kept)
        self.doc, self.start, self.end, self.key, self.place = (np.concatenate(c) for c in zip(*cols))


def _blocks(texts, length):
    """Texts one after the other in byte blocks of bounded size; long texts in pieces that overlap by length - 1."""
    parts, docs, begins, ends, froms, size = [], [], [], [], [], 0

    def out():
        return (b"".join(parts), np.array(docs, np.int64), np.array(begins, np.int64), np.array(ends, np.int64), np.array(froms, np.int64))
    for i, text in enumerate(texts):
        for at in range(0, max(len(text) - length + 1, 0), PIECE):
            piece = text[at:at + PIECE + length - 1]
            parts.append(piece)
            docs.append(i)
            begins.append(size)
            size += len(piece)
            ends.append(size)
            froms.append(at)
            if size >= PIECE:
                yield out()
                parts, docs, begins, ends, froms, size = [], [], [], [], [], 0
    if parts:
        yield out()


def _bucketed(keys, buckets):
    """Bucket edges in sorted keys."""
    edges = (np.arange(1, buckets, dtype=object) << 64) // buckets
    return np.concatenate([[0], np.searchsorted(keys, np.array(edges.tolist(), np.uint64)), [len(keys)]]).astype(np.int64)


def _distinct_keys(windows, ids):
    """Sorted different anchors of a group, and which of them lie in documents of two ids or more."""
    order = np.argsort(windows.key, kind="stable")
    keys, owners = windows.key[order], ids[windows.doc[order]]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    starts = np.flatnonzero(new)
    if not len(starts):
        return keys, np.zeros(0, bool)
    return keys[starts], np.minimum.reduceat(owners, starts) < np.maximum.reduceat(owners, starts)


def _crowds(windows):
    """For each sorted different anchor of a group how many different windows it has beyond the first."""
    order = np.argsort(windows.key, kind="stable")
    _, number, count = np.unique(windows.key[order], return_inverse=True, return_counts=True)
    order, number = order[count[number] > 1], number[count[number] > 1]
    texts = (windows.data[s:e] for s, e in zip(windows.start[order].tolist(), windows.end[order].tolist()))
    different = np.fromiter((n for n, _ in set(zip(number.tolist(), texts))), np.int64)
    return np.maximum(np.bincount(different, minlength=len(count)) - 1, 0)


def _group(table, length):
    """Ids and texts of a group in an order that the rows alone fix, and the permutation."""
    ids = np.array([NO_ID if v is None else v for v in table["_sfx_id"].to_pylist()], np.int64)
    texts = pc.fill_null(table["text"], "").cast(pa.binary()).to_pylist()
    return ids, texts, Windows(texts, length)


# --- step 1: anchors that occur in two documents

_ANCHORS = T.StructType([T.StructField("_sfx_bucket", T.IntegerType()), T.StructField("_sfx_group", T.IntegerType()), T.StructField("_sfx_data", T.BinaryType())])
_WINDOWS = T.StructType(_ANCHORS.fields + [T.StructField("_sfx_bits", T.BinaryType())])


def _table(buckets, groups, data, bits=None):
    cols = {"_sfx_bucket": pa.array(buckets, pa.int32()), "_sfx_group": pa.array(groups, pa.int32()), "_sfx_data": pa.array(data, pa.binary())}
    return pa.table(cols if bits is None else cols | {"_sfx_bits": pa.array(bits, pa.binary())})


def _anchors_of(length, buckets):
    def run(table):
        ids, _, windows = _group(table, length)
        keys, several = _distinct_keys(windows, ids)
        edges, crowds, out = _bucketed(keys, buckets), _crowds(windows), []
        for b in np.flatnonzero(np.diff(edges)):
            part = slice(edges[b], edges[b + 1])
            short = (keys[part] >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6]
            at = np.flatnonzero(crowds[part])
            more = np.stack([at, crowds[part][at]]).astype(np.uint32)
            out.append((int(b), np.uint32(len(short)).tobytes() + short.tobytes() + np.packbits(several[part]).tobytes() + more.tobytes()))
        group = table["_sfx_group"][0].as_py()
        return _table([b for b, _ in out], [group] * len(out), [d for _, d in out])
    return run


def _repeated_anchors(table):
    """Which anchors of each group's list occur in two documents: one bit each, then the places of the crowded ones."""
    lists, several, places, extras, begin = [], [], [], [], 0
    for data in table["_sfx_data"].to_pylist():
        n = int(np.frombuffer(data, np.uint32, 1)[0])
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :6] = np.frombuffer(data, np.uint8, 6 * n, 4).reshape(n, 6)
        lists.append(wide.view(np.uint64).ravel())
        end = 4 + 6 * n + (n + 7) // 8
        several.append(np.unpackbits(np.frombuffer(data[:end], np.uint8, offset=4 + 6 * n), count=n).astype(bool))
        at, extra = np.frombuffer(data[end:], np.uint32).reshape(2, -1).astype(np.int64)
        places.append(begin + at)
        extras.append(extra)
        begin += n
    keys = np.concatenate(lists)
    found, place, count = np.unique(keys, return_inverse=True, return_counts=True)
    twice, crowd = count > 1, np.zeros(len(found), np.int64)
    twice[place[np.concatenate(several)]] = True
    np.add.at(crowd, place[np.concatenate(places)], np.concatenate(extras))
    bits, crowded, at, out = twice[place], (twice & (crowd > CROWD))[place], 0, []
    for keys in lists:
        out.append(np.packbits(bits[at:at + len(keys)]).tobytes() + np.flatnonzero(crowded[at:at + len(keys)]).astype(np.uint32).tobytes())
        at += len(keys)
    return _table(table["_sfx_bucket"].to_pylist(), table["_sfx_group"].to_pylist(), out)


# --- step 2: windows of those anchors, and their strings in a family of suffix arrays

class Family:
    """Suffix arrays of geometrically growing sizes; each maps strings of ``length`` bytes to a least doc_id."""

    def __init__(self, length):
        self.kind, self.levels = f"S{length}", []

    def add(self, strings, owners):
        """A new batch: sorted to a suffix array, merge-scanned against every level, then merged with levels of its size.

        Gives back the batch's order, for ``least``.
        """
        order = np.argsort(strings, kind="stable")
        level = _different_strings(strings[order], owners[order])
        for suffixes, least in self.levels:
            at, same = _meet(suffixes, level[0])
            level[1][same] = np.minimum(level[1][same], least[at[same]])
        self.levels.append(level)
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            (a, x), (b, y) = self.levels.pop(), self.levels.pop()
            strings, owners = np.concatenate([b, a]), np.concatenate([y, x])
            merged = np.argsort(strings, kind="stable")  # two sorted runs merge in linear time
            self.levels.append(_different_strings(strings[merged], owners[merged]))
        return order

    def least(self, strings, order=None):
        """The least doc_id of each string over all levels, which are scanned in the strings' sorted order."""
        order = np.argsort(strings, kind="stable") if order is None else order
        strings, found = strings[order], np.full(len(strings), NO_ID)
        for suffixes, least in self.levels:
            at, same = _meet(suffixes, strings)
            found[same] = np.minimum(found[same], least[at[same]])
        out = np.empty(len(strings), np.int64)
        out[order] = found
        return out


def _different_strings(strings, owners):
    """The different ones of sorted strings, with their least owners."""
    new = np.ones(len(strings), bool)
    new[1:] = strings[1:] != strings[:-1]
    starts = np.flatnonzero(new)
    return strings[starts], np.minimum.reduceat(owners, starts) if len(starts) else owners


def _meet(suffixes, strings):
    if not len(suffixes):
        return np.zeros(len(strings), np.int64), np.zeros(len(strings), bool)
    at = np.minimum(np.searchsorted(suffixes, strings), len(suffixes) - 1)
    return at, suffixes[at] == strings


def _strings(data, starts, counts, length):
    """All strings of ``length`` bytes of the windows."""
    total = int(counts.sum())
    first = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(total)
    view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), length)
    return np.ascontiguousarray(view[first]).view(f"S{length}").ravel()


def _windows_of(length, buckets):
    def run(docs, answers):
        if not docs.num_rows:
            return _table([], [], [], [])
        ids, _, windows = _group(docs, length)
        given = dict(zip(answers["_sfx_bucket"].to_pylist(), answers["_sfx_data"].to_pylist()))
        plain, crowded = _chosen(windows, given, ids, buckets)
        single, out = Single(windows, crowded, ids, length, buckets), []
        for b in sorted(set(plain) | set(single.buckets)):
            texts, least, _ = _different(windows, plain.get(b, crowded[:0]), ids)
            part = single.part(b)
            sizes = np.append(np.fromiter((len(t) for t in texts), np.uint16, len(texts)), np.full(part.stop - part.start, length, np.uint16))
            raw = sizes.tobytes() + least.tobytes() + single.least[part].tobytes() + b"".join(texts) + single.strings[part].tobytes()
            out.append((b, zlib.compress(np.uint64(len(sizes)).tobytes() + raw, 1)))
        group = docs["_sfx_group"][0].as_py()
        return _table([b for b, _ in out], [group] * len(out), [d for _, d in out], [given.get(b, b"") for b, _ in out])
    return run


def _chosen(windows, given, ids, buckets):
    """The windows whose anchor has its bit set in its bucket's answer: by bucket those of plain anchors, and those of crowded ones.

    A bucket with crowded anchors only has an entry too, so that its answer travels on.
    """
    keys, _ = _distinct_keys(windows, ids)
    edges, repeated, crowded = _bucketed(keys, buckets), np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    for b, bits in given.items():
        n = int(edges[b + 1] - edges[b])
        repeated[edges[b]:edges[b + 1]] = np.unpackbits(np.frombuffer(bits[:(n + 7) // 8], np.uint8), count=n)
        crowded[edges[b] + np.frombuffer(bits[(n + 7) // 8:], np.uint32).astype(np.int64)] = True
    at = np.searchsorted(keys, windows.key)
    picked = np.flatnonzero(repeated[at])
    picked = picked[np.argsort(windows.key[picked], kind="stable")]
    edges, alone = _bucketed(windows.key[picked], buckets), crowded[at[picked]]
    plain = {}
    for b in np.flatnonzero(np.diff(edges)):
        part = slice(edges[b], edges[b + 1])
        plain[int(b)] = picked[part][~alone[part]]
    return plain, picked[alone]


class Single:
    """The different strings of a group's crowded windows, in order of a hash of their own that deals them to buckets.

    ``number`` is each window's text among ``counts`` and ``firsts``, which tell where its strings lie in ``which``,
    the list of string numbers.
    """

    def __init__(self, windows, chosen, ids, length, buckets):
        names, least, self.number = _different(windows, chosen, ids)
        self.counts = np.fromiter(map(len, names), np.int64, len(names)) - length + 1
        self.firsts = np.cumsum(self.counts) - self.counts
        sizes = self.counts + length - 1
        if names:
            strings = _strings(b"".join(names), np.cumsum(sizes) - sizes, self.counts, length)
        else:
            strings = np.zeros(0, f"S{length}")
        key = _string_hashes(strings, length)
        order = np.argsort(key, kind="stable")
        key, strings, owners = key[order], strings[order], np.repeat(least, self.counts)[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (strings[1:] != strings[:-1])
        self.which = np.zeros(len(key), np.int64)
        self.which[order] = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        self.strings, self.least = strings[starts], np.minimum.reduceat(owners, starts) if len(starts) else owners
        self.edges = _bucketed(key[starts], buckets)
        self.buckets = np.flatnonzero(np.diff(self.edges)).tolist()

    def part(self, bucket):
        return slice(int(self.edges[bucket]), int(self.edges[bucket + 1]))


def _string_hashes(strings, length):
    a, h = strings.view(np.uint8).reshape(-1, length), np.zeros(len(strings), np.uint64)
    for at in [*range(0, length - 8, 8), length - 8]:
        h = (h ^ np.ascontiguousarray(a[:, at:at + 8]).view(np.uint64).ravel()) * _MIX[0]
        h ^= h >> np.uint64(29)
    h *= _MIX[2]
    return h ^ (h >> np.uint64(32))


def _different(windows, chosen, ids):
    """Different texts of windows in sorted order, their least doc_id, and for each window its number."""
    data, seen = windows.data, {}
    texts = [data[s:e] for s, e in zip(windows.start[chosen].tolist(), windows.end[chosen].tolist())]
    for t in texts:
        seen.setdefault(t, 0)
    names = sorted(seen)
    for i, t in enumerate(names):
        seen[t] = i
    number = np.fromiter((seen[t] for t in texts), np.int64, len(texts))
    least = np.full(len(names), NO_ID)
    np.minimum.at(least, number, ids[windows.doc[chosen]])
    return names, least, number


def _opened(data):
    raw = zlib.decompress(data)
    n = int(np.frombuffer(raw, np.uint64, 1)[0])
    return np.frombuffer(raw, np.uint16, n, 8).astype(np.int64), np.frombuffer(raw[8 + 2 * n:8 + 10 * n], np.int64), raw[8 + 10 * n:]


def _least_ids(length, batch):
    def run(table):
        """Answers per group: the least doc_id of each string of each of its windows, as one number where they agree."""
        family, lists, known = Family(length), [], {}
        for data in table["_sfx_data"].to_pylist():
            sizes, least, text = _opened(data)
            cuts = np.cumsum(sizes)
            names = [text[a:z] for a, z in zip((cuts - sizes).tolist(), cuts.tolist())]
            for name, i in zip(names, least.tolist()):
                if i < known.get(name, NO_ID + 1):
                    known[name] = i
            lists.append(names)
        # A window that several groups sent enters once, with its least id.
        texts = sorted(known)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        owners = np.fromiter((known[t] for t in texts), np.int64, len(texts))
        counts, cuts = sizes - length + 1, np.cumsum(sizes)
        data, ends = b"".join(texts), np.cumsum(counts)
        lots = np.searchsorted(ends, np.arange(batch, (ends[-1] if len(ends) else 0) + batch, batch), side="right")
        spans = [(a, z) for a, z in zip(np.append(0, lots[:-1]).tolist(), np.append(lots[:-1], len(texts)).tolist()) if z > a]
        own = lambda a, z: _strings(data, (cuts - sizes)[a:z], counts[a:z], length)
        orders = [family.add(own(a, z), np.repeat(owners[a:z], counts[a:z])).astype(np.uint32) for a, z in spans]
        found = {}
        for (a, z), order in zip(spans, orders):
            least = family.least(own(a, z), order)
            starts = np.cumsum(counts[a:z]) - counts[a:z]
            low, high = np.minimum.reduceat(least, starts), np.maximum.reduceat(least, starts)
            for i in range(z - a):
                found[texts[a + i]] = (int(low[i]), b"") if low[i] == high[i] else (MIXED, least[starts[i]:starts[i] + counts[a + i]].tobytes())
        out = [zlib.compress(np.array([found[n][0] for n in names], np.int64).tobytes() + b"".join(found[n][1] for n in names), 1) for names in lists]
        return _table(table["_sfx_bucket"].to_pylist(), table["_sfx_group"].to_pylist(), out, table["_sfx_bits"].to_pylist())
    return run


# --- step 3: what to remove

def _spans_of(length, buckets):
    def covered(docs, answers):
        ids, texts, windows = _group(docs, length)
        marks = [[] for _ in texts]
        bits = dict(zip(answers["_sfx_bucket"].to_pylist(), answers["_sfx_bits"].to_pylist()))
        least = dict(zip(answers["_sfx_bucket"].to_pylist(), answers["_sfx_data"].to_pylist()))
        plain, crowded = _chosen(windows, bits, ids, buckets)
        single = Single(windows, crowded, ids, length, buckets)
        value = np.full(len(single.strings), NO_ID)
        for b in sorted(set(plain) | set(single.buckets)):
            chosen = plain.get(b, crowded[:0])
            names, _, number = _different(windows, chosen, ids)
            counts = np.fromiter((len(t) for t in names), np.int64, len(names)) - length + 1
            raw = np.frombuffer(zlib.decompress(least[b]), np.int64)
            part = single.part(b)
            both = len(names) + part.stop - part.start
            one, rest, value[part] = raw[:len(names)], raw[both:], raw[len(names):both]
            odd = one == MIXED
            ends = np.cumsum(np.where(odd, counts, 0))
            doc, place, me = windows.doc[chosen], windows.place[chosen], ids[windows.doc[chosen]]
            whole = one[number] < me
            whole &= ~odd[number]
            for d, p, n in zip(doc[whole].tolist(), place[whole].tolist(), counts[number[whole]].tolist()):
                marks[d].append((p, p + n + length - 1))
            for i in np.flatnonzero(odd[number]).tolist():
                n = number[i]
                hit = np.flatnonzero(rest[ends[n] - counts[n]:ends[n]] < me[i])
                cut = np.flatnonzero(np.diff(hit) > 1)
                for a, z in zip(hit[np.append(0, cut + 1)].tolist(), hit[np.append(cut, len(hit) - 1)].tolist()) if len(hit) else ():
                    marks[doc[i]].append((int(place[i]) + a, int(place[i]) + z + length))
        # A crowded window's strings are marked one by one.
        doc, place, me, of = windows.doc[crowded], windows.place[crowded], ids[windows.doc[crowded]], single.number
        value = value[single.which]
        low = np.minimum.reduceat(value, single.firsts) if len(value) else value
        for i in np.flatnonzero(low[of] < me).tolist():
            n = of[i]
            hit = np.flatnonzero(value[single.firsts[n]:single.firsts[n] + single.counts[n]] < me[i])
            cut = np.flatnonzero(np.diff(hit) > 1)
            for a, z in zip(hit[np.append(0, cut + 1)].tolist(), hit[np.append(cut, len(hit) - 1)].tolist()):
                marks[doc[i]].append((int(place[i]) + a, int(place[i]) + z + length))
        return texts, [_joined(m) for m in marks]
    return covered


def _joined(spans):
    out = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return out


def without(text: bytes, spans) -> bytes:
    kept, at = [], 0
    for a, z in spans:
        kept.append(text[at:a])
        at = z
    return b"".join(kept) + text[at:]


def repeated_spans(docs: DataFrame, length: int = 50, group_bytes: int = 4 << 20, batch: int = 1 << 18,
                   as_text: bool = False) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) with ``spans`` and ``kept``: what smaller documents also hold.

    A byte is covered where a string of ``length`` bytes around it also starts in a document of
    smaller doc_id; ``spans`` lists the maximal covered runs [from, to) in bytes, ``kept`` is the
    rest of the text as bytes, or as text without characters that a cut has split. A null text is empty; a null doc_id is larger than any other; rows
    that repeat a doc_id don't count against each other. All other columns pass through unchanged.
    """
    if length < GRAM + 1:
        raise ValueError(f"length must exceed {GRAM}")
    size = F.octet_length(text_bytes()) + 64
    groups = parts_for(docs, size, group_bytes)
    spread = docs.withColumns({"_sfx_id": F.col("doc_id").cast("long"),
                               "_sfx_group": F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int")})
    near = spread.groupBy("_sfx_group")
    anchors = near.applyInArrow(_anchors_of(length, groups), _ANCHORS)
    repeated = anchors.groupBy("_sfx_bucket").applyInArrow(_repeated_anchors, _ANCHORS)
    windows = near.cogroup(repeated.groupBy("_sfx_group")).applyInArrow(_windows_of(length, groups), _WINDOWS)
    answers = windows.groupBy("_sfx_bucket").applyInArrow(_least_ids(length, batch), _WINDOWS)
    covered, names = _spans_of(length, groups), docs.columns
    kind = T.StringType() if as_text else T.BinaryType()
    result = T.StructType(docs.schema.fields + [T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("kept", kind)])

    def finish(table, found):
        texts, spans = covered(table, found) if table.num_rows else ([], [])
        kept = [without(t, s) for t, s in zip(texts, spans)]
        kept = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
        return table.select(names).append_column("spans", pa.array(spans, pa.list_(pa.list_(pa.int64())))).append_column("kept", kept)
    return near.cogroup(answers.groupBy("_sfx_group")).applyInArrow(finish, result)


def digest(docs: DataFrame, length: int = 50) -> DataFrame:
    """What was removed from each document, in numbers: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    found = repeated_spans(docs.select("doc_id", "text"), length)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select("doc_id", F.octet_length(text_bytes()).cast("long").alias("n_bytes"), removed.alias("n_removed"),
                        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def trimmed(docs: DataFrame, length: int = 50) -> DataFrame:
    """``docs`` with the repeated passages cut out of ``text`` (and ``n_chars`` kept true, where there is one).

    A character that a cut has split goes as a whole. No row goes; a text may become empty.
    """
    held = [n if n in ("doc_id", "text") else f"_c{i}" for i, n in enumerate(docs.columns)]
    found = repeated_spans(docs.toDF(*held), length, as_text=True)
    cut, cols = F.size("spans") > 0, []
    for name, now in zip(docs.columns, held):
        col = F.col(now)
        if name == "text":
            col = F.when(cut, F.col("kept")).otherwise(col)
        elif name == "n_chars":
            col = F.when(cut, F.length("kept").cast(docs.schema[name].dataType)).otherwise(col)
        cols.append(col.alias(name))
    return found.select(*cols)
