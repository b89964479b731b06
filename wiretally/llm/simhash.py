"""SimHash near-duplicates: majority fingerprints, linked through one-wildcard segment variants."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wiretally.llm.common import staged, text_bytes
from wiretally.llm.graph import components

BITS = 64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, words: int = 3, repeats: bool = True) -> int:
    """Signed 64-bit SimHash of one text: a bit is set if set in over half of the shingle hashes.

    Without ``repeats`` every different shingle counts once.
    """
    tokens = text.translate(_LOWER).split()
    if not tokens:
        return 0
    if len(tokens) < words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(tokens), 42)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(b" ".join(s), 42) for s in zip(*(tokens[i:] for i in range(words)))]
        hashes = hashes if repeats else list(set(hashes))
    votes = np.zeros(BITS, np.int64)
    values = np.array(hashes, dtype=">u8")
    for at in range(0, len(values), 1 << 16):
        block = np.unpackbits(values[at:at + (1 << 16)].view(np.uint8)).reshape(-1, BITS)
        votes += block.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(values)).view(">i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, repeats: bool = True) -> DataFrame:
    """(doc_id, fp) of every row; a null text counts as empty and has fingerprint zero."""
    def run(batches):
        for b in batches:
            b["fp"] = np.fromiter((fingerprint(t, words, repeats) for t in b["raw"]), np.int64, len(b))
            yield b[["doc_id", "fp"]]
    # A missing id leaves pandas with floats, so ids travel as text.
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_bytes().alias("raw"))
    return rows.mapInPandas(run, "doc_id string, fp long").select(F.col("doc_id").cast("long").alias("doc_id"), "fp")


def _segments(distance: int):
    """(shift, width) of segments of which one differs by at most one bit within ``distance``."""
    count = max(2, distance // 2 + 1)
    width, wider = divmod(BITS, count)
    out, at = [], 0
    for i in range(count):
        w = width + (i < wider)
        out.append((at, w))
        at += w
    return out


def _cut(col, shift, width):
    return F.shiftrightunsigned(col, shift).bitwiseAND(F.lit((1 << width) - 1))


def _pieces(shift, width, count):
    """Columns of ``count`` or fewer parts of the bits outside a segment, as functions of a value."""
    bits = [b for b in range(BITS) if not shift <= b < shift + width]
    each, out = -(-len(bits) // count), []
    for at in range(0, len(bits), each):
        run = bits[at:at + each]
        gap = next((i for i in range(1, len(run)) if run[i] != run[i - 1] + 1), len(run))

        def piece(col, run=run, gap=gap):
            first = _cut(col, run[0], gap)
            return first if gap == len(run) else first.bitwiseOR(F.shiftleft(_cut(col, run[gap], len(run) - gap), gap))
        out.append(piece)
    return out


def links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs (u, v) of distinct fingerprints of column ``fp`` that differ in 1..``distance`` bits, once each.

    A pair meets where a segment differs in exactly one bit (rows with the bit clear join rows with
    it set, under the segment with that bit wild), or where a segment is equal. Equal segments are
    refined by a part of the other bits, cut so that one part must be equal too, which keeps crowds
    of close fingerprints apart without comparing all pairs of a segment. A pair that meets in
    several places counts only in the first, and no pair is lost.
    """
    if not 0 <= distance < 32:
        raise ValueError("distance must lie in 0..31")
    fp, differ = F.col("fp"), F.col("u").bitwiseXOR(F.col("v"))
    low, high, kind, place, wild = [], [], 0, [], []
    for shift, width in _segments(distance):
        part, seg, base = _cut(fp, shift, width), _cut(differ, shift, width), kind
        for bit in range(width):
            key = F.struct(F.lit(kind).alias("k"), part.bitwiseAND(F.lit(~(1 << bit))).alias("a"), F.lit(0).cast("long").alias("b"))
            is_set = part.bitwiseAND(F.lit(1 << bit)) != 0
            low.append(F.when(~is_set, key))
            high.append(F.when(is_set, key))
            wild.append(kind)
            kind += 1
        place.append((F.bit_count(seg) == 1, F.bit_count(seg - 1) + base))
        for piece in _pieces(shift, width, distance + 1):
            key = F.struct(F.lit(kind).alias("k"), part.alias("a"), piece(fp).cast("long").alias("b"))
            low.append(key)
            high.append(key)
            place.append(((seg == 0) & (piece(differ) == 0), F.lit(kind)))
            kind += 1
    first = F.coalesce(*[F.when(c, k) for c, k in place])
    side = lambda keys, name: (fps.select("fp", F.explode(F.filter(F.array(*keys), lambda k: k.isNotNull())).alias("key"))
                               .select(F.col("fp").alias(name), *[F.col(f"key.{c}").alias(f"{name}{c}") for c in "kab"]))
    low, high = side(low, "u"), side(high, "v")
    meets = [low[f"u{c}"] == high[f"v{c}"] for c in "kab"]
    near = (F.col("u") != F.col("v")) & (F.bit_count(differ) <= distance) & (F.col("uk") == first)
    # Two rows of an equal segment meet both ways round, so the lesser one leads.
    led = F.col("uk").isin(wild) | (F.col("u") < F.col("v"))
    # Spark takes an exploded side for about as large as the table before it, and would broadcast what the driver cannot hold.
    met = low.join(high.hint("merge"), [*meets, near, led])
    return met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3, repeats: bool = True) -> DataFrame:
    """Fingerprint and group of every document: (doc_id, fp, component_id).

    ``component_id`` is the least doc_id reachable over links of at most ``distance`` bits. Equal
    fingerprints are one node, so copies never form pairs. Null, empty and blank texts have
    fingerprint zero and link like any other; texts of fewer than ``words`` words are one shingle.
    Rows that repeat a doc_id come out once each; a null doc_id is carried but never names a group
    (a group of null ids only has a null component_id). Extra columns are ignored. An empty table
    gives an empty result.
    """
    fps = staged(fingerprints(docs, words, repeats))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(fps.select("fp").distinct(), distance))
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.select("fp", "root").join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def shingle_set(text: bytes, words: int = 5) -> np.ndarray:
    """Sorted different 64-bit hashes of the ``words``-word shingles of one text; a shorter text is one shingle."""
    tokens = text.translate(_LOWER).split()
    if not tokens:
        return np.zeros(0, np.int64)
    count = max(1, len(tokens) - words + 1)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(tokens[i:i + words]), 42) for i in range(count)), np.uint64, count)).view(np.int64)


def _class(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), 42)).view(np.int64))


#: Texts that a task holds as Python objects, with their shingle sets, at once.
SLICE = 64


def _sliced(batches):
    """Rows of Arrow batches as frames of ``SLICE`` rows."""
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE).to_pandas()


#: Shingles that the common order of all sets puts last, as they are frequent; the rest stands by hash.
FREQUENT = 200_000


#: Shingles of different texts that are counted at once, and how many texts of these must share one.
COUNTED, SHARED = 1 << 21, 3


def _frequent(rows: DataFrame, words: int, keep: int = FREQUENT) -> np.ndarray:
    """Shingles that several texts of one lot share, the most frequent of all lots, sorted by hash.

    They only set an order (see ``_places``), in which any choice is right; so counts need not be
    exact, and of crowds beyond ``keep`` shingles the lesser may be left out. A lot holds texts of a
    task with ``COUNTED`` shingles or a little more, copies once; only what ``SHARED`` texts of a lot
    share leaves its task. A passage in few texts of many comes up often enough in one of the lots.
    """
    def tally(held):
        """Shingles of at least ``SHARED`` sets with their counts; empties ``held``, so that all are in memory once only."""
        every = np.concatenate(list(held.values()))
        held.clear()
        every.sort()
        found = np.unique(every[SHARED - 1:][every[SHARED - 1:] == every[:max(0, len(every) - SHARED + 1)]])
        often = np.searchsorted(every, found, "right") - np.searchsorted(every, found, "left")
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(often, pa.int64())], ["shingle", "n"])

    def run(batches):
        held, size = {}, 0
        for b in _sliced(batches):
            for text in b["raw"]:
                one = shingle_set(text, words)
                held[_class(one)] = one
                size += len(one)
                if size >= COUNTED:
                    yield tally(held)
                    size = 0
        if held:
            yield tally(held)

    counted = rows.mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "shingle").limit(keep).collect()  # at most ``keep`` rows
    return np.sort(np.array([r["shingle"] for r in top], np.int64))


def _places(shingles: np.ndarray, frequent: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set in one order for all sets, so many that two sets of ``similarity`` or more share one.

    Of n shingles these are the first n - ceil(similarity n) + 1, in any fixed order. Frequent shingles
    come last, so crowds around a shared passage rarely meet through it.
    """
    if not len(shingles):
        return shingles
    at = np.minimum(np.searchsorted(frequent, shingles), max(len(frequent) - 1, 0))
    known = frequent[at] == shingles if len(frequent) else np.zeros(len(shingles), bool)
    count = len(shingles) - int(np.ceil(similarity * len(shingles) - 1e-9)) + 1
    return np.concatenate([shingles[~known], shingles[known]])[:count]


def _needed(similarity: float):
    return F.ceil(similarity / (1 + similarity) * (F.col("un") + F.col("vn")) - 1e-9)


def _may_reach(similarity: float):
    """Whether sets of ``un`` and ``vn`` shingles with ``common`` places in common can be similar enough.

    Of the set whose last place comes first in the order, every shingle that the other has among its
    own places counts in ``common``; the most that can follow is all behind its places. So the common
    shingles are at most ``common`` and what lies behind the places of one of the sets.
    """
    behind = lambda n: F.ceil(similarity * F.col(n) - 1e-9) - 1
    return F.col("common") + F.greatest(behind("un"), behind("vn")) >= _needed(similarity)


PARITIES = 512


def _parity(shingles: np.ndarray) -> np.ndarray:
    """For each of ``PARITIES`` bits whether an odd number of the shingles falls on it, as longs."""
    odd = np.bincount(shingles & (PARITIES - 1), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _parities_allow(similarity: float):
    """Whether sets with the parities ``ub`` and ``vb`` can be similar enough; never false for sets that are.

    Shingles that both sets hold leave the parities alike, so at least one shingle of a single set
    stands behind each bit that differs.
    """
    apart = F.aggregate(F.zip_with("ub", "vb", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, x: n + x)
    return F.col("un") + F.col("vn") - apart >= 2 * _needed(similarity)


#: Bits of a filter for ids, 1 MB, however many ids there are.
HASHED = 1 << 23


def _perhaps(ids: DataFrame):
    """Whether an id may be among ``ids.doc_id``, as a function of a column; never false for one that is.

    Rows that can't match are so left out before a join, and their texts are not shuffled. A filter of fixed
    size lets more rows pass as ids grow, so the exact join follows.
    """
    place = lambda col: F.xxhash64(col.cast("long")).bitwiseAND(F.lit(HASHED - 1))
    words = (ids.select(place(F.col("doc_id")).alias("at")).groupBy(F.shiftright("at", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")))
    every = ids.sparkSession.range(HASHED // 64).withColumnRenamed("id", "word").join(words, "word", "left")
    listed = F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))  # HASHED / 64 entries
    # A subquery of one row, written once: the test needs no Python worker beside those that read the texts.
    held = staged(every.agg(listed.alias("held")).select(F.col("held.bits").alias("held"))).scalar()
    return lambda col: F.bit_get(F.get(held, F.shiftright(place(col), 6).cast("int")), place(col).bitwiseAND(F.lit(63)).cast("int")) == 1


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, distance: int = 5, complete: bool = False) -> DataFrame:
    """Group of every document with a doc_id: (doc_id, component_id), for verified near-duplicates.

    Candidates are texts whose fingerprints over their different words lie within ``distance`` bits:
    a few edits move these less than fingerprints over longer shingles. A candidate pair becomes a
    link only if the sets of its ``words``-word shingles have a Jaccard similarity of ``similarity``
    or more, counted exactly; so documents that merely use the same words stay apart.
    ``component_id`` is the least doc_id reachable. Texts with equal shingle sets are one node, and
    the pairs of different ones are compared only if their set sizes allow the similarity. Empty and
    blank texts are equal; rows without a doc_id take no part.

    With ``complete`` no similar pair is lost: texts that share one of their rarest shingles
    (``_places``) and whose groups still differ are compared too, whatever their fingerprints. Each
    text then meets only one text of its own fingerprint and one of a near fingerprint before that,
    so a crowd of near copies makes two pairs a text.
    """
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("raw"))
    frequent = _frequent(rows.select("raw"), words) if complete else None

    mark_schema = pa.schema([*[(c, pa.int64()) for c in ("doc_id", "fp", "cls", "n")], *[(c, pa.list_(pa.int64())) for c in ("places", "bits")]])
    set_schema = pa.schema([("cls", pa.int64()), ("set", pa.list_(pa.int64()))])

    def sketch(batches):
        for b in _sliced(batches):
            sets = [shingle_set(t, words) for t in b["raw"]]
            b["places"] = [_places(x, frequent, similarity) if complete else x[:0] for x in sets]
            b["fp"] = np.fromiter((fingerprint(t, 1, False) for t in b["raw"]), np.int64, len(b))
            b["cls"] = np.fromiter(map(_class, sets), np.int64, len(b))
            b["n"] = np.fromiter(map(len, sets), np.int64, len(b))
            b["bits"] = [_parity(x) if complete else x[:0] for x in sets]
            yield pa.RecordBatch.from_pandas(b[mark_schema.names], mark_schema, preserve_index=False)

    def gather(batches):
        for b in _sliced(batches):
            b["set"] = [shingle_set(t, words) for t in b["raw"]]
            b["cls"] = np.fromiter(map(_class, b["set"]), np.int64, len(b))
            yield pa.RecordBatch.from_pandas(b[set_schema.names], set_schema, preserve_index=False)

    marks = staged(rows.mapInArrow(sketch, "doc_id long, fp long, cls long, n long, places array<long>, bits array<long>"))
    classes = marks.groupBy("cls").agg(F.first("fp").alias("fp"), F.first("n").alias("n"), F.min("doc_id").alias("first"))
    fits = F.least("un", "vn") >= similarity * F.greatest("un", "vn")
    near = links(marks.select("fp").distinct(), distance)
    if complete:
        # One partner a text: what these stars miss, the pass over places finds, and no crowd is compared all with all.
        toward = near.groupBy("v").agg(F.min("u").alias("fp")).select(F.col("v").alias("at"), "fp")
        hubs = classes.groupBy("fp").agg(F.min(F.struct("first", "cls", "n")).alias("hub"))
        hubs = hubs.select(F.col("fp").alias("at"), "hub").unionByName(toward.join(hubs, "fp").select("at", "hub"))
        pairs = classes.join(hubs, F.col("fp") == F.col("at")).select(
            F.col("hub.cls").alias("uc"), F.col("cls").alias("vc"), F.col("hub.first").alias("uf"), F.col("first").alias("vf"), F.col("hub.n").alias("un"), F.col("n").alias("vn"))
        pairs = pairs.where((F.col("uc") != F.col("vc")) & fits)
    else:
        several = classes.groupBy("fp").count().where("count > 1").select(F.col("fp").alias("u"), F.col("fp").alias("v"))
        named_side = lambda a: classes.select(F.col("fp").alias(a), F.col("cls").alias(f"{a}c"), F.col("n").alias(f"{a}n"), F.col("first").alias(f"{a}f"))
        pairs = near.unionByName(several).join(named_side("u"), "u").join(named_side("v"), "v")
        pairs = pairs.where(((F.col("u") != F.col("v")) | (F.col("uc") < F.col("vc"))) & fits)
    pairs = staged(pairs.select("uc", "vc", "uf", "vf"))

    def verified(pairs):
        """Of pairs (uc, vc, uf, vf) of classes with a document each, the links (u, v) that are similar enough."""
        wanted = pairs.select(F.explode(F.array("uf", "vf")).alias("doc_id")).distinct()
        sets = staged(rows.where(_perhaps(wanted)(F.col("doc_id"))).join(wanted, "doc_id", "left_semi").select("raw").mapInArrow(gather, "cls long, set array<long>"))
        both = (pairs.select("uc", "vc").join(sets.select(F.col("cls").alias("uc"), F.col("set").alias("us")), "uc")
                .join(sets.select(F.col("cls").alias("vc"), F.col("set").alias("vs")), "vc"))
        common = F.size(F.array_intersect("us", "vs"))
        alike = common >= similarity * (F.size("us") + F.size("vs") - common)
        return both.where(alike).select(F.col("uc").alias("u"), F.col("vc").alias("v"))

    roots = components(verified(pairs))
    if complete:
        nodes = classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "n", F.coalesce("root", "cls").alias("root"))
        marked = marks.groupBy("cls").agg(F.first("places").alias("places"))  # equal sets have equal marks
        shared = marked.join(nodes, "cls").select("cls", "n", "root", F.explode("places").alias("shingle"))
        # Where all that share a shingle are of one group already, as in a crowd of near copies, nothing is left to compare.
        # A window, so that places are dealt by shingle once, for this and for both sides of the join.
        alike = Window.partitionBy("shingle")
        open_ = shared.withColumn("a", F.min("root").over(alike)).withColumn("z", F.max("root").over(alike)).where("a <> z")
        side = lambda a: open_.select("shingle", F.col("cls").alias(f"{a}c"), F.col("n").alias(f"{a}n"), F.col("root").alias(f"{a}r"))
        met = side("u").join(side("v"), "shingle").where((F.col("uc") < F.col("vc")) & (F.col("ur") != F.col("vr")) & fits)
        missed = met.groupBy("uc", "vc", "un", "vn").agg(F.count(F.lit(1)).alias("common")).where(_may_reach(similarity))
        held = marks.groupBy("cls").agg(F.min("doc_id").alias("first"), F.first("bits").alias("bits"))
        known = lambda a: held.select(F.col("cls").alias(f"{a}c"), F.col("first").alias(f"{a}f"), F.col("bits").alias(f"{a}b"))
        missed = missed.join(known("u"), "uc").join(known("v"), "vc").where(_parities_allow(similarity))
        found = verified(staged(missed.select("uc", "vc", "uf", "vf")))
        roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(found))
    placed = classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.select("cls", "root").join(least, "root").select("cls", "component_id")
    return marks.join(named, "cls").select("doc_id", "component_id")


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, distance: int = 5) -> DataFrame:
    """``docs`` with one document of each group of ``similar_groups``, the one of least doc_id; columns are unchanged.

    Rows that repeat the kept doc_id are copies of it and leave one row. Rows without a doc_id
    stay, as they can't be told apart.
    """
    groups = staged(similar_groups(docs, words, similarity, distance, complete=True))
    found = groups.where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    # Most ids have one row, which stays; only rows of the others are joined and told apart, so most texts are not shuffled.
    doubtful = groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("doc_id") == F.col("component_id")).alias("kept"))
    perhaps = _perhaps(doubtful.where("n > 1 or not kept"))(F.col("doc_id"))
    named = docs.where(F.col("doc_id").isNotNull())
    kept = named.where(perhaps).join(found, F.col("doc_id") == F.col("_kept"), "left_semi").dropDuplicates(["doc_id"])
    return named.where(~perhaps).unionByName(kept).unionByName(docs.where(F.col("doc_id").isNull()))
