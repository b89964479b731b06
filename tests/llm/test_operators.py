"""Operators against brute force, on stored tables and on rows made to be awkward."""

import hashlib
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash
from pyspark.sql import functions as F

from wiretally.llm import ann, html, licenses, merkle, mixing, packing, simhash, suffixes, tokens, toxicity
from wiretally.llm.graph import components
from wiretally.llm.queries import ORACLES, QUERIES
from wiretally.verify import compare, connect

SF = "/root/testdata/sf0.001"
#: Columns whose names the operators use inside.
EXTRA = "rank int, spans int, kept int, size int, part int, fp long, key int, at int, h int, words int, copies int, score int, shard int, _at int, v int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    passage = "a passage that several of these documents share word for word, well over fifty bytes long"
    texts = [None, "", " \n\t ", "one", "one two", passage, passage, f"Before it. {passage}", f"{passage} after it é", "é" * 60 + passage[:40],
             "word " * 30000, "aaaa" * 50, "aaaa" * 51, "Released under the MIT License.", f"x\n\n{passage}\ny"]
    rows = [(i, t, "en", [None, "", "s1", "s2"][i % 4], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[6], (None, passage, "en", None, 9), (None, None, None, None, None), (3, "one", "en", "s2", 3)]
    return spark.createDataFrame([r + (1,) * 15 for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- 10

def groups(rows, words, distance):
    prints = [simhash.fingerprint((t or "").encode(), words) for _, t in rows]
    bits = np.array(prints, np.int64).view(np.uint64)
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= distance
    root = list(range(len(rows)))
    while True:
        new = [min(root[j] for j in np.flatnonzero(near[i])) for i in range(len(rows))]
        if new == root:
            break
        root = new
    ids = {}
    for (i, _), r in zip(rows, root):
        ids.setdefault(r, []).append(i)
    return [(i, p, min((x for x in ids[r] if x is not None), default=None)) for (i, _), p, r in zip(rows, prints, root)]


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_near_duplicates(request, which):
    df = request.getfixturevalue(which)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert rows_of(simhash.near_duplicates(df)) == sorted(groups(rows, 3, 3), key=repr)


def test_fingerprint_bit_by_bit():
    text = "The cat SAT on\tthe cat sat on\x0bthe mat"
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text.encode()) % (1 << 64) == want


def test_shingle_hash_is_that_of_spark(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("one two three"))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest("one two three", 42)


@pytest.mark.parametrize("distance", [0, 1, 3, 5, 8])
def test_links_are_those_of_all_pairs(spark, distance):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 63, 12)]
    values = sorted({b ^ sum(1 << int(i) for i in set(rng.integers(0, 63, rng.integers(0, 9)).tolist())) for b in base for _ in range(40)})
    want = sorted((a, b) for i, a in enumerate(values) for b in values[i + 1:] if (a ^ b).bit_count() <= distance)
    got = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), distance)
    assert sorted(map(tuple, got.collect())) == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1300)] + [(5000, 5000)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1300)}}


def test_one_of_each_group_stays(odd, empty):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and simhash.keep_one(empty).count() == 0
    ids = [r["doc_id"] for r in kept.collect()]
    assert 5 in ids and 6 not in ids and ids.count(3) == 1 and ids.count(None) == 2


def edited_copies():
    """Texts with few and many edits, with the same words in other order, and a crowd of copies of one text."""
    rng = np.random.default_rng(9)
    word = lambda n: [f"w{int(i)}" for i in rng.integers(0, 4000, n)]
    out = []
    for _ in range(12):
        base = word(220)
        out += [base, base, [w.upper() for w in base], base[::-1], base[110:] + base[:110], base + word(6), base[:200]]
        for edits in (1, 2, 4, 8, 20):
            copy = list(base)
            for at in rng.integers(0, len(base), edits):
                copy[at] = word(1)[0]
            out.append(copy)
    crowd = word(400)
    for _ in range(60):
        copy = list(crowd)
        copy[int(rng.integers(0, 400))] = word(1)[0]
        out.append(copy)
    texts = [" ".join(t) for t in out] + [None, "", " \n", "one two", "two one", "one two", "a b c d e", "a b c d e f"]
    return [(3 * i + 1, t) for i, t in enumerate(texts)]


def test_similar_groups_are_those_of_all_pairs(spark):
    rows = edited_copies()
    shingles = lambda w: {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    sets = [shingles((t or "").lower().split()) for _, t in rows]
    bits = np.array([simhash.fingerprint((t or "").encode(), 1, False) for _, t in rows], np.int64).view(np.uint64)
    root = list(range(len(rows)))
    alike = [[j for j in range(len(rows)) if np.bitwise_count(bits[i] ^ bits[j]) <= 5
              and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(len(rows))]
    while (new := [min(root[j] for j in near) for near in alike]) != root:
        root = new
    got = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    want = sorted((i, rows[r][0]) for (i, _), r in zip(rows, root))
    assert sorted(map(tuple, got.collect())) == want
    assert 1 < len(set(root)) < len(rows) - 100


def test_kept_documents_are_those_of_all_similar_pairs(spark):
    rows = edited_copies()
    shingles = lambda w: {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    sets = [shingles((t or "").lower().split()) for _, t in rows]
    alike = [[j for j in range(len(rows)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(len(rows))]
    root = list(range(len(rows)))
    while (new := [min(root[j] for j in near) for near in alike]) != root:
        root = new
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({rows[r][0] for r in root})


# --- 2

def brute_removal(rows, length=50):
    first, out = {}, []
    key = lambda i: 1 << 70 if i is None else i
    for i, t in rows:
        for p in range(len(t) - length + 1):
            first[t[p:p + length]] = min(first.get(t[p:p + length], 1 << 71), key(i))
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if first[t[p:p + length]] < key(i):
                gone[p:p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        runs = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_removed_bytes(request, which):
    df = request.getfixturevalue(which)
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in df.collect()]
    assert rows_of(suffixes.digest(df)) == brute_removal(rows)


def test_removal_does_not_depend_on_how_work_is_cut(docs, monkeypatch):
    want = rows_of(suffixes.digest(docs))
    cut = suffixes.repeated_spans(docs.select("doc_id", "text"), group_bytes=1 << 14, batch=500)
    got = cut.select("doc_id", F.octet_length("text").cast("long"), F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0]),
                     F.size("spans").cast("long"), F.sha2("kept", 256))
    assert rows_of(got) == want


def test_a_frequent_line_in_other_surroundings_stays_spread():
    rng, line, n, buckets = np.random.default_rng(5), "a short line that very many of the documents hold, 53 b", 24000, 16
    word = lambda: bytes(rng.integers(97, 123, 30, dtype=np.uint8)).decode()
    texts = [f"{word()} {line} {word()}" for _ in range(n)]
    groups = [pa.table({"_sfx_id": list(range(g, n, 8)), "text": texts[g::8], "_sfx_group": [g] * len(texts[g::8])}) for g in range(8)]
    parts = lambda tables, by: [t.filter(pc.equal(t[by], b)) for t in [pa.concat_tables(tables)] for b in sorted(set(t[by].to_pylist()))]
    answers = [suffixes._repeated_anchors(t) for t in parts([suffixes._anchors_of(50, buckets)(g) for g in groups], "_sfx_bucket")]
    sent = parts([suffixes._windows_of(50, buckets)(g, a) for g, a in zip(groups, parts(answers, "_sfx_group"))], "_sfx_bucket")
    sizes = [sum(len(suffixes._opened(d)[2]) for d in t["_sfx_data"].to_pylist()) for t in sent]
    assert len(sizes) == buckets and max(sizes) < 2 * sum(sizes) / len(sizes)
    found = parts([suffixes._least_ids(50, 1 << 18)(t) for t in sent], "_sfx_group")
    got = []
    for g, (group, answer) in enumerate(zip(groups, found)):
        for i, t, spans in zip(range(g, n, 8), texts[g::8], suffixes._spans_of(50, buckets)(group, answer)[1]):
            kept = suffixes.without(t.encode(), spans)
            got.append((i, len(t), sum(z - a for a, z in spans), len(spans), hashlib.sha256(kept).hexdigest()))
    assert sorted(got, key=repr) == brute_removal([(i, t.encode()) for i, t in enumerate(texts)])


def test_removed_bytes_where_every_anchor_is_crowded(docs, odd, monkeypatch):
    for df in (docs.limit(60), odd):
        rows = [(r["doc_id"], (r["text"] or "").encode()) for r in df.collect()]
        monkeypatch.setattr(suffixes, "CROWD", -1)
        groups = [pa.table({"_sfx_id": pa.array([i for i, _ in rows[g::3]], pa.int64()), "text": [t.decode() for _, t in rows[g::3]],
                            "_sfx_group": [g] * len(rows[g::3])}) for g in range(3)]
        parts = lambda tables, by: [t.filter(pc.equal(t[by], b)) for t in [pa.concat_tables(tables)] for b in sorted(set(t[by].to_pylist()))]
        answers = [suffixes._repeated_anchors(t) for t in parts([suffixes._anchors_of(50, 5)(g) for g in groups], "_sfx_bucket")]
        sent = [suffixes._windows_of(50, 5)(g, a) for g, a in zip(groups, parts(answers, "_sfx_group"))]
        found = parts([suffixes._least_ids(50, 1000)(t) for t in parts(sent, "_sfx_bucket")], "_sfx_group")
        got = []
        for g, (group, answer) in enumerate(zip(groups, found)):
            for (i, t), spans in zip(rows[g::3], suffixes._spans_of(50, 5)(group, answer)[1]):
                got.append((i, len(t), sum(z - a for a, z in spans), len(spans), hashlib.sha256(suffixes.without(t, spans)).hexdigest()))
        assert sorted(got, key=repr) == brute_removal(rows)


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 300)
    text = bytes(np.random.default_rng(1).integers(97, 101, 5000, dtype=np.uint8))
    windows = suffixes.Windows([text], 50)
    starts = sorted(p + k for p, s, e in zip(windows.place, windows.start, windows.end) for k in range(e - s - 49))
    assert starts == list(range(len(text) - 49))


def test_family_levels_grow_geometrically():
    family = suffixes.Family(4)
    for i in range(32):
        family.add(np.array([f"{i:02}{j:02}".encode() for j in range(10)]), np.full(10, i))
        sizes = [len(s) for s, _ in family.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:])) and all(list(s) == sorted(s) for s, _ in family.levels)
    assert family.least(np.array([b"0707", b"9999"])).tolist() == [7, suffixes.NO_ID]


def test_trimmed_keeps_rows_and_columns(odd, empty):
    out = suffixes.trimmed(odd)
    assert out.columns == odd.columns and out.count() == odd.count() and suffixes.trimmed(empty).count() == 0
    assert out.where("doc_id = 7").first()["text"] == "Before it. " and out.where("doc_id = 0").first()["text"] is None
    assert suffixes.digest(empty).count() == 0


# --- 4, 5

def test_mix_of_awkward_rows(odd, empty):
    out = mixing.mixed(odd).collect()
    assert len(out) == odd.count() and mixing.mixed(empty).count() == 0
    assert all(r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"] + 1e-9 for r in out)
    taken = mixing.repeated(odd)
    assert taken.columns == odd.columns and taken.count() == sum(r["copies"] for r in out) and mixing.repeated(empty).count() == 0
    assert rows_of(mixing.mixed(odd)) == sorted((tuple(r) for r in out), key=repr)


def test_targets_by_refilling(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 50), ("d", 700), (None, 40), ("", 5)]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    order = sorted((s for s, _ in sizes), key=lambda s: (s is None, s or ""))
    weight, limit = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, {s: 2 * n for s, n in sizes}
    left, open_, want = 1.5 * sum(n for _, n in sizes), set(limit), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > limit[s]}
        want.update(share if not over else {s: limit[s] for s in over})
        left -= sum(limit[s] for s in over)
        open_ = over and open_ - over
    assert got == pytest.approx(want)


def test_taken_words_come_near_the_target(spark):
    out = mixing.mixed(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    near = out.groupBy("source").agg(F.abs(F.sum("taken") - F.first("target")).alias("off"), F.first("target").alias("target"), F.max("size").alias("most")).collect()
    assert all(r["off"] <= r["most"] for r in near)


def test_best_buckets_waste_least():
    rng = np.random.default_rng(2)
    from itertools import combinations
    for _ in range(20):
        lengths = sorted(set(rng.integers(1, 60, 9).tolist()))
        counts = rng.integers(1, 9, len(lengths)).tolist()
        for k in (1, 2, 3, 4):
            cost = lambda bounds: sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts))
            ways = [c + (lengths[-1],) for r in range(k) for c in combinations(lengths[:-1], r)]
            assert cost(packing.best_buckets(lengths, counts, k)) == min(map(cost, ways))
    assert packing.best_buckets([], [], 4) == []


def test_batches_hold_their_budget(odd, empty):
    out = packing.packed(odd, budget=64, buckets=3).collect()
    assert len(out) == odd.count() and packing.packed(empty).count() == 0
    batches = {}
    for r in out:
        assert r["n_tokens"] + r["padding"] == r["bucket"] and r["padding"] >= 0
        batches.setdefault((r["bucket"], r["batch"]), []).append(r["slot"])
    for (bucket, batch), slots in batches.items():
        room = max(1, 64 // max(bucket, 1))
        last = max(b for k, b in batches if k == bucket)
        assert sorted(slots) == list(range(len(slots))) and (len(slots) == room or batch == last and len(slots) < room)


# --- 7, 9

PATH = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_token_counts(odd, empty):
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(PATH)
    out = tokens.digest(odd, PATH)
    want = [(r["doc_id"], len((r["text"] or "").encode()), len(whole.encode(r["text"] or "", add_special_tokens=False))) for r in odd.collect()]
    assert rows_of(out) == sorted(((i, b, n, n > 512) for i, b, n in want), key=repr) and tokens.digest(empty, PATH).count() == 0


@pytest.mark.parametrize("chunk, overlap", [(600, 16), (2000, 64), (5000, 300)])
def test_spliced_chunks_count_as_the_whole(docs, chunk, overlap):
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(PATH)
    texts = ["a" * 5000 + " b" * 3000, " " * 4000 + "x" * 3000 + "\n" * 2000, "<|endoftext|>" * 800, "it's " * 1500 + "<|endoftext|>  \n\n" * 300, "\0     " * 900]
    texts += [r["text"] for r in docs.orderBy(F.desc("n_chars")).limit(10).collect()]
    counter = tokens.Counter(PATH, chunk=chunk, overlap=overlap)
    want = [len(whole.encode(t, add_special_tokens=False)) for t in texts]
    assert counter.counts(texts) == want and [counter.pieced(t) for t in texts] == want


@pytest.mark.parametrize("part_bytes", [1 << 15, 1 << 25])
def test_fingerprints_of_neighbours(docs, part_bytes):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), reverse=True)
    want = []
    for k, (i, t) in enumerate(rows):
        other = rows[(k + 1) % len(rows)][1]
        new, a = merkle.edited(t, other), merkle.fingerprint(t)
        b = merkle.fingerprint(new)
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), a, b, merkle.likeness(a, b), merkle.likeness(a, merkle.fingerprint(other))))
    assert rows_of(merkle.compared(docs, part_bytes)) == sorted(want, key=repr)


def test_fingerprints_of_awkward_rows(odd, empty):
    out = merkle.compared(odd, 1 << 16).collect()
    assert len(out) == odd.count() and merkle.compared(empty).count() == 0
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    text = "".join(f"Paragraph {i} says something of its own.\n" for i in range(60))
    a, b = merkle.fingerprint(text), merkle.fingerprint(text.replace("Paragraph 30 says", "Paragraph 30 said"))
    assert merkle.likeness(a, a) == 1 and 0.9 < merkle.likeness(a, b) < 1 and 1 <= len(merkle.differing_sections(a, b)) <= 2
    assert merkle.likeness(a, merkle.fingerprint("")) == 0


# --- 1, 3, 6, 8

def test_licenses_of_awkward_rows(odd, empty):
    assert [r["doc_id"] for r in licenses.scanned(odd).collect()] == [13] and licenses.scanned(empty).count() == 0
    long = "filler words here " * 50 + licenses.TEMPLATES["bsd"].upper() + " more filler" * 9
    out = licenses.scanned(odd.sparkSession.createDataFrame([(1, long), (2, long[:960] + "x " + long[1000:])], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["license"], r["containment"]) for r in out] == [(1, "bsd", 1.0)]


def test_stored_license_lines_in_long_texts(spark):
    lines = {"All rights reserved.": "reserved-line", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Released under the MIT License.": "mit",
             "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0", "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0"}
    for lead in (0, 1, 4, 101):
        texts = [(i, "filler " * lead + f"\n{line}\n" + "more words of filler " * 30) for i, line in enumerate(lines)]
        out = licenses.scanned(spark.createDataFrame(texts, "doc_id long, text string")).collect()
        assert {(r["doc_id"], r["license"]) for r in out} == set(enumerate(lines.values()))
        assert [(r["containment"], r["first_word"], r["n_hits"]) for r in out if r["doc_id"] == 0] == [(1.0, lead, 1)]


def test_short_templates_of_every_length(spark):
    wordings = {"one": "Unlicense", "two": "MIT License", "twin": "mit-license", "three": "no rights reserved", "four": "Free for any use", "none": " . "}
    texts = ["the MIT license and the mit License again", "mit license", "Unlicense", "it is free for any use, no rights reserved",
             "rights reserved no", "mit the license", None, ""]
    out = licenses.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), wordings).collect()
    assert sorted(map(tuple, out)) == [(0, "twin", 1.0, 1, 2), (0, "two", 1.0, 1, 2), (1, "twin", 1.0, 0, 1), (1, "two", 1.0, 0, 1),
                                       (2, "one", 1.0, 0, 1), (3, "four", 1.0, 2, 1), (3, "three", 1.0, 6, 1)]


def test_short_wordings_are_found_in_every_text(spark):
    found = QUERIES["op1_license_scan"](spark, "/root/testdata/sf0.01").where(F.col("license").isin(list(licenses.LINES)))
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    assert sorted(r["doc_id"] for r in found.collect()) == sorted(r["doc_id"] for r in texts if "all rights reserved" in (r["text"] or "").lower())


def test_main_text_of_stored_pages(spark):
    import html as entities
    import re
    out = {r["page_id"]: r for r in html.main_text(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(entities.unescape(re.sub(r"<[^>]+>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", body)]
        assert out[r["page_id"]]["text"] == "\n".join(p for p in parts if p)


def test_field_on_held_out_layouts():
    from wiretally.llm.labelled import pages
    made = [(html.featured(html.blocks(p)), y) for p, y in pages()]
    field = html.Field.trained(made[:120])
    pairs = [(a, b) for x, y in made[120:] for a, b in zip(field.best(x), y)]
    assert sum(a == b for a, b in pairs) / len(pairs) > 0.95


def test_viterbi_is_the_best_of_all_ways():
    from itertools import product
    rng = np.random.default_rng(4)
    field = html.Field(rng.normal(size=(len(html.FEATURES), 2)), rng.normal(size=(2, 2)))
    x = rng.integers(0, 2, (7, len(html.FEATURES))).astype(float)
    worth = lambda y: sum((x @ field.state)[i, k] for i, k in enumerate(y)) + sum(field.step[a, b] for a, b in zip(y, y[1:]))
    assert tuple(field.best(x)) == max(product((0, 1), repeat=7), key=worth)


def test_odd_pages(spark):
    pages = ["<p>Text &amp; more  <b>bold</b>\n here.<script>var t='</p>'</script>", None, "", "plain words only, no markup at all.", "<<<>><p", "<!-- only", "<p>" * 3000]
    df = spark.createDataFrame([(i, None, p, 1) for i, p in enumerate(pages)], "page_id long, url string, html string, text int")
    out = {r["page_id"]: r for r in html.main_text(df).collect()}
    assert len(out) == len(pages) and out[1]["text"] == out[2]["text"] == "" and out[1]["n_chars"] == 0
    assert html.blocks(pages[0])[0][0] == "Text & more bold here."
    assert html.main_text(df.where("false")).count() == 0


def test_neighbours(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    held = df.orderBy("vec_id").toPandas()
    x, ids = np.array(list(held.embedding), float), held.vec_id.to_numpy()
    got = ann.searched(df, F.col("vec_id") % 20 == 0, shard_rows=700).toPandas()
    asked = np.flatnonzero(ids % 20 == 0)
    near = x[asked] @ x.T
    near[np.arange(len(asked)), asked] = -9
    best = np.argsort(-near, axis=1, kind="stable")[:, :20]
    found = got.groupby("query_id").vec_id.apply(set)
    assert len(got) == 20 * len(asked)
    assert np.mean([len(found[ids[a]] & set(ids[b].tolist())) / 20 for a, b in zip(asked, best)]) >= 0.9
    assert np.allclose(got.score, [x[q] @ x[v] for q, v in zip(got.query_id, got.vec_id)], atol=1e-12)


def test_neighbours_of_awkward_rows(spark):
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(60, [0.5, 0.5]), (61, None), (62, [0.0, 0.0]), (63, [float("nan"), 1.0]), (64, [None, 1.0]), (65, []), (66, [1.0]), (None, [1.0, 1.0]), (40, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.digest(df).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert sorted(got) == [0, 20, 40, 60]
    assert got[0] == list(range(1, 21)) and got[20] == list(range(20)) and got[60] == list(range(20))
    assert ann.digest(df.where("false")).count() == 0 and ann.digest(df.where("vec_id in (0, 1)")).collect()[0]["vec_id"] == 1


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.digest(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 3 == 1 for i in out.doc_id)
    bad, good = out[out.toxic == 1].score.to_numpy(), out[out.toxic == 0].score.to_numpy()
    assert np.mean([(x > good).mean() + (x == good).mean() / 2 for x in bad]) > 0.85
    assert (bad >= 0.7).mean() > 0.7 and (good >= 0.7).mean() < 0.02


def test_toxicity_of_awkward_rows(spark, odd, empty):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(15)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    for df, given in ((odd, labels), (odd, labels.where("false")), (empty, labels)):
        out = toxicity.digest(df, given).collect()
        assert len(out) == df.count() and all(0 <= r["score"] <= 1 for r in out)
        assert all(r["held_out"] is (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    assert toxicity.without_toxic(odd, toxicity.train(odd, labels.where("false"))).columns == odd.columns


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert compare(QUERIES[name](spark, "/root/testdata/sf0.01"), connect("/root/testdata/sf0.01"), ORACLES[name]).startswith("ok")
    duckdb.default_connection()


def test_pipeline(spark, odd, empty):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for table in (docs, odd, empty):
        df = table
        for name, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, SF)
            assert name == "packing" or df.columns == table.columns, name
        assert df.count() >= 0
    assert corpus_pipeline.run(spark, SF).count() > 100
