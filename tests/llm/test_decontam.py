"""Benchmark decontamination against brute force."""

import hashlib
import re

import pytest

from wiretally.llm import decontam

GAP = re.compile("[\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}
ITEM = "One two, three four; five SIX seven eight nine ten eleven twelve"
ITEMS = [(1, ITEM, "x"), (20, "Übung É é über straße naïve 日本 a1 b2 c3 d4", "x"), (3, "only four words here", "x"), (4, "", "x"), (5, None, "x"),
         (6, ITEM, "x"), (None, "no name has this item of words that nobody gave", "x"), (1, "another text of item one which is ten words long altogether", "x")]
TEXTS = [None, "", " .,\n", "one", "prefix " + ITEM.upper() + " suffix", ITEM, "One two three four five six seven eight nine", ITEM + ". " + ITEM + "! " + ITEM,
         "…übung É é über straße naïve 日本 a1 b2 c3 d4", "Übung é é über straße naïve 日本 a1 b2 c3", "here: only four words here, only FOUR words here.",
         "x two three four five six seven eight nine ten eleven twelve thirteen", "no name has this item of words that nobody gave",
         "two three four five six seven eight nine ten eleven " * 40, "word " * 30000 + ITEM, "another text of item one which is ten words long altogether;" + ITEM]
ROWS = [(i, t, 1, "g", 2) for i, t in enumerate(TEXTS)] + [(None, ITEM, 1, "g", 2), (None, None, 1, "g", 2), (5, ITEM, 1, "g", 2), (5, "another one", 1, "g", 2)]
SCHEMA = "doc_id long, text string, hash int, gram string, n int"


def words(text):
    return [w for w in GAP.split((text or "").translate(UPPER)) if w]


def covered(text, items):
    said, hit, found = words(text), set(), set()
    for item, content in items:
        w = words(content)
        n = min(len(w), 10)
        for run in {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else ():
            for at in range(len(said) - n + 1):
                if tuple(said[at:at + n]) == run:
                    hit |= set(range(at, at + n))
                    found |= {str(item)} - {"None"}
    return said, hit, sorted(found)


def expected(rows, items):
    out = []
    for doc_id, text in rows:
        said, hit, found = covered(text, items)
        out.append((doc_id, len(said), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string, at string")


@pytest.mark.parametrize("limits", [{}, {"block_bytes": 400}])
def test_awkward_rows(spark, items, limits):
    got = decontam.digest(spark.createDataFrame(ROWS, SCHEMA), items, **limits).collect()
    assert sorted(map(tuple, got), key=repr) == expected([r[:2] for r in ROWS], [r[:2] for r in ITEMS])


def test_stored_rows(spark):
    sf = "/root/testdata/sf0.001"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = expected([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in bench.collect()])
    assert sorted(map(tuple, decontam.digest(docs, bench).collect()), key=repr) == want and any(r[-1] for r in want)


def test_empty_tables(spark, items):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    assert decontam.digest(rows.where("false"), items).count() == 0
    none = decontam.digest(rows, items.where("false")).collect()
    assert len(none) == len(ROWS) and not any(r["contaminated"] for r in none)
    assert decontam.cleaned(rows, items.where("false")).count() == len(ROWS)


def test_other_window_lengths(spark, items):
    rows = spark.createDataFrame([(1, "three four five"), (2, "three four"), (3, "Four, Five six")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_hit"] for r in decontam.digest(rows, items, size=3).collect()}
    assert got == {1: 3, 2: 0, 3: 3}


def test_cleaned_texts(spark, items):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    out = decontam.cleaned(rows, items)
    assert out.schema == rows.schema
    want = []
    for doc_id, text, *rest in ROWS:
        said, hit, _ = covered(text, [r[:2] for r in ITEMS])
        if hit:
            spans = [m.span() for m in re.finditer("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text)]
            kept, at = "", 0
            for i, (lo, hi) in enumerate(spans):
                if i in hit:
                    kept += text[at:lo] if i - 1 not in hit else ""
                    at = hi
                else:
                    kept, at = kept + text[at:hi], hi
            text = kept + text[at:]
        want.append((doc_id, text, *rest))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    left = decontam.cleaned(rows, items, "documents").collect()
    assert sorted(map(tuple, left), key=repr) == sorted((r for r in ROWS if not covered(r[1], [i[:2] for i in ITEMS])[1]), key=repr)
    with pytest.raises(ValueError):
        decontam.cleaned(rows, items, "words")


def test_no_python_in_the_plan(spark, items):
    plan = decontam.digest(spark.createDataFrame(ROWS, SCHEMA).where("doc_id > 0"), items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapIn" not in plan and "CartesianProduct" not in plan
