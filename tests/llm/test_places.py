"""The prefix bound of the near-duplicate stage: similar sets share a place, in whatever order frequent shingles give."""

import numpy as np
import pytest

from wiretally.llm import simhash


@pytest.mark.parametrize("similarity", [0.5, 0.8, 0.95, 1.0])
def test_similar_sets_share_a_place(similarity):
    rng = np.random.default_rng(6)
    shared = np.sort(rng.integers(-2**62, 2**62, 300))
    found = 0
    for _ in range(600):
        base = np.unique(np.concatenate([rng.choice(shared, int(rng.integers(0, 200)), replace=False), rng.integers(-2**62, 2**62, int(rng.integers(1, 60)))]))
        keep = rng.random(len(base)) >= rng.random() * rng.choice([0, 0.3])
        other = np.unique(np.concatenate([base[keep], rng.integers(-2**62, 2**62, int(rng.choice([0, 5])))]))
        common = len(np.intersect1d(base, other))
        if not len(other) or common < similarity * (len(base) + len(other) - common):
            continue
        found += 1
        for frequent in (shared, shared[::3], np.zeros(0, np.int64)):
            # Sets come in order of their unsigned hash, as ``shingle_set`` gives them.
            a, b = (np.unique(x.view(np.uint64)).view(np.int64) for x in (base, other))
            mine, theirs = simhash._places(a, frequent, similarity), simhash._places(b, frequent, similarity)
            shared_places = len(np.intersect1d(mine, theirs))
            assert shared_places
            apart = sum(int(x).bit_count() for x in simhash._parity(a).view(np.uint64) ^ simhash._parity(b).view(np.uint64))
            assert len(a) + len(b) - apart >= 2 * np.ceil(similarity / (1 + similarity) * (len(a) + len(b)) - 1e-9)
            assert shared_places + max(len(a) - len(mine), len(b) - len(theirs)) >= np.ceil(similarity / (1 + similarity) * (len(a) + len(b)) - 1e-9)
    assert found > (20 if similarity < 1 else 0)


def test_frequent_shingles_come_last():
    one = np.arange(10, dtype=np.int64)
    assert simhash._places(one, np.array([0, 1, 2], np.int64), 0.8).tolist() == [3, 4, 5]
    assert simhash._places(one[:0], one, 0.8).tolist() == []


def test_frequent_shingles_of_texts(spark):
    line = "a line that very many of the texts share word for word"
    rows = [(f"{line} {' '.join(f'w{i}x{j}' for j in range(20))}".encode(),) for i in range(200)]
    found = simhash._frequent(spark.createDataFrame(rows, "raw binary"), 5)
    assert found.tolist() == sorted(simhash.shingle_set(line.encode()).tolist())


def test_a_crowd_makes_few_pairs(spark, monkeypatch):
    """Near copies of one text: a star of candidates, one group."""
    rng, made = np.random.default_rng(3), []
    base = [f"w{i}" for i in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 200):
        words = list(base)
        words[int(rng.integers(300))] = f"x{i}"
        rows.append((i, " ".join(words)))
    staged = simhash.staged

    def counted(df):
        out = staged(df)
        if out.columns == ["uc", "vc", "uf", "vf"]:
            made.append(out.count())
        return out
    monkeypatch.setattr(simhash, "staged", counted)
    got = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), complete=True).collect()
    assert {r["component_id"] for r in got} == {0} and len(got) == 200
    assert sum(made) <= 2 * 200


def test_a_line_in_few_of_many_texts_is_frequent(spark):
    """Five of 1,000 texts of a task share a line; three copies of another text share nothing with a different one."""
    line = "a line that only a few of the texts share word for word"
    rows = [(" ".join(f"w{i}x{j}" for j in range(20)) + (f" {line}" if i % 200 == 0 else ""),) for i in range(1000)]
    rows += [("a text that comes three times and is one text all the same",)] * 3
    texts = spark.createDataFrame([(t.encode(),) for (t,) in rows], "raw binary").coalesce(1)
    assert simhash._frequent(texts, 5).tolist() == sorted(simhash.shingle_set(line.encode()).tolist())


def test_complete_groups_are_those_of_all_pairs_and_places_are_dealt_once(spark, monkeypatch):
    """Texts around shared passages, with edits and copies: groups as by brute force; places are never written to the folder one by one."""
    rng, rows, written = np.random.default_rng(8), [], []
    passages = [" ".join(f"p{k}y{j}" for j in range(30)) for k in range(3)]
    for i in range(120):
        words = [f"t{i % 40}z{j}" for j in range(60)]
        for at in rng.integers(0, 60, int(rng.integers(0, 4))):
            words[at] = f"e{i}"
        rows.append((i, " ".join(words) + " " + passages[i % 3]))
    rows += [(200 + i, t) for i, t in rows[:10]]
    staged = simhash.staged
    monkeypatch.setattr(simhash, "staged", lambda df: written.append(df.columns) or staged(df))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(frame, complete=True).collect()}
    sets = {i: set(simhash.shingle_set(t.encode()).tolist()) for i, t in rows}
    least = {i: i for i in sets}
    for _ in range(len(sets)):
        was = dict(least)
        for a in sets:
            for b in sets:
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
        if least == was:
            break
    assert got == least and 1 < len(set(least.values())) < len(rows)
    assert not any("shingle" in columns for columns in written)


def test_only_texts_that_may_match_are_joined(spark):
    """The filter before a join misses no id, null and negative ones included, and lets few others pass."""
    from pyspark.sql import functions as F
    ids = [0, -5, 2**62, *range(1000, 3000, 2)]
    perhaps = simhash._perhaps(spark.createDataFrame([(i,) for i in ids], "doc_id long"))
    rows = spark.range(-2000, 20000).select(F.col("id").alias("doc_id")).unionByName(spark.createDataFrame([(2**62,), (None,)], "doc_id long"))
    passed = [r["doc_id"] for r in rows.where(perhaps(F.col("doc_id"))).collect()]
    assert set(ids) <= set(passed) and len(passed) < len(ids) + 100


def test_repeated_ids_leave_one_row_and_other_texts_stay(spark):
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(i, " ".join(f"d{i}x{j}" for j in range(30))) for i in range(50)] + [(100, base), (100, base), (101, base + " end"), (102, "other words"), (102, "other words"), (None, base)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id int, text string"))
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([*range(50), 100, 102, None], key=str)
    assert kept.schema["doc_id"].dataType.simpleString() == "int"


def test_the_filter_before_a_join_needs_no_python_worker(spark):
    """A second worker beside the one that reads the texts took an executor over its memory."""
    from pyspark.sql import functions as F
    ids = spark.createDataFrame([(1,), (2,)], "doc_id long")
    rows = spark.range(100).select(F.col("id").alias("doc_id"))
    plan = rows.where(simhash._perhaps(ids)(F.col("doc_id")))._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan
    none = rows.where(simhash._perhaps(ids.limit(0))(F.col("doc_id")))
    assert none.count() == 0


def test_texts_are_taken_in_slices():
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"raw": [b"x"] * (2 * simhash.SLICE + 3)})
    assert [len(b) for b in simhash._sliced([batch])] == [simhash.SLICE, simhash.SLICE, 3]


def test_counts_of_a_lot(spark, monkeypatch):
    """Fewer shingles than texts that must share one, and lots that end within a slice."""
    texts = lambda *rows: spark.createDataFrame([(t.encode(),) for t in rows], "raw binary").coalesce(1)
    assert simhash._frequent(texts("one"), 5).tolist() == []
    monkeypatch.setattr(simhash, "COUNTED", 6)
    line = "five words that all share"
    found = simhash._frequent(texts(*[f"{line} w{i}" for i in range(6)]), 5)
    assert found.tolist() == simhash.shingle_set(line.encode()).tolist()
