"""Chunked scans against brute force, with one key holding a third of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from wiretally.operators import scan


def _rows(n=600, seed=5, span=90_000_000):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else f"k{rnd.randrange(4)}"
        out.append((key, rnd.randrange(span), i, rnd.randrange(6)))
    return out


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(_rows(), "k string, ts_us long, no long, v long")


def _by_key():
    out = {}
    for k, t, no, v in _rows():
        out.setdefault(k, []).append((t, no, v))
    return {k: sorted(v) for k, v in out.items()}


def test_lag_and_running(points):
    got = scan.with_lag(points, "k", ["ts_us", "no"], {"prev": "v"}, width=1_000_000)
    got = {(r.k, r.ts_us, r.no): r.prev for r in got.collect()}
    run = scan.running(points, "k", ["ts_us", "no"], {"s": ("sum", "v"), "m": ("max", "v")}, width=1_000_000)
    run = {(r.k, r.ts_us, r.no): (r.s, r.m) for r in run.collect()}
    for k, rows in _by_key().items():
        for i, (t, no, v) in enumerate(rows):
            assert got[(k, t, no)] == (rows[i - 1][2] if i else None)
            vals = [x[2] for x in rows[:i + 1]]
            assert run[(k, t, no)] == (sum(vals), max(vals))


def test_trailing_count_and_distinct(points):
    span, width = 2_000_000, 4_000_000
    got = scan.trailing(
        [scan.count_changes(points, "k", "ts_us", span, width, "n"),
         scan.distinct_changes(points, "k", "v", "ts_us", span, width, "d")], "k", "ts_us", ["n", "d"])
    got = {(r.k, r.ts_us): (r.n, r.d) for r in got.collect()}
    want = {}
    for k, rows in _by_key().items():
        for t, _, _ in rows:
            inside = [x for x in rows if t - span <= x[0] <= t]
            want[(k, t)] = (len(inside), len({x[2] for x in inside}))
    assert got == want


def test_row_halo_keeps_last_n(points):
    got = scan.with_row_halo(points, "k", ["ts_us", "no"], 3, width=1_000_000)
    groups = {}
    for r in got.collect():
        groups.setdefault((r.k, r["_chunk"]), []).append((r["_halo"], r.ts_us, r.no, r.v))
    for (k, chunk), rows in groups.items():
        halo = sorted(r[1:] for r in rows if r[0])
        before = [x for x in _by_key()[k] if x[0] < chunk]
        assert halo == before[-3:]


@pytest.mark.parametrize("limit", [10_000, 0, 150])
def test_anchors_small_and_hot_paths_agree(points, limit):
    length = 700_000
    got = {}
    for r in scan.anchors(points, "k", "ts_us", length, max_points=limit, block=4).collect():
        got.setdefault(r.k, []).append(r.ts_us)
    for k, rows in _by_key().items():
        want = []
        for t, _, _ in rows:
            if not want or t - want[-1] >= length:
                want.append(t)
        assert sorted(got[k]) == want


def test_evenly_spaced_hot_key_never_merges(spark):
    """Equal spacing keeps every possible entry distinct, the worst case for links."""
    df = spark.range(2000).select(F.lit("a").alias("k"), (F.col("id") * 30_000 + F.col("id") % 7).alias("ts_us"))
    got = [r.ts_us for r in scan.anchors(df, "k", "ts_us", 1_000_000, max_points=0, block=8)
           .orderBy("ts_us").collect()]
    want = []
    for i in range(2000):
        t = i * 30_000 + i % 7
        if not want or t - want[-1] >= 1_000_000:
            want.append(t)
    assert got == want


def test_assign_anchor(points):
    found = scan.anchors(points, "k", "ts_us", 5_000_000)
    got = scan.assign_anchor(points, found, "k", "ts_us", 5_000_000, "win")
    assert got.count() == points.count()
    for k, rows in _by_key().items():
        want, cur = {}, None
        for t, no, _ in rows:
            if cur is None or t - cur >= 5_000_000:
                cur = t
            want[(t, no)] = cur
        have = {(r.ts_us, r.no): r.win for r in got.filter(F.col("k") == k).collect()}
        assert have == want
