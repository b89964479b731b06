"""The conversation trie against a dictionary of all prefixes."""

import hashlib
import zlib

import pytest

from wiretally.llm import trie
from wiretally.llm.queries import ORACLES, QUERIES
from wiretally.verify import compare, connect

SCHEMA = "conv_id long, turn long, role string, text string, node int, digest string, first int, n int, shard int"


def expected(rows):
    """rows: (conv_id, turn, role, text); turns that tie are given in the order of their hashes."""
    said = {}
    key = lambda r: (r[1] is not None, r[1] or 0, hashlib.sha256(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).digest()[:16])
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=key):
        said.setdefault(c, []).append((role or "", text or ""))
    full = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 6
        head = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        full[c] = tuple(said.get(head, [])[:h] + own[h:])
    members = {}
    for c, path in full.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    totals = {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        worth = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        totals[node] = (sum(totals[b][0] for b in below) or 1, worth + sum(totals[b][1] for b in below))
    out = []
    for node, ids in members.items():
        ends = ",".join(str(c) for c in sorted(ids) if full[c] == node)
        out.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(children.get(node, [])), *totals[node],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, trie.trie(df).collect()), key=repr)


def made(spark, rows):
    return spark.createDataFrame([(*r, 1, "d", 2, 3, 4) for r in rows], SCHEMA)


def awkward():
    rows = [(c, t, "user" if t % 2 else "assistant", f"say {t % 3}") for c in (0, 1, 5, 42, 99, 100, 101, 250, 999, 1000, 1001, 2300, 2301) for t in range(c % 9)]
    rows += [(c, t, "user", f"shared {t}") for c in range(4000, 4060) for t in range(7)]           # one crowd over a whole head
    rows += [(c, t, "user", f"shared {t}") for c in (7000, 12000, 12100, 30000) for t in range(3)]  # the same node in several shards
    rows += [(-5, 1, "a", "minus"), (-105, 1, "a", "minus"), (-100, 1, "a", "head"), (0, -3, None, None)]
    rows += [(600, None, "u", "no turn"), (600, None, None, "no turn"), (600, 2, "u", None), (600, 2, "u", "tie"), (600, 2, "u", "tie"), (601, None, None, None)]
    rows += [(None, 1, "u", "nobody"), (None, None, None, None), (800, 1, "ab", "c"), (801, 1, "a", "bc"), (802, 1, "", "abc"), (900, 1, "u", "é日𝒳" * 5000)]
    rows += [(5000, t, "u", "long " + str(t)) for t in range(900)] + [(5001, t, "u", "long " + str(t)) for t in range(890)]
    rows += [(9007199254740993, 2**60 + 1, "u", "later"), (9007199254740993, 2**60, "u", "sooner")]
    return rows


def test_awkward_rows(spark):
    rows = awkward()
    assert found(made(spark, rows)) == expected(rows)


def test_empty_tables(spark):
    assert found(made(spark, [])) == []
    rows = [(17, 1, "u", "one")]
    # The only turn of 17 lies in its first crc32("17") % 6 = 3, which the absent head does not give back: a turnless member.
    assert found(made(spark, rows)) == expected(rows) and trie._taken(17) > 0 and len(expected(rows)) == 1


def test_stored_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert found(df) == expected([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_a_node_is_one_row_per_shard(spark):
    """A turn that every conversation begins with reaches the join as one row per shard, not one per conversation."""
    df = spark.range(30000).selectExpr("id AS conv_id", "0L AS turn", "'u' AS role", "'hello' AS text")
    local = trie.local_nodes(df)
    assert local.count() <= 30 * 3
    got = trie.trie(df).collect()
    assert sorted((r["depth"], r["n_children"]) for r in got) == [(0, 1), (1, 0)] and {r["n_convs"] for r in got if r["depth"] == 0} == {30000}


@pytest.mark.parametrize("limit", [100, 200])
def test_shards_of_other_sizes(spark, limit, monkeypatch):
    rows = awkward()
    monkeypatch.setattr(trie, "SHARD_IDS", limit)
    assert found(made(spark, rows)) == expected(rows)


def test_matches_sql(spark):
    name, sf = "op12_conversation_prefix_trie", "/root/testdata/sf0.01"
    assert compare(QUERIES[name](spark, sf), connect(sf), ORACLES[name]).startswith("ok")
