"""Conversation prefix trie by vertical bitmaps.

Conversations are dealt into shards by ranges of ids. Inside a shard every (position, turn) has a
bitset of the conversations that say this turn there; walking depth first, a node's bitset meets
the postings of the next position, which yields its children, its count and the list of those that
end in it. Nodes are named by a hash chained over their turns, so the parts of a node that lie in
several shards meet again.

What belongs to a whole subtree (leaves, saved text) is added up without walking the joined trie:
every node is owned by its smallest member, which lies in one shard, and counts in that shard only.
"""

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.llm.common import staged

#: Ids of one shard; a multiple of 100, so that a shard holds the heads of its conversations.
SHARD_IDS = 1000
HEAD_IDS = 100
HEAD_TURNS = 6
_LOCAL = "shard long, node int, parent int, digest binary, depth int, chars int, first long, n int, ends binary"


def turns(conversations: DataFrame) -> DataFrame:
    """(shard, conv_id, turn, said, chars): each turn as 16 bytes of hash over role and text; null role or text is empty."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    kept = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return kept.select((F.col("conv_id") - F.col("conv_id") % SHARD_IDS).alias("shard"), "conv_id", "turn",
                       F.substring(F.unhex(F.sha2(whole, 256)), 1, 16).alias("said"), F.length("text").alias("chars"))


def _taken(conv_id: int) -> int:
    return zlib.crc32(str(conv_id).encode()) % HEAD_TURNS


def _head(conv_id: int) -> int:
    """The conversation that lends its first turns; as in SQL, the remainder has the sign of the id."""
    return conv_id - (abs(conv_id) % HEAD_IDS) * (1 if conv_id >= 0 else -1)


def rebuilt(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list:
    """Per conversation the row numbers of its rebuilt turns; its own are ``starts[i]:ends[i]``."""
    place = {int(c): i for i, c in enumerate(ids)}
    out = []
    for i, c in enumerate(ids.tolist()):
        h, at = _taken(c), place.get(_head(c))
        own = np.arange(min(starts[i] + h, ends[i]), ends[i])
        lent = np.arange(starts[at], min(starts[at] + h, ends[at])) if at is not None else own[:0]
        out.append(np.concatenate([lent, own]))
    return out


def walk(ids: list, said: list, chars: list):
    """The trie of one shard, depth first: (parent, digest, depth, chars, first, n, ends) per node, parents before children.

    ``ids`` ascend; ``said[i]`` are the turn codes of conversation i, ``chars`` the lengths of the texts of a code.
    """
    postings, alive = [], []
    for i, codes in enumerate(said):
        for d, code in enumerate(codes):
            if d == len(postings):
                postings.append({})
                alive.append(0)
            postings[d][code] = postings[d].get(code, 0) | 1 << i
            alive[d] |= 1 << i
    out, stack = [], [(-1, b"", 0, 0, (1 << len(ids)) - 1)]
    while stack:
        parent, digest, depth, length, members = stack.pop()
        node = len(out)
        going = members & alive[depth] if depth < len(alive) else 0
        ended, ends = members ^ going, []
        while ended:
            low = ended & -ended
            ends.append(ids[low.bit_length() - 1])
            ended ^= low
        out.append((parent, digest, depth, length, ids[(members & -members).bit_length() - 1], members.bit_count(), ends))
        while going:
            code = said[(going & -going).bit_length() - 1][depth]
            child = going & postings[depth][code]
            going ^= child
            stack.append((node, hashlib.sha256(digest + code).digest()[:16], depth + 1, chars[code], child))
    return out


def _shard(table: pa.Table) -> pa.Table:
    """One shard's turns to its local nodes."""
    order = pc.sort_indices(table, sort_keys=[(c, "ascending") for c in ("conv_id", "turn", "said")], null_placement="at_start")
    conv, codes, length = (table.column(c).take(order).to_numpy() for c in ("conv_id", "said", "chars"))
    starts = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
    ids = conv[starts]
    rows = rebuilt(ids, starts, np.r_[starts[1:], len(conv)])
    nodes = walk(ids.tolist(), [codes[r].tolist() for r in rows], dict(zip(codes.tolist(), length.tolist())))
    parent, digest, depth, chars, first, n, ends = zip(*nodes)
    shard = table.column("shard")[0].as_py()
    return pa.table({"shard": pa.array([shard] * len(nodes), pa.int64()), "node": pa.array(range(len(nodes)), pa.int32()), "parent": pa.array(parent, pa.int32()),
                     "digest": pa.array(digest, pa.binary()), "depth": pa.array(depth, pa.int32()), "chars": pa.array(chars, pa.int32()), "first": pa.array(first, pa.int64()),
                     "n": pa.array(n, pa.int32()), "ends": pa.array([np.array(e, "<i8").tobytes() for e in ends], pa.binary())})


def local_nodes(conversations: DataFrame) -> DataFrame:
    """The nodes of every shard's own trie; ``ends`` holds ids as 8 bytes each, ascending."""
    return turns(conversations).groupBy("shard").applyInArrow(_shard, _LOCAL)


def _joined(batches):
    """Rows sorted by (digest, shard) to one row per digest; ends are hashed as they pass by, whatever their number."""
    digest, row, hashed = None, None, None

    def closed():
        return (digest, row[0], row[1], row[2], row[1] == row[2], hashed.hexdigest())

    for batch in batches:
        done = []
        for d, first, n, ends in zip(*(batch.column(c).to_pylist() for c in ("digest", "first", "n", "ends"))):
            if d != digest:
                if row is not None:
                    done.append(closed())
                digest, row, hashed = d, [first, 0, 0], hashlib.sha256()
            if ends:
                text = ",".join(map(str, np.frombuffer(ends, "<i8").tolist()))
                hashed.update(("," + text if row[2] else text).encode())
            row[1] += n
            row[2] += len(ends) // 8
        if done:
            yield _batch(done)
    if row is not None:
        yield _batch([closed()])


def _batch(rows):
    kinds = (("digest", pa.binary()), ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_ends", pa.int64()), ("leaf", pa.bool_()), ("ends_sha256", pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], [n for n, _ in kinds])


def _shares(table: pa.Table) -> pa.Table:
    """What one shard adds to the totals of each of its nodes."""
    rows = table.to_pandas().sort_values("node", ignore_index=True)
    n = len(rows)
    parent, least = rows["parent"].to_numpy(), rows["conv_id"].to_numpy()
    owned = rows["first"].to_numpy() == least
    children = np.bincount(parent[1:][owned[1:]], minlength=n) if n > 1 else np.zeros(n, np.int64)
    leaves = (owned & rows["leaf"].to_numpy()).astype(np.int64)
    saved = np.where(owned, (rows["n_convs"].to_numpy() - 1) * rows["chars"].to_numpy().astype(np.int64), 0)
    for i in range(n - 1, 0, -1):  # children come after their parents
        leaves[parent[i]] += leaves[i]
        saved[parent[i]] += saved[i]
    above = pd.array(np.where(parent >= 0, least[np.maximum(parent, 0)], 0), dtype="Int64")
    above[parent < 0] = pd.NA
    out = rows[["digest", "depth", "conv_id", "n_convs", "ends_sha256"]].assign(parent_conv_id=above, n_children=children, n_leaves=leaves, saved_tokens=saved)
    return pa.Table.from_pandas(out, preserve_index=False)


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the prefix trie of the rebuilt conversations.

    Columns: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. A conversation's turns are ordered by turn, null first, ties
    by a hash of role and text; a null role or text is empty. It is rebuilt from the first h turns of
    the conversation with its id less the last two digits, then its own after its first h; h is the
    crc32 of its decimal id modulo 6. Rows without a conv_id take no part. An empty table has no nodes.
    Extra columns are ignored; repeated rows are turns of their own.

    A shard is at most ``SHARD_IDS`` ids (twice that around zero) and holds 28 bytes a turn, texts stay
    behind; a node shared by any number of conversations is one row per shard. The ends of a node are
    one stream in order of ids, as its hash demands, and are never held together.
    """
    local = staged(local_nodes(conversations))
    spread = local.select("digest", "shard", "first", "n", "ends").repartition("digest").sortWithinPartitions("digest", "shard")
    joined = staged(spread.mapInArrow(_joined, "digest binary, conv_id long, n_convs long, n_ends long, leaf boolean, ends_sha256 string"))
    named = local.select("shard", "node", "parent", "digest", "depth", "chars", "first").join(joined, "digest")
    shares = named.groupBy("shard").applyInArrow(
        _shares, "digest binary, depth int, conv_id long, n_convs long, ends_sha256 string, parent_conv_id long, n_children long, n_leaves long, saved_tokens long")
    same = ("depth", "conv_id", "n_convs", "ends_sha256", "parent_conv_id")
    totals = shares.groupBy("digest").agg(*[F.max(c).alias(c) for c in same], *[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")])
    return totals.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


SQL = r"""
WITH said AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(code)) AS p, code, chars
  FROM (SELECT conv_id, turn, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS code, length(coalesce(text, '')) AS chars
        FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (
  SELECT conv_id, count(*) AS n, conv_id - conv_id % 100 AS head,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                         lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 6 AS h
  FROM said GROUP BY conv_id),
rebuilt AS (
  SELECT c.conv_id, p AS d, code, chars FROM convs c JOIN said t ON t.conv_id = c.head AND p <= h
  UNION ALL
  SELECT c.conv_id, p - c.h + least(c.h, coalesce(l.n, 0)), code, chars
  FROM convs c JOIN said t ON t.conv_id = c.conv_id AND p > c.h LEFT JOIN convs l ON l.conv_id = c.head),
paths AS (
  SELECT conv_id, d, sha256(string_agg(sha256(code), '') OVER (PARTITION BY conv_id ORDER BY d)) AS k, chars FROM rebuilt
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
lasts AS (SELECT conv_id, max(d) AS z FROM paths GROUP BY conv_id),
nodes AS (
  SELECT k, d, min(conv_id) AS owner, count(*) AS n, any_value(chars) AS chars, count(*) FILTER (d = z) AS n_ends,
         string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = z) AS ends
  FROM paths JOIN lasts USING (conv_id) GROUP BY k, d),
above AS (
  SELECT a.k, m.k AS below, a.d = m.d - 1 AS child, (m.n - 1) * m.chars AS saved, m.n = m.n_ends AS leaf
  FROM nodes m JOIN paths a ON a.conv_id = m.owner AND a.d <= m.d),
sums AS (SELECT k, count(*) FILTER (child) AS n_children, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved FROM above GROUP BY k),
parents AS (SELECT below AS k, owner FROM above JOIN nodes USING (k) WHERE child)
SELECT n.owner::BIGINT AS conv_id, n.d::BIGINT AS depth, p.owner::BIGINT AS parent_conv_id, n.n::BIGINT AS n_convs, n_children::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM nodes n JOIN sums USING (k) LEFT JOIN parents p USING (k)
"""
