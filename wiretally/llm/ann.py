"""Approximate nearest neighbours by inner product: robust-pruned directed graphs, one per shard, beam-searched."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wiretally.llm.common import staged


class Graph:
    """A directed graph over vectors, built by greedy searches and relaxed distance pruning.

    Inner products are turned to distances by one more component that gives all vectors one length,
    so the nearest by distance has the largest inner product. Points enter in lots of growing size:
    each searches the graph so far for its visited neighbourhood and keeps diverse edges (an edge
    to p drops those to points that lie ``relax`` times nearer to p than to the new point); edges
    are laid back, and a list that overflows is pruned alike. A second pass over all points repairs
    what the first could not see.
    """

    def __init__(self, vectors, degree: int = 32, beam: int = 64, relax: float = 1.2, seed: int = 1):
        self.raw = np.asarray(vectors, np.float64)
        norms = (self.raw ** 2).sum(axis=1)
        self.radius = float(norms.max()) if len(norms) else 0.0
        extra = np.sqrt(np.maximum(self.radius - norms, 0))
        self.points = np.column_stack([self.raw, extra]).astype(np.float32)
        n = len(self.points)
        self.degree, self.beam, self.relax = degree, beam, relax
        self.edges = np.full((n, degree), -1, np.int32)
        if not n:
            return
        self.start = int(((self.points - self.points.mean(axis=0)) ** 2).sum(axis=1).argmin())
        order = np.random.default_rng(seed).permutation(n)
        order = np.concatenate([[self.start], order[order != self.start]])
        for first in (True, False):
            at, lot = (1 if first else 0), 1
            while at < n:
                lot = min(max(1, at // 2) if first else 256, 256)
                self._insert(order[at:at + lot])
                at += lot

    def _distances(self, queries, ids):
        near = self.points[ids]
        return ((near - queries[:, None, :]) ** 2).sum(axis=2)

    def search(self, queries, beam):
        """Beam search of many queries at once: ids and distances of the beam, nearest first; -1 where none."""
        m, n = len(queries), len(self.points)
        ids = np.full((m, beam), -1, np.int32)
        dist = np.full((m, beam), np.inf, np.float32)
        done = np.zeros((m, beam), bool)
        seen = np.zeros((m, n), bool)
        ids[:, 0] = self.start
        dist[:, 0] = ((self.points[self.start] - queries) ** 2).sum(axis=1)
        seen[:, self.start] = True
        alive = np.arange(m)
        while len(alive):
            open_ = np.where(done[alive] | (ids[alive] < 0), np.inf, dist[alive])
            pick = open_.argmin(axis=1)
            going = np.isfinite(open_[np.arange(len(alive)), pick])
            alive, pick = alive[going], pick[going]
            if not len(alive):
                break
            done[alive, pick] = True
            nxt = self.edges[ids[alive, pick]]
            new = nxt >= 0
            new &= ~seen[alive[:, None], np.where(new, nxt, 0)]
            seen[np.repeat(alive, new.sum(axis=1)), nxt[new]] = True
            d = np.where(new, self._distances(queries[alive], np.where(new, nxt, 0)), np.inf).astype(np.float32)
            every = np.concatenate([dist[alive], d], axis=1)
            order = np.argsort(every, axis=1, kind="stable")[:, :beam]
            dist[alive] = np.take_along_axis(every, order, axis=1)
            ids[alive] = np.take_along_axis(np.concatenate([ids[alive], np.where(new, nxt, -1)], axis=1), order, axis=1)
            done[alive] = np.take_along_axis(np.concatenate([done[alive], ~new], axis=1), order, axis=1)
        return ids, dist

    def _insert(self, chosen):
        found, _ = self.search(self.points[chosen], self.beam)
        pool = np.concatenate([found, self.edges[chosen]], axis=1)
        self.edges[chosen] = self._pruned(chosen, pool)
        source = np.repeat(chosen, self.degree)
        target = self.edges[chosen].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        starts = np.flatnonzero(np.append(True, target[1:] != target[:-1])) if len(target) else np.zeros(0, int)
        full, wide = [], []
        for s, e in zip(starts, np.append(starts[1:], len(target))):
            p, added = target[s], np.setdiff1d(source[s:e], self.edges[target[s]])
            free = np.flatnonzero(self.edges[p] < 0)
            if len(added) <= len(free):
                self.edges[p, free[:len(added)]] = added
            else:
                full.append(p)
                wide.append(np.concatenate([self.edges[p], added]))
        if full:
            pool = np.full((len(full), max(map(len, wide))), -1, np.int32)
            for i, w in enumerate(wide):
                pool[i, :len(w)] = w
            self.edges[full] = self._pruned(np.array(full), pool)

    def _pruned(self, owners, pool):
        """Diverse nearest neighbours of each owner from its pool."""
        pool = np.where(pool == np.asarray(owners)[:, None], -1, pool)
        d = np.where(pool >= 0, self._distances(self.points[owners], np.maximum(pool, 0)), np.inf)
        order = np.argsort(d, axis=1, kind="stable")
        pool, d = np.take_along_axis(pool, order, axis=1), np.take_along_axis(d, order, axis=1)
        out = np.full((len(pool), self.degree), -1, np.int32)
        count, rows = np.zeros(len(pool), int), np.arange(len(pool))
        d = d.copy()
        for _ in range(self.degree):
            pick = d.argmin(axis=1)
            ok = np.isfinite(d[rows, pick])
            if not ok.any():
                break
            best = np.where(ok, pool[rows, pick], -1)
            out[ok, count[ok]] = best[ok]
            count[ok] += 1
            apart = ((self.points[np.maximum(pool, 0)] - self.points[np.maximum(best, 0)][:, None, :]) ** 2).sum(axis=2)
            d[(self.relax ** 2 * apart <= d) & ok[:, None]] = np.inf
            d[pool == best[:, None]] = np.inf
        return out


def usable(vector):
    """Whether a vector takes part: not null, not empty, all components finite, not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def searched(vectors: DataFrame, is_query, k: int = 20, shard_rows: int = 4096, degree: int = 32, beam: int = 96) -> DataFrame:
    """The ``k`` nearest rows found for every query row: (query_id, rank, vec_id, score).

    ``vectors`` has vec_id and embedding; ``is_query`` is a condition on vec_id. Every usable row is
    indexed and a candidate of all queries but its own; nearness is the inner product of the
    original vectors in double precision, ties go to the smaller vec_id. Null, empty and zero
    vectors and those with null or non-finite components take no part, nor do null ids; vectors of
    another length than the most frequent one neither. Equal vectors are one point that stands for
    its k + 1 least ids, which is all that an answer can hold, so copies neither crowd the graph nor
    drop out of a tie. Rows that repeat a vec_id with the same vector are one. Points are dealt to
    shards of about ``shard_rows`` by hash; each shard builds its graph once and answers all
    queries in lots; the best k per query are kept per shard and then over all. Extra columns are
    ignored.
    """
    values = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), values.alias("v"))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if length is None:
        return vectors.sparkSession.createDataFrame([], empty)
    rows = staged(rows.where(F.size("v") == length["n"]).distinct())
    place = Window.partitionBy("v").orderBy("vec_id")
    points = (rows.withColumn("n", F.row_number().over(place)).where(F.col("n") <= k + 1)
              .groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    shards = max(1, -(-points.count() // shard_rows))
    dealt = points.select(F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"), "v", "ids", F.lit(False).alias("asks"))
    queries = rows.where(is_query)
    named = queries.groupBy("v").agg(F.min("vec_id").alias("first"))
    asking = named.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "v", F.array("first").alias("ids"), F.lit(True).alias("asks"))

    def answer(table: pd.DataFrame) -> pd.DataFrame:
        asks = table["asks"].to_numpy(bool)
        held, queries = table[~asks], table[asks]
        if not len(held) or not len(queries):
            return pd.DataFrame({"first": [], "vec_id": [], "score": []})
        order = np.argsort([i[0] for i in held["ids"]], kind="stable")
        names = [list(held["ids"].iloc[i]) for i in order]
        graph = Graph(np.array([held["v"].iloc[i] for i in order]), degree, max(64, beam * 2 // 3))
        asked, out = np.array(list(queries["v"])), []
        first = [int(i[0]) for i in queries["ids"]]
        pad = np.zeros((1, 1), np.float32)
        for at in range(0, len(asked), 256):
            q = asked[at:at + 256]
            found, _ = graph.search(np.column_stack([q, np.repeat(pad, len(q), 0)]).astype(np.float32), min(max(beam, k + 1), len(names)))
            for j in range(len(q)):
                near = found[j][found[j] >= 0]
                score = (graph.raw[near] * q[j]).sum(axis=1)
                best = near[np.lexsort((near, -score))][:k + 1]
                score = (graph.raw[best] * q[j]).sum(axis=1)
                hits = sorted((-s, i) for s, b in zip(score.tolist(), best.tolist()) for i in names[b])[:k + 1]
                out += [(first[at + j], i, -s) for s, i in hits]
        return pd.DataFrame(out, columns=["first", "vec_id", "score"])
    answers = dealt.unionByName(asking).groupBy("shard").applyInPandas(answer, "first long, vec_id long, score double")
    best = Window.partitionBy("first").orderBy(F.desc("score"), "vec_id")
    kept = answers.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    askers = queries.join(named, "v").select(F.col("vec_id").alias("query_id"), "first")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    others = askers.join(kept, "first").where("vec_id <> query_id")
    return others.withColumn("rank", F.row_number().over(own).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digest(vectors: DataFrame) -> DataFrame:
    return searched(vectors, F.col("vec_id") % 20 == 0)
