"""Ordered scans that stay exact and parallel when one key holds most rows.

A plain ``Window.partitionBy(key)`` puts a whole key in one task. The functions
here cut every key into time chunks, work per (key, chunk), and bring in from
earlier chunks only what the scan needs:

* a *time halo*: rows of the last ``span`` of the previous chunk (trailing windows);
* a *row halo*: the last ``n`` rows before the chunk (lag, last-n statistics);
* a *carry*: one aggregate per earlier chunk (running sums and maxima).

A chunk is named by its start, so ``chunk_start(ts, width)`` is a LONG. Inputs
that may repeat a timestamp are aggregated per (key, timestamp) first, hence a
(key, chunk) group has at most ``width`` rows whatever the packet rate. Only
chunk summaries, one row per non-empty chunk, are ordered per key.

Key columns must not be null.
"""

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretally.session import stage

CHUNK_US = 10_000_000


def as_list(keys):
    return [keys] if isinstance(keys, str) else list(keys)


def chunk_start(ts, width=CHUNK_US) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return ts - F.pmod(ts, F.lit(width))


def with_time_halo(df: DataFrame, ts: str, span: int, width: int) -> DataFrame:
    """Add ``_chunk``; rows of the last ``span`` also appear in the next chunk, marked ``_halo``."""
    if span > width:
        raise ValueError("a halo cannot be longer than a chunk")
    own = chunk_start(ts, width)
    both = F.array(F.struct(own.alias("c"), F.lit(False).alias("h")),
                   F.struct((own + width).alias("c"), F.lit(True).alias("h")))
    copies = F.when(own + width - F.col(ts) <= span, both).otherwise(F.slice(both, 1, 1))
    return (df.withColumn("_copy", F.explode(copies))
            .withColumn("_chunk", F.col("_copy.c")).withColumn("_halo", F.col("_copy.h")).drop("_copy"))


def with_row_halo(df: DataFrame, keys, order, n: int = 1, width: int = CHUNK_US) -> DataFrame:
    """Add ``_chunk``; each (key, chunk) is preceded by the ``n`` rows before it, marked ``_halo``.

    ``order[0]`` is the column chunks are cut on.
    """
    keys, order = as_list(keys), as_list(order)
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.struct(*order, *rest)
    part = df.withColumn("_chunk", chunk_start(order[0], width))
    if n == 1:
        tails = part.groupBy(*keys, "_chunk").agg(F.array(F.max(row)).alias("_tail"))
    else:
        latest = Window.partitionBy(*keys, "_chunk").orderBy(*[F.desc(c) for c in order])
        tails = (part.withColumn("_n", F.row_number().over(latest)).filter(F.col("_n") <= n)
                 .groupBy(*keys, "_chunk").agg(F.collect_list(row).alias("_tail")))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(-n, -1)
    last = F.slice(F.sort_array(F.flatten(F.collect_list("_tail").over(before)), asc=False), 1, n)
    halo = (tails.withColumn("_last", last).select(*keys, "_chunk", F.explode("_last").alias("_row"))
            .select(*keys, "_chunk", *[F.col(f"_row.{c}").alias(c) for c in order + rest],
                    F.lit(True).alias("_halo")))
    return part.withColumn("_halo", F.lit(False)).unionByName(halo)


def with_lag(df: DataFrame, keys, order, columns: dict, width: int = CHUNK_US) -> DataFrame:
    """``lag`` per key: ``columns`` maps new names to the columns to read from the previous row."""
    keys, order = as_list(keys), as_list(order)
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    out = with_row_halo(df, keys, order, 1, width)
    return (out.withColumns({new: F.lag(old).over(w) for new, old in columns.items()})
            .filter(~F.col("_halo")).drop("_chunk", "_halo"))


_MERGE = {"sum": F.sum, "max": F.max, "min": F.min}


def running(df: DataFrame, keys, order, columns: dict, width: int = CHUNK_US,
            chunk: Column = None) -> DataFrame:
    """Running aggregates per key, current row included.

    ``columns`` maps new names to ``(fn, column)`` with fn one of sum, max, min.
    ``chunk`` overrides the time cut and must be monotone in ``order``.
    """
    keys, order = as_list(keys), as_list(order)
    part = df.withColumn("_chunk", chunk_start(order[0], width) if chunk is None else chunk)
    totals = part.groupBy(*keys, "_chunk").agg(
        *[_MERGE[fn](col).alias(f"_t_{new}") for new, (fn, col) in columns.items()])
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, "_chunk", *[
        _MERGE[fn](f"_t_{new}").over(before).alias(f"_c_{new}") for new, (fn, _) in columns.items()])
    upto = (Window.partitionBy(*keys, "_chunk").orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))

    def merged(new, fn, col):
        here, past = _MERGE[fn](col).over(upto), F.col(f"_c_{new}")
        if fn == "sum":
            return F.coalesce(here, F.lit(0)) + F.coalesce(past, F.lit(0))
        return (F.greatest if fn == "max" else F.least)(here, past)

    return (part.join(carry, [*keys, "_chunk"])
            .withColumns({new: merged(new, fn, col) for new, (fn, col) in columns.items()})
            .drop("_chunk", *[f"_c_{new}" for new in columns]))


def count_changes(df: DataFrame, keys, ts: str, span: int, width: int, name: str,
                  extra: dict = None) -> DataFrame:
    """Changes of "rows in the trailing ``span``": +n at a timestamp, -n once it has left."""
    keys, extra = as_list(keys), extra or {}
    points = df.groupBy(*keys, F.col(ts).alias("_at")).agg(
        F.count(F.lit(1)).alias("_n"), *[c.alias(k) for k, c in extra.items()])
    halo = with_time_halo(points, "_at", span, width)
    nulls = [F.when(F.lit(True), F.col(k)).alias(k) for k in extra]
    gone = [F.when(F.lit(False), F.col(k)).alias(k) for k in extra]
    change = F.array(
        F.struct(F.col("_at").alias("at"), F.col("_n").alias(name), (~F.col("_halo")).alias("real"), *nulls),
        F.struct((F.col("_at") + span + 1).alias("at"), (-F.col("_n")).alias(name), F.lit(False).alias("real"),
                 *gone))
    return (halo.select(*keys, "_chunk", F.inline(change))
            .filter(F.col("at") < F.col("_chunk") + width))


def distinct_changes(df: DataFrame, keys, values, ts: str, span: int, width: int, name: str) -> DataFrame:
    """Changes of "distinct ``values`` seen in the trailing ``span``".

    A value is present from each sighting until its next sighting or until
    ``span`` has passed, whichever is first; summing the ends of those
    stretches counts distinct values without holding a set.
    """
    keys, values = as_list(keys), as_list(values)
    points = df.select(*keys, *values, F.col(ts).alias("_at")).distinct()
    halo = with_time_halo(points, "_at", span, width)
    nxt = F.lead("_at").over(Window.partitionBy(*keys, *values, "_chunk").orderBy("_at"))
    end = F.least(F.coalesce(nxt, F.col("_at") + span + 1), F.col("_at") + span + 1)
    one = F.lit(1).cast("long")
    change = F.array(
        F.struct(F.col("_at").alias("at"), one.alias(name), (~F.col("_halo")).alias("real")),
        F.struct(F.col("_end").alias("at"), (-one).alias(name), F.lit(False).alias("real")))
    return (halo.withColumn("_end", end).select(*keys, "_chunk", F.inline(change))
            .filter(F.col("at") < F.col("_chunk") + width))


def trailing(changes, keys, ts: str, names, extra=()) -> DataFrame:
    """Sum several change streams into trailing values at every real timestamp."""
    keys, names = as_list(keys), as_list(names)
    allrows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), changes)
    points = allrows.groupBy(*keys, "_chunk", "at").agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(f"_d_{n}") for n in names],
        F.max("real").alias("_real"), *[F.min(e).alias(e) for e in extra])
    upto = (Window.partitionBy(*keys, "_chunk").orderBy("at")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (points.select(*keys, F.col("at").alias(ts), "_real", *extra,
                          *[F.sum(f"_d_{n}").over(upto).alias(n) for n in names])
            .filter("_real").drop("_real"))


def trailing_rows(df: DataFrame, keys, ts: str, span: int, width: int, count: str = None, distinct: dict = None) -> DataFrame:
    """Every row of ``df`` with values over the trailing ``span`` of its key, at its own timestamp (ties included).

    ``count`` names the number of rows; ``distinct`` maps names to (columns, condition) for the number of
    different values among the rows that meet the condition. One shuffle by (key, chunk) serves all of
    them: a row enters its chunk with +1 and leaves behind marks with -1 where it, or the value it
    shows, is no longer within the span.
    """
    keys, distinct = as_list(keys), distinct or {}
    cols = df.columns
    halo = with_time_halo(df, ts, span, width).repartition(*keys, "_chunk")
    gone = F.col(ts) + span + 1
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    seen, ends = {}, {}
    for i, (name, (values, where)) in enumerate(distinct.items()):
        halo = halo.withColumn(f"_in{i}", F.coalesce(where, F.lit(False)))
        again = Window.partitionBy(*keys, "_chunk", f"_in{i}", *as_list(values)).orderBy(ts)
        halo = halo.withColumn(f"_end{i}", F.least(F.coalesce(F.lead(ts).over(again), gone), gone))
        seen[name], ends[name] = F.col(f"_in{i}"), F.col(f"_end{i}")
    names = ([count] if count else []) + list(distinct)

    def mark(at, real, changes):
        own = [F.when(F.lit(real), F.col(f"`{c}`")).alias(c) for c in cols]
        return F.struct(at.alias("_at"), (~F.col("_halo") if real else F.lit(False)).alias("_real"),
                        *[changes.get(n, zero).alias(f"_d_{n}") for n in names], *own)

    came = {n: F.when(seen[n], one).otherwise(zero) for n in distinct} | ({count: one} if count else {})
    left = {n: F.when(seen[n] & (ends[n] == gone), -one).otherwise(zero) for n in distinct} | ({count: -one} if count else {})
    marks = [mark(F.col(ts), True, came), mark(gone, False, left)]
    marks += [F.when(seen[n] & (ends[n] < gone), mark(ends[n], False, {n: -one})) for n in distinct]
    rows = halo.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_chunk", F.explode(F.filter(F.array(*marks), lambda m: m.isNotNull() & (m["_at"] < F.col("_chunk") + width))).alias("_m"))
    rows = rows.select(*[f"_k_{k}" for k in keys], "_chunk", "_m.*")
    upto = Window.partitionBy(*[f"_k_{k}" for k in keys], "_chunk").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return (rows.withColumns({n: F.sum(f"_d_{n}").over(upto) for n in names}).filter("_real")
            .select("_chunk", *[F.col(f"`{c}`") for c in cols], *names))


def running_over_all(df: DataFrame, order, columns: dict) -> DataFrame:
    """Running sums over the whole table in ``order``, current row included; ``columns`` maps new names to columns.

    Rows are cut into ranges at sampled quantiles, so a range holds about its share wherever the values
    crowd. Sums run within a range; what the ranges before it hold is one row per range, added up on
    the driver. The ranges are written once, since they are read for both.
    """
    order = as_list(order)
    cut = stage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = cut.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{new}") for new, c in columns.items()]).orderBy("_part").collect()
    rows, so_far = [], [0] * len(columns)
    for r in totals:
        rows.append((r["_part"], *so_far))
        so_far = [a + (r[f"_t_{new}"] or 0) for a, new in zip(so_far, columns)]
    kinds = {new: df.select(F.sum(c).alias("s")).schema["s"].dataType.simpleString() for new, c in columns.items()}
    before = df.sparkSession.createDataFrame(rows, "_part int, " + ", ".join(f"_c_{new} {k}" for new, k in kinds.items()))
    upto = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (cut.join(before, "_part").withColumns({new: F.sum(c).over(upto) + F.col(f"_c_{new}") for new, c in columns.items()})
            .drop("_part", *[f"_c_{new}" for new in columns]))


# --- anchored windows -------------------------------------------------------
#
# The first timestamp of a key is an anchor; the next anchor is the first
# timestamp at least ``length`` later; and so on. This is both "new window once
# the current one is 5 s old" and "alert again once the last alert is 30 s old".

def _walk(ts: np.ndarray, start: int, length: int) -> list:
    """Indexes of the anchors of a sorted array from position ``start``."""
    out, i = [], start
    while i < len(ts):
        out.append(i)
        i = int(np.searchsorted(ts, ts[i] + length, side="left"))
    return out


def _anchors_of_sorted(names, ts, length):
    """mapInPandas body: rows sorted by key then time, one pass, constant state."""
    def body(batches):
        key, last = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            stamps = pdf[ts].to_numpy()
            fields = [pdf[n].to_numpy() for n in names]
            change = np.zeros(len(pdf), dtype=bool)
            for f in fields:
                change[1:] |= f[1:] != f[:-1]
            bounds = [0, *np.flatnonzero(change).tolist(), len(pdf)]
            keep = []
            for lo, hi in zip(bounds, bounds[1:]):
                here = tuple(f[lo] for f in fields)
                part = stamps[lo:hi]
                begin = 0
                if here == key:
                    begin = int(np.searchsorted(part, last + length, side="left"))
                found = _walk(part, begin, length)
                if found:
                    last = part[found[-1]]
                keep.extend(lo + i for i in found)
                key = here
            yield pdf.iloc[keep]
    return body


def _first_at_or_after(probes: DataFrame, points: DataFrame, keys, ts: str, width: int) -> DataFrame:
    """For each probe (keys, _probe) the first point at or after it, as ``_next``."""
    both = (points.select(*keys, F.col(ts).alias("_t"), F.col(ts).alias("_hit"), F.lit(1).alias("_kind"))
            .unionByName(probes.select(*keys, F.col("_probe").alias("_t"), F.lit(None).cast("long").alias("_hit"),
                                       F.lit(0).alias("_kind"))))
    back = both.withColumn("_rev", -F.col("_t")).withColumn("_rk", -F.col("_kind"))
    found = running(back, keys, ["_rev", "_rk"], {"_next": ("min", "_hit")}, width)
    return found.filter("_kind = 0").select(*keys, F.col("_t").alias("_probe"), "_next")


def _anchors_of_hot(points: DataFrame, keys, ts: str, length: int, block: int) -> DataFrame:
    """Anchors of keys too large for one task.

    Time is cut into blocks of ``block`` window lengths. Inside a block only
    timestamps of its first ``length`` (and the first one after) can be its
    first anchor, so each block is reduced to "entered here -> last anchor
    there". Those links are followed across blocks by repeated doubling, and
    every block is then walked once from its known entry.
    """
    width = length * block
    cut = stage(points.withColumn("_block", chunk_start(ts, width)).repartition(*keys, "_block"))
    spark_keys = cut.select(*keys, "_block", ts).schema

    def exits(pdf):
        pdf = pdf.sort_values(ts, ignore_index=True)
        t = pdf[ts].to_numpy()
        nxt = np.searchsorted(t, t + length, side="left")
        last = np.arange(len(t))
        for _ in range(block + 1):
            step = nxt[last]
            last = np.where(step < len(t), np.minimum(step, len(t) - 1), last)
        head = int(np.searchsorted(t, pdf["_block"].iloc[0] + length, side="left")) + 1
        out = pdf.iloc[:head].copy()
        out["_exit"] = t[last[:head]]
        return out

    links = cut.groupBy(*keys, "_block").applyInPandas(
        exits, schema=", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark_keys) + ", _exit long")
    links = stage(links.withColumn("_probe", F.col("_exit") + length))
    hits = _first_at_or_after(links.select(*keys, "_probe").distinct(), cut.select(*keys, ts), keys, ts, width)
    jump = stage(links.join(hits, [*keys, "_probe"]).filter(F.col("_next").isNotNull())
                 .select(*keys, F.col(ts).alias("_from"), F.col("_next").alias("_to")))
    reached = cut.groupBy(*keys).agg(F.min(ts).alias("_from"))
    while True:
        more = reached.join(jump, [*keys, "_from"]).select(*keys, F.col("_to").alias("_from"))
        grown = stage(reached.unionByName(more).distinct())
        if grown.count() == reached.count():
            break
        reached = grown
        jump = stage(jump.join(jump.select(*keys, F.col("_from").alias("_to"), F.col("_to").alias("_far")),
                               [*keys, "_to"]).select(*keys, "_from", F.col("_far").alias("_to")))

    entries = reached.withColumn("_block", chunk_start("_from", width))
    fields = cut.select(*keys, ts).schema

    def walk(pdf):
        pdf = pdf.sort_values(ts, ignore_index=True)
        t = pdf[ts].to_numpy()
        start = int(np.searchsorted(t, pdf["_from"].iloc[0], side="left"))
        return pdf.iloc[_walk(t, start, length)][[*keys, ts]]

    return (cut.join(entries, [*keys, "_block"]).groupBy(*keys, "_block")
            .applyInPandas(walk, schema=fields))


def anchors(points: DataFrame, keys, ts: str, length: int, max_points: int = 2_000_000,
            block: int = 16) -> DataFrame:
    """Anchor timestamps (keys, ts) of every key; see the note above.

    Keys of up to ``max_points`` rows are scanned in order, many keys per task
    and with constant memory. Larger keys are split by time blocks. The size of
    a key is checked by a map-side combined count before choosing.
    """
    keys = as_list(keys)
    slim = points.select(*keys, ts)
    hot = slim.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_points).drop("_n")
    has_hot = bool(hot.head(1))
    small = slim.join(hot, keys, "left_anti") if has_hot else slim
    fields = slim.schema
    found = (small.repartition(*keys).sortWithinPartitions(*keys, ts)
             .mapInPandas(_anchors_of_sorted(keys, ts, length), schema=fields))
    if has_hot:
        big = slim.join(hot, keys, "left_semi").distinct()
        found = found.unionByName(_anchors_of_hot(big, keys, ts, length, block))
    return found


def assign_anchor(rows: DataFrame, found: DataFrame, keys, ts: str, length: int, name: str, carry=()) -> DataFrame:
    """Give every row the anchor whose window it falls in (less than ``length`` before it).

    Columns ``carry`` of the anchors, which must be the same for all anchors of a key, come with it.
    """
    keys = as_list(keys)
    width = max(length, CHUNK_US)
    cols = [c for c in rows.columns if c not in keys and c != ts]
    marks = with_time_halo(found.select(*keys, F.col(ts).alias("_at"), *carry), "_at", length, width)
    data = (rows.withColumn("_chunk", chunk_start(ts, width))
            .withColumn("_at", F.col(ts)).withColumn("_mark", F.lit(None).cast("long"))
            .withColumn("_row", F.lit(True)))
    both = data.unionByName(
        marks.select(*keys, "_chunk", "_at", F.col("_at").alias("_mark"), F.lit(False).alias("_row"), *carry),
        allowMissingColumns=True)
    w = (Window.partitionBy(*keys, "_chunk").orderBy("_at", "_row")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (both.withColumns({name: F.max("_mark").over(w), **{c: F.max(c).over(w) for c in carry}}).filter("_row")
            .select(*keys, ts, *cols, name, *carry))
