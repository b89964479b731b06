"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Rows are whole numbers x, centred as (n x - S) / n with n x - S exact. With the centred rows as
matrix X, every step makes u = X v - b u', takes out what it shares with all earlier u, scales it
to length 1 and makes v from X'u likewise; the lengths form a small bidiagonal matrix whose
singular vectors give the components.

A long vector u is never stored: each is X g for a short g kept with the step, so a task makes its
part of all of them from its rows. One pass over the rows gives all that a step needs: the inner
products of the new u with the earlier ones, its length and X'u. What reaches the driver is a few
numbers per dimension, added up by Spark.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
#: Size from which x would not be a whole number that a double holds.
HUGE = 2.0 ** 42
LONG = 2 ** 63 - 1


def usable(batch: pa.RecordBatch, column: str):
    """(positions, list of entries per row) of rows without null, non-finite or huge entries, grouped by length: {length: (positions, doubles)}."""
    lists = batch.column(column)
    out = {}
    flat = lists.flatten()
    values = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64)  # null becomes nan
    size = np.where(np.asarray(lists.is_null()), -1, np.asarray(lists.value_lengths().fill_null(0)))
    begin = np.r_[0, np.cumsum(np.maximum(size, 0))]
    bad = ~np.isfinite(values) | (np.abs(values) >= HUGE)
    fine = (size > 0) & (np.diff(np.r_[0, np.cumsum(bad)][begin]) == 0)
    for length in np.unique(size[fine]).tolist():
        at = np.flatnonzero(fine & (size == length))
        out[length] = at, values[begin[at][:, None] + np.arange(length)]
    return out


def whole(values: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * values).astype(np.int64) + SHIFT


def _added(df: DataFrame, column: str, schema_of, body) -> dict:
    """Sum over all tasks of the arrays that ``body`` yields, element by element, in Spark: {position: sum}."""
    parts = df.select(column).mapInArrow(body, schema_of)
    return {r["pos"]: r["total"] for r in parts.select(F.posexplode("part").alias("pos", "value")).groupBy("pos").agg(F.sum("value").alias("total")).collect()}


def totals(vectors: DataFrame, column: str = "embedding"):
    """(length, n, S): the length most rows have (ties: the longer), its rows and the exact sum of x per dimension."""
    def body(batches):
        held = {}
        for batch in batches:
            for length, (_, values) in usable(batch, column).items():
                n, sums = held.get(length, (0, 0))
                held[length] = n + len(values), sums + whole(values).astype(object).sum(axis=0)
        if held:
            rows = [(length, n, [str(x) for x in sums]) for length, (n, sums) in held.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.list_(pa.string())))], ["length", "n", "sums"])

    parts = vectors.select(column).mapInArrow(body, "length long, n long, sums array<string>")
    per = (parts.select("length", "n", F.posexplode("sums").alias("pos", "x")).groupBy("length", "pos")
           .agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")))
    most = per.where("pos = 0").orderBy(F.desc("n"), F.desc("length")).first()
    if most is None:
        return 0, 0, []
    sums = {r["pos"]: int(r["x"]) for r in per.where(F.col("length") == most["length"]).collect()}
    return most["length"], most["n"], [sums[i] for i in range(most["length"])]


class Rows:
    """The centred rows of a table of vectors, read anew in every pass."""

    def __init__(self, vectors: DataFrame, column: str = "embedding"):
        self.vectors, self.column = vectors, column
        self.length, self.n, self.sums = totals(vectors, column)

    def exact(self):
        """Function of a batch of x to n x - S, as long where that fits and as Python numbers beyond."""
        n, sums = self.n, self.sums
        limit = LONG // max(n, 1)

        def run(x):
            if max(int(np.abs(x).max()), 1) <= limit and max(map(abs, sums)) <= LONG // 2 and n * int(np.abs(x).max()) <= LONG // 2:
                return x * n - np.array(sums, np.int64)
            return x.astype(object) * n - np.array(sums, object)
        return run

    def batches(self):
        """Function of a batch to (positions, n x - S, centred rows)."""
        exact, length, n, column = self.exact(), self.length, self.n, self.column

        def run(batch):
            found = usable(batch, column).get(length)
            if found is None:
                return None
            far = exact(whole(found[1]))
            return found[0], far, far.astype(np.float64) / n
        return run

    def summed(self, share) -> np.ndarray:
        """``share(centred rows)`` added up over all rows; it gives an array whose size doesn't depend on the rows."""
        made = self.batches()

        def body(batches):
            total = 0
            for batch in batches:
                rows = made(batch)
                if rows is not None:
                    total = total + share(rows[2])
            if not np.isscalar(total):
                yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["part"])

        found = _added(self.vectors, self.column, "part array<double>", body)
        return np.array([found[i] for i in range(len(found))])


def bidiagonal(rows: Rows, wanted: int, seed: int = 7):
    """(values, components, trace): the ``wanted`` greatest eigenvalues of X'X with unit eigenvectors as columns, and its trace.

    Stops once the wanted triplets have converged to rounding and what the steps have not yet found
    of the trace is less than the least of them, so that no hidden equal or larger one is missed;
    at the latest after as many steps as there are dimensions.
    """
    d, rng = rows.length, np.random.default_rng(seed)
    V, G, W, upper, diagonal = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0)), [], []

    def fresh(v):
        """v less its parts along the known directions, at length 1; a random new direction where nothing is left."""
        size = np.linalg.norm(v)
        for _ in range(2):
            v = v - V @ (V.T @ v)
        left = np.linalg.norm(v)
        if left > 1e-13 * max(size, scale):
            return v / left, left
        v = rng.normal(size=d)
        for _ in range(3):
            v = v - V @ (V.T @ v)
            v = v / np.linalg.norm(v)
        return v, 0.0

    scale, trace, after = 0.0, None, 0.0
    v, _ = fresh(rng.normal(size=d))
    while True:
        g, before = v - (after * G[:, -1] if G.shape[1] else 0), G
        for turn in range(3):
            def share(x, g=g, before=before):
                u, old = x @ g, x @ before
                return np.concatenate([old.T @ u, x.T @ u, [u @ u, (x * x).sum()]])
            got = rows.summed(share)
            k = before.shape[1]
            along, product, square = got[:k], got[k:k + d], got[k + d]
            trace = got[k + d + 1]
            rest = square - along @ along
            g = g - before @ along
            if rest >= 0.5 * square or square <= 1e-26 * trace:
                break
        product = product - W @ along
        length = math.sqrt(max(rest, 0.0))
        scale = math.sqrt(trace)
        if length <= 1e-13 * scale:  # X v lies within the earlier u: an empty row of the bidiagonal matrix
            length, g, product = 0.0, np.zeros(d), np.zeros(d)
        else:
            g, product = g / length, product / length
        V, G, W = np.c_[V, v], np.c_[G, g], np.c_[W, product]
        diagonal.append(length)
        if V.shape[1] < d:
            v, after = fresh(product - length * V[:, -1] if length else rng.normal(size=d))
            after = after if length else 0.0
        else:
            after = 0.0
        small = np.diag(diagonal) + np.diag(upper, 1)
        left, sizes, right = np.linalg.svd(small)
        found = min(wanted, len(sizes))
        loose = after * np.abs(left[-1, :found]).max()
        hidden = trace - float((sizes ** 2).sum())
        done = len(sizes) >= wanted and loose <= 1e-15 * max(sizes[0], 1e-300) and hidden < sizes[found - 1] ** 2
        if V.shape[1] == d or done:
            return sizes[:found] ** 2, V @ right[:found].T, trace
        upper.append(after)


def moments(rows: Rows, project) -> tuple:
    """(n, mean, centred products) of ``project(centred rows)``; batches are centred on their own means and then merged."""
    made = rows.batches()

    def merged(a, b):
        if a is None or b is None:
            return b if a is None else a
        n = a[0] + b[0]
        gap = b[1] - a[1]
        return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)

    def of(values):
        mean = values.mean(axis=0)
        return len(values), mean, (values - mean).T @ (values - mean)

    def packed(state):
        row = ([state[0]], [state[1].tolist()], [state[2].ravel().tolist()])
        return pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), *(pa.array(c, pa.list_(pa.float64())) for c in row[1:])], ["n", "mean", "products"])

    def body(batches):
        state = None
        for batch in batches:
            found = made(batch)
            if found is not None:
                state = merged(state, of(project(found[2])))
        if state is not None:
            yield packed(state)

    def gathered(batches):
        state = None
        for batch in batches:
            for n, mean, products in zip(*(batch.column(c).to_pylist() for c in ("n", "mean", "products"))):
                state = merged(state, (n, np.array(mean), np.array(products).reshape(len(mean), len(mean))))
        if state is not None:
            yield packed(state)

    schema = "n long, mean array<double>, products array<double>"
    parts = rows.vectors.select(rows.column).mapInArrow(body, schema)
    state = None
    for r in parts.repartition(16).mapInArrow(gathered, schema).collect():
        state = merged(state, (r["n"], np.array(r["mean"]), np.array(r["products"]).reshape(len(r["mean"]), len(r["mean"]))))
    return state


def whitened(vectors: DataFrame, components: int = 8, column: str = "embedding") -> DataFrame:
    """Whitened coordinates of every usable vector: a row per vector and component.

    Columns: vec_id, component (from 1, by falling variance), n (rows of the fit list), deviation (sum
    over dimensions of (n x - S)^2, exact; null beyond a long), whitened, explained, identity_error.
    Entries c count as x = floor(1024 c) + 100000. All usable rows are the fit list: rows whose vector
    is null, empty, or holds null, non-finite or huge (2^42 and more) entries are left out, and so are
    vectors whose length is not that of most rows (ties: the longer). Components without variance
    can't be scaled and are left out too, so a single row, equal rows and an empty table give no
    rows. Rows that repeat a vec_id or have none are rows of their own. Extra columns are ignored.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = Rows(vectors, column)
    nothing = vectors.sparkSession.createDataFrame([], schema)
    if rows.n < 2:
        return nothing
    values, axes, trace = bidiagonal(rows, min(components, rows.length))
    live = values > 1e-20 * trace if trace > 0 else values > 0
    values, axes = values[live] / rows.n, axes[:, live]
    if not len(values):
        return nothing
    for j in range(axes.shape[1]):  # either sign is right; take the one with a positive largest entry
        axes[:, j] *= np.sign(axes[np.abs(axes[:, j]).argmax(), j])
    scaled = axes / np.sqrt(values)
    n, _, products = moments(rows, lambda x: x @ scaled)
    error = float(np.abs(products / n - np.eye(len(values))).max())
    share = values / (trace / rows.n)
    made, fields = rows.batches(), [(f.split()[0], {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[f.split()[1]]) for f in schema.split(", ")]
    count, total = len(values), rows.n

    def far(differences):
        """Exact sums of squares; in long where no sum can pass it."""
        if differences.dtype != object and int(np.abs(differences).max(initial=0)) ** 2 * differences.shape[1] <= LONG:
            return pa.array((differences * differences).sum(axis=1))
        return pa.array([x if x <= LONG else None for x in (differences.astype(object) ** 2).sum(axis=1).tolist()], pa.int64())

    def body(batches):
        for batch in batches:
            found = made(batch)
            if found is None:
                continue
            at, differences, centred = found
            ids = batch.column("vec_id").take(pa.array(at))
            every = pa.array(np.repeat(np.arange(len(at)), count))
            columns = [ids.take(every), pa.array(np.tile(np.arange(1, count + 1), len(at))), pa.array(np.full(len(every), total)), far(differences).take(every),
                       pa.array((centred @ scaled).ravel()), pa.array(np.tile(share, len(at))), pa.array(np.full(len(every), error))]
            yield pa.RecordBatch.from_arrays([c.cast(k) for c, (_, k) in zip(columns, fields)], [name for name, _ in fields])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), column).mapInArrow(body, schema)
