"""Whitening of embeddings: leading principal components, scaled to unit variance.

Sums, covariance and projection are passes over all vectors; between them only the covariance matrix, whose size is that
of one vector squared, comes to the driver. It is solved there: Householder reflections make it tridiagonal, Sturm
counts bisect for the leading eigenvalues, inverse iteration gives their vectors, which are made orthogonal within
clusters of close eigenvalues, and the reflections carry them back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaops.session import materialise

COMPONENTS = 8
#: Longest vectors taken; their covariance is 32 MB.
WIDEST = 2048
#: An eigenvalue of a smaller share of the trace is not told from zero, and its direction can't be whitened.
LEAST_SHARE = 1e-11
#: Each entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000


def tridiagonal(matrix):
    """``(diagonal, off, reflectors)`` of a symmetric matrix, by Householder reflections."""
    import numpy as np

    a = np.array(matrix, np.float64)
    n = len(a)
    off, reflectors = np.zeros(max(0, n - 1)), []
    for k in range(n - 2):
        x = a[k + 1:, k].copy()
        size = np.linalg.norm(x)
        if np.linalg.norm(x[1:]) == 0:
            off[k] = x[0]
            reflectors.append(None)
            continue
        lead = -size if x[0] > 0 else size
        x[0] -= lead
        v = x / np.linalg.norm(x)
        rest = a[k + 1:, k + 1:]
        p = rest @ v
        w = 2 * (p - (v @ p) * v)
        rest -= np.outer(v, w) + np.outer(w, v)
        off[k] = lead
        reflectors.append(v)
    if n > 1:
        off[n - 2] = a[n - 1, n - 2]
    return a.diagonal().copy(), off, reflectors


def carry_back(reflectors, vector):
    """A vector of the tridiagonal matrix in the coordinates of the first one."""
    out = vector.copy()
    for k in range(len(reflectors) - 1, -1, -1):
        v = reflectors[k]
        if v is not None:
            out[k + 1:] -= 2 * (v @ out[k + 1:]) * v
    return out


def counts_below(diagonal, off, points):
    """How many eigenvalues of the tridiagonal matrix lie below each point: the negative terms of the Sturm sequence."""
    import numpy as np

    floor = np.finfo(np.float64).tiny ** 0.5 * max(1.0, float(np.abs(off).max(initial=0)))
    q = diagonal[0] - points
    below = (q < 0).astype(np.int64)
    for i in range(1, len(diagonal)):
        q = np.where(np.abs(q) < floor, -floor, q)
        q = diagonal[i] - points - off[i - 1] ** 2 / q
        below += q < 0
    return below


def leading_values(diagonal, off, k: int):
    """The ``k`` largest eigenvalues, falling, bisected to the last bit."""
    import numpy as np

    n = len(diagonal)
    radius = np.zeros(n)
    radius[:-1] += np.abs(off)
    radius[1:] += np.abs(off)
    low = np.full(k, (diagonal - radius).min())
    high = np.full(k, (diagonal + radius).max())
    span = max(float(np.abs(low).max()), float(np.abs(high).max()), np.finfo(np.float64).tiny)
    low, high = low - 1e-12 * span, high + 1e-12 * span
    wanted = n - 1 - np.arange(k)  # eigenvalues below the j-th largest one
    while True:
        middle = (low + high) / 2
        if not ((low < middle) & (middle < high)).any():
            return middle
        above = counts_below(diagonal, off, middle) > wanted
        low, high = np.where(above, low, middle), np.where(above, middle, high)


def _solved(diagonal, off, value: float, right):
    """Solves (T - value) x = right by elimination with row exchanges; tiny pivots are set to a tiny number."""
    import numpy as np

    n = len(diagonal)
    d, u, u2 = (diagonal - value).tolist(), off.tolist() + [0.0], [0.0] * n
    b, low = right.tolist(), off.tolist()
    tiny = np.finfo(np.float64).eps * max(float(np.abs(diagonal).max()), float(np.abs(off).max(initial=0)), np.finfo(np.float64).tiny)
    for i in range(n - 1):
        if abs(low[i]) > abs(d[i]):
            d[i], low_i = low[i], d[i]
            u[i], d[i + 1] = d[i + 1], u[i]
            u2[i], u[i + 1] = u[i + 1], 0.0
            b[i], b[i + 1] = b[i + 1], b[i]
        else:
            low_i = low[i]
        if abs(d[i]) < tiny:
            d[i] = tiny
        f = low_i / d[i]
        d[i + 1] -= f * u[i]
        u[i + 1] -= f * u2[i]
        b[i + 1] -= f * b[i]
    if abs(d[-1]) < tiny:
        d[-1] = tiny
    x = [0.0] * n
    for i in range(n - 1, -1, -1):
        rest = b[i] - (u[i] * x[i + 1] if i + 1 < n else 0.0) - (u2[i] * x[i + 2] if i + 2 < n else 0.0)
        x[i] = rest / d[i]
        if abs(x[i]) > 1e150:  # the direction is all that counts
            x[i:] = [e * 1e-150 for e in x[i:]]
            b[:i] = [e * 1e-150 for e in b[:i]]
    return np.array(x)


def vectors_of(diagonal, off, values, rounds: int = 5):
    """Unit eigenvectors of the tridiagonal matrix for eigenvalues that fall. Those closer than a thousandth of its norm to the
    one before form a cluster, within which every step is made orthogonal to the vectors already there."""
    import numpy as np

    draw = np.random.default_rng(12)
    norm = float(np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0))
    found, cluster = [], []
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * norm:
            cluster = []
        x = draw.standard_normal(len(diagonal))
        for _ in range(rounds):
            for _ in range(2):
                for other in cluster:
                    x -= (other @ x) * other
            x /= np.linalg.norm(x)
            x = _solved(diagonal, off, float(value), x)
            x /= np.abs(x).max()
        for _ in range(2):
            for other in cluster:
                x -= (other @ x) * other
        x /= np.linalg.norm(x)
        found.append(x)
        cluster.append(x)
    return found


def leading_pairs(matrix, k: int):
    """``(values, vectors)``: the ``k`` leading eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns, the
    largest entry of each positive."""
    import numpy as np

    k = min(k, len(matrix))
    if not np.any(matrix):
        return np.zeros(k), np.eye(len(matrix), k)
    diagonal, off, reflectors = tridiagonal(matrix)
    values = leading_values(diagonal, off, k)
    columns = []
    for x in vectors_of(diagonal, off, values):
        v = carry_back(reflectors, x)
        columns.append(v if v[np.abs(v).argmax()] > 0 else -v)
    return values, np.stack(columns, axis=1)


@dataclass
class Whitening:
    """What the fit found: row count, exact sums per dimension, leading eigenvalues, eigenvectors as columns, trace."""

    n: int
    sums: list[int]
    values: object
    vectors: object
    trace: float


def taking_part(vector: str) -> Column:
    """Vectors that are there and hold neither null nor non-finite entries."""
    c = F.col(f"`{vector}`").cast("array<double>")
    return c.isNotNull() & F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))


def _whole(lists, width: int):
    """The integers x of one Arrow column of vectors, as a matrix."""
    import numpy as np

    flat = np.asarray(lists.flatten(), np.float64)
    return np.floor(SCALE * flat).astype(np.int64).reshape(-1, width) + SHIFT


def _deviations(x, n: int, sums):
    """n * x - S, exact: in 64 bits where they suffice, else in whole numbers of any length."""
    import numpy as np

    most = n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, sums), default=0)
    if most < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Whitening]:
    """``(rows, model)``: the rows of ``df`` that take part, and the whitening fitted on all of them."""
    import numpy as np

    good = df.where(taking_part(vector))
    sizes = good.groupBy(F.size(F.col(f"`{vector}`")).alias("w")).count()
    most = sizes.orderBy(F.desc("count"), F.desc("w")).first()
    width, n = (most[0], most[1]) if most else (0, 0)
    if width > WIDEST:
        raise ValueError(f"vectors of {width} entries; at most {WIDEST} are taken")
    rows = good.where(F.size(F.col(f"`{vector}`")) == width)
    if not width:
        return rows.limit(0), Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    only = rows.select(F.col(f"`{vector}`").alias("v"))

    def add_up(batches):
        import pyarrow as pa

        total = np.zeros(width, object)
        for batch in batches:
            total = total + _whole(batch.column(0), width).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_pydict({"i": np.arange(width, dtype=np.int32), "s": [int(s) for s in total]}, pa.schema(
            [("i", pa.int32()), ("s", pa.int64())]))

    sums = [0] * width
    for i, s in only.mapInArrow(add_up, "i int, s long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)"))).collect():
        sums[i] = int(s)
    upper = np.triu_indices(width)

    def multiply(batches):
        import pyarrow as pa

        total = np.zeros((width, width))
        for batch in batches:
            x = _whole(batch.column(0), width)
            for at in range(0, len(x), 4096):
                centred = (_deviations(x[at:at + 4096], n, sums) / n).astype(np.float64)
                total += centred.T @ centred
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]), dtype=np.int32)), pa.array(total[upper])], names=["cell", "v"])

    covariance = np.zeros((width, width))
    for cell, v in only.mapInArrow(multiply, "cell int, v double").groupBy("cell").agg(F.sum("v")).collect():
        i, j = upper[0][cell], upper[1][cell]
        covariance[i, j] = covariance[j, i] = v / n
    values, vectors = leading_pairs(covariance, components)
    trace = float(covariance.trace())
    kept = int((values > LEAST_SHARE * trace).sum()) if trace > 0 else 0
    return rows, Whitening(n, sums, values[:kept], vectors[:, :kept], trace)


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error`` for every row that takes part and every
    component, numbered from 1 by falling eigenvalue.

    Rows whose vector is null or holds null or non-finite entries are left out; so are vectors of another length than the most
    frequent one (of equally frequent lengths the longest). ``deviation`` is the exact sum of (n*x - S)^2, a decimal. Equal
    rows are rows of their own; null keys stay. A component exists if its eigenvalue is over ``LEAST_SHARE`` of the trace:
    one row, rows that are all equal, empty vectors and an empty table give no rows. Other columns are not read.
    """
    import numpy as np

    rows, model = fit(df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("v")), "v", components)
    width, k = len(model.sums), len(model.values)
    kind = rows.schema["key"].dataType.simpleString()
    scaled = model.vectors / np.sqrt(model.values)
    shared = rows.sparkSession.sparkContext.broadcast((model.n, model.sums, scaled))

    def project(batches):
        from decimal import Decimal

        import pyarrow as pa

        n, sums, directions = shared.value
        for batch in batches:
            d = _deviations(_whole(batch.column(1), width), n, sums)
            white = (d / n).astype(np.float64) @ directions
            most = int(np.abs(d).max(initial=0))
            squares = (d if most * most * width < 1 << 62 else d.astype(object))
            exact = [Decimal(int(s)) for s in (squares * squares).sum(axis=1)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1, dtype=np.int32) * k), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(exact, pa.decimal128(38, 0)), lists], names=["key", "deviation", "w"])

    if not k:
        projected, error = rows.limit(0).select("key", F.lit(0).cast("decimal(38,0)").alias("deviation"), F.array(F.lit(0.0)).alias("w")), None
    else:
        projected = materialise(rows.mapInArrow(project, f"key {kind}, deviation decimal(38,0), w array<double>"), "whitened")
        error = _identity_error(projected, k)
    explained = F.array(*(F.lit(float(e / model.trace)) for e in model.values)) if k else F.array(F.lit(0.0))
    return projected.select("key", "deviation", F.posexplode("w").alias("i", "whitened")).select(
        F.col("key").alias(key), (F.col("i") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("i") + 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def _identity_error(projected: DataFrame, k: int) -> float:
    """The largest absolute entry of the covariance of ``w`` minus the identity: one pass for the means, one for the products."""
    means = projected.agg(*(F.avg(F.col("w")[i]) for i in range(k))).first()
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    centred = [F.col("w")[i] - F.lit(float(means[i])) for i in range(k)]
    found = projected.agg(*(F.avg(centred[i] * centred[j]) for i, j in cells)).first()
    return max(abs(v - (i == j)) for (i, j), v in zip(cells, found))
