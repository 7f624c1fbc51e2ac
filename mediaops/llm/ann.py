"""Nearest neighbours by inner product with an inverted multi-index.

Vectors are cut into two halves; each half has its own codebook, and a pair of centroids is a cell. A query visits
cells in the order of their summed distance, which a heap over the two sorted lists of centroids yields, until the
visited cells hold a set share of all rows; those rows are ranked again on the original vectors.

The codebooks are fitted on a bounded sample, and on it the share is found that reaches the wanted recall against brute
force. Every row is indexed. Cells are packed into bins of bounded size (a large cell is dealt over several), and queries
meet a bin in bounded blocks. Rows of the sample that a query visits tell a score that all its neighbours have at least, so
that few rows of a bin need more than a matrix product.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from mediaops.llm.common import add_columns
from mediaops.session import materialise

NEIGHBOURS = 20
#: Rows that codebooks and visited share are fitted on.
FIT_ROWS = 8192
FIT_QUERIES = 400
#: Recall that the visited share is chosen for, above the 0.9 that is promised.
RECALL = 0.96
#: Rows of a bin, and queries that meet a bin in one group.
BIN_ROWS = 8192
QUERY_ROWS = 2048
#: Queries that are scored at once within a group.
TILE = 64
#: Of the product of two lengths: more than the error of an inner product of vectors that long.
SLACK = 1e-9


@dataclass
class MultiIndex:
    """``books``: the centroids of either half; ``share``: the part of all rows that a query visits."""

    books: tuple
    share: float

    @property
    def width(self) -> int:
        return sum(book.shape[1] for book in self.books)

    def distances(self, vectors):
        """Of each vector's halves to the centroids, as negated inner products: two arrays, a row per vector."""
        cut = self.books[0].shape[1]
        return -(vectors[:, :cut] @ self.books[0].T), -(vectors[:, cut:] @ self.books[1].T)

    def cells(self, vectors):
        """The cell of each vector: the nearest centroid of either half."""
        cut = self.books[0].shape[1]
        first, second = (nearest(v, b) for v, b in ((vectors[:, :cut], self.books[0]), (vectors[:, cut:], self.books[1])))
        return first * len(self.books[1]) + second


def nearest(points, centroids):
    import numpy as np

    return np.argmin((centroids ** 2).sum(1) - 2 * points @ centroids.T, axis=1)


def traverse(first, second, counts, wanted: int) -> tuple[list[int], float]:
    """Cells of one query by growing summed distance until they hold ``wanted`` rows, and the last such sum.

    ``first`` and ``second`` are the distances of the halves to their centroids, ``counts`` the rows per cell. The heap
    holds one open pair per rank of the first half at most.
    """
    from heapq import heappop, heappush, heapreplace

    a, b = first.argsort(kind="stable"), second.argsort(kind="stable")
    x, y, starts, ends = first[a].tolist(), second[b].tolist(), (a * len(b)).tolist(), b.tolist()
    heap, cells, have, last = [(x[0] + y[0], 0, 0)], [], 0, float("-inf")
    while heap and have < wanted:
        last, i, j = heap[0]
        cell = starts[i] + ends[j]
        if counts[cell]:
            cells.append(cell)
            have += counts[cell]
        if j + 1 < len(y):
            heapreplace(heap, (x[i] + y[j + 1], i, j + 1))
        else:
            heappop(heap)
        if not j and i + 1 < len(x):
            heappush(heap, (x[i + 1] + y[0], i + 1, 0))
    return cells, last


def codebook(points, size: int, rounds: int = 12):
    """Centroids by Lloyd's rounds from evenly spaced starting points; no empty ones are kept."""
    import numpy as np

    distinct = np.unique(points, axis=0)
    centroids = distinct[np.linspace(0, len(distinct) - 1, min(size, len(distinct))).astype(int)]
    for _ in range(rounds):
        own = nearest(points, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, points)
        n = np.bincount(own, minlength=len(centroids))
        centroids = sums[n > 0] / n[n > 0, None]
    return centroids


def fit_index(sample, rows: int, neighbours: int = NEIGHBOURS, recall: float = RECALL) -> MultiIndex:
    """Fits on a sample of vectors (two-dimensional array) for a table of so many rows."""
    import numpy as np

    size = int(min(256, max(4, 2 ** int(np.log2(4 * max(rows, 1) ** 0.25)))))
    cut = max(1, sample.shape[1] // 2)
    index = MultiIndex((codebook(sample[:, :cut], size), codebook(sample[:, cut:], size)), 1.0)
    asked = sample[:FIT_QUERIES]
    cells = index.cells(sample)
    first, second = index.distances(asked)
    ranks = []
    for q in range(len(asked)):
        scores = sample @ asked[q]
        scores[q] = -np.inf
        best = np.argsort(-scores, kind="stable")[:min(neighbours, len(sample) - 1)]
        sums = (first[q][:, None] + second[q][None, :]).ravel()[cells]
        ranks += [float((sums <= s).mean()) for s in sums[best]]
    index.share = float(np.quantile(ranks, recall)) if ranks else 1.0
    return index


def usable(vector: Column) -> Column:
    """Neither null, empty or zero, nor with null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0)


def search(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", neighbours: int = NEIGHBOURS) -> DataFrame:
    """``query_id, rank, key, score`` of the ``neighbours`` nearest rows found for every row where ``is_query`` holds.

    Nearest is the largest inner product in double precision, ties go to the smaller key; rows with the query's own key
    are no candidates. Rows with a null key or an unusable vector take no part, nor do vectors whose length is not
    that of most sampled ones. Of query rows that share a key, the one with the smallest vector asks. With fewer
    candidates than ``neighbours`` all are returned; without any there are no rows.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    narrow = df.schema[vector].dataType.simpleString() == "array<float>"  # half the bytes, widened where it is reckoned with
    named = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<float>" if narrow else "array<double>").alias("v"), is_query.alias("asks")).where(F.col("key").isNotNull() & usable(F.col("v")))
    empty = spark.createDataFrame([], f"query_id {kind}, rank int, `{key}` {kind}, score double")

    n = named.count()
    keep = min(1.0, 2 * FIT_ROWS / max(n, 1))
    draw = F.pmod(F.xxhash64("key"), F.lit(1 << 30))
    sample = named.where(draw < int(keep * (1 << 30))).select(draw.alias("d"), "key", "v").orderBy("d", "key").limit(FIT_ROWS).collect()
    if not sample:
        return empty
    import numpy as np

    lengths = [len(r.v) for r in sample]
    width = max(set(lengths), key=lambda x: (lengths.count(x), x))
    known, known_keys = np.array([r.v for r in sample if len(r.v) == width]), np.array([r.key for r in sample if len(r.v) == width])
    index = fit_index(known, n, neighbours)
    tasks = min(4 * spark.sparkContext.defaultParallelism, 1 + n // 1000)
    shared = spark.sparkContext.broadcast(index)  # two codebooks of 256 centroids at most

    def to_cells(vectors):
        import pyarrow as pa

        return [pa.array(shared.value.cells(doubles(vectors, shared.value.width)), pa.int32())]

    rows = materialise(add_columns(named.where(F.size("v") == width), ["v"], "cell int", to_cells), "cells")
    # one count per cell: 256 * 256 at most
    counts = np.zeros(len(index.books[0]) * len(index.books[1]), np.int64)
    for row in rows.groupBy("cell").count().collect():
        counts[row["cell"]] = row["count"]
    parts = np.maximum(1, -(-counts // BIN_ROWS))  # of a cell that is larger than a bin
    bins, bin_now, held = np.zeros(len(counts), np.int64), -1, BIN_ROWS + 1
    for cell in np.flatnonzero(counts):
        if parts[cell] > 1 or held + counts[cell] > BIN_ROWS:
            bin_now, held = bin_now + 1, 0
        bins[cell] = bin_now
        held += counts[cell]
        if parts[cell] > 1:
            bin_now, held = bin_now + int(parts[cell]) - 1, BIN_ROWS + 1
    plan = spark.sparkContext.broadcast((counts, bins, parts, int(np.ceil(index.share * counts.sum()))))
    drawn = spark.sparkContext.broadcast((known, known_keys, index.cells(known)))  # FIT_ROWS vectors at most

    def to_bins(cells, draws):
        import pyarrow as pa

        _, bins, parts, _ = plan.value
        at = np.asarray(cells)
        return [pa.array(bins[at] + np.asarray(draws) % parts[at], pa.int64())]

    placed = add_columns(rows.select("key", "v", "cell", F.pmod(F.xxhash64("key"), F.lit(1 << 30)).alias("d")), ["cell", "d"], "bin long", to_bins)
    asked = rows.where("asks").repartition(tasks, "key").groupBy("key").agg(F.min("v").alias("v"))

    def to_visits(batches):
        import pyarrow as pa

        counts, bins, parts, wanted = plan.value
        listed = counts.tolist()
        for batch in filter(len, batches):
            vectors = doubles(batch.column("v"), shared.value.width)
            first, second = shared.value.distances(vectors)
            where, last = [], []
            for q in range(len(vectors)):
                cells, end = traverse(first[q], second[q], listed, wanted)
                where.append(np.unique(np.repeat(bins[cells], parts[cells]) + steps(parts[cells])))
                last.append(end)
            ends = np.cumsum([0, *map(len, where)])
            least = floor(vectors, np.asarray(batch.column("key")), first, second, np.array(last), *drawn.value, neighbours)
            reached = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(where), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("v"), reached, pa.array(last, pa.float64()), pa.array(least, pa.float64())],
                                             names=["query", "q", "bins", "last", "least"])

    visits = materialise(asked.mapInArrow(to_visits, f"query {kind}, q {rows.schema['v'].dataType.simpleString()}, bins array<long>, last double, least double"), "visits")
    blocks = visits.select(F.explode("bins").alias("bin")).groupBy("bin").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks"))
    asking = visits.select("query", "q", "last", "least", F.explode("bins").alias("bin")).join(blocks, "bin").withColumn(
        "block", F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int"))
    offered = placed.join(blocks, "bin").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    schema = T.StructType.fromDDL(f"query {kind}, key {kind}, score double")

    def meet(asking, offered):
        import pyarrow as pa

        found = [[], [], []]
        if asking.num_rows and offered.num_rows:
            found = rank(shared.value, asking, offered, neighbours)
        return pa.table([pa.array(found[0], asking["query"].type), pa.array(found[1], asking["query"].type), pa.array(found[2], pa.float64())],
                        names=["query", "key", "score"])

    # many tasks, as a group costs the same however few bytes it has
    near = asking.select("query", "q", "last", "least", "bin", "block").repartition(tasks, "bin", "block").groupBy("bin", "block").cogroup(
        offered.select("key", "v", "cell", "bin", "block").repartition(tasks, "bin", "block").groupBy("bin", "block")).applyInArrow(meet, schema)
    order = W.partitionBy("query").orderBy(F.desc("score"), "key")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= neighbours).select(
        F.col("query").alias("query_id"), "rank", F.col("key").alias(key), "score")


def doubles(vectors, width: int):
    """An Arrow column of vectors as a two-dimensional array of doubles."""
    import numpy as np

    return np.asarray(vectors.flatten()).astype(np.float64, copy=False).reshape(-1, width)


def steps(parts):
    """0, 1, .. below each of ``parts`` in turn."""
    import numpy as np

    return np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)


def floor(q, queries, first, second, last, known, keys, cells, neighbours: int):
    """A score that the last neighbour of each query has at least: that of its last neighbour among the known rows in the cells it visits."""
    import numpy as np

    least = np.full(len(q), -np.inf)
    if len(known) < neighbours:
        return least
    for at in range(0, len(q), TILE):
        part = slice(at, at + TILE)
        scores = q[part] @ known.T
        scores[(sums_of(first[part], second[part], cells) >= last[part, None]) | (keys == queries[part, None])] = -np.inf
        least[part] = np.partition(scores, len(keys) - neighbours, axis=1)[:, -neighbours]
    return least - SLACK * lengths(q) * lengths(known).max()


def lengths(vectors):
    return (vectors ** 2).sum(1) ** 0.5


def sums_of(first, second, cells):
    """The summed distance of each query to each of the cells."""
    return first[:, cells // second.shape[1]] + second[:, cells % second.shape[1]]


def rank(index: MultiIndex, asking, offered, neighbours: int):
    """The best of one bin for each query, over the cells it visits: queries, keys, scores.

    Some queries at a time are scored against the whole bin by one matrix product. Rows below what the last neighbour has
    at least go, and those left are scored again, exactly.
    """
    import numpy as np

    q, v = doubles(asking["q"].combine_chunks(), index.width), doubles(offered["v"].combine_chunks(), index.width)
    queries, keys = np.asarray(asking["query"]), np.asarray(offered["key"])
    last, least = np.asarray(asking["last"]), np.asarray(asking["least"])
    cells, cell_of = np.unique(np.asarray(offered["cell"]), return_inverse=True)
    first, second = index.distances(q)
    slack, columns = SLACK * lengths(q) * lengths(v).max(), np.ascontiguousarray(v.T)
    found = []
    for at in range(0, len(q), TILE):
        part = slice(at, at + TILE)
        visited = sums_of(first[part], second[part], cells) <= (last[part] + 1e-12 * (1 + abs(last[part])))[:, None]
        rough = q[part] @ columns
        kept = (rough >= least[part, None]) & visited[:, cell_of] & (keys != queries[part, None])
        of, row = np.divmod(np.flatnonzero(kept), len(v))
        many = np.flatnonzero(np.bincount(of) > 4 * neighbours)
        if len(many):
            scores = np.where(kept[many], rough[many], -np.inf)
            enough = np.partition(scores, len(v) - neighbours, axis=1)[:, -neighbours] - slack[part][many]
            kept[many] &= scores >= enough[:, None]
            of, row = np.divmod(np.flatnonzero(kept), len(v))
        score, asked = np.zeros(len(of)), np.ascontiguousarray(q[part].T)
        for d in range(index.width):  # one component after the other, so that equal vectors have equal scores everywhere
            score += asked[d].take(of) * columns[d].take(row)
        order = np.lexsort((keys[row], -score, of))
        of, row, score = of[order], row[order], score[order]
        best = np.arange(len(of)) - np.searchsorted(of, of) < neighbours
        found.append((queries[part][of[best]], keys[row[best]], score[best]))
    return [np.concatenate(x) for x in zip(*found)]
