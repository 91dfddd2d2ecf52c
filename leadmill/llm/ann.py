"""Approximate nearest neighbours with an inverted multi-index.

A vector is cut in two halves and each half is quantised by its own centroids; a
cell of the index is a pair of centroids.  A query walks the pairs in the order
of their summed distance with a heap, until the cells hold enough entries, and
the entries are reranked by the exact measure.  The measure is the inner product,
so the distance of a centroid is the negated inner product with its half.

Equal vectors are one entry with the smallest of their ids, as many as can ever
be answers, which is exact since ties go to the smaller id.  Entries of a row of
cells and the queries that visit it meet in blocks of bounded size, so no task
grows with the table.  Centroids are fitted on a sample of at most *sample_rows*
entries; cell sizes are a table of *centroids* squared numbers.  Only those two
go through the driver.

Defined results: vectors that are null, zero, or hold a null or non-finite
component take no part, nor do rows with a null id, nor vectors whose length is
not the most common one (of equals the longest); of several rows with one id the
smallest vector counts; a query with fewer candidates gets all of them; other
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadmill import storage

CENTROIDS = 32
SAMPLE_ROWS = 16_384
#: Part of all entries that a query visits, at every size of the table.
PROBE_SHARE = 0.65
BLOCK_ROWS = 4_096
_ROUNDS = 8


def fit(sample: np.ndarray, centroids: int = CENTROIDS) -> np.ndarray:
    """Centroids of a sample, by Lloyd's iterations from evenly spread rows."""
    k = min(centroids, len(sample))
    found = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(_ROUNDS):
        nearest = assign(sample, found)
        for i in range(k):
            own = sample[nearest == i]
            if len(own):
                found[i] = own.mean(axis=0)
    return found


def assign(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(axis=1)[None] - 2 * rows @ centroids.T, axis=1)


def visited_cells(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, enough: float) -> list[tuple[int, int]]:
    """Cells by summed distance of their two centroids, until they hold *enough* entries.

    The heap holds the frontier of the two sorted lists of distances.
    """
    by_first, by_second = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist()
    a, b = np.sort(first).tolist(), np.sort(second).tolist()
    count = sizes.tolist()
    heap, met, held, out = [(a[0] + b[0], 0, 0)], [0] * len(a), 0, []
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = (by_first[i], by_second[j])
        met[i] = j + 1
        if n := count[cell[0]][cell[1]]:
            held += n
            out.append(cell)
        if j + 1 < len(b) and (i == 0 or met[i - 1] > j + 1):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if i + 1 < len(a) and met[i + 1] == j:
            heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
    return out


def _matrix(column, dim: int) -> np.ndarray:
    chunk = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return chunk.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v`` of the vectors that take part."""
    v = F.col("v")
    good = (
        F.col("vec_id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
        .filter(good).groupBy("vec_id").agg(F.min("v").alias("v"))
    )


def search(vectors: DataFrame, is_query: Column, *, k: int = 20, id_col: str = "vec_id",
           vector_col: str = "embedding", centroids: int = CENTROIDS, sample_rows: int = SAMPLE_ROWS,
           probe_share: float = PROBE_SHARE) -> DataFrame:
    """The *k* nearest rows of each row with *is_query* (a condition on ``vec_id``).

    A query visits cells until they hold *probe_share* of the entries, *k* + 1 at least;
    1 visits all and is exact.
    Returns ``query_id, rank, vec_id, score``; nearest first, ties to the smaller id.
    """
    if not 0 < centroids < 63:
        raise ValueError("a visit names the cells of a row in the bits of one number: 1 to 62 centroids")
    rows = storage.materialize(usable(vectors, id_col, vector_col), "vectors")
    width = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    dim = width["n"] if width else 2
    rows = rows.filter(F.size("v") == dim)

    # Equal vectors as one entry with its k + 1 smallest ids (one may be the query).
    place = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    entries = rows.select("v", "vec_id", place.alias("place")).filter(F.col("place") <= k + 1).groupBy("v").agg(
        F.sort_array(F.collect_list("vec_id")).alias("ids")
    )
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("v").toArrow()
    half = dim // 2
    fitted = _matrix(sample.column("v"), dim) if sample.num_rows else np.zeros((1, dim))
    books = (fit(fitted[:, :half], centroids), fit(fitted[:, half:], centroids))

    def to_cells(batches):
        for batch in batches:
            v = _matrix(batch.column(0), dim)
            cells = [pa.array(assign(part, book), pa.int32()) for part, book in zip((v[:, :half], v[:, half:]), books)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cells], names=["v", "ids", "c1", "c2"])

    indexed = storage.materialize(
        entries.mapInArrow(to_cells, "v array<double>, ids array<bigint>, c1 int, c2 int"), "index"
    )
    sizes = np.zeros((len(books[0]), len(books[1])), np.int64)
    for c1, c2, n in indexed.groupBy("c1", "c2").count().collect():
        sizes[c1, c2] = n
    enough = max(k + 1, probe_share * sizes.sum())  # k answers, and the query itself

    def walk(batches):
        for batch in batches:
            out = ([], [], [])
            v = _matrix(batch.column(1), dim)
            near = (-v[:, :half] @ books[0].T, -v[:, half:] @ books[1].T)
            for at in range(batch.num_rows):
                mask: dict[int, int] = {}
                for c1, c2 in visited_cells(near[0][at], near[1][at], sizes, enough):
                    mask[c1] = mask.get(c1, 0) | 1 << c2
                out[0].extend([at] * len(mask))
                out[1].extend(mask)
                out[2].extend(mask.values())
            ids, vs = batch.column(0).take(pa.array(out[0], pa.int64())), batch.column(1).take(pa.array(out[0], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, vs, pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64())],
                names=["query_id", "q", "c1", "mask"],
            )

    queries = rows.filter(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    query_blocks = -(-queries.count() // BLOCK_ROWS)
    row_blocks = [max(1, -(-int(n) // BLOCK_ROWS)) for n in sizes.sum(axis=1)]
    blocks = F.get(F.array(*map(F.lit, row_blocks)), F.col("c1"))
    visits = queries.mapInArrow(walk, "query_id long, q array<double>, c1 int, mask long").select(
        "*", F.pmod(F.xxhash64("query_id"), F.lit(max(1, query_blocks))).alias("qb"),
        F.explode(F.sequence(F.lit(0).cast("long"), (blocks - 1).cast("long"))).alias("eb"),
    )
    held = indexed.select(
        "*", F.pmod(F.xxhash64(F.get("ids", F.lit(0))), blocks).cast("long").alias("eb"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, query_blocks) - 1).cast("long"))).alias("qb"),
    )

    def rerank(asked: pa.Table, there: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if asked.num_rows and there.num_rows:
            q, e = _matrix(asked.column("q"), dim), _matrix(there.column("v"), dim)
            masks, cells = asked.column("mask").to_numpy(), there.column("c2").to_numpy()
            scores = np.full((len(q), len(e)), -np.inf)
            for cell in np.unique(cells).tolist():
                who, what = np.flatnonzero(masks >> cell & 1), np.flatnonzero(cells == cell)
                scores[np.ix_(who, what)] = q[who] @ e[what].T
            ids = there.column("ids").to_pylist()
            for query, row in zip(asked.column("query_id").to_pylist(), scores):
                least = np.partition(row, len(row) - k - 1)[len(row) - k - 1] if len(row) > k + 1 else -np.inf
                best = [
                    (-row[at], i) for at in np.flatnonzero((row >= least) & (row > -np.inf)).tolist()
                    for i in ids[at] if i != query
                ]
                found += [(query, i, -s) for s, i in sorted(best)[:k]]
        columns = list(zip(*found)) or [(), (), ()]
        return pa.table(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())],
            names=["query_id", "vec_id", "score"],
        )

    keys = ["c1", "eb", "qb"]
    near = visits.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(
        rerank, "query_id long, vec_id long, score double"
    )
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
