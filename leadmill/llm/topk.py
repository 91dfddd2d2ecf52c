"""Exact search by inner product over vectors sorted by length.

The components of a vector become integers.  Entries are range-partitioned by
descending Euclidean norm into strips of bounded size.  Each query first meets the
longest entries, a head of fixed size; the k-th best score there is a bound from
below.  The product of two norms bounds a score from above, so a query needs only
the strips down to some norm.  Inside a strip entries are taken in descending
length: the inner product is summed over the leading directions of a rotation, by
singular value decomposition of all entries, and the rest is bounded by the norms
of what remains (Cauchy-Schwarz); only entries that can reach a query's k-th best
score are scored on all components, in integers.

Groups of at most *group_rows* queries meet strips of about *strip_rows* entries,
one pair of them a task.  Equal vectors are one entry with its smallest ids.  Only
the head, a matrix of squared dimension and one number go through the driver.

Defined results: vectors that are null or empty, hold a null or non-finite component, or
become non-finite when scaled take no part, nor do rows with a null id, nor
vectors whose length is not the most common one (of equals the longest); zero
vectors take part; of several rows with one id the smallest vector counts; a query
with fewer candidates gets all of them; a score outside the range of a long counts
as its end; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadmill import storage

SCALE = 256
HEAD_ROWS = 1_024
STRIP_ROWS = 16_384
GROUP_ROWS = 8_192
#: Entries of a strip, and queries, that are bounded and scored at once.
BLOCK_ROWS = 512
#: Part of the directions whose products are summed before the rest is bounded.
LEADING_PART = 4
#: Rounding of floating-point bounds, as a part of the product of two norms.
SLACK = 1e-9
_EXACT = 2.0**53
_LEAST, _MOST = -(2**63), 2**63 - 1


def _matrix(column, dim: int) -> np.ndarray:
    chunk = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return chunk.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _norms(rows: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((rows**2).sum(axis=1))


def products(queries: np.ndarray, entries: np.ndarray, at: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Inner products of the pairs (at, of) of integral rows, within the range of a long."""
    if _norms(queries).max(initial=0) * _norms(entries).max(initial=0) < _EXACT:
        if len(at) * LEADING_PART > len(queries) * len(entries):
            return (queries @ entries.T)[at, of].astype(np.int64)
        return np.einsum("ij,ij->i", queries[at], entries[of]).astype(np.int64)
    whole = [[int(x) for x in row] for row in queries.tolist()], [[int(x) for x in row] for row in entries.tolist()]
    exact = [sum(a * b for a, b in zip(whole[0][i], whole[1][j])) for i, j in zip(at.tolist(), of.tolist())]
    return np.array([min(max(s, _LEAST), _MOST) for s in exact], np.int64)


class Best:
    """The *k* best entries of each of some queries: by score, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, k: int):
        self._ids, self._k = ids, k
        self.bounds = bounds.copy()
        self.rows = np.zeros((0, 3), np.int64)  # place of the query, score, id

    def add(self, at: np.ndarray, scores: np.ndarray, ids: list[np.ndarray]) -> None:
        each = np.array([len(i) for i in ids], np.int64)
        found = np.column_stack([np.repeat(at, each), np.repeat(scores, each), np.concatenate([*ids, np.zeros(0, np.int64)])])
        found = found[found[:, 2] != self._ids[found[:, 0]]]
        rows = np.concatenate([self.rows, found])
        rows = rows[np.lexsort((rows[:, 2], ~rows[:, 1], rows[:, 0]))]
        start = np.flatnonzero(np.diff(rows[:, 0], prepend=-1))
        place = np.arange(len(rows)) - np.repeat(start, np.diff(np.append(start, len(rows))))
        self.rows = rows[place < self._k]
        last = rows[place == self._k - 1]
        self.bounds[last[:, 0]] = np.maximum(self.bounds[last[:, 0]], last[:, 1].astype(float))


def scan(queries: np.ndarray, bounds: np.ndarray, query_ids: np.ndarray, entries: np.ndarray,
         entry_ids: list, rotation: np.ndarray, k: int) -> np.ndarray:
    """Rows (place of the query, score, id) that can be among the *k* best of the queries.

    *bounds* is a score that each query reaches k times in any case.
    """
    best = Best(query_ids, bounds, k)
    lead = max(1, -(-entries.shape[1] // LEADING_PART))
    order = np.argsort(-_norms(entries), kind="stable")
    with np.errstate(over="ignore", invalid="ignore"):
        turned = queries @ rotation
        q_norm, q_lead, q_rest = _norms(queries), turned[:, :lead], _norms(turned[:, lead:])
        for start in range(0, len(order), BLOCK_ROWS):
            block = order[start : start + BLOCK_ROWS]
            there = entries[block] @ rotation
            e_norm, e_lead, e_rest = _norms(entries[block]), there[:, :lead], _norms(there[:, lead:])
            reach = ~(q_norm * e_norm[0] * (1 + SLACK) < best.bounds)
            for some in _in_blocks(np.flatnonzero(reach)):
                upper = q_lead[some] @ e_lead.T + q_rest[some, None] * e_rest + SLACK * q_norm[some, None] * e_norm
                at, of = np.nonzero(~(upper < best.bounds[some, None]))
                scores = products(queries[some], entries[block], at, of)
                # Of more than k + 1 entries only those that reach the last of these can count.
                table = np.full(upper.shape, -np.inf)
                table[at, of] = scores
                if len(block) > k + 1:
                    least = np.partition(table, len(block) - k - 1, axis=1)[:, len(block) - k - 1]
                    best.bounds[some] = np.maximum(best.bounds[some], least)
                there_too = table[at, of] >= best.bounds[some][at]
                best.add(some[at[there_too]], scores[there_too], [entry_ids[i] for i in block[of[there_too]].tolist()])
    return best.rows


def _in_blocks(places: np.ndarray) -> list[np.ndarray]:
    return [places[i : i + BLOCK_ROWS] for i in range(0, len(places), BLOCK_ROWS)]


def _usable(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``vec_id, v``: the integral vectors that take part."""
    v = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x * scale)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    floor = F.transform("v", lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x))
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
        .filter(F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite)
        .select("vec_id", floor.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))
    )


def _rotation(entries: DataFrame, dim: int) -> np.ndarray:
    """Directions of the entries, most of their length first: one column each."""

    def moments(batches):
        total = np.zeros((dim, dim))
        with np.errstate(over="ignore", invalid="ignore"):
            for batch in batches:
                rows = _matrix(batch.column(0), dim)
                total += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], names=["at", "x"])

    summed = np.zeros(dim * dim)
    got = entries.select("v").mapInArrow(moments, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
    summed[got.column("at").to_numpy()] = got.column("x").to_numpy()
    if not np.isfinite(summed).all() or not dim:
        return np.eye(dim)
    return np.linalg.svd(summed.reshape(dim, dim))[0]


def search(vectors: DataFrame, is_query: Column, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
           scale: int = SCALE, head_rows: int = HEAD_ROWS, strip_rows: int = STRIP_ROWS,
           group_rows: int = GROUP_ROWS) -> DataFrame:
    """The *k* rows with the largest inner products of each row with *is_query* (a condition on ``vec_id``).

    Returns ``query_id, rank, vec_id, score``; best first, ties to the smaller id.
    """
    spark = vectors.sparkSession
    rows = storage.materialize(_usable(vectors, id_col, vector_col, scale), "vectors")
    width = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    dim = width["n"] if width else 1
    rows = rows.filter(F.size("v") == dim)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))

    # Equal vectors as one entry with its k + 1 smallest ids (one may be the query), in strips by descending norm.
    place = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    entries = rows.select("v", "vec_id", place.alias("place")).filter(F.col("place") <= k + 1).groupBy("v").agg(
        F.sort_array(F.collect_list("vec_id")).alias("ids")
    ).withColumn("norm", norm)
    entries = storage.materialize(entries, "entries")
    strips = max(1, -(-entries.count() // strip_rows))
    entries = storage.materialize(
        entries.repartitionByRange(strips, F.desc("norm"), F.xxhash64("v")).withColumn("strip", F.spark_partition_id()),
        "strips",
    )
    lengths = entries.groupBy("strip").agg(F.max("norm").alias("longest"))
    rotation = _rotation(entries, dim)

    top = entries.orderBy(F.desc("norm"), F.element_at("ids", 1)).limit(head_rows).select("v", "ids").toArrow()
    head = spark.sparkContext.broadcast((_matrix(top.column("v"), dim), top.column("ids").to_pylist()))

    def bound(batches):
        held, held_ids = head.value
        held_ids = [np.array(i, np.int64) for i in held_ids]
        for batch in batches:
            mine, own = _matrix(batch.column(1), dim), batch.column(0).to_numpy()
            found = scan(mine, np.full(len(mine), -np.inf), own, held, held_ids, rotation, k)
            n = np.bincount(found[:, 0], minlength=len(mine))
            reached = np.full(len(mine), -np.inf)
            np.minimum.at(least := np.full(len(mine), np.inf), found[:, 0], found[:, 1].astype(float))
            reached[n >= k] = least[n >= k]
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                need = np.where(reached > 0, reached / _norms(mine) * (1 - SLACK), -1.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(reached), pa.array(np.nan_to_num(need, nan=-1.0))],
                names=["query_id", "q", "bound", "need"],
            )

    asked = rows.filter(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    asked = storage.materialize(
        asked.mapInArrow(bound, "query_id long, q array<double>, bound double, need double"), "asked"
    )
    groups = max(1, -(-asked.count() // group_rows))
    asked = storage.materialize(
        asked.repartitionByRange(groups, "need", F.xxhash64("query_id")).withColumn("part", F.spark_partition_id()), "asked"
    )
    visits = storage.materialize(
        asked.groupBy("part").agg(F.min("need").alias("need"))
        .select("part", "need", F.explode(F.sequence(F.lit(0), F.lit(strips - 1))).alias("at"))
        .join(lengths, (F.col("at") == F.col("strip")) & (F.col("longest") >= F.col("need"))).select("part", "strip"),
        "visits",
    )
    by_part, by_strip = (visits.select(F.col("part").alias("p"), F.col("strip").alias("s")) for _ in range(2))
    queries = asked.join(by_part, F.col("part") == F.col("p")).select("query_id", "q", "bound", "p", "s")
    held = entries.join(by_strip, F.col("strip") == F.col("s")).select("v", "ids", "p", "s")

    def meet(mine: pa.Table, there: pa.Table) -> pa.Table:
        found, own = np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
        if mine.num_rows and there.num_rows:
            own = mine.column("query_id").to_numpy()
            ids = [np.array(i, np.int64) for i in there.column("ids").to_pylist()]
            found = scan(
                _matrix(mine.column("q"), dim), mine.column("bound").to_numpy(), own,
                _matrix(there.column("v"), dim), ids, rotation, k,
            )
        return pa.table(
            [pa.array(own[found[:, 0]]), pa.array(found[:, 2].copy()), pa.array(found[:, 1].copy())],
            names=["query_id", "vec_id", "score"],
        )

    near = queries.groupBy("p", "s").cogroup(held.groupBy("p", "s")).applyInArrow(
        meet, "query_id long, vec_id long, score long"
    )
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
