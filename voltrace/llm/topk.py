"""Exact top-k inner products over norm-sorted blocks.

Vectors become integers (``floor(scale * x)``). Candidates are ordered by
descending length and cut into blocks of bounded size, queries into blocks
too. A block of queries meets the longest candidates first, which sets each
query's bar: its k-th best score so far. By Cauchy-Schwarz a later block can
only help a query whose length times the block's longest is not below its
bar, so every other pair of query and block is dropped before any vector is
copied. Inside a block the rotated coordinates of a singular value
decomposition come in order of importance: partial sums over the first ones
plus the product of what is left of both lengths bound the score, and only
candidates whose bound reaches the bar are scored, exactly and on integers.

The rotation is fitted on a bounded sample of rows (any rotation is right, a
good one prunes more). Bounds carry a margin for rounding; ties at the bar are
kept, so that they can go to the smaller id.

Edge cases: a vector that is null or holds null or non-finite components takes
no part; vectors of unequal lengths are compared as if padded with zeros; a
query never gets its own id; repeated ids are candidates each, and a repeated
query row gives one set of results; fewer than k candidates give fewer rows;
empty tables give none. Components are limited to 2**24 and lengths to 2**14,
so that scores fit into a long; larger ones raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import durable
from .textkernel import batchwise

#: Rows of a candidate block and of a query block.
BLOCK = 16_384
QUERY_BLOCK = 2048
#: Rows that the rotation is fitted on.
FIT_ROWS = 20_000
#: Rotated coordinates of the first and second partial sum.
STEPS = (8, 24)
LIMIT = 1 << 24


def integers(vectors: DataFrame, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, x array<long>, norm) of the vectors that take part."""
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    bad = F.col(embedding).isNull() | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    x = F.transform(v, lambda c: F.floor(F.when(F.abs(c) * scale < LIMIT, c * scale).otherwise(F.raise_error(F.lit("vector component out of range")))))
    kept = vectors.where(F.col(vec_id).isNotNull() & ~F.coalesce(bad, F.lit(True))).select(F.col(vec_id).cast("long").alias("id"), x.alias("x"))
    return kept.withColumn("norm", F.sqrt(F.aggregate(F.transform("x", lambda c: c.cast("double") * c), F.lit(0.0), lambda a, c: a + c)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(size), dim), np.int64)
    rows = np.repeat(np.arange(len(size)), size)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size)] = column.flatten().to_numpy()
    return out


def _packed(rows: DataFrame, dim: int, most: int) -> DataFrame:
    """(block, ids, data, norm): every partition's rows, in its order, in blocks of at most ``most``; norm is the longest."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        ids, xs, norms, held = [], [], [], 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([np.concatenate(xs).tobytes()], pa.binary()), pa.array([max(norms)], pa.float64())], ["block", "ids", "data", "norm"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, most - held)
                at += piece.num_rows
                held += piece.num_rows
                ids.append(piece.column(0).to_numpy())
                xs.append(_matrix(piece.column(1), dim).astype(np.int32))
                norms.append(float(piece.column(2).to_numpy().max()))
                if held == most:
                    yield block()
                    number += 1
                    ids, xs, norms, held = [], [], [], 0
        if held:
            yield block()

    return rows.select("id", "x", "norm").transform(batchwise, pack, "block long, ids binary, data binary, norm double")


def _rotation(rows: DataFrame, dim: int, fit_rows: int) -> np.ndarray:
    sample = rows.select("id", "x").orderBy(F.xxhash64("id"), "id").limit(fit_rows).select("x").toArrow().column("x").combine_chunks()
    x = _matrix(sample, dim).astype(np.float64)
    return np.linalg.svd(x.T @ x)[0]


def best_of_block(q_ids: np.ndarray, q: np.ndarray, bar: np.ndarray, c_ids: np.ndarray, c: np.ndarray, rotation: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, candidate id, score) of the k best candidates of a block for each query that reach its bar."""
    qf, cf = q.astype(np.float64) @ rotation, c.astype(np.float64) @ rotation
    rest_q = np.sqrt(np.maximum(np.cumsum((qf * qf)[:, ::-1], 1)[:, ::-1], 0))
    rest_c = np.sqrt(np.maximum(np.cumsum((cf * cf)[:, ::-1], 1)[:, ::-1], 0))
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1] < 2.0**52
    out_q, out_c, out_s = [], [], []
    for i in range(len(q)):
        own_bar, lo = bar[i], 0
        margin = 1e-9 * rest_q[i, 0] * (rest_c[0, 0] if len(c) else 0) + 1e-6
        alive = np.arange(np.searchsorted(-rest_c[:, 0] * rest_q[i, 0], -own_bar + margin, "right")) if np.isfinite(own_bar) else np.arange(len(c))  # a norm-sorted block is cut off
        part = np.zeros(len(alive))
        for hi in STEPS:
            hi = min(hi, q.shape[1])
            if lo < hi and np.isfinite(own_bar) and len(alive) > 4 * k:
                part = part + cf[alive, lo:hi] @ qf[i, lo:hi]
                left = rest_q[i, hi] * rest_c[alive, hi] if hi < q.shape[1] else 0.0
                keep = part + left >= own_bar - margin
                alive, part, lo = alive[keep], part[keep], hi
        alive = alive[c_ids[alive] != q_ids[i]]
        score = c[alive] @ q[i] if exact else np.array([sum(int(a) * int(b) for a, b in zip(row, q[i], strict=True)) for row in c[alive]], np.int64)
        keep = score >= own_bar
        alive, score = alive[keep], score[keep]
        top = np.lexsort((c_ids[alive], -score))[:k]
        out_q.append(np.full(len(top), i))
        out_c.append(c_ids[alive][top])
        out_s.append(score[top].astype(np.int64))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_q, out_c, out_s))


def _column(batch: pa.RecordBatch, name: str, row: int, kind: type) -> np.ndarray:
    return np.frombuffer(batch.column(batch.schema.get_field_index(name))[row].as_buffer(), kind)


def _meet(batch: pa.RecordBatch, row: int, bar: np.ndarray, dim: int, rotation: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    q_ids, q, c_ids, c = _column(batch, "q_ids", row, np.int64), _column(batch, "q_data", row, np.int32), _column(batch, "ids", row, np.int64), _column(batch, "data", row, np.int32)
    return q_ids, *best_of_block(q_ids, q.reshape(-1, dim).astype(np.int64), bar, c_ids, c.reshape(-1, dim).astype(np.int64), rotation, k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding", block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other vectors of every row where ``is_query`` holds.

    ``is_query`` is an expression of the integer id, named ``id``.
    """
    spark = vectors.sparkSession
    rows = durable(integers(vectors, scale, vec_id, embedding))
    total, asking, dim = rows.agg(F.count("*"), F.count_if(is_query), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    if dim > 1 << 14:
        raise ValueError("vectors are too long for exact scores")
    if not asking or not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rotation = spark.sparkContext.broadcast(_rotation(rows, dim, FIT_ROWS))
    # the second key deals out lengths that very many vectors share
    ranged = rows.withColumn("spread", F.xxhash64("id")).repartitionByRange(max(1, -(-total // block)), F.desc("norm"), "spread").sortWithinPartitions(F.desc("norm"), "id")
    candidates = durable(_packed(ranged, dim, block))
    asked = rows.where(is_query).groupBy("id").agg(F.min("x").alias("x"), F.min("norm").alias("norm"))
    queries = durable(_packed(asked.repartition(max(1, -(-asking // query_block))), dim, query_block))

    # the longest candidates first, for a bar
    front = candidates.orderBy(F.desc("norm"), "block").limit(1)  # one block of bounded size

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q_ids, at, ids, score = _meet(batch, row, np.full(len(_column(batch, "q_ids", row, np.int64)), -np.inf), dim, rotation.value, k)
                bar = np.full(len(q_ids), -np.inf)
                n = np.bincount(at, minlength=len(q_ids))
                full = np.flatnonzero(n == k)
                bar[full] = score[np.cumsum(n)[full] - 1]
                length = np.sqrt((_column(batch, "q_data", row, np.int32).reshape(-1, dim).astype(np.float64) ** 2).sum(1))
                need = np.where((length > 0) & np.isfinite(bar), bar / np.maximum(length, 1e-300), -np.inf).min()
                lists = [pa.array([x], pa.list_(pa.int64())) for x in (q_ids[at], ids, score)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([bar.tobytes()], pa.binary()), pa.array([need], pa.float64()), *lists], ["q_block", "q_bar", "need", "query_id", "vec_id", "score"])

    shape = queries.select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    first = durable(shape.crossJoin(F.broadcast(front.select("ids", "data"))).transform(batchwise, begin, "q_block long, q_bar binary, need double, query_id array<long>, vec_id array<long>, score array<long>"))
    found = first.select(F.explode(F.arrays_zip("query_id", "vec_id", "score")).alias("r")).select("r.*")

    # then each block that can still help a block of queries
    others = candidates.join(front.select("block"), "block", "left_anti")
    reach = first.select("q_block", "need").join(others.select("block", "norm"), F.col("norm") * (1 + 1e-9) + 1e-6 >= F.col("need")).select("q_block", "block")
    met = reach.join(shape.join(first.select("q_block", "q_bar"), "q_block"), "q_block").join(others.select("block", "ids", "data"), "block")

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q_ids, at, ids, score = _meet(batch, row, _column(batch, "q_bar", row, np.float64), dim, rotation.value, k)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (q_ids[at], ids, score)], ["query_id", "vec_id", "score"])

    rest = met.select("q_ids", "q_data", "q_bar", "ids", "data").transform(batchwise, go_on, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.unionByName(rest).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
