"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected to a few dimensions, several times with other directions and shifts; each projection orders
all rows along a Hilbert curve. Spark range-partitions every ordering into blocks of equal numbers of rows; a
query is compared with the block it falls into and the blocks next to it, and what the orderings find is merged
and ranked again by the exact inner product in double precision.

Every row is in every ordering. With isotropic vectors of many dimensions near neighbours lie only a little nearer
along a curve than others do, so the windows are a fixed share of the rows (WINDOW of them on both sides of
a query); the README has the measured recall. Blocks have at most about BLOCK_ROWS rows, and the queries that look
into a block are dealt into pieces of about QUERY_PIECE, so the work of a task is bounded.

Rows that repeat count once, and of several vectors of an id the best for a query counts.
Vectors that are null, empty, all zero, or hold null or non-finite components take no part, nor do rows without an id. Rows with equal vectors are kept
apart along the curve by their ids, so a common vector fills many blocks instead of one. With fewer
than k candidates all that are found are returned. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, written
from .covertree import usable

CURVES, DIMENSIONS, ORDER_BITS = 6, 4, 12
LEAST_BLOCKS, WINDOW = 24, 1 / 6
BLOCK_ROWS, QUERY_PIECE = 16_384, 4_096
SEED = 77


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of rows of integers below 2**bits, vectorised over the rows.

    Skilling's transform: from the axes to the transposed index, whose bits are then interleaved."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = np.where(on, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _directions(length: int, curves: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each curve orthonormal directions and a shift; as fixed by seed and length, so all tasks agree."""
    out = []
    for c in range(curves):
        rng = np.random.default_rng([seed, length, c])
        basis = np.linalg.qr(rng.standard_normal((length, min(DIMENSIONS, length))))[0]
        out.append((basis, rng.random(basis.shape[1])))
    return out


def keyed(rows: DataFrame, curves: int, seed: int) -> DataFrame:
    """id, v, curve, key for each curve. A projection is scaled by the vector's length into [-1, 1], shifted and cut to a grid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            lengths = np.array(list(map(len, vectors)))
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                own = batch.column(1).take(pa.array(at))
                v = np.array([vectors[i] for i in at], dtype=np.float64)
                unit = v / np.linalg.norm(v / np.abs(v).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(v).max(axis=1, keepdims=True)
                for c, (basis, shift) in enumerate(_directions(int(n), curves, seed)):
                    # most of a projection lies within a few standard deviations, 1 / sqrt(n)
                    p = np.clip(unit @ basis * np.sqrt(n) / 8 + 0.25 + shift / 2, 0, 1 - 1e-9)
                    key = hilbert((p * (1 << ORDER_BITS)).astype(np.int64), ORDER_BITS)
                    yield pa.RecordBatch.from_pydict({"id": pa.array(ids[at]), "v": own, "curve": pa.array(np.full(len(at), c, np.int32)), "key": pa.array(key)})

    return rows.mapInArrow(run, f"id long, v {rows.schema['v'].dataType.simpleString()}, curve int, key long")


def _first_k(i: np.ndarray, score: np.ndarray, ids: np.ndarray, j: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs (i, j) the k of each i with the largest score, ties to smaller ids."""
    by = np.lexsort((ids, -score, i))
    i, j = i[by], j[by]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < k], j[place < k]


def search(rows: DataFrame, queries: DataFrame, k: int = 20, curves: int = CURVES, window: float = WINDOW, seed: int = SEED) -> DataFrame:
    """rows, queries: id, v (queries are rows too). Returns query_id, rank, vec_id, score. window: the share of
    all rows that a query looks at on either side along each curve."""
    rows = written(rows.select("id", "v").where("id IS NOT NULL").distinct(), "rows")
    every = keyed(rows, curves, seed)
    wanted = written(queries.select(F.col("id").alias("wanted")).where("wanted IS NOT NULL").distinct(), "wanted")
    asked, n = wanted.count(), rows.count()
    # a range partition is a block; the ids keep equal keys apart
    parts = curves * max(LEAST_BLOCKS, -(-n // BLOCK_ROWS))
    ordered = every.repartitionByRange(parts, "curve", "key", F.xxhash64("id"), "id").withColumn("block", F.spark_partition_id())
    ordered = written(ordered, "curves")
    blocks = (ordered.agg(F.max("block")).first()[0] or 0) + 1
    side = max(1, int(np.ceil(window * blocks / curves)))
    pieces = max(1, -(-asked * curves * (2 * side + 1) // (blocks * QUERY_PIECE)))
    asking = ordered.join(wanted, ordered["id"] == F.col("wanted"), "left_semi").withColumn("piece", F.pmod(F.xxhash64("id"), F.lit(pieces)).cast("int"))
    asking = asking.withColumn("block", F.explode(F.sequence(F.col("block") - side, F.col("block") + side)))
    answering = ordered.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    answering = answering.select(*[F.col(c).alias(c) for c in answering.columns])  # columns of their own beside asking's

    def meet(qs: pd.DataFrame, xs: pd.DataFrame) -> pd.DataFrame:
        ids, others, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        for n in sorted(set(qs.v.map(len)) & set(xs.v.map(len))):
            a, b = qs[qs.v.map(len) == n], xs[xs.v.map(len) == n]
            x, x_ids, x_curve = np.stack(b.v.to_numpy()).astype(np.float64), b.id.to_numpy(), b.curve.to_numpy()
            by = np.lexsort((x_curve, x_ids))
            ends = np.flatnonzero((np.diff(x_ids[by]) != 0) | (np.diff(x_curve[by]) != 0)) + 1
            again = [same for same in np.split(by, ends) if len(same) > 1] if len(ends) + 1 < len(by) else []
            for at in range(0, len(a), 256):
                part = a.iloc[at : at + 256]
                own, v = part.id.to_numpy(), np.stack(part.v.to_numpy()).astype(np.float64)
                score = v @ x.T
                score[(own[:, None] == x_ids[None, :]) | (part.curve.to_numpy()[:, None] != x_curve[None, :])] = -np.inf
                for same in again:  # an id counts once, by the best of its vectors
                    best = score[:, same].argmax(axis=1)
                    score[:, same] = np.where(np.arange(len(same)) == best[:, None], score[:, same], -np.inf)
                # everything down to the kth score, so that ties are settled by id when all windows are merged
                last = np.partition(score, -min(k, score.shape[1]), axis=1)[:, -min(k, score.shape[1])]
                i, j = np.nonzero((score >= last[:, None]) & np.isfinite(score))
                i, j = _first_k(i, score[i, j], x_ids[j], j, k)
                ids.append(own[i])
                others.append(x_ids[j])
                scores.append(np.einsum("ij,ij->i", v[i], x[j]))
        return pd.DataFrame({"query_id": np.concatenate(ids), "vec_id": np.concatenate(others), "score": np.concatenate(scores)})

    near = asking.groupBy("block", "piece").cogroup(answering.groupBy("block", "piece")).applyInPandas(meet, "query_id long, vec_id long, score double")
    merged = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def vectors(table: DataFrame) -> DataFrame:
    """id, v of usable rows that aren't all zero."""
    rows = pick(table, "vec_id", "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")) & F.exists("embedding", lambda v: v != 0))
    return rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
