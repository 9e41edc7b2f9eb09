"""Exact top-k by inner product with dual-tree search over cover trees.

A node has a centre, a covering radius, the largest angle to its centre, and the lengths of its shortest and longest
vector; its children's centres lie further apart than a share of its radius, FAN of them at most. Two
nodes with centres p, q and radii r, s can't hold an inner product above p.q + r|q| + s|p| + rs, nor above what the
cone of their angles and their lengths allow; a pair is pruned if the smaller of these is below the worst kth score of
the query node's group. Equal bounds are visited, since ties go to smaller ids.

The top level is made of a bounded sample, and lives across the cluster: every row goes to its nearest top
node, whose radius, angle and lengths are aggregated over all rows. Small top nodes share a block, those of more than
data_block rows are dealt into several by the rows' places, so a vector that repeats doesn't make a task grow.
The sample, being rows, also gives each query a first worst kth score, which prunes top nodes before anything
is shuffled, and all later pairs. A query is sent to the blocks that are left; a piece of queries and a block meet in one
task, which builds a tree of either side and searches both together down to leaves, where a matrix product scores all.

The search is exact whatever the data; how much it prunes depends on them. Vectors without clusters in many dimensions
leave nothing to prune, so every query meets every row in a product (the README has figures).

Scores are integer inner products, exact also beyond 2**53; beyond the range of a long they are that range's end.
Vectors that are null or hold null or non-finite components take no part, nor do rows without an id. Rows that repeat
count as often as they are there as candidates; an equal query is answered once, and an id that has several vectors gets an
answer for each. Products are of vectors of equal length; empty
vectors score 0 with each other. With less than k candidates all are returned; without queries or candidates the
result is empty. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, pick, written

QUERY_BLOCK, DATA_BLOCK = 8_192, 65_536
#: Blocks of a small table, so that it is worked on by more than one core.
LEAST_BLOCKS = 12
#: Numbers in the sample, and top nodes at most.
SAMPLE_VALUES, MOST_TOPS, ROWS_PER_TOP = 1 << 18, 256, 2_048
LEAF_QUERIES, LEAF_ROWS = 16, 1_024
#: Queries in a product.
QUERY_RUN = 256
FAN, SHRINK = 16, 0.7
#: Vectors with a component from here on are compared one by one in whole numbers, beside the trees.
LARGE = 2.0**52
NONE = -(2**63 - 1)
FOUND = pa.schema([("ask", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


@dataclass
class Nodes:
    """What bounds need of nodes, a row for each."""

    centre: np.ndarray
    radius: np.ndarray
    angle: np.ndarray
    shortest: np.ndarray
    longest: np.ndarray


def lengths_of(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def away(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distance and angle of each row to its centre, and its length. A zero vector is at any angle."""
    length = lengths_of(x)
    both = length * np.sqrt((centre * centre).sum(axis=-1))
    cosine = (x * centre).sum(axis=1) / np.where(both > 0, both, 1)
    return lengths_of(x - centre), np.where(both > 0, np.arccos(np.clip(cosine, -1, 1)), np.pi), length


def bounds(a: Nodes, b: Nodes) -> np.ndarray:
    """No inner product of a row of a's node and one of b's is above this. There is some room for rounding."""
    dot = a.centre @ b.centre.T
    na, nb = lengths_of(a.centre)[:, None], lengths_of(b.centre)[None, :]
    ra, rb = a.radius[:, None], b.radius[None, :]
    ball = dot + ra * nb + rb * na + ra * rb
    both = na * nb
    angle = np.where(both > 0, np.arccos(np.clip(dot / np.where(both > 0, both, 1), -1, 1)), 0) - a.angle[:, None] - b.angle[None, :] - 1e-6
    cosine = np.cos(np.clip(angle, 0, np.pi))
    longest = a.longest[:, None] * b.longest[None, :]
    cone = np.where(cosine >= 0, longest, a.shortest[:, None] * b.shortest[None, :]) * cosine
    return np.minimum(ball, cone) + 1e-9 * longest + 1e-3


def far_apart(x: np.ndarray, first: int, most: int, within: float) -> tuple[list[int], np.ndarray]:
    """Rows that are further from each other than within, the farthest first and at most so many; each row's nearest of them."""
    chosen, owner = [first], np.zeros(len(x), dtype=np.int64)
    near = lengths_of(x - x[first])
    while len(chosen) < most and near[i := int(near.argmax())] > within:
        d = lengths_of(x - x[i])
        owner[d < near] = len(chosen)
        near = np.minimum(near, d)
        chosen.append(i)
    return chosen, owner


class CoverTree:
    """Nodes over points that are reordered so that each node has a run of them."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.order = np.arange(len(points))
        self.run: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        made: list[tuple] = []
        todo = [(0, len(points), int(lengths_of(points - points.mean(axis=0)).argmin()), -1)] if len(points) else []
        while todo:
            low, high, middle, parent = todo.pop()
            own = points[self.order[low:high]]
            me, centre = len(self.run), points[middle]
            far, angle, length = away(own, centre)
            made.append((centre, far.max(), angle.max(), length.min(), length.max()))
            self.run.append((low, high))
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(me)
            if high - low <= leaf or far.max() == 0:
                continue
            rows = self.order[low:high]
            chosen, owner = far_apart(own, int(far.argmin()), FAN, float(far.max()) * SHRINK)
            if len(chosen) < 2:  # nothing is further away than the share: the farthest row becomes a child's centre
                chosen, owner = far_apart(own, int(far.argmin()), 2, 0.0)
            self.order[low:high] = rows[np.argsort(owner, kind="stable")]
            ends = low + np.cumsum(np.bincount(owner, minlength=len(chosen)))
            todo += [(int(s), int(e), int(rows[c]), me) for s, e, c in zip([low, *ends[:-1]], ends, chosen, strict=True) if e > s]
        self.points = points[self.order]
        columns = list(zip(*made, strict=True)) or [np.zeros((0, points.shape[1])), *[()] * 4]
        self.nodes = Nodes(np.array(columns[0]).reshape(len(made), points.shape[1]), *[np.array(c, dtype=float) for c in columns[1:]])


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exact; as doubles if these hold them, else as longs within (NONE, -NONE]."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)))
    most = int(max(1, np.abs(q).max())) * int(max(1, np.abs(x).max())) * q.shape[1]
    if most < 1 << 53:
        return q @ x.T
    if most < 1 << 62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    whole = [np.array([[int(c) for c in row] for row in part], dtype=object) for part in (q, x)]
    return np.clip(whole[0] @ whole[1].T, NONE + 1, -NONE).astype(np.int64)


class Best:
    """The best k of each query by (score descending, id ascending). floor: scores below it can't be among them."""

    def __init__(self, ids: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.own, self.k = ids, k
        self.score = np.full((len(ids), k), NONE, dtype=np.int64)
        self.id = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.floor = np.full(len(ids), NONE, dtype=np.int64) if floor is None else floor

    def worst(self, rows: slice | np.ndarray) -> np.ndarray:
        return np.maximum(self.score[rows, -1], self.floor[rows])

    def offer(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """score: of these queries with the candidates ids; none with the query's own id counts."""
        score = np.where(self.own[rows, None] == ids[None, :], NONE, score)
        hit = (score >= self.worst(rows)[:, None]) & (score > NONE)
        if hit.sum() > 4 * self.k * len(score):
            k = min(self.k, score.shape[1])
            hit &= score >= np.partition(score, -k, axis=1)[:, -k][:, None]
        i, j = np.nonzero(hit)
        s, c = score[i, j].astype(np.int64), ids[j]
        i = rows[i]
        better = (s > self.score[i, -1]) | (s == self.score[i, -1]) & (c < self.id[i, -1])
        if not better.any():
            return
        i, s, c = i[better], s[better], c[better]
        who = np.unique(i)
        every = [np.concatenate([np.repeat(who, self.k), i]), np.concatenate([self.score[who].ravel(), s]), np.concatenate([self.id[who].ravel(), c])]
        by = np.lexsort((every[2], -every[1], every[0]))
        i, s, c = (e[by] for e in every)
        place = np.arange(len(i)) - np.searchsorted(i, i)
        first = place < self.k
        self.score[i[first], place[first]], self.id[i[first], place[first]] = s[first], c[first]


def dual_tree(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[Best, int]:
    """The best k rows of x for each row of q, but none with the query's own id, and how many pairs were scored. Rows of Best follow q."""
    a, b = CoverTree(q, LEAF_QUERIES), CoverTree(x, LEAF_ROWS)
    best = Best(q_ids[a.order], k, None if floor is None else floor[a.order])
    ids, limit, scored = x_ids[b.order], bounds(a.nodes, b.nodes), 0
    worst = np.array([best.worst(slice(*r)).min() for r in a.run])
    level, leaves = [(0, 0)] if len(q) and len(x) else [], []
    while level:
        level = [p for p in level if limit[p] >= worst[p[0]]]
        leaves += [p for p in level if not a.children[p[0]] and not b.children[p[1]]]
        # the larger side is opened
        level = [
            pair for m, n in level if a.children[m] or b.children[n]
            for pair in ([(c, n) for c in a.children[m]] if not b.children[n] or a.children[m] and a.nodes.radius[m] > b.nodes.radius[n] else [(m, c) for c in b.children[n]])
        ]
    # the most promising leaves of data first, so that the worst scores rise early; at each, a query's own bound decides
    length, zero = lengths_of(a.points), np.zeros(len(a.points))
    own, asking = bounds(Nodes(a.points, zero, zero, length, length), b.nodes), {}
    for m, n in leaves:
        asking.setdefault(n, []).append(m)
    for n in sorted(asking, key=lambda n: -limit[asking[n], n].max()):
        rows = np.concatenate([np.arange(*a.run[m]) for m in asking[n]])
        rows = rows[own[rows, n] >= best.worst(rows)]
        for one in range(b.run[n][0], b.run[n][1], LEAF_ROWS):  # a leaf of equal vectors may be larger
            other = min(b.run[n][1], one + LEAF_ROWS)
            for at in range(0, len(rows), QUERY_RUN):
                part = rows[at : at + QUERY_RUN]
                best.offer(part, products(a.points[part], b.points[one:other]), ids[one:other])
            scored += len(rows) * (other - one)
    back = np.argsort(a.order)
    best.own, best.score, best.id, best.floor = best.own[back], best.score[back], best.id[back], best.floor[back]
    return best, scored


def by_length(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each length: their places and a matrix."""
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), int(n))


def usable(vector: Column) -> Column:
    """Not null, and no component that is null or not finite."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


@dataclass
class Tops:
    """The top nodes: for each length of vectors the numbers of its nodes, their centres, and the sample's ids and rows.
    The last number is that of rows which no centre is near: of another length, or too large."""

    of: dict[int, tuple[int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)
    n: int = 0

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each row's top node, and its distance, angle and length."""
        top, zero = np.full(len(x), self.n), np.zeros(len(x))
        measures = [zero.copy(), zero.copy(), zero.copy()]
        near = ~too_large(x)
        if x.shape[1] in self.of and near.any():
            first, centres = self.of[x.shape[1]][:2]
            own = x[near]
            nearest = ((centres * centres).sum(axis=1) - 2 * (own @ centres.T)).argmin(axis=1)
            top[near] = first + nearest
            for m, found in zip(measures, away(own, centres[nearest]), strict=True):
                m[near] = found
        return (top, *measures)


def too_large(x: np.ndarray) -> np.ndarray:
    return (np.abs(x) >= LARGE).any(axis=1)


def tops_of(rows: DataFrame, n: int, longest: int) -> Tops:
    """Centres that are far apart, out of a sample of SAMPLE_VALUES numbers or so; the driver gets no more."""
    size = max(16, SAMPLE_VALUES // max(1, longest))
    got = rows.where(F.rand(7) < F.lit(min(1.0, size / max(1, n)))).limit(2 * size).toArrow()
    out = Tops()
    ids = got["id"].to_numpy()
    for at, x in by_length(got["v"].combine_chunks()) if len(got) else ():
        own = ~too_large(x)
        x, at = x[own], at[own]
        if len(x):
            most = max(1, min(MOST_TOPS - out.n, n * len(x) // len(got) // ROWS_PER_TOP))
            chosen, _ = far_apart(x, int(lengths_of(x - x.mean(axis=0)).argmin()), most, 0.0)
            out.of[x.shape[1]] = (out.n, x[chosen], ids[at], x)
            out.n += len(chosen)
        if out.n >= MOST_TOPS:
            break
    return out


def placed(df: DataFrame, tops: Tops) -> DataFrame:
    """Of every row: its top node, and what the node needs to know of it."""
    sent = df.sparkSession.sparkContext.broadcast(tops)  # bounded by SAMPLE_VALUES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in by_length(batch.column(0)):
                top, far, angle, length = sent.value.place(x)
                yield pa.RecordBatch.from_pydict({"top": top.astype(np.int32), "far": far, "angle": angle, "length": length})

    return df.select("v").mapInArrow(run, "top int, far double, angle double, length double")


def summary(df: DataFrame, tops: Tops) -> tuple[np.ndarray, np.ndarray]:
    """How many rows each top node has, and its radius, angle, shortest and longest length over all of them."""
    own = placed(df, tops).groupBy("top").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.max("angle").alias("angle"), F.min("length").alias("low"), F.max("length").alias("high"))
    counts, measures = np.zeros(tops.n + 1, dtype=np.int64), np.zeros((4, tops.n + 1))
    for r in own.collect():  # MOST_TOPS and one rows at most
        counts[r["top"]], measures[:, r["top"]] = r["n"], (r["far"], r["angle"], r["low"], r["high"])
    return counts, measures


def dealt(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For groups in order, their first block and number of blocks: large groups are split, small ones share a block."""
    first, parts = np.zeros(len(counts), dtype=np.int64), np.ones(len(counts), dtype=np.int64)
    block, room = -1, 0
    for g, n in enumerate(counts):
        if n > most:
            parts[g] = -(-n // most)
            first[g], block, room = block + 1, block + int(parts[g]), 0
        elif n:
            if n > room:
                block, room = block + 1, most
            first[g], room = block, room - n
    return first, parts


def top_k(queries: DataFrame, data: DataFrame, k: int = 5, query_block: int = QUERY_BLOCK, data_block: int = DATA_BLOCK) -> DataFrame:
    """queries, data: id long, v array<double> of whole numbers. Returns query_id, rank, vec_id, score long; a row's own id is no candidate."""
    spark = data.sparkSession
    rows = written(data.select("id", "v").where("id IS NOT NULL"), "vectors")
    # an equal query is asked once; ask tells queries of one id apart
    asking = written(queries.select("id", "v").where("id IS NOT NULL").distinct().withColumn("ask", F.monotonically_increasing_id()), "queries")
    n, longest = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    tops = tops_of(rows, n, longest)
    (counts, measures), asked = summary(rows, tops), summary(asking, tops)[0]
    blocks = dealt(counts, min(data_block, max(LEAF_ROWS, -(-n // LEAST_BLOCKS))))
    pieces = dealt(asked, query_block)
    sent = spark.sparkContext.broadcast((tops, counts, measures, blocks, pieces))

    def places(at: np.ndarray) -> np.ndarray:
        return at + 7919 * TaskContext.get().partitionId()

    def to_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops, _, _, (first, parts), _ = sent.value
        seen = 0
        for batch in batches:
            for at, x in by_length(batch.column(1)):
                top = tops.place(x)[0]
                block = first[top] + places(seen + at) % parts[top]
                yield pa.RecordBatch.from_pydict({"id": batch.column(0).take(pa.array(at)), "v": batch.column(1).take(pa.array(at)), "block": block.astype(np.int32)})
            seen += batch.num_rows

    def to_ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops, counts, (radius, angle, low, high), (first, parts), pieces = sent.value
        seen = 0
        for batch in batches:
            every_id = batch.column(0).to_numpy()
            for at, x in by_length(batch.column(1)):
                ids, top = every_id[at], tops.place(x)[0]
                ask = np.tile(counts > 0, (len(x), 1))  # rows of no centre are always asked
                floor = np.full(len(x), NONE, dtype=np.int64)
                if x.shape[1] in tops.of:
                    start, centres, sample_ids, sample = tops.of[x.shape[1]]
                    nodes = slice(start, start + len(centres))
                    ask[:, : tops.n] = False
                    usual = np.flatnonzero(~too_large(x))
                    for a in range(0, len(usual), QUERY_RUN):
                        part = usual[a : a + QUERY_RUN]
                        best = Best(ids[part], k)
                        for b in range(0, len(sample), LEAF_ROWS):
                            best.offer(np.arange(len(part)), products(x[part], sample[b : b + LEAF_ROWS]), sample_ids[b : b + LEAF_ROWS])
                        floor[part] = best.score[:, -1]
                    length, zero = lengths_of(x), np.zeros(len(x))
                    limit = bounds(Nodes(x, zero, zero, length, length), Nodes(centres, radius[nodes], angle[nodes], low[nodes], high[nodes]))
                    ask[:, nodes] = ((limit >= floor[:, None]) | too_large(x)[:, None]) & (counts[nodes] > 0)
                else:
                    ask[:, : tops.n] = False
                piece = pieces[0][top] + places(seen + at) % pieces[1][top]
                wanted = [sorted({int(first[t]) + p for t in np.flatnonzero(row) for p in range(int(parts[t]))}) for row in ask]
                yield pa.RecordBatch.from_pydict({"id": ids, "ask": batch.column(2).take(pa.array(at)), "v": batch.column(1).take(pa.array(at)), "floor": floor, "piece": piece.astype(np.int32), "blocks": pa.array(wanted, pa.list_(pa.int32()))})
            seen += batch.num_rows

    asks = written(asking.mapInArrow(to_ask, "id long, ask long, v array<double>, floor long, piece int, blocks array<int>"), "asks")
    discard(asking)
    asks = asks.withColumn("block", F.explode("blocks")).drop("blocks")
    x = rows.mapInArrow(to_block, "id long, v array<double>, block int")
    x = x.withColumnRenamed("block", "own").join(asks.select(F.col("block").alias("wanted"), F.col("piece").alias("to")).distinct(), F.col("own") == F.col("wanted"))

    def meet(asks: pa.Table, xs: pa.Table) -> pa.Table:
        if not len(asks) or not len(xs):
            return FOUND.empty_table()
        numbers, q_ids, x_ids, floors = asks["ask"].to_numpy(), asks["id"].to_numpy(), xs["id"].to_numpy(), asks["floor"].to_numpy()
        candidates, out = {v.shape[1]: (at, v) for at, v in by_length(xs["v"].combine_chunks())}, []
        for at, q in by_length(asks["v"].combine_chunks()):
            if q.shape[1] in candidates:
                there, v = candidates[q.shape[1]]
                best = best_of(q, q_ids[at], v, x_ids[there], k, floors[at])
                i, j = np.nonzero((best.score >= best.floor[:, None]) & (best.score > NONE))
                out.append(pa.table({"ask": numbers[at][i], "query_id": best.own[i], "vec_id": best.id[i, j], "score": best.score[i, j]}, FOUND))
        return pa.concat_tables(out) if out else FOUND.empty_table()

    found = asks.groupBy("block", "piece").cogroup(x.select("own", "to", "id", "v").groupBy("own", "to")).applyInArrow(meet, "ask long, query_id long, vec_id long, score long")
    w = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best_of(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, floor: np.ndarray) -> Best:
    """Dual-tree search; what is too large for a tree is compared with all, beside it."""
    large_q, large_x = too_large(q), too_large(x)
    if not large_q.any() and not large_x.any():
        return dual_tree(q, q_ids, x, x_ids, k, floor)[0]
    best = Best(q_ids, k, floor)
    small = np.flatnonzero(~large_q)
    found = dual_tree(q[small], q_ids[small], x[~large_x], x_ids[~large_x], k, floor[small])[0]
    best.score[small], best.id[small] = found.score, found.id
    for i in range(len(q)):
        others = np.flatnonzero(large_x | large_q[i])
        for at in range(0, len(others), LEAF_ROWS):
            part = others[at : at + LEAF_ROWS]
            best.offer(np.array([i]), products(q[i : i + 1], x[part]), x_ids[part])
    return best


def scaled_integers(table: DataFrame) -> DataFrame:
    """id, v of usable rows with an id: floor(256 * x) of each component, as a double. Products beyond a double's range are its largest."""
    rows = pick(table, "vec_id", "embedding").where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    largest = 1.7976931348623157e308

    def scaled(v: Column) -> Column:
        y = v.cast("double") * 256
        # a double from 2**52 on is a whole number, and floor() would make it a long
        return F.when(F.abs(y) < LARGE, F.floor(F.when(F.abs(y) < LARGE, y).otherwise(0.0)).cast("double")).otherwise(F.greatest(F.least(y, F.lit(largest)), F.lit(-largest)))

    return rows.select(F.col("vec_id").alias("id"), F.transform("embedding", scaled).alias("v"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id AS vec_id, list_dot_product(q.v, x.v)::BIGINT AS score, q.v AS v
  FROM (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 50 = 0) q JOIN v x ON q.vec_id <> x.vec_id AND len(q.v) = len(x.v)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, v ORDER BY score DESC, vec_id)::INT AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
