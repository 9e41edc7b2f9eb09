"""A Merkle manifest of a table, with an authentication path for every row, by fractal traversal.

H is the lowercase hex sha256 of its inputs, digests as hex text. Rows become leaves; the leaves of a source, by doc_id, become
nodes of FANOUT at a time, level by level, until one is left (the last run of a level may be shorter, even one node; a lone leaf
is its own subroot); the subroots, by source with null first and then bytewise, become the root in the same way.

Leaves are numbered across tasks: a range sort, counts per task and source, and their running sums. Aligned blocks of
FANOUT ** BLOCK_LEVELS leaves are streamed through Python twice: once for the blocks' roots, from which Spark builds the levels above,
each written before the next; once for the paths. There a Traversal keeps, for each level of a block, one existing run and one desired
run that grows by a leaf a step, so it holds a few hundred digests beside the block's leaves; paths come out one after the other, each
followed by the steps above the block, which arrive with it in the stream. No task sees more than a block at a time, and nothing
but counts of levels goes to the driver.

A path is an array of steps from the leaf up, each with the digests `before` and `after` in the run, concatenated: folding H(before || node ||
after) gives the root. Leaves with the same doc_id are ordered by digest, null doc_ids first; equal rows each have a leaf. Texts are
hashed whole, whatever their length. An empty table has no rows and no root. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import discard, pick, written

FANOUT, BLOCK_LEVELS = 16, 3
STEP = "struct<before string, after string>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Counts of leaves per task and group that are broadcast; beyond it they are shuffled.
BROADCAST_COUNTS = 200_000
#: Rows that come out of Python at once; each carries a path of a few KB.
OUT_ROWS = 256


def h(*digests: Column) -> Column:
    return F.sha2(F.concat(*digests).cast("binary"), 256)


def leaf(*fields: Column) -> Column:
    """H of the fields, each '-' if null, else its UTF-8 length in bytes, ':' and itself."""
    value = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
    return h(*[F.coalesce(value(c.cast("string")), F.lit("-")) for c in fields])


def combine(digests: Sequence[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


class Run:
    """The run at some level that is being made from leaves: a stack of finished nodes per level below."""

    def __init__(self, level: int):
        self.stack: list[list[str]] = [[] for _ in range(level)]

    def add(self, digest: str) -> None:
        for nodes in self.stack:
            nodes.append(digest)
            if len(nodes) < FANOUT or nodes is self.stack[-1]:
                return
            digest = combine(nodes)
            nodes.clear()

    def nodes(self) -> list[str]:
        """The nodes of the run, with what is left of shorter runs below it."""
        for below, above in zip(self.stack, self.stack[1:]):
            if below:
                above.append(combine(below))
                below.clear()
        return self.stack[-1]


class Traversal:
    """Successive authentication paths of a block: `existing` holds the run of each level that the current leaf is under, `desired`
    the next one of that level, which takes one leaf a step, so it is there when the existing one is left."""

    def __init__(self, leaves: Callable[[int], str], n: int, levels: int):
        self.leaves, self.n, self.levels = leaves, n, levels
        self.existing: list[list[str]] = []
        self.desired: list[Run] = []
        for level in range(1, levels + 1):
            first = Run(level)
            for i in range(min(n, FANOUT**level)):
                first.add(leaves(i))
            self.existing.append(first.nodes())
            self.desired.append(Run(level))

    def root(self) -> str:
        return combine(self.existing[-1]) if self.levels else self.leaves(0)

    def paths(self) -> Iterator[list[tuple[str, str]]]:
        """(before, after) of each level, for one leaf after the other."""
        steps: list[tuple[str, str]] = [("", "")] * self.levels
        for i in range(self.n):
            for level in range(1, self.levels + 1):
                size = FANOUT**level
                if i and i % size == 0:
                    self.existing[level - 1], self.desired[level - 1] = self.desired[level - 1].nodes(), Run(level)
                if i % (size // FANOUT) == 0:
                    run, place = self.existing[level - 1], i // (size // FANOUT) % FANOUT
                    steps[level - 1] = ("".join(run[:place]), "".join(run[place + 1 :]))
                if i + size < self.n:
                    self.desired[level - 1].add(self.leaves(i + size))
            yield list(steps)


def levels_of(n: int) -> int:
    """Levels of runs above n leaves."""
    k = 0
    while n > 1:
        n, k = -(-n // FANOUT), k + 1
    return k


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows, which must be a written table, with place (from 0, in its group by order; nulls first) and size (of the group)."""
    spark = rows.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    # equal rows may be many, so where they were read from parts them
    ranged = rows.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(n, *keys, "at").sortWithinPartitions(*keys, "at")
    ranged = written(ranged.drop("at").withColumn("task", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id()), "ranged")
    counts = written(ranged.groupBy(F.col(group).alias("g"), F.col("task").alias("t")).agg(F.count("*").alias("n"), F.min("nth").alias("first")), "counts")
    before = Window.partitionBy("g").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("g", "t", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(Window.partitionBy("g")).alias("size"))
    if counts.count() <= BROADCAST_COUNTS:
        offsets = F.broadcast(offsets)
    out = ranged.join(offsets, F.col(group).eqNullSafe(F.col("g")) & (F.col("task") == F.col("t")))
    out = written(out.select(*rows.columns, (F.col("nth") + F.col("shift")).alias("place"), "size"), "numbered")
    discard(ranged, counts)
    return out


def _blocks(numbered_rows: DataFrame, group: str, block_levels: int, marks: DataFrame | None = None) -> DataFrame:
    """g, block, place, size, leaf, row_, and upper, own and root, in the order of the stream; a block's mark comes first."""
    size = FANOUT**block_levels
    rows = numbered_rows.select(F.col(group).alias("g"), F.floor(F.col("place") / size).alias("block"), "place", "size", "leaf", F.struct(*numbered_rows.columns).alias("row_"))
    if marks is not None:
        rows = rows.unionByName(marks.withColumn("place", F.lit(-1).cast("long")), allowMissingColumns=True)
    return rows.repartition("g", "block").sortWithinPartitions("g", "block", "place")


def _each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one block after the other: slices are joined while they belong to it."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        g, block = batch.column("g").to_pylist(), batch.column("block").to_pylist()
        cuts = [0, *(i for i in range(1, len(g)) if block[i] != block[i - 1] or g[i] != g[i - 1]), len(g)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                if held and key != (g[a], block[a]):
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held = []
                key = (g[a], block[a])
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _traversal(rows: pa.RecordBatch, block_levels: int) -> Traversal:
    leaves = rows.column("leaf").to_pylist()
    return Traversal(leaves.__getitem__, len(leaves), min(block_levels, levels_of(rows.column("size")[0].as_py())))


def _block_roots(batches: Iterator[pa.RecordBatch], block_levels: int) -> Iterator[pa.RecordBatch]:
    for rows in _each_block(batches):
        found = _traversal(rows, block_levels)
        yield pa.RecordBatch.from_arrays([rows.column("g").slice(0, 1), rows.column("block").slice(0, 1), pa.array([found.root()])], names=["g", "idx", "node"])


def _block_paths(batches: Iterator[pa.RecordBatch], block_levels: int) -> Iterator[pa.RecordBatch]:
    for rows in _each_block(batches):
        mark, rows = rows.slice(0, 1), rows.slice(1)
        upper, ends = [(s["before"], s["after"]) for s in mark.column("upper")[0].as_py()], [mark.column(c)[0].as_py() for c in ("own", "root")]
        paths = _traversal(rows, block_levels).paths()
        for at in range(0, rows.num_rows, OUT_ROWS):
            part = rows.slice(at, OUT_ROWS)
            steps = [next(paths) + upper for _ in range(part.num_rows)]
            flat = [s for path in steps for s in path]
            offsets = pa.array(np.cumsum([0, *map(len, steps)]), pa.int32())
            sides = pa.StructArray.from_arrays([pa.array([s[k] for s in flat], pa.string()) for k in (0, 1)], names=["before", "after"])
            roots = [pa.array([x] * part.num_rows, pa.string()) for x in ends]
            yield pa.RecordBatch.from_arrays([part.column("row_"), pa.ListArray.from_arrays(offsets, sides), *roots], names=["row_", "path", "own", "root"])


def _levels_above(nodes: DataFrame, sizes: DataFrame, block_levels: int) -> list[DataFrame]:
    """Tables of g, idx, node, left (nodes of its group at that level), children; from the blocks' roots to where every group has one."""
    span = FANOUT**block_levels
    nodes = nodes.join(sizes, nodes["g"].eqNullSafe(sizes["of"])).select(nodes["g"], "idx", "node", F.ceil(F.col("size") / span).alias("left"), F.lit(None).cast("array<string>").alias("children"))
    found = [written(nodes, "nodes")]
    for _ in range(levels_of(found[0].agg(F.max("left")).first()[0] or 0)):
        runs = found[-1].where("left > 1").groupBy("g", F.floor(F.col("idx") / FANOUT).alias("up")).agg(F.max("left").alias("was"), F.array_sort(F.collect_list(F.struct("idx", "node"))).alias("run"))
        runs = runs.select("g", F.col("up").alias("idx"), F.col("run.node").alias("children"), F.ceil(F.col("was") / FANOUT).alias("left"))
        found.append(written(runs.select("g", "idx", h(F.array_join("children", "")).alias("node"), "left", "children"), "nodes"))
    return found


def _down(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """g, block, upper, own, root: the steps above each block, those of its group's root (tops: of, upper, own, root) last."""
    down = None
    for k in range(len(levels) - 1, -1, -1):
        here = levels[k].select("g", "idx", "left")
        ends = here.where("left = 1").join(tops, F.col("g").eqNullSafe(F.col("of"))).select("g", "idx", "upper", "own", "root")
        if down is not None:
            above = down.join(levels[k + 1].select(F.col("g").alias("u"), F.col("idx").alias("ui"), "children"), F.col("g").eqNullSafe(F.col("u")) & (F.col("idx") == F.col("ui"))).select("u", "ui", "children", "upper", "own", "root")
            place = (F.col("idx") % FANOUT).cast("int")
            sides = lambda start, length: F.array_join(F.slice("children", start, length), "")
            step = F.struct(sides(F.lit(1), place).alias("before"), sides(place + 2, F.lit(FANOUT)).alias("after"))
            inner = here.where("left > 1").join(above, F.col("g").eqNullSafe(F.col("u")) & (F.floor(F.col("idx") / FANOUT) == F.col("ui")))
            ends = ends.unionByName(inner.select("g", "idx", F.concat(F.array(step), F.col("upper")).alias("upper"), "own", "root"))
        lower = written(ends, "steps")
        if down is not None:
            discard(down)
        down = lower
    out = down.withColumnRenamed("idx", "block")
    out.written_to = down.written_to
    return out


def authenticate(leaves: DataFrame, group: str, order: list[str], block_levels: int, above: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The rows of leaves (a written table with a column leaf, deleted here) with path, own (the root of their group) and root. `above` turns
    the groups' roots (group, leaf) into a table with path and root of these; their steps then follow, and the root is theirs."""
    places = numbered(leaves, group, order)
    discard(leaves)
    kind = leaves.schema[group].dataType.simpleString()
    roots = _blocks(places, group, block_levels).mapInArrow(lambda batches: _block_roots(batches, block_levels), f"g {kind}, idx long, node string")
    levels = _levels_above(roots, places.where("place = 0").select(F.col(group).alias("of"), "size"), block_levels)
    tops = levels[0].where("left = 1").select(F.col("g").alias(group), F.col("node").alias("leaf"))
    for nodes in levels[1:]:
        tops = tops.unionByName(nodes.where("left = 1").select(F.col("g").alias(group), F.col("node").alias("leaf")))
    if above is None:
        tops = tops.select(F.col(group).alias("of"), F.array().cast(f"array<{STEP}>").alias("upper"), F.col("leaf").alias("own"), F.col("leaf").alias("root"))
    else:
        tops = above(tops).select(F.col(group).alias("of"), F.col("path").alias("upper"), F.col("leaf").alias("own"), "root")
    tops = written(tops, "tops")
    marks = _down(levels, tops)
    discard(tops, *levels)
    schema = StructType([StructField("row_", places.schema), *StructType.fromDDL(f"path array<{STEP}>, own string, root string")])
    return _blocks(places, group, block_levels, marks).mapInArrow(lambda batches: _block_paths(batches, block_levels), schema).select(*[f"row_.{c}" for c in leaves.columns], "path", "own", "root")


def with_paths(leaves: DataFrame, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """doc_id, source, leaf and other columns of leaves, with path (to the root), subroot and root."""

    def subroots_in_order(subroots: DataFrame) -> DataFrame:
        return authenticate(written(subroots.withColumn("whole", F.lit(0)), "subroots"), "whole", ["source"], block_levels)

    return authenticate(written(leaves, "leaves"), "source", ["doc_id", "leaf"], block_levels, subroots_in_order).withColumnRenamed("own", "subroot")


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, path, subroot, root for each row of docs (doc_id, source, lang, n_chars, text)."""
    rows = pick(docs, *FIELDS)
    return with_paths(rows.select("doc_id", "source", leaf(*map(F.col, FIELDS)).alias("leaf")))


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path lead to."""
    return F.aggregate(path, digest, lambda node, step: h(step["before"], node, step["after"]))


def proof(path: Column) -> Column:
    """H of the siblings, from the leaf up, left to right."""
    return h(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""))


def oracle(levels: int = 6, source_levels: int = 5) -> str:
    """SQL for the query over at most FANOUT ** levels documents of a source, and FANOUT ** source_levels sources."""
    field = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')".format
    fields = " || ".join(map(field, FIELDS))
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = "list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda r, b: list_reduce([xor(r, b)] || range(8), lambda u, i: xor(u >> 1, CASE WHEN u & 1 = 1 THEN 3988292384 ELSE 0 END)))"
    parts = [f"""l AS (
  SELECT *, sha256({fields}) AS leaf, CASE WHEN xor({crc}, 4294967295) % 5 = 0 THEN sha256({" || ".join([*map(field, FIELDS[:-1]), field(lowered)])}) END AS claimed
  FROM documents
), d0 AS (
  SELECT source AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS m, leaf AS node, doc_id, leaf, claimed FROM l
)"""]

    def up(name: str, n: int) -> None:
        for k in range(n):
            below, sides = f"{name}{k}", f"PARTITION BY g, i // {FANOUT} ORDER BY i ROWS BETWEEN"
            parts.append(f"""{name}s{k} AS (
  SELECT g, i, m, coalesce(string_agg(node, '') OVER ({sides} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
         coalesce(string_agg(node, '') OVER ({sides} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM {below}
), {name}{k + 1} AS (
  SELECT g, i // {FANOUT} AS i, (max(m) + {FANOUT - 1}) // {FANOUT} AS m, CASE WHEN max(m) = 1 THEN max(node) ELSE sha256(string_agg(node, '' ORDER BY i)) END AS node
  FROM {below} GROUP BY g, i // {FANOUT}
)""")

    def fold(name: str, rows: str, index: str, n: int) -> None:
        """rows with x (the digest so far) and proof, over the levels of name."""
        for k in range(n):
            parts.append(f"""{name}f{k + 1} AS (
  SELECT r.* EXCLUDE (x, proof), CASE WHEN s.m = 1 THEN r.x ELSE sha256(s.a || r.x || s.b) END AS x, CASE WHEN s.m = 1 THEN r.proof ELSE r.proof || s.a || s.b END AS proof
  FROM {rows if k == 0 else f"{name}f{k}"} r JOIN {name}s{k} s ON s.g IS NOT DISTINCT FROM r.{index[0]} AND s.i = r.{index[1]} // {FANOUT**k}
)""")

    up("d", levels)
    parts.append(f"""t0 AS (
  SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, count(*) OVER () AS m, node, g AS source FROM d{levels}
)""")
    up("t", source_levels)
    parts.append("r0 AS (\n  SELECT *, coalesce(claimed, leaf) AS x, '' AS proof FROM d0\n)")
    fold("d", "r0", ("g", "i"), levels)
    parts.append(f"r1 AS (\n  SELECT f.*, t.node AS subroot, t.g AS tg, t.i AS ti FROM df{levels} f JOIN t0 t ON t.source IS NOT DISTINCT FROM f.g\n)")
    fold("t", "r1", ("tg", "ti"), source_levels)
    return f"""WITH {", ".join(parts)}
SELECT doc_id, leaf, subroot, t.node AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = t.node AS verified
FROM tf{source_levels} r JOIN t{source_levels} t ON t.g = r.tg"""
