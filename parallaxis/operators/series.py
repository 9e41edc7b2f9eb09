"""Operators along a time series: order, neighbours, carrying forward, offsets, thinning and packing.

Every operator takes the grouping keys of the series (a recording, a stream of it), so one job
handles many series; windows never span the whole table.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import on_keys

Names = Sequence[str]


def series(keys: Names, *order: Column | str) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def numbered(df: DataFrame, keys: Names, order: Sequence[Column | str], name: str = "frame_index") -> DataFrame:
    """Indices 0.. of rows by their order."""
    return df.withColumn(name, (F.row_number().over(series(keys, *order)) - 1).cast("long"))


def with_dropped(delivered: DataFrame, dropped: DataFrame, keys: Names, ts: str, tie: str) -> DataFrame:
    """Delivered and dropped rows as one series in time order; at equal times delivered ones come first, each kind in the order of tie.

    Adds is_dropped and pos (0.. in the series); columns that one side lacks are null there."""
    both = delivered.withColumn("is_dropped", F.lit(False)).unionByName(dropped.withColumn("is_dropped", F.lit(True)), allowMissingColumns=True)
    return numbered(both, keys, [ts, "is_dropped", tie], "pos")


def increasing(df: DataFrame, keys: Names, order: str, ts: str) -> DataFrame:
    """keys and strictly_increasing: whether every ts is above the one before it; true for a single row."""
    w = series(keys, order)
    up = df.withColumn("up", F.col(ts) > F.lag(ts).over(w))
    return up.groupBy(*keys).agg(F.coalesce(F.bool_and("up"), F.lit(True)).alias("strictly_increasing"))


def continuous(df: DataFrame, keys: Names, index: str) -> DataFrame:
    """keys and is_continuous: whether the indices are 0..n-1, each once. By sums, so no sort is needed."""
    n, x = F.count("*"), F.col(index)
    ok = (F.min(x) == 0) & (F.max(x) == n - 1) & (F.count_distinct(x) == n)
    return df.groupBy(*keys).agg(F.coalesce(ok, F.lit(False)).alias("is_continuous"))


def carried(keys: Names, order: Sequence[str], value: str, start: Column | None = None) -> Column:
    """The latest value that isn't null up to each row; before the first, start, or else the first there is."""
    w = Window.partitionBy(*keys)
    upto = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = w.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    first = start if start is not None else F.first(value, ignorenulls=True).over(ahead)
    return F.coalesce(F.last(value, ignorenulls=True).over(upto), first)


def offsets(size: str, keys: Names, order: Sequence[str]) -> Column:
    """Where each frame's bytes start in its file: the sizes before it, summed."""
    w = series(keys, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.sum(size).over(w) - F.col(size)


def offsets_in_blocks(df: DataFrame, size: str, keys: Names, order: Names, block: Column, name: str = "starts") -> DataFrame:
    """offsets() as a column of a table, for series that are too long for one sort: block is a number that never falls along the
    order, so each block is summed by itself and only the blocks' totals are put in a row. A row without a size has no offset."""
    rows = df.withColumn("block_", block)
    totals = rows.groupBy(*keys, "block_").agg(F.coalesce(F.sum(size), F.lit(0)).alias("in_"))
    before = totals.select(*[F.col(k).alias(f"{k}_r_") for k in keys], F.col("block_").alias("at_"), (F.sum("in_").over(series(keys, "block_")) - F.col("in_")).alias("before_"))
    same = F.col("block_").eqNullSafe(F.col("at_"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_r_"))
    within = offsets(size, [*keys, "block_"], order)
    return rows.join(before, same).withColumn(name, F.col("before_") + within).select(*df.columns, name)


def subsample(df: DataFrame, keys: Names, order: Sequence[str], most: int) -> DataFrame:
    """At most so many rows of each series, evenly spread: the i-th of n from N rows is row i*(N-1) div max(n-1, 1)."""
    w = series(keys, *order)
    whole = Window.partitionBy(*keys)
    rows = df.withColumn("p_", F.row_number().over(w) - 1).withColumn("n_all_", F.count("*").over(whole))
    n = F.least(F.lit(most), F.col("n_all_"))
    # row p is chosen if it is the place of some i; the only candidates are around p * (n-1) / (N-1)
    gap, last = F.greatest(n - 1, F.lit(1)), F.col("n_all_") - 1
    guess = F.ceil(F.col("p_") * gap / F.greatest(last, F.lit(1))).cast("long")
    hit = F.lit(False)
    for d in (-1, 0, 1):
        i = guess + d
        hit = hit | ((i >= 0) & (i < n) & (F.floor(i * last / gap) == F.col("p_")))
    return rows.where(hit).drop("p_", "n_all_")


def scanned(df: DataFrame, keys: Names, order: Names, start: Callable[[], object], step: Callable[[object, pd.DataFrame], tuple[object, pd.DataFrame]], schema: str) -> DataFrame:
    """Runs a sequential operator over each series without holding a series in memory.

    Rows are brought together and sorted by Spark; step gets the state and the next rows of one series (all of it, or a
    piece that an Arrow batch holds) and returns the new state and rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            parts = pdf[list(keys)].astype(object).where(pdf[list(keys)].notna(), None)
            tuples = list(map(tuple, parts.to_numpy()))
            cut = [0, *[i for i in range(1, len(tuples)) if tuples[i] != tuples[i - 1]], len(tuples)]
            for a, b in zip(cut, cut[1:], strict=False):
                if key is None or tuples[a] != key:
                    key, state = tuples[a], start()
                state, out = step(state, pdf.iloc[a:b])
                yield out

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def thinned(df: DataFrame, keys: Names, ts: str, tie: str, least: float) -> DataFrame:
    """Greedy rate thinning: a row is kept if it is at least so far behind the last row kept (not the last row)."""

    def step(last: float, pdf: pd.DataFrame) -> tuple[float, pd.DataFrame]:
        t, kept, i = pdf[ts].to_numpy(dtype=float), [], 0
        while True:
            if last > -np.inf:
                low, i = i, i + int(np.searchsorted(t[i:], last + least))
                # a sum and a difference can round to either side of the limit; the difference decides
                while i > low and t[i - 1] - last >= least:
                    i -= 1
                while i < len(t) and t[i] - last < least:
                    i += 1
            if i >= len(t):
                break
            kept.append(i)
            last, i = t[i], i + 1
        return last, pdf.iloc[kept]

    return scanned(df, keys, [ts, tie], lambda: -np.inf, step, df.schema)


def packed(df: DataFrame, keys: Names, order: Names, size: str, limit: int) -> DataFrame:
    """Adds segment: consecutive rows fill a segment until its size reaches the limit; the next row opens another."""

    def step(state: tuple[int, int], pdf: pd.DataFrame) -> tuple[tuple[int, int], pd.DataFrame]:
        segment, held = state
        total = np.cumsum(pdf[size].to_numpy(dtype=np.int64))
        out, i, before = np.empty(len(pdf), dtype=np.int64), 0, 0
        while i < len(pdf):
            # the row that fills the segment is its last
            end = int(np.searchsorted(total, before + limit - held)) + 1
            out[i:end] = segment
            if end > len(pdf):
                held += int(total[-1]) - before
                break
            segment, held, before, i = segment + 1, 0, int(total[end - 1]), end
        return (segment, held), pdf.assign(segment=out)

    return scanned(df, keys, order, lambda: (0, 0), step, df.schema.add("segment", "long"))


def handed_over(rows: DataFrame, keys: Names, size: str, limit: int, ended: DataFrame) -> DataFrame:
    """keys, segment, frames and size of the segments that may go: full ones, and the last one of a series that has ended.

    rows: as packed() gives them; ended: keys. A segment that is still being filled has no row until its series ends."""
    per = rows.groupBy(*keys, "segment").agg(F.count("*").alias("frames"), F.sum(size).alias("size"))
    return on_keys(per, ended.select(*keys).distinct().withColumn("ended_", F.lit(True)), keys, "left").where((F.col("size") >= limit) | F.col("ended_")).drop("ended_")


def queued(df: DataFrame, keys: Names, order: Names, size: str, written: str, limit: int) -> DataFrame:
    """Adds accepted: whether a frame fits a queue of so many bytes. A row where `written` is true isn't a frame (accepted is null); it
    frees what the oldest frame in the queue holds. A frame that would take the queue above the limit is dropped and holds nothing."""

    def step(state: tuple[deque, int], pdf: pd.DataFrame) -> tuple[tuple[deque, int], pd.DataFrame]:
        waiting, held = state
        out: list[bool | None] = []
        for n, is_written in zip(pdf[size].to_numpy(), pdf[written].to_numpy(), strict=True):
            if is_written:
                held -= waiting.popleft() if waiting else 0
                out.append(None)
                continue
            fits = held + int(n) <= limit
            if fits:
                waiting.append(int(n))
                held += int(n)
            out.append(fits)
        return (waiting, held), pdf.assign(accepted=pd.Series(out, index=pdf.index, dtype=object))

    return scanned(df, keys, order, lambda: (deque(), 0), step, df.schema.add("accepted", "boolean"))


def shifted_scores(df: DataFrame, keys: Names, index: str, a: str, b: str, most: int = 3) -> DataFrame:
    """keys, offset, score for offsets -most..most: the mean product of the change of a around each row with b's change that many rows
    away; rows whose neighbours are missing take no part."""
    w = series(keys, index)
    change = lambda c: F.lead(c).over(w) - F.lag(c).over(w)
    moved = df.withColumn("da_", change(a)).withColumn("db_", change(b))
    pairs = F.array(*[F.struct(F.lit(k).alias("offset"), (F.col("da_") * F.lead("db_", k).over(w)).alias("s")) for k in range(-most, most + 1)])
    moved = moved.select(*keys, pairs.alias("pairs_"))
    return moved.select(*keys, F.explode("pairs_").alias("o")).groupBy(*keys, F.col("o.offset").alias("offset")).agg(F.avg("o.s").alias("score"))


def best_offset(scores: DataFrame, keys: Names) -> DataFrame:
    """The offset with the largest score, the smallest at ties. Without any score, or with one that is NaN, there is none: offset is null."""
    score = F.when(~F.isnan("score"), F.col("score"))
    best = F.max(F.when(score.isNotNull(), F.struct(score.alias("score"), (-F.col("offset")).alias("o"))))
    return scores.groupBy(*keys).agg((-best["o"]).alias("best_offset"))
