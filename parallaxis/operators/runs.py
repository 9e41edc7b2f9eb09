"""Runs of equal values: encoding, expanding, adjacent groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import on_keys

Names = Sequence[str]


def encode(df: DataFrame, keys: Names, pos: str, value: Column) -> DataFrame:
    """keys, value, first, last: the inclusive runs of each value over positions 0..; null ends a run and has none.

    Within one value, rows of a run have the same difference between position and rank."""
    rows = df.select(*keys, F.col(pos).alias("pos"), value.alias("value")).where(F.col("value").isNotNull())
    rank = F.row_number().over(Window.partitionBy(*keys, "value").orderBy("pos"))
    return rows.withColumn("island", F.col("pos") - rank).groupBy(*keys, "value", "island").agg(F.min("pos").alias("first"), F.max("pos").alias("last")).drop("island")


def entries(runs: DataFrame, keys: Names) -> DataFrame:
    """keys, entry_no, value, ranges: each distinct value once, in the order of first appearance, with its sorted runs."""
    per = runs.groupBy(*keys, "value").agg(F.array_sort(F.collect_list(F.array("first", "last"))).alias("ranges"))
    w = Window.partitionBy(*keys).orderBy(F.get(F.get("ranges", F.lit(0)), F.lit(0)))
    return per.withColumn("entry_no", F.row_number().over(w) - 1)


def expand(runs: DataFrame) -> DataFrame:
    """A row for each position of each run, in place of first and last."""
    return runs.withColumn("pos", F.explode(F.sequence("first", "last"))).drop("first", "last")


def per_frame(frames: DataFrame, runs: DataFrame, keys: Names, index: str) -> DataFrame:
    """Every frame with the value of the run that holds it, or null. An equi-join on expanded runs, not a join on a range; null keys are equal."""
    names = [*keys, index]
    found = on_keys(frames, expand(runs).withColumnRenamed("pos", index), names, "left")
    return found.select(*names, *[c for c in found.columns if c not in names])


def disjoint(runs: DataFrame, keys: Names) -> DataFrame:
    """keys and is_disjoint: whether runs are ordered ranges that don't overlap."""
    w = Window.partitionBy(*keys).orderBy("first", "last")
    ok = (F.col("first") >= 0) & (F.col("first") <= F.col("last")) & (F.col("first") > F.coalesce(F.lag("last").over(w), F.lit(-1)))
    return runs.withColumn("ok", ok).groupBy(*keys).agg(F.bool_and("ok").alias("is_disjoint"))


def adjacent(keys: Names, order: Sequence[str], value: str) -> Column:
    """A number for each group of consecutive rows with equal values; equal values that aren't adjacent stay apart."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return F.sum(F.when(F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)).over(w)
