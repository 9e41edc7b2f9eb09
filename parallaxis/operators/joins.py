"""Joins between time series, and between what should be there and what is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Names = Sequence[str]
#: Frames whose times round to the same multiple of this were captured together.
SAME_INSTANT_S = 0.0005


def bucket(ts: Column, width: float) -> Column:
    """The nearest multiple of width, halves to even: two times close to each other can still fall into two buckets."""
    return F.rint(ts / F.lit(width))


def on_keys(left: DataFrame, right: DataFrame, keys: Names, how: str = "inner") -> DataFrame:
    """A join on keys whose nulls are equal, as they are one group to groupBy. The other columns of both sides have names of their own.
    Spark hashes or sorts such keys like any others."""
    named = right.select(*[F.col(k).alias(f"{k}_r_") for k in keys], *[c for c in right.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"{k}_r_"))
    both = left.join(named, cond, how)
    if how == "full":  # a row of the right alone has its keys there; which side a null is of, its mark says
        for k in keys:
            both = both.withColumn(k, F.coalesce(k, f"{k}_r_"))
    return both if how in ("left_semi", "left_anti") else both.drop(*[f"{k}_r_" for k in keys])


def same_instant(left: DataFrame, right: DataFrame, keys: Names, left_ts: str, right_ts: str, right_pos: str, width: float = SAME_INSTANT_S) -> DataFrame:
    """Rows of left with the row of right at the same instant; of several in a bucket of right the last by right_pos.

    Columns of right must have names of their own, but for the keys. Right is reduced by an aggregation, which combines
    before its shuffle, and both sides are then partitioned alike."""
    others = [c for c in right.columns if c not in keys]
    last = right.groupBy(*keys, bucket(F.col(right_ts), width).alias("bucket_")).agg(F.max_by(F.struct(*others), right_pos).alias("r_"))
    return on_keys(left.withColumn("bucket_", bucket(F.col(left_ts), width)).where("bucket_ IS NOT NULL"), last, [*keys, "bucket_"]).select(*left.columns, *[F.col(f"r_.{c}").alias(c) for c in others])


def latest_or_first(probe: DataFrame, build: DataFrame, keys: Names, probe_ts: str, build_ts: str, value: str) -> DataFrame:
    """Each probe row with the value of the latest build row at or before it, or else of the first build row that has a value, or null.

    One union and one window over each series: a build row sorts before a probe row of the same time."""
    b = build.where(F.col(value).isNotNull()).select(*keys, F.col(build_ts).alias("t_"), F.lit(0).alias("side_"), F.col(value).alias("v_"), F.lit(None).cast(probe.select(F.struct(*probe.columns).alias("s")).schema["s"].dataType).alias("row_"))
    p = probe.select(*keys, F.col(probe_ts).alias("t_"), F.lit(1).alias("side_"), F.lit(None).cast(build.schema[value].dataType).alias("v_"), F.struct(*probe.columns).alias("row_"))
    w = Window.partitionBy(*keys).orderBy("t_", "side_")
    upto, ahead = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    both = b.unionByName(p).withColumn(value, F.coalesce(F.last("v_", ignorenulls=True).over(upto), F.first("v_", ignorenulls=True).over(ahead)))
    return both.where("side_ = 1").select("row_.*", value)


def zipped(df: DataFrame, arrays: Names, name: str = "pos") -> DataFrame:
    """Parallel lists as rows by position. Lists of unequal lengths are an error, not padded; lists that are all null have no rows."""
    same = F.lit(True)
    for a in arrays[1:]:
        same = same & F.size(a).eqNullSafe(F.size(arrays[0]))
    checked = F.when(same, F.arrays_zip(*arrays)).otherwise(F.raise_error(F.lit("parallel lists differ in length")))
    rest = [c for c in df.columns if c not in arrays]
    return df.select(*rest, F.posexplode(checked).alias(name, "z_")).select(*rest, name, *[F.col(f"z_.{a}").alias(a) for a in arrays])


def missing(expected: DataFrame, present: DataFrame, on: Names) -> DataFrame:
    """Expected rows without an equal one that is present; nulls are equal."""
    return on_keys(expected, present.select(*on).distinct(), on, "left_anti")


def complete(expected: DataFrame, present: DataFrame, keys: Names, on: Names) -> DataFrame:
    """keys, expected, found, is_complete: whether all expected members are present with the same size, hash, ...; nulls are equal."""
    p = present.select(*keys, *on).distinct().withColumn("there_", F.lit(1))
    return on_keys(expected.select(*keys, *on), p, [*keys, *on], "left").groupBy(*keys).agg(F.count("*").alias("expected"), F.count("there_").alias("found")).withColumn("is_complete", F.col("expected") == F.col("found"))


def same_maps(a: DataFrame, b: DataFrame, keys: Names, values: Names) -> DataFrame:
    """keys whose values differ, or that one side lacks; null keys are equal."""
    r = b.select(*keys, *[F.col(c).alias(f"r_{c}") for c in values], F.lit(True).alias("right_"))
    both = on_keys(a.withColumn("left_", F.lit(True)), r, keys, "full")
    differs = F.col("left_").isNull() | F.col("right_").isNull()
    for c in values:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"r_{c}"))
    return both.where(differs).select(*keys, *values, *[f"r_{c}" for c in values])
