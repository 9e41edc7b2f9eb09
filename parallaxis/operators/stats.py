"""Statistics of series and distributions; all exact."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import on_keys

Names = Sequence[str]


def rate(ts: Column) -> Column:
    """Frames a second: the intervals between rows over the time they take; null if no time passes."""
    return F.try_divide(F.count("*") - 1, F.max(ts) - F.min(ts))


def duration(*streams: DataFrame, keys: Names = (), ts: str = "ts") -> DataFrame:
    """Time from the first to the last row over several streams together."""
    rows = streams[0].select(*keys, ts)
    for s in streams[1:]:
        rows = rows.unionByName(s.select(*keys, ts))
    return rows.groupBy(*keys).agg((F.max(ts) - F.min(ts)).alias("duration"))


def dropped_by_reason(df: DataFrame, keys: Names, reason: str) -> DataFrame:
    """Rows by reason, and their total under a null reason."""
    return df.rollup(*keys, reason).agg(F.count("*").alias("n"), F.grouping_id().alias("level")).where(F.col("level") <= 1).drop("level")


def quantiles(value: Column, *shares: float) -> Column:
    """Exact quantiles with linear interpolation, as an array."""
    return F.percentile(value, F.array(*map(F.lit, shares)))


def _at_ranks(df: DataFrame, keys: Names, value: str, ranks: Callable[[Column], list[Column]], bins: int, times: str | None) -> DataFrame:
    """keys, n_ and a column r0, r1, ... for each rank that `ranks` makes of the number of values: the value at that place (from 0) of a group's
    values in order, for groups of any size.

    Values are counted first, the counts of bins of equal width tell which bins hold the ranks that are asked for, and only the values of these
    are put in order, each bin by itself."""
    keys = list(keys)
    v = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys, F.col(value).cast("double").alias("v_")).agg((F.sum(times) if times else F.count("*")).alias("n_"))
    whole = v.groupBy(*keys).agg(F.min("v_").alias("low_"), F.max("v_").alias("high_"), F.sum("n_").alias("all_"))
    place = F.when(F.col("high_") > F.col("low_"), F.floor((F.col("v_") - F.col("low_")) / (F.col("high_") - F.col("low_")) * bins)).otherwise(0)
    binned = on_keys(v, whole, keys).withColumn("bin_", F.least(place, F.lit(bins - 1)).cast("int"))
    counts = binned.groupBy(*keys, "bin_").agg(F.sum("n_").alias("in_"), F.max("all_").alias("all_"))
    upto = F.sum("in_").over(Window.partitionBy(*keys).orderBy("bin_"))
    asked = F.array(*[F.struct(F.lit(i).alias("i"), r.cast("long").alias("rank")) for i, r in enumerate(ranks(F.col("all_")))])
    # a bin keeps the ranks that fall into it
    held = counts.withColumn("before_", upto - F.col("in_")).withColumn("asked_", F.filter(asked, lambda r: (r["rank"] >= F.col("before_")) & (r["rank"] < F.col("before_") + F.col("in_"))))
    held = held.where(F.size("asked_") > 0).select(*keys, "bin_", "before_", "asked_")
    run = F.sum("n_").over(Window.partitionBy(*keys, "bin_").orderBy("v_"))
    rows = on_keys(binned, held, [*keys, "bin_"]).withColumn("to_", F.col("before_") + run)
    rows = rows.select(*keys, "v_", "all_", F.explode(F.filter("asked_", lambda r: (r["rank"] >= F.col("to_") - F.col("n_")) & (r["rank"] < F.col("to_")))).alias("r_"))
    n = len(ranks(F.lit(1)))
    return rows.groupBy(*keys).agg(F.max("all_").alias("n_"), *[F.max(F.when(F.col("r_.i") == i, F.col("v_"))).alias(f"r{i}") for i in range(n)])


def exact_quantiles(df: DataFrame, keys: Names, value: str, *shares: float, bins: int = 1024, times: str | None = None) -> DataFrame:
    """keys and q, an array of the quantiles as quantiles() gives them, for groups of any size; quantiles() keeps a group's distinct
    values in one task. A row stands for as many equal ones as `times` says."""
    at = lambda s, n: F.lit(s) * (n - 1)
    found = _at_ranks(df, keys, value, lambda n: [f(at(s, n)) for s in shares for f in (F.floor, F.ceil)], bins, times)
    between = lambda i, s: F.col(f"r{2 * i}") + (F.col(f"r{2 * i + 1}") - F.col(f"r{2 * i}")) * (at(s, F.col("n_")) - F.floor(at(s, F.col("n_"))))
    return found.select(*keys, F.array(*[between(i, s) for i, s in enumerate(shares)]).alias("q"))


def upper_medians(df: DataFrame, keys: Names, value: str, bins: int = 1024, times: str | None = None) -> DataFrame:
    """keys and upper_median, sorted[n div 2], for groups of any size; a group without values has no row."""
    return _at_ranks(df, keys, value, lambda n: [F.floor(n / 2)], bins, times).select(*keys, F.col("r0").alias("upper_median"))


def share(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def levels(value: Column, *known: int) -> list[Column]:
    """The share of every known level, also of those that don't occur."""
    return [share(value == v).alias(f"level_{v}") for v in known]


def norm(*parts: Column) -> Column:
    total = parts[0] * parts[0]
    for p in parts[1:]:
        total = total + p * p
    return F.sqrt(total)


def all_of(condition: Column) -> Column:
    """Whether a condition holds for all rows; it does for none."""
    return F.coalesce(F.bool_and(condition), F.lit(True))


#: Fixed values of the interval of a median; and how many values are drawn at once.
RESAMPLES, SEED, INTERVAL, DRAWN_AT_ONCE = 1_000, 0, (2.5, 97.5), 1 << 22


def interval_of_median(v: np.ndarray) -> tuple[float, float]:
    """The bootstrap interval of the median of values. The draws are taken in runs, whose stream is that of drawing all at once."""
    rng, medians, run = np.random.default_rng(SEED), [], max(1, DRAWN_AT_ONCE // len(v))
    for at in range(0, RESAMPLES, run):
        medians.append(np.median(v[rng.integers(0, len(v), (min(run, RESAMPLES - at), len(v)))], axis=1))
    low, high = np.percentile(np.concatenate(medians), INTERVAL)
    return float(low), float(high)


def _median_interval(values: pd.Series) -> list[float]:
    v = values.dropna().to_numpy(dtype=float)
    return list(interval_of_median(v)) if len(v) else []


def median_interval(df: DataFrame, keys: Names, value: str) -> DataFrame:
    """keys and the 95 % bootstrap interval of the median (1,000 resamples, seed 0). Meant for the few values that a recording has."""
    udf = F.pandas_udf(_median_interval_of, "array<double>")
    return df.groupBy(*keys).agg(udf(F.col(value).cast("double")).alias("median_interval"))


def _median_interval_of(values: pd.Series) -> list:
    return _median_interval(values)


_median_interval_of.__annotations__ = {"values": pd.Series, "return": list}


def ratios(df: DataFrame, keys: Names, raw: str, stored: str, member: str) -> DataFrame:
    """How many times smaller each member is stored than raw, and all together (null member): ratios of sums."""
    out = df.rollup(*keys, member).agg(F.sum(raw).alias("raw"), F.sum(stored).alias("stored"), F.grouping_id().alias("level"))
    return out.where(F.col("level") <= 1).select(*keys, member, F.try_divide("raw", "stored").alias("ratio"))


def in_use(value: Column) -> Column:
    """The distinct values of a group, in order."""
    return F.sort_array(F.collect_set(value))


def best_of(candidates: Column, score: Callable[[Column], Column]) -> Column:
    """best() of an array of candidates within a row, so nothing is shuffled; null if none has a score."""
    scored = F.transform(candidates, lambda c: F.struct(score(c).alias("score"), c.alias("candidate")))
    return F.array_max(F.filter(scored, lambda x: x["score"].isNotNull() & ~F.isnan(x["score"])))["candidate"]


def best(score: Column, candidate: Column) -> Column:
    """The candidate with the largest score; at ties the larger candidate. NaN scores don't count."""
    return F.max(F.when(~F.isnan(score), F.struct(score.alias("score"), candidate.alias("candidate"))))["candidate"]
