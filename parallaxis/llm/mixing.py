"""Mixing sources to target weights by capped water-filling.

Sources share the words of the whole corpus by weight. A source's target stops at a number of epochs of its
own size; what is over is dealt again by weight, until no target is above. That is one water level: with
sources in the order of (cap / weight), the first k are capped, and the level of the others is what is left
divided by the weights that are left. Running sums over the few rows of the source table give it, so there
is no loop.

The repetitions are whole documents: with f = target / size, every document of a source is taken floor(f)
times, and a seeded choice of documents once more. The choice is exact: documents are ordered by a hash of
seed and doc_id, and the cut is where the running sum of sizes comes nearest to the fraction. The running
sum is taken in two steps: over at most BUCKETS sums of each source, then over the one bucket with the cut,
so no task gets a whole source. Each source ends within half a document of its target (rows that share a
doc_id are taken together). Reruns agree.

Null texts have size 0; a source without words gets target 0 and nothing is taken. Null is a source of its own, last in order.
Repeated rows count each. An empty table gives an empty result. Other columns are ignored. No Python
runs on executors; only the table with one row per source is joined back, broadcast if it has at most
BROADCAST_SOURCES rows, else shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Carried, pick, written

BUCKETS = 1024
BROADCAST_SOURCES = 10_000
WEIGHTS = (5.0, 2.0, 1.0)
EPOCHS = 3.0
SEED = 20_240_607


def size_of(text: Column) -> Column:
    """How many `[^\\x20\\x09-\\x0D]+` a text has."""
    plain = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.array_remove(F.split(plain, " "), "")).cast("long")


def order_of(doc_id: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed).cast("long"), doc_id)


def weigh(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Adds weight: the weights in turn, to sources by code point, null last."""
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.pmod(n, F.lit(len(weights)))))


def fill(sources: DataFrame, epochs: float = EPOCHS) -> DataFrame:
    """sources: source, source_size, weight. Adds target. One row per source, so these windows are over a small table."""
    cap = F.col("source_size") * F.lit(epochs)
    by = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    left = F.col("all_size") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    # the level if this source and all after it were not capped; the first that stays below its cap sets it
    levelled = (
        sources.withColumn("cap", cap)
        .withColumn("all_size", F.sum("source_size").over(everything).cast("double"))
        .withColumn("level", left / weight_left)
        .withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything)["level"])
    )
    target = F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))))
    return levelled.select("source", "source_size", "weight", target.alias("target"))


def cuts(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """targets and, for each source: whole (times every document is taken) and cut (documents whose hash is at most this once more; null: none)."""
    f = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = targets.withColumn("whole", F.floor(f + 1e-12).cast("int")).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    bucket = F.shiftright("h", 54)  # 1024 ranges of the hash, in its order
    sums = sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("s"))
    run = Window.partitionBy("source").orderBy("bucket")
    sums = sums.withColumn("upto", F.sum("s").over(run)).withColumn("before", F.col("upto") - F.col("s"))
    small = F.broadcast if targets.count() <= BROADCAST_SOURCES else (lambda d: d)
    p, s = plan.alias("p"), sums.alias("s")
    edge = s.join(small(p), F.col("s.source").eqNullSafe(F.col("p.source"))).where("before < rest AND rest <= upto")
    edge = edge.groupBy(F.col("p.source").alias("source")).agg(F.min(F.struct("bucket", "before", "rest")).alias("e")).select("source", "e.*")
    d, e = sized.withColumn("bucket", bucket).alias("d"), edge.alias("e")
    inside = d.join(small(e), F.col("d.source").eqNullSafe(F.col("e.source")) & (F.col("d.bucket") == F.col("e.bucket")))
    inside = inside.groupBy(F.col("d.source").alias("source"), "h").agg(F.sum("size").alias("size"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    w = Window.partitionBy("source").orderBy("h")
    # a document is taken if the cut lies beyond its middle
    inside = inside.withColumn("mid", F.col("before") + F.sum("size").over(w) - F.col("size") / 2)
    last = inside.groupBy("source").agg(F.max(F.when(F.col("mid") <= F.col("rest"), F.col("h"))).alias("in_h"), F.min("h").alias("first_h"))
    # nothing of the edge bucket: all that come before it
    last = last.select(F.col("source").alias("source_"), F.coalesce("in_h", F.col("first_h") - 1).alias("cut"))
    return plan.join(small(last), plan["source"].eqNullSafe(last["source_"]), "left").select("source", "source_size", "weight", "target", "whole", "cut")


def mixture(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: float = EPOCHS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(decisions per row: doc_id, source, size, h; the plan per source). Sizes are counted once and written."""
    sized = pick(docs, "doc_id", "source", "text").select("doc_id", "source", size_of(F.col("text")).alias("size"), order_of(F.col("doc_id"), seed).alias("h"))
    sized = written(sized, "sizes")
    sources = written(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    targets = fill(weigh(sources, weights), epochs)
    return sized, written(cuts(sized, targets), "mix")


def apply_plan(df: DataFrame, source: Column, h: Column, plan: DataFrame) -> DataFrame:
    """Adds source_size, target and reps to rows; source and h are columns of theirs."""
    small = F.broadcast if plan.count() <= BROADCAST_SOURCES else (lambda d: d)
    p = small(plan.select(F.col("source").alias("source_"), "source_size", "target", F.col("whole").alias("whole_"), F.col("cut").alias("cut_")))
    once_more = F.when(h <= F.col("cut_"), 1).otherwise(0)
    return df.join(p, source.eqNullSafe(F.col("source_")), "left").withColumn("reps", F.coalesce(F.col("whole_") + once_more, F.lit(0)))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: float = EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, reps, taken for every row."""
    sized, plan = mixture(docs, weights, epochs, seed)
    return apply_plan(sized, F.col("source"), F.col("h"), plan).select("doc_id", "source", "size", "source_size", "target", "reps", (F.col("reps") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: float = EPOCHS, seed: int = SEED) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    _, plan = mixture(docs, weights, epochs, seed)
    c = Carried(docs)
    out = apply_plan(c.rows, c["source"], order_of(c["doc_id"], seed), plan).where("reps > 0")
    return c.restored(out.select("row_", F.explode(F.sequence(F.lit(1), F.col("reps")))))
