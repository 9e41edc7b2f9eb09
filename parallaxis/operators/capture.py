"""Operators of capture and of the lists around it: fan-out, format choice, configurations, upload state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Depth types by how precise they are.
DEPTH_RANK = {"fdep": 1, "hdep": 0}


def fanned_out(frames: DataFrame, streams: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One row per stream of each frame, all at the frame's time; streams without a value are left out. Values must be of one type."""
    parts = F.array(*[F.struct(F.lit(s).alias("stream"), F.col(s).alias("value")) for s in streams])
    return frames.select(*keys, F.explode(parts).alias("p")).select(*keys, "p.*").where("value IS NOT NULL")


def since_first(frames: DataFrame, keys: Sequence[str], ts: str, depth: str) -> DataFrame:
    """Frames from the first one with depth on: a session's format is that frame's, and those before it are swallowed."""
    w = Window.partitionBy(*keys)
    first = F.min(F.when(F.col(depth).isNotNull(), F.col(ts))).over(w)
    return frames.withColumn("first_", first).where(F.col(ts) >= F.col("first_")).drop("first_")


def with_latest(frames: DataFrame, samples: DataFrame, keys: Sequence[str], ts: str, sample_ts: str, value: str) -> DataFrame:
    """Each frame with the newest sample that was there; null before the first one."""
    from .joins import latest_or_first, on_keys

    late = samples.groupBy(*keys).agg(F.min(sample_ts).alias("first_sample_"))
    out = on_keys(latest_or_first(frames, samples, keys, ts, sample_ts, value), late, keys, "left")
    return out.withColumn(value, F.when(F.col(ts) >= F.col("first_sample_"), F.col(value))).drop("first_sample_")


def rank_of(kind: Column) -> Column:
    out = F.lit(-1)
    for k, r in DEPTH_RANK.items():
        out = F.when(kind == k, r).otherwise(out)
    return out


def supports(ranges: Column, duration: Column) -> Column:
    """Whether a frame duration lies within one of the ranges (array of structs low, high)."""
    return F.exists(ranges, lambda r: (r["low"] <= duration) & (duration <= r["high"]))


def best_pair(formats: DataFrame, keys: Sequence[str], duration: Column) -> DataFrame:
    """The colour and depth formats of a camera: of the pairs that support the duration the largest depth area, then the most precise
    type; at ties the pair that is listed first.

    formats: keys, color_no, ranges, depths (array of structs width, height, kind), in the order they are listed."""
    rows = formats.where(supports(F.col("ranges"), duration)).select(*keys, "color_no", F.posexplode("depths").alias("depth_no", "d"))
    order = F.struct((F.col("d.width") * F.col("d.height")).alias("area"), rank_of(F.col("d.kind")).alias("rank"), (-F.col("color_no")).alias("c"), (-F.col("depth_no")).alias("n"))
    return rows.groupBy(*keys).agg(F.max_by(F.struct("color_no", "depth_no", "d"), order).alias("best")).select(*keys, "best.*")


def best_video(formats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of the 4:3 formats the one with the largest area, then the highest frame rate."""
    ok = formats.where(F.col("width") * 3 == F.col("height") * 4)
    return ok.groupBy(*keys).agg(F.max_by(F.struct("width", "height", "fps"), F.struct(F.col("width") * F.col("height"), "fps")).alias("f")).select(*keys, "f.*")


def target(state: Column) -> Column:
    """Where a recording goes, out of its JSON: {"phone": ..} or {"upload": {"destination": ..}}; an upload without a destination stays on the phone."""
    other = F.get_json_object(state, "$.upload.destination")
    return F.when(F.array_contains(F.json_object_keys(state), "phone"), F.lit("phone")).otherwise(F.coalesce(other, F.lit("phone")))


def address(servers: Column, name: Column) -> Column:
    return F.try_element_at(servers, name)


def server_names(servers: Column) -> Column:
    return F.sort_array(F.map_keys(servers))


def all_configs(phone: Column, configs: Column, added: Column) -> Column:
    """The phone's own configuration, those of the file, and those that were added; nulls are none."""
    none = F.slice(configs, 1, 0)
    return F.concat(F.array(phone), F.coalesce(configs, none), F.coalesce(added, none))


def without_position(configs: Column, at: Column) -> Column:
    return F.filter(configs, lambda _, i: i != at)


def gallery(listings: DataFrame, state: DataFrame) -> DataFrame:
    """Recordings on the phone, newest first, with the state of an upload that is under way, or else that of the listing."""
    s = state.select(F.col("upload_key").alias("k"), F.col("state").alias("now_"))
    key = F.coalesce("upload_id", "scan_id")
    rows = listings.join(s, key == F.col("k"), "left").withColumn("state", F.coalesce("now_", "state")).drop("k", "now_")
    return rows.orderBy(F.desc_nulls_last("start_time_utc"), F.desc("scan_id"))


def finished(wanted: DataFrame, memory: DataFrame, disk: DataFrame, underway: DataFrame) -> DataFrame:
    """The finished recording under each key: the one in memory, or else on disk, but there not while it is under way.

    wanted, underway: upload_key; memory, disk: upload_id, scan_id and the same other columns. Keys without one have no row."""
    key = F.coalesce("upload_id", "scan_id").alias("upload_key")
    of = lambda df, place: df.select(key, F.struct(F.lit(place).alias("place"), "scan_id").alias("order_"), F.struct(*memory.columns).alias("info_"))
    rows = of(memory, 0).unionByName(of(disk, 1).join(underway.select("upload_key"), "upload_key", "left_anti"))
    rows = rows.join(wanted.select("upload_key"), "upload_key", "left_semi")
    return rows.groupBy("upload_key").agg(F.min_by("info_", "order_").alias("info_")).select("upload_key", "info_.*")


def progress(parts: DataFrame, sent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, started: whether parts that are stored or under way have bytes at all; progress: the share of the bytes that are
    stored or sent so far, where there are none no number. parts: keys, name, size, uploaded; sent: keys, name, bytes.

    Rows of one part add up; what was sent of stored or unknown parts doesn't count."""
    rows = parts.select(*keys, "name", "size", "uploaded", F.lit(True).alias("part_")).unionByName(sent.select(*keys, "name", "bytes", F.lit(True).alias("sent_")), allowMissingColumns=True)
    each = rows.groupBy(*keys, "name").agg(
        F.sum("size").alias("size_"),
        F.sum(F.when(F.col("uploaded"), F.col("size"))).alias("stored_"),
        F.sum("bytes").alias("bytes_"),
        *[F.bool_or(c).alias(c) for c in ("uploaded", "part_", "sent_")],
    )
    done = F.when(F.col("uploaded"), F.col("stored_")).otherwise(F.coalesce("bytes_", F.lit(0)))
    begun = F.when(F.col("uploaded"), F.col("stored_")).when(F.col("sent_"), F.col("size_")).otherwise(0)
    of = each.where("part_").groupBy(*keys).agg(F.sum(begun).alias("begun_"), F.sum(done).alias("done_"), F.sum("size_").alias("size_"))
    share = F.when(F.col("size_") == 0, F.col("done_") * F.lit(float("inf"))).otherwise(F.try_divide("done_", "size_"))
    return of.select(*keys, (F.col("begun_") > 0).alias("started"), share.alias("progress"))
