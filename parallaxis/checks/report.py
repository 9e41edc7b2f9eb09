"""The quality report: every check of every recording as a row (scan_id, check_no, name, passed).

kernels once over the frames. A check that doesn't apply to a recording's version or camera has no row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parallaxis.functions import geometry
from parallaxis.kernels import alignment, frames as kernels
from parallaxis.operators import joins, series, stats
from parallaxis.sources import layout, recording_tar

K = layout.K_CELLS
#: A fixed value: the highest level of confidence.
HIGH_CONFIDENCE = 2
Carry = Callable[[Sequence[Column], Column, Column], list[Column]]


@dataclass
class Tables:
    recordings: DataFrame
    frames: DataFrame
    runs: DataFrame
    calibrations: DataFrame
    members: DataFrame
    #: Frames of colour, depth and confidence; each reads its own stream only.
    color: DataFrame
    depth: DataFrame
    confidence: DataFrame
    #: Where frames of colour and depth lie, for joins that would carry their bytes along.
    color_places: DataFrame
    depth_places: DataFrame

    def release(self) -> None:
        """Lets go of what tables() keeps."""
        self.recordings.unpersist()
        self.frames.unpersist()


def tables(spark: SparkSession, path: str, keep: bool = True) -> Tables:
    """The tables of a report. Recordings and rows of frames, which most parts of a report read, are read once and kept, on disk where memory
    is short, until release(), unless keep is false."""
    load = lambda t, **o: recording_tar.load(spark, path, t, **o)
    kept = lambda df: df.persist() if keep else df
    return Tables(kept(load("recordings")), kept(load("frames")), load("runs"), load("calibrations"), load("members", measure="true"), *[load("blobs", stream=x) for x in ("color", "depth", "confidence")], *[load("blobs", stream=x, content="false") for x in ("color", "depth")])


def pairs(t: Tables) -> DataFrame:
    """Every delivered depth frame with the colour row, delivered or dropped, of the same instant."""
    depth = t.frames.where("stream = 'depth' AND frame_index IS NOT NULL").select("scan_id", F.col("frame_index").alias("depth_index"), F.col("ts").alias("depth_ts"), F.col("intrinsics").alias("depth_k"))
    color = t.frames.where("stream = 'color'").select("scan_id", F.col("frame_index").alias("color_index"), F.col("ts").alias("color_ts"), F.col("intrinsics").alias("color_k"), F.col("pos").alias("color_pos"))
    return joins.same_instant(depth, color, ["scan_id"], "depth_ts", "color_ts", "color_pos")


def _all(condition: Column) -> Column:
    """Over the group: true unless a row fails; a null condition fails."""
    return F.coalesce(F.bool_and(F.coalesce(condition, F.lit(False))), F.lit(True))


def _streams(t: Tables) -> DataFrame:
    """One row per recording with what its delivered frames and dropped rows say."""
    f = t.frames
    got, color = F.col("frame_index").isNotNull(), F.col("stream") == "color"
    lacks = lambda c: F.coalesce(c, F.lit(False))
    k = F.col("intrinsics").isNotNull()
    orientation = F.col("upright_rotation_deg").isNotNull() & F.col("gravity").isNotNull() & F.col("gravity_ts").isNotNull()
    for n in K:
        k = k & F.col(f"intrinsics.{n}").isNotNull()
    ordered = f.where(got).withColumn("up", F.col("ts") > F.lag("ts").over(series.series(["scan_id", "stream"], "pos"))).withColumn("in_place", F.col("frame_index") == F.row_number().over(series.series(["scan_id", "stream"], "pos")) - 1)
    delivered = ordered.groupBy("scan_id").agg(
        F.count_if(color).alias("n_color"), F.count_if(~color).alias("n_depth"), F.coalesce(F.bool_and("up"), F.lit(True)).alias("increasing"), _all(F.col("in_place")).alias("indexed"),
        _all(k).alias("has_k"), _all(orientation).alias("oriented"), _all(~color | orientation).alias("color_oriented"), _all(color | ~lacks(F.col("filtered")) & F.col("filtered").isNotNull()).alias("unfiltered"),
        _all(~color | geometry.is_pose(F.col("tracking_state"), F.col("world_from_camera"))).alias("posed"),
    )
    packed = F.col("depth_width") * 4
    strides = f.where(~color).join(t.recordings.select("scan_id", "depth_width"), "scan_id")
    strides = strides.groupBy("scan_id").agg(_all(F.when(got, F.coalesce(F.col("bytes_per_row") >= packed, F.lit(False))).otherwise(F.col("bytes_per_row").isNull())).alias("strides"))
    return delivered.join(strides, "scan_id", "left")


def _times(t: Tables, p: DataFrame) -> DataFrame:
    """Whether every depth frame within the colour rows' span has a colour row at its instant."""
    span = t.frames.where("stream = 'color'").groupBy("scan_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    inside = lambda df, ts: df.join(span, "scan_id").where(F.col(ts).between(F.col("a"), F.col("b"))).groupBy("scan_id").agg(F.count("*").alias("n"))
    depth = inside(t.frames.where("stream = 'depth' AND frame_index IS NOT NULL"), "ts").withColumnRenamed("n", "n_in")
    return t.recordings.select("scan_id").join(depth, "scan_id", "left").join(inside(p, "depth_ts"), "scan_id", "left").select("scan_id", (F.coalesce("n_in", F.lit(0)) == F.coalesce("n", F.lit(0))).alias("timed"))


def carried(t: Tables, p: DataFrame, carry: Carry | None = None) -> DataFrame:
    """Whether the depth intrinsics are the same-instant colour frame's carried to the depth map; not if there is no pair. carry
    takes fx, fy, cx, cy and the scales of both axes; without one it is that of the camera."""
    r = t.recordings.select("scan_id", "camera", geometry.ratio(F.col("depth_width"), F.col("color_width")).alias("sx"), geometry.ratio(F.col("depth_height"), F.col("color_height")).alias("sy"))
    rows = p.where("color_index IS NOT NULL").join(r, "scan_id")
    k = [F.col(f"color_k.{n}") for n in K]
    match = F.lit(True)
    rear, front = (f(k, F.col("sx"), F.col("sy")) for f in ((carry, carry) if carry else (geometry.grid_carried, geometry.plainly_scaled)))
    for n, r_, f_ in zip(K, rear, front, strict=True):
        match = match & geometry.close(F.col(f"depth_k.{n}"), F.when(F.col("camera") == "rear", r_).otherwise(f_))
    return rows.groupBy("scan_id").agg(F.bool_and(match).alias("carried"))


CALIBRATION = "struct<intrinsic_matrix_row_major:array<array<double>>,intrinsic_reference_width:double,intrinsic_reference_height:double>"


def _calibrated(t: Tables) -> DataFrame:
    """For the tables of a front camera: a line per depth frame, with its index and time; and its intrinsics scaled from the line's."""
    c = t.calibrations.withColumn("cal", F.from_json("calibration_json", CALIBRATION))
    d = series.numbered(t.frames.where("stream = 'depth' AND frame_index IS NOT NULL").select("scan_id", F.col("frame_index").alias("di"), F.col("ts").alias("dts"), "intrinsics", "pos"), ["scan_id"], ["pos"], "line_no")
    size = t.recordings.where("camera = 'front' AND format_minor < 8").select("scan_id", "depth_width", "depth_height")
    rows = d.join(c.withColumn("line_no", F.col("line_no").cast("long")), ["scan_id", "line_no"], "full").join(size, "scan_id")
    at = lambda i, j: F.col("cal.intrinsic_matrix_row_major")[i][j].cast("float")
    sx, sy = geometry.ratio(F.col("depth_width"), F.col("cal.intrinsic_reference_width")), geometry.ratio(F.col("depth_height"), F.col("cal.intrinsic_reference_height"))
    scaled = geometry.plainly_scaled([at(0, 0), at(1, 1), at(0, 2), at(1, 2)], sx, sy)
    match = F.col("cal").isNotNull()
    for n, v in zip(K, scaled, strict=True):
        match = match & geometry.close(F.col(f"intrinsics.{n}"), v)
    line = (F.col("frame_index") == F.col("di")) & (F.abs(F.col("ts") - F.col("dts")) < joins.SAME_INSTANT_S)
    return rows.groupBy("scan_id").agg(_all(line).alias("lines"), _all(match).alias("scaled"))


def _attributed(t: Tables) -> DataFrame:
    """Frames that runs cover, by kind; runs are disjoint, or the archive would not have loaded."""
    n = F.col("last") - F.col("first") + 1
    kinds = ("color_distortion", "depth_distortion", "depth_to_color")
    return t.runs.groupBy("scan_id").agg(*[F.sum(F.when(F.col("kind") == k, n).otherwise(0)).alias(k) for k in kinds])


def _members(t: Tables) -> DataFrame:
    """Sizes and hashes as recorded and as measured."""
    own = t.members.groupBy("scan_id")
    return own.agg(
        _all(F.col("size") == F.col("stored_size_sum")).alias("whole"), _all(F.col("size") == F.col("recorded_size")).alias("sized"), _all(F.col("sha256") == F.col("recorded_sha256")).alias("hashed"),
        F.bool_and(F.col("recorded_sha256").isNotNull()).alias("has_hash"), *[F.max(F.when(F.col("stream") == s, F.col("frames"))).alias(f"{s}_stored") for s in ("color", "depth", "confidence")],
    )


def _pixels(t: Tables) -> DataFrame:
    lossless = kernels.lossless(t.color.unionByName(t.depth).unionByName(t.confidence).where("raw_sha256 IS NOT NULL")).groupBy("scan_id").agg(_all(F.col("is_lossless")).alias("lossless"))
    levels = kernels.depth_statistics(t.confidence).groupBy("scan_id").agg(_all(F.col("level") <= 2).alias("levels"))
    return t.recordings.select("scan_id").join(lossless, "scan_id", "left").join(levels, "scan_id", "left")


def temporal(t: Tables, p: DataFrame) -> DataFrame:
    """scan_id, best_offset."""
    delivered = p.where("color_index IS NOT NULL").select("scan_id", "color_index", "depth_index")
    scores = kernels.offset_scores(delivered, kernels.luma_edges(t.color, t.recordings), kernels.depth_edges(t.depth))
    return series.best_offset(scores, ["scan_id"])


def spatial(t: Tables, p: DataFrame, depth_k: Column | None = None) -> DataFrame:
    """The alignment report of each recording that has pairs to compare. depth_k takes the place of the depth frames' intrinsics; it is
    a column over scan_id, depth_index, color_k and depth_k."""
    shares = kernels.depth_statistics(t.depth).where(F.col("valid_share") >= alignment.LEAST_VALID).select("scan_id", F.col("frame_index").alias("depth_index"))
    good = p.where("color_index IS NOT NULL AND color_k IS NOT NULL AND depth_k IS NOT NULL").join(shares, ["scan_id", "depth_index"])
    if depth_k is not None:
        good = good.withColumn("depth_k", depth_k)
    chosen = series.subsample(good, ["scan_id"], ["depth_index"], alignment.MOST_PAIRS)
    blob = lambda s: getattr(t, f"{s}_places").select("scan_id", F.col("frame_index").alias(f"{s}_index"), F.struct(*kernels.PLACE).alias(s))
    rows = chosen.join(blob("color"), ["scan_id", "color_index"]).join(blob("depth"), ["scan_id", "depth_index"]).join(t.recordings.select("scan_id", "camera"), "scan_id")
    return kernels.alignment_report(kernels.alignment_fits(rows))


def facts(t: Tables) -> DataFrame:
    """One row per recording with everything that the checks are about."""
    p = pairs(t)
    out = t.recordings
    for part in (_streams(t), _times(t, p), carried(t, p), _calibrated(t), _attributed(t), _members(t), _pixels(t), temporal(t, p), spatial(t, p)):
        out = out.join(part, "scan_id", "left")
    return out


def definitions() -> list[tuple[int, str, Column, Column]]:
    """(number, name, applies, passes) over a row of facts."""
    c = F.col
    is_ = lambda name: F.coalesce(c(name), F.lit(False))
    split, rear, front = c("format_minor") >= 8, c("camera") == "rear", c("camera") == "front"
    old, hashed = ~split, split & is_("has_hash")
    meta = lambda key: F.get_json_object("metadata_json", f"$.{key}")
    keys = F.array_sort("scan_keys")
    exact = F.when(c("format_version") == "5.2", keys == F.array(*map(F.lit, sorted(layout.scan_keys("5.2"))))).otherwise(keys == F.array(*map(F.lit, sorted(layout.scan_keys("4.8")))))
    named = F.coalesce((F.length(F.trim("name")) > 0) & (c("duration_s") > 0), F.lit(False))
    counts = (c("color_stored") == c("n_color")) & (c("depth_stored") == c("n_depth"))
    tables_ = "struct<avfoundation_calibration:struct<lens_distortion_lookup_table:array<double>,inverse_lens_distortion_lookup_table:array<double>,intrinsic_reference_width:double,intrinsic_reference_height:double>>"
    cal = F.from_json("metadata_json", tables_)["avfoundation_calibration"]
    complete = geometry.complete_calibration(cal["lens_distortion_lookup_table"], cal["inverse_lens_distortion_lookup_table"], cal["intrinsic_reference_width"], cal["intrinsic_reference_height"])
    covered = (c("color_distortion") == c("n_color")) & (c("depth_distortion") == c("n_depth")) & (c("depth_to_color") == c("n_depth"))
    levels = F.coalesce(c("levels"), F.lit(True)) & (c("confidence_stored") == c("depth_stored"))
    always = F.lit(True)
    return [
        (1, "each frame member holds its frames", split, is_("whole") & counts),
        (2, "each frame member has its recorded size and SHA-256", hashed, is_("sized") & is_("hashed")),
        (3, "each frame member has its recorded size", split & ~is_("has_hash"), is_("sized")),
        (4, "every frame decodes to the bytes that were hashed", split & c("encoded"), F.coalesce(c("lossless"), F.lit(True))),
        (5, "color.bin holds a frame per row with an index", old, (c("color_stored") == c("n_color")) & (c("n_color") == meta("color_frames").cast("int"))),
        (6, "depth.bin holds a map per row with an index", old, (c("depth_stored") == c("n_depth")) & (c("n_depth") == meta("depth_frames").cast("int"))),
        (7, "indices are 0..n-1", old, is_("indexed")),
        (8, "timestamps strictly increase", always, is_("increasing")),
        (9, "every depth frame within the colour span has a colour row at its instant", always, is_("timed")),
        (10, "depth aligns best with its same-instant colour frame", always, F.coalesce(c("best_offset") == 0, F.lit(False))),
        (11, "depth edges land on colour edges", always, is_("aligned")),
        (12, "depth_filtering_enabled is false", old, F.coalesce(meta("depth_filtering_enabled") == "false", F.lit(False))),
        (13, "every depth map is unfiltered", front, is_("unfiltered")),
        (14, "every frame has intrinsics", always, is_("has_k")),
        (15, "one intrinsics entry per frame", split, (c("n_color_intrinsics") == c("color_stored")) & (c("n_depth_intrinsics") == c("depth_stored"))),
        (16, "depth intrinsics are the colour frame's carried to the depth grid", rear, is_("has_k") & is_("carried")),
        (17, "depth intrinsics are the colour frame's scaled", front & split, is_("has_k") & is_("carried")),
        (18, "one calibration line per depth frame", front & old, is_("lines")),
        (19, "depth intrinsics are the calibration's scaled", front & old, is_("lines") & is_("has_k") & is_("scaled")),
        (20, "every depth map has its bytes per row", old, is_("strides")),
        (21, "every frame has orientation and gravity", old, is_("oriented")),
        (22, "every colour frame has orientation and gravity", split, is_("color_oriented")),
        (23, "every frame has a distortion, every depth frame a depth_to_color", front & split, F.coalesce(covered, F.lit(False))),
        (24, "one valid pose per colour frame", rear & split, (c("n_poses") == c("color_stored")) & is_("posed")),
        (25, "confidence has a map per depth map, levels 0 to 2", rear & split, levels),
        (26, "every colour frame has a valid pose", rear & old, is_("posed")),
        (27, "confidence.bin has a map per depth map, levels 0 to 2", rear & old, levels),
        (28, "metadata has the complete wide-camera calibration", rear & c("format_minor").between(4, 6), complete),
        (29, "scan_metadata has exactly its keys, a name and a duration", split, exact & named),
        (30, "metadata has a name and a duration", old, named & F.array_contains("scan_keys", "named_by_user") & F.array_contains("scan_keys", "name") & F.array_contains("scan_keys", "duration_s")),
    ]


def checks(t: Tables) -> DataFrame:
    """scan_id, check_no, name, passed."""
    rows = [F.struct(F.lit(n).alias("check_no"), F.lit(name).alias("name"), F.when(applies, F.coalesce(passes, F.lit(False))).alias("passed")) for n, name, applies, passes in definitions()]
    out = facts(t).select("scan_id", F.array(*rows).alias("rows"))
    return out.select("scan_id", F.explode("rows").alias("r")).select("scan_id", "r.*").where("passed IS NOT NULL")


def readings(t: Tables) -> DataFrame:
    """scan_id; depth and high (where there is confidence, of its highest level): lowest, p1, median, p99, highest, count; stretch: p2 and
    p98; confidence: the share of valid pixels at each level, also of levels that don't occur."""
    n = kernels.reading_counts(t.depth, t.confidence)
    kinds = F.array_compact(F.array(F.lit("depth"), F.when(F.col("level") == HIGH_CONFIDENCE, "high")))
    each = n.withColumn("kind", F.explode(kinds)).groupBy("scan_id", "kind", "metres").agg(F.sum("n").alias("n"))
    ends = each.groupBy("scan_id", "kind").agg(F.min("metres").alias("low"), F.max("metres").alias("far"), F.sum("n").alias("count"))
    q = stats.exact_quantiles(each, ["scan_id", "kind"], "metres", 0.01, 0.02, 0.5, 0.98, 0.99, times="n")
    at = lambda i: F.get("q", F.lit(i))
    each = ends.join(q, ["scan_id", "kind"]).withColumn("r", F.struct("low", at(0).alias("p1"), at(2).alias("median"), at(4).alias("p99"), F.col("far").alias("high"), "count"))
    of = lambda kind, c: F.any_value(F.when(F.col("kind") == kind, c), ignoreNulls=True)
    ranges = each.groupBy("scan_id").agg(of("depth", F.col("r")).alias("depth"), of("high", F.col("r")).alias("high"), of("depth", F.array(at(1), at(3))).alias("stretch"))
    level = lambda v: F.try_divide(F.sum(F.when(F.col("level") == v, F.col("n")).otherwise(0)), F.sum(F.when(F.col("level").isNotNull(), F.col("n"))))
    shares = n.groupBy("scan_id").agg(F.when(F.count("level") > 0, F.array(*map(level, range(HIGH_CONFIDENCE + 1)))).alias("confidence"))
    return ranges.join(shares, "scan_id")


def _by_value(rows: DataFrame, value: str, name: str, share: bool = False) -> DataFrame:
    """scan_id and a map from each value to its rows, or to its share of them, by value; the values are few kinds of text."""
    n = rows.groupBy("scan_id", value).agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(value).alias("key"), F.col("n").alias("value"))))
    out = n.groupBy("scan_id").agg(entries.alias("e"), F.sum("n").alias("all"))
    if share:
        return out.select("scan_id", F.map_from_entries(F.transform("e", lambda x: F.struct(x["key"], x["value"] / F.col("all")))).alias(name))
    return out.select("scan_id", F.map_from_entries("e").alias(name))


def _paired(t: Tables) -> DataFrame:
    """scan_id, pairs, pairs_with_color, depth_out_of_span: how depth frames meet colour rows, and how many lie beyond all of them."""
    met = pairs(t).groupBy("scan_id").agg(F.count("*").alias("pairs"), F.count("color_index").alias("pairs_with_color"))
    f, color = t.frames, F.col("stream") == "color"
    span = f.groupBy("scan_id").agg(F.min(F.when(color, F.col("ts"))).alias("a"), F.max(F.when(color, F.col("ts"))).alias("b"))
    beyond = f.where("stream = 'depth' AND frame_index IS NOT NULL").join(span, "scan_id").groupBy("scan_id").agg(F.count_if(~F.col("ts").between(F.col("a"), F.col("b"))).alias("depth_out_of_span"))
    return met.join(beyond, "scan_id", "full")


def statistics(t: Tables) -> DataFrame:
    """What the report prints besides the checks, one row per recording. Numbers that a version or camera doesn't record are null."""
    f, got, color = t.frames, F.col("frame_index").isNotNull(), F.col("stream") == "color"
    of = lambda s, c: F.when(got & (F.col("stream") == s), c)
    g = F.sqrt(F.aggregate("gravity", F.lit(0.0), lambda a, x: a + x * x))
    rate = lambda s: F.try_divide(F.count(of(s, F.col("ts"))) - 1, F.max(of(s, F.col("ts"))) - F.min(of(s, F.col("ts"))))
    per = f.groupBy("scan_id").agg(
        F.count(of("color", F.col("ts"))).alias("color_frames"), rate("color").alias("color_fps"), F.count(of("depth", F.col("ts"))).alias("depth_frames"), rate("depth").alias("depth_fps"),
        F.count_if(~got & color).alias("color_dropped"), F.count_if(~got & ~color).alias("depth_dropped"), F.avg(of("color", g)).alias("gravity"), F.sort_array(F.collect_set(of("color", F.col("upright_rotation_deg")))).alias("rotations"),
        F.min(of("color", F.col("intrinsics.fx"))).alias("color_fx_min"), F.max(of("color", F.col("intrinsics.fx"))).alias("color_fx_max"), F.min(of("depth", F.col("intrinsics.fx"))).alias("depth_fx_min"), F.max(of("depth", F.col("intrinsics.fx"))).alias("depth_fx_max"),
        F.count(of("color", F.col("intrinsics.fx"))).alias("color_fx_frames"), F.count(of("depth", F.col("intrinsics.fx"))).alias("depth_fx_frames"), F.sort_array(F.collect_set(of("depth", F.col("bytes_per_row")))).alias("depth_bytes_per_row"),
        *[g for name, c in (("exposure", F.col("exposure_s")), ("lens", F.col("lens_position")), ("latency", F.col("received_ts") - F.col("ts"))) for g in (F.min(of("color", c)).alias(f"{name}_min"), F.max(of("color", c)).alias(f"{name}_max"), F.median(of("color", c)).alias(f"{name}_median"))],
    )
    cover = kernels.depth_statistics(t.depth).groupBy("scan_id").agg(stats.quantiles(F.col("valid_share") * 100, 0, 0.05, 0.25, 0.5, 0.75, 0.95, 1).alias("coverage"), F.min("low").alias("nearest"), F.max("high").alias("farthest"))
    lost = [_by_value(f.where(~got & (F.col("stream") == s)), "dropped", f"{s}_dropped_by_reason") for s in ("color", "depth")]
    tracking = _by_value(f.where(got & color & F.col("tracking_state").isNotNull()), "tracking_state", "tracking", share=True)
    out = t.recordings.select("scan_id", "camera", "format_version", "frame_rate")
    for part in (per, *lost, tracking, _paired(t), cover, readings(t)):
        out = out.join(part, "scan_id", "left")
    return out
