"""From a recorder's work log to a recording: its JSON files, the order of its members, and what keeps it from being one.

    parts = compose.parts(starts, color, depth, segments)
    archive_writer.write_archives(parts, root)

starts, color, depth: lines with the schemas of worklog; segments: scan_id, file, seg_index, size, and path (the staged file), sha256 and
prefix as they are wanted in the parts. Everything is joined and grouped by recording; a recording's lists become one document each, which
is what the format has, so no group is larger than a file of the archive. Recordings with faults() are left out, and recordings
without a colour or without a depth frame aren't ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parallaxis.functions import geometry, scalar
from parallaxis.operators import joins, runs

from . import archive_writer, layout, recording_tar, worklog

#: Fixed values of the format.
VERSION = "5.2"
COLOR_BIN, DEPTH_BIN, CONFIDENCE_BIN = "color_frames.bin", "depth_frames.bin", "depth_frames_confidence.bin"
IDENTITY = ((1.0, 0.0, 0.0, 0.0), (0.0, 1.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0))
MEMBERS = ("scan_metadata.json", COLOR_BIN, "color_frames_metadata.json", DEPTH_BIN, "depth_frames_metadata.json", CONFIDENCE_BIN, "color_intrinsics.json", "depth_intrinsics.json", "extrinsics.json")


def _json(doc: Column) -> Column:
    """Nulls are written: a null and no key differ."""
    return F.to_json(doc, {"ignoreNullFields": "false"})


def _listed(order: str, value: Column) -> Column:
    """Values in order, nulls too, as an array."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order, value.alias("v")))), lambda x: x["v"])


def logged_bytes(color: DataFrame, depth: DataFrame) -> DataFrame:
    """scan_id, file, bytes: what the lines of each frames file account for; a confidence file only where there are its sizes."""
    part = lambda df, size, file: df.where("reason IS NULL").groupBy("scan_id").agg(F.sum(size).alias("bytes")).select("scan_id", F.lit(file).alias("file"), "bytes")
    out = part(color, "compressed_size", COLOR_BIN).unionByName(part(depth, "compressed_size", DEPTH_BIN))
    return out.unionByName(part(depth, "confidence_compressed_size", CONFIDENCE_BIN).where("bytes IS NOT NULL"))


def faults(starts: DataFrame, color: DataFrame, depth: DataFrame, segments: DataFrame) -> DataFrame:
    """scan_id, fault, file: why a work log can't become a recording; one row for each fault of a file.

    not_in_time_order: a delivered line isn't later than the one before it. pose_count: a rear colour frame without a pose, or a front one with one.
    no_confidence_size: a rear map without its confidence map's size. segment_order: segments aren't numbered 0, 1, ... without a gap.
    segment_size: segments hold other bytes than the lines account for. no_encoding: a delivered line without a size or hash of its frame."""
    cameras = starts.select("scan_id", "camera")
    c, d = (df.where("reason IS NULL") for df in (color, depth))
    out = []

    def add(found: DataFrame, fault: str, file: str | None = None) -> None:
        own = F.col("file") if file is None else F.lit(file)
        out.append(found.select("scan_id", F.lit(fault).alias("fault"), own.alias("file")))

    for df, file in ((color, COLOR_BIN), (depth, DEPTH_BIN)):
        add(worklog.ordered_in_time(df), "not_in_time_order", file)
        stored = (F.col("compressed_size") > 0) & scalar.is_sha256(F.col("raw_sha256"))
        add(df.where("reason IS NULL").where(~F.coalesce(stored, F.lit(False))).select("scan_id").distinct(), "no_encoding", file)
    posed = c.groupBy("scan_id").agg(F.count("pose").alias("poses"), F.count("*").alias("frames")).join(cameras, "scan_id")
    add(posed.where("poses <> CASE WHEN camera = 'rear' THEN frames ELSE 0 END"), "pose_count", COLOR_BIN)
    add(d.join(cameras.where("camera = 'rear'"), "scan_id").where("confidence_compressed_size IS NULL").select("scan_id").distinct(), "no_confidence_size", DEPTH_BIN)
    held = segments.groupBy("scan_id", "file").agg(F.count("*").alias("n"), F.count_distinct("seg_index").alias("distinct"), F.min("seg_index").alias("low"), F.max("seg_index").alias("high"), F.sum("size").alias("held"))
    add(held.where("low <> 0 OR high <> n - 1 OR distinct <> n"), "segment_order")
    both = joins.on_keys(logged_bytes(color, depth).where("bytes > 0"), held, ["scan_id", "file"], "full")
    add(both.where("NOT bytes <=> held"), "segment_size")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def _runs(frames: DataFrame, value: Column) -> DataFrame:
    """scan_id, entries: an array of (value, ranges), each distinct value once, in the order of first appearance."""
    found = runs.entries(runs.encode(frames, ["scan_id"], "frame_index", value), ["scan_id"])
    return found.groupBy("scan_id").agg(_listed("entry_no", F.struct("value", "ranges")).alias("entries"))


def color_distortions(color: DataFrame, depth: DataFrame) -> DataFrame:
    """scan_id, frame_index, color_distortion of delivered colour frames: that of the latest depth frame up to its time that has one, or else
    of the first that has one."""
    known = worklog.delivered(depth).where("color_distortion IS NOT NULL").select("scan_id", F.col("timestamp").alias("t"), "color_distortion")
    return joins.latest_or_first(worklog.delivered(color).select("scan_id", "frame_index", "timestamp"), known, ["scan_id"], "timestamp", "t", "color_distortion").drop("timestamp")


def distortion_runs(color: DataFrame, depth: DataFrame) -> DataFrame:
    """scan_id, kind, entry_no, value, ranges: runs of the distortions of both streams and of the transforms between them."""
    d = worklog.delivered(depth)
    out = None
    for kind, df, value in (("color_distortion", color_distortions(color, depth), "color_distortion"), ("depth_distortion", d, "distortion"), ("depth_to_color", d, "depth_to_color")):
        found = runs.entries(runs.encode(df, ["scan_id"], "frame_index", F.when(F.col(value).isNotNull(), F.to_json(F.struct(F.col(value).alias("v"))))), ["scan_id"])
        found = found.select("scan_id", F.lit(kind).alias("kind"), "entry_no", "value", "ranges")
        out = found if out is None else out.unionByName(found)
    return out


def identity_runs(starts: DataFrame, depth: DataFrame) -> DataFrame:
    """scan_id, entries of depth_to_color. The rear camera's maps are registered to its pictures, so all have the identity."""
    m = F.array(*[F.array(*map(F.lit, row)).cast("array<float>") for row in IDENTITY])
    frames = worklog.delivered(depth).join(starts.select("scan_id", "camera"), "scan_id")
    return _runs(frames, F.when(F.col("camera") == "rear", m).otherwise(F.col("depth_to_color")))


def _intrinsics(k: str = "intrinsics", scale: Column | None = None) -> Column:
    """A frame's intrinsics; with the scale of its distortion, their principal point is carried about the corner."""
    if scale is None:
        return F.col(k)
    moved = [geometry.about_corner(F.col(f"{k}.{n}"), F.get(scale, F.lit(i))).alias(n) for i, n in enumerate(("cx", "cy"))]
    carried = F.struct(F.col(f"{k}.fx").alias("fx"), F.col(f"{k}.fy").alias("fy"), *moved)
    return F.when(F.col(k).isNotNull() & scale.isNotNull(), carried).otherwise(F.col(k))


def documents(starts: DataFrame, color: DataFrame, depth: DataFrame, segments: DataFrame) -> DataFrame:
    """scan_id (of the log), id (of the recording), member, text: the six JSON files of each recording."""
    c, d = worklog.delivered(color), worklog.delivered(depth)
    c = c.join(color_distortions(color, depth), ["scan_id", "frame_index"], "left").join(starts.select("scan_id", "camera"), "scan_id")
    front = F.col("camera") == "front"
    frame = F.struct("timestamp", "upright_rotation_deg", "gravity", "gravity_timestamp", "exposure_duration_s", "compressed_size", "raw_sha256")
    k = F.when(front, _intrinsics(scale=F.col("color_distortion.scale"))).otherwise(_intrinsics())
    colors = c.groupBy("scan_id").agg(_listed("frame_index", frame).alias("c_frames"), _listed("frame_index", k).alias("c_k"), _listed("frame_index", F.col("pose")).alias("poses"))
    own, conf = F.struct("timestamp", "filtered", "accuracy", "quality", "compressed_size", "raw_sha256"), F.struct("timestamp", "compressed_size", "raw_sha256", "confidence_compressed_size", "confidence_raw_sha256")
    depths = d.groupBy("scan_id").agg(_listed("frame_index", own).alias("f_frames"), _listed("frame_index", conf).alias("r_frames"), _listed("frame_index", F.col("intrinsics")).alias("d_k"))
    lost = lambda df, name: df.where("reason IS NOT NULL").groupBy("scan_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("timestamp", "line_no", "reason"))), lambda x: F.struct(x["timestamp"].alias("timestamp"), x["reason"].alias("reason"))).alias(name))
    sizes = segments.groupBy("scan_id").agg(*[F.coalesce(F.sum(F.when(F.col("file") == file, F.col("size"))), F.lit(0)).alias(n) for n, file in (("c_size", COLOR_BIN), ("d_size", DEPTH_BIN), ("f_size", CONFIDENCE_BIN))])
    rows = starts.join(colors, "scan_id").join(depths, "scan_id").join(worklog.duration(color, depth), "scan_id")
    none = F.array().cast("array<struct<timestamp:double,reason:string>>")
    for more in (lost(color, "c_lost"), lost(depth, "d_lost"), sizes):
        rows = rows.join(more, "scan_id", "left")
    entry = f"array<struct<value:{worklog.DISTORTION},ranges:array<array<long>>>>"
    for frames, value, name in ((c, "color_distortion", "c_runs"), (d, "distortion", "d_runs")):
        rows = rows.join(_runs(frames, F.col(value)).select("scan_id", F.col("entries").cast(entry).alias(name)), "scan_id", "left").withColumn(name, F.coalesce(name, F.array().cast(entry)))
    rows = rows.join(identity_runs(starts, depth).withColumnRenamed("entries", "t_runs"), "scan_id", "left")
    rows = rows.withColumn("start_", F.to_timestamp("start_time_utc")).withColumn("id", scalar.scan_id(F.col("start_"), F.col("camera"), F.col("user_name")))

    lit, col = (lambda v, n: F.lit(v).alias(n)), (lambda c, n: F.col(c).alias(n))
    head = lambda file, size, w, h, kind: [lit(file, "file"), F.coalesce(size, F.lit(0)).alias("size"), lit(layout.ENCODINGS[file], "encoding"), col(w, "width"), col(h, "height"), kind.alias("pixel_format")]
    tables = lambda name: F.transform(name, lambda e: F.struct(e["value"]["center"].alias("center"), e["value"]["lookup_table"].alias("lookup_table"), e["value"]["inverse_lookup_table"].alias("inverse_lookup_table"), e["ranges"].alias("frame_ranges"))).alias("distortions")
    matrices = F.transform("t_runs", lambda e: F.struct(e["value"].alias("matrix"), e["ranges"].alias("depth_frame_ranges")))
    by_camera = lambda front_doc, rear_doc: F.when(front, _json(F.struct(*front_doc))).otherwise(_json(F.struct(*rear_doc)))
    depth_head = head(DEPTH_BIN, F.col("d_size"), "depth_width", "depth_height", F.col("depth_pixel_format"))
    confidence = F.struct(lit(CONFIDENCE_BIN, "file"), F.coalesce("f_size", F.lit(0)).alias("size"), lit(layout.ENCODINGS[CONFIDENCE_BIN], "encoding"), lit("L008", "pixel_format")).alias("confidence")
    after = lambda frames, dropped: [F.size(frames).alias("frame_count"), col(frames, "frames"), F.coalesce(dropped, none).alias("dropped")]
    image = lambda w, h, frames: [col(w, "image_width"), col(h, "image_height"), F.col("principal_point_origin"), col(frames, "frames")]
    of_color, of_depth = image("color_width", "color_height", "c_k"), image("depth_width", "depth_height", "d_k")
    docs = {
        "scan_metadata.json": _json(F.struct(
            lit(VERSION, "format_version"), col("id", "scan_id"), scalar.display_name(F.col("user_name"), F.col("start_"), F.col("camera")).alias("name"), F.col("start_time_utc"), F.col("duration_s"),
            F.col("phone_model"), F.col("phone_id"), F.col("ios_version"), F.col("camera"), F.col("frame_rate"), F.coalesce("recovered", F.lit(False)).alias("recovered"), col("user", "author"),
        )),
        "color_frames_metadata.json": _json(F.struct(*head(COLOR_BIN, F.col("c_size"), "color_width", "color_height", F.lit("420f")), F.col("ycbcr_matrix"), *after("c_frames", "c_lost"))),
        "depth_frames_metadata.json": by_camera([*depth_head, *after("f_frames", "d_lost")], [*depth_head, confidence, *after("r_frames", "d_lost")]),
        "color_intrinsics.json": by_camera([*of_color, tables("c_runs")], of_color),
        "depth_intrinsics.json": by_camera([*of_depth, tables("d_runs")], of_depth),
        "extrinsics.json": by_camera([matrices.alias("depth_to_color")], [matrices.alias("depth_to_color"), col("poses", "camera_poses")]),
    }
    files = F.explode(F.array(*[F.struct(lit(n, "member"), text.alias("text")) for n, text in docs.items()]))
    return rows.select("scan_id", "id", files.alias("f")).select("scan_id", "id", "f.*")


def parts(starts: DataFrame, color: DataFrame, depth: DataFrame, segments: DataFrame) -> DataFrame:
    """scan_id (of the recording), position, member, name, data, path, size, sha256, prefix: the members of every recording in their order, frame
    files as their segments; what archive_writer writes and worklog.manifest lists. Recordings with faults have none."""
    whole = lambda df: df.join(faults(starts, color, depth, segments).select("scan_id").distinct(), "scan_id", "left_anti")
    docs = documents(whole(starts), color, depth, segments)
    place = F.array_position(F.array(*map(F.lit, MEMBERS)), F.col("member")).cast("int")
    known = dict(zip(segments.columns, segments.columns, strict=True))
    more = [F.col(c) if c in known else F.lit(None).cast(kind).alias(c) for c, kind in (("path", "string"), ("sha256", "string"), ("prefix", "boolean"))]
    of_segments = segments.join(docs.select("scan_id", "id").distinct(), "scan_id").select("id", F.col("file").alias("member"), scalar.segment_name(F.col("file"), F.col("seg_index")).alias("name"), "seg_index", F.lit(None).cast("binary").alias("data"), F.col("size").cast("long").alias("size"), *more)
    text = F.col("text").cast("binary")
    of_docs = docs.select("id", "member", F.col("member").alias("name"), F.lit(0).alias("seg_index"), text.alias("data"), F.octet_length(text).cast("long").alias("size"), F.lit(None).cast("string").alias("path"), F.sha2(text, 256).alias("sha256"), F.lit(False).alias("prefix"))
    rows = of_docs.unionByName(of_segments).withColumn("place", place)
    position = (F.row_number().over(Window.partitionBy("id").orderBy("place", "seg_index")) - 1).alias("position")
    return rows.select(F.col("id").alias("scan_id"), position, "member", "name", "data", "path", "size", "sha256", "prefix")


def recovered(segments: DataFrame, color: DataFrame, depth: DataFrame) -> DataFrame:
    """The segments that a recorder left (scan_id, file, seg_index, size, path), each with what the log accounts for: size is cut to it, sha256 is that
    of these bytes, prefix says that the file holds more. Segments beyond it are left out. A segment is read in pieces by a task of its own."""
    kept = worklog.recovered_segments(segments, logged_bytes(color, depth)).withColumn("prefix", F.col("keep") < F.col("size")).withColumn("size", F.col("keep")).drop("keep", "sha256")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for path, size in zip(pdf["path"], pdf["size"], strict=True):
                system, at = archive_writer.open_fs(path)
                with system.open_input_file(at) as f:
                    found.append(recording_tar.hashed(f, 0, int(size)))
            yield pdf.assign(sha256=found)

    return kept.repartition("scan_id", "file", "seg_index").mapInPandas(hashed, kept.schema.add("sha256", "string"))
