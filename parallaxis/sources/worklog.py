"""From a recorder's work log to the files of a recording, and back: lines, recovery, segments, manifests.

Logs are JSON lines with an explicit schema; a line that doesn't parse is an error, not a null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parallaxis.functions import scalar
from parallaxis.operators import joins, runs, series

K = "struct<fx:float,fy:float,cx:float,cy:float>"
COLOR_LINE = f"scan_id string, line_no int, timestamp double, reason string, upright_rotation_deg int, gravity array<double>, gravity_timestamp double, exposure_duration_s double, intrinsics {K}, pose struct<tracking_state:string,world_from_camera:array<array<float>>>, compressed_size long, raw_sha256 string"
DISTORTION = "struct<center:array<float>,lookup_table:array<float>,inverse_lookup_table:array<float>,scale:array<float>>"
DEPTH_LINE = f"scan_id string, line_no int, timestamp double, reason string, filtered boolean, accuracy string, quality string, intrinsics {K}, distortion {DISTORTION}, color_distortion {DISTORTION}, depth_to_color array<array<float>>, compressed_size long, raw_sha256 string, confidence_compressed_size long, confidence_raw_sha256 string"
SEGMENT_LINE = "scan_id string, file string, seg_index int, size long, sha256 string"
#: What a recorder writes down when it begins.
START_LINE = "scan_id string, user_name string, start_time_utc string, camera string, phone_model string, phone_id string, ios_version string, user string, recovered boolean, frame_rate double, color_width int, color_height int, ycbcr_matrix string, depth_width int, depth_height int, depth_pixel_format string, principal_point_origin string"


def lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def unparsed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file, line_no (from 1) and text of the lines that aren't of the schema; blank lines are none. A log is that of one
    recording and is read as one row, so that its lines have numbers."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("at", "text"))
    parsed = F.from_json("text", f"{schema}, corrupt_ string", {"columnNameOfCorruptRecord": "corrupt_"})
    bad = text.where(F.trim("text") != "").withColumn("corrupt_", parsed["corrupt_"]).where("corrupt_ IS NOT NULL")
    return bad.select("file", (F.col("at") + 1).alias("line_no"), "text")


def unfinished(work: DataFrame, finished: DataFrame) -> DataFrame:
    return work.join(finished.select("scan_id").distinct(), "scan_id", "left_anti")


def without_members(listing: Column) -> Column:
    """Whether the raw JSON text of a listing has no members key (null is a value, absence isn't)."""
    return ~F.coalesce(F.array_contains(F.json_object_keys(listing), "members"), F.lit(False))


def delivered(log: DataFrame) -> DataFrame:
    """Delivered lines numbered in the order of the log."""
    return series.numbered(log.where("reason IS NULL"), ["scan_id"], ["line_no"])


def frames_json(log: DataFrame, names: Sequence[str]) -> DataFrame:
    """scan_id, frames_json, dropped_json: the lists of a frames file; nulls are written, as a null and no key differ.

    Lists are gathered by recording, which is what a file of one holds."""
    frame = F.struct("line_no", F.struct(*names).alias("f"))
    dropped = F.struct("timestamp", "reason")
    per = log.groupBy("scan_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("reason").isNull(), frame))), lambda x: x["f"]).alias("frames"),
        F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), dropped))).alias("dropped"),
    )
    text = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    return per.select("scan_id", text(F.col("frames")).alias("frames_json"), text(F.col("dropped")).alias("dropped_json"), F.size("frames").alias("frame_count"))


def member(name: str, text: Column) -> Column:
    """What a manifest says of a JSON member."""
    return F.struct(F.lit(name).alias("name"), F.octet_length(text).cast("long").alias("size"), scalar.sha256(text).alias("sha256"))


def duration(color: DataFrame, depth: DataFrame) -> DataFrame:
    both = color.select("scan_id", "timestamp").unionByName(depth.select("scan_id", "timestamp"))
    return both.groupBy("scan_id").agg((F.max("timestamp") - F.min("timestamp")).alias("duration_s"))


def ordered_in_time(log: DataFrame) -> DataFrame:
    """Recordings with a delivered line that isn't later than the one before it."""
    w = Window.partitionBy("scan_id").orderBy("line_no")
    return log.where("reason IS NULL").withColumn("back", F.col("timestamp") <= F.lag("timestamp").over(w)).where("back").select("scan_id").distinct()


def manifest(files: DataFrame) -> DataFrame:
    """files: scan_id, position, name, size, sha256. Members in order; segments that follow each other are under their file."""
    file = F.when(scalar.is_segment(F.col("name")), F.regexp_replace("name", "\\.[0-9]{6}\\z", "")).otherwise(F.col("name"))
    rows = files.withColumn("file", file)
    rows = rows.withColumn("group_", runs.adjacent(["scan_id"], ["position"], "file"))
    piece = F.struct("position", F.struct("name", "size", "sha256").alias("s"))
    groups = rows.groupBy("scan_id", "group_", "file").agg(F.array_sort(F.collect_list(piece)).alias("p"), F.sum("size").alias("size"))
    whole = F.get(F.col("p.s"), F.lit(0))
    is_one = (F.size("p") == 1) & (whole["name"] == F.col("file"))
    entry = F.struct(F.col("file").alias("name"), F.col("size"), F.when(is_one, whole["sha256"]).alias("sha256"), F.when(~is_one, F.col("p.s")).alias("segments"))
    return groups.groupBy("scan_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("group_", entry.alias("e")))), lambda x: x["e"]).alias("members"))


def recovered_segments(segments: DataFrame, logged: DataFrame) -> DataFrame:
    """Segments of a recording that was cut off: each keeps what the log accounts for, those beyond it go.

    segments: scan_id, file, seg_index, size; logged: scan_id, file, bytes. Adds keep (bytes to keep)."""
    w = Window.partitionBy("scan_id", "file").orderBy("seg_index").rowsBetween(Window.unboundedPreceding, -1)
    rows = segments.withColumn("before", F.coalesce(F.sum("size").over(w), F.lit(0))).join(logged, ["scan_id", "file"])
    keep = F.least(F.col("size"), F.col("bytes") - F.col("before"))
    return rows.withColumn("keep", keep).where("keep > 0").drop("before", "bytes")


def acknowledged(members: DataFrame, files_left: DataFrame) -> DataFrame:
    """Segments whose file is gone from the phone have been stored: uploaded becomes true."""
    left = files_left.select(F.col("scan_id").alias("s"), F.col("name").alias("n"), F.lit(True).alias("left_"))
    rows = members.join(left, (F.col("scan_id") == F.col("s")) & (F.col("name") == F.col("n")), "left")
    return rows.withColumn("uploaded", F.col("uploaded") | (scalar.is_segment(F.col("name")) & F.col("left_").isNull())).drop("s", "n", "left_")


def to_upload(members: DataFrame, underway: DataFrame) -> DataFrame:
    return members.where("NOT uploaded").join(underway.select("scan_id", "name"), ["scan_id", "name"], "left_anti")


def users_file_errors(text: DataFrame) -> DataFrame:
    """Configs that name a server which the file doesn't have. text: one column, value, with the file's JSON."""
    schema = "servers map<string,string>, users array<struct<name:string,configs:array<struct<server:string,data_root:string>>>>"
    f = text.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("f"))
    rows = f.select(F.map_keys("f.servers").alias("servers"), F.explode("f.users").alias("u")).select("servers", F.col("u.name").alias("user"), F.explode("u.configs").alias("c"))
    return rows.where(F.col("c.server").isNotNull() & ~F.array_contains("servers", F.col("c.server"))).select("user", "c.server", "c.data_root")
