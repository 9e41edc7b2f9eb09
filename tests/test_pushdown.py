"""Conditions are evaluated before frames are read, and planning opens no archive."""

import re

import pytest
from pyspark.sql import datasource as ds
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from parallaxis.sources import layout, recording_tar
from tests import recordings as R

KINDS = {"string": StringType(), "int": IntegerType(), "long": LongType(), "binary": BinaryType()}
BLOBS = StructType([StructField(*(KINDS.get(x, x) for x in column.split())) for column in recording_tar.TABLES["blobs"].split(",")])


class Opened:
    """A file system that counts what is opened and which frames are read."""

    def __init__(self, monkeypatch):
        self.opened, self.read, real = [], [], recording_tar.open_fs

        class File:
            def __init__(self, f):
                self.f = f

            def __getattr__(self, name):
                return getattr(self.f, name)

            def __enter__(self):
                return self

            def __exit__(self, *_):
                self.f.close()

            def read_at(_self, n, offset):
                self.read.append((offset, n))
                return _self.f.read_at(n, offset)

        class System:
            def __init__(self, system):
                self.system = system

            def __getattr__(self, name):
                return getattr(self.system, name)

            def open_input_file(_self, at):
                self.opened.append(at)
                return File(_self.system.open_input_file(at))

        def counted(path):
            system, at = real(path)
            return System(system), at

        monkeypatch.setattr(recording_tar, "open_fs", counted)


def test_only_the_frames_asked_for_are_read(tmp_path, monkeypatch):
    for c in ("front", "rear"):
        R.write(tmp_path, R.files_split("5.2", c))
    seen = Opened(monkeypatch)
    reader = recording_tar.FilteringReader(BLOBS, {"table": "blobs", "path": str(tmp_path), "bytesPerPartition": "600"})
    filters = [ds.EqualTo(("stream",), "depth"), ds.LessThan(("frame_index",), 2), ds.IsNotNull(("stream",)), ds.EqualTo(("data",), b"x")]
    assert list(reader.pushFilters(filters)) == filters[3:]  # of a column that isn't known yet
    pieces = reader.partitions()
    assert len(pieces) > 10 and seen.opened == []
    rows = [r for p in pieces for r in reader.read(p)]
    index = {n: i for i, n in enumerate(BLOBS.fieldNames())}
    assert sorted((r[index["scan_id"]][-5:], r[index["frame_index"]]) for r in rows) == [("_rear", 0), ("_rear", 1), ("front", 0), ("front", 1)]
    assert sorted(seen.read) == sorted((r[index["tar_offset"]], r[index["stored_len"]]) for r in rows)


def test_pieces_hold_each_frame_once(tmp_path):
    path = R.write(tmp_path, R.files_split("5.2", "rear"))
    whole = None
    for step in ("1", "37", "512", "1000000"):
        reader = recording_tar.RecordingReader(BLOBS, {"table": "blobs", "path": path, "bytesPerPartition": step})
        rows = sorted(r for p in reader.partitions() for r in reader.read(p))
        whole = whole or rows
        assert rows == whole and len(rows) == 12


@pytest.mark.parametrize(
    "condition",
    ["stream = 'depth' AND frame_index < 9", "frame_index IS NULL", "frame_index IS NOT NULL AND NOT stream = 'color'", "stream IN ('color', 'x') AND frame_index >= 2", "dropped LIKE 'writer%'", "NOT frame_index = 1", "frame_index <=> NULL", "NOT frame_index IN (1, NULL)", "scan_id = 'rgbd_20261016_120000_rear'", "ts > 41.55 AND stream = 'color'", "dropped > 'a' OR frame_index = 0", "intrinsics.fx > 0 AND pos <= 1"],
)
def test_filtered_as_spark_does(spark, tmp_path, condition):
    for c in ("front", "rear"):
        R.write(tmp_path, R.files_split("5.2", c))
    plain = recording_tar.load(spark, str(tmp_path), "frames").where(condition)
    spark.conf.set(recording_tar.PUSHED, "true")
    try:
        pushed = recording_tar.load(spark, str(tmp_path), "frames").where(condition)
        assert sorted(map(str, pushed.collect())) == sorted(map(str, plain.collect()))
    finally:
        spark.conf.set(recording_tar.PUSHED, "false")


def test_unreadable_archives_stay_rows(spark, tmp_path):
    (tmp_path / "broken.tar").write_bytes(b"no archive")
    spark.conf.set(recording_tar.PUSHED, "true")
    try:
        rows = recording_tar.load(spark, str(tmp_path), "recordings", mode="PERMISSIVE").where("camera IS NULL AND scan_id = 'broken'").collect()
    finally:
        spark.conf.set(recording_tar.PUSHED, "false")
    assert len(rows) == 1 and rows[0].corrupt


# rules of the layouts, without Spark


def rejected(tmp_path, files):
    path = R.write(tmp_path, files)
    with open(path, "rb") as f, pytest.raises(layout.RecordingError) as e:
        layout.read(f, path)
    return str(e.value)


SPLIT_FAULTS = {
    "a key of a frame": ("color_frames_metadata.json", lambda m: m["frames"][0].update(x=1), "frames.*"),
    "gravity": ("color_frames_metadata.json", lambda m: m["frames"][0].update(gravity=[1, 2]), "gravity"),
    "an odd width": ("color_frames_metadata.json", lambda m: m.update(width=15), "width"),
    "a count": ("color_frames_metadata.json", lambda m: m.update(frame_count=3), "counted"),
    "a dropped row": ("depth_frames_metadata.json", lambda m: m["dropped"][0].update(x=1), "dropped.*"),
    "no confidence": ("depth_frames_metadata.json", lambda m: m.pop("confidence"), "confidence.file"),
    "one hash": ("depth_frames_metadata.json", lambda m: m["confidence"].update(sha256="0" * 64), "hashes"),
    "one encoding": ("depth_frames_metadata.json", lambda m: m["confidence"].pop("encoding"), "confidence.encoding"),
    "a size that is no number": ("depth_frames_metadata.json", lambda m: m["frames"][1].update(compressed_size=True), "compressed_size"),
    "distortions": ("depth_intrinsics.json", lambda m: m.update(distortions=[]), "distortions"),
    "an image size": ("color_intrinsics.json", lambda m: m.update(image_width=1), "image_width"),
    "an origin": ("color_intrinsics.json", lambda m: m.update(principal_point_origin="x"), "principal_point_origin"),
    "intrinsics": ("color_intrinsics.json", lambda m: m["frames"].pop(), "differ in length"),
    "poses": ("extrinsics.json", lambda m: m["camera_poses"].pop(), "differ in length"),
    "no poses": ("extrinsics.json", lambda m: m.pop("camera_poses"), "camera_poses"),
    "a matrix": ("extrinsics.json", lambda m: m["depth_to_color"][0]["matrix"].pop(), "matrix"),
    "transforms": ("extrinsics.json", lambda m: m["depth_to_color"][0].update(depth_frame_ranges=[[0, 2]]), "no depth_to_color run"),
    "a run beyond": ("extrinsics.json", lambda m: m["depth_to_color"][0].update(depth_frame_ranges=[[0, 4]]), "leaves its frames"),
    "runs that overlap": ("extrinsics.json", lambda m: m["depth_to_color"][0].update(depth_frame_ranges=[[0, 1], [1, 3]]), "overlap"),
    "a camera": ("scan_metadata.json", lambda m: m.update(camera="side"), "camera"),
}


@pytest.mark.parametrize("name", SPLIT_FAULTS)
def test_rules_of_split_archives(tmp_path, name):
    file, change, says = SPLIT_FAULTS[name]
    assert re.search(re.escape(says), rejected(tmp_path, R.edited(R.files_split("5.2", "rear"), file, change)))


@pytest.mark.parametrize(("key", "value"), [("color_pixel_format", "x"), ("color_bytes_per_frame", 1), ("depth_bytes_per_pixel", 2), ("depth_bytes_per_frame", 3), ("confidence_pixel_format", "x"), ("confidence_bytes_per_pixel", None), ("format_version", "4.8"), ("camera", "front")])
def test_rules_of_table_archives(tmp_path, key, value):
    assert rejected(tmp_path, R.edited(R.files_tables(7, "rear"), "metadata.json", lambda m: m.update({key: value})))


def test_a_table_archive_that_ends_within_a_frame(tmp_path):
    files = R.files_tables(7, "rear")
    assert "as long as its frames" in rejected(tmp_path, files | {"depth.bin": files["depth.bin"] + b"x"})


def test_places_of_frames_are_where_their_bytes_lie(spark, tmp_path):
    from parallaxis.kernels import frames

    path = R.write(tmp_path, R.files_split("5.2", "rear"))
    places = recording_tar.load(spark, path, "blobs", content="false").toPandas()
    data = {(r.stream, r.frame_index): bytes(r.data) for r in recording_tar.load(spark, path, "blobs").collect()}
    assert places["data"].isna().all() and {(r.stream, r.frame_index): frames.stored(r) for r in places.itertuples()} == data
