"""Archives of every version as tables, and what must be rejected."""

import json

import numpy as np
import pytest

from parallaxis.kernels import frames as kernels
from parallaxis.sources import recording_tar
from tests import recordings as R

SPLIT = [(v, c) for v in ("4.8", "5.0.2", "5.0.3", "5.2") for c in ("front", "rear")]


@pytest.mark.parametrize(("version", "camera"), SPLIT)
def test_split_archive(spark, tmp_path, version, camera):
    path = R.write(tmp_path, R.files_split(version, camera))
    rec = recording_tar.load(spark, path, "recordings").collect()
    assert [(r.format_version, r.camera, r.encoded, r.corrupt) for r in rec] == [(version, camera, version != "4.8", None)]
    rows = recording_tar.load(spark, path, "frames").orderBy("stream", "pos").collect()
    index = lambda s: [r.frame_index for r in rows if r.stream == s]
    assert index("color") == [0, 1, None, 2, 3]
    assert index("depth") == [0, 1, 2, None, 3]
    assert {r.dropped for r in rows if r.frame_index is None} == {"writer_busy", "late_data" if camera == "front" else "no_scene_depth"}
    blobs = recording_tar.load(spark, path, "blobs")
    raw = {(r.stream, r.frame_index): bytes(r.raw) for r in kernels.decoded(blobs).collect()}
    for stream, frames in (("color", R.color_frames()), ("depth", R.depth_maps()), *([("confidence", R.confidence_maps())] if camera == "rear" else [])):
        assert [raw[stream, i] for i in range(4)] == [np.ascontiguousarray(f).tobytes() for f in frames]
    if version == "4.8" and camera == "front":
        runs = recording_tar.load(spark, path, "runs").where("kind = 'color_distortion'").orderBy("entry_no").collect()
        assert [(r.entry_no, r.first, r.last) for r in runs] == [(0, 0, 1), (1, 2, 3)]


@pytest.mark.parametrize("minor", [0, 3, 7])
@pytest.mark.parametrize("camera", ["front", "rear"])
def test_table_archive(spark, tmp_path, minor, camera):
    path = R.write(tmp_path, R.files_tables(minor, camera))
    rows = recording_tar.load(spark, path, "frames").orderBy("stream", "pos").collect()
    assert [r.frame_index for r in rows] == [0, 1, None, 2, 3, 0, 1, 2, None, 3]
    assert (rows[0].exposure_s is None) == (minor < 3)
    assert recording_tar.load(spark, path, "calibrations").count() == (4 if camera == "front" else 0)


def test_options_prune_before_reading(spark, tmp_path):
    path = R.write(tmp_path, R.files_split("5.2", "rear"))
    blobs = recording_tar.load(spark, path, "blobs", bytesPerPartition="40")
    assert blobs.rdd.getNumPartitions() > 3
    some = recording_tar.load(spark, path, "blobs", stream="depth", frames="1,3")
    assert some.rdd.getNumPartitions() == 1
    assert sorted((r.stream, r.frame_index) for r in some.select("stream", "frame_index").collect()) == [("depth", 1), ("depth", 3)]


def _wrong(name):
    files = R.files_split("4.8", "front")
    if name == "extra member":
        return files | {"x.json": b"{}"}
    if name == "missing member":
        return {k: v for k, v in files.items() if k != "extrinsics.json"}
    if name == "version":
        return R.edited(files, "scan_metadata.json", lambda m: m.update(format_version="4.7"))
    if name == "upper-case hash":
        return R.edited(files, "color_frames_metadata.json", lambda m: m.update(sha256=m["sha256"].upper() if not m["sha256"].isdigit() else "X" * 64))
    if name == "size":
        return R.edited(files, "color_frames_metadata.json", lambda m: m.update(size=m["size"] + 1))
    if name == "overlapping run":
        return R.edited(files, "color_intrinsics.json", lambda m: m["distortions"][1].update(frame_ranges=[[1, 3]]))
    files = R.files_split("5.0.2", "front")
    if name == "encoding":
        return R.edited(files, "depth_frames_metadata.json", lambda m: m.update(encoding="lz4"))
    if name == "encoded size":
        return R.edited(files, "color_frames_metadata.json", lambda m: m["frames"][0].update(compressed_size=m["frames"][0]["compressed_size"] + 1))
    if name == "old version":
        return R.edited(R.files_tables(), "metadata.json", lambda m: m.update(format_version="3.0"))
    if name == "ragged row":
        old = R.files_tables()
        return old | {"color.csv": old["color.csv"] + b"1,2\n"}
    raise KeyError(name)


@pytest.mark.parametrize("name", ["extra member", "missing member", "version", "upper-case hash", "size", "overlapping run", "encoding", "encoded size", "old version", "ragged row"])
def test_rejected(spark, tmp_path, name):
    path = R.write(tmp_path, _wrong(name))
    with pytest.raises(Exception):  # noqa: B017
        recording_tar.load(spark, path, "recordings").collect()
    bad = recording_tar.load(spark, path, "recordings", mode="PERMISSIVE").collect()
    assert len(bad) == 1 and bad[0].corrupt


def test_shifted_boundary_is_caught_by_decoding(spark, tmp_path):
    def shift(m):
        m["frames"][0]["compressed_size"] += 1
        m["frames"][1]["compressed_size"] -= 1

    path = R.write(tmp_path, R.edited(R.files_split("5.0.2", "front"), "color_frames_metadata.json", shift))
    with pytest.raises(Exception):  # noqa: B017
        kernels.decoded(recording_tar.load(spark, path, "blobs").where("stream = 'color'")).collect()


def test_json_is_what_was_written():
    assert json.loads(R.files_split("5.2", "front")["scan_metadata.json"])["author"] == "a"
