"""Work logs become archives that read back as the same tables."""

import hashlib
import json
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parallaxis.sources import archive_writer, compose, recording_tar, worklog
from tests import recordings as R


def logs(folder, camera, scan="work", piece=50, files=None):
    """Lines of a work log and staged segments that a recording was made of: starts, color, depth, segments as lists."""
    files = files or R.files_split("5.2", camera)
    js = {n: json.loads(b) for n, b in files.items() if n.endswith(".json")}
    meta, c, d = js["scan_metadata.json"], js["color_frames_metadata.json"], js["depth_frames_metadata.json"]
    ck, dk, ex = js["color_intrinsics.json"], js["depth_intrinsics.json"], js["extrinsics.json"]

    def per_frame(entries, key, n):
        out = [None] * n
        for e in entries:
            for a, b in e[key]:
                out[a : b + 1] = [{k: v for k, v in e.items() if k != key}] * (b - a + 1)
        return out

    start = {"scan_id": scan, "user_name": None, "user": meta["author"], "recovered": False, "color_width": c["width"], "color_height": c["height"], "ycbcr_matrix": c["ycbcr_matrix"], "depth_width": d["width"], "depth_height": d["height"], "depth_pixel_format": d["pixel_format"], "principal_point_origin": ck["principal_point_origin"]}
    start |= {k: meta[k] for k in ("start_time_utc", "camera", "phone_model", "phone_id", "ios_version", "frame_rate")}
    poses = ex.get("camera_poses", [None] * len(c["frames"]))
    color = [f | {"intrinsics": k, "pose": p} for f, k, p in zip(c["frames"], ck["frames"], poses, strict=True)] + c["dropped"]
    tables = [per_frame(k.get("distortions", ()), "frame_ranges", len(k["frames"])) for k in (ck, dk)]
    depth = [f | {"intrinsics": k, "distortion": t} for f, k, t in zip(d["frames"], dk["frames"], tables[1], strict=True)]
    if camera == "front":
        for f, m in zip(depth, per_frame(ex["depth_to_color"], "depth_frame_ranges", len(depth)), strict=True):
            f["depth_to_color"] = m["matrix"]
        # the depth map of an instant has the colour frame's distortion; instants 0, 1, 3, 4 and 0, 1, 2, 4
        for f, t in zip(depth, (tables[0][0], tables[0][1], tables[0][2], tables[0][3]), strict=True):
            f["color_distortion"] = t
    lines = [[r | {"scan_id": scan, "line_no": i} for i, r in enumerate(x)] for x in (color, depth + d["dropped"])]
    segments = []
    for name, data in files.items():
        for i in range(0, len(data) if name.endswith(".bin") else 0, piece):
            path = folder / f"{scan}-{name}.{i // piece:06d}"
            path.write_bytes(data[i : i + piece])
            segments.append((scan, name, i // piece, len(data[i : i + piece]), str(path), hashlib.sha256(data[i : i + piece]).hexdigest()))
    return start, *lines, segments


def frames_of(spark, folder, *each):
    """DataFrames of several logs."""
    out = []
    for k, schema in enumerate((worklog.START_LINE, worklog.COLOR_LINE, worklog.DEPTH_LINE)):
        path = folder / f"log-{k}.jsonl"
        rows = [r for log in each for r in ([log[0]] if k == 0 else log[k])]
        path.write_text("\n".join(map(json.dumps, rows)))
        out.append(worklog.lines(spark, str(path), schema))
    return [*out, spark.createDataFrame([s for log in each for s in log[3]], "scan_id string, file string, seg_index int, size long, path string, sha256 string")]


def same_table(a, b, table):
    names = [c for c in a.columns if c not in ("scan_id", "name", "tar_path", "size", "metadata_json", "tar_offset")]
    # matrices are single precision, which JSON shows by fewer digits
    singles = lambda c: F.col(c).cast("array<array<float>>").alias(c) if c == "world_from_camera" else F.col(c)
    key = lambda df: Counter(str(r) for r in df.select(*map(singles, names)).collect())
    assert key(a) == key(b), table


def test_logs_become_archives_of_both_cameras(spark, tmp_path):
    (tmp_path / "staged").mkdir()
    each = [logs(tmp_path / "staged", c, f"work-{c}") for c in ("front", "rear")]
    log = frames_of(spark, tmp_path, *each)
    assert compose.faults(*log).count() == 0
    parts = compose.parts(*log)
    archive_writer.write_archives(parts, str(tmp_path / "root"))
    for camera in ("front", "rear"):
        mine, theirs = str(tmp_path / "root" / f"rgbd_20261016_120000_{camera}.tar"), R.write(tmp_path, R.files_split("5.2", camera))
        for table in recording_tar.TABLES:
            same_table(recording_tar.load(spark, mine, table), recording_tar.load(spark, theirs, table), table)
        r = recording_tar.load(spark, mine, "recordings").first()
        assert (r.scan_id, r.name, r.author, r.phone_id) == (f"rgbd_20261016_120000_{camera}", f"2026-10-16 12:00:00 {camera.title()}", "a", None)
    listing = {r.scan_id: r.members for r in worklog.manifest(parts.select("scan_id", "position", "name", "size", "sha256")).collect()}
    members = listing["rgbd_20261016_120000_rear"]
    assert [m.name for m in members] == [m for m in compose.MEMBERS] and members[1].segments[0].sha256 and members[0].sha256


def test_a_cut_off_recording_keeps_what_its_log_accounts_for(spark, tmp_path):
    """Bytes behind the last line go, segments beyond them too, and hashes are of what is kept."""
    (tmp_path / "staged").mkdir()
    start, color, depth, segments = logs(tmp_path / "staged", "front")
    last = [s for s in segments if s[1] == compose.COLOR_BIN][-1]
    with open(last[4], "ab") as f:
        f.write(b"a frame without a line")
    more = tmp_path / "staged" / "beyond"
    more.write_bytes(b"x" * 50)
    open_ones = [(s, f, i, size + 22 * (path == last[4]), path, None) for s, f, i, size, path, _ in segments] + [("work", compose.COLOR_BIN, last[2] + 1, 50, str(more), None)]
    log = frames_of(spark, tmp_path, (start, color, depth, open_ones))
    assert {r.fault for r in compose.faults(*log).collect()} == {"segment_size"} and compose.parts(*log).count() == 0
    kept = compose.recovered(log[3], *log[1:3])
    got = {(r.file, r.seg_index): (r.size, r.sha256, r.prefix) for r in kept.collect()}
    assert got == {(f, i): (size, sha, path == last[4]) for _, f, i, size, path, sha in segments}
    archive_writer.write_archives(compose.parts(*log[:3], kept), str(tmp_path / "root"))
    path = R.write(tmp_path, R.files_split("5.2", "front"))
    same_table(recording_tar.load(spark, str(tmp_path / "root"), "members", measure="true"), recording_tar.load(spark, path, "members", measure="true"), "members")


def test_colour_intrinsics_are_carried_by_the_scale_of_their_distortion(spark, tmp_path):
    start, color, depth, segments = logs(tmp_path, "front")
    scale = [0.4, 0.3]
    for i, f in enumerate(depth[:4]):
        f["color_distortion"] = f["color_distortion"] | {"scale": scale if i < 2 else None}
    color[3]["intrinsics"] = None
    docs = {r.member: json.loads(r.text) for r in compose.documents(*frames_of(spark, tmp_path, (start, color, depth, segments))).collect()}
    got = docs["color_intrinsics.json"]["frames"]
    f32 = np.float32
    for i, k in enumerate(R.color_k(n) for n in R.COLOR_AT):
        if i == 3:
            assert got[i] is None
            continue
        moved = [f32(k[n]) + (f32(1) - f32(s)) / f32(2) for n, s in zip(("cx", "cy"), scale, strict=True)] if i < 2 else [f32(k["cx"]), f32(k["cy"])]
        assert [f32(got[i][n]) for n in ("fx", "fy", "cx", "cy")] == [f32(k["fx"]), f32(k["fy"]), *moved]
    assert all("scale" not in t for t in docs["color_intrinsics.json"]["distortions"]) and docs["scan_metadata.json"]["phone_id"] is None


@pytest.mark.parametrize("camera", ["front", "rear"])
def test_faults(spark, tmp_path, camera):
    def spoiled(name):
        (tmp_path / name).mkdir()
        start, color, depth, segments = logs(tmp_path / name, camera, name)
        if name == "times":
            color[1]["timestamp"] = color[0]["timestamp"]
        if name == "poses":
            color[2]["pose"] = None if camera == "rear" else R.pose(0)
        if name == "order":
            segments[1] = (*segments[1][:2], 7, *segments[1][3:])
        if name == "size":
            segments[0] = (*segments[0][:3], segments[0][3] - 1, *segments[0][4:])
        if name == "lacks":
            segments = [s for s in segments if s[1] != compose.DEPTH_BIN]
        if name == "hash":
            depth[0]["raw_sha256"] = "X"
        if name == "confidence":
            depth[1].pop("confidence_compressed_size", None)
        if name == "empty":
            color, segments = [r for r in color if r.get("reason")], [s for s in segments if s[1] != compose.COLOR_BIN]
        return start, color, depth, segments

    names = ["times", "poses", "order", "size", "lacks", "hash", "empty", "good", *(["confidence"] if camera == "rear" else [])]
    log = frames_of(spark, tmp_path, *map(spoiled, names))
    got = {(r.scan_id, r.fault, r.file) for r in compose.faults(*log).collect()}
    c, d = compose.COLOR_BIN, compose.DEPTH_BIN
    want = {("times", "not_in_time_order", c), ("poses", "pose_count", c), ("order", "segment_order", c), ("size", "segment_size", c), ("lacks", "segment_size", d), ("hash", "no_encoding", d)}
    if camera == "rear":
        want |= {("confidence", "no_confidence_size", d), ("confidence", "segment_size", compose.CONFIDENCE_BIN)}
    assert got == want
    assert compose.documents(*log).where("scan_id IN ('good', 'empty')").select("scan_id").distinct().collect()[0][0] == "good"
    assert compose.parts(*log).select("scan_id").distinct().count() == 1


def test_runs_of_distortions(spark, tmp_path):
    start, color, depth, _ = logs(tmp_path, "front")
    log = frames_of(spark, tmp_path, (start, color, depth, [("work", "x", 0, 1, "p", "s")]))
    got = {(r.kind, r.entry_no): r.ranges for r in compose.distortion_runs(log[1], log[2]).collect()}
    assert got == {("color_distortion", 0): [[0, 1]], ("color_distortion", 1): [[2, 3]], ("depth_distortion", 0): [[0, 1]], ("depth_distortion", 1): [[2, 3]], ("depth_to_color", 0): [[0, 3]]}
    rear = compose.identity_runs(log[0].withColumn("camera", F.lit("rear")), log[2]).first().entries
    assert [(e.value, e.ranges) for e in rear] == [([list(r) for r in compose.IDENTITY], [[0, 3]])]
