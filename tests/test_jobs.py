"""Sinks, work logs and streams."""

import hashlib
import json
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from parallaxis import cli
from parallaxis.sources import compose, sinks, worklog
from parallaxis.streaming import stateful
from tests import recordings as R


def test_decode_is_whole_and_skipped_when_done(spark, tmp_path):
    path = R.write(tmp_path, R.files_split("5.2", "rear"))
    out = str(tmp_path / "out")
    assert [(r.frames) for r in sinks.decode(spark, path, out).collect()] == [12]
    folder = tmp_path / "out" / "rgbd_20261016_120000_rear"
    texts = {n: b for n, b in R.files_split("5.2", "rear").items() if not n.endswith(".bin")}
    assert sorted(os.listdir(folder)) == sorted(["color", "confidence", "decoded.json", "depth", *texts])
    assert {n: (folder / n).read_bytes() for n in texts} == texts
    about = json.loads((folder / "decoded.json").read_text())
    assert about["copied"] == sorted(texts) and about["source"] == os.path.basename(path) and about["camera"] == "rear"
    assert [about[s]["count"] for s in ("color", "depth", "confidence")] == [4, 4, 4] and about["depth"]["format"] == "npy float32, metres"
    assert about["bytes"] == sum(p.stat().st_size for p in folder.rglob("*") if p.is_file() and p.name != "decoded.json")
    assert (folder / "color" / "000003.png").read_bytes().startswith(b"\x89PNG")
    assert sinks.decode(spark, path, out).collect() == []
    assert len(sinks.decode(spark, path, out, force=True).collect()) == 1


def test_catalog_tolerates_unreadable_archives(spark, tmp_path):
    R.write(tmp_path, R.files_split("5.2", "rear"))
    (tmp_path / "broken.tar").write_bytes(b"no archive")
    (tmp_path / ".hidden.tar").write_bytes(b"")
    rows = sinks.catalog(spark, str(tmp_path)).collect()
    assert [(r.scan_id, r.start_time_utc is None) for r in rows] == [("rgbd_20261016_120000_rear", False), ("broken", True)]


def test_rendered_rows(spark, tmp_path):
    rows = sinks.rendered(spark, R.write(tmp_path, R.files_split("4.8", "front"))).orderBy("pos").collect()
    assert [(r.color_index, r.depth_index) for r in rows] == [(0, 0), (1, 1), (None, 2), (2, None), (3, 3)]
    assert {r.rotation for r in rows} == {90}


def _staged(tmp_path, files, size=37):
    """Parts of 37 bytes of the frame files, other files whole: manifest rows and staged rows."""
    manifest, staged, position = [], [], 0
    for name, data in files.items():
        parts = [data[i : i + size] for i in range(0, len(data), size)] if name.endswith(".bin") else [data]
        for k, part in enumerate(parts):
            own = f"{name}.{k:06d}" if name.endswith(".bin") else name
            path = tmp_path / own
            path.write_bytes(part)
            sha = hashlib.sha256(part).hexdigest()
            manifest.append(("up", str(tmp_path / "root"), R.scan_id(files), position, name, own, len(part), sha))
            staged.append(("up", own, len(part), sha, str(path)))
            position += 1
    return manifest, staged


def test_archives_are_assembled_once_when_complete(spark, tmp_path):
    files = R.files_split("5.2", "front")
    manifest, staged = _staged(tmp_path, files)
    m = spark.createDataFrame(manifest, "upload_key string, root string, scan_id string, position int, member string, name string, size long, sha256 string")
    s = spark.createDataFrame(staged, "upload_key string, name string, size long, sha256 string, path string")
    none = spark.createDataFrame([], "root string, scan_id string")
    assert sinks.assemble(sinks.ready(m, s.limit(len(staged) - 1), none)).collect() == []
    got = sinks.assemble(sinks.ready(m, s, none)).collect()
    with tarfile.open(got[0].archive, "r:") as tar:
        assert {x.name.split("/")[1]: tar.extractfile(x).read() for x in tar.getmembers()} == files
    with open(got[0].archive, "rb") as f:
        assert f.read()[257:265] == b"ustar  \0"
    before = os.stat(got[0].archive)
    assert sinks.assemble(sinks.ready(m, s, none)).collect() == got  # the first archive stays, and is told again
    assert os.stat(got[0].archive).st_ino == before.st_ino and os.listdir(manifest[0][1]) == [os.path.basename(got[0].archive)]
    stored = spark.createDataFrame([(manifest[0][1], manifest[0][2])], "root string, scan_id string")
    assert sinks.ready(m, s, stored).count() == 0


def test_accepted(spark):
    rows = [("k", "a", bytearray(b"x"), 1, hashlib.sha256(b"x").hexdigest()), ("k", "b", bytearray(b"x"), 1, "0" * 64), ("k", "c", bytearray(b"x"), 2, hashlib.sha256(b"x").hexdigest())]
    df = spark.createDataFrame(rows, "key string, name string, data binary, expected_size long, expected_sha256 string")
    assert [r.name for r in sinks.accepted(df).collect()] == ["a"]


def test_work_log_becomes_files(spark, tmp_path):
    k = {"fx": 1.0, "fy": 1.0, "cx": 0.5, "cy": 0.5}
    d = {"center": [1.0, 2.0], "lookup_table": [0.0], "inverse_lookup_table": [0.0]}
    color = [{"scan_id": "s", "line_no": i, "timestamp": float(i), "intrinsics": k, "reason": "late" if i == 2 else None} for i in range(4)]
    other = {**d, "center": [9.0, 2.0]}
    depth = [{"scan_id": "s", "line_no": 0, "timestamp": 1.0, "distortion": d, "color_distortion": d}, {"scan_id": "s", "line_no": 1, "timestamp": 3.0, "distortion": other, "color_distortion": other}]
    (tmp_path / "color.jsonl").write_text("\n".join(map(json.dumps, color)))
    (tmp_path / "depth.jsonl").write_text("\n".join(map(json.dumps, depth)))
    c = worklog.lines(spark, str(tmp_path / "color.jsonl"), worklog.COLOR_LINE)
    z = worklog.lines(spark, str(tmp_path / "depth.jsonl"), worklog.DEPTH_LINE)
    r = {(x.kind, x.entry_no): x.ranges for x in compose.distortion_runs(c, z).collect()}
    assert r == {("color_distortion", 0): [[0, 1]], ("color_distortion", 1): [[2, 2]], ("depth_distortion", 0): [[0, 0]], ("depth_distortion", 1): [[1, 1]]}
    f = worklog.frames_json(c, ["timestamp", "gravity"]).first()
    assert f.frame_count == 3 and json.loads(f.frames_json)[0] == {"timestamp": 0.0, "gravity": None} and json.loads(f.dropped_json) == [{"timestamp": 2.0, "reason": "late"}]
    assert worklog.duration(c, z).first().duration_s == 3.0
    assert worklog.ordered_in_time(c).count() == 0
    (tmp_path / "bad.jsonl").write_text('{"timestamp": "x"}')
    with pytest.raises(Exception):  # noqa: B017
        worklog.lines(spark, str(tmp_path / "bad.jsonl"), worklog.COLOR_LINE).collect()


def test_manifest_and_recovery(spark):
    files = [("s", 0, "color.bin.000000", 5, "a"), ("s", 1, "color.bin.000001", 4, "b"), ("s", 2, "scan.json", 3, "c")]
    df = spark.createDataFrame(files, "scan_id string, position int, name string, size long, sha256 string")
    m = worklog.manifest(df).first().members
    assert [(x.name, x.size, x.sha256, x.segments and [y.name for y in x.segments]) for x in m] == [("color.bin", 9, None, ["color.bin.000000", "color.bin.000001"]), ("scan.json", 3, "c", None)]
    seg = spark.createDataFrame([("s", "f", i, 10) for i in range(3)], "scan_id string, file string, seg_index int, size long")
    logged = spark.createDataFrame([("s", "f", 14)], "scan_id string, file string, bytes long")
    assert [(r.seg_index, r.keep) for r in worklog.recovered_segments(seg, logged).orderBy("seg_index").collect()] == [(0, 10), (1, 4)]
    up = spark.createDataFrame([("s", "f.000000", False), ("s", "f.000001", False), ("s", "x.json", False)], "scan_id string, name string, uploaded boolean")
    left = spark.createDataFrame([("s", "f.000001")], "scan_id string, name string")
    got = worklog.acknowledged(up, left)
    assert {r.name: r.uploaded for r in got.collect()} == {"f.000000": True, "f.000001": False, "x.json": False}
    assert [r.name for r in worklog.to_upload(got, left).collect()] == ["x.json"]


def test_users_file(spark):
    text = json.dumps({"servers": {"home": "http://h"}, "users": [{"name": "u", "configs": [{"server": "home", "data_root": "/d"}, {"server": "gone", "data_root": "/d"}]}]})
    assert [r.server for r in worklog.users_file_errors(spark.createDataFrame([(text,)], "value string")).collect()] == ["gone"]
    flags = spark.createDataFrame([('{"members": null}',), ("{}",)], "v string").select(worklog.without_members(F.col("v"))).collect()
    assert [r[0] for r in flags] == [False, True]


def _run(spark, stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return spark.sql(f"SELECT * FROM {name}").collect()


def test_streams(spark, tmp_path):
    schema = "key string, ts double, payload string"
    for i, part in enumerate([[0.0, 0.5, 1.0], [1.2, 2.5]]):
        spark.createDataFrame([("a", t, "p") for t in part], schema).coalesce(1).write.json(str(tmp_path / "in" / str(i)))
    s = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    got = sorted(r.ts for r in _run(spark, stateful.thin(s, 1.0, strict=False), "thin"))
    assert got[0] == 0.0 and all(b - a >= 1.0 for a, b in zip(got, got[1:]))
    schema = "key string, name string, size long, sha256 string, manifest string"
    m = json.dumps([{"name": "f", "size": 3, "sha256": "h"}])
    rows = [("u", None, None, None, m), ("v", "f", 3, "h", None), ("u", "f", 3, "h", None), ("v", None, None, None, json.dumps([{"name": "f", "size": 3, "sha256": "other"}]))]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.json(str(tmp_path / "up" / str(i)))
    s = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).json(str(tmp_path / "up"))
    assert [tuple(r) for r in _run(spark, stateful.completed(s), "done")] == [("u", 1, 3, "complete")]


def test_cli(spark, tmp_path, capsys):
    path = R.write(tmp_path, R.files_split("4.8", "front"))
    assert cli.main(["list", path]) == 0
    assert cli.main(["inspect", path]) == 1  # the alignment of a synthetic recording can't be measured
    assert "[PASS] timestamps" in capsys.readouterr().out
