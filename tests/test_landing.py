"""Uploaded files land whole or not at all, and whole uploads become archives."""

import hashlib
import json
import os
import tarfile

from pyspark.sql import functions as F

from parallaxis.sources import landing, uploads
from tests import recordings as R

SCHEMA = "path string, token string, data_root string, content_length long, sha256 string, data binary, body string"


def sha(b):
    return hashlib.sha256(b).hexdigest()


def put(root, key, name, data, /, **other):
    r = {"path": f"/upload/{key}/{name}", "token": "t", "data_root": str(root), "content_length": len(data), "sha256": sha(data), "data": bytearray(data), "body": None} | other
    return tuple(r[c.split()[0]] for c in SCHEMA.split(", "))


def upload(root, key, files, piece=300):
    """Requests of a whole upload, the manifest last."""
    rows, members = [], []
    for name, data in files.items():
        if name.endswith(".bin"):
            parts = [(f"{name}.{i // piece:06d}", data[i : i + piece]) for i in range(0, len(data), piece)]
            members.append({"name": name, "segments": [{"name": n, "size": len(b), "sha256": sha(b)} for n, b in parts]})
        else:
            parts = [(name, data)]
            members.append({"name": name, "size": len(data), "sha256": sha(data)})
        rows += [put(root, key, n, b) for n, b in parts]
    return [*rows, put(root, key, "manifest.json", json.dumps({"scan_id": R.scan_id(files), "members": members}).encode())]


def roots_of(spark, *roots):
    return spark.createDataFrame([(str(r),) for r in roots], "root string")


def staged_files(root):
    return sorted(os.path.relpath(os.path.join(d, f), root / ".staging") for d, _, names in os.walk(root / ".staging") for f in names if not f.endswith(".crc"))


def test_answers_are_those_of_the_rules_and_bad_files_leave_nothing(spark, tmp_path):
    (tmp_path / "spooled").write_bytes(b"from a file, and more")
    good = b"{}"
    rows = [
        put(tmp_path, "k", "scan_metadata.json", good), put(tmp_path, "k", "color_frames.bin.000000", b"abc", content_length=4), put(tmp_path, "k", "color_frames.bin.000001", b"abc", sha256="0" * 64),
        put(tmp_path, "k", "color_frames.bin.000002", b"abcdef", content_length=3, sha256=sha(b"abc")), put(tmp_path, "k", "x.json", good), put(tmp_path, "k", "extrinsics.json", good, token="no"), put("/nowhere", "k", "extrinsics.json", good),
        put(tmp_path, "k", "extrinsics.json", good, content_length=-1), put(tmp_path, "k", "extrinsics.json", good, sha256=None), put(tmp_path, "k", "color_intrinsics.json", b"", data=None), put(tmp_path, "k", "scan_metadata.json", good),
    ]
    requests = spark.createDataFrame(rows, SCHEMA)
    roots = roots_of(spark, tmp_path)
    key = lambda r: (r.path, r.content_length, r.sha256 or "", r.status, r.reason or "")
    got = sorted(map(key, landing.land(requests, "t", roots).collect()))
    assert got == sorted(map(key, uploads.put_answers(requests.drop("body"), "t", roots).collect()))
    assert staged_files(tmp_path) == sorted(f"k/{n}{x}" for n in ("scan_metadata.json", "color_frames.bin.000002", "color_intrinsics.json") for x in ("", ".sha256"))
    assert (tmp_path / ".staging/k/color_frames.bin.000002").read_bytes() == b"abc" and (tmp_path / ".staging/k/scan_metadata.json.sha256").read_text() == sha(good)
    spool = spark.createDataFrame([put(tmp_path, "k", "extrinsics.json", b"from a file", data=None, body=str(tmp_path / "spooled"))], SCHEMA)
    assert landing.land(spool, "t", roots).first().status == 200 and (tmp_path / ".staging/k/extrinsics.json").read_bytes() == b"from a file"


def test_uploads_become_archives_when_they_are_whole(spark, tmp_path):
    files = R.files_split("5.2", "rear")
    rows, roots = upload(tmp_path, "up", files), roots_of(spark, tmp_path)
    land = lambda some: landing.land(spark.createDataFrame(some, SCHEMA), "t", roots).collect()
    land(rows[1:])
    assert landing.store(spark, roots) == [] and not list(tmp_path.glob("*.tar"))
    land(rows[:1])
    assert landing.store(spark, roots) == [(str(tmp_path), "up", R.scan_id(files))]
    archive = tmp_path / f"{R.scan_id(files)}.tar"
    with tarfile.open(archive, "r:") as tar:
        assert {m.name.split("/")[1]: tar.extractfile(m).read() for m in tar.getmembers()} == files
    assert staged_files(tmp_path) == []
    before = archive.stat().st_ino
    land(upload(tmp_path, "again", files))
    assert landing.store(spark, roots) == [] and archive.stat().st_ino == before and len(staged_files(tmp_path)) > 10  # it stays, and so does the other upload


def test_manifests_that_list_other_files(spark, tmp_path):
    bad = [{"scan_id": "../x", "members": []}, {"scan_id": "s", "members": [{"name": "x.json", "size": 1, "sha256": "h"}]}, {"scan_id": "s", "members": [{"name": "color_frames.bin", "segments": [{"name": "depth_frames.bin.000000", "size": 1, "sha256": "h"}]}]}, []]
    rows = [put(tmp_path, f"k{i}", "manifest.json", json.dumps(m).encode()) for i, m in enumerate(bad)] + [put(tmp_path, "k9", "manifest.json", b"{")]
    roots = roots_of(spark, tmp_path)
    assert {r.status for r in landing.land(spark.createDataFrame(rows, SCHEMA), "t", roots).collect()} == {200}
    assert landing.staged(spark, roots)[1].count() == 0 and landing.store(spark, roots) == []


def test_a_stream_of_requests(spark, tmp_path):
    every = {c: R.files_split("5.2", c) for c in ("front", "rear")}
    (tmp_path / "root").mkdir()
    rows = [upload(tmp_path / "root", c, files) for c, files in every.items()]
    batches = [[*rows[0][::2], rows[1][-1]], [*rows[0][1::2], *rows[1][:3], put(tmp_path / "root", "front", "bad", b"x")], rows[1]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
        for p in (tmp_path / "in" / str(i)).glob("*.parquet"):
            os.utime(p, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = landing.receive(stream, "t", roots_of(spark, tmp_path / "root"), str(tmp_path / "answers"), str(tmp_path / "checkpoint"))
    q.processAllAvailable()
    q.stop()
    assert sorted(p.name for p in (tmp_path / "root").glob("*.tar")) == sorted(f"{R.scan_id(f)}.tar" for f in every.values())
    answers = spark.read.parquet(str(tmp_path / "answers"))
    assert answers.count() == sum(map(len, batches)) and answers.where("status <> 200").select("reason").collect()[0][0] == "bad path"
    assert answers.groupBy("batch").count().count() == 3 and answers.where(F.col("status") == 200).count() == sum(map(len, batches)) - 1
