"""Rules of a receiver, routes, lookups, hand-over and descriptions, on hand-made cases."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from parallaxis.checks import report
from parallaxis.functions import scalar
from parallaxis.kernels import image
from parallaxis.operators import capture, series
from parallaxis.sources import sinks, uploads, worklog
from tests import recordings as R

BODY = b"frames"
GOOD = {"path": "/upload/k-1.a/color_frames.bin.000012", "token": "t", "data_root": "/data/a", "content_length": len(BODY), "data": BODY, "sha256": hashlib.sha256(BODY).hexdigest()}
PUT = "n int, path string, token string, data_root string, content_length long, data binary, sha256 string"


def test_answers_to_put(spark):
    cases = [
        ({}, 200, None),
        ({"data": BODY + b"more"}, 200, None),
        ({"content_length": -1, "path": "/x"}, 411, "length required"),
        ({"content_length": None}, 411, "length required"),
        ({"path": "/upload/k/color_frames.bin", "token": "no"}, 404, "bad path"),
        ({"path": "/upload/.k/manifest.json"}, 404, "bad path"),
        ({"path": "/upload/k/manifest.json\n"}, 404, "bad path"),
        ({"path": None}, 404, "bad path"),
        ({"token": "no", "data_root": "/data/none"}, 403, "bad token"),
        ({"token": None}, 403, "bad token"),
        ({"data_root": "/data/../data/a"}, 400, "bad data root"),
        ({"data_root": "/data/b"}, 400, "bad data root"),
        ({"data_root": None}, 400, "bad data root"),
        ({"data": BODY[:3]}, 400, "bytes missing"),
        ({"data": None}, 400, "bytes missing"),
        ({"sha256": "0" * 64}, 400, "sha256 mismatch"),
        ({"sha256": None}, 400, "sha256 mismatch"),
        ({"path": "/upload/k/manifest.json", "content_length": 0, "data": None, "sha256": hashlib.sha256(b"").hexdigest()}, 200, None),
    ]
    roots = spark.createDataFrame([("/data/a",), ("/data/a",)], "root string")
    rows = spark.createDataFrame([(i, *(GOOD | change).values()) for i, (change, *_) in enumerate(cases)], PUT)
    got = {r.n: r for r in uploads.put_answers(rows, "t", roots).collect()}
    assert [(got[i].status, got[i].reason) for i in range(len(cases))] == [(s, r) for _, s, r in cases]
    assert (got[0].key, got[0].file) == ("k-1.a", "color_frames.bin.000012") and got[7].key is None
    assert uploads.put_answers(rows.limit(0), "t", roots).collect() == []


def test_answers_to_get(spark):
    asked = [("/ping", None, None), ("/recordings", "t", "/d"), ("/stored/a", "t", "/d"), ("/stored/b", "t", "/d"), ("/stored/", "t", "/d"), (None, "t", "/d"), ("/stored/a", None, "/d"), ("/stored/a", "t", "d")]
    rows = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "n int, path string, token string, data_root string")
    roots, archives = spark.createDataFrame([("/d",)], "root string"), spark.createDataFrame([("/d", "a"), ("/e", "b")], "root string, scan_id string")
    got = sorted(uploads.get_answers(rows, "t", roots, archives).collect())
    assert [(r.status, r.stored) for r in got] == [(200, None), (200, None), (200, True), (200, False), (404, None), (404, None), (403, None), (400, None)]


def test_descriptions(spark):
    one = spark.range(1)
    drop = lambda v: one.select(scalar.drop_reason(F.lit(v).cast("string"))).first()[0]
    assert [drop(v) for v in ("lateData", "outOfBuffers", "discontinuity", "other", None)] == ["late", "out_of_buffers", "discontinuity", "unknown", None]
    state = lambda s, r=None: one.select(scalar.tracking_state(F.lit(s).cast("string"), F.lit(r).cast("string"))).first()[0]
    assert [state("normal"), state("notAvailable"), state("limited", "excessiveMotion"), state(None)] == ["normal", "not_available", "limited_excessive_motion", None]
    with pytest.raises(PySparkException):
        state("limited", "fog")


def test_a_finished_recording_is_found_in_memory_first(spark):
    schema = "upload_id string, scan_id string, size long"
    memory = spark.createDataFrame([("u", "a", 1)], schema)
    disk = spark.createDataFrame([("u", "a", 2), (None, "b", 3), ("w", "c", 4)], schema)
    wanted = spark.createDataFrame([("u",), ("b",), ("w",), ("gone",), ("u",)], "upload_key string")
    got = capture.finished(wanted, memory, disk, spark.createDataFrame([("w",)], "upload_key string")).collect()
    assert sorted((r.upload_key, r.scan_id, r.size) for r in got) == [("b", "b", 3), ("u", "a", 1)]


def test_segments_are_handed_over(spark):
    df = spark.createDataFrame([(k, i, 4) for k in "ab" for i in range(5)], "k string, i int, size int")
    rows = series.packed(df, ["k"], ["i"], "size", 8)
    got = series.handed_over(rows, ["k"], "size", 8, spark.createDataFrame([("a",)], "k string"))
    assert sorted((r.k, r.segment, r.frames, r.size) for r in got.collect()) == [("a", 0, 2, 8), ("a", 1, 2, 8), ("a", 2, 1, 4), ("b", 0, 2, 8), ("b", 1, 2, 8)]


def test_lines_that_do_not_parse_are_named(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"scan_id": "s", "file": "f", "seg_index": 0, "size": 1, "sha256": "x"}\n{"scan_id": \n\n{"size": "many"}\n')
    bad = worklog.unparsed(spark, str(tmp_path / "log.jsonl"), worklog.SEGMENT_LINE).collect()
    assert sorted((r.line_no, r.text) for r in bad) == [(2, '{"scan_id": '), (4, '{"size": "many"}')] and bad[0].file.endswith("log.jsonl")


def _pixels(png: bytes) -> np.ndarray:
    """RGB of an 8-bit PNG whose rows aren't filtered."""
    at, data = 8, b""
    while at < len(png):
        n, kind = struct.unpack(">I4s", png[at : at + 8])
        if kind == b"IHDR":
            w, h = struct.unpack(">II", png[at + 8 : at + 16])
        data += png[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += 12 + n
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, 1 + 3 * w)[:, 1:].reshape(h, w, 3)


def test_turbo_and_stretch():
    ramp = image.turbo(np.linspace(0, 1, 256))
    assert ramp.shape == (256, 3) and len(np.unique(ramp, axis=0)) > 200
    assert ramp[40, 0] > ramp[40, 2] and ramp[230, 2] > ramp[230, 0]  # blue is near, red far
    z = np.array([[np.nan, 0, 1.0], [2.0, 3.0, 9.0]], dtype=np.float32)
    got = image.stretched(z, 1.0, 3.0)
    assert not got[0, :2].any() and (got[1, 1] == got[1, 2]).all() and (got[0, 2] == ramp[0]).all()
    assert image.stretched(z, 2.0, 2.0).shape == (2, 3, 3)


def test_panels(spark, tmp_path):
    path = R.write(tmp_path, R.files_split("4.8", "front"))
    rows = sinks.panels(spark, path, box=48).orderBy("pos").collect()
    assert [(r.color_index, r.depth_index) for r in rows] == [(0, 0), (1, 1), (None, 2), (2, None), (3, 3)]
    z = R.depth_maps()
    low, high = np.percentile(z[np.isfinite(z) & (z > 0)], [2, 98])
    assert all(abs(r.near - low) < 0.05 and abs(r.far - high) < 0.05 for r in rows)
    shown = [_pixels(r.panel) for r in rows]
    assert {p.shape for p in shown} == {(48 + image.LEGEND_ROWS, 96, 3)}
    assert [(p[:48, :48].any(), p[:48, 48:].any()) for p in shown] == [(True, True), (True, True), (False, True), (True, False), (True, True)]
    assert rows[3].valid_share is None and abs(rows[2].valid_share - (1 - 1 / z[2].size)) < 1e-9
    out = tmp_path / "out"
    assert sinks.render(spark, path, str(out), box=48).count() == 5
    assert sorted(p.name for p in out.rglob("*.png")) == [f"{r.pos:06d}.png" for r in rows]


def test_other_intrinsics_for_the_alignment(spark, tmp_path):
    t = report.tables(spark, R.write(tmp_path, R.files_split("4.8", "front")))
    p = report.pairs(t)
    twice = lambda k, sx, sy: [2 * v for v in k]
    assert report.carried(t, p).first().carried and not report.carried(t, p, twice).first().carried
    report.spatial(t, p, F.col("color_k")).collect()
