"""The quality report on synthetic recordings: which checks apply, and that a fault fails its own check only."""

import numpy as np
import pytest

from parallaxis.checks import report
from tests import recordings as R

ALIGNMENT = {10, 11}
EXPECTED = {
    ("4.8", "front"): {1, 2, 8, 9, 10, 11, 13, 14, 15, 17, 22, 23, 29}, ("4.8", "rear"): {1, 2, 8, 9, 10, 11, 14, 15, 16, 22, 24, 25, 29}, ("5.0.2", "front"): {1, 2, 4, 8, 9, 10, 11, 13, 14, 15, 17, 22, 23, 29}, ("5.2", "rear"): {1, 3, 4, 8, 9, 10, 11, 14, 15, 16, 22, 24, 25, 29},
}
OLD = {5, 6, 7, 8, 9, 10, 11, 12, 14, 20, 21, 30}


def failed(spark, path):
    rows = report.checks(report.tables(spark, str(path))).collect()
    return {r.check_no for r in rows}, {r.check_no for r in rows if not r.passed} - ALIGNMENT


@pytest.mark.parametrize(("version", "camera"), list(EXPECTED))
def test_split(spark, tmp_path, version, camera):
    there, bad = failed(spark, R.write(tmp_path, R.files_split(version, camera)))
    assert there == EXPECTED[version, camera] and not bad


@pytest.mark.parametrize(("minor", "camera", "more"), [(7, "front", {13, 18, 19}), (7, "rear", {16, 26, 27}), (4, "rear", {16, 26, 27, 28})])
def test_tables(spark, tmp_path, minor, camera, more):
    there, bad = failed(spark, R.write(tmp_path, R.files_tables(minor, camera)))
    assert there == OLD | more and not bad


def _hash(m):
    m["sha256"] = "0" * 64


def _raw(m):
    m["frames"][0]["raw_sha256"] = m["frames"][1]["raw_sha256"]


def _run(m):
    m["distortions"][1]["frame_ranges"] = [[2, 2]]


@pytest.mark.parametrize(("version", "file", "change", "fails"), [("4.8", "color_frames_metadata.json", _hash, 2), ("5.0.2", "color_frames_metadata.json", _raw, 4), ("4.8", "depth_intrinsics.json", _run, 23)])
def test_one_fault_fails_one_check(spark, tmp_path, version, file, change, fails):
    assert failed(spark, R.write(tmp_path, R.edited(R.files_split(version, "front"), file, change)))[1] == {fails}


def test_many_recordings_at_once(spark, tmp_path):
    R.write(tmp_path, R.files_split("5.2", "rear"))
    R.write(tmp_path, R.files_tables(7, "front"))
    rows = report.checks(report.tables(spark, str(tmp_path))).collect()
    assert len({r.scan_id for r in rows}) == 2
    assert report.statistics(report.tables(spark, str(tmp_path))).count() == 2


def _range(z):
    return [z.min(), *np.percentile(z.astype(float), [1, 50, 99]), z.max(), z.size]


def _numbers(r):
    return [r["low"], r["p1"], r["median"], r["p99"], r["high"], r["count"]]


def test_statistics_of_a_rear_recording(spark, tmp_path):
    s = report.statistics(report.tables(spark, R.write(tmp_path, R.files_split("5.2", "rear")))).first()
    z, c = R.depth_maps(), R.confidence_maps()
    ok = np.isfinite(z) & (z > 0)
    assert _numbers(s.depth) == pytest.approx(_range(z[ok])) and _numbers(s.high) == pytest.approx(_range(z[ok & (c == 2)]))
    assert s.stretch == pytest.approx(np.percentile(z[ok].astype(float), [2, 98])) and s.confidence == pytest.approx([(c[ok] == v).mean() for v in range(3)])
    assert s.color_dropped_by_reason == {"writer_busy": 1} and s.depth_dropped_by_reason == {"no_scene_depth": 1} and s.tracking == {"normal": 1.0}
    assert (s.pairs, s.pairs_with_color, s.depth_out_of_span) == (4, 3, 0)
    assert (s.color_fx_frames, s.depth_fx_frames) == (4, 4) and s.exposure_min == s.exposure_max == s.exposure_median == 0.01 and s.lens_min is None


def test_statistics_of_a_front_table(spark, tmp_path):
    s = report.statistics(report.tables(spark, R.write(tmp_path, R.files_tables(7, "front")))).first()
    assert s.high is None and s.confidence is None and s.tracking is None and s.depth["count"] == 4 * R.DW * R.DH - 2
    assert s.lens_min == s.lens_max == 0.7 and s.latency_max == pytest.approx(0.05) and s.depth_bytes_per_row == [R.DW * 4]
    assert s.depth_dropped_by_reason == {"late_data": 1}


def test_a_report_reads_rows_of_frames_once(spark, tmp_path):
    path = R.write(tmp_path, R.files_split("5.2", "front"))
    t = report.tables(spark, path)
    try:
        plan = report.checks(t)._jdf.queryExecution().optimizedPlan().toString()
        assert "InMemoryRelation" in plan and t.frames.storageLevel.useDisk
    finally:
        t.release()
    assert not t.frames.storageLevel.useMemory
