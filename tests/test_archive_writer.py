"""Archives are written once and whole, whatever becomes of the tasks that write them."""

import hashlib
import os
import pickle
import tarfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import Row, StringType, StructField, StructType

from parallaxis.sources import archive_writer, recording_tar, sinks
from tests import recordings as R

SCHEMA = "scan_id string, position int, member string, data binary"


def rows_of(files, piece=41):
    """Frame files in pieces, other files whole."""
    rows, sid = [], R.scan_id(files)
    for name, data in files.items():
        for part in [data[i : i + piece] for i in range(0, len(data), piece)] if name.endswith(".bin") else [data]:
            rows.append((sid, len(rows), name, bytearray(part)))
    return rows


def contents(path):
    with tarfile.open(path, "r:") as tar:
        return {m.name: tar.extractfile(m).read() for m in tar.getmembers()}


def listing(root):
    return sorted(p for p in os.listdir(root) if not p.endswith(".crc"))


def test_what_is_written_reads_back(spark, tmp_path):
    every = {c: R.files_split("5.2", c) for c in ("front", "rear")}
    rows = [r for files in every.values() for r in rows_of(files)]
    df = spark.createDataFrame(rows[::-1], SCHEMA).repartition(5)
    archive_writer.write_archives(df, str(tmp_path / "root"))
    assert listing(tmp_path / "root") == sorted(f"{R.scan_id(f)}.tar" for f in every.values())
    for files in every.values():
        sid = R.scan_id(files)
        path = tmp_path / "root" / f"{sid}.tar"
        assert contents(path) == {f"{sid}/{n}": b for n, b in files.items()}
        assert path.read_bytes()[257:265] == b"ustar  \0"
        other = R.write(tmp_path, files)
        for table in recording_tar.TABLES:
            mine, theirs = (recording_tar.load(spark, str(p), table) for p in (path, other))
            drop = [c for c in ("tar_path", "size") if c in mine.columns and (table == "recordings" or c == "tar_path")]
            assert sorted(map(str, mine.drop(*drop).collect())) == sorted(map(str, theirs.drop(*drop).collect()))


def test_the_first_archive_stays_unless_it_is_overwritten(spark, tmp_path):
    one = [("s", 0, "a.json", bytearray(b"first"))]
    two = [("s", 0, "a.json", bytearray(b"second"))]
    root = str(tmp_path)
    for rows, overwrite, want in ((one, False, b"first"), (two, False, b"first"), (two, True, b"second")):
        archive_writer.write_archives(spark.createDataFrame(rows, SCHEMA), root, overwrite)
        assert contents(tmp_path / "s.tar") == {"s/a.json": want} and listing(tmp_path) == ["s.tar"]


def test_a_task_that_fails_leaves_nothing(spark, tmp_path):
    bad = R.files_split("5.2", "front")
    rows = [(s, p, m, bytearray(d), hashlib.sha256(d).hexdigest()) for s, p, m, d in rows_of(bad)]
    rows[3] = (*rows[3][:4], "0" * 64)
    rows += [("other", 0, "a.json", bytearray(b"x"), None)]
    df = spark.createDataFrame(rows, SCHEMA + ", sha256 string")
    with pytest.raises(Exception, match="isn't what was announced"):
        archive_writer.write_archives(df, str(tmp_path))
    assert listing(tmp_path) == []
    archive_writer.write_archives(df.where("scan_id = 'other'"), str(tmp_path))
    assert listing(tmp_path) == ["other.tar"]


def _writer(tmp_path, names="scan_id position member data", overwrite=False):
    return archive_writer.ArchiveWriter(StructType([StructField(n, StringType()) for n in names.split()]), {"path": str(tmp_path)}, overwrite)


def _rows(*rows):
    return iter([Row("scan_id", "position", "member", "data")(*r) for r in rows])


def test_repeated_and_speculative_attempts(tmp_path):
    """Three attempts at the same rows, in processes of their own as far as the writer knows; one of them reports."""
    driver = _writer(tmp_path)
    tasks = [pickle.loads(pickle.dumps(driver)) for _ in range(3)]
    rows = [("s", 0, "a.json", b"abc"), ("s", 1, "b.bin", b"12"), ("s", 2, "b.bin", b"345"), ("t", 0, "a.json", b"")]
    messages = [t.write(_rows(*rows)) for t in tasks]
    assert len(listing(tmp_path)) == 6 and all(p.startswith(".") for p in listing(tmp_path)) and recording_tar.archives(str(tmp_path)) == []
    driver.commit([messages[1], None])
    assert listing(tmp_path) == ["s.tar", "t.tar"]
    assert contents(tmp_path / "s.tar") == {"s/a.json": b"abc", "s/b.bin": b"12345"} and contents(tmp_path / "t.tar") == {"t/a.json": b""}
    driver.commit([])  # a job without rows
    again = _writer(tmp_path)
    again.commit([again.write(_rows(*rows))])  # the whole job once more
    assert listing(tmp_path) == ["s.tar", "t.tar"]


def test_a_job_that_is_given_up(tmp_path):
    driver = _writer(tmp_path)
    kept = driver.write(_rows(("s", 0, "a", b"1")))
    driver.write(_rows(("t", 0, "a", b"1")))  # its executor is lost before it reports
    driver.abort([kept, None])
    assert listing(tmp_path) == []


def test_rows_that_are_not_together(tmp_path):
    w = _writer(tmp_path)
    with pytest.raises(ValueError, match="don't follow each other"):
        w.write(_rows(("s", 0, "a", b"1"), ("t", 0, "a", b"1"), ("s", 1, "b", b"1")))
    assert listing(tmp_path) == []
    with pytest.raises(ValueError, match="several tasks"):
        w.commit([w.write(_rows(("s", 0, "a", b"1"))), w.write(_rows(("s", 1, "b", b"1")))])
    assert listing(tmp_path) == []
    with pytest.raises(ValueError, match="an archive's parts"):
        _writer(tmp_path, "scan_id data")


def test_staged_files_of_other_lengths(spark, tmp_path):
    (tmp_path / "part").write_bytes(b"12345")
    for size in (4, 6):
        df = spark.createDataFrame([("s", 0, "b.bin", str(tmp_path / "part"), size)], "scan_id string, position int, member string, path string, size int")
        with pytest.raises(Exception):  # noqa: B017
            archive_writer.write_archives(df, str(tmp_path / "root"))
        assert listing(tmp_path / "root") == []


def test_a_forced_decode_replaces_all_or_nothing(spark, tmp_path):
    files = R.files_split("5.2", "rear")
    out, path = tmp_path / "out", R.write(tmp_path, files)
    sinks.decode(spark, path, str(out))
    folder = out / R.scan_id(files)
    (folder / "color" / "000099.png").write_bytes(b"stale")
    before = {str(p): p.read_bytes() for p in folder.rglob("*") if p.is_file()}
    broken = R.edited(files, "color_frames_metadata.json", lambda m: m["frames"][2].update(raw_sha256="0" * 64, compressed_size=m["frames"][2]["compressed_size"] - 1) or m["frames"][3].update(compressed_size=m["frames"][3]["compressed_size"] + 1))
    R.write(tmp_path, broken)
    with pytest.raises(Exception):  # noqa: B017
        sinks.decode(spark, path, str(out), force=True).collect()
    assert {str(p): p.read_bytes() for p in folder.rglob("*") if p.is_file()} == before and os.listdir(out) == [folder.name]
    R.write(tmp_path, files)
    assert [r.frames for r in sinks.decode(spark, path, str(out), force=True).collect()] == [12]
    assert not (folder / "color" / "000099.png").exists() and len(list(folder.rglob("*.png"))) == 4 and os.listdir(out) == [folder.name]
