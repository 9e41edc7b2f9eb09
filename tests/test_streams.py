"""Streams give what their batch forms give, also across restarts, and keep bounded state."""

import json
import os
import random
import time

import pytest

from parallaxis.operators import capture, series
from parallaxis.sources import recording_tar, replay
from parallaxis.streaming import stateful
from tests import recordings as R


def fed(spark, folder, schema, *batches):
    """A stream that gets one list of rows a batch."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(folder / f"{i:03d}"))
        for p in (folder / f"{i:03d}").glob("*.json"):
            os.utime(p, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).json(str(folder))


def ran(spark, stream, name, checkpoint=None, until=None):
    writer = stream.writeStream.format("memory").queryName(name).outputMode("append")
    q = (writer.option("checkpointLocation", str(checkpoint)) if checkpoint else writer).start()
    try:
        if until is None:
            q.processAllAvailable()
        end = time.time() + 120  # with timers of the clock a query always has another batch
        while until and time.time() < end and spark.table(name).where(until).count() == 0:
            time.sleep(0.3)
    finally:
        q.stop()
    return spark.table(name).collect()


def test_replay_is_the_batch_also_across_a_restart(spark, tmp_path):
    root, out, checkpoint = tmp_path / "root", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    root.mkdir()
    recording_tar.register(spark)

    def run():
        frames = spark.readStream.format("recording_tar").option("table", "frames").load(str(root))
        q = frames.writeStream.format("parquet").option("checkpointLocation", checkpoint).start(out)
        q.processAllAvailable()
        q.stop()
        return sorted(map(str, spark.read.schema(frames.schema).parquet(out).collect()))

    batch = lambda: sorted(map(str, recording_tar.load(spark, str(root), "frames").collect()))
    R.write(root, R.files_split("5.2", "front"))
    (root / ".half.tar").write_bytes(b"not there yet")
    assert run() == batch() and len(batch()) == 10
    R.write(root, R.files_split("4.8", "rear"))
    R.write(root, R.files_tables(7, "front"))
    assert run() == batch() and len(batch()) == 30
    assert run() == batch()  # nothing new


def test_offsets_of_replay_stay_small(tmp_path):
    from pyspark.sql.types import StringType, StructField, StructType

    reader = replay.ReplayReader(StructType([StructField("scan_id", StringType())]), {"path": str(tmp_path), "table": "frames", "lateness": "100"})
    assert reader.latestOffset() == {"upto": 0, "recent": []} and [p.path for p in reader.partitions(reader.initialOffset(), reader.latestOffset())] == [""]
    seen, offset = [], reader.initialOffset()
    for day in range(5):
        for k in range(3):
            p = tmp_path / f"{day}-{k}.tar"
            p.write_bytes(b"x")
            os.utime(p, (1_700_000_000 + 1000 * day - 90 * (k == 2), 1_700_000_000 + 1000 * day - 90 * (k == 2)))
            now = reader.latestOffset()
            seen += [os.path.basename(x.path) for x in reader.partitions(offset, now) if x.path]
            assert reader.partitions(now, now)[0].path == "" and len(now["recent"]) <= 3
            offset = json.loads(json.dumps(now))
    assert seen == [f"{day}-{k}.tar" for day in range(5) for k in range(3)]  # also those with a somewhat older time


def test_counters_are_a_fold(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for i in range(240):
        stream = rng.choice(["color", "color", "depth"])
        rows.append((rng.choice("ab"), i / 30, i, stream, rng.choice(["late", None, None, None]), None if stream == "color" else i / 1000, None if stream == "color" else float(i)))
    schema = "key string, ts double, pos long, stream string, dropped string, valid_share double, median_m double"
    got = ran(spark, stateful.counters(fed(spark, tmp_path, schema, rows[:70], rows[70:71], rows[71:])), "counters")
    want = []
    for key in "ab":
        n = {"color": 0, "depth": 0, "lost_color": 0, "lost_depth": 0}
        shown = (None, None)
        for k, _, _, stream, dropped, share, median in rows:
            if k != key:
                continue
            if dropped:
                n[f"lost_{stream}"] += 1
                continue
            n[stream] += 1
            if stream == "depth" and n["depth"] % 15 == 1:
                shown = (share, median)
            if stream == "color" and n["color"] % 5 == 0:
                want.append((key, *n.values(), *shown))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and len(want) > 15


def test_latest_sample_is_the_batch_join_and_state_stays_small(spark, tmp_path):
    rng = random.Random(5)
    frames = [(k, i / 10 + rng.random() / 50, f"f{i}") for i in range(120) for k in "ab"]
    samples = [(k, i / 25 + rng.random() / 100, f"s{k}{i}") for i in range(3, 300) for k in "ab" if k == "a" or i > 60]
    tied = [("a", 5.0, "tied")]
    schema = "key string, ts double, payload string"
    cut = lambda rows, a, b: [r for r in rows if a <= r[1] < b]
    end = [("end", 100.0, "x")]
    batches = [(cut([*frames, *[("a", 5.0, "ft")]], a, a + 4), cut([*samples, *tied], a, a + 4)) for a in range(0, 12, 4)] + [(end, end), ([("end", 101.0, "x")], end)]
    f = fed(spark, tmp_path / "f", schema, *[b[0] for b in batches])
    s = fed(spark, tmp_path / "s", schema, *[b[1] for b in batches])
    checkpoint = tmp_path / "checkpoint"
    got = {(r.key, r.ts): r.sample for r in ran(spark, stateful.with_latest(f, s, "1 second"), "latest", checkpoint) if r.key != "end"}
    batch = capture.with_latest(spark.createDataFrame([*frames, ("a", 5.0, "ft")], schema), spark.createDataFrame([*samples, *tied], "key string, st double, sample string"), ["key"], "ts", "st", "sample")
    want = {(r.key, r.ts): r.sample for r in batch.collect()}
    assert got == want and len(want) == 241 and got["a", 5.0] == "tied" and None in got.values()
    left = spark.read.format("statestore").option("stateVarName", "samples").load(str(checkpoint))
    per_key = left.groupBy("key").count().collect()
    assert all(r["count"] <= 2 for r in per_key), per_key  # one sample that later frames could still take


def test_segments_close_end_and_fall_silent(spark, tmp_path):
    rng = random.Random(7)
    rows = [(k, i / 5, i, rng.randrange(1, 40)) for i in range(60) for k in ("ends", "silent", "goes on")]
    rows += [("ends", 12.0, 60, None), ("goes on", 12.5, 61, 5)]
    later = [("goes on", 40.0, 100, 5)]
    schema = "key string, ts double, pos long, size long"
    checkpoint = tmp_path / "checkpoint"
    stream = stateful.segments(fed(spark, tmp_path / "in", schema, rows[:50], rows[50:], later, [("goes on", 41.0, 101, 5)]), 100, 15.0, "1 second")
    got = {(r.key, r.segment): (r.frames, r["size"], r.why) for r in ran(spark, stream, "segments", checkpoint, "why = 'silent' AND key = 'silent'")}
    sized = spark.createDataFrame([r for r in [*rows, *later, ("goes on", 41.0, 101, 5)] if r[3] is not None], schema)
    packed = series.packed(sized.where("key <> 'goes on' OR ts <= 12.5"), ["key"], ["ts", "pos"], "size", 100)
    ended = spark.createDataFrame([("ends",), ("silent",), ("goes on",)], "key string")
    want = {(r.key, r.segment): (r.frames, r["size"]) for r in series.handed_over(packed, ["key"], "size", 100, ended).collect()}
    assert {k: v[:2] for k, v in got.items() if k in want} == {k: v for k, v in want.items() if k in got} and {k for k in want if k[0] != "goes on"} <= set(got)
    last = lambda key: max(s for k, s in want if k == key)
    assert got["ends", last("ends")][2] in ("ended", "full") and got["silent", last("silent")][2] in ("silent", "full")
    assert {r.key for r in spark.read.format("statestore").option("stateVarName", "open").load(str(checkpoint)).select("key.key").collect()} <= {"goes on"}


@pytest.mark.parametrize("silence", [None, 20.0])
def test_completed_uploads_leave_the_state(spark, tmp_path, silence):
    schema = "key string, name string, size long, sha256 string, manifest string"
    manifest = json.dumps([{"name": "f", "size": 3, "sha256": "h"}, {"name": "g", "size": 4, "sha256": "i"}])
    batches = [[("u", "f", 3, "h", None), ("quiet", "f", 5, "x", None)], [("u", None, None, None, manifest)], [("u", "g", 9, "i", None)], [("u", "g", 4, "i", None)]]
    checkpoint = tmp_path / "checkpoint"
    got = ran(spark, stateful.completed(fed(spark, tmp_path / "in", schema, *batches), silence), f"done_{silence is None}", checkpoint, silence and "state = 'expired'")
    assert {tuple(r) for r in got} == {("u", 2, 7, "complete"), *([("quiet", 1, 5, "expired")] if silence else [])}
    held = lambda name: {r[0] for r in spark.read.format("statestore").option("stateVarName", name).load(str(checkpoint)).select("key.key").collect()}
    assert held("files") == (set() if silence else {"quiet"}) and held("manifest") == set()


def test_nothing_streams(spark, tmp_path):
    schema = "key string, ts double, pos long, size long"
    (tmp_path / "none").mkdir()
    empty = spark.readStream.schema(schema).json(str(tmp_path / "none"))
    assert ran(spark, stateful.segments(empty, 10, 1.0), "nothing") == []
