"""Operators against hand-made cases and brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parallaxis.functions import geometry, scalar
from parallaxis.operators import joins, runs, series, stats


def test_same_instant_is_a_bucket_not_a_band(spark):
    left = spark.createDataFrame([("a", 1.0), ("a", 2.00024), ("a", 3.0)], "k string, t double")
    right = spark.createDataFrame([("a", 1.0, 0, "old"), ("a", 1.0001, 1, "new"), ("a", 2.00026, 2, "straddles")], "k string, rt double, pos int, v string")
    got = {(r.t, r.v) for r in joins.same_instant(left, right, ["k"], "t", "rt", "pos").collect()}
    assert got == {(1.0, "new")}


def test_latest_or_first(spark):
    probe = spark.createDataFrame([("a", t) for t in (0.0, 1.0, 1.5, 9.0)] + [("b", 1.0)], "k string, t double")
    build = spark.createDataFrame([("a", 1.0, "A"), ("a", 2.0, None), ("a", 3.0, "B"), ("b", 5.0, None)], "k string, bt double, v string")
    got = {(r.k, r.t): r.v for r in joins.latest_or_first(probe, build, ["k"], "t", "bt", "v").collect()}
    assert got == {("a", 0.0): "A", ("a", 1.0): "A", ("a", 1.5): "A", ("a", 9.0): "B", ("b", 1.0): None}


@pytest.mark.parametrize("seed", range(3))
def test_runs_expand_to_what_was_encoded(spark, seed):
    rng = random.Random(seed)
    values = [rng.choice(["x", "y", None]) for _ in range(40)]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "k string, pos int, v string")
    encoded = runs.encode(df, ["k"], "pos", F.col("v"))
    back = {r.pos: r.value for r in runs.expand(encoded).collect()}
    assert [back.get(i) for i in range(40)] == values
    assert all(r.is_disjoint for r in runs.disjoint(encoded, ["k"]).collect())
    first = [r.value for r in runs.entries(encoded, ["k"]).orderBy("entry_no").collect()]
    assert first == list(dict.fromkeys(v for v in values if v is not None))


def test_overlapping_runs(spark):
    bad = spark.createDataFrame([("k", "x", 0, 3), ("k", "y", 3, 5)], "k string, value string, first int, last int")
    assert not runs.disjoint(bad, ["k"]).first().is_disjoint


@pytest.mark.parametrize("seed", range(3))
def test_thinning_and_packing(spark, seed):
    rng = random.Random(seed)
    t = sorted(rng.randrange(100) for _ in range(60))
    size = [rng.randrange(1, 9) for _ in range(60)]
    df = spark.createDataFrame([("a", i, float(x), s) for i, (x, s) in enumerate(zip(t, size, strict=True))], "k string, i int, t double, size long")
    kept, last = [], -math.inf
    for i, x in enumerate(t):
        if x - last >= 7:
            kept.append(i)
            last = x
    assert sorted(r.i for r in series.thinned(df, ["k"], "t", "i", 7.0).collect()) == kept
    want, seg, held = [], 0, 0
    for s in size:
        want.append(seg)
        held += s
        if held >= 20:
            seg, held = seg + 1, 0
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    assert [r.segment for r in series.packed(df, ["k"], ["i"], "size", 20).orderBy("i").collect()] == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


@pytest.mark.parametrize("n", [1, 2, 39, 40, 41, 97, 1000])
def test_subsample(spark, n):
    df = spark.range(n).select(F.lit("a").alias("k"), "id")
    m = min(40, n)
    assert sorted(r.id for r in series.subsample(df, ["k"], ["id"], 40).collect()) == sorted({i * (n - 1) // max(m - 1, 1) for i in range(m)})


def test_order_with_dropped(spark):
    got = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0)], "k string, id int, ts double")
    lost = spark.createDataFrame([("a", 3, 1.0, "late"), ("a", 4, 0.5, "late")], "k string, id int, ts double, reason string")
    rows = series.with_dropped(got, lost, ["k"], "ts", "id").orderBy("pos").collect()
    assert [(r.id, r.reason) for r in rows] == [(4, "late"), (1, None), (3, "late"), (2, None)]


def test_zipped_refuses_unequal_lists(spark):
    df = spark.createDataFrame([(1, [1, 2], ["a", "b"]), (2, [1], ["a", "b"])], "id int, x array<int>, y array<string>")
    assert joins.zipped(df.where("id = 1"), ["x", "y"]).count() == 2
    with pytest.raises(Exception, match="differ in length"):
        joins.zipped(df, ["x", "y"]).collect()


def test_positional_join_takes_every_document(spark, tmp_path):
    from parallaxis.plans import recordings_on_events

    texts = {1: "a bc", 2: "word " * 20_000, 3: "", 4: None, 5: "no count here", 6: "ä  b"}
    docs = spark.createDataFrame([(i, t, None if i == 5 or t is None else len(t)) for i, t in texts.items()], "doc_id long, text string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in recordings_on_events.positional_join(spark, str(tmp_path)).collect())
    assert got == [(i, k, w, len(w)) for i, t in texts.items() if t is not None for k, w in enumerate(t.split(" "))]


def test_upper_median_rate_and_best(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 4.0)], "v double")
    assert stats.upper_medians(df, [], "v").first()[0] == 3.0
    assert stats.upper_medians(df.limit(3), [], "v").first()[0] == 2.0
    assert df.limit(1).agg(stats.rate(F.col("v"))).first()[0] is None
    ties = spark.createDataFrame([(1.0, 0.1), (1.0, 0.2), (float("nan"), 9.0)], "s double, c double")
    assert ties.agg(stats.best(F.col("s"), F.col("c"))).first()[0] == 0.2
    assert df.where("v > 9").agg(stats.all_of(F.col("v") > 0)).first()[0] is True


def test_median_interval_is_seeded(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(20)], "k string, v double")
    v = np.arange(20.0)
    want = np.percentile(np.median(v[np.random.default_rng(0).integers(0, 20, (1000, 20))], axis=1), [2.5, 97.5])
    assert stats.median_interval(df, ["k"], "v").first().median_interval == list(want)


def test_best_offset(spark):
    s = spark.createDataFrame([("a", -1, 2.0), ("a", 0, 2.0), ("b", 0, float("nan")), ("c", 1, None), ("c", 2, 0.5)], "k string, offset int, score double")
    assert {r.k: r.best_offset for r in series.best_offset(s, ["k"]).collect()} == {"a": -1, "b": None, "c": 2}


def test_scalar_rules(spark):
    df = spark.createDataFrame([("my räum 1", "4.7", "/a/b", 0.000005, 1718314864), ("  ", "4.8", "/a/../b", -0.000015, 1717855600), (None, "4.7\n", "a", 0.5, 1278226488)], "n string, v string, p string, g double, c int")
    got = df.select(scalar.sanitized(F.col("n")), scalar.entered(F.col("n")), scalar.format_minor(F.col("v")), scalar.is_data_root(F.col("p")), scalar.rounded_away(F.col("g"))).collect()
    assert [tuple(r) for r in got] == [("my_r_um_1", "my räum 1", 7, True, 0.00001), ("__", None, None, False, -0.00002), (None, None, None, False, 0.5)]
    z = spark.createDataFrame([(float("nan"),), (float("inf"),), (0.0,), (0.4,), (None,)], "z double")
    assert [r[0] for r in z.select(scalar.is_depth(F.col("z"))).collect()] == [False, False, False, True, False]
    assert spark.range(1).select(scalar.four_cc(F.lit(0x34323066))).first()[0] == "420f"


def test_names_states_and_orientations(spark):
    names = spark.createDataFrame([("\tname\n", 1), ("\n", 2), (" \u2003a b\u0085", 3), (None, 4), ("a\n\n", 5)], "n string, i int")
    assert [r[0] for r in names.orderBy("i").select(scalar.entered(F.col("n"))).collect()] == ["name", None, "a b", None, "a"]
    start = F.to_timestamp(F.lit("2026-10-16 12:00:01"))
    shown = [spark.range(1).select(scalar.display_name(F.lit(n).cast("string"), start, F.lit(c))).first()[0] for n, c in (("\t", "front"), (None, "rear"), ("x", "rear"))]
    assert shown == ["2026-10-16 12:00:01 Front", "2026-10-16 12:00:01 Rear", "x"]
    states = spark.createDataFrame([("not_uploaded", None), ("in_progress", "2 of 5"), ("uploaded", None), ("failed", "no route"), ("kept_on_phone", None), ("other", None)], "s string, d string")
    got = [tuple(r) for r in states.select(scalar.upload_label(F.col("s"), F.col("d")), scalar.can_start(F.col("s"))).collect()]
    assert got == [("not uploaded", True), ("2 of 5", False), ("uploaded, checking the server stored it", True), ("upload failed: no route", True), ("kept on this phone", False), (None, False)]
    turns = spark.createDataFrame([(d, m) for d in (0, 90, 180, 270, -90, 450, 45) for m in (False, True)], "d int, m boolean")
    got = [r[0] for r in turns.select(scalar.orientation(F.col("d"), F.col("m"))).collect()]
    assert got == ["up", "up_mirrored", "right", "left_mirrored", "down", "down_mirrored", "left", "right_mirrored", "left", "right_mirrored", "right", "left_mirrored", None, None]


def test_thinning_compares_differences(spark):
    """Of times whose sum and difference round to different sides of the limit, the difference decides."""
    rng, least = np.random.default_rng(9), 1 / 15
    t = np.sort(np.round(1e5 + rng.integers(0, 400, 300) / 30 + rng.choice([0, 1e-11, -1e-11], 300), 12))
    want, last = [], -np.inf
    for x in t:
        if x - last >= least:
            want.append(float(x))
            last = x
    df = spark.createDataFrame([("a", float(x), i) for i, x in enumerate(t)], "k string, ts double, i int")
    assert sorted(r.ts for r in series.thinned(df, ["k"], "ts", "i", least).collect()) == want


def test_interval_of_a_median_in_runs():
    v = np.random.default_rng(1).random(5000)
    drawn = np.median(v[np.random.default_rng(0).integers(0, 5000, (1000, 5000))], axis=1)
    assert stats.interval_of_median(v) == tuple(np.percentile(drawn, [2.5, 97.5]))


def test_geometry(spark):
    m = [[1.0, 0.0, 0.0, 5.0], [0.0, 1.0, 0.0, 5.0], [0.0, 0.0, 1.0, 5.0]]
    flipped = [[-1.0, 0.0, 0.0, 5.0], *m[1:]]
    df = spark.createDataFrame([("normal", m), ("normal", flipped), ("lost", m), (None, m)], "s string, m array<array<double>>")
    assert [r[0] for r in df.select(geometry.is_pose(F.col("s"), F.col("m"))).collect()] == [True, False, False, False]
    assert df.select(geometry.homogeneous(F.col("m"))).first()[0][3] == [0.0, 0.0, 0.0, 1.0]
    assert df.select(geometry.row_major(F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4))))).first()[0] == [[1, 3], [2, 4]]


@pytest.mark.parametrize("seed", range(3))
def test_exact_quantiles(spark, seed):
    rng = np.random.default_rng(seed)
    groups = {"a": rng.standard_normal(200).round(1), "b": np.array([5.0]), "c": np.repeat([1.0, 2.0], 30), "d": np.array([0.0, 1e12, 3.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None), ("a", float("nan"))], "k string, v double")
    got = {r.k: r.q for r in stats.exact_quantiles(df, ["k"], "v", 0.0, 0.05, 0.5, 0.95, 1.0, bins=16).collect()}
    for k, v in groups.items():
        assert got[k] == pytest.approx(list(np.percentile(v, [0, 5, 50, 95, 100])))


@pytest.mark.parametrize("seed", range(2))
def test_a_queue_drops_what_does_not_fit(spark, seed):
    rng = random.Random(seed)
    rows = [("a" if i % 3 else "b", i, rng.randrange(1, 9), rng.random() < 0.3) for i in range(80)]
    want, state = {}, {"a": [], "b": []}
    for k, i, n, done in rows:
        q = state[k]
        if done:
            want[i] = None
            del q[:1]
        else:
            want[i] = sum(q) + n <= 15
            q += [n] * want[i]
    df = spark.createDataFrame(rows, "k string, i int, n int, done boolean")
    assert {r.i: r.accepted for r in series.queued(df, ["k"], ["i"], "n", "done", 15).collect()} == want
    assert series.queued(df.limit(0), ["k"], ["i"], "n", "done", 15).count() == 0


def test_offsets_in_blocks_are_those_of_one_sort(spark):
    rows = [("a" if i % 3 else None, i, None if i == 7 else i % 5) for i in range(50)] + [("b", 0, None)]
    df = spark.createDataFrame(rows, "k string, i int, n long")
    plain = df.select("k", "i", series.offsets("n", ["k"], ["i"]).alias("starts"))
    got = series.offsets_in_blocks(df, "n", ["k"], ["i"], F.floor(F.col("i") / 8))
    assert sorted(map(tuple, got.select("k", "i", "starts").collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


def test_quantiles_of_counted_values(spark):
    rows = [("a", float(v), n) for v, n in ((3, 2), (1, 5), (9, 1), (3, 4))]
    got = stats.exact_quantiles(spark.createDataFrame(rows, "k string, v double, n long"), ["k"], "v", 0.1, 0.5, 0.9, times="n").first().q
    assert got == pytest.approx(np.percentile(np.repeat([r[1] for r in rows], [r[2] for r in rows]), [10, 50, 90]))


def _duck(sql, **tables):
    import duckdb

    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toPandas())
    return sorted(map(tuple, con.sql(sql).fetchall()), key=repr)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_null_keys_of_quantiles_and_medians(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", None]), rng.choice([1, None]), float(rng.randrange(50))) for _ in range(300)]
    df = spark.createDataFrame(rows, "k string, j int, v double")
    groups = {(k, j): sorted(v for a, b, v in rows if (a, b) == (k, j)) for k, j, _ in rows}
    got = {(r.k, r.j): r.q for r in stats.exact_quantiles(df, ["k", "j"], "v", 0.05, 0.5, bins=7).collect()}
    assert got == {g: pytest.approx(np.quantile(v, [0.05, 0.5]).tolist()) for g, v in groups.items()} and len(got) == 4
    assert {(r.k, r.j): r.upper_median for r in stats.upper_medians(df, ["k", "j"], "v", bins=5).collect()} == {g: v[len(v) // 2] for g, v in groups.items()}
    assert stats.upper_medians(df.limit(0), ["k"], "v").count() == 0


def test_upper_medians_of_bins(spark):
    """Ranks in any bin, values that repeat, rows that stand for several."""
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(0, 1, 400), np.full(900, 7.0), rng.normal(50, 0.01, 300)])
    df = spark.createDataFrame([("a", float(v), int(t)) for v, t in zip(values, rng.integers(1, 4, len(values)), strict=True)], "k string, v double, t long")
    every = np.sort(np.repeat(values, [r.t for r in df.select("t").collect()]))
    for bins in (1, 16, 1024):
        assert stats.upper_medians(df, ["k"], "v", bins, times="t").first().upper_median == every[len(every) // 2]
        assert np.allclose(stats.exact_quantiles(df, ["k"], "v", 0.0, 0.1, 0.9, 1.0, bins=bins, times="t").first().q, np.quantile(every, [0, 0.1, 0.9, 1]))


def test_null_keys_of_joins(spark):
    a = spark.createDataFrame([("x", None, 1), (None, "m", 2), (None, None, 3), ("y", "m", None)], "k string, m string, v int")
    b = spark.createDataFrame([("x", None, 1), (None, "m", 9), ("y", "m", None), ("z", None, 4)], "k string, m string, v int")
    want = _duck("SELECT coalesce(a.k, b.k), coalesce(a.m, b.m), a.v, b.v FROM (SELECT *, 1 AS l FROM a) a FULL JOIN (SELECT *, 1 AS r FROM b) b ON a.k IS NOT DISTINCT FROM b.k AND a.m IS NOT DISTINCT FROM b.m WHERE l IS NULL OR r IS NULL OR a.v IS DISTINCT FROM b.v", a=a, b=b)
    clean = lambda rows: sorted((tuple(None if x is None or x != x else x for x in r) for r in rows), key=repr)
    assert clean(_rows(joins.same_maps(a, b, ["k", "m"], ["v"]))) == clean(want) and len(want) == 3
    assert _rows(joins.complete(a, b, ["k"], ["m"])) == sorted([("x", 1, 1, True), (None, 2, 1, False), ("y", 1, 1, True)], key=repr)
    assert _rows(joins.missing(a, b, ["k", "m"])) == [(None, None, 3)]
    left, right = a.select("k", F.lit(1.0).alias("t")), b.where("m IS NOT NULL OR k = 'x'").select("k", F.lit(1.0).alias("u"), F.lit(0).alias("pos"))
    assert _rows(joins.same_instant(left, right, ["k"], "t", "u", "pos").select("k", "u")) == sorted([("x", 1.0), (None, 1.0), (None, 1.0), ("y", 1.0)], key=repr)


def test_null_keys_of_runs_and_segments(spark):
    frames = spark.createDataFrame([(k, i) for k in ("a", None) for i in range(4)], "k string, i int")
    found = spark.createDataFrame([("a", "x", 0, 1), (None, "y", 2, 3)], "k string, value string, first int, last int")
    assert _rows(runs.per_frame(frames, found, ["k"], "i")) == sorted([("a", 0, "x"), ("a", 1, "x"), ("a", 2, None), ("a", 3, None), (None, 0, None), (None, 1, None), (None, 2, "y"), (None, 3, "y")], key=repr)
    packed = spark.createDataFrame([(k, s, 5) for k in ("a", None, "b") for s in (0, 0, 1)], "k string, segment long, size long")
    ended = spark.createDataFrame([(None,), ("b",), (None,)], "k string")
    assert _rows(series.handed_over(packed, ["k"], "size", 10, ended)) == sorted([("a", 0, 2, 10), (None, 0, 2, 10), (None, 1, 1, 5), ("b", 0, 2, 10), ("b", 1, 1, 5)], key=repr)


def test_distortion_needs_both_tables(spark):
    df = spark.createDataFrame([([1.0], [2.0]), (None, [2.0]), ([1.0], None)], "lut array<float>, inv array<float>")
    size, reference = [F.lit(1920), F.lit(1440)], [F.lit(4032), F.lit(3024)]
    got = [r[0] for r in df.select(geometry.distortion([F.lit(2000.0), F.lit(1500.0)], F.col("lut"), F.col("inv"), size, reference)).collect()]
    s = np.float32(1920) / np.float32(4032)
    assert got[1:] == [None, None] and got[0].lookup_table == [1.0] and np.allclose(got[0].center, [2000 * s, 1500 * s], rtol=1e-6) and np.float32(got[0].scale[0]) == s


def test_durations(spark):
    df = spark.createDataFrame([(0.0,), (61.5,), (59.4,), (3599.6,), (6000.0,), (None,)], "s double")
    assert [r[0] for r in df.select(scalar.display_duration(F.col("s"))).collect()] == ["0:00", "1:02", "0:59", "60:00", "100:00", None]
