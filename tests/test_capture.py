"""Capture operators on hand-made cases."""

from pyspark.sql import functions as F

from parallaxis.operators import capture


def test_fan_out_and_sessions(spark):
    df = spark.createDataFrame([("s", 0.0, "c0", None), ("s", 1.0, "c1", "d1"), ("s", 2.0, "c2", None)], "k string, ts double, color string, depth string")
    rows = capture.fanned_out(df, ["color", "depth"], ["k", "ts"]).collect()
    assert sorted((r.ts, r.stream, r.value) for r in rows) == [(0.0, "color", "c0"), (1.0, "color", "c1"), (1.0, "depth", "d1"), (2.0, "color", "c2")]
    assert sorted(r.ts for r in capture.since_first(df, ["k"], "ts", "depth").collect()) == [1.0, 2.0]
    samples = spark.createDataFrame([("s", 0.5, "g")], "k string, st double, g string")
    assert {r.ts: r.g for r in capture.with_latest(df.select("k", "ts"), samples, ["k"], "ts", "st", "g").collect()} == {0.0: None, 1.0: "g", 2.0: "g"}


def test_formats(spark):
    schema = "cam string, color_no int, ranges array<struct<low:double,high:double>>, depths array<struct<width:int,height:int,kind:string>>"
    rows = [("f", 0, [(0.1, 0.2)], [(9, 9, "fdep")]), ("f", 1, [(0.01, 0.2)], [(4, 3, "hdep"), (4, 3, "fdep")]), ("f", 2, [(0.01, 0.2)], [(4, 3, "fdep"), (2, 2, "fdep")])]
    b = capture.best_pair(spark.createDataFrame(rows, schema), ["cam"], F.lit(0.05)).first()
    assert (b.color_no, b.depth_no) == (1, 1)
    v = spark.createDataFrame([("r", 4, 3, 60), ("r", 8, 6, 30), ("r", 8, 6, 60), ("r", 16, 9, 60)], "cam string, width int, height int, fps int")
    assert tuple(capture.best_video(v, ["cam"]).first()) == ("r", 8, 6, 60)


def test_configurations(spark):
    df = spark.createDataFrame([('{"phone": {}}', {"b": "1", "a": "2"}, ["x", "y"]), ('{"upload": {"destination": "a"}}', {}, None), ("{}", None, None)], "t string, s map<string,string>, c array<string>")
    got = df.select(capture.target(F.col("t")), capture.address(F.col("s"), F.lit("a")), capture.server_names(F.col("s")), capture.all_configs(F.lit("phone"), F.col("c"), F.lit(None).cast("array<string>")), capture.without_position(F.col("c"), F.lit(0))).collect()
    assert got[0][0] == "phone" and got[0][1] == "2" and got[0][2] == ["a", "b"] and got[0][3] == ["phone", "x", "y"] and got[0][4] == ["y"]
    odd = spark.createDataFrame([('{"upload": {}}',), ('{"destination": "a"}',), ('{"upload": {"destination": null}}',)], "t string")
    assert [r[0] for r in odd.select(capture.target(F.col("t"))).collect()] == ["phone"] * 3
    assert got[1][0] == "a" and got[1][1] is None and got[2][0] == "phone"


def test_gallery_and_progress(spark):
    g = spark.createDataFrame([("a", None, "2026", "none"), ("b", "u", "2027", "none")], "scan_id string, upload_id string, start_time_utc string, state string")
    s = spark.createDataFrame([("u", "uploading")], "upload_key string, state string")
    assert [(r.scan_id, r.state) for r in capture.gallery(g, s).collect()] == [("b", "uploading"), ("a", "none")]
    parts = spark.createDataFrame([("u", "x", 60, True), ("u", "y", 40, False)], "k string, name string, size long, uploaded boolean")
    sent = spark.createDataFrame([("u", "y", 20)], "k string, name string, bytes long")
    assert capture.progress(parts, sent, ["k"]).first().progress == 0.8


def test_upload_progress_is_its_sql(spark, tmp_path):
    """With repeated rows, nulls, sizes below 0 and recordings without bytes, of which only some have started."""
    import duckdb

    from parallaxis.plans import recordings_on_events as plans

    rows = [(1, 1, "view", 3.0), (2, 1, "click", 4.0), (2, 1, "click", 4.0), (2, 1, "error", 4.0), (3, 2, "error", 5.0), (4, 3, "view", 0.0), (5, 4, "click", None), (6, 5, "view", 3.0), (7, 5, "click", -4.0), (8, 5, "error", -1.0)]
    rows += [(9, None, None, 2.0), (None, None, "click", 1.0), (None, None, "click", 2.0), (10, 6, "view", float("nan")), (11, 7, "view", 1.0), (12, 7, "error", -1.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").selectExpr("*", "timestamp'2026-01-01' AS ts").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = con.execute(plans.ORACLES["upload_progress"]).fetchall()
    got = plans.upload_progress(spark, str(tmp_path))
    assert got.columns == ["user_id", "started", "progress"]
    of = lambda found: sorted(str(tuple(r)).replace("-nan", "nan") for r in found)
    assert of(got.collect()) == of(want)
    assert {r.user_id: r.started for r in got.collect()} == {1: True, 2: False, 3: False, 4: None, 5: False, None: True, 6: True, 7: True}


def test_progress_counts_a_part_once(spark):
    parts = spark.createDataFrame([("u", "x", 60, True), ("u", "y", 40, False), ("v", "x", 10, False), ("w", "x", 0, False)], "k string, name string, size long, uploaded boolean")
    sent = spark.createDataFrame([("u", "x", 60), ("u", "y", 15), ("u", "y", 5), ("u", "z", 9), ("q", "x", 1)], "k string, name string, bytes long")
    got = {r.k: (r.started, str(r.progress)) for r in capture.progress(parts, sent, ["k"]).collect()}
    assert got == {"u": (True, "0.8"), "v": (False, "0.0"), "w": (False, "nan")}
