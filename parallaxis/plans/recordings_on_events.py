"""The library's operators as queries over the driver's tables, with the same in DuckDB SQL.

`events` stands for frame streams: a user is a recording, its events are frames in time order, and `error` events are
dropped frames. Each query is named for the operator that it applies to a whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parallaxis.functions import geometry, scalar
from parallaxis.operators import capture, joins, runs, series, stats
from parallaxis.sources import compose, uploads, worklog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def events(spark: SparkSession, d: str) -> DataFrame:
    """event_id, us (microseconds), user_id, event_type, value."""
    return read(spark, d, "events").select("event_id", micros(F.col("ts")).alias("us"), "user_id", "event_type", "value")


@query("""
SELECT user_id, count(*) FILTER (WHERE event_type <> 'error') AS delivered, count(*) FILTER (WHERE event_type = 'error') AS dropped,
       CASE WHEN max(ts) > min(ts) THEN round((count(*) - 1) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 9) END AS frames_per_s,
       min(value) AS low, max(value) AS high
FROM events GROUP BY user_id""")
def drop_rate_report(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: frames delivered and dropped, rate, and range of each recording, in one aggregation."""
    e = events(spark, d)
    return e.groupBy("user_id").agg(
        F.count_if(F.col("event_type") != "error").alias("delivered"),
        F.count_if(F.col("event_type") == "error").alias("dropped"),
        F.round(stats.rate(F.col("us")) * 1e6, 9).alias("frames_per_s"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
    )


@query("""
SELECT user_id, us, value, click_id, click_value FROM (
  SELECT v.event_id, v.user_id, epoch_us(v.ts) AS us, v.value, c.event_id AS click_id, c.value AS click_value,
  FROM events v JOIN (
    SELECT *, row_number() OVER (PARTITION BY user_id, round_even(epoch_us(ts) / 6e8, 0) ORDER BY event_id DESC) AS n
    FROM events WHERE event_type = 'click'
  ) c ON c.n = 1 AND c.user_id = v.user_id AND round_even(epoch_us(c.ts) / 6e8, 0) = round_even(epoch_us(v.ts) / 6e8, 0)
  WHERE v.event_type = 'view')""")
def same_instant_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    views = e.where("event_type = 'view'").select("user_id", "us", "value")
    clicks = e.where("event_type = 'click'").select("user_id", F.col("us").alias("click_us"), F.col("event_id").alias("click_id"), F.col("value").alias("click_value"))
    return joins.same_instant(views, clicks, ["user_id"], "us", "click_us", "click_id", width=6e8).select("user_id", "us", "value", "click_id", "click_value")


@query("""
WITH v AS (SELECT * FROM events WHERE event_type = 'view'), p AS (SELECT * FROM events WHERE event_type = 'purchase'),
f AS (SELECT user_id, arg_min(value, ts) AS first_value FROM p GROUP BY user_id)
SELECT v.event_id, v.user_id, coalesce(p.value, f.first_value) AS purchase_value
FROM v ASOF LEFT JOIN p ON v.user_id = p.user_id AND v.ts >= p.ts LEFT JOIN f ON f.user_id = v.user_id""")
def asof_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    views = e.where("event_type = 'view'").select("event_id", "user_id", "us")
    purchases = e.where("event_type = 'purchase'").select("user_id", "us", F.col("value").alias("purchase_value"))
    return joins.latest_or_first(views, purchases, ["user_id"], "us", "us", "purchase_value").select("event_id", "user_id", "purchase_value")


POSITIONS = "SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events"
RUNS = f"""
SELECT user_id, event_type AS value, min(pos) AS first, max(pos) AS last FROM (
  SELECT *, pos - row_number() OVER (PARTITION BY user_id, event_type ORDER BY pos) AS island FROM ({POSITIONS}) WHERE event_type <> 'error'
) GROUP BY user_id, event_type, island"""


def _positions(spark: SparkSession, d: str) -> DataFrame:
    return series.numbered(events(spark, d), ["user_id"], ["us", "event_id"], "pos")


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.encode(_positions(spark, d), ["user_id"], "pos", F.when(F.col("event_type") != "error", F.col("event_type")))


@query(RUNS)
def run_length_encode(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d)


@query(f"SELECT user_id, pos, CASE WHEN event_type <> 'error' THEN event_type END AS value FROM ({POSITIONS})")
def run_expand(spark: SparkSession, d: str) -> DataFrame:
    frames = _positions(spark, d).select("user_id", "pos")
    return runs.per_frame(frames, _runs(spark, d), ["user_id"], "pos").select("user_id", "pos", "value")


@query(f"""
SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY min(first)) - 1 AS entry_no, count(*) AS n_runs, min(first) AS first_frame
FROM ({RUNS}) GROUP BY user_id, value""")
def run_entries(spark: SparkSession, d: str) -> DataFrame:
    e = runs.entries(_runs(spark, d), ["user_id"])
    return e.select("user_id", "value", F.col("entry_no").cast("long").alias("entry_no"), F.size("ranges").cast("long").alias("n_runs"), F.get(F.get("ranges", F.lit(0)), F.lit(0)).alias("first_frame"))


@query(f"""
SELECT user_id, bool_and(coalesce(first > reached, true)) AS is_disjoint
FROM (SELECT *, max(last) OVER (PARTITION BY user_id ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM ({RUNS})) GROUP BY user_id""")
def runs_disjoint(spark: SparkSession, d: str) -> DataFrame:
    return runs.disjoint(_runs(spark, d), ["user_id"])


@query("""
SELECT user_id, g AS group_no, any_value(event_type) AS event_type, count(*) AS n FROM (
  SELECT *, sum(CASE WHEN event_type = prev THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS g FROM (
    SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
) GROUP BY user_id, g""")
def adjacent_groups(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("group_no", runs.adjacent(["user_id"], ["us", "event_id"], "event_type"))
    return e.groupBy("user_id", "group_no").agg(F.first("event_type").alias("event_type"), F.count("*").alias("n"))


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
k AS (
  SELECT user_id, event_id, us, n, us AS kept, true AS emit FROM e WHERE n = 1
  UNION ALL
  SELECT e.user_id, e.event_id, e.us, e.n, CASE WHEN e.us - k.kept >= 21600000000 THEN e.us ELSE k.kept END, e.us - k.kept >= 21600000000
  FROM k JOIN e ON e.user_id = k.user_id AND e.n = k.n + 1
)
SELECT user_id, event_id, us FROM k WHERE emit""")
def thin_rate(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("user_id", "event_id", "us")
    return series.thinned(e, ["user_id"], "us", "event_id", 6 * 3600e6)


@query("""
WITH RECURSIVE x AS (SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents),
k AS (
  SELECT doc_id, lang, n_chars, n, n_chars AS held, 0::BIGINT AS segment FROM x WHERE n = 1
  UNION ALL
  SELECT x.doc_id, x.lang, x.n_chars, x.n, CASE WHEN k.held >= 50000 THEN x.n_chars ELSE k.held + x.n_chars END, CASE WHEN k.held >= 50000 THEN k.segment + 1 ELSE k.segment END
  FROM k JOIN x ON x.lang = k.lang AND x.n = k.n + 1
)
SELECT lang, doc_id, n_chars, segment FROM k""")
def pack_segments(spark: SparkSession, d: str) -> DataFrame:
    return series.packed(read(spark, d, "documents").select("lang", "doc_id", "n_chars"), ["lang"], ["doc_id"], "n_chars", 50_000)


@query("""
WITH RECURSIVE x AS (SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents),
k AS (
  SELECT doc_id, lang, n_chars, n, n_chars AS held, 0::BIGINT AS segment FROM x WHERE n = 1
  UNION ALL
  SELECT x.doc_id, x.lang, x.n_chars, x.n, CASE WHEN k.held >= 50000 THEN x.n_chars ELSE k.held + x.n_chars END, CASE WHEN k.held >= 50000 THEN k.segment + 1 ELSE k.segment END
  FROM k JOIN x ON x.lang = k.lang AND x.n = k.n + 1
)
SELECT lang, segment, count(*) AS frames, sum(n_chars)::BIGINT AS size FROM k GROUP BY lang, segment HAVING sum(n_chars) >= 50000 OR lang <> 'en'""")
def segments_handed_over(spark: SparkSession, d: str) -> DataFrame:
    """Languages are recordings; English is still being recorded, the others have ended."""
    docs = read(spark, d, "documents").select("lang", "doc_id", "n_chars")
    return series.handed_over(series.packed(docs, ["lang"], ["doc_id"], "n_chars", 50_000), ["lang"], "n_chars", 50_000, docs.where("lang <> 'en'").select("lang"))


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, 1 + event_id % 7 AS bytes, event_type = 'purchase' AS done, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
k AS (
  SELECT user_id, event_id, n, CASE WHEN done THEN []::BIGINT[] ELSE [bytes::BIGINT] END AS q, CASE WHEN NOT done THEN true END AS accepted FROM e WHERE n = 1
  UNION ALL
  SELECT e.user_id, e.event_id, e.n, CASE WHEN e.done THEN k.q[2:] WHEN coalesce(list_sum(k.q), 0) + e.bytes > 12 THEN k.q ELSE list_append(k.q, e.bytes::BIGINT) END,
         CASE WHEN NOT e.done THEN coalesce(list_sum(k.q), 0) + e.bytes <= 12 END
  FROM k JOIN e ON e.user_id = k.user_id AND e.n = k.n + 1
)
SELECT user_id, event_id, accepted FROM k""")
def queue_limit(spark: SparkSession, d: str) -> DataFrame:
    """Events are frames of 1 to 7 bytes for a queue of 12, which a purchase frees of its oldest one."""
    e = events(spark, d).select("user_id", "event_id", "us", (F.col("event_id") % 7 + 1).alias("bytes"), (F.col("event_type") == "purchase").alias("is_written"))
    return series.queued(e, ["user_id"], ["us", "event_id"], "bytes", "is_written", 12).select("user_id", "event_id", "accepted")


@query("SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text))::BIGINT AS size FROM documents")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", scalar.sha256(F.col("text")).alias("sha256"), F.octet_length("text").cast("long").alias("size"))


@query("""
WITH a AS (
  SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index, NULL AS reason, false AS is_dropped FROM events WHERE event_type <> 'error'
  UNION ALL SELECT user_id, event_id, ts, NULL, event_type, true FROM events WHERE event_type = 'error'
)
SELECT user_id, event_id, coalesce(frame_index, -1)::BIGINT AS frame_index, coalesce(reason, '') AS reason,
       row_number() OVER (PARTITION BY user_id ORDER BY ts, is_dropped, event_id) - 1 AS pos FROM a""")
def order_with_dropped(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    delivered = series.numbered(e.where("event_type <> 'error'"), ["user_id"], ["us", "event_id"]).select("user_id", "event_id", "us", "frame_index")
    dropped = e.where("event_type = 'error'").select("user_id", "event_id", "us", F.col("event_type").alias("reason"))
    rows = series.with_dropped(delivered, dropped, ["user_id"], "us", "event_id")
    return rows.select("user_id", "event_id", F.coalesce("frame_index", F.lit(-1)).alias("frame_index"), scalar.cell(F.col("reason")).alias("reason"), "pos")


@query("SELECT user_id, event_type AS reason, count(*) AS n FROM events GROUP BY ROLLUP (user_id, event_type) HAVING user_id IS NOT NULL")
def drop_counts(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumnRenamed("event_type", "reason")
    return stats.dropped_by_reason(e, ["user_id"], "reason")


@query("SELECT user_id, CASE WHEN max(ts) > min(ts) THEN round((count(*) - 1) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 9) END AS rate FROM events GROUP BY user_id")
def stream_rate(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("user_id").agg(F.round(stats.rate(F.col("us")) * 1e6, 9).alias("rate"))


@query("""
SELECT user_id, coalesce(bool_and(ts > prev), true) AS strictly_increasing
FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events) GROUP BY user_id""")
def strictly_increasing(spark: SparkSession, d: str) -> DataFrame:
    return series.increasing(events(spark, d), ["user_id"], "event_id", "us")


@query("SELECT l_orderkey, min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*) AS is_continuous FROM lineitem GROUP BY l_orderkey")
def index_continuity(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("i"))
    return series.continuous(lines, ["l_orderkey"], "i")


@query("""
SELECT event_type, round(q[1], 9) AS p05, round(q[2], 9) AS p25, round(q[3], 9) AS p50, round(q[4], 9) AS p75, round(q[5], 9) AS p95
FROM (SELECT event_type, quantile_cont(value, [0.05, 0.25, 0.5, 0.75, 0.95]) AS q FROM events GROUP BY event_type)""")
def coverage_quantiles(spark: SparkSession, d: str) -> DataFrame:
    shares = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    q = stats.exact_quantiles(events(spark, d), ["event_type"], "value", *shares.values())
    return q.select("event_type", *[F.round(F.get("q", F.lit(i)), 9).alias(n) for i, n in enumerate(shares)])


@query("""
SELECT l_returnflag, min(x) AS low, round(quantile_cont(x, 0.01), 6) AS p01, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.99), 6) AS p99, max(x) AS high, count(*) AS n
FROM (SELECT l_returnflag, l_extendedprice AS x FROM lineitem WHERE l_extendedprice > 0 AND isfinite(l_extendedprice)) GROUP BY l_returnflag""")
def depth_range(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("l_extendedprice")
    ok = read(spark, d, "lineitem").select("l_returnflag", "l_extendedprice").where(scalar.is_depth(x))
    q = stats.exact_quantiles(ok, ["l_returnflag"], "l_extendedprice", 0.01, 0.5, 0.99)
    ends = ok.groupBy("l_returnflag").agg(F.min(x).alias("low"), F.max(x).alias("high"), F.count("*").alias("n"))
    return joins.on_keys(ends, q, ["l_returnflag"]).select("l_returnflag", "low", *[F.round(F.get("q", F.lit(i)), 6).alias(n) for i, n in enumerate(("p01", "median", "p99"))], "high", "n")


@query("""
SELECT user_id, list_sort(list(value))[len(list(value)) // 2 + 1] AS upper_median FROM events GROUP BY user_id""")
def upper_median(spark: SparkSession, d: str) -> DataFrame:
    return stats.upper_medians(events(spark, d), ["user_id"], "value")


@query("""
SELECT count(*) FILTER (WHERE o_orderdate BETWEEN a AND b) AS inside, count(*) FILTER (WHERE NOT o_orderdate BETWEEN a AND b) AS outside
FROM orders, (SELECT min(l_shipdate) AS a, max(l_shipdate) AS b FROM lineitem)""")
def span_pairs(spark: SparkSession, d: str) -> DataFrame:
    bounds = read(spark, d, "lineitem").agg(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"))
    o = read(spark, d, "orders").select("o_orderdate").join(F.broadcast(bounds))  # one row
    inside = F.col("o_orderdate").between(F.col("a"), F.col("b"))
    return o.agg(F.count_if(inside).alias("inside"), F.count_if(~inside).alias("outside"))


@query("""
SELECT user_id, event_id, coalesce(last_value(p IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       first_value(p IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS carried
FROM (SELECT *, CASE WHEN event_type = 'purchase' THEN value END AS p FROM events)""")
def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("p", F.when(F.col("event_type") == "purchase", F.col("value")))
    return e.select("user_id", "event_id", series.carried(["user_id"], ["us", "event_id"], "p").alias("carried"))


@query("""
SELECT o_custkey, o_orderkey, c_name, row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(strftime(o_orderdate, '%Y-%m-%d'), '') DESC, o_orderkey DESC) AS place
FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def catalog_newest(spark: SparkSession, d: str) -> DataFrame:
    """A root's recordings newest first by the text of their start, those without one last; a customer is a root."""
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", F.coalesce(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("")).alias("start"))
    c = read(spark, d, "customer").select("c_custkey", "c_name")
    w = series.series(["o_custkey"], F.desc("start"), F.desc("o_orderkey"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_custkey", "o_orderkey", "c_name", F.row_number().over(w).cast("long").alias("place"))


@query("""
WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p, count(*) OVER (PARTITION BY user_id) AS c FROM events),
i AS (SELECT user_id, c, least(40, c) AS n, unnest(range(least(40, c))) AS i FROM (SELECT DISTINCT user_id, c FROM e))
SELECT e.user_id, e.event_id FROM e JOIN i ON i.user_id = e.user_id AND e.p = (i.i * (i.c - 1)) // greatest(i.n - 1, 1)""")
def even_subsample(spark: SparkSession, d: str) -> DataFrame:
    return series.subsample(events(spark, d), ["user_id"], ["us", "event_id"], 40).select("user_id", "event_id")


@query("""
WITH c AS (
  SELECT vec_id, s, CASE WHEN s IS NOT NULL THEN round(-abs(embedding[1]::DOUBLE * s - embedding[2]::DOUBLE), 9) END AS score
  FROM embeddings, (SELECT (unnest(range(41)) * 0.0025 + 0.95)::DOUBLE AS s)
), m AS (SELECT vec_id, max(score) AS best FROM c GROUP BY vec_id)
SELECT c.vec_id, round(max(s), 9) AS scale FROM c JOIN m ON m.vec_id = c.vec_id AND score = best GROUP BY c.vec_id""")
def grid_argmax(spark: SparkSession, d: str) -> DataFrame:
    """The best of 41 scales for each row; at ties the larger scale. The grid stays in the row, so nothing is shuffled."""
    e = read(spark, d, "embeddings").select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("a"), F.get("embedding", F.lit(1)).cast("double").alias("b"))
    grid = F.array(*[F.lit(i * 0.0025 + 0.95) for i in range(41)])
    best = stats.best_of(grid, lambda s: F.round(-F.abs(F.col("a") * s - F.col("b")), 9))
    return e.select("vec_id", F.round(best, 9).alias("scale")).where("scale IS NOT NULL")


@query("""
SELECT p_partkey, round((k * s)::FLOAT, 3) AS fx, round((c * s)::FLOAT, 3) AS cx, round(((c + 0.5::FLOAT)::FLOAT * s)::FLOAT - 0.5::FLOAT, 3) AS cy, round(c + ((1 - s)::FLOAT * 0.5::FLOAT)::FLOAT, 3) AS corner FROM (
  SELECT p_partkey, p_retailprice::FLOAT AS k, p_size::FLOAT AS c, (p_size::FLOAT / 64::FLOAT)::FLOAT AS s FROM part)""")
def intrinsics_carry(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select("p_partkey", F.col("p_retailprice").cast("float").alias("k"), F.col("p_size").cast("float").alias("c"), geometry.ratio(F.col("p_size"), F.lit(64)).alias("s"))
    k, c, s = F.col("k"), F.col("c"), F.col("s")
    fx, _, cx, cy = geometry.grid_carried([k, k, c, c], s, s)
    three = lambda x: F.round(x, 3)
    return p.select("p_partkey", three(fx).alias("fx"), three(cx).alias("cx"), three(cy).alias("cy"), three(geometry.about_corner(c, s)).alias("corner"))


@query("""
SELECT vec_id, abs(a*a+b*b+c*c-1) <= 0.9 AND abs(p*p+q*q+r*r-1) <= 0.9 AND abs(x*x+y*y+z*z-1) <= 0.9 AND abs(a*p+b*q+c*r) <= 0.9 AND abs(a*x+b*y+c*z) <= 0.9 AND abs(p*x+q*y+r*z) <= 0.9
       AND abs(a*(q*z-r*y) - b*(p*z-r*x) + c*(p*y-q*x) - 1) < 0.9 AS is_pose
FROM (SELECT vec_id, 5*embedding[1]::DOUBLE AS a, 5*embedding[2]::DOUBLE AS b, 5*embedding[3]::DOUBLE AS c, 5*embedding[4]::DOUBLE AS p, 5*embedding[5]::DOUBLE AS q, 5*embedding[6]::DOUBLE AS r, 5*embedding[7]::DOUBLE AS x, 5*embedding[8]::DOUBLE AS y, 5*embedding[9]::DOUBLE AS z FROM embeddings)""")
def pose_valid(spark: SparkSession, d: str) -> DataFrame:
    at = lambda i, j: F.get("embedding", F.lit(3 * i + j)).cast("double") * 5
    return read(spark, d, "embeddings").select("vec_id", geometry.is_rotation([[at(i, j) for j in range(3)] for i in range(3)], tolerance=0.9).alias("is_pose"))


@query("SELECT p_partkey, 'rgbd_rear_' || left(regexp_replace(trim(p_name), '[^A-Za-z0-9_-]', '_', 'g'), 40) AS scan_id FROM part")
def sanitize_id(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    return p.select("p_partkey", F.concat(F.lit("rgbd_rear_"), scalar.sanitized(scalar.entered(F.col("p_name")))).alias("scan_id"))


@query("""
SELECT l_orderkey, count(*) AS expected, count(o_orderkey) AS found, count(*) = count(o_orderkey) AS is_complete
FROM (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem) m
LEFT JOIN (SELECT DISTINCT l_orderkey AS o_orderkey, l_linenumber AS n, l_quantity AS q FROM lineitem WHERE l_linestatus = 'F') f ON l_orderkey = o_orderkey AND l_linenumber = n AND l_quantity = q
GROUP BY l_orderkey""")
def member_completeness(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem")
    on = ["l_linenumber", "l_quantity"]
    return joins.complete(lines.select("l_orderkey", *on), lines.where("l_linestatus = 'F'").select("l_orderkey", *on), ["l_orderkey"], on)


@query("SELECT lang, doc_id, (sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - n_chars)::BIGINT AS starts FROM documents")
def prefix_offsets(spark: SparkSession, d: str) -> DataFrame:
    """A language may hold a third of all rows, so its documents are summed in blocks of ids."""
    rows = read(spark, d, "documents").select("lang", "doc_id", "n_chars")
    return series.offsets_in_blocks(rows, "n_chars", ["lang"], ["doc_id"], F.floor(F.col("doc_id") / 65_536)).select("lang", "doc_id", "starts")


@query("""
SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')""")
def missing_members(spark: SparkSession, d: str) -> DataFrame:
    have = read(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.missing(read(spark, d, "customer").select("c_custkey"), have, ["c_custkey"])


@query("""
SELECT coalesce(a.k, b.k) AS o_custkey, a.n AS n, b.n AS r_n FROM
  (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) b ON a.k = b.k
WHERE a.n IS DISTINCT FROM b.n""")
def map_differences(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    side = lambda s: o.where(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.count("*").alias("n"))
    return joins.same_maps(side("O"), side("F"), ["o_custkey"], ["n"])


@query("SELECT user_id, avg(CASE WHEN event_type = 'view' THEN 1.0 ELSE 0 END)::DOUBLE AS view, avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0 END)::DOUBLE AS click, avg(CASE WHEN event_type = 'never' THEN 1.0 ELSE 0 END)::DOUBLE AS never FROM events GROUP BY user_id")
def level_shares(spark: SparkSession, d: str) -> DataFrame:
    is_ = lambda v: stats.share(F.col("event_type") == v).alias(v)
    return events(spark, d).groupBy("user_id").agg(is_("view"), is_("click"), is_("never"))


@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice) / sum(l_quantity), 6) AS ratio FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus) HAVING l_returnflag IS NOT NULL""")
def stored_ratios(spark: SparkSession, d: str) -> DataFrame:
    r = stats.ratios(read(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity", "l_linestatus")
    return r.select("l_returnflag", "l_linestatus", F.round("ratio", 6).alias("ratio"))


@query("SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS in_use FROM events GROUP BY user_id")
def values_in_use(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("user_id").agg(F.array_join(stats.in_use(F.col("event_type")), ",").alias("in_use"))


@query("SELECT label, round(avg(sqrt(embedding[1]::DOUBLE ** 2 + embedding[2]::DOUBLE ** 2 + embedding[3]::DOUBLE ** 2)), 9) AS gravity FROM embeddings GROUP BY label")
def mean_norm(spark: SparkSession, d: str) -> DataFrame:
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return read(spark, d, "embeddings").groupBy("label").agg(F.round(F.avg(stats.norm(at(0), at(1), at(2))), 9).alias("gravity"))


SCORES = """
WITH d AS (SELECT user_id, pos, lead(value) OVER w - lag(value) OVER w AS da FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
s AS (SELECT a.user_id, o.k AS "offset", avg(a.da * b.da) AS score FROM d a CROSS JOIN (SELECT unnest([-3, -2, -1, 0, 1, 2, 3]) AS k) o JOIN d b ON b.user_id = a.user_id AND b.pos = a.pos + o.k GROUP BY ALL)
"""


@query(f'{SCORES} SELECT user_id, "offset", round(score, 2) AS score FROM s')
def alignment_scores(spark: SparkSession, d: str) -> DataFrame:
    s = series.shifted_scores(_positions(spark, d), ["user_id"], "pos", "value", "value")
    return s.where("score IS NOT NULL").select("user_id", "offset", F.round("score", 2).alias("score"))


@query(f'''{SCORES}
SELECT e.user_id, b."offset" AS best_offset FROM (SELECT DISTINCT user_id FROM events) e
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, "offset") AS n FROM s) b ON b.user_id = e.user_id AND b.n = 1''')
def alignment_best(spark: SparkSession, d: str) -> DataFrame:
    """A series aligns best with itself at offset 0."""
    return series.best_offset(series.shifted_scores(_positions(spark, d), ["user_id"], "pos", "value", "value"), ["user_id"])


@query("""
SELECT user_id, sum(CASE WHEN event_type IN ('view', 'click') THEN value ELSE 0 END) > 0 AS started, round(sum(CASE WHEN event_type = 'view' THEN value WHEN event_type = 'click' THEN value / 2 ELSE 0 END) / sum(value), 6) AS progress FROM events GROUP BY user_id""")
def upload_progress(spark: SparkSession, d: str) -> DataFrame:
    """Whether anything is acknowledged or under way; acknowledged sizes and what of the others is under way, over all sizes."""
    e = events(spark, d)
    name = F.struct("event_type", "event_id").alias("name")
    parts = e.select("user_id", name, F.col("value").alias("size"), (F.col("event_type") == "view").alias("uploaded"))
    sent = e.where("event_type = 'click'").select("user_id", name, (F.col("value") / 2).alias("bytes"))
    return capture.progress(parts, sent, ["user_id"]).select("user_id", "started", F.round("progress", 6).alias("progress"))


@query("""
WITH f AS (SELECT p_brand, 4 * p_size AS width, 3 * p_size + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS height, p_partkey % 60 AS fps FROM part)
SELECT p_brand, width, height, fps FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY width * height DESC, fps DESC) AS n FROM f WHERE width * 3 = height * 4) WHERE n = 1""")
def best_format(spark: SparkSession, d: str) -> DataFrame:
    """Of the 4:3 formats of a brand the largest, then the fastest."""
    height = 3 * F.col("p_size") + F.when(F.col("p_partkey") % 3 == 0, 1).otherwise(0)
    return capture.best_video(read(spark, d, "part").select("p_brand", (4 * F.col("p_size")).alias("width"), height.alias("height"), (F.col("p_partkey") % 60).alias("fps")), ["p_brand"])


@query("SELECT page_id, url[1] = '/' AND NOT list_has_any(string_split(url, '/'), ['.', '..']) AS is_root, regexp_matches(url, '\\.[0-9]{6}$') AS is_segment FROM (SELECT page_id, regexp_replace(url, '^https?:/', '') AS url FROM pages)")
def path_rules(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "pages").select("page_id", F.regexp_replace("url", "^https?:/", "").alias("url"))
    return p.select("page_id", scalar.is_data_root(F.col("url")).alias("is_root"), scalar.is_segment(F.col("url")).alias("is_segment"))


@query(r"""
WITH p AS (SELECT o_orderkey, '/upload/' || CASE WHEN o_orderkey % 7 = 0 THEN '.' ELSE 'k-' END || o_orderkey || '/' || ['manifest.json', 'color_frames.bin.000012', 'color_frames.bin', 'extrinsics.json', 'depth_frames_confidence.bin.12'][1 + o_orderkey % 5] AS path FROM orders),
r AS (SELECT *, '^/upload/([A-Za-z0-9_][A-Za-z0-9_.-]*)/((?:scan_metadata|(?:color|depth)_frames_metadata|(?:color|depth)_intrinsics|extrinsics|manifest)\.json|(?:color_frames|depth_frames|depth_frames_confidence)\.bin\.[0-9]{6})$' AS pattern FROM p)
SELECT o_orderkey, nullif(regexp_extract(path, pattern, 1), '') AS key, nullif(regexp_extract(path, pattern, 2), '') AS file FROM r""")
def upload_routes(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select("o_orderkey")
    files = F.array(*map(F.lit, ("manifest.json", "color_frames.bin.000012", "color_frames.bin", "extrinsics.json", "depth_frames_confidence.bin.12")))
    path = F.concat(F.lit("/upload/"), F.when(F.col("o_orderkey") % 7 == 0, ".").otherwise("k-"), F.col("o_orderkey"), F.lit("/"), F.get(files, (F.col("o_orderkey") % 5).cast("int")))
    return o.withColumn("r", uploads.upload_route(path)).select("o_orderkey", "r.key", "r.file")


@query("SELECT o_orderkey, 'color_frames.bin.' || lpad((o_orderkey % 1000000)::VARCHAR, 6, '0') AS segment, chr(48 + (o_orderkey % 10)::INT) || 'fde' AS four_cc, round(sign(x) * floor(abs(x * 1e5) + 0.5) / 1e5, 9) AS rounded FROM (SELECT o_orderkey, o_totalprice / 7 AS x FROM orders)")
def scalar_rules(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    code = F.shiftleft(F.lit(48) + F.col("o_orderkey") % 10, 24) + F.lit(0x666465)
    return o.select("o_orderkey", scalar.segment_name(F.lit("color_frames.bin"), F.col("o_orderkey") % 1_000_000).alias("segment"), scalar.four_cc(code.cast("long")).alias("four_cc"), F.round(scalar.rounded_away(F.col("o_totalprice") / 7), 9).alias("rounded"))


@query("""
SELECT user_id, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS duration FROM events GROUP BY user_id""")
def union_duration(spark: SparkSession, d: str) -> DataFrame:
    """Delivered frames and dropped ones are two streams of a recording."""
    e = events(spark, d).withColumn("ts", F.col("us") / 1e6)
    parts = [e.where("event_type <> 'error'"), e.where("event_type IS NULL OR event_type = 'error'")]
    return stats.duration(*parts, keys=["user_id"]).select("user_id", F.round("duration", 6).alias("duration"))


@query("""
SELECT v.event_id, abs(epoch_us(v.ts) - epoch_us(c.ts)) < 3600000000 AS is_close
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'view') v
JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'click') c ON c.user_id = v.user_id AND c.n = v.n""")
def tolerance_match(spark: SparkSession, d: str) -> DataFrame:
    """Rows of two series with the same index, and whether their times agree within a tolerance."""
    e = events(spark, d)
    side = lambda k: series.numbered(e.where(F.col("event_type") == k), ["user_id"], ["us", "event_id"], "n")
    c = side("click").select("user_id", "n", F.col("us").alias("other"))
    return side("view").join(c, ["user_id", "n"]).select("event_id", (F.abs(F.col("us") - F.col("other")) < 3_600_000_000).alias("is_close"))


@query("SELECT doc_id, pos, word, len(word)::INT AS chars FROM (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS word FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents))")
def positional_join(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents").select("doc_id", F.split("text", " ").alias("word"))
    t = t.withColumn("chars", F.transform("word", F.char_length))
    return joins.zipped(t, ["word", "chars"]).select("doc_id", F.col("pos").cast("long").alias("pos"), "word", "chars")


@query("""
SELECT event_id, coalesce(nullif(regexp_replace(n, '^[\\s]+|[\\s]+$', '', 'g'), ''), strftime(ts, '%Y-%m-%d %H:%M:%S') || CASE WHEN user_id % 2 = 0 THEN ' Front' ELSE ' Rear' END) AS name
FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN chr(9) || ' ' || chr(10) ELSE chr(9) || event_type || ' x' || chr(10) END AS n FROM events)""")
def display_names(spark: SparkSession, d: str) -> DataFrame:
    """Names as they are shown, of rows with white space around a name or nothing else."""
    e = read(spark, d, "events")
    given = F.when(F.col("event_id") % 3 == 0, F.lit("\t \n")).otherwise(F.concat(F.lit("\t"), "event_type", F.lit(" x\n")))
    camera = F.when(F.col("user_id") % 2 == 0, "front").otherwise("rear")
    return e.select("event_id", scalar.display_name(given, F.col("ts"), camera).alias("name"))


@query("""
SELECT event_id, CASE WHEN q % 90 <> 0 THEN NULL WHEN user_id % 2 = 0 THEN (['up', 'right', 'down', 'left'])[1 + ((q % 360 + 360) % 360) // 90]
  ELSE (['up_mirrored', 'left_mirrored', 'down_mirrored', 'right_mirrored'])[1 + ((q % 360 + 360) % 360) // 90] END AS orientation
FROM (SELECT *, ((event_id % 17) * 45 - 360)::INT AS q FROM events)""")
def orientations(spark: SparkSession, d: str) -> DataFrame:
    """How pictures turned by multiples of 45 degrees are shown, mirrored or not."""
    e = read(spark, d, "events").select("event_id", "user_id", ((F.col("event_id") % 17) * 45 - 360).cast("int").alias("q"))
    return e.select("event_id", scalar.orientation(F.col("q"), F.col("user_id") % 2 != 0).alias("orientation"))


@query()
def median_intervals(spark: SparkSession, d: str) -> DataFrame:
    return stats.median_interval(events(spark, d), ["user_id"], "value")


@query("""
WITH t AS (SELECT doc_id, text, regexp_extract_all(hex(encode(text)), '..') AS x, octet_length(encode(text)) AS n FROM documents), f AS (SELECT *, 2 * greatest(1, (n + 95) // 96) AS h FROM t),
b AS (SELECT doc_id, h, i, ('0x' || v)::BIGINT AS v FROM (SELECT doc_id, h, unnest(range(h * 48)) AS i, unnest(list_concat(x, list_transform(range(h * 48 - n), lambda j: '00'))) AS v FROM f)),
c AS (SELECT doc_id, i, CASE WHEN i < 32 OR i // 32 = h THEN v ELSE (v - lag(v, 32) OVER (PARTITION BY doc_id ORDER BY i) + 256) % 256 END AS delta FROM b),
s AS (SELECT doc_id, sum(delta * (1 + i % 97))::BIGINT AS deltas FROM c GROUP BY doc_id)
SELECT t.doc_id, sha256(text) AS sha256, n::BIGINT AS size, deltas FROM t JOIN s ON s.doc_id = t.doc_id""")
def frame_codec(spark: SparkSession, d: str) -> DataFrame:
    """Every text as the rows of a frame, encoded and decoded again: a sum over the differences of rows that the stream holds, and the digest
    of what came back."""
    import hashlib

    import numpy as np
    import pandas as pd

    from parallaxis.kernels import codec

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                raw = r.text.encode()
                h = 2 * max(1, -(-len(raw) // 96))  # of 32 bytes; with half as many chroma rows
                frame = np.zeros((h * 3 // 2, 32), dtype=np.uint8)
                frame.ravel()[: len(raw)] = np.frombuffer(raw, dtype=np.uint8)
                stream = codec.encode_color(frame, h)
                stored = np.frombuffer(codec.inflate(stream), dtype=np.uint8).astype(np.int64)
                back = codec.decode_color(stream, 32, h).tobytes()[: len(raw)]
                out.append((r.doc_id, hashlib.sha256(back).hexdigest(), len(back), int(stored @ (1 + np.arange(len(stored)) % 97))))
            yield pd.DataFrame(out, columns=["doc_id", "sha256", "size", "deltas"])

    return read(spark, d, "documents").select("doc_id", "text").mapInPandas(run, "doc_id long, sha256 string, size long, deltas long")


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, (l_partkey % 256)::DOUBLE AS y, (l_suppkey * 7 % 256)::DOUBLE - 128 AS cb, (l_orderkey % 256)::DOUBLE - 128 AS cr FROM lineitem),
k AS (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN 0.2126 ELSE 0.299 END::DOUBLE AS kr, CASE WHEN l_linenumber % 2 = 0 THEN 0.0722 ELSE 0.114 END::DOUBLE AS kb FROM p),
q AS (SELECT *, y + 2 * (1 - kr) * cr AS red, y + 2 * (1 - kb) * cb AS blue FROM k)
SELECT l_orderkey, l_linenumber, greatest(0, least(255, round_even(red, 0)))::INT AS r, greatest(0, least(255, round_even((y - kr * red - kb * blue) / (1 - kr - kb), 0)))::INT AS g, greatest(0, least(255, round_even(blue, 0)))::INT AS b FROM q""")
def colour_conversion(spark: SparkSession, d: str) -> DataFrame:
    """A 2 x 2 frame of one colour for each row, through the colour kernel, by the matrix that is its."""
    import numpy as np
    import pandas as pd

    from parallaxis.kernels import image

    def run(batches):
        for pdf in batches:
            # one wide frame for a batch: two luma rows and one chroma row, two columns a colour
            n = len(pdf)
            frame = np.zeros((3, 2 * n), dtype=np.uint8)
            frame[:2] = np.repeat(pdf.y.to_numpy(), 2)
            frame[2, 0::2], frame[2, 1::2] = pdf.cb.to_numpy(), pdf.cr.to_numpy()
            both = [image.to_bgr(frame, m)[0, ::2].astype(np.int32) for m in ("ITU_R_709_2", "ITU_R_601_4")]
            bgr = np.where(pdf.l_linenumber.to_numpy()[:, None] % 2 == 0, *both)
            yield pd.DataFrame({"l_orderkey": pdf.l_orderkey, "l_linenumber": pdf.l_linenumber, "r": bgr[:, 2], "g": bgr[:, 1], "b": bgr[:, 0]})

    p = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 256).alias("y"), (F.col("l_suppkey") * 7 % 256).alias("cb"), (F.col("l_orderkey") % 256).alias("cr"))
    return p.mapInPandas(run, "l_orderkey long, l_linenumber int, r int, g int, b int")


#: Events as a work log: users are recordings, even ids colour lines and odd ones depth lines, errors are dropped; one segment holds a file.
LOG = """
WITH l AS (
  SELECT user_id, event_id, epoch_us(ts) AS us, event_id % 2 = 0 AS is_color, event_type = 'error' AS dropped, user_id % 2 = 0 AS rear, 1 + event_id % 7 AS size, event_id % 97 <> 0 AS hashed, event_id % 31 <> 0 AS marked
  FROM events
), d AS (SELECT *, lag(us) OVER (PARTITION BY user_id, is_color ORDER BY event_id) AS before, row_number() OVER (PARTITION BY user_id, is_color ORDER BY event_id) - 1 AS i FROM l WHERE NOT dropped)
"""


def _log(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """starts, color, depth and segments of the work logs that LOG describes."""
    e, i = events(spark, d), F.col("event_id")
    color = i % 2 == 0
    common = [F.col("user_id").cast("string").alias("scan_id"), i.alias("line_no"), (F.col("us") / 1e6).alias("timestamp"), F.when(F.col("event_type") == "error", "late").alias("reason"), (1 + i % 7).alias("compressed_size"), F.when(i % 97 != 0, F.repeat(F.lit("a"), F.lit(64))).alias("raw_sha256")]
    rear, marked = F.col("user_id") % 2 == 0, i % 31 != 0
    pose = F.when(marked & rear, F.lit("normal")).alias("pose")
    transform = F.when(marked, F.array(F.array((i % 3).cast("float")))).alias("depth_to_color")
    c = e.where(color).select(*common, pose)
    z = e.where(~color).select(*common, transform, F.when(marked & rear, F.lit(2).cast("long")).alias("confidence_compressed_size"))
    starts = e.select(F.col("user_id").cast("string").alias("scan_id"), F.when(rear, "rear").otherwise("front").alias("camera")).distinct()
    user = F.col("scan_id").cast("long")
    segments = compose.logged_bytes(c, z).select("scan_id", "file", F.when(user % 5 == 0, 1).otherwise(0).alias("seg_index"), (F.col("bytes") + F.when(user % 3 == 0, 1).otherwise(0)).alias("size"))
    return starts, c, z, segments


@query(f"""
{LOG}, f AS (
  SELECT DISTINCT user_id, 'not_in_time_order' AS fault, is_color, false AS conf FROM d WHERE us <= before
  UNION ALL SELECT DISTINCT user_id, 'no_encoding', is_color, false FROM d WHERE NOT hashed
  UNION ALL SELECT user_id, 'pose_count', true, false FROM d WHERE is_color GROUP BY user_id HAVING count(*) FILTER (WHERE rear AND marked) <> count(*) FILTER (WHERE rear)
  UNION ALL SELECT DISTINCT user_id, 'no_confidence_size', false, false FROM d WHERE NOT is_color AND rear AND NOT marked
  UNION ALL SELECT DISTINCT user_id, 'segment_order', is_color, conf FROM d CROSS JOIN (VALUES (false), (true)) t(conf) WHERE user_id % 5 = 0 AND (NOT conf OR NOT is_color AND rear AND marked)
  UNION ALL SELECT DISTINCT user_id, 'segment_size', is_color, conf FROM d CROSS JOIN (VALUES (false), (true)) t(conf) WHERE user_id % 3 = 0 AND (NOT conf OR NOT is_color AND rear AND marked)
)
SELECT user_id, fault, CASE WHEN is_color THEN 'color_frames.bin' WHEN conf THEN 'depth_frames_confidence.bin' ELSE 'depth_frames.bin' END AS file FROM f""")
def writer_checks(spark: SparkSession, d: str) -> DataFrame:
    """What keeps work logs from being recordings."""
    return compose.faults(*_log(spark, d)).select(F.col("scan_id").cast("long").alias("user_id"), "fault", "file")


@query(f"""
{LOG}, z AS (
  SELECT user_id, i, CASE WHEN rear THEN 0 WHEN marked THEN 1 + event_id % 3 END AS m FROM d WHERE NOT is_color
), g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, m ORDER BY i) AS island FROM z WHERE m IS NOT NULL),
r AS (SELECT user_id, m, min(i) AS first, max(i) AS last FROM g GROUP BY user_id, m, island),
n AS (SELECT user_id, m, dense_rank() OVER (PARTITION BY user_id ORDER BY low) - 1 AS entry_no FROM (SELECT user_id, m, min(first) AS low FROM r GROUP BY user_id, m))
SELECT r.user_id, n.entry_no::INT AS entry_no, r.m = 0 AS is_identity, r.first, r.last FROM r JOIN n ON n.user_id = r.user_id AND n.m = r.m""")
def rear_identity_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of the transforms between the streams; those of a rear camera are one identity."""
    starts, _, depth, _ = _log(spark, d)
    rows = compose.identity_runs(starts, depth).select("scan_id", F.posexplode("entries").alias("entry_no", "e")).select("scan_id", "entry_no", (F.size("e.value") == 3).alias("is_identity"), F.explode("e.ranges").alias("r"))
    return rows.select(F.col("scan_id").cast("long").alias("user_id"), "entry_no", "is_identity", F.get("r", F.lit(0)).cast("long").alias("first"), F.get("r", F.lit(1)).cast("long").alias("last"))


@query("""
WITH s AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, 10 + o_orderkey % 50 AS size FROM orders),
b AS (SELECT *, sum(size) OVER (PARTITION BY o_custkey ORDER BY i) - size AS before, sum(size) OVER (PARTITION BY o_custkey) * (o_custkey % 10) // 10 AS logged FROM s)
SELECT o_custkey, i AS seg_index, least(size, logged - before)::BIGINT AS keep FROM b WHERE logged > before""")
def recovered_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """What is kept of the segments of recordings that were cut off: as much as their logs account for."""
    s = series.numbered(read(spark, d, "orders").select(F.col("o_custkey").alias("scan_id"), F.lit("f").alias("file"), "o_orderkey", (10 + F.col("o_orderkey") % 50).alias("size")), ["scan_id"], ["o_orderkey"], "seg_index")
    logged = s.groupBy("scan_id", "file").agg(F.expr("sum(size) * (scan_id % 10) div 10").alias("bytes"))
    return worklog.recovered_segments(s, logged).select(F.col("scan_id").alias("o_custkey"), "seg_index", F.col("keep").cast("long").alias("keep"))


@query("""
SELECT e.user_id, e.event_id, (SELECT max(s.event_id)::VARCHAR FROM events s WHERE s.user_id = e.user_id AND s.event_type = 'purchase' AND s.ts = (
  SELECT max(t.ts) FROM events t WHERE t.user_id = e.user_id AND t.event_type = 'purchase' AND t.ts <= e.ts)) AS sample
FROM events e WHERE e.event_type <> 'purchase'""")
def latest_samples(spark: SparkSession, d: str) -> DataFrame:
    """Each frame with the newest sample up to its time; null before the first."""
    e = events(spark, d)
    samples = e.where("event_type = 'purchase'").groupBy("user_id", F.col("us").alias("sample_us")).agg(F.max("event_id").cast("string").alias("sample"))
    return capture.with_latest(e.where("event_type <> 'purchase'").select("user_id", "event_id", "us"), samples, ["user_id"], "us", "sample_us", "sample").select("user_id", "event_id", "sample")
