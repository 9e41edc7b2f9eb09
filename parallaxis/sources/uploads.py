"""What a receiver of recordings answers, as a function of a table of requests: a status and a reason for each.

Transport is not here; a log of requests, or a stream of them, is judged by the same rules. The first rule that a request
breaks gives its status. Null columns count as missing headers; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallaxis.functions import scalar

#: What a key looks like, and which files an upload may have. Frame files come in segments with six digits.
KEY = "[A-Za-z0-9_][A-Za-z0-9_.-]*"
JSON_FILES = ("scan_metadata.json", "color_frames_metadata.json", "depth_frames_metadata.json", "color_intrinsics.json", "depth_intrinsics.json", "extrinsics.json")
FRAME_FILES = ("color_frames.bin", "depth_frames.bin", "depth_frames_confidence.bin")
MANIFEST = "manifest.json"


def _either(*names: str) -> str:
    return "|".join(n.replace(".", "\\.") for n in names)


_UPLOAD = f"^/upload/({KEY})/({_either(MANIFEST, *JSON_FILES)}|(?:{_either(*FRAME_FILES)})\\.[0-9]{{6}})\\z"
_STORED = f"^/stored/({KEY})\\z"


def upload_route(path: Column) -> Column:
    """(key, file) of a path that a file may be put to; null for any other."""
    part = lambda i: F.regexp_extract(path, _UPLOAD, i)
    return F.when(path.rlike(_UPLOAD), F.struct(part(1).alias("key"), part(2).alias("file")))


def stored_route(path: Column) -> Column:
    """The recording that a path asks about; null for any other path."""
    return F.when(path.rlike(_STORED), F.regexp_extract(path, _STORED, 1))


def _rules(*rules: tuple[Column, int, str]) -> Column:
    """The first rule that holds, as (status, reason); 200 and no reason if none does."""
    out = F.struct(F.lit(200).alias("status"), F.lit(None).cast("string").alias("reason"))
    for broken, status, reason in reversed(rules):
        out = F.when(F.coalesce(broken, F.lit(True)), F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))).otherwise(out)
    return out


def _with_root(requests: DataFrame, roots: DataFrame) -> DataFrame:
    """Adds root_there: whether the data root that is asked for is a directory that exists. roots: root."""
    there = roots.select(F.col("root").alias("root_")).distinct().withColumn("root_there", F.lit(True))
    return requests.join(there, scalar.is_data_root(F.col("data_root")) & (F.col("data_root") == F.col("root_")), "left").drop("root_").withColumn("root_there", F.col("root_there").isNotNull())


def _head_rules(token: str) -> list[tuple[Column, int, str]]:
    return [(F.col("content_length") < 0, 411, "length required"), (F.col("route_").isNull(), 404, "bad path"), (F.col("token") != token, 403, "bad token"), (~F.col("root_there"), 400, "bad data root")]


def _put(requests: DataFrame, roots: DataFrame, rules: Column) -> DataFrame:
    rows = _with_root(requests, roots).withColumn("route_", upload_route(F.col("path")))
    return rows.withColumn("answer_", rules).select(*requests.columns, "route_.key", "route_.file", "answer_.status", "answer_.reason")


def put_heads(requests: DataFrame, token: str, roots: DataFrame) -> DataFrame:
    """put_answers() as far as they are known before the body is read."""
    return _put(requests, roots, _rules(*_head_rules(token)))


def put_answers(requests: DataFrame, token: str, roots: DataFrame) -> DataFrame:
    """Adds key, file, status and reason to requests to store a file.

    requests: path, token, data_root, content_length, data (the body, as far as it came), sha256. Of a longer body only the first
    content_length bytes count."""
    body = F.substring(F.coalesce("data", F.lit(b"")), F.lit(1), F.col("content_length").cast("int"))
    return _put(requests, roots, _rules(*_head_rules(token), (F.octet_length(body) < F.col("content_length"), 400, "bytes missing"), (F.sha2(body, 256) != F.col("sha256"), 400, "sha256 mismatch")))


def get_answers(requests: DataFrame, token: str, roots: DataFrame, archives: DataFrame) -> DataFrame:
    """Adds status, reason and stored (whether the recording that is asked about has its archive; null for other questions).

    requests: path, token, data_root; archives: root, scan_id."""
    scan = stored_route(F.col("path"))
    rows = _with_root(requests, roots).withColumn("scan_", scan)
    have = archives.select(F.col("root").alias("in_"), F.col("scan_id").alias("had_")).distinct()
    rows = rows.join(have, (F.col("data_root") == F.col("in_")) & (F.col("scan_") == F.col("had_")), "left")
    ping = F.coalesce(F.col("path") == "/ping", F.lit(False))
    known = ping | (F.col("path") == "/recordings") | F.col("scan_").isNotNull()
    rules = _rules((~known, 404, "not found"), (~ping & F.coalesce(F.col("token") != token, F.lit(True)), 403, "bad token"), (~ping & ~F.col("root_there"), 400, "bad data root"))
    stored = F.when((F.col("answer_.status") == 200) & F.col("scan_").isNotNull(), F.col("had_").isNotNull())
    return rows.withColumn("answer_", rules).select(*requests.columns, "answer_.status", "answer_.reason", stored.alias("stored"))
