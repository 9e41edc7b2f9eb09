"""Landing uploaded files, and turning uploads that are whole into archives; as a batch job, or for each batch of a stream.

A request's body is a column (data) or a spooled file (body). It is copied and hashed in pieces under a name of the attempt's own; if it has the
length and the hash that were announced, its hash is put beside it (<file>.sha256) and it gets its name, by renames, so a file that
has a name is whole, and sending it again changes nothing. Whatever else happens has a status and a reason. Files lie in
<root>/.staging/<key>/ until their upload's manifest and all that it lists are there; then an archive is written, if there is none, and the
folder goes. An archive that is there already stays, and so does the folder then.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from . import archive_writer, recording_tar, sinks, uploads

CHUNK = 8 << 20
STAGING = ".staging"
_SEGMENT = re.compile(r"\.[0-9]{6}")


def _take_in(system, final: str, source, length: int, sha256: str | None) -> str | None:
    """Stores `length` bytes of a source; why it didn't, or None."""
    attempt = f"{final}.{uuid.uuid4().hex[:12]}{archive_writer.PARTIAL}"
    digest, left = hashlib.sha256(), length
    with system.open_output_stream(attempt) as out:
        while left and (piece := source.read(min(left, CHUNK))):
            digest.update(piece)
            out.write(piece)
            left -= len(piece)
    if left or digest.hexdigest() != sha256:
        system.delete_file(attempt)
        return "bytes missing" if left else "sha256 mismatch"
    beside = f"{attempt}.sha256"
    with system.open_output_stream(beside) as out:
        out.write(sha256.encode())
    system.move(beside, f"{final}.sha256")
    system.move(attempt, final)
    return None


def land(requests: DataFrame, token: str, roots: DataFrame) -> DataFrame:
    """requests: path, token, data_root, content_length, sha256, and data or body (the path of a spooled file). Stores what may be stored; returns
    the requests without their bodies, with key, file, status, reason. The result must be computed once: computing it stores."""
    heads = uploads.put_heads(requests, token, roots)
    rest = [c for c in requests.columns if c not in ("data", "body")]
    out = heads.select(*rest, "key", "file", "status", "reason")

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            status, reason = list(pdf["status"]), list(pdf["reason"])
            for i, r in enumerate(pdf.to_dict("records")):
                if r["status"] != 200:
                    continue
                system, root = recording_tar.open_fs(r["data_root"])
                folder = f"{root}/{STAGING}/{r['key']}"
                system.create_dir(folder, recursive=True)
                if isinstance(r.get("body"), str):
                    bodies, at = recording_tar.open_fs(r["body"])
                    source = bodies.open_input_stream(at)
                else:
                    source = io.BytesIO(r.get("data") or b"")
                with source:
                    why = _take_in(system, f"{folder}/{r['file']}", source, int(r["content_length"]), r["sha256"])
                if why is not None:
                    status[i], reason[i] = 400, why
            yield pdf[[*rest, "key", "file"]].assign(status=status, reason=reason)

    return heads.mapInPandas(store, out.schema)


def _members(manifest: dict) -> Iterator[tuple[int, str, str, int, str]]:
    """(position, member, name, size, sha256) of a manifest's files: a text is itself, a file with frames its segments in order."""
    rows = []
    for m in manifest["members"]:
        framed = m["name"] in uploads.FRAME_FILES
        for f in m["segments"] if framed else [m]:
            own = f["name"].startswith(m["name"]) and _SEGMENT.fullmatch(f["name"][len(m["name"]) :]) if framed else m["name"] in uploads.JSON_FILES
            if not own:
                raise ValueError(f"a manifest lists {f['name']} for {m['name']}")
            rows.append((m["name"], f["name"], int(f["size"]), f["sha256"]))
    yield from ((i, *r) for i, r in enumerate(rows))


def staged(spark: SparkSession, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files: root, upload_key, name, size, sha256, path; manifests: root, upload_key, scan_id, position, member, name, size, sha256) of the uploads
    that are staged. Each root is listed by a task; manifests that can't be read, or list what no recording has, are left out."""
    files = "root string, upload_key string, name string, size long, sha256 string, path string"
    listed = "root string, upload_key string, scan_id string, position int, member string, name string, size long, sha256 string"

    def listing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for root in pdf["root"]:
                system, at = recording_tar.open_fs(root)
                found = system.get_file_info(fs.FileSelector(f"{at}/{STAGING}", recursive=True, allow_not_found=True))
                hashes = {f.path.removesuffix(".sha256") for f in found if f.path.endswith(".sha256")}
                rows = []
                for f in found:
                    if f.type == fs.FileType.File and f.path in hashes and not f.path.endswith(".sha256"):
                        with system.open_input_stream(f"{f.path}.sha256") as h:
                            rows.append((root, f.path.split("/")[-2], f.base_name, f.size, h.read().decode(), f.path))
                yield pd.DataFrame(rows, columns=["root", "upload_key", "name", "size", "sha256", "path"])

    def reading(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                system, at = recording_tar.open_fs(r.path)
                try:
                    with system.open_input_stream(at) as f:
                        manifest = json.loads(f.read())
                    scan_id = manifest["scan_id"]
                    if re.fullmatch(uploads.KEY, scan_id):
                        rows += [(r.root, r.upload_key, scan_id, *m) for m in list(_members(manifest))]
                except (ValueError, KeyError, TypeError, AttributeError):
                    continue
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in listed.split(", ")])

    found = roots.select("root").distinct().repartition("root").mapInPandas(listing, files)
    return found, found.where(F.col("name") == uploads.MANIFEST).mapInPandas(reading, listed)


def store(spark: SparkSession, roots: DataFrame) -> list[tuple[str, str, str]]:
    """Writes an archive for each staged upload that is whole; the (root, upload_key, scan_id) of those that have one now and had none before."""
    files, manifests = staged(spark, roots)
    where = roots.select("root").distinct()

    def known(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            there = [system.get_file_info(f"{at}/{s}.tar").type != fs.FileType.NotFound for (system, at), s in zip(map(recording_tar.open_fs, pdf["root"]), pdf["scan_id"], strict=True)]
            yield pdf[there]

    scans = manifests.join(where, "root", "left_semi").select("root", "scan_id").distinct()
    stored = scans.mapInPandas(known, scans.schema)
    keyed = F.concat_ws("\n", "root", "upload_key").alias("upload_key")  # a key is one of its root
    parts = sinks.ready(manifests.withColumn("upload_key", keyed), files.withColumn("upload_key", keyed).drop("root"), stored)
    # two uploads of one recording: the first by its key
    first = parts.groupBy("root", "scan_id").agg(F.min("upload_key").alias("upload_key"))
    parts = parts.join(first, ["root", "scan_id", "upload_key"], "left_semi")
    done = [(r.root, r.upload_key.split("\n")[1], r.scan_id) for r in parts.select("root", "upload_key", "scan_id").distinct().collect()]  # a row for each new archive
    if done:
        archive_writer.write_archives(parts.select("root", "scan_id", "position", "member", "size", "path", "sha256"))
        for root, key, _ in done:
            system, at = recording_tar.open_fs(root)
            system.delete_dir(f"{at}/{STAGING}/{key}")
    return done


def receive(stream: DataFrame, token: str, roots: DataFrame, answers: str, checkpoint: str) -> StreamingQuery:
    """A query that lands each batch of requests and then stores what is whole. The answers of a batch are the Parquet files of
    <answers>/batch=<n>; a batch that is repeated lands the same files under the same names and writes the same answers again."""

    def batch(rows: DataFrame, n: int) -> None:
        spark = rows.sparkSession
        land(rows, token, roots).write.mode("overwrite").parquet(f"{answers}/batch={n}")
        touched = spark.read.parquet(f"{answers}/batch={n}").where("status = 200").select(F.col("data_root").alias("root")).distinct()
        store(spark, touched)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
