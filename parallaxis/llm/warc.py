"""WARC archives: writing, the normaliser of monolithic gzip, and reading by sidecar index.

An archive that was compressed as one gzip stream can't be entered in the middle. The normaliser inflates
such a file once, from front to back with one record in memory, writes each record again as a gzip member
of its own, and writes a sidecar index beside it with the offset and length of every member. Readers then seek.

Files go to the shared folder through pyarrow's file systems (local, HDFS, S3, ...), under names
no other attempt of a task uses; only what a finished attempt returned is read, so lost executors and
repeated tasks do no harm. Archives are rolled at ROLL_BYTES.

Of records with equal payloads, that with the largest page_id is the response and the others are revisits
of it; rows that tie on payload and page_id are all written as responses; a null page_id is smaller than any other.
Null html is an empty payload. Null urls are left out of the record. An empty table writes nothing and gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, pick, text_batches, written

ROLL_BYTES = 256 << 20
#: Read at once; deflate can make at most about 1,000 times as much of it.
CHUNK = 1 << 16
DATE = "2000-01-01T00:00:00Z"
_GZIP = 31


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    def bytes(self) -> bytes:
        head = "".join(f"{k}: {v}\r\n" for k, v in {**self.headers, "Content-Length": str(len(self.block))}.items())
        return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + self.block + b"\r\n\r\n"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def one_line(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in value or "\n" in value else value


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def read_id(value: str) -> int | None:
    digits = value.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> Record:
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": DATE,
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": "sha1:" + digest32(payload),
        "X-Payload-Length": str(len(payload)),
    }
    if url is not None:
        headers["WARC-Target-URI"] = one_line(url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if revisit:
        headers |= {"WARC-Refers-To": record_id(refers_to), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
        return Record(headers, http)
    return Record(headers, http + payload)


class Parser:
    """Records out of inflated bytes that come in pieces; holds one record and one piece at most."""

    def __init__(self) -> None:
        self.held, self.need = bytearray(), 0

    def feed(self, piece: bytes) -> Iterator[Record]:
        self.held += piece
        at = 0
        while len(self.held) - at >= max(self.need, 1):
            end = self.held.find(b"\r\n\r\n", at)
            if end < 0:
                break
            lines = self.held[at:end].decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"no WARC record here: {lines[0][:40]!r}")
            headers = dict(x.split(": ", 1) for x in lines[1:])
            size = int(headers.pop("Content-Length"))
            stop = end + 4 + size
            if len(self.held) < stop + 4:
                self.need = stop + 4 - at
                break
            if self.held[stop : stop + 4] != b"\r\n\r\n":
                raise ValueError("a record does not end where its length says")
            yield Record(headers, bytes(self.held[end + 4 : stop]))
            at, self.need = stop + 4, 0
        del self.held[:at]

    def close(self) -> None:
        if self.held:
            raise ValueError("the archive ends within a record")


def inflated(source) -> Iterator[bytes]:
    """The bytes of a gzip file of one or many members, in pieces."""
    inflate, clean = zlib.decompressobj(_GZIP), True
    while data := source.read(CHUNK):
        while data:
            piece, clean = inflate.decompress(data), inflate.eof
            data = inflate.unused_data
            if piece:
                yield piece
            if clean:
                inflate = zlib.decompressobj(_GZIP)
    if not clean:
        raise ValueError("the gzip stream is cut off")


def normalise(source, target, index) -> int:
    """One pass from a monolithic gzip WARC to one with a member per record; returns the records.

    index gets a line of JSON per record: offset and length of its member, and its id."""
    parser, offset, n = Parser(), 0, 0
    for piece in inflated(source):
        for record in parser.feed(piece):
            deflate = zlib.compressobj(6, zlib.DEFLATED, _GZIP)
            member = deflate.compress(record.bytes()) + deflate.flush()
            target.write(member)
            index.write(json.dumps({"offset": offset, "length": len(member), "id": record.headers["WARC-Record-ID"]}).encode() + b"\n")
            offset, n = offset + len(member), n + 1
    parser.close()
    return n


def read_member(data: bytes) -> Record:
    parser = Parser()
    found = list(parser.feed(zlib.decompress(data, _GZIP)))
    parser.close()
    if len(found) != 1:
        raise ValueError("a member must hold one record")
    return found[0]


def mark_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to and revisit. Only digests that repeat are joined; their table is written
    first, so a small one is broadcast by its known size, and skewed digests of a large one are split by AQE."""
    rows = pick(pages, "page_id", "url", "html").select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    keyed = rows.withColumn("digest", F.when(F.octet_length("payload") >= least_bytes, F.sha1("payload")))
    repeated = keyed.where("digest IS NOT NULL").groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("digest_"), "top")
    repeated = written(repeated, "digests")
    joined = keyed.join(repeated, keyed["digest"] == repeated["digest_"], "left")
    revisit = F.col("digest_").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return joined.select("page_id", "url", "payload", F.when(revisit, F.col("top")).alias("refers_to"), revisit.alias("revisit"))


def write_monolithic(records: DataFrame, folder: str) -> DataFrame:
    """Writes page_id, url, payload, refers_to, revisit as archives of one gzip stream each; returns archive, records."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = fs.FileSystem.from_uri(folder)
        system.create_dir(top, recursive=True)
        out = deflate = None
        name, n, raw, done = "", 0, 0, []

        def close() -> None:
            out.write(deflate.flush())
            out.close()
            done.append((name, n))

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, n, raw = f"{top}/mono-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, deflate = system.open_output_stream(name, compression=None), zlib.compressobj(1, zlib.DEFLATED, _GZIP)
                data = make_record(row["page_id"], row["url"], row["payload"], row["refers_to"], row["revisit"]).bytes()
                out.write(deflate.compress(data))
                n, raw = n + 1, raw + len(data)
                if raw >= ROLL_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_pydict({"archive": pa.array([x for x, _ in done], pa.string()), "records": pa.array([x for _, x in done], pa.int64())})

    return written(text_batches(records).mapInArrow(write, "archive string, records long"), "archives")


def normalise_archives(archives: DataFrame, folder: str) -> DataFrame:
    """archive, records of monolithic files in; archive, sidecar, records of normalised ones out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = fs.FileSystem.from_uri(folder)
        for batch in batches:
            out = []
            for source, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = f"{top}/norm-{uuid.uuid4().hex}.warc.gz"
                with system.open_input_stream(source, compression=None) as s, system.open_output_stream(name, compression=None) as t, system.open_output_stream(name + ".idx") as i:
                    n = normalise(s, t, i)
                if n != records:
                    raise ValueError(f"{source} has {n} records, not {records}")
                out.append((name, name + ".idx", n))
            yield pa.RecordBatch.from_pydict({"archive": pa.array([x[0] for x in out], pa.string()), "sidecar": pa.array([x[1] for x in out], pa.string()), "records": pa.array([x[2] for x in out], pa.int64())})

    return written(_one_each(archives).mapInArrow(run, "archive string, sidecar string, records long"), "normalised")


def _one_each(archives: DataFrame) -> DataFrame:
    """An archive to a partition, as near as hashing gets; the list of archives is short."""
    return archives.repartition(max(1, min(10_000, archives.count())), "archive")


def read_archives(normalised: DataFrame, folder: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every record, found by the sidecars.
    Payloads of responses are digested again and must agree with their headers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for archive, sidecar in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_input_stream(sidecar) as s:
                    index = [json.loads(x) for x in s.read().splitlines()]
                rows = []
                with system.open_input_file(archive) as f:
                    for at in index:
                        h = (r := read_member(f.read_at(at["length"], at["offset"]))).headers
                        size, digest, kind = int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"]
                        if kind == "response":
                            payload = r.block[r.block.index(b"\r\n\r\n") + 4 :]
                            if len(payload) != size or digest32(payload) != digest:
                                raise ValueError(f"the payload of {h['WARC-Record-ID']} is not what its header says")
                        refers = read_id(h["WARC-Refers-To"]) if kind == "revisit" else None
                        rows.append((read_id(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), size, digest, kind, refers))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return _one_each(normalised).mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Writes pages as monolithic archives, normalises them, and reads all records back."""
    folder = folder or fresh_path(pages.sparkSession, "warc")
    mono = write_monolithic(mark_revisits(pages, least_bytes), folder)
    return read_archives(normalise_archives(mono, folder), folder)


#: DuckDB has no SHA-1 in base 32 of its own; it is put together from the hex digest, five bits a letter.
ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, encode(coalesce(html, ''))::BLOB AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), t AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex) AS top FROM p
), b AS (
  SELECT *, list_reduce(list_transform(range(40), lambda i: [(position(hex[i + 1] IN '0123456789abcdef') - 1)::BIGINT]), lambda x, y: x || y) AS nib FROM t
), bits AS (
  SELECT *, flatten(list_transform(nib, lambda v: [(v // 8) % 2, (v // 4) % 2, (v // 2) % 2, v % 2])) AS bit FROM b
)
SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(bit[5 * k + 1] * 16 + bit[5 * k + 2] * 8 + bit[5 * k + 3] * 4 + bit[5 * k + 4] * 2 + bit[5 * k + 5] + 1)::INT]), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM bits"""
