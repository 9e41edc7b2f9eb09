"""Writing archives: `df.write.format("recording_tar").mode("append").save(root)`.

Rows are parts of members: scan_id, position, member, and either data (the bytes) or path and size (a staged file); root, if it is there,
says where a row's archive goes instead of the path that was saved to, sha256 what the part's bytes must hash to, and a true prefix that
a file goes on behind its part. Parts of a
member follow each other in the order of position, members in the order of their first part. All rows of a recording must come in one
task, one after the other, as write_archives() sees to.

The commit has two phases. A task writes each archive under a name of its own attempt that no reader takes for an archive, and reports it.
When all tasks have reported, the driver gives each archive its name: those that are already there stay (append) or go (overwrite).
Whatever attempts were lost, repeated or run twice, what they left is deleted then, or when the job is given up.
"""

from __future__ import annotations

import hashlib
import itertools
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from .recording_tar import open_fs, register

CHUNK = 8 << 20
#: Names that are being written begin with a dot and end so.
PARTIAL = ".partial"


class Pieces:
    """Parts one after another as one stream, hashed as they are read; one file is open at a time."""

    def __init__(self, parts: list[Part]):
        self.parts, self.at, self.file, self.digest, self.read_bytes = parts, -1, None, None, 0

    def _next(self) -> bool:
        self._close()
        if self.at + 1 >= len(self.parts):
            return False
        self.at += 1
        part = self.parts[self.at]
        if part.data is None:
            system, where = open_fs(part.path)
            self.file = system.open_input_stream(where)
        else:
            self.file = memoryview(part.data)
        self.digest, self.read_bytes = hashlib.sha256(), 0
        return True

    def _close(self) -> None:
        if self.file is None:
            return
        if not isinstance(self.file, memoryview):
            self.file.close()
        self.file, part = None, self.parts[self.at]
        if self.read_bytes != part.size or part.sha256 not in (None, self.digest.hexdigest()):
            raise ValueError(f"a part of {part.member} isn't what was announced: {part.path or 'data'}")

    def _take(self, n: int) -> bytes:
        if isinstance(self.file, memoryview):
            out, self.file = bytes(self.file[:n]), self.file[n:]
            return out
        return self.file.read(n)

    def read(self, n: int) -> bytes:
        out = []
        while n > 0 and (self.file is not None or self._next()):
            part = self.parts[self.at]
            piece = self._take(min(n, CHUNK, part.size - self.read_bytes if part.prefix else n))
            if piece:
                self.digest.update(piece)
                self.read_bytes += len(piece)
                out.append(piece)
                n -= len(piece)
            elif not self._next():
                break
        return b"".join(out)

    def finish(self) -> None:
        """Checks what follows the last byte that was asked for: nothing may, and the last part must be whole."""
        if self.read(1):
            raise ValueError(f"parts of {self.parts[0].member} hold more than was announced")
        self._close()


@dataclass(frozen=True)
class Part:
    position: int
    member: str
    size: int
    path: str | None = None
    data: bytes | None = None
    sha256: str | None = None
    prefix: bool = False


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: (root, name, partial name, size)."""

    archives: list[tuple[str, str, str, int]]


class ArchiveWriter(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        names = set(schema.fieldNames())
        if not {"scan_id", "position", "member"} <= names or not ("data" in names or {"path", "size"} <= names):
            raise ValueError(f"an archive's parts are scan_id, position, member and data, or path and size; these are {sorted(names)}")
        if "root" not in names and not options.get("path"):
            raise ValueError("where archives go is the path that is saved to, or a column root")
        self.root, self.overwrite, self.job = options.get("path"), overwrite, uuid.uuid4().hex[:16]

    def write(self, rows: Iterator[Row]) -> Written:
        archives: list[tuple[str, str, str, int]] = []
        seen: set[tuple[str, str]] = set()
        try:
            for key, own in itertools.groupby(rows, lambda r: (_of(r, "root") or self.root, r["scan_id"])):
                if key in seen:
                    raise ValueError(f"rows of {key[1]} don't follow each other")
                seen.add(key)
                self._archive(*key, sorted(map(_part, own), key=lambda p: p.position), archives)
        except BaseException:
            _delete((root, partial) for root, _, partial, _ in archives)
            raise
        return Written(archives)

    def _archive(self, root: str, scan_id: str, parts: list[Part], archives: list) -> None:
        system, top = open_fs(root)
        name, partial = f"{scan_id}.tar", f".{scan_id}.{self.job}.{uuid.uuid4().hex[:12]}{PARTIAL}"
        system.create_dir(top, recursive=True)
        members: dict[str, list[Part]] = {}
        for p in parts:
            members.setdefault(p.member, []).append(p)
        archives.append((root, name, partial, 0))
        with system.open_output_stream(f"{top}/{partial}") as f, tarfile.open(fileobj=f, mode="w|", format=tarfile.GNU_FORMAT) as tar:
            tar.copybufsize = CHUNK
            for member, pieces in members.items():
                info = tarfile.TarInfo(f"{scan_id}/{member}")
                info.size = sum(p.size for p in pieces)
                source = Pieces(pieces)
                tar.addfile(info, source)
                source.finish()
        archives[-1] = (root, name, partial, system.get_file_info(f"{top}/{partial}").size)

    def commit(self, messages: list[Written | None]) -> None:
        found = [a for m in messages if m is not None for a in m.archives]
        twice = {k for k, own in itertools.groupby(sorted(a[:2] for a in found)) if len(list(own)) > 1}
        if twice:
            self.abort(messages)
            raise ValueError(f"rows of a recording came from several tasks; use write_archives(): {sorted(twice)[:3]}")
        for root, name, partial, _ in found:
            system, top = open_fs(root)
            there = system.get_file_info(f"{top}/{name}").type != fs.FileType.NotFound
            if there and not self.overwrite:
                continue  # the first one stays
            system.move(f"{top}/{partial}", f"{top}/{name}")
        self._sweep(found)

    def abort(self, messages: list[Written | None]) -> None:
        self._sweep([a for m in messages if m is not None for a in m.archives])

    def _sweep(self, found: list[tuple[str, str, str, int]]) -> None:
        """Deletes what is left of this job's attempts, also of those that reported nothing."""
        for root in {a[0] for a in found} | ({self.root} if self.root else set()):
            system, top = open_fs(root)
            left = system.get_file_info(fs.FileSelector(top, allow_not_found=True))
            _delete((root, f.base_name) for f in left if f".{self.job}." in f.base_name and f.base_name.endswith(PARTIAL))


def _of(row: Row, name: str):
    return row[name] if name in row.__fields__ else None


def _part(row: Row) -> Part:
    data = _of(row, "data")
    if data is not None:
        return Part(int(row["position"]), row["member"], len(data), None, bytes(data), _of(row, "sha256"))
    return Part(int(row["position"]), row["member"], int(row["size"]), row["path"], None, _of(row, "sha256"), bool(_of(row, "prefix")))


def _delete(files) -> None:
    for root, name in files:
        system, top = open_fs(root)
        if system.get_file_info(f"{top}/{name}").type != fs.FileType.NotFound:
            system.delete_file(f"{top}/{name}")


def write_archives(parts: DataFrame, root: str | None = None, overwrite: bool = False) -> None:
    """Writes an archive for every recording (root, scan_id) of parts: its rows are brought together and put in order, and then written."""
    register(parts.sparkSession)
    keys = [c for c in ("root", "scan_id") if c in parts.columns]
    if "size" in parts.columns:
        parts = parts.withColumn("size", F.col("size").cast("long"))
    rows = parts.repartition(*keys).sortWithinPartitions(*keys, "position")
    writer = rows.write.format("recording_tar").mode("overwrite" if overwrite else "append")
    writer.save(root) if root else writer.save()
