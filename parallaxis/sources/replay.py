"""Archives of a growing folder as a stream of frames.

    spark.readStream.format("recording_tar").option("table", "frames").load("/data/archives")

The rows of an archive come once, when it is there under its own name: those of one archive in the order of their times. An offset is the time
up to which archives were seen and the names of those that are not older than that by `lateness` (seconds, a day if it isn't
given), so it stays small however many archives there are; one that appears with an older time of change than that isn't seen. Between the
same two offsets there are the same archives, so a restart from a checkpoint repeats what wasn't committed and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSourceStreamReader
from pyspark.sql.types import StructType

from . import recording_tar

DAY_S = 86_400


def listed(path: str) -> list[tuple[int, str, int]]:
    """(time of change in ns, path, size) of the archives of a folder."""
    system, at = recording_tar.open_fs(path)
    prefix = path.split("://")[0] + "://" if "://" in path else ""
    found = system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    return sorted((f.mtime_ns or 0, prefix + f.path, f.size) for f in found if recording_tar.is_archive(f))


class ReplayReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict):
        self.reader = recording_tar.RecordingReader(schema, options)
        self.path = options["path"]
        self.lateness = int(float(options.get("lateness", DAY_S)) * 1e9)

    def initialOffset(self) -> dict:
        return {"upto": 0, "recent": []}

    def latestOffset(self) -> dict:
        found = listed(self.path)
        upto = max((t for t, _, _ in found), default=0)
        return {"upto": upto, "recent": sorted(p for t, p, _ in found if t > upto - self.lateness)}

    def _seen(self, offset: dict, t: int, path: str, recent: set[str]) -> bool:
        return bool(offset["upto"]) and (t <= offset["upto"] - self.lateness or path in recent)

    def partitions(self, start: dict, end: dict) -> list[recording_tar.Piece]:
        before, upto = set(start["recent"]), set(end["recent"])
        new = [(p, size) for t, p, size in listed(self.path) if self._seen(end, t, p, upto) and not self._seen(start, t, p, before)]
        return [recording_tar.Piece(p, size) for p, size in new] or [recording_tar.Piece("")]

    def read(self, piece: recording_tar.Piece) -> Iterator[tuple]:
        yield from self.reader.read(piece)

    def commit(self, end: dict) -> None:
        pass
