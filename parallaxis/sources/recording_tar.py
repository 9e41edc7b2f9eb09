"""The `recording_tar` data source: archives of recordings as tables.

    register(spark)
    spark.read.format("recording_tar").option("table", "frames").load("/data/archives")

Tables: recordings, frames, runs, values, calibrations, members, blobs. Only `blobs` and the hashes of `members` read
frame bytes; every other table reads the small members alone. The driver lists archives and opens none: each is a partition, and for blobs
each range of `bytesPerPartition` of its bytes is, whose task has the frames that begin in it. Conditions on columns other than
nested ones are evaluated before a frame is read, where spark.sql.python.filterPushdown.enabled is true when load() is called; the options
scan_id, member, stream and frames do the same in any case. With the option content false, blobs have no data: they say where frames lie, so that
joins carry places and the bytes are read by whoever needs them (kernels.frames.stored). `mode` PERMISSIVE gives unreadable archives a row of `recordings` with the
reason in `corrupt`; FAILFAST (the default) raises. Paths may be on any file system that pyarrow knows. Written archives: archive_writer.
"""

from __future__ import annotations

import hashlib
import operator
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition
from pyspark.sql.types import StructType

from . import layout

CHUNK = 8 << 20
K = "struct<fx:float,fy:float,cx:float,cy:float>"
TABLES = {
    "recordings": """scan_id string, format_version string, format_minor int, encoded boolean, camera string, name string, author string, start_time_utc string, duration_s double,
        phone_model string, phone_id string, ios_version string, frame_rate double, recovered boolean, color_width int, color_height int, depth_width int, depth_height int,
        ycbcr_matrix string, depth_pixel_format string, principal_point_origin string, n_poses int, n_color_intrinsics int, n_depth_intrinsics int, scan_keys array<string>, metadata_json string,
        tar_path string, size long, corrupt string""",
    "frames": f"""scan_id string, stream string, pos int, frame_index int, ts double, dropped string, intrinsics {K}, upright_rotation_deg int, gravity array<double>, gravity_ts double,
        exposure_s double, lens_position double, received_ts double, bytes_per_row int, filtered boolean, accuracy string, quality string, tracking_state string,
        world_from_camera array<array<double>>, compressed_size long, raw_sha256 string, confidence_compressed_size long, confidence_raw_sha256 string""",
    "runs": "scan_id string, kind string, entry_no int, first int, last int",
    "values": "scan_id string, kind string, entry_no int, value_json string",
    "calibrations": "scan_id string, line_no int, frame_index int, ts double, calibration_json string",
    "members": """scan_id string, member string, stream string, tar_offset long, size long, frames int, frame_bytes long, encoding string, recorded_size long, recorded_sha256 string,
        stored_size_sum long, sha256 string""",
    "blobs": """scan_id string, member string, stream string, frame_index int, width int, height int, pixel_format string, encoding string, raw_sha256 string, tar_path string,
        tar_offset long, stored_len long, data binary""",
}


@dataclass
class Piece(InputPartition):
    path: str
    size: int = 0
    first: int = 0  # of the bytes whose frames it has
    after: int = 1 << 62


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def archives(path: str) -> list[tuple[str, int]]:
    """(path, size) of an archive, or of all `*.tar` under a folder, by path. Names that begin with a dot aren't finished."""
    system, at = open_fs(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    prefix = path.split("://")[0] + "://" if "://" in path else ""
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = system.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted((prefix + f.path, f.size) for f in found if is_archive(f))


def is_archive(f: fs.FileInfo) -> bool:
    return f.type == fs.FileType.File and f.base_name.endswith(".tar") and not f.base_name.startswith(".")


class RecordingTar(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recording_tar"

    def schema(self) -> str:
        return TABLES[self.options.get("table", "recordings")]

    def reader(self, schema: StructType) -> RecordingReader:
        return (FilteringReader if self.options.get("pushdown") == "true" else RecordingReader)(schema, dict(self.options))

    def streamReader(self, schema: StructType):
        from .replay import ReplayReader

        return ReplayReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool):
        from .archive_writer import ArchiveWriter

        return ArchiveWriter(schema, dict(self.options), overwrite)


#: Filters that are evaluated here, and how.
COMPARED = {ds.EqualTo: operator.eq, ds.GreaterThan: operator.gt, ds.GreaterThanOrEqual: operator.ge, ds.LessThan: operator.lt, ds.LessThanOrEqual: operator.le, ds.StringStartsWith: str.startswith}
#: Columns of tables whose values are known before frame bytes are read.
LATE_COLUMNS = ("data", "sha256")


def passes(f: Filter, row: dict) -> bool:
    """Whether a row passes a filter; a comparison with null doesn't."""
    if isinstance(f, ds.Not):
        return row.get(f.child.attribute[0]) is not None and not passes(f.child, row)
    value = row.get(f.attribute[0])
    if isinstance(f, ds.IsNull):
        return value is None
    if isinstance(f, ds.IsNotNull):
        return value is not None
    if isinstance(f, ds.EqualNullSafe):
        return value == f.value
    if value is None:
        return False
    return value in f.value if isinstance(f, ds.In) else bool(COMPARED[type(f)](value, f.value))


class RecordingReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = schema.fieldNames()
        self.plain = {f.name for f in schema.fields if f.dataType.typeName() in ("string", "integer", "long", "boolean")} - set(LATE_COLUMNS)
        self.table = options.get("table", "recordings")
        self.path = options["path"]
        self.permissive = options.get("mode", "FAILFAST").upper() == "PERMISSIVE"
        self.measure = options.get("measure", "false").lower() == "true"
        self.content = options.get("content", "true").lower() == "true"
        self.bytes = max(1, int(options.get("bytesperpartition") or options.get("bytesPerPartition") or 128 << 20))
        only = {c: set(options[c].split(",")) for c in ("scan_id", "member", "stream") if options.get(c)}
        if options.get("frames"):
            only["frame_index"] = set(map(int, options["frames"].split(",")))
        self.filters: list[Filter] = [ds.In((c,), tuple(v)) for c, v in only.items() if c in self.names]

    def keeps(self, row: dict) -> bool:
        return all(passes(f, row) for f in self.filters)

    def can_hold(self, known: dict) -> bool:
        """Whether rows with these values can pass, whatever their other columns are."""
        return all(passes(f, known) for f in self.filters if (f.child if isinstance(f, ds.Not) else f).attribute[0] in known)

    def partitions(self) -> list[Piece]:
        out = []
        for path, size in archives(self.path):
            step = self.bytes if self.table == "blobs" else max(size, 1)
            out += [Piece(path, size, a, a + step) for a in range(0, max(size, 1), step)]
        return out or [Piece("")]

    def _contents(self, path: str) -> layout.Contents:
        system, at = open_fs(path)
        with system.open_input_file(at) as f:
            return layout.read(f, path)

    def read(self, piece: Piece) -> Iterator[tuple]:
        if not piece.path:
            return
        try:
            contents = self._contents(piece.path)
        except Exception as e:
            if not self.permissive:
                raise
            if self.table == "recordings":
                yield self.row({"tar_path": piece.path, "size": piece.size, "corrupt": str(e)[:500], "scan_id": piece.path.rpartition("/")[2].removesuffix(".tar")})
            return
        if self.can_hold({"scan_id": contents.recording["scan_id"]}):
            for r in self.rows(contents, piece):
                if self.keeps(r):
                    yield self.row(r)

    def row(self, values: dict) -> tuple:
        return tuple(self.value(values.get(n)) for n in self.names)

    @staticmethod
    def value(v: object) -> object:
        return tuple(float(v[k]) for k in layout.K_CELLS) if isinstance(v, dict) else v

    def rows(self, c: layout.Contents, piece: Piece) -> Iterator[dict]:
        scan = {"scan_id": c.recording["scan_id"]}
        if self.table == "recordings":
            yield c.recording | {"size": piece.size, "duration_s": _double(c.recording["duration_s"]), "frame_rate": _double(c.recording["frame_rate"])}
        elif self.table == "members":
            system, at = open_fs(piece.path)
            for s in c.stored:
                r = scan | {"member": s.member, "stream": s.stream, "tar_offset": s.offset, "size": s.size, "frames": s.frames, "frame_bytes": s.frame_bytes, "encoding": s.encoding, "recorded_size": s.recorded_size, "recorded_sha256": s.recorded_sha256, "stored_size_sum": sum(s.sizes) if s.sizes is not None else s.frames * s.frame_bytes, "sha256": None}
                if self.measure and self.keeps(r):
                    with system.open_input_file(at) as f:
                        r["sha256"] = hashed(f, s.offset, s.size)
                yield r
        elif self.table == "blobs":
            yield from self._blobs(c, piece, scan)
        else:
            for r in getattr(c, self.table):
                yield _floats(r)

    def _blobs(self, c: layout.Contents, piece: Piece, scan: dict) -> Iterator[dict]:
        """Frames that begin within the piece's bytes; only those that pass are read."""
        system, at = open_fs(piece.path)
        with system.open_input_file(at) as f:
            for s in c.stored:
                own = scan | {"member": s.member, "stream": s.stream, "width": s.width, "height": s.height, "pixel_format": s.pixel_format, "encoding": s.encoding}
                if not self.can_hold(own):
                    continue
                spans = s.spans()
                for i in range(bisect_left(spans, (piece.first,)), bisect_left(spans, (piece.after,))):
                    offset, n = spans[i]
                    r = own | {"frame_index": i, "raw_sha256": s.raw_sha256[i] if s.raw_sha256 else None, "tar_path": piece.path, "tar_offset": offset, "stored_len": n}
                    if self.keeps(r):
                        yield r | {"data": f.read_at(n, offset) if self.content else None}


class FilteringReader(RecordingReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            of = f.child if isinstance(f, ds.Not) else f
            known = isinstance(of, (ds.In, ds.IsNull, ds.IsNotNull, ds.EqualNullSafe, *COMPARED)) and not (isinstance(f, ds.Not) and isinstance(of, (ds.IsNull, ds.IsNotNull, ds.EqualNullSafe)))
            # unreadable archives have a row whatever their contents would be
            if known and len(of.attribute) == 1 and of.attribute[0] in self.plain and not (self.permissive and self.table == "recordings") and not (isinstance(of, ds.In) and None in of.value):
                self.filters.append(f)
            else:
                yield f


def hashed(f, offset: int, size: int) -> str:
    digest, at = hashlib.sha256(), offset
    while at < offset + size:
        part = f.read_at(min(CHUNK, offset + size - at), at)
        digest.update(part)
        at += len(part)
    return digest.hexdigest()


def _double(v: object) -> float | None:
    return None if v is None else float(v)


DOUBLES = ("ts", "gravity_ts", "exposure_s", "lens_position", "received_ts")


def _floats(r: dict) -> dict:
    """JSON numbers may be whole; their columns are doubles."""
    r = r | {k: _double(r[k]) for k in DOUBLES if k in r}
    if r.get("gravity") is not None:
        r["gravity"] = [float(x) for x in r["gravity"]]
    if r.get("world_from_camera") is not None:
        r["world_from_camera"] = [[float(x) for x in row] for row in r["world_from_camera"]]
    return r


#: Spark asks Python sources about filters only if this is true, and bears none that could be asked where it isn't.
PUSHED = "spark.sql.python.filterPushdown.enabled"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordingTar)


def load(spark: SparkSession, path: str, table: str, **options: str):
    register(spark)
    reader = spark.read.format("recording_tar").option("table", table).option("pushdown", spark.conf.get(PUSHED))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path)
