"""Writing recordings: archives out of uploaded parts, decoded datasets, and the catalog.

Tasks put files under names that are not yet valid, and the driver renames them when all are whole; so a task that is lost, repeated or
run twice leaves nothing that a reader would take for a result, and loses none.
"""

from __future__ import annotations

import io
import json
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parallaxis.kernels import frames as kernels
from parallaxis.kernels import image
from parallaxis.operators import joins

from . import recording_tar
from .archive_writer import write_archives


def png(bgr: np.ndarray) -> bytes:
    """An 8-bit RGB PNG."""
    h, w, _ = bgr.shape
    rows = np.zeros((h, 1 + 3 * w), dtype=np.uint8)
    rows[:, 1:] = bgr[:, :, ::-1].reshape(h, 3 * w)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def npy(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(a))
    return out.getvalue()


def accepted(files: DataFrame) -> DataFrame:
    """Received files (key, name, data, expected_size, expected_sha256) whose bytes are what was announced."""
    ok = (F.octet_length("data") == F.col("expected_size")) & (F.sha2("data", 256) == F.col("expected_sha256"))
    return files.where(ok)


def ready(manifest: DataFrame, staged: DataFrame, stored: DataFrame) -> DataFrame:
    """Uploads all of whose members are staged with equal sizes and hashes, less those that have an archive: the first one stays.

    manifest: upload_key, root, scan_id, position, member, name (of the file or segment), size, sha256; staged: upload_key, name, size, sha256, path."""
    whole = joins.complete(manifest.select("upload_key", "name", "size", "sha256"), staged.select("upload_key", "name", "size", "sha256"), ["upload_key"], ["name", "size", "sha256"]).where("is_complete").select("upload_key")
    rows = manifest.join(whole, "upload_key", "left_semi").join(stored.select("root", "scan_id"), ["root", "scan_id"], "left_anti")
    return rows.join(staged.select("upload_key", "name", "path"), ["upload_key", "name"])


def assemble(parts: DataFrame) -> DataFrame:
    """Writes <root>/<scan_id>.tar (GNU, members in order, segments joined) for every recording of ready(), where there is none yet, and
    returns archive, size for all of them. The bytes of parts are copied in pieces, and hashed if parts have a sha256."""
    write_archives(parts.select("root", "scan_id", "position", "member", "size", "path", *(["sha256"] if "sha256" in parts.columns else [])))

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                system, root = recording_tar.open_fs(r.root)
                rows.append((f"{root}/{r.scan_id}.tar", system.get_file_info(f"{root}/{r.scan_id}.tar").size))
            yield pd.DataFrame(rows, columns=["archive", "size"])

    return parts.select("root", "scan_id").distinct().mapInPandas(found, "archive string, size long")


def _put(system, final: str, pieces) -> int:
    """Writes a file under a name of this attempt's own and renames it; returns its size."""
    temp, n = f"{final}.{uuid.uuid4().hex[:12]}.partial", 0
    with system.open_output_stream(temp) as f:
        for piece in pieces:
            n += len(piece)
            f.write(piece)
    system.move(temp, final)
    return n


def _text_members(archive: str, system, folder: str) -> dict[str, int]:
    """Copies every member that holds no frames into a folder, byte for byte; their names and sizes."""
    source, at = recording_tar.open_fs(archive)
    out = {}
    with source.open_input_file(at) as f, tarfile.open(fileobj=f, mode="r:") as tar:
        for m in tar:
            name = m.name.rpartition("/")[2]
            if m.isfile() and not name.endswith(".bin"):
                data = tar.extractfile(m)
                out[name] = _put(system, f"{folder}/{name}", iter(lambda: data.read(recording_tar.CHUNK), b""))
    return out


def _summary(r, copied: list[str], total: int) -> dict:
    """What decoded.json says of a recording. Its keys, and the patterns of file names, are fixed values."""
    color = {"count": int(r.color_frames), "width": int(r.color_width), "height": int(r.color_height), "files": "color/<index:06d>.png", "format": "PNG, 8-bit RGB", "holds": f"colour frames by index, as the sensor lies, converted by {r.ycbcr_matrix}"}
    size = {"width": int(r.depth_width), "height": int(r.depth_height)}
    kind = np.dtype(kernels.TYPES[r.depth_pixel_format]).name
    depth = {"count": int(r.depth_frames), **size, "files": "depth/<index:06d>.npy", "format": f"npy {kind}, metres", "holds": "depth maps by index, as they are stored; NaN and 0 are no reading"}
    out = {"source": r.tar_path.rpartition("/")[2], "format_version": r.format_version, "camera": r.camera, "copied": copied, "color": color, "depth": depth}
    if r.confidence_frames:
        out["confidence"] = {"count": int(r.confidence_frames), **size, "files": "confidence/<index:06d>.npy", "format": "npy uint8", "holds": "a level for each pixel of the depth map with the same index: 0 low, 1 medium, 2 high"}
    return out | {"bytes": total}


def decode(spark: SparkSession, path: str, out: str, force: bool = False) -> DataFrame:
    """Decodes archives into <out>/<scan_id>/: color/000000.png, depth/000000.npy, confidence/..., the text members as they are, and
    decoded.json, which says what the folder holds. Returns scan_id, frames, bytes of what was decoded.

    Recordings with a decoded.json are left alone unless force says otherwise. Frames are tasks of their own, which fill a folder of this
    job that has another name; when all are there the driver gives each folder its own, once that of an earlier run is gone (its decoded.json
    first). So a folder with a decoded.json is whole and holds nothing else, and a run that fails leaves what was there as it was."""
    recordings = recording_tar.load(spark, path, "recordings")
    system, top = recording_tar.open_fs(out)
    system.create_dir(top, recursive=True)
    job = uuid.uuid4().hex[:16]
    partial = lambda scan_id: f".{scan_id}.{job}.partial"

    def left(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, top = recording_tar.open_fs(out)
        for pdf in batches:
            yield pdf[[system.get_file_info(f"{top}/{s}/decoded.json").type.name == "NotFound" for s in pdf.scan_id]]

    about = recordings.select("scan_id", "tar_path", "format_version", "camera", "color_width", "color_height", "depth_width", "depth_height", "depth_pixel_format", "ycbcr_matrix")
    todo = about if force else about.mapInPandas(left, about.schema)
    blobs = recording_tar.load(spark, path, "blobs").join(todo.select("scan_id", "ycbcr_matrix"), "scan_id")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, top = recording_tar.open_fs(out)
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                a = kernels.pixels(r)
                data, kind = (png(image.to_bgr(a, r.ycbcr_matrix)), "png") if r.stream == "color" else (npy(a), "npy")
                folder = f"{top}/{partial(r.scan_id)}/{r.stream}"
                system.create_dir(folder, recursive=True)
                _put(system, f"{folder}/{r.frame_index:06d}.{kind}", [data])
                rows.append((r.scan_id, r.stream, len(data)))
            yield pd.DataFrame(rows, columns=["scan_id", "stream", "bytes"])

    of = lambda s: F.count_if(F.col("stream") == s).alias(f"{s}_frames")
    frames = blobs.mapInPandas(write, "scan_id string, stream string, bytes long").groupBy("scan_id").agg(F.count("*").alias("frames"), F.sum("bytes").alias("bytes"), *map(of, ("color", "depth", "confidence")))
    frames = todo.join(frames, "scan_id", "left").fillna(0, ["frames", "bytes", "color_frames", "depth_frames", "confidence_frames"])

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, top = recording_tar.open_fs(out)
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                folder = f"{top}/{partial(r.scan_id)}"
                system.create_dir(folder, recursive=True)
                copied = _text_members(r.tar_path, system, folder)
                total = int(r.bytes) + sum(copied.values())
                _put(system, f"{folder}/decoded.json", [json.dumps(_summary(r, sorted(copied), total), indent=2).encode()])
                rows.append((r.scan_id, int(r.frames), total))
            yield pd.DataFrame(rows, columns=["scan_id", "frames", "bytes"])

    schema = "scan_id string, frames long, bytes long"
    try:
        done = frames.mapInPandas(summarise, schema).collect()  # a row for each archive
        for r in done:
            final = f"{top}/{r.scan_id}"
            if system.get_file_info(final).type.name != "NotFound":
                if system.get_file_info(f"{final}/decoded.json").type.name != "NotFound":
                    system.delete_file(f"{final}/decoded.json")
                system.delete_dir(final)
            system.move(f"{top}/{partial(r.scan_id)}", final)
    finally:
        for f in system.get_file_info(fs.FileSelector(top)):
            if f.base_name.endswith(f".{job}.partial"):
                system.delete_dir(f.path)
    return spark.createDataFrame(done, schema)


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """Archives of a root, newest first by the text of their start, those without one last. Unreadable metadata are nulls."""
    r = recording_tar.load(spark, root, "recordings", mode="PERMISSIVE")
    return r.select("scan_id", "name", "camera", "start_time_utc", "duration_s", "size").orderBy(F.desc(F.coalesce("start_time_utc", F.lit(""))), F.desc("scan_id"))


def rendered(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a side-by-side view in time order: colour frame, dropped or not, with the depth of its instant (times need not be
    equal, only captured together) and the rotation that was last known. Encoding a video is left to a tool that does that."""
    from pyspark.sql import Window

    f = recording_tar.load(spark, path, "frames")
    color, depth = f.where("stream = 'color'"), f.where("stream = 'depth' AND frame_index IS NOT NULL")
    d = depth.select("scan_id", F.col("ts").alias("depth_ts"), F.col("frame_index").alias("depth_index"))
    met = joins.same_instant(d, color.select("scan_id", "ts", "pos"), ["scan_id"], "depth_ts", "ts", "pos")
    met = met.groupBy("scan_id", "pos").agg(F.max_by("depth_index", F.struct("depth_ts", "depth_index")).alias("depth_index"))
    rows = color.select("scan_id", "ts", F.col("frame_index").alias("color_index"), "dropped", "upright_rotation_deg", "pos").join(met, ["scan_id", "pos"], "left").where("dropped IS NULL OR depth_index IS NOT NULL")
    w = Window.partitionBy("scan_id").orderBy("pos")
    last = F.last("upright_rotation_deg", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = F.first("upright_rotation_deg", ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return rows.withColumn("rotation", F.coalesce(last, first)).drop("upright_rotation_deg")


def panels(spark: SparkSession, path: str, box: int = 640) -> DataFrame:
    """rendered() with a picture of each row: near and far (metres at the ends of the legend: the 2nd and 98th percentile of the
    recording's readings), valid_share of the depth map, and panel, a PNG of both frames upright side by side over a legend."""
    from parallaxis.checks import report

    t, shown = report.tables(spark, path, keep=False), rendered(spark, path)
    columns = shown.columns
    blob = lambda s: getattr(t, f"{s}_places").select("scan_id", F.col("frame_index").alias(f"{s}_index"), F.struct(*kernels.PLACE).alias(f"{s}_"))
    rows = shown.join(blob("color"), ["scan_id", "color_index"], "left").join(blob("depth"), ["scan_id", "depth_index"], "left")
    rows = rows.join(t.recordings.select("scan_id", F.col("ycbcr_matrix").alias("matrix_")), "scan_id").join(report.readings(t).select("scan_id", F.col("stretch").alias("ends_")), "scan_id", "left")
    more = {"near": "double", "far": "double", "valid_share": "double", "panel": "binary"}
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in shown.schema), *(f"{n} {k}" for n, k in more.items())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = []
            for r in pdf.itertuples(index=False):
                color = None if r.color_ is None else image.to_bgr(kernels.pixels(pd.Series(r.color_)), r.matrix_)
                depth = None if r.depth_ is None else kernels.pixels(pd.Series(r.depth_))
                near, far = (None, None) if r.ends_ is None else map(float, r.ends_)
                ends = (0.0, 1.0) if near is None else (near, far)
                share = None if depth is None else float(image.is_valid(depth).mean())
                made.append((near, far, share, png(image.panel(color, depth, 0 if pd.isna(r.rotation) else int(r.rotation), *ends, box))))
            yield pdf[columns].assign(**{n: [m[i] for m in made] for i, n in enumerate(more)})

    return rows.select(*columns, "color_", "depth_", "matrix_", "ends_").mapInPandas(run, schema)


def render(spark: SparkSession, path: str, out: str, box: int = 640) -> DataFrame:
    """Writes the panels of recordings as <out>/<scan_id>/<pos>.png, each renamed when it is whole. Returns scan_id, pos, bytes."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, top = recording_tar.open_fs(out)
        for pdf in batches:
            for s in set(pdf.scan_id):
                system.create_dir(f"{top}/{s}", recursive=True)
            yield pdf[["scan_id", "pos"]].assign(bytes=[_put(system, f"{top}/{r.scan_id}/{r.pos:06d}.png", [r.panel]) for r in pdf.itertuples(index=False)])

    return panels(spark, path, box).select("scan_id", F.col("pos").cast("long").alias("pos"), "panel").mapInPandas(write, "scan_id string, pos long, bytes long")
