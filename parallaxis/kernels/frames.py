"""Kernels over tables of frames: Arrow-batched, one frame in, one row out, so memory is bounded by a batch, which Spark ends at
`spark.sql.execution.arrow.maxBytesPerBatch` (64 MB unless set)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallaxis.sources import recording_tar

from . import alignment, codec, image

#: What a place of a frame consists of.
PLACE = ("width", "height", "pixel_format", "encoding", "tar_path", "tar_offset", "stored_len")
#: numpy types of stored pixels.
TYPES = {"fdep": "<f4", "hdep": "<f2", "L008": "|u1"}


def stored(row) -> bytes:
    """A frame's bytes as they are stored: its data, or what lies at its place in the archive."""
    if (data := getattr(row, "data", None)) is not None:
        return bytes(data)
    system, at = recording_tar.open_fs(row.tar_path)
    with system.open_input_file(at) as f:
        return f.read_at(int(row.stored_len), int(row.tar_offset))


def pixels(row) -> np.ndarray:
    """The frame of a row of `blobs`, decoded if it is encoded."""
    w, h, data = int(row.width), int(row.height), stored(row)
    if row.pixel_format == "420f":
        return codec.decode_color(data, w, h) if row.encoding else np.frombuffer(data, dtype=np.uint8).reshape(h * 3 // 2, w)
    kind = np.dtype(TYPES[row.pixel_format])
    return codec.decode_map(data, kind, (h, w)) if row.encoding else np.frombuffer(data, dtype=kind).reshape(h, w)


def _each(fn, schema: str):
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([fn(r) for r in pdf.itertuples(index=False)], columns=names)

    return run


def decoded(blobs: DataFrame) -> DataFrame:
    """Raw bytes of every frame, and whether their SHA-256 is the recorded one (null where none is)."""

    def one(r) -> tuple:
        raw = np.ascontiguousarray(pixels(r)).tobytes()
        return r.scan_id, r.stream, r.frame_index, raw, None if r.raw_sha256 is None else hashlib.sha256(raw).hexdigest() == r.raw_sha256

    schema = "scan_id string,stream string,frame_index int,raw binary,is_lossless boolean"
    return blobs.mapInPandas(_each(one, schema), schema)


def lossless(blobs: DataFrame) -> DataFrame:
    """As decoded(), without the bytes."""

    def one(r) -> tuple:
        raw = np.ascontiguousarray(pixels(r))
        return r.scan_id, r.stream, r.frame_index, None if r.raw_sha256 is None else hashlib.sha256(raw).hexdigest() == r.raw_sha256

    schema = "scan_id string,stream string,frame_index int,is_lossless boolean"
    return blobs.mapInPandas(_each(one, schema), schema)


def bgr(blobs: DataFrame, recordings: DataFrame) -> DataFrame:
    """Colour frames as 8-bit BGR (rows of pixels)."""
    rows = blobs.where("stream = 'color'").join(recordings.select("scan_id", "ycbcr_matrix"), "scan_id")

    def one(r) -> tuple:
        return r.scan_id, r.frame_index, r.width, r.height, image.to_bgr(pixels(r), r.ycbcr_matrix).tobytes()

    schema = "scan_id string,frame_index int,width int,height int,bgr binary"
    return rows.mapInPandas(_each(one, schema), schema)


def depth_statistics(blobs: DataFrame) -> DataFrame:
    """Of each depth map its share of valid pixels, and range; of each confidence map its largest level."""

    def one(r) -> tuple:
        a = pixels(r)
        if r.stream == "confidence":
            return r.scan_id, r.stream, r.frame_index, None, None, None, int(a.max(initial=0))
        z = image.metres(a)
        ok = image.is_valid(z)
        return r.scan_id, r.stream, r.frame_index, float(ok.mean()), float(z[ok].min()) if ok.any() else None, float(z[ok].max()) if ok.any() else None, None

    schema = "scan_id string,stream string,frame_index int,valid_share double,low double,high double,level int"
    return blobs.where("stream IN ('depth', 'confidence')").mapInPandas(_each(one, schema), schema)


def depth_values(blobs: DataFrame, step: int = 1) -> DataFrame:
    """Valid readings as an array per depth map, every step-th pixel of every step-th row."""

    def one(r) -> tuple:
        z = image.metres(pixels(r))[::step, ::step]
        return r.scan_id, r.frame_index, z[image.is_valid(z)].astype(float).tolist()

    schema = "scan_id string,frame_index int,metres array<double>"
    return blobs.where("stream = 'depth'").mapInPandas(_each(one, schema), schema)


def reading_counts(depth: DataFrame, confidence: DataFrame) -> DataFrame:
    """scan_id, metres, level, n: how often each valid reading occurs at each level of confidence, counted by frame, so a value of a
    recording may have several rows. level is null for maps without a confidence map."""
    levels = confidence.select("scan_id", "frame_index", F.col("encoding").alias("level_encoding"), F.col("data").alias("level_data"))
    rows = depth.select("scan_id", "frame_index", "width", "height", "pixel_format", "encoding", "data").join(levels, ["scan_id", "frame_index"], "left")

    def one(r) -> tuple:
        z = image.metres(pixels(r))
        ok = image.is_valid(z)
        level = np.full(z.shape, -1, dtype=np.int32)
        if r.level_data is not None:
            data = bytes(r.level_data)
            level = (codec.decode_map(data, np.dtype("u1"), z.shape) if r.level_encoding else np.frombuffer(data, dtype=np.uint8).reshape(z.shape)).astype(np.int32)
        parts = [(v, *np.unique(z[ok & (level == v)], return_counts=True)) for v in np.unique(level[ok])]
        none = np.empty(0)
        metres, n = (np.concatenate([p[i] for p in parts]) if parts else none for i in (1, 2))
        return r.scan_id, metres.astype(np.float64), np.repeat([p[0] for p in parts], [len(p[1]) for p in parts]).astype(np.int32) if parts else none.astype(np.int32), n.astype(np.int64)

    schema = "scan_id string,metres array<double>,level array<int>,n array<bigint>"
    each = rows.mapInPandas(_each(one, schema), schema).select("scan_id", F.explode(F.arrays_zip("metres", "level", "n")).alias("x")).select("scan_id", "x.*")
    return each.withColumn("level", F.nullif("level", F.lit(-1)))


def luma_edges(blobs: DataFrame, recordings: DataFrame) -> DataFrame:
    size = recordings.select("scan_id", "depth_width", "depth_height")

    def one(r) -> tuple:
        luma = image.planes(pixels(r))[0]
        return r.scan_id, r.frame_index, alignment.luma_edges(luma, int(r.depth_width), int(r.depth_height)).astype("<f4").tobytes()

    schema = "scan_id string,frame_index int,gradient binary"
    return blobs.where("stream = 'color'").join(size, "scan_id").mapInPandas(_each(one, schema), schema)


def depth_edges(blobs: DataFrame) -> DataFrame:
    def one(r) -> tuple:
        e = alignment.depth_edges(pixels(r))
        return r.scan_id, r.frame_index, None if e is None else np.packbits(e).tobytes(), int(r.width), int(r.height)

    schema = "scan_id string,frame_index int,edges binary,width int,height int"
    return blobs.where("stream = 'depth'").mapInPandas(_each(one, schema), schema).where("edges IS NOT NULL")


#: Frames on each side of one that its score looks at, and frames of a chunk; maps near an end of a chunk go to the next one too.
REACH, CHUNK = 3, 64


def in_chunks(rows: DataFrame, at: str, reach: int = REACH, chunk: int = CHUNK) -> DataFrame:
    """A row for each chunk of consecutive frames that may look at it: its own, and a neighbour's if it is within reach."""
    first, last = (F.floor((F.col(at) + d) / chunk).cast("long") for d in (-reach, reach))
    return rows.withColumn("chunk", F.explode(F.sequence(first, last)))


def offset_scores(pairs: DataFrame, luma: DataFrame, edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """scan_id, offset, score over all pairs (color_index, depth_index) whose colour frame has three on each side.

    A recording is dealt by chunks of frames, each map to its own and, within reach of an end, to the next: 1 + 2 * REACH / CHUNK times in all.
    A task slides over its chunk with the last few maps at hand, and gives sums."""
    maps = in_chunks(luma.select("scan_id", F.col("frame_index").alias("at"), F.lit(0).alias("kind"), F.col("gradient").alias("data"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height")), "at", REACH, chunk)
    of_pairs = pairs.select("scan_id", "color_index", "depth_index").join(edges.withColumnRenamed("frame_index", "depth_index"), ["scan_id", "depth_index"])
    asked = of_pairs.select("scan_id", F.col("color_index").cast("int").alias("at"), F.lit(1).alias("kind"), F.col("edges").alias("data"), "width", "height", F.floor(F.col("color_index") / chunk).cast("long").alias("chunk"))
    rows = maps.unionByName(asked).repartition("scan_id", "chunk").sortWithinPartitions("scan_id", "chunk", "at", "kind")

    def slide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, near, waiting, sums = None, {}, [], np.zeros((2, 2 * REACH + 1))

        def given() -> pd.DataFrame:
            at = np.flatnonzero(sums[1])
            return pd.DataFrame([(key[0], int(i) - REACH, float(sums[0][i]), int(sums[1][i])) for i in at], columns=["scan_id", "offset", "total", "n"])

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if key != (r.scan_id, r.chunk):
                    if key is not None:
                        yield given()
                    key, near, waiting, sums = (r.scan_id, r.chunk), {}, [], np.zeros((2, 2 * REACH + 1))
                if r.kind:
                    w, h = int(r.width), int(r.height)
                    waiting.append((r.at, np.unpackbits(np.frombuffer(r.data, dtype=np.uint8), count=w * h).reshape(h, w).astype(bool)))
                    continue
                near = {i: g for i, g in near.items() if i >= r.at - 2 * REACH} | {r.at: np.frombuffer(r.data, dtype="<f4")}
                # edges whose last neighbour this is, or could have been
                for at, e in [x for x in waiting if x[0] + REACH <= r.at]:
                    if all(at + o in near for o in range(-REACH, REACH + 1)):
                        for o, score in alignment.offset_scores(e, {o: near[at + o].reshape(e.shape) for o in range(-REACH, REACH + 1)}).items():
                            sums[:, o + REACH] += score, 1
                waiting = [x for x in waiting if x[0] + REACH > r.at]
        if key is not None:
            yield given()

    found = rows.mapInPandas(slide, "scan_id string, offset int, total double, n long").groupBy("scan_id", "offset").agg((F.sum("total") / F.sum("n")).alias("score"))
    # recordings with pairs have a row for each offset, also where nothing could be scored
    every = of_pairs.select("scan_id").distinct().withColumn("offset", F.explode(F.sequence(F.lit(-REACH), F.lit(REACH))))
    return every.join(found, ["scan_id", "offset"], "left")


def alignment_fits(pairs: DataFrame) -> DataFrame:
    """pairs: scan_id, camera, color and depth (rows of blobs), color_k, depth_k. The fit of each pair."""

    def one(r) -> tuple:
        c, d = pd.Series(r.color), pd.Series(r.depth)
        k = [[float(x[n]) for n in ("fx", "fy", "cx", "cy")] for x in (r.color_k, r.depth_k)]
        fit = alignment.fit_pair(image.planes(pixels(c))[0], pixels(d), k[0], k[1], r.camera)
        return (r.scan_id, *([None] * 6 if fit is None else [fit.k, fit.dx, fit.dy, fit.fattening_x, fit.fattening_y, fit.corr]))

    schema = "scan_id string,k double,dx double,dy double,fattening_x double,fattening_y double,corr double"
    return pairs.mapInPandas(_each(one, schema), schema).where("k IS NOT NULL")


def alignment_report(fits: DataFrame) -> DataFrame:
    """One row per recording; a recording has at most 40 fits."""

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [alignment.Fit(*map(float, r)) for r in pdf[["k", "dx", "dy", "fattening_x", "fattening_y", "corr"]].sort_values("k").to_numpy()]
        r = alignment.report(rows)
        names = ["frames", "k_median", "k_iqr", "dx_median", "dy_median", "fattening_x_median", "fattening_y_median", "corr_median", "aligned"]
        return pd.DataFrame([{"scan_id": pdf.scan_id.iloc[0], **{n: r[n] for n in names}, "dx_ci95": list(r["dx_median_ci95"]), "dy_ci95": list(r["dy_median_ci95"])}])

    schema = "scan_id string, frames int, k_median double, k_iqr double, dx_median double, dy_median double, fattening_x_median double, fattening_y_median double, corr_median double, aligned boolean, dx_ci95 array<double>, dy_ci95 array<double>"
    return fits.groupBy("scan_id").applyInPandas(of, schema)
