"""Lossless frame encoding: rows as differences from the row above, then raw DEFLATE."""

from __future__ import annotations

import zlib

import numpy as np


def inflate(stream: bytes) -> bytes:
    """The bytes of a raw DEFLATE stream that ends where its data end."""
    z = zlib.decompressobj(-15)
    raw = z.decompress(stream) + z.flush()
    if not z.eof or z.unused_data:
        raise ValueError("a stream does not end where its frame does")
    return raw


def deflate(raw: bytes, strategy: int = zlib.Z_DEFAULT_STRATEGY) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, -15, 9, strategy)
    return z.compress(raw) + z.flush()


def row_deltas(plane: np.ndarray) -> np.ndarray:
    """Each row but the first less the row above it, modulo 256."""
    out = plane.copy()
    out[1:] -= plane[:-1]
    return out


def undo_row_deltas(plane: np.ndarray) -> np.ndarray:
    return np.cumsum(plane, axis=0, dtype=np.uint8)


def encode_color(frame: np.ndarray, height: int) -> bytes:
    """A frame of height luma rows and half as many chroma rows; each plane starts with a whole row."""
    rows = np.concatenate([row_deltas(frame[:height]), row_deltas(frame[height:])])
    return deflate(rows.tobytes(), zlib.Z_RLE)


def decode_color(stream: bytes, width: int, height: int) -> np.ndarray:
    rows = np.frombuffer(inflate(stream), dtype=np.uint8)
    if rows.size != width * height * 3 // 2:
        raise ValueError(f"a colour frame has {rows.size} bytes, not {width * height * 3 // 2}")
    rows = rows.reshape(height * 3 // 2, width)
    return np.concatenate([undo_row_deltas(rows[:height]), undo_row_deltas(rows[height:])])


def encode_map(values: np.ndarray) -> bytes:
    return deflate(np.ascontiguousarray(values).tobytes())


def decode_map(stream: bytes, dtype: np.dtype, shape: tuple[int, int]) -> np.ndarray:
    raw = inflate(stream)
    if len(raw) != np.dtype(dtype).itemsize * shape[0] * shape[1]:
        raise ValueError(f"a map has {len(raw)} bytes, not those of {shape}")
    return np.frombuffer(raw, dtype=dtype).reshape(shape)
