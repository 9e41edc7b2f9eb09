"""Image kernels: fixed values, round trips, and recovery of a known misalignment."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parallaxis.kernels import alignment, codec, image


@given(st.integers(1, 6), st.integers(1, 6), st.integers(0, 2**32 - 1))
@settings(max_examples=30, deadline=None)
def test_codec_round_trip(h2, w2, seed):
    w, h = 2 * w2, 2 * h2
    frame = np.random.default_rng(seed).integers(0, 256, (h * 3 // 2, w), dtype=np.uint8)
    assert (codec.decode_color(codec.encode_color(frame, h), w, h) == frame).all()
    z = np.random.default_rng(seed).random((h, w)).astype("<f2")
    assert (codec.decode_map(codec.encode_map(z), "<f2", (h, w)) == z).all()


def test_inflate_refuses_more_or_less():
    s = codec.deflate(b"abc" * 50)
    for bad in (s + b"x", s[:-1]):
        with pytest.raises(Exception):  # noqa: B017
            codec.inflate(bad)


def test_colour_conversion():
    frame = np.full((3, 2), 128, dtype=np.uint8)
    frame[:2] = [[0, 255], [100, 101]]
    grey = image.to_bgr(frame, "ITU_R_601_4")
    assert (grey == frame[:2, :, None]).all()
    frame[2] = [0, 255]  # Cb, Cr
    red = image.to_bgr(frame, "ITU_R_709_2").astype(int)
    assert (red[..., 2] >= red[..., 0]).all() and red[0, 1, 2] == 255 and red[0, 0, 0] == 0


def test_turning_and_padding():
    a = np.arange(6).reshape(2, 3)
    assert image.upright(a, 90).tolist() == [[3, 0], [4, 1], [5, 2]]
    assert image.unpadded(bytes([1, 2, 9, 3, 4]), 2, 2, 3).tolist() == [[1, 2], [3, 4]]


def test_live_summary():
    assert image.live_summary(np.zeros((8, 8))) == (0.0, 0.0)
    z = np.zeros((8, 8))
    z[0, 0], z[0, 4] = 1.0, 2.0
    assert image.live_summary(z) == (0.5, 2.0)


def _scene(instant: int, w: int, h: int, s: int) -> np.ndarray:
    """0.6 m boxes before 2.4 m, at s pixels a depth pixel."""
    rng = np.random.default_rng(10 + instant)
    z = np.full((h * s, w * s), 2.4, dtype=np.float32)
    for _ in range(8):
        x, y = rng.integers(10, w - 30), rng.integers(10, h - 30)
        z[y * s : (y + rng.integers(10, 20)) * s, x * s : (x + rng.integers(10, 20)) * s] = 0.6
    return z


@pytest.mark.parametrize(("scale", "shift"), [(1.0, 0.0), (1.02, 0.0), (1.0, 0.5)])
def test_alignment_recovers_what_was_put_in(scale, shift):
    w, h, s = 128, 96, 4
    fits = []
    for i in range(10):
        big = _scene(i, w, h, s)
        luma = np.where(big < 1, 200, 60).astype(np.uint8)
        depth = big[s // 2 :: s, s // 2 :: s]
        color_k = [400.0, 400.0, 256.0, 192.0]
        depth_k = [100.0 * scale, 100.0 * scale, 64.0 + shift, 48.0]
        fits.append(alignment.fit_pair(luma, depth, color_k, depth_k, "front"))
    r = alignment.report(fits)
    assert abs(r["k_median"] - scale) <= 0.005
    assert abs(r["dx_median"] - shift) <= 0.2 and abs(r["dy_median"]) <= 0.2
    assert r["aligned"] == (scale == 1.0 and shift == 0.0)


def test_small_maps_are_not_compared():
    assert alignment.fit_pair(np.zeros((6, 8), np.uint8), np.ones((3, 4), np.float32), [7, 7, 4, 3], [3.5, 3.5, 2, 1.5], "front") is None
    assert not alignment.report([])["aligned"]


def test_canny_finds_a_step():
    a = np.zeros((20, 20), dtype=np.uint8)
    a[:, 10:] = 255
    e = image.canny(a, 40, 120)
    assert e[5].sum() == 1 and e[5, 9:11].any()


def test_preview_has_the_palette_at_fixed_ends():
    z = np.array([[0.2, 3.0, 0.1, 9.0], [np.nan, 0.0, np.inf, 1.6]], dtype=np.float32)
    shown = image.colourised(z)
    assert (shown[0, 0] == image.turbo(np.array(1.0))[::-1]).all() and (shown[0, 1] == image.turbo(np.array(0.0))[::-1]).all()
    assert (shown[0, 2] == shown[0, 0]).all() and (shown[0, 3] == shown[0, 1]).all()
    assert not shown[1, :3].any() and shown[1, 3].any()


def test_offset_scores_slide_over_chunks(spark):
    """As comparing each pair with its seven neighbours, whatever the chunks; each map travels little more than once."""
    from parallaxis.kernels import frames

    rng = np.random.default_rng(4)
    w, h = 24, 20
    maps = {s: [rng.random((h, w)).astype("<f4") * 4 for _ in range(n)] for s, n in (("a", 40), ("b", 6), ("c", 7))}
    gone = {("a", 11), ("a", 12)}  # frames that weren't kept
    luma = [(s, i, bytearray(m.tobytes())) for s, ms in maps.items() for i, m in enumerate(ms) if (s, i) not in gone]
    edges = {(s, i): rng.random((h, w)) < 0.2 for s, ms in maps.items() for i in range(len(ms))}
    pairs = [(s, c, d) for s, ms in maps.items() for c, d in zip(range(len(ms)), rng.permutation(len(ms)).tolist(), strict=True)] + [("a", 20, 3)]
    want = {}
    for s, c, d in pairs:
        near = {o: maps[s][c + o] for o in range(-3, 4) if 0 <= c + o < len(maps[s]) and (s, c + o) not in gone}
        if len(near) == 7:
            for o, v in alignment.offset_scores(edges[s, d], near).items():
                want.setdefault((s, o), []).append(v)
    p = spark.createDataFrame(pairs, "scan_id string, color_index int, depth_index int")
    m = spark.createDataFrame(luma, "scan_id string, frame_index int, gradient binary")
    e = spark.createDataFrame([(s, i, bytearray(np.packbits(x).tobytes()), w, h) for (s, i), x in edges.items()], "scan_id string, frame_index int, edges binary, width int, height int")
    for chunk in (1, 5, 64):
        got = {(r.scan_id, r.offset): r.score for r in frames.offset_scores(p, m, e, chunk).collect()}
        assert set(got) == {(s, o) for s in "abc" for o in range(-3, 4)}
        assert {k: v for k, v in got.items() if v is not None} == {k: pytest.approx(np.mean(v), rel=1e-5) for k, v in want.items()}
    long = spark.range(6400).selectExpr("'a' AS scan_id", "CAST(id AS INT) AS frame_index")
    assert frames.in_chunks(long, "frame_index").count() <= 1.1 * 6400
