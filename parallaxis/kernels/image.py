"""Image kernels in numpy: colour conversion, turning, gradients, edges, resizing, resampling."""

from __future__ import annotations

import numpy as np

#: Kr and Kb of each conversion matrix by its name.
MATRICES = {"ITU_R_601_4": (0.299, 0.114), "ITU_R_709_2": (0.2126, 0.0722)}


def planes(frame: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Luma (h, w) and chroma (h/2, w/2, 2) of a frame of h * 3/2 rows."""
    rows, width = frame.shape
    if rows % 3 or width % 2:
        raise ValueError(f"a frame can't be {rows} x {width}")
    h = rows * 2 // 3
    return frame[:h], frame[h:].reshape(h // 2, width // 2, 2)


def to_bgr(frame: np.ndarray, matrix: str) -> np.ndarray:
    """8-bit BGR of a full-range frame; every chroma pair covers 2 x 2 pixels. Halves are rounded to even."""
    kr, kb = MATRICES[matrix]
    luma, chroma = planes(frame)
    y = luma.astype(np.float64)
    cb, cr = (np.kron(chroma[:, :, i].astype(np.float64) - 128, np.ones((2, 2))) for i in (0, 1))
    red, blue = y + 2 * (1 - kr) * cr, y + 2 * (1 - kb) * cb
    green = (y - kr * red - kb * blue) / (1 - kr - kb)
    return np.clip(np.rint(np.dstack([blue, green, red])), 0, 255).astype(np.uint8)


def upright(image: np.ndarray, degrees: int) -> np.ndarray:
    """Turned clockwise by a multiple of 90 degrees."""
    if degrees % 90:
        raise ValueError(f"{degrees} degrees aren't a quarter turn")
    return np.ascontiguousarray(np.rot90(image, -(degrees // 90)))


def unpadded(data: bytes, width_bytes: int, rows: int, stride: int) -> np.ndarray:
    """Rows of width_bytes out of rows of stride bytes; the last row may be cut short at its width."""
    if stride < width_bytes:
        raise ValueError("rows overlap")
    raw = np.zeros(rows * stride, dtype=np.uint8)
    got = np.frombuffer(data, dtype=np.uint8)[: rows * stride]
    raw[: len(got)] = got
    return raw.reshape(rows, stride)[:, :width_bytes].copy()


def is_valid(depth: np.ndarray) -> np.ndarray:
    return np.isfinite(depth) & (depth > 0)


def metres(depth: np.ndarray) -> np.ndarray:
    return depth.astype(np.float32)


def _padded(a: np.ndarray, n: int) -> np.ndarray:
    """Reflected at the edges, without the edge itself; where an axis is too short for that, repeated."""
    mode = "reflect" if min(a.shape) > n else "edge"
    return np.pad(a, n, mode=mode)


def sobel(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """3 x 3 gradients along x and y."""
    p = _padded(a.astype(np.float32), 1)
    right, left = p[:, 2:], p[:, :-2]
    dx = right - left
    dy = p[2:] - p[:-2]
    x = dx[:-2] + 2 * dx[1:-1] + dx[2:]
    y = dy[:, :-2] + 2 * dy[:, 1:-1] + dy[:, 2:]
    return x, y


def blur(a: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur with a kernel of four standard deviations on each side."""
    n = max(1, round(sigma * 4))
    w = np.exp(-0.5 * (np.arange(-n, n + 1) / sigma) ** 2).astype(np.float32)
    w /= w.sum()
    p = _padded(a.astype(np.float32), n)
    rows = sum(w[i] * p[i : i + a.shape[0]] for i in range(2 * n + 1))
    return sum(w[i] * rows[:, i : i + a.shape[1]] for i in range(2 * n + 1))


def area_resized(a: np.ndarray, width: int, height: int) -> np.ndarray:
    """Each new pixel is the mean of the area it covers, rounded."""

    def weights(n: int, m: int) -> np.ndarray:
        edges = np.linspace(0, n, m + 1)
        i = np.arange(n)
        over = np.minimum(edges[1:, None], i + 1) - np.maximum(edges[:-1, None], i)
        w = np.clip(over, 0, None)
        return w / w.sum(axis=1, keepdims=True)

    out = weights(a.shape[0], height) @ a.astype(np.float64) @ weights(a.shape[1], width).T
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def dilated(mask: np.ndarray, n: int = 1) -> np.ndarray:
    p = np.pad(mask, n, constant_values=False)
    size = 2 * n + 1
    out = np.zeros_like(mask)
    for i in range(size):
        for j in range(size):
            out |= p[i : i + mask.shape[0], j : j + mask.shape[1]]
    return out


def eroded(mask: np.ndarray, n: int) -> np.ndarray:
    """What lies beyond the image doesn't shrink the mask."""
    return ~dilated(~mask, n)


def canny(a: np.ndarray, low: float, high: float) -> np.ndarray:
    """Edges of an 8-bit image: local maxima of |gx| + |gy| along the gradient, above high or joined to such."""
    gx, gy = sobel(a)
    size = np.abs(gx) + np.abs(gy)
    p = np.pad(size, 1)
    shift = lambda di, dj: p[1 + di : p.shape[0] - 1 + di, 1 + dj : p.shape[1] - 1 + dj]
    flat, steep = np.abs(gy) <= np.abs(gx) * np.tan(np.pi / 8), np.abs(gy) >= np.abs(gx) * np.tan(3 * np.pi / 8)
    same = (gx * gy) >= 0
    before = np.select([flat, steep, same], [shift(0, -1), shift(-1, 0), shift(-1, -1)], shift(-1, 1))
    after = np.select([flat, steep, same], [shift(0, 1), shift(1, 0), shift(1, 1)], shift(1, -1))
    ridge = (size > before) & (size >= after)
    weak, edge = ridge & (size > low), ridge & (size > high)
    while True:
        grown = weak & dilated(edge)
        if (grown == edge).all():
            return edge
        edge = grown


def resampled(a: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear samples of a at (x, y); zero beyond it. Places are rounded to 1/32 pixel."""
    x, y = np.rint(x.astype(np.float64) * 32) / 32, np.rint(y.astype(np.float64) * 32) / 32
    p = np.pad(a.astype(np.float32), 1)
    i, j = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - i).astype(np.float32), (x - j).astype(np.float32)
    inside = (i >= -1) & (i < a.shape[0]) & (j >= -1) & (j < a.shape[1])
    i, j = np.where(inside, i, -1) + 1, np.where(inside, j, -1) + 1
    out = (1 - fy) * ((1 - fx) * p[i, j] + fx * p[i, j + 1]) + fy * ((1 - fx) * p[i + 1, j] + fx * p[i + 1, j + 1])
    return np.where(inside, out, 0).astype(np.float32)


def letterboxed(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Scaled by the nearest pixel to fit, centred on black."""
    h, w = image.shape[:2]
    scale = min(width / w, height / h)
    nw, nh = max(1, round(w * scale)), max(1, round(h * scale))
    small = image[(np.arange(nh) * h // nh)][:, (np.arange(nw) * w // nw)]
    out = np.zeros((height, width, *image.shape[2:]), dtype=image.dtype)
    top, left = (height - nh) // 2, (width - nw) // 2
    out[top : top + nh, left : left + nw] = small
    return out


#: The published polynomials of the turbo colour map, lowest power first, of red, green and blue.
TURBO = (
    (0.13572138, 4.61539260, -42.66032258, 132.13108234, -152.94239396, 59.28637943),
    (0.09140261, 2.19418839, 4.84296658, -14.18503333, 4.27729857, 2.82956604),
    (0.10667330, 12.64194608, -60.58204836, 110.36276771, -89.90310912, 27.34824973),
)
#: Height of a legend, the rows of its ramp and of its ticks, what is left free on either side, and how many ticks there are.
LEGEND_ROWS, LEGEND_RAMP, LEGEND_TICKS, LEGEND_MARGIN, TICKS = 32, slice(4, 20), slice(20, 27), 8, 5


def turbo(share: np.ndarray) -> np.ndarray:
    """8-bit BGR of shares from 0 to 1, in 256 steps."""
    t = np.floor(np.clip(share, 0, 1) * 255) / 255
    red, green, blue = (np.polynomial.polynomial.polyval(t, c) for c in TURBO)
    return np.clip(np.rint(255 * np.stack([blue, green, red], axis=-1)), 0, 255).astype(np.uint8)


def stretched(depth: np.ndarray, low: float, high: float) -> np.ndarray:
    """8-bit BGR of depth between two ends, whatever lies beyond as the ends; invalid pixels are black."""
    ok = is_valid(depth)
    out = turbo((np.where(ok, depth, low).astype(np.float64) - low) / max(high - low, 1e-9))
    out[~ok] = 0
    return out


#: The depths that a preview shows, in metres.
PREVIEW_M = (0.2, 3.0)


def colourised(depth: np.ndarray, near: float = PREVIEW_M[0], far: float = PREVIEW_M[1]) -> np.ndarray:
    """A preview of depth, 8-bit RGB: near warm, far cool by the palette of 256 steps, invalid pixels black."""
    ok = is_valid(depth)
    near, far = np.float32(near), np.float32(far)
    out = turbo(1 - (np.where(ok, depth, near).astype(np.float32) - near) / (far - near))[..., ::-1].copy()
    out[~ok] = 0
    return out


def legend(width: int) -> np.ndarray:
    """A ramp of colours with even ticks, the first and the last at its ends; what these stand for is for the caller to say."""
    out = np.full((LEGEND_ROWS, width, 3), 255, dtype=np.uint8)
    left, n = min(LEGEND_MARGIN, (width - 1) // 2), max(1, width - 2 * LEGEND_MARGIN)
    out[LEGEND_RAMP, left : left + n] = turbo(np.linspace(0, 1, n))
    out[LEGEND_TICKS, left + np.rint(np.linspace(0, n - 1, TICKS)).astype(int)] = 0
    return out


def fitted(image: np.ndarray, box: int) -> np.ndarray:
    """As letterboxed() in a square; what is shrunk is averaged."""
    h, w = image.shape[:2]
    scale = box / max(h, w)
    if scale < 1:
        image = np.dstack([area_resized(image[:, :, i], max(1, round(w * scale)), max(1, round(h * scale))) for i in range(image.shape[2])])
    return letterboxed(image, box, box)


def panel(color: np.ndarray | None, depth: np.ndarray | None, degrees: int, low: float, high: float, box: int) -> np.ndarray:
    """8-bit BGR: a colour frame (BGR) beside its depth map, both upright, over the legend; black where there is none."""
    left = np.zeros((box, box, 3), dtype=np.uint8) if color is None else fitted(upright(color, degrees), box)
    right = np.zeros_like(left) if depth is None else letterboxed(upright(stretched(depth, low, high), degrees), box, box)
    return np.vstack([np.hstack([left, right]), legend(2 * box)])


def live_summary(depth: np.ndarray, step: int = 4) -> tuple[float, float]:
    """(valid share, upper median) of every step-th pixel of every step-th row; zeros without a valid one."""
    some = depth[::step, ::step]
    ok = np.sort(some[is_valid(some)])
    return (0.0, 0.0) if not ok.size else (ok.size / some.size, float(ok[ok.size // 2]))
