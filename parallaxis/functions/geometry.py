"""Camera geometry as columns. Single precision is kept after every operation, as devices compute it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TRACKING_STATES = ("normal", "not_available", "limited_initializing", "limited_excessive_motion", "limited_insufficient_features", "limited_relocalizing")
#: Four units in the last place of single precision.
FLOAT_TOLERANCE = 4 * 2.0**-23
ROTATION_TOLERANCE = 1e-4


def single(c: Column) -> Column:
    return c.cast("float")


def ratio(a: Column, b: Column) -> Column:
    return single(single(a) / single(b))


def plainly_scaled(k: Sequence[Column], sx: Column, sy: Column) -> list[Column]:
    """fx, fy, cx, cy times the scale of their axis, measured from the frame's corner."""
    fx, fy, cx, cy = k
    return [single(fx * sx), single(fy * sy), single(cx * sx), single(cy * sy)]


def grid_carried(k: Sequence[Column], sx: Column, sy: Column) -> list[Column]:
    """As plainly_scaled, but cy is carried between the centres of pixels: (cy + 0.5) * sy - 0.5."""
    fx, fy, cx, cy = k
    half = single(F.lit(0.5))
    return [single(fx * sx), single(fy * sy), single(cx * sx), single(single(single(cy + half) * sy) - half)]


def about_corner(c: Column, s: Column) -> Column:
    """A principal point that was carried about pixel centres, carried about the corner: c + (1 - s) / 2."""
    return single(c + single(single(F.lit(1.0) - s) * single(F.lit(0.5))))


def close(a: Column, b: Column, relative: float = FLOAT_TOLERANCE, absolute: float = 0.0) -> Column:
    """Whether a is b within a tolerance; no NaN is close to anything."""
    a, b = a.cast("double"), b.cast("double")
    return F.coalesce((F.abs(a - b) <= absolute + relative * F.abs(b)) & ~F.isnan(a) & ~F.isnan(b), F.lit(False))


def centre_carried(x: Column, size: Column, reference: Column) -> Column:
    """A distortion centre carried from the calibration's reference size to the image."""
    return single(x * ratio(size, reference))


def distortion(centre: Sequence[Column], lookup: Column, inverse: Column, size: Sequence[Column], reference: Sequence[Column]) -> Column:
    """The distortion of an image of this size out of a calibration: its centre carried to the image, the tables as they are, and the scale; null if a
    table is not there."""
    carried = F.array(*[centre_carried(c, s, r) for c, s, r in zip(centre, size, reference, strict=True)])
    scale = F.array(*[ratio(s, r) for s, r in zip(size, reference, strict=True)])
    whole = F.struct(carried.alias("center"), lookup.alias("lookup_table"), inverse.alias("inverse_lookup_table"), scale.alias("scale"))
    return F.when(lookup.isNotNull() & inverse.isNotNull(), whole)


def homogeneous(m: Column) -> Column:
    """A 3 x 4 matrix (array of rows) with the row 0 0 0 1."""
    last = F.array(*[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)])
    return F.concat(F.transform(m, lambda r: r.cast("array<double>")), F.array(last))


def row_major(columns: Column) -> Column:
    """An array of columns as an array of rows."""
    n = F.size(F.get(columns, F.lit(0)))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(columns, lambda c: F.get(c, i)))


def is_rotation(r: Sequence[Sequence[Column]], tolerance: float = ROTATION_TOLERANCE) -> Column:
    """Whether a 3 x 3 matrix of columns is orthonormal with determinant +1, within a tolerance: six dot products and a determinant."""
    ok = F.lit(True)
    for i in range(3):
        for j in range(i, 3):
            dot = r[i][0] * r[j][0] + r[i][1] * r[j][1] + r[i][2] * r[j][2]
            ok = ok & (F.abs(dot - (1.0 if i == j else 0.0)) <= tolerance)
    return F.coalesce(ok & (F.abs(determinant(r) - 1.0) < tolerance), F.lit(False))


def determinant(r: Sequence[Sequence[Column]]) -> Column:
    return (
        r[0][0] * (r[1][1] * r[2][2] - r[1][2] * r[2][1])
        - r[0][1] * (r[1][0] * r[2][2] - r[1][2] * r[2][0])
        + r[0][2] * (r[1][0] * r[2][1] - r[1][1] * r[2][0])
    )


def is_pose(state: Column, m: Column) -> Column:
    """A known tracking state and a 3 x 4 matrix (array of rows) whose rotation is one."""
    r = [[F.get(F.get(m, F.lit(i)), F.lit(j)).cast("double") for j in range(3)] for i in range(3)]
    return F.coalesce(state.isin(*TRACKING_STATES), F.lit(False)) & is_rotation(r)


def complete_calibration(lookup: Column, inverse: Column, width: Column, height: Column) -> Column:
    """Both tables present, of one length above zero, with positive reference dimensions."""
    return F.coalesce((F.size(lookup) == F.size(inverse)) & (F.size(lookup) > 0) & (width > 0) & (height > 0), F.lit(False))
