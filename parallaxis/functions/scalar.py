"""Scalar functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sanitized(name: Column, most: int = 40) -> Column:
    """Characters outside [A-Za-z0-9_-] become `_`, one for one; at most so many are kept."""
    return F.left(F.regexp_replace(name, "[^A-Za-z0-9_-]", "_"), F.lit(most))


def scan_id(start: Column, camera: Column, name: Column) -> Column:
    """rgbd_<yyyyMMdd_HHmmss>_<camera>[_<name>]; a null or blank name is left out. The time is formatted in the session's zone."""
    given = entered(name)
    return F.concat_ws("_", F.lit("rgbd"), F.date_format(start, "yyyyMMdd_HHmmss"), camera, F.when(given.isNotNull(), sanitized(given)))


def entered(name: Column) -> Column:
    """A name without the white space and line ends around it; null if nothing is left."""
    space = r"[\p{Z}\x09-\x0D\x85]+"
    return F.nullif(F.regexp_replace(name, f"^{space}|{space}\\z", ""), F.lit(""))


def display_name(name: Column, start: Column, camera: Column) -> Column:
    """The name that was given, or else the start, in the session's zone, and which camera it was."""
    side = F.when(camera == "front", "Front").otherwise("Rear")
    return F.coalesce(entered(name), F.concat_ws(" ", F.date_format(start, "yyyy-MM-dd HH:mm:ss"), side))


def sha256(data: Column) -> Column:
    return F.sha2(data.cast("binary"), 256)


def is_sha256(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9a-f]{64}\\z"), F.lit(False))


def four_cc(code: Column) -> Column:
    """The four characters of a 32-bit code, highest byte first."""
    part = lambda shift: F.char(F.shiftright(code, shift).bitwiseAND(F.lit(255)))
    return F.concat(part(24), part(16), part(8), part(0))


def rounded_away(value: Column, digits: int = 5) -> Column:
    """Rounded to so many decimals, halves away from zero, in binary floating point."""
    scale = float(10**digits)
    return F.signum(value) * F.floor(F.abs(value * scale) + 0.5) / scale


def format_minor(version: Column) -> Column:
    """0..7 of `4.<minor>`; null for other texts."""
    return F.nullif(F.regexp_extract(version, "^4\\.([0-7])\\z", 1), F.lit("")).cast("int")


def segment_name(file: Column, index: Column) -> Column:
    return F.concat(file, F.lit("."), F.lpad(index.cast("string"), 6, "0"))


def is_segment(name: Column) -> Column:
    return name.rlike("\\.[0-9]{6}\\z")


def is_data_root(path: Column) -> Column:
    """An absolute path without `.` or `..` in it."""
    return F.coalesce(path.startswith("/") & ~F.exists(F.split(path, "/"), lambda p: p.isin(".", "..")), F.lit(False))


def is_depth(value: Column) -> Column:
    """Finite and above zero. NaN compares as the largest number in SQL, so it is named."""
    return F.coalesce((value > 0) & ~F.isnan(value) & (value < float("inf")), F.lit(False))


def cell(value: Column) -> Column:
    """A value of a text table: empty for null, 1 and 0 for booleans."""
    return F.coalesce(value.cast("string"), F.lit(""))


def flag(value: Column) -> Column:
    return F.when(value, "1").when(~value, "0").otherwise("")


#: What a list shows for a state of upload. {} is the step that an upload is in, or what it failed with.
UPLOAD_LABELS = {
    "not_uploaded": "not uploaded",
    "in_progress": "{}",
    "uploaded": "uploaded, checking the server stored it",
    "failed": "upload failed: {}",
    "kept_on_phone": "kept on this phone",
}


def upload_label(state: Column, detail: Column) -> Column:
    """What a list shows for a state of upload; null for a state that isn't known."""
    out = F.lit(None).cast("string")
    for k, label in UPLOAD_LABELS.items():
        out = F.when(state == k, F.replace(F.lit(label), F.lit("{}"), F.coalesce(detail, F.lit("")))).otherwise(out)
    return out


#: Names that recordings give to what a camera says.
DROP_REASONS = {"lateData": "late", "outOfBuffers": "out_of_buffers", "discontinuity": "discontinuity"}
TRACKING = {"normal": "normal", "notAvailable": "not_available"}
LIMITED = {"initializing": "limited_initializing", "excessiveMotion": "limited_excessive_motion", "insufficientFeatures": "limited_insufficient_features", "relocalizing": "limited_relocalizing"}


def _named(value: Column, names: dict[str, str]) -> Column:
    return F.get(F.array(*map(F.lit, names.values())), F.array_position(F.array(*map(F.lit, names)), value).cast("int") - 1)


def drop_reason(reason: Column) -> Column:
    """Why a frame was dropped; what isn't known is `unknown`, null is null."""
    return F.when(reason.isNotNull(), F.coalesce(_named(reason, DROP_REASONS), F.lit("unknown")))


def tracking_state(state: Column, reason: Column) -> Column:
    """normal, not_available or limited_<reason>; null for null, and an error for what isn't known."""
    name = F.when(state == "limited", _named(reason, LIMITED)).otherwise(_named(state, TRACKING))
    unknown = F.raise_error(F.concat(F.lit("unknown tracking state "), F.concat_ws(" ", state, reason))).cast("string")
    return F.when(state.isNull(), F.lit(None).cast("string")).when(name.isNotNull(), name).otherwise(unknown)


def can_start(state: Column) -> Column:
    """Whether an upload may begin: not while one is under way, and not of what stays on the phone."""
    return F.coalesce(state.isin("not_uploaded", "uploaded", "failed"), F.lit(False))


def orientation(degrees: Column, mirrored: Column) -> Column:
    """How a picture is shown that is turned clockwise by so much and then, if mirrored, flipped left to right: a flip after a
    quarter turn is that of the opposite quarter. Null for what is no multiple of 90."""
    plain = F.array(*map(F.lit, ("up", "right", "down", "left")))
    flipped = F.array(*map(F.lit, ("up_mirrored", "left_mirrored", "down_mirrored", "right_mirrored")))
    quarter = (F.pmod(degrees, F.lit(360)) / 90).cast("int")
    return F.when(F.pmod(degrees, F.lit(90)) == 0, F.get(F.when(mirrored, flipped).otherwise(plain), quarter))


def upload_key(upload_id: Column, own_id: Column) -> Column:
    return F.coalesce(upload_id, own_id)


def visible(target: Column, shown: Column) -> Column:
    """Whether a row is shown under a target; rows without one belong to the phone."""
    return F.coalesce(target, F.lit("phone")).eqNullSafe(F.coalesce(shown, F.lit("phone")))


def display_size(size: Column) -> Column:
    return F.when(size >= 1_000_000_000, F.format_string("%.2f GB", size / 1e9)).otherwise(F.format_string("%.1f MB", size / 1e6))


def display_duration(seconds: Column) -> Column:
    """Minutes and seconds, rounded to whole seconds with halves to even, minutes without a leading zero: 61.5 is 1:02."""
    whole = F.rint(seconds).cast("long")
    return F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))
