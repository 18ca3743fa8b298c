"""Numeric functions of boxes, tensors, sizes and ids. Rounding is half to even wherever the data model says round."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LAYOUT_SCORE = 0.3
PIXEL_THRESHOLD = 0.2
BOX_SCORE, MIN_SIDE, MIN_SIDE_AFTER = 0.45, 3, 5
UNCLIP = 1.4
MAX_CANDIDATES = 3000
DETECTION_SIDE, DETECTION_CAP, DETECTION_STEP = 960, 4000, 32
RECOGNITION_HEIGHT, RECOGNITION_WIDTH, RECOGNITION_CAP = 48, 320, 3200


def round_even(value: Column) -> Column:
    return F.rint(value).cast("int")


def center(low: Column, high: Column) -> Column:
    return round_even((low + high) / 2)


def clamp(value: Column, limit: Column) -> Column:
    """Rounded and held between 0 and limit, both included."""
    return F.greatest(F.lit(0), F.least(round_even(value), limit.cast("int")))


def detection_size(height: Column, width: Column) -> tuple[Column, Column]:
    """(height, width) of the detector's input: long side within the limit, both multiples of the step."""
    ratio = F.when(F.greatest(height, width) > DETECTION_SIDE, F.lit(float(DETECTION_SIDE)) / F.when(height > width, height).otherwise(width)).otherwise(F.lit(1.0))

    def fit(side: Column) -> Column:
        return F.greatest(F.lit(DETECTION_STEP), (F.rint(F.floor(side * ratio) / DETECTION_STEP) * DETECTION_STEP).cast("int"))

    return fit(height), fit(width)


def recognition_size(height: Column, width: Column) -> tuple[Column, Column]:
    """(target width, resized width) of a crop for the recogniser."""
    ratio = F.greatest(F.lit(RECOGNITION_WIDTH / RECOGNITION_HEIGHT), width / height)
    target = F.floor(RECOGNITION_HEIGHT * ratio).cast("int")
    resized = F.least(F.ceil(RECOGNITION_HEIGHT * width / height).cast("int"), target)
    over = target > RECOGNITION_CAP
    return F.when(over, RECOGNITION_CAP).otherwise(target), F.when(over, RECOGNITION_CAP).otherwise(resized)


def unclip_distance(width: Column, height: Column) -> Column:
    """How far a rectangle's sides move out: area times the ratio over the perimeter."""
    return width * height * UNCLIP / (2 * (width + height))


def human_size(count: Column) -> Column:
    """Bytes with their unit; from KB on one decimal, ties away from zero."""
    out = F.concat(count.cast("long").cast("string"), F.lit(" B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        size = 1024**power
        out = F.when(count >= size, F.format_string(f"%.1f {unit}", count.cast("double") / size)).otherwise(out)
    return out


def unique_id(millis: Column, random_part: Column) -> Column:
    """Base 36 of the time and of a random unsigned 32-bit number, which the caller gives."""
    return F.concat(base36(millis), F.lit("-"), base36(random_part))


def base36(number: Column) -> Column:
    return F.lower(F.conv(number.cast("string"), 10, 36))


def byte_limit(megabytes: Column) -> Column:
    """Whole number at the start of a text, as bytes; null where there is none."""
    return F.nullif(F.regexp_extract(megabytes, r"^\s*([+-]?\d+)", 1), F.lit("")).cast("long") * 1048576


def size_allowed(size: Column, megabytes: Column) -> Column:
    """Whether a size stays within the limit: an unknown size does, an unreadable limit lets nothing through."""
    limit = byte_limit(megabytes)
    return limit.isNotNull() & F.coalesce(size <= limit, F.lit(True))


def number_text(value: Column) -> Column:
    """en-US decimal form: grouped, at most three decimals."""
    return F.call_function("format_number", value, F.lit("#,##0.###"))


def date_text(time: Column, day: bool = True, clock: bool = True) -> Column:
    """ja-JP form: numeric date and 24-hour clock."""
    parts = [p for p, on in (("yyyy/M/d", day), ("HH:mm:ss", clock)) if on]
    return F.date_format(time, " ".join(parts)) if parts else F.year(time).cast("string")


def elapsed_seconds(began: Column, ended: Column) -> Column:
    """Seconds between two times, to three decimals."""
    return F.round((F.unix_micros(ended) - F.unix_micros(began)) / 1e6, 3)
