"""Functions over array columns: thresholds, normalisation, argmax, character decoding, polygons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import PIXEL_THRESHOLD


def binarize(values: Column, threshold: float = PIXEL_THRESHOLD) -> Column:
    """1 where a float is above the threshold, compared as floats."""
    level = F.lit(threshold).cast("float")
    return F.transform(values, lambda p: (p > level).cast("int"))


def normalize_and_pad(values: Column, width: int) -> Column:
    """(v / 255 - 0.5) / 0.5 for each value, zeros on the right up to width."""
    scaled = F.transform(values, lambda v: (v.cast("double") / 255 - 0.5) / 0.5)
    return F.concat(scaled, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(width) - F.size(values))))


def argmax(values: Column) -> Column:
    """Place of the first largest value, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def rows_of(values: Column, width: int) -> Column:
    """A flat array as rows of the given width."""
    return F.transform(F.sequence(F.lit(0), (F.size(values) / width).cast("int") - 1), lambda i: F.slice(values, i * width + 1, F.lit(width)))


def emitted(matrix: Column) -> Column:
    """(index, p) of the steps of a time x class matrix that emit a character: not blank (0) and not the
    index of the step before. The steps meet a copy of themselves moved by one, so the work grows with their number."""
    best = F.transform(matrix, lambda r: F.struct(argmax(r).alias("index"), F.array_max(r).alias("p")))
    before = F.concat(F.array(F.lit(-1)), F.transform(matrix, argmax))
    beside = F.zip_with(best, before, lambda s, k: F.struct(s["index"].alias("index"), s["p"].alias("p"), k.alias("before")))
    kept = F.filter(beside, lambda s: s["index"].isNotNull() & (s["index"] != 0) & (s["index"] != s["before"]))
    return F.transform(kept, lambda s: F.struct(s["index"].alias("index"), s["p"].alias("p")))


def decoded_text(steps: Column, charset: Column) -> Column:
    return F.array_join(F.transform(steps, lambda s: F.element_at(charset, s["index"] + 1)), "")


def mean_probability(steps: Column) -> Column:
    """Mean probability of the emitted steps; 0 without any."""
    total = F.aggregate(steps, F.lit(0.0), lambda a, s: a + s["p"].cast("double"))
    return F.when(F.size(steps) > 0, total / F.size(steps)).otherwise(F.lit(0.0))


def corners(points: Column) -> Column:
    """Four (x, y) points as top left, top right, bottom right, bottom left.

    Sorted by x (equal ones as they come), the first two are the left side and the last two the right; in each the
    first is the upper one only if the second lies below it.
    """
    placed = F.transform(points, lambda p, i: F.struct(p["x"].alias("x"), i.alias("i"), p["y"].alias("y")))

    def pick(s: Column) -> Column:
        at = lambda i: F.struct(F.get(s, F.lit(i))["x"].alias("x"), F.get(s, F.lit(i))["y"].alias("y"))
        left, right = at(1)["y"] > at(0)["y"], at(3)["y"] > at(2)["y"]
        top_left, bottom_left = F.when(left, at(0)).otherwise(at(1)), F.when(left, at(1)).otherwise(at(0))
        top_right, bottom_right = F.when(right, at(2)).otherwise(at(3)), F.when(right, at(3)).otherwise(at(2))
        return F.array(top_left, top_right, bottom_right, bottom_left)

    # An array of one holds the sorted points, so that they are sorted once for all eight uses.
    return F.get(F.transform(F.array(F.array_sort(placed)), pick), F.lit(0))
