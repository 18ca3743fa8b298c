"""Box post-processing: layout gate, detection gates, reading order. One row per box, or arrays within one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import tensors as T

# Classes of the layout model.
LAYOUT_LABELS = {
    0: "paragraph_title",
    1: "image",
    2: "text",
    3: "number",
    4: "abstract",
    5: "content",
    6: "figure_title",
    7: "formula",
    8: "table",
    9: "reference",
    10: "doc_title",
    11: "footnote",
    12: "header",
    13: "algorithm",
    14: "footer",
    15: "seal",
    16: "chart",
    17: "formula_number",
    18: "aside_text",
    19: "reference_content",
}


def layout_label(class_id: Column) -> Column:
    """Label of a class, its number in digits where it has none."""
    known = F.create_map(*[F.lit(x) for pair in LAYOUT_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, class_id.cast("int")), class_id.cast("int").cast("string"))


def layout_boxes(rows: DataFrame) -> DataFrame:
    """Model rows (class_id, score, x1, y1, x2, y2, width, height and any keys) that pass the gate, with label, clamped
    corners and the centre. The order column of the model, if any, stays with its row."""
    for c, limit in (("x1", "width"), ("y1", "height"), ("x2", "width"), ("y2", "height")):
        rows = rows.withColumn(c, N.clamp(F.col(c), F.col(limit)))
    kept = rows.where((F.col("score") >= N.LAYOUT_SCORE) & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
    return kept.withColumn("label", layout_label(F.col("class_id"))).withColumn("center_x", N.center(F.col("x1"), F.col("x2"))).withColumn("center_y", N.center(F.col("y1"), F.col("y2")))


def detection_boxes(rows: DataFrame, image: str = "image_id", cap: int = N.MAX_CANDIDATES) -> DataFrame:
    """Candidates (contour_ord, side, score, box_width, box_height) of each image that pass the gates.

    The first `cap` contours are looked at; then short sides, weak boxes and sides still short after moving out by
    `distance` go. contour_ord counts from 0 within an image, so the cap is a filter and no sort.
    """
    kept = rows.where((F.col("contour_ord") < cap) & (F.col("side") >= N.MIN_SIDE) & (F.col("score") >= N.BOX_SCORE))
    kept = kept.withColumn("distance", N.unclip_distance(F.col("box_width"), F.col("box_height")))
    kept = kept.withColumn("side_after", F.least("box_width", "box_height") + 2 * F.col("distance"))
    return kept.where(F.col("side_after") >= N.MIN_SIDE_AFTER)


def scaled_point(x: Column, y: Column, image_width: Column, image_height: Column, map_width: Column, map_height: Column) -> tuple[Column, Column]:
    """A point of the probability map in the image."""
    return N.clamp(x * image_width / map_width, image_width), N.clamp(y * image_height / map_height, image_height)


def reading_order(boxes: DataFrame, image: str, y: str, x: str, tie: list[str]) -> DataFrame:
    """Boxes numbered from 1 within each image by the top left corner, rows first; equal ones in the order of `tie`."""
    order = Window.partitionBy(image).orderBy(y, x, *tie)
    return boxes.withColumn("id", F.row_number().over(order))


def items_from_arrays(points: Column, texts: Column, search: Column | None = None) -> Column:
    """Item structs of one image kept in one row: sorted by top left corner (ties in order), numbered, without shuffle."""
    placed = F.transform(F.arrays_zip(points.alias("points"), texts.alias("texts")), lambda z, i: F.struct(F.element_at(z["points"], 1)["y"].alias("y"), F.element_at(z["points"], 1)["x"].alias("x"), i.alias("i"), z["points"].alias("points"), z["texts"].alias("text")))
    return F.transform(F.array_sort(placed), lambda s, i: item_struct((i + 1).cast("int"), _center(s["points"], "x"), _center(s["points"], "y"), s["text"], F.lit(False)))


def _center(points: Column, axis: str) -> Column:
    found = F.transform(points, lambda p: p[axis])
    return N.center(F.array_min(found), F.array_max(found))


def item_struct(id_: Column, x: Column, y: Column, text: Column, matched: Column) -> Column:
    return F.struct(id_.alias("id"), F.struct(x.alias("x"), y.alias("y")).alias("centerPoint"), text.alias("text"), matched.alias("isMatch"))


def layout_struct(label: Column, score: Column, x: Column, y: Column) -> Column:
    return F.struct(label.alias("label"), score.cast("double").alias("score"), F.struct(x.alias("x"), y.alias("y")).alias("centerPoint"))


def decode_characters(rows: DataFrame, matrix: str, charset: list[str]) -> DataFrame:
    """rows with text and score decoded from a time x class matrix; charset starts with the blank and ends with the space."""
    steps = T.emitted(F.col(matrix))
    letters = F.array(*map(F.lit, charset))
    return rows.withColumn("_steps", steps).withColumn("text", T.decoded_text(F.col("_steps"), letters)).withColumn("text_score", T.mean_probability(F.col("_steps"))).drop("_steps")
