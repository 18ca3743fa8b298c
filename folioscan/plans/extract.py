"""The extraction dataflow: files to result documents, with pluggable models."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import normalize_value
from ..operators import boxes as B
from ..operators import files, results
from ..operators.pixels import crop_box, decode_steps, detection_tensor, layout_tensor, recognition_batches, text_boxes
from ..session import materialize
from ..sources.sinks import write_results

Image = np.ndarray


@dataclass(frozen=True)
class Models:
    """Functions that build what one worker needs, so that weights are loaded once in each.

    decode: bytes -> BGR image or None. layout: image inputs -> rows [class, score, x1, y1, x2, y2], or such rows and
    how many of them count. detection: tensor -> probability map. recognition: tensors of one width -> as many time x class matrices. All are built by calling the given builders.
    """

    decode: Callable[[], Callable[[bytes], Image | None]]
    layout: Callable[[], Callable[[dict], np.ndarray]]
    detection: Callable[[], Callable[[np.ndarray], np.ndarray]]
    recognition: Callable[[], Callable[[np.ndarray], np.ndarray]]
    charset: tuple[str, ...]


POINT = "struct<x:int,y:int>"
RAW = f"path string, unique_id string, width int, height int, layout array<array<double>>, detections array<struct<score:double,corners:array<{POINT}>,text:string,text_score:double>>, error string"


def infer(images: DataFrame, models: Models) -> DataFrame:
    """One row per image (path, unique_id, content) with model outputs; what can't be decoded has empty lists, and a failure its
    message in `error`, so one bad file never ends the job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode, layout, detection, recognition = models.decode(), models.layout(), models.detection(), models.recognition()
        for batch in batches:
            rows = []
            for path, unique_id, content in zip(batch["path"], batch["unique_id"], batch["content"]):
                row = [path, unique_id, None, None, [], [], None]
                try:
                    image = decode(content)
                    if image is not None:
                        height, width = image.shape[:2]
                        row[2:5] = [width, height, _rows(layout(layout_tensor(image)))]
                        row[5] = _read_boxes(image, detection, recognition, list(models.charset))
                except Exception as error:  # noqa: BLE001 the file is set aside with its message
                    row[6] = f"{type(error).__name__}: {error}"
                rows.append(row)
            yield pd.DataFrame(rows, columns=["path", "unique_id", "width", "height", "layout", "detections", "error"])

    return images.select("path", "unique_id", "content").mapInPandas(run, RAW)


def _rows(output) -> list[list[float]]:
    """The layout model's rows; with a count, so many of them."""
    rows, count = output if isinstance(output, tuple) else (output, None)
    return np.asarray(rows, float)[: None if count is None else int(count)].tolist()


def _read_boxes(image: Image, detection, recognition, charset: list[str]) -> list[dict]:
    boxes = text_boxes(detection(detection_tensor(image)), *image.shape[:2])
    crops = [crop_box(image, box["coordinate"]) for box in boxes]
    read = {i: ("", 0.0) for i, crop in enumerate(crops) if crop is None}
    whole = [i for i in range(len(crops)) if i not in read]
    for places, tensors in recognition_batches([crops[i] for i in whole]):
        for k, matrix in zip(places, recognition(tensors)):
            read[whole[k]] = decode_steps(np.asarray(matrix), charset)
    return [{"score": b["score"], "corners": [{"x": x, "y": y} for x, y in b["coordinate"]], "text": read[i][0], "text_score": read[i][1]} for i, b in enumerate(boxes)]


def documents(inferred: DataFrame, search: str) -> DataFrame:
    """path, unique_id, error, decoded and document of inferred images, one row each: gate, label, number and nest without a shuffle."""
    width, height = F.col("width"), F.col("height")

    def box(row):
        at = lambda i: F.get(row, F.lit(i))
        corner = [B.N.clamp(at(2), width), B.N.clamp(at(3), height), B.N.clamp(at(4), width), B.N.clamp(at(5), height)]
        return F.struct(at(0).alias("c"), at(1).alias("score"), *[c.alias(n) for c, n in zip(corner, ("x1", "y1", "x2", "y2"))])

    gated = F.filter(F.transform("layout", box), lambda b: (b["score"] >= B.N.LAYOUT_SCORE) & (b["x2"] > b["x1"]) & (b["y2"] > b["y1"]))
    layout = F.transform(gated, lambda b: B.layout_struct(B.layout_label(b["c"]), b["score"], B.N.center(b["x1"], b["x2"]), B.N.center(b["y1"], b["y2"])))
    items = B.items_from_arrays(F.transform("detections", lambda d: d["corners"]), F.transform("detections", lambda d: d["text"]))
    decoded = F.col("width").isNotNull() & F.col("error").isNull()
    rows = inferred.select("path", "unique_id", "error", decoded.alias("decoded"), layout.alias("layout"), items.alias("items"))
    matched = _match_array(F.transform("items", lambda i: i["text"]), search)
    rows = rows.withColumn("_m", matched)
    items = F.transform("items", lambda i, k: B.item_struct(i["id"], i["centerPoint"]["x"], i["centerPoint"]["y"], i["text"], F.get("_m", k)))
    document = results.result_document(F.col("unique_id"), F.col("layout"), items)
    return rows.select("path", "unique_id", "error", "decoded", document.alias("document"))


def _match_array(texts, search: str):
    needle = normalize_value(search)

    @F.pandas_udf("array<boolean>")
    def match(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else [bool(t) and search != "" and needle in normalize_value(t) for t in v])

    return match(texts)


def extract(images: DataFrame, models: Models, search: str, output: str | None = None) -> DataFrame:
    """path, unique_id, error, decoded, json and response of each image; with `output` also one result folder for each image
    that could be decoded."""
    done = documents(infer(images, models), search)
    out = done.select("path", "unique_id", "error", "decoded", results.result_json(F.col("document")).alias("json"), results.file_json(F.col("document")).alias("file"))
    out = out.withColumn("response", F.when(F.col("error").isNull(), results.envelope(F.col("json"))).otherwise(results.error_document(F.col("error"))))
    if output:
        out = materialize(out, "extracted")  # models run once, for the files and the rows
        write_results(out.where("decoded").select("unique_id", F.col("file").alias("json")), output)
    return out.drop("file")


def intake(parts: DataFrame, allowed: str, megabytes: str) -> DataFrame:
    """Requests that pass the checks, with the path their file is stored under and what is processed."""
    good = files.check_uploads(parts, allowed, megabytes).where("error = ''").select("request_id")
    chosen = files.chosen_parts(parts.join(good, "request_id", "left_semi"))
    return chosen.withColumn("path", results.input_path(T.base_name(F.col("stored")), T.file_name(F.col("stored"))))
