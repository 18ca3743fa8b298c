"""Result documents: nesting, serialising, the response envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAYOUT_TYPE = "array<struct<label:string,score:double,centerPoint:struct<x:int,y:int>>>"
ITEM_TYPE = "array<struct<id:int,centerPoint:struct<x:int,y:int>,text:string,isMatch:boolean>>"


def item_list(items: DataFrame, image: str) -> DataFrame:
    """(image, itemList) from rows (image, item) with item structs: ordered by their id, one shuffle by image."""
    return items.groupBy(image).agg(F.array_sort(F.collect_list("item")).alias("itemList"))


def result_document(unique_id: Column, layout: Column, items: Column) -> Column:
    """The result of one image; missing lists are empty, as for an image that can't be read."""
    empty = lambda value, kind: F.coalesce(value.cast(kind), F.array().cast(kind))
    return F.struct(unique_id.alias("uniqueId"), empty(layout, LAYOUT_TYPE).alias("layoutList"), empty(items, ITEM_TYPE).alias("itemList"))


def result_json(document: Column) -> Column:
    return F.to_json(document, {"ignoreNullFields": "false"})


def file_json(document: Column) -> Column:
    """What a result file holds: the lists without the id, which its folder names."""
    return F.to_json(F.struct(document["layoutList"].alias("layoutList"), document["itemList"].alias("itemList")), {"ignoreNullFields": "false"})


def envelope(stdout: Column, stderr: Column | None = None) -> Column:
    """The response text around a payload, which is itself text."""
    return F.to_json(F.struct(F.struct(stdout.alias("stdout"), (F.lit("") if stderr is None else stderr).alias("stderr")).alias("response")))


def error_document(message: Column) -> Column:
    return F.to_json(F.struct(message.alias("error")))


def input_path(base_name: Column, name: Column) -> Column:
    return F.concat(F.lit("input/"), base_name, F.lit("/"), name)


def output_path(unique_id: Column) -> Column:
    return F.concat(F.lit("output/"), unique_id, F.lit("/"))
