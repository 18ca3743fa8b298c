"""Registered queries over the operators, each with its SQL.

The tables hold no images, so boxes, tensors, uploads and requests are derived from their columns by fixed
arithmetic; the SQL states the same arithmetic on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import numbers as N
from .functions import tensors as A
from .functions import text as T
from .operators import boxes as B
from .operators import files as FI
from .operators import requests as R
from .operators import results as RE
from .sources import readers as S
from .sources import sinks as K

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

PHRASE = "on the"
ALLOWED = "text/html,application/pdf,image/png"
NOW = "2024-06-01 00:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MATCH_SQL = r"""text <> '' AND contains(replace(replace(lower(trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), 'ß', 'ss'), ' ', ''), 'onthe')"""


@query(f"SELECT doc_id, coalesce({MATCH_SQL}, false) AS is_match FROM documents")
def text_match(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.is_match(F.col("text"), PHRASE).alias("is_match"))


@query("SELECT conv_id, turn, coalesce(text <> '', false) AS is_match FROM conversations")
def text_match_blank_search(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_match(F.col("text"), " ").alias("is_match"))


@query("SELECT item_id, false AS is_match FROM benchmark")
def text_match_empty_search(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.is_match(F.col("text"), "").alias("is_match"))


def _boxes(spark, sf_dir):
    """Line items as boxes of the image that is their order."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image_id"),
        F.col("l_linenumber").alias("ord"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_partkey") % 23).cast("int").alias("class_id"),
        (F.col("l_discount") * 10).alias("score"),
        (F.col("l_partkey") % 1000 - 20).cast("double").alias("x1"),
        (F.col("l_suppkey") % 1000 - 20).cast("double").alias("y1"),
        (F.col("l_partkey") % 1000 - 20 + F.col("l_quantity") * 1.5 - 10).alias("x2"),
        (F.col("l_suppkey") % 1000 - 20 + F.col("l_linenumber") * 6.5).alias("y2"),
        F.lit(800).alias("width"),
        F.lit(90).alias("height"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"),
    )


BOXES_SQL = """b AS (SELECT l_orderkey AS image_id, l_linenumber AS ord, (l_partkey % 23)::INT AS class_id, l_discount * 10 AS score,
    l_quantity AS quantity, (l_partkey % 1000 - 20)::DOUBLE AS x1, (l_suppkey % 1000 - 20)::DOUBLE AS y1,
    l_partkey % 1000 - 20 + l_quantity * 1.5::DOUBLE - 10 AS x2, l_suppkey % 1000 - 20 + l_linenumber * 6.5::DOUBLE AS y2,
    l_partkey AS part, l_suppkey AS supp FROM lineitem)"""


@query(f"WITH {BOXES_SQL} SELECT image_id, ord, part, supp, row_number() OVER (PARTITION BY image_id ORDER BY supp, part, ord, quantity) AS id FROM b")
def item_reading_order(spark, sf_dir):
    boxes = B.reading_order(_boxes(spark, sf_dir), "image_id", "supp", "part", ["ord", "quantity"])
    return boxes.select("image_id", "ord", "part", "supp", F.col("id").cast("long").alias("id"))


@query(f"WITH {BOXES_SQL} SELECT image_id, ord, part, round_even((x1 + x2) / 2, 0)::INT AS cx, round_even((y1 + y2) / 2, 0)::INT AS cy FROM b")
def center_point(spark, sf_dir):
    return _boxes(spark, sf_dir).select("image_id", "ord", "part", N.center(F.col("x1"), F.col("x2")).alias("cx"), N.center(F.col("y1"), F.col("y2")).alias("cy"))


LABELS_SQL = "(VALUES " + ", ".join(f"({k}, '{v}')" for k, v in B.LAYOUT_LABELS.items()) + ") AS l(k, label)"
CLAMPED_SQL = """c AS (SELECT image_id, ord, part, class_id, score, greatest(0, least(round_even(x1, 0)::INT, 800)) AS x1, greatest(0, least(round_even(y1, 0)::INT, 90)) AS y1,
    greatest(0, least(round_even(x2, 0)::INT, 800)) AS x2, greatest(0, least(round_even(y2, 0)::INT, 90)) AS y2 FROM b)"""


@query(
    f"""WITH {BOXES_SQL}, {CLAMPED_SQL} SELECT image_id, ord, part, coalesce(label, class_id::VARCHAR) AS label, score,
    round_even((x1 + x2) / 2, 0)::INT AS center_x, round_even((y1 + y2) / 2, 0)::INT AS center_y
    FROM c LEFT JOIN {LABELS_SQL} ON k = class_id WHERE score >= 0.3::DOUBLE AND x2 > x1 AND y2 > y1"""
)
def layout_gate(spark, sf_dir):
    return B.layout_boxes(_boxes(spark, sf_dir)).select("image_id", "ord", "part", "label", "score", "center_x", "center_y")


@query(f"WITH {BOXES_SQL} SELECT image_id, ord, part, greatest(0, least(round_even(x2 * 640 / 320, 0)::INT, 640)) AS px, greatest(0, least(round_even(y2 * 480 / 160, 0)::INT, 480)) AS py FROM b")
def clamp_scale(spark, sf_dir):
    x, y = B.scaled_point(F.col("x2"), F.col("y2"), F.lit(640), F.lit(480), F.lit(320), F.lit(160))
    return _boxes(spark, sf_dir).select("image_id", "ord", "part", x.alias("px"), y.alias("py"))


@query(
    """WITH r AS (SELECT l_orderkey AS image_id, l_partkey AS part, l_linenumber AS ord,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS contour_ord,
        least(l_quantity, l_linenumber * 2) AS side, l_discount * 10 AS score, l_quantity AS w, l_linenumber * 2 AS h FROM lineitem),
    d AS (SELECT *, w * h * 1.4::DOUBLE / (2 * (w + h)) AS distance FROM r WHERE contour_ord < 5 AND side >= 3 AND score >= 0.45::DOUBLE)
    SELECT image_id, part, ord, contour_ord, round(distance, 6) AS distance, round(least(w, h) + 2 * distance, 6) AS side_after FROM d WHERE least(w, h) + 2 * distance >= 5"""
)
def detection_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image_id"), F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("ord"), F.col("l_suppkey").alias("supp"),
        F.col("l_quantity").alias("box_width"), (F.col("l_linenumber") * 2).alias("box_height"), (F.col("l_discount") * 10).alias("score"),
    )
    rows = B.reading_order(rows, "image_id", "ord", "part", ["supp", "box_width"]).withColumn("contour_ord", (F.col("id") - 1).cast("long"))
    kept = B.detection_boxes(rows.withColumn("side", F.least("box_width", "box_height")), cap=5)
    return kept.select("image_id", "part", "ord", "contour_ord", F.round("distance", 6).alias("distance"), F.round("side_after", 6).alias("side_after"))


def _points():
    a, b, c = F.col("l_partkey") % 50, F.col("l_suppkey") % 40, F.col("l_linenumber")
    made = [(a, b), (a + c * 5, b + 1), (a + 3, b + c), (b, a)]
    return F.array(*[F.struct(x.cast("int").alias("x"), y.cast("int").alias("y")) for x, y in made])


@query(
    """WITH p AS (SELECT l_orderkey AS image_id, l_linenumber AS ord, l_partkey AS part, (l_partkey % 50)::INT AS a, (l_suppkey % 40)::INT AS b, l_linenumber AS c FROM lineitem),
    q AS (SELECT image_id, ord, part, list_sort([{'x': a, 'i': 0, 'y': b}, {'x': a + c * 5, 'i': 1, 'y': b + 1}, {'x': a + 3, 'i': 2, 'y': b + c}, {'x': b, 'i': 3, 'y': a}]) AS s FROM p)
    SELECT image_id, ord, part,
        CASE WHEN s[2].y > s[1].y THEN s[1].x ELSE s[2].x END::INT AS tl_x, CASE WHEN s[2].y > s[1].y THEN s[1].y ELSE s[2].y END::INT AS tl_y,
        CASE WHEN s[4].y > s[3].y THEN s[3].x ELSE s[4].x END::INT AS tr_x, CASE WHEN s[4].y > s[3].y THEN s[4].x ELSE s[3].x END::INT AS br_x,
        CASE WHEN s[2].y > s[1].y THEN s[2].y ELSE s[1].y END::INT AS bl_y FROM q"""
)
def corner_order(spark, sf_dir):
    c = A.corners(_points())
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("ord"), F.col("l_partkey").alias("part"), c.alias("c"))
    at = lambda i, f: F.element_at("c", i)[f]
    return rows.select("image_id", "ord", "part", at(1, "x").alias("tl_x"), at(1, "y").alias("tl_y"), at(2, "x").alias("tr_x"), at(3, "x").alias("br_x"), at(4, "y").alias("bl_y"))


@query(
    """WITH d AS (SELECT doc_id, n_chars % 5000 + 1 AS h, n_chars % 977 + 1 AS w FROM documents),
    r AS (SELECT *, CASE WHEN greatest(h, w) > 960 THEN 960.0::DOUBLE / (CASE WHEN h > w THEN h ELSE w END) ELSE 1.0::DOUBLE END AS ratio FROM d)
    SELECT doc_id, greatest(32, (round_even(floor(h * ratio) / 32, 0) * 32)::INT) AS height, greatest(32, (round_even(floor(w * ratio) / 32, 0) * 32)::INT) AS width FROM r"""
)
def resize_detection(spark, sf_dir):
    height, width = N.detection_size(F.col("n_chars") % 5000 + 1, F.col("n_chars") % 977 + 1)
    return table(spark, sf_dir, "documents").select("doc_id", height.alias("height"), width.alias("width"))


@query(
    """WITH d AS (SELECT doc_id, (n_chars % 100 + 1)::DOUBLE AS h, (n_chars % 9001 + 1)::DOUBLE AS w FROM documents),
    t AS (SELECT *, floor(48 * greatest(320::DOUBLE / 48, w / h))::INT AS target FROM d)
    SELECT doc_id, CASE WHEN target > 3200 THEN 3200 ELSE target END AS target, CASE WHEN target > 3200 THEN 3200 ELSE least(ceil(48 * w / h)::INT, target) END AS resized FROM t"""
)
def resize_recognition(spark, sf_dir):
    target, resized = N.recognition_size((F.col("n_chars") % 100 + 1).cast("double"), (F.col("n_chars") % 9001 + 1).cast("double"))
    return table(spark, sf_dir, "documents").select("doc_id", target.alias("target"), resized.alias("resized"))


@query("SELECT vec_id, len(list_filter(embedding, lambda p: p > 0.2::FLOAT))::BIGINT AS n_set FROM embeddings")
def binary_threshold(spark, sf_dir):
    mask = A.binarize(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.aggregate(mask, F.lit(0).cast("long"), lambda a, b: a + b).alias("n_set"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: (v::DOUBLE / 255 - 0.5) / 0.5)), 6) AS total, 80::BIGINT AS width FROM embeddings")
def tensor_normalize(spark, sf_dir):
    padded = A.normalize_and_pad(F.col("embedding"), 80)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", padded.alias("t"))
    return rows.select("vec_id", F.round(F.aggregate("t", F.lit(0.0), lambda a, b: a + b), 6).alias("total"), F.size("t").cast("long").alias("width"))


@query("SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS best FROM embeddings")
def argmax(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", A.argmax(F.col("embedding")).alias("best"))


CHARSET = [S.BLANK, "a", "b", "c", "d", "e", "f", S.SPACE]


@query(
    """WITH r AS (SELECT vec_id, list_transform(range(8), lambda i: embedding[i * 8 + 1 : i * 8 + 8]) AS m FROM embeddings),
    s AS (SELECT vec_id, list_transform(m, lambda x: list_position(x, list_max(x)) - 1) AS k, list_transform(m, lambda x: list_max(x)) AS p FROM r),
    e AS (SELECT vec_id, k, p, list_filter(range(1, 9), lambda i: k[i] <> 0 AND (i = 1 OR k[i] <> k[i - 1])) AS steps FROM s)
    SELECT vec_id, array_to_string(list_transform(steps, lambda i: ['blank', 'a', 'b', 'c', 'd', 'e', 'f', ' '][k[i] + 1]), '') AS text,
        round(CASE WHEN len(steps) > 0 THEN list_sum(list_transform(steps, lambda i: p[i]::DOUBLE)) / len(steps) ELSE 0 END, 6) AS score FROM e"""
)
def ctc_decode(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", A.rows_of(F.col("embedding"), 8).alias("m"))
    return B.decode_characters(rows, "m", CHARSET).select("vec_id", "text", F.round("text_score", 6).alias("score"))


IMAGE_SQL = f"""i AS (SELECT 'image-' || (doc_id // 20) AS unique_id, doc_id, text, n_chars, coalesce({MATCH_SQL}, false) AS hit,
    row_number() OVER (PARTITION BY doc_id // 20 ORDER BY n_chars, doc_id)::INT AS id, round_even(n_chars / 2.0::DOUBLE, 0)::INT AS x, (doc_id % 100)::INT AS y FROM documents)"""


@query(
    f"""WITH {IMAGE_SQL} SELECT unique_id, count(*) AS n_items, count(*) FILTER (WHERE hit) AS n_match, sum(id::BIGINT * x)::BIGINT AS x_sum FROM i GROUP BY unique_id"""
)
def result_json_summary(spark, sf_dir):
    parsed = result_json(spark, sf_dir).select("unique_id", F.from_json("json", f"uniqueId string, layoutList {RE.LAYOUT_TYPE}, itemList {RE.ITEM_TYPE}").alias("d"))
    items = F.col("d.itemList")
    return parsed.select(
        "unique_id",
        F.size(items).cast("long").alias("n_items"),
        F.size(F.filter(items, lambda i: i["isMatch"])).cast("long").alias("n_match"),
        F.aggregate(items, F.lit(0).cast("long"), lambda a, i: a + i["id"] * i["centerPoint"]["x"].cast("long")).alias("x_sum"),
    )


def _documents_of_images(spark, sf_dir):
    """Result documents of images of twenty documents each: a bounded number of items an image, whatever the size of the table."""
    docs = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 20).alias("image"), F.col("doc_id").alias("x"), "text", "n_chars")
    items = B.reading_order(docs, "image", "n_chars", "x", [])
    item = B.item_struct(F.col("id"), N.round_even(F.col("n_chars") / 2), (F.col("x") % 100).cast("int"), F.col("text"), T.is_match(F.col("text"), PHRASE))
    lists = RE.item_list(items.select("image", item.alias("item")), "image")
    layout = F.array(B.layout_struct(F.lit("text"), F.lit(0.9), F.lit(1), F.lit(2)))
    unique_id = F.concat(F.lit("image-"), F.col("image").cast("string"))
    return lists.select(unique_id.alias("unique_id"), RE.result_document(unique_id, layout, F.col("itemList")).alias("document"))


LISTS_SQL = """'"layoutList":[{"label":"text","score":0.9,"centerPoint":{"x":1,"y":2}}],"itemList":[' || string_agg('{"id":' || id || ',"centerPoint":{"x":' || x || ',"y":' || y || '},"text":'
    || to_json(text)::VARCHAR || ',"isMatch":' || hit || '}', ',' ORDER BY id) || ']}'"""


@query(f"""WITH {IMAGE_SQL} SELECT unique_id, '{{"uniqueId":"' || unique_id || '",' || {LISTS_SQL} AS json FROM i GROUP BY unique_id""")
def result_json(spark, sf_dir):
    """Flagship: documents as recognised items of images, matched, ordered, numbered, nested, serialised."""
    return _documents_of_images(spark, sf_dir).select("unique_id", RE.result_json(F.col("document")).alias("json"))


@query(f"""WITH {IMAGE_SQL} SELECT unique_id, '{{' || {LISTS_SQL} AS json FROM i GROUP BY unique_id""")
def result_file(spark, sf_dir):
    """What the images' result files hold."""
    return _documents_of_images(spark, sf_dir).select("unique_id", RE.file_json(F.col("document")).alias("json"))


@query("""SELECT doc_id, '{"response":{"stdout":"' || doc_id || '","stderr":""}}' AS response, '{"error":"' || lang || '"}' AS error FROM documents""")
def response_envelope(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", RE.envelope(F.col("doc_id").cast("string")).alias("response"), RE.error_document(F.col("lang")).alias("error"))


FIRST_KINDS: dict[str, tuple] = {}
for _k, _m, _e, _c, _b in FI.signature_rows():
    FIRST_KINDS.setdefault(_e, (_m, _e, _c))
KINDS_SQL = "(VALUES " + ", ".join(f"('{e}', '{m}', '{c}')" for m, e, c in FIRST_KINDS.values()) + ") AS k(ext, mime, category)"
EXT_SQL = r"lower(regexp_extract(url, '\.([^.]*)$', 1))"


@query(f"SELECT page_id, {EXT_SQL} AS extension, mime, category FROM pages LEFT JOIN {KINDS_SQL} ON ext = {EXT_SQL}")
def mime_by_extension(spark, sf_dir):
    kind = FI.by_extension(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", T.extension(F.col("url")).alias("extension"), kind["mime"].alias("mime"), kind["category"].alias("category"))


def _heads(spark, sf_dir):
    """Documents as files: the mark of a kind (or none) in front of their text."""
    marks = FI.signature_rows()
    head = F.array(*[F.lit(_head(m)) for *_, m in marks])
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.get(head, (F.col("doc_id") % len(marks)).cast("int")), F.encode("text", "UTF-8")).alias("content"))


def _head(magic) -> bytes:
    out = bytearray(b"." * max([0, *(o + len(b) for o, b in magic)]))
    for offset, mark in magic:
        out[offset : offset + len(mark)] = mark
    return bytes(out)


def _magic_sql() -> str:
    rows = FI.signature_rows()
    heads = ", ".join(f"({k}, unhex('{_head(m).hex()}'))" for k, *_, m in rows)
    checks = ", ".join(f"({k}, '{mime}', {o}, '{b.hex().upper()}', {len(m)})" for k, mime, _, _, m in rows for o, b in m)
    return f"""WITH h AS (SELECT * FROM (VALUES {heads}) AS h(k, head)), s AS (SELECT * FROM (VALUES {checks}) AS s(ord, mime, start, mark, n)),
    f AS (SELECT doc_id, hex(head || encode(text)) AS content FROM documents JOIN h ON k = doc_id % {len(rows)}),
    m AS (SELECT doc_id, ord, mime FROM f JOIN s ON substr(content, 2 * start + 1, len(mark)) = mark GROUP BY doc_id, ord, mime, n HAVING count(*) = n),
    b AS (SELECT doc_id, max(ord)::INT AS ord, max_by(mime, ord) AS mime FROM m GROUP BY doc_id)
    SELECT doc_id, ord, mime FROM documents LEFT JOIN b USING (doc_id)"""


@query(_magic_sql())
def mime_by_magic(spark, sf_dir):
    kind = FI.sniffed(F.col("content"))
    return _heads(spark, sf_dir).select("doc_id", kind["ord"].alias("ord"), kind["mime"].alias("mime"))


@query(_magic_sql().replace("LEFT JOIN b", "JOIN b"))
def mime_by_magic_join(spark, sf_dir):
    return FI.sniff_join(_heads(spark, sf_dir), "content", "doc_id")


@query(f"SELECT page_id, contains('{ALLOWED}', coalesce(mime, 'undefined')) AS allowed FROM pages LEFT JOIN {KINDS_SQL} ON ext = {EXT_SQL}")
def mime_allow(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", FI.mime_allowed(FI.by_extension(F.col("url"))["mime"], ALLOWED).alias("allowed"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN true ELSE n_chars * 1000 <= 2 * 1048576 END AS allowed, false AS without_limit FROM documents")
def size_limit(spark, sf_dir):
    size = F.when(F.col("doc_id") % 7 != 0, F.col("n_chars") * 1000)
    return table(spark, sf_dir, "documents").select("doc_id", N.size_allowed(size, F.lit("2")).alias("allowed"), N.size_allowed(size, F.lit("x")).alias("without_limit"))


#: The marks and the types of the file endings that the uploads below take in turn.
UPLOAD_KINDS = [("png", b"\x89PNG\r\n\x1a\n"), ("pdf", b"%PDF"), ("xyz", b"???"), ("html", b"<p>")]


def _uploads(spark, sf_dir):
    """Pages as requests: a file part and two search texts each; every seventh has no file, every fifth two."""
    page = table(spark, sf_dir, "pages").select(F.col("page_id").alias("request_id"), "html")
    k = (F.col("request_id") % 4).cast("int")
    file = lambda ord_, shift: F.struct(
        F.lit(ord_).alias("ord"),
        F.when(F.col("request_id") % 7 == 0, "other").otherwise("file").alias("name"),
        F.concat(F.lit(f"f{ord_}."), F.get(F.array(*[F.lit(e) for e, _ in UPLOAD_KINDS]), (k + shift) % 4)).alias("file_name"),
        F.concat(F.get(F.array(*[F.lit(m) for _, m in UPLOAD_KINDS]), (k + shift) % 4), F.encode("html", "UTF-8")).alias("buffer"),
    )
    text = lambda ord_: F.struct(F.lit(ord_).alias("ord"), F.lit("searchText").alias("name"), F.lit(None).cast("string").alias("file_name"), F.encode(F.concat(F.lit(f"t{ord_}-"), F.col("request_id").cast("string")), "UTF-8").alias("buffer"))
    parts = F.array(file(0, 0), text(1), text(2), F.when(F.col("request_id") % 5 == 0, file(3, 1)))
    return page.select("request_id", F.explode(F.filter(parts, lambda p: p.isNotNull())).alias("p")).select("request_id", "p.*")


@query(
    """WITH r AS (SELECT page_id AS request_id, page_id % 7 = 0 AS other, page_id % 5 = 0 AS two, ['png', 'pdf', 'xyz', 'html'][page_id % 4 + 1] AS e0, ['png', 'pdf', 'xyz', 'html'][(page_id + 1) % 4 + 1] AS e3 FROM pages),
    f AS (SELECT *, CASE e0 WHEN 'xyz' THEN 'Mime type are not allowed.' WHEN 'html' THEN '' ELSE 'File size exceeds limit.' END AS f0,
        CASE WHEN NOT two THEN '' WHEN e3 = 'xyz' THEN 'Mime type are not allowed.' WHEN e3 = 'html' THEN '' ELSE 'File size exceeds limit.' END AS f3 FROM r)
    SELECT request_id, CASE WHEN other THEN 'Parameter ''file'' is missing.' ELSE f0 || f3 END AS error, 
        CASE WHEN other THEN 'Parameter ''file'' is missing.' ELSE replace(f0 || f3, 'File size exceeds limit.', '') END AS error_within_limit,
        CASE WHEN NOT other THEN 'f0.' || e0 END AS stored, CASE WHEN NOT other THEN CASE WHEN two THEN 'f3.' || e3 ELSE 'f0.' || e0 END END AS processed, 't2-' || request_id AS search_text FROM f"""
)
def upload_validation(spark, sf_dir):
    """Limits of nothing and of a megabyte: files known by their bytes have a size, those known by their ending alone have none."""
    parts = _uploads(spark, sf_dir)
    within = FI.check_uploads(parts, ALLOWED, "1").withColumnRenamed("error", "error_within_limit")
    return FI.check_uploads(parts, ALLOWED, "0").join(within, "request_id").join(FI.chosen_parts(parts), "request_id")


@query(r"SELECT page_id, regexp_replace(trim(string_split(url, '/')[-1]), '\.[^/.]+$', '') AS base_name, string_split(url, '/')[-1] AS name FROM pages")
def base_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.base_name(F.col("url")).alias("base_name"), T.file_name(F.col("url")).alias("name"))


@query(
    """WITH s AS (SELECT doc_id, n_chars * n_chars * (doc_id % 5) * (doc_id % 3 + 1) AS n FROM documents)
    SELECT doc_id, CASE WHEN n >= 1099511627776 THEN printf('%.1f TB', floor(n / 1099511627776 * 10 + 0.5) / 10) WHEN n >= 1073741824 THEN printf('%.1f GB', floor(n / 1073741824 * 10 + 0.5) / 10)
    WHEN n >= 1048576 THEN printf('%.1f MB', floor(n / 1048576 * 10 + 0.5) / 10) WHEN n >= 1024 THEN printf('%.1f KB', floor(n / 1024 * 10 + 0.5) / 10) ELSE n || ' B' END AS size FROM s"""
)
def size_human(spark, sf_dir):
    n = F.col("n_chars") * F.col("n_chars") * (F.col("doc_id") % 5) * (F.col("doc_id") % 3 + 1)
    return table(spark, sf_dir, "documents").select("doc_id", N.human_size(n).alias("size"))


@query("SELECT event_id, lower(to_base(epoch_us(ts) // 1000, 36)) || '-' || lower(to_base(user_id, 36)) AS id FROM events")
def unique_id_prefix(spark, sf_dir):
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", N.unique_id(millis, F.col("user_id")).alias("id"))


@query("SELECT event_id, event_id % 4 IN (0, 3) AND json_valid(props) AS valid FROM events")
def json_check(spark, sf_dir):
    """Whole objects, cut ones, ones with a trailing comma, and bare numbers."""
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.col("props")).when(k == 1, F.expr("left(props, length(props) - 1)")).when(k == 2, F.concat(F.expr("left(props, length(props) - 1)"), F.lit(",}"))).otherwise(F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", T.is_json(text).alias("valid"))


@query(r"SELECT doc_id, regexp_replace(chr(27) || '[1;31m' || text || chr(27) || '[0m', chr(27) || '[\[0-9;]*[a-zA-Z]', '', 'g') AS text FROM documents")
def ansi_strip(spark, sf_dir):
    coloured = F.concat(F.lit("\x1b[1;31m"), "text", F.lit("\x1b[0m"))
    return table(spark, sf_dir, "documents").select("doc_id", T.strip_terminal_codes(coloured).alias("text"))


@query("SELECT o_orderkey, format('{:,}', floor(o_totalprice)::BIGINT) AS whole, strftime(o_orderdate, '%Y/%-m/%-d %H:%M:%S') AS full_date, strftime(o_orderdate, '%Y/%-m/%-d') AS day FROM orders")
def number_and_date_format(spark, sf_dir):
    date = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf_dir, "orders").select("o_orderkey", N.number_text(F.floor("o_totalprice")).alias("whole"), N.date_text(date).alias("full_date"), N.date_text(date, clock=False).alias("day"))


@query(
    """WITH h AS (SELECT event_id, user_id, CASE event_id % 4 WHEN 0 THEN '10.0.0.' || user_id || ', 9.9.9.9' WHEN 1 THEN '' END AS forwarded,
        CASE event_id % 3 WHEN 0 THEN '::ffff:1.2.3.' || user_id WHEN 1 THEN '1.1.1.1:' || user_id END AS ip FROM events),
    c AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN '10.0.0.' || user_id ELSE coalesce(ip, '') END AS client FROM h)
    SELECT event_id, client, string_split(client, ':')[-1] AS key, CASE event_id % 5 WHEN 0 THEN 'T' || user_id WHEN 1 THEN '' ELSE '' END AS token FROM c"""
)
def request_headers(spark, sf_dir):
    user = F.col("user_id").cast("string")
    forwarded = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("10.0.0."), user, F.lit(", 9.9.9.9"))).when(F.col("event_id") % 4 == 1, "")
    ip = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("::ffff:1.2.3."), user)).when(F.col("event_id") % 3 == 1, F.concat(F.lit("1.1.1.1:"), user))
    auth = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("Bearer T"), user)).when(F.col("event_id") % 5 == 1, "Bearer ").when(F.col("event_id") % 5 == 2, F.concat(F.lit("bearer T"), user))
    client = T.client_ip(forwarded, ip)
    return table(spark, sf_dir, "events").select("event_id", client.alias("client"), T.limiter_key(client).alias("key"), T.bearer_token(auth).alias("token"))


@query("SELECT event_id, 'in/' || user_id AS path_input, CASE WHEN event_id % 3 <> 0 THEN event_type END AS search_text, NULL::VARCHAR AS path_output FROM events")
def engine_request_body(spark, sf_dir):
    """JSON bodies that lack a key, or two, as structs."""
    body = F.to_json(F.struct(F.concat(F.lit("in/"), F.col("user_id").cast("string")).alias("pathInput"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("searchText"), F.lit(1).alias("more")))
    got = S.engine_request(body)
    return table(spark, sf_dir, "events").select("event_id", got["pathInput"].alias("path_input"), got["searchText"].alias("search_text"), got["pathOutput"].alias("path_output"))


@query(
    """SELECT page_id, 0 AS ord, 'file' AS name, 'p' || page_id || '.html' AS file_name, octet_length(encode(html))::INT AS n_bytes FROM pages
    UNION ALL SELECT page_id, 1, 'searchText', NULL, length('find ' || page_id)::INT FROM pages"""
)
def multipart_parts(spark, sf_dir):
    """Pages sent as multipart/form-data bodies, taken apart again."""
    page = F.col("page_id").cast("string")
    line = F.lit("\r\n")
    head = F.concat(F.lit('--cut\r\nContent-Disposition: form-data; name="file"; filename="p'), page, F.lit('.html"\r\nContent-Type: text/html\r\n\r\n'))
    tail = F.concat(line, F.lit('--cut\r\nContent-Disposition: form-data; name="searchText"\r\n\r\nfind '), page, line, F.lit("--cut--\r\n"))
    bodies = table(spark, sf_dir, "pages").select("page_id", F.encode(F.concat(head, "html", tail), "UTF-8").alias("body"), F.lit("multipart/form-data; boundary=cut").alias("kind"))
    parts = bodies.lateralJoin(S.MultipartParts(F.col("body").outer(), F.col("kind").outer()))
    return parts.select("page_id", "ord", "name", "file_name", F.octet_length("buffer").alias("n_bytes"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'Content-type missing.' END AS error FROM events")
def content_type_check(spark, sf_dir):
    kind = F.when(F.col("event_id") % 3 != 0, F.when(F.col("event_id") % 3 == 1, "multipart/form-data; boundary=b").otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", FI.content_type_error(kind).alias("error"))


@query("SELECT conv_id, encode(string_agg(text, '' ORDER BY turn)) AS body FROM conversations GROUP BY conv_id")
def chunks_of_body(spark, sf_dir):
    """A conversation's turns as the chunks of one request."""
    chunks = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.encode("text", "UTF-8").alias("chunk"))
    return FI.whole_bodies(chunks, "conv_id", "turn", "chunk")


@query("SELECT event_id, 'Time: ' || strftime(ts, '%Y/%-m/%-d %H:%M:%S') || ' - ' || event_type || ': ' || props AS line, round(epoch_us(ts) % 60000000 / 1e6, 3) AS seconds FROM events")
def log_lines(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", K.log_line(ts, F.col("event_type"), F.col("props")).alias("line"), N.elapsed_seconds(F.date_trunc("minute", ts), ts).alias("seconds"))


@query(
    """SELECT event_id, 'e' || event_id || '.png' AS name, CASE WHEN event_id % 2 = 0 THEN '5' END AS size, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y/%-m/%-d %H:%M:%S') END AS date_modified FROM events"""
)
def file_details(spark, sf_dir):
    """Names with and without a folder: only paths have their file's size and date."""
    name = F.concat(F.when(F.col("event_id") % 2 == 0, "d/").otherwise(""), F.lit("e"), F.col("event_id").cast("string"), F.lit(".png"))
    detail = FI.file_detail(name, stat_size=F.lit(5), modified=F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", detail.alias("d")).select("event_id", "d.name", "d.size", "d.date_modified")


@query(r"SELECT page_id, url_decode(replace(url, '+', '%2B')) AS decoded, 'a b/' || page_id || '+é' AS back FROM pages")
def uri_decode(spark, sf_dir):
    coded = F.concat(F.lit("a%20b/"), F.col("page_id").cast("string"), F.lit("+%C3%A9"))
    return table(spark, sf_dir, "pages").select("page_id", T.decode_uri(F.col("url")).alias("decoded"), T.decode_uri(coded).alias("back"))


@query(r"SELECT page_id, 'input/' || regexp_replace(trim(string_split(url, '/')[-1]), '\.[^/.]+$', '') || '/' || string_split(url, '/')[-1] AS input_path, 'output/' || page_id || '/' AS output_path FROM pages")
def request_paths(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", RE.input_path(T.base_name(url), T.file_name(url)).alias("input_path"), RE.output_path(F.col("page_id").cast("string")).alias("output_path"))


@query(
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, [(l_partkey % 50)::INT, (l_partkey % 50 + l_linenumber * 5)::INT, (l_partkey % 50 + 3)::INT, (l_suppkey % 40)::INT] AS xs,
        [(l_suppkey % 40)::INT, (l_suppkey % 40 + 1)::INT, (l_suppkey % 40 + l_linenumber)::INT, (l_partkey % 50)::INT] AS ys FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, round_even((list_min(xs) + list_max(xs)) / 2, 0)::INT AS x, round_even((list_min(ys) + list_max(ys)) / 2, 0)::INT AS y FROM p"""
)
def polygon_center(spark, sf_dir):
    """Centre of four points: middle of their least and greatest coordinates."""
    items = B.items_from_arrays(F.array(_points()), F.array(F.lit("t")))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.get(items, F.lit(0)).alias("i"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.col("i.centerPoint.x").alias("x"), F.col("i.centerPoint.y").alias("y"))


@query("SELECT string_split(min_by(text, doc_id), ':')[2][2:] AS vendor FROM (SELECT doc_id, 'vendor_id : v' || doc_id AS text FROM documents WHERE doc_id % 9 = 4)")
def cpu_vendor(spark, sf_dir):
    line = F.when(F.col("doc_id") % 9 == 4, F.concat(F.lit("vendor_id : v"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("model: "), "lang"))
    return S.first_vendor(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), line.alias("line")))


@query("SELECT doc_id, CASE WHEN coalesce(source, '') = '' OR doc_id % 3 = 0 THEN lang ELSE source END AS value FROM documents")
def setting_fallback(spark, sf_dir):
    primary = F.when(F.col("doc_id") % 3 == 0, F.when(F.col("doc_id") % 2 == 0, "")).otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", S.setting(primary, F.col("lang")).alias("value"))


@query(f"SELECT 'root/' || event_id AS path FROM events WHERE event_id % 3 = 0 AND epoch(TIMESTAMP '{NOW}') - epoch(date_trunc('second', ts)) > 86400 * 30")
def sweep_entries(spark, sf_dir):
    """Of entries, nested files and hidden names under a root those that a sweep takes."""
    name = F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("d/"), F.col("event_id").cast("string"))).otherwise(F.concat(F.lit(".h"), F.col("event_id").cast("string")))
    listing = table(spark, sf_dir, "events").select(F.concat(F.lit("root/"), name).alias("path"), F.col("ts").cast("timestamp").alias("modificationTime"))
    return R.sweep_candidates(listing, "root", F.lit(NOW).cast("timestamp"), 86400 * 30).select("path")


@query(f"SELECT event_id, epoch(TIMESTAMP '{NOW}') - epoch(date_trunc('second', ts)) > 86400 * 30 AS expired FROM events")
def retention(spark, sf_dir):
    when = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", R.expired(when, F.lit(NOW).cast("timestamp"), 86400 * 30).alias("expired"))


@query("SELECT event_type, time_bucket(INTERVAL '15 minutes', ts) AS window_start, count(*) AS requests FROM events GROUP BY ALL")
def rate_limit_window(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return R.quota_counts(rows, "event_type", "ts").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    """WITH p AS (SELECT event_id, row_number() OVER (PARTITION BY event_type, time_bucket(INTERVAL '15 minutes', ts) ORDER BY ts, event_id) AS place FROM events)
    SELECT event_id, place, place <= 2 AS admitted FROM p"""
)
def rate_limit_admit(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return R.admit(rows, "event_type", "ts", ["event_id"], limit=2).select("event_id", F.col("place").cast("long").alias("place"), "admitted")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def no_clobber(spark, sf_dir):
    uploads = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"))
    existing = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("path"))
    return FI.new_uploads(uploads, existing).withColumnRenamed("path", "doc_id")


@query("SELECT doc_id, base64(encode(text)) AS stdout FROM documents")
def download_base64(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.unwrapped_base64(F.encode("text", "UTF-8")).alias("stdout"))


@query(
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'CUDAExecutionProvider,CPUExecutionProvider' WHEN 1 THEN 'OpenVINOExecutionProvider' WHEN 2 THEN '' ELSE 'CUDAExecutionProvider,OpenVINOExecutionProvider,CPUExecutionProvider' END AS chosen FROM pages"""
)
def provider_select(spark, sf_dir):
    there = [["CPUExecutionProvider", "X", "CUDAExecutionProvider"], ["OpenVINOExecutionProvider", "Y"], ["X"], ["CPUExecutionProvider", "OpenVINOExecutionProvider", "CUDAExecutionProvider"]]
    available = F.get(F.array(*[F.array(*map(F.lit, x)) for x in there]), (F.col("page_id") % 4).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(S.providers_in_order(available), ",").alias("chosen"))


@query(
    """WITH l AS (SELECT doc_id AS ord, 'K' || (doc_id % 50) AS key, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN lang || '=' || doc_id ELSE lang || ' ' || doc_id END AS value FROM documents),
    f AS (SELECT key, coalesce(min_by(value, ord) FILTER (WHERE value <> ''), '') AS found FROM l GROUP BY key),
    e AS (SELECT 'K' || doc_id AS key, CASE WHEN doc_id % 3 = 0 THEN 'set' ELSE '' END AS value FROM documents WHERE doc_id < 30)
    SELECT key, CASE WHEN coalesce(e.value, '') <> '' THEN e.value ELSE found END AS value FROM f LEFT JOIN e USING (key)"""
)
def env_precedence(spark, sf_dir):
    """Settings lines made of documents (plain, with quotes, with an equals sign inside, empty) over what is set already."""
    docs, n = table(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    value = F.when(F.col("doc_id") % 4 == 0, "").when(F.col("doc_id") % 4 == 1, F.concat("lang", F.lit("="), n)).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("'"), "lang", F.lit(" "), n, F.lit("'"))).otherwise(F.concat("lang", F.lit(" "), n))
    lines = docs.select(F.col("doc_id").alias("ord"), F.concat(F.lit("K"), (F.col("doc_id") % 50).cast("string"), F.lit("="), value).alias("line"))
    existing = docs.where("doc_id < 30").select(F.concat(F.lit("K"), n).alias("key"), F.when(F.col("doc_id") % 3 == 0, "set").otherwise("").alias("value"))
    return S.effective_settings(S.parse_settings(lines), existing)


@query(
    """WITH n AS (SELECT n_nationkey, ['a_local', 'prod_it', 'x_', 'us', 'a_b_jp', 'test_de'][n_nationkey % 6 + 1] AS name, ['jp', 'it', 'jp', 'us', 'jp', 'de'][n_nationkey % 6 + 1] AS key FROM nation)
    SELECT n_nationkey, name, key, CASE key WHEN 'jp' THEN 'ja-JP' WHEN 'it' THEN 'it-IT' WHEN 'us' THEN 'en-US' ELSE 'de-DE' END AS locale, CASE key WHEN 'jp' THEN 'JPY' WHEN 'us' THEN 'USD' ELSE 'EUR' END AS currency FROM n"""
)
def locale_lookup(spark, sf_dir):
    names = F.array(*map(F.lit, ["a_local", "prod_it", "x_", "us", "a_b_jp", "test_de"]))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.get(names, F.col("n_nationkey") % 6).alias("name"))
    return S.with_locale(rows.withColumn("key", S.locale_key(F.col("name"))), "key")


def _audits(spark, sf_dir):
    """Suppliers as packages of an audit report for each nation."""
    k = F.col("s_suppkey")
    fix = F.when(k % 4 == 0, "true").when(k % 4 == 1, "false").when(k % 4 == 2, F.concat(F.lit('{"name":"fix'), k.cast("string"), F.lit('","version":"'), (k % 7).cast("string"), F.lit('"}'))).otherwise('{"isSemVerMajor":true}')
    via = F.when(k % 3 == 0, '["dep",{"source":7,"title":"t"}]').when(k % 3 == 1, '[{"title":"u"}]').otherwise("[]")
    severity = F.when(k % 5 == 0, F.lit("")).otherwise(F.concat(F.lit('"severity":"'), F.get(F.array(*map(F.lit, ["low", "moderate", "high", "critical"])), (k % 5 - 1).cast("int")), F.lit('",')))
    package = F.concat(F.lit('"p'), k.cast("string"), F.lit('":{'), severity, F.lit('"isDirect":'), (k % 2 == 0).cast("string"), F.lit(',"range":"<'), (k % 9).cast("string"), F.lit('","fixAvailable":'), fix, F.lit(',"via":'), via, F.lit("}"))
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", k.alias("k"), package.alias("p"))
    listed = rows.groupBy("s_nationkey").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "p"))), lambda x: x["p"]), ",").alias("ps"))
    text = F.concat(F.lit('{"metadata":{"vulnerabilities":{"low":'), F.col("n").cast("string"), F.lit(',"high":1},"dependencies":{"total":'), (F.col("n") * 3).cast("string"), F.lit('}},"vulnerabilities":{'), "ps", F.lit("}}"))
    return S.read_audit(listed.select("s_nationkey", text.alias("text")), "text")


@query(
    """SELECT 'p' || s_suppkey AS name, CASE s_suppkey % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN 'low' WHEN 2 THEN 'moderate' WHEN 3 THEN 'high' ELSE 'critical' END AS severity,
    CASE WHEN s_suppkey % 2 = 0 THEN 'Direct' ELSE 'Transitive' END AS kind, '<' || (s_suppkey % 9) AS range,
    CASE s_suppkey % 4 WHEN 0 THEN 'Available (version unknown).' WHEN 1 THEN 'Not available' WHEN 2 THEN 'fix' || s_suppkey || '@' || (s_suppkey % 7) ELSE 'p' || s_suppkey || '@latest' END AS fix,
    CASE s_suppkey % 3 WHEN 0 THEN 'dep | 7:t' WHEN 1 THEN 'advisory:u' ELSE '' END AS cause FROM supplier"""
)
def audit_packages(spark, sf_dir):
    return K.audit_packages(_audits(spark, sf_dir))


@query(
    """SELECT (count(*) * 3)::VARCHAR AS total, 0 AS info, count(*)::INT AS low, 0 AS moderate, 1 AS high, 0 AS critical, count(*)::INT AS n_packages, count(*) FILTER (WHERE s_suppkey % 4 <> 1)::INT AS n_fixable
    FROM supplier GROUP BY s_nationkey"""
)
def audit_summary(spark, sf_dir):
    return K.audit_summary(_audits(spark, sf_dir))


#: Paths of one to four pieces made of page numbers.
PATHS_SQL = """p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'd' || (page_id % 10) || '/d' || (page_id % 10) || 'x' || page_id || '.txt' WHEN 1 THEN 'top' || page_id || '.txt'
    WHEN 2 THEN 'd' || (page_id % 6) || '/e/e' || page_id || '.png' ELSE 'g/h/i/' || page_id || '.txt' END AS path FROM pages)"""


def _paths(spark, sf_dir):
    n, text = F.col("page_id"), F.col("page_id").cast("string")
    ten, six = (n % 10).cast("string"), (n % 6).cast("string")
    path = F.when(n % 4 == 0, F.concat(F.lit("d"), ten, F.lit("/d"), ten, F.lit("x"), text, F.lit(".txt"))).when(n % 4 == 1, F.concat(F.lit("top"), text, F.lit(".txt")))
    path = path.when(n % 4 == 2, F.concat(F.lit("d"), six, F.lit("/e/e"), text, F.lit(".png"))).otherwise(F.concat(F.lit("g/h/i/"), text, F.lit(".txt")))
    return table(spark, sf_dir, "pages").select(path.alias("path"))


@query(f"WITH {PATHS_SQL} SELECT DISTINCT string_split(path, '/')[1] || '/' AS entry FROM p WHERE contains(path, '/') UNION ALL SELECT path FROM p WHERE page_id % 4 < 2")
def listing_two_levels(spark, sf_dir):
    return FI.two_levels(_paths(spark, sf_dir), ".txt")


@query(f"WITH {PATHS_SQL} SELECT path FROM p WHERE page_id % 4 IN (0, 2)")
def listing_named_after_directory(spark, sf_dir):
    return FI.named_after_directory(_paths(spark, sf_dir))


@query(f"WITH {PATHS_SQL} SELECT regexp_replace(min(path), '/[^/]*$', '') || '/' AS directory FROM p WHERE path LIKE '%8.txt'")
def listing_first_ending(spark, sf_dir):
    return FI.first_path_ending(_paths(spark, sf_dir), "8.txt")


@query("SELECT page_id, string_split(replace(url, 'http://', ''), ':')[1] AS host, regexp_replace(url, '^https?://', '') AS bare, trim(regexp_replace('  ' || url || '  x ', '\\s+', ' ', 'g')) AS squeezed FROM pages")
def url_parts(spark, sf_dir):
    url = F.col("url")
    bare = T.strip_first(T.strip_first(url, "https://"), "http://")
    return table(spark, sf_dir, "pages").select("page_id", F.get(T.host_and_port(url), F.lit(0)).alias("host"), bare.alias("bare"), T.squeeze(F.concat(F.lit("  "), url, F.lit("  x "))).alias("squeezed"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag || ' ' || printf('%.2f', l_discount) AS caption, CASE WHEN l_linestatus = 'O' THEN 'green' ELSE 'red' END AS colour FROM lineitem")
def overlay_labels(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", T.labelled_score(F.col("l_returnflag"), F.col("l_discount")).alias("caption"), K.overlay_colour(F.col("l_linestatus") == "O").alias("colour"))
