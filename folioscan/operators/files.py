"""File typing and intake: signatures, detail, allow-list, size limit, upload checks, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T

# Media type, extension, category, and the bytes (hexadecimal, at an offset) that mark a file of the kind.
SIGNATURES = """
text/javascript js code
text/javascript jsx code
text/javascript mjs code
text/typescript ts code
text/typescript tsx code
text/x-python py code
text/css css code
text/html html code
text/html htm code
text/csv csv text
text/plain txt text
text/xml xml code
text/markdown md code
text/yaml yaml code
text/yaml yml code
text/x-sh sh code
font/ttf ttf font 0:0001000000
font/otf otf font 0:4f54544f
font/woff woff font 0:774f4646
font/woff2 woff2 font 0:774f4632
image/jpeg jpg image 0:ffd8ff
image/jpeg jpeg image
image/png png image 0:89504e470d0a1a0a
image/gif gif image 0:47494638
image/webp webp image 0:52494646 8:57454250
image/bmp bmp image 0:424d
image/tiff tiff image 0:49492a00
image/tiff tiff image 0:4d4d002a
image/x-icon ico image 0:00000100
image/avif avif image 4:6674797061766966
image/avif avif image 4:6674797061766973
image/svg+xml svg image
audio/mpeg mp3 audio 0:494433
audio/mpeg mp3 audio 0:fffb
audio/wav wav audio 0:52494646 8:57415645
audio/ogg ogg audio 0:4f676753
audio/flac flac audio 0:664c6143
video/mp4 mp4 video 4:66747970
video/avi avi video 0:52494646 8:41564920
video/webm webm video 0:1a45dfa3
application/pdf pdf document 0:25504446
application/msword doc document
application/vnd.openxmlformats-officedocument.wordprocessingml.document docx document
application/vnd.ms-excel xls document
application/vnd.openxmlformats-officedocument.spreadsheetml.sheet xlsx document
application/vnd.ms-powerpoint ppt document
application/vnd.openxmlformats-officedocument.presentationml.presentation pptx document
application/vnd.oasis.opendocument.text odt document
application/vnd.oasis.opendocument.spreadsheet ods document
application/vnd.oasis.opendocument.presentation odp document
application/zip zip archive 0:504b0304
application/x-rar-compressed rar archive 0:526172211a07
application/x-7z-compressed 7z archive 0:377abcaf271c
application/gzip gz archive 0:1f8b
application/x-bzip2 bz2 archive 0:425a68
application/x-xz xz archive 0:fd377a585a00
application/json json code
application/x-msdownload exe executable 0:4d5a
application/x-elf elf executable 0:7f454c46
application/wasm wasm executable 0:0061736d
application/x-sqlite3 db database 0:53514c69746520
"""

ZIP = "application/zip"


def signature_rows() -> list[tuple[int, str, str, str, list[tuple[int, bytes]]]]:
    """(ord, mime, ext, category, [(offset, bytes)]) in their order, which decides between several that fit."""
    rows = []
    for k, line in enumerate(SIGNATURES.split("\n")[1:-1]):
        mime, ext, category, *magic = line.split()
        rows.append((k, mime, ext, category, [(int(m.split(":")[0]), bytes.fromhex(m.split(":")[1])) for m in magic]))
    return rows


def signature_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(signature_rows(), "ord int, mime string, ext string, category string, magic array<struct<offset:int,bytes:binary>>")


def _kinds() -> Column:
    return F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(m).alias("mime"), F.lit(e).alias("ext"), F.lit(c).alias("category")) for k, m, e, c, _ in signature_rows()])


def sniffed(content: Column) -> Column:
    """The kind (ord, mime, ext, category) whose bytes all stand in the content; of several the last, null without one.

    The table is small and fixed, so it is an expression over each row: no join, and only the first bytes are read.
    """
    kind = None
    for k, mime, ext, category, magic in reversed(signature_rows()):
        if not magic:
            continue
        fits = F.lit(True)
        for offset, mark in magic:
            fits &= F.substring(content, offset + 1, len(mark)) == F.lit(mark)
        made = F.struct(F.lit(k).alias("ord"), F.lit(mime).alias("mime"), F.lit(ext).alias("ext"), F.lit(category).alias("category"))
        kind = F.when(fits, made) if kind is None else kind.when(fits, made)
    return kind


def sniff_join(files: DataFrame, content: str, key: str) -> DataFrame:
    """(key, ord, mime) by joining the signature table: the same answer as sniffed(), for tables of signatures that users add to."""
    table = F.broadcast(signature_table(files.sparkSession).where(F.size("magic") > 0))
    marks = table.select("ord", "mime", F.size("magic").alias("n"), F.explode("magic").alias("m"))
    fits = F.substring(F.col(content), F.col("m.offset") + 1, F.octet_length("m.bytes")) == F.col("m.bytes")
    met = files.select(key, content).join(marks, fits).groupBy(key, "ord", "mime", "n").agg(F.count("*").alias("k")).where("k = n")
    return met.groupBy(key).agg(F.max("ord").alias("ord"), F.max_by("mime", "ord").alias("mime"))


def by_extension(value: Column) -> Column:
    """The first kind with the value's extension, null without one."""
    first: dict[str, int] = {}
    for k, _, ext, _, _ in signature_rows():
        first.setdefault(ext, k)
    place = F.create_map(*[F.lit(x) for pair in first.items() for x in pair])
    return F.get(_kinds(), F.try_element_at(place, T.extension(value)))


def file_detail(value: Column, content: Column | None = None, stat_size: Column | None = None, human: bool = False, modified: Column | None = None) -> Column:
    """Struct name, base_name, extension, category, mime, size, date_modified of a file by its bytes and name.

    Bytes decide; the name's extension does where they decide nothing or say zip. Only known bytes give a size (and a
    path its file's size); only a path has a date, if its file's time is given; an empty value gives null. Unknown files have no name, type or size from here.
    """
    size_text = lambda n: N.human_size(n) if human else n.cast("string")
    by_bytes = sniffed(content) if content is not None else F.lit(None).cast("struct<ord:int,mime:string,ext:string,category:string>")
    named = by_extension(value)
    kind = F.when(by_bytes.isNull() | (by_bytes["mime"] == ZIP), F.coalesce(named, by_bytes)).otherwise(by_bytes)
    stat = F.lit(None).cast("string") if stat_size is None else F.when(F.contains(value, F.lit("/")), size_text(stat_size))
    size = F.when(by_bytes.isNotNull(), size_text(F.octet_length(content))).otherwise(stat) if content is not None else stat
    known = kind.isNotNull()
    made = F.struct(
        F.when(known, T.file_name(value)).alias("name"),
        F.when(known, T.base_name(value)).alias("base_name"),
        kind["ext"].alias("extension"),
        kind["category"].alias("category"),
        kind["mime"].alias("mime"),
        size.alias("size"),
        (F.lit(None).cast("string") if modified is None else F.when(F.contains(value, F.lit("/")), N.date_text(modified))).alias("date_modified"),
    )
    return F.when(value != "", made)


def mime_allowed(mime: Column, allowed: str) -> Column:
    """Whether the type occurs in the allow-list, a text; a missing type acts as the word undefined."""
    return F.contains(F.lit(allowed), F.coalesce(mime, F.lit("undefined")))


def check_uploads(parts: DataFrame, allowed: str, megabytes: str) -> DataFrame:
    """(request_id, error): what is wrong with each request's parts (request_id, ord, name, file_name, buffer).

    Messages follow the parts' order without anything between; the one for a missing file comes last. A file without
    known bytes has no size, so the limit doesn't apply to it.
    """
    detail = file_detail(F.col("file_name"), F.col("buffer"))
    rows = parts.withColumn("_d", detail)
    empty = (F.col("_d.name") == "") | (F.col("_d.mime") == "") | (F.col("_d.size") == "")
    fault = (
        F.when(F.coalesce(empty, F.lit(False)), "File input empty.")
        .when(~mime_allowed(F.col("_d.mime"), allowed), "Mime type are not allowed.")
        .when(~N.size_allowed(F.col("_d.size").cast("long"), F.lit(megabytes)), "File size exceeds limit.")
        .otherwise("")
    )
    rows = rows.withColumn("_fault", F.when(F.col("name") == "file", fault).otherwise(""))
    faults = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "_fault"))), lambda s: s["_fault"]), "")
    missing = F.when(F.count_if(F.col("name") == "file") == 0, "Parameter 'file' is missing.").otherwise("")
    return rows.groupBy("request_id").agg(F.concat(faults, missing).alias("error"))


def content_type_error(content_type: Column) -> Column:
    """What is wrong with a request's content type before its body is looked at; null if nothing is."""
    # Fixed value: the message.
    return F.when(content_type.isNull(), "Content-type missing.")


def whole_bodies(chunks: DataFrame, key: str, order: str, chunk: str) -> DataFrame:
    """(key, body): each request's chunks put together in their order. A request's size is limited, so its chunks are few."""
    held = F.array_sort(F.collect_list(F.struct(order, chunk)))
    return chunks.groupBy(key).agg(F.aggregate(held, F.lit(b""), lambda body, c: F.concat(body, F.coalesce(c[chunk], F.lit(b"")))).alias("body"))


def chosen_parts(parts: DataFrame) -> DataFrame:
    """(request_id, stored, processed, search_text): the first file is stored, the last file name and search text are processed."""
    is_file, is_text = F.col("name") == "file", F.col("name") == "searchText"
    stored = is_file & (F.col("file_name") != "") & F.col("buffer").isNotNull()
    return parts.groupBy("request_id").agg(
        F.min_by("file_name", F.when(stored, F.col("ord"))).alias("stored"),
        F.max_by("file_name", F.when(is_file, F.col("ord"))).alias("processed"),
        F.max_by(F.col("buffer").cast("string"), F.when(is_text, F.col("ord"))).alias("search_text"),
    )


def new_uploads(uploads: DataFrame, existing: DataFrame, path: str = "path") -> DataFrame:
    """Uploads whose target isn't there yet."""
    return uploads.join(existing.select(path), path, "left_anti")


def first_path_ending(listing: DataFrame, ending: str) -> DataFrame:
    """(directory): that of the first path, in the order of paths, which ends with `ending`, with a slash; else empty."""
    hit = listing.where(F.endswith("path", F.lit(ending))).agg(F.min("path").alias("p"))
    return hit.select(F.coalesce(F.concat(F.regexp_replace("p", r"/[^/]*$", ""), F.lit("/")), F.lit("")).alias("directory"))


def two_levels(listing: DataFrame, ext: str = "*") -> DataFrame:
    """(entry) of relative paths: first-level directories with a slash, and matching files on levels one and two."""
    pieces = F.split("path", "/")
    files = listing.where((F.size(pieces) <= 2) & (F.lit(ext == "*") | F.endswith("path", F.lit(ext)))).select(F.col("path").alias("entry"))
    tops = listing.where(F.size(pieces) > 1).select(F.concat(pieces[0], F.lit("/")).alias("entry")).distinct()
    return tops.unionByName(files)


def named_after_directory(listing: DataFrame) -> DataFrame:
    """Relative paths of files whose name starts with the name of the directory that holds them."""
    pieces = F.split("path", "/")
    return listing.where((F.size(pieces) > 1) & F.startswith(F.element_at(pieces, -1), F.try_element_at(pieces, F.lit(-2)))).select("path")

