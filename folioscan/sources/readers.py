"""Sources: files, listings, character lists, settings, schedules, request parts, audit reports."""

from __future__ import annotations

from email.parser import BytesParser
from email.policy import HTTP

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

BLANK, SPACE = "blank", " "
PROVIDERS = ["CUDAExecutionProvider", "OpenVINOExecutionProvider", "CPUExecutionProvider"]


def read_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """path, modificationTime, length, content; content is read only if it is selected."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def list_files(spark: SparkSession, path: str, extension: str = "*") -> DataFrame:
    """Paths of the files under a folder whose name ends with the extension (as written); a missing folder has none."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    if not root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
        return spark.createDataFrame([], "path string, length long, modificationTime timestamp")
    return read_files(spark, path, None if extension == "*" else f"*{extension}").select("path", "length", "modificationTime")


def relative(path: Column, root: str) -> Column:
    return F.regexp_replace(path, "^(?:[a-z]+:)?/*" + root.strip("/").replace(".", r"\.") + "/", "")


def character_list(text: str) -> list[str]:
    """The recogniser's characters: blank, the lines that aren't empty, space."""
    return [BLANK, *[line for line in text.split("\n") if line], SPACE]


def read_character_list(spark: SparkSession, path: str) -> list[str]:
    """One small file, read through Spark's file systems; the list is a literal of later expressions."""
    return character_list(spark.read.format("binaryFile").load(path).select(F.col("content").cast("string")).first()[0])


def parse_settings(lines: DataFrame) -> DataFrame:
    """(ord, key, value) of setting lines (ord, line): split at the first equals sign, one pair of outer quotes off; a line
    without a sign is key and value. Empty lines go."""
    at = F.instr("line", "=")
    key = F.when(at > 0, F.substring_index("line", "=", 1)).otherwise(F.col("line"))
    value = F.when(at > 0, F.expr("substring(line, instr(line, '=') + 1)")).otherwise(F.col("line"))
    return lines.where("line <> ''").select("ord", key.alias("key"), F.regexp_replace(value, "^'(.*)'$", "$1").alias("value"))


def effective_settings(parsed: DataFrame, existing: DataFrame) -> DataFrame:
    """(key, value): what is set already wins if it isn't empty, then the first value in order that isn't empty."""
    first = parsed.groupBy("key").agg(F.min_by("value", F.when(F.col("value") != "", F.col("ord"))).alias("found"), F.min_by("value", "ord").alias("any"))
    joined = first.alias("f").join(existing.alias("e"), "key", "left")
    return joined.select("key", F.coalesce(F.nullif(F.col("e.value"), F.lit("")), "found", "any").alias("value"))


def setting(primary: Column, fallback: Column) -> Column:
    return F.coalesce(F.nullif(primary, F.lit("")), fallback)


def locale_key(env_name: Column) -> Column:
    """Last piece at underscores; jp for an empty one or local."""
    last = F.element_at(F.split(env_name, "_"), -1)
    return F.when(last.isin("", "local"), "jp").otherwise(last)


# Locale and currency by key.
LOCALES = """
jp ja-JP JPY
cn zh-CN CNY
tw zh-TW TWD
kr ko-KR KRW
in hi-IN INR
th th-TH THB
it it-IT EUR
fr fr-FR EUR
de de-DE EUR
es es-ES EUR
pt pt-PT EUR
nl nl-NL EUR
ru ru-RU RUB
pl pl-PL PLN
sv sv-SE SEK
us en-US USD
mx es-MX MXN
br pt-BR BRL
ca fr-CA CAD
ke sw-KE KES
za af-ZA ZAR
eg ar-EG EGP
au en-AU AUD
nz mi-NZ NZD
"""


def locale_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([line.split() for line in LOCALES.split("\n")[1:-1]], "key string, locale string, currency string")


def with_locale(rows: DataFrame, key: str) -> DataFrame:
    """rows with locale and currency; a key that the table lacks is an error."""
    table = F.broadcast(locale_table(rows.sparkSession)).withColumnRenamed("key", "_key")
    joined = rows.join(table, rows[key] == table["_key"], "left")
    known = F.when(F.col("_key").isNull(), F.raise_error(F.concat(F.lit("unknown locale: "), F.coalesce(F.col(key), F.lit("null"))))).otherwise(F.col("locale"))
    return joined.withColumn("locale", known).drop("_key")


def read_schedule(spark: SparkSession, path: str) -> DataFrame:
    """(schedule, command) of job definitions, one JSON object a file."""
    return spark.read.schema("schedule string, command string").json(path, multiLine=True)


def providers_in_order(available: Column) -> Column:
    """Preferred execution providers that are there, in order of preference."""
    return F.array_intersect(F.array(*map(F.lit, PROVIDERS)), available)


def first_vendor(lines: DataFrame) -> DataFrame:
    """(vendor) of the first line (ord, line) that names one."""
    rows = lines.where(F.startswith("line", F.lit("vendor_id")))
    return rows.agg(F.trim(F.get(F.split(F.min_by("line", "ord"), ":"), F.lit(1))).alias("vendor"))


ENGINE_REQUEST = "pathInput string, pathOutput string, searchText string"


def engine_request(body: Column) -> Column:
    """A request body as a struct; missing keys are null."""
    return F.from_json(body, ENGINE_REQUEST)


@udtf(returnType="ord int, name string, file_name string, buffer binary")
class MultipartParts:
    """Parts of a multipart/form-data body: their order, name, file name and bytes."""

    def eval(self, body: bytes, content_type: str):
        message = BytesParser(policy=HTTP).parsebytes(b"Content-Type: " + (content_type or "").encode() + b"\r\n\r\n" + (body or b""))
        if not message.is_multipart():
            return
        for k, part in enumerate(message.iter_parts()):
            yield k, part.get_param("name", header="content-disposition"), part.get_filename(), part.get_payload(decode=True)


AUDIT = "metadata struct<vulnerabilities:map<string,int>,dependencies:struct<total:int>>, vulnerabilities map<string,string>"


def read_audit(reports: DataFrame, text: str) -> DataFrame:
    """reports with the struct `report` of an audit text; the packages stay JSON for audit_packages()."""
    return reports.withColumn("report", F.from_json(text, AUDIT))
