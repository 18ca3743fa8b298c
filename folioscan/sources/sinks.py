"""Sinks: result files, downloads, deletion, moves, audit text."""

from __future__ import annotations

import json
import time

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.numbers import date_text
from ..functions.text import unwrapped_base64
from .readers import read_files


@F.pandas_udf(StringType())
def indented(texts: pd.Series) -> pd.Series:
    """JSON texts with an indent of two spaces and letters as they are."""
    return texts.map(lambda t: None if t is None else json.dumps(json.loads(t), ensure_ascii=False, indent=2))


def write_results(results: DataFrame, path: str) -> None:
    """One folder for each unique_id with its result text (column json), indented: partitioned text, pruned by id when read.

    A write replaces the folders of its own ids only.
    """
    rows = results.select("unique_id", indented("json").alias("value"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("unique_id").text(path)


def write_result_files(results: DataFrame, root: str, debug: bool = False) -> int:
    """For the images of a request: `<unique_id>/result.json` each under root, one after another; how many were written.

    An image's debug folder of an earlier run is deleted first, and made anew with debug.
    """
    spark, n = results.sparkSession, 0
    for row in results.select("unique_id", indented("json").alias("value")).toLocalIterator():
        folder = f"{root.rstrip('/')}/{row.unique_id}"
        delete_tree(spark, f"{folder}/debug")
        if debug:
            target, system = _system(spark, f"{folder}/debug")
            system.mkdirs(target)
        write_bytes(spark, f"{folder}/result.json", row.value.encode())
        n += 1
    return n


def download(spark: SparkSession, root: str, unique_id: str, file: str) -> DataFrame:
    """(path, stdout) with the file's base64. Ids and names that leave the root are refused."""
    if any(piece in ("", ".", "..") for piece in f"{unique_id}/{file}".split("/")) or "\\" in unique_id + file:
        raise ValueError("path outside the output folder")
    return read_files(spark, f"{root.rstrip('/')}/{unique_id}/{file}", recursive=False).select("path", unwrapped_base64(F.col("content")).alias("stdout"))


def _system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete_tree(spark: SparkSession, path: str) -> bool:
    target, system = _system(spark, path)
    return bool(system.delete(target, True))


def move(spark: SparkSession, source: str, target: str) -> bool:
    old, system = _system(spark, source)
    return bool(system.rename(old, _system(spark, target)[0]))


def rename_in_directory(spark: SparkSession, directory: str, new_directory: str, old_file: str = "", new_file: str = "") -> bool:
    """Rename a folder, then a file within it if one is named."""
    done = move(spark, directory, new_directory)
    return done and (not old_file or move(spark, f"{new_directory.rstrip('/')}/{old_file}", f"{new_directory.rstrip('/')}/{new_file}"))


def sweep(spark: SparkSession, root: str, seconds: int, now: float | None = None) -> list[str]:
    """Delete the files and folders right under root that were last changed more than so many seconds ago; hidden ones
    stay. Returns their paths. Only names and times are listed, one level deep."""
    target, system = _system(spark, root)
    if not system.exists(target):
        return []
    limit = int(time.time() if now is None else now) - seconds
    gone = []
    for status in system.listStatus(target):
        entry = status.getPath()
        if not entry.getName().startswith(".") and status.getModificationTime() // 1000 < limit and system.delete(entry, True):
            gone.append(entry.toString())
    return sorted(gone)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> bool:
    """Make the folder and write one small file from the driver, through Spark's file systems."""
    target, system = _system(spark, path)
    system.mkdirs(target.getParent())
    stream = system.create(target, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
    return True


def log_line(time_: Column, tag: Column, value: Column) -> Column:
    return F.concat(F.lit("Time: "), date_text(time_), F.lit(" - "), tag, F.lit(": "), value)


def append_log(lines: DataFrame, path: str, debug: bool) -> None:
    """Add log lines (column line) to those under path; nothing without debug."""
    if debug:
        lines.select("line").write.mode("append").text(path)


def overlay_colour(matched: Column) -> Column:
    """Colour of a box in the debug picture."""
    return F.when(matched, "green").otherwise("red")


def audit_summary(reports: DataFrame) -> DataFrame:
    """total, info, low, moderate, high, critical, n_packages, n_fixable of parsed reports."""
    counts = F.col("report.metadata.vulnerabilities")
    names = ["info", "low", "moderate", "high", "critical"]
    packages = F.coalesce(F.map_values("report.vulnerabilities"), F.array().cast("array<string>"))
    return reports.select(
        F.coalesce(F.col("report.metadata.dependencies.total").cast("string"), F.lit("n/d")).alias("total"),
        *[F.coalesce(F.try_element_at(counts, F.lit(n)), F.lit(0)).alias(n) for n in names],
        F.size(packages).alias("n_packages"),
        F.size(F.filter(packages, lambda p: _fixable(p))).alias("n_fixable"),
    )


def _fixable(package: Column) -> Column:
    fix = F.get_json_object(package, "$.fixAvailable")
    return fix.isNotNull() & ~fix.isin("false", "null", "0", "")


def audit_packages(reports: DataFrame) -> DataFrame:
    """name, severity, kind, range, fix, cause of every package of parsed reports."""
    rows = reports.select(F.explode("report.vulnerabilities").alias("name", "p"))
    return _package_facts(rows, []).drop("exact", "fixable")


def _package_facts(rows: DataFrame, keys: list[str]) -> DataFrame:
    # The wordings of a report.
    get = lambda path: F.get_json_object("p", path)
    fix = get("$.fixAvailable")
    other = F.concat(F.coalesce(F.nullif(get("$.fixAvailable.name"), F.lit("")), F.col("name")), F.lit("@"), F.coalesce(F.nullif(get("$.fixAvailable.version"), F.lit("")), F.lit("latest")))
    exact = F.coalesce(F.startswith(fix, F.lit("{")), F.lit(False))
    fix_text = F.when(fix == "true", "Available (version unknown).").when(exact, other).otherwise("Not available")
    via = F.coalesce(F.from_json(get("$.via"), "array<string>"), F.array().cast("array<string>"))

    def cause(v: Column) -> Column:
        full = F.concat(F.coalesce(F.get_json_object(v, "$.source"), F.lit("advisory")), F.lit(":"), F.coalesce(F.get_json_object(v, "$.title"), F.lit("n/d")))
        return F.when(F.startswith(v, F.lit("{")), full).otherwise(v)

    return rows.select(
        *keys,
        "name",
        F.coalesce(F.nullif(get("$.severity"), F.lit("")), F.lit("unknown")).alias("severity"),
        F.when(get("$.isDirect") == "true", "Direct").otherwise("Transitive").alias("kind"),
        F.coalesce(F.nullif(get("$.range"), F.lit("")), F.lit("n/d")).alias("range"),
        fix_text.alias("fix"),
        F.array_join(F.transform(via, cause), " | ").alias("cause"),
        exact.alias("exact"),
        F.coalesce(_fixable(F.col("p")), F.lit(False)).alias("fixable"),
    )


def audit_report(reports: DataFrame, key: str) -> DataFrame:
    """(key, text): each parsed report as the lines that a person reads: totals, packages by their place, fixes."""
    # Wordings of the report.
    totals = ["", "Summary:", "Total dependency: %s", "Info: %s", "Low: %s", "Moderate: %s", "High: %s", "Critical: %s"]
    counts = F.col("report.metadata.vulnerabilities")
    total = F.coalesce(F.col("report.metadata.dependencies.total").cast("string"), F.lit("n/d"))
    head = F.format_string("\n".join(totals), total, *[F.coalesce(F.try_element_at(counts, F.lit(n)), F.lit(0)).cast("string") for n in ("info", "low", "moderate", "high", "critical")])
    keyed = reports.select(F.col(key).alias("_key"), head.alias("_head"), "report")
    rows = keyed.select("_key", F.posexplode("report.vulnerabilities").alias("_at", "name", "p"))
    facts = _package_facts(rows, ["_key", "_at"])
    lines = F.concat(
        F.format_string("\n\n- %s\n   Severity: %s\n   Type: %s\n   Range impact: %s\n   Fix: %s", "name", "severity", "kind", "range", "fix"),
        F.when(F.col("cause") != "", F.concat(F.lit("\n   Cause: "), "cause")).otherwise(""),
    )
    remedy = F.when(F.col("fixable"), F.concat(F.lit("- "), "name", F.lit(" -> "), F.when(F.col("exact"), F.col("fix")).otherwise("npm audit fix --force")))
    one = facts.select("_key", F.struct("_at", lines.alias("line"), remedy.alias("remedy")).alias("x"))
    packages = one.groupBy("_key").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    fixes = F.filter(F.transform("xs", lambda x: x["remedy"]), lambda r: r.isNotNull())
    details = F.concat(F.lit("\n\nVulnerability details:"), F.array_join(F.transform("xs", lambda x: x["line"]), ""))
    summary = F.concat(F.lit("\n\nPackage with available fix: "), F.size(fixes).cast("string"), F.lit("/"), F.size("xs").cast("string"))
    listed = F.when(F.size(fixes) > 0, F.concat(F.lit("\n\nList:\n"), F.array_join(fixes, "\n"))).otherwise("")
    joined = keyed.join(packages, "_key", "left")
    text = F.concat("_head", F.when(F.col("xs").isNull(), "\n\nNo vulnerabilities found.").otherwise(F.concat(details, summary, listed)))
    return joined.select(F.col("_key").alias(key), text.alias("text"))
