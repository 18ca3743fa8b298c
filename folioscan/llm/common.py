"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable
from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

#: The white space that the word and text contracts name.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


class Memo(dict):
    """key -> make(key) for short texts. Of two generations of at most `most` entries in all the older goes when the younger is full,
    so frequent keys stay and memory is bounded; what is forgotten changes speed only."""

    def __init__(self, make: Callable, most: int = 200_000):
        super().__init__()
        self.make, self.half, self.older = make, max(1, most // 2), {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.half:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def salt_count(df: DataFrame) -> int:
    """About the square root of the row count: a group split so has neither large salted parts nor many of them."""
    return max(1, isqrt(df.count()))


def group_in_two_levels(rows: DataFrame, keys: list[str], id_col: str, salts: int, best: str = "min", route: list[str] | None = None) -> DataFrame:
    """Group rows by keys and give each row its group's first (best='min') or last (best='max') id and the group's size.

    Level one groups by keys and salt, with map-side combining, and holds the ids of that part only. The salt numbers
    rows, whatever their ids, so repeated and null ids are split too. Level two combines one winner and one count of each
    part; no ids go there. What it finds returns to the parts by route (some of the keys, default all), a
    hash of all keys, and salt, so the members of a hot group never meet in one task. All keys are compared as a whole at both levels.
    Returns route, id_col, keep_id, group_size, kept; exactly one row of a group is kept, of repeated ids one
    copy. A null id never wins against another id; if all ids of a group are null, keep_id is null.
    """
    descending, route = best == "max", route or keys
    # Never null, so that the plan's two readers of level one ask for the same rows and share its exchange.
    salted = rows.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)), F.lit(0).cast("long")))
    parts = salted.groupBy(*keys, "_salt").agg(F.collect_list(F.struct(F.col(id_col).alias("v"))).alias("_members"))
    ids = F.transform("_members", lambda m: m["v"])
    ordered = F.sort_array(ids, asc=False) if descending else F.array_sort(ids)
    parts = parts.select(*keys, "_salt", F.xxhash64(*keys).alias("_check"), ordered.alias("_ids"))
    first = F.get("_ids", F.lit(0))
    # Nulls come last in either order.
    rank = F.struct((first.isNotNull() if descending else first.isNull()).alias("null"), first.alias("id"), F.col("_salt").alias("salt"))
    choose = F.max if descending else F.min
    winners = parts.groupBy(*keys).agg(choose(rank).alias("_best"), F.sum(F.size("_ids").cast("long")).alias("group_size"), F.collect_set("_salt").alias("_salts"))
    winners = winners.select(*route, F.xxhash64(*keys).alias("_check"), "_best", "group_size", F.explode("_salts").alias("_salt"))
    members = parts.select(*route, "_check", "_salt", "_ids")
    out = members.join(winners.hint("merge"), [*route, "_check", "_salt"])
    out = out.select(*route, F.col("_best.id").alias("keep_id"), "group_size", (F.col("_salt") == F.col("_best.salt")).alias("_won"), F.posexplode("_ids").alias("_at", id_col))
    return out.withColumn("kept", F.col("_won") & (F.col("_at") == 0)).drop("_at", "_won")


def empty_if_null(name: str | Column) -> Column:
    return F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit(""))


def null_safe_key(name: str | Column) -> Column:
    """An id as text with a mark for null, so that plain equality joins and windows treat nulls as one key."""
    return F.coalesce((F.col(name) if isinstance(name, str) else name).cast("string"), F.lit("null"))


def whole_row(df: DataFrame) -> Column:
    """All columns of df as one struct `_row`: names of helper columns can't clash with them, and `_row.*` gives them back."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")


def one_row_each(df: DataFrame, keys: list[Column], wanted: DataFrame) -> DataFrame:
    """For each row of wanted (two columns, distinct) one row of df whose keys equal it, with df's own columns.

    Of rows that repeat a key one stays before the join; each map task sends one of them at most.
    """
    left, right = wanted.columns
    rows = df.select(whole_row(df), keys[0].alias(left), keys[1].alias(right))
    first = F.row_number().over(Window.partitionBy(left, right).orderBy(F.lit(0)))
    rows = rows.withColumn("_rn", first).where("_rn = 1")
    return rows.join(wanted.hint("merge"), [left, right], "left_semi").select("_row.*")
