"""Mixing sources to target weights by subset-sum budget fitting."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import Scratch
from .common import WORD, empty_if_null, null_safe_key, salt_count, whole_row

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
SEED = 20


def fit_counts(sizes: Sequence[int], counts: Sequence[int], budget: int, seed: int = SEED) -> np.ndarray:
    """How many documents of each size to take so that their sizes add up to budget or the nearest sum below it
    that is reached.

    The budget's share of every size is taken first, so the choice keeps the source's spread of sizes. Sizes in
    seeded order then take one more while it fits. A bounded-knapsack dynamic programme over the documents still
    left spends what remains of the budget (less than twice the largest size): bit b of its set says that b can be reached.
    """
    sizes, counts = np.asarray(sizes, np.int64), np.asarray(counts, np.int64)
    total = int((sizes * counts).sum())
    take = np.zeros(len(sizes), np.int64)
    if budget <= 0 or total == 0:
        return take
    if budget >= total:
        return counts.copy()
    usable = sizes > 0
    # Shares in whole numbers: floor(count * budget / total) without rounding.
    take[usable] = [int(c) * budget // total for c in counts[usable]]
    rest = budget - int((sizes * take).sum())
    largest = int(sizes.max())
    order = np.random.default_rng(seed).permutation(np.flatnonzero(usable))
    moved = True
    while moved and rest >= 2 * largest:
        moved = False
        for i in order:
            if rest < 2 * largest:
                break
            if take[i] < counts[i] and sizes[i] <= rest:
                take[i] += 1
                rest -= int(sizes[i])
                moved = True
    # reached[j]: sums reachable with the first j lots; a lot is (size index, how many of that size).
    mask = (1 << (rest + 1)) - 1
    reached, lots = [1], []
    for i in order:
        left, lot = int(min(counts[i] - take[i], rest // max(1, int(sizes[i])))), 1
        while left > 0 and not reached[-1] >> rest & 1:
            n = min(lot, left)
            reached.append((reached[-1] | reached[-1] << (n * int(sizes[i]))) & mask)
            lots.append((i, n))
            left, lot = left - n, lot * 2
    goal = reached[-1].bit_length() - 1
    for j in range(len(lots), 0, -1):
        if not reached[j - 1] >> goal & 1:
            i, n = lots[j - 1]
            take[i] += n
            goal -= n * int(sizes[i])
    return take


def source_targets(totals: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target: share of all sizes dealt by weight, none above cap times its size.

    Dealing out the excess again until nobody is above its cap ends at target = min(cap * size, level * weight)
    with one level for all; sources in order of cap * size / weight reach their cap first. The sources are ordered
    as a whole, so they meet in one task: their number must be small, not that of hosts or users.
    """
    n = len(weights)
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % n + 1).cast("int"))
    rows = totals.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    rows = rows.withColumn("_turn", F.col("_cap") / F.col("_w"))
    order = Window.orderBy("_turn", F.col("source").asc_nulls_last())
    before, everyone = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = (
        rows.withColumn("_capped", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_w_left", F.sum("_w").over(everyone) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_pot", F.sum("source_size").over(everyone) * F.lit(float(share)))
        .withColumn("_level", (F.col("_pot") - F.col("_capped")) / F.col("_w_left"))
    )
    # The level of the first source that stays below its cap holds for all; there is none if all are capped.
    level = F.min(F.when(F.col("_level") <= F.col("_turn"), F.struct("_turn", "_level"))).over(everyone)["_level"]
    rows = rows.withColumn("_all", level)
    target = F.when(F.col("_all").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_all") * F.col("_w")))
    return rows.select("source", "source_size", target.alias("target"))


def _fit(seed: int):
    def run(hist: pd.DataFrame) -> pd.DataFrame:
        hist = hist.sort_values("size", kind="stable")
        size, target = int(hist["source_size"].iloc[0]), float(hist["target"].iloc[0])
        rounds = min(int(target // size), int(CAP)) if size else 0
        rest = int(round(target - rounds * size)) if size else 0
        take = fit_counts(hist["size"].to_numpy(), hist["n"].to_numpy(), rest, seed)
        return pd.DataFrame({"source": hist["source"], "size": hist["size"], "source_size": size, "target": target, "rounds": rounds, "more": take})

    return run


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies.

    Size is the number of words; a source takes all of its documents as often as its target holds its size, and
    of the remaining budget the documents that fit_counts() chooses by length: of each length those with the smallest
    seeded hashes, so reruns agree. A length's documents are ranked within hash ranges, about the
    square root of the row count of them, so no length needs one task. Sources are ordered by code point with null last.
    Null and empty texts have size 0 and are taken 0 words; of repeated rows each counts; an empty table
    gives no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    size = F.regexp_count(empty_if_null(text_col), F.lit(WORD)).cast("long")
    # Rows without an id are told apart by their texts.
    hashed = F.when(F.col(id_col).isNull(), F.xxhash64(F.lit(seed), F.col(text_col))).otherwise(F.xxhash64(F.lit(seed), F.col(id_col)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), hashed.alias("_h"))
    rows = scratch.write(rows, "sizes")
    parts = salt_count(rows)
    rows = rows.withColumn("_part", F.floor((F.col("_h").cast("double") + 2.0**63) / 2.0**64 * parts).cast("long"))
    counted = rows.groupBy("source", "size", "_part").agg(F.count("*").alias("n"))
    hist = counted.groupBy("source", "size").agg(F.sum("n").alias("n"))
    totals = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = source_targets(totals, weights, share)
    h, t = hist.alias("h"), targets.alias("t")
    hist = h.join(t, F.col("h.source").eqNullSafe(F.col("t.source"))).select("h.source", "size", "n", "source_size", "target")
    # A group is a source's lengths, not its documents.
    plan = hist.groupBy("source").applyInPandas(_fit(seed), "source string, size long, source_size long, target double, rounds long, more long")
    plan = scratch.write(plan, "plan")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source", "size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counted.select("source", "size", "_part", before.alias("_before"))
    # Their sizes follow the data, so both sides of these joins are shuffled, not broadcast.
    c, p = starts.alias("c"), plan.hint("merge").alias("p")
    starts = c.join(p, F.col("c.source").eqNullSafe(F.col("p.source")) & (F.col("c.size") == F.col("p.size"))).select("c.source", "c.size", "c._part", "_before", "source_size", "target", "rounds", "more")
    rank = F.row_number().over(Window.partitionBy("source", "size", "_part").orderBy("_h", "doc_id"))
    r, s = rows.withColumn("_rank", rank).alias("r"), starts.hint("merge").alias("s")
    out = r.join(s, F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.size") == F.col("s.size")) & (F.col("r._part") == F.col("s._part")))
    copies = F.col("rounds") + (F.col("_before") + F.col("_rank") <= F.col("more")).cast("long")
    return out.select(F.col("r.doc_id").alias("doc_id"), F.col("r.size").alias("size"), "source_size", "target", (copies * F.col("r.size")).alias("taken"), copies.alias("copies"))


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it is taken, with their own columns.

    Rows that repeat an id are matched to its results in any order: they agree in source and hash.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    chosen = mix(docs, **options).where("copies > 0")
    chosen = chosen.groupBy(null_safe_key("doc_id").alias("_key"), F.col("size").alias("_size")).agg(F.sort_array(F.collect_list("copies"), asc=False).alias("_copies"))
    sized = docs.select(whole_row(docs), F.regexp_count(empty_if_null(text_col), F.lit(WORD)).cast("long").alias("_size"), null_safe_key(id_col).alias("_key"))
    joined = sized.join(chosen.hint("merge"), ["_key", "_size"])
    nth = F.row_number().over(Window.partitionBy("_key", "_size").orderBy("_key"))
    taken = joined.withColumn("_nth", nth).withColumn("_k", F.try_element_at("_copies", F.col("_nth").cast("int"))).where("_k > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_k").cast("int"))).alias("_copy")).select("_row.*")
