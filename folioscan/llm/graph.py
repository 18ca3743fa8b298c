"""Connected components over an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

#: Rows up to this number are sent to every executor (some 16 bytes each); beyond it a shuffled join takes their place.
BROADCAST_ROWS = 1_000_000
#: Edges up to this number (16 bytes each) are joined in one task; beyond it components are found by distributed steps.
FEW_EDGES = 200_000


def small_side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, a written table, marked for broadcast if it is small enough, else for a shuffled merge join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.coalesce(F.sum((F.xxhash64("u", "v") / 1024).cast("decimal(38,0)")), F.lit(0))).first()
    return tuple(row)


def _joined_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges that a task sees, by union and find; root is the smallest."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "root"])


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "components", few: int = FEW_EDGES) -> DataFrame:
    """(node, root) of every node of the edges (columns a, b; written), written; root is the smallest id of its component.

    Up to `few` edges one task joins them. Beyond that edges only ever link a node to smaller ones, and each step is a minimum by
    node joined back to the edges, so no component is gathered in a task or on the driver; a node with very many edges can be
    split by adaptive execution. Every step is written to the shared folder, and the step before is deleted. Ends when the edges no
    longer change, which they do after about as many steps as the logarithm of the longest path.
    """
    if edges.limit(few + 1).count() <= few:
        return scratch.write(edges.select("a", "b").coalesce(1).mapInArrow(_joined_here, "node long, root long"), name)
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now = scratch.write(now, f"{name}-edges")
    before, state = None, _state(now)
    while state != before and state[0]:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.write(large, f"{name}-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        done, now = now, scratch.write(small.select("e.u", "e.v").where("u <> v").distinct(), f"{name}-small")
        scratch.drop(done, large)
        before, state = state, _state(now)
    # Settled edges are stars: every other node of a component points at its smallest.
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    out = scratch.write(now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots), name)
    scratch.drop(now)
    return out


def renamed(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """rows with the roots that joined (node, root; written) gives theirs."""
    new = joined.select(F.col("node").alias("root"), F.col("root").alias("_new"))
    return rows.join(small_side(new), "root", "left").withColumn("root", F.coalesce("_new", "root")).select(*rows.columns)


def star_rounds(
    rest: DataFrame,
    close: Callable[[str, str], Column],
    quality: Column,
    links_of: Callable[[DataFrame], DataFrame],
    scratch: Scratch,
    extra: Callable[[str, str], dict[str, Column]] = lambda x, y: {},
) -> list[DataFrame]:
    """Edges between roots that candidates within buckets add, as written tables, one a round that found any.

    rest (written; it is deleted) has bucket, uid, root and facts; a uid with several facts in a bucket is a member for each. A pair of different components has a member outside its bucket's
    largest component. Each round makes some members of each bucket centres, the best of quality first; they meet
    all members of other components there for which close(one, other) holds, and leave; components that the links join
    are one from then on. The first round takes the best of each bucket, later ones 16, 256 ... of those outside its largest component; they go on until no bucket holds several components: no
    pair that close() admits is left untested, and none within a component is made. links_of turns written pairs (a, b, ra, rb, extra
    columns; a below b) into written edges (a, b) between the roots ra, rb of those that hold.
    """
    found: list[DataFrame] = []
    take = 1
    while True:
        by_root = rest.groupBy("bucket", "root").agg(F.count("*").alias("n"))
        main = by_root.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("m"), F.count("*").alias("roots")).where("roots > 1").select("bucket", F.col("m.root").alias("main"))
        now = scratch.write(rest.join(main.hint("merge"), "bucket"), "round")
        scratch.drop(rest)
        if now.isEmpty():
            scratch.drop(now)
            return found
        slot = F.pmod(F.xxhash64("uid", F.lit(take)), F.lit(take)).alias("slot")
        best = F.max(F.struct(quality.alias("quality"), "uid", "root", "facts")).alias("c")
        # The very first centres may be of the largest component too: the best of a bucket reaches most of it.
        centres = now.where("root <> main" if take > 1 else "true").groupBy("bucket", slot).agg(best).select("bucket", "c.uid", "c.root", "c.facts")
        c, m = centres.hint("merge").alias("c"), now.alias("m")
        turned = F.col("c.uid") < F.col("m.uid")
        either = lambda name, one, other: F.when(turned, F.col(f"{one}.{name}")).otherwise(F.col(f"{other}.{name}"))
        ends = {"a": either("uid", "c", "m"), "b": either("uid", "m", "c"), "ra": either("root", "c", "m"), "rb": either("root", "m", "c")}
        more = {k: F.when(turned, x).otherwise(y) for (k, x), y in zip(extra("c", "m").items(), extra("m", "c").values())}
        pairs = m.join(c, (F.col("c.bucket") == F.col("m.bucket")) & (F.col("c.root") != F.col("m.root")) & close("c", "m"))
        pairs = scratch.write(pairs.select(*[v.alias(k) for k, v in (ends | more).items()]).distinct(), "more")
        links = links_of(pairs)
        left = now.drop("main").join(centres.select("bucket", "uid", "facts").hint("merge"), ["bucket", "uid", "facts"], "left_anti")
        # The next round reads what is left twice, so it is written.
        if links.isEmpty():
            rest = scratch.write(left, "rest")
            scratch.drop(links)
        else:
            found.append(links)
            joined = connected_components(links, scratch, "joined")
            rest = scratch.write(renamed(left, joined), "rest")
            scratch.drop(joined)
        scratch.drop(now, pairs)
        take *= 16


def named_classes(copies: DataFrame, components: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per row of copies: id, uid, class_id, class_size, kept.

    copies has each row's place (null mark, id, uid), its group of equal rows (keep_id: the group's first place,
    group_size) and whether it is that first (kept); components (node, root; written, it is deleted) joins groups by
    their first rows' uids. A class is named by the smallest id in it, null last, and keeps one row. Sums are made over the groups
    that components hold, never over the rows of a class.
    """
    facts = copies.where("kept").select("place", "group_size")
    nodes = scratch.write(components.join(facts.hint("merge"), F.col("node") == F.col("place.uid")).select("node", "root", "place", "group_size"), "nodes")
    whole = scratch.write(nodes.groupBy("root").agg(F.min("place").alias("best"), F.sum("group_size").alias("class_size")), "whole")
    named = scratch.write(nodes.select("node", "root").join(small_side(whole), "root").select("node", "best", "class_size"), "named")
    scratch.drop(components, nodes, whole)
    c, f = copies.alias("c"), small_side(named).alias("f")
    out = c.join(f, F.col("c.keep_id.uid") == F.col("f.node"), "left")
    best, size = F.coalesce("f.best", "c.keep_id"), F.coalesce("f.class_size", "c.group_size")
    return out.select("c.place.id", F.col("c.place.uid").alias("uid"), best["id"].alias("class_id"), size.alias("class_size"), (F.col("c.place.uid") == best["uid"]).alias("kept"))
