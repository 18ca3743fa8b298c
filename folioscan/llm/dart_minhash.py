"""Near-duplicate classes by DartMinHash signatures of weighted word shingles and banded joining."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .common import empty_if_null, group_in_two_levels, null_safe_key, one_row_each, salt_count
from .graph import connected_components, named_classes, small_side, star_rounds

SHINGLE = 5
SIMILARITY = 0.8
#: Bands and rows a band: two texts of similarity 0.8 share a band with chance 0.997, of 0.85 with 0.99996.
BANDS, ROWS = 32, 8
_WORD = re.compile(r"\w+")
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = x ^ (x >> _U(32))
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1] from hashes."""
    y = (x >> _U(11)).astype(np.float64)
    y += 1
    y *= 2.0**-53
    return y


def _step(n: int, odd: int) -> np.uint64:
    return _U(n * odd & 0xFFFFFFFFFFFFFFFF)


def darts(key: np.ndarray, weight: np.ndarray, doc: np.ndarray, reach: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """Earliest dart of each document at each of k coordinates, as ranks (infinite: none within reach).

    Every element throws the same hashed darts at a plane of weight and rank, in every document: a Poisson process
    of rate one, dealt with by dyadic weight regions [0, 1), [1, 2), [2, 4) and so on. A dart counts for a document if it
    lies below the element's weight there and its rank is below the document's reach; it falls on one coordinate. Only darts
    within reach are made, so the work is about reach times total weight, whatever the number of elements. The rank
    uses a throw's upper 53 bits; where the eleven others can hold a coordinate, they give it.
    """
    best = np.full(n_docs * k, np.inf)
    level, low, width = 0, 0.0, 1.0
    spare = k <= 2048 and k & (k - 1) == 0
    seeds = mix(key)
    while len(seeds):
        region = mix(seeds + _step(level, 0x9E3779B97F4A7C15))
        partly = level > 0 or bool((weight < 1).any())
        w, first, far = weight, doc * k, reach[doc]
        rank, step = np.zeros(len(region)), 0
        while len(region):
            throw = mix(region + _step(step + 1, 0xC2B2AE3D27D4EB4F))
            rank = rank - np.log(unit(throw)) / width
            near = np.flatnonzero(rank < far)
            if len(near) < len(region):
                region, throw, rank, first, far = (x.take(near) for x in (region, throw, rank, first, far))
                w = w.take(near) if partly else w
            coordinate = first + ((throw & _U(k - 1)) if spare else (mix(throw) % _U(k))).astype(np.int64)
            if partly:
                hit = low + unit(mix(throw + _U(1))) * width < w
                np.minimum.at(best, coordinate[hit], rank[hit])
            else:
                np.minimum.at(best, coordinate, rank)
            step += 1
        level, low, width = level + 1, 2.0**level, 2.0**level
        deeper = weight > low
        seeds, weight, doc = seeds[deeper], weight[deeper], doc[deeper]
    return best.reshape(n_docs, k)


def signatures(key: np.ndarray, weight: np.ndarray, doc: np.ndarray, n_docs: int, k: int = BANDS * ROWS) -> np.ndarray:
    """DartMinHash signatures of n_docs weighted sets given as (element hash, weight, document) triples.

    Two sets agree at a coordinate with chance sum(min) / sum(max) of their weights. Documents with a coordinate
    that no dart reached throw again twice as far. Each must have an element of positive weight.
    """
    total = np.bincount(doc, weight, n_docs)
    reach = k * (np.log(k) + 4.0) / total
    out = darts(key, weight, doc, reach, n_docs, k)
    while len(lacking := np.flatnonzero(~np.isfinite(out).all(1))):
        place = np.full(n_docs, -1)
        place[lacking] = np.arange(len(lacking))
        mine = place[doc] >= 0
        reach[lacking] *= 2
        out[lacking] = darts(key[mine], weight[mine], place[doc[mine]], reach[lacking], len(lacking), k)
    return out.view(np.uint64)


class Powers:
    """Powers of an odd number modulo 2^64, and of its inverse, made longer when needed."""

    def __init__(self, base: int = _BASE):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 14)
            ups, downs = np.full(size, self.base, np.uint64), np.full(size, self.inverse, np.uint64)
            ups[0] = downs[0] = 1
            self.up, self.down = np.cumprod(ups), np.cumprod(downs)
        return self.up[:n], self.down[:n]


def word_hashes(words: list[str], powers: Powers) -> np.ndarray:
    """64-bit hashes of words, all at once: of each the sum of its characters' hashes times powers by place."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    up, down = powers.upto(len(points) + 1)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(mix(points + _U(1)) * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def shingle_counts(words: list[str], powers: Powers, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the word shingles; fewer words than a shingle has make one."""
    h = word_hashes(words, powers)
    n = max(1, len(h) - size + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(min(size, len(h))):
        rolled = mix(rolled + _U(j + 1)) + h[j : j + n]
    return np.unique(mix(rolled), return_counts=True)


def multiset(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sorted 32-bit hashes of (shingle, occurrence): common members over all members is the weighted similarity."""
    if len(counts) and counts.max() > 1:
        which = np.repeat(np.arange(len(counts)), counts)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
        hashes = mix(hashes[which] + nth.astype(np.uint64))
    return np.unique((mix(hashes) >> _U(32)).astype(np.uint32))


SKETCH = "uid long, doc_id long, raw string, digest string, size long, bands array<long>, bits array<long>, members binary"


def _sketch(bands: int, rows: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, k = Powers(), bands * rows
        context = TaskContext.get()
        uid = (context.partitionId() if context else 0) << 36
        for whole in batches:
            for at in range(0, len(whole), 250):
                batch = whole.slice(at, 250)
                n, digests, held = len(batch), [], []
                for text in batch.column("text"):
                    text = text.as_py() or ""
                    words = _WORD.findall(text.lower())
                    own = " ".join(words) if words else "\0" + text
                    digests.append(xxhash.xxh3_128_hexdigest(own.encode("utf-8", "replace")))
                    held.append(shingle_counts(words, powers, shingle) if words else None)
                full = [i for i, x in enumerate(held) if x is not None]
                band_lists, bit_lists, members, sizes = [[]] * n, [[]] * n, [b""] * n, [0] * n
                if full:
                    keys = np.concatenate([held[i][0] for i in full])
                    weights = np.concatenate([held[i][1] for i in full]).astype(np.float64)
                    doc = np.repeat(np.arange(len(full)), [len(held[i][0]) for i in full])
                    signed = signatures(keys, weights, doc, len(full), k)
                    folded = np.zeros((len(full), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
                    parts = signed.reshape(len(full), bands, rows)
                    for r in range(rows):
                        folded = mix(folded + parts[:, :, r] * _U(0x9E3779B97F4A7C15))
                    bits = np.packbits((mix(signed) & _U(1)).astype(np.uint8), axis=1)
                    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(np.int64)
                    for j, i in enumerate(full):
                        band_lists[i], bit_lists[i] = folded[j].view(np.int64), bits[j]
                        own = multiset(*held[i])
                        members[i], sizes[i] = own.tobytes(), len(own)
                longs = pa.list_(pa.int64())
                ids = pa.array(np.arange(uid, uid + n))
                uid += n
                arrays = [ids, batch.column("doc_id"), batch.column("raw"), pa.array(digests), pa.array(sizes, pa.int64()), pa.array(band_lists, longs), pa.array(bit_lists, longs), pa.array(members, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in SKETCH.split(", ")])

    return run


def similar(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    """Whether the common members of two sorted sets are at least that part of all."""
    both = np.sort(np.concatenate([x, y]))
    common = int((both[1:] == both[:-1]).sum())
    return common >= threshold * (len(both) - common)


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similar(np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32), threshold) for x, y in zip(batch.column("x"), batch.column("y"))]
            kept = batch.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(c) for c in ("a", "b", "ra", "rb")], ["a", "b", "ra", "rb"])

    return run


def _only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose uid is among ids (a written table with column uid, distinct)."""
    return rows.join(small_side(ids), "uid", "left_semi")


def _links(pairs: DataFrame, sketches: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """The edges (a, b) between the roots ra, rb of the pairs (a, b) whose members are similar enough; pairs is written."""
    ids = scratch.write(pairs.select(F.col("a").alias("uid")).union(pairs.select("b")).distinct(), "ids")
    members = _only(sketches.select("uid", "members"), ids)
    x = members.select(F.col("uid").alias("a"), F.col("members").alias("x")).hint("merge")
    y = members.select(F.col("uid").alias("b"), F.col("members").alias("y")).hint("merge")
    good = pairs.join(x, "a").join(y, "b").select("a", "b", "ra", "rb", "x", "y").mapInArrow(_verify(threshold), "a long, b long, ra long, rb long")
    out = scratch.write(good.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links")
    scratch.drop(ids)
    return out


def _members_one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, len(whole), 250):
            batch = whole.slice(at, 250)
            own = [np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column("members")]
            uids = np.repeat(batch.column("uid").to_numpy(), [len(x) for x in own])
            members = np.concatenate(own).astype(np.int64)
            for start in range(0, len(uids), 100_000):
                part = slice(start, start + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(uids[part]), pa.array(members[part])], ["uid", "member"])


def _rest(shared: DataFrame, roots: DataFrame, texts: DataFrame, sketches: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """(bucket, uid, root, facts: size, common, bits, bands) of the texts in buckets that still hold several components.

    common is how many of a text's members another text of these buckets has as well. A text can share no more than those with
    any, so one with fewer than the similarity asks for has no link left and leaves.
    """
    rooted = shared.join(roots.hint("merge"), F.col("uid") == F.col("node"), "left").select("band", "uid", "centre", F.coalesce("root", "uid").alias("root"))
    rooted = scratch.write(rooted, "rooted")
    split = rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band")
    # A bucket's centre has met all others of its bucket.
    left = rooted.join(split.hint("merge"), "band", "left_semi").where("uid <> centre").select("band", "uid", "root")
    left = scratch.write(left, "left")
    ids = scratch.write(left.select("uid").distinct(), "left-ids")
    members = _only(sketches.select("uid", "members"), ids).mapInArrow(_members_one_by_one, "uid long, member long")
    lone = members.groupBy("member").agg(F.count("*").alias("n"), F.min("uid").alias("uid")).where("n = 1").groupBy("uid").agg(F.count("*").alias("lone"))
    facts = _only(texts.select("uid", "size", "bits", "bands"), ids).join(lone.hint("merge"), "uid", "left")
    facts = facts.select("uid", "size", "bits", "bands", (F.col("size") - F.coalesce("lone", F.lit(0))).alias("common")).where(F.col("common") >= similarity * F.col("size"))
    facts = facts.select("uid", F.struct("size", "common", "bits", "bands").alias("facts"))
    out = scratch.write(left.join(facts.hint("merge"), "uid").select(F.col("band").alias("bucket"), "uid", "root", "facts"), "rest")
    scratch.drop(rooted, left, ids)
    return out


def _could_be_similar(similarity: float, k: int):
    """Whether two texts' sizes, common members and signature bits (at four standard deviations) allow the similarity."""
    share = (1 - similarity) / 2
    most_bits = int(np.ceil(k * share + 4 * np.sqrt(k * share * (1 - share))))

    def close(x: str, y: str) -> Column:
        one, other = (lambda name: F.col(f"{x}.facts.{name}")), (lambda name: F.col(f"{y}.facts.{name}"))
        common, sizes = F.least(one("common"), other("common")), one("size") + other("size")
        differ = sum((F.bit_count(F.get(one("bits"), F.lit(i)).bitwiseXOR(F.get(other("bits"), F.lit(i)))) for i in range(-(-k // 64))), F.lit(0))
        even = F.least(one("size"), other("size")) >= similarity * F.greatest(one("size"), other("size"))
        # A pair meets once, in the first of the buckets that it shares.
        first = F.array_min(F.array_intersect(one("bands"), other("bands"))) == F.col(f"{x}.bucket")
        return even & (common >= similarity * (sizes - common)) & (differ <= most_bits) & first

    return close


def _classes(docs: DataFrame, similarity: float, bands: int, rows: int, shingle: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """One row per row of docs: doc_id, uid, class_id, class_size, kept; and what tells rows apart: uid, doc_id, raw (hash of the text)."""
    scratch = Scratch(docs.sparkSession, "dart")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.sha2(empty_if_null(text_col).cast("binary"), 256).alias("raw"))
    sketches = scratch.write(own.mapInArrow(_sketch(bands, rows, shingle), SKETCH), "sketches")
    # Null ids come last among the rows of a class.
    place = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("id"), "uid").alias("place")
    copies = scratch.write(group_in_two_levels(sketches.select(place, "digest"), ["digest"], "place", salt_count(sketches)), "copies")
    first = copies.where("kept").select("digest", F.col("place.uid").alias("uid"))
    texts = sketches.select("uid", "size", "bands", "bits").join(first.hint("merge"), "uid", "left_semi")
    buckets = scratch.write(texts.select("uid", F.explode("bands").alias("band")), "buckets")
    centres = buckets.groupBy("band").agg(F.min(F.struct(F.xxhash64("band", "uid").alias("h"), F.col("uid").alias("c"))).alias("m"), F.count("*").alias("n"))
    centres = centres.where("n > 1").select("band", F.col("m.c").alias("centre"))
    shared = scratch.write(buckets.join(centres.hint("merge"), "band"), "shared")
    scratch.drop(buckets)
    a, b = F.least("uid", "centre"), F.greatest("uid", "centre")
    pairs = scratch.write(shared.where("uid <> centre").select(a.alias("a"), b.alias("b"), a.alias("ra"), b.alias("rb")).distinct(), "pairs")
    links = _links(pairs, sketches, similarity, scratch)
    scratch.drop(pairs)
    roots = connected_components(links, scratch, "roots")
    rest = _rest(shared, roots, texts, sketches, similarity, scratch)
    scratch.drop(links, shared)
    shared_part = F.col("facts.common") / F.col("facts.size")
    found = star_rounds(rest, _could_be_similar(similarity, bands * rows), shared_part, lambda pairs: _links(pairs, sketches, similarity, scratch), scratch)
    names = scratch.write(sketches.select("uid", "doc_id", "raw"), "names")
    scratch.drop(sketches)
    if found:
        edges = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        for links in found:
            edges = edges.union(links)
        edges = scratch.write(edges, "edges")
        scratch.drop(roots, *found)
        final = connected_components(edges, scratch, "last")
        scratch.drop(edges)
    else:
        final = roots
    return named_classes(copies, final, scratch).withColumnRenamed("id", "doc_id"), names


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id, class_size, kept.

    Texts are linked when the weighted Jaccard similarity of their word shingles (lower-cased words, weight: number of
    occurrences) is at least `similarity`; classes are the components of the links and class_id is the smallest doc_id of
    one. Equal word sequences are one text. Links are found in rounds, each verified on all shingles: in each band bucket every text
    meets the bucket's own centre, which joins large groups without their pairs; then star_rounds() takes the
    buckets that still hold several components. So no pair that shares a band is left untested.

    A text without words is linked only to texts identical to it; null counts as empty. Rows are told apart by their place, not
    their id: rows that share a doc_id, or have none, are each in the class of their own text, and of a class one row is kept, that with the
    smallest doc_id (null last). An empty table gives no rows; other columns are not read.
    """
    return _classes(docs, similarity, bands, rows, shingle, id_col, text_col)[0].drop("uid")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs that stand for their class of near duplicates, one of each, with their own columns."""
    classes, names = _classes(docs, similarity, bands, rows, shingle, id_col, text_col)
    kept = names.join(classes.where("kept").select("uid").hint("merge"), "uid", "left_semi").select(null_safe_key("doc_id").alias("_key"), F.col("raw").alias("_raw"))
    raw = F.sha2(empty_if_null(text_col).cast("binary"), 256)
    return one_row_each(docs, [null_safe_key(F.col(id_col).cast("long")), raw], kept)
