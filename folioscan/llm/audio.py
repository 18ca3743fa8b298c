"""Chroma audio fingerprints of a media column, and alignment of recordings by offset histograms and bit errors."""

from __future__ import annotations

import io
import wave
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch
from .common import group_in_two_levels, salt_count
from .graph import connected_components, named_classes, renamed, small_side, star_rounds

#: Analysis frames.
FRAME, HOP = 1024, 256
LOWEST, HIGHEST = 100.0, 1800.0
#: Two recordings are one if, aligned, this many packed integers overlap and at most this part of their bits differ.
MIN_OVERLAP, MAX_BIT_ERRORS = 16, 0.15
SPAN = 8
#: A place's word is its integer and that GAP places on, 64 bits. Words that agree in all KEY_BITS sampled bits of one of TABLES
#: samples and differ in at most WORD_ERRORS bits vote for their offset.
GAP, KEY_BITS, TABLES, WORD_ERRORS = 4, 30, 4, 12

Decoder = Callable[[object], tuple[np.ndarray, int]]


def decode_wav(data: bytes | None) -> tuple[np.ndarray, int]:
    """Samples in -1 to 1 (mean of the channels) and rate of a WAV file of 8 or 16 bits; nothing for what isn't one."""
    try:
        with wave.open(io.BytesIO(data or b"")) as w:
            raw, width, channels, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    except (wave.Error, EOFError):
        return np.zeros(0), 8000
    if width not in (1, 2):
        return np.zeros(0), rate
    x = np.frombuffer(raw, np.uint8).astype(float) / 128 - 1 if width == 1 else np.frombuffer(raw, "<i2").astype(float) / 32768
    return x[: len(x) // channels * channels].reshape(-1, channels).mean(1), rate


def render_vector(vector, rate: int = 4000, note: int = 256) -> tuple[np.ndarray, int]:
    """A vector as a recording: one note per number, higher for larger ones, within four octaves."""
    v = np.nan_to_num(np.asarray([] if vector is None else vector, float))
    pitch = np.clip(57 + np.rint(56 * v), 45, 92)
    frequency = np.repeat(440 * 2.0 ** ((pitch - 69) / 12), note)
    return np.sin(2 * np.pi * np.cumsum(frequency) / rate), rate


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Energy of the twelve pitch classes in each frame, scaled to length one; a silent frame is all zero."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    power = np.abs(np.fft.rfft(frames * np.hanning(FRAME), axis=1)) ** 2
    frequency = np.fft.rfftfreq(FRAME, 1 / rate)
    used = np.flatnonzero((frequency >= LOWEST) & (frequency <= HIGHEST))
    classes = np.rint(12 * np.log2(frequency[used] / 440)).astype(int) % 12
    to_class = np.zeros((len(used), 12))
    to_class[np.arange(len(used)), classes] = 1
    energy = power[:, used] @ to_class
    size = np.sqrt((energy**2).sum(1, keepdims=True))
    return np.divide(energy, size, out=np.zeros_like(energy), where=size > 1e-6)


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first class, height, frames) of the sixteen filters: kinds, heights and spans take turns."""
    return [(i % 4, (5 * i) % 9, 3 + i // 4 % 4 if (5 * i) % 9 + 3 + i // 4 % 4 <= 12 else 3, (4, 8, 6, 8)[i // 4]) for i in range(16)]


def fingerprint(image: np.ndarray) -> np.ndarray:
    """Packed 32-bit integers, one for each place where SPAN frames fit: sixteen filters of two bits each.

    A filter compares two parts of a rectangle of frames and pitch classes, with sums from the integral image: early and late
    half, low and high half, crosswise quarters, or middle and outer frames. Places of silence alone have no integer
    and are left out by the caller through `sounding`.
    """
    n = len(image) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(0).cumsum(1)

    def area(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        at = np.arange(n)
        return total[at + t1, c1] - total[at + t0, c1] - total[at + t1, c0] + total[at + t0, c0]

    out = np.zeros(n, np.uint32)
    for k, (kind, low, high, span) in enumerate(filters()):
        top, half, middle = low + high, span // 2, low + high // 2
        whole = area(0, span, low, top)
        if kind == 0:
            one = area(0, half, low, top)
        elif kind == 1:
            one = area(0, span, low, middle)
        elif kind == 2:
            one = area(0, half, low, middle) + area(half, span, middle, top)
        else:
            one = area(span // 4, span - span // 4, low, top)
        value = np.log((1 + one) / (1 + np.maximum(whole - one, 0)))
        level = (value > -0.25).astype(np.uint32) + (value > 0) + (value > 0.25)
        out |= ((level ^ (level >> np.uint32(1))) & np.uint32(3)) << np.uint32(2 * k)
    return out


def sounding(image: np.ndarray) -> np.ndarray:
    """Whether each place of fingerprint() has a frame that isn't silent."""
    if len(image) < SPAN:
        return np.zeros(0, bool)
    return np.lib.stride_tricks.sliding_window_view(image.any(1), SPAN).any(1)


def bit_errors(x: np.ndarray, y: np.ndarray, offset: int) -> tuple[int, float]:
    """Overlap of x and y, with x's place t on y's place t - offset, and the part of its bits that differ."""
    start, end = max(0, offset), min(len(x), len(y) + offset)
    if end <= start:
        return 0, 1.0
    return end - start, float(np.bitwise_count(x[start:end] ^ y[start - offset : end - offset]).mean() / 32)


PRINTS = "uid long, rec_id long, n_codes long, fingerprint_crc32 long, digest string, codes binary, places array<int>, words array<long>"


def words_of(codes: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that sound and their 64-bit words; of a run of equal words the first and the last."""
    if len(codes) <= GAP:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = codes[:-GAP].astype(np.uint64) << np.uint64(32) | codes[GAP:]
    kept = alive[:-GAP] | alive[GAP:]
    same = words[1:] == words[:-1]
    kept[1:-1] &= ~(same[:-1] & same[1:])
    places = np.flatnonzero(kept)
    return places, words[places].view(np.int64)


def samples(tables: int = TABLES, bits: int = KEY_BITS) -> list[int]:
    """Masks of the sampled bits, the same in every run, as signed 64-bit numbers."""
    rng = np.random.default_rng(7)
    masks = [sum(1 << int(b) for b in rng.choice(64, bits, replace=False)) for _ in range(tables)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def fingerprints(media: DataFrame, id_col: str, media_col: str, decode: Decoder = decode_wav) -> DataFrame:
    """uid, rec_id, n_codes, fingerprint_crc32, digest, codes, places, words of each recording; uid numbers rows.

    Recordings that are null, unreadable or shorter than SPAN frames have no code.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        uid = (context.partitionId() if context else 0) << 36
        for whole in batches:
            for at in range(0, len(whole), 500):
                batch, rows = whole.slice(at, 500), []
                for rec, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                    image = chroma(*decode(value.as_py()))
                    codes, alive = fingerprint(image), sounding(image)
                    data = codes.astype("<u4").tobytes()
                    digest = f"{len(codes)}:{xxhash.xxh3_128_hexdigest(data)}" if alive.any() else f"silent:{uid}"
                    rows.append((uid, rec, len(codes), zlib.crc32(data), digest, data, *words_of(codes, alive)))
                    uid += 1
                c = list(zip(*rows))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types)], [n.split()[0] for n in PRINTS.split(", ")])

    return media.select(F.col(id_col).cast("long").alias("rec_id"), F.col(media_col).alias("media")).mapInArrow(run, PRINTS)


def same_sound(x: np.ndarray, y: np.ndarray, offset: int) -> bool:
    """Whether x and y overlap enough at the offset and few enough bits differ there."""
    overlap, errors = bit_errors(x, y, offset)
    return overlap >= MIN_OVERLAP and errors <= MAX_BIT_ERRORS


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets = batch.column("offset").to_pylist()
        good = [same_sound(np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4"), o) for x, y, o in zip(batch.column("x"), batch.column("y"), offsets)]
        kept = batch.filter(pa.array(good, pa.bool_()))
        yield pa.RecordBatch.from_arrays([kept.column("ra"), kept.column("rb")], ["a", "b"])


def _links(pairs: DataFrame, prints: DataFrame, scratch: Scratch) -> DataFrame:
    """The edges (a, b) between the roots of the pairs that sound the same at one of their offsets; pairs is written."""
    ids = scratch.write(pairs.select(F.col("a").alias("uid")).union(pairs.select("b")).distinct(), "ids")
    codes = prints.select("uid", "codes").join(small_side(ids), "uid", "left_semi")
    x, y = codes.select(F.col("uid").alias("a"), F.col("codes").alias("x")), codes.select(F.col("uid").alias("b"), F.col("codes").alias("y"))
    # A pair's histogram: every bin with votes is aligned, the fullest first.
    bins = pairs.groupBy("a", "b", "ra", "rb", "offset").agg(F.count("*").alias("votes"))
    joined = bins.join(x.hint("merge"), "a").join(y.hint("merge"), "b")
    out = scratch.write(joined.select("ra", "rb", "x", "y", "offset").mapInArrow(_aligned, "a long, b long").distinct(), "links")
    scratch.drop(ids)
    return out


def same_recordings(media: DataFrame, id_col: str, media_col: str, decode: Decoder = decode_wav) -> DataFrame:
    """One row per recording: rec_id, n_codes, fingerprint_crc32, class_id, class_size.

    Two recordings are linked if at an offset of their histogram of votes they overlap and agree well
    enough; classes are the components of the links, named by their smallest id. Equal fingerprints are one recording at
    once. Votes come from places whose words agree in a sample of their bits; in each such bucket the members meet some
    centres, round by round, until it holds one component, so no group is expanded into its pairs and none is dropped. Silent, null and
    short recordings are classes of their own; rows are told apart by their place, so repeated and null ids each are in
    the class of their own sound; an empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(media.sparkSession, "audio")
    prints = scratch.write(fingerprints(media, id_col, media_col, decode), "prints")
    place = F.struct(F.col("rec_id").isNull().alias("null"), F.col("rec_id").alias("id"), "uid").alias("place")
    copies = scratch.write(group_in_two_levels(prints.select(place, "digest"), ["digest"], "place", salt_count(prints)), "copies")
    first = copies.where("kept").select(F.col("place.uid").alias("uid"))
    words = prints.join(first.hint("merge"), "uid", "left_semi").select("uid", F.explode(F.arrays_zip("places", "words")).alias("z"))
    keys = [F.xxhash64(F.lit(i), F.col("z.words").bitwiseAND(F.lit(m))) for i, m in enumerate(samples())]
    codes = words.select("uid", F.struct(F.col("z.places").alias("place"), F.col("z.words").alias("word")).alias("facts"), F.explode(F.array(*keys)).alias("bucket"))
    close = lambda x, y: F.bit_count(F.col(f"{x}.facts.word").bitwiseXOR(F.col(f"{y}.facts.word"))) <= WORD_ERRORS
    offset = lambda x, y: {"offset": F.col(f"{x}.facts.place") - F.col(f"{y}.facts.place")}
    # A bucket's centre has the least rank, the same in every bucket, so that a pair's votes come together. Most buckets hold one
    # word, or two that differ too much: they end here, after one exchange.
    whole = Window.partitionBy("bucket")
    centre = F.min(F.struct(F.xxhash64("uid").alias("rank"), "uid", "facts")).over(whole)
    marked = codes.withColumn("c", centre).withColumn("n", F.count("*").over(whole)).where("n > 1")
    near = (F.col("uid") != F.col("c.uid")) & (F.bit_count(F.col("facts.word").bitwiseXOR(F.col("c.facts.word"))) <= WORD_ERRORS)
    marked = scratch.write(marked.withColumn("near", near).where("near OR (n > 2 AND (uid <> c.uid OR facts <> c.facts))"), "marked")
    turned, apart = F.col("uid") < F.col("c.uid"), F.col("facts.place") - F.col("c.facts.place")
    ends = [F.least("uid", "c.uid").alias("a"), F.greatest("uid", "c.uid").alias("b"), F.least("uid", "c.uid").alias("ra"), F.greatest("uid", "c.uid").alias("rb")]
    pairs = scratch.write(marked.where("near").select(*ends, F.when(turned, apart).otherwise(-apart).alias("offset")).distinct(), "pairs")
    first = _links(pairs, prints, scratch)
    roots = connected_components(first, scratch, "roots")
    rest = marked.where("n > 2").select("bucket", "uid", F.col("uid").alias("root"), "facts")
    rest = scratch.write(renamed(rest, roots), "rest")
    scratch.drop(marked, pairs, roots)
    found = [first, *star_rounds(rest, close, F.xxhash64("uid"), lambda pairs: _links(pairs, prints, scratch), scratch, offset)]
    edges = found[0]
    for links in found[1:]:
        edges = edges.union(links)
    facts = scratch.write(prints.select("uid", "n_codes", "fingerprint_crc32"), "facts")
    edges = scratch.write(edges, "edges")
    scratch.drop(prints, *found)
    components = connected_components(edges, scratch, "last")
    scratch.drop(edges)
    named = named_classes(copies, components, scratch)
    return named.join(facts.hint("merge"), "uid").select(F.col("id").alias("rec_id"), "n_codes", "fingerprint_crc32", "class_id", "class_size")
