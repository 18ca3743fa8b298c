"""License scans by diagonal voting of word k-grams against licence templates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Memo

K = 2
#: Diagonals at most so far apart belong to one occurrence with words put in or left out.
NEIGHBOUR = 3
#: Part of a template's k-grams that an occurrence must have; short templates must be whole.
MIN_COVER, SHORT = 0.75, 10
#: Words that an occurrence may have for each template word.
MAX_STRETCH = 1.5

# Phrases and labels that the base report counts.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Notices of public licences with their short names.
NOTICES = [
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-sa", "licensed under cc by sa"),
    ("cc-by-nd", "licensed under cc by nd"),
    ("cc0-1.0", "cc0 1 0 universal"),
    ("gpl-2.0", "gnu general public license version 2"),
    ("gpl-3.0", "gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    # Whole notices.
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without "
        "restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the "
        "software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a "
        "particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract "
        "tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must "
        "retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of "
        "conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and "
        "contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission "
        "notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of "
        "merchantability and fitness",
    ),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache "
        "org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or "
        "conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    (
        "gpl-3.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either "
        "version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied "
        "warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    ),
    # Short forms that name the licence only.
    ("apache-2.0", "apache license version 2 0"),
    ("apache-2.0", "under the apache license"),
    ("apache-2.0", "under apache 2 0"),
    ("mit", "under the mit license"),
    ("mit", "under an mit license"),
    ("mit", "under mit license"),
    ("bsd", "under the bsd license"),
    ("bsd", "under a bsd license"),
    ("mpl-2.0", "mozilla public license version 2 0"),
    ("mpl-2.0", "mozilla public license 2 0"),
    ("isc", "under the isc license"),
    ("unlicense", "under the unlicense"),
]

# K-grams of these words alone are too common to vote.
COMMON = "a an and any are as at be by for from if in is it not of on or that the this to was were with you".split()

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    base: bool


def default_templates() -> list[Template]:
    return [Template(v, tuple(k.split()), True) for k, v in BASE.items()] + [Template(k, tuple(v.split()), False) for k, v in NOTICES]


def word_memo() -> Memo:
    """word -> 64-bit hash."""
    return Memo(xxhash.xxh64_intdigest)


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode("utf-8", "replace").lower())


def gram_hashes(words: list[bytes], memo: Memo, k: int = K) -> np.ndarray:
    """Rolling hashes of all word k-grams, in order; never 0, which marks the document itself."""
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    rolled = h[:n].copy()
    for j in range(1, k):
        rolled = rolled * _ODD + h[j : j + n]
        rolled ^= rolled >> np.uint64(29)
    rolled[rolled == 0] = 1
    return rolled.view(np.int64)


def template_positions(templates: list[Template], k: int = K) -> list[tuple[int, int, int]]:
    """(gram, template, position) of the grams that vote, and the row (0, -1, 0) that stands for every document."""
    memo, common, rows = word_memo(), set(COMMON), [(0, -1, 0)]
    for t, template in enumerate(templates):
        for at, gram in enumerate(gram_hashes([w.encode() for w in template.words], memo, k).tolist()):
            if template.base or not common.issuperset(template.words[at : at + k]):
                rows.append((gram, t, at))
    return rows


def _document_grams(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, context = word_memo(), TaskContext.get()
        uid = (context.partitionId() if context else 0) << 36
        start = np.zeros(1, np.int64)
        for whole in batches:
            for at in range(0, len(whole), 400):
                batch = whole.slice(at, 400)
                words = [words_of(t) for t in batch.column("text").to_pylist()]
                grams = [x for w in words for x in (start, gram_hashes(w, memo, k))]
                ends = np.cumsum([0, *(1 + max(0, len(w) - k + 1) for w in words)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(grams)))
                ids = pa.array(np.arange(uid, uid + len(batch)))
                uid += len(batch)
                yield pa.RecordBatch.from_arrays([ids, batch.column("doc_id"), pa.array([len(w) for w in words], pa.int64()), lists], ["uid", "doc_id", "n_words", "grams"])

    return run


def scan(docs: DataFrame, templates: list[Template] | None = None, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verified occurrences: uid, doc_id, n_words, template, start, n_span, cover; and a row with template -1 for every document.

    Every word k-gram of every whole text is joined to the template positions (a fixed list, broadcast). Hits are
    counted by diagonal (word position less template position), diagonals up to NEIGHBOUR apart merge, and the merged
    span stands if its words hold enough of the template's k-grams without too many words between; else its fullest diagonal
    stands if it holds enough. A base template
    stands where all its grams lie on one diagonal, so its words stand consecutively. uid numbers rows, so repeated ids
    stay apart; null text has no words; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    templates = templates or default_templates()
    positions = template_positions(templates, k)
    index = spark.createDataFrame(positions, "gram long, template int, at int")
    sizes = [sum(1 for p in positions if p[1] == t) for t in range(len(templates))]
    facts = [(t, x.base, len(x.words), sizes[t]) for t, x in enumerate(templates)] + [(-1, False, 0, 1)]
    facts = spark.createDataFrame(facts, "template int, base boolean, n_template int, n_grams int")
    grams = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_document_grams(k), "uid long, doc_id long, n_words long, grams array<long>")
    # Place 0 of each array is the document's own mark, so a word's place is one less.
    placed = grams.select("uid", "doc_id", "n_words", F.posexplode("grams").alias("place", "gram"))
    hits = placed.join(F.broadcast(index), "gram").select("uid", "doc_id", "n_words", "template", "at", (F.col("place") - 1).alias("pos"))
    hits = hits.repartition("uid")
    lines = hits.groupBy("uid", "doc_id", "n_words", "template", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("ats"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    lines = lines.join(F.broadcast(facts), "template")
    order = Window.partitionBy("uid", "template").orderBy("diagonal")
    apart = F.col("base") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > NEIGHBOUR, F.lit(True))
    lines = lines.withColumn("_cut", apart.cast("int")).withColumn("_run", F.sum("_cut").over(order))
    spans = lines.groupBy("uid", "doc_id", "n_words", "template", "_run", "base", "n_template", "n_grams").agg(
        # Long notices repeat word pairs, whose diagonals lie beside the true one: a span starts by the diagonal of its first hit.
        F.greatest(F.lit(0), F.min(F.struct("lo", "diagonal"))["diagonal"]).alias("start"),
        (F.max("hi") - F.min("lo") + k).alias("n_span"),
        (F.size(F.array_distinct(F.flatten(F.collect_list("ats")))) / F.col("n_grams")).alias("cover"),
        F.max(F.struct(F.size("ats").alias("n"), (-F.col("diagonal")).alias("back"), (F.col("hi") - F.col("lo") + k).alias("n_span"))).alias("one"),
    )
    whole = F.col("base") | (F.col("n_template") <= SHORT)
    enough = F.when(whole, 1.0).otherwise(MIN_COVER)
    good = (F.col("cover") >= enough) & (F.col("n_span") <= F.col("n_template") * F.when(whole, 1.0).otherwise(MAX_STRETCH))
    # Where the chain doesn't stand, its fullest diagonal may: no words lie between there.
    alone = ~good & (F.col("one.n") / F.col("n_grams") >= enough) & (F.col("template") >= 0)
    own = {"start": -F.col("one.back"), "n_span": F.col("one.n_span"), "cover": F.col("one.n") / F.col("n_grams")}
    spans = spans.withColumn("_good", good | alone).withColumns({c: F.when(alone, x).otherwise(F.col(c)) for c, x in own.items()})
    good = F.col("_good")
    return spans.where((F.col("template") == -1) | good).select("uid", "doc_id", "n_words", "template", "start", "n_span", "cover")


def license_report(docs: DataFrame, templates: list[Template] | None = None, **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Score is the best cover of a verified span, 0 without one. Labels are empty strings where there are none.
    """
    templates = templates or default_templates()
    found = scan(docs, templates, **options)
    base = [t for t, x in enumerate(templates) if x.base]
    names = F.when(F.col("template") >= 0, F.get(F.array(*[F.lit(x.label) for x in templates]), F.col("template")))
    is_base = F.col("template").isin(base)
    joined = lambda labels: F.array_join(F.array_sort(labels), ",")
    rows = found.withColumn("_label", names).withColumn("_base", is_base)
    return (
        rows.groupBy("uid", "doc_id", "n_words")
        .agg(
            F.count_if("_base").alias("n_base"),
            F.min(F.when(F.col("_base"), F.col("start"))).cast("long").alias("first_word"),
            F.max(F.when(F.col("_base"), F.col("start"))).cast("long").alias("last_word"),
            joined(F.collect_set(F.when(F.col("_base"), F.col("_label")))).alias("base_labels"),
            joined(F.collect_set("_label")).alias("labels"),
            F.max(F.when(F.col("template") >= 0, F.col("cover")).otherwise(F.lit(0.0))).alias("score"),
        )
        .select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    )
