"""Each operator against a plain version, on small fixtures with nulls, empty and long texts, ties, repeated rows,
empty tables and columns whose names clash with the operators' own."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, _key string, _row string, digest string, size string, label int"


def make(spark, rows):
    """Documents with extra columns of clashing names."""
    full = [(i, t, "en", s, len(t or ""), "x", "k", "r", "d", "s", 7) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def words(n, seed, pool=4000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, words(60 + i % 7, i), f"s{i % 4}") for i in range(60)]
    rows += [(100 + i, words(60, 0), "s0") for i in range(20)]  # one text many times
    rows += [(200, None, None), (201, "", "s1"), (202, "  \n", None), (203, words(9000, 77), "s1"), (204, "one two", "s2"), (204, "one two", "s2")]
    rows += [(205, "one\t two", "s2"), (None, "nameless text", "s3"), (None, "nameless text", "s3"), (206, "ünï ç   x", "s3")]
    return make(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(spark, docs, empty):
    from folioscan.llm.exact_dedup import exact_dedup, keep_first

    source = docs.select("doc_id", "text").collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = collections.defaultdict(list)
    for r in source:
        groups[norm(r.text)].append(r.doc_id)
    for salts in (1, 5, None):
        got = exact_dedup(docs, salts=salts).collect()
        assert len(got) == len(source)
        by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
        kept = collections.Counter()
        for r in got:
            ids = by_sha[r.text_sha256]
            assert r.group_size == len(ids)
            assert r.keep_id == min((i for i in ids if i is not None), default=None)
            kept[r.text_sha256] += r.kept
        assert set(kept.values()) == {1}
    left = keep_first(docs)
    assert left.columns == docs.columns and left.count() == len(groups)
    assert left.first()._row == "r"
    assert exact_dedup(empty).count() == 0 and keep_first(empty).count() == 0


def test_exact_dedup_is_native(docs):
    from folioscan.llm.exact_dedup import exact_dedup

    plan = exact_dedup(docs, salts=3)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_groups_send_winners_only(spark, docs):
    """Level two gets no ids, and level one's exchange of texts has two readers."""
    from folioscan.llm.exact_dedup import exact_dedup

    got = exact_dedup(docs, salts=3)
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan and plan.count("FileScan") + plan.count("Scan ExistingRDD") <= 2
    for line in plan.split("\n"):
        if "collect_list" in line:
            assert "_salt" in line.split("functions=")[0]


def test_groups_of_repeated_and_null_ids(spark):
    """One id, or none, a thousand times: split by salt all the same, and one row of a group is kept."""
    from folioscan.llm.common import group_in_two_levels

    rows = spark.createDataFrame([(i, k) for i in (7, None) for k in ("a", "b") for _ in range(500)] + [(9, "a"), (5, "c"), (5, "c")], "id long, k string").repartition(4)
    for best, want in (("min", {"a": 7, "b": 7, "c": 5}), ("max", {"a": 9, "b": 7, "c": 5})):
        got = group_in_two_levels(rows, ["k"], "id", 8, best).collect()
        assert len(got) == rows.count()
        assert {r.k: (r.keep_id, r.group_size) for r in got} == {"a": (want["a"], 1001), "b": (want["b"], 1000), "c": (5, 2)}
        assert collections.Counter(r.k for r in got if r.kept) == {"a": 1, "b": 1, "c": 1} and all(r.id == r.keep_id for r in got if r.kept)


def test_packing(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from folioscan.llm.packing import SumOfSquares, pack

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    pieces = pack(docs, path).collect()
    ids = collections.defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        ids[r.doc_id].append([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1])
    fill = collections.Counter()
    by_sequence = collections.defaultdict(list)
    total = collections.Counter()
    for p in pieces:
        data = [d[p.start : p.start + p.length] for d in ids[p.doc_id] if len(d) == p.doc_tokens]
        assert p.ids_crc32 in [zlib.crc32(np.array(d, "<u4").tobytes()) for d in data]
        fill[p.sequence_id] += p.length
        by_sequence[p.sequence_id].append((p.offset, p.length))
        total[p.doc_id] += p.length
    assert total == {k: sum(map(len, v)) for k, v in ids.items()}
    assert all(n == 2048 or n & (n - 1) == 0 for n in fill.values())
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
    assert pack(empty, path).count() == 0
    # Placement against the definition: the smallest sum of squares over all levels.
    packer, rng = SumOfSquares(16), random.Random(5)
    for _ in range(400):
        size = rng.randrange(1, 16)
        counts = packer.counts.copy()

        def cost(level, counts=counts, size=size):
            c = counts.copy()
            if level:
                c[level] -= 1
            if level + size < 16:
                c[level + size] += 1
            return int((c[1:16] ** 2).sum())

        options = [h for h in range(0, 17 - size) if h == 0 or counts[h]]
        chosen = packer.place(size)
        assert cost(chosen) == min(map(cost, options)) and chosen == max(h for h in options if cost(h) == cost(chosen))
        packer.add(size, (0,))


def test_ids_by_either_way():
    """Latin and other texts, special tokens and odd white space, against the tokenizer itself."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from folioscan.llm.packing import ChunkIds

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, ours = Tokenizer.from_file(path), ChunkIds(path)
    odd = ["<|endoftext|> a<|startoftext|>b", "ΑΣ σ", "\x00a b", "東京 と", "é e\u0301", "a\u3000b", "don't WE'LL 'tis", "x\x85y\xa0z", "", None, "İı ŉ ſ ß", "½²3", "\ud83dé", "a\x1cb"]
    rng, letters = random.Random(5), [chr(c) for c in (*range(1, 0x180), 0x250, 0x3A3, 0x4E00, 0x301)]
    odd += ["".join(rng.choice(letters if rng.random() < 0.4 else letters[96:122]) for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    for text, ids in zip(odd, ours.of_all(odd)):
        clean = (text or "").encode("utf-8", "replace").decode()
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(clean, add_special_tokens=False).ids, text
    assert ours.latin.of("plain Ünï text") is not None and ours.latin.of("東") is None


def test_windows_left_open_stay_together():
    from folioscan.llm.packing import SHORTEST, Packer

    rng = random.Random(7)
    packer = Packer(0)
    sizes = [rng.randrange(1, 6000) for _ in range(1000)]
    for i, n in enumerate(sizes):
        packer.add(i, np.arange(n, dtype="<u4").tobytes())
    packer.close()
    assert packer.whole + packer.placed + packer.joined == sum(sizes)
    assert packer.placed >= 0.95 * (packer.placed + packer.joined)
    length = collections.Counter()
    for r in packer.rows():
        length[r[5]] += r[2]
    assert all(n == 2048 or n & (n - 1) == 0 for n in length.values())
    assert sum(n < SHORTEST for n in length.values()) <= 6


def test_mixing(spark, docs, empty):
    from folioscan.llm.mixing import fit_counts, mix, take_mix

    rng = random.Random(2)
    for _ in range(60):
        sizes = sorted(rng.sample(range(1, 40), rng.randrange(1, 6)))
        counts = [rng.randrange(1, 5) for _ in sizes]
        total = sum(s * c for s, c in zip(sizes, counts))
        budget = rng.randrange(0, total + 1)
        take = fit_counts(sizes, counts, budget)
        assert all(0 <= t <= c for t, c in zip(take, counts))
        assert budget - max(sizes) <= int(np.dot(take, sizes)) <= budget
    got = mix(docs).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mix(docs.repartition(5)).collect()), key=str)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    source = docs.select("doc_id", "text", "source").collect()
    sizes = collections.Counter()
    for r in source:
        sizes[r.source] += size(r.text)
    order = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, pot = {}, set(order), 1.5 * sum(sizes.values())
    while True:
        left = pot - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    assert len(got) == len(source)
    named = {(r.doc_id, size(r.text)): r.source for r in source}
    taken = collections.Counter()
    for r in got:
        s = named[r.doc_id, r.size]
        assert abs(r.target - target[s]) < 1e-6 and r.source_size == sizes[s] and r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= max(r.size for r in got if named[r.doc_id, r.size] == s) + 1 for s in order)
    rows = take_mix(docs)
    assert rows.columns == docs.columns and rows.count() == sum(r.copies for r in got)
    assert mix(empty).count() == 0 and take_mix(empty).count() == 0


@pytest.fixture(scope="module")
def abusive(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(500):
        bad = i % 4 == 0
        sentences = [words(8, i * 100 + k, 300) for k in range(5)]
        if bad:
            sentences[rng.randrange(5)] += " " + rng.choice(["vileword", "nastyterm"])
        rows.append((i, ". ".join(sentences) + ".", "s"))
        labels.append((i, 0, int(bad)))
    labels += [(0, 0, None), (None, 1, 1), (9999, 0, 1)]
    return make(spark, [*rows, (700, None, "s"), (701, "", "s"), (702, words(20000, 5, 300), "s"), (None, "vileword", "s")]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, abusive, empty):
    from folioscan.llm.toxicity import drop_toxic, score, train

    docs, labels = abusive
    model = train(docs, labels)
    got = {r.doc_id: r for r in score(docs, model).collect()}
    assert len(got) == 504
    tested = [r for i, r in got.items() if i is not None and i < 500 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i is not None)
    assert np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in tested]) > 0.95
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in tested:
        if r.predicted:
            assert any(re.search("vileword|nastyterm", texts[r.doc_id][x.start : x.end]) for x in r.offending)
    assert 0 <= got[700].score < 0.5 and got[700].n_sentences == 0 and got[701].score == 0
    kept = drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.score < 0.5 for r in got.values())
    assert score(empty, model).count() == 0
    bare = train(docs, labels.where("toxic = 2"))
    assert {r.predicted for r in score(docs, bare).collect()} == {0}


def test_noisy_or_by_hand():
    from folioscan.llm.toxicity import Instances, Model, WordFeatures

    model = Model({"bad": 0}, np.array([3.0]), -2.0)
    x = Instances.read(["bad. fine one. also bad bad", None, "good"], WordFeatures(model.vocabulary))
    p = lambda z: 1 / (1 + np.exp(-z))
    want = [1 - (1 - p(1)) ** 2 * (1 - p(-2)), 0, p(-2)]
    assert np.allclose(-np.expm1(-model.log_clean(x, model.sentence_logits(x))), want)


def test_noisy_or_gradient():
    from folioscan.llm.toxicity import Instances, Model, WordFeatures, gradient, loss

    rng = np.random.default_rng(3)
    vocabulary = {f"w{i}": i for i in range(9)}
    texts = [". ".join(words(4, 10 * i + k, 20) for k in range(i % 4)) for i in range(30)]
    x, y = Instances.read(texts, WordFeatures(vocabulary)), rng.integers(0, 2, 30).astype(float)
    y[x.n_sentences == 0] = 0
    weights, bias = rng.normal(0, 1, 9), -1.3
    got, step = gradient(Model(vocabulary, weights, bias), x, y), 1e-6
    for i in range(10):
        move = np.eye(10)[i] * step
        up, down = (loss(Model(vocabulary, weights + d[:9], bias + d[9]), x, y) for d in (move, -move))
        assert abs((up - down) / (2 * step) - got[i]) < 1e-6


def test_offending_sentences(spark):
    """All of them, at places of the text as it is: lower-casing makes some letters longer."""
    from folioscan.llm.toxicity import Model, score

    model = Model({"bad": 0}, np.array([9.0]), -5.0)
    texts = ["İİİ ok. then BAD here! fine。İ bad", "fine. fine", None, "", "bad. bad. bad"]
    got = {r.doc_id: r for r in score(make(spark, [(i, t, "s") for i, t in enumerate(texts)]), model).collect()}
    cut = {i: [texts[i][x.start : x.end] for x in r.offending] for i, r in got.items()}
    assert cut == {0: [" then BAD here", "İ bad"], 1: [], 2: [], 3: [], 4: ["bad", " bad", " bad"]}
    assert got[0].n_sentences == 4 and [got[i].predicted for i in range(5)] == [1, 0, 0, 0, 1]


def test_warc(spark, tmp_path):
    from folioscan.llm.warc import read_archives, round_trip, sha1_base32, write_archives

    big = "<p>" + "ä\r\n\r\nWARC/1.1\r\n" * 3000
    rows = [(1, "http://a/x", "<p>é</p>"), (2, "u", "<p>é</p>"), (3, None, None), (4, "v w", ""), (5, "b", big), (6, "b", big), (6, "b", big), (7, "c", "x\n"), (7, "c", "y"), (None, "n", "n")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    got = round_trip(pages, str(tmp_path / "w"), chunk=1000).collect()
    assert len(got) == len(rows)
    groups = collections.defaultdict(list)
    for i, _, h in rows:
        groups[(h or "").encode()].append(i)
    seen = collections.Counter()
    for r in got:
        digest = r.payload_digest
        payload = next(p for p in groups if base64.b32encode(hashlib.sha1(p).digest()).decode() == digest)
        assert r.payload_bytes == len(payload)
        best = max((i for i in groups[payload] if i is not None), default=None)
        assert r.refers_to == (best if r.record_type == "revisit" else None)
        if r.record_type == "response":
            assert r.page_id == best
            seen[payload] += 1
    assert all(seen[p] == 1 for p in groups)
    chunks = read_archives(spark, str(tmp_path / "w")).where("record_type = 'response'").orderBy("record_id", "chunk_no").collect()
    whole = collections.defaultdict(bytes)
    for c in chunks:
        assert len(c.payload) <= 1000
        whole[c.record_id] += bytes(c.payload)
        assert c.payload_total == len(whole[c.record_id]) and c.payload_digest == base64.b32encode(hashlib.sha1(whole[c.record_id]).digest()).decode()
    assert sorted(whole.values()) == sorted(groups)
    few = round_trip(pages, str(tmp_path / "m"), min_bytes=5000).collect()
    assert sum(r.record_type == "revisit" for r in few) == 2
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert round_trip(none, str(tmp_path / "e")).count() == 0
    value = spark.createDataFrame([(b"abc",)], "b binary").select(sha1_base32(F.col("b"))).first()[0]
    assert value == base64.b32encode(hashlib.sha1(b"abc").digest()).decode()


def test_damaged_archives(spark, tmp_path):
    import gzip

    from folioscan.llm.warc import RecordReader, page_report, read_archives, record_chunks

    digest = lambda data: base64.b32encode(hashlib.sha1(data).digest()).decode()
    data = b"payload " * 300
    whole = b"".join(r + b"\n" for r in record_chunks(1, "u", data, digest(data), "response", None, chunk=500))
    again = b"".join(r + b"\n" for r in record_chunks(2, "u", data, digest(data), "revisit", 1))

    def read(raw):
        reader = RecordReader()
        rows = [row for line in raw.split(b"\n")[:-1] if (row := reader.feed(line))]
        reader.close()
        return rows

    rows = read(whole + again)
    assert len(rows) == 6 and rows[4][7:] == (len(data), digest(data), digest(data), True) and rows[5][2] == "revisit"
    parts = [r + b"\n" for r in record_chunks(1, "u", data, digest(data), "response", None, chunk=500)]
    for bad in (whole[:-40], b"".join(parts[:-1]), b"".join(parts[1:]), whole.replace(b"payload payload", b"payload Payload", 1), b"".join(parts[:2]) + again):
        with pytest.raises(ValueError, match="archive damaged"):
            read(bad)
    for name, raw, good in (("good", whole + again, True), ("lost", again, False), ("other", whole.replace(b"<urn:page:1:", b"<urn:page:3:") + again, False)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.txt.gz").write_bytes(gzip.compress(raw))
        report = page_report(read_archives(spark, str(tmp_path / name)))
        if good:
            assert {tuple(r) for r in report.collect()} == {(1, len(data), digest(data), "response", None), (2, len(data), digest(data), "revisit", 1)}
        else:
            with pytest.raises(Exception, match="revisit without its response"):
                report.collect()


def test_licenses(spark, docs, empty):
    from folioscan.llm.licenses import BASE, license_report

    texts = [
        "All Rights RESERVED. all rights reserved, cc-by and CC BY 4.0", "general public license", "GENERAL  PUBLIC, license general public", "cc", "", None,
        "x " * 50 + "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.",
        "Permission is hereby granted, free of charge, to any kind person obtaining a copy of this software and associated documentation files", "all rights all rights reserved é all", "cc by cc by",
        "of the license you may " * 2000,
    ]
    rows = make(spark, [(i, t, "s") for i, t in enumerate(texts)] + [(0, texts[0], "s"), (None, "cc by", "s")])
    got = license_report(rows).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = "cc by" if r.doc_id is None else texts[r.doc_id] or ""
        found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        places, labels = [], set()
        for phrase, label in BASE.items():
            p = phrase.split()
            hits = [k for k in range(len(found)) if found[k : k + len(p)] == p]
            places += hits
            labels |= {label} if hits else set()
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(found), len(places), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted(labels)) and labels <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    named = {r.doc_id: r for r in got}
    assert named[6].labels == "gpl,gpl-3.0" and named[7].labels == "cc-by,cc-by-nc" and named[8].labels == "mit" and named[11].labels == ""
    assert license_report(empty).count() == 0


def test_license_lines(spark):
    from folioscan.llm.licenses import license_report

    lines = {
        "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0", "All rights reserved.": "reserved", "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc",
        "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Licensed under the MIT license": "mit", "under the Apache License": "apache-2.0",
        "Mozilla Public License, version 2.0": "mpl-2.0", "Released under the BSD license": "bsd", "under the ISC License": "isc", "the license of MIT under review": "", "apache helicopter license": "",
    }
    rows = make(spark, [(i, f"Some words before. {x} Some words after.", "s") for i, x in enumerate(lines)])
    got = {r.doc_id: r for r in license_report(rows).collect()}
    assert [got[i].labels for i in range(len(lines))] == list(lines.values())
    assert all((got[i].score == 1) == bool(x) for i, x in enumerate(lines.values()))


def test_license_beside_a_part_of_itself(spark):
    from folioscan.llm.licenses import license_report, scan

    rows = make(spark, [(1, "Licensed under CC BY-NC (CC BY-NC 4.0)", "s"), (2, "CC BY: licensed under CC BY NC", "s"), (3, "licensed under CC x BY x NC", "s")])
    got = {r.doc_id: r.labels for r in license_report(rows).collect()}
    assert got == {1: "cc-by,cc-by-nc", 2: "cc-by,cc-by-nc", 3: ""}
    assert {(r.doc_id, r.start, r.n_span, r.cover) for r in scan(rows).where("n_span = 5").collect()} == {(1, 0, 5, 1.0), (2, 2, 5, 1.0)}


def test_license_of_several_paragraphs(spark):
    """A whole notice with words put in and left out along the way is one occurrence: its diagonals merge."""
    from folioscan.llm.licenses import NOTICES, scan

    place = max(range(len(NOTICES)), key=lambda i: len(NOTICES[i][1]))
    label, text = NOTICES[place]
    notice = text.split()
    altered = notice[:40] + ["really"] + notice[40:80] + notice[81:] + ["end"]
    rows = make(spark, [(1, "intro words " + " ".join(altered), "s"), (2, " ".join(notice[:60]), "s")])
    found = {r.doc_id: (r.start, r.n_span) for r in scan(rows).where(f"template = {place + 3}").collect()}
    assert label == "mit" and found == {1: (2, len(notice))}


PAGE = """<!doctype html><html><head><title>t</title><script>x="<p>no</p>"</script></head><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">Cookies</div><aside>side</aside>
<article><header><h1>{title} &amp; more</h1></header><p>First&nbsp;{body}
 line <b>bold<p>second &lt;b&gt;<br>same</p><div class="ad">buy</div><ul><li>one<li>two</ul><form><p>f</p></form><blockquote>q</blockquote>
<section id="comments"><p>me too</p></section></article><footer>&copy; x</footer></body></html>"""


def test_html(spark):
    from folioscan.llm.html_extract import Shape, extract, main_text, parse, simple_tree_matching

    want = "T & more\n\nFirst x line bold\n\nsecond <b> same\n\none\n\ntwo\n\nq"
    assert main_text(PAGE.format(title="T", body="x")) == want
    assert main_text("") == "" and main_text("<nav>a</nav>") == "" and main_text("plain < text") == "plain < text"
    assert main_text("<div class=content>a<div>b</div>c</div><div class=footer>d</div>") == "a\n\nb\n\nc"
    assert main_text("<p a='x>y'>t<!-- <p>c</p> --><script>unclosed") == "t"
    a, b = Shape(parse("<div><p>1</p><ul><li>x</li></ul></div>")), Shape(parse("<div><h2>n</h2><p>2</p><ul><li>y</li><li>z</li></ul></div>"))
    score, pairs = simple_tree_matching(a, b)
    assert score == 5 and {(a.labels[i], b.labels[j]) for i, j in pairs} == {("#page",) * 2, ("div",) * 2, ("p",) * 2, ("ul",) * 2, ("li",) * 2}
    # Without an article the host's template goes: a line on every page, though no name marks it.
    rows = [(i, f"http://h{i % 2}.org/{i}", f"<body><div class=top>Daily words of host {i % 2}</div><div class=c><p>text number {i}</p><p>{words(5, i)}</p></div></body>") for i in range(40)]
    rows += [(100, "http://h0.org/z", PAGE.format(title="A", body="b")), (101, None, None), (102, "http://h0.org/e", ""), (0, rows[0][1], rows[0][2]), (103, "http://copies.org/", "<p>same</p>")]
    rows += [(200 + i, "http://copies.org/", "<p>same</p>") for i in range(30)] + [(None, "x", "<p>" + "long " * 30000)]
    pages = spark.createDataFrame([(*r, "host", "html") for r in rows], "page_id long, url string, html string, host string, text string").repartition(4)
    got = {r.page_id: r for r in extract(pages).collect()}
    assert extract(pages).count() == len(rows)
    for i in range(40):
        assert got[i].text == f"text number {i}\n\n{words(5, i)}" and got[i].n_chars == len(got[i].text)
    assert got[100].text.startswith("A & more") and got[101].text == "" and got[102].text == "" and got[103].text == "same"
    assert got[None].n_chars == 30000 * 5 - 1
    assert extract(spark.createDataFrame([], pages.schema)).count() == 0


def _brute_matching(a, b):
    """Simple tree matching by definition, over (label, children) trees."""
    if a[0] != b[0]:
        return 0
    best = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for x, u in enumerate(a[1], 1):
        for y, v in enumerate(b[1], 1):
            best[x][y] = max(best[x - 1][y], best[x][y - 1], best[x - 1][y - 1] + _brute_matching(u, v))
    return 1 + best[-1][-1]


def test_tree_matching():
    from folioscan.llm.html_extract import Node, Shape, Wrapper, simple_tree_matching

    rng = random.Random(11)

    def tree(depth):
        node = Node(rng.choice("abc"))
        last = None
        for _ in range(rng.randrange(4) if depth else 0):
            child = tree(depth - 1)
            if last != (last := repr(plain(child))):  # runs of siblings alike are one node
                node.parts.append(child)
        return node

    def plain(node):
        return (node.tag, [plain(c) for c in node.children])

    for _ in range(400):
        one, other = tree(3), tree(3)
        other.tag = other.label = one.label
        a, b = Shape(one), Shape(other)
        score, pairs = simple_tree_matching(a, b)
        assert score == len(pairs) == _brute_matching(plain(one), plain(other))
        assert all(a.paths[i] == b.paths[j] for i, j in pairs) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == score
        order = sorted(pairs)
        assert [j for _, j in order] == sorted(j for _, j in order)
        w = Wrapper(a.labels, a.sizes)
        assert (w.children, w.keys, w.paths) == (a.children, a.keys, a.paths)
        assert simple_tree_matching(w, b)[0] == score


def test_html_of_great_depth():
    from folioscan.llm.html_extract import HostRules, Shape, main_text, parse, simple_tree_matching

    deep = "<div>" * 10_000 + "<p>inner</p>" + "</div>" * 10_000
    assert main_text(deep) == "inner" and main_text("<article>" + deep + "</article>") == "inner"
    assert main_text("<ul><li>" * 5_000 + "x") == "x"
    a, b = Shape(parse(deep)), Shape(parse(deep.replace("<p>", "<h2>n</h2><p>", 1)))
    assert simple_tree_matching(a, b)[0] == len(a.labels)
    assert HostRules([{"slot": 0, "text": 0}], [], a.labels, a.sizes).decide(b) == (set(), set())


def test_html_names_inside_an_article(spark):
    """There a name drops text only if it is one whole, or if the host's pages show that the part is a menu or stays the same."""
    from folioscan.llm.html_extract import extract, main_text

    kept = ["<section class='discussion'><p>{}</p></section>", "<div class='notice-board content'>{}</div>", "<p class='share-price'>{}</p>", "<div class='menu-of-the-day'>{}</div>"]
    gone = ["<div class='ad'>{}</div>", "<div id='comments'><p>{}</p></div>", "<div class='cookie-notice'>{}</div>", "<div class='share'>{} <p>Share this</p></div>", "<ul class='related-links'><li><a href=/>{}</a></li></ul>"]
    rows = []
    for i in range(12):
        inner = "".join(x.format(f"kept {k} of {i}") for k, x in enumerate(kept)) + "".join(x.format(f"link {i}" if "related" in x else "stays" if "share" in x else f"gone {i}") for x in gone)
        rows.append((i, "http://h.org/", f"<article><h1>t {i}</h1>{inner}<p>end {i}</p></article>"))
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)).collect()}
    for i in range(12):
        assert got[i].split("\n\n") == [f"t {i}", *(f"kept {k} of {i}" for k in range(4)), f"end {i}"]
    assert "Share this" in main_text(rows[0][2])


def test_html_menu_without_names(spark):
    """Link lists that differ from page to page are a menu by their slot; prose with a link is not."""
    from folioscan.llm.html_extract import extract

    page = "<body><div class=x1><ul><li><a href=/>{0}</a></li><li><a href=/>more {0}</a></li></ul></div><div class=x2><p>Text of page {1} with <a href=/>one link</a> in many other words.</p></div></body>"
    rows = [(i, "http://h.org/", page.format(words(3, i), i)) for i in range(12)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == {i: f"Text of page {i} with one link in many other words." for i in range(12)}


def test_html_siblings_of_one_path(spark):
    """Real paragraphs at the path of a constant one stay, whichever page the task sees first."""
    from folioscan.llm.html_extract import extract

    rows = [(i, f"<article><h1>t{i}</h1><p>By staff.</p></article>" if i % 7 == 0 else f"<article><h1>t{i}</h1><p>By staff.</p><h2>s</h2><p>real {i}</p></article>") for i in range(28)]
    # Most pages have the constant one only: it is constant, the others at its path are not.
    rows += [(100 + i, f"<article><h1>u{i}</h1><p>By staff.</p></article>") for i in range(120)]
    for n in (1, 3):
        got = {r.page_id: r.text for r in extract(spark.createDataFrame([(i, "http://a.b/", h) for i, h in rows], "page_id long, url string, html string").coalesce(n)).collect()}
        assert all(f"real {i}" in got[i] for i in range(28) if i % 7)
        assert not any("By staff." in t for t in got.values())


def test_html_copies_of_one_article(spark):
    from folioscan.llm.html_extract import extract, main_text

    page = "<body><div class=top>{0}</div><article><h1>Same title</h1><p>Same text</p><!-- {1} --><div class=ad>buy {1}</div></article></body>"
    rows = [(i, "http://a.b/", page.format("x", i)) for i in range(40)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert {r.text for r in got} == {"Same title\n\nSame text"}
    assert main_text("<article><p>a</p></article><p>b</p>") == "a"


def _jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def _shingles(text):
    w = re.findall(r"\w+", (text or "").lower())
    return collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter()


def _components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_components_by_either_way(spark):
    from folioscan.llm.graph import connected_components
    from folioscan.session import Scratch

    rng = random.Random(2)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(50)] + [(2000, 2001 + i) for i in range(40)]
    want = _components({x for e in links for x in e}, links)
    scratch = Scratch(spark, "test")
    edges = spark.createDataFrame(links, "a long, b long").repartition(3)
    assert {r.node: r.root for r in connected_components(edges, scratch).collect()} == want
    far = {r.node: r.root for r in connected_components(edges, scratch, few=-1).collect()}
    assert far == {n: r for n, r in want.items() if n in far} and all(want[n] == n for n in want if n not in far)
    assert connected_components(edges.limit(0), scratch).count() == 0 and connected_components(edges.limit(0), scratch, few=-1).count() == 0
    scratch.drop_all()


def test_dart_signatures():
    from folioscan.llm.dart_minhash import signatures

    rng = np.random.default_rng(4)
    keys = rng.integers(0, 2**63, 300).astype(np.uint64)
    weights = [np.where(rng.random(300) < 0.7, rng.choice([0.25, 1, 2.5, 9], 300), 0) for _ in range(2)]
    weights[1] = np.where(rng.random(300) < 0.6, weights[0], weights[1])
    used = [np.flatnonzero(w) for w in weights]
    triple = [np.concatenate([keys[u] for u in used]), np.concatenate([w[u] for w, u in zip(weights, used)]), np.repeat([0, 1], [len(u) for u in used])]
    s = signatures(*triple, 2, 4096)
    want = np.minimum(*weights).sum() / np.maximum(*weights).sum()
    assert abs((s[0] == s[1]).mean() - want) < 0.03
    # A signature doesn't depend on the documents beside it, nor on the order of elements.
    turned = [x[: len(used[0])][::-1] for x in triple[:2]]
    assert np.array_equal(signatures(*turned, np.zeros(len(used[0]), int), 1, 4096)[0], s[0])


def test_near_duplicates(spark, docs, empty):
    from folioscan.llm.dart_minhash import keep_representatives, near_duplicates

    rng = random.Random(3)
    rows = [(r.doc_id, r.text, "s") for r in docs.select("doc_id", "text").collect()]
    for k in range(6):
        base = words(120, 1000 + k).split()
        for v in range(12):
            w = list(base)
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(1000)}"
            rows.append((1000 + 20 * k + v, " ".join(w), "s"))
    long = words(80, 5)
    rows += [(1500 + i, long + " " + words(30, 2000 + i), "s") for i in range(40)]  # a shared passage alone is no copy
    rows += [(1600, "!!!", "s"), (1601, "???", "s"), (1602, "!!!", "s")]
    frame = make(spark, rows)
    got = near_duplicates(frame).collect()
    assert len(got) == len(rows)
    named = [(i, t) for i, t, _ in rows if i is not None]
    sets = [(i, _shingles(t), t) for i, t in named]
    links = [(a, b) for k, (a, x, s) in enumerate(sets) for b, y, t in sets[:k] if (x and _jaccard(x, y) >= 0.8) or (not x and s == t)]
    want = _components([i for i, _ in named], links)
    # Null counts as empty, so 200 and 201 hold the same text.
    want[201] = 200
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want
    left = keep_representatives(frame)
    assert left.columns == frame.columns
    ids = [r.doc_id for r in left.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(want.values())) and ids.count(None) == 1
    assert near_duplicates(empty).count() == 0 and keep_representatives(empty).count() == 0


def test_near_duplicates_of_a_spread_group(spark):
    """Many copies of one text, most of them too far from each other: links that no bucket's first centre sees are found."""
    from folioscan.llm.dart_minhash import near_duplicates

    rng = random.Random(6)
    rows, base = [], words(150, 1).split()
    for i in range(90):
        w = list(base)
        for _ in range(rng.randrange(1, 9)):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = [f"e{rng.randrange(10**6)}"]
        rows.append((i, " ".join(w), "s"))
        if i % 9 == 0:
            rows.append((500 + i, " ".join(w[:-1]), "s"))
    sets = [(i, _shingles(t)) for i, t, _ in rows]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if _jaccard(x, y) >= 0.8]
    want = _components([i for i, _ in sets], links)
    assert 10 < len(set(want.values())) < 90
    for bands in (32, 64):
        got = {r.doc_id: (r.class_id, r.class_size) for r in near_duplicates(make(spark, rows), bands=bands).collect()}
        sizes = collections.Counter(want.values())
        assert sum(got[i] == (want[i], sizes[want[i]]) for i in want) >= (0.97 if bands == 32 else 1) * len(want)


def test_near_duplicates_with_repeated_ids(spark):
    from folioscan.llm.dart_minhash import keep_representatives, near_duplicates

    rows = [(1, words(50, 1), "s"), (1, words(50, 2), "s"), (1, words(50, 1), "s"), (2, words(50, 2), "s"), (None, words(50, 3), "s"), (3, words(50, 3), "s"), (None, words(50, 4), "s")]
    got = collections.Counter(tuple(r) for r in near_duplicates(make(spark, rows)).collect())
    assert got == {(1, 1, 2, False): 1, (1, 1, 2, True): 2, (2, 1, 2, False): 1, (None, 3, 2, False): 1, (3, 3, 2, True): 1, (None, None, 1, True): 1}
    left = keep_representatives(make(spark, rows))
    assert sorted(r.text for r in left.collect()) == sorted(words(50, i) for i in (1, 2, 3, 4))


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def test_banded_distance():
    from folioscan.llm.line_dedup import within

    rng = random.Random(1)
    for _ in range(3000):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(14)))
        b = list(a)
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "a", "c"])
        b = "".join(b)
        for k in (1, 2, 3):
            assert within(a, b, k) == min(_distance(a, b), k + 1)


def test_lines(spark, empty):
    from folioscan.llm.line_dedup import MIN_CHARS, drop_repeated_lines, line_classes, line_report

    rng = random.Random(8)
    base = [words(rng.randrange(5, 12), 50 + k) for k in range(30)]

    def edited(line):
        b = list(line)
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(b))
            b[at : at + rng.randrange(2)] = rng.choice(["", "z", "ü"])
        return "".join(b)

    rows = [(i, "\n".join(rng.choice([edited(rng.choice(base)), rng.choice(base), "short", words(6, rng.randrange(9999)), " ", ""]) for _ in range(9)), "s") for i in range(50)]
    rows += [(90, None, "s"), (91, "", "s"), (92, base[0] + "\n" + "\n".join(["same line again and again here"] * 40), "s"), (93, words(8000, 1), "s")]
    frame = make(spark, rows)
    lines = [(i, k, x.strip(" \t\x0b\x0c\r")) for i, t, _ in rows for k, x in enumerate((t or "").split("\n")) if x.strip(" \t\x0b\x0c\r")]
    first = {}
    for i, k, x in sorted(lines):
        first.setdefault(x, (i, k))
    different = list(first)
    links = [(first[a], first[b]) for n, a in enumerate(different) for b in different[:n] if min(len(a), len(b)) >= MIN_CHARS and abs(len(a) - len(b)) <= 2 and _distance(a, b) <= 2]
    want = _components(list(first.values()), links)
    got = {(r.doc_id, r.line_no): ((r.keep_doc_id, r.keep_line_no), r.exact) for r in line_classes(frame).collect()}
    assert got == {(i, k): (want[first[x]], first[x] != (i, k)) for i, k, x in lines}
    report = {r.doc_id: r for r in line_report(frame).collect()}
    assert len(report) == len(rows) and report[90].n_lines == 0 and report[92].n_exact >= 39
    for i, t, _ in rows:
        own = {k: v for (d, k), v in got.items() if d == i}
        dropped = sorted(k for k, (keep, exact) in own.items() if keep != (i, k) or exact)
        assert report[i].n_lines == len(own) and report[i].dropped == dropped and report[i].n_kept == len(own) - len(dropped)
    clean = {r.doc_id: r for r in drop_repeated_lines(frame).collect()}
    assert clean[90].text is None and clean[92].text.count("same line") == 1 and clean[92]._row == "r"
    assert line_report(empty).count() == 0


def test_lines_with_growing_edits(spark):
    from folioscan.llm.line_dedup import SHARE, edits, line_classes, shared_run, within

    assert [edits(n, 2, 0.05) for n in (9, 10, 23, 24, 59, 60, 200)] == [0, 1, 1, 2, 2, 3, 10] and edits(23) == 0 and edits(500) == 2
    assert shared_run(2, 0.05) == min(-(-(n - n // 20) // (n // 20 + 1)) for n in range(60, 5000))
    rng = random.Random(4)
    rows, no = [], 0
    for n in (1, 2, 3, 4, 6, 9, 13, 20, 32, 60, 200):
        for _ in range(4):
            base = words(n, rng.randrange(10**6)) + "!" * rng.randrange(9)
            for most in (0, 0.4, 0.9, 1.0, 1.0, 1.3):
                # Edits spread evenly leave the shortest runs.
                b, e = list(base), round(most * edits(len(base), 2, SHARE))
                for i in range(e, 0, -1):
                    at = i * len(base) // (e + 1)
                    b[at : at + rng.randrange(2)] = rng.choice(["", "z", "ü"])
                rows.append((no := no + 1, "".join(b), "s"))
    rows.append((no + 1, rows[-1][1][:600] + " one two three four five " + rows[-1][1][600:], "s"))
    first = {}
    for i, t, _ in rows:
        first.setdefault(t, i)
    held = list(first)
    links = [(first[a], first[b]) for m, a in enumerate(held) for b in held[:m] if (e := edits(min(len(a), len(b)), 2, SHARE)) and within(a, b, e) <= e]
    want = _components(list(first.values()), links)
    assert sum(len(t) > 60 and want[i] != i for t, i in first.items()) > 50
    got = {r.doc_id: r.keep_doc_id for r in line_classes(make(spark, rows), share=SHARE).collect()}
    assert got == {i: want[first[t]] for i, t, _ in rows}


def test_line_keys_are_small(spark):
    """A text's keys take few bytes on their way, and no pair within the edits is lost to them."""
    from folioscan.llm.line_dedup import SHARE, _emit_grams, _meet, _once, within, within_many

    rng = random.Random(12)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(61, 900))) for _ in range(300)]
    lines = base + [x[:20] + "zz" + x[22:-9] + x[-8:] for x in base]
    batch = pa.RecordBatch.from_arrays([pa.array(lines), pa.array(range(len(lines)), pa.int64())], ["line", "lid"])
    keys = list(_emit_grams(2, SHARE, 4)(iter([batch])))
    assert sum(len(x) for b in keys for x in b.column("data").to_pylist()) < 2 * sum(map(len, lines))
    got = [r for b in _once(_meet(2, SHARE, 4)(iter(keys))) for r in b.to_pylist()]
    lid = {r["a"]: r["b"] for r in got if r["id"]}
    assert {(i, i + 300) for i in range(300)} <= {tuple(sorted((lid[r["a"]], lid[r["b"]]))) for r in got if not r["id"]}
    most = np.array([rng.randrange(1, 60) for _ in base])
    assert within_many(base, lines[300:], most).tolist() == [within(x, y, k) <= k for x, y, k in zip(base, lines[300:], most.tolist())]



def test_near_copies_of_a_line_meet_few():
    """Pairs grow with the copies, not with their square; pairs of lines that no link joins all meet, wherever their edits are."""
    from types import SimpleNamespace

    from folioscan.llm.line_dedup import SHARE, _across, _emit_grams, _meet, _once

    rng = random.Random(5)
    base = [rng.choice("abcdefgh ") for _ in range(400)]
    copies = ["".join(base[:at] + ["z"] + base[at + 1 :]) for at in range(300)]
    # Evenly spread edits leave the shortest runs.
    even = "".join("z" if i % 20 == 10 else c for i, c in enumerate(base))
    lines = [*copies, even]
    batch = pa.RecordBatch.from_arrays([pa.array(lines), pa.array(range(len(lines)), pa.int64())], ["line", "lid"])
    met = list(_meet(2, SHARE, 4)(iter(_emit_grams(2, SHARE, 4)(iter([batch])))))
    got = [r for b in _once(iter(met)) for r in b.to_pylist()]
    lid = {r["a"]: r["b"] for r in got if r["id"]}
    pairs = [(lid[r["a"]], lid[r["b"]]) for r in got if not r["id"]]
    assert {i for p in pairs for i in p} == set(range(301)) and len(pairs) < 20 * len(lines)
    handles = np.array(sorted(h for h, i in lid.items() if i < 300))
    left = [b for b in met if b.column("base")[0].as_py() < 0]

    def across(roots):
        known = SimpleNamespace(value=(handles, np.array(roots)))
        return {tuple(sorted((lid[r["a"]], lid[r["b"]]))) for b in _once(_across(2, SHARE, 4, known)(iter(left))) for r in b.to_pylist()}

    assert across([-1] * 300) == {(i, 300) for i in range(300)}
    assert len(across([-1 - i for i in range(300)])) == 300 * 301 // 2

def test_audio(spark):
    import io
    import wave

    from folioscan.llm.audio import bit_errors, chroma, decode_wav, fingerprint, render_vector, same_recordings

    rng = np.random.default_rng(0)

    def wav(samples):
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(4000)
            w.writeframes((samples * 20000).astype("<i2").tobytes())
        return out.getvalue()

    tunes = [rng.normal(0, 0.125, 64) for _ in range(8)]
    rows = []
    for k, t in enumerate(tunes):
        rows.append((10 * k, wav(render_vector(t)[0])))
        rows.append((10 * k + 1, wav(render_vector(np.concatenate([rng.normal(0, 0.125, 9), t[:50]]))[0] * 0.5)))
        rows.append((10 * k + 2, wav(render_vector(t)[0] + rng.normal(0, 0.01, 64 * 256))))
    rows += [(900, None), (901, b""), (902, b"RIFFnonsense"), (903, wav(np.zeros(9000))), (904, wav(np.zeros(9000))), (0, rows[0][1])]
    frame = spark.createDataFrame([(*r, "c") for r in rows], "id long, media binary, codes string").repartition(3)
    got = same_recordings(frame, "id", "media").collect()
    assert len(got) == len(rows)
    named = {r.rec_id: r.class_id for r in got}
    assert all(named[10 * k + v] == 10 * k for k in range(8) for v in range(3))
    assert [named[i] for i in range(900, 905)] == [900, 901, 902, 903, 904]
    x, y = (fingerprint(chroma(*decode_wav(rows[i][1]))) for i in (0, 1))
    assert bit_errors(y, x, 9)[1] < 0.05 < bit_errors(y, x, 8)[1]
    assert same_recordings(frame.limit(0), "id", "media").count() == 0


def test_audio_against_all_pairs(spark):
    """Shifts of 0 to 255 samples and noise: links against alignments of all pairs at all offsets."""
    from folioscan.llm.audio import chroma, fingerprint, render_vector, same_recordings, same_sound

    rng = np.random.default_rng(5)
    rows = []
    for k in range(24):
        sound = render_vector(rng.normal(0, 0.125, 64))[0]
        rows.append((10 * k, sound))
        rows.append((10 * k + 1, sound[(11 * k) % 256 :] if k % 2 else sound[(11 * k) % 256 :] + rng.normal(0, 0.1, len(sound) - 11 * k % 256)))
        rows.append((10 * k + 2, sound + rng.normal(0, (0.2, 0.3, 0.4, 0.5)[k % 4], len(sound))))
    rows += [(900, np.sin(np.arange(40_000) * 0.7)), (901, np.sin(np.arange(30_000) * 0.7))]  # one tone, long
    prints = {i: fingerprint(chroma(x, 4000)) for i, x in rows}
    ids = sorted(prints)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if any(same_sound(prints[a], prints[b], o) for o in range(-len(prints[b]), len(prints[a])))]
    want = _components(ids, links)
    frame = spark.createDataFrame([(i, x.astype("<f4").tobytes()) for i, x in rows] + [(None, rows[0][1].astype("<f4").tobytes())], "id long, media binary").repartition(3)
    got = same_recordings(frame, "id", "media", lambda data: (np.frombuffer(data or b"", "<f4").astype(float), 4000)).collect()
    named = {r.rec_id: r.class_id for r in got}
    assert named.pop(None) == 0 and len(got) == len(rows) + 1
    found = sum(named[a] == named[b] for a, b in links)
    assert found >= 0.97 * len(links) > 40
    assert all(want[i] == want[named[i]] for i in named)


def _plain_score(model, text):
    """Noisy-or over the sentences of a text, by hand."""
    from folioscan.llm.toxicity import word_features

    clean = 1.0
    for sentence in re.split("[.!?\n…؟।。！？｡]+", text or ""):
        found = {f for w in re.findall(r"\w+", sentence.lower()) for f in word_features(w) if f in model.vocabulary}
        if re.search(r"\w", sentence):
            clean /= 1 + np.exp(model.bias + sum(model.weights[model.vocabulary[f]] for f in found))
    return 1 - clean


def test_pipeline_against_plain_versions(spark, abusive, tmp_path):
    """Every stage on what the one before kept: rows against a plain version, columns as in documents, and tables without rows."""
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline as C
    from folioscan.llm.mixing import mix
    from folioscan.llm.toxicity import train

    docs, labels = abusive
    base = [(i, words(40 + i % 9, 7 * i), f"s{i % 3}") for i in range(2000, 2030)]
    near = [(3000 + k, base[k][1] + " more words", None) for k in range(10)]
    odd = [(None, base[1][1], "s1"), (4000, "  ", "s0"), (4001, None, None), (4002, base[2][1].replace(" ", "  "), "s2"), (2003, base[3][1], "s0")]
    docs = docs.union(make(spark, base + near + odd)).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, stages, sf_dir = now.columns, dict(C.STAGES), str(tmp_path)
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "source_mixing", "packing"]
    rows = [tuple(r) for r in now.collect()]
    key = lambda r: tuple(map(str, r))

    def run(name):
        nonlocal now
        stages[name](spark, now, sf_dir).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        assert now.columns == columns
        return sorted(map(tuple, now.collect()), key=key)

    model = train(now, labels)
    rows = sorted((r for r in rows if _plain_score(model, r[1]) < 0.5), key=key)
    assert run("toxicity") == rows and 350 < len(rows) < 500
    first = lambda held: min(held, key=lambda r: (r[0] is None, r[0]))
    groups = collections.defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r)
    kept = run("exact_dedup")
    assert {(r[0], re.sub(r"\s+", " ", r[1] or "")) for r in kept} == {(first(g)[0], k) for k, g in groups.items()} and len(kept) == len(groups)
    sets = [(k, _shingles(r[1]), r[1] or "") for k, r in enumerate(kept)]
    links = [(a, b) for n, (a, x, s) in enumerate(sets) for b, y, t in sets[:n] if (x and _jaccard(x, y) >= 0.8) or (not x and s == t)]
    classes = collections.defaultdict(list)
    for k, root in _components(range(len(kept)), links).items():
        classes[root].append(kept[k])
    rows = sorted(map(first, classes.values()), key=key)
    assert run("near_dedup") == rows and len(rows) < len(kept)
    copies = {(r.doc_id, r.size): (r.copies, r.target, r.source_size) for r in mix(now).collect()}
    taken = collections.Counter(run("source_mixing"))
    size = lambda r: len((r[1] or "").split())
    assert {r: copies[r[0], size(r)][0] for r in rows if copies[r[0], size(r)][0]} == taken
    for source in {r[3] for r in rows}:
        own = [r for r in rows if r[3] == source]
        words_taken, (_, target, whole) = sum(taken[r] * size(r) for r in own), copies[own[0][0], size(own[0])]
        assert whole == sum(map(size, own)) and abs(words_taken - target) <= max(map(size, own)) + 1
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for r, n in taken.items():
        want[r[0]] += n * (len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1)
    pieces = stages["packing"](spark, now, sf_dir).collect()
    got, fill = collections.Counter(), collections.Counter()
    for p in pieces:
        got[p.doc_id] += p.length
        fill[p.sequence_id] += p.length
    assert got == want and all(n == 2048 or n & (n - 1) == 0 for n in fill.values())
    whole = C.run(spark, sf_dir)
    assert whole.columns == stages["packing"](spark, now, sf_dir).columns and whole.agg(F.sum("length")).first()[0] == sum(want.values())
    none = docs.limit(0)
    assert all(stage(spark, none, sf_dir).count() == 0 for stage in stages.values())
