"""Golden values of the scalar functions, and properties against plain restatements."""

import json

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscan.functions import numbers as N
from folioscan.functions import tensors as A
from folioscan.functions import text as T
from folioscan.operators.pixels import decode_steps


def column(spark, values, kind, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.select("i", f(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_match_edges(spark):
    texts = ["Straße", "ＡＢ c", "x\ty", "", None, "a　b", "ﬁn", "İ"]
    assert column(spark, texts, "string", lambda c: T.is_match(c, "STRASSE")) == [True] + [False] * 7
    assert column(spark, texts, "string", lambda c: T.is_match(c, "ab"))[1] is True
    assert column(spark, texts, "string", lambda c: T.is_match(c, "xy"))[2] is False
    assert column(spark, texts, "string", lambda c: T.is_match(c, " ")) == [True, True, True, False, False, True, True, True]
    assert column(spark, texts, "string", lambda c: T.is_match(c, "")) == [False] * 8
    assert column(spark, texts, "string", lambda c: T.is_match(c, "AB"))[5] is True
    assert column(spark, texts, "string", lambda c: T.is_match(c, "fin"))[6] is True


def test_normalize_equals_plain_version(spark):
    texts = ["".join(map(chr, range(a, a + 40))) for a in range(1, 0x600, 40)] + ["  Ein Maß \n", "ǅ ẞ ŉ"]
    assert column(spark, texts, "string", T.normalize) == [T.normalize_value(t) for t in texts]


def test_names(spark):
    values = ["d/a.tar.gz", " b ", "x.JPEG", "net/en/25#top", ".hidden"]
    assert column(spark, values, "string", T.base_name) == ["a.tar", "b", "x", "25#top", ""]
    assert column(spark, values, "string", T.extension) == ["gz", "", "jpeg", "", "hidden"]


def test_headers_and_codes(spark):
    assert column(spark, ["Bearer t", "bearer t", ""], "string", T.bearer_token) == ["t", "", ""]
    assert column(spark, ["\x1b[1mx\x1b[0m", "\x1bmy"], "string", T.strip_terminal_codes) == ["x", "y"]
    assert column(spark, ["aXbXc", "b"], "string", lambda c: T.strip_first(c, "X")) == ["abXc", "b"]
    assert column(spark, ["a+b%20c"], "string", T.decode_uri) == ["a+b c"]


def test_json_values(spark):
    values = ['{"a":1} x', '{"a":1,"a":2}', "NaN", "[1,]", "null", "3", "", None]
    assert column(spark, values, "string", T.is_json) == [False, True, False, False, True, True, False, False]


def test_half_even_and_sizes(spark):
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "a int, b int")
    assert [r[0] for r in pairs.select(N.center(F.col("a"), F.col("b"))).collect()] == [0, 2, 2]
    assert column(spark, [1023, 1024, 1280, 1048576, 1099511627776], "long", N.human_size) == ["1023 B", "1.0 KB", "1.3 KB", "1.0 MB", "1.0 TB"]
    sides = spark.createDataFrame([(48, 80), (10, 10), (4000, 500)], "h int, w int")
    assert [tuple(r) for r in sides.select(*N.detection_size(F.col("h"), F.col("w"))).collect()] == [(64, 64), (32, 32), (960, 128)]


def test_number_and_limit(spark):
    assert column(spark, [1234567.8916, 5.0, 0.25], "double", N.number_text) == ["1,234,567.892", "5", "0.25"]
    assert column(spark, ["2", " 3x", "x", None], "string", N.byte_limit) == [2097152, 3145728, None, None]
    assert column(spark, [None, 5, 3000000], "long", lambda c: N.size_allowed(c, F.lit("2"))) == [True, True, False]


def test_float_threshold(spark):
    assert column(spark, [[0.2, 0.21, 0.1]], "array<float>", A.binarize) == [[0, 1, 0]]


def test_decoding(spark):
    def one(best):
        return [[1.0 if k == b else 0.0 for k in range(6)] for b in best]

    letters = F.array(*[F.lit(c) for c in ["blank", "a", "b", "c", "d", " "]])
    matrices = [one([0, 3, 3, 0, 3, 5]), one([0, 0]), one([1, 1])]
    assert column(spark, matrices, "array<array<double>>", lambda c: A.decoded_text(A.emitted(c), letters)) == ["cc ", "", "a"]
    assert column(spark, matrices, "array<array<double>>", lambda c: A.mean_probability(A.emitted(c))) == [1.0, 0.0, 1.0]


def test_decoding_equals_numpy(spark):
    rng = np.random.default_rng(3)
    charset = ["blank", *"abcde", " "]
    matrices = [rng.random((9, 7)).round(1).tolist() for _ in range(40)]
    letters = F.array(*[F.lit(c) for c in charset])
    texts = column(spark, matrices, "array<array<double>>", lambda c: A.decoded_text(A.emitted(c), letters))
    scores = column(spark, matrices, "array<array<double>>", lambda c: A.mean_probability(A.emitted(c)))
    want = [decode_steps(np.array(m), charset) for m in matrices]
    assert texts == [w[0] for w in want] and np.allclose(scores, [w[1] for w in want])


def test_corners_of_ties(spark):
    points = [[(0, 0), (5, 0), (5, 5), (0, 5)], [(1, 1), (1, 1), (2, 2), (2, 2)]]
    got = column(spark, points, "array<struct<x:int,y:int>>", A.corners)
    assert [tuple(p) for p in got[0]] == [(0, 0), (5, 0), (5, 5), (0, 5)]
    assert [tuple(p) for p in got[1]] == [(1, 1), (2, 2), (2, 2), (1, 1)]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(-1e4, 1e4), min_size=1, max_size=30), st.integers(0, 2000))
def test_clamp_against_a_plain_rule(spark, values, limit):
    got = column(spark, values, "double", lambda c: N.clamp(c, F.lit(limit)))
    assert got == [max(0, min(int(round(v)), limit)) for v in values]


def test_decoding_grows_with_the_steps():
    """The expression names the matrix as often for long matrices as for short ones, and never within a step."""
    shown = str(A.emitted(F.col("matrix")))
    assert shown.count("matrix") == 2


def test_results_as_json(spark):
    from folioscan.operators import results as R
    from folioscan.sources.sinks import indented

    layout = F.array(F.struct(F.lit("ü").alias("label"), F.lit(0.5).alias("score"), F.struct(F.lit(1).alias("x"), F.lit(2).alias("y")).alias("centerPoint")))
    document = R.result_document(F.lit("u"), layout, F.lit(None))
    row = spark.range(1).select(document.alias("d")).select(R.result_json(F.col("d")).alias("j"), indented(R.file_json(F.col("d"))).alias("f")).first()
    lists = {"layoutList": [{"label": "ü", "score": 0.5, "centerPoint": {"x": 1, "y": 2}}], "itemList": []}
    assert json.loads(row.j) == {"uniqueId": "u"} | lists
    assert row.f == json.dumps(lists, ensure_ascii=False, indent=2)
