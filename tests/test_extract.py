"""Pixel operators on hand-made shapes, and the whole dataflow with made-up models."""

import json
import sys

import numpy as np
from pyspark import cloudpickle

from folioscan.operators import pixels as P
from folioscan.plans.extract import Models, documents, extract, infer, intake
from folioscan.streaming import quota as Q


def test_regions_and_holes():
    mask = np.zeros((9, 12), bool)
    mask[1:6, 1:6] = True
    mask[2:5, 2:5] = False
    mask[6, 6] = True  # touches the ring by its corner
    mask[8, 11] = True
    found = P.contours(mask)
    assert [len(f) for f in found][0] == 17 and len(found) == 3
    assert P.label_regions(mask, False).max() == 3


def test_rectangle_of_a_turned_square():
    r = P.smallest_rectangle(np.array([[5, 0], [10, 5], [5, 10], [0, 5], [5, 5]]))
    assert abs(r.width - r.height) < 1e-6 and abs(r.short - 50**0.5) < 1e-6
    grown = P.grow(P.smallest_rectangle(np.array([[0, 0], [10, 0], [10, 4], [0, 4]])))
    d = 10 * 4 * 1.4 / 28
    assert np.allclose(sorted([grown.width, grown.height]), [4 + 2 * d, 10 + 2 * d])


def test_sizes_of_tensors():
    image = np.full((100, 400, 3), 128, np.uint8)
    assert P.detection_tensor(image).shape == (1, 3, 96, 384)
    assert P.recognition_tensor(image).shape == (1, 3, 48, 320)
    assert P.layout_tensor(image)["image"].shape == (1, 3, 800, 800)
    assert np.allclose(P.recognition_tensor(image)[0, :, :, 192:], 0)


def test_crop_turns_tall_boxes():
    image = np.zeros((40, 40, 3), np.uint8)
    image[5:35, 10:20] = 200
    assert P.crop_box(image, [[10, 5], [20, 5], [20, 35], [10, 35]]).shape == (10, 30, 3)
    assert P.crop_box(image, [[1, 1], [1, 1], [1, 1], [1, 1]]) is None


cloudpickle.register_pickle_by_value(sys.modules[__name__])
CHARS = ("blank", "a", "b", " ")


def _decode():
    def run(data):
        if data == b"bad":
            return None
        if data == b"boom":
            raise OSError("unreadable")
        image = np.zeros((64, 64, 3), np.uint8)
        image[8:24, 8:56] = 255
        image[40:56, 8:40] = 255
        return image

    return run


def _layout():
    return lambda inputs: np.array([[2, 0.9, 1, 1, 99, 40], [25, 0.3, 0, 0, 10, 10], [1, 0.2, 0, 0, 9, 9], [1, 0.9, 5, 5, 5, 9]])


def _detection():
    return lambda tensor: (tensor[0, 0] > 0).astype(np.float32) * 0.8


def _recognition():
    return lambda tensors: np.stack([np.eye(4)[[1, 1, 0, 2]] * 0.5] * len(tensors))


MODELS = Models(_decode, _layout, _detection, _recognition, CHARS)


def test_extraction(spark, tmp_path):
    images = spark.createDataFrame([("p1", "u1", b"ok"), ("p2", "u2", b"bad"), ("p3", "u3", b"boom")], "path string, unique_id string, content binary")
    got = {r.unique_id: r for r in extract(images, MODELS, "AB", str(tmp_path / "out")).collect()}
    good = json.loads(got["u1"].json)
    assert [x["label"] for x in good["layoutList"]] == ["text", "25"]
    assert good["layoutList"][0]["centerPoint"] == {"x": 32, "y": 20}
    assert [(i["id"], i["text"], i["isMatch"]) for i in good["itemList"]] == [(1, "ab", True), (2, "ab", True)]
    assert abs(good["itemList"][0]["centerPoint"]["x"] - 32) <= 1 and good["itemList"][0]["centerPoint"]["y"] < good["itemList"][1]["centerPoint"]["y"]
    assert json.loads(got["u2"].json) == {"uniqueId": "u2", "layoutList": [], "itemList": []}
    assert json.loads(got["u3"].response)["error"] == "OSError: unreadable"
    assert json.loads(json.loads(got["u1"].response)["response"]["stdout"]) == good
    # Neither what can't be decoded nor what failed has a file.
    written = spark.read.text(str(tmp_path / "out"), wholetext=True).collect()
    assert [(r.unique_id, json.loads(r.value)) for r in written] == [("u1", {k: good[k] for k in ("layoutList", "itemList")})]
    assert written[0].value.startswith('{\n  "layoutList": [\n    {\n      "label": "text"')
    assert [got[u].decoded for u in ("u1", "u2", "u3")] == [True, False, False]
    assert documents(infer(images, MODELS), "").count() == 3


def test_results_of_other_ids_stay(spark, tmp_path):
    from folioscan.sources.sinks import write_result_files, write_results

    path = str(tmp_path / "results")
    for ids, text in ((["a", "b"], '{"n":1}'), (["b", "c"], '{"n":2}')):
        write_results(spark.createDataFrame([(i, text) for i in ids], "unique_id string, json string"), path)
    assert {r.unique_id: json.loads(r.value)["n"] for r in spark.read.text(path, wholetext=True).collect()} == {"a": 1, "b": 2, "c": 2}
    (tmp_path / "files/x/debug").mkdir(parents=True)
    rows = spark.createDataFrame([("x", '{"layoutList":[],"itemList":[]}')], "unique_id string, json string")
    assert write_result_files(rows, str(tmp_path / "files")) == 1
    assert (tmp_path / "files/x/result.json").read_text() == '{\n  "layoutList": [],\n  "itemList": []\n}' and not (tmp_path / "files/x/debug").exists()


def test_sweep(spark, tmp_path):
    import os

    from folioscan.sources.sinks import sweep

    for name, age in (("old", 100), ("new", 5), (".hidden", 100)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "f").write_text("x")
        os.utime(tmp_path / name, (10_000 - age, 10_000 - age))
    (tmp_path / "old.txt").write_text("x")
    os.utime(tmp_path / "old.txt", (9_900, 9_900))
    gone = sweep(spark, str(tmp_path), 50, now=10_000)
    assert [g.rsplit("/", 1)[1] for g in gone] == ["old", "old.txt"]
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == [".hidden", "new"]
    assert sweep(spark, str(tmp_path / "none"), 1) == []


def test_bilinear_golden_values():
    """Halves and doubles of a small ramp, by hand: pixel centres stay in place and borders repeat."""
    ramp = np.repeat(np.array([[0, 100, 200, 40]], np.uint8)[:, :, None], 3, axis=2)
    assert P.resize(ramp, 2, 1)[0, :, 0].tolist() == [50, 120]
    assert P.resize(ramp, 8, 1)[0, :, 0].tolist() == [0, 25, 75, 125, 175, 160, 80, 40]
    assert np.array_equal(P.resize(ramp, 4, 3), np.repeat(ramp, 3, axis=0))
    flat = np.full((100, 400, 3), 128, np.uint8)
    assert np.allclose(P.detection_tensor(flat)[0, :, 0, 0], [(128 / 255 - m) / s for m, s in zip(P.MEAN, P.SPREAD)])


def test_contours_against_a_plain_version():
    rng = np.random.default_rng(8)
    for _ in range(40):
        mask = rng.random((12, 15)) < 0.55
        regions = P.label_regions(mask, True)
        want = [np.column_stack(np.nonzero(regions == k)[::-1]) for k in range(1, regions.max() + 1)]
        holes = P.label_regions(np.pad(~mask, 1, constant_values=True), False)
        for k in range(2, holes.max() + 1):
            near = {(x - 1 + dx, y - 1 + dy) for y, x in np.argwhere(holes == k) for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0))}
            want.append(np.array(sorted((p for p in near if 0 <= p[1] < 12 and 0 <= p[0] < 15 and mask[p[1], p[0]]), key=lambda p: p[::-1])))
        key = lambda points: [tuple(map(int, p)) for p in points]
        assert sorted(map(key, P.contours(mask))) == sorted(map(key, want))


def test_decoders():
    import struct
    import zlib

    from folioscan.sources.images import PNG_MARK, decode_image

    rng = np.random.default_rng(2)
    rgb = rng.integers(0, 256, (7, 5, 3)).astype(np.uint8)

    def png(rows, colour, step):
        """Rows take the five filters in turn."""
        flat, out, before = rows.reshape(len(rows), -1).astype(int), b"", np.zeros(rows[0].size, int)
        for y, row in enumerate(flat):
            left = np.concatenate([np.zeros(step, int), row[:-step]])
            corner = np.concatenate([np.zeros(step, int), before[:-step]])
            guess = left + before - corner
            a, b, c = abs(guess - left), abs(guess - before), abs(guess - corner)
            paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, before, corner))
            out += bytes([y % 5]) + ((row - [0 * row, left, before, (left + before) // 2, paeth][y % 5]) % 256).astype(np.uint8).tobytes()
            before = row
        chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + b"crc!"
        return PNG_MARK + chunk(b"IHDR", struct.pack(">IIBBBBB", rows.shape[1], rows.shape[0], 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")

    assert np.array_equal(decode_image(png(rgb, 2, 3)), rgb[:, :, ::-1])
    assert np.array_equal(decode_image(png(np.dstack([rgb, rgb[:, :, :1]]), 6, 4)), rgb[:, :, ::-1])
    assert np.array_equal(decode_image(png(rgb[:, :, :1], 0, 1)), np.repeat(rgb[:, :, :1], 3, axis=2))
    assert np.array_equal(decode_image(b"P6\n# note\n5 7\n255\n" + rgb.tobytes()), rgb[:, :, ::-1])
    rows = b"".join(r[:, ::-1].tobytes() + b"\0" for r in rgb[::-1])
    assert np.array_equal(decode_image(b"BM" + bytes(8) + struct.pack("<IIiiHHI", 54, 40, 5, 7, 1, 24, 0) + bytes(20) + rows), rgb[:, :, ::-1])
    assert decode_image(b"") is None and decode_image(None) is None and decode_image(PNG_MARK + b"short") is None and decode_image(b"BMx") is None


def _field(number, value):
    """One field of the model format's encoding: a number, a text or a nested message."""
    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def _identity_model(*names):
    """A model that gives its float inputs back, of any shape."""
    tensor = _field(1, _field(1, 1) + _field(2, _field(1, _field(2, "a")) + _field(1, _field(2, "b")) + _field(1, _field(2, "c")) + _field(1, _field(2, "d"))))
    node = b"".join(_field(1, _field(1, n) + _field(2, n + "_out") + _field(4, "Identity")) for n in names)
    ends = b"".join(_field(11, _field(1, n) + _field(2, tensor)) + _field(12, _field(1, n + "_out") + _field(2, tensor)) for n in names)
    return _field(1, 8) + _field(7, node + _field(2, "g") + ends) + _field(8, _field(1, "") + _field(2, 13))


def test_onnx_models(tmp_path):
    from folioscan.plans.onnx_models import detection_model, layout_model, recognition_model

    (tmp_path / "one.onnx").write_bytes(_identity_model("image"))
    (tmp_path / "two.onnx").write_bytes(_identity_model("image", "scale_factor"))
    tensor = np.arange(24, dtype=np.float32).reshape(2, 1, 3, 4)
    assert np.array_equal(detection_model(str(tmp_path / "one.onnx"))()(tensor), tensor[0, 0])
    assert np.array_equal(recognition_model(str(tmp_path / "one.onnx"))()(tensor), tensor)
    rows, count = layout_model(str(tmp_path / "two.onnx"))()({"image": tensor, "scale_factor": np.full((1, 1, 1, 1), 1, np.float32), "im_shape": tensor})
    assert len(rows) == 2 and count == 1
    assert layout_model(str(tmp_path / "one.onnx"))()({"image": tensor, "im_shape": tensor})[1] == 2


def test_counted_rows():
    from folioscan.plans.extract import _rows

    assert _rows((np.ones((3, 6)), 2)) == [[1.0] * 6] * 2 and len(_rows(np.ones((3, 6)))) == 3


def test_batches_by_width():
    crops = [np.zeros((48, w, 3), np.uint8) for w in (100, 900, 200, 900, 50)]
    parts = P.recognition_batches(crops, 2)
    assert sorted(i for p, _ in parts for i in p) == [0, 1, 2, 3, 4] and all(len(p) == len(t) <= 2 for p, t in parts)


def test_audit_text(spark):
    from folioscan.sources import readers, sinks

    text = '{"metadata":{"vulnerabilities":{"low":2,"high":1},"dependencies":{"total":9}},"vulnerabilities":{"a":{"severity":"high","isDirect":true,"range":"<2","fixAvailable":true,"via":["b",{"source":7,"title":"t"}]},"b":{"fixAvailable":{"name":"bb","version":"3"},"via":[]},"c":{"severity":"low","fixAvailable":false}}}'
    reports = readers.read_audit(spark.createDataFrame([(1, text), (2, '{"metadata":{}}')], "id int, text string"), "text")
    got = {r.id: r.text for r in sinks.audit_report(reports, "id").collect()}
    assert got[2] == "\nSummary:\nTotal dependency: n/d\nInfo: 0\nLow: 0\nModerate: 0\nHigh: 0\nCritical: 0\n\nNo vulnerabilities found."
    want = ["", "Summary:", "Total dependency: 9", "Info: 0", "Low: 2", "Moderate: 0", "High: 1", "Critical: 0", "", "Vulnerability details:", "",
            "- a", "   Severity: high", "   Type: Direct", "   Range impact: <2", "   Fix: Available (version unknown).", "   Cause: b | 7:t", "",
            "- b", "   Severity: unknown", "   Type: Transitive", "   Range impact: n/d", "   Fix: bb@3", "", "- c", "   Severity: low", "   Type: Transitive", "   Range impact: n/d", "   Fix: Not available", "",
            "Package with available fix: 2/3", "", "List:", "- a -> npm audit fix --force", "- b -> bb@3"]
    assert got[1].split("\n") == want


def test_intake(spark):
    rows = [("r", 0, "file", "a.b.png", b"\x89PNG\r\n\x1a\n"), ("r", 1, "searchText", None, b"s"), ("q", 0, "x", None, b"")]
    parts = spark.createDataFrame(rows, "request_id string, ord int, name string, file_name string, buffer binary")
    assert [tuple(r) for r in intake(parts, "image/png", "1").collect()] == [("r", "a.b.png", "a.b.png", "s", "input/a.b/a.b.png")]


def test_streams(spark, tmp_path):
    from pyspark.sql import functions as F

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    Q.stream_counts(stream, "event_type", "ts").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    want = events.groupBy("event_type", F.window("ts", "15 minutes")).count().count()
    assert spark.table("counts").count() == want
    (tmp_path / "drop").mkdir()
    (tmp_path / "drop/a.png").write_bytes(b"ok")
    seen = []
    files = Q.stream_files(spark, str(tmp_path / "drop"), "*.png")
    for _ in range(2):
        Q.run_available(files, lambda batch, n: seen.extend(r.path for r in batch.select("path").collect()), str(tmp_path / "ck")).start().awaitTermination()
    assert len(seen) == 1
