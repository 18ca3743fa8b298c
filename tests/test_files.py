import os

import pytest
from pyspark.sql import functions as F

from folioscan.operators import files as FI
from folioscan.operators import requests as R
from folioscan.sources import readers as S
from folioscan.sources import sinks as K

CASES = [
    ("a.avif", b"\0\0\0\x1cftypavif", "video/mp4", "mp4"),
    ("a.avif", None, "image/avif", "avif"),
    ("d/x.docx", b"PK\x03\x04abc", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "docx"),
    ("x.unknown", b"PK\x03\x04abc", "application/zip", "zip"),
    ("x.jpeg", b"\xff\xd8\xff\xe0", "image/jpeg", "jpg"),
    ("x.png", b"\x89P", "image/png", "png"),
    ("x.none", b"\x89P", None, None),
    ("x.webp", b"RIFF1234WEBPxx", "image/webp", "webp"),
    ("x.wav", b"RIFF1234WAVExx", "audio/wav", "wav"),
]


def test_detail(spark):
    rows = spark.createDataFrame([(i, n, c) for i, (n, c, _, _) in enumerate(CASES)], "i int, name string, content binary")
    got = rows.select("i", FI.file_detail(F.col("name"), F.col("content")).alias("d")).orderBy("i").collect()
    assert [(r.d.mime, r.d.extension) for r in got] == [(m, e) for _, _, m, e in CASES]
    assert got[0].d.size == "12" and got[1].d.size is None and got[2].d.base_name == "x"
    joined = {r.i: r.mime for r in FI.sniff_join(rows, "content", "i").collect()}
    direct = {r.i: r.k.mime for r in rows.select("i", FI.sniffed(F.col("content")).alias("k")).collect() if r.k}
    assert joined == direct


def test_upload_messages(spark):
    rows = [
        ("a", 0, "searchText", None, b"x"),
        ("b", 0, "file", "big.csv", b"," * 3_000_000),
        ("c", 0, "file", "p.png", b"\x89PNG\r\n\x1a\n" + b"0" * 3_000_000),
        ("d", 0, "file", "p.zzz", b"?"),
    ]
    parts = spark.createDataFrame(rows, "request_id string, ord int, name string, file_name string, buffer binary")
    got = {r.request_id: r.error for r in FI.check_uploads(parts, "text/csv image/png", "2").collect()}
    assert got == {"a": "Parameter 'file' is missing.", "b": "", "c": "File size exceeds limit.", "d": "Mime type are not allowed."}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_text("x\n\ny")
    (tmp_path / "in/sub/b.TXT").write_text("q")
    assert [os.path.basename(r.path) for r in S.list_files(spark, str(tmp_path / "in"), ".txt").collect()] == ["a.txt"]
    assert S.list_files(spark, str(tmp_path / "in")).count() == 2
    assert S.list_files(spark, str(tmp_path / "none")).count() == 0
    assert S.read_character_list(spark, str(tmp_path / "in/a.txt")) == ["blank", "x", "y", " "]
    results = spark.createDataFrame([("u1", '{"a":"ü"}'), ("u2", "{}")], "unique_id string, json string")
    K.write_results(results, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out"), wholetext=True).where("unique_id = 'u1'").first().value == '{\n  "a": "ü"\n}\n'
    assert K.write_bytes(spark, str(tmp_path / "out/u3/r.json"), b"{}" * 100)
    assert K.download(spark, str(tmp_path / "out"), "u3", "r.json").first().stdout == __import__("base64").b64encode(b"{}" * 100).decode()
    with pytest.raises(ValueError):
        K.download(spark, str(tmp_path / "out"), "..", "r.json")
    assert K.rename_in_directory(spark, str(tmp_path / "out/u3"), str(tmp_path / "out/u4"), "r.json", "s.json")
    assert (tmp_path / "out/u4/s.json").exists()
    assert K.delete_tree(spark, str(tmp_path / "out/u4")) and not (tmp_path / "out/u4").exists()


def test_multipart(spark):
    body = b'--B\r\nContent-Disposition: form-data; name="file"; filename="a.png"\r\nContent-Type: image/png\r\n\r\n\x89PNG\r\n--B\r\nContent-Disposition: form-data; name="searchText"\r\n\r\nhi\r\n--B--\r\n'
    spark.udtf.register("multipart_parts", S.MultipartParts)
    spark.createDataFrame([(body, "multipart/form-data; boundary=B")], "body binary, kind string").createOrReplaceTempView("bodies")
    got = spark.sql("SELECT p.* FROM bodies, LATERAL multipart_parts(body, kind) p ORDER BY ord").collect()
    assert [(r.name, r.file_name, bytes(r.buffer)) for r in got] == [("file", "a.png", b"\x89PNG"), ("searchText", None, b"hi")]


def test_requests_schedule_and_vendor(spark, tmp_path):
    (tmp_path / "job.json").write_text('{\n"schedule": "*/10 * * * *",\n"command": "x"}')
    assert tuple(S.read_schedule(spark, str(tmp_path)).first()) == ("*/10 * * * *", "x")
    lines = spark.createDataFrame([(0, "cpu: 1"), (1, "vendor_id\t: One"), (2, "vendor_id: Two")], "ord int, line string")
    assert S.first_vendor(lines).first().vendor == "One"
    body = spark.createDataFrame([('{"pathInput":"a"}',)], "b string").select(S.engine_request(F.col("b")).alias("r")).first().r
    assert body.pathInput == "a" and body.searchText is None
    listing = spark.createDataFrame([("/r/a", 0), ("/r/.b", 0), ("/r/c", 95), ("/r/d/e", 0)], "path string, s long").select("path", F.timestamp_seconds("s").alias("modificationTime"))
    swept = R.sweep_candidates(listing, "/r", F.timestamp_seconds(F.lit(100)), 5)
    assert [r.path for r in swept.collect()] == ["/r/a"]


def test_debug_log(spark, tmp_path):
    lines = spark.createDataFrame([("a",), ("b",)], "line string")
    K.append_log(lines, str(tmp_path / "log"), False)
    assert not (tmp_path / "log").exists()
    K.append_log(lines, str(tmp_path / "log"), True)
    K.append_log(lines, str(tmp_path / "log"), True)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "log")).collect()) == ["a", "a", "b", "b"]
