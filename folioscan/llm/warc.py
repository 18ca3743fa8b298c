"""WARC archives through a chunked record table: payloads as rows of record id and chunk number."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import Scratch
from .common import empty_if_null, group_in_two_levels, null_safe_key, salt_count

CHUNK = 1 << 20
#: Payload bytes that an archive holds about: beyond the session's number of partitions, pages go to so many more tasks.
ARCHIVE_BYTES = 1 << 30
#: Payloads from this many bytes on are stored once and referred to.
MIN_REVISIT_BYTES = 0

#: Fixed values of the format.
VERSION = b"WARC/1.1"
RESPONSE_TYPE = b"application/http; msgtype=response"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n"

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CHUNKS = "record_id string, chunk_no int, record_type string, uri string, refers_to string, head_bytes long, payload binary, payload_total long, payload_digest string, stated_digest string, last boolean"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1, natively: forty bits at a time, digits renamed."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.lower(F.concat(*parts)), "0123456789abcdefghijklmnopqrstuv", BASE32)


def plan_records(pages: DataFrame, id_col: str = "page_id", payload_col: str = "payload", min_bytes: int = MIN_REVISIT_BYTES, salts: int | None = None) -> DataFrame:
    """record id, digest, payload_bytes, record_type, refers_to of every page, without its payload.

    Of equal payloads of at least min_bytes the one with the largest id is the response; groups are combined in
    two levels (salted, then over the salts), so a payload that a third of all pages share stays in small parts. Of
    repeated rows of that id one copy is the response, and the other copies revisit it.
    """
    payload = F.col(payload_col)
    rows = pages.select(F.col(id_col).alias("page_id"), sha1_base32(payload).alias("digest"), F.sha2(payload, 256).alias("_sha256"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    grouped = group_in_two_levels(rows, ["digest", "_sha256", "payload_bytes"], "page_id", salts or salt_count(pages), best="max")
    revisit = (F.col("payload_bytes") >= min_bytes) & ~F.col("kept")
    return grouped.select("page_id", "digest", "payload_bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("keep_id")).alias("refers_to"))


def _record(kind: bytes, fields: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    head = b"".join(b"%b: %b\r\n" % f for f in [(b"WARC-Type", kind), *fields, (b"Content-Length", b"%d" % len(block))])
    return b"%b\r\n%b\r\n%b\r\n\r" % (VERSION, head, block)


def _urn(page_id, digest: str, nth: int, at: int) -> bytes:
    """Record id: page, payload, which of repeated rows, segment."""
    return f"<urn:page:{page_id}:{digest}:{nth}:{at}>".encode()


def record_chunks(page_id, uri: str | None, payload, digest: str, kind: str, refers_to, nth: int = 1, chunk: int = CHUNK) -> Iterator[bytes]:
    """The WARC records of one page, each at most `chunk` payload bytes: the first whole or segment 1, then continuations.

    The final line feed of each is left to the line separator of the writer.
    """
    total = len(payload)
    fields = [(b"WARC-Target-URI", b"".join((uri or "").encode().split())), (b"WARC-Date", b"1970-01-01T00:00:00Z"), (b"WARC-Payload-Digest", b"sha1:" + digest.encode())]
    if kind == "revisit":
        more = [(b"WARC-Profile", REVISIT_PROFILE), (b"WARC-Refers-To", _urn(refers_to, digest, 1, 1))]
        yield _record(b"revisit", [(b"WARC-Record-ID", _urn(page_id, digest, nth, 1)), *fields, *more], b"")
        return
    head = HTTP_HEAD % total
    pieces = max(1, -(-total // chunk))
    for k in range(pieces):
        block = bytes(payload[k * chunk : (k + 1) * chunk])
        own = [(b"WARC-Record-ID", _urn(page_id, digest, nth, k + 1))]
        if pieces > 1:
            own.append((b"WARC-Segment-Number", b"%d" % (k + 1)))
        if k == 0:
            yield _record(b"response", [*own, *fields, (b"Content-Type", RESPONSE_TYPE)], head + block)
        else:
            own.append((b"WARC-Segment-Origin-ID", _urn(page_id, digest, nth, 1)))
            if k == pieces - 1:
                own.append((b"WARC-Segment-Total-Length", b"%d" % (len(head) + total)))
            yield _record(b"continuation", [*own, *fields], block)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "payload", min_bytes: int = MIN_REVISIT_BYTES, chunk: int = CHUNK) -> None:
    """Write every page as WARC records into gzip archives under path, one archive a task.

    A payload longer than a chunk becomes segments of one chunk each, so no record is put together in memory.
    """
    plan = plan_records(pages, id_col, payload_col, min_bytes)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(uri_col).alias("uri"), F.col(payload_col).alias("payload")).withColumn("digest", sha1_base32(F.col("payload")))
    # Repeated (page_id, payload) rows share a line of the plan: the first of them is the response, if any is. One key
    # column with plain equality lets the join and the numbering use one exchange of the payloads.
    keyed = lambda rows: rows.withColumn("_key", null_safe_key("page_id"))
    copies = keyed(plan).groupBy("_key", "digest").agg(F.min("record_type").alias("record_type"), F.max("refers_to").alias("refers_to"))
    total = pages.agg(F.coalesce(F.sum(F.octet_length(payload_col)), F.lit(0))).first()[0]
    archives = -(-int(total) // ARCHIVE_BYTES)
    rows = keyed(rows)
    if archives > int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        rows = rows.repartition(archives, "_key", "digest")
    rows = rows.join(copies.hint("merge"), ["_key", "digest"])
    nth = F.row_number().over(Window.partitionBy("_key", "digest").orderBy("_key"))
    again = (F.col("_nth") > 1) & (F.col("record_type") == "response") & (F.octet_length("payload") >= min_bytes)
    rows = rows.withColumn("_nth", nth).withColumn("refers_to", F.when(again, F.col("page_id")).otherwise(F.col("refers_to"))).withColumn("record_type", F.when(again, "revisit").otherwise(F.col("record_type")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            columns = [batch.column(c) for c in ("page_id", "uri", "payload", "digest", "record_type", "refers_to", "_nth")]
            for page_id, uri, payload, digest, kind, refers_to, nth in zip(*columns):
                view = memoryview(payload.as_buffer())
                for record in record_chunks(page_id.as_py(), uri.as_py(), view, digest.as_py(), kind.as_py(), refers_to.as_py(), nth.as_py(), chunk):
                    held.append(record)
                    size += len(record)
                    if size >= 8 * CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])
                        held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])

    blocks = rows.select("page_id", "uri", "payload", "digest", "record_type", "refers_to", "_nth").mapInArrow(run, "value binary")
    # The text writer puts bytes as they are; the separator ends the record's own CR LF CR LF.
    blocks.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").option("compression", "gzip").text(path)


class RecordReader:
    """Puts lines of an archive back into chunk rows, one record segment at a time."""

    def __init__(self):
        self.fields: dict[str, str] | None = None
        self.need = 0
        self.block: list[bytes] = []
        self.have = 0
        self.sha1, self.total, self.chunk_no, self.origin = hashlib.sha1(), 0, 0, {}
        self.waiting = False

    def feed(self, line: bytes) -> tuple | None:
        """One line without its line feed; a chunk row when a record segment is complete."""
        if self.block or self.need:
            self.block.append(line)
            self.have += len(line) + 1
            # The block's own bytes and the CR LF CR LF behind it.
            if self.have == self.need + 4:
                return self._done(b"\n".join(self.block)[: self.need])
            return None
        if self.fields is None:
            if line == VERSION + b"\r":
                self.fields = {}
            return None
        if line == b"\r":
            self.need, self.have, self.block = int(self.fields["content-length"]), 0, []
            if self.need == 0:
                return self._done(b"")
            return None
        name, _, value = line.rstrip(b"\r").partition(b":")
        self.fields[name.decode().lower()] = value.strip().decode()
        return None

    def _done(self, block: bytes) -> tuple:
        f, self.fields, self.block, self.need = self.fields, None, [], 0
        kind = f["warc-type"]
        if kind != "continuation":
            self.close()
            self.sha1, self.total, self.chunk_no, self.origin = hashlib.sha1(), 0, 0, f
        elif not self.waiting or f.get("warc-segment-origin-id") != self.origin["warc-record-id"]:
            raise ValueError(f"archive damaged: segment without its record: {f.get('warc-record-id')}")
        head = block.find(b"\r\n\r\n") + 4 if kind == "response" else 0
        payload = block[head:] if head else block
        self.sha1.update(payload)
        self.total += len(payload)
        self.chunk_no += 1
        last = "warc-segment-number" not in f or "warc-segment-total-length" in f
        self.waiting = not last
        origin = self.origin
        stated, digest = origin.get("warc-payload-digest", "").removeprefix("sha1:"), base32(self.sha1.digest())
        if origin["warc-type"] == "revisit":
            digest = stated
        elif last and stated and stated != digest:
            raise ValueError(f"archive damaged: {origin['warc-record-id']} has the digest {digest}")
        return (origin["warc-record-id"], self.chunk_no, origin["warc-type"], origin.get("warc-target-uri"), origin.get("warc-refers-to"), head, payload, self.total, digest, stated, last)

    def close(self) -> None:
        """An archive, or a record before the next, must be whole."""
        if self.fields is not None or self.block or self.need or self.waiting:
            raise ValueError(f"archive damaged: it ends within {(self.fields or self.origin).get('warc-record-id')}")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of the archives under path: a row for each record segment, in CHUNKS' columns.

    payload_total and payload_digest run along: in a row they cover the record's chunks so far, so the last
    chunk has those of the whole payload although no task ever held it. Whole payloads whose digest isn't the one
    stated, segments that lack their record and archives that end within a record are errors. A revisit has the digest that it states; page_report() compares it.
    Gzip archives are not split, so a task sees each one's lines in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, file = RecordReader(), None
        names = [c.split()[0] for c in CHUNKS.split(", ")]
        types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
        for batch in batches:
            rows = []
            for line, name in zip(batch.column("line").to_pylist(), batch.column("file").to_pylist()):
                if name != file:
                    reader.close()
                    reader, file = RecordReader(), name
                if (row := reader.feed(line)) is not None:
                    rows.append(row)
            columns = list(zip(*rows)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
        reader.close()

    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file")).mapInArrow(run, CHUNKS)


def page_report(chunks: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to, from the last chunk of each.

    A revisit is resolved: length and digest are those read from the response that it refers to. One without a response, or
    with another digest than it states, is an error.
    """
    slim = chunks.where("last").select("record_id", "record_type", "refers_to", "payload_total", "payload_digest", "stated_digest")
    last = Scratch(chunks.sparkSession, "warc-records").write(slim, "last")
    r = last.where("record_type <> 'revisit'").select(F.col("record_id").alias("refers_to"), F.col("payload_total").alias("_total"), F.col("payload_digest").alias("_digest"))
    found = last.join(r.hint("merge"), "refers_to", "left")
    revisit = F.col("record_type") == "revisit"
    wrong = revisit & (F.col("_digest").isNull() | (F.col("_digest") != F.col("stated_digest")))
    digest = F.when(wrong, F.raise_error(F.concat(F.lit("archive damaged: revisit without its response: "), "record_id"))).when(revisit, F.col("_digest")).otherwise(F.col("payload_digest"))
    page_of = lambda name: F.expr(f"try_cast(regexp_extract({name}, '^<urn:page:(-?[0-9]+):', 1) as long)")
    return found.select(
        page_of("record_id").alias("page_id"),
        F.when(revisit, F.col("_total")).otherwise(F.col("payload_total")).alias("payload_bytes"),
        digest.alias("payload_digest"),
        "record_type",
        page_of("refers_to").alias("refers_to"),
    )


def round_trip(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES, chunk: int = CHUNK) -> DataFrame:
    """Write the pages under path and report what the archives say: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Payloads are html in UTF-8, null as empty; empty payloads are equal to each other. Repeated rows give a record each,
    one of them the response. A null page_id stays null; an empty table gives no rows; other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(uri_col).alias("url"), empty_if_null(html_col).cast("binary").alias("payload"))
    write_archives(rows, path, min_bytes=min_bytes, chunk=chunk)
    return page_report(read_archives(pages.sparkSession, path))
