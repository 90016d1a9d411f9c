"""WARC archives: writing pages as transactions, reading records, assembling captures.

Each page is a transaction of three records: a response (or a revisit of an earlier equal payload),
a request and a metadata record that name it in WARC-Concurrent-To. Archives are written by Spark's
text writer, so any store that Spark can write to will do: the record end of the format, two line
breaks, is the writer's line separator. They are read as binary files, each record by its
Content-Length, and transactions are put together by a grouping on the concurrent-to identifier.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.shared import materialise, tidy

CRLF = "\r\n"
#: Payloads of fewer bytes are always written again.
LEAST_REVISIT_BYTES = 100
#: Payload bytes and pages of one archive file at most, which bounds what a reading task holds; a larger payload has a file of its own.
FILE_BYTES = 64_000_000
PAGES_PER_FILE = 2_000
#: Pages are written by size, so that files hold as many as fit: each class has payloads of up to so many bytes.
SIZES = (FILE_BYTES // PAGES_PER_FILE, FILE_BYTES // 40)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _uuid(*parts: Column) -> Column:
    """A record identifier that follows from its parts, so that a task that runs again writes the same."""
    h = F.md5(F.concat_ws("\x00", *parts))
    return F.concat(F.lit("urn:uuid:"), F.regexp_replace(h, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"))


def _header(value: Column) -> Column:
    """A value that stays on one header line."""
    return F.regexp_replace(F.regexp_replace(value, "\r", "%0D"), "\n", "%0A")


def _record(kind: str | Column, ident: Column, uri: Column, date: str, content_type: str, block: Column, *more: tuple[str, Column]) -> Column:
    """The text of a record without its end. Fields whose value is null are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    fields = [("WARC-Type", kind), ("WARC-Record-ID", F.concat(F.lit("<"), ident, F.lit(">"))), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", uri), *more, ("Content-Type", F.lit(content_type)), ("Content-Length", F.octet_length(block).cast("string"))]
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in fields]
    return F.concat(F.concat_ws(CRLF, F.lit("WARC/1.1"), *lines), F.lit(CRLF * 2), block)


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write one transaction per row below `path` (gzip).

    Null html is an empty payload. Of rows with equal payloads of LEAST_REVISIT_BYTES or more, those
    with the smallest id (then url; null ids last) are responses and the others revisit it. A null
    url has no target field. Rows repeated in id, url and payload are written as often as they occur,
    with equal record identifiers. Other columns are ignored. An empty table writes no records.

    Payloads go from the scan straight to the files. Only digests are grouped, and what comes back is
    one narrow row for each page whose payload another page has too; where those are few they are
    broadcast, else pages meet them by their own key, which no two unequal pages share.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload"))
    order = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("id"), F.coalesce("url", F.lit("")).alias("url"))
    key = ["key", "digest"]
    rows = rows.withColumn("key", F.xxhash64("page_id", "url"))
    narrow = materialise(rows.select("key", "digest", "n", order.alias("own")), "digests")
    most = narrow.agg(F.max("n")).first()[0] or 0
    narrow = narrow.where(F.col("n") >= LEAST_REVISIT_BYTES)
    first = narrow.groupBy("digest").agg(F.min("own").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    again = materialise(narrow.groupBy(*key).agg(F.min("own").alias("own")).join(first, "digest").where("own <> first").select(*key, "first"), "revisits")
    rows = rows.join(again, key, "left")

    def ident(kind: str, page: Column, url: Column) -> Column:
        return _uuid(F.lit(kind), F.coalesce(page.cast("string"), F.lit("null")), F.coalesce(url, F.lit("")), F.col("digest"))

    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.id"))
    uri = _header(F.col("url"))
    own = ident("capture", F.col("page_id"), F.col("url"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF * 2))
    to = ("WARC-Concurrent-To", F.concat(F.lit("<"), own, F.lit(">")))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    host = F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    target = F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    asked = F.coalesce(F.concat(F.lit("GET "), F.when(target == "", "/").otherwise(target), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF * 2)), F.lit(f"GET / HTTP/1.1{CRLF * 2}"))
    known = F.concat_ws("", F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(CRLF)), F.concat(F.lit("payload-bytes: "), F.col("n").cast("string"), F.lit(CRLF)))
    capture = F.when(
        revisit,
        _record("revisit", own, uri, date, "application/http; msgtype=response", http, digest, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", F.concat(F.lit("<"), ident("capture", F.col("first.id"), F.col("first.url")), F.lit(">")))),
    ).otherwise(_record("response", own, uri, date, "application/http; msgtype=response", F.concat(http, F.col("payload")), digest))
    records = F.array(
        _record("request", ident("request", F.col("page_id"), F.col("url")), uri, date, "application/http; msgtype=request", asked, to),
        capture,
        _record("metadata", ident("metadata", F.col("page_id"), F.col("url")), uri, date, "application/warc-fields", known, to),
    )
    for low, high in zip((-1, *SIZES), (*SIZES, max(most, *SIZES)), strict=True):
        if low < most or low < 0:
            fits = max(1, min(PAGES_PER_FILE, FILE_BYTES // high))
            part = rows.where((F.col("n") > low) & (F.col("n") <= high)).select(F.explode(records).alias("value"))
            part.write.mode("append").option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", 3 * fits).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive: header fields (names in lower case) and block. A cut-off last record raises."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split(CRLF)
        if not first.startswith("WARC/1."):
            raise ValueError(f"no record at byte {at}")
        fields = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
        begin = end + 4
        at = begin + int(fields["content-length"])
        if at > len(data):
            raise ValueError("the last record is cut off")
        yield fields, data[begin:at]
        at += 4


_RECORD = [("record_id", "string"), ("kind", "string"), ("concurrent_to", "string"), ("refers_to", "string"), ("uri", "string"), ("date", "string"), ("digest", "string"), ("head", "string"), ("payload", "string"), ("n_bytes", "long"), ("computed", "string"), ("page_id", "long"), ("said_bytes", "long")]


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives below `path`; payloads of responses are digested as read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in _RECORD])
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in parse(content.as_py()):
                    bare = {k: fields.get(k, "").strip("<>") or None for k in ("warc-record-id", "warc-concurrent-to", "warc-refers-to")}
                    head, _, payload = block.partition(b"\r\n\r\n")
                    kind = fields["warc-type"]
                    said = dict(line.split(": ", 1) for line in block.decode().split(CRLF) if line) if kind == "metadata" else {}
                    rows.append(
                        (bare["warc-record-id"], kind, bare["warc-concurrent-to"], bare["warc-refers-to"], fields.get("warc-target-uri"), fields.get("warc-date"), fields.get("warc-payload-digest", "").removeprefix("sha256:") or None, head.decode() if kind != "metadata" else None, payload.decode() if with_payload and kind == "response" else None)
                        + ((len(payload), hashlib.sha256(payload).hexdigest()) if kind == "response" else (None, None))
                        + (int(said["page-id"]) if "page-id" in said else None, int(said["payload-bytes"]) if "payload-bytes" in said else None)
                    )
                    if len(rows) == 1_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(tidy(run), ", ".join(f"{n} {t}" for n, t in _RECORD))


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, request, response (or revisit) and metadata structs.

    Records meet by the identifier they name in WARC-Concurrent-To, or their own. A transaction
    without a response or revisit gives no capture; one whose request or metadata is missing has
    nulls there. A capture that was written n times gives n rows.
    """
    is_capture = F.col("kind").isin("response", "revisit")
    answer = F.struct("kind", "uri", "date", "digest", "refers_to", "head", "payload", "n_bytes", "computed")
    grouped = records.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id")).agg(
        F.max(F.when(F.col("kind") == "request", F.struct("record_id", "head"))).alias("request"),
        F.max(F.when(is_capture, answer)).alias("response"),
        F.max(F.when(F.col("kind") == "metadata", F.struct("record_id", "page_id", "said_bytes"))).alias("metadata"),
        F.sum(is_capture.cast("int")).alias("times"),
    )
    return grouped.where("times > 0").withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("times")


def captures(assembled: DataFrame) -> DataFrame:
    """The contract's columns from assembled captures; a payload must have the digest that its record states.

    Length and digest of a revisit are those of the payload of the response it refers to; where that is
    not in the archives, what the revisit's own records say.
    """
    ok = F.col("response.payload").isNull() | (F.sha2("response.payload", 256) == F.col("response.digest"))
    flat = assembled.select(
        "capture_id",
        F.col("metadata.page_id").alias("page_id"),
        F.col("metadata.said_bytes").alias("said_bytes"),
        F.octet_length("response.payload").cast("long").alias("n_bytes"),
        F.when(ok, F.col("response.digest")).otherwise(F.raise_error(F.lit("a payload differs from its digest"))).alias("digest"),
        F.col("response.kind").alias("record_type"),
        F.coalesce("response.refers_to", "capture_id").alias("to"),  # a response meets itself, so no null key gathers rows
    )
    flat = materialise(flat, "captures")  # payloads are assembled once; what is joined is narrow
    origin = flat.where("record_type = 'response'").groupBy(F.col("capture_id").alias("to")).agg(F.min(F.struct("page_id", "n_bytes", "digest")).alias("first"))
    found = flat.join(origin, "to", "left")
    same = F.col("first.digest").isNull() | (F.col("first.digest") == F.col("digest"))
    return found.select(
        "page_id",
        F.coalesce("n_bytes", "first.n_bytes", "said_bytes").alias("payload_bytes"),
        F.when(same, F.col("digest")).otherwise(F.raise_error(F.lit("a revisit differs from its response"))).alias("payload_digest"),
        "record_type",
        F.when(F.col("record_type") == "revisit", F.col("first.page_id")).alias("refers_to"),
    )
