"""WARC archives: writing captures, reading records, assembling transactions.

The writer is plain DataFrame work: each capture becomes a response (or
revisit), a request and a metadata record, written by Spark's text writer with
the record separator as the line separator. The reader parses whole archive
files by Content-Length. Assembly joins the records of a capture through
their concurrent-to identifiers and emits one nested row per capture.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import cut_lineage, remove_at_exit, shared_folder, written

CRLF = "\r\n"
END = CRLF + CRLF
# Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: Bytes of payload that an archive holds at most, besides a single larger one; pages are written in classes of size, each with so many to a file that this holds.
FILE_BYTES, CLASS_BYTES = 64 << 20, (64 << 10, 1 << 20, 16 << 20)

RECORD = """type string, record_id string, concurrent_to array<string>, refers_to string, target_uri string, date string,
    payload_digest string, payload_bytes long, digest_ok boolean, http_head string, fields map<string,string>, payload binary"""


def base32_sha1(text: Column) -> Column:
    """SHA-1 of a string or binary as base32: groups of 20 bits, four characters each."""
    hexed = F.sha1(text)
    groups = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), DIGITS, BASE32)


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: str | Column, record_id: Column, headers: list[tuple[str, Column | str]], block: Column) -> Column:
    """One record without its separator; a header whose value is null is left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [("WARC-Type", kind), ("WARC-Record-ID", record_id), *headers, ("Content-Length", F.octet_length(block).cast("string"))]
    text = [F.concat(F.lit(f"{k}: "), F.lit(v) if isinstance(v, str) else v) for k, v in lines]
    return F.concat(F.concat_ws(CRLF, F.lit(VERSION), *text), F.lit(END), block)


def write_captures(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", captures_per_file: int = 1000) -> None:
    """Write every page as one capture.

    Of pages with equal payloads of at least ``least_bytes``, the one with the
    smallest id holds the payload; the others are revisits that refer to it.
    A null payload is empty, a null id sorts last, a null url has no target
    header. Rows that repeat id, url and payload are one capture, written and
    read as often as they stand there. An archive has ``captures_per_file``
    captures at most, fewer where payloads are large.
    """
    clean = lambda c: F.regexp_replace(c, "[\\r\\n]", "%0A")
    rows = pages.select(F.col(id_col).alias("id"), clean(F.col(url_col).cast("string")).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", base32_sha1(F.col("html"))).withColumn("n", F.octet_length("html").cast("long"))
    ident = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.coalesce("url", F.lit("")).alias("at"))
    per = cut_lineage(rows.groupBy("digest").agg(F.min(ident).alias("first"), F.count("*").alias("copies"), F.max("n").alias("size")))
    sizes = [r["size"] for r in per.select(sum((F.col("size") >= b).cast("int") for b in CLASS_BYTES).alias("size")).distinct().collect()]
    firsts = per.where((F.col("copies") > 1) & (F.col("size") >= least_bytes)).select("digest", "first")
    rows = rows.join(firsts, "digest", "left")
    again = F.col("first").isNotNull() & (F.col("n") >= least_bytes) & (F.col("first") != ident)
    rows = rows.withColumn("again", F.coalesce(again, F.lit(False)))
    named = lambda i, at: _urn(F.lit("response"), F.coalesce(i.cast("string"), F.lit("none")), at, F.col("digest"))
    own, first = named(F.col("id"), F.coalesce("url", F.lit(""))), named(F.col("first.id"), F.col("first.at"))
    rows = rows.withColumn("own", own).withColumn("refers", F.when(F.col("again"), first))

    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(END))
    common = [("WARC-Date", date), ("WARC-Target-URI", F.col("url"))]
    response = _record(
        F.when(F.col("again"), "revisit").otherwise("response"),
        F.col("own"),
        [*common, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), ("WARC-Profile", F.when(F.col("again"), REVISIT_PROFILE)), ("WARC-Refers-To", F.col("refers")), ("Content-Type", "application/http;msgtype=response")],
        F.concat(head, F.when(F.col("again"), "").otherwise(F.col("html"))),
    )
    beside = [*common, ("WARC-Concurrent-To", F.col("own"))]
    path = F.coalesce(F.nullif(F.regexp_extract("url", r"^[a-z]+://[^/]*(/.*)$", 1), F.lit("")), F.lit("/"))
    host = F.regexp_extract("url", r"^[a-z]+://([^/]*)", 1)
    request = _record("request", _urn(F.lit("request"), F.col("own")), [*beside, ("Content-Type", "application/http;msgtype=request")], F.concat(F.lit("GET "), path, F.lit(f" HTTP/1.1{CRLF}Host: "), F.coalesce(host, F.lit("")), F.lit(END)))
    fields = F.concat_ws(CRLF, F.concat(F.lit("page-id: "), F.col("id").cast("string")), F.concat(F.lit("refers-to-page: "), F.when(F.col("again"), F.col("first.id").cast("string"))), F.lit(""))
    metadata = _record("metadata", _urn(F.lit("metadata"), F.col("own")), [*beside, ("Content-Type", "application/warc-fields")], fields)
    edges = [0, *CLASS_BYTES, None]
    for k, size in enumerate(sorted(sizes) or [0]):
        low, high = edges[size], edges[size + 1]
        some = rows.where((F.col("n") >= low) & (F.col("n") < high) if high else F.col("n") >= low) if len(sizes) > 1 else rows
        most = max(1, min(captures_per_file, FILE_BYTES // high)) if high else 1
        records = some.select(F.explode(F.array(response, request, metadata)).alias("value"))
        records.write.mode("append" if k else "overwrite").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", 3 * most).text(folder)


def _members(data: bytes) -> bytes:
    """The content of an archive, which may be a sequence of gzip members."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        one = zlib.decompressobj(31)
        out.append(one.decompress(data) + one.flush())
        data = one.unused_data
    return b"".join(out)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """(headers by lower-case name, block) of each record; a damaged record is an error."""
    data, at = _members(data), 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        headers: dict[str, list[str]] = {}
        for line in data[at:end].decode("utf-8", "replace").split(CRLF)[1:]:
            k, _, v = line.partition(":")
            headers.setdefault(k.strip().lower(), []).append(v.strip())
        start, n = end + 4, int(headers["content-length"][0])
        if start + n > len(data):
            raise ValueError(f"record at byte {at} is cut off")
        yield headers, data[start : start + n]
        at = start + n
        while data.startswith(b"\r\n", at):
            at += 2


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the archives in a folder. Each archive is one row to Spark, of 2 GB at most."""

    def rows(batches):
        names = ["type", "record_id", "concurrent_to", "refers_to", "target_uri", "date", "payload_digest", "payload_bytes", "digest_ok", "http_head", "fields", "payload"]
        kinds = [pa.string(), pa.string(), pa.list_(pa.string()), *[pa.string()] * 4, pa.int64(), pa.bool_(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]

        def batch(found):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)

        for b in batches:
            for data in b.column("content"):
                found, held = [], 0
                for h, block in parse_records(data.as_py()):
                    one = lambda k: (h.get(k) or [None])[0]  # noqa: B023, E731
                    kind, said = one("warc-type"), (one("warc-payload-digest") or "").removeprefix("sha1:") or None
                    head = payload = digest = size = ok = None
                    fields: list = []
                    if kind in ("response", "revisit", "request"):
                        raw, _, payload = block.partition(b"\r\n\r\n")
                        head = raw.decode("utf-8", "replace")
                    if kind == "metadata":
                        fields = [tuple(x.strip() for x in line.split(":", 1)) for line in block.decode("utf-8", "replace").split(CRLF) if ":" in line]
                    if kind == "response":
                        digest, size = b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
                        ok = said is None or said == digest
                    elif kind == "revisit":
                        digest, payload = said, None
                        size = next((int(x.split(":")[1]) for x in head.split(CRLF) if x.lower().startswith("content-length:")), None)
                    found.append((kind, one("warc-record-id"), h.get("warc-concurrent-to", []), one("warc-refers-to"), one("warc-target-uri"), one("warc-date"), digest, size, ok, head, list(dict(fields).items()), payload))
                    held += len(block)
                    if held > 8 << 20:
                        yield batch(found)
                        found, held = [], 0
                if found:
                    yield batch(found)

    files = spark.read.format("binaryFile").load(folder).select("content")
    return files.mapInArrow(rows, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: the response or revisit, with its requests and metadata.

    A record belongs to a capture if either names the other in its
    concurrent-to headers. A response without companions has empty lists; a
    companion of no response is left out, as it is no capture.
    """
    captures = records.where(F.col("type").isin("response", "revisit"))
    other = records.where(F.col("type").isin("request", "metadata")).select("record_id", "type", "http_head", "fields", "concurrent_to")
    forth = other.select("record_id", "type", "http_head", "fields", F.explode("concurrent_to").alias("capture_id"))
    back = captures.select(F.col("record_id").alias("capture_id"), F.explode("concurrent_to").alias("record_id"))
    back = other.join(back, "record_id").select("record_id", "type", "http_head", "fields", "capture_id")
    linked = forth.unionByName(back)
    part = lambda kind, *cols: F.sort_array(F.collect_set(F.when(F.col("type") == kind, F.struct("record_id", *cols))))
    beside = linked.withColumn("pairs", F.sort_array(F.map_entries("fields"))).groupBy("capture_id").agg(part("request", "http_head").alias("requests"), part("metadata", "pairs").alias("metadata"))
    own = ["record_id", "type", "target_uri", "date", "refers_to", "payload_digest", "payload_bytes", "digest_ok", "http_head", "payload"]
    none = lambda c: F.coalesce(F.col(c), F.expr("array()").cast(beside.schema[c].dataType))
    return captures.select(*own).join(beside, F.col("record_id") == F.col("capture_id"), "left").select(*own, none("requests").alias("requests"), none("metadata").alias("metadata"))


def round_trip(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write the pages to archives in a folder all machines share, and read the captures back; archives are parsed once, into a table."""
    spark = pages.sparkSession
    own = None if folder else f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_captures(pages, folder or own, **options)
    if own:
        remove_at_exit(spark, own)
    return assemble(written(read_records(spark, folder or own), "zstd"))


def metadata_field(name: str) -> Column:
    """The first value of a metadata field of a capture."""
    pairs = F.flatten(F.transform("metadata", lambda m: m["pairs"]))
    return F.try_element_at(F.map_from_entries(F.filter(pairs, lambda p: p["key"] == name)), F.lit(name))
