r"""WARC transaction assembly (operator 1).

``write`` makes three records per page: a request, a response (or, for a payload that an earlier page has, a revisit) and a
metadata record; request and metadata name the response's record in WARC-Concurrent-To. ``read_records`` parses archives, a
row per record; ``assemble`` joins the records of a transaction through these identifiers to one nested row per capture.

Archives are gzip files of WARC/1.1 records, of at most ``PER_FILE`` transactions and about ``FILE`` bytes, those of pages of
like sizes together (the largest are alone), written by Spark's text sink: a record ends in two line ends, which is also the separator between rows. Records are read
by their Content-Length, never by a separator, so payloads may hold anything. Archives are read through Spark as well, so any
store that it reaches will do.

Of records with equal payloads of at least ``LEAST`` bytes that with the smallest page_id is the response and the others
revisit it. A revisit record has no payload but its digest and length; it names the response's record in WARC-Refers-To, by which
``assemble`` finds the page that it refers to. A page's id is in its metadata record, as page-id.

Scale: only digests are shuffled to find equal payloads, with partial aggregation; only digests of several pages are joined
back; per transaction a few short columns are shuffled to assemble it.

Defined cases: a null html or url is the empty one; of rows with the same smallest page_id and equal payloads each is a
response, of repeated rows each gets a transaction; a null page_id comes after all others and stays null; line ends in a url are
percent-encoded; other columns are ignored; no rows give no records and no captures. Of an archive that is cut short or damaged
the whole records before the damage are read; a record without a usable Content-Length is passed over; other archives' captures
have a null page_id where no metadata record tells one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: Transactions in a file; bytes in a file; pages over so many bytes are alone in one.
PER_FILE, FILE, ALONE = 2000, 64 << 20, 1 << 20
#: Bounds of the classes of smaller pages, in bytes.
CLASSES = (1 << 16, 1 << 18)
LEAST = 100
EOL = "\r\n"
_RECORD = "type string, id string, concurrent_to string, refers_to string, uri string, date string, http string, fields map<string,string>, payload_bytes long, payload_digest string, payload binary"


def _uuid(*parts: Column) -> Column:
    x = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", x.substr(1, 8), x.substr(9, 4), x.substr(13, 4), x.substr(17, 4), x.substr(21, 12)), F.lit(">"))


def _lines(*lines: Column) -> Column:
    """Lines with their ends; null lines are left out."""
    return F.concat_ws("", *(F.concat(x, F.lit(EOL)) for x in lines))


def _field(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value)


def _record(kind: Column | str, ident: Column, block: Column, *fields: Column) -> Column:
    head = _lines(F.lit("WARC/1.1"), _field("WARC-Type", kind), _field("WARC-Record-ID", ident), *fields, _field("Content-Length", F.octet_length(block).cast("string")), F.lit(""))
    return F.concat(head, block)


def write(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", scratch: Scratch | None = None) -> None:
    """Write the archives of pages (page_id, url, html) to the folder path."""
    scratch = scratch or Scratch(pages.sparkSession)
    html = F.coalesce("html", F.lit(""))
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    rows = pages.select("page_id", url.alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    seen = Observation()
    narrow = pages.select("page_id", url.alias("url"), F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("bytes"))
    bounds = [-1, *(x for x in CLASSES if x < ALONE), ALONE, None]
    classes = list(pairwise(bounds))
    of = lambda size, low, high: (size > low) if high is None else (size > low) & (size <= high)
    narrow = narrow.observe(seen, *(F.max(F.when(of(F.col("bytes"), *c), F.col("bytes"))).alias(f"most{i}") for i, c in enumerate(classes)))
    first = F.min(F.struct(F.col("page_id").isNull(), "page_id", "url")).alias("first")
    repeats = narrow.groupBy("digest").agg(first, F.max("bytes").alias("bytes"), F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("bytes") >= LEAST))
    repeats = scratch.cut(repeats.select("digest", F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url")), "repeats")
    rows = rows.join(repeats, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    ident = _uuid(F.lit("response"), page, F.col("digest"), "url")
    host = F.coalesce(F.nullif(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1), F.lit("")), F.lit("unknown"))
    target = F.coalesce(F.nullif(F.regexp_extract("url", "^[a-z]+://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    when, uri = _field("WARC-Date", date), _field("WARC-Target-URI", F.col("url"))
    ask = _lines(F.concat(F.lit("GET "), target, F.lit(" HTTP/1.1")), _field("Host", host), F.lit(""))
    size = F.octet_length("html").cast("string")
    http = _lines(F.lit("HTTP/1.1 200 OK"), _field("Content-Type", "text/html; charset=utf-8"), _field("Content-Length", size), F.lit(""))
    request = _record("request", _uuid(F.lit("request"), page, F.col("digest"), "url"), ask, _field("WARC-Concurrent-To", ident), when, uri, _field("Content-Type", "application/http; msgtype=request"))
    response = _record(
        F.when(again, "revisit").otherwise("response"), ident, F.when(again, http).otherwise(F.concat(http, F.col("html"))), when, uri,
        F.when(again, _field("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(again, _field("WARC-Refers-To", _uuid(F.lit("response"), F.col("first").cast("string"), F.col("digest"), F.col("first_url")))),
        F.when(again, _field("WARC-Refers-To-Target-URI", F.col("first_url"))), F.when(again, _field("WARC-Refers-To-Date", date)),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), _field("Content-Type", "application/http; msgtype=response"),
    )
    about = _lines(_field("page-id", page), _field("payload-bytes", size))
    metadata = _record("metadata", _uuid(F.lit("metadata"), page, F.col("digest"), "url"), about, _field("WARC-Concurrent-To", ident), when, uri, _field("Content-Type", "application/warc-fields"))
    gap = F.lit(EOL + EOL)
    value = F.concat(request, gap, response, gap, metadata)
    for i, c in enumerate(classes):  # files of pages of like sizes, so that a few long pages don't make short files of all
        most = seen.get[f"most{i}"]
        if most is not None or i == 0:  # without pages there is an archive without records
            n = 1 if c[1] is None else min(PER_FILE, max(1, FILE // max(1, most or 1)))
            out = rows.where(of(F.octet_length("html"), *c)).select(value.alias("value")).write.mode("append")
            out.option("lineSep", EOL + EOL).option("compression", "gzip").option("maxRecordsPerFile", n).text(path)


def _head(data: bytes) -> dict[str, str]:
    out = {}
    for line in data.decode("utf-8", "replace").split(EOL):
        name, sep, value = line.partition(":")
        if sep:
            out[name.strip().lower()] = value.strip()
    return out


def _inflate(data: bytes) -> bytes:
    """All members of a gzip file, as far as it is whole; other files as they are."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        d = zlib.decompressobj(31)
        try:
            out.append(d.decompress(data))
        except zlib.error:
            break
        data = d.unused_data
    return b"".join(out)


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each whole record."""
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        head = _head(data[at:end])
        at = end + 4
        size = head.get("content-length", "")
        if not size.isdecimal():
            continue
        if at + int(size) > len(data):
            return
        yield head, data[at : at + int(size)]
        at += int(size)


def _parse(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for head, block in records(_inflate(content.as_py())):
                    kind, http, fields, payload = head.get("warc-type"), None, [], None
                    size = digest = None
                    if head.get("content-type", "").startswith("application/http"):
                        top, _, payload = block.partition(b"\r\n\r\n")
                        http = top.decode("utf-8", "replace")
                        if kind == "response":
                            size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        elif kind == "revisit":
                            size = int(n) if (n := _head(top).get("content-length", "")).isdecimal() else None
                            digest = head.get("warc-payload-digest", "").removeprefix("sha256:")
                    else:
                        fields = list(_head(block).items())
                    rows.append((kind, head.get("warc-record-id"), head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), head.get("warc-date"), http, fields, size, digest, payload if with_payload and kind == "response" else None))
                if rows:
                    types = [pa.string()] * 7 + [pa.map_(pa.string(), pa.string()), pa.int64(), pa.string(), pa.binary()]
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in _RECORD.split(", ")])

    return run


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row per record of the archives in path; payloads are hashed and measured also where they aren't kept."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(_parse(with_payload), _RECORD)


def assemble(records: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """A nested row per capture: (page_id, response struct, request struct, metadata struct, refers_to).

    Very many revisits may refer to one record: both sides of that join are written tables, whose hot keys Spark can split.
    """
    scratch = scratch or Scratch(records.sparkSession)
    other = lambda kind: records.where(F.col("type") == kind)
    request = other("request").groupBy(F.col("concurrent_to").alias("id")).agg(F.min(F.struct(F.col("id").alias("record"), "uri", "date", "http")).alias("request"))
    about = F.struct(F.col("id").alias("record"), "uri", "date", F.col("fields")["page-id"].alias("page_id"), F.col("fields")["payload-bytes"].cast("long").alias("bytes"))
    metadata = other("metadata").groupBy(F.col("concurrent_to").alias("id")).agg(F.min(about).alias("metadata"))
    page = F.nullif(F.col("metadata.page_id"), F.lit("")).cast("long")
    pages = scratch.cut(metadata.select(F.col("id").alias("refers"), page.alias("refers_to")), "pages")
    revisits = scratch.cut(other("revisit").where("refers_to is not null").select("id", F.col("refers_to").alias("refers")).distinct(), "revisits")
    refers = revisits.join(pages, "refers").select("id", "refers_to")
    main = records.where("type in ('response', 'revisit')")
    response = F.struct(F.col("id").alias("record"), "type", "uri", "date", "http", "payload_bytes", "payload_digest", "payload")
    rows = main.select("id", response.alias("response")).join(request, "id", "left").join(metadata, "id", "left").join(refers, "id", "left")
    return rows.select(page.alias("page_id"), "response", "request", "metadata", "refers_to")
