"""WARC archives: written from pages, read back, and assembled into captures.

A page becomes three records side by side: its response (or a revisit of an earlier equal payload), the request and a
metadata record; the latter two name the first in WARC-Concurrent-To. Archives are written by Spark's text writer,
whose line end is the empty line behind a WARC record, so any store Spark can write to will do. Pages go to files by the
power of four their records stay under, as many a file as FILE_BYTES of that size allow, so that a file before
compression holds FILE_BYTES at most, or a single larger page. Reading
takes whole files and cuts them by Content-Length. The records are then joined by their
identifiers into one nested row per capture. Payloads are not moved by that join unless asked for.

Of records with equal payloads of at least LEAST_BYTES the largest page_id is the response, others revisit it.
Copies are found by digest, by the two Bloom passes of exact dedup.

Defined cases: null html counts as empty; a null url becomes urn:none and line ends in urls are escaped.
Repeated rows (same id, url and payload) have equal record ids and are each returned. A null page_id comes back as null and
never revisits another page, nor is visited while its group has an id. An empty table gives no archive and no captures. Other
columns are not looked at.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .exact_dedup import group_copies
from .scratch import keep, map_arrow

LEAST_BYTES = 1000
FILE_BYTES = 16 << 20
SMALL_PAGE = 1 << 14
# More than the three headers of a page take, but for its url.
HEADERS, URLS = 1 << 12, 8
# Fixed values of the format.
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = ("type string, record_id string, concurrent_to string, refers_to string, uri string, "
          "payload_bytes long, payload_digest string, page_id long, payload binary")


def _record_id(kind: str, key: Column) -> Column:
    h = F.md5(F.concat_ws("\n", F.lit(kind), key))
    parts = [F.substring(h, start, length) for start, length in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(kind: Column, record_id: Column, uri: Column, extra: list[Column], block: Column) -> Column:
    """Header and block; the writer adds the empty lines behind it."""
    lines = [F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id),
             F.lit(f"WARC-Date: {DATE}"), F.concat(F.lit("WARC-Target-URI: "), uri), *extra,
             F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *lines), F.lit(END), block)


def _records(pages: DataFrame) -> DataFrame:
    """(value) records of rows (page_id, url, html, digest, keep_id); keep_id is null for responses."""
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    digest, uri = F.col("digest"), F.col("url")
    own = _record_id("response", F.concat_ws("\n", page, digest))
    length = F.octet_length("html").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.when(F.col("keep_id").isNull(), length).otherwise(F.col("bytes").cast("string")), F.lit(END))
    signed = F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest)
    response = _record(F.lit("response"), own, uri, [signed, F.lit("Content-Type: application/http; msgtype=response")],
                       F.concat(http, F.col("html")))
    other = _record_id("response", F.concat_ws("\n", F.col("keep_id").cast("string"), digest))
    revisit = _record(F.lit("revisit"), own, uri, [
        signed, F.concat(F.lit("WARC-Refers-To: "), other), F.lit(f"WARC-Profile: {PROFILE}"),
        F.lit("Content-Type: application/http; msgtype=response")], http)
    joined = F.concat(F.lit("WARC-Concurrent-To: "), own)
    request = _record(F.lit("request"), _record_id("request", F.concat_ws("\n", page, digest)), uri,
                      [joined, F.lit("Content-Type: application/http; msgtype=request")],
                      F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{END}")))
    metadata = _record(F.lit("metadata"), _record_id("metadata", F.concat_ws("\n", page, digest)), uri,
                       [joined, F.lit("Content-Type: application/warc-fields")],
                       F.concat(F.lit("page_id: "), page, F.lit("\r\n")))
    main = F.when(F.col("keep_id").isNull(), response).otherwise(revisit)
    return pages.select("part", F.explode(F.array(main, request, metadata)).alias("value"))


def _parts(rows: DataFrame, file_bytes: int) -> DataFrame:
    """`rows` with the number `part` of the file of their task that their records go to."""
    size = F.octet_length("html").cast("long") + F.octet_length("url") * URLS + HEADERS
    step = F.greatest(F.lit(0), F.ceil(F.log(4.0, size / SMALL_PAGE))).cast("long")
    most = F.lit(SMALL_PAGE).cast("double") * F.pow(F.lit(4.0), step)
    pages_a_file = F.greatest(F.lit(1.0), F.floor(file_bytes / most)).cast("long")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("part", step * (1 << 33) + F.floor(place / pages_a_file))


def write_archives(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Write gzipped WARC files of `pages` (page_id, url, html) into folders under `path`."""
    url = F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("urn:none")), "[\r\n]", "%0A")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    large = keep(rows.filter(F.octet_length("html") >= LEAST_BYTES).select(
        F.col("page_id").alias("doc_id"), F.unhex("digest").alias("digest"), F.octet_length("html").alias("bytes")), "digests")
    copies = group_copies(large.select("doc_id", "digest")).filter("doc_id <> keep_id").select(
        "doc_id", "keep_id", F.lower(F.hex("digest")).alias("digest")).distinct()
    copies = keep(copies.join(large.select("doc_id", F.lower(F.hex("digest")).alias("digest"), "bytes").distinct(),
                              ["doc_id", "digest"]), "copies")
    ids = keep(copies.select("doc_id").distinct(), "ids")
    number = ids.count()
    alone = bloom.without(rows, "page_id", ids, number).select("*", F.lit(None).cast("long").alias("keep_id"), F.lit(0).alias("bytes"))
    named = copies.withColumnRenamed("doc_id", "page_id")
    # A page id may also stand for other payloads; those are responses of their own.
    met = bloom.within(rows, "page_id", ids, number).join(named, ["page_id", "digest"], "left").select(
        "page_id", "url", F.when(F.col("keep_id").isNull(), F.col("html")).otherwise("").alias("html"), "digest", "keep_id",
        F.coalesce("bytes", F.lit(0)).alias("bytes"))
    _records(_parts(alone.unionByName(met), file_bytes)).write.partitionBy("part").option("lineSep", END).option(
        "compression", "gzip").text(path)


def parse(data: bytes) -> Iterator[dict]:
    """Records of an archive, cut by their Content-Length."""
    at = 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        lines = data[at:head_end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        start = head_end + 4
        end = start + int(fields["Content-Length"])
        if data[end:end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where its length says")
        yield fields | {"block": data[start:end]}
        at = end + 4


def _parsed(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.int64() if n in ("payload_bytes", "page_id") else pa.binary() if n == "payload" else pa.string())
                            for n in (field.split()[0] for field in RECORD.split(", "))])
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for record in parse(gzip.decompress(content.as_py())):
                    row = {"type": record["WARC-Type"], "record_id": record["WARC-Record-ID"], "uri": record["WARC-Target-URI"],
                           "concurrent_to": record.get("WARC-Concurrent-To"), "refers_to": record.get("WARC-Refers-To")}
                    head, _, body = record["block"].partition(b"\r\n\r\n")
                    if row["type"] == "response":
                        row |= {"payload_bytes": len(body), "payload_digest": hashlib.sha1(body).hexdigest()}
                        row["payload"] = body if with_payload else None
                    elif row["type"] == "revisit":
                        row["payload_bytes"] = int(head.decode().rsplit("Content-Length: ", 1)[1].split("\r\n")[0])
                        row["payload_digest"] = record["WARC-Payload-Digest"].removeprefix("sha1:")
                    elif row["type"] == "metadata":
                        page = record["block"].decode().removeprefix("page_id: ").strip()
                        row["page_id"] = None if page == "none" else int(page)
                    rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
    return run


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """All records in the archives of a folder."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return map_arrow(files, _parsed(with_payload), RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, page_id, refers_to (page_id of the response that a revisit names),
    response, request, metadata.

    Requests and metadata meet their response by WARC-Concurrent-To, revisits theirs by WARC-Refers-To.
    """
    # Cut points: the joins below then start at tables, and Spark can split their hot keys.
    records = keep(records, "records")
    main = records.filter("type in ('response', 'revisit')")
    sides = records.filter("concurrent_to is not null").groupBy("concurrent_to").agg(
        F.min(F.when(F.col("type") == "request", F.struct("record_id", "uri"))).alias("request"),
        F.min(F.when(F.col("type") == "metadata", F.struct("record_id", "page_id"))).alias("metadata"))
    main = main.drop("concurrent_to", "page_id")
    captures = main.join(sides.withColumnRenamed("concurrent_to", "record_id"), "record_id", "left").select(
        "record_id", "refers_to", "request", "metadata",
        F.struct("type", "uri", "payload_bytes", "payload_digest", "payload").alias("response"))
    captures = keep(captures.withColumn("page_id", F.col("metadata.page_id")), "captures")
    revisits = captures.filter("refers_to is not null")
    named = captures.filter("response.type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("page"))
    wanted = keep(named.join(revisits.select("refers_to").distinct(), "refers_to", "left_semi").distinct(), "visited")
    plain = captures.filter("refers_to is null").select("record_id", "page_id", F.lit(None).cast("long").alias("refers_to"), "response", "request", "metadata")
    seen = revisits.join(wanted, "refers_to", "left").select(
        "record_id", "page_id", F.col("page").alias("refers_to"), "response", "request", "metadata")
    return plain.unionByName(seen)
