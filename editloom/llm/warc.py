"""WARC derivative builder: response records become linked metadata and plain-text conversion records.

A derived record names the response it refers to, and carries the source's content type, status and digests. Record ids
follow from the source's id and content, so a repeated run writes the same records. Files are written by the text
writer, whose line separator is the end of a record, and read back by content length, so a payload may hold anything."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pass_rows, prepare

CRLF = "\r\n"
#: Date of records whose source has none, and records of one file.
DATE = "1970-01-01T00:00:00Z"
FILE_RECORDS = 5000

# Patterns of the plain-text conversion, in order; each match is replaced by the second text.
TEXT_STEPS = (
    (r"(?is)<!--.*?-->", ""),
    (r"(?is)<head\b.*?</head\s*>|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<template\b.*?</template\s*>", "\n"),
    (r"(?i)</?(p|div|br|h[1-6]|li|ul|ol|tr|td|th|table|article|section|nav|header|footer|blockquote|pre)\b[^>]*>", "\n"),
    (r"<[^>]*>", ""),
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"),
    (r"[ \t\r\f]+", " "),
    (r" ?\n[ \n]*", "\n"),
    (r"^[ \n]+|[ \n]+$", ""),
)
# The same matches, found faster: alternatives begin after their common letter, no way back into a tag's inside, and a space
# that would be replaced by itself is left alone.
_FASTER = {
    TEXT_STEPS[1][0]: r"(?is)<(?:head\b.*?</head|script\b.*?</script|style\b.*?</style|template\b.*?</template)\s*>",
    TEXT_STEPS[2][0]: TEXT_STEPS[2][0].replace("(p|", "(?:p|").replace("[^>]*>", "[^>]*+>"),
    TEXT_STEPS[3][0]: r"<[^>]*+>",
    TEXT_STEPS[10][0]: r"[ \t\r\f]{2,}|[\t\r\f]",
}
TITLE = r"(?is)<title[^>]*>(.*?)</title"
LANGUAGE = r"(?is)<html[^>]*\blang=\"([^\"]*)\""

_FIELDS = "headers map<string,string>, block binary"


def digest_of(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def record_id(*parts: Column) -> Column:
    """A uuid-shaped id from a digest over its parts."""
    hexed = F.sha2(F.concat_ws("|", *parts), 256)
    cut = [F.substring(hexed, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def plain_text(html: Column) -> Column:
    """TEXT_STEPS in order. Entities are plain words, replaced without a regular expression; comments are searched only where one begins."""
    for pattern, put in TEXT_STEPS:
        if pattern.startswith("&"):
            html = F.replace(html, F.lit(pattern), F.lit(put))
            continue
        done = F.regexp_replace(html, _FASTER.get(pattern, pattern), put)
        html = F.when(F.contains(html, F.lit("<!--")), done).otherwise(html) if "<!--" in pattern else done
    return html


def _clean(value: Column) -> Column:
    """A header value: no line ends."""
    return F.translate(F.coalesce(value, F.lit("")), CRLF, "  ")


def responses(pages: DataFrame) -> DataFrame:
    """Response records of (page_id, url, html): ids, headers of the source, payload and digests. Nulls count as empty."""
    own = pass_rows(pages, {"page_id": F.coalesce(F.col("page_id").cast("string"), F.lit("")), "target_uri": _clean(F.col("url")), "payload": F.coalesce(F.col("html"), F.lit(""))})
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(CRLF + CRLF))
    return own.select("*", digest_of(F.col("payload")).alias("payload_digest"), digest_of(F.concat(http, "payload")).alias("block_digest"),
                      F.lit("200").alias("status"), F.lit("text/html; charset=utf-8").alias("content_type"), F.lit(DATE).alias("date")).select(
        "*", record_id(F.lit("response"), F.col("page_id"), F.col("target_uri"), F.col("payload_digest")).alias("record_id"))


def _record(kind: str, block: Column, digest: Column, content_type: str) -> Column:
    """A whole record but for its end; ``digest`` is that of the block."""
    lines = [("WARC-Type", F.lit(kind)), ("WARC-Record-ID", record_id(F.lit(kind), F.col("record_id"))), ("WARC-Refers-To", F.col("record_id")),
             ("WARC-Target-URI", F.col("target_uri")), ("WARC-Date", F.col("date")), ("WARC-Block-Digest", digest),
             ("X-Source-Payload-Digest", F.col("payload_digest")), ("X-Source-Block-Digest", F.col("block_digest")), ("X-Source-Status", F.col("status")),
             ("X-Source-Content-Type", F.col("content_type")), ("X-Page-ID", F.col("page_id")), ("Content-Type", F.lit(content_type)),
             ("Content-Length", F.octet_length(block).cast("string"))]
    head = F.concat(F.lit("WARC/1.1" + CRLF), *[x for name, value in lines for x in (F.lit(name + ": "), value, F.lit(CRLF))], F.lit(CRLF))
    return F.concat(head, block)


def derivatives(source: DataFrame) -> DataFrame:
    """(record): one metadata and one conversion record for each response record."""
    text = plain_text(F.col("payload"))
    title = F.trim(F.regexp_replace(F.regexp_extract("payload", TITLE, 1), r"\s+", " "))
    with_text = source.select("*", text.alias("text"), title.alias("title"), _clean(F.regexp_extract("payload", LANGUAGE, 1)).alias("language"))
    # Each digest is a column of its own, as it stands in several places.
    with_digest = with_text.select("*", digest_of(F.col("text")).alias("text_digest"))
    fields = F.concat(F.lit("title: "), "title", F.lit(CRLF + "language: "), "language", F.lit(CRLF + "text-digest: "), "text_digest", F.lit(CRLF))
    with_fields = with_digest.select("*", fields.alias("fields"))
    both = F.array(_record("metadata", F.col("fields"), digest_of(F.col("fields")), "application/warc-fields"),
                   _record("conversion", F.col("text"), F.col("text_digest"), "text/plain; charset=utf-8"))
    return with_fields.select(F.explode(both).alias("record"))


def write_records(records: DataFrame, path: str) -> None:
    """Write records as gzipped WARC files of a bounded number of records, packed fast rather than small."""
    options = {"lineSep": CRLF + CRLF, "compression": "gzip", "maxRecordsPerFile": str(FILE_RECORDS), "zlib.compress.level": "BEST_SPEED"}
    records.write.options(**options).text(path)


def parse(raw: bytes):
    """(headers, block) of each record of a file."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode().split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        low, high = end + 4, end + 4 + int(headers["Content-Length"])
        if raw[high:high + 4] != b"\r\n\r\n":
            raise ValueError(f"a record ends short at byte {high}")
        yield headers, raw[low:high]
        at = high + 4


def unzipped(content: bytes) -> bytes:
    """A file's bytes; of a gzipped one, of all its members, as many writers make one member per record."""
    parts = []
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        parts.append(member.decompress(content) + member.flush())
        if not member.eof:
            raise ValueError("a gzip member ends short")
        content = member.unused_data
    return b"".join([*parts, content])


def _parse_files(batches):
    for batch in batches:
        for content in batch["content"].to_pylist():
            found = list(parse(unzipped(content)))
            for k in range(0, len(found), 500):
                part = found[k:k + 500]
                yield pa.record_batch({"headers": pa.array([list(h.items()) for h, _ in part], pa.map_(pa.string(), pa.string())),
                                       "block": pa.array([b for _, b in part], pa.binary())})


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(headers, block) of all records of the WARC files in a folder."""
    prepare(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_parse_files, _FIELDS)


def digest_rows(records: DataFrame) -> DataFrame:
    """One row per record read: page_id, kind, ids, digests of the source, and of the block as it was read."""
    h = F.col("headers")
    return records.select(
        F.expr("try_cast(headers['X-Page-ID'] AS BIGINT)").alias("page_id"), h["WARC-Type"].alias("kind"), h["WARC-Record-ID"].alias("record_id"), h["WARC-Refers-To"].alias("refers_to"),
        h["WARC-Target-URI"].alias("target_uri"), h["X-Source-Payload-Digest"].alias("source_digest"), h["X-Source-Content-Type"].alias("source_type"),
        F.concat(F.lit("sha256:"), F.sha2("block", 256)).alias("block_digest"), (h["WARC-Block-Digest"] == F.concat(F.lit("sha256:"), F.sha2("block", 256))).alias("sound"),
        F.octet_length("block").cast("long").alias("block_bytes"))


def build(pages: DataFrame, path: str) -> DataFrame:
    """Derive, write and read back: two rows for each row of ``pages``. An empty page_id header reads as null."""
    write_records(derivatives(responses(pages)), path)
    return digest_rows(read_records(pages.sparkSession, path).select("headers", "block"))
