"""Derivatives of web responses: linked metadata and plain-text conversion records.

A response record holds a page as it was fetched. From each, two records are made that name it in
WARC-Refers-To and keep its target, its headers and the digest of its payload: ``metadata``
(application/warc-fields: title, language, charset, links in order) and ``conversion`` (the page's text).
Records are identified by a hash of what they are made from, so a task that runs again
makes the same record. All of it is row by row and in built-in functions; writing and reading
files of records is done in tasks.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.llm.common import columns_of, filesystem

CRLF = "\r\n"
#: Patterns are alike in Java and RE2, so that SQL can repeat them.
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>"
BLOCKS = r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|blockquote|pre)\b[^>]*>"
TAGS = r"(?s)<[/!?a-zA-Z][^>]*>"
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def record_id(kind: str, *parts: Column) -> Column:
    """A name-based identifier: the md5 of kind and parts in the form of a UUID."""
    h = F.md5(F.concat_ws("\x1f", F.lit(kind), *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def decoded(text: Column) -> Column:
    """Named entities of common pages, the ampersand last."""
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def plain_text(html: Column) -> Column:
    """Visible text: blocks on lines of their own, runs of spaces as one, no empty lines."""
    text = F.regexp_replace(html, HIDDEN, " ")
    text = F.regexp_replace(text, BLOCKS, "\n")
    text = decoded(F.regexp_replace(text, TAGS, ""))
    text = F.regexp_replace(text, r"[ \t\r\f\x0B]+", " ")
    text = F.regexp_replace(text, r" ?\n[ \n]*", "\n")
    return F.regexp_replace(text, r"^[ \n]+|[ \n]+$", "")


def responses(pages: DataFrame) -> DataFrame:
    """Response records of pages (page_id, url, html); a null page is an empty payload."""
    pages = columns_of(pages, page_id="long", url="string", html="string")
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    return pages.select(
        "page_id",
        record_id("response", F.coalesce(F.col("page_id").cast("string"), F.lit("")), url, F.md5(html)).alias("record_id"),
        url.alias("target_uri"),
        F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(html).cast("string"), F.lit(CRLF)).alias("http_headers"),
        html.alias("payload"),
        digest(html).alias("payload_digest"),
    )


def metadata_block(html: Column) -> Column:
    """The fields of a metadata record; fields that a page does not have are left out."""

    def field(name: str, value: Column) -> Column:
        value = F.trim(F.regexp_replace(decoded(value), r"\s+", " "))
        return F.when(value != "", F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise("")

    links = F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*?href=\"([^\"]*)\""), F.lit(1))
    out = F.array_join(F.transform(links, lambda u: F.concat(F.lit("outlink: "), decoded(u), F.lit(CRLF))), "")
    return F.concat(
        field("title", F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title", 1)),
        field("language", F.regexp_extract(html, r"(?i)<html[^>]*?\slang=\"([^\"]*)\"", 1)),
        field("charset", F.regexp_extract(html, r"(?i)<meta[^>]*?charset=\"?([^\"\s/>]+)", 1)),
        out,
    )


def derivatives(records: DataFrame) -> DataFrame:
    """A metadata and a conversion record for each response record.

    page_id, record_type, record_id, refers_to, target_uri, content_type, content_length (bytes of the
    block), block_digest, source_digest (of the response's payload), source_headers, block. An empty
    payload gives an empty block. Equal responses give equal records, as often as they come; an
    empty table gives none.
    """
    made = records.select(
        "*",
        F.explode(
            F.array(
                F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), metadata_block(F.col("payload")).alias("block")),
                F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), plain_text(F.col("payload")).alias("block")),
            )
        ).alias("d"),
    )
    return made.select(
        "page_id",
        "d.record_type",
        F.when(F.col("d.record_type") == "metadata", record_id("metadata", F.col("record_id"))).otherwise(record_id("conversion", F.col("record_id"))).alias("record_id"),
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "d.content_type",
        F.octet_length("d.block").cast("long").alias("content_length"),
        digest(F.col("d.block")).alias("block_digest"),
        F.col("payload_digest").alias("source_digest"),
        F.col("http_headers").alias("source_headers"),
        "d.block",
    )


def write_warc(records: DataFrame, path: str, date: str) -> DataFrame:
    """Write derivatives as files of one gzip member per record, a file per partition; gives (file, records).

    Files are named by partition and renamed when whole, so a task that runs again replaces its own. ``date`` is the
    WARC-Date of all records.
    """
    fs, folder = filesystem(path)
    fs.create_dir(folder, recursive=True)
    names = ["record_type", "record_id", "refers_to", "target_uri", "content_type", "block_digest", "source_digest", "source_headers", "block"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, folder = filesystem(path)
        name = f"part-{TaskContext.get().partitionId():05d}.warc.gz"
        own, n = f"{folder}/.{name}-{uuid.uuid4().hex}", 0
        with fs.open_output_stream(own, compression=None) as out:
            for batch in batches:
                for kind, rid, refers, uri, mime, block_digest, source_digest, headers, block in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                    body = block.encode()
                    kept = headers.strip().replace(CRLF, "; ")
                    lines = [
                        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Refers-To: {refers}",
                        f"WARC-Target-URI: {uri}", f"WARC-Date: {date}", f"WARC-Block-Digest: {block_digest}",
                        f"WARC-Source-Payload-Digest: {source_digest}", f"WARC-Source-Headers: {kept}",
                        f"Content-Type: {mime}", f"Content-Length: {len(body)}",
                    ]
                    out.write(gzip.compress((CRLF.join(lines) + CRLF * 2).encode() + body + b"\r\n\r\n", mtime=0))
                    n += 1
        fs.move(own, f"{folder}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["file", "records"])

    return records.select(*names).mapInArrow(write, "file string, records long")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(headers map, block) of the records of a folder's files, one task per file or more files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                data, at, rows = gzip.decompress(content), 0, []
                while at < len(data):
                    split = data.index(b"\r\n\r\n", at)
                    head = dict(line.split(": ", 1) for line in data[at:split].decode().split(CRLF)[1:])
                    size = int(head["Content-Length"])
                    rows.append((list(head.items()), data[split + 4 : split + 4 + size].decode()))
                    at = split + 4 + size + 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.map_(pa.string(), pa.string())), pa.array([r[1] for r in rows], pa.string())], ["headers", "block"]
                )

    return files.mapInArrow(parse, "headers map<string,string>, block string")
