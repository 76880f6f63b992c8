"""WARC files: writing captures, reading records, and assembling transactions.

A capture is written as a response (or revisit) record and a request and a metadata record that name it in WARC-Concurrent-To.
Files go out through Spark's text writer, whose line separator closes each record, and come back
through its binary reader, so both ends use any file system that Spark knows. Assembly joins request, response and metadata
records through their concurrent-to identifiers and gives one nested row per capture.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftlab.session import materialise, new_path, release

#: Bytes of records that a file holds at the mean size of a page.
FILE_BYTES = 32 << 20
LEAST_REVISIT = 100
CRLF = "\r\n"
RECORD = "record_id string, type string, uri string, date string, concurrent_to array<string>, refers_to string, digest string, content_type string, length long, block binary"
_LINES = re.compile(rb"\r\n(?=[^ \t])")


def _urn(*parts: Column) -> Column:
    """A UUID urn from a hash of the parts (version and variant bits of a name-based UUID)."""
    h = F.sha2(F.concat_ws("\x1f", *parts), 256)
    p = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), p(1, 8), F.lit("-"), p(9, 4), F.lit("-5"), p(14, 3), F.lit("-a"), p(18, 3), F.lit("-"), p(21, 12), F.lit(">"))


def _record(kind: str | Column, rid: Column, uri: Column, date: Column, content_type: str, block: Column, *more: Column) -> Column:
    """Text of a record without the two closing line ends; more: header lines, null if absent."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), rid), F.concat(F.lit("WARC-Target-URI: "), uri), F.concat(F.lit("WARC-Date: "), date), *more,
             F.concat(F.lit(f"Content-Type: {content_type}{CRLF}Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), block)


def captures(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """(id, uri, payload, bytes, digest, first, nth): payload in UTF-8 (null: empty), the smallest id with the same payload if that has
    at least `least` bytes, and the number of the row, from 1, among those of one id and payload. Only rows that repeat both are dealt out
    to be numbered, by url."""
    page = pages.select(F.col(id_col).cast("long").alias("id"), F.regexp_replace(F.coalesce(F.col(uri_col), F.lit("")), r"[\r\n]", "").alias("uri"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    page = page.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    again = page.filter(F.col("bytes") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    twice = materialise(page.groupBy("id", "digest").count().filter("count > 1").select(F.col("id").alias("id2"), F.col("digest").alias("digest2")), "repeated")
    if twice.isEmpty():
        return page.join(again, "digest", "left").withColumn("nth", F.lit(1))
    same = page.id.eqNullSafe(twice.id2) & (page.digest == twice.digest2)
    order = Window.partitionBy("id", "digest").orderBy("uri")
    numbered = page.join(twice, same, "left_semi").withColumn("nth", F.row_number().over(order))
    return page.join(twice, same, "left_anti").withColumn("nth", F.lit(1)).unionByName(numbered).join(again, "digest", "left")


def write(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> None:
    """Write every row of pages as a capture to gzipped WARC files under path.

    Null urls and payloads are empty; line ends inside a url are dropped. Rows that repeat an id and a payload are written each, with
    record ids of their own; revisits refer to the first of them. Other columns are ignored. The mean size of a page sets the
    number of records of a file.
    """
    page = captures(pages, id_col, uri_col, payload_col)
    key = F.concat_ws("-", F.coalesce(F.col("id").cast("string"), F.lit("null")), "digest", F.col("nth").cast("string"))
    same = F.coalesce(F.col("first") < F.col("id"), F.lit(False))
    main, day = _urn(F.lit("main"), key), F.lit(date)
    origin = F.concat_ws("-", F.col("first").cast("string"), "digest", F.lit("1"))
    mean = pages.agg(F.avg(F.octet_length(payload_col))).first()[0] or 0.0
    per_file = max(3, int(3 * FILE_BYTES / (mean + 1500)))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"))
    refers = F.when(same, F.concat(F.lit("WARC-Refers-To: "), _urn(F.lit("main"), origin), F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))
    concurrent = F.concat(F.lit("WARC-Concurrent-To: "), main)
    body = F.when(same, head).otherwise(F.concat(head, "payload"))
    request = F.concat(F.lit("GET "), F.regexp_replace("uri", r"^\w+://[^/]*", ""), F.lit(f" HTTP/1.1{CRLF}Host: "), F.regexp_extract("uri", r"^\w+://([^/]*)", 1), F.lit(CRLF * 2))
    records = F.array(
        _record("request", _urn(F.lit("request"), key), F.col("uri"), day, "application/http; msgtype=request", request, concurrent),
        _record(F.when(same, F.lit("revisit")).otherwise("response"), main, F.col("uri"), day, "application/http; msgtype=response", body, digest, refers),
        _record("metadata", _urn(F.lit("metadata"), key), F.col("uri"), day, "application/warc-fields", F.concat(F.lit("page-id: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(CRLF)), concurrent),
    )
    page.select(F.explode(records).alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse(data: bytes | io.BufferedIOBase) -> Iterator[dict]:
    """Records of a WARC file, each cut by its Content-Length; a stream is read record by record. Raises ValueError on a damaged one."""
    stream = io.BytesIO(data) if isinstance(data, bytes) else data
    at = 0
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            at += len(line)
            continue
        head = [line]
        while (line := stream.readline()) not in (b"\r\n", b""):
            head.append(line)
        if not head[0].startswith(b"WARC/") or not line:
            raise ValueError(f"no record header at byte {at}")
        fields: dict[str, list[str]] = {}
        for part in _LINES.split(b"".join(head).removesuffix(b"\r\n"))[1:]:
            name, _, value = part.decode("utf-8", "replace").partition(":")
            fields.setdefault(name.strip().lower(), []).append(value.strip())
        one = lambda k, fields=fields: fields[k][0] if k in fields else None
        size = int(one("content-length") or 0)
        block = stream.read(size)
        if len(block) < size:
            raise ValueError(f"record at byte {at} is cut off")
        yield {"record_id": one("warc-record-id"), "type": one("warc-type"), "uri": one("warc-target-uri"), "date": one("warc-date"), "concurrent_to": fields.get("warc-concurrent-to", []), "refers_to": one("warc-refers-to"),
               "digest": one("warc-payload-digest"), "content_type": one("content-type"), "length": size, "block": block}
        at += sum(map(len, head)) + 2 + size


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records of the files under path, gzipped or not, one row each; a file is unpacked as it is read."""
    names = [c.split()[0] for c in RECORD.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                data = gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
                rows, held = [], 0
                for r in parse(data):
                    rows.append(r)
                    held += r["length"] + 500
                    if held > 8 << 20:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInPandas(run, RECORD)


def with_payload(records: DataFrame) -> DataFrame:
    """records, with the HTTP payload's size and SHA-256 (as found, and as stated) in place of the block of response and revisit records."""
    names = [c.split()[0] for c in RECORD.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes, digests = [], []
            for kind, block in zip(pdf["type"], pdf["block"], strict=True):
                body = block[block.find(b"\r\n\r\n") + 4 :] if kind == "response" else None
                sizes.append(None if body is None else len(body))
                digests.append(None if body is None else hashlib.sha256(body).hexdigest())
            light = [b if k == "metadata" else None for k, b in zip(pdf["type"], pdf["block"], strict=True)]
            yield pdf.assign(block=light, payload_bytes=pd.array(sizes, dtype="Int64"), payload_digest=digests)[[*names, "payload_bytes", "payload_digest"]]

    return records.mapInPandas(run, RECORD + ", payload_bytes long, payload_digest string")


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: main (the response or revisit record), requests and metadata (arrays of records).

    A request or metadata record belongs to the main record it names in concurrent_to, or that names it. Records without a
    partner: a main record stands alone with empty arrays; others are left out. Record ids are assumed to be unique;
    of repeated concurrent-to entries one counts.
    """
    cols = records.columns
    nested = F.struct(*cols)
    main = records.filter(F.col("type").isin("response", "revisit"))
    side = records.filter(F.col("type").isin("request", "metadata"))
    named = side.select(F.explode(F.array_distinct("concurrent_to")).alias("capture"), F.col("record_id").alias("side"))
    naming = main.select(F.col("record_id").alias("capture"), F.explode(F.array_distinct("concurrent_to")).alias("side"))
    pairs = named.union(naming).distinct()
    found = side.select(F.col("record_id").alias("side"), "type", nested.alias("record")).join(pairs, "side")
    of = lambda kind: F.collect_list(F.when(F.col("type") == kind, F.col("record")))
    sides = found.groupBy("capture").agg(of("request").alias("requests"), of("metadata").alias("metadata"))
    out = main.select(F.col("record_id").alias("capture"), nested.alias("main")).join(sides, "capture", "left")
    empty = F.array().cast(sides.schema["requests"].dataType)
    return out.select("capture", "main", F.coalesce("requests", empty).alias("requests"), F.coalesce("metadata", empty).alias("metadata"))


def digest_of_pages(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of every row, from archives written and read back."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path, id_col, uri_col, payload_col)
    got = assemble(materialise(with_payload(read(spark, path)), "records"))
    page = F.regexp_extract(F.element_at("metadata", 1)["block"].cast("string"), r"page-id: (-?\d+)", 1)
    got = got.select(F.col("main.record_id").alias("rid"), F.when(page != "", page.cast("long")).alias("page_id"), "main.payload_bytes", F.coalesce("main.payload_digest", F.regexp_replace("main.digest", "^sha256:", "")).alias("payload_digest"),
                     F.col("main.type").alias("record_type"), F.col("main.refers_to").alias("refers"), F.col("main.uri").alias("url"))
    first = got.filter("record_type = 'response'").select(F.col("rid").alias("refers"), F.col("page_id").alias("first_id"), F.col("payload_bytes").alias("first_bytes"))
    out = got.join(first, "refers", "left")
    return out.select("page_id", F.coalesce("payload_bytes", "first_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("first_id").alias("refers_to"), "url")
