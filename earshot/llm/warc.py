"""Content-addressed archives of web records.

Payload bytes are stored once, as resource records of gzip-per-record WARC segments named by their
SHA-256 digest; the exact header block of every record is kept in a table beside them. Reading checks
every payload against the digest that names it, and a join puts original records together again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import file_system, settle, shared_dir

SMALLEST = 100  # payloads of fewer bytes are never told to be the same
DATE = "1970-01-01T00:00:00Z"


def _header(kind: Column, page: Column, url: Column, size: Column, digest: Column, refers_to: Column, date: str) -> Column:
    """The header block of a record, with its blank line."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    uri = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]", "")
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        F.when(
            refers_to.isNotNull(),
            F.concat(
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), refers_to.cast("string"), F.lit(">"))),
            ),
        ).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(kind == "revisit", F.lit(0).cast("long")).otherwise(size).cast("string")),
        F.lit("\r\n"),
    ).cast("binary")


def store(pages: DataFrame, out: str | None = None, date: str = DATE) -> tuple[DataFrame, DataFrame]:
    """Writes ``page_id, url, html`` as an archive; returns its headers and the manifest of its segments.

    Headers: page_id, digest, header (exact bytes). Null html is an empty payload. Among records with
    equal payloads of at least 100 bytes the one with the smallest page_id is a response and the others
    revisit it; where ids repeat, the first response is one of those rows. Rows without page_id are
    responses. Segments are named by random numbers and only the manifest lists those of tasks that
    ended. Other columns are not used. Runs the jobs.
    """
    spark = pages.sparkSession
    out = out or shared_dir(spark, "archive")
    raw = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", raw.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.length("payload").cast("long"))
    # the row whose payload is stored: the smallest id; rows that repeat it are told apart by a number
    narrow = settle(rows.select("page_id", "url", "digest", "size", F.monotonically_increasing_id().alias("row")), "records")
    first = settle(
        narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.min(F.struct(F.col("page_id").isNull(), "page_id", "row"))["row"].alias("first_row")), "firsts"
    )
    records = narrow.join(first, "digest")
    again = (F.col("size") >= SMALLEST) & F.col("page_id").isNotNull() & (F.col("row") != F.col("first_row"))
    records = records.withColumn("kind", F.when(again, "revisit").otherwise("response"))
    refers_to = F.when(again, F.col("first"))
    records.select(
        "page_id", "digest", _header(F.col("kind"), F.col("page_id"), F.col("url"), F.col("size"), F.col("digest"), refers_to, date).alias("header")
    ).write.parquet(f"{out}/headers")

    def write(batches):
        import gzip
        import hashlib

        import pyarrow as pa
        from pyspark import TaskContext

        files, folder = file_system(f"{out}/payloads")
        files.create_dir(folder, recursive=True)
        name = f"seg-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        sink, n, size = None, 0, 0
        for b in batches:
            for digest, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"payload does not match its digest {digest}")
                head = (
                    "WARC/1.1\r\nWARC-Type: resource\r\n" f"WARC-Record-ID: <urn:sha256:{digest}>\r\nWARC-Date: {date}\r\n"
                    f"WARC-Block-Digest: sha256:{digest}\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
                )
                if sink is None:
                    sink = files.open_output_stream(f"{folder}/{name}", compression=None)
                sink.write(gzip.compress(head.encode() + payload + b"\r\n\r\n", compresslevel=5, mtime=0))
                n, size = n + 1, size + len(payload)
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pylist([{"path": f"{out}/payloads/{name}", "n": n, "size": size}], schema=pa.schema([("path", pa.string()), ("n", pa.int64()), ("size", pa.int64())]))

    # the payload of every digest once: groups are merged in the tasks before they are shuffled
    once = rows.groupBy("digest").agg(F.min("payload").alias("payload"))
    segments = settle(once.mapInArrow(write, "path string, n long, size long"), "segments")
    return spark.read.schema("page_id long, digest string, header binary").parquet(f"{out}/headers"), segments


def payloads(segments: DataFrame) -> DataFrame:
    """Reads the segments back: digest, payload. Every record is checked against the digest that names it."""

    def read(batches):
        import hashlib
        import zlib

        import pyarrow as pa

        kinds = pa.schema([("digest", pa.string()), ("payload", pa.binary())])
        for b in batches:
            for path in b.column(0).to_pylist():
                files, name = file_system(path)
                out, size = [], 0
                with files.open_input_stream(name, compression=None) as source:
                    rest, ended = b"", False
                    while not ended or rest:
                        unzip, parts = zlib.decompressobj(31), []
                        while not unzip.eof:
                            if not rest:
                                rest = source.read(1 << 20)
                                if not rest:
                                    ended = True
                                    break
                            parts.append(unzip.decompress(rest))
                            rest = unzip.unused_data
                        record = b"".join(parts)
                        if not record:
                            break
                        head, _, body = record.partition(b"\r\n\r\n")
                        named = dict(h.split(": ", 1) for h in head.decode().split("\r\n")[1:])
                        payload = body[: int(named["Content-Length"])]
                        digest = named["WARC-Block-Digest"].removeprefix("sha256:")
                        if body[len(payload) :] != b"\r\n\r\n" or hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"damaged record {digest} in {path}")
                        out.append((digest, payload))
                        size += len(payload)
                        if size > 1 << 23:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)
                            out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

    n = max(1, segments.count())
    return segments.select("path").repartition(n).mapInArrow(read, "digest string, payload binary")


def fields(headers: DataFrame) -> DataFrame:
    """What the header bytes say: page_id, digest, record_type, refers_to."""
    text = F.col("header").cast("string")
    of = lambda name, p: F.regexp_extract(text, rf"\r\n{name}: {p}\r\n", 1)
    number = lambda c: F.when(c != "", c).cast("long")
    return headers.select(
        number(of("WARC-Record-ID", r"<urn:page:(-?\d*)>")).alias("page_id"),
        of("WARC-Payload-Digest", "sha256:([0-9a-f]{64})").alias("digest"),
        of("WARC-Type", r"(\w+)").alias("record_type"),
        number(of("WARC-Refers-To", r"<urn:page:(-?\d+)>")).alias("refers_to"),
        "header",
    )


def records(headers: DataFrame, segments: DataFrame) -> DataFrame:
    """Original records: page_id, header, payload, record (header, payload and the closing blank lines)."""
    joined = headers.join(payloads(segments), "digest")
    return joined.select("page_id", "header", "payload", F.concat("header", "payload", F.lit(b"\r\n\r\n")).alias("record"))
