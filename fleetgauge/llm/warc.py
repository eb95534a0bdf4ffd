"""WARC archives of raw pages: written by Spark, indexed, and read back by byte ranges.

Writing: every page becomes one record. Records with equal payloads of at least
``min_bytes`` have one response, the one with the largest page_id; the others are
revisits without a payload that name it. Payload digests are counted before any
payload moves, and only digests that occur twice are joined, so a payload shared by
a third of all pages is one row on that side.

Reading: one pass over the archives writes the index (file, offset, length, URL, digest,
and so on per record). Wanted records are then sorted by file and offset, and neighbours
are read as one byte range of bounded size.

Archives lie below ``spark.checkpoint.dir``, in a file system that pyarrow can open.

A null html is an empty payload, a null url an empty target. A null page_id counts as
smaller than any other; among null ids no one is larger, so all of them are responses
unless a page with an id has their payload. Repeated rows are records each: all rows
with the largest id are responses. Line ends in urls are percent-encoded. Payloads may
hold anything, header lines and blank lines included. An empty table has no records.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.llm.common import column, sliced
from fleetgauge.session import new_folder, stored

#: Records in an archive file, bytes in one range read, and of one reading task.
FILE_RECORDS, RANGE, TASK = 50_000, 4 << 20, 16 << 20

#: The date of the records; the pages have none.
DATE = "1970-01-01T00:00:00Z"

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"

INDEX = (
    "path string, offset bigint, length bigint, url string, digest string,"
    " page_id bigint, record_type string, refers_to bigint, payload_bytes bigint"
)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def digested(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """``page_id, url, payload, digest`` of every page."""
    read = pages.select(
        column(page_id).cast("bigint").alias("page_id"),
        F.coalesce(column(url), F.lit("")).alias("url"),
        F.coalesce(column(html), F.lit("")).alias("payload"),
    )

    def work(part: pa.RecordBatch) -> dict:
        payloads = part.column("payload").cast(pa.binary()).to_pylist()
        made = {name: part.column(name) for name in part.schema.names}
        return made | {"digest": [digest(p) for p in payloads]}

    return sliced(
        read, "payload", work, "page_id bigint, url string, payload string, digest string"
    )


def write_archives(
    pages: DataFrame, folder: str, min_bytes: int = 0,
    page_id: str = "page_id", url: str = "url", html: str = "html",
) -> None:
    """Uncompressed WARC 1.1 files in ``folder``, one record per page."""
    full = digested(pages, page_id, url, html)
    size = F.octet_length("payload")
    repeated = stored(
        full.filter(size >= min_bytes)
        .groupBy(F.col("digest").alias("digest_"))
        .agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
        .filter(F.col("n") > 1).drop("n"),
        "repeated-payloads",
    )
    joined = full.join(
        repeated, (F.col("digest") == F.col("digest_")) & (size >= min_bytes), "left"
    )
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    name = lambda c: F.concat(
        F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">")
    )
    target = F.replace(
        F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")
    )
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("page_id")),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), target,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit("\r\nWARC-Payload-Length: "), size.cast("string"),
        F.when(
            revisit,
            F.concat(
                F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), name(F.col("response"))
            ),
        ).otherwise("\r\nContent-Type: text/html; charset=utf-8"),
        F.lit("\r\nContent-Length: "),
        F.when(revisit, "0").otherwise(size.cast("string")),
        F.lit(END),
    )
    body = F.when(revisit, "").otherwise(F.col("payload"))
    joined.select(F.concat(head, body).alias("value")).write.option("lineSep", END).option(
        "maxRecordsPerFile", FILE_RECORDS
    ).text(folder)


def _opened(path: str):
    """A seekable file; Spark writes ``file:/x`` for what others call ``file:///x``."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file:///"):
        path = "file://" + path[len("file:") :]
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    return dict(line.split(": ", 1) for line in lines[1:] if ": " in line)


def _page(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _records(path: str) -> Iterator[tuple]:
    """What the index keeps of each record; payloads are skipped, not read whole."""
    end = END.encode()
    with _opened(path) as file:
        total, offset = file.size(), 0
        held, at = b"", 0  # bytes of the file from position ``at``
        while offset < total:
            held, at = (held[offset - at :], offset) if offset - at < len(held) else (b"", offset)
            while (stop := held.find(end)) < 0:
                file.seek(at + len(held))
                more = file.read(1 << 20)
                if not more:
                    raise ValueError(f"{path}: no end of the header at {offset}")
                held += more
            headers = _headers(held[:stop])
            length = stop + len(end) + int(headers["Content-Length"]) + len(end)
            yield (
                path, offset, length, headers.get("WARC-Target-URI", ""),
                headers["WARC-Payload-Digest"].removeprefix("sha1:"),
                _page(headers["WARC-Record-ID"]), headers["WARC-Type"],
                _page(headers.get("WARC-Refers-To")), int(headers["WARC-Payload-Length"]),
            )
            offset += length


def build_index(spark: SparkSession, folder: str) -> DataFrame:
    """Offset, length, URL and digest of every record below ``folder``."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    spread = files.repartition(
        max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows: list[tuple] = []
                for row in _records(path):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return spread.mapInArrow(run, INDEX)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    whole, text = pa.int64(), pa.string()
    kinds = [text, whole, whole, text, text, whole, text, whole, whole]
    names = [field.split()[0] for field in INDEX.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)],
        names=names,
    )


def read_records(index: DataFrame) -> DataFrame:
    """Payloads of the index rows given, by coalesced byte ranges.

    A revisit's payload is null; its response has it.
    """
    near = index.repartition("path", F.floor(F.col("offset") / TASK)).sortWithinPartitions(
        "path", "offset"
    )
    fields = INDEX + ", payload binary"

    def read(rows: list[tuple]) -> pa.RecordBatch:
        start, end = rows[0][1], rows[-1][1] + rows[-1][2]
        with _opened(rows[0][0]) as file:
            file.seek(start)
            data = file.read(end - start)
        payloads = []
        for row in rows:
            record = data[row[1] - start : row[1] - start + row[2]]
            body = record[record.find(END.encode()) + len(END) : -len(END)]
            payloads.append(body if row[6] == "response" else None)
        made = _batch(rows)
        return pa.RecordBatch.from_arrays(
            [*made.columns, pa.array(payloads, pa.binary())],
            names=[*made.schema.names, "payload"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if waiting and (
                    row[0] != waiting[0][0]
                    or row[1] != waiting[-1][1] + waiting[-1][2]
                    or row[1] + row[2] - waiting[0][1] > RANGE
                ):
                    yield read(waiting)
                    waiting = []
                waiting.append(row)
        if waiting:
            yield read(waiting)

    return near.mapInArrow(run, fields)


def archived(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the pages, index the archives, and read every record back.

    Sizes and digests of responses are those of the bytes read; a revisit tells those
    of the payload it stands for.
    """
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    write_archives(pages, folder, min_bytes)
    index = stored(build_index(spark, folder), "warc-index")

    def work(part: pa.RecordBatch) -> dict:
        made = {n: part.column(n) for n in ("page_id", "record_type", "refers_to", "url")}
        payloads = part.column("payload").to_pylist()
        told = zip(
            payloads, part.column("payload_bytes").to_pylist(),
            part.column("digest").to_pylist(), strict=True,
        )
        pairs = [(n, d) if p is None else (len(p), digest(p)) for p, n, d in told]
        return made | {
            "payload_bytes": [n for n, _ in pairs], "payload_digest": [d for _, d in pairs],
        }

    return sliced(
        read_records(index), "payload", work,
        "page_id bigint, payload_bytes bigint, payload_digest string, record_type string,"
        " refers_to bigint, url string",
    ).drop("url")


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
    unhex(sha1(coalesce(html, '')))::BIT::VARCHAR AS bits
  FROM pages
), d AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
      + 16 * CAST(substr(bits, CAST(5 * i + 1 AS BIGINT), 1) AS INT)
      + 8 * CAST(substr(bits, CAST(5 * i + 2 AS BIGINT), 1) AS INT)
      + 4 * CAST(substr(bits, CAST(5 * i + 3 AS BIGINT), 1) AS INT)
      + 2 * CAST(substr(bits, CAST(5 * i + 4 AS BIGINT), 1) AS INT)
      + CAST(substr(bits, CAST(5 * i + 5 AS BIGINT), 1) AS INT), 1)), '') AS payload_digest
  FROM p
), r AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS response FROM d
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = response THEN NULL ELSE response END AS refers_to
FROM r
"""
