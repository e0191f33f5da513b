"""WARC archives and their merged capture index.

Writing: pages become WARC records, gzipped files of bounded size in a folder. Of pages with equal payloads
the one with the largest page_id is a response, the others are revisit records that refer to it and hold no
payload. Reading: each archive is parsed into an index run, sorted by URL key and timestamp. The runs are
exchanged by ranges of (URL key, timestamp, page_id), and in each range the k runs that reach into it are
merged by a loser tree. The ranges in order make one globally ordered capture history. A URL key with very
many captures is split between ranges by timestamp.

Defined results: a null html is an empty payload. Payloads of under `least_bytes` are all responses. Rows
that repeat page_id and payload are captures of their own, alike in type. A null page_id is never referred
to unless all its payload's ids are null, when all of them are responses. A null url has the empty key and
no Target-URI. A URL with control characters is written in a header of its own, in hex. An empty table gives an
empty index. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator
from typing import Any
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, fresh_path, join_counted, pinned

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Bytes of a record besides its payload, about.
HEADERS = 4096
#: Index rows that a task merges, about.
RANGE = 100_000
#: 2024-01-01; pages without a date are dated by their id, a second apart, within a year.
FIRST_SECOND, YEAR = 1704067200, 365 * 86400
INDEX = "url_key string, captured timestamp, page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, url string, archive string, nth long"


def base32_sha1(payload: Column) -> Column:
    """Of five hex digits at a time, the four base-32 digits."""
    hexed = F.sha1(payload)
    parts = []
    for k in range(8):
        n = F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(ALPHABET), F.shiftright(n, 15 - 5 * j).bitwiseAND(31) + F.lit(1), F.lit(1)) for j in range(4)]
    return F.concat(*parts)


def records(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date_col: str | None = None) -> DataFrame:
    """One column, value: each page's WARC record, but for its very last line feed."""
    date = col(date_col) if date_col else F.timestamp_seconds(F.lit(FIRST_SECOND) + F.pmod(F.coalesce(col(id_col).cast("long"), F.lit(0)), F.lit(YEAR)))
    base = pages.select(col(id_col).cast("long").alias("page_id"), col(url_col).alias("url"), F.coalesce(col(html_col), F.lit("")).alias("payload"), date.alias("date"))
    base = base.withColumn("digest", base32_sha1(F.col("payload")))
    tops = pinned(base.groupBy("digest").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")))
    rows = join_counted(base, tops, "digest", "n", F.struct("page_id", "url"))
    revisit = (F.octet_length("payload") >= least_bytes) & F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("payload"), F.lit(CRLF + CRLF))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    # A URL with control characters can't stand in a header line as it is.
    odd = F.col("url").rlike(r"[\x00-\x1F\x7F]")
    url = F.when(odd, F.concat(F.lit("X-Target-URI-Hex: "), F.hex("url"), F.lit(CRLF))).when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), "url", F.lit(CRLF)))
    head = F.concat(
        F.lit(f"WARC/1.0{CRLF}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit(CRLF + "WARC-Record-ID: "), urn(F.col("page_id")),
        F.lit(CRLF + "WARC-Date: "), F.date_format(F.col("date"), "yyyy-MM-dd'T'HH:mm:ssXXX"), F.lit(CRLF), F.coalesce(url, F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit(CRLF),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: "), urn(F.col("top")), F.lit(CRLF))).otherwise(""),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), F.octet_length(block), F.lit(CRLF + CRLF),
    )
    return rows.select(F.concat(head, block, F.lit(CRLF + "\r")).alias("value"))


def write_archives(pages: DataFrame, path: str, per_file: int = 5000, most_bytes: int = 256 << 20, **columns: Any) -> None:
    """Folders of gzipped archives with `per_file` records and about `most_bytes` each at most, before they are packed. Records
    that are too large for that many in a file are written apart, as few to a file as the largest of them asks for."""
    rows, size = records(pages, **columns), F.octet_length("value")
    usual = max(1, most_bytes // per_file)
    largest = pages.agg(F.max(F.octet_length(col(columns.get("html_col", "html"))))).first()[0] or 0
    parts = [("usual", rows, per_file)]
    if largest + HEADERS > usual:
        parts = [("usual", rows.filter(size <= usual), per_file)]
        parts.append(("large", rows.filter(size > usual), max(1, min(per_file, most_bytes // (largest + HEADERS)))))
    for name, part, most in parts:
        part.write.option("compression", "gzip").option("maxRecordsPerFile", most).option("lineSep", "\n").text(f"{path}/{name}")


def url_key(url: str | None) -> str:
    """Host labels from the last to the first, then port, path and query: `com,example)/a?b=1`."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url.lower()
    labels = ",".join(reversed(host.split(".")))
    return f"{labels}{f':{port}' if port and port not in (80, 443) else ''}){parts.path.rstrip('/') or '/'}{'?' + parts.query if parts.query else ''}".lower()


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record; blocks are told by their length alone."""
    while line := stream.readline():
        if line != b"WARC/1.0\r\n":
            raise ValueError(f"no record begins with {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(": ")
            headers[name.lower()] = value.removesuffix("\r\n")
        block = stream.read(int(headers["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record's block isn't as long as its header says")
        yield headers, block


def page_of(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def index_run(archive: str, content: bytes) -> list[tuple]:
    """The index rows of one archive, sorted."""
    from datetime import datetime

    rows = []
    for nth, (h, block) in enumerate(parse(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content))))):
        http, _, payload = block.partition(b"\r\n\r\n")
        length, digest = int(re.search(rb"Content-Length: (\d+)", http)[1]), h["warc-payload-digest"].removeprefix("sha1:")
        if h["warc-type"] == "response" and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError(f"record {nth} of {archive} is damaged")
        url = h.get("warc-target-uri")
        if "x-target-uri-hex" in h:
            url = bytes.fromhex(h["x-target-uri-hex"]).decode()
        captured = datetime.fromisoformat(h["warc-date"])
        rows.append((url_key(url), captured, page_of(h["warc-record-id"]), h["warc-type"], digest, length, page_of(h.get("warc-refers-to")), url, archive, nth))
    return sorted(rows, key=order)


def order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[8], row[9]


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, the winner goes up."""

    def __init__(self, runs: list[Iterator[tuple]], key):
        self.runs, self.key, self.n = runs, key, len(runs)
        self.heads: list[tuple | None] = [next(r, None) for r in runs]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.losers = [-1] * self.n
        self.winner = self._first(1) if self.n else -1

    def _beats(self, a: int, b: int) -> bool:
        """Ended runs lose; equal keys go to the earlier run."""
        x, y = self.keys[a], self.keys[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _first(self, node: int) -> int:
        if node >= self.n:
            return node - self.n
        a, b = self._first(2 * node), self._first(2 * node + 1)
        a, b = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = b
        return a

    def __iter__(self) -> Iterator[tuple]:
        while self.n and self.heads[self.winner] is not None:
            yield self.heads[self.winner]
            w = self.winner
            self.heads[w] = head = next(self.runs[w], None)
            self.keys[w] = None if head is None else self.key(head)
            node = (w + self.n) // 2
            while node:
                if self._beats(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node //= 2
            self.winner = w


def sorted_runs(rows: list[tuple]) -> list[Iterator[tuple]]:
    """Rows that arrived, by archive, cut where an archive's rows aren't in order."""
    runs: dict[tuple, list[tuple]] = {}
    part: dict[str, int] = {}
    for row in rows:
        key = row[8], part.setdefault(row[8], 0)
        if key in runs and order(runs[key][-1]) > order(row):
            part[row[8]] += 1
            key = row[8], part[row[8]]
        runs.setdefault(key, []).append(row)
    return [iter(r) for _, r in sorted(runs.items())]


def _batches(rows: Iterator[tuple], size: int = 10_000) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in INDEX.split(", ")]
    held: list[tuple] = []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], t) for k, t in enumerate(kinds)], names=names)

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield out()
            held = []
    if held:
        yield out()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The archives' index rows; each archive's are a sorted run."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                yield from _batches(iter(index_run(name.rpartition("/")[2], content.as_buffer().to_pybytes())))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInArrow(read, INDEX)


def merged_index(runs: DataFrame) -> DataFrame:
    """The same rows in global order of (url_key, captured, page_id): within partitions, and from one to the next."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        yield from _batches(iter(LoserTree(sorted_runs(rows), order)))

    held = pinned(runs)
    ranges = max(1, -(-held.count() // RANGE))  # the key is unique, so that ranges are even whatever is common
    by_range = held.repartitionByRange(max(ranges, held.sparkSession.sparkContext.defaultParallelism), "url_key", "captured", F.col("page_id").asc_nulls_first(), "archive", "nth")
    return by_range.mapInArrow(merge, INDEX)


def capture_history(pages: DataFrame, path: str | None = None, per_file: int = 5000, **columns: Any) -> DataFrame:
    """Writes pages to archives (in `path`, or a new folder of the shared one) and returns their merged index."""
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    write_archives(pages, path, per_file, **columns)
    return merged_index(read_archives(spark, path))
