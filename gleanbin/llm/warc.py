"""WARC archives of pages, read back into one globally ordered index of captures.

Writing: pages of equal payloads (SHA-256, at least 100 bytes) are grouped by digest alone; the smallest page_id keeps
the payload, the others are revisit records that name it. Records go out through Spark's text writer as gzipped WARC/1.1
files: the record is the line, and the two line breaks that end a record are the line separator.

Reading: each archive is decompressed as a stream and parsed by Content-Length; response payloads are digested anew
against their header. Each archive gives a run of captures, sorted by (URL key, time, page_id).

Index merge: runs are dealt to key ranges (of about RANGE_ROWS captures, so memory is bounded; a URL with very many
captures spans several ranges, as time and page_id are parts of the key), and in each range a loser tree merges the
runs' pieces, k - 1 inner nodes, log2(k) comparisons a capture. The ranges in order are the global capture history.

Defined cases: null html is an empty payload; null url has an empty URL key and no target URI; line breaks in a url are
percent-encoded; null page_id sorts first, and is a revisit if another row of its group has an id; rows that repeat the
smallest page_id of a group are responses all; very long payloads are written in files of their own, so an archive is
read with about 256 MB of payloads or one record in memory; an empty table gives an empty index; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanbin.llm.common import discard, scratch, written

LEAST = 100
END = "\r\n\r\n"
#: Records of an archive file at most, of payloads of SMALL bytes at most; 16 times larger ones make 16 times fewer, so that
#: a file has about 256 MB of payloads, or one record. Captures of a key range, about.
FILE_RECORDS, SMALL, RANGE_ROWS = 4000, 1 << 16, 200_000
INDEX = "url_key string, capture_ts string, page_id long, archive string, record long, record_type string, payload_bytes long, payload_digest string, refers_to long"


def with_duplicates(pages: DataFrame) -> DataFrame:
    """page_id, url, body, n_bytes, digest, and refers_to of the rows that repeat another's payload."""
    body = F.coalesce("html", F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("body")).withColumns({"n_bytes": F.octet_length("body").cast("long"), "digest": F.sha2("body", 256)})
    groups = p.where(F.col("n_bytes") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    # written, so that the join gets both sides by an exchange of its own and can split a digest that very many pages share
    groups, _ = written(groups, "payloads")
    repeats = (F.col("n_bytes") >= LEAST) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return p.join(groups, "digest", "left").select("page_id", "url", "body", "n_bytes", "digest", F.when(repeats, F.col("first")).alias("refers_to"))


def capture_time() -> Column:
    """Pages have no time; this stands in for it: one second a page_id from 2024 on."""
    seconds = F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(300_000_000))
    return F.date_format(F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(secs=seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def record() -> Column:
    """A row of with_duplicates() as a WARC record, without its closing line breaks."""
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    again = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(again, "").otherwise(F.col("body")))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        F.when(F.col("page_id").isNotNull(), line("WARC-Record-ID", urn(F.col("page_id")))).otherwise(""),
        line("WARC-Date", capture_time()),
        F.when(uri.isNotNull(), line("WARC-Target-URI", uri)).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(again, F.concat(line("WARC-Refers-To", urn(F.col("refers_to"))), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def write_archives(pages: DataFrame, path: str) -> None:
    """Gzipped WARC files of FILE_RECORDS records at most, in the folder path; large payloads in files of fewer."""
    longest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    rows, low, high, records = with_duplicates(pages), -1, SMALL, FILE_RECORDS
    while low < longest or low < 0:  # sizes in steps of 16: one step for ordinary pages, eight at most
        part = rows.where((F.col("n_bytes") > low) & (F.col("n_bytes") <= high)) if longest > SMALL else rows
        out = part.select(record().alias("value")).write.mode("append").option("lineSep", END).option("compression", "gzip")
        out.option("maxRecordsPerFile", records).text(path)
        low, high, records = high, high * 16, max(1, records // 16)


def url_key(url: str) -> str:
    """The sort key of a URL: host labels from the right, then path and query, without scheme, www, port and fragment."""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    at = min((k for k in (rest.find("/"), rest.find("?")) if k >= 0), default=len(rest))
    host = rest[:at].lower().rsplit("@", 1)[-1].split(":", 1)[0].removeprefix("www.")
    return f"{','.join(reversed(host.split('.')))}){rest[at:] or '/'}" if url else ""


def records(content: bytes) -> Iterator[tuple[dict[str, str], int, bytes]]:
    """Headers, number and block of each record of a gzipped archive, decompressed as a stream."""
    held, at, number = bytearray(), 0, 0

    def pieces():
        machine, data = zlib.decompressobj(31), content
        for k in range(0, len(data), 1 << 16):
            part = data[k : k + (1 << 16)]
            while part:
                yield machine.decompress(part)
                part = machine.unused_data
                if machine.eof:
                    machine = zlib.decompressobj(31)
        yield machine.flush() if not machine.eof else b""

    source = pieces()
    while True:
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            more = next(source, None)
            if more is None:
                if bytes(held[at:]).strip():
                    raise ValueError("an archive ends within a record's header")
                return
            del held[:at]
            at = 0
            held += more
        head = bytes(held[at:end]).decode("utf-8").split("\r\n")
        if not head[0].startswith("WARC/"):
            raise ValueError(f"no WARC record but {head[0][:40]!r}")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
        size = int(headers["content-length"])
        while len(held) < end + 4 + size + 4:
            more = next(source, None)
            if more is None:
                raise ValueError("an archive ends within a record")
            held += more
        yield headers, number, bytes(held[end + 4 : end + 4 + size])
        at, number = end + 4 + size + 4, number + 1


def _id(urn: str | None) -> int | None:
    return int(urn.rsplit(":", 1)[1].rstrip(">")) if urn else None


def capture(headers: dict[str, str], number: int, block: bytes, archive: str) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    digest, kind = headers["warc-payload-digest"].removeprefix("sha256:"), headers["warc-type"]
    size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"record {number} of {archive} does not match its digest")
    return url_key(headers.get("warc-target-uri", "")), headers["warc-date"], _id(headers.get("warc-record-id")), archive, number, kind, size, digest, _id(headers.get("warc-refers-to"))


def order(c: tuple) -> tuple:
    return c[0], c[1], c[2] is not None, c[2] or 0, c[3], c[4]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [x.split(" ")[0] for x in INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """A sorted run of captures for each archive."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                archive = name.as_py().rsplit("/", 1)[-1]
                run = sorted((capture(h, k, b, archive) for h, k, b in records(content.as_py())), key=order)
                for k in range(0, len(run), 5000):
                    yield _batch(run[k : k + 5000])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content").mapInArrow(parse, INDEX)


class LoserTree:
    """Merges sorted iterators; each inner node holds the loser of its match, the root's winner is next."""

    def __init__(self, sources: list[Iterator[tuple]], key):
        self.key, self.sources = key, sources
        self.k = max(1, len(sources))
        self.heads = [self._next(i) for i in range(len(sources))] or [None]
        self.losers = [-1] * self.k
        winner = {self.k + i: i for i in range(self.k)}
        for node in range(self.k - 1, 0, -1):
            a, b = winner[2 * node], winner[2 * node + 1]
            winner[node], self.losers[node] = (a, b) if self._beats(a, b) else (b, a)
        self.top = winner[1]

    def _next(self, i: int):
        row = next(self.sources[i], None)
        return None if row is None else (self.key(row), row)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and x[0] <= y[0]

    def __iter__(self):
        while (head := self.heads[self.top]) is not None:
            yield head[1]
            at = self.top
            self.heads[at] = self._next(at)
            node = (self.k + at) // 2
            while node:
                if self._beats(self.losers[node], at):
                    at, self.losers[node] = self.losers[node], at
                node //= 2
            self.top = at


def merged(index_runs: DataFrame, rows: int) -> DataFrame:
    """The captures in global order: partition after partition, and within each."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                pieces.setdefault(row[3], []).append(row)
        for piece in pieces.values():  # in order already, unless a run came in several blocks
            piece.sort(key=order)
        out = []
        for row in LoserTree([iter(p) for p in pieces.values()], order):
            out.append(row)
            if len(out) == 5000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    n = max(int(index_runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE_ROWS))
    return index_runs.repartitionByRange(n, "url_key", "capture_ts", "page_id", "archive", "record").mapInArrow(merge, INDEX)


def history(pages: DataFrame) -> DataFrame:
    """Writes the archives of pages, reads them back, and merges their runs into one index."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_archives(pages, path)
    index, _ = written(runs(spark, path), "runs")
    discard(spark, path)
    return merged(index, index.count())


def op1(pages: DataFrame) -> DataFrame:
    return history(pages.select("page_id", "url", "html")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as d from pages),
g as (select *, min(page_id) over (partition by d) as f from p)
select page_id, n::bigint as payload_bytes, d as payload_digest, case when n >= 100 and page_id <> f then 'revisit' else 'response' end as record_type,
  case when n >= 100 and page_id <> f then f end as refers_to from g
"""
