"""WARC archives of pages, read back into one index in order of address and time.

Writing: a page is one record. Of records with equal payloads of at least `LEAST_SHARED` bytes
the one of the greatest page id is a `response`, which holds the payload; the others are
`revisit` records, which name it and hold no payload. Smaller records are all responses.
Records are laid out with string functions and written by Spark's text writer, whose line end
is the record end, so an archive lands on any file system Spark writes to, a file a task and at
most `MOST_RECORDS` records a file, and a lost task's files are written anew.

Reading: every archive is parsed by its Content-Length fields, the digest of each payload is
worked out and compared with the one in the header, and the archive's captures are sorted by
address key and time: a run. Runs are cut into ranges of the key that Spark takes from their
quantiles, and each range merges its pieces of the runs with a loser tree: a leaf a run, each
inner node the loser of its match, so the next capture costs one match per level. Ranges in
their order, and captures in a range, are the capture history of all addresses.

A piece is recognised as a stretch of ascending captures, so it does not matter in which order
the pieces arrive. Equal payloads meet in 64 parts by page, so a payload that a third of all
pages share is decided in as many tasks.

Nulls, ties and the rest: a null html is an empty payload; a null url has no WARC-Target-URI
and the empty key, which sorts first; line ends in a url are written as %0D and %0A; a null
page id is less than any other; of equal greatest page ids with equal payloads the greatest url
is the response, and of wholly equal rows one; pages hold no capture time, so the second
`page_id` modulo 2^32 of the epoch stands for it; no pages give no records; other columns are
unused.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import math
import uuid
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from staycohort.llm.common import materialised, shared_folder

#: Bytes from which equal payloads are stored once.
LEAST_SHARED = 1000
#: Records of an archive file, and captures of a range that one task merges.
MOST_RECORDS, RANGE_ROWS = 4_000, 100_000
#: Parts in which equal payloads meet.
PARTS = 64

_LINE = "\r\n"
_KEY = ["address", "captured", "page_id", "record_type", "payload_digest"]
_INDEX = pa.schema(
    [("address", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string())]
    + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]
    + [("url", pa.string()), ("archive", pa.string()), ("place", pa.int64())]
)
_INDEX_SQL = (
    "address string, captured string, page_id bigint, record_type string, payload_bytes bigint, "
    "payload_digest string, refers_to bigint, url string, archive string, place bigint"
)


def _decided(pages: DataFrame, least_shared: int) -> DataFrame:
    """The pages with digest, n_bytes, `nth` of wholly equal rows, and `first`: the page that
    holds the payload (page_id, url), null where the payload is stored with its own record."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        "url",
        payload.alias("html"),
        F.sha1(payload).alias("digest"),
        F.octet_length(payload).cast("bigint").alias("n_bytes"),
        F.pmod(F.xxhash64("page_id", "url"), F.lit(PARTS)).cast("int").alias("part"),
    )
    identity = F.struct(F.col("page_id").isNotNull().alias("has_id"), "page_id", F.col("url").isNotNull().alias("has_url"), "url")
    first = (
        rows.where(F.col("n_bytes") >= least_shared)
        .groupBy("digest", "part")
        .agg(F.max(identity).alias("first"), F.count(F.lit(1)).alias("n"))
        .groupBy("digest")
        .agg(F.max("first").alias("first"), F.sum("n").alias("n"), F.collect_list("part").alias("parts"))
        .where(F.col("n") > 1)
        .select("digest", "first", F.explode("parts").alias("part"))
    )
    equal = Window.partitionBy("digest", "part", "page_id", "url").orderBy("n_bytes")
    return (
        rows.repartition("digest", "part")
        .withColumn("nth", F.row_number().over(equal))
        .join(first, ["digest", "part"], "left")
        .withColumn("holds", (F.col("first") == identity) & (F.col("nth") == 1))
        .withColumn("first", F.when(F.col("holds"), None).otherwise(F.col("first")))
    )


def _lines(*fields: tuple[str, Column]) -> Column:
    """Header lines; a field of a null value is left out."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_LINE)), F.lit("")) for name, value in fields])


def _record_name(page_id: Column, url: Column, digest: Column, nth: Column) -> Column:
    parts = [F.coalesce(page_id.cast("string"), F.lit("")), F.lower(F.hex(F.xxhash64(url))), digest, nth.cast("string")]
    return F.concat(F.lit("<urn:page:"), F.concat_ws(":", *parts), F.lit(">"))


def _records(decided: DataFrame) -> DataFrame:
    """(record): the text of each record but for its end."""
    shared = F.col("first").isNotNull()
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_LINE}Content-Type: text/html; charset=utf-8{_LINE}"),
        _lines(("Content-Length", F.col("n_bytes").cast("string"))),
        F.lit(_LINE),
    )
    block = F.when(shared, http).otherwise(F.concat(http, "html"))
    second = "timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, pmod(coalesce(page_id, 0), 4294967296))"
    head = _lines(
        ("WARC-Type", F.when(shared, "revisit").otherwise("response")),
        ("WARC-Record-ID", _record_name(F.col("page_id"), F.col("url"), F.col("digest"), F.col("nth"))),
        ("WARC-Target-URI", F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")),
        ("WARC-Date", F.concat(F.replace(F.expr(f"string({second})"), F.lit(" "), F.lit("T")), F.lit("Z"))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        ("WARC-Refers-To", F.when(shared, _record_name(F.col("first.page_id"), F.col("first.url"), F.col("digest"), F.lit(1)))),
        ("WARC-Profile", F.when(shared, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("Content-Type", F.lit("application/http;msgtype=response")),
        ("Content-Length", F.octet_length("block").cast("string")),
    )
    written = F.concat(F.lit(f"WARC/1.1{_LINE}"), head, F.lit(_LINE), F.col("block"))
    return decided.withColumn("block", block).select(written.alias("record"))


def write_archives(pages: DataFrame, folder: str, least_shared: int = LEAST_SHARED, most_records: int = MOST_RECORDS) -> None:
    """Write a record per page to compressed archives in a new folder that all executors share."""
    options = {"lineSep": _LINE * 2, "compression": "gzip", "maxRecordsPerFile": most_records}
    _records(_decided(pages, least_shared)).write.options(**options).text(folder)


def address_key(url: str | None) -> str:
    """Host labels from the last, in lower case, then path and query: addresses of a host sort together."""
    if not url:
        return ""
    _, mark, rest = url.partition("://")
    if not mark:
        return url
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    return ",".join(reversed(rest[:cut].lower().split("."))) + ")" + rest[cut:].partition("#")[0]


def _fields(stream: io.BufferedIOBase) -> dict[str, str]:
    """Header lines up to the empty one."""
    found = {}
    while (line := stream.readline()) not in (b"\r\n", b""):
        name, _, value = line.decode("utf-8", "surrogatepass").rstrip(_LINE).partition(": ")
        found[name.lower()] = value
    return found


def _page_of(name: str | None) -> int | None:
    """The page id in a record's name."""
    number = name.split(":")[2] if name else ""
    return int(number) if number else None


def read_records(stream: io.BufferedIOBase, archive: str) -> Iterator[dict]:
    """The index rows of an archive's records, in its order; a damaged record raises ValueError."""
    place = 0
    while line := stream.readline():
        fields = _fields(stream)
        block = stream.read(int(fields.get("content-length", -1)) if line == b"WARC/1.1\r\n" else 0)
        http, mark, payload = block.partition(b"\r\n\r\n")
        size = int(_fields(io.BytesIO(http.partition(b"\r\n")[2])).get("content-length", -1))
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        whole = fields.get("warc-type") == "revisit" or (len(payload) == size and hashlib.sha1(payload).hexdigest() == digest)
        if not mark or not whole or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"{archive}: record {place} is damaged")
        url = fields.get("warc-target-uri")
        yield {
            "address": address_key(url),
            "captured": fields["warc-date"],
            "page_id": _page_of(fields["warc-record-id"]),
            "record_type": fields["warc-type"],
            "payload_bytes": size,
            "payload_digest": digest,
            "refers_to": _page_of(fields.get("warc-refers-to")),
            "url": url,
            "archive": archive,
            "place": place,
        }
        place += 1


def _key(row: dict) -> tuple:
    """What captures are ordered by, null ids first."""
    return row["address"], row["captured"], row["page_id"] is not None, row["page_id"] or 0, row["record_type"], row["payload_digest"]


def sorted_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The captures of every archive of a folder, sorted archive by archive, stored."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                with gzip.open(pa.BufferReader(content.as_buffer())) as stream:
                    rows = sorted(read_records(stream, path.rsplit("/", 1)[-1]), key=_key)
                yield pa.RecordBatch.from_pylist(rows, _INDEX)

    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "1")  # an archive at a time in a Python worker
    try:
        archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder)
        return materialised(archives.select("path", "content").mapInArrow(read, _INDEX_SQL))
    finally:
        spark.conf.set(setting, before)


class LoserTree:
    """Merges ascending lists: leaf i holds the next item of list i, an inner node the loser of its match."""

    def __init__(self, lists: list[list]) -> None:
        self.lists, self.at = lists, [0] * len(lists)
        n = len(lists)
        winners = [0] * n + list(range(n))
        self.losers = [0] * n
        for node in range(n - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._beats(a, b) else (b, a)
        self.winner = winners[1] if n > 1 else 0

    def _beats(self, a: int, b: int) -> bool:
        if self.at[a] >= len(self.lists[a]):
            return False
        return self.at[b] >= len(self.lists[b]) or self.lists[a][self.at[a]] <= self.lists[b][self.at[b]]

    def __iter__(self) -> Iterator[int]:
        """The list that holds the next least item, once for each item."""
        n = len(self.lists)
        while n and self.at[self.winner] < len(self.lists[self.winner]):
            yield self.winner
            self.at[self.winner] += 1
            node, now = (n + self.winner) // 2, self.winner
            while node:
                if self._beats(self.losers[node], now):
                    now, self.losers[node] = self.losers[node], now
                node //= 2
            self.winner = now


def merge_order(keys: list) -> list[int]:
    """Places of keys that arrive as ascending pieces, in ascending order."""
    starts = [0, *(i for i in range(1, len(keys)) if keys[i] < keys[i - 1])] if keys else []
    pieces = [keys[a:b] for a, b in pairwise([*starts, len(keys)])]
    following = list(starts)
    out = []
    for piece in LoserTree(pieces):
        out.append(following[piece])
        following[piece] += 1
    return out


def histories(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures, ordered by address, time and page over the whole frame."""
    ranges = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(runs.count() / range_rows))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, _INDEX)
        columns = [table[c].to_pylist() for c in _KEY]
        keys = [(a, c, p is not None, p or 0, r, d) for a, c, p, r, d in zip(*columns, strict=True)]
        yield from table.take(pa.array(merge_order(keys), pa.int64())).to_batches(max_chunksize=10_000)

    # ids of one second of one address are few, so the range is cut by the whole key but digests
    return runs.repartitionByRange(ranges, "address", "captured", "page_id").mapInArrow(merge, _INDEX_SQL)


def archived(pages: DataFrame, least_shared: int = LEAST_SHARED) -> DataFrame:
    """The capture histories of pages that are written to archives in the shared folder and read back."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4()}"
    write_archives(pages, folder, least_shared)
    return histories(sorted_runs(spark, folder))
