"""WARC archives of pages, read back and indexed.

Writing: a page is one record; of equal payloads the first page is a response,
the others revisit it. Archives are text files whose line separator is the two
line ends that close a record, so Spark's own writer makes them on any store.
Reading: each archive gives one run of captures sorted by URL key and time. The
runs are dealt by key ranges, and in each range a loser tree merges them, which
gives the capture histories in one global order.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import math
import uuid
import zlib
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import slices, whole_text
from corpusflow.operators.sizing import broadcast_if_small
from corpusflow.session import shared_dir, staged

RECORDS_PER_ARCHIVE = 2_000
CAPTURES_PER_RANGE = 200_000
END = b"\r\n\r\n"
# Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Pages carry no time of capture: by default they were taken a second apart, in order of their ids.
FIRST_CAPTURE = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page: str | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def page_of(uri: str | None) -> str | None:
    name = uri[len("<urn:page:") : -1] if uri else "none"
    return None if name == "none" else name


def clean_url(url: str) -> str:
    """Control characters, spaces and characters beyond ASCII escaped, so that a URL is one header line."""
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~<>\"\\^`{|}")


def url_key(url: str) -> str:
    """Sort key of a URL: host parts reversed, then path and query, in lower case; '' without a URL."""
    try:
        parts = urlsplit(url.strip().lower())
        host, port = parts.hostname, parts.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    names = host.split(".")
    names = names[1:] if names[0] == "www" and len(names) > 2 else names
    at = "" if port in (None, 80, 443) else f":{port}"
    return f"{','.join(reversed(names))}{at}){parts.path or '/'}{'?' + parts.query if parts.query else ''}"


def record(page: str | None, url: str | None, date: str, payload: bytes, first: str | None, revisit: bool) -> bytes:
    """One record without its closing line ends."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_uri(page)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {clean_url(url)}")
    if revisit:
        head += [f"WARC-Refers-To: {record_uri(first)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block


def headers(raw: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in raw.decode("utf-8").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, value in pairs}


def records(archive: bytes):
    """(offset, length, headers, block) of every record."""
    at = 0
    while at < len(archive):
        split = archive.index(END, at)
        head = headers(archive[at:split])
        start = split + len(END)
        end = start + int(head["content-length"])
        if archive[end : end + len(END)] != END:
            raise ValueError(f"the record at {at} is not closed")
        yield at, end + len(END) - at, head, archive[start:end]
        at = end + len(END)


def capture(head: dict[str, str], block: bytes) -> dict:
    """The index row of a record; a response's digest is taken from the payload itself."""
    split = block.index(END) + len(END)
    payload, http = block[split:], headers(block[: split - len(END)])
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    if head["warc-type"] == "response" and (payload_digest(payload) != digest or len(payload) != int(http["content-length"])):
        raise ValueError(f"the payload of {head['warc-record-id']} is damaged")
    url = head.get("warc-target-uri")
    return {
        "page": page_of(head["warc-record-id"]),
        "url_key": url_key(url) if url is not None else "",
        "date": head["warc-date"],
        "record_type": head["warc-type"],
        "payload_bytes": int(http["content-length"]),
        "payload_digest": digest,
        "refers": page_of(head.get("warc-refers-to")),
    }


def write_archives(pages: DataFrame, folder: str, captured: Column | None, records_per_archive: int) -> None:
    body = whole_text("html")
    if captured is None:
        captured = F.timestamp_seconds(F.lit(int(FIRST_CAPTURE.timestamp())) + F.coalesce(F.expr("try_cast(page_id as long)"), F.lit(0)))
    date = F.date_format(captured, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date")
    rows = pages.select(F.col("page_id").alias("id"), "url", date, body.alias("body"), F.unhex(F.sha2(body, 256)).alias("same"))
    # Copies: the first page of each payload that occurs more than once; null ids come last.
    order = F.struct(F.col("id").isNull().alias("late"), "id")
    copies = rows.groupBy("same").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = staged(copies.select("same", F.col("first.id").alias("first"), F.lit(True).alias("copied")))
    joined = rows.join(broadcast_if_small(copies), "same", "left")
    revisit = F.coalesce(F.col("copied"), F.lit(False)) & ~F.col("id").eqNullSafe(F.col("first"))
    given = joined.select(F.col("id").cast("string"), "url", "date", F.col("body").cast("binary"), F.col("first").cast("string"), revisit.alias("revisit"))

    def run(batches):
        for batch in slices(batches, 3):
            made = [record(*row).decode("utf-8") for row in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["value"])

    lines = given.mapInArrow(run, "value string")
    lines.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", records_per_archive).text(folder)


FIELDS = ("page", "url_key", "date", "record_type", "payload_bytes", "payload_digest", "refers", "archive", "offset", "length", "seq")
RUN = (
    "page string, url_key string, date string, record_type string, payload_bytes long, payload_digest string, refers string, "
    "archive string, offset long, length long, seq long"
)
KINDS = [pa.int64() if f in ("payload_bytes", "offset", "length", "seq") else pa.string() for f in FIELDS]


def sort_key(row: dict) -> tuple:
    return row["url_key"], row["date"], row["archive"], row["offset"]


def index_runs(spark: SparkSession, folder: str) -> DataFrame:
    """One sorted run of captures per archive; ``seq`` is the place in the run."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                archive = zlib.decompress(content.as_py(), wbits=47)
                found = [
                    {**capture(head, block), "archive": path, "offset": at, "length": length} for at, length, head, block in records(archive)
                ]
                found.sort(key=sort_key)
                for seq, row in enumerate(found):
                    row["seq"] = seq
                yield pa.RecordBatch.from_arrays([pa.array([r[f] for r in found], k) for f, k in zip(FIELDS, KINDS)], list(FIELDS))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder)
    return files.select("path", "content").mapInArrow(run, RUN)


class LoserTree:
    """Merges sorted lists; a replacement costs one comparison per level of the tree."""

    def __init__(self, runs: list[list]) -> None:
        self.runs = runs
        self.at = [0] * len(runs)
        k = self.size = max(1, len(runs))
        self.losers = [-1] * k
        winners = [-1] * (2 * k)
        for i in range(len(runs)):
            winners[k + i] = i
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self.before(a, b) else (b, a)
        self.winner = winners[1] if k > 1 else (0 if runs else -1)

    def before(self, a: int, b: int) -> bool:
        """Run ``a``'s next item comes first; ended runs come last, equal items in order of runs."""
        if a < 0 or self.at[a] >= len(self.runs[a]):
            return False
        if b < 0 or self.at[b] >= len(self.runs[b]):
            return True
        x, y = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return (x, a) < (y, b)

    def __iter__(self):
        """(run, place in the run) in sorted order."""
        while self.winner >= 0 and self.at[self.winner] < len(self.runs[self.winner]):
            run = self.winner
            yield run, self.at[run]
            self.at[run] += 1
            node = (self.size + run) // 2
            while node >= 1:
                if self.losers[node] >= 0 and self.before(self.losers[node], run):
                    self.losers[node], run = run, self.losers[node]
                node //= 2
            self.winner = run


def merge_runs(runs: DataFrame) -> DataFrame:
    """Captures with ``range_no`` and ``position``: in order of both, all histories are sorted by key and time."""
    spark = runs.sparkSession
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(runs.count() / CAPTURES_PER_RANGE))
    keys = ("url_key", "date", "archive", "offset")
    # One key may hold any share of the captures, so ranges are cut inside keys too.
    dealt = runs.repartitionByRange(wanted, *keys).withColumn("range_no", F.spark_partition_id())

    def run(batches):
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        items = list(zip(*(table[k].to_pylist() for k in keys)))
        archives, cuts = table["archive"].to_pylist(), [0]
        cuts += [i for i in range(1, len(archives)) if archives[i] != archives[i - 1]] + [len(archives)]
        lists = [items[a:b] for a, b in zip(cuts, cuts[1:])]
        order = pa.array([cuts[r] + i for r, i in LoserTree(lists)], pa.int64())
        merged = table.take(order).append_column("position", pa.array(range(len(order)), pa.int64()))
        yield from merged.combine_chunks().to_batches()

    ordered = dealt.sortWithinPartitions("archive", "seq")  # the pieces of the runs, one after another
    return ordered.mapInArrow(run, f"{RUN}, range_no int, position long")


def warc_round_trip(
    pages: DataFrame, folder: str | None = None, captured: Column | None = None, records_per_archive: int = RECORDS_PER_ARCHIVE
) -> DataFrame:
    """Write pages(page_id, url, html) to archives and return their merged index.

    One row per page: page_id, payload_bytes, payload_digest, record_type,
    refers_to, url_key, warc_date, archive, offset, length, range_no, position.
    ``captured`` is the time of capture (a column of timestamps); without it
    pages are one second apart by id. Null html is an empty payload; pages
    without a URL have the key ''. Rows that repeat both the page_id and the
    payload of a response are responses too; null ids are larger than others.
    An empty table gives an empty result.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/corpusflow-warc/{uuid.uuid4().hex}"
    write_archives(pages, folder, captured, records_per_archive)
    merged = merge_runs(staged(index_runs(spark, folder)))
    kind = pages.schema["page_id"].dataType
    return merged.select(
        F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers").cast(kind).alias("refers_to"), "url_key", F.col("date").alias("warc_date"),
        "archive", "offset", "length", "range_no", "position",
    )
