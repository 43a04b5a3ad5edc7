"""WARC archives with an externally merged capture index.

Writing: each page becomes one record, its payload the html, its URL with blanks and control
characters escaped. Of equal payloads of min_payload
bytes or more the row with the smallest page_id is stored as a response, the others as revisits
that refer to it. Records are sorted by URL key and time within each task, and Spark writes them
as gzipped WARC files with a member for each record (several for one of PART bytes or more), so a
reader can seek to any of them. Files hold at most FILE_RECORDS records of LARGE bytes, larger
payloads stand in files of LARGE_RECORDS.

Reading: files are parsed member by member, and stored digests are checked against the payloads.
Each file is a sorted run of captures. The runs are cut by common ranges of about RANGE_ROWS
captures, by (URL key, time, page with null last, file, place), which no two captures share, so a hot URL or
moment is split too. A task gets its cuts of all runs, one run after the other, and merges them
through a loser tree; the captures' history is in order within and across tasks, and no task holds
more than its range.

Rows: null html is an empty payload, a null url an empty one. A null page_id is stored without an
id, as a response if no row with an id has its payload, else as a revisit. Repeated rows and ids
give a record each; those with the smallest page_id are all responses. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm.runtime import bounded_batches, settled, swept, table_path, width, written

FILE_RECORDS, LARGE, LARGE_RECORDS = 512, 1 << 20, 16
RANGE_ROWS = 50_000
PART = (1 << 24) - 1
BREAK = b"\r\n\r\n"
#: Pages without a time get one second each from here on, by page_id.
EPOCH = 1704067200
CAPTURES = "urlkey string, time string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, file string, place long"


def url_key(url: Column) -> Column:
    """Host parts from the last to the first, then path and query: org,example,www)/path?query."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*|#.*$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))


def escaped(url: Column) -> Column:
    """The URL as it stands in records and keys: blanks and control characters as %XX."""
    one = lambda c: F.when((c <= " ") | (c == "\x7f"), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c)
    return F.when(url.rlike(r"[\x00-\x20\x7F]"), F.array_join(F.transform(F.split(url, ""), lambda c: F.when(c == "", c).otherwise(one(c))), "")).otherwise(url)


def base32(raw: bytes) -> str:
    return base64.b32encode(raw).decode()


def captures(pages: DataFrame, min_payload: int = 0, time_col: str | None = None) -> DataFrame:
    """(page_id, url, urlkey, time, payload, sha1, refers_to), refers_to null for responses; url is
    escaped, and its key is of what is written, so that records are sorted as they are read back."""
    seconds = F.lit(EPOCH) + F.coalesce(F.col("page_id"), F.lit(0))
    time = F.col(time_col).cast("timestamp") if time_col else F.timestamp_seconds(F.pmod(seconds, F.lit(253402300799)))
    url = F.coalesce("url", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), escaped(url).alias("url"), F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("urlkey", url_key(F.col("url"))).withColumn("sha1", F.sha1(F.col("payload").cast("binary")))
    # one row for each payload that occurs more than once; the other payloads need no join partner
    first = rows.where(F.octet_length("payload") >= min_payload).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha1", "first")
    both = rows.join(first, "sha1", "left")
    return both.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("first")


def gzipped(record: bytes) -> bytes:
    """The record as gzip members of at most PART bytes, without the last byte. A member ends in its
    length as four bytes, of which the last is zero for PART bytes or fewer: the files' line
    separator stands for that of the last member, so a record is one row and never parted."""
    return b"".join(zlib.compress(record[at : at + PART], 6, 31) for at in range(0, len(record), PART))[:-1]


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for page, url, time, payload, sha1, refers in zip(batch.page_id, batch.url, batch.time, batch.payload, batch.sha1, batch.refers_to):
            digest = base32(bytes.fromhex(sha1))
            revisit = not pd.isna(refers)
            size = len(payload.encode())
            head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Date: {time}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
            if not pd.isna(page):
                head.append(f"WARC-Record-ID: <urn:page:{int(page)}>")
            if revisit:
                head += [f"WARC-Refers-To: <urn:page:{int(refers)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
            head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if revisit else size}"]
            record = "\r\n".join(head).encode() + BREAK + (b"" if revisit else payload.encode()) + BREAK
            out.append(gzipped(record))
        yield pd.DataFrame({"value": pd.Series(out, dtype=object)})
    settled()


def write_archives(pages: DataFrame, path: str, min_payload: int = 0, time_col: str | None = None) -> str:
    """Write the pages as WARC files into the folder path."""
    bounded_batches(pages.sparkSession)

    def write(some: DataFrame, to: str, most: int) -> None:
        rows = some.sortWithinPartitions("urlkey", "time", F.col("page_id").asc_nulls_last())
        stored = rows.select("page_id", "url", "time", "payload", "sha1", "refers_to").mapInPandas(_records, "value binary")
        stored.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", most).mode("append").text(to)

    rows, large = captures(pages, min_payload, time_col), F.octet_length("payload") > LARGE
    if pages.where(F.octet_length("html") > LARGE).isEmpty():
        write(rows, path, FILE_RECORDS)
    else:
        write(rows.where(~large), path, FILE_RECORDS)
        write(rows.where(large), path, LARGE_RECORDS)
    return path


def members(data: bytes, step: int = 1 << 16) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member."""
    at = 0
    while at < len(data):
        start, reader, parts = at, zlib.decompressobj(31), []
        while not reader.eof:
            if at >= len(data):
                raise ValueError(f"the gzip member at byte {start} has no end")
            parts.append(reader.decompress(data[at : at + step]))
            at += step
        at = min(at, len(data)) - len(reader.unused_data)
        yield start, b"".join(parts)


def records_of(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset of its first member, headers, payload) of each record in a WARC file."""
    whole = members(data) if data[:2] == b"\x1f\x8b" else iter([(0, data)])
    place, left = 0, b""
    for offset, content in whole:
        place, left = (place, left + content) if left else (offset, content)
        while (end := left.find(BREAK)) >= 0:
            lines = left[:end].decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"no WARC record at byte {place}")
            head = dict(x.split(": ", 1) for x in lines[1:])
            stop = end + len(BREAK) + int(head["Content-Length"])
            if len(left) < stop + len(BREAK):
                break
            yield place, head, left[end + len(BREAK) : stop]
            left = left[stop + len(BREAK) :]
    if left:
        raise ValueError(f"the record at byte {place} has no end")


def _page(reference: str | None) -> int | None:
    return int(reference[len("<urn:page:") : -1]) if reference else None


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, data in zip(batch.path, batch.content):
            out = []
            for at, head, payload in records_of(data):
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                kind = head["WARC-Type"]
                if kind == "response" and base32(hashlib.sha1(payload).digest()) != digest:
                    raise ValueError(f"{path}, byte {at}: the payload doesn't have its digest")
                size = len(payload) if kind == "response" else int(head["X-Payload-Length"])
                out.append((head["WARC-Target-URI"], head["WARC-Date"], _page(head.get("WARC-Record-ID")), kind, size, digest, _page(head.get("WARC-Refers-To")), path, at))
            frame = pd.DataFrame(out, columns=["url", "time", "page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "file", "place"], dtype=object)
            yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})
    settled()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the files in path, digests checked."""
    bounded_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    schema = CAPTURES.replace("urlkey", "url")
    return files.mapInPandas(_parsed, schema).withColumn("urlkey", url_key(F.col("url")))


class LoserTree:
    """k sorted iterators as one. Inner nodes keep the loser of their match, so the next item
    takes one match for each level."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * k
        for i in range(k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        if b < 0 or a < 0:
            return a < 0  # an open place wins, and takes part as a loser later
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def _play(self, i: int) -> None:
        node, winner = (i + len(self.runs)) // 2, i
        while node > 0:
            if self._beats(self.losers[node], winner):
                winner, self.losers[node] = self.losers[node], winner
            if winner < 0:
                return
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and self.heads[self.losers[0]] is not None:
            i = self.losers[0]
            item = self.heads[i]
            self.heads[i] = next(self.runs[i], None)
            self._play(i)
            yield item


def _key(value) -> tuple:
    return (value is None or value is pd.NA or value != value, 0 if pd.isna(value) else value)


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One range of all runs, run after run, as one sorted run."""
    frames = [b for b in batches if len(b)]
    if not frames:
        return
    rows = pd.concat(frames, ignore_index=True)
    keys = list(zip(rows.urlkey, rows.time, map(_key, rows.page_id), rows.file, rows.place, range(len(rows))))
    bounds = [0, *(np.flatnonzero(rows.file.to_numpy()[1:] != rows.file.to_numpy()[:-1]) + 1).tolist(), len(rows)]
    order = [item[-1] for item in LoserTree([iter(keys[a:b]) for a, b in zip(bounds, bounds[1:])])]
    for at in range(0, len(order), 10_000):
        yield rows.iloc[order[at : at + 10_000]]


def capture_histories(records: DataFrame) -> DataFrame:
    """The captures in global order of (urlkey, time, page_id), for a written table of captures."""
    names = [c.split(" ")[0] for c in CAPTURES.split(", ")]
    ranges = max(width(records.sparkSession), -(-records.count() // RANGE_ROWS))
    dealt = records.select(*names).repartitionByRange(ranges, "urlkey", "time", F.col("page_id").asc_nulls_last(), "file", "place")
    return dealt.sortWithinPartitions("file", "place").mapInPandas(_merged, CAPTURES)


def archived(pages: DataFrame, path: str | None = None, min_payload: int = 0) -> DataFrame:
    """Write pages as archives (to path, else to the shared folder), read them back and merge
    their index: a row per capture, as in CAPTURES."""
    spark = pages.sparkSession
    path = write_archives(pages, path or table_path(spark, "warc"), min_payload)
    swept(spark)
    # the index is small beside the archives, and dealing it by ranges reads it twice
    return capture_histories(written(read_archives(spark, path), "captures"))


_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('{_CHARS}',
         (((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
