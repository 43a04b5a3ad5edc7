"""Exact removal of repeated 100-byte strings with a logarithmic family of suffix arrays.

The corpus is never in one place. Three steps narrow down which suffixes have to be compared,
and none of them can lose a repeat:

1. chunks: texts are cut at content-defined places (minima of a rolling hash over windows of
   CHUNK bytes). A chunk stands for the suffixes that start in it and is keyed by its bytes and
   the WINDOW - 1 after them. Of equal chunks the earliest is kept, all suffixes of the others
   repeat it.
2. anchors: in each 100-byte window of the earliest chunks the smallest hash of a K-byte string
   is its anchor, which depends on the window's bytes alone. A window whose anchor occurs at one
   place in the corpus can't be a repeat.
3. suffixes: the windows at anchors of several places are dealt by the bytes that windows of
   neighbouring offsets share. Each task takes its suffixes as batches in corpus order: a batch
   gets a suffix array, is merge-scanned against the existing levels for matches of full length,
   what is new becomes a level, and levels of equal size merge, so they grow geometrically.

Hot strings: equal pieces meet in their batch before the shuffle (the later ones repeat the
first), and keys that stay large are dealt anew, suffix by suffix. Step 1 and 2 use partially
aggregated groups and joins whose skewed partitions Spark can split. Per-document lists are bound
by the document's length.

Order is (doc_id, hash of the text, position). Rows: null texts are empty; texts under 100 bytes
lose nothing; rows with one doc_id and one text are one document and get the same result; rows
with a null doc_id take no part and lose nothing. An empty table gives an empty result. Other
columns are ignored (but kept by without_repeats).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.runtime import bounded_batches, removed, settled, swept, width, written

WINDOW = 100
K = 32
CHUNK = 512
BLOCK = 32
#: Bytes that are hashed together, and the longest piece of a text that is handled as one.
TOGETHER, LONGEST = 1 << 18, 1 << 20
PLACE = np.uint64((1 << 24) - 1)
PIECES_PER_TASK, HOT = 5_000, 20_000
#: Rows that a task gathers before it hands them on.
ROWS = 4096

_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, TOGETHER), base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def rolling(data: np.ndarray, k: int = K) -> np.ndarray:
    """A 64-bit hash of each k-byte string (modulo 2^64, then mixed)."""
    n = len(data)
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    h = (total[k:] - total[:-k]) * down[: n - k + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def sliding_min(x: np.ndarray, size: int, done: int = 1) -> np.ndarray:
    """Minimum of each size values; x already holds minima of done."""
    while done < size:
        step = min(done, size - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def places(data: np.ndarray, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, each window's anchor, and the content-defined cuts at each window of chunk bytes."""
    h = rolling(data)
    key = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
    near = sliding_min(key, WINDOW - K + 1)
    far = sliding_min(near, chunk - K + 1, WINDOW - K + 1) if len(near) > chunk - WINDOW else near[:0]
    return h, (near & PLACE).astype(np.int64), (far & PLACE).astype(np.int64)


def cut(text: bytes) -> Iterator[tuple[int, bytes]]:
    """Parts of at most LONGEST bytes that hold every window once."""
    for at in range(0, max(1, len(text) - WINDOW + 1), LONGEST):
        yield at, text[at : at + LONGEST + WINDOW - 1] if len(text) > LONGEST else text


def together(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """(…, base, bytes) rows in lists of about TOGETHER bytes."""
    group, total = [], 0
    for row in rows:
        if group and total + len(row[-1]) > TOGETHER:
            yield group
            group, total = [], 0
        group.append(row)
        total += len(row[-1])
    if group:
        yield group


CHUNKS = "h1 long, h2 long, doc_id long, dk long, start int, n int, anchors array<long>, spots array<int>"
_CHUNKS = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("dk", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("anchors", pa.list_(pa.int64())), ("spots", pa.list_(pa.int32()))])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys, texts = (batch.column(i) for i in range(3))
        rows = ((i, at, part) for i, t in enumerate(texts.to_pylist()) for at, part in cut(t.encode()) if len(part) >= WINDOW)
        for group in together(rows):
            size = np.array([len(r[2]) for r in group], np.int64)
            offset = np.concatenate([[0], np.cumsum(size)[:-1]])
            raw = b"".join(r[2] for r in group)
            data = np.frombuffer(raw, np.uint8)
            h, anchor, cuts = places(data)
            here = np.arange(len(anchor))
            of = np.repeat(np.arange(len(group)), size)
            end = offset + size
            inside = here + WINDOW <= end[of[: len(here)]]
            wide = np.arange(len(cuts)) + CHUNK <= end[of[: len(cuts)]]
            bounds = np.unique(np.concatenate([offset, cuts[wide]]))
            bounds = bounds[bounds + WINDOW <= end[of[bounds]]]
            stop = np.minimum(np.append(bounds[1:], len(data)), end[of[bounds]] - WINDOW + 1)
            fresh = inside.copy()
            fresh[1:] &= anchor[1:] != anchor[:-1]
            fresh[bounds] = True
            begins = np.flatnonzero(fresh)
            spot = anchor[begins]
            ends = np.searchsorted(begins, stop)
            lists = np.concatenate([[0], ends]).astype(np.int32)
            whose = of[bounds]
            base = np.array([r[1] for r in group], np.int64)
            digest = [xxhash.xxh3_128_intdigest(raw[a : b + WINDOW - 1]) for a, b in zip(bounds.tolist(), stop.tolist())]
            low = np.array([d & ((1 << 64) - 1) for d in digest], np.uint64).view(np.int64)
            high = np.array([d >> 64 for d in digest], np.uint64).view(np.int64)
            row = pa.array(np.array([r[0] for r in group])[whose])
            absolute = spot - offset[of[begins]] + base[of[begins]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(low), pa.array(high), ids.take(row), keys.take(row), pa.array((bounds - offset[whose] + base[whose]).astype(np.int32)), pa.array((stop - bounds).astype(np.int32)), pa.ListArray.from_arrays(pa.array(lists), pa.array(h[spot].view(np.int64))), pa.ListArray.from_arrays(pa.array(lists), pa.array(absolute.astype(np.int32)))],
                schema=_CHUNKS,
            )
    settled()


PIECES = "core long, doc_id long, dk long, start int, n int, data binary"


def _rows(out: list[tuple]) -> pd.DataFrame:
    rows = pd.DataFrame(out, columns=["core", "doc_id", "dk", "start", "n", "data"])
    out.clear()
    return rows


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The suffixes at shared anchors, in pieces of up to BLOCK starts. Of equal pieces in a batch
    (by 128-bit digests) the earliest carries its bytes; the others are repeats, theirs are null."""
    out: list[tuple] = []
    for batch in batches:
        seen: set[int] = set()
        batch = batch.sort_values(["doc_id", "dk"])
        for doc, key, text, spots in zip(batch.doc_id, batch.dk, batch.text, batch.spots):
            wanted = np.unique(np.asarray(spots, np.int64))
            for at, part in cut(text.encode()):
                if len(part) < WINDOW:
                    continue
                _, anchor, _ = places(np.frombuffer(part, np.uint8), len(part) + WINDOW)
                starts = np.flatnonzero(np.isin(anchor + at, wanted))
                if not len(starts):
                    continue
                anchors = anchor[starts]
                block = (anchors - starts) // BLOCK
                new = np.ones(len(starts), bool)
                new[1:] = (anchors[1:] != anchors[:-1]) | (block[1:] != block[:-1])
                first = np.flatnonzero(new)
                count = np.diff(np.append(first, len(starts)))
                for s, n, a, b in zip(starts[first].tolist(), count.tolist(), anchors[first].tolist(), block[first].tolist()):
                    if len(out) >= ROWS:
                        yield _rows(out)
                    data = part[s : s + n - 1 + WINDOW]
                    digest = xxhash.xxh3_128_intdigest(data)
                    if digest in seen:
                        out.append((0, doc, key, at + s, n, None))
                        continue
                    seen.add(digest)
                    shared = part[a - b * BLOCK : a - b * BLOCK - BLOCK + 1 + WINDOW]
                    out.append((xxhash.xxh64_intdigest(shared) - (1 << 63), doc, key, at + s, n, data))
    yield _rows(out)
    settled()


def _singly(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces of large keys, suffix by suffix, each keyed by all of its bytes."""
    out: list[tuple] = []
    for batch in batches:
        seen: set[int] = set()
        batch = batch.sort_values(["doc_id", "dk", "start"])
        for doc, key, start, n, data in zip(batch.doc_id, batch.dk, batch.start, batch.n, batch.data):
            if len(out) >= ROWS:
                yield _rows(out)
            for i in range(n):
                one = data[i : i + WINDOW]
                digest = xxhash.xxh3_128_intdigest(one)
                out.append(((digest >> 64) - (1 << 63), doc, key, start + i, 1, None if digest in seen else one))
                seen.add(digest)
    yield _rows(out)
    settled()


class IndexFamily:
    """Sorted suffixes of WINDOW bytes in levels of geometrically growing size."""

    def __init__(self) -> None:
        self.levels: list[np.ndarray] = []

    def add(self, suffixes: np.ndarray) -> np.ndarray:
        """suffixes: a batch in corpus order. True for those that occurred before."""
        order = np.argsort(suffixes, kind="stable")  # the batch's suffix array
        ranked = suffixes[order]
        again = np.zeros(len(ranked), bool)
        again[1:] = ranked[1:] == ranked[:-1]
        heads = np.flatnonzero(~again)
        new = ranked[heads]
        known = np.zeros(len(new), bool)
        for level in self.levels:  # both are sorted: one scan finds where they meet
            at = np.minimum(np.searchsorted(level, new), len(level) - 1)
            known |= level[at] == new
        again[heads] = known
        if not known.all():
            self.levels.append(new[~known])
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            merged = np.concatenate([self.levels.pop(), self.levels.pop()])
            merged.sort(kind="stable")
            self.levels.append(merged)
        out = np.empty(len(again), bool)
        out[order] = again
        return out


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One task's pieces, in corpus order, against its index family: runs of repeated suffixes."""
    family = IndexFamily()
    for batch in batches:
        if not len(batch):
            continue
        n = batch.n.to_numpy(np.int64)
        size = np.array([len(d) for d in batch.data], np.int64)
        data = np.frombuffer(b"".join(batch.data), np.uint8)
        row = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = (np.cumsum(size) - size)[row] + step
        suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, WINDOW)[at]).view(f"V{WINDOW}").ravel()
        again = family.add(_sortable(suffixes))
        row, step = row[again], step[again]
        head = np.ones(len(row), bool)
        head[1:] = (row[1:] != row[:-1]) | (step[1:] != step[:-1] + 1)
        first = np.flatnonzero(head)
        owner = row[first]
        yield pd.DataFrame({"doc_id": batch.doc_id.to_numpy()[owner], "dk": batch.dk.to_numpy()[owner], "start": batch.start.to_numpy()[owner] + step[first], "n": np.diff(np.append(first, len(row)))})
    family.levels.clear()
    settled()


def _sortable(suffixes: np.ndarray) -> np.ndarray:
    """As byte strings: all have the full length, so zero bytes compare as they should."""
    return suffixes.view(f"S{WINDOW}")


def _merged(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [a, b) of bytes that the repeated suffixes cover."""
    order = np.argsort(starts, kind="stable")
    a, b = starts[order], np.maximum.accumulate((starts + counts - 1 + WINDOW)[order])
    head = np.ones(len(a), bool)
    head[1:] = a[1:] > b[:-1]
    first = np.flatnonzero(head)
    return a[first], b[np.append(first[1:], len(a)) - 1]


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("dk"), text.alias("text"))


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, dk, start, n): n suffixes from byte start on that occurred before, for a table
    (doc_id, dk, text) as keyed() gives."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.where("doc_id is not null")
    again = written(docs.groupBy("doc_id", "dk").count().where("count > 1").select("doc_id", "dk"), "again")
    if not again.isEmpty():  # one row of each document, else its rows would repeat each other
        once = docs.join(again, ["doc_id", "dk"], "left_semi").groupBy("doc_id", "dk").agg(F.first("text").alias("text"))
        docs = docs.join(again, ["doc_id", "dk"], "left_anti").union(once)
    chunks = written(docs.where(F.octet_length("text") >= WINDOW).mapInArrow(_chunks, CHUNKS), "chunks")
    place = ["doc_id", "dk", "start"]
    earliest = written(chunks.groupBy("h1", "h2").agg(F.min(F.struct(*place)).alias("at")).select("h1", "h2", "at.*"), "earliest")
    later = written(chunks.select("h1", "h2", *place, "n").join(earliest, ["h1", "h2", *place], "left_anti").select(*place, "n"), "later")
    pairs = F.explode(F.arrays_zip("anchors", "spots")).alias("p")
    anchors = chunks.join(earliest, ["h1", "h2", *place], "left_semi").select("doc_id", "dk", pairs).select(F.col("p.anchors").alias("anchor"), "doc_id", "dk", F.col("p.spots").alias("spot"))
    anchors = written(anchors, "anchors")
    removed(spark, chunks, earliest)
    where = F.xxhash64("doc_id", "dk", "spot")
    shared = written(anchors.groupBy("anchor").agg(F.min(where).alias("a"), F.max(where).alias("b")).where("a <> b").select("anchor"), "shared")
    spots = written(anchors.join(shared, "anchor", "left_semi").groupBy("doc_id").agg(F.collect_list("spot").alias("spots")), "spots")
    removed(spark, anchors, shared)
    pieces = written(docs.join(spots, "doc_id").mapInPandas(_pieces, PIECES), "pieces")
    removed(spark, spots)
    known, open_ = pieces.where("data is null").select(*place, "n"), pieces.where("data is not null")
    hot = written(open_.groupBy("core").count().where(F.col("count") > HOT).select("core"), "hot")
    if not hot.isEmpty():
        single = written(open_.join(hot, "core", "left_semi").select(*pieces.columns).mapInPandas(_singly, PIECES), "single")
        known = known.union(single.where("data is null").select(*place, "n"))
        open_ = open_.join(hot, "core", "left_anti").select(*pieces.columns).union(single.where("data is not null"))
    tasks = max(width(spark), -(-open_.count() // PIECES_PER_TASK))
    found = open_.repartition(tasks, "core").sortWithinPartitions(*place).drop("core").mapInPandas(_scan, "doc_id long, dk long, start int, n int")
    found = written(found, "found")
    swept(spark)
    return later.union(known).union(found)


def _spans(docs: DataFrame) -> DataFrame:
    runs = repeated_runs(docs)
    lists = runs.groupBy("doc_id", "dk").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("counts"))
    return written(lists, "spans")


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and starts and ends of the
    removed byte runs."""

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text, starts, counts in zip(batch.doc_id, batch.text, batch.starts, batch.counts):
                raw = text.encode()
                a, b = runs_of(starts, counts)
                sha = hashlib.sha256(kept(raw, a, b)).hexdigest()
                out.append((doc, len(raw), int((b - a).sum()), len(a), sha, a.tolist(), b.tolist()))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends"]).astype({"doc_id": "Int64", "kept_sha256": object})

    docs = keyed(docs, id_col, text_col)
    both = docs.join(_spans(docs), ["doc_id", "dk"], "left").select("doc_id", "text", "starts", "counts")
    return both.mapInPandas(digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<int>, ends array<int>")


def runs_of(starts, counts) -> tuple[np.ndarray, np.ndarray]:
    if starts is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _merged(np.asarray(starts, np.int64), np.asarray(counts, np.int64))


def kept(raw: bytes, a: np.ndarray, b: np.ndarray) -> bytes:
    return b"".join(raw[s:e] for s, e in zip([0, *b.tolist()], [*a.tolist(), len(raw)]))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated strings cut out of text (and n_chars, if there, counted anew).
    A cut inside a character drops its other bytes too. Rows of which nothing but white space is
    left go; untouched rows stay as they are."""
    narrow = keyed(docs)
    spans = _spans(narrow).select(F.col("doc_id").alias("_id"), F.col("dk").alias("_dk"), F.col("starts").alias("_starts"), F.col("counts").alias("_counts"))

    @F.pandas_udf("string")
    def rest(texts: pd.Series, starts: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([kept(t.encode(), *runs_of(s, c)).decode("utf-8", "ignore") for t, s, c in zip(texts, starts, counts)])

    text = F.coalesce(docs["text"], F.lit(""))
    same = (docs["doc_id"].cast("long") == spans["_id"]) & (F.xxhash64(text) == spans["_dk"])
    left = F.when(spans["_starts"].isNotNull(), rest(text, spans["_starts"], spans["_counts"])).alias("__rest")
    both = docs.join(spans, same, "left").select(*(docs[c] for c in docs.columns), left)
    both = both.where(F.col("__rest").isNull() | (F.trim(F.col("__rest"), F.lit(" \t\r\n")) != ""))
    columns = {"text": F.coalesce("__rest", "text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("__rest").isNotNull(), F.char_length("__rest").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return both.withColumns(columns).select(*docs.columns)
