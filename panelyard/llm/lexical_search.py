"""Ranked lexical search: presence masks over blocks of documents.

Items are searched in groups with at most BLOCK_TERMS distinct terms, so that what travels to the
tasks is bounded. One pass over the documents keeps, for each, its number of terms and the counts
of the group's terms (its postings), as a written table; N, L and document frequencies are sums of
that table. In the second pass a task takes blocks of at most BLOCK_ROWS documents. For each item,
every term's bitmap sets its bit in the masks of the documents that hold it; documents of equal
masks are a group, and a mask's largest possible score is the sum of its terms' largest values in
the block. Masks are evaluated by falling bound until the next bound is below the TOP-th score
that the task has for the item, so no later document can enter; equal bounds are still evaluated.
A task passes on at most TOP rows an item; these meet in two steps, dealt by item and a salt first.

Terms are runs of letters, digits and non-ASCII characters, A-Z lower-cased. All of a score but the
weights' logarithm is 64-bit integer arithmetic.

Rows: a null text has no terms. Repeated documents are ranked each. Null ids come after all others
of equal score. Each benchmark row is an item of its own, repeated ids or not; items without terms
have no result. Other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.llm.runtime import bounded_batches, settled, written

TOP = 20
BLOCK_TERMS = 1 << 18
BLOCK_ROWS = 1 << 14
BLOCK_POSTINGS = 1 << 21
SALT = 64
#: Documents that are evaluated at once, at least.
AT_ONCE = 256
#: Bytes that stand in terms keep their value, but for capitals; all others part terms.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

Items = list[tuple[int, np.ndarray, np.ndarray]]


def terms(text: bytes) -> list[bytes]:
    """The terms of UTF-8 text in order."""
    return text.translate(_BYTES).split()


def _postings(number: dict[bytes, int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = number.get
        for batch in batches:
            lengths, ends, found, times = [], [0], [], []
            for text in batch.column("text"):
                got = terms(text.as_py() or b"")
                lengths.append(len(got))
                for term, tf in Counter(map(get, got)).items():
                    if term is not None:
                        found.append(term)
                        times.append(tf)
                ends.append(len(found))
            ends = pa.array(np.array(ends, np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.array(x, np.int32))) for x in (found, times)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])
        settled()

    return run


class _Block:
    """Postings of some documents, by document and by term; value is weight * saturated frequency."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, ends: np.ndarray, found: np.ndarray, tfs: np.ndarray, weights: np.ndarray, total: tuple[int, int]):
        docs, length = total
        m = 75 + (25 * n * docs) // max(length, 1)
        self.ids, self.starts, self.ends, self.terms = ids, np.concatenate([[0], ends[:-1]]), ends, found
        rows = np.repeat(np.arange(len(ids)), ends - self.starts)
        self.values = weights[found] * ((1_000_000_000 * tfs) // (1000 * tfs + 12 * m[rows]))
        order = np.argsort(found, kind="stable")
        self.rows = rows[order]
        self.own, first = np.unique(found[order], return_index=True)
        self.cuts = np.append(first, len(order))
        self.most = np.maximum.reduceat(self.values[order], first) if len(first) else np.zeros(0, np.int64)

    def masks(self, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, words): the documents that hold a term, their masks as rows of 64-bit words, and
        each of the item's terms' largest values."""
        words = np.zeros((len(self.ids), -(-len(item) // 64)), np.uint64)
        most = np.zeros(len(item), np.int64)
        at = np.searchsorted(self.own, item)
        for j, (term, k) in enumerate(zip(item.tolist(), at.tolist())):
            if k < len(self.own) and self.own[k] == term:
                words[self.rows[self.cuts[k] : self.cuts[k + 1]], j >> 6] |= np.uint64(1 << (j & 63))
                most[j] = self.most[k]
        rows = np.flatnonzero(words.any(axis=1))
        return rows, words[rows], most

    def scores(self, rows: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Exact scores of documents; times has how often the item holds each term."""
        size = self.ends[rows] - self.starts[rows]
        at = np.repeat(self.starts[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())
        part = np.concatenate([[0], np.cumsum(times[self.terms[at]] * self.values[at])])
        end = np.cumsum(size)
        return part[end] - part[end - size]


def _best(ids: np.ndarray, known: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Places of the TOP best: by score, then id, null ids last."""
    return np.lexsort((ids, ~known, -scores))[:TOP]


def _ranked(items: Items, weights: np.ndarray, total: tuple[int, int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {k: (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for k, _, _ in items}
        times = np.zeros(len(weights), np.int64)

        def search(block: _Block, known: np.ndarray) -> None:
            for k, item, often in items:
                rows, words, most = block.masks(item)
                if not len(rows):
                    continue
                masks, of = np.unique(words, axis=0, return_inverse=True)
                bits = np.unpackbits(masks.astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, : len(item)]
                bounds = bits.astype(np.int64) @ (most * often)
                order = np.argsort(-bounds, kind="stable")
                members = np.argsort(of.reshape(-1), kind="stable")
                size = np.bincount(of.reshape(-1), minlength=len(masks))
                start = np.cumsum(size) - size
                times[item] = often
                ids, real, scores = best[k]
                at = 0
                while at < len(order):
                    least = scores[TOP - 1] if len(scores) >= TOP else 1
                    if bounds[order[at]] < least:
                        break
                    end = at + 1
                    taken = int(size[order[at]])
                    while end < len(order) and taken < AT_ONCE and bounds[order[end]] >= least:
                        taken += int(size[order[end]])
                        end += 1
                    chosen = rows[np.concatenate([members[start[g] : start[g] + size[g]] for g in order[at:end]])]
                    got = block.scores(chosen, times)
                    good = got > 0
                    ids, real, scores = np.concatenate([ids, block.ids[chosen[good]]]), np.concatenate([real, known[chosen[good]]]), np.concatenate([scores, got[good]])
                    top = _best(ids, real, scores)
                    ids, real, scores = ids[top], real[top], scores[top]
                    at = end
                best[k] = ids, real, scores
                times[item] = 0

        for ids, known, *postings in _blocks(batches):
            search(_Block(ids, *postings, weights, total), known)
        for k, (ids, real, scores) in best.items():
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), k, np.int64)), pa.array(ids, mask=~real), pa.array(scores)], ["item", "doc_id", "score"])
        settled()

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, known, n, ends, terms, tfs) of at most BLOCK_ROWS documents, or BLOCK_POSTINGS postings and a batch's."""
    kept: list[pa.RecordBatch] = []

    def block() -> tuple[np.ndarray, ...]:
        table = pa.Table.from_batches(kept)
        lists = table.column("terms").combine_chunks(), table.column("tfs").combine_chunks()
        ends = np.cumsum(lists[0].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        found, tfs = (x.flatten().to_numpy().astype(np.int64) for x in lists)
        doc = table.column("doc_id").combine_chunks()
        return doc.fill_null(0).to_numpy(), doc.is_valid().to_numpy(zero_copy_only=False), table.column("n").to_numpy(), ends, found, tfs

    rows = postings = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        rows, postings = rows + batch.num_rows, postings + len(batch.column("terms").flatten())
        if rows >= BLOCK_ROWS or postings >= BLOCK_POSTINGS:
            yield block()
            kept, rows, postings = [], 0, 0
    if kept:
        yield block()


def _item_groups(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """Benchmark rows (number, item_id, terms) in groups of at most BLOCK_TERMS distinct terms (one
    larger item is a group of its own); rows are fetched a partition at a time."""
    group, seen = [], set()
    for number, row in enumerate(benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("binary").alias("text")).toLocalIterator()):
        counted = Counter(terms(bytes(row["text"] or b"")))
        if group and len(seen | counted.keys()) > BLOCK_TERMS:
            yield group
            group, seen = [], set()
        seen |= counted.keys()
        group.append((number, row["item_id"], counted))
    if group:
        yield group


def ranked_search(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's TOP highest-scoring documents with a score above
    0, from rank 1; equal scores by rising doc_id."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = benchmark.schema[item_col].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for group in _item_groups(benchmark, item_col, query_col):
        number = {t: i for i, t in enumerate(dict.fromkeys(t for _, _, counted in group for t in counted))}
        if not number:
            continue
        posted = written(rows.mapInArrow(_postings(number), "doc_id long, n long, terms array<int>, tfs array<int>"), "postings")
        total = tuple(int(x or 0) for x in posted.agg(F.count_if(F.col("n") > 0), F.sum("n")).first())
        df = np.zeros(len(number), np.int64)
        for term, n in posted.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():  # of the group's terms only
            df[term] = n
        weights = np.floor(1000 * np.log((2 * total[0] + 2) / (2 * df + 1))).astype(np.int64)
        items = [(k, np.array([number[t] for t in counted], np.int64), np.array(list(counted.values()), np.int64)) for k, _, counted in group if counted]
        candidates = posted.where(F.size("terms") > 0).mapInArrow(_ranked(items, weights, total), "item long, doc_id long, score long")
        place = [F.desc("score"), F.asc_nulls_last("doc_id")]
        some = candidates.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALT)))
        some = some.withColumn("r", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*place))).where(F.col("r") <= TOP)
        final = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*place))).where(F.col("rank") <= TOP)
        names = F.broadcast(spark.createDataFrame([(k, item_id) for k, item_id, _ in group], f"item long, item_id {kind}"))  # as many as the group has
        out = out.unionByName(written(final.join(names, "item").select("item_id", "rank", "doc_id", "score"), "ranks"))
    return out


SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
items AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM benchmark),
qt AS (SELECT q, item_id, term, count(*) AS often FROM (SELECT q, item_id, unnest(ts) AS term FROM items) GROUP BY ALL),
total AS (SELECT count(*) FILTER (len(ts) > 0) AS N, CAST(sum(len(ts)) AS BIGINT) AS L FROM docs),
tf AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(ts) AS term FROM docs) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * N + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, total GROUP BY term, N),
v AS (SELECT d, doc_id, tf.term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(ts) * N) // L))) AS v FROM tf JOIN w USING (term) JOIN docs USING (d), total),
s AS (SELECT q, item_id, d, doc_id, CAST(sum(often * v) AS BIGINT) AS score FROM qt JOIN v USING (term) GROUP BY ALL HAVING sum(often * v) > 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank FROM s)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""
