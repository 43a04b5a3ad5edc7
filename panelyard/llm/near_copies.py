"""Near copies by similarity: texts whose sets of five-word shingles have a Jaccard of 0.8 or more.

Candidates are the links that pigeonring chains find between SimHash fingerprints (simhash.py) and,
as those are too few at 0.8, texts that share a band; an exact check of the shingle sets follows.

A 64-bit SimHash can't tell such pairs apart at scale: at 0.8 they lie 10 bits apart on average and
up to 19, and no chain of segments within such a budget is selective. Here a text has a MinHash
signature of BANDS * ROWS values, and texts that share all ROWS values of a band are candidates: at
a Jaccard of 0.8 a pair is missed with a chance of (1 - 0.8 ** ROWS) ** BANDS = 7e-5, less above.
Each candidate pair is then checked on its exact shingle sets (first by its signatures, at ROUGH,
which lies over five standard deviations below 0.8).

Hot bands: the texts of a key of more than HEAVY are first paired with its smallest node alone.
What these pairs and those of light keys link is one class already, and pairs within a class need no
check; a key whose texts are all of one class is done. Of the other heavy keys all pairs of different
classes are compared on their exact shingle sets, in blocks of texts and in the first band that both
share; only links are written. Memory is that of two blocks; a large group that stays in many classes
costs the square of its size in comparisons. Equal texts are one node from the start. Links are joined
into classes as those of SimHash are.

Rows: null and word-less texts are one class. Repeated rows and ids give a row each. Rows with a
null id stay only if no row of their class has an id. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.llm.runtime import bounded_batches, removed, settled, written
from panelyard.llm.simhash import SEED, WORD, components, fingerprint, links

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 24, 5
ROUGH = 0.6
HEAVY = 32
BLOCK = 1 << 10
#: Texts and shingles of a block, about.
BLOCK_TEXTS, BLOCK_SHINGLES = 1 << 10, 1 << 20

_RANDOM = np.random.default_rng(20250611)
_TURN = _RANDOM.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64)
_TIMES = _RANDOM.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _RANDOM.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's runs of size words (a shorter text is one run)."""
    words = WORD.findall(text.encode().lower())
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[a:b], SEED) for a, b in spans), np.uint64, len(words) - size + 1))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value of the hashes in each of BANDS * ROWS orders."""
    out = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), BLOCK):
        out = np.minimum(out, ((hashes[i : i + BLOCK] ^ _TURN) * _TIMES).min(axis=1))
    return (out >> np.uint64(32)).astype(np.uint32)


def band_keys(values: np.ndarray) -> np.ndarray:
    """A key for each band, different between bands."""
    key = (values.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    key ^= key >> np.uint64(31)
    key *= np.uint64(0xD6E8FEB86659FD93)
    return (key ^ (key >> np.uint64(29))).view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _node(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _paired(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Pairs of nodes with equal keys where at most HEAVY have them, and the keys of more with their
    smallest and largest node."""
    groups = written(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("node").alias("a"), F.max("node").alias("b")).where("n > 1"), "bands")
    some = rows.join(groups.where((F.col("n") > 2) & (F.col("n") <= HEAVY)).select(*keys), keys)
    side = lambda x: some.withColumnRenamed("node", x)
    pairs = side("a").join(side("b"), keys).where("a < b").select("a", "b")
    return groups.where("n = 2").select("a", "b").union(pairs), groups.where(F.col("n") > HEAVY).select(*keys, "a", "b")


def _texts(docs: DataFrame, nodes: DataFrame, text_col: str) -> DataFrame:
    """(node, text) of the nodes."""
    texts = docs.select(_node(text_col).alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(nodes, "node", "left_semi")
    return texts.groupBy("node").agg(F.first("text").alias("text"))


def verified(docs: DataFrame, signed: DataFrame, pairs: DataFrame, text_col: str) -> DataFrame:
    """The pairs (a, b) whose exact similarity is SIMILAR or more."""

    @F.pandas_udf("double")
    def alike(left: pd.Series, right: pd.Series) -> pd.Series:
        one, two = (np.frombuffer(b"".join(s), np.uint8).reshape(-1, BANDS * ROWS) for s in (left, right))
        return pd.Series((one == two).mean(axis=1))

    @F.pandas_udf("double")
    def exact(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            yield pd.Series([jaccard(shingles(a), shingles(b)) for a, b in zip(left, right)], dtype=float)
        settled()

    own = signed.select("node", "signature")
    of = lambda table, value, node: table.select(F.col("node").alias(node), F.col(value).alias(f"{value}_{node}"))
    rough = pairs.join(of(own, "signature", "a"), "a").join(of(own, "signature", "b"), "b")
    rough = written(rough.where(alike("signature_a", "signature_b") >= ROUGH).select("a", "b"), "rough")
    wanted = written(rough.select(F.col("a").alias("node")).union(rough.select("b")).distinct(), "wanted")
    texts = written(_texts(docs, wanted, text_col), "texts")
    told = rough.join(of(texts, "text", "a"), "a").join(of(texts, "text", "b"), "b")
    found = written(told.where(exact("text_a", "text_b") >= SIMILAR).select("a", "b"), "similar")
    removed(docs.sparkSession, rough, wanted, texts)
    return found


def similar(docs: DataFrame, signed: DataFrame, text_col: str, close: DataFrame) -> DataFrame:
    """Links (a, b) between nodes whose fingerprints are close or that share a band, for a table
    (node, signature, keys)."""
    rows = signed.select("node", F.explode("keys").alias("key"))
    pairs, heavy = _paired(rows, ["key"])
    pairs = pairs.union(close.select(F.least("a", "b"), F.greatest("a", "b")))
    if heavy.isEmpty():
        return verified(docs, signed, written(pairs.distinct(), "pairs"), text_col)
    hot = written(rows.join(heavy.select("key", "a"), "key"), "hot")
    stars = hot.where("node <> a").select("a", F.col("node").alias("b"))
    linked = verified(docs, signed, written(pairs.union(stars).distinct(), "pairs"), text_col)
    roots = written(components(linked), "roots")
    named = hot.select("key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = written(named.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("key"), "open")
    return linked if open_.isEmpty() else linked.union(between(docs, signed, written(named.join(open_, "key", "left_semi"), "apart"), text_col))


def _links_between(rows: pa.Table) -> pa.Table:
    """Links that join different roots among the texts of a key, of one part or between two."""
    rows = rows.sort_by("part").combine_chunks()
    node, part, root = (rows.column(c).to_numpy() for c in ("node", "part", "root"))
    root = np.unique(root, return_inverse=True)[1]
    keys = pa.concat_arrays(rows.column("keys").chunks).flatten().to_numpy().reshape(-1, BANDS)
    band = np.flatnonzero(keys[0] == rows.column("key")[0].as_py())[0]
    sets = [np.frombuffer(s, np.uint64) for s in rows.column("shingles").to_pylist()]
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    start, ids = np.cumsum(size) - size, np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    inside, found = np.zeros(ids.max() + 1, bool), []
    one, n = part[0] == part[-1], len(node)
    second = 0 if one else np.searchsorted(part, part[-1])
    crossed = rows.column("lo")[0].as_py() != rows.column("hi")[0].as_py()
    for x in range(0 if one and crossed else n if one else second):
        y = slice(x + 1 if one else second, n)
        apart = (root[y] != root[x]) & (np.minimum(size[y], size[x]) / np.maximum(size[y], size[x]) >= SIMILAR)
        apart &= ~(keys[y, :band] == keys[x, :band]).any(axis=1)  # those meet in an earlier band
        if not apart.any():
            continue
        own = ids[start[x] : start[x] + size[x]]
        inside[own] = True
        both = np.add.reduceat(inside[ids[start[y][0] :]], start[y] - start[y][0], dtype=np.int64)
        inside[own] = False
        for k in np.flatnonzero(apart & (both / (size[y] + size[x] - both) >= SIMILAR)) + y.start:
            if root[k] != root[x]:
                found.append((node[x], node[k]))
                root[root == root[k]] = root[x]
    if rows.nbytes > 1 << 22:
        settled()
    a, b = zip(*found) if found else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def between(docs: DataFrame, signed: DataFrame, apart: DataFrame, text_col: str) -> DataFrame:
    """Links (a, b) at SIMILAR or more that join different roots within a key, for a table (key, node,
    root): a key's texts are dealt to parts of about a block, and every two parts meet."""

    @F.pandas_udf("binary")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingles(t).tobytes() for t in texts], dtype=object)
        settled()

    texts = _texts(docs, apart.select("node"), text_col).select("node", hashed("text").alias("shingles"))
    sets = written(texts.join(signed.select("node", "keys"), "node"), "sets")
    sized = apart.join(sets.select("node", (F.length("shingles") / 8).alias("size")), "node").groupBy("key")
    parts = sized.agg(F.ceil(F.greatest(F.count("*") / BLOCK_TEXTS, F.sum("size") / BLOCK_SHINGLES)).alias("parts"))
    dealt = apart.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("node"), "parts"))
    dealt = dealt.select("key", "node", "root", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "node", "root")
    return written(dealt.join(sets, "node").groupBy("key", "lo", "hi").applyInArrow(_links_between, "a long, b long"), "between")


def fingerprint_links(signed: DataFrame) -> DataFrame:
    """Links (a, b) between nodes whose fingerprints pigeonring chains find at BITS bits or fewer;
    nodes of one fingerprint are linked to the smallest of them."""
    ones = written(signed.groupBy("fp").agg(F.min("node").alias("a")), "ones")
    same = signed.select("fp", F.col("node").alias("b")).join(ones.hint("merge"), "fp").where("a <> b").select("a", "b")
    near = links(ones.select("fp"))
    of = lambda x: ones.select(F.col("fp").alias(x), F.col("a").alias(f"node_{x}"))
    both = near.join(of("a"), "a").join(of("b"), "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    return same.union(both)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, component_id) for each distinct text: the smallest id that is reachable over pairs at
    SIMILAR or more; node is the hash of the text."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("signature binary, keys array<long>, fp long")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            values = [signature(shingles(t)) for t in texts]
            # a byte of each value is enough to tell unlike signatures
            yield pd.DataFrame({"signature": [v.astype(np.uint8).tobytes() for v in values], "keys": [band_keys(v) for v in values], "fp": np.array([fingerprint(t.encode()) for t in texts], np.uint64).view(np.int64)})
        settled()

    own = docs.select(F.col(id_col).alias("id"), _node(text_col).alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    one = own.groupBy("node").agg(F.min("id").alias("first"), F.first("text").alias("text"))
    signed = written(one.select("node", "first", sign("text").alias("s")).select("node", "first", "s.*"), "signed")
    roots = components(similar(docs, signed, text_col, written(fingerprint_links(signed), "close")))
    of = signed.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = of.groupBy("root").agg(F.min("first").alias("component_id"))
    return of.join(least, "root").select("node", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without near copies of another: of each class the row with the smallest
    doc_id stays (of repeated rows with that id and class all)."""
    rows = docs.select("doc_id", _node("text").alias("_node")).groupBy("_node").agg(F.min("doc_id").alias("_least"), F.max("doc_id").alias("_most"), F.count("*").alias("_rows"), F.count("doc_id").alias("_ids"))
    named = rows.join(classes(docs).withColumnRenamed("node", "_node"), "_node")
    # texts of one id whose class has no smaller one stay as they are, and the documents need not be dealt for them
    alone = F.col("_least").eqNullSafe(F.col("component_id")) & F.col("_least").eqNullSafe(F.col("_most")) & ((F.col("_rows") == F.col("_ids")) | (F.col("_ids") == 0))
    shared = written(named.where(~alone).select("_node", F.lit(True).alias("_shared"), F.col("component_id").alias("_keep")), "shared")
    both = docs.join(shared, F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == shared["_node"], "left")
    return both.where(shared["_shared"].isNull() | docs["doc_id"].eqNullSafe(shared["_keep"])).select(*(docs[c] for c in docs.columns))
