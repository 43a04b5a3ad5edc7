"""SimHash near-duplicates: pigeonring candidates, full Hamming check, connected classes.

A fingerprint is cut into four segments of 16 bits that form a ring. If two fingerprints differ
in at most three bits, some segment starts a chain whose cumulative differences stay within the
proportional budget l * 3 / 4 for every length l: 0 in the first segment, at most 1 in two, 2 in
three, 3 in all four. A join key is therefore a start, its first segment exactly, and the second
within one bit (one side gives the 17 variants); the rest of the chain prunes before the full
check. Keys that hold more than HEAVY fingerprints are extended by a third segment within the
budget of two, so no key ever pairs a large group with itself.

Equal fingerprints are one class from the start (a partially aggregated group), so copies are
never paired. Links are joined into classes by alternating large-star and small-star rounds over
written tables; nothing is gathered on the driver.

Rows: a null or word-less text has fingerprint zero and links like any other. Repeated rows and
ids give a row each. Rows with a null id keep a null id; a class without any id has a null
component_id. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.llm.runtime import bounded_batches, removed, settled, written

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SEED = 42
SHINGLE = 3
BITS = 3
SEGMENTS, SEGMENT_BITS = 4, 16
HEAVY = 256
ROUNDS = 64
BLOCK = 1 << 15


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Bits that are set in over half of the shingles' hashes."""
    words = WORD.findall(text.lower())  # of bytes: A-Z only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in spans), np.uint64, len(words) - size + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[i : i + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int("".join("1" if n * 2 > len(hashes) else "0" for n in ones), 2)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id and fp, the fingerprint as a signed long."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def simhash(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            got = np.array([fingerprint(t.encode()) for t in texts], np.uint64)
            yield pd.Series(got.view(np.int64))
        settled()

    return docs.select(F.col(id_col).alias("doc_id"), simhash(F.coalesce(F.col(text_col), F.lit(""))).alias("fp"))


def _flips(up_to: int) -> Column:
    """Masks of one segment with at most up_to bits, as a literal array."""
    one = [1 << i for i in range(SEGMENT_BITS)]
    masks = [0, *one] + ([x | y for k, x in enumerate(one) for y in one[k + 1 :]] if up_to > 1 else [])
    return F.array(*(F.lit(m).cast("long") for m in masks))


def _turned(fp: str, start: str) -> str:
    """The ring turned so that segment start is the lowest, in SQL."""
    k = f"cast({SEGMENT_BITS} * {start} AS int)"  # a shift by 64 is one by 0
    return f"(shiftrightunsigned({fp}, {k}) | shiftleft({fp}, 64 - {k}))"


def links(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of different fingerprints of a one-column table fp at BITS bits or fewer."""
    low = (1 << SEGMENT_BITS) - 1
    # a key is the start, the first and the second segment in one number, so that rows are a key and a fingerprint
    turned = F.expr(_turned("fp", "start"))
    key = F.shiftleft("start", 2 * SEGMENT_BITS).bitwiseOR(F.shiftleft(turned.bitwiseAND(low), SEGMENT_BITS)).bitwiseOR(F.shiftrightunsigned(turned, SEGMENT_BITS).bitwiseAND(low))
    rows = distinct.select("fp", F.explode(F.array(*(F.lit(i).cast("long") for i in range(SEGMENTS)))).alias("start")).select("fp", key.alias("key"))
    near = rows.select("fp", "key", F.explode(_flips(1)).alias("e")).withColumn("key", F.col("key").bitwiseXOR(F.col("e")))
    heavy = written(rows.groupBy("key").count().where(F.col("count") > HEAVY).select("key"), "heavy")
    dense = not heavy.isEmpty()
    without = (lambda df: df.join(heavy.hint("merge"), "key", "left_anti")) if dense else (lambda df: df)
    start = f"(key >> {2 * SEGMENT_BITS})"

    def chains(exact: DataFrame, around: DataFrame, keys: list[str]) -> DataFrame:
        a, b = exact.select(*keys, F.col("fp").alias("a")), around.select(*keys, F.col("fp").alias("b"))
        differ = F.expr(_turned("(a ^ b)", start))
        budget = F.bit_count(differ.bitwiseAND((1 << 3 * SEGMENT_BITS) - 1)) <= 2  # the chain of three
        return a.join(b.hint("merge"), keys).where((F.col("a") < F.col("b")) & (F.bit_count(differ) <= BITS) & budget).select("a", "b")

    found = chains(without(rows), without(near), ["key"])
    if dense:
        third = F.shiftrightunsigned(F.expr(_turned("fp", start)), 2 * SEGMENT_BITS).bitwiseAND(low)
        # a variant's start is its key's: e turns bits of the second segment only
        exact = rows.join(heavy.hint("merge"), "key", "left_semi").withColumn("s3", third)
        around = near.join(heavy.hint("merge"), "key", "left_semi").withColumn("f", F.explode(_flips(2))).where(F.bit_count("e") + F.bit_count("f") <= 2)
        found = found.union(chains(exact, around.withColumn("s3", third.bitwiseXOR(F.col("f"))), ["key", "s3"]))
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node it reaches."""
    spark = edges.sparkSession
    now, seen = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"), None
    for _ in range(ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.withColumnRenamed("m", "v"))
        after = written(small.distinct(), "links")
        mark = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        removed(spark, now)
        now = after
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"links did not settle in {ROUNDS} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fp (signed long), fingerprint (16 hex digits) and component_id, the
    smallest id that is reachable over fingerprints at three or fewer differing bits."""
    marked = written(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(links(classes.select("fp")))
    # tables of a row a class are merged: as broadcasts they would pass through the driver
    of = classes.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = of.groupBy("root").agg(F.min("first").alias("component_id"))
    named = written(of.join(least.hint("merge"), "root").select("fp", "component_id"), "named")
    return marked.join(named.hint("merge"), "fp", "left").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without near copies of another: of each class the row with the smallest
    doc_id stays (of repeated rows with that id all, as they are one document)."""
    keep = near_duplicates(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_keep")).distinct()
    return docs.join(keep, F.col("doc_id").eqNullSafe(F.col("_keep")), "left_semi")
