"""Correlations of all pairs of codes by products of matrix blocks.

Codes are cut into blocks of CODES in order (of a part, where pairs are wanted within parts only); a
block is a dense code x date matrix of the whole calendar. Two blocks meet once, in one task, which
has all that their pairs need: counts, sums, squares and cross products of the dates that both codes
have. What is shuffled is blocks, each as often as there are blocks; no row stands for a date and a
pair, and of a pair of blocks only the pairs asked for leave the task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.sources.folders import scratch

CODES, DATES = 4096, 256
#: Codes of the left block whose products are held at once; they are added up by DATES dates.
STRIP = 256

_CELL = "part string, block int, codes array<long>, cells binary"
_PAIR = "code long, peer long, n long, corr double"


def _cells(days: int) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        """One dense block: NaN where a code has no value on a date."""
        code, at, x = (rows.column(c).to_numpy() for c in ("code", "at", "x"))
        codes, i = np.unique(code, return_inverse=True)
        dense = np.full((len(codes), days), np.nan)
        dense[i, at] = x
        return pa.table({"part": rows.column("part").slice(0, 1), "block": pa.array([rows.column("block")[0].as_py()], pa.int32()), "codes": pa.array([codes], pa.list_(pa.int64())), "cells": [dense.tobytes()]})

    return run


def _strips(codes: list[np.ndarray], cells: list[bytes], days: int, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first, n, corr) for STRIP codes of the left block against all of the right one; corr is NaN
    below least common dates, infinite where a side has no spread."""
    a, b = (np.frombuffer(c).reshape(len(k), days) for k, c in zip(codes, cells))
    kb = ~np.isnan(b)
    b, fb = np.where(kb, b, 0.0), kb.astype(float)
    for at in range(0, len(a), STRIP):
        ka = ~np.isnan(a[at : at + STRIP])
        x, fa = np.where(ka, a[at : at + STRIP], 0.0), ka.astype(float)
        sums = np.zeros((6, len(x), len(b)))
        for d in range(0, days, DATES):
            p, fp, q, fq = (m[:, d : d + DATES] for m in (x, fa, b, fb))
            for total, (left, right) in zip(sums, ((fp, fq), (p, fq), (fp, q), (p * p, fq), (fp, q * q), (p, q))):
                total += left @ right.T
        n, sx, sy, sxx, syy, sxy = sums
        with np.errstate(all="ignore"):
            vx, vy = sxx - sx * sx / n, syy - sy * sy / n
            corr = np.clip((sxy - sx * sy / n) / np.sqrt(vx * vy), -1, 1)
            corr[(vx <= 1e-13 * sxx) | (vy <= 1e-13 * syy)] = np.inf
        corr[n < least] = np.nan
        yield at, n, corr


def _pairs(days: int, least: int, best: int | None, flat: bool) -> Callable:
    def rows(code: np.ndarray, peer: np.ndarray, n: np.ndarray, corr: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(code), 1 << 16):
            c, p, m, r = (x[k : k + (1 << 16)] for x in (code, peer, n, corr))
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(p), pa.array(m.astype(np.int64)), pa.array(r, mask=np.isinf(r))], ["code", "peer", "n", "corr"])

    def highest(own: np.ndarray, other: np.ndarray, n: np.ndarray, corr: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of each row its best positive ones: by correlation to nine digits, then by code."""
        r = np.where(np.isfinite(corr) & (corr > 0) & (own[:, None] != other[None, :]), np.round(corr, 9), -1.0)
        cut = np.partition(r, max(0, r.shape[1] - best), axis=1)[:, max(0, r.shape[1] - best)]
        i, j = np.nonzero((r >= cut[:, None]) & (r >= 0))
        order = np.lexsort((other[j], -r[i, j], i))
        i, j = i[order], j[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        i, j = i[nth < best], j[nth < best]
        yield from rows(own[i], other[j], n[i, j], corr[i, j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                codes = [batch.column(f"codes_{s}")[k].values.to_numpy() for s in ("left", "right")]
                cells = [batch.column(f"cells_{s}")[k].as_py() for s in ("left", "right")]
                one, two = codes
                if best is None:
                    for at, n, corr in _strips(codes, cells, days, least):
                        own = one[at : at + STRIP]
                        i, j = np.nonzero((~np.isnan(corr) if flat else np.isfinite(corr)) & (own[:, None] < two[None, :]))
                        yield from rows(own[i], two[j], n[i, j], corr[i, j])
                    continue
                turns = (0, 1) if batch.column("left")[k].as_py() != batch.column("right")[k].as_py() else (0,)
                for turn in turns:  # each side against the other
                    mine, theirs = codes[turn], codes[1 - turn]
                    for at, n, corr in _strips([mine, theirs], [cells[turn], cells[1 - turn]], days, least):
                        yield from highest(mine[at : at + STRIP], theirs, n, corr)

    return run


def _met(rows: DataFrame, least: int, best: int | None = None, flat: bool = False) -> DataFrame:
    rows = rows.withColumn("part", F.col("part").cast("string") if "part" in rows.columns else F.lit(""))
    codes = rows.where("part IS NOT NULL").groupBy("part", "code").agg(F.avg("x").alias("_mean"))
    # numbers of codes by ranges, so that blocks hold CODES codes whatever the ids are
    codes = _numbered(codes, ["part", "code"], "_c")
    dates = _numbered(rows.select("date").distinct(), ["date"], "_d")
    days = dates.count()
    placed = rows.join(codes, ["part", "code"]).join(F.broadcast(dates), "date")
    cell = placed.select("part", (F.col("_c") / CODES).cast("int").alias("block"), "code", F.col("_d").alias("at"), (F.col("x") - F.col("_mean")).alias("x"))
    path = scratch(rows.sparkSession, "blocks")
    cell.groupBy("part", "block").applyInArrow(_cells(days), _CELL).write.parquet(path)
    blocks = rows.sparkSession.read.parquet(path)
    # blocks of a part have numbers in a row, so a pair of blocks is two numbers
    own = blocks.select("part", "block")
    pairs = own.withColumnRenamed("block", "left").join(own.withColumnRenamed("block", "right"), "part").where("left <= right")
    side = lambda s: blocks.select("part", F.col("block").alias(s), F.col("codes").alias(f"codes_{s}"), F.col("cells").alias(f"cells_{s}"))
    both = pairs.join(side("left"), ["part", "left"]).join(side("right"), ["part", "right"])
    return both.select("left", "right", "codes_left", "codes_right", "cells_left", "cells_right").repartition("left", "right").mapInArrow(_pairs(days, least, best, flat), _PAIR)


def correlations(rows: DataFrame, least: int = 24, flat: bool = False) -> DataFrame:
    """(code, peer, n, corr) for code < peer: the correlation over their n common dates, of pairs with
    least of them, of one part where rows have a part, and spread on both sides (flat: null else). rows are
    (code, date, x) with known, distinct (code, date); values are centred by date-free means in
    double precision."""
    return _met(rows, least, flat=flat)


def best_peers(rows: DataFrame, best: int, least: int = 24) -> DataFrame:
    """(code, peer, n, corr, rank): of each code its best positive correlations, by their nine digits,
    then by code. A pair of blocks hands on best of each code, so no more leave the tasks."""
    place = F.row_number().over(Window.partitionBy("code").orderBy(F.desc(F.round("corr", 9)), "peer"))
    return _met(rows, least, best).withColumn("rank", place).where(F.col("rank") <= best)


def _numbered(keys: DataFrame, by: list[str], name: str) -> DataFrame:
    """keys with their place in order, from 0: places within ranges, and counts of the ranges before.
    Ranges are written once, as a later run could cut them otherwise."""
    path = scratch(keys.sparkSession, "ranges")
    keys.repartitionByRange(*by).withColumn("_p", F.spark_partition_id()).write.parquet(path)
    ranged = keys.sparkSession.read.parquet(path)
    placed = ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*by)) - 1)
    before = ranged.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n"))  # a row a range
    return placed.join(F.broadcast(before.drop("_n")), "_p").withColumn(name, (F.col("_i") + F.col("_before")).cast("int")).drop("_p", "_i", "_before")
