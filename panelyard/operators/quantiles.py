"""Exact quantiles of many groups at once, without any group's values in one place.

Doubles are counted by the leading bits of an order-preserving code: first coarsely, then finer
within the cells that hold a wanted rank, and only the values of these small cells are gathered. Each
pass is map-side counting; the driver sees counts of cells, whose number does not depend on the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Leading bits that the first and the second count go by.
COARSE, FINE = 16, 24

#: From a batch its values by group: pairs of a group's number and an array of doubles; NaN counts as unknown.
Values = Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]]


def _codes(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles; both zeros are one."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _cells(x: np.ndarray, bits: int, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The known values, of the coarse cells within if given, and the cells they are in."""
    x = x[~np.isnan(x)] + 0.0
    code = _codes(x)
    if within is not None:
        wanted = np.zeros(1 << COARSE, bool)
        wanted[within] = True
        inside = wanted[code >> np.uint64(64 - COARSE)]
        x, code = x[inside], code[inside]
    return x, (code >> np.uint64(64 - bits)).astype(np.int64)


def _counts(rows: DataFrame, values: Values, bits: int, within: dict[int, np.ndarray] | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each group its cells, in order, and how many values they hold; within: only in these
    coarse cells."""
    shape = pa.schema([("g", pa.int32()), ("cell", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for g, x in values(batch):
                if within is not None and g not in within:
                    continue
                mine = seen.setdefault(g, [])
                mine.append(np.unique(_cells(x, bits, within and within[g])[1], return_counts=True))
                if len(mine) == 64:
                    seen[g] = [_merged(mine)]
        for g, parts in seen.items():
            cell, n = _merged(parts)
            yield pa.record_batch([pa.array(np.full(len(cell), g, np.int32)), pa.array(cell), pa.array(n)], schema=shape)

    got = rows.mapInArrow(run, "g int, cell long, n long").groupBy("g", "cell").agg(F.sum("n").alias("n")).toPandas().sort_values(["g", "cell"])
    return {g: (part["cell"].to_numpy(), part["n"].to_numpy()) for g, part in got.groupby("g")}


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    cell, place = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return cell, np.bincount(place, np.concatenate([n for _, n in parts]), len(cell)).astype(np.int64)


def _united(counts: dict[int, tuple[np.ndarray, np.ndarray]], groups: list[int]) -> tuple[np.ndarray, np.ndarray]:
    parts = [counts[g] for g in groups if g in counts]
    return _merged(parts) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def exact(rows: DataFrame, values: Values, members: dict[int, list[int]], shares: list[float]) -> dict[int, tuple[int, list[float]]]:
    """For each target, which unites the groups that members names, the number of its known values
    and their quantiles at shares, interpolated between neighbours as percentile() does it. Targets
    without values are absent. rows are read three times."""
    coarse = _counts(rows, values, COARSE)
    total = {t: _united(coarse, groups) for t, groups in members.items()}
    sizes = {t: int(n.sum()) for t, (_, n) in total.items() if len(n)}
    ranks = {t: sorted({r for q in shares for r in (int(np.floor(q * (n - 1))), int(np.ceil(q * (n - 1))))}) for t, n in sizes.items()}

    def place(counts: dict[int, tuple[np.ndarray, np.ndarray]], below: dict[tuple[int, int], int], shift: int) -> dict[tuple[int, int], tuple[int, int]]:
        """For each target and rank its cell, and how many values of the target stand before it;
        below: how many stand before the coarser cell that the rank is in."""
        out = {}
        for t, wanted in ranks.items():
            cells, n = _united(counts, members[t])
            for r in wanted:
                lo, hi = 0, len(cells)
                if shift:
                    lo, hi = np.searchsorted(cells >> shift, [below[t, r][0], below[t, r][0] + 1])
                before = (below[t, r][1] if shift else 0) + np.append(0, np.cumsum(n[lo:hi]))
                i = int(np.searchsorted(before, r, "right")) - 1
                out[t, r] = int(cells[lo + i]), int(before[i])
        return out

    def by_group(at: dict[tuple[int, int], tuple[int, int]]) -> dict[int, np.ndarray]:
        out: dict[int, set[int]] = {}
        for (t, _), (cell, _) in at.items():
            for g in members[t]:
                out.setdefault(g, set()).add(cell)
        return {g: np.array(sorted(cells), np.int64) for g, cells in out.items()}

    first = place(coarse, {}, 0)
    second = place(_counts(rows, values, FINE, by_group(first)), first, FINE - COARSE)
    wanted = by_group(second)
    shape = pa.schema([("g", pa.int32()), ("cell", pa.int64()), ("v", pa.float64()), ("n", pa.int64())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, x in values(batch):
                if g in wanted:
                    x, cell = _cells(x, FINE, wanted[g] >> (FINE - COARSE))
                    x, n = np.unique(x[np.isin(cell, wanted[g])], return_counts=True)
                    cell = (_codes(x) >> np.uint64(64 - FINE)).astype(np.int64)
                    yield pa.record_batch([pa.array(np.full(len(x), g, np.int32)), pa.array(cell), pa.array(x), pa.array(n.astype(np.int64))], schema=shape)

    spark = rows.sparkSession
    told = [(g, cell, t, r, before) for (t, r), (cell, before) in second.items() for g in members[t]]
    if not told:
        return {}
    inside = rows.mapInArrow(gather, "g int, cell long, v double, n long").groupBy("g", "cell", "v").agg(F.sum("n").alias("n"))
    at = inside.join(F.broadcast(spark.createDataFrame(told, "g int, cell long, t int, r long, before long")), ["g", "cell"]).groupBy("t", "r", "before", "v").agg(F.sum("n").alias("n"))
    run = at.withColumn("up_to", F.col("before") + F.sum("n").over(Window.partitionBy("t", "r").orderBy("v")))
    found = {(x.t, x.r): x.v for x in run.where(F.col("up_to") > F.col("r")).groupBy("t", "r").agg(F.min("v").alias("v")).collect()}
    out = {}
    for t, n in sizes.items():
        cuts = []
        for q in shares:
            p = q * (n - 1)
            lo, hi = int(np.floor(p)), int(np.ceil(p))
            a, b = found[t, lo], found[t, hi]
            cuts.append(a if a == b else (hi - p) * a + (p - lo) * b)
        out[t] = n, cuts
    return out


def columns(names: list[str]) -> Values:
    """The values of columns of doubles, grouped by their place in names."""

    def values(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for i, name in enumerate(names):
            yield i, batch.column(name).to_numpy(zero_copy_only=False)

    return values
