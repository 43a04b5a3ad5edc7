"""Learned positions by action bin, and walk-forward fits for all blocks at once.

Fits are made from sums: each block's rows are summed up once (counts, sums, products), a block's
training sums are those of all blocks before it, and what is solved is a small matrix a block. The
logistic fit takes Newton steps whose sums come from one pass over written rows for all blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.functions.expr import clip
from panelyard.operators.quantiles import exact
from panelyard.operators.walkforward import block_index
from panelyard.sources.folders import scratch

LEAST_BIN, CASH = 80, 0.238095
# fixed values: what each policy holds in a bin too small to learn from, in the order of BINS
BINS = ("hard_counter", "opp_strong_kline_clean", "opp_kline_clean", "opp_only_channel_support", "kline_only_channel_support", "opp_only_clean", "kline_only_clean", "confirm_with_review", "review_only", "low_signal")
FALLBACK = {
    "learned_precision_v1": (0.0, 0.45, 0.35, 0.20, 0.20, 0.15, 0.15, 0.05, 0.0, 0.05),
    "learned_loss_guard_v1": (0.0, 0.40, 0.30, 0.20, 0.20, 0.10, 0.10, 0.05, 0.0, 0.05),
    "learned_balanced_v1": (0.0, 0.55, 0.40, 0.30, 0.30, 0.20, 0.20, 0.10, 0.05, 0.10),
    "learned_delta_guard_v1": (0.0, 0.40, 0.35, 0.20, 0.10, 0.25, 0.10, 0.05, 0.0, 0.05),
}
STEPS, RIDGE, INVERSE_PENALTY = 25, 1.0, 0.5
LEAST_SHARE = 0.2


def action_bin() -> Column:
    """The bin of a row with flags hard, review, opp, opp_strong and kline, and the probabilities
    channel_hard and channel_support; the first that holds."""
    c = F.col
    opp, kline, clean, backed = c("opp"), c("kline"), ~c("review"), F.coalesce("channel_support", F.lit(0.0)) >= 0.45
    tests = (
        c("hard") | (F.coalesce("channel_hard", F.lit(0.0)) >= 0.95), c("opp_strong") & kline & clean, opp & kline & clean, opp & ~kline & backed & clean, kline & ~opp & backed & clean,
        opp & ~kline & clean, kline & ~opp & clean, (opp | kline) & c("review"), c("review"),
    )
    return F.coalesce(*(F.when(t, F.lit(name)) for t, name in zip(tests, BINS)), F.lit(BINS[-1]))


def bin_records(rows: DataFrame, block: str = "time_block") -> DataFrame:
    """(target_block, action_bin, …): the record of each bin over the blocks before target_block,
    against all rows of these blocks."""
    r = F.col("return_20d")
    parts = rows.groupBy(block, "action_bin").agg(F.count("*").alias("n_all"), F.count(r).alias("n"), F.count_if(r > 0).alias("up"), F.count_if(r <= -5).alias("down"), F.sum(r).alias("total"))
    order = block_index(parts, block)
    later = order.select(F.col(block).alias("target_block"), F.col("idx").alias("k")).where("k >= 2")
    past = parts.join(order, block).join(later, F.col("idx") < F.col("k")).groupBy("target_block", "action_bin").agg(*(F.sum(c).alias(c) for c in ("n_all", "n", "up", "down", "total")))
    base = past.groupBy("target_block").agg((F.sum("up") / F.sum("n_all")).alias("base_pos"), (F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("base_avg"), (F.sum("down") / F.sum("n_all")).alias("base_loss"))
    share = lambda c: F.round(F.col(c) / F.nullif(F.col("n"), F.lit(0)), 6)
    out = past.join(base, "target_block").select("target_block", "action_bin", F.col("n").alias("n_rows"), share("up").alias("pos_rate"), share("total").alias("avg_return"), share("down").alias("loss_rate"), "base_pos", "base_avg", "base_loss")
    return out.withColumns({"delta_pos": F.col("pos_rate") - F.col("base_pos"), "delta_avg": F.col("avg_return") - F.col("base_avg")})


def _first(*rules: tuple[Column, float], otherwise: float) -> Column:
    out = F
    for test, value in rules:
        out = out.when(F.coalesce(test, F.lit(False)), value)
    return out.otherwise(otherwise)


def learned_positions() -> dict[str, Column]:
    """The position that each policy takes from a bin's record."""
    p, a, loss, dp, da = (F.col(c) for c in ("pos_rate", "avg_return", "loss_rate", "delta_pos", "delta_avg"))
    limit = lambda floor, more: F.greatest(F.lit(floor), F.col("base_loss") + more)
    weak = F.coalesce((dp < 0) | (da < 0), F.lit(False))
    strong = _first(((p >= 0.72) & (a >= 2.0) & (loss <= limit(0.20, 0)), 0.55), ((p >= 0.62) & (a >= 1.0) & (loss <= limit(0.25, 0.03)), 0.40), ((p >= 0.55) & (a >= 0.5), 0.25), otherwise=0.10)
    return {
        "learned_precision_v1": _first(((p >= 0.68) & (a >= 2.0) & (loss <= limit(0.22, 0)), 0.55), ((p >= 0.60) & (a >= 1.0) & (loss <= limit(0.28, 0.04)), 0.35), ((p >= 0.53) & (a >= 0.0), 0.20), ((a < 0) | (p < 0.45), 0.0), otherwise=0.10),
        "learned_loss_guard_v1": _first(((loss > limit(0.30, 0.06)) | (a < -1.0), 0.0), ((p >= 0.65) & (a >= 1.5), 0.50), ((p >= 0.57) & (a >= 0.5), 0.30), ((p >= 0.50) & (a >= -0.25), 0.15), otherwise=0.05),
        "learned_balanced_v1": _first(((p >= 0.64) & (a >= 1.5) & (loss <= limit(0.30, 0.05)), 0.55), ((p >= 0.56) & (a >= 0.3), 0.35), ((p >= 0.48) & (a >= -0.5), 0.20), ((a < -1.0) | (p < 0.43), 0.0), otherwise=0.10),
        "learned_delta_guard_v1": F.when(weak, _first(((loss > limit(0.30, 0.04)) | (a < 0), 0.0), otherwise=0.10)).otherwise(strong),
    }


def position_models(records: DataFrame, least: int = LEAST_BIN) -> DataFrame:
    """(target_block, policy_name, action_bin, position): a row for each bin, learned where its
    record is long enough; small, so it is broadcast to the rows."""
    spark = records.sparkSession
    rules = learned_positions()
    known = records.select("target_block", "action_bin", "n_rows", F.explode(F.array(*(F.struct(F.lit(k).alias("policy_name"), v.alias("learned")) for k, v in rules.items()))).alias("m")).select("target_block", "action_bin", "n_rows", "m.*")
    defaults = spark.createDataFrame([(k, b, v) for k, values in FALLBACK.items() for b, v in zip(BINS, values)], "policy_name string, action_bin string, fallback double")
    whole = records.select("target_block").distinct().join(F.broadcast(defaults))  # 40 rows a block
    out = whole.join(known, ["target_block", "policy_name", "action_bin"], "left")
    return out.select("target_block", "policy_name", "action_bin", F.when(F.col("n_rows") >= least, F.col("learned")).otherwise(F.col("fallback")).alias("position"), F.coalesce(F.col("n_rows") >= least, F.lit(False)).alias("is_learned"))


def positioned(rows: DataFrame, models: DataFrame, block: str = "time_block") -> DataFrame:
    """rows with each policy's target: the bin's position, nothing at hard risks, a fifth under review."""
    out = rows.join(F.broadcast(models.withColumnRenamed("target_block", block)), [block, "action_bin"])
    target = F.when(F.col("hard"), 0.0).when(F.col("review"), F.least("position", F.lit(0.20))).otherwise(F.col("position"))
    out = out.withColumn("target_position", clip(target, 0, 0.70))
    t = F.col("target_position")
    hint = (
        F.when(t <= 0, "avoid_or_reduce_by_learned_position_tool").when(t >= 0.50, "trial_buy_or_add_if_user_confirms_by_learned_tool").when(t >= 0.35, "small_buy_or_hold_by_learned_tool")
        .when(t >= 0.15, "hold_tiny_or_wait_for_confirmation_by_learned_tool").otherwise("wait_or_hold_tiny_position_by_learned_tool")
    )
    return out.withColumns({"operation_hint": hint, "cash_adjusted_return_20d": t * F.col("return_20d") + (1 - t) * CASH})


# -- walk-forward fits ------------------------------------------------------------------------


def moments(rows: DataFrame, features: list[str], y: str, block: str = "time_block") -> DataFrame:
    """(valid_block, n, sx, sxx, sy, sxy, syy): sums over the blocks before valid_block, of rows in
    which features and y are known."""
    known = rows.dropna(subset=[*features, y])
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    x = [F.col(f) for f in features]
    sums = [F.count("*").alias("n"), *(F.sum(c).alias(f"s{i}") for i, c in enumerate(x)), *(F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs), F.sum(y).alias("sy"), *(F.sum(c * F.col(y)).alias(f"q{i}") for i, c in enumerate(x)), F.sum(F.col(y) * F.col(y)).alias("syy")]
    parts = known.groupBy(block).agg(*sums)
    order = block_index(parts, block)
    later = order.select(F.col(block).alias("valid_block"), F.col("idx").alias("k")).where("k >= 2")
    names = [c for c in parts.columns if c != block]
    return parts.join(order, block).join(later, F.col("idx") < F.col("k")).groupBy("valid_block").agg(*(F.sum(c).alias(c) for c in names))


def ridge(sums: DataFrame, features: list[str], penalty: float = RIDGE, least: int = 100) -> DataFrame:
    """(valid_block, n, intercept, weights): ridge on standardized features, weights in their own
    units; a block with fewer than least training rows has none. Features without spread get 0."""
    k = len(features)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                n = r["n"]
                mean = np.array([r[f"s{i}"] for i in range(k)]) / n
                cross = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) - n * np.outer(mean, mean)
                right = np.array([r[f"q{i}"] for i in range(k)]) - mean * r["sy"]
                spread = np.sqrt(np.maximum(np.diag(cross) / n, 0))
                scale = np.where(spread > 1e-12, spread, np.inf)
                b = np.linalg.solve(cross / np.outer(scale, scale) + penalty * np.eye(k), right / scale) / scale
                out.append({"valid_block": r["valid_block"], "n": n, "intercept": r["sy"] / n - float(mean @ b), "weights": b.tolist()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("valid_block", pa.string()), ("n", pa.int64()), ("intercept", pa.float64()), ("weights", pa.list_(pa.float64()))]))

    return sums.where(F.col("n") >= least).mapInArrow(solve, "valid_block string, n long, intercept double, weights array<double>")


def imputed(rows: DataFrame, features: list[str], label: str, block: str = "time_block") -> DataFrame:
    """(…, x): rows whose label is known with their features, unknown ones at their median over the
    blocks before theirs (0 where there is none, so no block sees its own)."""
    order = [r[0] for r in block_index(rows, block).orderBy("idx").select(block).collect()]  # blocks are few
    place, k = {b: i for i, b in enumerate(order)}, len(features)

    def values(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        at = np.array([place[b] for b in batch.column("b").to_pylist()], int)
        for j in range(k):
            x = batch.column(f"f{j}").to_numpy(zero_copy_only=False)
            for i in np.unique(at):
                yield int(i) * k + j, x[at == i]

    # a target for each later block and feature, which unites the blocks before it
    known = rows.where(F.col(block).isNotNull()).select(F.col(block).alias("b"), *(F.round(F.col(f).cast("double"), 6).alias(f"f{j}") for j, f in enumerate(features)))
    found = exact(known, values, {i * k + j: [g * k + j for g in range(i)] for i in range(1, len(order)) for j in range(k)}, [0.5])
    table = [(b, *(found[i * k + j][1][0] if i * k + j in found else None for j in range(k))) for b, i in place.items()]
    medians = rows.sparkSession.createDataFrame(table, ", ".join([f"_later {rows.schema[block].dataType.simpleString()}", *(f"`{f}` double" for f in features)]))
    out = rows.where(F.col(label).isNotNull()).join(F.broadcast(medians.withColumnsRenamed({f: f"_m_{f}" for f in features} | {"_later": block})), block, "left")
    return out.withColumn("x", F.array(*(F.coalesce(F.col(f).cast("double"), F.col(f"_m_{f}"), F.lit(0.0)) for f in features))).drop(*(f"_m_{f}" for f in features))


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table, for passes that read it again and again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def logistic_blocks(rows: DataFrame, label: str, block: str = "time_block", steps: int = STEPS, inverse_penalty: float = INVERSE_PENALTY, least: int = 100) -> DataFrame:
    """(valid_block, n, intercept, weights): for each block from the second on a logistic fit on all
    blocks before it, classes weighed alike, features standardized over the training rows, and a
    penalty of 1 / inverse_penalty on the weights. rows, best written ones, hold x (array) and a 0/1 label.

    Every step is one pass over the rows for all blocks, which returns a gradient and a
    matrix a block; only these reach the driver."""
    spark = rows.sparkSession
    order = [r[0] for r in block_index(rows, block).orderBy("idx").select(block).collect()]
    place = {b: i for i, b in enumerate(order)}
    data = rows.select(block, "x", F.col(label).cast("double").alias("y"))
    size = len(data.select("x").first()[0]) if not data.isEmpty() else 0
    parts = data.groupBy(block).agg(F.count("*").alias("n"), F.sum("y").alias("ones"), *(F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(size)), *(F.sum(F.col("x")[i] * F.col("x")[i]).alias(f"t{i}") for i in range(size)))
    sums = {r[block]: r for r in parts.collect()}  # a row a block
    models: dict[int, dict] = {}
    total = np.zeros(2 + 2 * size)
    for k, b in enumerate(order):
        n, ones = total[0], total[1]
        if n >= least and 0 < ones < n:
            mean = total[2 : 2 + size] / n
            spread = np.sqrt(np.maximum(total[2 + size :] / n - mean * mean, 0))
            models[k] = {"n": int(n), "mean": mean, "scale": np.where(spread > 1e-12, spread, 1.0), "class": np.array([n / (2 * (n - ones)), n / (2 * ones)]), "beta": np.zeros(size + 1)}
        if b in sums:
            r = sums[b]
            total = total + np.array([r["n"], r["ones"], *(r[f"s{i}"] for i in range(size)), *(r[f"t{i}"] for i in range(size))], float)
    for _ in range(steps):
        if not models:
            break
        got = data.mapInArrow(_newton(models, place, block), "k int, g array<double>, h array<double>").groupBy("k").agg(*(F.array(*(F.sum(F.col(c)[i]) for i in range(m))).alias(c) for c, m in (("g", size + 1), ("h", (size + 1) ** 2)))).collect()
        moved = 0.0
        for r in got:
            m = models[r["k"]]
            own = np.r_[0.0, np.full(size, 1 / inverse_penalty)]
            step = np.linalg.solve(np.reshape(r["h"], (size + 1, size + 1)) + np.diag(own), np.array(r["g"]) - own * m["beta"])
            m["beta"] = m["beta"] + step
            moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-9:
            break
    out = []
    for k, m in models.items():
        w = m["beta"][1:] / m["scale"]
        out.append((order[k], m["n"], float(m["beta"][0] - w @ m["mean"]), w.tolist()))
    return spark.createDataFrame(out, "valid_block string, n long, intercept double, weights array<double>")


def _newton(models: dict[int, dict], place: dict[str, int], block: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: (np.zeros(len(m["beta"])), np.zeros((len(m["beta"]),) * 2)) for k, m in models.items()}
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.array([place[b] for b in batch.column(block).to_pylist()])
            x, y = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), batch.column("y").to_numpy()
            for k, m in models.items():
                use = at < k
                if use.any():
                    z = np.c_[np.ones(use.sum()), (x[use] - m["mean"]) / m["scale"]]
                    p = 1 / (1 + np.exp(-np.clip(z @ m["beta"], -35, 35)))
                    weight = m["class"][y[use].astype(int)]
                    g, h = sums[k]
                    g += z.T @ (weight * (y[use] - p))
                    h += z.T @ ((weight * p * (1 - p))[:, None] * z)
        yield pa.RecordBatch.from_pylist([{"k": k, "g": g.tolist(), "h": h.ravel().tolist()} for k, (g, h) in sums.items()], schema=pa.schema([("k", pa.int32()), ("g", pa.list_(pa.float64())), ("h", pa.list_(pa.float64()))]))

    return run


def linear_score(x: Column, intercept: Column, weights: Column) -> Column:
    return intercept + F.aggregate(F.zip_with(x, weights, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)


def guard_scores(rows: DataFrame, models: DataFrame, block: str = "time_block") -> DataFrame:
    """rows of blocks that have a model with guard_probability."""
    out = rows.join(F.broadcast(models.withColumnRenamed("valid_block", block).drop("n")), block)
    return out.withColumn("guard_probability", 1 / (1 + F.exp(-linear_score(F.col("x"), F.col("intercept"), F.col("weights"))))).drop("intercept", "weights")


def _probability(x: np.ndarray, intercept: float, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-(intercept + x @ weights)))


def thresholds(rows: DataFrame, models: DataFrame, label: str, least_share: float = LEAST_SHARE, block: str = "time_block") -> DataFrame:
    """(valid_block, threshold): of 15 quantiles of the training rows' probabilities the one whose
    allowed rows score best by excess, precision and return, and are not too few. No row is repeated
    for a model or a threshold: passes over the rows return sums a model and threshold."""
    order = [r[0] for r in block_index(rows, block).orderBy("idx").select(block).collect()]
    place = {b: i for i, b in enumerate(order)}
    fits = {place[m["valid_block"]]: (m["intercept"], np.array(m["weights"])) for m in models.collect()}  # a row a block
    data = rows.where(F.col(block).isNotNull()).select(F.col(block).alias("b"), "x", "return_20d", "pool_excess_20d", F.col(label).cast("double").alias("y"))

    def scored(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        at = np.array([place[b] for b in batch.column("b").to_pylist()], int)
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        for k, (intercept, weights) in fits.items():
            if (use := at < k).any():
                yield k, use, _probability(x[use], intercept, weights)

    def values(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        return ((k, p) for k, _, p in scored(batch))

    found = exact(data.select("b", "x"), values, {k: [k] for k in fits}, [round(0.20 + 0.05 * i, 2) for i in range(15)])
    cuts = {k: np.unique(c) for k, (_, c) in found.items()}
    names = ("n", "ny", "y", "ne", "e", "nr", "r")

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros((len(names), len(c) + 1)) for k, c in cuts.items()}
        for batch in batches:
            told = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "pool_excess_20d", "return_20d")]
            for k, use, p in scored(batch):
                at = np.searchsorted(cuts[k], p, "right")
                parts = [None, *(w for t in told for w in (~np.isnan(t[use]), np.nan_to_num(t[use])))]
                sums[k] += [np.bincount(at, w, len(cuts[k]) + 1) for w in parts]
        for k, s in sums.items():
            yield pa.record_batch([pa.array(np.full(s.shape[1], k, np.int32)), pa.array(np.arange(s.shape[1], dtype=np.int32)), *map(pa.array, s)], names=["k", "at", *names])

    got = data.mapInArrow(tried, "k int, at int, " + ", ".join(f"{c} double" for c in names)).groupBy("k", "at").agg(*(F.sum(c).alias(c) for c in names)).collect()
    sums = {k: np.zeros((len(names), len(c) + 1)) for k, c in cuts.items()}
    for r in got:
        sums[r["k"]][:, r["at"]] = [r[c] for c in names]
    out = []
    for k, s in sums.items():
        n, ny, y, ne, e, nr, r = np.cumsum(s[:, ::-1], axis=1)[:, ::-1][:, 1:]  # of the rows at each cut or above
        with np.errstate(all="ignore"):
            score = np.round(e / ne + 0.5 * (y / ny) + 0.1 * (r / nr), 12)
        score = np.where(np.isnan(score), -np.inf, score)
        fit = np.flatnonzero(n / found[k][0] >= least_share)
        if len(fit):  # the smallest of equal ones, as it is met first
            out.append((order[k], float(cuts[k][fit[np.argmax(score[fit])]])))
    return rows.sparkSession.createDataFrame(out, "valid_block string, threshold double")
