"""Exact quantiles by counting against percentile(), and that rules hold no feature's values in one place."""

import random

import numpy as np
from pyspark.sql import functions as F

from panelyard.operators import learners, search
from panelyard.operators.quantiles import columns, exact

SHARES = [0.0, 0.2, 0.35, 0.5, 0.8, 1.0]


def test_quantiles_are_those_of_percentile(spark):
    rng = random.Random(5)
    rows = [(rng.gauss(0, 30), rng.choice([-0.0, 0.0, 1.5, None]), rng.uniform(0.4, 0.4001), None, float(i == 7)) for i in range(3000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(7)
    got = exact(df, columns(df.columns), {i: [i] for i in range(5)}, SHARES)
    for i, c in enumerate(df.columns):
        want = df.agg(F.count(c).alias("n"), F.percentile(c, F.array(*map(F.lit, SHARES))).alias("q")).first()
        assert (got.get(i) is None and want.n == 0) or got[i] == (want.n, want.q), c


def test_quantiles_of_united_groups(spark):
    df = spark.createDataFrame([(float(i % 97), float(i)) for i in range(1000)], "a double, b double").repartition(3)
    both = [float(i % 97) for i in range(1000)] + [float(i) for i in range(1000)]
    n, cuts = exact(df, columns(["a", "b"]), {3: [0, 1]}, [0.5])[3]
    assert n == 2000 and cuts == [(sorted(both)[999] + sorted(both)[1000]) / 2]


def test_rules_meet_plain_counts_and_hold_no_value_list(spark):
    rng = random.Random(2)
    rows = [(rng.gauss(1, 9), rng.choice([0.0, 0.0, 0.0, 1.0, 2.0]), rng.choice([0.0, 1.0]), rng.gauss(0, 1)) for _ in range(400)]
    df = spark.createDataFrame(rows, "fwd double, few double, two double, x double")
    out = search.candidates(df, ["few", "two", "x"], least=1)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "Expand" not in plan
    got = out.collect()
    assert {r.feature for r in got} == {"few", "x"} and len(got) == 20
    place = {"few": 1, "x": 3}
    for r in got:
        y = [v[0] for v in rows if (v[place[r.feature]] >= r.threshold if r.op == ">=" else v[place[r.feature]] <= r.threshold)]
        mean = sum(y) / len(y)
        assert r.n == len(y) and abs(r.mean_fwd - mean) < 1e-9 and abs(r.spread - (sum((v - mean) ** 2 for v in y) / len(y)) ** 0.5) < 1e-9


def test_thresholds_are_those_of_plain_loops_and_repeat_no_row(spark):
    rng = random.Random(4)
    rows = [(f"b{i // 200}", [rng.gauss(0, 1)], rng.gauss(1, 5), rng.choice([None, rng.gauss(0, 3)]), int(rng.random() < 0.4)) for i in range(800)]
    df = spark.createDataFrame(rows, "time_block string, x array<double>, return_20d double, pool_excess_20d double, y int").repartition(3)
    models = spark.createDataFrame([(f"b{k}", 200 * k, 0.1 * k, [0.5]) for k in (1, 2, 3)], "valid_block string, n long, intercept double, weights array<double>")
    out = learners.thresholds(df, models, "y")
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = dict(map(tuple, out.collect()))
    for k in (1, 2, 3):
        p = np.array([1 / (1 + np.exp(-(0.1 * k + 0.5 * r[1][0]))) for r in rows[: 200 * k]])
        best = None
        for t in sorted(set(np.quantile(p, [round(0.20 + 0.05 * i, 2) for i in range(15)]))):
            on = [r for r, v in zip(rows, p) if v >= t - 1e-12]
            excess = [r[3] for r in on if r[3] is not None]
            s = sum(excess) / len(excess) + 0.5 * sum(r[4] for r in on) / len(on) + 0.1 * sum(r[2] for r in on) / len(on)
            if len(on) / len(p) >= 0.2 and (best is None or s > best[0] + 1e-12):
                best = s, t
        assert abs(got[f"b{k}"] - best[1]) < 1e-9
