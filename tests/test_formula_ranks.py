"""Each date's best rows by formula against windows; and that no window sorts a date's rows a feature."""

import datetime as dt
import random

from pyspark.sql import functions as F

from panelyard.functions.expr import half_away, rank_pct
from panelyard.operators import cross, walkforward


def test_best_by_formula_are_those_of_windows(spark):
    rng = random.Random(3)
    rows = [(dt.date(2020, 1, 1 + d), c, None if rng.random() < 0.1 else rng.gauss(0, 9), rng.choice([None, 0.0, -0.0, 1.0, 2.0]), rng.gauss(0, 1)) for d in range(5) for c in range(3 + 60 * (d > 0))]
    df = spark.createDataFrame(rows, "date date, code long, return_20d double, a double, b double").repartition(4)
    formulas = {"one": {"a": 0.7}, "two": {"a": -0.4, "b": 0.6}}
    out = walkforward.best_by_formula(df, 7, formulas)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    known = df.where("return_20d is not null").fillna(0.0, ["a", "b"])
    ranked = known.select("date", "code", "return_20d", rank_pct("a", "date").alias("a"), rank_pct("b", "date").alias("b"))
    want = []
    for name, weights in formulas.items():
        scored = ranked.withColumn("score", half_away(sum((F.col(f) * w for f, w in weights.items()), F.lit(0.0)), 9))
        want += [(name, r.date, r.rank, r.return_20d) for r in cross.top_n(scored, "score", 7, "date").collect()]
    assert sorted(map(tuple, out.select("formula", "date", "rank", "return_20d").collect())) == sorted(want)
