"""Indicators at month ends against plain loops; and how often the signals' build reads and windows."""

import math
import random
import statistics
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import functions as F

from panelyard.functions.expr import rank_pct
from panelyard.operators.month_ends import month_ends
from panelyard.plans import signals

KIND = pa.list_(pa.struct([("date", pa.date32()), *((c, pa.float64()) for c in ("high", "low", "close", "volume", "amount"))]))


def _bars(seed: int, n: int) -> list[dict]:
    rng, day, out = random.Random(seed), date(1995, 1, 1), []
    for _ in range(n):
        day += timedelta(rng.randint(1, 4))
        close, volume = round(rng.uniform(90, 110), 4), float(rng.randint(1, 50))
        out.append({"date": day, "high": close + 1, "low": close - 2, "close": close, "volume": volume, "amount": round(close * volume, 2)})
    return out


def test_month_ends_are_those_of_plain_loops():
    lists = [_bars(1, 300), [], _bars(2, 1), _bars(3, 77)]
    mixed = [random.Random(9).sample(x, len(x)) for x in lists]  # in any order
    got = month_ends(pa.array(mixed, KIND), 60).to_pylist()
    close_to = lambda a, b: (a is None and b is None) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    for rows, months in zip(lists, got):
        ends = [i for i, b in enumerate(rows) if i + 1 == len(rows) or rows[i + 1]["date"].replace(day=1) != b["date"].replace(day=1)]
        assert [m["date"] for m in months] == [rows[i]["date"].replace(day=1) for i in ends]
        for k, (i, m) in enumerate(zip(ends, months)):
            c = [b["close"] for b in rows[: i + 1]]
            around = rows[max(0, i - 59) : i + 1]
            whole = sum(b["volume"] for b in around)
            own = [b for b in rows if b["date"].replace(day=1) == m["date"]]
            assert close_to(m["close"], sum(b["amount"] for b in own) / sum(b["volume"] for b in own))
            assert (m["return_20d"] is None) == (k + 1 == len(ends))
            assert close_to(m["prior_return_20d"], 100 * (c[-1] / c[-21] - 1) if len(c) > 20 else None)
            assert m["close_above_ma200"] == (c[-1] > sum(c[-200:]) / 200 if len(c) >= 200 else None)
            assert close_to(m["drawdown60"], 100 * (c[-1] / max(c[-60:]) - 1) if len(c) >= 60 else None)
            assert close_to(m["winner_rate_pct"], 100 * sum(b["volume"] for b in around if b["close"] <= c[-1]) / whole)
            r = [100 * (b / a - 1) for a, b in zip(c, c[1:])]
            assert close_to(m["kline_volatility_ratio_3_20"], statistics.pstdev(r[-3:]) / statistics.pstdev(r[-20:]) if len(r) >= 20 else None)


def test_unknown_values_give_no_indicator():
    rows = _bars(4, 90)
    rows[80]["close"] = rows[80]["amount"] = None
    rows.append({"date": None, "high": 1.0, "low": 1.0, "close": 1.0, "volume": 1.0, "amount": 1.0})
    last = month_ends(pa.array([rows], KIND), 60).to_pylist()[0][-1]
    assert last["date"] is not None and last["drawdown60"] is None and last["atr20_pct"] is not None and last["kline_return_3d"] is not None


def test_signals_take_windows_at_month_ends_and_read_line_items_once(spark, data):
    assert "Window" not in signals.daily_signals(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert signals.statement_scores(spark, data)._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_rank_shares_have_no_window_a_value(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (1, 5.0), (1, None), (2, 1.0)], "g int, x double").withColumn("r", rank_pct("x", "g"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 2  # ranks, and the number of a group
    assert sorted((r.g, r.x, r.r) for r in df.where(F.col("x").isNotNull()).collect()) == [(1, 2.0, 0.5), (1, 2.0, 0.5), (1, 5.0, 1.0), (2, 1.0, 1.0)]
