"""Block by block choices with carried promotions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.functions.expr import rounded
from panelyard.operators import epochs
from panelyard.operators.epochs import CASH, FILTERS, FORMULAS, LEAST_BLOCK, LEAST_DATES, SPECS, TARGET, Z
from panelyard.plans.signals import SIGNALS, signals
from panelyard.plans.sql import rank_pct as rank_sql
from panelyard.sources.folders import scratch

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_KINDS = sorted({(f, r) for f, _, _, r in SPECS})
_FEATURES = sorted({x for w in FORMULAS.values() for x in w})
_SPECS = ", ".join(f"({i}, '{f}', {n}, '{g}', '{r}')" for i, (f, n, g, r) in enumerate(SPECS))
_SCORE = " ".join(f"WHEN '{f}' THEN {' + '.join(f'{w} * r_{x}' for x, w in weights.items())}" for f, weights in FORMULAS.items())
_WILSON = f"(up / n + {Z * Z} / (2 * n) - {Z} * sqrt((up / n * (1 - up / n) + {Z * Z} / (4 * n)) / n)) / (1 + {Z * Z} / n)"
_SPEC_IS = lambda test: ", ".join(str(i) for i, s in enumerate(SPECS) if test(s))
_RECORDS = f"""{SIGNALS},
e0 AS (SELECT *, close_above_ma200::INT AS above FROM sg WHERE return_20d IS NOT NULL),
e1 AS (SELECT date, code, return_20d, {', '.join(_FEATURES)}, unnest([{', '.join(f"CASE WHEN {FILTERS[r]} THEN {{'formula': '{f}', 'filter': '{r}'}} END" for f, r in _KINDS)}]) AS k FROM e0),
e2 AS (SELECT date, code, return_20d, {', '.join(_FEATURES)}, k.formula AS formula, k.filter AS filter_ FROM e1 WHERE k IS NOT NULL),
e3 AS (SELECT *, {', '.join(f"coalesce({rank_sql(x, 'formula', 'filter_', 'date')}, 0.5) AS r_{x}" for x in _FEATURES)} FROM e2),
e4 AS (SELECT *, row_number() OVER (PARTITION BY formula, filter_, date ORDER BY round(CASE formula {_SCORE} END, 9) DESC, code) AS place FROM e3),
spec AS (SELECT * FROM (VALUES {_SPECS}) t(spec, formula, picks, gate, filter_)),
pk AS (SELECT spec, gate, date, avg(return_20d) AS day FROM e4 JOIN spec ON spec.formula = e4.formula AND spec.filter_ = e4.filter_ AND place <= picks GROUP BY 1, 2, 3),
ed0 AS (SELECT date, time_block, avg(prior_return_20d) AS prior, avg((prior_return_20d > 0)::INT) AS breadth FROM e0 GROUP BY 1, 2),
ed AS (SELECT *, dense_rank() OVER (ORDER BY time_block) AS idx FROM ed0),
st AS (SELECT unnest(range(1, (SELECT max(idx) FROM ed))) AS step),
pr AS (SELECT st.step, f.step AS fitted FROM st JOIN st f ON f.step <= st.step),
cut AS (SELECT st.step AS fitted, quantile_cont(breadth, 0.80) AS cut FROM ed JOIN st ON idx <= step GROUP BY 1),
eat AS (SELECT pr.step, spec, pr.fitted, idx, day FROM pk JOIN ed USING (date) JOIN pr ON idx <= pr.step + 1 JOIN cut ON cut.fitted = pr.fitted WHERE gate = 'all_dates' OR (gate = 'locked_pool_deep_drawdown' AND prior <= {epochs.DEEP}) OR (gate = 'low_market_breadth_q80' AND breadth <= cut)),
eb0 AS (SELECT step, spec, fitted, idx, count(*) AS n, sum(day) AS s, sum(day * day) AS q, count(*) FILTER (day > 0) AS up, count(*) FILTER (day <= -5) AS down FROM eat GROUP BY 1, 2, 3, 4),
sch AS (SELECT idx, count(*) AS scheduled FROM ed GROUP BY 1),
eb1 AS (SELECT pr.step, spec.spec, pr.fitted, sch.idx, scheduled, coalesce(n, 0) AS n, coalesce(s, 0) AS s, coalesce(q, 0) AS q, coalesce(up, 0) AS up, coalesce(down, 0) AS down FROM pr CROSS JOIN spec JOIN sch ON sch.idx <= pr.step + 1
  LEFT JOIN eb0 ON eb0.step = pr.step AND eb0.spec = spec.spec AND eb0.fitted = pr.fitted AND eb0.idx = sch.idx),
eb AS (SELECT a.*, b.n AS base_n, b.s / nullif(b.n, 0) AS base_avg FROM eb1 a JOIN eb1 b ON b.step = a.step AND b.idx = a.idx AND b.spec = 0 AND b.fitted = b.step),
er0 AS (SELECT step, spec, fitted, sum(n) FILTER (idx <= step) AS n, sum(s) FILTER (idx <= step) AS s, sum(q) FILTER (idx <= step) AS q, sum(up) FILTER (idx <= step) AS up, sum(down) FILTER (idx <= step) AS down, sum(scheduled) FILTER (idx <= step) AS scheduled,
  min({_WILSON}) FILTER (idx <= step AND n >= {LEAST_BLOCK}) AS min_wilson, min(up / n) FILTER (idx <= step AND n >= {LEAST_BLOCK}) AS min_pos, avg(up / n) FILTER (idx <= step AND n >= {LEAST_BLOCK}) AS mean_pos, min(s / n) FILTER (idx <= step AND n >= {LEAST_BLOCK}) AS min_avg, count(*) FILTER (idx <= step AND n >= {LEAST_BLOCK}) AS n_blocks,
  min(s / n - base_avg) FILTER (idx <= step AND n >= {LEAST_BLOCK} AND base_n >= {LEAST_BLOCK}) AS min_delta, avg(s / n - base_avg) FILTER (idx <= step AND n >= {LEAST_BLOCK} AND base_n >= {LEAST_BLOCK}) AS mean_delta,
  max(n) FILTER (idx = step + 1) AS valid_n, max(up / nullif(n, 0)) FILTER (idx = step + 1) AS valid_pos, max(s / nullif(n, 0)) FILTER (idx = step + 1) AS valid_avg, max(s / nullif(n, 0) - base_avg) FILTER (idx = step + 1) AS valid_delta FROM eb GROUP BY 1, 2, 3),
er1 AS (SELECT *, s / nullif(n, 0) AS av, up / nullif(n, 0) AS pos, down / nullif(n, 0) AS loss, scheduled - n AS idle, (s + (scheduled - n) * {CASH!r}) / scheduled AS mean FROM er0),
er2 AS (SELECT *, av - 0.5 * sqrt(greatest(q / nullif(n, 0) - av * av, 0)) - 10 * loss AS stability, mean - 0.5 * sqrt(greatest((q + idle * {CASH!r} * {CASH!r}) / scheduled - mean * mean, 0)) - 10 * down / scheduled AS cash_stability FROM er1),
er AS MATERIALIZED (SELECT *, round(coalesce(min_wilson, 0) * 180 + coalesce(min_pos, 0) * 60 + coalesce(mean_pos, 0) * 25 + coalesce(pos, 0) * 10 + coalesce(min_delta, 0) * 1.8 + coalesce(mean_delta, 0) * 0.8 + coalesce(min_avg, 0) * 0.8 + coalesce(av, 0) * 0.4 + coalesce(stability, 0) * 0.6 - coalesce(loss, 0) * 35
   + (up + idle) / scheduled * 70 + cash_stability * 0.8
   + CASE WHEN spec IN ({_SPEC_IS(lambda s: s[2] == 'low_market_breadth_q80')}) THEN CASE WHEN n >= {LEAST_DATES} AND pos >= 0.65 THEN 18 ELSE 0 END + CASE WHEN spec IN ({_SPEC_IS(lambda s: s[1] == 5)}) THEN 8 ELSE -28 END ELSE 0 END
   + CASE WHEN spec IN ({_SPEC_IS(lambda s: s[0] == 'low_vol_trend')}) AND n >= {LEAST_DATES} AND stability >= 0 THEN 10 ELSE 0 END
   - CASE WHEN n < {LEAST_DATES} THEN ({LEAST_DATES} - n) * 4 ELSE 0 END - CASE WHEN n_blocks < least(2, step) THEN 35 ELSE 0 END - CASE WHEN min_pos < {TARGET} THEN 180 ELSE 0 END - CASE WHEN min_delta < -2 THEN 180 ELSE 0 END - CASE WHEN min_delta < -5 THEN 120 ELSE 0 END, 6) AS score,
   coalesce(valid_n >= {LEAST_DATES} AND valid_pos >= {TARGET} AND valid_delta >= 0, false) AS promoted FROM er2)"""
_CHAIN = f"""{_RECORDS},
ch AS (SELECT 0::BIGINT AS step, 0 AS spec, 0::BIGINT AS fitted, false AS promoted, 0.0::DOUBLE AS score, 0::BIGINT AS valid_n, NULL::DOUBLE AS valid_pos, NULL::DOUBLE AS valid_avg, NULL::DOUBLE AS valid_delta, true AS was_locked, 0 AS lock_spec, 0::BIGINT AS lock_fitted
 UNION ALL SELECT step, spec, fitted, promoted, score, valid_n, valid_pos, valid_avg, valid_delta, was_locked, CASE WHEN promoted THEN spec ELSE 0 END, CASE WHEN promoted AND spec <> 0 THEN fitted ELSE 0 END FROM (
  SELECT er.step, er.spec, er.fitted, er.promoted, er.score, er.valid_n::BIGINT AS valid_n, er.valid_pos, er.valid_avg, er.valid_delta, er.spec = ch.lock_spec AS was_locked,
   row_number() OVER (ORDER BY er.score DESC, er.min_wilson DESC NULLS LAST, er.min_pos DESC NULLS LAST, er.pos DESC NULLS LAST, er.spec = ch.lock_spec DESC, er.spec) AS i
  FROM ch JOIN er ON er.step = ch.step + 1 AND ((er.spec = ch.lock_spec AND er.fitted = CASE WHEN ch.lock_fitted = 0 THEN er.step ELSE ch.lock_fitted END) OR (er.spec <> ch.lock_spec AND er.fitted = er.step))) WHERE i = 1)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written, as the steps read it: a row a step, candidate and fit."""
    rows, path = signals(spark, sf_dir), scratch(spark, "epochs")
    epochs.records(epochs.daily_picks(rows), epochs.date_facts(rows)).write.parquet(path)
    return spark.read.parquet(path)


_SHOWN = ["min_wilson", "min_pos", "mean_pos", "min_delta", "mean_delta", "valid_pos", "valid_avg", "valid_delta"]


@query(f"WITH {_RECORDS} SELECT step, spec, fitted, n::BIGINT AS n, {', '.join(f'round({c}, 6) AS {c}' for c in _SHOWN)}, round(score, 3) AS score FROM er")
def l_epoch_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each candidate's record over the blocks so far, for every step and fit of its threshold."""
    out = _records(spark, sf_dir).select("step", "spec", "fitted", "n", *_SHOWN, "score")
    return rounded(out.withColumn("score", F.round("score", 3)))


@query(f"WITH RECURSIVE {_CHAIN} SELECT step, spec, fitted, was_locked, promoted, valid_n, round(valid_pos, 6) AS valid_pos, round(valid_avg, 6) AS valid_avg, round(valid_delta, 6) AS valid_delta FROM ch WHERE step > 0")
def l_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each step chose on the blocks before, and whether it stayed locked after the next one."""
    out = epochs.chain(_records(spark, sf_dir))
    return rounded(out.select("step", "spec", "fitted", "was_locked", "promoted", "valid_n", "valid_pos", "valid_avg", "valid_delta"))
