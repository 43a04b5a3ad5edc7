"""Case retrieval, fits, correlations, statements and guardrails against plain loops."""

import datetime as dt
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelyard.operators import cases, entries, gates, gram, guardrails, learners, statements


def brute_cases(queries, bank, k):
    out = {}
    for q in queries:
        mature = [b for b in bank if b["maturity_idx"] is not None and b["maturity_idx"] <= q["date_idx"]]
        own = [b for b in mature if b["industry"] == q["industry"]]
        pool = own if len(own) >= k else mature
        place = sorted(pool, key=lambda b: (-round(float(np.dot(q["v"], b["v"])), 9), b["date_idx"], b["code"]))[:k]
        out[q["query_id"]] = len(pool), [(b["code"], b["date_idx"]) for b in place]
    return out


@pytest.mark.parametrize("block", [4096, 7])
def test_cases_are_mature_and_of_the_industry_where_it_has_enough(spark, monkeypatch, block):
    monkeypatch.setattr(cases, "QUERY_BLOCK", block)
    rng = np.random.default_rng(3)
    rows = []
    for code in range(12):
        for day in range(15):
            v = rng.integers(-3, 4, 4).astype(float)  # ties
            v /= np.linalg.norm(v) or 1.0
            rows.append({"code": code, "date_idx": day, "maturity_idx": day + 1 if day < 14 else None, "industry": None if code == 11 else "abc"[code % 3], "v": v.tolist(), "fwd": None if (code + day) % 7 == 0 else float(rng.normal()), "tags": ["reversal_pullback"] if code % 2 else []})
    bank = spark.createDataFrame(rows, "code long, date_idx int, maturity_idx int, industry string, v array<double>, fwd double, tags array<string>").repartition(5)
    asked = [{**r, "query_id": r["code"] * 100 + r["date_idx"]} for r in rows if (r["code"] + r["date_idx"]) % 3 == 0]
    queries = spark.createDataFrame([(r["query_id"], r["code"], dt.date(2020, 1, 1 + r["date_idx"]), r["date_idx"], r["industry"], r["v"]) for r in asked], "query_id long, code long, date date, date_idx int, industry string, v array<double>")
    hits, pooled = cases.analogues(queries, bank, 6)
    want = brute_cases(asked, rows, 6)
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.code, r.date_idx))
    assert {r.query_id: r.n_candidates for r in pooled.collect()} == {q: n for q, (n, _) in want.items()}
    assert got == {q: hit for q, (_, hit) in want.items() if hit}
    known = {(r["code"], r["date_idx"]): r["fwd"] for r in rows}
    for r in cases.outcomes(hits, pooled, 6).collect():
        n, hit = want[r.code * 100 + r.date.day - 1]
        values = [known[h] for h in hit if known[h] is not None]
        if n < 6:
            assert r.analogue_base_rate is None and r.dominant_skill_tag == ""
        elif values:
            assert math.isclose(r.analogue_base_rate, np.mean(values), abs_tol=1e-12) and math.isclose(r.analogue_std, np.std(values), abs_tol=1e-12)


def test_applicable_cases(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "b", "c"]), (["a"], ["a", "b"]), (["b", "c"], ["b", "c"]), (["a", "b", "meta"], ["a", "b"]), (None, ["a"])], "x array<string>, y array<string>")
    got = df.select(cases.applicable(F.col("x"), F.col("y"), ["a"], ["meta"]).alias("ok")).collect()
    assert [r.ok for r in got] == [True, False, False, False, False]


def test_logistic_blocks_equal_newton_in_numpy(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 3)) * [1, 5, 0.2] + [0, 2, 7]
    y = (rng.random(900) < 1 / (1 + np.exp(-(x[:, 0] + 0.3 * x[:, 1] - 1.5)))).astype(int)
    blocks = np.array(["b1", "b2", "b3"])[np.arange(900) // 300]
    rows = spark.createDataFrame([(b, v.tolist(), int(t)) for b, v, t in zip(blocks, x, y)], "time_block string, x array<double>, y int").repartition(3)
    got = {r.valid_block: r for r in learners.logistic_blocks(rows, "y").collect()}
    assert sorted(got) == ["b2", "b3"]
    for b, n in (("b2", 300), ("b3", 600)):
        a, t = x[:n], y[:n]
        mean, scale = a.mean(axis=0), a.std(axis=0)
        z = np.c_[np.ones(n), (a - mean) / scale]
        weight = np.where(t == 1, n / (2 * t.sum()), n / (2 * (n - t.sum())))
        beta = np.zeros(4)
        for _ in range(50):
            p = 1 / (1 + np.exp(-z @ beta))
            own = np.r_[0, 2, 2, 2]
            beta += np.linalg.solve(z.T @ ((weight * p * (1 - p))[:, None] * z) + np.diag(own), z.T @ (weight * (t - p)) - own * beta)
        w = beta[1:] / scale
        assert got[b].n == n and np.allclose(got[b].weights, w, atol=1e-6) and math.isclose(got[b].intercept, beta[0] - w @ mean, abs_tol=1e-6)


def test_medians_come_from_the_blocks_before(spark):
    rows = spark.createDataFrame([("b1", 1.0, 1), ("b1", 3.0, 0), ("b1", None, 1), ("b2", 10.0, 1), ("b2", None, 0), ("b3", None, 1), ("b3", None, None)], "time_block string, f double, y int")
    got = sorted((r.time_block, r.x[0]) for r in learners.imputed(rows, ["f"], "y").collect())
    assert got == [("b1", 0.0), ("b1", 1.0), ("b1", 3.0), ("b2", 2.0), ("b2", 10.0), ("b3", 3.0)]


def test_correlations_equal_numpy(spark, monkeypatch):
    monkeypatch.setattr(gram, "CODES", 4)
    monkeypatch.setattr(gram, "DATES", 8)
    rng = np.random.default_rng(2)
    data = {c: {d: float(rng.normal() + (c % 3) * d / 9) for d in range(30) if rng.random() < 0.7} for c in range(5, 60, 5)}
    data[100] = {d: 1.0 for d in range(30)}
    rows = spark.createDataFrame([(c, dt.date(2021, 1, 1) + dt.timedelta(days=d), x) for c, xs in data.items() for d, x in xs.items()], "code long, date date, x double")
    got = {(r.code, r.peer): (r.n, r.corr) for r in gram.correlations(rows, least=12).collect()}
    want = {}
    for a in data:
        for b in data:
            both = sorted(data[a].keys() & data[b].keys())
            if a < b and len(both) >= 12 and b != 100:
                want[a, b] = len(both), np.corrcoef([data[a][d] for d in both], [data[b][d] for d in both])[0, 1]
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and math.isclose(got[k][1], want[k][1], abs_tol=1e-9) for k in want)


def test_statements(spark):
    rows = [(1, 8, "income", {"total_revenue": 50.0, "n_income": -5.0, "total_profit": None}), (1, 4, "income", {"total_revenue": 100.0, "n_income": 10.0, "total_profit": 0.0}), (1, 8, "balancesheet", {"total_assets": 100.0, "total_liab": 90.0}), (2, 8, "cashflow", {"n_cashflow_act": -1.0})]
    df = spark.createDataFrame(rows, "code long, period int, interface string, metrics map<string,double>")
    got = {(r.code, r.period, r.interface): r for r in statements.scored(statements.with_ratios(statements.with_changes(df))).collect()}
    one = got[1, 8, "income"]
    assert one.metrics == {"total_revenue": 50.0, "n_income": -5.0, "total_revenue_yoy": -50.0, "n_income_yoy": -150.0}
    assert math.isclose(one.risk, 0.125 + 0.25 + 0.25) and one.surprise == -0.75 and one.missing_rate == 0.5
    sheet = got[1, 8, "balancesheet"]
    assert sheet.metrics["liab_to_assets"] == 0.9 and sheet.risk == 0.45 and sheet.surprise == 0 and math.isclose(sheet.materiality, max(0.35 + 0.3 * 3 / 8, 0.45))
    assert got[2, 8, "cashflow"].risk == 0.3


def test_guardrails_see_what_those_before_left(spark):
    names = "grade action weight suggestion target financial_guard variant task_mode positive_capped confirmation_gap gaps strong_quant failure_cases review_queue no_downweight operation from_label_scorer hard_counter floor plan_target".split()
    base = {"grade": guardrails.DIG, "action": guardrails.RAISE, "weight": 0.3, "suggestion": "", "target": 0.6, "variant": "full_agent", "task_mode": "portfolio_pool", "gaps": [], "operation": "hold"}
    kinds = "grade string, action string, weight double, suggestion string, target double, financial_guard boolean, variant string, task_mode string, positive_capped boolean, confirmation_gap boolean, gaps array<string>, strong_quant boolean, failure_cases boolean, review_queue boolean, no_downweight boolean, operation string, from_label_scorer boolean, hard_counter boolean, floor double, plan_target double"
    changes = [
        {}, {"financial_guard": True, "failure_cases": True}, {"failure_cases": True, "positive_capped": True, "confirmation_gap": True}, {"gaps": ["news_gap", "financial_gap", "book_skill_gap"], "strong_quant": True}, {"gaps": ["news_gap", "quant_tool_gap", "book_skill_gap"], "strong_quant": True},
        {"task_mode": "single_stock", "review_queue": True}, {"task_mode": "single_stock", "review_queue": True, "no_downweight": True}, {"grade": guardrails.UNKNOWN, "action": guardrails.TO_CASH, "weight": None, "target": None, "operation": "small_buy_hold"},
        {"operation": "wait", "from_label_scorer": True}, {"operation": "reduce_review", "from_label_scorer": True, "weight": None, "grade": guardrails.ASIDE, "action": guardrails.LOWER},
    ]
    rows = spark.createDataFrame([tuple({**base, **c}.get(n) for n in names) for c in changes], kinds).coalesce(1)
    r = guardrails.RULES
    got = [(x.grade, x.action, x.weight, x.target, x.fired) for x in guardrails.guarded(rows).select("grade", "action", "weight", "target", "fired").collect()]
    dig, watch, hold = guardrails.DIG, guardrails.WATCH, guardrails.HOLD
    assert got == [
        (dig, guardrails.RAISE, 0.3, 0.6, []), (watch, guardrails.NO_ACTION, 0.0, 0.6, [r[0]]), (watch, hold, 0.1, 0.6, [r[2]]), (dig, guardrails.RAISE, 0.3, 0.6, []), (watch, hold, 0.1, 0.6, [r[3]]),
        (watch, guardrails.LOWER, 0.05, 0.6, [r[5]]), (watch, hold, 0.1, 0.6, [r[5]]), (watch, hold, 0.1, 0.1, [r[6]]), (guardrails.ASIDE, guardrails.TO_CASH, 0.0, 0.0, [r[8]]), (guardrails.ASIDE, guardrails.LOWER, 0.05, 0.1, [r[8]]),
    ]


def test_grids():
    assert len(entries.grid()) == 385 and len({p[0] for p in entries.grid()}) == 385
    assert len(gates.GATES) == 37 and len({g.name for g in gates.GATES}) == 37


def test_every_row_of_the_panel_asks_for_its_cases(spark, data):
    from panelyard.plans import case_queries
    from panelyard.sources.tables import panel

    rows = panel(spark, data).select("code", "date")
    got = case_queries.t_analogues(spark, data).select("code", "date")
    assert got.count() == rows.count() > 0 and got.exceptAll(rows).isEmpty()
    hits = case_queries.q_analogue_leaks(spark, data).agg(F.sum("n_hits")).first()[0]
    some = case_queries.t_analogue_hits(spark, data).count()
    assert hits > 10 * some > 0
    assert all("% 50" not in case_queries.SQL[q] for q in ("t_analogues", "q_analogue_leaks"))


def test_large_blocks_of_ties_are_compared_in_parts():
    rng = np.random.default_rng(4)
    v = np.eye(3)[rng.integers(0, 3, 700)]
    queries = pa.table({"query_id": np.arange(40), "date_idx": pa.array([9] * 40, pa.int32()), "v": list(v[:40]), "pool": [cases.EVERYWHERE] * 40})
    best = cases._Best(queries, 5)
    best.add(pa.RecordBatch.from_pydict({"code": np.arange(700), "date_idx": pa.array([3] * 700, pa.int32()), "maturity_idx": pa.array([4] * 700, pa.int32()), "v": list(v), "fwd": np.ones(700), "tags": [["a"]] * 700}))
    got = pa.Table.from_batches(list(best.batches())).sort_by([("query_id", "ascending"), ("rank", "ascending")])
    want = [int(c) for q in range(40) for c in np.flatnonzero((v == v[q]).all(axis=1))[:5]]
    assert got.column("code").to_pylist() == want
