"""Correlations and analogues at sizes where each pair or merge counts."""

import time

import numpy as np
import pyarrow as pa

from panelyard.operators import cases, gram
from panelyard.plans.registry import QUERIES


def test_pairs_of_blocks_hand_on_best_peers_only(spark, monkeypatch):
    monkeypatch.setattr(gram, "CODES", 5)
    rng = np.random.default_rng(3)
    common = rng.normal(size=30)
    x = 0.5 * common + rng.normal(size=(17, 30))
    x[3] = 1.0  # no spread
    rows = spark.createDataFrame([(c * 11, d, float(x[c, d])) for c in range(17) for d in range(30) if (c + d) % 7], "code long, date int, x double")
    got = {(r.code, r["rank"]): (r.peer, r.n, round(r["corr"], 9)) for r in gram.best_peers(rows, 2, least=20).collect()}
    want = {}
    for c in range(17):
        own = []
        for p in range(17):
            both = [d for d in range(30) if (c + d) % 7 and (p + d) % 7]
            if p != c and 3 not in (c, p) and len(both) >= 20:
                own.append((-round(float(np.corrcoef(x[c, both], x[p, both])[0, 1]), 9), p * 11, len(both)))
        want |= {(c * 11, k): (p, n, -r) for k, (r, p, n) in enumerate(sorted(o for o in own if o[0] < 0)[:2], 1)}
    assert got == want
    assert gram._met(rows, 20, 2).count() <= 17 * 4 * 2


def test_returns_are_not_paired_by_date(spark, data):
    plan = QUERIES["j_return_correlation"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Join Inner" in line and plan.count("ret#") and "date#" in line and "a#" in line and "b#" in line for line in plan.splitlines())
    assert "MapInArrow" in plan


def test_a_merge_costs_its_own_queries_only():
    rng = np.random.default_rng(5)
    unit = lambda n: (lambda m: m / np.linalg.norm(m, axis=1, keepdims=True))(rng.normal(size=(n, 20)))
    queries = pa.table({"query_id": np.arange(4000), "date_idx": pa.array([90] * 4000, pa.int32()), "v": list(unit(4000)), "pool": [f"i{k % 20}" for k in range(4000)]})
    best, start = cases._Best(queries, 20), time.process_time()
    for b in range(60):
        n = 1000
        industry = [f"i{k % 20}" if k % 50 else None for k in range(n)]
        best.add(pa.RecordBatch.from_pydict({"code": np.arange(n) + n * b, "date_idx": pa.array([b] * n, pa.int32()), "maturity_idx": pa.array([b + 1] * n, pa.int32()), "industry": industry, "v": list(unit(n)), "fwd": np.ones(n), "tags": [["a"]] * n}))
    assert time.process_time() - start < 12
    got = pa.Table.from_batches(list(best.batches()))
    assert got.num_rows == 4000 * 20 and got.column("maturity_idx").to_numpy().max() == 60
