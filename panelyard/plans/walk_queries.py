"""Walk-forward queries: block roles, rulebooks, date gates and grids, block metrics, keyness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelyard.functions.expr import rank_pct, rounded, zscore
from panelyard.operators import walkforward
from panelyard.operators.policy import has_skill, on
from panelyard.plans.decisions import DECISIONS, SKILLS, decisions
from panelyard.plans.sql import rank_pct as rank_sql
from panelyard.plans.sql import zscore as z_sql

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""
WITH {DECISIONS}, o AS (SELECT time_block, row_number() OVER (ORDER BY time_block) AS idx FROM (SELECT DISTINCT time_block FROM d)),
r AS (SELECT t.time_block AS target_block, o.time_block, CASE WHEN o.idx = t.idx THEN 'target' WHEN o.idx = t.idx - 1 THEN 'valid' ELSE 'train' END AS role FROM o JOIN o t ON o.idx <= t.idx WHERE t.idx >= 3),
n AS (SELECT time_block, count(*) AS n, count(DISTINCT date) AS days FROM d GROUP BY 1)
SELECT target_block, role, sum(n)::BIGINT AS n_rows, sum(days)::BIGINT AS n_dates, count(*) AS n_blocks FROM r JOIN n USING (time_block) GROUP BY 1, 2
""")
def l_rolling_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = decisions(spark, sf_dir).groupBy("time_block").agg(F.count("*").alias("n"), F.count_distinct("date").alias("days"))
    both = walkforward.rolling_roles(per).join(per, "time_block")
    return both.groupBy("target_block", "role").agg(F.sum("n").alias("n_rows"), F.sum("days").alias("n_dates"), F.count("*").alias("n_blocks"))


_RULES = {
    "strong": "coalesce(relative_strength_rank >= 0.8, false)",
    "skill_trend": f"list_contains(string_split(triggered_skills, ';'), '{SKILLS[2]}')",
    "deep_fall": "coalesce(drawdown60 <= -30, false)",
    "peer_lead": "coalesce(peer_relative_to_group_20d > 10, false)",
    "busy": "coalesce(news_count_30d >= 10, false)",
}


def _rules() -> dict:
    return {"strong": on(F.col("relative_strength_rank") >= 0.8), "skill_trend": has_skill(SKILLS[2]), "deep_fall": on(F.col("drawdown60") <= -30), "peer_lead": on(F.col("peer_relative_to_group_20d") > 10), "busy": on(F.col("news_count_30d") >= 10)}


_BOOKS = f"""{DECISIONS}, fired AS (SELECT unnest(list_filter(['base', {', '.join(f"CASE WHEN {c} THEN '{k}' END" for k, c in _RULES.items())}], lambda x: x IS NOT NULL)) AS rule, * FROM d WHERE return_20d IS NOT NULL),
ord AS (SELECT time_block, row_number() OVER (ORDER BY time_block) AS idx FROM (SELECT DISTINCT time_block FROM fired)),
parts AS (SELECT rule, time_block, count(*) AS n_rows, sum(return_20d) AS rs, sum(pool_excess_20d) AS es, count(*) FILTER (return_20d > 0) AS np, count(*) FILTER (return_20d <= -5) AS nl FROM fired GROUP BY 1, 2),
books AS (SELECT t.time_block AS valid_block, rule, sum(n_rows)::BIGINT AS n_rows, count(*) AS n_blocks, sum(rs) / sum(n_rows) AS avg20, sum(es) / sum(n_rows) AS pool_excess20, sum(np) / sum(n_rows) AS pos20, sum(nl) / sum(n_rows) AS loss_gt5_rate, min(np / n_rows) AS min_block_pos20
 FROM parts JOIN ord USING (time_block) JOIN ord t ON ord.idx < t.idx GROUP BY 1, 2)"""


@query(f"""
WITH {_BOOKS} SELECT valid_block, rule, n_rows, n_blocks, round(avg20, 6) AS avg20, round(pos20, 6) AS pos20, round(loss_gt5_rate, 6) AS loss_gt5_rate, round(min_block_pos20, 6) AS min_block_pos20,
 CASE WHEN n_rows < 60 THEN 'insufficient_sample' WHEN avg20 > 0 AND pos20 >= 0.55 AND pool_excess20 > 0 AND loss_gt5_rate <= 0.25 AND min_block_pos20 >= 0.40 THEN 'acceptable_reversal_friction'
 WHEN avg20 < 0 OR pos20 <= 0.45 OR pool_excess20 < 0 OR loss_gt5_rate >= 0.30 THEN 'veto_or_downweight' ELSE 'mixed_needs_agent_judgment' END AS rule_status FROM books WHERE rule <> 'base'
""")
def l_rulebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block's rulebook from the blocks before it; the base rule is left to l_promotions."""
    books = walkforward.rulebooks(walkforward.rule_blocks(decisions(spark, sf_dir), _rules()), 60)
    return rounded(books.where("rule <> 'base'").select("valid_block", "rule", "n_rows", "n_blocks", "avg20", "pos20", "loss_gt5_rate", "min_block_pos20", "rule_status"))


@query(f"""
WITH {_BOOKS}, b AS (SELECT k.*, k.pos20 - z.pos20 AS pl, k.pool_excess20 - z.pool_excess20 AS el FROM books k JOIN books z ON k.valid_block = z.valid_block AND z.rule = 'base' AND k.rule <> 'base')
SELECT valid_block, rule, n_rows, round(pl, 6) AS pos_lift, round(el, 6) AS excess_lift, CASE WHEN n_rows < 60 THEN 'observe_too_thin' WHEN pl >= 0.04 AND el >= 0.35 AND loss_gt5_rate <= 0.30 THEN 'promote_candidate' WHEN pl <= 0 OR el <= 0 THEN 'rejected_for_promote' ELSE 'observe_context_probe' END AS promote_status FROM b
""")
def l_promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = walkforward.rulebooks(walkforward.rule_blocks(decisions(spark, sf_dir), _rules()), 60)
    return rounded(walkforward.promotions(books, 60).select("valid_block", "rule", "n_rows", "pos_lift", "excess_lift", "promote_status"))


_DAYS = """days AS (SELECT date, avg(prior_return_20d) AS pool_avg_prior_return_20d, avg(news_risk_event_score_30d) AS pool_avg_news_risk, avg((prior_return_20d > 0)::INT) AS pool_positive_breadth_20d, stddev_samp(prior_return_20d) AS pool_return_dispersion_20d FROM d GROUP BY 1)"""
_TESTS = [(name, [(f, side, q)]) for name, f, side, q in walkforward.DATE_GATES] + [(name, list(parts)) for name, *parts in walkforward.COMPOUND_GATES]
_CUTS = ", ".join(f"quantile_cont({f}, {q}) AS {name}_{i}" for name, parts in _TESTS for i, (f, _, q) in enumerate(parts))
_PASSED = ", ".join(f"CASE WHEN {' AND '.join(f'{f} {side} {name}_{i}' for i, (f, side, _) in enumerate(parts))} THEN '{name}' END" for name, parts in _TESTS)
_GATED = f"""cuts AS (SELECT {_CUTS} FROM days WHERE year(date) <= 1997),
gated AS (SELECT date, unnest(list_filter(['all_dates', {_PASSED}], lambda x: x IS NOT NULL)) AS gate FROM days, cuts)"""


@query(f"WITH {DECISIONS}, {_DAYS}, {_GATED} SELECT date, gate FROM gated")
def l_date_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walkforward.gated_dates(walkforward.date_features(decisions(spark, sf_dir)), F.year("date") <= 1997)


_FEATURES = sorted({f for w in walkforward.FORMULAS.values() for f in w})
_SCORED = ", ".join(f"round({' + '.join(f'r_{f} * {w}' for f, w in weights.items())}, 9)" for weights in walkforward.FORMULAS.values())
_PART = "CASE WHEN year(date) <= 1997 THEN 'search' WHEN year(date) <= 1999 THEN 'valid' ELSE 'test' END"
_GRID = f"""{DECISIONS}, {_DAYS}, {_GATED}, fz AS (SELECT date, code, return_20d, {', '.join(f'coalesce({f}::DOUBLE, 0) AS {f}' for f in _FEATURES)} FROM d WHERE return_20d IS NOT NULL),
fr AS (SELECT date, code, return_20d, {', '.join(f'{rank_sql(f, "date")} AS r_{f}' for f in _FEATURES)} FROM fz),
sc AS (SELECT date, code, return_20d, unnest({list(walkforward.FORMULAS)}) AS formula, unnest([{_SCORED}]) AS score FROM fr),
rk AS (SELECT *, row_number() OVER (PARTITION BY formula, date ORDER BY score DESC NULLS LAST, code) AS rank FROM sc),
day AS (SELECT formula, top_n, date, avg(return_20d) AS day, count(*) FILTER (return_20d > 0) AS np, count(return_20d) AS n FROM rk, (SELECT unnest([3, 5, 10, 20]) AS top_n) WHERE rank <= top_n GROUP BY 1, 2, 3),
grid AS (SELECT formula, gate, top_n, {{part}} AS part, count(*) AS decision_dates, avg(day) AS avg_return_20d, sum(np) / sum(n) AS positive_20d_rate, stddev_samp(day) AS std_return_20d, CASE WHEN stddev_samp(day) > 1e-12 THEN avg(day) / stddev_samp(day) END AS stability_score FROM day JOIN gated USING (date) GROUP BY 1, 2, 3, 4)"""


def _grid(spark: SparkSession, sf_dir: str, part) -> DataFrame:
    df = decisions(spark, sf_dir)
    gates = walkforward.gated_dates(walkforward.date_features(df), F.year("date") <= 1997)
    return walkforward.grid_metrics(walkforward.best_by_formula(df, 20), [3, 5, 10, 20], gates, part)


def _years():
    return F.when(F.year("date") <= 1997, "search").when(F.year("date") <= 1999, "valid").otherwise("test")


_HITS = {p: f"coalesce({p}_avg_return_20d >= 8 AND {p}_positive_20d_rate >= 0.65 AND {p}_decision_dates >= 20, false)" for p in ("valid", "test")}
_NAMES = ["decision_dates", "avg_return_20d", "positive_20d_rate", "std_return_20d", "stability_score"]


@query(f"""
WITH {_GRID.format(part=_PART)}, w AS (SELECT formula, gate, top_n, {', '.join(f"max({n}) FILTER (part = '{p}') AS {p}_{n}" for p in ('valid', 'test') for n in _NAMES)} FROM grid GROUP BY 1, 2, 3)
SELECT formula, gate, top_n, valid_decision_dates, test_decision_dates, round(valid_avg_return_20d, 6) AS valid_avg_return_20d, round(test_avg_return_20d, 6) AS test_avg_return_20d,
 round(CASE WHEN coalesce(valid_decision_dates, 0) < 20 THEN -9999 ELSE coalesce(valid_avg_return_20d, -999) + coalesce(valid_positive_20d_rate, 0) * 8 + coalesce(valid_stability_score, -999) * 0.3 - coalesce(valid_std_return_20d, 999) * 0.05 END, 6) AS selection_score,
 {_HITS['valid']} AS target_hit_on_valid, {_HITS['valid']} AND {_HITS['test']} AS target_hit_on_test FROM w
""")
def l_gate_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas, pool sizes and date gates: validation and test metrics, selection score, targets."""
    out = walkforward.selection(_grid(spark, sf_dir, _years()))
    return rounded(out.select("formula", "gate", "top_n", "valid_decision_dates", "test_decision_dates", "valid_avg_return_20d", "test_avg_return_20d", "selection_score", "target_hit_on_valid", "target_hit_on_test"))


@query(f"""
WITH {_GRID.format(part="year(date)::VARCHAR")}, f AS (SELECT formula, gate, top_n, count(*) AS folds, avg((avg_return_20d > 0)::INT) AS hit_rate, avg(avg_return_20d) AS avg_return_20d, avg(positive_20d_rate) AS positive_20d_rate, avg(stability_score) AS stability_score, avg(decision_dates) AS avg_decision_dates FROM grid GROUP BY 1, 2, 3 HAVING count(*) >= 4)
SELECT formula, gate, top_n, folds, round(hit_rate, 6) AS hit_rate, round(avg_return_20d, 6) AS avg_return_20d, round(avg_decision_dates, 6) AS avg_decision_dates, round(avg_return_20d + positive_20d_rate * 8 + coalesce(stability_score, -999) * 0.3 + hit_rate * 6, 6) AS selection_score FROM f
""")
def a_family_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = walkforward.families(_grid(spark, sf_dir, F.year("date").cast("string")))
    return rounded(out.select("formula", "gate", "top_n", "folds", "hit_rate", "avg_return_20d", "avg_decision_dates", "selection_score"))


_BLOCKS = f"""{DECISIONS}, k AS (SELECT time_block, date, code, return_20d, counter_score AS score, pool_excess_20d, row_number() OVER (PARTITION BY date ORDER BY counter_score DESC NULLS LAST, code) AS r, count(*) OVER (PARTITION BY date) AS n,
  {rank_sql('counter_score', 'date')} AS rx, {rank_sql('return_20d', 'date')} AS ry FROM d WHERE return_20d IS NOT NULL AND counter_score IS NOT NULL),
day AS (SELECT time_block, date, corr(rx, ry) AS ic, avg(return_20d) AS pool, avg(return_20d) FILTER (r <= ceil(0.1 * n)) AS top, avg(return_20d) FILTER (r > n - ceil(0.1 * n)) AS bottom, count(*) AS n_rows, count(*) FILTER (return_20d > 0) AS np, count(*) FILTER (return_20d <= -5) AS nl, count(*) FILTER (r <= ceil(0.1 * n) AND return_20d > 0) AS tp, count(*) FILTER (r <= ceil(0.1 * n)) AS nt FROM k GROUP BY 1, 2),
blk AS (SELECT time_block, count(*) AS n_dates, sum(n_rows)::BIGINT AS n_rows, avg(ic) AS mean_rank_ic, avg(ic) / nullif(stddev_samp(ic), 0) AS icir, avg((ic > 0)::INT) AS ic_positive_rate, avg(pool) AS base_return, sum(np) / sum(n_rows) AS base_pos, sum(nl) / sum(n_rows) AS loss_gt5_rate, avg(top - bottom) AS topk_bottomk_gross, avg(top - pool) AS pool_excess_gross, avg(top - pool) - 1.5 AS pool_excess_net, sum(tp) / sum(nt) AS top_precision, avg((top > 0)::INT) AS top_positive_rate FROM day GROUP BY 1),
cn AS (SELECT time_block, max(n) / sum(n) AS concentration FROM (SELECT time_block, code, count(*) AS n FROM k WHERE r <= ceil(0.1 * n) GROUP BY 1, 2) GROUP BY 1)"""


def _block_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("date")
    df = decisions(spark, sf_dir).where("return_20d is not null and counter_score is not null").select("time_block", "date", "code", "return_20d", F.col("counter_score").alias("score"))
    k = F.ceil(0.1 * F.count("*").over(w))
    rank = F.row_number().over(w.orderBy(F.desc("score"), "code"))
    marked = df.select("*", rank_pct("score", "date").alias("rx"), rank_pct("return_20d", "date").alias("ry"), (rank <= k).alias("in_top"), (rank > F.count("*").over(w) - k).alias("in_bottom"))
    r = F.col("return_20d")
    # how large a share of a block's picks its most frequent code has
    share = marked.where("in_top").groupBy("time_block", "code").count().groupBy("time_block").agg((F.max("count") / F.sum("count")).alias("concentration"))
    day = marked.groupBy("time_block", "date").agg(
        F.corr("rx", "ry").alias("ic"), F.avg(r).alias("pool"), F.avg(F.when(F.col("in_top"), r)).alias("top"), F.avg(F.when(F.col("in_bottom"), r)).alias("bottom"), F.count("*").alias("n_rows"),
        F.count_if(r > 0).alias("np"), F.count_if(r <= -5).alias("nl"), F.count_if(F.col("in_top") & (r > 0)).alias("tp"), F.count_if(F.col("in_top")).alias("nt"),
    )
    blocks = day.groupBy("time_block").agg(
        F.count("*").alias("n_dates"), F.sum("n_rows").alias("n_rows"), F.avg("ic").alias("mean_rank_ic"), (F.avg("ic") / F.nullif(F.stddev_samp("ic"), F.lit(0.0))).alias("icir"), F.avg((F.col("ic") > 0).cast("int")).alias("ic_positive_rate"),
        F.avg("pool").alias("base_return"), (F.sum("np") / F.sum("n_rows")).alias("base_pos"), (F.sum("nl") / F.sum("n_rows")).alias("loss_gt5_rate"), F.avg(F.col("top") - F.col("bottom")).alias("topk_bottomk_gross"),
        F.avg(F.col("top") - F.col("pool")).alias("pool_excess_gross"), (F.avg(F.col("top") - F.col("pool")) - 1.5).alias("pool_excess_net"), (F.sum("tp") / F.sum("nt")).alias("top_precision"), F.avg((F.col("top") > 0).cast("int")).alias("top_positive_rate"),
    )
    return blocks.join(share, "time_block", "left")


_METRICS = ["mean_rank_ic", "icir", "ic_positive_rate", "base_return", "base_pos", "loss_gt5_rate", "topk_bottomk_gross", "pool_excess_gross", "pool_excess_net", "top_precision", "top_positive_rate"]


@query(f"WITH {_BLOCKS} SELECT time_block, n_dates, n_rows, {', '.join(f'round({m}, 6) AS {m}' for m in _METRICS)} FROM blk")
def m_block_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_block_metrics(spark, sf_dir).drop("concentration"))


@query(f"""
WITH {_BLOCKS}, b AS (SELECT *, time_block = max(time_block) OVER () AS final FROM blk)
SELECT unnest(['all', 'without_final']) AS scope, unnest([count(*) FILTER (mean_rank_ic > 0), count(*) FILTER (mean_rank_ic > 0 AND NOT final)]) AS hit_blocks, unnest([count(*), count(*) FILTER (NOT final)]) AS total_blocks,
 {', '.join(f'round(unnest([avg({m}), avg({m}) FILTER (NOT final)]), 6) AS {m}' for m in _METRICS)} FROM b
""")
def a_oos_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over blocks, with and without the final one."""
    blocks = _block_metrics(spark, sf_dir)
    final = F.col("time_block") == F.max("time_block").over(Window.partitionBy(F.lit(1)))  # over a few blocks
    rows = blocks.withColumn("final", final).select("*", F.explode(F.array(F.lit("all"), F.when(~F.col("final"), F.lit("without_final")))).alias("scope")).where("scope is not null")
    return rounded(rows.groupBy("scope").agg(F.count_if(F.col("mean_rank_ic") > 0).alias("hit_blocks"), F.count("*").alias("total_blocks"), *(F.avg(m).alias(m) for m in _METRICS)))


@query(f"""
WITH {_BLOCKS}, b AS (SELECT *, row_number() OVER (ORDER BY time_block) AS i, count(*) OVER () AS n FROM blk),
s AS (SELECT t.time_block, t.pool_excess_net AS last_net, t.top_positive_rate AS last_pos, t.mean_rank_ic AS last_ic, (SELECT avg(p.pool_excess_net) FROM b p WHERE p.i < t.i) AS prior_net, (SELECT avg(p.top_positive_rate) FROM b p WHERE p.i < t.i) AS prior_pos, (SELECT avg(p.mean_rank_ic) FROM b p WHERE p.i < t.i) AS prior_ic, concentration FROM b t LEFT JOIN cn USING (time_block))
SELECT time_block, round(prior_net, 6) AS prior_net, round(last_net, 6) AS last_net, round(concentration, 6) AS concentration, CASE WHEN prior_net IS NULL OR last_net IS NULL THEN 'observe_insufficient_blocks'
 WHEN prior_net > 0 AND last_net > 0 AND prior_pos >= 0.6 AND last_pos >= 0.6 AND prior_ic >= 0.03 AND last_ic >= 0.03 AND coalesce(concentration <= 0.25, true) THEN 'accepted_cost_recheck_candidate' WHEN last_net > 0 AND last_pos >= 0.6 AND last_ic >= 0.03 THEN 'observe_latest_positive_prior_weak'
 WHEN prior_net > 0 AND prior_pos >= 0.6 AND prior_ic >= 0.03 THEN 'observe_prior_positive_latest_weak' ELSE 'rejected_or_diagnostic_only' END AS status FROM s
""")
def m_promotion_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each block: do the blocks before it and itself agree?"""
    past = Window.orderBy("time_block").rowsBetween(Window.unboundedPreceding, -1)  # over a few blocks
    own = _block_metrics(spark, sf_dir).select("time_block", F.col("pool_excess_net").alias("last_net"), F.col("top_positive_rate").alias("last_pos"), F.col("mean_rank_ic").alias("last_ic"), F.avg("pool_excess_net").over(past).alias("prior_net"), F.avg("top_positive_rate").over(past).alias("prior_pos"), F.avg("mean_rank_ic").over(past).alias("prior_ic"), "concentration")
    status = walkforward.turnover_status("prior_net", "last_net", "prior_pos", "last_pos", "prior_ic", "last_ic", "concentration")
    return rounded(own.select("time_block", "prior_net", "last_net", "concentration", status.alias("status")))


@query(f"""
WITH {DECISIONS}, m AS (SELECT *, CASE WHEN date > DATE '1998-06-15' THEN 'future_date' WHEN date + 28 > DATE '1998-06-15' THEN 'gt_pending' WHEN return_20d IS NOT NULL THEN 'evaluated' ELSE 'gt_pending' END AS status FROM d)
SELECT time_block, count(*) AS row_count, count(DISTINCT code) AS stock_count, min(date) AS first_date, max(date) AS last_date, count(*) FILTER (status = 'evaluated') AS evaluated_count, count(*) FILTER (status = 'gt_pending') AS gt_pending_count, count(*) FILTER (status = 'future_date') AS future_date_count, count(*) FILTER (status <> 'evaluated') > 0 AS is_provisional FROM m GROUP BY 1
""")
def a_maturity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walkforward.maturity(decisions(spark, sf_dir), F.lit("1998-06-15").cast("date"))


_REGIME = ["pool_avg_prior_return_20d", "pool_return_dispersion_20d", "pool_positive_breadth_20d"]


@query(f"""
WITH {DECISIONS}, {_DAYS}, q AS (SELECT quantile_cont(pool_avg_prior_return_20d, 0.35) AS weak, quantile_cont(pool_return_dispersion_20d, 0.65) AS vol, quantile_cont(pool_positive_breadth_20d, 0.5) AS breadth FROM days WHERE year(date) <= 1997),
f AS (SELECT date, coalesce(pool_avg_prior_return_20d, 0) <= weak AS weak_market, coalesce(pool_return_dispersion_20d, 0) >= vol AS high_vol, coalesce(pool_positive_breadth_20d, 0) >= breadth AS breadth_ok FROM days, q)
SELECT date, weak_market, high_vol, weak_market AND breadth_ok AND NOT high_vol AS repair_setup, weak_market AND high_vol AS low_signal FROM f
""")
def l_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regime flags of dates, by quantiles that are fitted on the first years."""
    days = walkforward.date_features(decisions(spark, sf_dir))
    spec = days.where(F.year("date") <= 1997).agg(*(F.percentile(f, F.lit(q)).alias(name) for f, q, name in zip(_REGIME, (0.35, 0.65, 0.5), ("weak", "vol", "breadth"))))  # one row
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    out = days.join(F.broadcast(spec)).select("date", (zero(_REGIME[0]) <= F.col("weak")).alias("weak_market"), (zero(_REGIME[1]) >= F.col("vol")).alias("high_vol"), (zero(_REGIME[2]) >= F.col("breadth")).alias("breadth_ok"))
    weak, vol = F.col("weak_market"), F.col("high_vol")
    return out.select("date", weak, vol, (weak & F.col("breadth_ok") & ~vol).alias("repair_setup"), (weak & vol).alias("low_signal"))


_CUTS = [0.5, 0.6, 0.7, 0.8, 0.9]


@query(f"""
WITH {DECISIONS}, q AS (SELECT unnest({_CUTS}) AS q, unnest(quantile_cont(counter_score, {_CUTS})) AS threshold FROM d WHERE year(date) <= 1997 AND return_20d IS NOT NULL),
m AS (SELECT q, threshold, count(*) AS n_rows, avg(return_20d) AS avg20, avg((return_20d > 0)::INT) AS pos FROM d, q WHERE year(date) BETWEEN 1998 AND 1999 AND return_20d IS NOT NULL AND counter_score >= threshold GROUP BY 1, 2 HAVING count(*) >= 80),
r AS (SELECT *, row_number() OVER (ORDER BY round(pos, 9) DESC, q) AS place FROM m)
SELECT q::DOUBLE AS q, round(threshold, 6) AS threshold, n_rows, round(avg20, 6) AS avg20, round(pos, 6) AS pos, place = 1 AS chosen FROM r
""")
def l_threshold_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantile thresholds of a score: fitted on the first years, chosen on the next, 80 rows at least."""
    df = decisions(spark, sf_dir).where("return_20d is not null")
    cuts = df.where(F.year("date") <= 1997).agg(F.percentile("counter_score", F.array(*map(F.lit, _CUTS))).alias("cuts"))  # one row
    table = cuts.select(F.explode(F.arrays_zip(F.array(*map(F.lit, _CUTS)).alias("q"), F.col("cuts").alias("threshold"))).alias("c")).select("c.*")
    valid = df.where(F.year("date").between(1998, 1999))
    both = valid.join(F.broadcast(table), F.col("counter_score") >= F.col("threshold")).groupBy("q", "threshold").agg(F.count("*").alias("n_rows"), F.avg("return_20d").alias("avg20"), F.avg((F.col("return_20d") > 0).cast("int")).alias("pos")).where("n_rows >= 80")
    place = F.row_number().over(Window.orderBy(F.desc(F.round("pos", 9)), "q"))  # over a few thresholds
    return rounded(both.withColumn("chosen", place == 1))


_KEYS = ["score_std", "score_gap", "tension", "pressure"]
_DAILY = f"""{DECISIONS}, s AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY counter_score DESC NULLS LAST, code) AS r, count(*) OVER (PARTITION BY date) AS n FROM d),
daily AS (SELECT date, time_block, count(*) AS candidate_rows, count(DISTINCT industry) AS industries, stddev_samp(relative_strength_rank * atr20_pct) AS score_std, quantile_cont(atr20_pct, 0.9) - quantile_cont(atr20_pct, 0.5) AS score_gap,
 avg(abs(prior_return_20d - kline_return_60d)) AS tension, avg(-drawdown60) AS pressure, avg((news_count_30d > 3)::INT) AS news_coverage_rate, stddev_samp(return_20d) AS future_return_std, quantile_cont(return_20d, 0.75) - quantile_cont(return_20d, 0.25) AS future_return_iqr,
 avg(return_20d) FILTER (r <= greatest(1, ceil(0.05 * n))) - avg(return_20d) AS top5_pool_excess, avg((return_20d > 0)::INT) FILTER (r <= greatest(1, ceil(0.05 * n))) AS top5_positive_rate FROM s GROUP BY 1, 2),
z AS (SELECT *, ({' + '.join(z_sql(f'coalesce({k}, 0)', 'time_block') for k in _KEYS)}) / 4 AS key_score FROM daily),
p AS (SELECT *, {rank_sql('round(key_score, 9)', 'time_block')} AS key_score_pct FROM z),
keyed AS (SELECT *, CASE WHEN key_score_pct >= 0.9 THEN 'key_top10' WHEN key_score_pct >= 0.8 THEN 'key_top20' WHEN key_score_pct >= 0.6 THEN 'watch_mid40' ELSE 'ordinary_bottom60' END AS sampler_bucket FROM p)"""


def _daily_keyness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a date: how far scores, returns and ranges spread, and what followed; its keyness is
    the mean z of the former within the block."""
    w = Window.partitionBy("date")
    top = F.row_number().over(w.orderBy(F.desc_nulls_last("counter_score"), "code")) <= F.greatest(F.lit(1), F.ceil(0.05 * F.count("*").over(w)))
    df = decisions(spark, sf_dir).withColumn("top", top)
    q = lambda c, p: F.percentile(c, F.lit(p))
    r = F.col("return_20d")
    daily = df.groupBy("date", "time_block").agg(
        F.count("*").alias("candidate_rows"), F.count_distinct("industry").alias("industries"), F.stddev_samp(F.col("relative_strength_rank") * F.col("atr20_pct")).alias("score_std"), (q("atr20_pct", 0.9) - q("atr20_pct", 0.5)).alias("score_gap"),
        F.avg(F.abs(F.col("prior_return_20d") - F.col("kline_return_60d"))).alias("tension"), F.avg(-F.col("drawdown60")).alias("pressure"), F.avg((F.col("news_count_30d") > 3).cast("int")).alias("news_coverage_rate"), F.stddev_samp(r).alias("future_return_std"),
        (q("return_20d", 0.75) - q("return_20d", 0.25)).alias("future_return_iqr"), (F.avg(F.when(F.col("top"), r)) - F.avg(r)).alias("top5_pool_excess"), F.avg(F.when(F.col("top"), (r > 0).cast("int"))).alias("top5_positive_rate"),
    )
    key = sum((zscore(F.coalesce(k, F.lit(0.0)), "time_block") for k in _KEYS), F.lit(0.0)) / 4
    out = daily.withColumn("key_score", key).withColumn("key_score_pct", rank_pct(F.round("key_score", 9), "time_block"))
    p = F.col("key_score_pct")
    return out.withColumn("sampler_bucket", F.when(p >= 0.9, "key_top10").when(p >= 0.8, "key_top20").when(p >= 0.6, "watch_mid40").otherwise("ordinary_bottom60"))


_SHOWN = ["candidate_rows", "industries", "sampler_bucket"]
_SHOWN_ROUNDED = ["score_std", "score_gap", "tension", "pressure", "news_coverage_rate", "future_return_std", "future_return_iqr", "top5_pool_excess", "top5_positive_rate", "key_score", "key_score_pct"]


@query(f"WITH {_DAILY} SELECT date, {', '.join(_SHOWN)}, {', '.join(f'round({c}, 6) AS {c}' for c in _SHOWN_ROUNDED)} FROM keyed")
def a_daily_keyness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_daily_keyness(spark, sf_dir).select("date", *_SHOWN, *_SHOWN_ROUNDED))


@query(f"""
WITH {_DAILY}, t AS (SELECT quantile_cont(future_return_std, 0.7) AS a, quantile_cont(abs(top5_pool_excess), 0.7) AS b FROM keyed),
h AS (SELECT *, coalesce(future_return_std >= a, false) OR coalesce(abs(top5_pool_excess) >= b, false) AS high FROM keyed, t),
g AS (SELECT sampler_bucket, count(*) AS dates, count(*) FILTER (high) AS high_impact_dates, avg(future_return_std) AS avg_future_return_std, avg(abs(top5_pool_excess)) AS avg_abs_excess FROM h GROUP BY 1)
SELECT sampler_bucket, dates, round(dates / sum(dates) OVER (), 6) AS date_share, high_impact_dates, round(high_impact_dates / greatest(1, sum(high_impact_dates) OVER ()), 6) AS capture_rate, round(high_impact_dates / dates, 6) AS precision, round(avg_future_return_std, 6) AS avg_future_return_std, round(avg_abs_excess, 6) AS avg_abs_excess FROM g
""")
def a_high_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the dates with much at stake the buckets catch. A row a date is few rows."""
    keyed = _daily_keyness(spark, sf_dir)
    cuts = F.broadcast(keyed.agg(F.percentile("future_return_std", F.lit(0.7)).alias("a"), F.percentile(F.abs("top5_pool_excess"), F.lit(0.7)).alias("b")))
    high = on(F.col("future_return_std") >= F.col("a")) | on(F.abs("top5_pool_excess") >= F.col("b"))
    g = keyed.join(cuts).groupBy("sampler_bucket").agg(F.count("*").alias("dates"), F.count_if(high).alias("high_impact_dates"), F.avg("future_return_std").alias("avg_future_return_std"), F.avg(F.abs("top5_pool_excess")).alias("avg_abs_excess"))
    w = Window.partitionBy(F.lit(1))  # over four buckets
    return rounded(g.withColumns({"date_share": F.col("dates") / F.sum("dates").over(w), "capture_rate": F.col("high_impact_dates") / F.greatest(F.lit(1), F.sum("high_impact_dates").over(w)), "precision": F.col("high_impact_dates") / F.col("dates")}))


@query(f"""
WITH {_BLOCKS}, s AS (SELECT unnest(['mean_rank_ic', 'pool_excess_net', 'top_precision']) AS metric, unnest([mean_rank_ic, pool_excess_net, top_precision]) AS x, unnest([ic_positive_rate, base_return, base_pos]) AS base FROM blk)
SELECT metric, count(x) AS panels, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS least, round(avg(x) - stddev_samp(x), 6) AS lower, round(avg(x) + stddev_samp(x), 6) AS upper, round(avg(x - base), 6) AS contrast, round(avg((x > base)::INT), 6) AS wins FROM s GROUP BY 1
""")
def m_panel_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, spread and least value of metrics over blocks, and their contrast with a baseline."""
    pairs = {"mean_rank_ic": "ic_positive_rate", "pool_excess_net": "base_return", "top_precision": "base_pos"}
    rows = _block_metrics(spark, sf_dir).select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("x"), F.col(b).alias("base")) for m, b in pairs.items()))).alias("s")).select("s.*")
    x, sd = F.avg("x"), F.stddev_samp("x")
    return rounded(rows.groupBy("metric").agg(F.count("x").alias("panels"), x.alias("mean"), sd.alias("std"), F.min("x").alias("least"), (x - sd).alias("lower"), (x + sd).alias("upper"), F.avg(F.col("x") - F.col("base")).alias("contrast"), F.avg((F.col("x") > F.col("base")).cast("int")).alias("wins")))


@query(f"""
WITH {DECISIONS}, n AS (SELECT date, industry, code, relative_strength_rank, counter_score, {z_sql('relative_strength_rank', 'date', 'area')} AS a, {z_sql('counter_score', 'date', 'area')} AS b FROM d)
SELECT code, date, round((a + b) / 2, 6) AS ensemble, round(0.7 * a + 0.3 * b, 6) AS tilted FROM n
""")
def x_group_ensembles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite scores that are standardized within the comparison group, here date and area."""
    a, b = zscore("relative_strength_rank", "date", "area"), zscore("counter_score", "date", "area")
    return rounded(decisions(spark, sf_dir).select("code", "date", ((a + b) / 2).alias("ensemble"), (0.7 * a + 0.3 * b).alias("tilted")))
