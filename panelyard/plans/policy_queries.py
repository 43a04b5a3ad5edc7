"""Queries of row-level policies, skill tokens, small joins and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelyard.functions.expr import rounded, share
from panelyard.operators import policy
from panelyard.operators.cross import top_n
from panelyard.plans.decisions import DECISIONS, SKILLS, decisions
from panelyard.sources.tables import stream_events, table

QUERIES, SQL = {}, {}
GAP = policy.GAP


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""
WITH {DECISIONS} SELECT code, date, relative_strength_rank >= 0.5 AS original,
 coalesce(prior_return_20d > 0, false) AND coalesce(relative_strength_rank >= 0.67, false) AND coalesce(close_above_ma200, false)
 AND {' AND '.join(f"list_contains(string_split(triggered_skills, ';'), '{s}')" for s in SKILLS)} AS adapted FROM d WHERE prior_return_20d IS NOT NULL
""")
def f_strategy_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = decisions(spark, sf_dir).where("prior_return_20d is not null")
    return df.select("code", "date", (F.col("relative_strength_rank") >= 0.5).alias("original"), policy.adapted_mask(SKILLS).alias("adapted"))


@query(f"""
WITH {DECISIONS} SELECT code, date, CASE WHEN coalesce(return_20d > 0, false) AND coalesce(pool_excess_20d, 0) >= 2 AND coalesce(pool_return_rank_pct, 0.5) >= 0.7 THEN 'positive_support'
 WHEN coalesce(return_20d <= -5, false) OR coalesce(pool_excess_20d, 0) <= -5 THEN 'hard_counter' WHEN data_gaps <> '' AND coalesce(return_20d >= -2, false) AND coalesce(pool_excess_20d, 0) >= -1.5 THEN 'soft_gap' ELSE 'neutral' END AS label FROM d
""")
def f_outcome_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(spark, sf_dir).select("code", "date", policy.outcome_label(F.col("data_gaps") != "").alias("label"))


_EDGES = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8, 1.0]


@query(f"""
WITH {DECISIONS} SELECT code, date, round(coalesce(relative_strength_rank, 0) + coalesce(counter_score, 0) * 0.08 + coalesce(close_above_ma200::INT, 0) * 0.25 + coalesce(news_count_30d, 0) * 0.03 + coalesce(peer_relative_to_group_20d, 0) * 0.05 - coalesce(news_risk_event_score_30d, 0) * 0.15, 6) AS default_score,
 round(coalesce(news_risk_event_score_30d, 0) * 0.5 + coalesce(atr20_pct, 0) * 0.08 - coalesce(drawdown60, 0) * 0.05 + coalesce(news_count_30d, 0) * 0.04 + 0.25 * (data_gaps <> '')::INT + 0.15 * (triggered_skills <> '')::INT, 6) AS need_score,
 CASE {' '.join(f"WHEN relative_strength_rank > {a} AND relative_strength_rank <= {b} THEN '({a}, {b}]'" for a, b in zip(_EDGES, _EDGES[1:]))} END AS rank_bin FROM d
""")
def f_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score presets, the need for a review, and labelled bins."""
    df = decisions(spark, sf_dir)
    return rounded(df.select("code", "date", policy.linear(policy.DEFAULT_PRESET).alias("default_score"), policy.need_score().alias("need_score"), policy.bins("relative_strength_rank", _EDGES).alias("rank_bin")))


def _parts(df: DataFrame) -> DataFrame:
    return df.withColumn("part", F.when(F.year("date") <= 1998, "train").otherwise("test"))


_TOKENS = f"""{DECISIONS}, tok AS (SELECT unnest(list_distinct(string_split(triggered_skills, ';'))) AS skill, CASE WHEN year(date) <= 1998 THEN 'train' ELSE 'test' END AS part, return_20d, gt_pass FROM d WHERE triggered_skills <> ''),
st AS (SELECT skill, part, count(*) AS trigger_count, avg(gt_pass::INT) AS gt_pass_rate, avg(return_20d) AS avg_return_20d, avg((return_20d > 0)::INT) AS positive_20d_rate FROM tok GROUP BY 1, 2)"""


@query(f"WITH {_TOKENS} SELECT skill, part, trigger_count, round(gt_pass_rate, 6) AS gt_pass_rate, round(avg_return_20d, 6) AS avg_return_20d, round(positive_20d_rate, 6) AS positive_20d_rate FROM st")
def a_skill_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(policy.skill_stats(_parts(decisions(spark, sf_dir)), "part"))


@query(f"""
WITH {_TOKENS}, w AS (SELECT skill, max(trigger_count) FILTER (part = 'train') AS train_trigger_count, max(trigger_count) FILTER (part = 'test') AS test_trigger_count, max(avg_return_20d) FILTER (part = 'train') AS train_avg_return_20d, max(avg_return_20d) FILTER (part = 'test') AS test_avg_return_20d FROM st GROUP BY 1)
SELECT skill, train_trigger_count, test_trigger_count, round(train_avg_return_20d, 6) AS train_avg_return_20d, round(test_avg_return_20d, 6) AS test_avg_return_20d,
 CASE WHEN coalesce(train_trigger_count, 0) < 30 THEN 'too_few_samples' WHEN coalesce(test_trigger_count, 0) < 10 THEN 'too_few_test_triggers' WHEN test_avg_return_20d * train_avg_return_20d < 0 THEN 'refuted_by_test' WHEN abs(test_avg_return_20d) >= 3 THEN 'candidate_for_review' ELSE 'weak_direction' END AS judgement FROM w
""")
def a_skill_judgement(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = policy.skill_stats(_parts(decisions(spark, sf_dir)), "part")
    wide = stats.groupBy("skill").agg(*(F.max(F.when(F.col("part") == p, F.col(c))).alias(f"{p}_{c}") for c in ("trigger_count", "avg_return_20d") for p in ("train", "test")))
    return rounded(wide.withColumn("judgement", policy.skill_judgement()))


@query(f"WITH {DECISIONS} SELECT industry, CASE WHEN year(date) <= 1998 THEN 'train' ELSE 'test' END AS part, count(*) AS n_rows, round(avg(gt_pass::INT), 6) AS gt_pass_rate, round(avg(return_20d), 6) AS avg_return_20d FROM d GROUP BY 1, 2")
def a_sector_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _parts(decisions(spark, sf_dir)).groupBy("industry", "part").agg(F.count("*").alias("n_rows"), F.avg(F.col("gt_pass").cast("int")).alias("gt_pass_rate"), F.avg("return_20d").alias("avg_return_20d"))
    return rounded(out)


_CARDS = [("PPS-Q-017", "momentum", 20), ("PPS-Q-019", "strength", 20), ("DOW-B-017", "trend", 60), ("NOT-USED-1", "trend", 5)]


@query(f"""
WITH {DECISIONS}, cards AS (SELECT * FROM (VALUES {', '.join(str(c) for c in _CARDS)}) t(skill, family, horizon)),
tok AS (SELECT unnest(list_distinct(string_split(triggered_skills, ';'))) AS skill, code, return_20d FROM d WHERE triggered_skills <> '')
SELECT skill, coalesce(family, 'no_card') AS family, horizon, count(*) AS n_rows, count(DISTINCT code) AS n_codes, round(avg(return_20d), 6) AS avg_return_20d FROM tok LEFT JOIN cards USING (skill) GROUP BY 1, 2, 3
""")
def j_strategy_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skill tokens with their strategy cards; tokens without a card stay."""
    cards = spark.createDataFrame(_CARDS, "skill string, family string, horizon int")
    tokens = decisions(spark, sf_dir).select("code", "return_20d", F.explode(F.array_distinct(F.filter(F.split("triggered_skills", ";"), lambda t: t != ""))).alias("skill"))
    both = tokens.join(F.broadcast(cards), "skill", "left").withColumn("family", F.coalesce("family", F.lit("no_card")))
    return rounded(both.groupBy("skill", "family", "horizon").agg(F.count("*").alias("n_rows"), F.count_distinct("code").alias("n_codes"), F.avg("return_20d").alias("avg_return_20d")))


@query(f"""
WITH {DECISIONS}, s AS (SELECT unnest(['original', 'adapted']) AS strategy, unnest([coalesce(relative_strength_rank >= 0.5, false), coalesce(prior_return_20d > 0 AND relative_strength_rank >= 0.67 AND close_above_ma200, false){''.join(f" AND contains(';' || triggered_skills || ';', ';{s};')" for s in SKILLS)}]) AS hit, return_20d, gt_pass FROM d),
a AS (SELECT strategy, count(*) AS n, avg(return_20d) AS r, avg(gt_pass::INT) AS p FROM s WHERE hit GROUP BY 1)
SELECT strategy, n AS n_rows, round(r, 6) AS avg_return_20d, round(p, 6) AS gt_pass_rate, round(r - max(r) FILTER (strategy = 'original') OVER (), 6) AS return_delta, round(p - max(p) FILTER (strategy = 'original') OVER (), 6) AS pass_delta FROM a
""")
def a_strategy_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = decisions(spark, sf_dir)
    names = F.array_compact(F.array(F.when(F.col("relative_strength_rank") >= 0.5, F.lit("original")), F.when(policy.adapted_mask(SKILLS), F.lit("adapted"))))
    per = df.select("return_20d", "gt_pass", F.explode(names).alias("strategy")).groupBy("strategy").agg(F.count("*").alias("n_rows"), F.avg("return_20d").alias("avg_return_20d"), F.avg(F.col("gt_pass").cast("int")).alias("gt_pass_rate"))
    base = F.broadcast(per.where("strategy = 'original'").select(F.col("avg_return_20d").alias("r0"), F.col("gt_pass_rate").alias("p0")))  # one row
    return rounded(per.join(base).select("strategy", "n_rows", "avg_return_20d", "gt_pass_rate", (F.col("avg_return_20d") - F.col("r0")).alias("return_delta"), (F.col("gt_pass_rate") - F.col("p0")).alias("pass_delta")))


@query(f"""
WITH {DECISIONS}, l AS (SELECT unnest(['news_count_30d', 'news_risk_event_score_30d', 'counter_score']) AS feature, unnest([news_count_30d, news_risk_event_score_30d, counter_score]) AS x, return_20d FROM d)
SELECT feature, count(*) AS n_rows, round(avg(coalesce(x > 0, false)::INT), 6) AS coverage, round(avg(return_20d) FILTER (x > 0), 6) AS active_mean, round(avg(return_20d) FILTER (NOT coalesce(x > 0, false)), 6) AS inactive_mean,
 round(avg(return_20d) FILTER (x > 0) - avg(return_20d) FILTER (NOT coalesce(x > 0, false)), 6) AS delta FROM l GROUP BY 1
""")
def a_active_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["news_count_30d", "news_risk_event_score_30d", "counter_score"]
    rows = decisions(spark, sf_dir).select("return_20d", *names).unpivot("return_20d", names, "feature", "x")
    active = F.coalesce(F.col("x") > 0, F.lit(False))
    one, two = F.avg(F.when(active, F.col("return_20d"))), F.avg(F.when(~active, F.col("return_20d")))
    return rounded(rows.groupBy("feature").agg(F.count("*").alias("n_rows"), share(active).alias("coverage"), one.alias("active_mean"), two.alias("inactive_mean"), (one - two).alias("delta")))


@query(f"""
WITH {DECISIONS}, w AS (SELECT *, CASE WHEN relative_strength_rank >= 0.9 THEN 1.0 WHEN relative_strength_rank >= 0.7 THEN 0.6 WHEN relative_strength_rank >= 0.5 THEN 0.25 ELSE 0.0 END AS w FROM d WHERE return_20d IS NOT NULL),
c AS (SELECT time_block, w, return_20d, w * return_20d + (1 - w) * (pow(1.03, 20.0 / 252) - 1) * 100 AS adjusted FROM w),
a AS (SELECT time_block, count(*) AS n_rows, avg((w > 0)::INT) AS active_rate, avg(w) AS exposure, sum(w * return_20d) / nullif(sum(w), 0) AS invested, avg(adjusted) AS cash_adjusted, avg(return_20d) AS hold, avg(adjusted) - avg(return_20d) AS excess_vs_hold FROM c GROUP BY 1)
SELECT time_block, n_rows, round(active_rate, 6) AS active_rate, round(exposure, 6) AS exposure, round(invested, 6) AS invested, round(cash_adjusted, 6) AS cash_adjusted, round(hold, 6) AS hold, round(excess_vs_hold, 6) AS excess_vs_hold,
 CASE WHEN exposure < 0.15 THEN true WHEN exposure >= 0.30 THEN false WHEN invested IS NULL THEN cash_adjusted > 0 ELSE cash_adjusted > invested + 0.25 END AS defensive_not_alpha FROM a
""")
def a_policy_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cash-adjusted returns of weights, by block, against holding; and whether that is alpha."""
    r = F.col("relative_strength_rank")
    df = decisions(spark, sf_dir).where("return_20d is not null").withColumn("w", F.when(r >= 0.9, 1.0).when(r >= 0.7, 0.6).when(r >= 0.5, 0.25).otherwise(0.0))
    cash = (1.03 ** (20 / 252) - 1) * 100
    adjusted = F.col("w") * F.col("return_20d") + (1 - F.col("w")) * cash
    out = df.withColumn("adjusted", adjusted).groupBy("time_block").agg(
        F.count("*").alias("n_rows"), F.avg((F.col("w") > 0).cast("int")).alias("active_rate"), F.avg("w").alias("exposure"), (F.sum(F.col("w") * F.col("return_20d")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("invested"), F.avg("adjusted").alias("cash_adjusted"), F.avg("return_20d").alias("hold"), (F.avg("adjusted") - F.avg("return_20d")).alias("excess_vs_hold")
    )
    return rounded(out.withColumn("defensive_not_alpha", policy.defensive_not_alpha("exposure", "invested", "cash_adjusted")))


@query(f"""
WITH {DECISIONS}, r AS (SELECT code, date, 1 - news_risk_event_score_30d * 2 AS net, area FROM d)
SELECT code, date, round(net, 6) AS net, round(coalesce((sum(net) OVER w - net) / nullif(count(*) OVER w - 1, 0), 0), 6) AS region_background FROM r WINDOW w AS (PARTITION BY date, area)
""")
def x_region_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelyard.functions.expr import others_mean

    df = decisions(spark, sf_dir).withColumn("net", 1 - F.col("news_risk_event_score_30d") * 2)
    return rounded(df.select("code", "date", "net", others_mean("net", "date", "area", rows=True).alias("region_background")))


@query("""
WITH e AS (SELECT user_id AS code, event_type AS title, date_trunc('hour', ts) AS seen_at, event_id % 3 AS provider, event_id, value FROM events)
SELECT code, title, CAST(seen_at AS TIMESTAMP) AS seen_at, provider, min(event_id) AS event_id, min_by(value, event_id) AS value, count(*) AS n_copies FROM e GROUP BY 1, 2, 3, 4
""")
def s_event_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of several sources, one for each code, title, time and provider: the first id."""
    rows = stream_events(spark, sf_dir).select("code", F.col("event_type").alias("title"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("seen_at"), (F.col("event_id") % 3).alias("provider"), "event_id", "value")
    return rows.groupBy("code", "title", "seen_at", "provider").agg(F.min("event_id").alias("event_id"), F.min_by("value", "event_id").alias("value"), F.count("*").alias("n_copies"))


@query(f"""
WITH {DECISIONS}, r AS (SELECT code, date, counter_score, greatest(5, ceil(0.1 * count(*) OVER (PARTITION BY date))) AS k, row_number() OVER (PARTITION BY date ORDER BY counter_score DESC NULLS LAST, code) AS top, row_number() OVER (PARTITION BY date ORDER BY counter_score NULLS LAST, code) AS bottom FROM d)
SELECT code, date, top, bottom, top <= k AS in_top, bottom <= k AS in_bottom FROM r WHERE top <= k OR bottom <= k
""")
def s_top_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("date")
    k = F.greatest(F.lit(5), F.ceil(0.1 * F.count("*").over(w)))
    row = lambda c: F.row_number().over(w.orderBy(c, "code"))
    df = decisions(spark, sf_dir).select("code", "date", k.alias("k"), row(F.desc_nulls_last("counter_score")).alias("top"), row(F.asc_nulls_last("counter_score")).alias("bottom"))
    return df.select("code", "date", "top", "bottom", (F.col("top") <= F.col("k")).alias("in_top"), (F.col("bottom") <= F.col("k")).alias("in_bottom")).where("in_top or in_bottom")


_SEEDS = [11, 23, 37]


@query(f"""
WITH {DECISIONS}, s AS (SELECT code, date, industry, area, seed, crc32 FROM (SELECT code, date, industry, area, unnest({_SEEDS}) AS seed FROM d WHERE return_20d IS NOT NULL),
 LATERAL (SELECT (code * 7919 + seed * 104729 + CAST(epoch(date) / 86400 AS BIGINT) * 31) % 1000003 AS crc32)),
g AS (SELECT *, row_number() OVER (PARTITION BY date, industry, seed ORDER BY crc32, code) AS i, row_number() OVER (PARTITION BY date, area, seed ORDER BY crc32, code) AS j FROM s)
SELECT 'same_sector' AS scenario, industry AS pool, date, seed, code, i AS place FROM g WHERE i <= 3 UNION ALL SELECT 'cross_sector', area, date, seed, code, j FROM g WHERE j <= 3
""")
def s_candidate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate groups of three for each date, pool and seed, drawn by a hash."""
    mix = (F.col("code") * 7919 + F.col("seed") * 104729 + F.unix_date("date") * 31) % 1000003
    rows = decisions(spark, sf_dir).where("return_20d is not null").select("code", "date", "industry", "area", F.explode(F.array(*map(F.lit, _SEEDS))).alias("seed")).withColumn("mix", mix)
    place = lambda pool: F.row_number().over(Window.partitionBy("date", pool, "seed").orderBy("mix", "code")).alias("place")
    parts = [rows.select(F.lit(name).alias("scenario"), F.col(pool).alias("pool"), "date", "seed", "code", place(pool)).where("place <= 3") for name, pool in (("same_sector", "industry"), ("cross_sector", "area"))]
    return parts[0].union(parts[1])


@query("""
WITH u AS (SELECT s_suppkey AS code, s_nationkey AS bucket, md5(s_suppkey::VARCHAR || ':7') AS h FROM supplier), r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY h, code) AS i, count(*) OVER (PARTITION BY bucket) AS n FROM u)
SELECT code, bucket, CASE WHEN i <= greatest(1, floor(0.3 * n)) THEN 'test' ELSE 'train' END AS part FROM r
""")
def s_hashed_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reproducible split within buckets, by a hash of the code."""
    w = Window.partitionBy("bucket")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_nationkey").alias("bucket"), F.md5(F.concat(F.col("s_suppkey").cast("string"), F.lit(":7"))).alias("h"))
    cut = F.greatest(F.lit(1), F.floor(0.3 * F.count("*").over(w)))
    return rows.select("code", "bucket", F.when(F.row_number().over(w.orderBy("h", "code")) <= cut, "test").otherwise("train").alias("part"))


@query(f"""
WITH {DECISIONS}, e AS (SELECT user_id AS code, count(*) AS n_events, max(value) AS volume FROM events GROUP BY 1) SELECT d.code, d.date, d.volume, e.n_events FROM d LEFT JOIN e USING (code)
""")
def j_new_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left join that takes only columns the left side lacks: volume stays its own."""
    left = decisions(spark, sf_dir).select("code", "date", "volume")
    right = stream_events(spark, sf_dir).groupBy("code").agg(F.count("*").alias("n_events"), F.max("value").alias("volume"))
    new = [c for c in right.columns if c not in left.columns]
    return left.join(right.select("code", *new), "code", "left")


@query(f"""
WITH {DECISIONS}, v AS (SELECT code, date, relative_strength_rank AS treated, counter_score / 10 AS control FROM d WHERE relative_strength_rank IS NOT NULL AND counter_score IS NOT NULL)
SELECT date, count(*) AS n_pairs, round(avg(treated - control), 6) AS mean_difference, round(avg((treated > control)::INT), 6) AS win_rate FROM v GROUP BY 1
""")
def j_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Treatment and control of the same keys, as one pivot instead of a self join."""
    df = decisions(spark, sf_dir)
    rows = df.select("code", "date", F.explode(F.array(F.struct(F.lit("treated").alias("variant"), F.col("relative_strength_rank").alias("x")), F.struct(F.lit("control").alias("variant"), (F.col("counter_score") / 10).alias("x")))).alias("v")).select("code", "date", "v.*")
    pairs = rows.groupBy("code", "date").agg(*(F.max(F.when(F.col("variant") == v, F.col("x"))).alias(v) for v in ("treated", "control"))).dropna(subset=["treated", "control"])
    return rounded(pairs.groupBy("date").agg(F.count("*").alias("n_pairs"), F.avg(F.col("treated") - F.col("control")).alias("mean_difference"), F.avg((F.col("treated") > F.col("control")).cast("int")).alias("win_rate")))


@query(f"""
WITH {DECISIONS}, e AS (SELECT DISTINCT user_id AS code, date_trunc('month', ts)::DATE AS date FROM events),
j AS (SELECT d.*, CASE WHEN e.code IS NOT NULL THEN 'matched' WHEN EXISTS (SELECT 1 FROM events x WHERE x.user_id = d.code) THEN 'no_event_in_window' ELSE 'code_without_events' END AS status FROM d LEFT JOIN e USING (code, date))
SELECT status, count(*) AS n_rows, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(avg((data_gaps = '')::INT), 6) AS financial_coverage, round(avg((peer_relative_to_group_20d IS NOT NULL)::INT), 6) AS peer_coverage, round(avg((triggered_skills <> '')::INT), 6) AS skill_coverage FROM j GROUP BY 1
""")
def q_join_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of a join and, for each, how far the channels are filled."""
    seen = stream_events(spark, sf_dir).select("code", F.trunc("ts", "month").alias("date")).distinct()
    months, codes = seen.withColumn("month", F.lit(True)), seen.select("code").distinct().withColumn("known", F.lit(True))
    both = decisions(spark, sf_dir).join(months, ["code", "date"], "left").join(codes, "code", "left")
    status = F.when(F.col("month"), "matched").when(F.col("known"), "no_event_in_window").otherwise("code_without_events")
    out = both.groupBy(status.alias("status")).agg(F.count("*").alias("n_rows"), share(F.col("data_gaps") == "").alias("financial_coverage"), share(F.col("peer_relative_to_group_20d").isNotNull()).alias("peer_coverage"), share(F.col("triggered_skills") != "").alias("skill_coverage"))
    whole = F.sum("n_rows").over(Window.partitionBy(F.lit(1)))  # over a few statuses
    return rounded(out.withColumn("share", F.col("n_rows") / whole))


@query("""
WITH a AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value, event_type FROM events),
v AS (SELECT event_id, unnest([CASE WHEN k IS NULL THEN 'k:missing' WHEN k NOT BETWEEN 0 AND 50 THEN 'k:range' END, CASE WHEN value IS NULL THEN 'value:missing' WHEN value < 0 OR value > 80 THEN 'value:range' END, CASE WHEN event_type NOT IN ('signup', 'purchase', 'view', 'click') THEN 'event_type:unknown' END]) AS violation FROM a)
SELECT violation, count(*) AS n_rows, min(event_id) AS first_id FROM v WHERE violation IS NOT NULL GROUP BY 1
""")
def q_answer_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers out of range, missing or unknown, counted by kind."""
    k, value = F.col("k"), F.col("value")
    checks = [F.when(k.isNull(), "k:missing").when(~k.between(0, 50), "k:range"), F.when(value.isNull(), "value:missing").when((value < 0) | (value > 80), "value:range"), F.when(~F.col("event_type").isin("signup", "purchase", "view", "click"), "event_type:unknown")]
    rows = stream_events(spark, sf_dir).select("event_id", F.explode(F.array_compact(F.array(*checks))).alias("violation"))
    return rows.groupBy("violation").agg(F.count("*").alias("n_rows"), F.min("event_id").alias("first_id"))


@query(f"""
WITH {DECISIONS}, r AS (SELECT code, date, concat_ws('+', CASE WHEN abs(prior_return_20d) >= 30 THEN 'price_move' END, CASE WHEN drawdown60 <= -30 THEN 'drawdown' END, CASE WHEN news_count_30d >= 12 THEN 'busy' END) AS reasons FROM d)
SELECT code, date, reasons, row_number() OVER (PARTITION BY code ORDER BY date) AS place FROM r WHERE reasons <> ''
""")
def st_decision_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision points where a threshold is met, with the reasons; numbered for each code."""
    from panelyard.functions.expr import named

    reasons = named({"price_move": F.abs("prior_return_20d") >= 30, "drawdown": F.col("drawdown60") <= -30, "busy": F.col("news_count_30d") >= 12})
    rows = decisions(spark, sf_dir).select("code", "date", reasons.alias("reasons")).where("reasons <> ''")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("code").orderBy("date")))


@query(f"""
WITH {DECISIONS}, m AS (SELECT date, count(*) AS n, max(return_20d) - min(return_20d) AS spread FROM d WHERE return_20d IS NOT NULL GROUP BY 1), t AS (SELECT date, code, return_20d, row_number() OVER (PARTITION BY date ORDER BY counter_score DESC NULLS LAST, code) AS rank FROM d)
SELECT a.date, a.code AS top1, b.code AS top2, round(a.return_20d - b.return_20d, 6) AS edge FROM t a JOIN t b ON a.date = b.date AND a.rank = 1 AND b.rank = 2
""")
def m_top2_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = top_n(decisions(spark, sf_dir), "counter_score", 2, "date")
    wide = best.groupBy("date").agg(*(F.max(F.when(F.col("rank") == i, F.col(c))).alias(f"{c}{i}") for i in (1, 2) for c in ("code", "return_20d"))).where("code2 is not null")
    return rounded(wide.select("date", F.col("code1").alias("top1"), F.col("code2").alias("top2"), (F.col("return_20d1") - F.col("return_20d2")).alias("edge")))
