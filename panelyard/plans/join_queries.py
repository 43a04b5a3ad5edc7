"""Queries over joins, roll-ups, rules and selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.functions.expr import number, rank_pct, rounded, safe_div
from panelyard.operators import asof, calendar, cross, picking, rules
from panelyard.plans.sql import BARS, EVENTS, PANEL
from panelyard.plans.sql import rank_pct as rank_sql
from panelyard.sources.tables import bars, panel, stream_events, table, universe

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' purchase days as decisions."""
    return stream_events(spark, sf_dir).where("event_type = 'purchase'").select("code", F.col("event_date").alias("date")).distinct()


@query(f"""
WITH {EVENTS}, q AS (SELECT code, event_id, ts AS at FROM ev WHERE event_type = 'purchase'), v AS (SELECT code, ts AS known, max(value) AS value FROM ev WHERE event_type = 'view' GROUP BY 1, 2)
SELECT q.code, q.event_id, q.at, v.known, round(v.value, 6) AS value FROM q ASOF LEFT JOIN v ON q.code = v.code AND q.at >= v.known
""")
def j_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's latest view at each purchase."""
    ev = stream_events(spark, sf_dir)
    left = ev.where("event_type = 'purchase'").select("code", "event_id", F.col("ts").alias("at"))
    right = ev.where("event_type = 'view'").groupBy("code", F.col("ts").alias("known")).agg(F.max("value").alias("value"))
    return rounded(asof.asof(left, right))


def _window_sql(days: int) -> str:
    return f"""
WITH {EVENTS}, d AS (SELECT DISTINCT code, event_date AS date FROM ev WHERE event_type = 'purchase'), e AS (SELECT code, event_date, ts AS available_at, event_type, k FROM ev WHERE event_type <> 'purchase'),
s AS (SELECT d.code, d.date, count(*) AS n_events, sum(k) AS total_k, max(k) AS max_k, array_to_string(list_sort(list(DISTINCT event_type)), '+') AS types FROM d JOIN e ON e.code = d.code AND e.event_date BETWEEN d.date - {days} AND d.date AND e.available_at <= d.date + INTERVAL 15 HOUR GROUP BY 1, 2)
SELECT d.code, d.date, coalesce(n_events, 0) AS n_events, total_k::BIGINT AS total_k, max_k, types,
  CASE WHEN d.code NOT IN (SELECT code FROM e) THEN 'code_not_in_feature_table' WHEN s.code IS NULL THEN 'no_event_in_window' ELSE 'event_window_matched' END AS join_status
FROM d LEFT JOIN s USING (code, date)"""


@query(_window_sql(7))
def j_event_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was known of a user's other events of the last week at 15:00 on each purchase day."""
    ev = stream_events(spark, sf_dir).where("event_type <> 'purchase'").select("code", "event_date", F.col("ts").alias("available_at"), "event_type", "k")
    out = asof.windowed(_decisions(spark, sf_dir), ev, 7, {"n_events": F.count("*"), "total_k": F.sum("k"), "max_k": F.max("k"), "types": F.concat_ws("+", F.array_sort(F.collect_set("event_type")))})
    return out.select("code", "date", F.coalesce("n_events", F.lit(0)).alias("n_events"), "total_k", "max_k", "types", "join_status")


@query(f"""
WITH {EVENTS}, d AS (SELECT DISTINCT code, event_date AS date FROM ev WHERE event_type = 'purchase'), w AS (SELECT unnest([1, 7, 14]) AS days),
e AS (SELECT code, event_date, ts FROM ev WHERE event_type = 'error'),
m AS (SELECT days, d.code, d.date, count(e.ts) AS n FROM d CROSS JOIN w LEFT JOIN e ON e.code = d.code AND e.event_date BETWEEN d.date - days AND d.date AND e.ts <= d.date + INTERVAL 15 HOUR GROUP BY 1, 2, 3)
SELECT days, count(*) AS n_decisions, count(*) FILTER (n > 0) AS n_matched, round(avg(n), 6) AS mean_events FROM m GROUP BY 1
""")
def j_window_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match rates of several window lengths from one join over the longest."""
    d, lengths = _decisions(spark, sf_dir), (1, 7, 14)
    ev = stream_events(spark, sf_dir).where("event_type = 'error'").select("code", "event_date", F.col("ts").alias("available_at"))
    out = asof.windowed(d, ev, max(lengths), {f"n{k}": F.count_if(F.datediff("date", "event_date") <= k) for k in lengths})
    long = out.select(F.stack(F.lit(len(lengths)), *(x for k in lengths for x in (F.lit(k), F.coalesce(F.col(f"n{k}"), F.lit(0))))).alias("days", "n"))
    return rounded(long.groupBy("days").agg(F.count("*").alias("n_decisions"), F.count_if(F.col("n") > 0).alias("n_matched"), F.avg("n").alias("mean_events")))


@query("""
WITH o AS (SELECT o_custkey AS code, CAST(o_orderdate AS DATE) AS event_date, date_trunc('day', o_orderdate) + INTERVAL 1 DAY AS available_at, o_totalprice AS v FROM orders),
d AS (SELECT DISTINCT o_custkey AS code, CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderpriority = '1-URGENT'),
s AS (SELECT d.code, d.date, count(*) AS n, sum(CAST(v AS DECIMAL(18,4)))::DOUBLE AS total, max_by(event_date, (available_at, event_date)) AS latest FROM d JOIN o ON o.code = d.code AND o.event_date BETWEEN d.date - 90 AND d.date AND available_at <= d.date + INTERVAL 15 HOUR GROUP BY 1, 2)
SELECT d.code, d.date, coalesce(n, 0) AS n, round(total, 4) AS total, latest, CASE WHEN s.code IS NULL THEN 'no_event_in_window' ELSE 'event_window_matched' END AS join_status FROM d LEFT JOIN s USING (code, date)
""")
def j_financial_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders of the last 90 days, known from the day after, at each urgent order."""
    orders = table(spark, sf_dir, "orders").withColumns({"code": F.col("o_custkey"), "event_date": F.to_date("o_orderdate")})
    known = orders.select("code", "event_date", asof.available(F.col("o_orderdate"), "next_day").alias("available_at"), F.col("o_totalprice").cast("decimal(18,4)").alias("v"))
    d = orders.where("o_orderpriority = '1-URGENT'").select("code", F.col("event_date").alias("date")).distinct()
    out = asof.windowed(d, known, 90, {"n": F.count("*"), "total": F.sum("v").cast("double"), "latest": F.max_by("event_date", F.struct("available_at", "event_date"))})
    return rounded(out.select("code", "date", F.coalesce("n", F.lit(0)).alias("n"), "total", "latest", "join_status"), 4)


@query("""
SELECT c_custkey, c_mktsegment, coalesce(n_name, 'unknown') AS nation, coalesce(r_name, 'unknown') AS region, count(o_orderkey) AS n_orders, round(sum(CAST(o_totalprice AS DECIMAL(18,4)))::DOUBLE, 4) AS total
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4
""")
def j_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimension joins with unknown filled in; orders are summed before they are joined."""
    per = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,4)")).cast("double").alias("total"))
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    out = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(per, "c_custkey", "left")
    return rounded(out.select("c_custkey", "c_mktsegment", F.coalesce("n_name", F.lit("unknown")).alias("nation"), F.coalesce("r_name", F.lit("unknown")).alias("region"), F.coalesce("n", F.lit(0)).alias("n_orders"), "total"), 4)


@query("""
WITH a AS (SELECT user_id AS code, count(*) AS n_buy FROM events WHERE event_type = 'purchase' GROUP BY 1), b AS (SELECT user_id AS code, count(*) AS n_error FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT coalesce(a.code, b.code) AS code, n_buy, n_error, CASE WHEN a.code IS NULL THEN 'right' WHEN b.code IS NULL THEN 'left' ELSE 'both' END AS side FROM a FULL JOIN b ON a.code = b.code
""")
def j_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = stream_events(spark, sf_dir)
    count = lambda t, name: ev.where(F.col("event_type") == t).groupBy("code").agg(F.count("*").alias(name))
    out = count("purchase", "n_buy").join(count("error", "n_error"), "code", "full")
    return out.withColumn("side", F.when(F.col("n_buy").isNull(), "right").when(F.col("n_error").isNull(), "left").otherwise("both"))


@query("""
SELECT s_suppkey, s_name, EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_quantity >= 49) AS is_key, NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_discount >= 0.1) AS never_deep FROM supplier
""")
def j_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key-set flags by semi and anti joins."""
    sup, li = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem")
    key = li.where("l_returnflag = 'R' and l_quantity >= 49").select(F.col("l_suppkey").alias("s_suppkey")).distinct().withColumn("k", F.lit(True))
    deep = li.where("l_discount >= 0.1").select(F.col("l_suppkey").alias("s_suppkey")).distinct()
    never = sup.join(deep, "s_suppkey", "left_anti").select("s_suppkey", F.lit(True).alias("a"))
    return sup.join(key, "s_suppkey", "left").join(never, "s_suppkey", "left").select("s_suppkey", "s_name", F.col("k").isNotNull().alias("is_key"), F.col("a").isNotNull().alias("never_deep"))


@query(f"""
WITH {PANEL}, b AS (SELECT * FROM (VALUES ('early', DATE '1995-01-01', DATE '1996-12-31'), ('middle', DATE '1997-01-01', DATE '1998-12-31'), ('late', DATE '1999-01-01', DATE '2001-12-31')) t(block, lo, hi)),
m AS (SELECT block, area, avg(fwd) AS m, count(fwd) AS n FROM panel JOIN b ON date BETWEEN lo AND hi GROUP BY 1, 2)
SELECT area, max(m.n) FILTER (block = 'late')::BIGINT AS n_late, round(max(m) FILTER (block = 'early'), 6) AS early, round(max(m) FILTER (block = 'middle'), 6) AS middle, round(max(m) FILTER (block = 'late'), 6) AS late, round(max(m) FILTER (block = 'late') - max(m) FILTER (block = 'early'), 6) AS delta FROM m GROUP BY area
""")
def j_blocks_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range join to three named blocks, pivoted to paired contrasts."""
    spans = [("early", "1995-01-01", "1996-12-31"), ("middle", "1997-01-01", "1998-12-31"), ("late", "1999-01-01", "2001-12-31")]
    block = F.coalesce(*(F.when(F.col("date").between(F.to_date(F.lit(a)), F.to_date(F.lit(b))), k) for k, a, b in spans))
    wide = panel(spark, sf_dir).withColumn("block", block).groupBy("area").pivot("block", [k for k, _, _ in spans]).agg(F.avg("fwd").alias("m"), F.count("fwd").alias("n"))
    return rounded(wide.select("area", F.col("late_n").alias("n_late"), F.col("early_m").alias("early"), F.col("middle_m").alias("middle"), F.col("late_m").alias("late"), (F.col("late_m") - F.col("early_m")).alias("delta")))


@query(f"""
WITH {EVENTS}
SELECT code, event_date, count(*) AS n_events, round(ln(1 + count(*)), 6) AS intensity, max(k) AS max_k, round(avg(k), 6) AS mean_k, array_to_string(list_slice(list_sort(list(DISTINCT event_type)), 1, 4), '+') AS types, max(ts) AS latest,
 sum((event_type = 'purchase')::INT)::BIGINT AS gains, sum((event_type = 'error')::INT)::BIGINT AS risks, least(sum((event_type = 'purchase')::INT), sum((event_type = 'error')::INT))::BIGINT AS conflict FROM ev GROUP BY 1, 2
""")
def a_event_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    gain, risk = F.count_if(F.col("event_type") == "purchase"), F.count_if(F.col("event_type") == "error")
    out = stream_events(spark, sf_dir).groupBy("code", "event_date").agg(F.count("*").alias("n_events"), F.log1p(F.count("*")).alias("intensity"), F.max("k").alias("max_k"), F.avg("k").alias("mean_k"), F.concat_ws("+", F.slice(F.array_sort(F.collect_set("event_type")), 1, 4)).alias("types"), F.max("ts").alias("latest"), gain.alias("gains"), risk.alias("risks"), F.least(gain, risk).alias("conflict"))
    return rounded(out)


_BUCKETS = ("view", "click", "purchase", "error", "signup")


@query(f"""
WITH {EVENTS}, d AS (SELECT code, max(event_date) AS date FROM ev GROUP BY code), j AS (SELECT d.code, d.date, e.*, d.date - e.event_date AS age, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS sign FROM d JOIN ev e ON e.code = d.code WHERE e.event_date >= d.date - 30)
SELECT code, date, count(*) AS n, {', '.join(f"count(*) FILTER (event_type = '{t}') AS n_{t}, max(k) FILTER (event_type = '{t}') AS max_{t}" for t in _BUCKETS)}, {', '.join(f"count(*) FILTER (age <= {a}) AS n_{a}d" for a in (1, 3, 7))},
 round(sum(k * sign / (1 + age / 7.0)), 6) AS recent_signed, count(DISTINCT event_type) AS n_types
FROM (SELECT code, date, event_type, k, age, sign FROM j) GROUP BY 1, 2
""")
def a_event_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector per user from one pass: counts and maxima by type and age, recency-weighted sum."""
    ev = stream_events(spark, sf_dir)
    last = ev.groupBy("code").agg(F.max("event_date").alias("date"))
    j = ev.join(last, "code").withColumn("age", F.datediff("date", "event_date")).where("age <= 30")
    sign = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    of = lambda t: F.col("event_type") == t
    return rounded(j.groupBy("code", "date").agg(F.count("*").alias("n"), *(x for t in _BUCKETS for x in (F.count_if(of(t)).alias(f"n_{t}"), F.max(F.when(of(t), F.col("k"))).alias(f"max_{t}"))), *(F.count_if(F.col("age") <= a).alias(f"n_{a}d") for a in (1, 3, 7)), F.sum(F.col("k") * sign / (1 + F.col("age") / 7)).alias("recent_signed"), F.count_distinct("event_type").alias("n_types")))


def _rule_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross.peers(panel(spark, sf_dir).withColumn("rank", rank_pct("ret", "date")))


_RULES = f"""{PANEL}, rp0 AS (SELECT *, {rank_sql('ret', 'date')} AS rank, count(ret) OVER w AS known, sum(ret) OVER w AS s, sum((ret > 0)::INT) OVER w AS up FROM panel WINDOW w AS (PARTITION BY date, industry)),
rp AS (SELECT *, CASE WHEN ret IS NOT NULL AND known > 1 THEN (s - ret) / (known - 1) END AS peer_mean, CASE WHEN ret IS NOT NULL AND known > 1 THEN (up - (ret > 0)::INT) / (known - 1) END AS peer_breadth FROM rp0)"""
_GATE_SQL = {k: " AND ".join(f"{c} {o} {t}" for c, o, t in v) or "TRUE" for k, v in rules.GATES.items()}


@query(f"""
WITH {_RULES}, l AS (SELECT gate, fwd FROM rp, LATERAL (VALUES {', '.join(f"('{k}', {g})" for k, g in _GATE_SQL.items())}) v(gate, ok) WHERE ok AND fwd IS NOT NULL)
SELECT gate, count(*) AS n, round(avg(fwd), 6) AS mean_fwd, round(avg((fwd > 0)::INT), 6) AS pos_rate, round(avg((fwd <= -5)::INT), 6) AS loss_rate FROM l GROUP BY gate
""")
def l_named_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All named gates in one pass: each row is exploded to the gates that it passes."""
    passed = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in rules.gates().items())), lambda g: g.isNotNull())
    long = _rule_panel(spark, sf_dir).where("fwd is not null").select(F.explode(passed).alias("gate"), "fwd")
    return rounded(long.groupBy("gate").agg(F.count("*").alias("n"), F.avg("fwd").alias("mean_fwd"), F.avg((F.col("fwd") > 0).cast("int")).alias("pos_rate"), F.avg((F.col("fwd") <= -5).cast("int")).alias("loss_rate")))


_CONFLICT_SQL = {"peer": "ret > 0 AND peer_mean < 0", "trend": "ret > 0 AND ret3 < 0", "volume": "ret > 0 AND volume < 150", "breadth": "ret > 0 AND peer_breadth < 0.5"}


@query(f"""
WITH {_RULES}
SELECT code, date, ({' + '.join(f'coalesce(({c})::INT, 0)' for c in _CONFLICT_SQL.values())})::INT AS n_conflicts, concat_ws('+', {', '.join(f"CASE WHEN {c} THEN '{k}' END" for k, c in _CONFLICT_SQL.items())}) AS combo,
 (coalesce((ret > 0)::INT, 0) + coalesce((ret3 > 0)::INT, 0) + coalesce((peer_mean > 0)::INT, 0) + coalesce((peer_breadth >= 0.5)::INT, 0))::INT AS n_confirm, coalesce(rank >= 0.8 AND ret >= 15, FALSE) AS overheated FROM rp
""")
def f_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.flagged(_rule_panel(spark, sf_dir)).select("code", "date", "n_conflicts", "combo", "n_confirm", "overheated")


_SCORED = f"""{_RULES}, t0 AS (SELECT *, list_filter([CASE WHEN ret >= 8 THEN struct_pack(o := -round(least(1.0, 0.5 + abs(ret - 8) / 8), 6), r := 'breakout', e := 'plus') END,
   CASE WHEN ret3 >= 10 THEN struct_pack(o := -round(least(1.0, 0.5 + abs(ret3 - 10) / 10), 6), r := 'trend', e := 'plus') END,
   CASE WHEN ret <= -8 THEN struct_pack(o := -round(least(1.0, 0.5 + abs(ret + 8) / 8), 6), r := 'breakdown', e := 'minus') END,
   CASE WHEN ret3 <= -10 THEN struct_pack(o := -round(least(1.0, 0.5 + abs(ret3 + 10) / 10), 6), r := 'downtrend', e := 'minus') END,
   CASE WHEN rank >= 0.95 THEN struct_pack(o := -round(least(1.0, 0.5 + abs(rank - 0.95) / 1.0), 6), r := 'crowded', e := 'minus') END], lambda x: x IS NOT NULL) AS fired FROM rp),
t1 AS (SELECT *, len(list_filter(fired, lambda x: x.e = 'plus')) AS plus, len(list_filter(fired, lambda x: x.e = 'minus')) AS minus,
  0.4 * least(10, greatest(0, 5 + coalesce(ret3, 0) / 4)) + 0.3 * least(10, greatest(0, 5 + coalesce(ret, 0) / 2)) + 0.2 * least(10, greatest(0, volume / 50)) + 0.1 * 10 * coalesce(rank, 0.5) AS b0 FROM t0),
t2 AS (SELECT *, b0 + 0.5 * plus - 0.5 * minus AS base FROM t1),
t3 AS (SELECT *, least(10, greatest(0, CASE WHEN minus > 0 THEN least(base, 4.0) WHEN plus >= 3 THEN least(base, 8.0) ELSE base END)) AS score FROM t2),
sc AS (SELECT *, array_to_string(list_transform(list_sort(fired), lambda x: x.r), '+') AS rules, CASE WHEN (ret IS NOT NULL)::INT + (ret3 IS NOT NULL)::INT + (fwd IS NOT NULL)::INT <= 1 THEN 'incomplete' WHEN score >= 7 THEN 'strong' WHEN score >= 5 THEN 'watch' WHEN score >= 2 THEN 'weak' ELSE 'avoid' END AS rating FROM t3)"""


@query(f"WITH {_SCORED} SELECT code, date, round(score, 6) AS score, rules, rating FROM sc")
def f_rules_and_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rules.scored(_rule_panel(spark, sf_dir)).select("code", "date", "score", "rules", "rating"))


@query(f"""
WITH {_SCORED}, p AS (SELECT *, CASE WHEN ret <= -15 THEN 0.0 WHEN score >= 7 THEN 0.8 WHEN score >= 5 THEN 0.5 WHEN score >= 2 THEN 0.2 ELSE 0.0 END AS tier, sum((score >= 5)::INT) OVER (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING) AS spell FROM sc),
q AS (SELECT *, CASE WHEN spell = 0 THEN 0.0 ELSE min(tier) OVER (PARTITION BY code, spell ORDER BY date ROWS UNBOUNDED PRECEDING) END AS target FROM p),
r AS (SELECT *, coalesce(lag(target) OVER (PARTITION BY code ORDER BY date), 0.0) AS before FROM q)
SELECT code, date, target::DOUBLE AS target, CASE WHEN before = 0 AND target > before THEN 'buy' WHEN target > before THEN 'add' WHEN target = 0 AND target < before THEN 'sell' WHEN target < before THEN 'reduce' ELSE 'hold' END AS action FROM r
""")
def f_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.positions(rules.scored(_rule_panel(spark, sf_dir))).select("code", "date", "target", "action")


@query(f"""
WITH {PANEL}, e AS (SELECT *, fwd - avg(fwd) OVER (PARTITION BY date) AS excess FROM panel),
b AS (SELECT CASE WHEN ret IS NULL THEN -1 ELSE (ret > -10)::INT + (ret > 0)::INT + (ret > 10)::INT END AS bin, CASE WHEN fwd IS NULL OR excess IS NULL THEN 'unknown' WHEN fwd > 0 AND excess > 0 THEN 'good' WHEN fwd > 0 THEN 'lucky' WHEN excess > 0 THEN 'resilient' ELSE 'bad' END AS quality, fwd FROM e),
g AS (SELECT bin, quality, count(*) AS n, avg(fwd) AS m FROM b GROUP BY bin, quality)
SELECT bin::INT AS bin, quality, n, round(m, 6) AS mean_fwd, round(n / sum(n) OVER (PARTITION BY bin), 6) AS share FROM g
""")
def f_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    df = panel(spark, sf_dir).withColumn("excess", cross.neutral("fwd", "date"))
    out = df.groupBy(rules.binned("ret", [-10, 0, 10]).cast("int").alias("bin"), rules.quadrant("fwd", "excess").alias("quality")).agg(F.count("*").alias("n"), F.avg("fwd").alias("mean_fwd"))
    return rounded(out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("bin"))))


@query("""
SELECT event_id, TRY_CAST(replace(props, '{"k": ', '') AS DOUBLE) AS raw, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, round(CASE WHEN abs(value) > 1e-12 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) / value END, 6) AS ratio,
 round(CASE WHEN value IS NOT NULL THEN greatest(0, least(1, value / 100)) END, 6) AS clipped, coalesce(nullif(event_type, 'view'), 'other') AS kind FROM events
""")
def f_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelyard.functions.expr import clip

    ev = table(spark, sf_dir, "events")
    k = number(F.get_json_object("props", "$.k"))
    return rounded(ev.select("event_id", number(F.replace("props", F.lit('{"k": '), F.lit(""))).alias("raw"), k.alias("k"), safe_div(k, "value").alias("ratio"), clip(F.col("value") / 100, 0, 1).alias("clipped"), F.coalesce(F.nullif(F.col("event_type"), F.lit("view")), F.lit("other")).alias("kind")))


@query(f"""
WITH {PANEL}, a AS (SELECT *, row_number() OVER (PARTITION BY date, area ORDER BY ret DESC NULLS LAST, code) AS g, greatest(3, least(12, round(count(*) OVER (PARTITION BY date) * 0.3)::INT)) AS want FROM panel),
b AS (SELECT *, (g > 2)::INT AS extra, row_number() OVER (PARTITION BY date ORDER BY (g > 2)::INT, ret DESC NULLS LAST, code) AS place FROM a)
SELECT code, date, area, extra, place FROM b WHERE place <= want
""")
def s_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picking.shortlist(panel(spark, sf_dir), "ret", "area").select("code", "date", "area", "extra", "place")


def s_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy capped choice per half year (each step depends on those before, so no SQL)."""
    rows = panel(spark, sf_dir).withColumn("block", calendar.half_year())
    return rounded(picking.capped(rows, "ret", 2, 3, 20))


QUERIES["s_capped"] = s_capped


@query(f"""
WITH {PANEL}, h AS (SELECT code, date, area, row_number() OVER (PARTITION BY area, year(date) ORDER BY substr(sha256(concat_ws('|', 's1', code::VARCHAR, date::VARCHAR)), 1, 16), code, date) AS pick FROM panel)
SELECT code, date, area, pick FROM h WHERE pick <= 5
""")
def s_hashed_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = panel(spark, sf_dir).withColumn("year", F.year("date"))
    return picking.hashed_sample(df, 5, ["area", "year"], ["code", "date"], "s1").select("code", "date", "area", "pick")


@query(f"""
WITH {BARS}, d AS (SELECT date, row_number() OVER (ORDER BY date) AS idx FROM (SELECT DISTINCT date FROM bars)), m AS (SELECT max(idx) AS m FROM d), a AS (SELECT DISTINCT (1 + round(i * (m - 1) / 11.0))::INT AS idx FROM m, range(12) t(i))
SELECT idx::INT AS idx, date FROM d JOIN a USING (idx)
""")
def s_evenly_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picking.evenly_spaced(calendar.trading_days(bars(spark, sf_dir)), 12)


@query(f"""
WITH {EVENTS}, e AS (SELECT event_id, code, event_date AS date, event_type, k, ts FROM ev), m AS (SELECT *, row_number() OVER (PARTITION BY code, isoyear(date) * 100 + week(date) ORDER BY k DESC, event_id) AS rn FROM e WHERE event_type <> 'error')
SELECT event_id, code, date, k, substr(sha1(concat_ws('|', event_id::VARCHAR, code::VARCHAR, event_type)), 1, 16) AS cid FROM (SELECT event_id, code, date, k, event_type FROM e WHERE event_type = 'error' UNION ALL SELECT event_id, code, date, k, event_type FROM m WHERE rn = 1)
""")
def s_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors all, else a user's strongest event per ISO week; with a content id."""
    ev = stream_events(spark, sf_dir).select("event_id", "code", F.col("event_date").alias("date"), "event_type", "k")
    week = F.expr("extract(YEAROFWEEK FROM date)") * 100 + F.weekofyear("date")
    major = F.col("event_type") == "error"
    minor = picking.first_by(ev.where(~major).withColumn("week", week), ["code", "week"], F.desc("k"), "event_id").drop("week")
    return ev.where(major).unionByName(minor).select("event_id", "code", "date", "k", picking.content_id("event_id", "code", "event_type").alias("cid"))


@query(r"""
WITH a AS (SELECT doc_id, source, lang, sha256(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', '', 'g')) AS key FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang, key ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY lang, key) AS copies FROM a)
SELECT doc_id, lang, source, copies FROM r WHERE rn = 1
""")
def s_natural_key_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per language and whole text without its white space, the first by id; the
    group's size comes from a partial aggregate, so a large group of copies is not sorted in one
    task."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", picking.content_key("text").alias("key"))
    return docs.groupBy("lang", "key").agg(F.min(F.struct("doc_id", "source")).alias("r"), F.count("*").alias("copies")).select("r.doc_id", "lang", "r.source", "copies")


@query("""
WITH p AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'), e AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error')
SELECT 'both' AS kind, count(*) AS n FROM (SELECT * FROM p INTERSECT SELECT * FROM e) UNION ALL SELECT 'only_purchase', count(*) FROM (SELECT * FROM p EXCEPT SELECT * FROM e) UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM p UNION SELECT * FROM e)
""")
def s_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = stream_events(spark, sf_dir)
    p, e = (ev.where(F.col("event_type") == t).select("code").distinct() for t in ("purchase", "error"))
    parts = {"both": p.intersect(e), "only_purchase": p.subtract(e), "either": p.union(e).distinct()}
    out = None
    for kind, df in parts.items():
        row = df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
        out = row if out is None else out.union(row)
    return out
