"""Queries that run streams with keyed state over the given tables; their SQL is the batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.functions.expr import rounded
from panelyard.operators import entries
from panelyard.plans.entry_queries import FACTS
from panelyard.plans.signals import signals
from panelyard.sources.tables import table
from panelyard.streaming import keyed

QUERIES, SQL = {}, {}
#: A row of no code at a far time, so that the last timers run out; it is dropped from the result.
CLOSING = -1
BASE = entries.grid()[0]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _capped(t: str) -> str:
    sparse = f"(CASE WHEN sparse THEN least({t}, {BASE[7]}) ELSE {t} END)"
    return f"(CASE WHEN heated THEN least({sparse}, {BASE[8]}) ELSE {sparse} END)"


@query(f"""
WITH {FACTS},
k AS (SELECT code, date, CASE WHEN hard_block THEN 0.0 WHEN score_q >= {BASE[3]} AND score >= {BASE[4]} THEN {_capped('0.80')} WHEN score_q >= {BASE[1]} AND score >= {BASE[2]} AND hard_risk_count = 0 THEN {_capped('0.35')}
  WHEN score_q >= 0.55 AND hard_risk_count = 0 THEN NULL ELSE 0.0 END::DOUBLE AS first FROM fx),
l AS (SELECT code, date, CASE WHEN first IS NULL THEN least(0.30, coalesce(last_value(first IGNORE NULLS) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) ELSE first END AS target FROM k),
m AS (SELECT *, coalesce(lag(target) OVER (PARTITION BY code ORDER BY date), 0) AS before FROM l)
SELECT code, date, round(target, 6) AS target, CASE WHEN target <= 0 THEN CASE WHEN before > 0 THEN '卖出/不买' ELSE '等待不买' END WHEN before <= 0 THEN CASE WHEN target >= 0.35 THEN '买入' ELSE '小仓试探' END
 WHEN round(target - before, 9) >= 0.15 THEN '加仓' WHEN round(target - before, 9) <= -0.15 THEN '减仓' ELSE '持有' END AS action FROM m
""")
def st_target_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base policy as a stream of yearly files: each code's last target is keyed state."""
    base = spark.createDataFrame([(BASE[0],)], "variant string")
    rows = entries.decided(entries.facts(signals(spark, sf_dir)), base).select("code", F.to_timestamp("date").alias("at"), "first", "keeps")
    out = keyed.run_in_parts([(rows, F.year("at"))], keyed.positions, "positions")
    return rounded(out.where("action <> 'expired'").select("code", F.to_date("at").alias("date"), "target", "action"))


_PRIORITY = "CASE WHEN event_type = 'error' AND value >= 90 THEN 3 ELSE 1 END"


@query(f"""
WITH t AS (SELECT user_id AS code, event_id AS id, ts AS seen, {_PRIORITY} AS priority, value AS strength FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY code, date_trunc('week', seen), priority >= 3 ORDER BY strength DESC, seen, id) AS i FROM t)
SELECT code, id, priority, round(strength, 6) AS strength FROM r WHERE priority >= 3 OR i = 1
""")
def st_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Major events at once, the strongest other event of each code and week when the week ends."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("code"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), F.expr(_PRIORITY).alias("priority"), F.col("value").alias("strength"))
    closing = rows.agg(F.max("at").alias("at")).select(F.lit(CLOSING).cast("long").alias("code"), F.lit(CLOSING).cast("long").alias("id"), (F.col("at") + F.expr("interval 30 days")).alias("at"), F.lit(3).alias("priority"), F.lit(0.0).alias("strength"))
    out = keyed.run_in_parts([(rows.unionByName(closing), F.date_trunc("week", "at"))], keyed.cooled, "cooldown")
    return rounded(out.where(F.col("code") != CLOSING).select("code", "id", "priority", "strength"))


_DAYS = 5


@query(f"""
WITH d AS (SELECT DISTINCT user_id AS code, unnest([TIMESTAMP '2024-01-10 12:00:00', TIMESTAMP '2024-01-20 12:00:00', TIMESTAMP '2024-01-30 12:00:00']) AS seen FROM events),
j AS (SELECT d.code, d.seen, event_id FROM d LEFT JOIN events e ON e.user_id = d.code AND e.ts <= d.seen AND e.ts >= d.seen - INTERVAL {_DAYS} DAY)
SELECT code, day(seen) AS day, count(event_id) AS n_events, min(event_id) AS first_event, max(event_id) AS last_event FROM j GROUP BY 1, 2
""")
def st_decision_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions joined as a stream with the stream of events that were known in the days before."""
    known = table(spark, sf_dir, "events").select(F.col("user_id").alias("code"), "event_id", F.col("ts").cast("timestamp").alias("available_at"))
    close = F.to_timestamp(F.lit("2024-03-30 12:00:00"))
    events = known.unionByName(spark.range(1).select(F.lit(CLOSING).cast("long").alias("code"), F.lit(CLOSING).cast("long").alias("event_id"), close.alias("available_at")))
    times = F.array(*(F.to_timestamp(F.lit(f"2024-01-{d} 12:00:00")) for d in (10, 20, 30)))
    decisions = known.select("code").distinct().select("code", F.explode(times).alias("at")).unionByName(spark.range(1).select(F.lit(CLOSING).cast("long").alias("code"), close.alias("at")))
    week = [(decisions, F.date_trunc("week", "at")), (events, F.date_trunc("week", "available_at"))]
    out = keyed.run_in_parts(week, lambda left, right: keyed.matched(left, right, _DAYS), "matched").where(F.col("code") != CLOSING)
    return out.groupBy("code", F.dayofmonth("at").alias("day")).agg(F.count("event_id").alias("n_events"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))
