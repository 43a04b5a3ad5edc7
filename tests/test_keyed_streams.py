"""Keyed state over several batches and restarts, against plain loops."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from panelyard.streaming import keyed


def at(month, day=1):
    return dt.datetime(2020 + (month - 1) // 12, (month - 1) % 12 + 1, day)


def test_positions_over_restarts_late_rows_and_expiry(spark):
    rows = [(1, at(1), 0.8, False), (1, at(2), 0.0, True), (1, at(3), 0.0, True), (1, at(4), 0.35, False), (1, at(5), 0.0, False), (1, at(6), 0.0, True), (2, at(1), 0.35, False), (3, at(30), 0.6, False)]
    late = [(1, at(2), 0.35, False)]
    df = spark.createDataFrame([(*r, r[1].month + 12 * (r[1].year - 2020)) for r in rows], "code long, at timestamp, first double, keeps boolean, part int")
    out = keyed.run_in_parts([(df.drop("part"), F.lit(0))], keyed.positions, "once")  # all in one batch
    once = sorted(map(tuple, out.where("action <> 'expired'").collect()))
    df = df.unionByName(spark.createDataFrame([(*late[0], 5)], df.schema))
    parts = df.withColumn("n", F.col("part"))
    source = [(parts.select("code", "at", "first", "keeps", "n"), F.col("n"))]
    got = sorted(map(tuple, keyed.run_in_parts(source, lambda s: keyed.positions(s.drop("n")), "parts").collect()))
    want = [(1, at(1), 0.8, "买入"), (1, at(2), 0.3, "减仓"), (1, at(3), 0.3, "持有"), (1, at(4), 0.35, "持有"), (1, at(5), 0.0, "卖出/不买"), (1, at(6), 0.0, "等待不买"), (2, at(1), 0.35, "买入"), (3, at(30), 0.6, "买入")]
    expired = [(2, at(1) + dt.timedelta(days=keyed.KEEP_DAYS), 0.0, "expired")]
    assert got == sorted(want + expired)  # code 1 held nothing when it expired
    assert once == want


def test_cooldown_passes_majors_and_the_weeks_best(spark):
    day = lambda d, h=0: dt.datetime(2024, 1, 1, h) + dt.timedelta(days=d)  # noqa: E731  a Monday
    rows = [(1, 1, day(0), 1, 5.0), (1, 2, day(2), 1, 7.0), (1, 3, day(3), 3, 1.0), (1, 4, day(5), 1, 7.0), (1, 5, day(8), 2, 1.0), (2, 6, day(6), 1, 2.0), (2, 7, day(6), 3, 2.0), (2, 8, day(6, 1), 3, 2.0), (-1, -1, day(40), 3, 0.0)]
    df = spark.createDataFrame(rows, "code long, id long, at timestamp, priority int, strength double")
    got = keyed.run_in_parts([(df, F.date_trunc("day", "at"))], keyed.cooled, "cooldown").where("code > 0")
    assert sorted(r.id for r in got.collect()) == [2, 3, 5, 6, 7, 8]


def test_context_is_read_anew_when_it_is_old(spark, tmp_path):
    now, version = [0.0], ["a"]
    context = keyed.DailyContext(lambda: spark.createDataFrame([(1, version[0])], "code long, tag string"), clock=lambda: now[0])
    schema, source = "code long, n int", str(tmp_path / "in")
    for k, hours in enumerate((0, 5, 25)):
        now[0], version[0] = hours * 3600.0, "abc"[k]
        spark.createDataFrame([(1, k), (2, k)], schema).write.mode("append").parquet(source)
        keyed.with_context(spark.readStream.schema(schema).parquet(source), context, ["code"], str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out")).select("code", "n", "tag").collect()
    assert sorted(map(tuple, got), key=str) == [(1, 0, "a"), (1, 1, "a"), (1, 2, "c"), (2, 0, None), (2, 1, None), (2, 2, None)]
    assert context.loads == 2


def test_interval_join_equals_the_batch_join(spark):
    t = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    decisions = spark.createDataFrame([(1, t(3)), (1, t(10)), (2, t(3)), (-1, t(90))], "code long, at timestamp")
    events = spark.createDataFrame([(1, 1, t(0)), (1, 2, t(3)), (1, 3, t(4)), (2, 4, t(3.5)), (1, 5, t(9)), (-1, 6, t(90))], "code long, event_id long, available_at timestamp")
    parts = [(decisions, F.date_trunc("week", "at")), (events, F.date_trunc("week", "available_at"))]
    got = keyed.run_in_parts(parts, lambda a, b: keyed.matched(a, b, 5), "matched").where("code > 0").collect()
    assert sorted(((r.code, r.at, r.event_id) for r in got), key=str) == sorted([(1, t(3), 1), (1, t(3), 2), (1, t(10), 5), (2, t(3), None)], key=str)


def test_labels_agree_in_both_forms(spark):
    from panelyard.operators import entries

    pairs = [(a, b) for a in (0.0, 0.1, 0.3, 0.35, 0.6, 0.8) for b in (0.0, 0.1, 0.3, 0.35, 0.6, 0.8)]
    df = spark.createDataFrame(pairs, "a double, b double").select("a", "b", entries.action(F.col("a"), F.col("b")).alias("c"))
    assert all(r.c == keyed.action(r.a, r.b) for r in df.collect())
    assert pd.Timestamp.min < pd.Timestamp(1990, 1, 1)


def test_positions_take_rows_and_four_calls_of_state_a_batch():
    calls = []

    class Handle:
        def getValueState(self, name, schema):
            return self

        def get(self):
            calls.append("get")
            return (0.8, 1000)

        def __getattr__(self, name):
            return lambda *a: calls.append(name)

    positions = keyed.Positions()
    positions.init(Handle())
    out = list(positions.handleInputRows((7,), iter([{"us": 3000, "first": 0.0, "keeps": True}, {"us": 900, "first": 0.5, "keeps": False}, {"us": 2000, "first": 0.35, "keeps": False}]), None))
    assert [(r.code, r.us, r.target, r.action) for r in out] == [(7, 2000, 0.35, "减仓"), (7, 3000, 0.3, "持有")]
    assert calls == ["get", "deleteTimer", "update", "registerTimer"]


def test_cooldown_runs_without_python_and_keeps_late_majors(spark):
    t = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    rows = [(1, 1, t(0), 1, None, 0), (1, 2, t(1), 1, 4.0, 0), (2, 3, t(0), 1, None, 0), (1, 4, t(9), 1, 1.0, 1), (1, 5, t(2), 3, 1.0, 2), (None, 6, t(3), 1, 1.0, 0), (-1, -1, t(60), 3, 0.0, 3)]
    df = spark.createDataFrame(rows, "code long, id long, at timestamp, priority int, strength double, n int")
    plans = []

    def build(stream):
        out = keyed.cooled(stream.drop("n"))
        plans.append(out._jdf.queryExecution().analyzed().toString())
        return out

    got = keyed.run_in_parts([(df, F.col("n"))], build, "late").where("id > 0")
    assert sorted(r.id for r in got.collect()) == [2, 3, 4, 5, 6]  # 5 is late, but major
    assert "TransformWithState" not in plans[0]
