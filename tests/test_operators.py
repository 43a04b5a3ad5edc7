"""Operators on small frames with results worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelyard.operators import asof, audit, calendar, cross, indicators, labels, picking
from panelyard.sources import tables


def day(n):
    return dt.date(2026, 1, 1) + dt.timedelta(days=n)


def bars_of(spark, closes, code=1):
    rows = [(code, day(i), c, c + 1, c - 1, c, 100.0, 100.0 * c) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, tables.BAR_SCHEMA)


@pytest.mark.parametrize("before, now, want", [("", "a", 1.0), ("ab", "ab", 0.0), ("ab", "bc", 0.5), ("ab", "cd", 1.0)])
def test_turnover(spark, before, now, want):
    rows = [(day(0), ord(c)) for c in before] + [(day(1), ord(c)) for c in now]
    out = cross.turnover(spark.createDataFrame(rows, "date date, code long")).orderBy("date").collect()
    assert out[-1].turnover == want


def test_leave_one_out_peers(spark):
    rows = [(day(0), 1, "x", 2.0), (day(0), 2, "x", -4.0), (day(0), 3, "y", 5.0)]
    out = {r.code: r for r in cross.peers(spark.createDataFrame(rows, "date date, code long, industry string, ret double")).collect()}
    assert (out[1].peer_count, out[1].peer_mean, out[1].peer_relative, out[1].peer_breadth) == (1, -4.0, 6.0, 0.0)
    assert out[3].peer_count == 0 and out[3].peer_mean is None


def test_windowed_join_says_why_nothing_matched(spark):
    at = lambda n, h: dt.datetime.combine(day(n), dt.time(h))
    events = spark.createDataFrame([(1, day(3), at(3, 14), 2), (1, day(3), at(3, 21), 9)], "code long, event_date date, available_at timestamp_ntz, n int")
    decisions = spark.createDataFrame([(1, day(3)), (1, day(4)), (1, day(60)), (2, day(3)), (1, None)], "code long, date date")
    out = {(r.code, r.date): r for r in asof.windowed(decisions, events, 30, {"n": F.sum("n")}).collect()}
    assert out[(1, day(3))].n == 2  # what became known at 21:00 is not used at 15:00
    assert out[(1, day(4))].n == 11 and out[(1, day(4))].join_status == "event_window_matched"
    assert out[(1, day(60))].join_status == "no_event_in_window"
    assert out[(2, day(3))].join_status == "code_not_in_feature_table"
    assert out[(1, None)].join_status == "decision_date_invalid"


def test_availability_policies(spark):
    ts = F.lit(dt.datetime(2026, 1, 5, 9)).cast("timestamp_ntz")
    row = spark.range(1).select(*(asof.available(ts, p).alias(p) for p in ("stamped", "same_close", "next_day"))).first()
    assert (row.stamped.hour, row.same_close.hour, row.next_day.day, row.next_day.hour) == (9, 15, 6, 0)


def test_asof_takes_the_latest_known_row(spark):
    at = lambda h: dt.datetime(2026, 1, 5, h)
    left = spark.createDataFrame([(1, at(3), "a"), (1, at(1), "b"), (2, at(9), "c")], "code long, at timestamp_ntz, tag string")
    right = spark.createDataFrame([(1, at(2), 5.0), (1, at(3), 6.0)], "code long, known timestamp_ntz, value double")
    out = {r.tag: r.value for r in asof.asof(left, right).collect()}
    assert out == {"a": 6.0, "b": None, "c": None}


def test_windows_need_all_their_rows(spark):
    out = indicators.trend(bars_of(spark, [float(i) for i in range(1, 31)])).orderBy("date").collect()
    assert out[3].ma5 is None and out[4].ma5 == 3.0
    assert out[18].ma20 is None and out[19].ma20 == 10.5
    assert out[25].rsi14 is None  # no losses: no ratio
    assert out[20].ret20 == pytest.approx(2000.0)


def test_streaks_end_on_flat_days(spark):
    out = [r.streak for r in indicators.streaks(bars_of(spark, [1.0, 2.0, 3.0, 3.0, 2.0, 1.0, 2.0])).orderBy("date").collect()]
    assert out == [0, 1, 2, 0, -1, -2, 1]


def test_macd_is_recursive_from_the_first_close(spark):
    out = indicators.macd(bars_of(spark, [10.0, 12.0])).orderBy("date").collect()
    dif = 2 * (2 / 13) - 2 * (2 / 27)
    assert out[0].dif == 0 and out[1].dif == pytest.approx(dif) and out[1].hist == pytest.approx(2 * (dif - dif * 0.2))


def test_forward_labels_are_withheld_until_ripe(spark):
    out = labels.forward(bars_of(spark, [float(10 + i) for i in range(22)])).orderBy("date").collect()
    assert out[0].fwd_ret_5 == pytest.approx(50.0) and out[0].gt_status == "evaluated"
    assert out[2].fwd_ret_5 is None and out[2].gt_status == "insufficient_future_data"


def test_weekday_schedule_falls_back(spark):
    # 2026-01-06 is a Tuesday; the week of the 12th lacks its Tuesday, the week of the 19th starts on Wednesday
    days = [(dt.date(2026, 1, d),) for d in (5, 6, 7, 12, 14, 21, 22)]
    out = sorted(r.date.day for r in calendar.weekday_schedule(spark.createDataFrame(days, "date date"), 1).collect())
    assert out == [6, 12, 21]


def test_capped_choice_is_greedy(spark):
    rows = [("b", 1, day(0), 9.0), ("b", 1, day(1), 8.0), ("b", 2, day(0), 7.0), ("b", 3, day(1), 6.0), ("b", 4, day(2), None)]
    out = picking.capped(spark.createDataFrame(rows, "block string, code long, date date, score double"), "score", per_code=1, per_date=1, limit=5)
    assert {(r.code, r.date) for r in out.collect()} == {(1, day(0)), (3, day(1))}


def test_labels_among_features_are_refused(spark):
    df = spark.createDataFrame([(1, 2.0, (3.0,))], "code long, fwd_ret_5 double, nested struct<gt_pass double>")
    assert audit.forbidden(df) == ["fwd_ret_5", "nested.gt_pass"]
    with pytest.raises(ValueError):
        audit.features_only(df, ["code", "fwd_ret_5"])
    assert audit.features_only(df, ["code"]).columns == ["code"]


def test_files_round_trip(spark, tmp_path):
    text = "day,close,open,note,high,low,volume,amount\n2026-01-05,10,x,a,1,1,1,1\n20260106,11,12,b,1,1,1,1\n,9,9,c,1,1,1,1\n2026-01-07,,1,d,1,1,1,1\n"
    (tmp_path / "7.csv").write_text(text)
    out = tables.csv_bars(spark, str(tmp_path / "7.csv"), {"day": "date"})
    assert [(r.date.day, r.close, r.open) for r in out.orderBy("date").collect()] == [(5, 10.0, None), (6, 11.0, 12.0)]
    with pytest.raises(ValueError):
        tables.csv_bars(spark, str(tmp_path / "7.csv"))
    tables.write_csv(out, str(tmp_path / "out"), gzip=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
    rows = spark.createDataFrame([(1, "a")], "id long, tag string")
    for _ in range(2):
        tables.append_ledger(rows, str(tmp_path / "ledger"))
    assert tables.ledger(spark, str(tmp_path / "ledger"), "id long, tag string").count() == 2
    (tmp_path / "r.json").write_text('{"records": [{"id": 1, "tag": "a"}, {"id": 2, "tag": "b"}]}')
    (tmp_path / "l.json").write_text('[{"id": 3, "tag": "c"}]')
    read = lambda n: [r.id for r in tables.json_records(spark, str(tmp_path / n), "id long, tag string").collect()]
    assert read("r.json") == [1, 2] and read("l.json") == [3]


def test_date_shards_and_keyed_union(spark, tmp_path):
    for day in ("20260105", "20260106"):
        (tmp_path / f"trade_date_{day}.csv").write_text(f"ts_code,trade_date,winner_rate\n000001.SZ,{day},5\n600000.SH,{day},6\n")
    out = tables.sharded_csv(spark, str(tmp_path / "trade_date_*.csv"))
    assert sorted((r.code, r.date.day, r.winner_rate) for r in out.collect()) == [("000001", 5, "5"), ("000001", 6, "5"), ("600000", 5, "6"), ("600000", 6, "6")]
    a = spark.createDataFrame([(1, "d1", 2.0), (1, "d1", 1.0)], "code long, date string, x double")
    b = spark.createDataFrame([(1, "d1", 9.0, "t"), (2, "d1", 3.0, "u")], "code long, date string, x double, y string")
    assert sorted(map(tuple, tables.union_by_key([a, b], ["date", "code"]).select("code", "x", "y").collect())) == [(1, 1.0, None), (2, 3.0, "u")]


def test_cached_tables_follow_their_files(spark, tmp_path):
    from panelyard.sources.folders import cached

    built, source = [], str(tmp_path / "in")
    build = lambda: built.append(1) or spark.read.parquet(source).selectExpr("id * 2 AS twice")
    spark.range(3).write.parquet(source)
    for _ in range(2):
        assert sorted(r.twice for r in cached(spark, "t", [source], build).collect()) == [0, 2, 4]
    assert len(built) == 1
    spark.range(4).write.mode("overwrite").parquet(source)
    assert cached(spark, "t", [source], build).count() == 4 and len(built) == 2


def test_stream_leaves_late_events_out(spark, tmp_path):
    """Several files, a batch each; the last holds an event older than the watermark allows."""
    import datetime as dt

    from panelyard.streaming import watch

    at = lambda d, h=12: dt.datetime(2026, 1, d, h)
    rows = [[(1, at(1)), (2, at(1, 13))], [(2, at(1, 13)), (3, at(2))], [(4, at(5))], [(5, at(1, 14)), (6, at(5, 13))], [(7, at(9))]]
    folder = tmp_path / "in"
    for i, part in enumerate(rows):
        spark.createDataFrame([(n, t, 7, "view", 1.0, "{}") for n, t in part], watch.SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(watch.SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder)).withColumn("ts", F.col("ts").cast("timestamp"))
    out = {r.start.day: r.n for r in watch.appended(watch.graded(stream), "late").collect()}
    assert out == {1: 2, 2: 1, 5: 2}


def test_diverse_and_last_listed(spark):
    from panelyard.operators import single

    rows = spark.createDataFrame([("b", c, f"2020-01-0{d}", s) for d in (1, 2, 3) for c, s in (("x", 3.0), ("y", 2.0), ("z", 1.0))], "block string, code string, date string, score double")
    got = sorted((r.date[-1], r.code) for r in single.diverse(rows, "score", 2).collect())
    assert got == [("1", "x"), ("1", "y"), ("2", "x"), ("2", "z"), ("3", "x"), ("3", "y")]
    records = spark.createDataFrame([("a", "2020-01-05", 1, 10.0), ("a", "2020-01-01", 2, 20.0), ("a", "2020-02-01", 3, 30.0)], "code string, date string, pos int, v double")
    asked = spark.createDataFrame([("a", "2019-12-31"), ("a", "2020-01-05"), ("a", "2020-02-01"), ("b", "2020-02-01")], "code string, date string")
    assert sorted(map(tuple, single.last_listed(asked, records, "v").collect()), key=str) == [("a", "2019-12-31", None, None), ("a", "2020-01-05", 2, 20.0), ("a", "2020-02-01", 3, 30.0), ("b", "2020-02-01", None, None)]


def test_breakouts_and_trend_equal_plain_loops(spark):
    import random

    from panelyard.operators import single

    random.seed(5)
    days = [f"{1000 + i}" for i in range(150)]
    data = {"a": [100 + random.uniform(-5, 5) + i / 3 for i in range(150)], "short": [random.uniform(1, 2) for _ in range(30)]}
    bars = spark.createDataFrame([(c, d, x) for c, xs in data.items() for d, x in zip(days, xs)], "code string, date string, close double")
    x = data["a"]
    hits = [100 * (x[i + 20] / x[i] - 1) for i in range(20, 150 - 60) if x[i] > max(x[i - 20 : i])]
    (row,) = single.breakouts(bars).collect()
    assert row.code == "a" and row.n_signals == len(hits) and abs(row.mean_20d - sum(hits) / len(hits)) < 1e-9
    got = {r.code: r for r in single.trend(bars).collect()}
    assert got["a"].score == 4 + sum(x[-1] > sum(x[-n:]) / n for n in (20, 60, 120)) and abs(got["a"].change60 - 100 * (x[-1] / x[-60] - 1)) < 1e-9
    assert got["short"].change60 is None and got["short"].score in (4, 5)
