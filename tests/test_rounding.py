"""Halves round as SQL rounds them."""

import duckdb

from panelyard.functions.expr import rounded


def test_halves_round_as_in_sql(spark):
    values = [-0.1410965, 0.5205945, 0.4071235, 0.0866105, 1.0000005, 2.5e-7, 5e-7, 123456789.1234565, 1e300, 3.0, -7.25]
    got = rounded(spark.createDataFrame([(v,) for v in [*values, None]], "x double")).collect()
    assert [r["x"] for r in got] == [duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values] + [None]
