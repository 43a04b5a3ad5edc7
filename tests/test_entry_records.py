from pyspark.sql import functions as F

from panelyard.plans.registry import QUERIES


def test_stocks_are_counted_without_a_row_for_each(spark, data):
    out = QUERIES["l_entry_records"](spark, data)
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()  # two distinct counts repeat each row
    replayed = QUERIES["l_entry_replay"](spark, data)
    block = F.concat(F.lit("H"), F.year("date"), F.when(F.month("date") <= 6, "_1").otherwise("_2"))
    want = replayed.groupBy("variant", block.alias("time_block")).agg(F.count_distinct("code").alias("unique_stocks"))
    assert sorted(map(tuple, out.select("variant", "time_block", "unique_stocks").collect())) == sorted(map(tuple, want.collect()))
