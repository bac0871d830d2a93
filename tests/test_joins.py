import pytest
from pyspark.sql import functions as F

from codeweave.plans.joins import counted, dealt_join, frequent, looked_up


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("rows", [3, 1000])
def test_dealt_join_equals_a_join(spark, how, rows):
    large = spark.range(200).select(F.expr("case when id % 3 = 0 then 7 when id % 50 = 1 then null else id % 11 end").alias("k"), F.expr("id % 2").alias("j"), F.col("id").alias("v"))
    small = spark.createDataFrame([(7, 0, "a"), (7, 0, "b"), (7, 1, "c"), (3, 1, "d"), (None, 1, "e"), (99, 0, "f")], "k long, j long, w string")
    order = lambda df: sorted(map(tuple, df.collect()), key=str)
    got, want = dealt_join(large, small, ["k", "j"], how, rows), large.join(small, ["k", "j"], how)
    assert got.columns == want.columns and order(got) == order(want)
    assert dealt_join(large.where("false"), small, ["k", "j"], how, rows).collect() == []


@pytest.mark.parametrize("rows", [3, 1000])
def test_looked_up_and_counted(spark, rows):
    large = spark.range(200).select(F.expr("case when id % 3 = 0 then 7 when id % 50 = 1 then null else id % 11 end").alias("k"), F.expr("id % 2").alias("j"), F.col("id").alias("v"))
    small = spark.createDataFrame([(7, 0, "a"), (7, 1, None), (3, 1, "d"), (None, 1, "e"), (99, 0, "f")], "k long, j long, w string")
    order = lambda df: sorted(map(tuple, df.collect()), key=str)
    got = looked_up(large, small, ["k", "j"], frequent(large, ["k", "j"], rows))
    want = large.join(small, ["k", "j"], "left")
    assert got.select(want.columns).schema.names == want.columns and order(got.select(want.columns)) == order(want)
    known = large.where("k is not null")
    n = counted(known, ["k", "j"], "n", rows)
    assert order(n.select("k", "j", "v", "n")) == order(known.selectExpr("k", "j", "v", "count(*) over (partition by k, j) as n"))
