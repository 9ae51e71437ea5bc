import pytest
from pyspark.sql import functions as F

from tidegauge.llm import common


@pytest.mark.parametrize("share", [2, 10, 1000])
def test_hot_keys_join_like_the_others(spark, monkeypatch, share):
    monkeypatch.setattr(common, "HOT_SHARE", share)
    rows = spark.range(500).select(F.when(F.col("id") < 200, 0).otherwise(F.col("id") % 97).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("first"))
    got = common.join_groups(rows, groups, ["k"], "c").select("id", "first").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, rows.join(groups, "k").select("id", "first").collect()))
    assert len(got) == 500


def test_join_of_nothing(spark):
    rows = spark.range(0).select(F.col("id").alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("c"))
    assert common.join_groups(rows, groups, ["k"], "c").count() == 0


def test_names_are_left_out_whatever_their_case(spark):
    assert common.without(spark.createDataFrame([(1, 2, 3)], "Size int, `a.b` int, c int"), ["size"]).columns == ["a.b", "c"]


def test_tables_are_written_to_the_shared_folder(spark):
    df, path = common.write_table(spark.range(3), "three")
    assert path.startswith(spark.conf.get("spark.checkpoint.dir")) and df.count() == 3
    common.remove(spark, path)
    with pytest.raises(Exception):
        df.count()
