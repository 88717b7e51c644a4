import pytest
from pyspark.sql import functions as F

from graphloom.llm import common
from graphloom.operators import fixpoint, vta, vta_small
from graphloom.sources.star import Facts


@pytest.mark.parametrize("cut", [fixpoint.cut, common.cut])
def test_guessed_sizes_do_not_grow_in_loops(spark, cut):
    df = cut(spark.range(4).select("id", F.col("id").alias("to")))
    for _ in range(5):
        step = df.select(F.col("id").alias("to"), F.col("to").alias("next"))
        df = cut(df.join(step, "to").select("id", F.col("next").alias("to")))
    assert df._jdf.logicalPlan().stats().sizeInBytes() < 1 << 64
    assert sorted(map(tuple, df.collect())) == [(k, k) for k in range(4)]
    assert df.alias("a").join(df.alias("b"), F.col("a.id") == F.col("b.to")).count() == 4


def test_guessed_sizes_do_not_decide_what_is_broadcast(spark, monkeypatch):
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return fixpoint.cut(df)

    for module in (vta, vta_small):
        monkeypatch.setattr(module, "cut", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    facts = Facts(spark, "/root/testdata/sf0.001")
    vta_small.solve(vta.Rules(facts.program), facts.methods.filter("is_root").select("method_id"))
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before
    assert "spark.sql.adaptive.autoBroadcastJoinThreshold" not in spark.conf.getAll
