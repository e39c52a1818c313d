"""Plan shape: top-k uses a partial group limit before the shuffle, ranking
never crosses all pairs through a nested-loop join, windows are partitioned,
and scans are pruned."""
from pyspark.sql import functions as F

from recsmith.operators import metrics as M
from recsmith.operators import topk as TK
from recsmith.plans import recommend as R
from recsmith.sources import testdata as td

from conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_topk_has_window_group_limit(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), F.col("id").cast("double").alias("s"),
                                  F.col("id").alias("i"))
    p = plan(TK.topk_per_group(df, ["g"], "s", ["i"], 5))
    assert "WindowGroupLimit" in p


def test_recommend_has_no_cartesian_or_nested_loop(spark):
    df = R.recommend_testdata(spark, SF_SMALL)
    p = final_plan(df)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "FlatMapCoGroupsInPandas" in p


def test_metrics_window_is_partitioned(spark):
    ix = td.interactions(spark, SF_SMALL).withColumn("score", F.col("rating") * 1.0)
    p = plan(M.ranking_metrics(ix, tiebreak=["row_id"]))
    assert "SinglePartition" not in p


def test_scan_is_pruned(spark):
    df = td.interactions(spark, SF_SMALL).filter(F.col("split") == "val").select("row_id")
    p = plan(df)
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,props:string>" in p


def test_ranking_limits_rows_before_the_shuffle(spark):
    """A partial group limit stands below the exchange, and k is joined to the ranks."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        items, n = R.items_testdata(spark, SF_SMALL)
        p = plan(R.rank_requests(items, td.query_requests(spark, SF_SMALL), n, 10))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    lines = p.splitlines()
    final = next(i for i, x in enumerate(lines) if "WindowGroupLimit" in x and "Final" in x and "query_id" in x)
    assert any("WindowGroupLimit" in x and "Partial" in x for x in lines[final:])
    assert "InMemoryTableScan" not in p
