"""Plan checks: pruning and pushdown reach the scan; no whole-table window on
raw rows; top-n is a per-task partial sort."""

from pyspark.sql import functions as F

from fairlane.operators import metrics, ordering
from fairlane.sources.tables import applications, load, predictions

from conftest import SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_and_projection_reach_parquet_scan(spark):
    o = load(spark, SMALL, "orders").where(F.col("o_totalprice") > 1000).select("o_orderkey")
    p = _plan(o)
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,1000" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in p


def test_rate_query_does_not_read_lineitem(spark):
    a = applications(spark, SMALL).groupBy("grp_a").agg(F.avg("target"))
    assert "lineitem" not in _plan(a)


def test_auc_has_no_single_partition_exchange_on_rows(spark):
    p = predictions(spark, SMALL)
    plan = _plan(metrics.roc_auc(p))
    assert "SinglePartition" not in plan


def test_top_n_is_take_ordered(spark):
    o = load(spark, SMALL, "orders")
    assert "TakeOrderedAndProject" in _plan(ordering.top_n(o, "o_totalprice", 10, tie="o_orderkey"))


def test_quantiles_are_exact_unless_a_sketch_is_asked_for(spark):
    from fairlane.operators import segment
    a = applications(spark, SMALL)
    assert "percentile_approx" not in _plan(segment.median_by(a, "income", "grp_a"))
    assert "percentile_approx" in _plan(segment.median_by(a, "income", "grp_a", approx=True))
