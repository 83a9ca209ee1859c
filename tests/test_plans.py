"""Physical plans: one exchange for the windows of a day, pruned scans, no Python where windows do."""

import os
import re

import pytest
from tickforge.plans import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
ONE_EXCHANGE = ["orderflow_cum", "mlofi", "fi2010_ts", "mbo_rates", "mbo_size_pct", "label_tlob", "label_barrier", "label_magnitude", "rolling_vol", "seq_index", "norm_zscore", "exp_mod_cancel", "signals14", "mbo_flow_vol", "exp_lots", "exp_sweep", "exp_vol"]


def plan_of(spark, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("name", ONE_EXCHANGE)
def test_one_exchange(spark, name):
    plan = plan_of(spark, name)
    by_day = len(re.findall(r"Exchange hashpartitioning", plan))
    more = {"orderflow_cum": 1, "exp_mod_cancel": 1}.get(name, 0)  # joined by (day, seq); windows of an order
    assert by_day <= 1 + more, plan
    assert not re.search(r"Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoopJoin", plan)


@pytest.mark.parametrize("name", ["samples116", "samples116_rebuilt"])
def test_samples_come_from_few_exchanges(spark, name):
    """All windows from one partitioning by day, and one more for the blocks of ended orders."""
    plan = plan_of(spark, name)
    assert len(re.findall(r"Exchange hashpartitioning", plan)) <= 3, re.findall(r"Exchange [^,]*,", plan)
    assert not re.search(r"Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoopJoin", plan)


def test_scans_are_pruned(spark):
    plan = plan_of(spark, "label_tlob")
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan)[1]
    assert "props" not in schema and "user_id" not in schema and "value" in schema


def test_folds_are_the_only_python(spark):
    folds = {"sample_volume", "sample_volume_stats", "exp_price_clustering", "book_reconstruct", "queue_positions", "samples116", "samples116_rebuilt", "dataset_sequences"}
    for name in QUERIES:
        if name not in folds:
            assert not re.search(r"PythonUDF|InPandas|InArrow", plan_of(spark, name)), name


@pytest.mark.parametrize("name", ["horizon_intersect", "label_multi_fixed", "label_multi_quantile", "label_multi_dynamic"])
def test_horizons_are_frames_of_one_partitioning(spark, name):
    """No table a horizon, nothing turned into columns by an aggregate, and days that adaptive plans leave apart."""
    plan = plan_of(spark, name)
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and "REPARTITION_BY_NUM" in plan, plan
    assert not re.search(r"Union|Aggregate|Join", plan), plan


def test_labels_and_sequences_are_merged(spark):
    plan = plan_of(spark, "align_join")
    assert "SortMergeJoin" in plan and not re.search(r"Broadcast|Union|Aggregate", plan), plan


@pytest.mark.parametrize("name", ["dataset_sequences", "dataset_multiscale"])
def test_only_day_tables_are_broadcast(spark, name):
    """Samples, labels and sequences grow with the input; however small they look, they are merged or not joined at all."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and not re.search(r"Join \[day#\d+, ", plan.replace("SortMergeJoin", ""))
    assert all("BroadcastHashJoin [day#" in line and line.count("day#") == 2 and "_idx" not in line.split("Inner")[0] for line in plan.splitlines() if "BroadcastHashJoin" in line)
