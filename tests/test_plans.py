"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from ebbtide.evaluation import curves
from ebbtide.operators import engagement
from ebbtide.operators.activity import behavior_counts
from ebbtide.plans.user_dataset import user_dataset
from ebbtide.registry import QUERIES, common
from ebbtide.sources.event_log import read_event_day, read_event_log


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored_log(spark, folder):
    return read_event_log(spark, common.log_folder(spark, folder))


def test_event_name_filter_reaches_the_scan(stored_log):
    text = plan(engagement.engagement_span(stored_log))
    assert "EqualTo(event_name,user_engagement)" in text
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert set(re.findall(r"(\w+):", schema)) == {"event_timestamp", "user_pseudo_id", "event_name"}


def test_only_used_nested_fields_are_read(stored_log):
    text = plan(stored_log.select("device.language"))
    assert "ReadSchema: struct<device:struct<language:string>>" in text


def test_one_day_prunes_partitions(spark, folder):
    text = plan(read_event_day(spark, common.log_folder(spark, folder), "2024-01-07"))
    assert re.search(r"PartitionFilters: \[[^\]]*event_date", text)


def test_single_partition_exchanges_hold_aggregated_rows_only(stored_log, spark, folder):
    for frame in (user_dataset(stored_log), curves.roc_auc(common.scored(spark, folder))):
        lines = plan(frame).splitlines()
        for here, below in zip(lines, lines[1:]):
            if "Exchange SinglePartition" in here:
                assert "Aggregate" in below, below


def test_rows_of_events_are_shuffled_once(spark, stored_log):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(behavior_counts(stored_log))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # rows of events move once; what is counted moves after its partial sums
    moved = [line for line in text.split("Initial Plan")[0].splitlines() if "Exchange hashpartitioning" in line]
    assert sum("_salt" in line for line in moved) == 2
    assert all("hashpartitioning(user_pseudo_id" in line for line in moved)


def test_scans_of_the_user_dataset(stored_log):
    """Bounds, end of the log, rows per user, tracked events."""
    frame = user_dataset(stored_log)
    frame.collect()
    assert plan(frame).split("Initial Plan")[0].count("FileScan parquet") == 4


def test_jobs_without_country_lose_the_customer_join(spark, folder):
    assert "customer" not in plan(behavior_counts(common.log(spark, folder)))
    assert "customer" in plan(engagement.latest_device(common.log(spark, folder)))


def test_latest_device_is_cut_before_the_shuffle(stored_log):
    text = plan(engagement.latest_device(stored_log))
    assert text.count("WindowGroupLimit") == 2


def test_python_runs_in_tree_explanations_only(spark, folder):
    python = re.compile("Python|Pandas|Arrow")
    for name in ("user_dataset", "profile_table", "metric_panel", "stratified_split", "bucketize"):
        assert not python.search(plan(QUERIES[name](spark, folder))), name


def test_event_day_counts(spark, folder, stored_log):
    days = stored_log.groupBy("event_date").agg(F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in days) == common.log(spark, folder).count()


def test_a_model_scores_each_row_once(spark, folder):
    """All parts of the metrics read one shuffle of the scores."""
    for metric in (curves.roc_points, curves.evaluate_model, curves.average_precision):
        frame = metric(common.scored(spark, folder))
        frame.collect()
        text = frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert text.count("FileScan parquet") == 1, metric.__name__
