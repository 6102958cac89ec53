"""The event log: a Parquet table partitioned by day, or loose day files."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.schema import EVENT_SCHEMA


def read_event_log(spark: SparkSession, root: str) -> DataFrame:
    """All days. The schema is given, so no file is opened to infer it."""
    return spark.read.schema(EVENT_SCHEMA).option("mergeSchema", "false").parquet(root)


def read_event_day(spark: SparkSession, root: str, day: date | str) -> DataFrame:
    """One day; the filter on the partition column prunes all other folders."""
    return read_event_log(spark, root).where(F.col("event_date") == F.lit(str(day)).cast("date"))


def write_event_log(events: DataFrame, root: str) -> str:
    """Write by day. The rebalance hint lets the runtime split big days and merge small ones."""
    (
        events.select(*EVENT_SCHEMA.fieldNames())
        .hint("rebalance", F.col("event_date"))
        .write.mode("overwrite")
        .partitionBy("event_date")
        .parquet(root)
    )
    return root


def union_shards(shards: list[DataFrame]) -> DataFrame:
    """Stack loose day shards whose columns may differ; absent columns become NULL."""
    stacked = shards[0]
    for shard in shards[1:]:
        stacked = stacked.unionByName(shard, allowMissingColumns=True)
    return stacked
