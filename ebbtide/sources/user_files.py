"""Per-user datasets as CSV files, Parquet files and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.schema import FIRST_SEEN, USER_SCHEMA

# ISO time with microseconds and zone
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSSxxx"


def _text_time_schema() -> T.StructType:
    return T.StructType(
        [
            T.StructField(f.name, T.StringType() if f.name == FIRST_SEEN else f.dataType)
            for f in USER_SCHEMA.fields
        ]
    )


def read_user_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header and given types; the engagement time stays text. Columns in another order and cells
    that don't fit their type are errors."""
    strict = {"header": True, "enforceSchema": False, "mode": "FAILFAST"}
    return spark.read.schema(_text_time_schema()).options(**strict).csv(path)


def read_user_csv_with_time(spark: SparkSession, path: str) -> DataFrame:
    """The same with the engagement time as a timestamp. A fraction or zone may be missing."""
    return read_user_csv(spark, path).withColumn(FIRST_SEEN, F.to_timestamp(FIRST_SEEN))


def write_user_csv(users: DataFrame, path: str) -> str:
    """CSV with header. NULL and empty text stay apart: NULL is an empty field."""
    timed = users.withColumn(
        FIRST_SEEN, F.date_format(F.col(FIRST_SEEN).cast("timestamp"), TIME_FORMAT)
    )
    timed.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_user_parquet(users: DataFrame, path: str) -> str:
    users.write.mode("overwrite").parquet(path)
    return path


def read_user_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(USER_SCHEMA).parquet(path)


def save_user_table(users: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Create or replace a table; with a path the data stays in that folder."""
    writer = users.write.mode("overwrite").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return users.sparkSession.table(name)


def write_splits(raw: DataFrame, undecided: DataFrame, split: DataFrame, root: str) -> dict[str, str]:
    """The four datasets of one run: all users, undecided users, train and test users."""
    columns = raw.columns
    frames = {
        "users_raw": raw,
        "users_not_yet": undecided,
        "users_train": split.where(F.col("split") == "train").select(*columns),
        "users_test": split.where(F.col("split") == "test").select(*columns),
    }
    return {name: write_user_csv(frame, f"{root}/{name}") for name, frame in frames.items()}
