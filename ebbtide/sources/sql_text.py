"""Run a SQL statement kept in a file; the result stays distributed."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SQL_FOLDER = Path(__file__).resolve().parent.parent / "plans" / "sql"


def run_sql_file(
    spark: SparkSession,
    path: str | Path,
    args: dict | None = None,
    frames: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Named parameters `:name` are bound from `args`, `{name}` stands for a frame of `frames`."""
    text = Path(path).read_text(encoding="utf-8")
    return spark.sql(text, args=args or {}, **(frames or {}))
