"""Reproducible splits: hash buckets, exact stratified hold-out, folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.functions.hashing import bucket, stable_hash
from ebbtide.schema import LABEL, USER


def hash_split(df: DataFrame, key: str = USER, buckets: int = 10, held_out: int = 9) -> DataFrame:
    """All rows but those of one hash bucket; a plain filter, no shuffle."""
    return df.where(bucket(key, buckets) != held_out)


def hash_held_out(df: DataFrame, key: str = USER, buckets: int = 10, held_out: int = 9) -> DataFrame:
    """The rows that `hash_split` leaves out."""
    return df.where(bucket(key, buckets) == held_out)


def kfold_assign(
    df: DataFrame, folds: int = 10, key: str = USER, seed: int = 42, name: str = "fold"
) -> DataFrame:
    """Each row belongs to one validation fold, given by a seeded hash of its key."""
    return df.withColumn(name, bucket(key, folds, seed))


def stratified_split(
    df: DataFrame,
    label: str = LABEL,
    key: str = USER,
    test_share: float = 0.1,
    seed: int = 42,
    cells: int = 4096,
) -> DataFrame:
    """Add `split` ('train' / 'test') with exactly ceil(share * rows) test rows, spread over
    the labels in proportion; a missing label counts as a label of its own.

    Rows are drawn in the order of a seeded hash. The hash range is cut into `cells`; counts
    per label and cell tell in which cell the quota of a label is reached. Cells below go to
    the test set whole, and only the rows of that one cell are ranked, so no task ever sorts
    a whole label.
    """
    hashed = df.withColumns(
        {"_h": stable_hash(key, seed), "_cell": (stable_hash(key, seed) * cells / 2**32).cast("int")}
    )
    per_cell = hashed.groupBy(label, "_cell").agg(F.count("*").alias("_n"))
    quota = _quotas(per_cell, label, test_share)
    upto = Window.partitionBy(label).orderBy("_cell")
    border = (
        per_cell.withColumn("_upto", F.sum("_n").over(upto))
        .join(F.broadcast(quota), F.col(label).eqNullSafe(F.col("_of")))
        .where((F.col("_upto") - F.col("_n") < F.col("_quota")) & (F.col("_upto") >= F.col("_quota")))
        .select(
            F.col(label).alias("_label"),
            F.col("_cell").alias("_border"),
            (F.col("_quota") - F.col("_upto") + F.col("_n")).alias("_take"),
        )
    )
    marked = hashed.join(F.broadcast(border), F.col(label).eqNullSafe(F.col("_label")), "left")
    ranked_part = marked.where(F.col("_cell") == F.col("_border"))
    other_part = marked.where(
        F.col("_border").isNull() | (F.col("_cell") != F.col("_border"))
    )
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_h", key))
    in_border = ranked_part.withColumn("_test", rank <= F.col("_take"))
    elsewhere = other_part.withColumn(
        "_test", F.coalesce(F.col("_cell") < F.col("_border"), F.lit(False))
    )
    split = F.when(F.col("_test"), F.lit("test")).otherwise(F.lit("train"))
    return elsewhere.unionByName(in_border).select(*df.columns, split.alias("split"))


def _quotas(counts: DataFrame, label: str, test_share: float) -> DataFrame:
    """Test rows per label: proportional shares, rounded by largest remainder."""
    per_label = counts.groupBy(label).agg(F.sum("_n").alias("_rows"))
    total = per_label.agg(F.sum("_rows").alias("_total"))
    # rounded first: 0.1 * 30 is a little more than 3 in binary
    wanted = F.ceil(F.round(F.col("_total") * F.lit(test_share), 6))
    shares = per_label.crossJoin(F.broadcast(total)).withColumns(
        {"_share": F.col("_rows") * wanted / F.col("_total"), "_wanted": wanted}
    )
    shares = shares.withColumn("_floor", F.floor("_share"))
    # one row per label: a window over them is small
    whole = Window.partitionBy(F.lit(0))
    by_rest = whole.orderBy((F.col("_share") - F.col("_floor")).desc(), F.col(label))
    extra = F.col("_wanted") - F.sum("_floor").over(whole)
    return shares.select(
        F.col(label).alias("_of"),
        (F.col("_floor") + (F.row_number().over(by_rest) <= extra).cast("long")).alias("_quota"),
    )
