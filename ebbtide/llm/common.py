"""Helpers shared by the operators: tables, stages on the shared folder, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.session import materialize, release

#: White space of the contracts: space and the ASCII controls from tab to carriage return.
BLANKS = r"[\x20\x09-\x0D]+"

#: Two salts make a 128-bit key of two 64-bit hashes.
SALTS = (1, 2)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_pair(*columns, seed: int = 0):
    """Two 64-bit hashes of the columns, for a key of 128 bits."""
    return [F.xxhash64(F.lit(seed * 2 + salt), *columns) for salt in SALTS]


def identity(id_col, *others, text=None) -> list:
    """Columns without nulls by which a row of documents is found again: its id and `others` as texts, each
    beside whether it is null, and, if `text` is given, hashes of that."""
    parts = []
    for column in (id_col, *others):
        parts += [column.isNull(), F.coalesce(column.cast("string"), F.lit(""))]
    parts += hash_pair(text) if text is not None else []
    return [part.alias(f"part{i}") for i, part in enumerate(parts)]


def matching_rows(
    docs: DataFrame, keys: list, chosen: DataFrame, times: str | None = None, every: bool = False
) -> DataFrame:
    """The rows of `docs` whose `keys` are those of a row of `chosen`, with all their columns and no
    others. Of rows with equal keys one is taken, or one as often as the column `times` of `chosen` says,
    or every one.

    The columns of `chosen` are its keys, and `times` behind them. Rows are packed while they are matched, so no column of
    `docs` can clash. They are shuffled once, by their keys, equal ones combined before; the join and the
    choice of one row use that same exchange.
    """
    names = [f"key{i}" for i in range(len(keys))]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[k.alias(n) for k, n in zip(keys, names)]
    )
    if not every:
        rows = rows.dropDuplicates(names)
    wanted = chosen.toDF(*names, *([times] if times else []))
    if not times:
        return rows.join(wanted, names, "left_semi").select("row.*")
    found = rows.join(wanted, names)
    return found.select("row", F.explode(F.sequence(F.lit(1).cast("long"), times)).alias("copy")).select("row.*")


def components(edges: DataFrame, purpose: str) -> DataFrame:
    """(node, component) for each node of the undirected edges (a, b): the smallest node reachable.

    Alternating large-star and small-star steps: each node links its neighbours to the smallest
    of them, until a pass changes nothing. Every step is one aggregate and one join on longs, and
    is written to the shared folder, so lineage stays short and a lost executor costs one step.
    The links of one node are never gathered; only a changed-links count reaches the driver.
    """
    links = materialize(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        purpose,
    )
    before = None
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        ).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        old = links
        links = materialize(
            small.where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b")))
            .distinct(),
            purpose,
        )
        release(old)
        # A forest of stars has reached its end when the same links come out again.
        after = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(after) == before:
            break
        before = tuple(after)
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
