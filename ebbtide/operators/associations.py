"""Associations of columns: rank correlations, nominal associations, correlation of missing values.

All of them start from the counts of pairs of values: equal rows are combined first, so pairs are formed
of distinct rows, and rows with a missing value in either column do not count for that pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.running import running_totals
from ebbtide.operators.frequencies import name_at
from ebbtide.session import materialize

#: Cells of a pair that one task puts in order.
STRIP_CELLS = 1 << 18
PAIR = ["x_at", "y_at"]


def pair_counts(df: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """(x_at, y_at, x, y, n): how often two columns, by their positions, have two values together."""
    rows = df.groupBy(F.array(*[F.col(c).cast(kind) for c in columns]).alias("v")).agg(F.count("*").alias("n"))
    first = rows.select("n", "v", F.posexplode("v").alias("x_at", "x")).where("x IS NOT NULL")
    rest = F.slice("v", F.col("x_at") + 2, F.size("v"))
    both = first.select("n", "x_at", "x", F.posexplode(rest).alias("k", "y")).where("y IS NOT NULL")
    return both.groupBy("x_at", (F.col("x_at") + F.col("k") + 1).alias("y_at"), "x", "y").agg(F.sum("n").alias("n"))


def _margins(pairs: DataFrame) -> DataFrame:
    """(x_at, y_at, side, value, cnt, cells): rows and different partners of each value of a pair."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("value")) for s in ("x", "y")])
    return (
        pairs.select(*PAIR, "n", F.inline(sides))
        .groupBy(*PAIR, "side", "value")
        .agg(F.sum("n").alias("cnt"), F.count(F.lit(1)).alias("cells"))
    )


def _ranked(pairs: DataFrame, strip: int) -> tuple[DataFrame, DataFrame]:
    """Pairs with mid-ranks rx, ry and the strips bx, by that they lie in; and the margins.

    A strip holds the cells of neighbouring values, fewer than twice `strip`; a value is in one strip, and
    one with more cells is alone in its own.
    """
    start = F.col("cells_upto") - F.col("cells")
    running = running_totals(
        _margins(pairs), "value", {"cnt": "upto", "cells": "cells_upto"}, by=[*PAIR, "side"]
    )
    margins = materialize(
        running.select(
            *PAIR, "side", "value", "cnt",
            (F.col("upto") - (F.col("cnt") - 1) / 2).alias("rank"),
            (2 * F.floor(start / strip) + (F.col("cells") > strip).cast("int")).alias("strip"),
        ),
        "margins",
    )
    found = pairs
    for side in ("x", "y"):
        own = margins.where(F.col("side") == side).select(
            *PAIR, F.col("value").alias(side), F.col("rank").alias(f"r{side}"), F.col("strip").alias(f"b{side}")
        )
        found = found.join(own, [*PAIR, side])
    return materialize(found.select(*PAIR, "n", "rx", "ry", "bx", "by"), "ranked-pairs"), margins


def concordance(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> int | float:
    """Sum over all two cells of n * n' * sign(x' - x) * sign(y' - y).

    Inversions as merge sort counts them, all merges of a level at once: cells whose x differ in a bit
    and agree in the higher ones are the two halves of a merge.
    """
    _, x = np.unique(x, return_inverse=True)
    _, y = np.unique(y, return_inverse=True)
    n = n.astype(np.int64 if n.sum() < 1 << 31 else np.float64)
    total = 0
    for bit in range(int(x.max(initial=0)).bit_length()):
        key = (x >> (bit + 1)) * (int(y.max()) + 1) + y
        order = np.argsort(key, kind="stable")
        key, upper, weight = key[order], (x[order] >> bit & 1).astype(bool), n[order]
        merge = x[order] >> (bit + 1)
        below = np.concatenate([[0], np.cumsum(np.where(upper, 0, weight))])
        less = below[np.searchsorted(key, key)] - below[np.searchsorted(merge, merge)]
        more = below[np.searchsorted(merge, merge, "right")] - below[np.searchsorted(key, key, "right")]
        total += ((less - more) * weight)[upper].sum()
    return total


_SUMS = "x_at int, y_at int, s double"


def _strip_sums(cells: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Concordance inside each strip; strips in which all x are equal have none and are not sent."""
    sizes = cells.groupBy(*by).agg((F.min(x) < F.max(x)).alias("mixed")).where("mixed").drop("mixed")

    def count(table: pa.Table) -> pa.Table:
        s = concordance(*[table[c].to_numpy() for c in (x, y, "n")])
        ends = [[table[c][0].as_py()] for c in PAIR]
        return pa.table([*[pa.array(e, pa.int32()) for e in ends], pa.array([float(s)])], names=["x_at", "y_at", "s"])

    return cells.join(sizes, by, "left_semi").groupBy(*by).applyInArrow(count, _SUMS)


def kendall_sums(ranked: DataFrame, strip: int) -> DataFrame:
    """(x_at, y_at, s): concordant less discordant pairs of rows.

    Two cells meet in the strip of their x, or, if these differ, in the strip of their y, or, if both
    differ, as sums of two cells of the table of strips, which is counted in the same way.
    """
    parts = []
    while True:
        parts.append(_strip_sums(ranked, [*PAIR, "bx"], "rx", "ry"))
        parts.append(_strip_sums(ranked, [*PAIR, "by"], "bx", "ry"))
        coarse = ranked.groupBy(*PAIR, F.col("bx").alias("x"), F.col("by").alias("y")).agg(F.sum("n").alias("n"))
        coarse = materialize(coarse, "strip-pairs")
        if coarse.groupBy(*PAIR).count().agg(F.max("count")).first()[0] in (None, 1):
            break
        ranked, _ = _ranked(coarse, strip)
    total = parts[0]
    for part in parts[1:]:
        total = total.unionAll(part)
    return total.groupBy(*PAIR).agg(F.sum("s").alias("s"))


def _named(columns: list[str], *values: Column | str) -> list:
    return [name_at(columns, "x_at").alias("x"), name_at(columns, "y_at").alias("y"), *values]


def rank_correlations(df: DataFrame, columns: list[str], strip: int = STRIP_CELLS) -> DataFrame:
    """(x, y, n, spearman, kendall) of each two numeric columns: correlation of mid-ranks, and tau-b.

    NULL where a column is constant over the rows that have both values. Pairs without such rows are
    left out.
    """
    pairs = materialize(pair_counts(df, columns, "double"), "pair-counts")
    ranked, margins = _ranked(pairs, strip)
    same = F.col("cnt") * (F.col("cnt") - 1) / 2
    tied = margins.groupBy(*PAIR).agg(
        F.sum(F.when(F.col("side") == "x", F.col("cnt"))).alias("n"),
        *[F.sum(F.when(F.col("side") == s, same)).alias(f"tied_{s}") for s in ("x", "y")],
    )
    middle = (F.col("n_all") + 1) / 2
    moved = [F.col(c) - middle for c in ("rx", "ry")]
    weighted = lambda a, b: F.sum(F.col("n") * moved[a] * moved[b])
    spearman = (
        ranked.join(tied.select(*PAIR, F.col("n").alias("n_all")), PAIR)
        .groupBy(*PAIR)
        .agg(F.try_divide(weighted(0, 1), F.sqrt(weighted(0, 0) * weighted(1, 1))).alias("spearman"))
    )
    all_pairs = F.col("n") * (F.col("n") - 1) / 2
    loose = F.sqrt((all_pairs - F.col("tied_x")) * (all_pairs - F.col("tied_y")))
    return (
        tied.join(spearman, PAIR)
        .join(kendall_sums(ranked, strip), PAIR, "left")
        .select(*_named(columns, "n", "spearman", F.try_divide(F.coalesce("s", F.lit(0.0)), loose).alias("kendall")))
    )


def nominal_associations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x, y, n, categories_x, categories_y, cramers_v) of each two columns, with bias correction.

    NULL where a column has one category only over the rows that have both values.
    """
    pairs = materialize(pair_counts(df, columns, "string"), "category-pairs")
    margins = materialize(_margins(pairs), "category-margins")
    sizes = margins.groupBy(*PAIR).agg(
        F.sum(F.when(F.col("side") == "x", F.col("cnt"))).alias("n"),
        F.count_if(F.col("side") == "x").alias("categories_x"),
        F.count_if(F.col("side") == "y").alias("categories_y"),
    )
    cells = pairs
    for side in ("x", "y"):
        own = margins.where(F.col("side") == side).select(*PAIR, F.col("value").alias(side), F.col("cnt").alias(f"n{side}"))
        cells = cells.join(own, [*PAIR, side])
    share = F.col("n").cast("double") * F.col("n") / F.col("nx") / F.col("ny")
    phi = cells.groupBy(*PAIR).agg((F.sum(share) - 1).alias("phi"))
    rows, kx, ky = F.col("n") - 1, F.col("categories_x"), F.col("categories_y")
    unbiased = F.greatest(F.lit(0.0), F.col("phi") - F.try_divide(((kx - 1) * (ky - 1)).cast("double"), rows))
    shrunk = [k - F.try_divide(((k - 1) * (k - 1)).cast("double"), rows) for k in (kx, ky)]
    v = F.sqrt(F.try_divide(unbiased, F.least(*[s - 1 for s in shrunk])))
    return sizes.join(phi, PAIR).select(
        *_named(columns, "n", "categories_x", "categories_y", F.when((kx > 1) & (ky > 1), v).alias("cramers_v"))
    )


def missing_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x, y, missing_x, missing_y, both, corr) of each two columns that have missing and present values."""
    rows = df.groupBy(F.array(*[F.col(c).isNull().cast("int") for c in columns]).alias("v")).agg(F.count("*").alias("n"))
    rows = materialize(rows, "missing-patterns")
    single = rows.select("n", F.posexplode("v").alias("at", "m")).groupBy("at").agg(
        F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("m")).alias("missing")
    )
    single = single.where("missing > 0 AND missing < rows")
    first = rows.select("n", "v", F.posexplode("v").alias("x_at", "mx"))
    rest = F.slice("v", F.col("x_at") + 2, F.size("v"))
    both = (
        first.select("n", "x_at", "mx", F.posexplode(rest).alias("k", "my"))
        .groupBy("x_at", (F.col("x_at") + F.col("k") + 1).alias("y_at"))
        .agg(F.sum(F.col("n") * F.col("mx") * F.col("my")).alias("both"))
    )
    side = lambda s: single.select(
        F.col("at").alias(f"{s}_at"), F.col("missing").alias(f"missing_{s}"), F.col("rows").alias(f"rows_{s}")
    )
    n, mx, my = (F.col(c).cast("double") for c in ("rows_x", "missing_x", "missing_y"))
    corr = (n * F.col("both") - mx * my) / F.sqrt(mx * (n - mx) * my * (n - my))
    found = both.join(side("x"), "x_at").join(side("y"), "y_at")
    return found.select(*_named(columns, "missing_x", "missing_y", "both", corr.alias("corr")))
