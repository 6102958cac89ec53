"""Bucketised counters and the SQL feature clause that travels with a model."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer, SQLTransformer
from pyspark.sql import Column
from pyspark.sql import functions as F

from ebbtide.schema import COUNTERS, LABEL

# Split points of the bucketised counters.
COUNTER_SPLITS = (0, 1, 2, 3, 4)


def bucket_label(value: Column, splits: tuple = COUNTER_SPLITS) -> Column:
    """'bin_1' below the first split, then one bin per split, closed on the left; NULL stays."""
    position = F.lit(1)
    for split in splits:
        position = position + (value >= F.lit(split)).cast("int")
    return F.concat(F.lit("bin_"), position.cast("string"))


def bucketizer(columns: tuple[str, ...] = COUNTERS, splits: tuple = COUNTER_SPLITS) -> Bucketizer:
    """The same bins as numbers 0...len(splits), as an ML stage."""
    edges = [-math.inf, *[float(s) for s in splits], math.inf]
    return Bucketizer(
        splitsArray=[edges] * len(columns),
        inputCols=list(columns),
        outputCols=[f"{c}_bin" for c in columns],
    )


def bucket_clause(columns: tuple[str, ...] = COUNTERS, label: str | None = LABEL) -> str:
    """SQL select list: missing counters as 0, bucketised; nothing else gets through but the label."""
    terms = []
    for c in columns:
        position = " + ".join(f"int(coalesce({c}, 0) >= {s})" for s in COUNTER_SPLITS)
        terms.append(f"concat('bin_', string(1 + {position})) AS {c}")
    if label:
        terms.append(label)
    return ", ".join(terms)


def transform_clause(select_list: str, keep: tuple[str, ...] = ()) -> SQLTransformer:
    """A select list as first stage of a model: columns it does not list are dropped."""
    listed = ", ".join([*keep, select_list])
    return SQLTransformer(statement=f"SELECT {listed} FROM __THIS__")
