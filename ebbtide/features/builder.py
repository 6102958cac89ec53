"""Feature stages per column role, put side by side into one vector."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame

from ebbtide.features.categories import CommonCategories, onehot_stages
from ebbtide.features.impute import ConstantImputer, ModeImputer
from ebbtide.features.scale import ZScaler
from ebbtide.schema import ColumnRoles

FEATURES = "features"


def feature_stages(
    numeric: bool = True,
    categorical: bool = True,
    most_common: float | None = None,
    roles: ColumnRoles = ColumnRoles(),
    order: str = "value",
) -> list:
    """Numeric columns: 0 for missing, z-score. Categories: mode for missing, optionally only
    common ones, one-hot. Ignored columns stay in the frame but not in the vector."""
    stages: list = []
    vectors: list[str] = []
    if numeric and roles.numeric:
        columns = list(roles.numeric)
        scaled = [f"{c}_scaled" for c in columns]
        filled = [f"{c}_filled" for c in columns]
        stages += [
            ConstantImputer(inputCols=columns, outputCols=filled, fillValue=0.0),
            ZScaler(inputCols=filled, outputCols=scaled),
        ]
        vectors += scaled
    if categorical and roles.categorical:
        columns = list(roles.categorical)
        filled = [f"{c}_known" for c in columns]
        stages.append(ModeImputer(inputCols=columns, outputCols=filled))
        if most_common:
            stages.append(CommonCategories(inputCols=filled, threshold=most_common, order=order))
        stages += onehot_stages(filled)
        vectors += [f"{c}_onehot" for c in filled]
    if not vectors:
        raise ValueError("no feature columns: switch on numeric or categorical")
    stages.append(VectorAssembler(inputCols=vectors, outputCol=FEATURES))
    return stages


def feature_names(df: DataFrame, vector: str = FEATURES) -> list[str]:
    """Names of the vector's positions, read from the metadata of the column."""
    groups = df.schema[vector].metadata["ml_attr"]["attrs"]
    named = {a["idx"]: a["name"] for group in groups.values() for a in group}
    return [_plain(named[i]) for i in range(len(named))]


def _plain(name: str) -> str:
    """`country_name_known_onehot_PERU` -> `country_name_PERU`, `x_scaled` -> `x`."""
    return name.replace("_known_onehot_", "_").removesuffix("_scaled")
