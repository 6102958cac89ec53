"""Feature stages: edge values, unseen categories, persistence."""

import statistics

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ebbtide.features import buckets, builder, categories, impute, scale, weights
from ebbtide.registry import common


def column(frame, name):
    return [r[name] for r in frame.select(name).collect()]


def words(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "c string")


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "x double")


def test_mode_tie_goes_to_the_smallest(spark):
    df = words(spark, "b", "a", "b", "a", None)
    model = impute.ModeImputer(inputCols=["c"]).fit(df)
    assert sorted(column(model.transform(df), "c")) == ["a", "a", "a", "b", "b"]


def test_mode_of_a_column_without_values(spark):
    df = words(spark, None, None)
    assert column(impute.ModeImputer(inputCols=["c"]).fit(df).transform(df), "c") == [None, None]


def test_constant_imputer(spark):
    stage = impute.ConstantImputer(inputCols=["x"], outputCols=["y"], fillValue=0.0)
    assert column(stage.transform(numbers(spark, None, 3.0)), "y") == [0.0, 3.0]


def test_zscore_uses_population_or_sample_deviation(spark):
    values = [1.0, 2.0, 4.0, 9.0]
    df = numbers(spark, *values)
    for ddof, deviation in ((0, statistics.pstdev(values)), (1, statistics.stdev(values))):
        model = scale.ZScaler(inputCols=["x"], outputCols=["y"], ddof=ddof).fit(df)
        assert column(model.transform(df), "y") == pytest.approx([(v - 4.0) / deviation for v in values])


def test_constant_column_is_centred_only(spark):
    df = numbers(spark, 5.0, 5.0)
    for stage in (scale.ZScaler(inputCols=["x"]), scale.RangeScaler(inputCols=["x"])):
        assert column(stage.fit(df).transform(df), "x") == [0.0, 0.0]


def test_quantile_scaler_matches_interpolation(spark):
    values = [float(v) for v in [0, 0, 0, 1, 2, 2, 3, 5, 8, 40]]
    df = numbers(spark, *values)
    grid = np.linspace(0, 1, 11)
    landmarks = np.quantile(values, grid)
    asked = [-1.0, 0.0, 0.5, 1.0, 2.0, 2.5, 8.0, 39.0, 40.0, 99.0]
    up = np.interp(asked, landmarks, grid)
    down = -np.interp([-a for a in asked], -landmarks[::-1], -grid[::-1])
    expected = (up + down) / 2
    expected = np.where(np.array(asked) <= 0, 0, np.where(np.array(asked) >= 40, 1, expected))
    model = scale.QuantileScaler(inputCols=["x"], outputCols=["y"], quantiles=11, exact=True).fit(df)
    assert column(model.transform(numbers(spark, *asked)), "y") == pytest.approx(list(expected))


def test_quantile_scaler_keeps_order_and_missing(spark, train):
    stage = scale.QuantileScaler(inputCols=["cnt_post_score"], outputCols=["y"], output="normal")
    rows = stage.fit(train).transform(train).select("cnt_post_score", "y").distinct().collect()
    ordered = [r["y"] for r in sorted(rows)]
    assert ordered == sorted(ordered) and min(ordered) >= -5.2 and max(ordered) <= 5.2
    assert column(stage.fit(train).transform(train.limit(1).withColumn("cnt_post_score", F.lit(None).cast("long"))), "y") == [None]


def test_probit_inverts_the_normal_distribution(spark):
    normal = statistics.NormalDist()
    ps = [0.0001, 0.02, 0.3, 0.5, 0.9, 0.99, 0.99999]
    got = column(numbers(spark, *ps).select(scale.probit(F.col("x")).alias("y")), "y")
    assert got == pytest.approx([normal.inv_cdf(p) for p in ps], abs=1e-7)


def test_unseen_and_missing_categories_get_the_zero_vector(spark):
    stages = categories.onehot_stages(["c"])
    model = Pipeline(stages=stages).fit(words(spark, "b", "a", "c", None))
    out = model.transform(words(spark, "a", "c", "new", None))
    assert column(out.select(vector_to_array("c_onehot").alias("v")), "v") == [
        [1.0, 0.0, 0.0], [0.0, 0.0, 1.0], [0.0] * 3, [0.0] * 3,
    ]


def test_unseen_categories_can_be_an_error(spark):
    model = Pipeline(stages=categories.onehot_stages(["c"], unknown="error")).fit(words(spark, "a", "b"))
    assert column(model.transform(words(spark, "b")).select(vector_to_array("c_onehot").alias("v")), "v") == [[0.0, 1.0]]
    with pytest.raises(Exception):
        model.transform(words(spark, "new")).collect()


def test_common_categories_alphabetic_and_by_frequency(spark):
    df = words(spark, *["a"] * 1, *["b"] * 6, *["c"] * 2, *["d"] * 1)
    by_value = categories.CommonCategories(inputCols=["c"], threshold=0.8).fit(df)
    assert set(column(by_value.transform(df), "c")) == {"a", "b", "other"}
    by_count = categories.CommonCategories(inputCols=["c"], threshold=0.85, order="frequency").fit(df)
    assert set(column(by_count.transform(df), "c")) == {"b", "c", "other"}


def test_first_category_at_the_threshold_makes_all_other(spark):
    df = words(spark, *["a"] * 8, "b", "c")
    model = categories.CommonCategories(inputCols=["c"], threshold=0.8).fit(df)
    assert set(column(model.transform(df), "c")) == {"other"}


def test_recode_with_a_table_equals_recode_in_the_model(spark, train):
    kept = categories.common_categories(train, ["country_name"]).select("value")
    by_table = categories.recode_other(train, "country_name", kept)
    by_model = categories.CommonCategories(inputCols=["country_name"]).fit(train).transform(train)
    assert sorted(column(by_table, "country_name")) == sorted(column(by_model, "country_name"))


def test_token_counts(spark):
    df = words(spark, "A\nb\na", "b", "c\na", None)
    counts = categories.TokenVectorizer(inputCols=["c"], outputCols=["v"], sizes=[2])
    assert column(counts.fit(df).transform(df), "v") == [[2.0, 1.0], [0.0, 1.0], [1.0, 0.0], [0.0, 0.0]]
    exact = categories.TokenVectorizer(inputCols=["c"], outputCols=["v"], sizes=[9], lowercase=False, binary=True)
    assert column(exact.fit(df).transform(df), "v")[0] == [1.0, 1.0, 1.0, 0.0]


def test_bucket_edges(spark):
    df = numbers(spark, -1.0, 0.0, 0.5, 1.0, 4.0, 99.0, None)
    assert column(df.select(buckets.bucket_label(F.col("x")).alias("b")), "b") == [
        "bin_1", "bin_2", "bin_2", "bin_3", "bin_6", "bin_6", None,
    ]


def test_sql_clause_drops_what_it_does_not_list(train):
    out = buckets.transform_clause(buckets.bucket_clause()).transform(train)
    assert "country_name" not in out.columns and out.columns[-1] == "churned"


def test_feature_vector_width_and_names(train):
    vectors = Pipeline(stages=builder.feature_stages()).fit(train).transform(train)
    names = builder.feature_names(vectors)
    distinct = sum(train.select(c).na.drop().distinct().count() for c in builder.ColumnRoles().categorical)
    assert len(names) == 11 + distinct and names[0] == "cnt_user_engagement"
    assert "device_os_IOS" in names


def test_no_columns_is_an_error():
    with pytest.raises(ValueError):
        builder.feature_stages(numeric=False, categorical=False)


def test_stages_survive_saving(train, tmp_path):
    stages = builder.feature_stages(most_common=0.8)
    stages.append(scale.QuantileScaler(inputCols=["cnt_post_score"], outputCols=["q"], quantiles=20))
    stages.append(categories.TokenVectorizer(inputCols=["country_name"], outputCols=["t"], sizes=[3]))
    stages.append(weights.LabelWeighter())
    model = Pipeline(stages=stages).fit(train)
    model.write().save(f"{tmp_path}/m")
    again = PipelineModel.load(f"{tmp_path}/m")
    wanted = ["features", "q", "t", "_weight"]
    assert again.transform(train).select(wanted).collect() == model.transform(train).select(wanted).collect()


def test_weights_stage_equals_the_frame_operator(spark, train):
    from ebbtide.operators.weighting import balanced_weights, base_rate_weights

    for scheme, operator in (("balanced", balanced_weights), ("base_rate", base_rate_weights)):
        stage = weights.LabelWeighter(scheme=scheme).fit(train)
        a = sorted(column(stage.transform(train), "_weight"))
        assert a == pytest.approx(sorted(column(operator(train), "weight")))
    assert set(column(stage.transform(train.drop("churned")), "_weight")) == {1.0}


def test_registered_users_are_written_once(spark, folder):
    assert common.users_folder(spark, folder) == common.users_folder(spark, folder)
