"""Queries on splits, weights, files and feature stages."""

from __future__ import annotations

import re

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ebbtide.features import buckets, builder, categories, impute, scale
from ebbtide.models.recipes import RECIPES, recipe_stages
from ebbtide.operators import splitting, weighting
from ebbtide.registry import common
from ebbtide.registry.exploration import rounded, union_all
from ebbtide.registry.oracle import TRAIN, USERS, bucket_sql, hash_sql, q
from ebbtide.schema import CATEGORIES, COUNTERS, IGNORED, LABEL, USER
from ebbtide.session import shared_dir
from ebbtide.sources import user_files

ONE = "cnt_user_engagement"


def label_feature_split(spark, folder):
    """Features as one vector, shown to six places, and the label beside it, in one frame."""
    users = common.train(spark, folder)
    stages = Pipeline(stages=builder.feature_stages()).fit(users)
    shown = F.transform(vector_to_array(builder.FEATURES), lambda x: F.round(x, 6) + 0.0)
    return stages.transform(users).select(USER, F.col(LABEL).alias("label"), shown.alias("features"))


def drop_ignored(spark, folder):
    """What is left after the ignored columns are dropped."""
    return common.train(spark, folder).drop(*IGNORED)


def hash_split(spark, folder):
    return splitting.hash_split(common.train(spark, folder)).select(USER, LABEL)


def stratified_split(spark, folder):
    return splitting.stratified_split(common.train(spark, folder)).select(USER, LABEL, "split")


def kfold_assign(spark, folder):
    return splitting.kfold_assign(common.train(spark, folder)).select(USER, "fold")


def base_rate_weights(spark, folder):
    weighted = weighting.base_rate_weights(common.train(spark, folder))
    return rounded(weighted.select(USER, LABEL, "weight"), "weight")


def balanced_weights(spark, folder):
    weighted = weighting.balanced_weights(common.train(spark, folder))
    return rounded(weighted.select(USER, LABEL, "weight"), "weight")


def scan_user_csv(spark, folder):
    path = shared_dir(spark, "users-csv")
    user_files.write_user_csv(common.users(spark, folder), path)
    return user_files.read_user_csv(spark, path)


def scan_user_csv_time(spark, folder):
    path = shared_dir(spark, "users-csv")
    user_files.write_user_csv(common.users(spark, folder), path)
    return common.shown(user_files.read_user_csv_with_time(spark, path))


def sink_user_csv(spark, folder):
    """Rows and churned users of the four written datasets, read back."""
    users = common.users(spark, folder)
    split = splitting.stratified_split(common.train(spark, folder))
    paths = user_files.write_splits(
        users, common.not_yet(spark, folder), split, shared_dir(spark, "splits")
    )
    parts = [
        user_files.read_user_csv(spark, path)
        .agg(F.count("*").alias("users"), F.sum(LABEL).alias("churned_users"))
        .withColumn("dataset", F.lit(name))
        for name, path in paths.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def sink_user_table(spark, folder):
    """Saved as a table in the shared folder and read back."""
    name = "users_" + re.sub(r"\W", "_", folder)
    path = shared_dir(spark, "users-table")
    return common.shown(user_files.save_user_table(common.users(spark, folder), name, path))


def null_to_zero(spark, folder):
    users = common.users(spark, folder)
    return users.select(USER, *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTERS])


def bucketize(spark, folder):
    users = common.train(spark, folder)
    return users.select(USER, *[buckets.bucket_label(F.col(c)).alias(c) for c in COUNTERS])


def bucketize_index(spark, folder):
    """The same bins as numbers, from the ML stage."""
    binned = buckets.bucketizer().transform(common.train(spark, folder))
    return binned.select(USER, *[F.col(f"{c}_bin").alias(c) for c in COUNTERS])


def model_transform_sql(spark, folder):
    stage = buckets.transform_clause(buckets.bucket_clause())
    return stage.transform(common.train(spark, folder))


def impute_constant(spark, folder):
    stage = impute.ConstantImputer(inputCols=list(COUNTERS))
    return stage.transform(common.users(spark, folder)).select(USER, *COUNTERS)


def impute_mode(spark, folder):
    users = common.users(spark, folder)
    stage = impute.ModeImputer(inputCols=list(CATEGORIES)).fit(users)
    return stage.transform(users).select(USER, *CATEGORIES)


def _scaled(spark, folder, stage, column=ONE):
    users = common.train(spark, folder)
    return rounded(stage.fit(users).transform(users).select(USER, "scaled"), "scaled")


def zscore_population(spark, folder):
    return _scaled(spark, folder, scale.ZScaler(inputCols=[ONE], outputCols=["scaled"]))


def zscore_sample(spark, folder):
    return _scaled(spark, folder, scale.ZScaler(inputCols=[ONE], outputCols=["scaled"], ddof=1))


def minmax_scale(spark, folder):
    return _scaled(spark, folder, scale.RangeScaler(inputCols=[ONE], outputCols=["scaled"]))


def quantile_transform(spark, folder):
    users = common.train(spark, folder)
    out = users
    for kind in ("uniform", "normal"):
        stage = scale.QuantileScaler(inputCols=[ONE], outputCols=[kind], output=kind)
        out = stage.fit(users).transform(out)
    return rounded(out.select(USER, F.col(ONE).alias("value"), "uniform", "normal"), "uniform", "normal")


def ordinal_encode(spark, folder):
    users = common.train(spark, folder).select(USER, "country_name").na.drop()
    stage = categories.ordinal_indexer(["country_name"], ["code"]).fit(users)
    return stage.transform(users)


def onehot_encode(spark, folder):
    """Position of the one of each user; learned on the 90 % part, applied to all users."""
    learn, _ = common.halves(spark, folder)
    stages = Pipeline(stages=categories.onehot_stages(["device_lang"])).fit(learn)
    cells = F.posexplode(vector_to_array("device_lang_onehot")).alias("position", "value")
    return stages.transform(common.users(spark, folder)).select(USER, cells)


def _vectorizer(columns, sizes, **kind):
    return categories.TokenVectorizer(
        inputCols=columns, outputCols=[f"{c}_tokens" for c in columns], sizes=sizes, **kind
    )


def _vectors_long(spark, folder, stage, columns):
    users = common.train(spark, folder)
    vectors = stage.fit(users).transform(users)
    parts = [
        vectors.select(USER, F.lit(c).alias("column"), F.posexplode(f"{c}_tokens").alias("index", "value"))
        for c in columns
    ]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    return stacked


def count_vectorize(spark, folder):
    stage = _vectorizer(["country_name"], [3], binary=True)
    return _vectors_long(spark, folder, stage, ["country_name"])


def count_vocabulary(spark, folder):
    stage = _vectorizer(list(CATEGORIES), [3, 5, 8], lowercase=False)
    return stage.vocabulary(common.train(spark, folder))


def count_vectorize_multi(spark, folder):
    stage = _vectorizer(list(CATEGORIES), [3, 5, 8], lowercase=False, binary=True)
    return _vectors_long(spark, folder, stage, list(CATEGORIES))


def most_common_categories(spark, folder):
    kept = categories.common_categories(common.train(spark, folder), list(CATEGORIES))
    return rounded(kept, "share")


def most_common_by_frequency(spark, folder):
    kept = categories.common_categories(
        common.train(spark, folder), list(CATEGORIES), order="frequency"
    )
    return rounded(kept, "share")


def recode_other(spark, folder):
    users = common.train(spark, folder)
    stage = categories.CommonCategories(inputCols=list(CATEGORIES)).fit(users)
    return stage.transform(users).select(USER, *CATEGORIES)


def column_transformer(spark, folder):
    """Width of the vector for each set of switches, and whether all rows have it."""
    users = common.train(spark, folder)
    cases = {
        "numeric": {"categorical": False},
        "categorical": {"numeric": False},
        "both": {},
        "both_common": {"most_common": 0.8},
    }
    parts = []
    for name, switches in cases.items():
        stages = Pipeline(stages=builder.feature_stages(**switches)).fit(users)
        size = F.size(vector_to_array(builder.FEATURES))
        parts.append(
            stages.transform(users)
            .groupBy(F.lit(name).alias("case"), size.alias("width"))
            .agg(F.count("*").alias("users"))
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def feature_names(spark, folder):
    """Names of the vector's positions with the mean of each over the users."""
    users = common.train(spark, folder)
    vectors = Pipeline(stages=builder.feature_stages()).fit(users).transform(users)
    names = builder.feature_names(vectors)
    cells = F.posexplode(vector_to_array(builder.FEATURES)).alias("position", "value")
    means = vectors.select(cells).groupBy("position").agg(F.avg("value").alias("mean"))
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("position") + 1)
    return rounded(means.select("position", name.alias("feature"), "mean"), "mean").withColumn("mean", F.col("mean") + 0.0)


def fit_transform_stages(spark, folder):
    """Feature stages fitted and applied: names and values per user, long."""
    users = common.train(spark, folder)
    vectors = Pipeline(stages=builder.feature_stages()).fit(users).transform(users)
    names = F.array(*[F.lit(n) for n in builder.feature_names(vectors)])
    cells = F.arrays_zip(names.alias("feature"), vector_to_array(builder.FEATURES).alias("value"))
    return rounded(vectors.select(USER, F.inline(cells).alias("feature", "value")), "value")


def transform_all_but_ids(spark, folder):
    """Feature stages of the network: all columns but id and time, flags included."""
    users = common.train(spark, folder)
    vectors = Pipeline(stages=recipe_stages(RECIPES["perceptron_sql"])).fit(users).transform(users)
    return vectors.select(USER, F.size(vector_to_array(builder.FEATURES)).alias("width"))


QUERIES = {
    name: globals()[name]
    for name in (
        "label_feature_split", "drop_ignored", "hash_split", "stratified_split", "kfold_assign",
        "base_rate_weights", "balanced_weights", "scan_user_csv", "scan_user_csv_time",
        "sink_user_csv", "sink_user_table", "null_to_zero", "bucketize", "bucketize_index",
        "model_transform_sql", "impute_constant", "impute_mode", "zscore_population",
        "zscore_sample", "minmax_scale", "quantile_transform", "ordinal_encode", "onehot_encode",
        "count_vectorize", "count_vocabulary", "count_vectorize_multi", "most_common_categories",
        "most_common_by_frequency", "recode_other", "column_transformer", "feature_names",
        "fit_transform_stages", "transform_all_but_ids",
    )
}

_LABEL_COUNTS = f"""{TRAIN}, c AS (SELECT count(*) AS n, CAST(sum(churned) AS BIGINT) AS p FROM train)"""
# the quota of a label: proportional share of ceil(n / 10), rounded by largest remainder
SPLIT = f"""{TRAIN},
s_n AS (SELECT churned, count(*) AS n FROM train GROUP BY churned),
s_all AS (SELECT CAST(sum(n) AS BIGINT) AS total, CAST(ceil(sum(n) / 10) AS BIGINT) AS wanted FROM s_n),
s_q AS (SELECT churned, n * wanted // total AS low, (n * wanted) % total AS rest, wanted FROM s_n, s_all),
s_quota AS (SELECT churned, low + CASE WHEN row_number() OVER (ORDER BY rest DESC, churned)
    <= wanted - sum(low) OVER () THEN 1 ELSE 0 END AS quota FROM s_q),
s_rank AS (SELECT *, row_number() OVER
    (PARTITION BY churned ORDER BY {hash_sql('user_pseudo_id', 42)}, user_pseudo_id) AS r FROM train),
split AS (SELECT s_rank.*, CASE WHEN r <= quota THEN 'test' ELSE 'train' END AS split
    FROM s_rank JOIN s_quota USING (churned))"""
_BINS = " + ".join("CAST({c} >= %d AS INTEGER)" % s for s in buckets.COUNTER_SPLITS)


def _bins(columns, template: str) -> str:
    return ", ".join(template.format(c=c, position=_BINS.format(c=c)) for c in columns)


def _mode(column: str, source: str) -> str:
    return f"""(SELECT {column} FROM {source} WHERE {column} IS NOT NULL GROUP BY {column}
    ORDER BY count(*) DESC, {column} LIMIT 1)"""


def _vocabulary(column: str, size: int, lowercase: bool) -> str:
    token = f"lower({column})" if lowercase else column
    return f"""SELECT '{column}' AS "column", token, frequency,
    CAST(row_number() OVER (ORDER BY token) - 1 AS INTEGER) AS index FROM
    (SELECT {token} AS token, count(*) AS frequency FROM train WHERE {column} IS NOT NULL
     GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {size})"""


def _tokens_long(column: str, lowercase: bool) -> str:
    token = f"lower({column})" if lowercase else column
    return f"""SELECT user_pseudo_id, '{column}' AS "column", index,
    CASE WHEN {token} = token THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value
    FROM train CROSS JOIN vocab WHERE vocab."column" = '{column}'"""


_VOCAB = union_all(
    f"SELECT * FROM ({_vocabulary(c, n, False)})" for c, n in zip(CATEGORIES, (3, 5, 8))
)


def _common(order: str) -> str:
    return f"""{TRAIN}, freq AS ({union_all(
        f'''SELECT '{c}' AS "column", {c} AS value, count(*) AS cnt FROM train
        WHERE {c} IS NOT NULL GROUP BY ALL''' for c in CATEGORIES)}),
    running AS (SELECT *, CAST(sum(cnt) OVER (PARTITION BY "column" ORDER BY {order}
        ROWS UNBOUNDED PRECEDING) AS DOUBLE) / sum(cnt) OVER (PARTITION BY "column") AS share FROM freq),
    kept AS (SELECT * FROM running WHERE share < 0.8::DOUBLE)"""


def _recoded(column: str) -> str:
    return f"""CASE WHEN {column} IS NULL OR {column} IN
    (SELECT value FROM kept WHERE "column" = '{column}') THEN {column} ELSE 'other' END AS {column}"""


_FEATURE_PARTS = [
    *[
        f"""SELECT user_pseudo_id, '{c}' AS feature, round((coalesce({c}, 0)
        - avg(coalesce({c}, 0)) OVER ()) / coalesce(nullif(stddev_pop(coalesce({c}, 0)) OVER (), 0), 1), 6)
        AS value FROM train"""
        for c in COUNTERS
    ],
    *[
        f"""SELECT user_pseudo_id, '{c}_' || cat AS feature,
        CASE WHEN coalesce({c}, {_mode(c, 'train')}) = cat THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value
        FROM train CROSS JOIN (SELECT DISTINCT {c} AS cat FROM train WHERE {c} IS NOT NULL)"""
        for c in CATEGORIES
    ],
]

# each cell with the place of its column; categories of a column stand in alphabetic order
_FEATURE_CELLS = f"""{TRAIN}, cells AS ({union_all(
    f"SELECT {i} AS place, * FROM ({part})" for i, part in enumerate(_FEATURE_PARTS)
)})"""

_WIDTHS = " + ".join(f"count(DISTINCT {c})" for c in CATEGORIES)
# the kept categories of each column, and 'other' if there are others
_COMMON_WIDTH = " + ".join(
    f"""(SELECT count(*) + CASE WHEN count(*) < (SELECT count(DISTINCT {c}) FROM train)
    THEN 1 ELSE 0 END FROM kept WHERE "column" = '{c}')"""
    for c in CATEGORIES
)

ORACLE = {
    "column_transformer": q(
        # missing values count as the most frequent one before the shares are taken
        _common("value").replace(
            "FROM train\n        WHERE",
            "FROM filled\n        WHERE",
        ).replace(
            "freq AS (",
            "filled AS (SELECT "
            + ", ".join(f"coalesce({c}, {_mode(c, 'train')}) AS {c}" for c in CATEGORIES)
            + " FROM train), freq AS (",
        ),
        f"""SELECT 'numeric' AS "case", CAST({len(COUNTERS)} AS INTEGER) AS width, count(*) AS users FROM train
        UNION ALL SELECT 'categorical', CAST({_WIDTHS} AS INTEGER), count(*) FROM train
        UNION ALL SELECT 'both', CAST({len(COUNTERS)} + {_WIDTHS} AS INTEGER), count(*) FROM train
        UNION ALL SELECT 'both_common', CAST({len(COUNTERS)} + {_COMMON_WIDTH} AS INTEGER), count(*) FROM train""",
    ),
    "transform_all_but_ids": q(
        TRAIN,
        f"""SELECT user_pseudo_id, CAST({len(COUNTERS)} + 2 +
        (SELECT {_WIDTHS} FROM train) AS INTEGER) AS width FROM train""",
    ),
    "drop_ignored": q(TRAIN, f"SELECT * EXCLUDE ({', '.join(IGNORED)}) FROM train"),
    "hash_split": q(
        TRAIN,
        f"SELECT user_pseudo_id, churned FROM train WHERE {bucket_sql('user_pseudo_id', 10)} <> 9",
    ),
    "stratified_split": q(SPLIT, "SELECT user_pseudo_id, churned, split FROM split"),
    "kfold_assign": q(
        TRAIN,
        f"""SELECT user_pseudo_id, CAST({bucket_sql('user_pseudo_id', 10, 42)} AS INTEGER) AS fold
        FROM train""",
    ),
    "base_rate_weights": q(
        _LABEL_COUNTS,
        """SELECT user_pseudo_id, churned, CASE WHEN churned = 1
        THEN round(CAST(n AS DOUBLE) / p, 6) ELSE 1.0::DOUBLE END AS weight FROM train, c""",
    ),
    "balanced_weights": q(
        _LABEL_COUNTS,
        """SELECT user_pseudo_id, churned, round(CAST(n AS DOUBLE)
        / (2 * CASE WHEN churned = 1 THEN p ELSE n - p END), 6) AS weight FROM train, c""",
    ),
    "scan_user_csv": q(
        USERS,
        """SELECT * REPLACE (strftime(user_first_engagement, '%Y-%m-%d %H:%M:%S.%f') || '+00:00'
        AS user_first_engagement) FROM users""",
    ),
    "scan_user_csv_time": q(USERS, "SELECT * FROM users"),
    "sink_user_csv": q(
        SPLIT,
        union_all(
            f"""SELECT '{name}' AS dataset, count(*) AS users,
            CAST(sum(churned) AS BIGINT) AS churned_users FROM {source}"""
            for name, source in {
                "users_raw": "users",
                "users_not_yet": "users WHERE is_enable = 0 AND bounced = 0",
                "users_train": "split WHERE split = 'train'",
                "users_test": "split WHERE split = 'test'",
            }.items()
        ),
    ),
    "sink_user_table": q(USERS, "SELECT * FROM users"),
    "null_to_zero": q(
        USERS,
        f"SELECT user_pseudo_id, {', '.join(f'coalesce({c}, 0) AS {c}' for c in COUNTERS)} FROM users",
    ),
    "bucketize": q(
        TRAIN,
        f"SELECT user_pseudo_id, {_bins(COUNTERS, chr(39) + 'bin_' + chr(39) + ' || (1 + {position}) AS {c}')} FROM train",
    ),
    "bucketize_index": q(
        TRAIN,
        f"SELECT user_pseudo_id, {_bins(COUNTERS, 'CAST({position} AS DOUBLE) AS {c}')} FROM train",
    ),
    "model_transform_sql": q(
        TRAIN,
        f"SELECT {_bins(COUNTERS, chr(39) + 'bin_' + chr(39) + ' || (1 + {position}) AS {c}')}, churned FROM train",
    ),
    "impute_constant": q(
        USERS,
        "SELECT user_pseudo_id, "
        + ", ".join(f"CAST(coalesce({c}, 0) AS DOUBLE) AS {c}" for c in COUNTERS)
        + " FROM users",
    ),
    "impute_mode": q(
        USERS,
        "SELECT user_pseudo_id, "
        + ", ".join(f"coalesce({c}, {_mode(c, 'users')}) AS {c}" for c in CATEGORIES)
        + " FROM users",
    ),
    "zscore_population": q(
        TRAIN,
        f"""SELECT user_pseudo_id, round(({ONE} - avg({ONE}) OVER ()) / stddev_pop({ONE}) OVER (), 6)
        AS scaled FROM train""",
    ),
    "zscore_sample": q(
        TRAIN,
        f"""SELECT user_pseudo_id, round(({ONE} - avg({ONE}) OVER ()) / stddev_samp({ONE}) OVER (), 6)
        AS scaled FROM train""",
    ),
    "minmax_scale": q(
        TRAIN,
        f"""SELECT user_pseudo_id, round(({ONE} - min({ONE}) OVER ())
        / CAST(max({ONE}) OVER () - min({ONE}) OVER () AS DOUBLE), 6) AS scaled FROM train""",
    ),
    "ordinal_encode": q(
        TRAIN,
        """SELECT user_pseudo_id, country_name, CAST(dense_rank() OVER (ORDER BY country_name) - 1
        AS DOUBLE) AS code FROM train WHERE country_name IS NOT NULL""",
    ),
    "onehot_encode": q(
        f"""{SPLIT}, cats AS (SELECT cat, CAST(row_number() OVER (ORDER BY cat) - 1 AS INTEGER) AS position
        FROM (SELECT DISTINCT device_lang AS cat FROM split
              WHERE split = 'train' AND device_lang IS NOT NULL))""",
        """SELECT user_pseudo_id, position, CASE WHEN device_lang = cat THEN 1.0::DOUBLE
        ELSE 0.0::DOUBLE END AS value FROM users CROSS JOIN cats""",
    ),
    "count_vectorize": q(
        f"{TRAIN}, vocab AS ({_vocabulary('country_name', 3, True)})",
        _tokens_long("country_name", True),
    ),
    "count_vocabulary": q(TRAIN, _VOCAB),
    "count_vectorize_multi": q(
        f"{TRAIN}, vocab AS ({_VOCAB})", union_all(_tokens_long(c, False) for c in CATEGORIES)
    ),
    "most_common_categories": q(
        _common("value"), 'SELECT "column", value, cnt, round(share, 6) AS share FROM kept'
    ),
    "most_common_by_frequency": q(
        _common("cnt DESC, value"),
        'SELECT "column", value, cnt, round(share, 6) AS share FROM kept',
    ),
    "recode_other": q(
        _common("value"),
        f"SELECT user_pseudo_id, {', '.join(_recoded(c) for c in CATEGORIES)} FROM train",
    ),
    "fit_transform_stages": q(TRAIN, union_all(_FEATURE_PARTS)),
    "label_feature_split": q(
        _FEATURE_CELLS,
        """SELECT user_pseudo_id, any_value(churned) AS label, list(value + 0.0::DOUBLE ORDER BY place, feature) AS features
        FROM cells JOIN train USING (user_pseudo_id) GROUP BY user_pseudo_id""",
    ),
    "feature_names": q(
        _FEATURE_CELLS,
        """SELECT CAST(row_number() OVER (ORDER BY place, feature) - 1 AS INTEGER) AS position, feature,
        round(avg(value), 6) + 0.0::DOUBLE AS mean FROM cells GROUP BY place, feature""",
    ),
}
