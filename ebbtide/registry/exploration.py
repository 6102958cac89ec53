"""Queries on the per-user dataset: counts, distributions, profile."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ebbtide.operators import associations as assoc
from ebbtide.operators import distributions as dist
from ebbtide.operators import frequencies as freq
from ebbtide.operators.profiling import profile_table as profile
from ebbtide.registry import common
from ebbtide.registry.oracle import TRAIN, USERS, q
from ebbtide.schema import CATEGORIES, COUNTERS, LABEL, USER, USER_SCHEMA

# the six counters drawn as box plots: the first four and the last two
BOXED = [*COUNTERS[:4], *COUNTERS[-2:]]
NOMINAL = [*CATEGORIES, "is_enable", "bounced", LABEL]
PROFILED = ["user_pseudo_id", "is_enable", "bounced", *CATEGORIES, *COUNTERS, LABEL]

_NUMERIC = [c for c in PROFILED if c not in (USER, *CATEGORIES)]


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def value_counts(spark, folder):
    return freq.value_counts(common.users(spark, folder), "device_lang")


def lang_prefix_counts(spark, folder):
    return freq.prefix_counts(common.users(spark, folder), "device_lang")


def distinct_counts(spark, folder):
    return freq.distinct_counts(common.users(spark, folder), ["country_name", "device_lang"])


def approx_distinct_counts(spark, folder):
    return freq.distinct_counts(
        common.users(spark, folder), ["country_name", "device_lang"], approximate=True
    )


def null_counts(spark, folder):
    return freq.null_counts(common.users(spark, folder))


def drop_null_rows(spark, folder):
    return common.shown(common.users(spark, folder).na.drop())


def drop_null_column(spark, folder):
    return common.users(spark, folder).select(USER, "device_lang").na.drop(subset=["device_lang"])


def describe_schema(spark, folder):
    return freq.describe_schema(common.users(spark, folder))


def top_categories(spark, folder):
    return freq.top_categories(common.users(spark, folder), "country_name")


def top_n_member_filter(spark, folder):
    kept = freq.keep_top_categories(common.users(spark, folder), "country_name")
    return kept.select(USER, "country_name", LABEL)


def category_by_label(spark, folder):
    return freq.category_by_label(common.train(spark, folder), CATEGORIES)


def mean_var(spark, folder):
    moments = dist.mean_var(common.train(spark, folder), list(COUNTERS))
    return rounded(moments, "mean", "variance")


def histogram_bins(spark, folder):
    return rounded(
        dist.scaled_histogram(common.train(spark, folder), "cnt_user_engagement", 10), "lower", "upper"
    )


def boxplot_stats(spark, folder):
    return dist.boxplot_stats(common.train(spark, folder), BOXED)


def pairwise_stats(spark, folder):
    return rounded(dist.pairwise_correlations(common.train(spark, folder)), "corr")


def pairwise_bins(spark, folder):
    return dist.pairwise_bins(common.train(spark, folder))


def daily_label_counts(spark, folder):
    return dist.daily_label_counts(common.train(spark, folder))


def profile_table(spark, folder):
    return rounded(profile(common.users(spark, folder).select(*PROFILED)), "number")


def rank_correlations(spark, folder):
    """Spearman and Kendall of all two numeric columns of the profile."""
    return rounded(assoc.rank_correlations(common.users(spark, folder), _NUMERIC), "spearman", "kendall")


def nominal_associations(spark, folder):
    """Cramer's V of all two categories and flags of the profile."""
    return rounded(assoc.nominal_associations(common.users(spark, folder), NOMINAL), "cramers_v")


def missing_correlations(spark, folder):
    """Correlation of missing values; a counter without events counts as missing."""
    users = common.users(spark, folder)
    sparse = [F.when(F.col(c) > 0, F.col(c)).alias(c) for c in COUNTERS]
    return rounded(assoc.missing_correlations(users.select(*CATEGORIES, *sparse), [*CATEGORIES, *COUNTERS]), "corr")


def pairwise_densities(spark, folder):
    """Densities per label on the pair plot's diagonal."""
    return rounded(dist.density_by_label(common.train(spark, folder), list(COUNTERS)), "value", "density")


QUERIES = {
    "value_counts": value_counts,
    "lang_prefix_counts": lang_prefix_counts,
    "distinct_counts": distinct_counts,
    "approx_distinct_counts": approx_distinct_counts,
    "null_counts": null_counts,
    "drop_null_rows": drop_null_rows,
    "drop_null_column": drop_null_column,
    "describe_schema": describe_schema,
    "top_categories": top_categories,
    "top_n_member_filter": top_n_member_filter,
    "category_by_label": category_by_label,
    "mean_var": mean_var,
    "histogram_bins": histogram_bins,
    "boxplot_stats": boxplot_stats,
    "pairwise_stats": pairwise_stats,
    "pairwise_bins": pairwise_bins,
    "daily_label_counts": daily_label_counts,
    "profile_table": profile_table,
    "rank_correlations": rank_correlations,
    "nominal_associations": nominal_associations,
    "missing_correlations": missing_correlations,
    "pairwise_densities": pairwise_densities,
}


def union_all(parts) -> str:
    return "\nUNION ALL ".join(parts)


def long_sql(source: str, columns, label: str = "") -> str:
    """CTE body: one row per user and column."""
    return union_all(
        f"SELECT {label}'{c}' AS \"column\", CAST({c} AS DOUBLE) AS v FROM {source}"
        for c in columns
    )


_TOP10 = """(SELECT {c} FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}
  ORDER BY count(*) DESC, {c} LIMIT 10)"""
_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in USER_SCHEMA.fieldNames())
_PAIR_BINS = ", ".join(
    f"""CAST(CASE WHEN hi_{c} = lo_{c} THEN least(floor(({c} - lo_{c} + 0.5::DOUBLE) / 0.1::DOUBLE), 9)
    ELSE least(floor(({c} - lo_{c}) / ((hi_{c} - lo_{c}) / 10)), 9) END AS INTEGER) AS {c}"""
    for c in COUNTERS
)
_PAIR_LIMITS = ", ".join(
    f"CAST(min({c}) AS DOUBLE) AS lo_{c}, CAST(max({c}) AS DOUBLE) AS hi_{c}" for c in COUNTERS
)


def _stat(stat: str, number: str = "NULL", text: str = "NULL") -> str:
    return f"""SELECT "column", '{stat}' AS stat, CAST({number} AS DOUBLE) AS number,
    CAST({text} AS VARCHAR) AS text FROM """


_VALUES = union_all(
    f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM users" for c in PROFILED
)
_PROFILE_PARTS = [
    _stat("count", "count(value)") + "vals GROUP BY \"column\"",
    _stat("missing", "count(*) - count(value)") + "vals GROUP BY \"column\"",
    _stat("distinct", "count(DISTINCT value)") + "vals GROUP BY \"column\"",
    _stat("unique", "count(*) FILTER (value IS NOT NULL AND n = 1)") + "freq GROUP BY \"column\"",
    _stat("top_count", "n") + "ranked WHERE r = 1",
    _stat("top", "NULL", "value") + "ranked WHERE r = 1",
    *[
        _stat(stat, f"round({expr}, 6)") + "nums GROUP BY \"column\""
        for stat, expr in {
            "min": "min(v)",
            "max": "max(v)",
            "mean": "avg(v)",
            "std": "stddev_samp(v)",
            "sum": "sum(v)",
            "zeros": "count(*) FILTER (v = 0)",
            "q05": "quantile_cont(v, 0.05)",
            "q25": "quantile_cont(v, 0.25)",
            "q50": "quantile_cont(v, 0.5)",
            "q75": "quantile_cont(v, 0.75)",
            "q95": "quantile_cont(v, 0.95)",
        }.items()
    ],
    "SELECT '*', 'duplicates', CAST((SELECT count(*) FROM picked) - "
    "(SELECT count(*) FROM (SELECT DISTINCT * FROM picked)) AS DOUBLE), NULL",
    *[
        f"SELECT '{x}~{y}', 'corr', CASE WHEN isfinite(corr({x}, {y})) "
        f"THEN round(corr({x}, {y}), 6) END, NULL FROM users"
        for x, y in combinations(_NUMERIC, 2)
    ],
]

def _pairs_sql(columns, kind: str) -> str:
    """CTE body: one row per user and two columns in which both have a value."""
    return union_all(
        f"SELECT '{x}' AS x, '{y}' AS y, CAST({x} AS {kind}) AS a, CAST({y} AS {kind}) AS b FROM users "
        f"WHERE {x} IS NOT NULL AND {y} IS NOT NULL"
        for x, y in combinations(columns, 2)
    )


_CELLS = "cells AS (SELECT x, y, a, b, count(*) AS n FROM p GROUP BY ALL)"
_SIDES = """sides AS (SELECT x, y, 'x' AS side, a AS v, count(*) AS n FROM p GROUP BY ALL
  UNION ALL SELECT x, y, 'y', b, count(*) FROM p GROUP BY ALL)"""
_MISSING = ", ".join(
    [
        *[f"CAST({c} IS NULL AS INTEGER) AS {c}" for c in CATEGORIES],
        *[f"CAST(coalesce({c}, 0) <= 0 AS INTEGER) AS {c}" for c in COUNTERS],
    ]
)

ORACLE = {
    "value_counts": q(
        USERS,
        """SELECT device_lang AS value, count(*) AS cnt FROM users WHERE device_lang IS NOT NULL
        GROUP BY ALL ORDER BY cnt DESC, value""",
    ),
    "lang_prefix_counts": q(
        USERS,
        """SELECT substr(device_lang, 1, 2) AS prefix, count(*) AS cnt FROM users
        WHERE device_lang IS NOT NULL GROUP BY ALL ORDER BY cnt DESC, prefix""",
    ),
    "distinct_counts": q(
        USERS,
        union_all(
            f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_distinct,
            count(DISTINCT lower({c})) AS n_distinct_lower FROM users"""
            for c in ("country_name", "device_lang")
        ),
    ),
    "null_counts": q(
        USERS,
        union_all(
            f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM users"
            for c in USER_SCHEMA.fieldNames()
        ),
    ),
    "drop_null_rows": q(USERS, f"SELECT * FROM users WHERE {_COMPLETE}"),
    "drop_null_column": q(
        USERS, "SELECT user_pseudo_id, device_lang FROM users WHERE device_lang IS NOT NULL"
    ),
    "describe_schema": q(
        USERS,
        union_all(
            f"""SELECT CAST({i} AS INTEGER) AS position, '{f.name}' AS "column",
            '{f.dataType.simpleString()}' AS dtype, count({f.name}) AS non_null FROM users"""
            for i, f in enumerate(USER_SCHEMA.fields)
        ),
    ),
    "top_categories": q(
        USERS,
        """SELECT country_name, count(*) AS cnt FROM users WHERE country_name IS NOT NULL
        GROUP BY ALL ORDER BY cnt DESC, country_name LIMIT 10""",
    ),
    "top_n_member_filter": q(
        USERS,
        f"""SELECT user_pseudo_id, country_name, churned FROM users
        WHERE country_name IN {_TOP10.format(c="country_name", t="users")}""",
    ),
    "category_by_label": q(
        TRAIN,
        union_all(
            f"""SELECT '{c}' AS "column", {c} AS category, churned, count(*) AS cnt FROM train
            WHERE {_COMPLETE} AND {c} IN {_TOP10.format(c=c, t="train")} GROUP BY ALL"""
            for c in CATEGORIES
        ),
    ),
    "mean_var": q(
        f"{TRAIN}, long AS ({long_sql('train', COUNTERS)})",
        """SELECT "column", round(avg(v), 6) AS mean, round(var_samp(v), 6) AS variance
        FROM long GROUP BY "column\"""",
    ),
    "rank_correlations": q(
        f"{USERS}, p AS ({_pairs_sql(_NUMERIC, 'DOUBLE')}), {_CELLS}, {_SIDES}",
        """, r AS (SELECT x, y, corr(rx, ry) AS spearman FROM (SELECT x, y,
            rank() OVER (PARTITION BY x, y ORDER BY a) + (count(*) OVER (PARTITION BY x, y, a) - 1) / 2 AS rx,
            rank() OVER (PARTITION BY x, y ORDER BY b) + (count(*) OVER (PARTITION BY x, y, b) - 1) / 2 AS ry FROM p)
          GROUP BY x, y),
        k AS (SELECT c.x, c.y, sum(c.n * d.n * sign(d.b - c.b)) AS s FROM cells c
          JOIN cells d ON c.x = d.x AND c.y = d.y AND c.a < d.a GROUP BY ALL),
        t AS (SELECT x, y, CAST(sum(n) FILTER (side = 'x') AS BIGINT) AS n, sum(n * (n - 1) / 2) FILTER (side = 'x') AS tx,
          sum(n * (n - 1) / 2) FILTER (side = 'y') AS ty FROM sides GROUP BY x, y)
        SELECT x, y, n, CASE WHEN isfinite(spearman) THEN round(spearman, 6) END AS spearman,
          CASE WHEN n * (n - 1) / 2 > tx AND n * (n - 1) / 2 > ty THEN
            round(coalesce(s, 0) / sqrt((n * (n - 1) / 2 - tx) * (n * (n - 1) / 2 - ty)), 6) END AS kendall
        FROM t JOIN r USING (x, y) LEFT JOIN k USING (x, y)""",
    ),
    "nominal_associations": q(
        f"{USERS}, p AS ({_pairs_sql(NOMINAL, 'VARCHAR')}), {_CELLS}, {_SIDES}",
        """, t AS (SELECT x, y, CAST(sum(n) FILTER (side = 'x') AS BIGINT) AS n, count(*) FILTER (side = 'x') AS kx,
          count(*) FILTER (side = 'y') AS ky FROM sides GROUP BY x, y),
        f AS (SELECT c.x, c.y, sum(c.n * 1.0::DOUBLE * c.n / u.n / v.n) - 1 AS phi FROM cells c
          JOIN sides u ON u.x = c.x AND u.y = c.y AND u.side = 'x' AND u.v = c.a
          JOIN sides v ON v.x = c.x AND v.y = c.y AND v.side = 'y' AND v.v = c.b GROUP BY ALL)
        SELECT x, y, n, kx AS categories_x, ky AS categories_y, CASE WHEN kx > 1 AND ky > 1 THEN round(sqrt(
          greatest(0, phi - (kx - 1) * (ky - 1) / (n - 1))
          / least(kx - 1 - (kx - 1) * (kx - 1) / (n - 1), ky - 1 - (ky - 1) * (ky - 1) / (n - 1))), 6) END AS cramers_v
        FROM t JOIN f USING (x, y)""",
    ),
    "missing_correlations": q(
        f"{USERS}, m AS (SELECT {_MISSING} FROM users)",
        union_all(
            f"""SELECT '{x}' AS x, '{y}' AS y, CAST(sum({x}) AS BIGINT) AS missing_x, CAST(sum({y}) AS BIGINT) AS missing_y,
            CAST(sum({x} * {y}) AS BIGINT) AS both, round(corr({x}, {y}), 6) AS corr FROM m
            HAVING sum({x}) > 0 AND sum({x}) < count(*) AND sum({y}) > 0 AND sum({y}) < count(*)"""
            for x, y in combinations([*CATEGORIES, *COUNTERS], 2)
        ),
    ),
    "pairwise_densities": q(
        f"""{TRAIN}, long AS ({long_sql('train', COUNTERS, 'churned, ')}),
        shape AS (SELECT churned, "column", count(v) AS n, min(v) AS lo, max(v) AS hi,
          stddev_samp(v) * pow(count(v), -0.2::DOUBLE) AS w FROM long WHERE v IS NOT NULL GROUP BY ALL HAVING min(v) < max(v)),
        whole AS (SELECT "column", count(v) AS all_n FROM long GROUP BY "column"),
        points AS (SELECT *, lo - 3 * w + p * ((hi - lo + 6 * w) / 199) AS spot
          FROM shape JOIN whole USING ("column") CROSS JOIN range(200) AS r(p)),
        placed AS (SELECT churned, "column", (v - lo) / w * 512 AS place FROM long JOIN shape USING (churned, "column")),
        halves AS (SELECT churned, "column", floor(place) AS node, 1 - (place - floor(place)) AS mass FROM placed
          UNION ALL SELECT churned, "column", floor(place) + 1, place - floor(place) FROM placed),
        nodes AS (SELECT churned, "column", node, sum(mass) AS mass FROM halves GROUP BY ALL)""",
        """SELECT churned, "column", CAST(p AS INTEGER) AS point, round(spot, 6) AS value, round(sum(mass
          * exp(-pow((spot - (lo + node / 512 * w)) / w, 2) / 2)) / (sqrt(2 * pi()) * w * all_n), 6) AS density
        FROM points JOIN nodes USING (churned, "column") GROUP BY churned, "column", p, spot, w, all_n""",
    ),
    "histogram_bins": q(
        f"""{TRAIN}, lim AS (SELECT CAST(min(cnt_user_engagement) AS DOUBLE) AS lo,
        CAST(max(cnt_user_engagement) AS DOUBLE) AS hi FROM train),
        filled AS (SELECT CAST(least(floor((cnt_user_engagement - lo) / ((hi - lo) / 10)), 9) AS INTEGER)
          AS bin, count(*) AS n FROM train, lim GROUP BY ALL)""",
        """, edges AS (SELECT CAST(b.bin AS INTEGER) AS bin, lo + b.bin * ((hi - lo) / 10) AS lower,
          lo + (b.bin + 1) * ((hi - lo) / 10) AS upper, coalesce(n, 0) AS cnt
          FROM range(10) AS b(bin) CROSS JOIN lim LEFT JOIN filled ON filled.bin = b.bin),
        m AS (SELECT avg(cnt_user_engagement) AS mean, stddev_pop(cnt_user_engagement) AS std FROM train)
        SELECT 'raw' AS scale, bin, round(lower, 6) AS lower, round(upper, 6) AS upper, cnt FROM edges
        UNION ALL SELECT 'scaled', bin, round((lower - mean) / std, 6), round((upper - mean) / std, 6), cnt FROM edges, m""",
    ),
    "boxplot_stats": q(
        f"""{TRAIN}, long AS ({long_sql('train', BOXED, 'churned, ')}),
        boxes AS (SELECT churned, "column", quantile_cont(v, 0.25) AS q1,
          quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3
          FROM long GROUP BY churned, "column"),
        placed AS (SELECT *, v BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1)
          AS inside FROM long JOIN boxes USING (churned, "column"))""",
        """SELECT churned, "column", q1, median, q3, min(v) FILTER (inside) AS whisker_low,
        max(v) FILTER (inside) AS whisker_high, count(*) FILTER (NOT inside) AS outliers
        FROM placed GROUP BY ALL""",
    ),
    "pairwise_stats": q(
        TRAIN,
        union_all(
            f"""SELECT churned, count(*) AS n, '{x}' AS x, '{y}' AS y,
            CASE WHEN isfinite(corr({x}, {y})) THEN round(corr({x}, {y}), 6) END AS corr
            FROM train GROUP BY churned"""
            for x, y in combinations(COUNTERS, 2)
        ),
    ),
    "pairwise_bins": q(
        f"""{TRAIN}, lim AS (SELECT {_PAIR_LIMITS} FROM train),
        binned AS (SELECT churned, {_PAIR_BINS} FROM train, lim)""",
        union_all(
            f"""SELECT churned, '{x}' AS x, '{y}' AS y, {x} AS x_bin, {y} AS y_bin,
            count(*) AS cnt FROM binned GROUP BY ALL"""
            for x, y in combinations(COUNTERS, 2)
        ),
    ),
    "daily_label_counts": q(
        f"""{TRAIN}, per_day AS (SELECT churned, CAST(user_first_engagement AS DATE) AS day,
          count(*) AS n FROM train GROUP BY ALL),
        days AS (SELECT churned, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))
          AS DATE) AS day FROM per_day GROUP BY churned)""",
        """SELECT churned, day, coalesce(n, 0) AS cnt
        FROM days LEFT JOIN per_day USING (churned, day)""",
    ),
    "profile_table": q(
        f"""{USERS}, picked AS (SELECT {", ".join(PROFILED)} FROM users),
        vals AS ({_VALUES}),
        freq AS (SELECT "column", value, count(*) AS n FROM vals GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS r
          FROM freq WHERE value IS NOT NULL),
        nums AS ({long_sql('users', _NUMERIC)})""",
        union_all(_PROFILE_PARTS),
    ),
}
