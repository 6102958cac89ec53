"""Queries of metrics over a deterministic score."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbtide.evaluation import confusion, curves
from ebbtide.operators.distributions import histogram
from ebbtide.registry import common
from ebbtide.registry.exploration import rounded, union_all
from ebbtide.registry.oracle import SCORED, q


def confusion_matrix(spark, folder):
    return confusion.confusion_matrix(common.scored(spark, folder))


def classification_report(spark, folder):
    report = confusion.classification_report(common.scored(spark, folder))
    return rounded(report, "precision", "recall", "f1_score")


def roc_auc_hard(spark, folder):
    return rounded(confusion.roc_auc_hard(common.scored(spark, folder)), "roc_auc")


def roc_points(spark, folder):
    points = curves.roc_points(common.scored(spark, folder))
    return rounded(points, "threshold", "fpr", "tpr")


def roc_corner_points(spark, folder):
    points = curves.roc_points(common.scored(spark, folder), corners_only=True)
    return rounded(points, "threshold", "fpr", "tpr")


def roc_auc(spark, folder):
    return rounded(curves.roc_auc(common.scored(spark, folder)), "roc_auc")


def pr_points(spark, folder):
    points = curves.pr_points(common.scored(spark, folder))
    return rounded(points, "threshold", "precision", "recall")


def average_precision(spark, folder):
    return rounded(curves.average_precision(common.scored(spark, folder)), "average_precision")


def precision_recall_by_threshold(spark, folder):
    lines = curves.precision_recall_by_threshold(common.scored(spark, folder))
    return rounded(lines, "threshold", "precision", "recall")


def evaluate_model(spark, folder):
    row = curves.evaluate_model(common.scored(spark, folder))
    return rounded(row, *row.columns)


def score_histogram(spark, folder):
    """Score of the negative class in 100 bins over 0...1."""
    scored = common.scored(spark, folder).withColumn("score_0", 1 - F.col("score"))
    return rounded(histogram(scored, "score_0", 100, 0.0, 1.0), "lower", "upper")


def metric_panel(spark, folder):
    return rounded(curves.metric_panel(common.scored(spark, folder)), "x", "y")


QUERIES = {
    name: globals()[name]
    for name in (
        "confusion_matrix", "classification_report", "roc_auc_hard", "roc_points",
        "roc_corner_points", "roc_auc", "pr_points", "average_precision",
        "precision_recall_by_threshold", "evaluate_model", "score_histogram", "metric_panel",
    )
}

_MATRIX = """SELECT CAST(l AS INTEGER) AS expected_label,
  (SELECT count(*) FROM {t} WHERE churned = l AND {f} = 0) AS predicted_0,
  (SELECT count(*) FROM {t} WHERE churned = l AND {f} = 1) AS predicted_1 FROM range(2) AS t(l)"""
_CELLS = """cells AS (SELECT
  CAST(count(*) FILTER (churned = 0 AND prediction = 0) AS DOUBLE) AS tn,
  CAST(count(*) FILTER (churned = 0 AND prediction = 1) AS DOUBLE) AS fp,
  CAST(count(*) FILTER (churned = 1 AND prediction = 0) AS DOUBLE) AS fn,
  CAST(count(*) FILTER (churned = 1 AND prediction = 1) AS DOUBLE) AS tp FROM hard)"""
_CLASSES = f"""{_CELLS}, classes AS (
  SELECT '0' AS "row", coalesce(tn / nullif(tn + fn, 0), 0) AS p, coalesce(tn / nullif(tn + fp, 0), 0) AS r,
    coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0) AS f, tn + fp AS n FROM cells
  UNION ALL SELECT '1', coalesce(tp / nullif(tp + fp, 0), 0), coalesce(tp / nullif(tp + fn, 0), 0),
    coalesce(2 * tp / nullif(2 * tp + fn + fp, 0), 0), tp + fn FROM cells)"""
_STEPS = """steps AS (SELECT score, count(*) FILTER (churned = 1) AS pos,
    count(*) FILTER (churned = 0) AS neg FROM scored GROUP BY score),
curve AS (SELECT score, pos, neg, CAST(sum(pos) OVER w AS DOUBLE) AS tp,
    CAST(sum(neg) OVER w AS DOUBLE) AS fp, CAST(sum(pos) OVER () AS DOUBLE) AS p,
    CAST(sum(neg) OVER () AS DOUBLE) AS n,
    lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg
    FROM steps WINDOW w AS (ORDER BY score DESC))"""
_ROC = """SELECT {t} AS threshold, {f} AS fpr, {r} AS tpr FROM curve {where}
UNION ALL SELECT round(max(score) + 1, 6), 0.0::DOUBLE, 0.0::DOUBLE FROM curve"""
_ROC_ALL = _ROC.format(
    t="round(score, 6)", f="round(fp / n, 6)", r="round(tp / p, 6)", where=""
)
_ROC_CORNERS = _ROC.format(
    t="round(score, 6)",
    f="round(fp / n, 6)",
    r="round(tp / p, 6)",
    where="WHERE next_pos IS NULL OR tp + fp = pos + neg OR next_pos <> pos OR next_neg <> neg",
)
_PR = """SELECT round(score, 6) AS threshold, round(tp / (tp + fp), 6) AS precision,
  round(tp / p, 6) AS recall FROM curve WHERE tp - pos < p
UNION ALL SELECT NULL, 1.0::DOUBLE, 0.0::DOUBLE"""
_BY_THRESHOLD = """SELECT round(t, 6) AS threshold,
  coalesce(round(CAST(count(*) FILTER (score > t AND churned = 1) AS DOUBLE)
    / nullif(count(*) FILTER (score > t), 0), 6), 0) AS precision,
  coalesce(round(CAST(count(*) FILTER (score > t AND churned = 1) AS DOUBLE)
    / nullif(count(*) FILTER (churned = 1), 0), 6), 0) AS recall
FROM scored CROSS JOIN (SELECT i * 0.01::DOUBLE AS t FROM range(100) AS r(i)) GROUP BY t"""
_AUC = "round(sum(neg * (tp - pos / 2.0::DOUBLE)) / max(p * n), 6)"

ORACLE = {
    "confusion_matrix": q(SCORED, _MATRIX.format(t="hard", f="prediction")),
    "classification_report": q(
        f"{SCORED}, {_CLASSES}",
        """SELECT "row", round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1_score,
          CAST(n AS BIGINT) AS support FROM classes
        UNION ALL SELECT 'accuracy', round((tn + tp) / (tn + fp + fn + tp), 6),
          round((tn + tp) / (tn + fp + fn + tp), 6), round((tn + tp) / (tn + fp + fn + tp), 6),
          CAST(tn + fp + fn + tp AS BIGINT) FROM cells
        UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6),
          CAST(sum(n) AS BIGINT) FROM classes
        UNION ALL SELECT 'weighted avg', round(sum(p * n) / sum(n), 6), round(sum(r * n) / sum(n), 6),
          round(sum(f * n) / sum(n), 6), CAST(sum(n) AS BIGINT) FROM classes""",
    ),
    "roc_auc_hard": q(
        f"{SCORED}, {_CELLS}",
        "SELECT round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS roc_auc FROM cells",
    ),
    "roc_points": q(f"{SCORED}, {_STEPS}", _ROC_ALL),
    "roc_corner_points": q(f"{SCORED}, {_STEPS}", _ROC_CORNERS),
    "roc_auc": q(f"{SCORED}, {_STEPS}", f"SELECT {_AUC} AS roc_auc FROM curve"),
    "pr_points": q(f"{SCORED}, {_STEPS}", _PR),
    "average_precision": q(
        f"{SCORED}, {_STEPS}",
        "SELECT round(sum(pos / p * tp / (tp + fp)), 6) AS average_precision FROM curve",
    ),
    "precision_recall_by_threshold": q(SCORED, _BY_THRESHOLD),
    "evaluate_model": q(
        f"""{SCORED}, {_STEPS}, h AS (SELECT
          CAST(count(*) FILTER (churned = 1 AND score > 0.5) AS DOUBLE) AS tp,
          CAST(count(*) FILTER (churned = 0 AND score > 0.5) AS DOUBLE) AS fp,
          CAST(count(*) FILTER (churned = 1 AND score <= 0.5) AS DOUBLE) AS fn,
          CAST(count(*) AS DOUBLE) AS n, avg(-CASE WHEN churned = 1
            THEN ln(least(greatest(score, 1e-15::DOUBLE), 1 - 1e-15::DOUBLE))
            ELSE ln(1 - least(greatest(score, 1e-15::DOUBLE), 1 - 1e-15::DOUBLE)) END) AS loss
          FROM scored)""",
        f"""SELECT coalesce(round(tp / nullif(tp + fp, 0), 6), 0) AS precision,
        coalesce(round(tp / nullif(tp + fn, 0), 6), 0) AS recall,
        round((n - fp - fn) / n, 6) AS accuracy,
        coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0), 6), 0) AS f1_score,
        round(loss, 6) AS log_loss, (SELECT {_AUC} FROM curve) AS roc_auc FROM h""",
    ),
    "score_histogram": q(
        f"""{SCORED}, filled AS (SELECT CAST(least(floor((1 - score) / (1.0::DOUBLE / 100)), 99)
        AS INTEGER) AS bin, count(*) AS n FROM scored GROUP BY ALL)""",
        """SELECT CAST(b.bin AS INTEGER) AS bin, round(b.bin * 0.01::DOUBLE, 6) AS lower,
        round((b.bin + 1) * 0.01::DOUBLE, 6) AS upper, coalesce(n, 0) AS cnt
        FROM range(100) AS b(bin) LEFT JOIN filled ON filled.bin = b.bin""",
    ),
    "metric_panel": q(
        f"""{SCORED}, {_STEPS}, flagged AS (SELECT *, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS flag
          FROM scored), m AS ({_MATRIX.format(t="flagged", f="flag")}),
        th AS ({_BY_THRESHOLD}), pr AS ({_PR}), roc AS ({_ROC_ALL})""",
        union_all(
            f"""SELECT '{panel}' AS panel, '{series}' AS series, CAST({x} AS DOUBLE) AS x,
            CAST({y} AS DOUBLE) AS y FROM {source}"""
            for panel, series, x, y, source in (
                ("confusion", "predicted_0", "expected_label", "predicted_0", "m"),
                ("confusion", "predicted_1", "expected_label", "predicted_1", "m"),
                ("threshold", "precision", "threshold", "precision", "th"),
                ("threshold", "recall", "threshold", "recall", "th"),
                ("precision_recall", "curve", "recall", "precision", "pr"),
                ("roc", "curve", "fpr", "tpr", "roc"),
            )
        ),
    ),
}
