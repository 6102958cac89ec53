"""Distribution summaries: moments, histograms, box plots, pair statistics, daily counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.operators.frequencies import exact_quantiles, name_at, unfold, value_frequencies
from ebbtide.schema import COUNTERS, FIRST_SEEN, LABEL

QUARTILES = (0.25, 0.5, 0.75)


def mean_var(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and sample variance of several columns in one pass."""
    moments = unfold(df, columns, kind="double").groupBy("position").agg(
        F.avg("value").alias("mean"), F.var_samp("value").alias("variance")
    )
    return moments.select(name_at(columns).alias("column"), "mean", "variance")


def bin_index(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin; the last bin is closed on both sides. One value only: bins of width 1
    around it, as the usual histogram routines do."""
    flat = low == high
    start = F.when(flat, low - 0.5).otherwise(low)
    width = F.when(flat, F.lit(1.0)).otherwise(high - low) / bins
    return F.least(F.floor((value - start) / width), F.lit(bins - 1)).cast("int")


def histogram(
    df: DataFrame,
    column: str,
    bins: int = 10,
    low: float | None = None,
    high: float | None = None,
) -> DataFrame:
    """Counts per bin, empty bins included. Without limits the data's range is used;
    with limits, values outside are left out."""
    values = df.select(F.col(column).cast("double").alias("_value")).na.drop()
    if low is None or high is None:
        limits = values.agg(F.min("_value").alias("_low"), F.max("_value").alias("_high"))
        values = values.crossJoin(F.broadcast(limits))
    else:
        values = values.where(F.col("_value").between(low, high)).withColumns(
            {"_low": F.lit(float(low)), "_high": F.lit(float(high))}
        )
        limits = None
    filled = values.groupBy(
        bin_index(F.col("_value"), F.col("_low"), F.col("_high"), bins).alias("bin")
    ).agg(F.count("*").alias("cnt"))
    spark = df.sparkSession
    axis = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    if limits is None:
        axis = axis.withColumns({"_low": F.lit(float(low)), "_high": F.lit(float(high))})
    else:
        axis = axis.crossJoin(F.broadcast(limits))
    flat = F.col("_low") == F.col("_high")
    start = F.when(flat, F.col("_low") - 0.5).otherwise(F.col("_low"))
    width = F.when(flat, F.lit(1.0)).otherwise(F.col("_high") - F.col("_low")) / bins
    return axis.join(filled, "bin", "left").select(
        "bin",
        (start + F.col("bin") * width).alias("lower"),
        (start + (F.col("bin") + 1) * width).alias("upper"),
        F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"),
    )


def boxplot_stats(
    df: DataFrame, columns: list[str], label: str = LABEL, exact: bool = True
) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers and outliers of each column per label.

    Works on the frequency table of the columns. `exact=False` saves the running counts.
    """
    freq = value_frequencies(df, columns, [label], "double").where(F.col("value").isNotNull())
    if exact:
        boxes = exact_quantiles(freq, [label, "column"], QUARTILES, "_q")
    else:
        quartiles = F.array(*[F.lit(q) for q in QUARTILES])
        q = F.percentile_approx("value", quartiles, F.lit(10000))
        boxes = (
            unfold(df, columns, [label], "double")
            .groupBy(label, "position")
            .agg(q.alias("_q"))
            .withColumn("column", name_at(columns))
        )
    boxes = boxes.select(
        label,
        "column",
        F.col("_q")[0].alias("q1"),
        F.col("_q")[1].alias("median"),
        F.col("_q")[2].alias("q3"),
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        freq.join(boxes, [label, "column"])
        .groupBy(label, "column", "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
            F.sum(F.when(inside, F.lit(0)).otherwise(F.col("cnt"))).cast("long").alias("outliers"),
        )
    )


def _pairs(df: DataFrame, values: Column, keep: list[str]) -> DataFrame:
    """One row per pair of positions of an array: (keep..., x_at, y_at, x_value, y_value)."""
    first = df.select(*keep, values.alias("_v")).select(
        *keep, "_v", F.posexplode("_v").alias("x_at", "x_value")
    )
    rest = F.slice("_v", F.col("x_at") + 2, F.size("_v"))
    second = first.select(*keep, "x_at", "x_value", F.posexplode(rest).alias("_k", "y_value"))
    return second.withColumn("y_at", F.col("x_at") + F.col("_k") + 1).drop("_k")


def pairwise_correlations(
    df: DataFrame, columns: tuple[str, ...] = COUNTERS, label: str | None = LABEL
) -> DataFrame:
    """Pearson correlation of every pair of columns, per label, over rows that have both values.

    NULL for a pair with a constant column. Rows are unfolded into pairs and combined
    again in the same stage: one small aggregate instead of one with hundreds of buffers,
    which would be too large to be compiled.
    """
    by = [label] if label else []
    values = F.array(*[F.col(c).cast("double") for c in columns])
    pairs = _pairs(df, values, by)
    x = F.when(F.col("y_value").isNotNull(), F.col("x_value"))
    y = F.when(F.col("x_value").isNotNull(), F.col("y_value"))
    corr = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return (
        pairs.groupBy(*by, "x_at", "y_at")
        .agg(F.count("*").alias("n"), corr.alias("corr"))
        .select(
            *by,
            "n",
            name_at(list(columns), "x_at").alias("x"),
            name_at(list(columns), "y_at").alias("y"),
            "corr",
        )
    )


def pairwise_bins(
    df: DataFrame, columns: tuple[str, ...] = COUNTERS, label: str = LABEL, bins: int = 10
) -> DataFrame:
    """Two-dimensional histograms of every pair of columns per label.

    Users are first combined by the bins of all columns, so that the pairs are formed on
    the distinct bin vectors and not on the users.
    """
    limits = df.agg(
        F.array(*[F.min(c).cast("double") for c in columns]).alias("_low"),
        F.array(*[F.max(c).cast("double") for c in columns]).alias("_high"),
    )
    cells = F.arrays_zip(
        F.array(*[F.col(c).cast("double") for c in columns]).alias("v"),
        F.col("_low").alias("low"),
        F.col("_high").alias("high"),
    )
    binned = F.transform(cells, lambda c: bin_index(c["v"], c["low"], c["high"], bins))
    vectors = (
        df.select(label, *columns)
        .crossJoin(F.broadcast(limits))
        .groupBy(label, binned.alias("_bins"))
        .agg(F.count("*").alias("_n"))
    )
    return (
        _pairs(vectors, F.col("_bins"), [label, "_n"])
        .where(F.col("x_value").isNotNull() & F.col("y_value").isNotNull())
        .groupBy(label, "x_at", "y_at", "x_value", "y_value")
        .agg(F.sum("_n").alias("cnt"))
        .select(
            label,
            name_at(list(columns), "x_at").alias("x"),
            name_at(list(columns), "y_at").alias("y"),
            F.col("x_value").alias("x_bin"),
            F.col("y_value").alias("y_bin"),
            "cnt",
        )
    )


def density_by_label(
    df: DataFrame, columns: list[str], label: str = LABEL, points: int = 200, cut: float = 3.0, nodes: int = 512
) -> DataFrame:
    """(label, column, point, value, density): smoothed densities as on the diagonal of a pair plot.

    A Gaussian kernel of Scott's width (standard deviation times n to the power -1/5) at `points` places
    from `cut` widths below the least to `cut` widths above the greatest value of a label and column. The
    density is scaled by the label's share of the rows that have a value, so the labels add up to one
    curve. Labels with fewer than two different values have none.

    Values are put on a grid of `nodes` steps a width, each shared by its two neighbours in proportion
    (linear binning), and the occupied nodes meet the points within 8.5 widths only: the rows are read
    once, and neither rows nor all nodes are paired with all points.
    """
    freq = value_frequencies(df, columns, [label], "double").where(F.col("value").isNotNull())
    n, mean = F.sum("cnt"), F.sum(F.col("cnt") * F.col("value")) / F.sum("cnt")
    square = F.sum(F.col("cnt") * F.col("value") * F.col("value"))
    shape = freq.groupBy(label, "column").agg(
        n.alias("n"), F.min("value").alias("least"), F.max("value").alias("greatest"),
        F.sqrt((square - n * mean * mean) / (n - 1)).alias("std"),
    ).where("least < greatest")
    width = F.col("std") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    all_rows = freq.groupBy("column").agg(F.sum("cnt").alias("all_n"))
    shape = shape.withColumn("width", width).join(all_rows, "column")
    place = (F.col("value") - F.col("least")) / F.col("width") * nodes
    low = F.floor(place)
    shares = F.array(
        F.struct(low.alias("node"), (F.col("cnt") * (1 - (place - low))).alias("mass")),
        F.struct((low + 1).alias("node"), (F.col("cnt") * (place - low)).alias("mass")),
    )
    keep = [label, "column", "n", "all_n", "least", "greatest", "width"]
    masses = (
        freq.join(shape, [label, "column"])
        .select(*keep, F.inline(shares))
        .groupBy(*keep, "node")
        .agg(F.sum("mass").alias("mass"))
    )
    start = F.col("least") - cut * F.col("width")
    step = (F.col("greatest") - F.col("least") + 2 * cut * F.col("width")) / (points - 1)
    at = F.col("least") + F.col("node") / nodes * F.col("width")
    first = F.greatest(F.lit(0), F.ceil((at - 8.5 * F.col("width") - start) / step))
    last = F.least(F.lit(points - 1), F.floor((at + 8.5 * F.col("width") - start) / step))
    met = masses.select(
        *keep, "mass", at.alias("node_at"), F.explode(F.when(first <= last, F.sequence(first, last))).alias("point")
    )
    distance = (start + F.col("point") * step - F.col("node_at")) / F.col("width")
    sums = met.groupBy(label, "column", "point").agg(
        F.sum(F.col("mass") * F.exp(-distance * distance / 2)).alias("sum")
    )
    axis = shape.select(*keep, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))).alias("point"))
    scale = F.sqrt(F.lit(2 * math.pi)) * F.col("width") * F.col("all_n")
    return axis.join(sums, [label, "column", "point"], "left").select(
        label, "column", F.col("point").cast("int").alias("point"), (start + F.col("point") * step).alias("value"),
        (F.coalesce("sum", F.lit(0.0)) / scale).alias("density"),
    )


def scaled_histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """`histogram` of a column and of its z-scores: (scale, bin, lower, upper, cnt).

    Scaling is linear, so the bins of the scaled values are the scaled bins and hold the same rows. The
    deviation is that of the population; a constant column is only centred.
    """
    raw = histogram(df, column, bins)
    moments = df.agg(F.avg(column).alias("_mean"), F.stddev_pop(column).alias("_std"))
    spread = F.when(F.col("_std") > 0, F.col("_std")).otherwise(1.0)
    scaled = [((F.col(c) - F.col("_mean")) / spread).alias(c) for c in ("lower", "upper")]
    both = raw.crossJoin(F.broadcast(moments))  # one row
    return both.select(F.lit("raw").alias("scale"), "bin", "lower", "upper", "cnt").unionByName(
        both.select(F.lit("scaled").alias("scale"), "bin", *scaled, "cnt")
    )


def daily_label_counts(df: DataFrame, label: str = LABEL, ts: str = FIRST_SEEN) -> DataFrame:
    """Users per label and day; days without users between a label's first and last day are 0."""
    daily = (
        df.where(F.col(ts).isNotNull())
        .groupBy(label, F.to_date(ts).alias("day"))
        .agg(F.count("*").alias("cnt"))
    )
    calendar = daily.groupBy(label).agg(
        F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day")
    )
    return calendar.join(daily, [label, "day"], "left").select(
        label, "day", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt")
    )
