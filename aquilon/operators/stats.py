"""Smoothing, correlation and histograms of series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _wma(col: Column, w: Window, n: int) -> Column:
    """Weighted mean of the last n rows, the newest heaviest; null until there are n."""
    terms = [F.lag(col, n - k).over(w) * k if n > k else col * k for k in range(1, n + 1)]
    return reduce(lambda a, b: a + b, terms) / (n * (n + 1) / 2)


def hull(df: DataFrame, value: str, window: int = 5, keys=("trajectory_id",), order: str = "snapshot", out: str = "hma") -> DataFrame:
    """Hull moving average: 2 WMA(window // 2) - WMA(window), then the mean of the last isqrt(window); 0 until every window is full."""
    if window < 2:
        raise ValueError("window must be 2 at least")
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.withColumn("_h", 2 * _wma(F.col(value), w, window // 2) - _wma(F.col(value), w, window))
    n = int(window**0.5)
    mean = reduce(lambda a, b: a + b, [F.lag("_h", k).over(w) if k else F.col("_h") for k in range(n)]) / n
    return d.withColumn(out, F.coalesce(mean, F.lit(0.0))).drop("_h")


def acf(df: DataFrame, value: str, keys=("trajectory_id",), order: str = "snapshot", max_lag: int | None = None) -> DataFrame:
    """Autocorrelation by lag: the mean product of deviations at the lag over that at lag 0."""
    all_ = Window.partitionBy(*keys)
    s = df.where(F.col(value).isNotNull()).select(*keys, F.row_number().over(all_.orderBy(order)).alias("i"), (F.col(value) - F.avg(value).over(all_)).alias("v"))
    b = s.select(*keys, F.col("i").alias("j"), F.col("v").alias("u"))
    p = s.join(b, list(keys)).where("j >= i")
    if max_lag is not None:
        p = p.where(F.col("j") - F.col("i") <= max_lag)
    g = p.groupBy(*keys, (F.col("j") - F.col("i")).cast("long").alias("lag")).agg(F.avg(F.col("v") * F.col("u")).alias("c"))
    zero = g.where("lag = 0").select(*keys, F.col("c").alias("c0"))
    return g.join(zero, list(keys)).select(*keys, "lag", F.try_divide("c", "c0").alias("acf"))


def cross_correlation(x: DataFrame, y: DataFrame, keys=("trajectory_id",), order: str = "snapshot", x_value: str = "value", y_value: str = "value", max_lag: int | None = None) -> DataFrame:
    """The half with lag >= 0 of the full correlation of two centred series (lag 0 is its middle), over the root of the product of
    their sums of squares. The series may differ in length."""
    def centred(df, v, i, u):
        a = Window.partitionBy(*keys)
        return df.where(F.col(v).isNotNull()).select(*keys, F.row_number().over(a.orderBy(order)).alias(i), (F.col(v) - F.avg(v).over(a)).alias(u))

    a, b = centred(x, x_value, "i", "v"), centred(y, y_value, "j", "u")
    n = a.groupBy(*keys).agg(F.sum(F.col("v") * F.col("v")).alias("vv"), F.count("*").alias("n"))
    m = b.groupBy(*keys).agg(F.sum(F.col("u") * F.col("u")).alias("uu"), F.count("*").alias("m"))
    size = n.join(m, list(keys)).select(*keys, F.sqrt(F.col("vv") * F.col("uu")).alias("scale"), (F.floor((F.col("n") + F.col("m") - 1) / 2) - (F.col("m") - 1)).alias("middle"))
    p = a.join(b, list(keys)).join(size, list(keys)).withColumn("lag", F.col("i") - F.col("j") - F.col("middle")).where("lag >= 0")
    if max_lag is not None:
        p = p.where(F.col("lag") <= max_lag)
    return p.groupBy(*keys, "lag").agg(F.try_divide(F.sum(F.col("v") * F.col("u")), F.first("scale")).alias("correlation"))


def histogram(df: DataFrame, value: str, start: float, stop: float, points: int, keys=()) -> DataFrame:
    """Counts between `points` edges from start to stop, half-open but for the last bin; empty bins are 0."""
    n = points - 1
    step = (stop - start) / n
    v = F.col(value)
    c = df.where((v >= start) & (v <= stop)).groupBy(*keys, F.least(F.floor((v - start) / step), F.lit(n - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    bins = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin")
    full = df.select(*keys).distinct().select(*keys, bins) if keys else df.sparkSession.range(1).select(bins)
    return full.join(c, [*keys, "bin"], "left").select(*keys, "bin", (F.lit(start) + F.col("bin") * step).alias("left_edge"), F.coalesce("n", F.lit(0)).alias("n"))


def auto_histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Equal-width bins from the least to the greatest value."""
    lo, hi = df.agg(F.min(value), F.max(value)).first()
    if lo is None:
        return histogram(df, value, 0.0, 1.0, bins + 1)
    lo, hi = (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)
    return histogram(df, value, float(lo), float(hi), bins + 1)
