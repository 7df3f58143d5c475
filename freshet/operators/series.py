"""Annual series per station and ion: means, robust trends, leakage-free features, splits and error measures."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from freshet.operators.frequencies import numbered

SERIES = ["station_id", "ion"]
#: Rows of the total order that one window takes where trailing means run over series borders; five at least.
STRETCH = 100_000


def annual_means(df: DataFrame, keys: list[str] = SERIES, year: str = "year", value: str = "value") -> DataFrame:
    """``*keys, year, value, n_obs_year``: mean and count per year; the partial sums are combined before the shuffle.

    Means are taken to nine decimals, so that the order of summation, which changes with the partitions, never makes or
    breaks a tie between two years.
    """
    return df.groupBy(*keys, year).agg(F.round(F.avg(value), 9).alias("value"), F.count(value).alias("n_obs_year"))


def gather(annual: DataFrame, keys: list[str] = SERIES, year: str = "year", value: str = "value") -> DataFrame:
    """One row per series with its points sorted by year (at most one per calendar year, so the array is short)."""
    return annual.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(year).cast("int").alias("t"), F.col(value).alias("v")))).alias("points"))


def pairs_of(points: Column, *measures) -> Column:
    """Array of structs ``m0, m1, ...`` over all pairs of points with different times: each measure taken of (earlier, later, years between)."""
    n = F.size(points)
    each = F.transform(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda i: F.transform(F.slice(points, i + 1, n), lambda q: _pair(F.element_at(points, i), q, measures)),
    )
    return F.filter(F.flatten(each), lambda s: s["years"] != 0)


def _pair(p: Column, q: Column, measures) -> Column:
    years = (q["t"] - p["t"]).cast("double")
    return F.struct(years.alias("years"), *[m(p["v"], q["v"], F.nullif(years, F.lit(0.0))).alias(f"m{k}") for k, m in enumerate(measures)])


def slope(a: Column, b: Column, years: Column) -> Column:
    return (b - a) / years


def log_slope(a: Column, b: Column, years: Column) -> Column:
    return (F.log1p(b) - F.log1p(a)) / years


def rise(a: Column, b: Column, years: Column) -> Column:
    return F.signum(b - a).cast("int")


def pair_slopes(points: Column, transform=None) -> Column:
    """Sorted slopes of all pairs of points with different times; ``transform`` is applied to the values first."""
    f = transform or (lambda v: v)
    return F.array_sort(F.transform(pairs_of(points, lambda a, b, years: (f(b) - f(a)) / years), lambda s: s["m0"]))


def middle(sorted_array: Column) -> Column:
    """Median of a sorted array; null when it is empty."""
    n = F.size(sorted_array)
    at = lambda k: F.try_element_at(sorted_array, k.cast("int"))
    return (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2


def tie_counts(points: Column) -> Column:
    """How often each distinct value occurs."""
    values = F.transform(points, lambda p: p["v"])
    return F.transform(F.array_distinct(values), lambda v: F.size(F.filter(values, lambda x: x == v)).cast("bigint"))


def tie_sum(counts: Column, of) -> Column:
    """Sum over groups of equal values of a polynomial of their size t, such as t(t-1)/2 or t(t-1)(2t+5)."""
    return F.aggregate(F.transform(counts, lambda t: of(t).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)


@lru_cache(maxsize=64)
def _mahonian(n: int) -> tuple[int, ...]:
    """Permutations of n by number of inversions."""
    row = [1]
    for k in range(2, n + 1):
        sums = np.cumsum(np.array([0, *row], dtype=object))
        size = len(row) + k - 1
        row = [sums[min(i + 1, len(row))] - sums[max(0, i + 1 - k)] for i in range(size)]
    return tuple(int(x) for x in row)


def kendall_p_value(s: float, n: float, ytie: float, y1: float) -> float | None:
    """Two-sided p of Kendall's tau for distinct times: exact without ties up to 33 points (or with at most one pair out of order), else normal."""
    n, s, ytie = int(n), int(s), int(ytie)
    total = n * (n - 1) // 2
    if n < 2 or ytie == total:
        return None
    dis = (total - ytie - s) // 2
    c = min(dis, total - dis)
    if ytie == 0 and (n <= 33 or c <= 1):
        if 4 * c == n * (n - 1):
            return 1.0
        if n > 33:
            return 2.0 / math.factorial(n) if c == 0 else 2.0 * n / math.factorial(n)
        counts = _mahonian(n)
        return min(1.0, 2 * sum(counts[: c + 1]) / math.factorial(n))
    var = (n * (n - 1) * (2 * n + 5) - y1) / 18
    return math.erfc(abs(s) / math.sqrt(var) / math.sqrt(2)) if var > 0 else None


@F.pandas_udf(DoubleType())
def kendall_p(s: pd.Series, n: pd.Series, ytie: pd.Series, y1: pd.Series) -> pd.Series:
    return pd.Series([kendall_p_value(*x) if all(v == v for v in x) else None for x in zip(s, n, ytie, y1)], dtype="float64")


def bound_ranks(n: Column, y1: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """One-based ranks of the lower and upper 95 % bound of the slope among the sorted pair slopes."""
    nt = n * (n - 1) / 2
    sigma = F.sqrt((n * (n - 1) * (2 * n + 5) - y1) / 18)
    upper = F.least(F.bround((nt + z * sigma) / 2), nt - 1)
    lower = F.greatest(F.bround((nt - z * sigma) / 2) - 1, F.lit(0.0))
    return (lower + 1).cast("int"), (upper + 1).cast("int")


def recent_level(points: Column, years: int = 5) -> Column:
    """Mean of the values within the last ``years`` calendar years up to the latest point."""
    last = F.element_at(points, -1)["t"]
    recent = F.filter(points, lambda p: p["t"] > last - years)
    return F.aggregate(recent, F.lit(0.0), lambda a, p: a + p["v"]) / F.size(recent)


def station_trends(annual: DataFrame, keys: list[str] = SERIES, min_years: int = 10, with_p: bool = True) -> DataFrame:
    """Theil-Sen slopes (plain and of log1p), 95 % bounds of the latter, Mann-Kendall S and p, median and recent level.

    One shuffle gathers each series into a short array; all statistics are array expressions over it.
    """
    g = gather(annual, keys).filter(F.size("points") >= min_years)
    p = F.col("points")
    # The pairs are formed once, for both slopes and the signs.
    g = g.withColumn("__pairs", pairs_of(p, slope, log_slope, rise)).withColumn("__ties", tie_counts(p))
    column = lambda k: F.transform("__pairs", lambda s: s[f"m{k}"])
    g = g.select(
        *keys, F.size(p).alias("n_year_obs"), F.element_at(p, -1)["t"].alias("base_year"), middle(F.array_sort(F.transform(p, lambda x: x["v"]))).alias("median_mgL"),
        F.array_sort(column(0)).alias("__r"), F.array_sort(column(1)).alias("__s"), F.aggregate(column(2), F.lit(0), lambda a, x: a + x).alias("mk_s"), recent_level(p).alias("base_level"),
        tie_sum(F.col("__ties"), lambda t: t * (t - 1) / 2).alias("__ytie"), tie_sum(F.col("__ties"), lambda t: t * (t - 1) * (2 * t + 5)).alias("__y1"),
    )
    low, high = bound_ranks(F.col("n_year_obs"), F.col("__y1"))
    out = g.select(
        *keys, "n_year_obs", "base_year", "median_mgL", middle(F.col("__r")).alias("slope_mgL_yr"), middle(F.col("__s")).alias("slope_log_yr"),
        F.try_element_at("__s", low).alias("slope_log_lo"), F.try_element_at("__s", high).alias("slope_log_hi"), "mk_s", "base_level", "__ytie", "__y1",
    )
    if with_p:
        out = out.withColumn("mk_p", kendall_p(F.col("mk_s").cast("double"), F.col("n_year_obs").cast("double"), F.col("__ytie").cast("double"), F.col("__y1").cast("double")))
    return out.drop("__ytie", "__y1")


def features(annual: DataFrame, keys: list[str] = SERIES, year: str = "year", value: str = "value", compat: bool = False) -> DataFrame:
    """log1p value, lags 1 to 3 by row, trailing means of 3 and 5 earlier rows, years seen, and the slope over all earlier rows.

    Only strictly earlier rows enter. ``compat`` lets the trailing means run over series borders, as a rolling mean over the
    whole frame does: rows are numbered in their total order, and the last rows of each stretch are copied to the next.
    """
    w = Window.partitionBy(*keys).orderBy(year)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    a = annual.withColumn("log_value", F.log1p(value))
    for k in (1, 2, 3):
        a = a.withColumn(f"lag{k}", F.lag("log_value", k).over(w))
    if compat:
        a = numbered(a, [*keys, year], "__k")
        home = F.floor(F.col("__k") / STRETCH)
        a = a.withColumn("__home", home).withColumn("__part", F.explode(F.array_distinct(F.array(home, F.floor((F.col("__k") + 4) / STRETCH)))))
        whole = Window.partitionBy("__part").orderBy("__k")
        a = a.withColumns({f"roll{k}": F.avg("lag1").over(whole.rowsBetween(-(k - 1), 0)) for k in (3, 5)}).filter(F.col("__part") == F.col("__home")).drop("__k", "__home", "__part")
    else:
        a = a.withColumns({f"roll{k}": F.avg("log_value").over(w.rowsBetween(-k, -1)) for k in (3, 5)})
    slope = F.when(F.count("*").over(past) >= 3, F.expr(f"regr_slope(log_value, {year}) over (partition by {', '.join(keys)} order by {year} rows between unbounded preceding and 1 preceding)"))
    return a.withColumn("years_seen", F.row_number().over(w) - 1).withColumn("year_c", F.col(year) - 2000).withColumn("trail_slope", slope)


def temporal_split(features_df: DataFrame, train_end: int = 2013, valid_end: int = 2017, year: str = "year") -> DataFrame:
    """Rows with a first lag, labelled train, valid or test by year."""
    y = F.col(year)
    return features_df.filter(F.col("lag1").isNotNull()).withColumn("split", F.when(y <= train_end, "train").when(y <= valid_end, "valid").otherwise("test"))


def error_measures(df: DataFrame, truth: str, guess: str, by: list[str] | None = None) -> DataFrame:
    """n, MAE, RMSE, R2 and the median absolute error on the native scale (expm1), per group."""
    e = F.col(truth) - F.col(guess)
    t = F.col(truth)
    return df.filter(F.col(guess).isNotNull() & t.isNotNull()).groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.try_divide(F.sum(e * e), F.sum(t * t) - F.sum(t) * F.sum(t) / F.count("*"))).alias("r2"),
        F.median(F.abs(F.expm1(t) - F.expm1(F.col(guess)))).alias("median_abs_native"),
    )


def share_over(df: DataFrame, columns: list[str], limits: list[float], by: list[str] | None = None) -> DataFrame:
    """``*by, series, threshold, share_pct``: share of rows over each limit; a missing value counts as not over. One aggregate for all."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).alias("v")) for c in columns]))
    long = df.select(*(by or []), cells.alias("c")).select(*(by or []), "c.*")
    shares = long.groupBy(*(by or []), "series").agg(*[(100 * F.avg(F.coalesce(F.col("v") > float(t), F.lit(False)).cast("int"))).alias(f"t{k}") for k, t in enumerate(limits)])
    return shares.select(*(by or []), "series", F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{k}").alias("share_pct")) for k, t in enumerate(limits)])).alias("x")).select(*(by or []), "series", "x.*")
