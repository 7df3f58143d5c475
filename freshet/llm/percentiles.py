"""Percentiles of very large numeric columns by cumulative frequencies.

The column is reduced to counts per group and value, map-side combined. Those counts are the mergeable state: results of
separate days or partitions are added with ``merge_counts``. For the percentiles the counts are range-sorted into
ordered buckets, as many as the counts ask for; running sums are taken within a bucket, the totals of the buckets before
are added, and the first value that reaches the target rank is picked. A group that holds a third of all rows is spread
over all buckets.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.operators import frequencies
from freshet.session import reliable_checkpoint


def quantized(value: Column, relative_error: float | None) -> Column:
    """The value itself, or the middle of its logarithmic bin, which lies within ``relative_error`` of it."""
    if not relative_error:
        return value
    if not 0 < relative_error < 1:
        raise ValueError("relative_error lies between 0 and 1")
    step = math.log((1 + relative_error) / (1 - relative_error))
    middle = F.exp(F.round(F.log(F.abs(value)) / step) * step)
    return F.when(value == 0, F.lit(0.0)).otherwise(F.signum(value) * middle)


def value_counts(df: DataFrame, groups: list[str], value: str, relative_error: float | None = None) -> DataFrame:
    """The mergeable state: ``*groups, value, n``.

    Null and NaN are left out; zero of either sign is one value; infinities count as the ends of the order. Without
    ``relative_error`` the percentiles are exact and the state has a row per distinct value; with it every value is
    replaced by one within that relative error, and the state is bounded by the bins of the value range (about
    1420 / relative_error for all doubles) per group, however many rows there are. A null group key is a group.
    """
    return frequencies.value_counts(df, groups, quantized(F.col(value).cast("double"), relative_error))


def merge_counts(*parts: DataFrame) -> DataFrame:
    """States of the same groups added up; the order of merging does not matter."""
    both = reduce(DataFrame.unionByName, parts)
    return both.groupBy(*[c for c in both.columns if c != "n"]).agg(F.sum("n").alias("n"))


def roll_up(counts: DataFrame, groups: list[str]) -> DataFrame:
    """The state of coarser groups, from the state of finer ones."""
    return counts.groupBy(*groups, "value").agg(F.sum("n").alias("n"))


def _ranks(percents: list[int]) -> Callable[[Column], Column]:
    if not all(isinstance(p, int) and 0 <= p <= 100 for p in percents):
        raise ValueError("percents are whole numbers from 0 to 100")
    # Whole numbers throughout: ceil(n * p / 100), at least 1.
    rank = lambda n, p: F.greatest(F.lit(1).cast("bigint"), F.call_function("div", n * p + 99, F.lit(100)))
    return lambda n: F.array(*[F.struct(F.lit(p).alias("target"), rank(n, p).alias("rank")) for p in percents])


def percentiles(counts: DataFrame, groups: list[str], percents: list[int], bounds: list[float] | None = None) -> DataFrame:
    """``*groups, percent, value, n`` from a state of ``value_counts``: the least value whose cumulative count reaches
    ceil(percent / 100 * n), the least of all for percent 0.

    ``bounds`` of the buckets only spread the work and never change the result. Ties are counts of one value. An empty
    state gives no row.
    """
    ranks = _ranks(percents)
    return frequencies.at_ranks(reliable_checkpoint(counts), groups, ranks, bounds).withColumnRenamed("target", "percent")


def percentiles_by(df: DataFrame, groupings: dict[str, list[str]], value: str, percents: list[int], relative_error: float | None = None) -> DataFrame:
    """Percentiles of several groupings from one pass over the rows.

    ``groupings`` names each list of group columns. The rows are reduced once to counts over all group columns, and these
    are laid out by buckets of values once; each grouping rolls them up where they lie. Columns: ``grouping``, all group
    columns as text (null where a grouping lacks one), ``percent, value, n``.
    """
    columns, ranks = list(dict.fromkeys(c for g in groupings.values() for c in g)), _ranks(percents)
    state = frequencies.bucketed(reliable_checkpoint(value_counts(df, columns, value, relative_error)), columns)
    parts = []
    for name, groups in groupings.items():
        part = frequencies.ranked(state, groups, ranks)
        cells = [(F.col(c) if c in groups else F.lit(None)).cast("string").alias(c) for c in columns]
        parts.append(part.select(F.lit(name).alias("grouping"), *cells, F.col("target").alias("percent"), "value", "n"))
    return reduce(DataFrame.unionByName, parts)
