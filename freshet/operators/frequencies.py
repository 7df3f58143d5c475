"""Order statistics by cumulative frequencies, over states of counts per group and value.

Counts are cut into ordered buckets of about equal numbers of distinct values; within a bucket running sums are taken,
the totals of the buckets before are added, and the first value that reaches a rank is picked. However large a group
is, its values spread over as many buckets as their number asks for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.session import join_dictionary, reliable_checkpoint

#: Rows of the state in one bucket, and buckets at most; beyond that buckets grow, and their sort spills.
BUCKET_ROWS, MOST_BUCKETS = 100_000, 20_000


def value_counts(df: DataFrame, groups: list[str], value: Column) -> DataFrame:
    """The mergeable state ``*groups, value, n``; null and NaN are left out, zero of either sign is one value. Combined map-side."""
    v = value.cast("double")
    rows = df.filter(v.isNotNull() & ~F.isnan(v)).select(*groups, (v + F.lit(0.0)).alias("value"))
    return rows.groupBy(*groups, "value").agg(F.count("*").alias("n"))


def bucket_bounds(counts: DataFrame, bucket_rows: int = BUCKET_ROWS) -> list[float]:
    """Ordered bounds that cut the rows of a state into about equal shares; at most ``MOST_BUCKETS`` numbers reach the driver."""
    rows = counts.count()
    buckets = min(MOST_BUCKETS, -(-rows // bucket_rows))
    if buckets < 2:
        return []
    found = counts.agg(F.percentile_approx("value", [k / buckets for k in range(1, buckets)], 20 * buckets).alias("b")).first()["b"]
    return sorted(set(found or []))


def bucket_of(bounds: list[float], value: str = "value") -> Column:
    """Number of bounds below the value, by binary search in a literal array; equal values share a bucket."""
    if not bounds:
        return F.lit(0)
    step, steps = 1, []
    while step <= len(bounds):
        steps, step = [step, *steps], 2 * step
    sorted_bounds = f"array({', '.join(repr(float(b)) + 'D' if abs(b) != float('inf') else ('' if b > 0 else '-') + 'double(' + repr('Infinity') + ')' for b in bounds)})"
    return F.expr(f"aggregate(array({', '.join(map(str, steps))}), 0, (k, s) -> if(k + s <= {len(bounds)} and {value} > element_at({sorted_bounds}, least(k + s, {len(bounds)})), k + s, k))")


def bucketed(counts: DataFrame, groups: list[str], bounds: list[float] | None = None) -> DataFrame:
    """A written state (``*groups, value, n``) laid out by ordered buckets of values: one shuffle, written once.

    ``bounds`` only spread the work and never change a result.
    """
    bounds = bucket_bounds(counts) if bounds is None else bounds
    keyed = counts.select(*groups, "value", "n", bucket_of(bounds).alias("__bucket"))
    return reliable_checkpoint(keyed.repartition(2 * len(bounds) + 1, "__bucket"), keep_layout=True)


def ranked(state: DataFrame, groups: list[str], ranks: Callable[[Column], Column]) -> DataFrame:
    """``*groups, target, value, n``: for each struct (``target``, ``rank``) that ``ranks`` makes of a group's total, the
    least value whose cumulative count reaches the rank.

    ``state`` comes from ``bucketed`` for these groups or finer ones, which are rolled up; null keys are groups. Rows of one
    bucket lie together, so roll-up, running sums and totals stay where they are; only the totals (a row per group and
    bucket) travel, and what is joined back is a row per group and rank.
    """
    group = F.struct(*[F.coalesce(F.col(g).cast("string"), F.lit("\u0000null")) for g in groups]) if groups else F.struct(F.lit("all"))
    totals = state.groupBy("__bucket", group.alias("__group")).agg(F.sum("n").alias("__sum"))
    ordered = Window.partitionBy("__group").orderBy("__bucket")
    totals = totals.select("__bucket", "__group", "__sum", (F.sum("__sum").over(ordered) - F.col("__sum")).alias("__before"), F.sum("__sum").over(Window.partitionBy("__group")).alias("__n"))
    # What is sought in each bucket: at most a row per group and rank, however many buckets there are.
    here = F.filter(ranks(F.col("__n")), lambda t: (t["rank"] > F.col("__before")) & (t["rank"] <= F.col("__before") + F.col("__sum")))
    sought = totals.select("__bucket", "__group", "__n", F.transform(here, lambda t: F.struct(t["target"].alias("target"), (t["rank"] - F.col("__before")).alias("rank"))).alias("__sought")).filter(F.size("__sought") > 0)
    rows = state.groupBy("__bucket", *groups, "value").agg(F.sum("n").alias("n")).withColumn("__group", group)
    running = rows.withColumn("__run", F.sum("n").over(Window.partitionBy("__bucket", "__group").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)))
    done = join_dictionary(running, sought, ["__bucket", "__group"])
    hits = F.filter("__sought", lambda t: (t["rank"] <= F.col("__run")) & (t["rank"] > F.col("__run") - F.col("n")))
    return done.select(*groups, "value", F.col("__n").alias("__total"), F.explode(hits).alias("t")).select(*groups, F.col("t.target").alias("target"), "value", F.col("__total").alias("n"))


def at_ranks(counts: DataFrame, groups: list[str], ranks: Callable[[Column], Column], bounds: list[float] | None = None) -> DataFrame:
    """``ranked`` for the groups of a state that is not laid out yet."""
    return ranked(bucketed(counts, groups, bounds), groups, ranks)


def medians(counts: DataFrame, groups: list[str]) -> DataFrame:
    """``*groups, median, n``: the middle value, or the mean of the two middle values, of each group of a state."""
    two = lambda n: F.array(F.struct(F.lit(0).alias("target"), F.expr("(__n + 1) div 2").alias("rank")), F.struct(F.lit(1).alias("target"), F.expr("__n div 2 + 1").alias("rank")))
    return at_ranks(counts, groups, two).groupBy(*groups).agg(F.avg("value").alias("median"), F.max("n").alias("n"))


def numbered(df: DataFrame, order: list[str], out: str = "k") -> DataFrame:
    """``df`` with the row number (from 0) in a total order: range-sorted partitions, each numbered for itself, plus the rows before it.

    ``order`` must tell all rows apart. The sorted rows are written once, so that the numbers hold when a task runs again.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    ranged = reliable_checkpoint(ranged).withColumn("__lot", F.shiftright("__id", 33)).withColumn("__at", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
    lots = ranged.groupBy("__lot").agg(F.count("*").alias("__n"))  # a row per partition
    lots = lots.select("__lot", (F.sum("__n").over(Window.orderBy("__lot")) - F.col("__n")).alias("__before"))
    return join_dictionary(ranged, lots, ["__lot"]).withColumn(out, F.col("__before") + F.col("__at")).drop("__id", "__lot", "__at", "__before")
