"""Order statistics by cumulative frequencies against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from freshet.operators import frequencies


def test_medians_and_ranks_for_any_buckets(spark):
    rng = np.random.default_rng(0)
    p = pd.DataFrame({"g": rng.choice(["a", "b", "c", None], 4000, p=[0.7, 0.1, 0.1, 0.1]), "v": np.round(rng.normal(0, 3, 4000), 2)})
    p.loc[:1300, "v"] = 1.25  # one value holds a third of all rows
    state = frequencies.value_counts(spark.createDataFrame(p), ["g"], F.col("v"))
    want = p.groupby("g", dropna=False).v.median()
    got = {r.g: (r["median"], r.n) for r in frequencies.medians(state, ["g"]).collect()}
    assert {k: v for k, (v, _) in got.items()} == pytest.approx({(None if k != k else k): v for k, v in want.items()}) and sum(n for _, n in got.values()) == 4000
    bounds = frequencies.bucket_bounds(state, 40)
    assert len(bounds) > 20
    first = lambda n: F.array(F.struct(F.lit("low").alias("target"), F.lit(1).alias("rank")))
    for b in (bounds, [], [0.0]):
        assert {r.g: r.value for r in frequencies.at_ranks(state, ["g"], first, b).collect()} == {(None if k != k else k): v for k, v in p.groupby("g", dropna=False).v.min().items()}


def test_infinities_nan_and_empty(spark):
    df = spark.createDataFrame([("a", float("inf")), ("a", float("-inf")), ("a", float("nan")), ("a", None), ("b", 0.0), ("b", -0.0)], "g string, v double")
    state = frequencies.value_counts(df, ["g"], F.col("v"))
    assert {(r.g, r.value, r.n) for r in state.collect()} == {("a", float("inf"), 1), ("a", float("-inf"), 1), ("b", 0.0, 2)}
    low = lambda n: F.array(F.struct(F.lit(0).alias("target"), F.lit(1).alias("rank")))
    got = frequencies.at_ranks(state, ["g"], low, [float("-inf"), 0.0, float("inf")]).collect()
    assert {(r.g, r.value) for r in got} == {("a", float("-inf")), ("b", 0.0)}
    assert frequencies.medians(state.limit(0), ["g"]).count() == 0


def test_numbered(spark):
    df = spark.range(500).select((F.col("id") * 7 % 501).alias("x")).repartition(6)
    got = frequencies.numbered(df, ["x"]).orderBy("x").collect()
    assert [r.k for r in got] == list(range(500))
