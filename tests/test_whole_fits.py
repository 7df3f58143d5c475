"""Validated models see all rows outside a fold, however many: against fits of all of them at once."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from freshet.operators import boosting, models


def test_every_row_outside_the_fold_counts(spark):
    rows = spark.range(120_000).select(
        (F.col("id") % 12 * 2 + 30.5).alias("latitude"), F.lit(-90.5).alias("longitude"), F.when(F.col("id") % 5 > 1, "cl").otherwise("na").alias("ion"),
        (F.xxhash64("id") % 1000 / 10.0).alias("u"), (F.xxhash64(F.col("id") + 7) % 1000 / 100.0 + F.col("id") % 3).alias("y"),
    )
    s = boosting.Settings(trees=2, step=0.5, leaves=8, least=40, rows=1.0, columns=1.0)
    out = models.spatial_cv(rows, "y", ["u"], ["ion"], s).toPandas()
    assert len(out) == 120_000 and out.fold.nunique() == 5
    for k in range(5):
        whole = boosting.Ensemble.fit(out[out.fold != k].reset_index(drop=True), "y", ["u"], ["ion"], s)
        assert whole.trees[0].cover[0] == (out.fold != k).sum()
        assert out.guess[out.fold == k].to_numpy() == pytest.approx(whole.predict(out[out.fold == k]), abs=1e-9)


def _rows(n, seed):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"k": rng.choice(["p", "q", "r", None], n), "u": np.round(rng.random(n), 1), "v": rng.random(n), "w": np.where(rng.random(n) < 0.2, np.nan, rng.random(n))})
    return pdf.assign(none=np.nan, y=rng.normal(size=n) + pdf.k.eq("p") + 2 * pdf.u, fold=rng.integers(0, 3, n).astype(np.int32))


def test_edges_are_those_of_the_rows_outside(spark):
    pdf = _rows(1500, 0)
    pdf.loc[5, "v"], pdf.loc[6, "v"], pdf.loc[7:9, "u"] = np.inf, -np.inf, [-0.0, 0.0, 9.0]
    numbers = ["u", "v", "w", "none"]
    found = boosting.encoders_apart(spark.createDataFrame(pdf).repartition(7), numbers, ["k"], "fold")
    assert sorted(found) == [0, 1, 2]
    for k, encoder in found.items():
        alone = boosting.Encoder(pdf[pdf.fold != k], numbers, ["k"])
        assert encoder.kinds == alone.kinds and encoder.names == alone.names
        assert all(np.array_equal(a, b) for a, b in zip(encoder.edges, alone.edges)) and (encoder.bins(pdf) == alone.bins(pdf)).all()


def test_cases_side_by_side_with_rows_that_are_only_asked(spark):
    pdf = _rows(900, 1)
    pdf.loc[:20, "y"] = np.nan  # no label
    df = spark.createDataFrame(pdf).withColumns({"y": F.nanvl("y", F.lit(None).cast("double")), "fold": F.when(F.col("v") > 0.02, F.col("fold"))})
    small = boosting.Settings(trees=6, step=0.3, leaves=9, least=5, rows=1.0, columns=1.0)
    cases = {"a": boosting.Case(["u", "v", "w"], ["k"], small), "b": boosting.Case(["v"], [], small), "c": boosting.Case(["u", "v"], ["k"], replace(boosting.FOREST, trees=4))}
    out = boosting.predicted_apart(df, "y", cases, "fold").toPandas()
    assert len(out) == 900 and out[["a", "b", "c"]].isna().any(axis=1).sum() == out.fold.isna().sum() == (pdf.v <= 0.02).sum() > 0
    assert out.y.isna().sum() == 21 and set(out.columns) == {*pdf.columns, "a", "b", "c"}
    for k in range(3):
        rest, own = out[out.fold.notna() & (out.fold != k) & out.y.notna()].reset_index(drop=True), out[out.fold == k]
        for name in "ab":
            alone = boosting.Ensemble.fit(rest, "y", cases[name].numeric, cases[name].categorical, small)
            assert own[name].to_numpy() == pytest.approx(alone.predict(own))
    one = boosting.predicted_apart(df.filter("fold = 1"), "y", cases, "fold").toPandas()
    assert len(one) and one[["a", "b", "c"]].isna().all(axis=None)


@pytest.mark.parametrize("few, together", [(10, 100), (60, 1), (300, 500)])
def test_histograms_and_levels_grow_the_same_tree(monkeypatch, few, together):
    pdf, forest = _rows(3000, 3).assign(turned=lambda d: -d.v), replace(boosting.FOREST, trees=2)
    fit = lambda: boosting.Ensemble.fit(pdf, "y", ["u", "v", "w", "turned"], ["k"], forest)
    monkeypatch.setattr(boosting, "FEW", 10**9)
    levels = fit()
    monkeypatch.setattr(boosting, "FEW", few)
    monkeypatch.setattr(boosting, "TOGETHER", together)
    monkeypatch.setattr(boosting, "LOT", 700)
    mixed = fit()
    shape = lambda m: [sorted((f, c, n) for f, c, _, _, _, n in t.nodes() if not isinstance(c, frozenset)) for t in m.trees]
    assert shape(mixed) == shape(levels) and mixed.gains == pytest.approx(levels.gains)
    assert mixed.predict(pdf) == pytest.approx(levels.predict(pdf), abs=1e-12)


def test_fitted_values_are_those_of_the_tree():
    pdf = _rows(800, 4)
    x, y = boosting.Encoder(pdf, ["u", "v", "w"], ["k"]).bins(pdf), pdf.y.to_numpy()
    rows, fitted = np.arange(0, 800, 2), np.full(800, np.nan)
    tree = boosting.grow(x, y, rows, np.array([0, 2, 3]), 1, boosting.Settings(leaves=12, least=10), np.zeros(4), fitted)
    assert np.isnan(fitted[1::2]).all() and (fitted[rows] == tree.predict(x[rows])).all()
