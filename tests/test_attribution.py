"""Attribution over whole tables."""

import numpy as np
import pandas as pd
import pytest

from freshet.operators import boosting, models


def _table(n=700):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"station_id": [f"s{k}" for k in range(n)], "ion": rng.choice(["cl", "na", "so4"], n), "a": rng.random(n), "b": rng.integers(0, 4, n).astype(float), "c": rng.random(n)})
    pdf.loc[::50, "a"] = np.nan
    pdf["y"] = 3 * pdf.a.fillna(-1) + pdf.ion.map({"cl": 0.0, "na": 5.0, "so4": -1.0}) + pdf.b * (pdf.c > 0.5)
    return pdf


def test_mean_abs_shap_takes_every_row_and_adds_up(spark):
    pdf = _table()
    model = boosting.Ensemble.fit(pdf, "y", ["a", "b", "c"], ["ion"], boosting.Settings(trees=12, step=0.3, leaves=7, least=10))
    x = model.encoder.bins(pdf).astype(float)
    phi = sum(models.tree_shap_rows(t.nodes(), x) for t in model.trees) * model.weight
    base = model.start + model.weight * sum(np.average([v for v, r in zip(t.value, t.right) if r < 0], weights=[c for c, r in zip(t.cover, t.right) if r < 0]) for t in model.trees)
    assert phi.sum(1) + base == pytest.approx(model.predict(pdf))
    got = {r.feature: r.mean_abs_shap for r in models.mean_abs_shap(model, spark.createDataFrame(pdf.astype({"a": float})).repartition(3)).collect()}
    assert got == pytest.approx(dict(zip(["ion", "a", "b", "c"], np.abs(phi).mean(0))))
    assert {n for n, _ in model.importance()[:1]} == {"ion"} and sum(v for _, v in model.importance()) == pytest.approx(100)
