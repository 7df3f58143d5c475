"""Tree learners: splits against all splits, encodings, bounds, early stop, folds, clusters."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors

from freshet.operators import boosting, models


def _loss(y, left):
    return sum(((y[m] - y[m].mean()) ** 2).sum() for m in (left, ~left))


@pytest.mark.parametrize("seed", range(6))
def test_first_split_is_the_best_of_all(seed):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"k": rng.choice(list("pqrs"), 60), "u": np.round(rng.random(60), 1), "v": rng.random(60)})
    pdf["y"] = rng.normal(size=60) + pdf.k.map({"p": 1.0, "q": -1.0, "r": 1.2, "s": 0.0}) * (seed % 2) + pdf.u
    one = boosting.Ensemble.fit(pdf, "y", ["u", "v"], ["k"], boosting.Settings(trees=1, step=1.0, leaves=2, least=5, rows=1.0, columns=1.0))
    y = pdf.y.to_numpy()
    cuts = [pdf[c].to_numpy() <= t for c in ("u", "v") for t in pdf[c].unique()]
    cuts += [pdf.k.isin(s).to_numpy() for n in (1, 2) for s in itertools.combinations("pqrs", n)]
    best = min(_loss(y, m) for m in cuts if min(m.sum(), (~m).sum()) >= 5)
    assert ((y - one.predict(pdf)) ** 2).sum() == pytest.approx(best)


def test_forest_leaves_and_unknown_values():
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b", None], 400), "u": rng.random(400)})
    pdf["y"] = np.where(pdf.k == "a", 4.0, 0.0) + pdf.u
    m = boosting.Ensemble.fit(pdf, "y", ["u"], ["k"], boosting.Settings(trees=20, leaves=0, least=5, rows=1.0, columns=1.0, forest=True))
    assert all(min(c for c, r in zip(t.cover, t.right) if r < 0) >= 5 for t in m.trees)
    odd = pd.DataFrame({"k": ["new", None, "a"], "u": [np.nan, np.inf, 99.0]})
    assert np.isfinite(m.predict(odd)).all() and m.predict(odd)[2] > 4
    assert 1 - ((pdf.y - m.predict(pdf)) ** 2).sum() / ((pdf.y - pdf.y.mean()) ** 2).sum() > 0.95


def test_early_stop_keeps_the_best_round():
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"u": rng.random(300), "y": rng.normal(size=300)})
    s = boosting.Settings(trees=300, step=0.3, leaves=15, least=5, patience=10)
    m = boosting.Ensemble.fit(pdf[:200], "y", ["u"], [], s, pdf[200:])
    assert 1 <= len(m.trees) < 30


def test_sample_is_bounded_and_fixed(spark):
    df = spark.range(1000).selectExpr("id", "double(id % 7) as y", "double(id) as u").repartition(5)
    a, b = (boosting.sample(d, "y", ["u"], 100) for d in (df, df.repartition(3)))
    assert len(a) == 100 and a.equals(b) and len(boosting.sample(df, "y", ["u"])) == 1000


def test_spatial_folds_never_share_a_block(spark):
    rng = np.random.default_rng(5)
    n = 300
    pdf = pd.DataFrame({"latitude": rng.uniform(30, 50, n), "longitude": rng.uniform(-100, -80, n), "ion": rng.choice(["cl", "na"], n), "u": rng.random(n)})
    pdf["y"] = pdf.u * 2
    pdf.loc[0, "latitude"] = np.nan
    df = spark.createDataFrame(pdf)
    s = boosting.Settings(trees=30, step=0.2, leaves=15, least=5)
    out = models.spatial_cv(df, "y", ["u"], ["ion"], s).toPandas()
    assert len(out) == n - 1 and out.groupby("block").fold.nunique().max() == 1 and out.fold.nunique() == 5
    k = 2
    alone = boosting.Ensemble.fit(boosting.sample(spark.createDataFrame(out.drop(columns="guess")), "y", ["u", "ion", "fold"]).query("fold != @k").reset_index(drop=True), "y", ["u"], ["ion"], s)
    assert alone.predict(out[out.fold == k]) == pytest.approx(out.guess[out.fold == k].to_numpy())
    one = models.spatial_cv(df.filter("latitude between 30 and 31.9 and longitude between -100 and -98.1"), "y", ["u"], ["ion"], s).toPandas()
    assert one.guess.isna().all()


def test_silhouette_brute_force(spark):
    rng = np.random.default_rng(6)
    x, c = np.concatenate((rng.normal(0, 1, (30, 2)), rng.normal(4, 1, (20, 2)), [[9.0, 9.0]])), np.array([0] * 30 + [1] * 20 + [2])
    df = spark.createDataFrame([(str(i), Vectors.dense(*v), int(k)) for i, (v, k) in enumerate(zip(x.tolist(), c))], ["station_id", "x", "cluster"])
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    s = []
    for i in range(len(x)):
        if (c == c[i]).sum() == 1:
            s.append(0.0)
            continue
        a = far[i][c == c[i]].sum() / ((c == c[i]).sum() - 1)
        b = min(far[i][c == k].mean() for k in set(c) - {c[i]})
        s.append((b - a) / max(a, b))
    assert models.silhouette(df, "station_id") == pytest.approx(np.mean(s))
    assert np.isnan(models.silhouette(df.filter("cluster = 0"), "station_id"))
