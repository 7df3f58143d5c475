"""Trees without a bound of leaves: cost set by levels, splits against all splits, equal splits."""

import itertools
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest

from freshet.operators import boosting

FOREST = replace(boosting.FOREST, trees=1)


def _rows(n, seed):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"k": rng.choice(["p", "q", "r", None], n), "u": np.round(rng.random(n), 1), "v": rng.random(n), "w": np.where(rng.random(n) < 0.2, np.nan, rng.random(n))})
    return pdf.assign(y=rng.normal(size=n) + pdf.k.eq("p") + 2 * pdf.u)


def test_leaves_of_a_level_are_searched_together(monkeypatch):
    searches, one = [], boosting._best_split
    monkeypatch.setattr(boosting, "_best_split", lambda *a: searches.append(1) or one(*a))
    tree = boosting.Ensemble.fit(_rows(2000, 0), "y", ["u", "v", "w"], ["k"], FOREST).trees[0]
    assert sum(r < 0 for r in tree.right) > 200 and len(searches) < 50


@pytest.mark.parametrize("seed", range(4))
def test_every_split_is_the_best_of_all(seed):
    pdf = _rows(150, seed)
    encoder = boosting.Encoder(pdf, ["u", "v", "w"], ["k"])
    x, y = encoder.bins(pdf), pdf.y.to_numpy()
    rows = np.sort(np.random.default_rng(seed).integers(0, 150, 150))
    gains = np.zeros(4)
    tree = boosting.grow(x, y, rows, np.arange(4), 1, FOREST, gains)
    fall = lambda at, go: (at := y[at]).var() * len(at) - sum(at[g].var() * g.sum() for g in (go, ~go))
    todo, falls, leaves = [(0, rows)], 0.0, 0
    while todo:
        k, at = todo.pop()
        assert tree.cover[k] == len(at) and tree.value[k] == pytest.approx(y[at].mean())
        cuts = [x[at, f] <= b for f in (1, 2, 3) for b in np.unique(x[at, f])]
        cuts += [np.isin(x[at, 0], kinds) for n in (1, 2, 3) for kinds in itertools.combinations(range(4), n)]
        best = max((fall(at, go) for go in cuts if min(go.sum(), (~go).sum()) >= 5), default=0.0)
        if tree.left[k] < 0:
            leaves += 1
            assert best < 1e-9
            continue
        go = np.isin(x[at, tree.feature[k]], list(tree.bins[k])) if k in tree.bins else x[at, tree.feature[k]] <= tree.cut[k]
        assert fall(at, go) == pytest.approx(best)
        falls += best
        todo += [(tree.left[k], at[go]), (tree.right[k], at[~go])]
    assert leaves > 8 and gains.sum() == pytest.approx(falls)


def test_of_equal_splits_the_first_feature_counts():
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"u": rng.permutation(3000) % 200 / 200.0})
    pdf = pdf.assign(copied=pdf.u * 2, turned=-pdf.u, y=np.sin(9 * pdf.u) + rng.normal(size=3000) / 3)
    tree = boosting.Ensemble.fit(pdf, "y", ["u", "copied", "turned"], [], FOREST).trees[0]
    assert len(tree.value) > 100 and {f for f, r in zip(tree.feature, tree.right) if r >= 0} == {0}


def test_alike_labels_make_one_leaf():
    pdf = _rows(40, 1).assign(y=2.5)
    tree = boosting.Ensemble.fit(pdf, "y", ["u"], ["k"], FOREST).trees[0]
    assert tree.value == [2.5] and tree.cover == [40]


def test_shipped_trees_are_small_and_the_same():
    pdf = _rows(3000, 2)
    model = boosting.Ensemble.fit(pdf, "y", ["u", "v", "w"], ["k"], replace(FOREST, trees=5))
    packed = boosting.Packed(model)
    odd = pd.concat((pdf, pd.DataFrame({"k": ["new", None], "u": [np.nan, 9.0], "v": [np.inf, 0.5], "w": [-9.0, np.nan]})))
    assert (packed.unpacked().predict(odd) == model.predict(odd)).all()
    assert packed.unpacked().trees[0].nodes() == model.trees[0].nodes()
    assert len(packed.data) < 25 * sum(len(t.value) for t in model.trees)
