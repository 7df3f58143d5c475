"""Regression trees on binned features, grown leaf by leaf from histograms: boosted ensembles and forests.

Validation by folds (``predicted_apart``) fits on all rows outside a fold, as bins of a byte each. A single model for all rows
is fitted on what ``sample`` gives: at most ``FIT_ROWS`` rows, all of them where there are no more, else those with the least
hash; the bound is a parameter. It is broadcast and predicts batch by batch wherever the rows lie.
"""

from __future__ import annotations

import heapq
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.session import reliable_checkpoint

#: Rows that ``sample`` gives at most, and bins of a feature.
FIT_ROWS, BINS = 100_000, 255
#: Rows times features that are searched at a time, so that they stay in the cache.
LOT = 100_000
#: Rows of a leaf of a forest up to which it is searched by level, rows searched by level at a time, and rows that a tree predicts at a time.
FEW, TOGETHER, STRETCH = 500, 20_000, 50_000


@dataclass(frozen=True)
class Settings:
    """Sizes of an ensemble. ``leaves`` 0: as many as ``least`` rows a leaf allow. ``patience`` 0: no early stop."""

    trees: int = 500
    step: float = 0.04
    leaves: int = 63
    least: int = 40
    rows: float = 0.8
    columns: float = 0.8
    patience: int = 0
    forest: bool = False


# Sizes of the learners in the analysis.
LEVEL = Settings()
BASELINE = Settings(trees=1500, step=0.05, least=50, patience=60)
ROBUST = Settings(trees=400, step=0.05)
FOREST = Settings(trees=120, step=1.0, leaves=0, least=5, rows=1.0, columns=1.0, forest=True)


class Encoder:
    """Numbers to bins at quantiles, categories to bins in alphabetical order; bin 0 is missing or unknown."""

    def __init__(self, pdf: pd.DataFrame, numeric: list[str], categorical: list[str]):
        numbers = (pdf[c].to_numpy(float) for c in numeric)
        self._set(numeric, categorical, [self.cuts(np.unique(v[np.isfinite(v)])) for v in numbers], [self.first(pdf[c].dropna().astype(str).unique()) for c in categorical])

    def _set(self, numeric: list[str], categorical: list[str], edges: list[np.ndarray], kinds: list[list[str]]) -> None:
        self.numeric, self.categorical, self.edges = numeric, categorical, edges
        self.kinds = [{k: i + 1 for i, k in enumerate(some)} for some in kinds]

    @classmethod
    def known(cls, numeric: list[str], categorical: list[str], edges: list[np.ndarray], kinds: list[list[str]]) -> Encoder:
        """Of edges and categories that are found already."""
        encoder = cls.__new__(cls)
        encoder._set(numeric, categorical, edges, kinds)
        return encoder

    @staticmethod
    def cuts(v: np.ndarray) -> np.ndarray:
        """Edges of distinct numbers in order."""
        return v if len(v) < BINS else np.unique(np.quantile(v, np.linspace(0, 1, BINS), method="lower"))

    @staticmethod
    def first(kinds: np.ndarray) -> list[str]:
        """Categories that have a bin."""
        return sorted(kinds)[: BINS - 1]

    @property
    def names(self) -> list[str]:
        return [*self.categorical, *self.numeric]

    def bins(self, pdf: pd.DataFrame) -> np.ndarray:
        """Rows by features. A number falls in the bin of the least edge that is not below it."""
        out = np.zeros((len(pdf), len(self.names)), np.uint8)
        for k, (c, kinds) in enumerate(zip(self.categorical, self.kinds)):
            out[:, k] = pdf[c].map(lambda v, kinds=kinds: kinds.get(str(v), 0) if v is not None else 0).to_numpy(np.uint8)
        for k, (c, edges) in enumerate(zip(self.numeric, self.edges), len(self.categorical)):
            v = pdf[c].to_numpy(float)
            out[:, k] = np.where(np.isfinite(v), np.minimum(np.searchsorted(edges, v, "left"), len(edges) - 1) + 1, 0) if len(edges) else 0
        return out


@dataclass
class Tree:
    """Nodes in parallel lists (arrays once shipped); ``left`` is -1 at a leaf, ``right`` the node after ``left``; a split sends the bins up to ``cut`` to the left."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    bins: dict[int, frozenset] = field(default_factory=dict)  # of a split of categories: those on the left
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[int] = field(default_factory=list)

    def add(self, value: float, cover: int) -> int:
        for name, v in zip(("feature", "cut", "left", "right", "value", "cover"), (-1, -1, -1, -1, value, cover)):
            getattr(self, name).append(v)
        return len(self.value) - 1

    def __getstate__(self) -> tuple:
        kinds = (("feature", np.int32), ("cut", np.int16), ("left", np.int32), ("value", np.float64), ("cover", np.int32))
        return self.bins, {name: np.asarray(getattr(self, name), kind) for name, kind in kinds}

    def __setstate__(self, state: tuple) -> None:
        self.bins, arrays = state
        self.__dict__.update(arrays, right=np.where(arrays["left"] < 0, -1, arrays["left"] + 1).astype(np.int32))

    def goes_left(self, k: int, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        v = x[rows, self.feature[k]]
        if k not in self.bins:
            return v <= self.cut[k]
        known = np.zeros(BINS + 1, bool)
        known[list(self.bins[k])] = True
        return known[v]

    def predict(self, x: np.ndarray) -> np.ndarray:
        if len(x) > STRETCH:
            return np.concatenate([self.predict(x[k : k + STRETCH]) for k in range(0, len(x), STRETCH)])
        feature, cut, left, right = (np.asarray(v) for v in (self.feature, self.cut, self.left, self.right))
        known, kinds = np.zeros((len(self.bins), BINS + 1), bool), np.full(len(left), -1)
        for i, (k, some) in enumerate(self.bins.items()):
            kinds[k] = i
            known[i, list(some)] = True
        at, rows = np.zeros(len(x), int), np.arange(len(x))
        while len(rows := rows[left[at[rows]] >= 0]):  # a level at a time
            k = at[rows]
            v = x[rows, feature[k]]
            go = v <= cut[k]
            some = np.flatnonzero(kinds[k] >= 0)
            go[some] = known[kinds[k[some]], v[some]]
            at[rows] = np.where(go, left[k], right[k])
        return np.asarray(self.value)[at]

    def nodes(self) -> list[tuple]:
        """As (feature, cut or set of left bins, left, right, value, cover), feature -1 at a leaf (see ``models.tree_shap_rows``)."""
        each = zip(self.feature, self.cut, self.left, self.right, self.value, self.cover)
        return [(f if r >= 0 else -1, self.bins.get(k, c), a, r, v, float(n)) for k, (f, c, a, r, v, n) in enumerate(each)]


def _histogram(x: np.ndarray, g: np.ndarray, rows: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """Sums and counts of ``rows`` by feature and bin."""
    out, p = np.zeros((2, size)), x.shape[1]
    lot = max(1, LOT // p)
    for k in range(0, len(rows), lot):
        some = rows[k : k + lot]
        at = (x.take(some, axis=0) + offsets).ravel()
        out[0] += np.bincount(at, np.repeat(g.take(some), p), size)
        out[1] += np.bincount(at, minlength=size)
    return out.reshape(2, p, -1)


def _running(h: np.ndarray, n_cat: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sums and counts up to each bin, and the order of the categories, which is by their mean."""
    (s, c), orders = np.cumsum(h, 2), []
    for f in range(n_cat):
        mean = np.divide(h[0, f], h[1, f], out=np.full(h.shape[2], np.inf), where=h[1, f] > 0)
        orders.append(np.argsort(mean, kind="stable"))
        s[f], c[f] = np.cumsum(h[:, f, orders[f]], 1)
    return s, c, orders


def _best_split(h: np.ndarray, n_cat: int, least: int) -> tuple[float, int, int, frozenset | None] | None:
    """(gain, feature, last left bin, left categories) of the best split of a histogram; categories are ordered by their mean first."""
    total, n = h[0, 0].sum(), h[1, 0].sum()
    s, c, orders = _running(h, n_cat)
    rest = n - c
    never = np.minimum(c, rest) < least
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = s**2
        gain /= c
        np.subtract(total, s, out=s)
        s *= s
        s /= rest
        gain += s
    gain[never] = -np.inf
    f, b = divmod(int(gain.argmax()), gain.shape[1])
    best = gain[f, b] - total**2 / n
    if not best > 1e-10:
        return None
    return best, f, b, frozenset(orders[f][: b + 1].tolist()) if f < n_cat else None


def grow(x: np.ndarray, g: np.ndarray, rows: np.ndarray, columns: np.ndarray, n_cat: int, s: Settings, gains: np.ndarray, fitted: np.ndarray | None = None) -> Tree:
    """A tree for the mean of ``g``: the leaf with the largest gain is split next. Without a bound of leaves their order is all the same.

    ``fitted`` takes what a tree with a bound of leaves says of ``rows``.
    """
    if not s.leaves:
        return _grow_whole(x, g, rows, columns, n_cat, s, gains)
    tree, xc = Tree(), x if len(columns) == x.shape[1] else x.take(columns, axis=1)
    cats = int((columns < n_cat).sum())
    width = BINS + 1
    offsets, size = np.arange(len(columns)) * width, len(columns) * width
    heap: list[tuple] = []
    ends: dict[int, np.ndarray] = {}

    def leaf(at: np.ndarray, h: np.ndarray) -> int:
        k = tree.add(float(h[0, 0].sum() / len(at)), len(at))
        ends[k] = at
        if len(at) >= 2 * s.least and (best := _best_split(h, cats, s.least)):
            heapq.heappush(heap, (-best[0], k, h, best))
        return k

    leaf(rows, _histogram(xc, g, rows, offsets, size))
    leaves = 1
    while heap and leaves < s.leaves:
        _, k, h, (gain, f, cut, bins) = heapq.heappop(heap)
        at = ends.pop(k)
        tree.feature[k], tree.cut[k] = int(columns[f]), cut
        if bins is not None:
            tree.bins[k] = bins
        go = tree.goes_left(k, x, at)
        a, b = at[go], at[~go]
        small = a if len(a) <= len(b) else b
        hs = _histogram(xc, g, small, offsets, size)
        ha, hb = (hs, h - hs) if small is a else (h - hs, hs)
        tree.left[k], tree.right[k] = leaf(a, ha), leaf(b, hb)
        gains[columns[f]] += gain
        leaves += 1
    if fitted is not None:
        for k, at in ends.items():
            fitted[at] = tree.value[k]
    return tree


def _best_exact(h: np.ndarray, n_cat: int, least: int) -> tuple[float, int, int, frozenset | None]:
    """As ``_best_split`` of a histogram of whole numbers, by the gain and the choice among equals of ``_grow_by_level``."""
    total, n = h[0, 0].sum(), h[1, 0].sum()
    s, c, orders = _running(h, n_cat)
    rest = n - c
    less = np.minimum(c, rest)
    share = np.rint(total * less / n)
    np.subtract(total, share, out=share, where=c > rest)
    s -= share
    s *= s
    with np.errstate(divide="ignore", invalid="ignore"):
        s *= n / (c * rest)
    s[less < least] = -np.inf
    f, b = divmod(int(s.argmax()), s.shape[1])
    return s[f, b], f, b, frozenset(orders[f][: b + 1].tolist()) if f < n_cat else None


def _grow_whole(x: np.ndarray, g: np.ndarray, rows: np.ndarray, columns: np.ndarray, n_cat: int, s: Settings, gains: np.ndarray) -> Tree:
    """A tree that only ``s.least`` bounds: leaves of more than ``FEW`` rows are split by histograms, the others level by level, some at a time.

    So beside the bins of the rows it takes memory for ``TOGETHER`` rows. Sums are of even whole numbers (``g`` in steps of
    2**-50 of its largest sum), so they are exact in any order and from either side, and of splits that part the rows alike the
    one of the first feature counts, whichever way they are found.
    """
    tree, y, n = Tree(), g[rows], len(rows)
    tree.add(float(y.mean()), n)
    z = y - y.mean()
    most = float(np.abs(z).max())
    if n < 2 * s.least or not most:
        return tree
    unit = 2.0 ** (np.floor(np.log2(most * n)) - 51)
    z = 2 * np.rint(z / (2 * unit))
    x = (x if len(columns) == x.shape[1] else x.take(columns, axis=1)).take(rows, axis=0)
    cats = int((columns < n_cat).sum())
    width = BINS + 1
    offsets, size = np.arange(len(columns)) * width, len(columns) * width
    todo: list[tuple[int, np.ndarray, np.ndarray | None]] = [(0, np.arange(n), None)]
    few: list[tuple[int, np.ndarray]] = []
    waiting = 0
    while todo or few:
        if few and (not todo or waiting >= TOGETHER):
            _grow_by_level(tree, [k for k, _ in few], [at for _, at in few], x, y, z, unit, columns, cats, s, gains)
            few, waiting = [], 0
            continue
        k, at, h = todo.pop()
        if len(at) <= FEW:
            few.append((k, at))
            waiting += len(at)
            continue
        h = _histogram(x, z, at, offsets, size) if h is None else h
        gain, f, cut, bins = _best_exact(h, cats, s.least)
        if not gain * unit**2 > 1e-10:
            continue
        tree.feature[k], tree.cut[k] = int(columns[f]), cut
        v = x[at, f]
        if bins is None:
            go = v <= cut
        else:
            tree.bins[k] = bins
            go = np.isin(v, list(bins))
        a, b = at[go], at[~go]
        tree.left[k], tree.right[k] = (tree.add(float(y[c].mean()), len(c)) for c in (a, b))
        gains[columns[f]] += gain * unit**2
        small, large = sorted(((tree.left[k], a), (tree.right[k], b)), key=lambda t: len(t[1]))
        hs = _histogram(x, z, small[1], offsets, size) if len(large[1]) > FEW else None
        todo += [(*t, u) for t, u in ((large, None if hs is None else h - hs), (small, hs)) if len(t[1]) >= 2 * s.least]
    return tree


def _grow_by_level(tree: Tree, nodes: list[int], ats: list[np.ndarray], x: np.ndarray, y: np.ndarray, z: np.ndarray, unit: float, columns: np.ndarray, cats: int, s: Settings, gains: np.ndarray) -> None:
    """Grows leaves of ``tree`` on. All leaves of a level are searched at once, at a cost set by rows, not by leaves and bins.

    Every feature has the rows sorted by leaf and bin; a leaf takes the same stretch in each.
    """
    rows, p = np.concatenate(ats), x.shape[1]
    ids, sizes = np.array(nodes), np.array([len(at) for at in ats])
    y, z, xt = y[rows], z[rows], np.ascontiguousarray(x[rows].T)
    first = np.repeat(np.arange(len(ids), dtype=np.uint16 if len(ids) < 2**16 else int), sizes)
    order = np.argsort(xt, axis=1, kind="stable")
    order = np.take_along_axis(order, np.argsort(first[order], axis=1, kind="stable"), 1)
    bins = np.take_along_axis(xt, order, 1)
    while len(ids):
        m, every = int(sizes.sum()), np.arange(len(ids))
        at, starts, leaf = np.arange(m), np.cumsum(sizes) - sizes, np.repeat(every, sizes)
        ranks = []
        for f in range(cats):  # categories by their mean in each leaf
            width = int(xt[f].max()) + 1
            kind = leaf * width + xt[f, order[f]]
            count = np.bincount(kind, minlength=len(ids) * width)
            mean = np.where(count > 0, np.bincount(kind, z[order[f]], len(count)) / np.maximum(count, 1), np.inf).reshape(-1, width)
            ranks.append(np.argsort(np.argsort(mean, axis=1, kind="stable"), axis=1))
            rank = ranks[f].ravel()[kind]
            by = np.argsort(leaf * width + rank, kind="stable")
            order[f], bins[f] = order[f, by], rank[by]
        total = np.add.reduceat(z[order[0]], starts)
        left = at - starts[leaf] + 1
        may = np.flatnonzero((left >= s.least) & (sizes[leaf] - left >= s.least))
        of, left = leaf[may], left[may]
        size, less = sizes[of], np.minimum(left, sizes[of] - left)
        share = np.rint(total[of] * less / size)  # what so many rows have on the mean; the rest is that of the other side
        share = (np.cumsum(total) - total)[of] + np.where(left == less, share, total[of] - share)
        weight = size / (left * (size - left))
        gain = np.empty((p, len(may)))
        lot = max(1, LOT // m)
        for k in range(0, p, lot):
            each, b = gain[k : k + lot], bins[k : k + lot]
            np.subtract(np.cumsum(z.take(order[k : k + lot]), axis=1).take(may, axis=1), share, out=each)
            each *= each
            each *= weight
            np.putmask(each, b.take(may, axis=1) == b.take(may + 1, axis=1), -1.0)
        top = np.maximum.reduceat(gain, np.searchsorted(of, every), axis=1)
        f = top.argmax(0)
        best = top[f, every]
        more = best * unit**2
        hit = np.flatnonzero(gain[f[of], np.arange(len(may))] == best[of])
        last = may[hit[np.searchsorted(of[hit], every)]]  # of the rows on the left
        cut, lefts = bins[f, last], last - starts + 1
        rights, split = sizes - lefts, more > 1e-10
        row, goes = order[f[leaf], at], at <= last[leaf]
        parts = [np.bincount(leaf, np.where(side, y[row], 0.0), len(ids)) for side in (goes, ~goes)]
        children = np.zeros((2, len(ids)), int)
        for k in np.flatnonzero(split).tolist():
            i, fk, c = int(ids[k]), int(f[k]), int(cut[k])
            tree.feature[i], tree.cut[i] = int(columns[fk]), c
            if fk < cats:
                tree.bins[i] = frozenset(np.flatnonzero(ranks[fk][k] <= c).tolist())
            children[0, k] = tree.left[i] = tree.add(float(parts[0][k] / lefts[k]), int(lefts[k]))
            children[1, k] = tree.right[i] = tree.add(float(parts[1][k] / rights[k]), int(rights[k]))
            gains[columns[fk]] += more[k]
        go = np.zeros(len(y), np.int8)  # 1: to a left child that is searched next, 2: to such a right child
        on = [split & (c >= 2 * s.least) for c in (lefts, rights)]
        go[row[goes & on[0][leaf]]] = 1
        go[row[~goes & on[1][leaf]]] = 2
        nl, nr = int(lefts[on[0]].sum()), int(rights[on[1]].sum())
        kept = np.empty((p, nl + nr), order.dtype), np.empty((p, nl + nr), bins.dtype)
        for k in range(0, p, lot):
            o = order[k : k + lot]
            side = go.take(o).ravel()
            for w, stretch in ((1, slice(nl)), (2, slice(nl, None))):
                this = np.flatnonzero(side == w)
                for new, was in zip(kept, (o, bins[k : k + lot])):
                    new[k : k + lot, stretch] = was.ravel().take(this).reshape(len(o), -1)
        order, bins = kept
        ids = np.concatenate([c[o] for c, o in zip(children, on)])
        sizes = np.concatenate((lefts[on[0]], rights[on[1]]))


def start_and_weight(y: np.ndarray, s: Settings) -> tuple[float, float]:
    """What an ensemble says without trees, and the weight of each tree."""
    return (0.0, 1 / s.trees) if s.forest else (float(y.mean()), s.step)


def grown(x: np.ndarray, y: np.ndarray, n_cat: int, s: Settings, gains: np.ndarray, seed: int = 0) -> Iterator[Tree]:
    """The trees of an ensemble, one after the other."""
    rng, (n, p) = np.random.default_rng(seed), x.shape
    pick = lambda: np.sort(rng.choice(p, max(1, round(p * s.columns)), replace=False)) if s.columns < 1 else np.arange(p)
    if s.forest:
        for _ in range(s.trees):
            yield grow(x, y, np.sort(rng.integers(0, n, n)), pick(), n_cat, s, gains)
        return
    rest = y - float(y.mean())
    for _ in range(s.trees):
        rows = np.sort(rng.choice(n, max(1, int(n * s.rows)), replace=False)) if s.rows < 1 else np.arange(n)
        fitted = np.full(n, np.nan)
        t = grow(x, rest, rows, pick(), n_cat, s, gains, fitted)
        yield t
        others = np.flatnonzero(np.isnan(fitted))
        fitted[others] = t.predict(x[others])
        rest = rest - s.step * fitted


class Ensemble:
    """A fitted sum (boosted) or mean (forest) of trees over encoded features."""

    def __init__(self, encoder: Encoder, start: float, trees: list[Tree], weight: float, gains: np.ndarray):
        self.encoder, self.start, self.trees, self.weight, self.gains = encoder, start, trees, weight, gains

    @classmethod
    def fit(cls, pdf: pd.DataFrame, label: str, numeric: list[str], categorical: list[str], s: Settings, valid: pd.DataFrame | None = None, seed: int = 0) -> Ensemble:
        encoder = Encoder(pdf, numeric, categorical)
        x, y = encoder.bins(pdf), pdf[label].to_numpy(float)
        gains = np.zeros(x.shape[1])
        start, weight = start_and_weight(y, s)
        trees, stops = [], valid is not None and len(valid) and s.patience and not s.forest
        if stops:
            xv, ev, best, at = encoder.bins(valid), valid[label].to_numpy(float) - start, np.inf, 0
        for k, t in enumerate(grown(x, y, len(categorical), s, gains, seed)):
            trees.append(t)
            if stops:
                ev = ev - s.step * t.predict(xv)
                loss = float((ev**2).mean())
                if loss < best:
                    best, at = loss, k
                elif k - at >= s.patience:
                    trees = trees[: at + 1]
                    break
        return cls(encoder, start, trees, weight, gains)

    def predict(self, pdf: pd.DataFrame) -> np.ndarray:
        x = self.encoder.bins(pdf)
        return self.start + self.weight * sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    def importance(self) -> list[tuple[str, float]]:
        """Gain in per cent, largest first."""
        total = self.gains.sum() or 1.0
        return sorted(((n, float(100 * v / total)) for n, v in zip(self.encoder.names, self.gains)), key=lambda t: (-t[1], t[0]))


class Packed:
    """A fitted ensemble as bytes, to be shipped."""

    def __init__(self, model: Ensemble):
        self.names, self.data = model.encoder.names, zlib.compress(pickle.dumps(model), 1)

    def unpacked(self) -> Ensemble:
        return pickle.loads(zlib.decompress(self.data))


def sample(df: DataFrame, label: str, columns: list[str], most: int = FIT_ROWS, order: Column | None = None) -> pd.DataFrame:
    """At most ``most`` labelled rows for a fit: all, or those with the least hash of their columns; in a fixed order."""
    rows = df.filter(F.col(label).isNotNull()).select(label, *columns)
    if rows.count() > most:
        rows = rows.orderBy(F.xxhash64(*columns, label), *columns).limit(most)
    pdf = rows.toPandas()
    hashes = [pd.util.hash_pandas_object(pdf[k : k + 5000].astype(str), index=False).to_numpy() for k in range(0, max(len(pdf), 1), 5000)]  # as text in lots
    return pdf.iloc[np.argsort(np.concatenate(hashes), kind="stable")].reset_index(drop=True)


def predicted(df: DataFrame, models: dict[int, Ensemble | Packed], by: str | None = None, out: str = "guess") -> DataFrame:
    """``df`` with the prediction of the model whose number stands in ``by`` (the only model where that is not given); null where there is none."""
    models = {k: m if isinstance(m, Packed) else Packed(m) for k, m in models.items()}
    shipped = df.sparkSession.sparkContext.broadcast(models)
    columns = list(dict.fromkeys(c for m in models.values() for c in m.names))
    schema = df.withColumn(out, F.lit(None).cast("double")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = {k: m.unpacked() for k, m in shipped.value.items()}
        for pdf in batches:
            guess = np.full(len(pdf), np.nan)
            for k, m in known.items():
                at = np.flatnonzero(pdf[by].to_numpy() == k) if by else np.arange(len(pdf))
                if len(at):
                    guess[at] = m.predict(pdf[columns].iloc[at])
            yield pdf.assign(**{out: guess})

    return df.mapInPandas(run, schema).withColumn(out, F.nanvl(out, F.lit(None).cast("double")))


@dataclass(frozen=True)
class Case:
    """An ensemble that is validated: its features and sizes."""

    numeric: list[str]
    categorical: list[str]
    settings: Settings

    @property
    def names(self) -> list[str]:
        return [*self.categorical, *self.numeric]


def encoders_apart(rows: DataFrame, numeric: list[str], categorical: list[str], fold: str) -> dict[int, Encoder]:
    """For each fold the encoder of all rows outside it. The distinct values of a column pass one task; only edges and categories reach the driver."""
    folds = sorted(r[0] for r in rows.select(F.col(fold).cast("int")).distinct().collect())
    number = lambda i, c: F.struct(F.lit(i).alias("column"), F.col(c).cast("double").alias("v"), F.lit(None).cast("string").alias("t"))
    text = lambda i, c: F.struct(F.lit(i).alias("column"), F.lit(None).cast("double").alias("v"), F.col(c).cast("string").alias("t"))
    cells = [*(text(i, c) for i, c in enumerate(categorical)), *(number(i, c) for i, c in enumerate(numeric, len(categorical)))]
    finite = F.col("t").isNotNull() | (F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") != float("inf")))
    long = rows.select(F.col(fold).cast("int").alias("__fold"), F.explode(F.array(*cells)).alias("x")).select("__fold", "x.*").filter(finite)
    spans = long.groupBy("column", "v", "t").agg(F.min("__fold").alias("lo"), F.max("__fold").alias("hi"))
    kinds_of = len(categorical)

    def found(pdf: pd.DataFrame) -> pd.DataFrame:
        c, out = int(pdf["column"].iloc[0]), []
        pdf = pdf.sort_values("v") if c >= kinds_of else pdf
        for k in folds:
            some = pdf[(pdf["lo"] != k) | (pdf["hi"] != k)]  # what stands in another fold too
            out.append((c, k, [], Encoder.first(some["t"])) if c < kinds_of else (c, k, Encoder.cuts(some["v"].to_numpy(float)), []))
        return pd.DataFrame(out, columns=["column", "fold", "edges", "kinds"])

    got = {(r["column"], r["fold"]): r for r in spans.groupBy("column").applyInPandas(found, "column int, fold int, edges array<double>, kinds array<string>").collect()}
    edges = lambda i, k: np.array(got[i, k]["edges"] if (i, k) in got else [], float)
    kinds = lambda i, k: got[i, k]["kinds"] if (i, k) in got else []
    return {k: Encoder.known(numeric, categorical, [edges(i, k) for i in range(kinds_of, kinds_of + len(numeric))], [kinds(i, k) for i in range(kinds_of)]) for k in folds}


def predicted_apart(df: DataFrame, label: str, cases: dict[str, Case], fold: str) -> DataFrame:
    """``df`` with a column for each case: the prediction of the model fitted on all labelled rows outside the row's fold; null where there are fewer than two folds.

    Every case and fold has a task of its own, and all of them run side by side. It holds the rows as bins, a byte each, and
    asks each tree about the rows of its fold as soon as it is grown; so neither rows nor models pass the driver. ``df`` is
    written once, with a number for each row.
    """
    numeric, categorical = (list(dict.fromkeys(c for case in cases.values() for c in getattr(case, kind))) for kind in ("numeric", "categorical"))
    rows = reliable_checkpoint(df.withColumn("__row", F.monotonically_increasing_id()))
    used = rows.filter(F.col(fold).isNotNull())
    used = used.select("__row", F.col(label).cast("double").alias("__label"), *[F.col(c).cast("double") for c in numeric], *categorical, F.col(fold).cast("int").alias("__fold"))
    encoders = encoders_apart(used.filter(F.col("__label").isNotNull()), numeric, categorical, "__fold")
    if len(encoders) < 2:
        return rows.withColumns({name: F.lit(None).cast("double") for name in cases}).drop("__row")
    targets = sorted(((name, k) for name in cases for k in encoders), key=lambda t: not cases[t[0]].settings.forest)  # forests take longest
    names, most = [*categorical, *numeric], rows.count()
    places = {name: np.array([names.index(c) for c in case.names]) for name, case in cases.items()}
    shipped = df.sparkSession.sparkContext.broadcast(encoders)
    binned = pa.schema([("__to", pa.int32()), ("__order", pa.int64()), ("__row", pa.int64()), ("__label", pa.float64()), ("bins", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pdf = b.to_pandas()
            if not len(pdf):
                continue
            hashes = pd.util.hash_pandas_object(pdf[["__label", *numeric, *categorical, "__fold"]].astype(str), index=False).to_numpy()
            order, own, label_of = (hashes ^ np.uint64(1 << 63)).view(np.int64), pdf["__fold"].to_numpy(), pdf["__label"].to_numpy(float)
            for k, encoder in shipped.value.items():
                at = np.flatnonzero((own == k) | ~np.isnan(label_of))
                x, asked = encoder.bins(pdf.iloc[at]), own[at] == k
                for to, (name, fold_of) in enumerate(targets):
                    if fold_of == k and len(at):
                        some = np.ascontiguousarray(x[:, places[name]])
                        ends = np.arange(len(at) + 1, dtype=np.int32) * some.shape[1]
                        bins = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(some)])
                        yield pa.record_batch([pa.array(np.full(len(at), to, np.int32)), pa.array(order[at]), pa.array(pdf["__row"].to_numpy()[at], mask=~asked), pa.array(label_of[at]), bins], schema=binned)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, to = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            if to is None:
                to = b.column("__to")[0].as_py()
                case = cases[targets[to][0]]
                x, y, row = np.empty((most, len(case.names)), np.uint8), np.empty(most), np.empty(most, np.int64)
            end, bins = n + b.num_rows, b.column("bins").cast(pa.large_binary())
            ends = np.frombuffer(bins.buffers()[1], np.int64)[bins.offset : bins.offset + len(bins) + 1]
            x[n:end] = np.frombuffer(bins.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(bins), -1)
            y[n:end] = b.column("__label").to_numpy(zero_copy_only=False)
            row[n:end] = b.column("__row").fill_null(-1).to_numpy(zero_copy_only=False)
            n = end
        if to is None:
            return
        asked = row[:n] >= 0
        xt, row, y = x[:n][asked], row[:n][asked], y[:n][~asked]
        x = x[:n][~asked]
        start, weight = start_and_weight(y, case.settings)
        total = np.zeros(len(xt))
        for t in grown(x, y, len(case.categorical), case.settings, np.zeros(x.shape[1])):
            total += t.predict(xt)
        yield pa.record_batch({"__row": pa.array(row), "case": pa.array([targets[to][0]] * len(row), pa.string()), "guess": pa.array(start + weight * total)})

    sent = used.mapInArrow(encode, "__to int, __order bigint, __row bigint, __label double, bins binary").repartitionById(len(targets), F.col("__to"))
    guesses = reliable_checkpoint(sent.sortWithinPartitions("__order").drop("__order").mapInArrow(fit, "__row bigint, case string, guess double"))
    wide = guesses.groupBy("__row").agg(*[F.max(F.when(F.col("case") == name, F.col("guess"))).alias(name) for name in cases])
    return rows.join(wide, "__row", "left").drop("__row")
