"""Models over the station tables: spatially blocked validation, attribution, regimes.

Trees are those of ``boosting``: validated models are fitted on all rows outside a fold, others on a bounded sample; all are
validated, attributed and applied over all rows.
Regimes are pyspark.ml k-means; only cluster centres reach the driver, and a bounded sample for the silhouette.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.functions.scalars import block_id
from freshet.operators.boosting import Case, Ensemble, Settings, predicted_apart
from freshet.operators.stations import group_folds
from freshet.session import join_dictionary, reliable_checkpoint

#: Rows of a table that the silhouette compares with each other at most.
SILHOUETTE_ROWS = 3000


def feature_columns(df: DataFrame, meta: set[str]) -> list[str]:
    """All numeric columns that are not meta data, in table order."""
    return [f.name for f in df.schema if f.name not in meta and f.dataType.typeName() in ("double", "float", "integer", "long")]


def spatial_folds(df: DataFrame, folds: int = 5, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """``df`` with ``block`` and ``fold``: folds are made of whole 2-degree blocks; rows without a position are left out."""
    rows = df.withColumn("block", block_id(lat, lon)).filter(F.col("block").isNotNull() & F.col(lat).isNotNull() & F.col(lon).isNotNull())
    return join_dictionary(rows, group_folds(rows, "block", folds).select("block", "fold"), ["block"])


def spatial_cv(df: DataFrame, label: str, numeric: list[str], categorical: list[str], settings: Settings, folds: int = 5, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Out-of-fold predictions ``guess`` of all labelled rows with spatial folds, so no block is on both sides.

    Null where there are fewer than two folds.
    """
    return predicted_apart(labelled_folds(df, label, folds, lat, lon), label, {"guess": Case(numeric, categorical, settings)}, "fold")


def labelled_folds(df: DataFrame, label: str, folds: int = 5, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """The labelled rows of ``df`` with their spatial ``fold``."""
    return spatial_folds(df.filter(F.col(label).isNotNull()), folds, lat, lon)


# ---- TreeSHAP ------------------------------------------------------------------------------------------------------


def tree_shap(nodes: list[tuple], x: np.ndarray) -> np.ndarray:
    """Shapley values of one tree for one row, path-dependent: a subset takes the mean of both branches by cover elsewhere."""
    return tree_shap_rows(nodes, np.asarray(x, dtype=float)[None, :])[0]


@lru_cache(maxsize=64)
def _nodes(degree: int) -> tuple[np.ndarray, np.ndarray]:
    """Points and weights on [0, 1] that integrate polynomials of this degree exactly."""
    t, w = np.polynomial.legendre.leggauss(degree // 2 + 1)
    return (t + 1) / 2, w / 2


def tree_shap_rows(nodes: list[tuple], x: np.ndarray) -> np.ndarray:
    """The same for many rows (rows by features) at once.

    Each leaf is a product game over the features on its path: a feature that is known lets the row through or not, one
    that is not lets a share of the cover through. Its Shapley values are integrals over t in [0, 1] of the products
    of ``share * (1 - t) + through * t`` over the other features: polynomials, integrated exactly at a few points.
    """
    phi = np.zeros(x.shape)

    def leaf(path: dict[int, tuple[float, np.ndarray]], value: float) -> None:
        if not path:
            return
        t, w = _nodes(len(path) - 1)
        share = np.array([z for z, _ in path.values()])
        through = np.stack([o for _, o in path.values()])
        each = share[:, None, None] * (1 - t)[None, :, None] + through[:, None, :] * t[None, :, None]
        others = each.prod(0)[None] / each  # no factor is 0: shares of cover are positive, the points lie inside
        phi[:, list(path)] += (value * (through - share[:, None]) * np.einsum("q,kqn->kn", w, others)).T

    def go(k: int, path: dict[int, tuple[float, np.ndarray]]) -> None:
        f, t, left, right, value, cover = nodes[k]
        if f < 0:
            leaf(path, value)
            return
        is_left = np.isin(x[:, f], list(t)) if isinstance(t, frozenset) else x[:, f] <= t
        for child, goes in ((left, is_left), (right, ~is_left)):
            z, o = path.get(f, (1.0, np.ones(len(x))))
            go(child, {**path, f: (z * nodes[child][5] / cover, o * goes)})

    go(0, {})
    return phi


def mean_abs_shap(model: Ensemble, df: DataFrame) -> DataFrame:
    """``feature, mean_abs_shap`` over all rows."""
    trees = [t.nodes() for t in model.trees]
    shipped = df.sparkSession.sparkContext.broadcast((model.encoder, trees, model.weight))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, known, weight = shipped.value
        for pdf in batches:
            if len(pdf):
                x = encoder.bins(pdf).astype(float)
                phi = sum((tree_shap_rows(n, x) for n in known), np.zeros(x.shape)) * weight
                yield pd.DataFrame({"feature": encoder.names, "total": np.abs(phi).sum(0), "n": len(x)})

    rows = df.select(*model.encoder.names).repartition(df.sparkSession.sparkContext.defaultParallelism)
    sums = rows.mapInPandas(run, "feature string, total double, n bigint")
    return sums.groupBy("feature").agg((F.sum("total") / F.sum("n")).alias("mean_abs_shap"))


# ---- Regimes -------------------------------------------------------------------------------------------------------

# Weights of the z-scored cluster centres in each archetype, in the order of assignment.
ARCHETYPES = {
    "Road-salt urban (rising Cl)": {"log_cl": 1, "night_lights_5km": 1, "slope_cl": 1},
    "Sulfate-declining": {"log_so4": 1, "slope_so4": -1},
    "Dilute forested": {"lc_tree_5km": 1, "log_cl": -1},
    "Arid evaporative": {"aridity": -1, "na_cl": 1},
    "Carbonate weathering": {"ca_mg": 1, "log_ca": 1},
}




def impute_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing numbers replaced by the exact column median."""
    medians = df.agg(*[F.median(c).alias(c) for c in columns]).first()
    return df.fillna({c: float(medians[c]) for c in columns if medians[c] is not None})


def standardized(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df``, missing numbers filled, with the vector ``x`` of the standardised columns; written once, since every fit reads it.

    A column without any number is filled with 0. Without rows there is nothing to scale, and ``x`` is what was assembled.
    """
    x = VectorAssembler(inputCols=columns, outputCol="__raw").transform(impute_medians(df, columns).fillna(0.0, columns))
    if x.isEmpty():
        return x.withColumnRenamed("__raw", "x")
    return reliable_checkpoint(StandardScaler(inputCol="__raw", outputCol="x", withMean=True).fit(x).transform(x).drop("__raw"))


def best_clusters(x: DataFrame, k: int, starts: int) -> KMeansModel | None:
    """The k-means model of least cost over several starts, which run side by side; none where there are fewer rows than clusters."""
    if x.limit(k).count() < k:
        return None
    one = inheritable_thread_target(x.sparkSession)(lambda seed: KMeans(featuresCol="x", predictionCol="cluster", k=k, seed=seed).fit(x))
    with ThreadPool(min(starts, 8)) as pool:
        return min(pool.map(one, range(starts)), key=lambda m: m.summary.trainingCost)


def silhouette(clustered: DataFrame, key: str, most: int = SILHOUETTE_ROWS) -> float:
    """Mean Euclidean silhouette over at most ``most`` rows (those of the least hash of their key), each compared with all others of them."""
    pdf = clustered.orderBy(F.xxhash64(key), key).limit(most).select(vector_to_array("x").alias("x"), "cluster").toPandas()
    if pdf["cluster"].nunique() < 2:
        return float("nan")
    x, c = np.array(pdf["x"].tolist()), pdf["cluster"].to_numpy()
    kinds, own = np.unique(c, return_inverse=True)
    sums = np.empty((len(x), len(kinds)))
    square = (x**2).sum(1)
    for at in range(0, len(x), 500):
        far = np.sqrt(np.maximum(square[at : at + 500, None] + square - 2 * x[at : at + 500] @ x.T, 0))
        sums[at : at + 500] = np.stack([far[:, own == k].sum(1) for k in range(len(kinds))], 1)
    n = np.bincount(own)
    rows = np.arange(len(x))
    inner = sums[rows, own] / np.maximum(n[own] - 1, 1)
    mean = sums / n
    mean[rows, own] = np.inf
    outer = mean.min(1)
    return float(np.where(n[own] > 1, (outer - inner) / np.maximum(np.maximum(inner, outer), 1e-300), 0.0).mean())


def name_regimes(centres: pd.DataFrame, columns: list[str]) -> dict[int, str]:
    """A name for each cluster (index of ``centres``), from a long list of (archetype, cluster, score).

    The list is sorted by archetype, in their order, then by score, then by cluster number; going down it, a line counts when
    neither its archetype nor its cluster is taken. A cluster left over is named after its Na:Cl ratio.
    """
    spread = centres[columns].sub(centres[columns].mean()).div(centres[columns].std() + 1e-9).rename_axis("cluster")
    lines = []
    for order, (label, weights) in enumerate(ARCHETYPES.items()):
        known = {f: w for f, w in weights.items() if f in spread}
        score = spread[list(known)].mul(pd.Series(known)).sum(axis=1)
        lines += [(order, -s, c, label) for c, s in score.items()]
    named: dict[int, str] = {}
    for _, _, cluster, label in sorted(lines):
        if cluster not in named and label not in named.values():
            named[cluster] = label
    ratio = centres["na_cl"] if "na_cl" in centres else pd.Series(np.nan, centres.index)
    # Fixed value: the form of the name of a cluster left over.
    return {c: named.get(c, f"Mixed ({ratio[c]:.2f} Na:Cl)") for c in centres.index}
