"""Queries of the learners: level and trend models, attribution, baseline, climate response, regimes.

Scores have no SQL; each learner has beside it a query of its exact part (rows, folds, bases) that has one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.functions import scalars as S
from freshet.operators import boosting, harmonize, models, series, stations
from freshet.plans.measurement import _FOLDS, _NN, _PLACES, _TREND, WITH, R, obs, places, registry, trends
from freshet.session import reliable_checkpoint
from freshet.sources.tables import nan_to_null, table

QUERIES, SQL, query = registry()

_META = {"station_id", "ion", "n_year_obs", "base_year", "median_mgL", "slope_mgL_yr", "slope_log_yr", "slope_log_lo", "slope_log_hi", "mk_s", "mk_p", "base_level", "log_level", "block", "fold", "value_2050", "value_2050_lo", "value_2050_hi", "pct_change_2050"}


def level_table(spark, d) -> tuple[DataFrame, list[str]]:
    """Trends with the covariates and the position of their station, and the names of the numeric features; written once."""
    cov = nan_to_null(table(spark, d, "station_covariates")).withColumn("station_id", F.col("station_id").cast("string"))
    p = places(spark, d).select(F.col("id").alias("pid"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))
    t = trends(spark, d).withColumn("station_id", F.col("station_id").cast("string")).join(cov, "station_id").join(p, F.col("station_id") == F.col("pid")).drop("pid")
    t = reliable_checkpoint(t.withColumn("log_level", F.log1p("base_level")))
    return t, models.feature_columns(t, _META)


def _scores(out: DataFrame, label: str) -> DataFrame:
    overall = series.error_measures(out.withColumn("ion", F.lit("all")), label, "guess", ["ion"])
    return series.error_measures(out, label, "guess", ["ion"]).unionByName(overall)


@query()
def gbt_level_cv(spark, d):
    """Out-of-fold error of boosted trees for the log level with spatial blocks, by ion and overall."""
    df, names = level_table(spark, d)
    return _scores(models.spatial_cv(df, "log_level", names, ["ion"], boosting.LEVEL), "log_level")


@query()
def trend_cv(spark, d):
    """The same for the trend: the yearly slope on the log scale."""
    df, names = level_table(spark, d)
    return _scores(models.spatial_cv(df, "slope_log_yr", names, ["ion"], boosting.LEVEL), "slope_log_yr").drop("median_abs_native")


@query(f"""WITH RECURSIVE {WITH[5:]}, {_TREND}, {_PLACES.replace("n AS (SELECT station_id, latitude", "cnt AS (SELECT station_id, latitude").replace("FROM n QUALIFY", "FROM cnt QUALIFY")},
lv AS (SELECT t.station_id, t.ion, t.base_level, concat_ws('_', floor(lat / 2)::BIGINT::VARCHAR, floor(lon / 2)::BIGINT::VARCHAR) AS block FROM tr t JOIN station_covariates c ON t.station_id = c.station_id JOIN places ON t.station_id = id),
blocks AS (SELECT block FROM lv), {_FOLDS}
SELECT fold, ion, count(*) AS n, count(DISTINCT l.block) AS n_blocks, round(avg(ln(1 + base_level)), 6) AS mean_log_level FROM lv l JOIN fill f ON l.block = f.block GROUP BY fold, ion""")
def level_folds(spark, d):
    """Exact part of the validated models: rows, blocks and mean label by fold and ion."""
    df, _ = level_table(spark, d)
    rows = models.spatial_folds(df)
    return rows.groupBy("fold", "ion").agg(F.count("*").alias("n"), F.countDistinct("block").alias("n_blocks"), R(F.avg("log_level")).alias("mean_log_level"))


@query()
def forest_robustness(spark, d):
    """Out-of-fold R2 of boosted trees with all covariates, of a random forest, and of boosted trees with either buffer only."""
    df, names = level_table(spark, d)
    cases = (("boosted_both", "", boosting.ROBUST), ("forest_both", "", boosting.FOREST), ("boosted_500m_only", "_5km", boosting.ROBUST), ("boosted_5km_only", "_500m", boosting.ROBUST))
    chosen = {label: boosting.Case([c for c in names if not (without and c.endswith(without))], ["ion"], settings) for label, without, settings in cases}
    out = boosting.predicted_apart(models.labelled_folds(df, "log_level"), "log_level", chosen, "fold")
    return harmonize.union_sources(*[series.error_measures(out, "log_level", label).withColumn("model", F.lit(label)) for label in chosen])


# Labels of the drivers.
LABELS = {
    "ion": "Ion identity", "lc_tree_5km": "Forest cover (5 km)", "precip_mm": "Precipitation", "longitude": "Longitude", "lc_bare_5km": "Bare ground (5 km)",
    "pet_mm": "Potential evapotranspiration", "night_lights_5km": "Night-time lights (5 km)", "elevation": "Elevation", "temp_trend_c_yr": "Warming rate", "soil_ph": "Soil pH",
    "latitude": "Latitude", "lc_crop_5km": "Cropland (5 km)", "lc_water_500m": "Open water (500 m)", "pr_tc_mm": "Precipitation (TerraClimate)", "soil_clay": "Soil clay",
    "pop_density_5km": "Population density (5 km)", "lc_grass_5km": "Grassland (5 km)", "temp_c": "Air temperature", "soil_soc": "Soil organic carbon", "aridity": "Aridity index",
}


@query()
def level_drivers(spark, d):
    """The fifteen features of the level model with the largest mean absolute Shapley attribution over all rows, with gain importance and label."""
    df, names = level_table(spark, d)
    model = boosting.Ensemble.fit(boosting.sample(df, "log_level", [*names, "ion"]), "log_level", names, ["ion"], boosting.LEVEL)
    gain = spark.createDataFrame([(n, g, LABELS.get(n, n)) for n, g in model.importance()], "feature string, gain_pct double, label string")
    return models.mean_abs_shap(model, df).join(gain, "feature").orderBy(F.desc("mean_abs_shap"), "feature").limit(15)


_STATIC = ["latitude", "longitude", "source", "country", "state_prov", "site_type"]
_FIRSTS = ", ".join(f"arg_min({c}, (ts, rec_id)) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in _STATIC)


def annual_static(spark, d) -> DataFrame:
    """Annual rows with the first known attributes of their station."""
    o = reliable_checkpoint(obs(spark, d))
    static = harmonize.first_non_null(o, "station_id", _STATIC, ["ts", "rec_id"])
    return series.annual_means(o).join(static, "station_id", "left")


@query(f"{WITH}, st AS (SELECT station_id, {_FIRSTS} FROM obs GROUP BY station_id) SELECT station_id, ion, year, round(value, 6) AS value, n_obs_year, {', '.join(_STATIC)} FROM ann LEFT JOIN st USING (station_id)")
def annual_with_static(spark, d):
    """Annual rows with the static attributes of their station."""
    return annual_static(spark, d).select("station_id", "ion", "year", R("value").alias("value"), "n_obs_year", *_STATIC)


def _baseline_rows(spark, d) -> DataFrame:
    return series.temporal_split(series.features(annual_static(spark, d)))


@query(f"""{WITH}, f AS (SELECT *, ln(1 + value) AS lv, lag(ln(1 + value)) OVER (PARTITION BY station_id, ion ORDER BY year) AS lag1 FROM ann)
SELECT CASE WHEN year <= 2013 THEN 'train' WHEN year <= 2017 THEN 'valid' ELSE 'test' END AS split, count(*) AS n, round(sqrt(avg(pow(lv - lag1, 2))), 6) AS persistence_rmse, round(avg(year - 2000), 6) AS mean_year_c FROM f WHERE lag1 IS NOT NULL GROUP BY split""")
def baseline_rows(spark, d):
    """Exact part of the baseline: rows and error of persistence by split."""
    e = F.col("log_value") - F.col("lag1")
    return _baseline_rows(spark, d).groupBy("split").agg(F.count("*").alias("n"), R(F.sqrt(F.avg(e * e))).alias("persistence_rmse"), R(F.avg("year_c")).alias("mean_year_c"))


@query()
def baseline_temporal(spark, d):
    """Boosted trees on all annual features, fitted up to 2013 and stopped on 2014 to 2017, against persistence, by split and ion."""
    x = reliable_checkpoint(_baseline_rows(spark, d))
    numbers, kinds = ["lag1", "lag2", "lag3", "roll3", "roll5", "trail_slope", "years_seen", "year_c", "n_obs_year", "latitude", "longitude"], ["ion", "source", "country", "state_prov", "site_type"]
    parts = {s: boosting.sample(x.filter(F.col("split") == s), "log_value", [*numbers, *kinds]) for s in ("train", "valid")}
    model = boosting.Ensemble.fit(parts["train"], "log_value", numbers, kinds, boosting.BASELINE, parts["valid"])
    out = boosting.predicted(x, {0: model})
    scores = [_by_split(out, guess).withColumn("model", F.lit(name)) for name, guess in (("trees", "guess"), ("persistence", "lag1"))]
    return scores[0].unionByName(scores[1])


def _by_split(out: DataFrame, guess: str) -> DataFrame:
    whole = series.error_measures(out.withColumn("ion", F.lit("all")), "log_value", guess, ["split", "ion"])
    return series.error_measures(out, "log_value", guess, ["split", "ion"]).unionByName(whole)


# ---- climate -------------------------------------------------------------------------------------------------------

SCENARIOS = ("ssp245", "ssp585")


def scenario_projection(spark, d) -> DataFrame:
    """Series of stations with covariates and deltas: the projected value, and per scenario the climate factor and the value times it; written once.

    The factor is the level model's answer for the shifted climate over its answer for the present one.
    """
    deltas = nan_to_null(table(spark, d, "cmip6_deltas"))
    cov = nan_to_null(table(spark, d, "station_covariates"))
    names = [c for c in cov.columns if c != "station_id"]
    t = stations.trend_projection(trends(spark, d)).withColumn("log_level", F.log1p("base_level")).select("station_id", "ion", "base_level", "log_level", "value_2050")
    t = t.join(deltas.select("station_id"), "station_id", "left_semi")
    p = places(spark, d).select(F.col("id").alias("station_id"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))
    base = reliable_checkpoint(t.join(cov, "station_id").join(p, "station_id", "left"))
    numbers = [*names, "latitude", "longitude"]
    model = boosting.Ensemble.fit(boosting.sample(base, "log_level", [*numbers, "ion"]), "log_level", numbers, ["ion"], boosting.LEVEL)
    out = boosting.predicted(base, {0: model}, out="now").select("station_id", "ion", "base_level", "value_2050", "latitude", "longitude", "now")
    for s in SCENARIOS:
        then = boosting.predicted(stations.climate_shift(base, deltas, s), {0: model}, out="then").select("station_id", "ion", "then")
        factor = F.exp(F.col("then") - F.col("now"))
        out = out.join(then, ["station_id", "ion"]).withColumns({f"factor_{s}": factor, f"value_2050_{s}": F.col("value_2050") * factor}).drop("then")
    return reliable_checkpoint(out.drop("now"))


@query()
def climate_response(spark, d):
    """Median climate factor by scenario and ion, and overall."""
    p = scenario_projection(spark, d)
    long = p.select("ion", F.explode(F.array(*[F.struct(F.lit(s).alias("scenario"), F.col(f"factor_{s}").alias("factor")) for s in SCENARIOS])).alias("x")).select("ion", "x.*")
    return long.rollup("scenario", "ion").agg(F.median("factor").alias("median_factor"), F.count("*").alias("n")).filter("scenario is not null")


@query()
def scenario_exceedance(spark, d):
    """Share of chloride stations over the thresholds: recent, trend, and trend under both climate scenarios."""
    p = scenario_projection(spark, d).filter("ion = 'cl' and value_2050 is not null")
    return series.share_over(p, ["base_level", "value_2050", *[f"value_2050_{s}" for s in SCENARIOS]], stations.THRESHOLDS)


@query()
def scenario_change(spark, d):
    """Median change of chloride to 2050 in per cent: trend, and trend under both climate scenarios."""
    p = scenario_projection(spark, d).filter("ion = 'cl' and value_2050 is not null")
    cells = [F.struct(F.lit(n).alias("series"), ((S.safe_ratio(c, "base_level") - 1) * 100).alias("change")) for n, c in (("trend", "value_2050"), *[(s, f"value_2050_{s}") for s in SCENARIOS])]
    return p.select(F.explode(F.array(*cells)).alias("x")).select("x.*").groupBy("series").agg(F.median("change").alias("median_pct_change"), F.count("change").alias("n"))


# ---- regimes -------------------------------------------------------------------------------------------------------


def typology(spark, d) -> tuple[DataFrame, list[str]]:
    t = reliable_checkpoint(trends(spark, d))
    f = stations.typology_features(stations.ion_wide(t, "base_level"), stations.ion_wide(t, "slope_log_yr", "slope_"), nan_to_null(table(spark, d, "station_covariates")))
    return f, [c for c in f.columns if c != "station_id"]


_FIVE = ("cl", "na", "ca", "mg", "so4")
_CLIP = lambda a, b, most: f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN {b} = 0 AND {a} > 0 THEN {most} WHEN {b} = 0 THEN NULL ELSE least(greatest({a} / {b}, 0.0), {most}) END"


@query(f"""{WITH}, {_TREND}, w AS (SELECT station_id, {', '.join(f"max(base_level) FILTER (WHERE ion = '{k}') AS {k}" for k in _FIVE)}, max(slope_log_yr) FILTER (WHERE ion = 'cl') AS slope_cl, max(slope_log_yr) FILTER (WHERE ion = 'so4') AS slope_so4 FROM tr GROUP BY station_id),
c AS (SELECT station_id, {_NN(stations.LANDSCAPE)} FROM station_covariates)
SELECT w.station_id, {', '.join(f'round(ln(1 + {k}), 6) AS log_{k}' for k in _FIVE)}, round({_CLIP('na', 'cl', '3.0')}, 6) AS na_cl, round({_CLIP('ca', 'mg', '8.0')}, 6) AS ca_mg, round(slope_cl, 6) AS slope_cl, round(slope_so4, 6) AS slope_so4, {', '.join(f'round({k}, 6) AS {k}' for k in stations.LANDSCAPE)}
FROM w LEFT JOIN c ON w.station_id = c.station_id WHERE {' + '.join(f'({k} IS NOT NULL)::INT' for k in _FIVE)} >= 4""")
def typology_table(spark, d):
    """Exact part of the regimes: the features of the stations that are clustered."""
    f, cols = typology(spark, d)
    return f.select("station_id", *[R(c).alias(c) for c in cols])


def _regimes(spark, d, k: int = 5, starts: int = 20):
    f, cols = typology(spark, d)
    x = models.standardized(f, cols)
    model = models.best_clusters(x, k, starts)
    return model.transform(x) if model else x.limit(0).withColumn("cluster", F.lit(0)), cols


@query()
def regimes(spark, d):
    """Stations in five named regimes from log levels, ratios, slopes and landscape: size and the median of every feature.

    Fewer than five stations make no regimes.
    """
    x, cols = _regimes(spark, d)
    medians = x.groupBy("cluster").agg(F.count("*").alias("n"), *[F.median(c).alias(c) for c in cols])
    centres = medians.toPandas().set_index("cluster").sort_index()  # five rows
    names = spark.createDataFrame(list(models.name_regimes(centres, cols).items()), "cluster int, regime string")
    level = F.round(F.expm1("log_cl"), 1).alias("cl_level")
    return medians.join(names, "cluster").select("regime", "n", level, *[R(c).alias(c) for c in cols])


@query()
def regime_scan(spark, d):
    """Euclidean silhouette for three to six clusters, ten starts each."""
    f, cols = typology(spark, d)
    x = models.standardized(f, cols)
    fits = {k: models.best_clusters(x, k, 10) for k in range(3, 7)}
    rows = [(k, models.silhouette(m.transform(x), "station_id")) for k, m in fits.items() if m]
    return spark.createDataFrame(rows, "k int, silhouette double")
