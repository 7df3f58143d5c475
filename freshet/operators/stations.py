"""Station-level analyses: seasons, ratios between ions, regimes' features, projections under scenarios, climate grids."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.functions.scalars import EARTH_KM, ION_KEYS, bounded_ratio, clip, haversine_km, project, project_policy, safe_ratio, season, shift_climate, yearly_precipitation
from freshet.operators.proximity import disc_trapezoids, locate, near_spots, spots_of
from freshet.operators.series import gather, middle, pair_slopes
from freshet.session import join_dictionary, reliable_checkpoint

THRESHOLDS = [120.0, 230.0, 860.0]


def seasonal_means(df: DataFrame, min_obs: int = 8, ts: str = "ts", value: str = "value") -> DataFrame:
    """Per station winter and summer mean and count and their ratio (summer floored at 0.1), from one conditional aggregate.

    Stations with fewer than ``min_obs`` readings in either season are left out.
    """
    s = season(ts)
    pick = lambda name: F.when(s == name, F.col(value))
    a = df.groupBy("station_id").agg(
        F.avg(pick("winter")).alias("winter_mean"), F.count(pick("winter")).alias("winter_n"), F.avg(pick("summer")).alias("summer_mean"), F.count(pick("summer")).alias("summer_n")
    )
    a = a.filter((F.col("winter_n") >= min_obs) & (F.col("summer_n") >= min_obs))
    return a.withColumn("ws_ratio", F.col("winter_mean") / clip("summer_mean", low=0.1))


def seasonal_slopes(df: DataFrame, min_years: int = 10, ts: str = "ts", value: str = "value") -> DataFrame:
    """Theil-Sen slope of log1p seasonal means per station: ``station_id, winter_slope, summer_slope``."""
    rows = df.withColumn("season", season(ts)).filter(F.col("season") != "other").withColumn("year", F.year(ts))
    means = rows.groupBy("station_id", "season", "year").agg(F.avg(value).alias("value"))
    g = gather(means, ["station_id", "season"]).filter(F.size("points") >= min_years)
    g = g.select("station_id", "season", pair_slopes(F.col("points"), F.log1p).alias("s")).select("station_id", "season", middle(F.col("s")).alias("slope"))
    return g.groupBy("station_id").pivot("season", ["winter", "summer"]).agg(F.first("slope")).withColumnsRenamed({"winter": "winter_slope", "summer": "summer_slope"})


def latitude_bands(df: DataFrame, lat: str, value: str, start: float = 25.0, stop: float = 61.0, width: float = 3.0) -> DataFrame:
    """``band, median_value, n`` by right-closed latitude bands; rows outside are left out, empty bands give null."""
    k = F.ceil((F.col(lat) - start) / width).cast("int")
    inside = df.filter((F.col(lat) > start) & (F.col(lat) <= stop)).groupBy(k.alias("band")).agg(F.median(value).alias("median_value"), F.count(value).alias("n"))
    every = df.sparkSession.range(1, int((stop - start) / width) + 1).select(F.col("id").cast("int").alias("band"))
    return every.join(inside, "band", "left").select("band", (start + (F.col("band") - 1) * width).alias("lat_above"), "median_value", F.coalesce("n", F.lit(0)).alias("n"))


def ion_wide(trends: DataFrame, value: str, prefix: str = "") -> DataFrame:
    """One row per station with a column per ion; keys are unique, so any single-value aggregate does."""
    w = trends.groupBy("station_id").pivot("ion", list(ION_KEYS)).agg(F.max(value))
    return w.withColumnsRenamed({k: prefix + k for k in ION_KEYS}) if prefix else w


def ion_ratios(wide: DataFrame) -> DataFrame:
    """Source fingerprints na_cl, ca_mg, cl_so4, cl_alk and the chloride level; null where the lower number is 0 or missing."""
    return wide.select("station_id", safe_ratio("na", "cl").alias("na_cl"), safe_ratio("ca", "mg").alias("ca_mg"), safe_ratio("cl", "so4").alias("cl_so4"), safe_ratio("cl", "alk").alias("cl_alk"), F.col("cl").alias("cl_level"))


# Landscape covariates that enter the regimes.
LANDSCAPE = ("lc_tree_5km", "night_lights_5km", "aridity", "soil_ph", "temp_c")


def typology_features(levels: DataFrame, slopes: DataFrame, covariates: DataFrame, least: int = 4) -> DataFrame:
    """Clustering features of stations with at least ``least`` of the five ions (alkalinity apart): log levels, clipped ratios, slopes of cl and so4, landscape."""
    five = [k for k in ION_KEYS if k != "alk"]
    have = sum((F.when(F.col(k).isNotNull(), 1).otherwise(0) for k in five), F.lit(0))
    core = levels.filter(have >= least)
    out = core.select("station_id", *[F.log1p(k).alias(f"log_{k}") for k in five], bounded_ratio("na", "cl", 0.0, 3.0).alias("na_cl"), bounded_ratio("ca", "mg", 0.0, 8.0).alias("ca_mg"))
    land = covariates.select("station_id", *[c for c in LANDSCAPE if c in covariates.columns])
    return out.join(slopes.select("station_id", "slope_cl", "slope_so4"), "station_id", "left").join(land, "station_id", "left")


def trend_projection(trends: DataFrame, target_year: int = 2050) -> DataFrame:
    """Value in the target year if the trend goes on, its bounds, and the change in per cent."""
    p = lambda s: project("base_level", s, "base_year", target_year)
    out = trends.withColumns({"value_2050": p("slope_log_yr"), "value_2050_lo": p("slope_log_lo"), "value_2050_hi": p("slope_log_hi")})
    return out.withColumn("pct_change_2050", (safe_ratio("value_2050", "base_level") - 1) * 100)


def management_scenarios(trends: DataFrame) -> DataFrame:
    """Trend, halved and stabilised growth after the policy start, for one ion's stations."""
    make = lambda f: project_policy("base_level", "slope_log_yr", "base_year", f)
    return trends.withColumns({"v_2050_trend": make(1.0), "v_2050_halved": make(0.5), "v_2050_stabilized": make(0.0)})


def climate_shift(cov: DataFrame, deltas: DataFrame, scenario: str) -> DataFrame:
    """Covariates with temperature, precipitation, PET and aridity shifted by a scenario's deltas; stations without deltas are left out."""
    d = deltas.select("station_id", F.col(f"dtemp_{scenario}").alias("__dt"), F.col(f"dprecip_{scenario}").alias("__dp"))
    j = cov.join(d, "station_id")
    new = shift_climate("temp_c", "pr_tc_mm", "pet_mm", "__dt", "__dp")
    return j.withColumns({"temp_c": new["temp_c"], "precip_mm": F.col("precip_mm") + F.col("__dp"), "pr_tc_mm": new["precip_mm"], "pet_mm": new["pet_mm"], "aridity": new["aridity"]}).drop("__dt", "__dp")


def climate_lattice(df: DataFrame, step: int, lat: tuple[int, int], lon: tuple[int, int]) -> DataFrame:
    """Regular lattice with running ids in order of latitude, then longitude: ``grid_id, latitude, longitude``."""
    spark = df.sparkSession
    n_lon = (lon[1] - lon[0]) // step + 1
    n = ((lat[1] - lat[0]) // step + 1) * n_lon
    k = F.col("id")
    return spark.range(n).select(
        F.format_string("g%04d", k).alias("grid_id"), (F.floor(k / n_lon) * step + lat[0]).cast("double").alias("latitude"), (k % n_lon * step + lon[0]).cast("double").alias("longitude")
    )


def grid_near_stations(grid: DataFrame, places: DataFrame, reach: float = 5.0) -> DataFrame:
    """Grid points whose least L1 distance in degrees to any station (``lat, lon``) is at most ``reach``.

    Stations are reduced to distinct positions and both sides meet in square cells of that size, so no pair of far
    points is ever formed.
    """
    cell = lambda c: F.floor(c / F.lit(reach))
    spots = places.select("lat", "lon").distinct().withColumns({"cy": cell(F.col("lat")), "cx": cell(F.col("lon"))})
    steps = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    g = grid.withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps)).withColumns({"cy": cell(F.col("latitude")) + F.col("dy"), "cx": cell(F.col("longitude")) + F.col("dx")})
    near = g.join(spots, ["cy", "cx"]).filter(F.abs(F.col("latitude") - F.col("lat")) + F.abs(F.col("longitude") - F.col("lon")) <= reach)
    return grid.join(near.select("grid_id").distinct(), "grid_id", "left_semi")


def grid_interpolate(places: DataFrame, grid: DataFrame, values: list[str], step: float = 3.0) -> DataFrame:
    """Grid values at stations (``id, lat, lon``): bilinear where all four corners hold a value, else that of the nearest grid point with one.

    Each place meets its four lattice cells by equi-join. The places that lack a corner, and they alone, look in growing
    rings of cells; a hit counts once nothing outside the ring can be nearer. Ties go to the lower latitude, then
    longitude. A place without a position gives nulls.
    """
    lat0, lon0, lat1, lon1, rows = grid.agg(F.min("latitude"), F.min("longitude"), F.max("latitude"), F.max("longitude"), F.count("*")).first()
    if not rows:
        return places.select("id", *[F.lit(None).cast("double").alias(v) for v in values])
    places = reliable_checkpoint(places.select("id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")))
    p = places.select("id", "lat", "lon", ((F.col("lat") - lat0) / step).alias("ty"), ((F.col("lon") - lon0) / step).alias("tx"))
    p = p.withColumns({"iy": F.floor("ty"), "ix": F.floor("tx")}).withColumns({"fy": F.col("ty") - F.col("iy"), "fx": F.col("tx") - F.col("ix")})
    near = lambda c, low: F.round((F.col(c) - low) / step).cast("bigint")
    g = reliable_checkpoint(grid.select(near("latitude", lat0).alias("gy"), near("longitude", lon0).alias("gx"), F.col("latitude").alias("glat"), F.col("longitude").alias("glon"), *values))
    side = lambda f, k: F.col(f) if k else 1 - F.col(f)
    corners = F.explode(F.array(*[F.struct((F.col("iy") + a).alias("gy"), (F.col("ix") + b).alias("gx"), (side("fy", a) * side("fx", b)).alias("w")) for a in (0, 1) for b in (0, 1)]))
    c = join_dictionary(p.select("id", corners.alias("c")).select("id", "c.*"), g, ["gy", "gx"], "left")
    out = reliable_checkpoint(c.groupBy("id").agg(*[F.when(F.count(v) == 4, F.sum(F.col(v) * F.col("w"))).alias(v) for v in values]))
    for v in values:
        found = _nearest(places.join(out.filter(F.col(v).isNull()).select("id"), "id", "left_semi"), g.filter(F.col(v).isNotNull()).select("gy", "gx", "glat", "glon", F.col(v).alias("v")), lat0, lon0, lat1, lon1, step)
        out = out.join(found.select("id", F.col("v").alias("__near")), "id", "left").withColumn(v, F.coalesce(v, "__near")).drop("__near")
    return places.select("id").join(out, "id", "left").select("id", *values)


def _nearest(places: DataFrame, cells: DataFrame, lat0: float, lon0: float, lat1: float, lon1: float, step: float) -> DataFrame:
    """``id, v`` of the nearest cell of a lattice for each place, by rings that double until no cell outside can be nearer."""
    rest = places.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    span = rest.agg(F.max(F.greatest(F.abs(F.col("lat") - lat0), F.abs(F.col("lat") - lat1), F.abs(F.col("lon") - lon0), F.abs(F.col("lon") - lon1)))).first()[0]
    if span is None:
        return rest.select("id", F.lit(None).cast("double").alias("v"))
    done: list[DataFrame] = []
    reach, last = 1, int(span / step) + 2
    while True:
        ring = F.sequence(F.lit(-reach), F.lit(reach))
        asked = rest.withColumn("dy", F.explode(ring)).withColumn("dx", F.explode(ring))
        asked = asked.select("id", "lat", "lon", (F.round((F.col("lat") - lat0) / step).cast("bigint") + F.col("dy")).alias("gy"), (F.round((F.col("lon") - lon0) / step).cast("bigint") + F.col("dx")).alias("gx"))
        met = join_dictionary(asked, cells, ["gy", "gx"]).withColumn("km", haversine_km("lat", "lon", "glat", "glon"))
        best = met.groupBy("id", "lat").agg(F.min_by(F.struct("v", "km"), F.struct("km", "glat", "glon")).alias("b")).select("id", "lat", "b.v", "b.km")
        # What lies outside the ring is off by this many degrees at least, in latitude or in longitude.
        off = F.radians(F.lit(min((reach + 0.5) * step, 90.0)))
        sure = F.least(off, F.asin(F.sin(off) * F.cos(F.radians("lat")))) * EARTH_KM
        best = reliable_checkpoint(best.filter(F.lit(reach >= last) | (F.col("km") <= sure)))
        done.append(best.select("id", "v"))
        rest = rest.join(best.select("id"), "id", "left_anti")
        if reach >= last or rest.isEmpty():
            return reduce(DataFrame.unionByName, done)
        reach = min(2 * reach, last)


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of all nodes of the edges (``a, b``): the least node of the connected component.

    Large stars and small stars alternate until the edges stay as they are; a chain of n nodes settles in about log n
    rounds, and the number of edges never grows, so a hub costs no more than its edges. Each round is written to the
    checkpoint folder; only a count and a sum of hashes reach the driver.
    """
    e = reliable_checkpoint(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    old = mark(e)
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b"))
        e = reliable_checkpoint(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        new = mark(e)
        if new == old:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        old = new


def proximity_clusters(places: DataFrame, threshold_km: float = 1.0) -> DataFrame:
    """``id, cluster_id``: connected components of places at most ``threshold_km`` apart; the label is the least id.

    The components are those of the positions; one join gives them to the places, so a crowd at one position costs one
    point. Places without a position form no cluster: null label.
    """
    member = reliable_checkpoint(spots_of(places))
    pairs = near_spots(member, threshold_km)
    roots = components(pairs.select(F.col("spot_a").alias("a"), F.col("spot_b").alias("b")))
    near = join_dictionary(member.select("id", "spot"), roots.select(F.col("node").alias("spot"), "root"), ["spot"], "left").select("id", F.coalesce("root", "spot").alias("root"))
    labels = near.groupBy("root").agg(F.min("id").alias("cluster_id"))
    labelled = join_dictionary(near, labels, ["root"]).select(F.col("id").alias("__id"), "cluster_id")
    ids = places.select("id")
    return ids.join(labelled, F.col("id") == F.col("__id"), "left").select("id", "cluster_id")


def group_folds(df: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """``group, n, fold``: groups by size descending (then name), each into the fold with the fewest rows so far.

    The rule is a chain: each choice rests on all before it. So the group sizes, not the rows, are sorted by all tasks and
    then pass through one task as a stream, of which only the loads of the folds are kept.
    """
    kind = df.schema[group].dataType.simpleString()

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        load = [0] * folds
        for pdf in batches:
            out = []
            for n in pdf["n"].tolist():
                k = min(range(folds), key=lambda i: (load[i], i))
                load[k] += n
                out.append(k)
            yield pdf.assign(fold=pd.Series(out, dtype="int32"))

    sizes = df.groupBy(group).agg(F.count("*").alias("n")).orderBy(F.desc("n"), group)
    return sizes.coalesce(1).mapInPandas(assign, f"`{group}` {kind}, n bigint, fold int")


def z_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """Scores across all rows (cluster centres), with the sample deviation."""
    s = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("spread", F.stddev_samp))]).first()
    return df.withColumns({f"z_{c}": (F.col(c) - F.lit(s[f"mean_{c}"])) / (F.lit(s[f"spread_{c}"]) + 1e-9) for c in columns})


def values_within(places: DataFrame, cells: DataFrame, values: list[str], radius_km: float) -> DataFrame:
    """Buffer means: per place (``id, lat, lon``) the mean of each value, and the count, of the cells (``cell_id, lat, lon``) at most ``radius_km`` away.

    Null values do not count; a place with no cell near has nulls and 0.
    """
    centres = places.select(F.col("id").alias("region_id"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    points = cells.select(F.col("cell_id").alias("point_id"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    hits = locate(points, disc_trapezoids(centres, radius_km)).select("region_id", "point_id")
    met = hits.join(cells.select(F.col("cell_id").alias("point_id"), *values), "point_id")
    means = met.groupBy(F.col("region_id").alias("__id")).agg(*[F.avg(v).alias(v) for v in values], F.count("*").alias("n_cells"))
    return places.select("id").join(means, F.col("id") == F.col("__id"), "left").select("id", *values, F.coalesce("n_cells", F.lit(0)).alias("n_cells"))


def climate_deltas(rows: DataFrame, base: str, scenarios: dict[str, tuple[int, int]], base_years: tuple[int, int], key: str = "cell") -> DataFrame:
    """``model, key, scenario, dtemp, dprecip`` from ``model, scenario, key, year, temp, precip_flux``: mean of the scenario's years less that of the base years.

    Precipitation flux (kg per square metre and second) becomes millimetres a year. A model without both periods gives no row.
    """
    flux = yearly_precipitation("precip_flux")
    of = lambda name, years: (F.col("scenario") == name) & F.col("year").between(*years)
    periods = [F.when(of(base, base_years), F.lit("__base"))] + [F.when(of(s, y), F.lit(s)) for s, y in scenarios.items()]
    means = rows.withColumn("__period", F.coalesce(*periods)).filter(F.col("__period").isNotNull()).groupBy("model", key, "__period").agg(F.avg("temp").alias("t"), F.avg(flux).alias("p"))
    wide = means.groupBy("model", key).pivot("__period", ["__base", *scenarios]).agg(F.first("t").alias("t"), F.first("p").alias("p"))
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("scenario"), (F.col(f"{s}_t") - F.col("__base_t")).alias("dtemp"), (F.col(f"{s}_p") - F.col("__base_p")).alias("dprecip")) for s in scenarios]))
    return wide.select("model", key, each.alias("d")).select("model", key, "d.*").filter(F.col("dtemp").isNotNull() | F.col("dprecip").isNotNull())


def model_mean(deltas: DataFrame, key: str = "cell") -> DataFrame:
    """Mean over the models of each scenario's deltas; a model that lacks one is left out of that mean alone."""
    return deltas.groupBy(key, "scenario").agg(F.avg("dtemp").alias("dtemp"), F.avg("dprecip").alias("dprecip"), F.countDistinct("model").alias("n_models"))


def resume_remaining(units: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Units that the manifest of finished ones does not hold; a null key is never finished."""
    return units.join(done.filter(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")
