"""Points near other points, and regions containing points, by trapezoidal decomposition.

Region boundaries, circles among them, are cut into horizontal bands; within a band a region becomes trapezoids between
a left and a right edge. The plane is cut into slabs and blocks, which are distributed; a crowded one is cut finer, so no
task holds an unbounded group and no edge goes to tasks that cannot need it. Within a cell the trapezoids are ordered by
their left edge, in classes of like width, and each point is located by binary search in each class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.functions.scalars import EARTH_KM
from freshet.session import join_dictionary, reliable_checkpoint

#: Height of a slab and length of a block in degrees.
SLAB_DEG, BLOCK_DEG = 0.2, 1.0
#: Points from which a cell is cut finer, and how often it is halved at most.
POINTS_PER_TASK, MOST_HALVINGS = 20_000, 12
#: Bands of a disc.
BANDS = 6
#: Places of one position that meet others in one join group.
LOT = 1000
#: Candidates that are tested in one pass.
PASS_PAIRS = 2_000_000


def _locate(cell: np.ndarray, is_point: np.ndarray, v: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (point, edge) of all points that lie in a trapezoid of their own cell; closed on every side.

    Cells are laid side by side on one axis, 1000 apart, so that one binary search serves all cells of the batch. In a
    class of trapezoids at most twice as wide as each other those that can hold a point begin within one width before it.
    """
    _, lane = np.unique(cell, return_inverse=True)
    lane = lane * 1000.0
    p, e = np.flatnonzero(is_point), np.flatnonzero(~is_point)
    least = lane[e] + np.minimum(v["left0"][e], v["left1"][e])
    width = lane[e] + np.maximum(v["right0"][e], v["right1"][e]) - least
    kind = np.floor(np.log2(np.maximum(width, 1e-6))).astype(int)
    classes = []
    for k in np.unique(kind):
        of = np.flatnonzero(kind == k)
        of = of[np.argsort(least[of], kind="stable")]
        classes.append((e[of], least[of], width[of].max()))
    x = lane[p] + v["x"][p]
    span = [(np.searchsorted(at, x - w - 1e-6, "left"), np.searchsorted(at, x + 1e-6, "right")) for _, at, w in classes]
    total = np.cumsum(sum((np.maximum(end - begin, 0) for begin, end in span), np.zeros(len(p), np.int64)))
    cuts = np.searchsorted(total, np.arange(PASS_PAIRS, total[-1] + 1, PASS_PAIRS)) + 1 if len(p) else []
    for part in np.split(np.arange(len(p)), cuts):
        pairs_p, pairs_e = [], []
        for (to_edge, _, _), (begin, end) in zip(classes, span):
            k = np.maximum(end[part] - begin[part], 0)
            at = np.repeat(p[part], k)
            to = to_edge[np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(begin[part], k)]
            inside = (cell[at] == cell[to]) & (v["y"][at] >= v["y0"][to]) & (v["y"][at] <= v["y1"][to])
            at, to = at[inside], to[inside]
            tall = v["y1"][to] - v["y0"][to]
            share = np.where(tall > 0, (v["y"][at] - v["y0"][to]) / np.where(tall > 0, tall, 1), 0)
            side = lambda a, b: v[a][to] + share * (v[b][to] - v[a][to])  # noqa: B023, E731
            hit = (v["x"][at] >= side("left0", "left1")) & (v["x"][at] <= side("right0", "right1"))
            pairs_p.append(at[hit])
            pairs_e.append(to[hit])
        if pairs_p:
            yield np.concatenate(pairs_p), np.concatenate(pairs_e)


_NUMBERS = ["x", "y", "y0", "y1", "left0", "left1", "right0", "right1", "km"]
#: Rows located in one pass.
PASS_ROWS = 100_000


def _km(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> np.ndarray:
    a, b = np.radians(y1), np.radians(y2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(x2 - x1) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.minimum(np.sqrt(h), 1.0))


def _locate_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    rows = 0

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, rows
        t = pa.Table.from_batches(held).combine_chunks()
        cell = t["cell"].to_numpy()
        other = np.flatnonzero(cell != cell[-1])
        cut = len(cell) if last else int(other[-1]) + 1 if len(other) else 0
        held, rows = (t.slice(cut).to_batches() if cut < len(cell) else []), len(cell) - cut
        if not cut:
            return
        t = t.slice(0, cut)
        v = {c: t[c].to_numpy() for c in _NUMBERS}
        ids = t["id"].combine_chunks() if isinstance(t["id"], pa.ChunkedArray) else t["id"]
        code = ids.dictionary_encode().indices.to_numpy()
        for at, to in _locate(cell[:cut], t["is_point"].to_numpy(zero_copy_only=False), v):
            disc = v["km"][to] > 0
            far = np.where(disc, _km(v["x"][at], v["y"][at], v["x"][to], v["y"][to]), 0.0)
            fine = ~disc | (far <= v["km"][to])
            at, to, far = at[fine], to[fine], far[fine]
            # A point has one cell, so what it meets twice (on the border of two trapezoids) meets here.
            _, once = np.unique(np.column_stack((at, code[to])), axis=0, return_index=True) if len(at) else (None, np.zeros(0, np.int64))
            yield from pa.table({"point_id": ids.take(pa.array(at[once])), "region_id": ids.take(pa.array(to[once])), "km": pa.array(far[once])}).to_batches()

    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
            if rows >= PASS_ROWS:
                yield from flush(False)
    if held:
        yield from flush(True)


def trapezoids_of(rings: list[list[tuple[float, float]]], slab: float) -> list[tuple[float, float, float, float, float, float]]:
    """(y0, y1, left x at y0 and y1, right x at y0 and y1) of a polygon given by the (x, y) vertices of its rings; what lies within an even number of rings is outside."""
    starts, ends = [], []
    for ring in rings:
        pts = np.asarray(ring, dtype=float)
        starts.append(pts)
        ends.append(np.roll(pts, -1, axis=0))
    a, b = np.concatenate(starts), np.concatenate(ends)
    ys = np.unique(np.concatenate((a[:, 1], np.arange(np.floor(a[:, 1].min() / slab) + 1, np.ceil(a[:, 1].max() / slab)) * slab)))
    out = []
    for y0, y1 in zip(ys[:-1].tolist(), ys[1:].tolist()):
        mid = (y0 + y1) / 2
        cross = (np.minimum(a[:, 1], b[:, 1]) < mid) & (mid < np.maximum(a[:, 1], b[:, 1]))
        p, q = a[cross], b[cross]
        at = lambda y: p[:, 0] + (y - p[:, 1]) / (q[:, 1] - p[:, 1]) * (q[:, 0] - p[:, 0])  # noqa: B023, E731
        order = np.argsort(at(mid), kind="stable")
        low, high = at(y0)[order].tolist(), at(y1)[order].tolist()
        out += [(y0, y1, low[k], high[k], low[k + 1], high[k + 1]) for k in range(0, len(low) - 1, 2)]
    return out


_EDGES = "region_id string, y0 double, y1 double, left0 double, left1 double, right0 double, right1 double"


def decompose(regions: DataFrame, slab: float = SLAB_DEG) -> DataFrame:
    """Trapezoids of regions ``region_id, ring`` (array of struct x, y) or ``region_id, rings`` (array of such: holes count as outside).

    Rings are simple; null ones, and those of fewer than three vertices, give none.
    """
    column = "rings" if "rings" in regions.columns else "ring"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for rid, shape in zip(pdf["region_id"], pdf[column]):
                rings = [[(p["x"], p["y"]) for p in r] for r in ([] if shape is None else shape if column == "rings" else [shape]) if r is not None and len(r) > 2]
                rows += [(rid, *t) for t in (trapezoids_of(rings, slab) if rings else [])]
            yield pd.DataFrame(rows, columns=["region_id", "y0", "y1", "left0", "left1", "right0", "right1"])

    return regions.select("region_id", column).mapInPandas(run, _EDGES)


def locate(points: DataFrame, trapezoids: DataFrame, slab: float = SLAB_DEG, block: float = BLOCK_DEG, per_task: int = POINTS_PER_TASK, least_side: float = 0.0) -> DataFrame:
    """``point_id, region_id, km`` for every point (``point_id, x, y``; distinct ids) in a region; boundary points belong to it.

    Points without coordinates lie in no region. ``trapezoids``: ``region_id, y0, y1, left0, left1, right0, right1`` and
    for discs ``x, y, radius`` (centre in degrees and kilometres): these are checked on the sphere and give ``km``, others 0. A
    cell of more than ``per_task`` points is halved in both directions until its share falls below, but not under
    ``least_side`` degrees. A point has one cell; a trapezoid is copied to every cell that it touches.
    """
    cell = lambda c, w: F.floor(c / F.lit(w))
    at = points.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    at = at.withColumns({"slab": cell(F.col("y"), slab), "block": cell(F.col("x"), block)})
    most = MOST_HALVINGS if least_side <= 0 else max(0, min(MOST_HALVINGS, int(np.floor(np.log2(max(1.0, min(slab, block) / least_side))))))
    crowd = at.groupBy("slab", "block").count().filter(F.col("count") > per_task)
    crowd = reliable_checkpoint(crowd.select("slab", "block", F.least(F.ceil(F.log2(F.col("count") / per_task) / 2), F.lit(most)).cast("int").alias("halved")))
    fold = lambda c, w: F.floor(c * F.pow(F.lit(2.0), F.coalesce("halved", F.lit(0))) / F.lit(w))
    at = join_dictionary(at, crowd, ["slab", "block"], "left").select("point_id", "x", "y", "halved", fold(F.col("y"), slab).alias("row"), fold(F.col("x"), block).alias("col"))
    edges = trapezoids.withColumn("slab", F.explode(F.sequence(cell(F.col("y0"), slab), cell(F.col("y1"), slab))))
    edges = edges.withColumn("block", F.explode(F.sequence(cell(F.least("left0", "left1"), block), cell(F.greatest("right0", "right1"), block))))
    edges = join_dictionary(edges, crowd, ["slab", "block"], "left")
    parts = F.pow(F.lit(2.0), F.coalesce("halved", F.lit(0))).cast("bigint")
    inside = lambda low, high, base: F.explode(F.sequence(F.greatest(low, F.col(base) * parts), F.least(high, F.col(base) * parts + parts - 1)))
    edges = edges.withColumn("row", inside(fold(F.col("y0"), slab), fold(F.col("y1"), slab), "slab"))
    edges = edges.withColumn("col", inside(fold(F.least("left0", "left1"), block), fold(F.greatest("right0", "right1"), block), "block"))
    cell_id = F.xxhash64(F.coalesce("halved", F.lit(0)), "row", "col").alias("cell")
    have = lambda df, pairs: [(F.col(src) if src in df.columns else F.lit(0.0)).cast("double").alias(c) for c, src in pairs]
    a = edges.select(cell_id, F.lit(False).alias("is_point"), F.col("region_id").cast("string").alias("id"), *have(edges, [(c, "radius" if c == "km" else c) for c in _NUMBERS]))
    b = at.select(cell_id, F.lit(True).alias("is_point"), F.col("point_id").cast("string").alias("id"), *have(at.select("x", "y"), [(c, c) for c in _NUMBERS]))
    cells = a.unionByName(b).repartition("cell").sortWithinPartitions("cell")
    return cells.mapInArrow(_locate_batches, "point_id string, region_id string, km double")


def disc_trapezoids(centres: DataFrame, radius_km: float, bands: int = BANDS) -> DataFrame:
    """Trapezoids that cover the disc of ``radius_km`` round each centre (``region_id, x, y``), in plain column arithmetic.

    The disc is cut into bands of equal height. In a band its edge, which bends inwards, is replaced by its tangent at the
    middle of the band, so the trapezoid covers the band and little more. Discs of more than a degree, and those near a
    pole, take their latitude-longitude box. What crosses the antimeridian is laid on both sides of it.
    """
    reach = float(np.degrees(radius_km / EARTH_KM))
    out = reach * (1 + 1e-9)
    c = centres.filter(F.col("x").between(-180, 180) & F.col("y").between(-90, 90))
    ratio = F.sin(F.radians(F.lit(out))) / F.cos(F.radians("y"))
    box = F.when((F.abs("y") + out < 90) & (ratio < 1), F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) * (1 + 1e-9)).otherwise(F.lit(180.0))
    tangents = (F.abs("y") < 85) & F.lit(reach < 1)
    c = c.withColumn("boxed", box).withColumn("band", F.explode(F.when(tangents, F.sequence(F.lit(0), F.lit(bands - 1))).otherwise(F.array(F.lit(-1)))))
    edge = lambda k: F.col("y") - out + (2 * out / bands) * k
    c = c.withColumns({"y0": F.when(F.col("band") < 0, F.col("y") - out).otherwise(edge(F.col("band"))), "y1": F.when(F.col("band") < 0, F.col("y") + out).otherwise(edge(F.col("band") + 1))})
    mid, centre = F.radians((F.col("y0") + F.col("y1")) / 2), F.radians("y")
    half = F.radians(F.lit(out))
    # Half width in longitude at the middle of the band, and its slope there (degrees per degree).
    wide = 2 * F.asin(F.sqrt(F.greatest((F.pow(F.sin(half / 2), 2) - F.pow(F.sin((mid - centre) / 2), 2)) / (F.cos(mid) * F.cos(centre)), F.lit(0.0))))
    slope = (F.sin(centre) - F.cos(half) * F.sin(mid)) / (F.pow(F.cos(mid), 2) * F.cos(centre) * F.sin(wide))
    w = lambda y: F.when(F.col("band") < 0, F.col("boxed")).otherwise((F.degrees(wide) + slope * (y - F.degrees(mid))) * (1 + 1e-6))
    c = c.withColumns({"w0": w(F.col("y0")), "w1": w(F.col("y1"))})
    turn = F.explode(F.filter(F.array(F.lit(0.0), F.lit(360.0), F.lit(-360.0)), lambda t: (F.col("x") + F.greatest("w0", "w1") + t >= -180) & (F.col("x") - F.greatest("w0", "w1") + t <= 180)))
    c = c.withColumn("turn", turn)
    side = lambda w, s: (F.col("x") + F.col("turn") + s * F.col(w))
    return c.select(
        F.col("region_id").cast("string").alias("region_id"), "y0", "y1", side("w0", -1).alias("left0"), side("w1", -1).alias("left1"), side("w0", 1).alias("right0"), side("w1", 1).alias("right1"),
        "x", "y", F.lit(float(radius_km)).alias("radius"),
    )


def usual_positions(df: DataFrame, id_col: str, lat_col: str = "latitude", lon_col: str = "longitude") -> DataFrame:
    """``id, lat, lon``: the pair most rows of each id carry; a tie goes to the smaller latitude, then longitude.

    Rows with a null id, a null or NaN coordinate, or a coordinate off the globe, do not count; an id without any
    usable pair is left out.
    """
    lat, lon = F.col(lat_col), F.col(lon_col)
    counts = df.filter(F.col(id_col).isNotNull() & lat.between(-90, 90) & lon.between(-180, 180)).groupBy(F.col(id_col).alias("id"), lat.alias("lat"), lon.alias("lon")).agg(F.count("*").alias("n"))
    return counts.groupBy("id").agg(F.min_by(F.struct("lat", "lon"), F.struct(-F.col("n"), F.col("lat"), F.col("lon"))).alias("p")).select("id", "p.lat", "p.lon")


def spots_of(places: DataFrame) -> DataFrame:
    """``id, lat, lon`` with ``spot``, one text per position; places without a position are left out."""
    zero = lambda c: F.col(c).cast("double") + F.lit(0.0)
    p = places.filter(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)).select("id", zero("lat").alias("lat"), zero("lon").alias("lon"))
    return p.withColumn("spot", F.concat_ws(",", F.col("lat").cast("string"), F.col("lon").cast("string")))


def near_spots(member: DataFrame, radius_km: float) -> DataFrame:
    """``spot_a, spot_b, km`` with spot_a < spot_b for different positions of ``member`` (see ``spots_of``) at most ``radius_km`` apart.

    Places at one position cost one point. Membership (``spot``, ``id``) stands in ``member``.
    """
    spots = reliable_checkpoint(member.select("spot", "lat", "lon").distinct())
    centres = spots.select(F.col("spot").alias("region_id"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    reach = float(np.degrees(radius_km / EARTH_KM))
    hits = locate(centres.withColumnRenamed("region_id", "point_id"), disc_trapezoids(centres, radius_km), least_side=2 * reach)
    return hits.filter(F.col("point_id") < F.col("region_id")).select(F.col("point_id").alias("spot_a"), F.col("region_id").alias("spot_b"), "km")


def near_pairs(places: DataFrame, radius_km: float) -> DataFrame:
    """``id_a, id_b, km`` with id_a < id_b for different ids (``id, lat, lon``) at most ``radius_km`` apart on a sphere.

    Pairs of positions are found first; the pairs of their places, which are the result, are made at the end, in lots of
    at most about ``LOT`` places a side, so a crowd at one position spreads. Nulls lie near nothing; an empty table gives no
    pair. Where the pairs themselves are not asked for use ``near_spots`` and the membership.
    """
    whole = reliable_checkpoint(spots_of(places))  # read several times below
    sizes = whole.groupBy("spot").agg(F.count("*").alias("n"))
    crowded = sizes.filter(F.col("n") > 1)  # single places need no lots and no pairs of their own
    lots = reliable_checkpoint(crowded.select("spot", F.ceil(F.col("n") / LOT).cast("int").alias("lots")))
    member = join_dictionary(whole.select("spot", "id"), lots, ["spot"], "left").withColumn("lot", F.pmod(F.xxhash64("id"), F.coalesce("lots", F.lit(1))).cast("int")).select("spot", "lot", "id")
    both = near_spots(whole, radius_km).unionByName(lots.select(F.col("spot").alias("spot_a"), F.col("spot").alias("spot_b"), F.lit(0.0).alias("km")))
    many = F.explode(F.sequence(F.lit(0), F.coalesce("lots", F.lit(1)) - 1))
    for side in ("a", "b"):
        look = lots.withColumnRenamed("spot", f"spot_{side}")
        both = join_dictionary(both, look, [f"spot_{side}"], "left").withColumn(f"lot_{side}", many).drop("lots")
    for side in ("a", "b"):
        m = member.select(F.col("spot").alias(f"spot_{side}"), F.col("lot").alias(f"lot_{side}"), F.col("id").alias(f"i_{side}"))
        both = both.join(m, [f"spot_{side}", f"lot_{side}"])
    pairs = both.filter((F.col("spot_a") != F.col("spot_b")) | (F.col("i_a") < F.col("i_b"))).filter(F.col("i_a") != F.col("i_b"))
    return pairs.select(F.least("i_a", "i_b").alias("id_a"), F.greatest("i_a", "i_b").alias("id_b"), "km")


def found(df: DataFrame) -> DataFrame:
    """Pairs of different stations at most one kilometre apart, smaller id first."""
    return near_pairs(usual_positions(df, "station_id"), 1.0).select(F.col("id_a").alias("station_id_a"), F.col("id_b").alias("station_id_b"))
