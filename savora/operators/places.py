"""Points, cells and walkable regions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from savora.functions import geo
from savora.functions.ordering import prefix_sums
from savora.session import cut_lineage, materialise

# --- points and cells -----------------------------------------------------------------------


def with_cell(df: DataFrame, lat: str, lon: str, res: int, out: str = "cell_id") -> DataFrame:
    q, r = geo.axial(F.col(lat), F.col(lon), res)
    return df.withColumn(out, geo.cell_id(q, r, res))


def cell_centres(cells: DataFrame, res: int, cell: str = "cell_id") -> DataFrame:
    lat, lon = geo.centre(geo.cell_q(F.col(cell)), geo.cell_r(F.col(cell)), res)
    return cells.withColumn("cell_lat", lat).withColumn("cell_lon", lon)


def cell_corners(cell: str, res: int) -> Column:
    c = F.col(cell)
    return geo.corners(geo.cell_q(c), geo.cell_r(c), res)


def mean_point(df: DataFrame, lat: str, lon: str) -> DataFrame:
    return df.agg(F.avg(lat).alias("lat"), F.avg(lon).alias("lon"))


def ring_cells(cells: DataFrame, res: int, k: int, ring_only: bool = False, cell: str = "cell_id") -> DataFrame:
    """Each cell with the cells within k steps (cell, neighbor, ring)."""
    c = F.col(cell)
    near = geo.disk(geo.cell_q(c), geo.cell_r(c), k, ring_only)
    return cells.select(cell, F.inline(near)).select(cell, geo.cell_id(F.col("q"), F.col("r"), res).alias("neighbor"), "ring")


def cell_stats(df: DataFrame, aggs: dict[str, Column], res: int, cell: str = "cell_id") -> DataFrame:
    return df.groupBy(cell).agg(*[v.alias(k) for k, v in aggs.items()])


def cells_with_stats(cells: DataFrame, stats: DataFrame, count: str, cell: str = "cell_id") -> DataFrame:
    """All cells, 0 where a cell has no points; point_count counts the cell's own centre too."""
    return cells.join(stats, cell, "left").fillna(0).withColumn("point_count", F.col(count) + 1)


def category_cell_metadata(df: DataFrame, category: str, lat: str, lon: str, res: int) -> DataFrame:
    """Graph metadata ids "category_cell" for the own cell and its ring of neighbours."""
    q, r = geo.axial(F.col(lat), F.col(lon), res)
    work = df.withColumn("__q", q).withColumn("__r", r)
    label = lambda a, b: F.concat(F.col(category), F.lit("_"), geo.cell_id(a, b, res))
    ring = F.array(*[label(F.col("__q") + dq, F.col("__r") + dr) for dq, dr, _ in sorted(geo.disk_offsets(1, True))])
    return (
        work.withColumn("metadata_id", label(F.col("__q"), F.col("__r")))
        .withColumn("metadata_id_neighbors", F.filter(ring, lambda x: x.isNotNull()))
        .drop("__q", "__r")
    )


# --- distances ------------------------------------------------------------------------------

def near_point(df: DataFrame, lat: str, lon: str, lat0: float, lon0: float, km: float, flat: bool = False) -> DataFrame:
    """Rows within km of a point; the box test in front reaches the scan as plain ranges. The box
    widens with the latitude, wraps at 180 degrees and spans all longitudes around a pole."""
    reach = math.degrees(km / geo.EARTH_RADIUS_KM) * 1.000001
    box = F.col(lat).between(lat0 - reach, lat0 + reach)
    if abs(lat0) + reach < 90:
        # The flat measure takes a degree of longitude for one of latitude.
        wide = max(reach, math.degrees(math.asin(min(1.0, math.sin(math.radians(reach)) / math.cos(math.radians(lat0))))))
        span = F.col(lon).between(lon0 - wide, lon0 + wide)
        if lon0 - wide < -180:
            span = span | (F.col(lon) >= lon0 - wide + 360)
        if lon0 + wide > 180:
            span = span | (F.col(lon) <= lon0 + wide - 360)
        box = box & span
    measure = geo.flat_radian_km if flat else geo.haversine_km
    return df.where(box).withColumn("km", measure(lat0, lon0, lat, lon)).where(F.col("km") <= km)


def near_pairs(df: DataFrame, key: str, lat: str, lon: str, km: float) -> DataFrame:
    """All pairs of rows within km, each once (a, b, km), a < b.

    Points lie on a sphere cut into cubes with a side of four times the radius, so that neither the
    poles nor 180 degrees are borders. A point is sent to the cubes within its reach (1 to 8), the
    others stay in their own: the range join becomes an equi-join that only meets nearby rows.
    """
    side, reach = 4.0 * km, km * 1.000001
    la, lo = F.radians(F.col(lat)), F.radians(F.col(lon))
    axes = {"x": F.cos(la) * F.cos(lo), "y": F.cos(la) * F.sin(lo), "z": F.sin(la)}
    pts = df.select(F.col(key).alias("k"), F.col(lat).alias("la"), F.col(lon).alias("lo"), *[(v * geo.EARTH_RADIUS_KM).alias(n) for n, v in axes.items()])
    sent = pts.select(F.col("k").alias("k1"), F.col("la").alias("la1"), F.col("lo").alias("lo1"), *axes, *[F.col(n).alias(f"{n}1") for n in axes])
    for n in axes:
        sent = sent.withColumn(n, F.explode(F.sequence(F.floor((F.col(n) - reach) / side), F.floor((F.col(n) + reach) / side))))
    own = pts.select("k", "la", "lo", *[F.floor(F.col(n) / side).alias(n) for n in axes], *[F.col(n).alias(f"{n}2") for n in axes])
    # The straight line is no longer than the arc. It is cheap to compare, and most pairs of neighbouring cubes end there.
    line = sum((F.col(f"{n}1") - F.col(f"{n}2")) * (F.col(f"{n}1") - F.col(f"{n}2")) for n in axes)
    near = sent.join(own, list(axes)).where((F.col("k1") < F.col("k")) & (line <= (reach + 1e-9) ** 2))
    out = near.withColumn("km", geo.haversine_km("la1", "lo1", "la", "lo"))
    return out.where(F.col("km") <= km).select(F.col("k1").alias("a"), F.col("k").alias("b"), "km")


def nearest_anchor(cells: DataFrame, key: str, lat: str, lon: str, anchors: DataFrame, per_block: int = 1000) -> DataFrame:
    """Closest anchor per row. anchors: (anchor, a_lat, a_lon), any number of them: they travel as
    packed blocks of bounded length, and a row meets each block once. Anchors without coordinates
    are nobody's; rows without have neither anchor nor distance."""
    anchors = anchors.where("a_lat is not null and a_lon is not null")
    n = anchors.agg(F.greatest(F.ceil(F.count("*") / per_block), F.lit(1)).cast("int")).scalar()
    packed = anchors.withColumn("blk", F.pmod(F.xxhash64("anchor"), n).cast("int")).groupBy("blk").agg(
        F.collect_list(F.struct("anchor", "a_lat", "a_lon")).alias("l")
    )
    rows = cells.select(key, F.col(lat).alias("__la"), F.col(lon).alias("__lo"), F.explode(F.sequence(F.lit(0), n - 1)).alias("blk"))
    km = lambda s: F.struct(F.round(geo.haversine_km(F.col("__la"), F.col("__lo"), s["a_lat"], s["a_lon"]), 9).alias("km"), s["anchor"].alias("anchor"))
    best = rows.join(packed, "blk").select(key, F.array_min(F.transform("l", km)).alias("b"))
    return best.groupBy(key).agg(F.min("b").alias("b")).select(
        key, F.when(F.col("b.km").isNotNull(), F.col("b.anchor")).alias("anchor"), "b.km"
    )


# --- areas ----------------------------------------------------------------------------------

def inside(polygon: Sequence[tuple[float, float]], lat: Column, lon: Column) -> Column:
    """Ray casting: an odd number of polygon edges crosses the ray to the east."""
    crossings = F.lit(0)
    for (la1, lo1), (la2, lo2) in zip(polygon, [*polygon[1:], polygon[0]]):
        if la1 == la2:
            continue
        spans = (F.lit(la1) > lat) != (F.lit(la2) > lat)
        at = F.lit(lo1) + (lat - F.lit(la1)) * F.lit((lo2 - lo1) / (la2 - la1))
        crossings = crossings + (spans & (lon < at)).cast("int")
    return crossings % 2 == 1


def cover_area(spark: SparkSession, polygon: Sequence[tuple[float, float]], res: int) -> DataFrame:
    """Cells whose centre lies inside the polygon, from the coordinate ranges of its box."""
    s = geo.side(res)
    mx = geo.metres_per_lon()
    lats, lons = [p[0] for p in polygon], [p[1] for p in polygon]
    r_lo, r_hi = (int(v * geo.METRES_PER_DEGREE_LAT / (1.5 * s)) for v in (min(lats), max(lats)))
    q_lo = int(min(lons) * mx / (s * 3**0.5) - r_hi / 2) - 1
    q_hi = int(max(lons) * mx / (s * 3**0.5) - r_lo / 2) + 1
    rows = spark.range(r_lo - 1, r_hi + 2).withColumnRenamed("id", "r")
    grid = rows.select("r", F.explode(F.sequence(F.lit(q_lo).cast("long"), F.lit(q_hi).cast("long"))).alias("q"))
    lat, lon = geo.centre(F.col("q"), F.col("r"), res)
    return grid.where(inside(polygon, lat, lon)).select(geo.cell_id(F.col("q"), F.col("r"), res).alias("cell_id"))


# --- cell graph and components --------------------------------------------------------------

def cell_graph(cells: DataFrame, res: int, k: int, max_km: float, cell: str = "cell_id") -> DataFrame:
    """Edges (a, b, km), a < b, between listed cells at most k steps and max_km apart."""
    ids = cells.select(cell).distinct()
    pairs = ring_cells(ids, res, k, cell=cell).where(F.col(cell) < F.col("neighbor"))
    hit = pairs.join(ids.select(F.col(cell).alias("neighbor")), "neighbor", "left_semi")
    la1, lo1 = geo.centre(geo.cell_q(F.col(cell)), geo.cell_r(F.col(cell)), res)
    la2, lo2 = geo.centre(geo.cell_q(F.col("neighbor")), geo.cell_r(F.col("neighbor")), res)
    return hit.select(F.col(cell).alias("a"), F.col("neighbor").alias("b"), geo.haversine_km(la1, lo1, la2, lo2).alias("km")).where(F.col("km") <= max_km)


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, comp): smallest id reachable from each node.

    Rounds of smallest-neighbour labels with pointer jumping, so chains shrink geometrically;
    lineage is cut every round and the loop ends when nothing changes.
    """
    both = materialise(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst"))))
    labels = cut_lineage(nodes.select("id").distinct().withColumn("comp", F.col("id")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy("src").agg(F.min("comp").alias("m"))
        low = labels.join(near.withColumnRenamed("src", "id"), "id", "left").select(
            "id", F.col("comp").alias("old"), F.least("comp", F.coalesce("m", F.col("comp"))).alias("comp")
        )
        jump = low.select(F.col("id").alias("comp"), F.col("comp").alias("root"))
        new = cut_lineage(low.join(jump, "comp", "left").select("id", "old", F.least("comp", F.coalesce("root", F.col("comp"))).alias("comp")))
        changed = not new.where(F.col("old") != F.col("comp")).isEmpty()
        labels = new.select("id", "comp")
        if not changed:
            return labels


def regions_from_components(labels: DataFrame, min_cells: int) -> DataFrame:
    """(cell_id, region): component label, "-1" for components below the minimum size."""
    sizes = labels.groupBy("comp").agg(F.count("*").alias("n"))
    return labels.join(sizes, "comp").select(F.col("id").alias("cell_id"), F.when(F.col("n") >= min_cells, F.col("comp")).otherwise("-1").alias("region"))


def _hull():
    """A task function that leaves the rows at the corners of their convex hull on the sphere: the planar hull after
    a projection that keeps great circles straight. Points over 45 degrees from their mean are no region: all stay."""

    def corners(pdf: pd.DataFrame) -> pd.DataFrame:
        la, lo = np.radians(pdf["la"].to_numpy(float)), np.radians(pdf["lo"].to_numpy(float))
        p = np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], axis=1)
        c = p.mean(axis=0)
        size = np.linalg.norm(c)
        c = c / size if size > 1e-9 else p[0]
        height = p @ c
        if len(pdf) < 4 or height.min() < 0.71:
            return pdf
        east = np.cross([0.0, 0.0, 1.0] if abs(c[2]) < 0.9 else [1.0, 0.0, 0.0], c)
        east /= np.linalg.norm(east)
        x, y = p @ east / height, p @ np.cross(c, east) / height
        order = np.lexsort((y, x))
        keep = set()
        for way in (order, order[::-1]):
            chain = []
            for i in way:
                while len(chain) > 1:
                    a, b = chain[-2], chain[-1]
                    if (x[b] - x[a]) * (y[i] - y[a]) - (y[b] - y[a]) * (x[i] - x[a]) > 0:
                        break
                    chain.pop()
                chain.append(i)
            keep.update(chain)
        return pdf.iloc[sorted(keep)]

    return corners


def region_diameter(
    cells: DataFrame, res: int, cell: str = "cell_id", region: str = "region", small: int = 256, rows_per_hull: int = 2048,
) -> DataFrame:
    """Largest distance between two cells of a region in km.

    Along a grid row distance grows towards its ends, so the farthest pair always consists of row ends. A cap of
    the sphere that holds the corners of a hull holds the hull, so of more than `small` row ends only corners of the
    hull are compared: hulls of `rows_per_hull` rows each are built in tasks and merged. The result is the same.
    """
    c = F.col(cell)
    ends = (
        cells.where(F.col(region) != "-1").select(region, geo.cell_q(c).alias("q"), geo.cell_r(c).alias("r"))
        .groupBy(region, "r").agg(F.min("q").alias("q1"), F.max("q").alias("q2"))
    )
    pts = ends.select(region, "r", F.explode(F.array_distinct(F.array("q1", "q2"))).alias("q"))
    lat, lon = geo.centre(F.col("q"), F.col("r"), res)
    pts = materialise(pts.select(region, lat.alias("la"), lon.alias("lo"), F.floor(F.col("r") / rows_per_hull).alias("part")))
    sizes = pts.groupBy(region).agg(F.count("*").alias("n"))
    large = materialise(sizes.where(F.col("n") > small))
    left = pts.select(region, "la", "lo")
    if not large.isEmpty():
        parts = pts.join(large, region, "left_semi").groupBy(region, "part").applyInPandas(_hull(), pts.schema)
        hulls = parts.groupBy(region).applyInPandas(_hull(), pts.schema)
        left = left.join(large, region, "left_anti").unionByName(hulls.select(region, "la", "lo"))
        left = materialise(left)
    other = left.select(region, F.col("la").alias("la2"), F.col("lo").alias("lo2"))
    return left.join(other, region).groupBy(region).agg(F.max(geo.haversine_km("la", "lo", "la2", "lo2")).alias("diameter_km"))


def split_oversize(cells: DataFrame, edges: DataFrame, res: int, max_cells: int, max_km: float, min_cells: int) -> DataFrame:
    """Halve regions that are too large along their wider axis until none is, then keep connected
    parts. Ranks are bucketed by the cut coordinate, so a whole city may start as one region."""
    c = F.col("cell_id")
    state = cells.where("region <> '-1'").select("cell_id", "region", geo.cell_q(c).alias("q"), geo.cell_r(c).alias("r"))
    state = cut_lineage(state)
    while True:
        sizes = state.groupBy("region").agg(
            F.count("*").alias("n"), (F.max("r") - F.min("r")).alias("dr"), (F.max(F.col("q") * 2 + F.col("r")) - F.min(F.col("q") * 2 + F.col("r"))).alias("dx")
        )
        big = sizes.join(region_diameter(state, res), "region").where((F.col("n") > 1) & ((F.col("n") > max_cells) | (F.col("diameter_km") > max_km)))
        big = cut_lineage(big.select("region", "n", (F.col("dr") * 1.5 >= F.col("dx") * (3**0.5) / 2).alias("by_row")))
        if big.isEmpty():
            break
        coord = F.when(F.col("by_row"), F.col("r")).otherwise(F.col("q") * 2 + F.col("r"))
        hit = state.join(big, "region").withColumn("x", coord)
        ranked = prefix_sums(hit, ["region"], F.col("x"), [F.col("x"), F.col("cell_id")], {"before": F.lit(1).cast("long")})
        cut = ranked.select("cell_id", F.concat("region", F.when(F.col("before") * 2 < F.col("n"), ".0").otherwise(".1")).alias("region"), "q", "r")
        state = cut_lineage(state.join(big.select("region"), "region", "left_anti").select("cell_id", "region", "q", "r").unionByName(cut))
    part_a = state.select(F.col("cell_id").alias("a"), F.col("region").alias("ra"))
    part_b = state.select(F.col("cell_id").alias("b"), F.col("region").alias("rb"))
    kept = edges.join(part_a, "a").join(part_b, "b").where(F.col("ra") == F.col("rb")).select("a", "b")
    parts = regions_from_components(connected_components(state.select(F.col("cell_id").alias("id")), kept), min_cells)
    rest = cells.where("region = '-1'").select("cell_id", "region")
    return parts.unionByName(rest)


def adopt_orphans(cells: DataFrame, res: int, max_km: float, rings: int = 3) -> DataFrame:
    """Cells without a region join the nearest valid one within three rings and max_km."""
    orphans = cells.where("region = '-1'").select("cell_id")
    valid = cells.where("region <> '-1'").select(F.col("cell_id").alias("neighbor"), F.col("region").alias("near_region"))
    la1, lo1 = geo.centre(geo.cell_q(F.col("cell_id")), geo.cell_r(F.col("cell_id")), res)
    la2, lo2 = geo.centre(geo.cell_q(F.col("neighbor")), geo.cell_r(F.col("neighbor")), res)
    options = ring_cells(orphans, res, rings).join(valid, "neighbor").withColumn("km", F.round(geo.haversine_km(la1, lo1, la2, lo2), 9)).where(F.col("km") <= max_km)
    best = options.groupBy("cell_id").agg(F.min_by("near_region", F.struct("ring", "km", "near_region")).alias("adopted"))
    return cells.join(best, "cell_id", "left").select(
        "cell_id", F.when(F.col("region") == "-1", F.coalesce("adopted", F.lit("-1"))).otherwise(F.col("region")).alias("region")
    )


def graph_statistics(cells: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node table, region table): degree, isolated and orphan flags; cells, inner and all edges."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("cell_id"))
    deg = ends.groupBy("cell_id").agg(F.count("*").alias("degree"))
    nodes = cells.join(deg, "cell_id", "left").fillna(0, subset=["degree"]).select(
        "cell_id", "region", "degree", (F.col("degree") == 0).cast("int").alias("isolated"), (F.col("region") == "-1").cast("int").alias("orphan")
    )
    ra = cells.select(F.col("cell_id").alias("a"), F.col("region").alias("ra"))
    rb = cells.select(F.col("cell_id").alias("b"), F.col("region").alias("rb"))
    labelled = edges.join(ra, "a").join(rb, "b")
    inner = labelled.where("ra = rb and ra <> '-1'").groupBy(F.col("ra").alias("region")).agg(F.count("*").alias("inner_edges"), F.avg("km").alias("mean_km"))
    regions = nodes.groupBy("region").agg(F.count("*").alias("cells"), F.avg("degree").alias("mean_degree"), F.sum("isolated").alias("isolated")).join(
        inner, "region", "left"
    ).fillna(0, subset=["inner_edges"])
    return nodes, regions


def edge_statistics(cells: DataFrame, edges: DataFrame) -> DataFrame:
    ra = cells.select(F.col("cell_id").alias("a"), F.col("region").alias("ra"))
    rb = cells.select(F.col("cell_id").alias("b"), F.col("region").alias("rb"))
    same = (F.col("ra") == F.col("rb")) & (F.col("ra") != "-1")
    return edges.join(ra, "a").join(rb, "b").agg(
        F.count("*").alias("edges"), F.count_if(same).alias("intra_region"), F.min("km").alias("min_km"), F.avg("km").alias("mean_km"), F.max("km").alias("max_km")
    )


# --- items and regions ----------------------------------------------------------------------

def items_to_regions(items: DataFrame, cells: DataFrame, cell: str = "cell_id") -> DataFrame:
    return items.join(cells.select(cell, "region"), cell, "left").withColumn("region", F.coalesce("region", F.lit("-1")))


def locate_points(points: DataFrame, key: str, lat: str, lon: str, cells: DataFrame, res: int, rings: int = 5) -> DataFrame:
    """Region of each point: its own cell's, else the one of the nearest ring with a valid cell
    (key, region, ring); -1 beyond the last ring."""
    located = with_cell(points, lat, lon, res).select(key, "cell_id")
    valid = cells.where("region <> '-1'").select(F.col("cell_id").alias("neighbor"), "region")
    spots = located.select("cell_id").distinct()
    found = ring_cells(spots, res, rings).join(valid, "neighbor").groupBy("cell_id").agg(
        F.min(F.struct("ring", "region")).alias("b")
    )
    return located.join(found, "cell_id", "left").select(
        key, F.coalesce("b.region", F.lit("-1")).alias("region"), F.coalesce("b.ring", F.lit(-1)).alias("ring")
    )


def region_items(points: DataFrame, key: str, located: DataFrame, items: DataFrame) -> DataFrame:
    """Items in the region of each point, with a flag for points served by a neighbouring cell."""
    usable = located.where("region <> '-1'").withColumn("fallback", (F.col("ring") > 0).cast("int"))
    return usable.join(items, "region")


def region_distribution(items: DataFrame, top: int = 10) -> DataFrame:
    """Items per region with the share of mapped items, largest first."""
    totals = items.agg(F.struct(F.count("*").alias("n"), F.count_if(F.col("region") != "-1").alias("m"))).scalar()
    return (
        items.where("region <> '-1'").groupBy("region").agg(F.count("*").alias("items"))
        .orderBy(F.desc("items"), F.asc("region")).limit(top)
        .withColumn("mapped_pct", F.round(100.0 * totals["m"] / totals["n"], 6))
    )


def region_sizes(cells: DataFrame) -> DataFrame:
    sizes = cells.where("region <> '-1'").groupBy("region").agg(F.count("*").alias("cells"))
    return sizes.agg(
        F.count("*").alias("regions"), F.min("cells").alias("min_cells"), F.avg("cells").alias("mean_cells"), F.max("cells").alias("max_cells")
    )


def build_regions(cells: DataFrame, res: int, k: int, max_km: float, max_cells: int, max_diameter_km: float, min_cells: int) -> tuple[DataFrame, DataFrame]:
    """Cells to regions: graph, components, splitting, orphans. Returns (regions, edges)."""
    ids = materialise(cells.select("cell_id").distinct())
    edges = materialise(cell_graph(ids, res, k, max_km))
    first = regions_from_components(connected_components(ids.select(F.col("cell_id").alias("id")), edges), min_cells)
    split = split_oversize(materialise(first), edges, res, max_cells, max_diameter_km, min_cells)
    return materialise(adopt_orphans(split, res, max_km * 3)), edges

