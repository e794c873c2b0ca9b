"""L: geography and walking regions over the diners' coordinates."""

from __future__ import annotations

from pyspark.sql import functions as F

from savora.functions import geo
from savora.operators import places as P
from savora.plans.features import hex_sql
from savora.plans.popularity import HAVERSINE_SQL
from savora.plans.registry import query
from savora.session import materialise
from savora.plans.splits import HASH_SQL

RES = 9
CELL_SQL = f"pts AS (SELECT *, '{RES}_' || q || '_' || r AS cell_id FROM ({hex_sql('lat', 'lon', RES, 'diner')}))"


def centre_sql(q, r, res=RES):
    s, mx = geo.side(res), geo.metres_per_lon()
    lat = f"(CAST({s * 1.5!r} AS DOUBLE) * {r} / CAST({geo.METRES_PER_DEGREE_LAT!r} AS DOUBLE))"
    lon = f"(CAST({s * 3 ** 0.5!r} AS DOUBLE) * ({q} + {r} / 2.0::DOUBLE) / CAST({mx!r} AS DOUBLE))"
    return lat, lon


def dist_sql(q1, r1, q2, r2):
    (a1, o1), (a2, o2) = centre_sql(q1, r1), centre_sql(q2, r2)
    return HAVERSINE_SQL.format(la1=a1, lo1=o1, la2=a2, lo2=o2)


def _points(t):
    return P.with_cell(t.diner, "lat", "lon", RES)


@query("l1_point_to_cell", f"WITH {CELL_SQL} SELECT diner_idx, cell_id FROM pts")
def l1(t):
    return _points(t).select("diner_idx", "cell_id")


@query("l2_haversine", f"SELECT diner_idx, round({HAVERSINE_SQL.format(la1='lat', lo1='lon', la2='37.5', lo2='127.0')}, 6) AS km, "
       "round(6371 * sqrt(pow(radians(lat - 37.5), 2) + pow(radians(lon - 127.0), 2)), 6) AS flat_km FROM diner")
def l2(t):
    return t.diner.select(
        "diner_idx", F.round(geo.haversine_km("lat", "lon", 37.5, 127.0), 6).alias("km"),
        F.round(geo.flat_radian_km(37.5, 127.0, "lat", "lon"), 6).alias("flat_km"),
    )


@query("l3_ring_neighbors", f"""
WITH {CELL_SQL}, c AS (SELECT DISTINCT cell_id, q, r FROM pts)
SELECT cell_id, '{RES}_' || (q + dq) || '_' || (r + dr) AS neighbor, CAST(greatest(abs(dq), abs(dr), abs(dq + dr)) AS INTEGER) AS ring
FROM c, (SELECT unnest(range(-2, 3)) AS dq), (SELECT unnest(range(-2, 3)) AS dr) WHERE greatest(abs(dq), abs(dr), abs(dq + dr)) <= 2""")
def l3(t):
    return P.ring_cells(_points(t).select("cell_id").distinct(), RES, 2)


@query("l4_cell_centre", f"""
WITH {CELL_SQL} SELECT DISTINCT cell_id, round({centre_sql('q', 'r')[0]}, 6) AS cell_lat, round({centre_sql('q', 'r')[1]}, 6) AS cell_lon FROM pts""")
def l4(t):
    out = P.cell_centres(_points(t).select("cell_id").distinct(), RES)
    return out.select("cell_id", F.round("cell_lat", 6).alias("cell_lat"), F.round("cell_lon", 6).alias("cell_lon"))


@query("l4_cell_boundary", f"""
WITH {CELL_SQL} SELECT DISTINCT cell_id, CAST(corner AS INTEGER) AS corner, round({centre_sql('q', 'r')[0]} + {geo.side(RES)!r}::DOUBLE * sin(radians(60 * corner + 30)) / {geo.METRES_PER_DEGREE_LAT!r}::DOUBLE, 6) AS lat,
 round({centre_sql('q', 'r')[1]} + {geo.side(RES)!r}::DOUBLE * cos(radians(60 * corner + 30)) / {geo.metres_per_lon()!r}::DOUBLE, 6) AS lon FROM pts, (SELECT unnest(range(6)) AS corner)""")
def l4b(t):
    cells = _points(t).select("cell_id").distinct()
    corners = cells.select("cell_id", F.posexplode(P.cell_corners("cell_id", RES)).alias("corner", "p"))
    return corners.select("cell_id", "corner", F.round("p.lat", 6).alias("lat"), F.round("p.lon", 6).alias("lon"))


@query("l5_near_point", f"SELECT diner_idx, round({HAVERSINE_SQL.format(la1='37.55', lo1='126.95', la2='lat', lo2='lon')}, 6) AS km FROM diner WHERE {HAVERSINE_SQL.format(la1='37.55', lo1='126.95', la2='lat', lo2='lon')} <= 5")
def l5(t):
    return P.near_point(t.diner, "lat", "lon", 37.55, 126.95, 5.0).select("diner_idx", F.round("km", 6).alias("km"))


@query("l6_near_pairs", f"""
SELECT x.diner_idx AS a, y.diner_idx AS b, round({HAVERSINE_SQL.format(la1='x.lat', lo1='x.lon', la2='y.lat', lo2='y.lon')}, 6) AS km
FROM diner x JOIN diner y ON x.diner_idx < y.diner_idx AND {HAVERSINE_SQL.format(la1='x.lat', lo1='x.lon', la2='y.lat', lo2='y.lon')} <= 1.0""")
def l6(t):
    return P.near_pairs(t.diner, "diner_idx", "lat", "lon", 1.0).withColumn("km", F.round("km", 6))


STATS_SQL = f"""{CELL_SQL}, rs AS (SELECT diner_idx, count(*) AS n, avg(score) AS m FROM review GROUP BY 1),
 cs AS (SELECT cell_id, count(*) AS diners, CAST(coalesce(sum(n), 0) AS BIGINT) AS reviews, round(avg(m), 2) AS mean_rating FROM pts LEFT JOIN rs USING (diner_idx) GROUP BY 1)"""


def _cell_stats(t):
    rs = t.review.groupBy("diner_idx").agg(F.count("*").alias("n"), F.avg("score").alias("m"))
    pts = _points(t).join(rs, "diner_idx", "left")
    return P.cell_stats(pts, {"diners": F.count("*"), "reviews": F.coalesce(F.sum("n"), F.lit(0)), "mean_rating": F.round(F.avg("m"), 2)}, RES)


@query("l7_cell_statistics", f"WITH {STATS_SQL} SELECT * FROM cs")
def l7(t):
    return _cell_stats(t)


@query("l8_cells_with_stats", f"""
WITH {STATS_SQL}, al AS (SELECT DISTINCT '{RES}_' || (q + dq) || '_' || (r + dr) AS cell_id FROM pts, (SELECT unnest(range(-1, 2)) AS dq), (SELECT unnest(range(-1, 2)) AS dr) WHERE abs(dq + dr) <= 1)
SELECT al.cell_id, coalesce(diners, 0) AS diners, coalesce(reviews, 0) AS reviews, coalesce(mean_rating, 0) AS mean_rating, coalesce(diners, 0) + 1 AS point_count FROM al LEFT JOIN cs USING (cell_id)""")
def l8(t):
    cells = P.ring_cells(_points(t).select("cell_id").distinct(), RES, 1).select(F.col("neighbor").alias("cell_id")).distinct()
    return P.cells_with_stats(cells, _cell_stats(t), "diners")


@query("l9_cell_counts", f"WITH {CELL_SQL} SELECT cell_id, count(*) AS n FROM pts GROUP BY 1")
def l9(t):
    return P.cell_stats(_points(t), {"n": F.count("*")}, RES)


# A pentagon over the diners' area.
AREA = [(37.41, 126.85), (37.45, 127.05), (37.6, 127.08), (37.68, 126.95), (37.55, 126.82)]


def _inside_sql(lat, lon):
    terms = []
    for (a1, o1), (a2, o2) in zip(AREA, [*AREA[1:], AREA[0]]):
        terms.append(f"CAST((({a1} > {lat}) <> ({a2} > {lat})) AND {lon} < {o1} + ({lat} - {a1}) * CAST({(o2 - o1) / (a2 - a1)!r} AS DOUBLE) AS INTEGER)")
    return "(" + " + ".join(terms) + ") % 2 = 1"


def _cover_sql(res):
    s, mx = geo.side(res), geo.metres_per_lon()
    lats, lons = [p[0] for p in AREA], [p[1] for p in AREA]
    r = [int(v * geo.METRES_PER_DEGREE_LAT / (1.5 * s)) for v in (min(lats), max(lats))]
    q = [int(min(lons) * mx / (s * 3 ** 0.5) - r[1] / 2) - 1, int(max(lons) * mx / (s * 3 ** 0.5) - r[0] / 2) + 1]
    la, lo = centre_sql("q", "r", res)
    return f"SELECT '{res}_' || q || '_' || r AS cell_id FROM (SELECT unnest(range({q[0]}, {q[1] + 1})) AS q), (SELECT unnest(range({r[0] - 1}, {r[1] + 2})) AS r) WHERE {_inside_sql(la, lo)}"


@query("l10_cover_area", f"""
WITH cov AS ({_cover_sql(8)}), p8 AS (SELECT '8_' || q || '_' || r AS cell_id, count(*) AS diners FROM ({hex_sql('lat', 'lon', 8, 'diner')}) GROUP BY 1)
SELECT cell_id, coalesce(diners, 0) AS diners FROM cov LEFT JOIN p8 USING (cell_id)""")
def l10(t):
    stats = P.with_cell(t.diner, "lat", "lon", 8).groupBy("cell_id").agg(F.count("*").alias("diners"))
    return P.cover_area(t.spark, AREA, 8).join(stats, "cell_id", "left").fillna(0)


EDGE_SQL = f"""{CELL_SQL}, c AS (SELECT DISTINCT cell_id, q, r FROM pts),
 edges AS (SELECT x.cell_id AS a, y.cell_id AS b, {dist_sql('x.q', 'x.r', 'y.q', 'y.r')} AS km FROM c x JOIN c y ON x.cell_id < y.cell_id
  AND greatest(abs(x.q - y.q), abs(x.r - y.r), abs(x.q + x.r - y.q - y.r)) <= 2 WHERE {dist_sql('x.q', 'x.r', 'y.q', 'y.r')} <= 0.45)"""
COMP_SQL = f"""{EDGE_SQL}, sym AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges),
 reach AS (SELECT cell_id AS id, cell_id AS root FROM c UNION SELECT sym.b, reach.root FROM reach JOIN sym ON sym.a = reach.id),
 comp AS (SELECT id, min(root) AS comp FROM reach GROUP BY 1),
 reg AS (SELECT id AS cell_id, CASE WHEN count(*) OVER (PARTITION BY comp) >= 3 THEN comp ELSE '-1' END AS region FROM comp)"""


def _graph(t):
    from savora.session import materialise

    ids = materialise(_points(t).select("cell_id").distinct())
    return ids, materialise(P.cell_graph(ids, RES, 2, 0.45))


def _regions(t):
    from savora.session import materialise

    ids, edges = _graph(t)
    labels = P.connected_components(ids.select(F.col("cell_id").alias("id")), edges)
    return materialise(P.regions_from_components(labels, 3)), edges


@query("l11_cell_graph", f"WITH {EDGE_SQL} SELECT a, b, round(km, 6) AS km FROM edges")
def l11(t):
    return _graph(t)[1].withColumn("km", F.round("km", 6))


@query("l12_connected_regions", f"WITH RECURSIVE {COMP_SQL} SELECT cell_id, region FROM reg")
def l12(t):
    return _regions(t)[0]


@query("l13_region_diameter", f"""
WITH RECURSIVE {COMP_SQL}, g AS (SELECT region, q, r FROM reg JOIN c USING (cell_id) WHERE region <> '-1')
SELECT x.region, round(max({dist_sql('x.q', 'x.r', 'y.q', 'y.r')}), 6) AS diameter_km FROM g x JOIN g y ON x.region = y.region GROUP BY 1""")
def l13(t):
    return P.region_diameter(_regions(t)[0], RES).withColumn("diameter_km", F.round("diameter_km", 6))


@query("l14_split_oversize")
def l14(t):
    regions, edges = _regions(t)
    return P.split_oversize(regions, edges, RES, 12, 1.5, 2)


@query("l14_split_check", f"""
WITH RECURSIVE {COMP_SQL} SELECT count(*) AS cells, count(*) AS inside, 0::BIGINT AS too_many, 0::BIGINT AS too_wide, 0::BIGINT AS too_few FROM reg""")
def l14_check(t):
    """All cells stay, parts lie inside one region or none, and none has over 12 cells, over 1.5 km or under 2 cells."""
    regions, edges = _regions(t)
    parts = materialise(P.split_oversize(regions, edges, RES, 12, 1.5, 2))
    real = parts.where("region <> '-1'")
    sizes = real.groupBy("region").agg(F.count("*").alias("n"))
    old = parts.join(regions.withColumnRenamed("region", "old"), "cell_id")
    one = old.groupBy("region").agg(F.count_distinct("old").alias("olds")).where("olds > 1 and region <> '-1'").select("region")
    wide = P.region_diameter(parts, RES).where("diameter_km > 1.5").agg(F.count("*")).scalar()
    inside = old.join(one, "region", "left_anti").agg(F.count("*")).scalar()
    return parts.agg(
        F.count("*").alias("cells"), F.first(inside).alias("inside"), F.first(sizes.where("n > 12").agg(F.count("*")).scalar()).alias("too_many"),
        F.first(wide).alias("too_wide"), F.first(sizes.where("n < 2").agg(F.count("*")).scalar()).alias("too_few"),
    )


ADOPT_SQL = f"""{COMP_SQL}, o AS (SELECT reg.cell_id, q, r FROM reg JOIN c USING (cell_id) WHERE region = '-1'), v AS (SELECT region, q, r FROM reg JOIN c USING (cell_id) WHERE region <> '-1'),
 opt AS (SELECT o.cell_id, v.region, greatest(abs(o.q - v.q), abs(o.r - v.r), abs(o.q + o.r - v.q - v.r)) AS ring, round({dist_sql('o.q', 'o.r', 'v.q', 'v.r')}, 9) AS km
  FROM o JOIN v ON greatest(abs(o.q - v.q), abs(o.r - v.r), abs(o.q + o.r - v.q - v.r)) <= 3 WHERE {dist_sql('o.q', 'o.r', 'v.q', 'v.r')} <= 0.8),
 ad AS (SELECT reg.cell_id, CASE WHEN reg.region = '-1' THEN coalesce(b.region, '-1') ELSE reg.region END AS region FROM reg
  LEFT JOIN (SELECT cell_id, arg_min(region, (ring, km, region)) AS region FROM opt GROUP BY 1) b USING (cell_id))"""


@query("l15_adopt_orphans", f"WITH RECURSIVE {ADOPT_SQL} SELECT cell_id, region FROM ad")
def l15(t):
    return P.adopt_orphans(_regions(t)[0], RES, 0.8)


@query("l16_node_statistics", f"""
WITH RECURSIVE {COMP_SQL}, d AS (SELECT cell_id, count(*) AS degree FROM (SELECT a AS cell_id FROM edges UNION ALL SELECT b FROM edges) GROUP BY 1)
SELECT cell_id, region, coalesce(degree, 0) AS degree, CAST(degree IS NULL AS INTEGER) AS isolated, CAST(region = '-1' AS INTEGER) AS orphan FROM reg LEFT JOIN d USING (cell_id)""")
def l16(t):
    return P.graph_statistics(*_regions(t))[0]


@query("l16_region_statistics", f"""
WITH RECURSIVE {COMP_SQL}, d AS (SELECT cell_id, count(*) AS degree FROM (SELECT a AS cell_id FROM edges UNION ALL SELECT b FROM edges) GROUP BY 1),
 i AS (SELECT x.region, count(*) AS inner_edges, avg(km) AS mean_km FROM edges JOIN reg x ON x.cell_id = a JOIN reg y ON y.cell_id = b AND x.region = y.region WHERE x.region <> '-1' GROUP BY 1)
SELECT reg.region, count(*) AS cells, round(avg(coalesce(degree, 0)), 6) AS mean_degree, count(*) FILTER (degree IS NULL) AS isolated, coalesce(any_value(inner_edges), 0) AS inner_edges, round(any_value(mean_km), 6) AS mean_km
FROM reg LEFT JOIN d USING (cell_id) LEFT JOIN i ON i.region = reg.region GROUP BY 1""")
def l16b(t):
    out = P.graph_statistics(*_regions(t))[1]
    return out.withColumn("mean_degree", F.round("mean_degree", 6)).withColumn("mean_km", F.round("mean_km", 6))


@query("l16_edge_statistics", f"""
WITH RECURSIVE {COMP_SQL} SELECT count(*) AS edges, count(*) FILTER (x.region = y.region AND x.region <> '-1') AS intra_region, round(min(km), 6) AS min_km, round(avg(km), 6) AS mean_km, round(max(km), 6) AS max_km
FROM edges JOIN reg x ON x.cell_id = a JOIN reg y ON y.cell_id = b""")
def l16c(t):
    out = P.edge_statistics(*_regions(t))
    return out.select("edges", "intra_region", *[F.round(c, 6).alias(c) for c in ("min_km", "mean_km", "max_km")])


@query("l17_nearest_anchor", f"""
WITH {CELL_SQL}, c AS (SELECT DISTINCT cell_id, {centre_sql('q', 'r')[0]} AS la, {centre_sql('q', 'r')[1]} AS lo FROM pts),
 an AS (SELECT diner_idx AS anchor, lat AS a_lat, lon AS a_lon FROM diner WHERE middle = 'Brand#3' AND large = 'PROMO'),
 d AS (SELECT cell_id, anchor, round({HAVERSINE_SQL.format(la1='la', lo1='lo', la2='a_lat', lo2='a_lon')}, 9) AS km FROM c, an)
SELECT cell_id, arg_min(anchor, (km, anchor)) AS anchor, round(min(km), 6) AS km FROM d GROUP BY 1""")
def l17(t):
    anchors = t.diner.where("middle = 'Brand#3' and large = 'PROMO'").select(F.col("diner_idx").alias("anchor"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    cells = P.cell_centres(_points(t).select("cell_id").distinct(), RES)
    return P.nearest_anchor(cells, "cell_id", "cell_lat", "cell_lon", anchors).withColumn("km", F.round("km", 6))


@query("l18_item_regions", f"WITH RECURSIVE {COMP_SQL} SELECT diner_idx, coalesce(region, '-1') AS region FROM pts LEFT JOIN reg USING (cell_id)")
def l18(t):
    return P.items_to_regions(_points(t).select("diner_idx", "cell_id"), _regions(t)[0]).select("diner_idx", "region")


SHIFT_SQL = f"(SELECT c_custkey AS customer, 37.4 + {HASH_SQL.format(repr('la|') + ' || c_custkey')} % 3000 / 10000.0::DOUBLE AS lat, 126.8 + {HASH_SQL.format(repr('lo|') + ' || c_custkey')} % 3000 / 10000.0::DOUBLE AS lon FROM customer)"
LOC_SQL = f"""{COMP_SQL}, cu AS ({hex_sql('lat', 'lon', RES, SHIFT_SQL)}), v AS (SELECT region, q, r FROM reg JOIN c USING (cell_id) WHERE region <> '-1'),
 m AS (SELECT customer, region, greatest(abs(cu.q - v.q), abs(cu.r - v.r), abs(cu.q + cu.r - v.q - v.r)) AS ring FROM cu JOIN v ON greatest(abs(cu.q - v.q), abs(cu.r - v.r), abs(cu.q + cu.r - v.q - v.r)) <= 5),
 loc AS (SELECT cu.customer, coalesce(b.region, '-1') AS region, CAST(coalesce(b.ring, -1) AS INTEGER) AS ring FROM cu LEFT JOIN (SELECT customer, arg_min(region, (ring, region)) AS region, min(ring) AS ring FROM m GROUP BY 1) b USING (customer))"""


def _customers(t):
    from savora.functions.hashing import hash_int

    k = F.col("c_custkey")
    return t.raw("customer").select(
        k.alias("customer"), (F.lit(37.4) + (hash_int("la", k) % 3000) / F.lit(10000.0)).alias("lat"), (F.lit(126.8) + (hash_int("lo", k) % 3000) / F.lit(10000.0)).alias("lon")
    )


@query("l19_locate_points", f"WITH RECURSIVE {LOC_SQL} SELECT customer, region, ring FROM loc")
def l19(t):
    return P.locate_points(_customers(t), "customer", "lat", "lon", _regions(t)[0], RES)


@query("l20_items_near_point", f"""
WITH RECURSIVE {LOC_SQL} SELECT customer, loc.region, ring, CAST(ring > 0 AS INTEGER) AS fallback, diner_idx FROM loc JOIN (SELECT diner_idx, region FROM pts JOIN reg USING (cell_id)) i ON i.region = loc.region WHERE loc.region <> '-1'""")
def l20(t):
    regions = _regions(t)[0]
    items = P.items_to_regions(_points(t).select("diner_idx", "cell_id"), regions).select("diner_idx", "region")
    located = P.locate_points(_customers(t), "customer", "lat", "lon", regions, RES)
    return P.region_items(_customers(t), "customer", located, items).select("customer", "region", "ring", "fallback", "diner_idx")


@query("l21_region_distribution", f"""
WITH RECURSIVE {COMP_SQL}, i AS (SELECT diner_idx, coalesce(region, '-1') AS region FROM pts LEFT JOIN reg USING (cell_id))
SELECT region, count(*) AS items, round(100.0::DOUBLE * (SELECT count(*) FROM i WHERE region <> '-1') / (SELECT count(*) FROM i), 6) AS mapped_pct FROM i WHERE region <> '-1' GROUP BY 1 ORDER BY items DESC, region LIMIT 10""")
def l21(t):
    return P.region_distribution(P.items_to_regions(_points(t).select("diner_idx", "cell_id"), _regions(t)[0]))


@query("l22_build_regions")
def l22(t):
    """Area cover to final regions, with each region's cells and diners."""
    cells = P.cells_with_stats(_points(t).select("cell_id").distinct(), _cell_stats(t), "diners")
    regions, _ = P.build_regions(cells, RES, 2, 0.45, 12, 1.5, 3)
    return regions.join(cells, "cell_id").groupBy("region").agg(F.count("*").alias("cells"), F.sum("diners").alias("diners"), F.sum("reviews").alias("reviews"))


@query("l22_region_totals", f"""
WITH {EDGE_SQL} SELECT (SELECT count(*) FROM c) AS cells, (SELECT count(*) FROM pts) AS diners, 0::BIGINT AS twice""")
def l22_totals(t):
    """Built regions hold every cell and every diner, none of them twice."""
    regions, _ = P.build_regions(_points(t).select("cell_id").distinct(), RES, 2, 0.45, 12, 1.5, 3)
    regions = materialise(regions)
    twice = regions.groupBy("cell_id").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*")).scalar()
    diners = _points(t).join(regions, "cell_id").agg(F.count("*")).scalar()
    return regions.agg(F.count("*").alias("cells"), F.first(diners).alias("diners"), F.first(twice).alias("twice"))


@query("l23_region_sizes", f"""
WITH RECURSIVE {COMP_SQL}, s AS (SELECT region, count(*) AS n FROM reg WHERE region <> '-1' GROUP BY 1)
SELECT count(*) AS regions, min(n) AS min_cells, round(avg(n), 6) AS mean_cells, max(n) AS max_cells FROM s""")
def l23(t):
    return P.region_sizes(_regions(t)[0]).withColumn("mean_cells", F.round("mean_cells", 6))
