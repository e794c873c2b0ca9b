import math
import random
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

from savora.functions import geo
from savora.operators import places as P


def hav(a, b):
    la1, lo1, la2, lo2 = map(math.radians, (*a, *b))
    h = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(h))


def _points(spark, n=200):
    rng = random.Random(13)
    pts = {i: (37.5 + rng.random() / 10, 127 + rng.random() / 10) for i in range(n)}
    return pts, spark.createDataFrame([(i, a, b) for i, (a, b) in pts.items()], "id long, lat double, lon double")


def test_near_pairs_match_brute_force(spark):
    pts, df = _points(spark)
    for km in (0.4, 2.0):
        want = {(a, b) for a in pts for b in pts if a < b and hav(pts[a], pts[b]) <= km}
        got = [(r["a"], r["b"]) for r in P.near_pairs(df, "id", "lat", "lon", km).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_points_lie_in_their_cell(spark):
    _, df = _points(spark)
    q, r = geo.axial(F.col("lat"), F.col("lon"), 9)
    la, lo = geo.centre(q, r, 9)
    far = df.select(F.max(geo.haversine_km("lat", "lon", la, lo)).alias("m")).collect()[0]["m"]
    assert far <= geo.side(9) / 1000 * 1.02
    assert len(geo.disk_offsets(1)) == 7 and len(geo.disk_offsets(2, True)) == 12


def _block(spark, w, h):
    rows = [(f"9_{q}_{r}",) for q in range(w) for r in range(20000, 20000 + h)]
    return spark.createDataFrame(rows, "cell_id string")


def test_components_match_union_find(spark):
    rng = random.Random(14)
    nodes = [f"n{i:03d}" for i in range(80)]
    edges = [tuple(sorted(rng.sample(nodes, 2))) for _ in range(60)] + [(nodes[i], nodes[i + 1]) for i in range(30)]
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = P.connected_components(spark.createDataFrame([(n,) for n in nodes], "id string"), spark.createDataFrame(edges, "a string, b string"))
    assert {r["id"]: r["comp"] for r in got.collect()} == {n: find(n) for n in nodes}


def test_split_and_diameter(spark):
    cells = _block(spark, 9, 7)
    edges = P.cell_graph(cells, 9, 1, 1.0)
    one = cells.withColumn("region", F.lit("all"))
    far = P.region_diameter(one, 9).collect()[0]["diameter_km"]
    pts = [(geo.side(9) * 1.5 * r / geo.METRES_PER_DEGREE_LAT, geo.side(9) * 3**0.5 * (q + r / 2) / geo.metres_per_lon()) for q in range(9) for r in range(20000, 20007)]
    assert abs(far - max(hav(a, b) for a in pts for b in pts)) < 1e-6
    out = P.split_oversize(one, edges, 9, 10, 1.5, 2)
    sizes = Counter(r["region"] for r in out.collect())
    assert sum(sizes.values()) == 63 and max(sizes.values()) <= 10
    assert all(r["diameter_km"] <= 1.5 for r in P.region_diameter(out, 9).collect())


def test_diameter_by_merged_hulls(spark):
    """Regions of any shape, with tiny hulls and with none, against all pairs."""
    r = random.Random(8)
    rows, want = [], {}
    for name, n, spread in [("blob", 300, 60), ("thin", 200, 900), ("one", 1, 1), ("two", 2, 50), ("row", 40, 0)]:
        spots = {(r.randint(0, 3 if name == "thin" else 60), 9000 + r.randint(0, spread)) for _ in range(n)}
        rows += [(geo_cell(q, k), name) for q, k in spots]
        pts = [(geo.side(9) * 1.5 * k / geo.METRES_PER_DEGREE_LAT, geo.side(9) * 3**0.5 * (q + k / 2) / geo.metres_per_lon()) for q, k in spots]
        want[name] = max(hav(a, b) for a in pts for b in pts)
    cells = spark.createDataFrame(rows + [(geo_cell(1, 1), "-1")], "cell_id string, region string")
    for small, per_hull in [(0, 5), (3, 64), (256, 2048)]:
        got = {x["region"]: x["diameter_km"] for x in P.region_diameter(cells, 9, small=small, rows_per_hull=per_hull).collect()}
        assert set(got) == set(want)
        assert all(abs(got[k] - want[k]) < 1e-7 for k in want)
    kept = P._hull()(pd.DataFrame({"la": [37.0, 37.0, 37.1, 37.1, 37.05], "lo": [127.0, 127.1, 127.0, 127.1, 127.05]}))
    assert sorted(kept.index) == [0, 1, 2, 3]


def geo_cell(q, r):
    return f"9_{q}_{r}"


def test_missing_coordinates_are_at_no_distance(spark):
    df = spark.createDataFrame([(1, 37.0, 127.0), (2, None, 127.0)], "id long, lat double, lon double")
    assert [r[0] for r in df.orderBy("id").select(geo.haversine_km("lat", "lon", 37.0, 127.0)).collect()] == [0.0, None]
    assert df.limit(1).select(geo.haversine_km(0.0, 0.0, 0.0, 180.0)).first()[0] > 20015
    anchors = spark.createDataFrame([(7, None, None), (9, 38.0, 127.0)], "anchor long, a_lat double, a_lon double")
    got = {r["id"]: (r["anchor"], r["km"] is None) for r in P.nearest_anchor(df, "id", "lat", "lon", anchors).collect()}
    assert got == {1: (9, False), 2: (None, True)}


def test_orphans_join_the_nearest_region(spark):
    rows = [("9_0_0", "A"), ("9_1_0", "A"), ("9_3_0", "-1"), ("9_5_0", "B"), ("9_20_0", "-1"), ("9_4_0", "-1")]
    got = {r["cell_id"]: r["region"] for r in P.adopt_orphans(spark.createDataFrame(rows, "cell_id string, region string"), 9, 5.0).collect()}
    assert got == {"9_0_0": "A", "9_1_0": "A", "9_3_0": "A", "9_5_0": "B", "9_20_0": "-1", "9_4_0": "B"}


def test_nearest_anchor_over_blocks(spark):
    pts, df = _points(spark, 60)
    anchors = {1000 + i: (37.5 + i / 400, 127 + (i * 7 % 13) / 150) for i in range(25)}
    a = spark.createDataFrame([(k, *v) for k, v in anchors.items()], "anchor long, a_lat double, a_lon double")
    got = {r["id"]: r["anchor"] for r in P.nearest_anchor(df, "id", "lat", "lon", a, per_block=4).collect()}
    assert got == {i: min(anchors, key=lambda k: (round(hav(p, anchors[k]), 9), k)) for i, p in pts.items()}


def test_cover_counts_area(spark):
    box = [(37.5, 127.0), (37.5, 127.1), (37.6, 127.1), (37.6, 127.0)]
    n = P.cover_area(spark, box, 8).count()
    area = 0.1 * geo.METRES_PER_DEGREE_LAT * 0.1 * geo.metres_per_lon()
    assert abs(n - area / (1.5 * 3**0.5 * geo.side(8) ** 2)) / n < 0.05


def test_near_rows_at_high_latitudes_and_the_date_line(spark):
    import math
    import random

    rng = random.Random(4)

    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * geo.EARTH_RADIUS_KM * math.asin(math.sqrt(h))

    spots = [(64.0, 25.0), (-17.0, 180.0), (-17.0, -180.0), (89.99, 40.0), (0.0, 0.0)]
    rows = []
    for a, b in spots:
        for _ in range(25):
            lon = b + rng.uniform(-0.12, 0.12) / math.cos(math.radians(min(a, 89)))
            rows.append((len(rows), min(90.0, a + rng.uniform(-0.06, 0.06)), (lon + 180) % 360 - 180))
    df = spark.createDataFrame(rows + [(999, None, 1.0)], "id long, lat double, lon double")
    for a, b in spots:
        want = {i for i, x, y in rows if km(a, b, x, y) <= 5}
        assert {r["id"] for r in P.near_point(df, "lat", "lon", a, b, 5.0).collect()} == want
    want = {(i, j) for i, x, y in rows for j, u, v in rows if i < j and km(x, y, u, v) <= 5}
    got = [(r["a"], r["b"]) for r in P.near_pairs(df, "id", "lat", "lon", 5.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_near_pairs_compare_lines_before_arcs(spark):
    """Points a metre, a walk and half the globe apart, also equal ones and ones without coordinates; arcs are measured last."""
    r = random.Random(12)
    rows = [(i, 37.5 + r.random() * 3e-5, 127.0 + r.random() * 3e-5) for i in range(30)] + [(30 + i, r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(30)]
    rows += [(70, *rows[0][1:]), (71, None, 127.0), (72, 90.0, 0.0), (73, 90.0, 90.0)]
    df = spark.createDataFrame(rows, "id long, la double, lo double")

    def arc(a, b):
        x = [math.radians(v) for v in (*a[1:], *b[1:])]
        h = math.sin((x[2] - x[0]) / 2) ** 2 + math.cos(x[0]) * math.cos(x[2]) * math.sin((x[3] - x[1]) / 2) ** 2
        return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))

    known = [x for x in rows if x[1] is not None]
    for km in (0.001, 0.5, 9000.0):
        out = P.near_pairs(df, "id", "la", "lo", km)
        assert sorted((x["a"], x["b"]) for x in out.collect()) == sorted((a[0], b[0]) for a in known for b in known if a[0] < b[0] and arc(a, b) <= km)
        join = next(x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in x)
        assert "x1#" in join and join.upper().find("ASIN(") in (-1, *range(join.find("x1#"), len(join)))
