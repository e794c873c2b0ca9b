"""A: scans, sources, sinks, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from savora.operators import cleaning as C
from savora.operators import places as P
from savora.plans.features import hex_sql
from savora.plans.registry import query
from savora.session import scratch_path
from savora.sources import files


@query("a1_load_review_log", """
SELECT review_id, r.reviewer_id, diner_idx, score, badge_level, badge_grade, round(reviewer_avg, 6) AS reviewer_avg
FROM review r LEFT JOIN reviewer u ON r.reviewer_id = u.reviewer_id""")
def a1(t):
    return files.review_log(t.review, t.reviewer).select(
        "review_id", "reviewer_id", "diner_idx", "score", "badge_level", "badge_grade",
        F.round("reviewer_avg", 6).alias("reviewer_avg"),
    )


@query("a2_dataset_in_memory", """
SELECT 'review' AS frame, count(*) AS n_rows FROM review UNION ALL SELECT 'reviewer', count(*) FROM customer
UNION ALL SELECT 'diner', count(*) FROM part UNION ALL SELECT 'category', count(*) FROM part""")
def a2(t):
    category = t.diner.select("diner_idx", "large", "middle", "small", "detail")
    return files.Dataset(t.review, t.reviewer, t.diner, category).sizes()


@query("a3_subset_scan", """
WITH ids AS (SELECT diner_idx FROM (SELECT diner_idx FROM diner WHERE starts_with(address, 'ASIA') ORDER BY diner_idx LIMIT 100)
             UNION SELECT diner_idx FROM diner WHERE diner_idx IN (3, 5, 8))
SELECT review_id, diner_idx, score FROM review WHERE diner_idx IN (SELECT diner_idx FROM ids)""")
def a3(t):
    return C.subset_scan(t.review, t.diner, "ASIA", 100, [3, 5, 8]).select("review_id", "diner_idx", "score")


@query("a4_pruned_dashboard_load", """
SELECT r.review_id, r.diner_idx, d.large, d.middle, k.term, k.sentiment
FROM docreview r LEFT JOIN keyword k ON r.review_id = k.review_id LEFT JOIN diner d ON r.diner_idx = d.diner_idx""")
def a4(t):
    return (
        t.docreview.select("review_id", "diner_idx")
        .join(t.keyword.select("review_id", "term", "sentiment"), "review_id", "left")
        .join(t.diner.select("diner_idx", "large", "middle"), "diner_idx", "left")
    )


@query("a5_schema_violations", """
SELECT 'diner' AS table_name, * FROM (
 SELECT 'diner_idx' AS "column", 'not_null' AS rule, count(*) FILTER (diner_idx IS NULL) AS violations FROM diner
 UNION ALL SELECT 'middle', 'not_null', count(*) FILTER (middle IS NULL) FROM diner
 UNION ALL SELECT 'lat', 'range', count(*) FILTER (NOT lat BETWEEN 37.41 AND 37.69) FROM diner
 UNION ALL SELECT 'prices', 'list_range', count(*) FILTER (len([x for x in prices if NOT (x BETWEEN 0 AND 1000)]) > 0) FROM diner
 UNION ALL SELECT 'diner_idx', 'unique', count(diner_idx) - count(DISTINCT diner_idx) FROM diner
 UNION ALL SELECT 'name', 'unique', count(name) - count(DISTINCT name) FROM diner)""")
def a5(t):
    return C.violations(
        t.diner, "diner", not_null=["diner_idx", "middle"], unique=["diner_idx", "name"],
        ranges={"lat": (37.41, 37.69)}, list_ranges={"prices": (0.0, 1000.0)},
    )


@query("a6_coerce_and_parse", """
SELECT diner_idx, CAST(review_count_txt AS BIGINT) AS review_count,
       CASE WHEN menu_txt IS NULL THEN '' ELSE array_to_string(regexp_extract_all(menu_txt, '''([^'']*)''', 1), '|') END AS menus,
       CASE WHEN menu_txt IS NULL THEN 0 ELSE CAST(len(regexp_extract_all(menu_txt, '''([^'']*)''', 1)) AS INTEGER) END AS n_menus
FROM diner_raw WHERE TRY_CAST(review_count_txt AS BIGINT) IS NOT NULL""")
def a6(t):
    menus = C.parse_string_list("menu_txt")
    return C.coerce_count(t.diner_raw, "review_count_txt", "review_count").select(
        "diner_idx", "review_count", F.array_join(menus, "|").alias("menus"), F.size(menus).alias("n_menus")
    )


@query("a7_safe_list_parse", """
SELECT diner_idx, coalesce(array_to_string([x for x in regexp_extract_all(menu_txt, '''([^'']*)''', 1) if x <> ''], '|'), '') AS menus,
       array_to_string(regexp_extract_all(price_txt, '''([0-9]+)''', 1), '|') AS prices
FROM diner_raw""")
def a7(t):
    return t.diner_raw.select(
        "diner_idx",
        F.array_join(C.parse_string_list("menu_txt", drop_empty=True), "|").alias("menus"),
        F.array_join(F.transform(C.parse_int_list("price_txt"), lambda x: x.cast("string")), "|").alias("prices"),
    )


@query("a8_candidate_roundtrip", """
SELECT reviewer_id AS user_id, diner_idx AS diner_id, CAST(sum(score) AS DOUBLE) AS score FROM train GROUP BY 1, 2""")
def a8(t):
    path = scratch_path(t.spark, "candidates")
    cand = t.train.groupBy(F.col("reviewer_id").alias("user_id"), F.col("diner_idx").alias("diner_id")).agg(
        F.sum("score").alias("score")
    )
    files.write_candidates(cand, path)
    return files.read_candidates(t.spark, path)


@query("a9_region_files", """
SELECT cell_id, min(split_part(address, ' ', 1)) AS region_name
FROM (SELECT address, CAST(floor(lat * 50) AS BIGINT) * 100000 + CAST(floor(lon * 50) AS BIGINT) AS cell_id FROM diner) GROUP BY 1""")
def a9(t):
    path = scratch_path(t.spark, "regions")
    cells = t.diner.select(
        (F.floor(F.col("lat") * 50) * 100000 + F.floor(F.col("lon") * 50)).cast("long").alias("cell_id"),
        F.split_part("address", F.lit(" "), F.lit(1)).alias("region_name"),
    ).distinct()
    files.write_regions_csv(cells, path)
    return files.read_regions_csv(t.spark, path, "cell_id long")


@query("a10_geojson_features", f"""
SELECT '9_' || q || '_' || r AS cell_id, count(*) AS n, 'Polygon' AS kind, 7 AS points, 1 AS closed FROM ({hex_sql('lat', 'lon', 9, 'diner')}) GROUP BY 1""")
def a10(t):
    cells = P.cell_stats(P.with_cell(t.diner, "lat", "lon", 9), {"n": F.count("*")}, 9)
    path = scratch_path(t.spark, "geojson")
    files.write_geojson(files.geojson_features(cells, P.cell_corners("cell_id", 9), ["cell_id", "n"]), path)
    back = t.spark.read.schema(
        "type string, geometry struct<type: string, coordinates: array<array<array<double>>>>, properties struct<cell_id: string, n: long>"
    ).json(path)
    ring = F.col("geometry.coordinates")[0]
    return back.select(
        "properties.cell_id", "properties.n", F.col("geometry.type").alias("kind"), F.size(ring).alias("points"),
        (F.element_at(ring, 1) == F.element_at(ring, -1)).cast("int").alias("closed"),
    )


@query("a11_similar_items_json", """
WITH s AS (SELECT diner_idx, middle, score, row_number() OVER (PARTITION BY middle ORDER BY score DESC, diner_idx) AS rn
           FROM (SELECT d.diner_idx, d.middle, avg(r.score) AS score FROM diner d JOIN review r ON d.diner_idx = r.diner_idx
                 WHERE d.middle IS NOT NULL GROUP BY 1, 2))
SELECT middle AS target, '[' || string_agg('[' || diner_idx || ',' || printf('%.2f', floor(score * 100 + 0.5) / 100) || ']', ',' ORDER BY score DESC, diner_idx) || ']' AS similar
FROM s WHERE rn <= 5 GROUP BY 1""")
def a11(t):
    from savora.operators.popularity import top_per_group

    scores = t.review.groupBy("diner_idx").agg(F.avg("score").alias("score")).join(
        t.diner.select("diner_idx", F.col("middle").alias("target")).where("middle is not null"), "diner_idx"
    )
    top = top_per_group(scores, ["target"], [F.desc("score"), F.asc("diner_idx")], 5)
    return files.similar_items_json(top, "target", "diner_idx", "score")


@query("a12_null_profile", """
SELECT 'diner_raw' AS table_name, * FROM (
 SELECT 'null:diner_idx' AS measure, count(*) FILTER (diner_idx IS NULL) AS n FROM diner_raw
 UNION ALL SELECT 'null:review_count_txt', count(*) FILTER (review_count_txt IS NULL) FROM diner_raw
 UNION ALL SELECT 'null:menu_txt', count(*) FILTER (menu_txt IS NULL) FROM diner_raw
 UNION ALL SELECT 'rows', count(*) FROM diner_raw
 UNION ALL SELECT 'duplicate_rows', count(*) - (SELECT count(*) FROM (SELECT DISTINCT diner_idx, review_count_txt, menu_txt FROM diner_raw)) FROM diner_raw
 UNION ALL SELECT 'distinct_keys', count(DISTINCT diner_idx) FROM diner_raw)""")
def a12(t):
    return C.null_profile(t.diner_raw.select("diner_idx", "review_count_txt", "menu_txt"), "diner_raw", "diner_idx")
