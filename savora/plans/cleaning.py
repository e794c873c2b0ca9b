"""B: filters, cleaning, id mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from savora.functions import text as X
from savora.operators import cleaning as C
from savora.operators import ids as I
from savora.operators import places as P
from savora.plans.registry import query

MONTHS = ["2024-03", "2024-04", "2024-11"]
WORDS = ["that", "there", "the", "los", "der", "ing", "and"]
WORD_SQL = ", ".join(f"'{w}'" for w in WORDS)
MONTH_SQL = ", ".join(f"'{m}'" for m in MONTHS)
TOKEN_SQL = "[x for x in string_split_regex(lower(text), '[^\\p{L}]+') if x <> '']"
ABUSED_SQL = f"""
 SELECT diner_idx FROM (SELECT diner_idx, review_id, unnest(list_intersect({TOKEN_SQL}, [{WORD_SQL}])) AS w
                        FROM docreview WHERE strftime(review_date, '%Y-%m') IN ({MONTH_SQL}))
 GROUP BY 1 HAVING count(DISTINCT w) >= 3 AND count(DISTINCT review_id) >= 2"""


@query("b1_min_activity", """
SELECT reviewer_id, count(*) AS n FROM review GROUP BY 1 HAVING count(*) >= 40""")
def b1(t):
    return C.min_activity(t.review, 40).groupBy("reviewer_id").agg(F.count("*").alias("n"))


@query("b2_keep_common_ids", """
SELECT 'diner' AS side, diner_idx, count(*) AS n FROM diner WHERE diner_idx IN (SELECT diner_idx FROM review) GROUP BY 1, 2
UNION ALL SELECT 'review', diner_idx, count(*) FROM review WHERE diner_idx IN (SELECT diner_idx FROM diner) GROUP BY 1, 2""")
def b2(t):
    diner, review = C.keep_common(t.diner, t.review, "diner_idx")
    one = lambda df, side: df.groupBy("diner_idx").agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "diner_idx", "n")
    return one(diner, "diner").unionByName(one(review, "review"))


@query("b3_replace_categories", """
SELECT d.diner_idx, name, coalesce(c.large, 'NA') AS large, coalesce(c.middle, 'NA') AS middle
FROM diner d LEFT JOIN (SELECT diner_idx, large, middle FROM diner WHERE diner_idx % 7 <> 0) c ON d.diner_idx = c.diner_idx""")
def b3(t):
    processed = t.diner.where("diner_idx % 7 <> 0").select("diner_idx", "large", "middle")
    return C.replace_categories(
        t.diner.select("diner_idx", "name", "large", "middle"), processed, "diner_idx", ["large", "middle"], ["large", "middle"]
    )


@query("b4_fill_dates", """
SELECT review_id, coalesce(TRY_CAST(CASE WHEN diner_idx % 5 = 0 THEN NULL WHEN diner_idx % 5 = 1 THEN 'soon' ELSE strftime(review_date, '%Y-%m-%d') END AS TIMESTAMP), TIMESTAMP '2015-01-01') AS review_date FROM review""")
def b4(t):
    text = F.when(F.col("diner_idx") % 5 == 0, F.lit(None).cast("string")).when(F.col("diner_idx") % 5 == 1, "soon").otherwise(
        F.date_format("review_date", "yyyy-MM-dd")
    )
    return t.review.select("review_id", C.fill_date(text).alias("review_date"))


@query("b5_event_topic_filter", f"""
SELECT review_id, diner_idx, CAST(review_date AS DATE) AS day FROM docreview
WHERE NOT (strftime(review_date, '%Y-%m') IN ({MONTH_SQL}) AND diner_idx IN ({ABUSED_SQL}))""")
def b5(t):
    tokens = X.tokens("text")
    abused = C.abusive_items(t.docreview, tokens, MONTHS, WORDS, 3, 2)
    return C.drop_abused(t.docreview, abused, MONTHS).select("review_id", "diner_idx", F.to_date("review_date").alias("day"))


@query("b6_event_topic_known_ids", f"""
SELECT review_id, diner_idx FROM docreview r
WHERE NOT (strftime(review_date, '%Y-%m') IN ({MONTH_SQL}) AND diner_idx IN (SELECT diner_idx FROM diner WHERE large = 'PROMO'))""")
def b6(t):
    known = t.diner.where("large = 'PROMO'").select("diner_idx")
    return C.drop_abused(t.docreview, known, MONTHS).select("review_id", "diner_idx")


@query("b7_dense_ids", """
SELECT reviewer_id, CAST(row_number() OVER (ORDER BY reviewer_id) - 1 AS BIGINT) AS idx FROM (SELECT DISTINCT reviewer_id FROM review)""")
def b7(t):
    return I.id_mapping(t.review, "reviewer_id", "idx")


@query("b8_shared_id_space", """
WITH i AS (SELECT diner_idx, row_number() OVER (ORDER BY diner_idx) - 1 AS item_idx FROM (SELECT DISTINCT diner_idx FROM train)),
 u AS (SELECT reviewer_id, row_number() OVER (ORDER BY reviewer_id) - 1 + (SELECT count(*) FROM i) AS user_idx FROM (SELECT DISTINCT reviewer_id FROM train))
SELECT review_id, CAST(item_idx AS BIGINT) AS item_idx, CAST(user_idx AS BIGINT) AS user_idx
FROM train JOIN i USING (diner_idx) JOIN u USING (reviewer_id)""")
def b8(t):
    items, users = I.pair_mapping(t.train)
    return I.map_column(
        I.map_column(t.train, items, "diner_idx", "diner_idx", "item_idx"), users, "reviewer_id", "reviewer_id", "user_idx"
    ).select("review_id", "item_idx", "user_idx")


@query("b9_metadata_ids", """
WITH d AS (SELECT diner_idx, middle || '_' || CAST(floor(lat * 20) AS BIGINT) AS meta,
                  [middle || '_' || CAST(floor(lat * 20) AS BIGINT) + 1, middle || '_' || CAST(floor(lat * 20) AS BIGINT) - 1] AS near FROM diner),
 v AS (SELECT meta FROM d UNION SELECT unnest(near) FROM d),
 n AS (SELECT (SELECT count(*) FROM diner) + (SELECT count(*) FROM customer) AS start_at),
 m AS (SELECT meta, row_number() OVER (ORDER BY meta) - 1 + (SELECT start_at FROM n) AS meta_idx FROM v WHERE meta IS NOT NULL),
 a AS (SELECT diner_idx, string_agg(CAST(meta_idx AS VARCHAR), ',' ORDER BY p) AS near_idx
       FROM (SELECT diner_idx, unnest(near) AS meta, generate_subscripts(near, 1) AS p FROM d) JOIN m USING (meta) GROUP BY 1)
SELECT d.diner_idx, CAST(m.meta_idx AS BIGINT) AS meta_idx, a.near_idx FROM d LEFT JOIN m ON d.meta = m.meta LEFT JOIN a ON d.diner_idx = a.diner_idx""")
def b9(t):
    row = F.floor(F.col("lat") * 20).cast("long")
    label = lambda k: F.concat(F.col("middle"), F.lit("_"), k.cast("string"))
    d = t.diner.select(
        "diner_idx", label(row).alias("meta"),
        F.filter(F.array(label(row + 1), label(row - 1)), lambda x: x.isNotNull()).alias("near"),
    )
    start = t.raw("part").agg(F.count("*")).scalar() + t.raw("customer").agg(F.count("*")).scalar()
    mapping = I.metadata_mapping(d, "meta", "near", start)
    out = I.map_column(I.map_array(d, "diner_idx", "near", mapping, "meta", "meta_idx", "near_ids"), mapping, "meta", "meta", "meta_idx")
    return out.select(
        "diner_idx", "meta_idx", F.array_join(F.transform("near_ids", lambda x: x.cast("string")), ",").alias("near_idx")
    )


PINNED_SQL = "SELECT 'guest_' || c_mktsegment AS guest, c_custkey % 200 AS diner_idx, CAST(c_custkey % 5 + 1 AS INTEGER) AS score FROM customer WHERE c_acctbal > 9000"


@query("b10_pinned_users", f"""
WITH picks AS (SELECT DISTINCT guest, diner_idx, score FROM ({PINNED_SQL})),
 m AS (SELECT reviewer_id, row_number() OVER (ORDER BY reviewer_id) - 1 AS idx FROM (SELECT DISTINCT reviewer_id FROM train)),
 g AS (SELECT guest, row_number() OVER (ORDER BY guest) + (SELECT max(idx) FROM m) AS idx FROM (SELECT DISTINCT guest FROM picks))
SELECT CAST(idx AS BIGINT) AS user_idx, diner_idx, score, review_id, review_date FROM train JOIN m USING (reviewer_id)
UNION ALL SELECT CAST(idx AS BIGINT), diner_idx, score, -1, TIMESTAMP '2024-12-31' FROM picks JOIN g USING (guest) WHERE diner_idx IN (SELECT diner_idx FROM diner)""")
def b10(t):
    picks = t.raw("customer").where("c_acctbal > 9000").select(
        F.concat(F.lit("guest_"), "c_mktsegment").alias("guest"), (F.col("c_custkey") % 200).alias("diner_idx"),
        (F.col("c_custkey") % 5 + 1).cast("int").alias("score"),
    ).distinct()
    picks = picks.join(t.diner.select("diner_idx"), "diner_idx", "left_semi")
    users = I.id_mapping(t.train, "reviewer_id", "idx").select(F.col("reviewer_id").cast("string").alias("who"), "idx")
    mapping, _ = I.append_users(users, picks.select(F.col("guest").alias("who")).distinct(), "who", "idx")
    rows = t.train.select(F.col("reviewer_id").cast("string").alias("who"), "diner_idx", "score", "review_id", "review_date")
    extra = I.pseudo_reviews(picks.withColumnRenamed("guest", "who"), "2024-12-31")
    return rows.unionByName(extra).join(mapping, "who").select(
        F.col("idx").alias("user_idx"), "diner_idx", "score", "review_id", "review_date"
    )


@query("b11_reverse_mapping", """
SELECT DISTINCT diner_idx, name FROM review JOIN diner USING (diner_idx)""")
def b11(t):
    m = I.id_mapping(t.review, "diner_idx", "idx")
    coded = I.map_column(t.review, m, "diner_idx", "diner_idx", "idx").select("idx").distinct()
    return coded.join(m, "idx").join(t.diner, "diner_idx").select("diner_idx", "name")


@query("b12_coordinate_hygiene", """
SELECT diner_idx, CAST(coalesce(TRY_CAST(review_count_txt AS DOUBLE), 0) AS DOUBLE) AS review_count, round(TRY_CAST(lat_txt AS DOUBLE), 6) AS lat, round(lon, 6) AS lon
FROM diner_raw WHERE TRY_CAST(lat_txt AS DOUBLE) BETWEEN 37.45 AND 37.65 AND lon BETWEEN 126.85 AND 127.05""")
def b12(t):
    d = t.diner_raw.select("diner_idx", F.col("review_count_txt").alias("review_count"), F.col("lat_txt").alias("lat"), "lon")
    return C.coordinate_hygiene(d, "lat", "lon", (37.45, 37.65, 126.85, 127.05), ["review_count"]).select(
        "diner_idx", "review_count", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon")
    )


@query("b13_keep_first", """
SELECT reviewer_id, diner_idx, score, review_id, review_date FROM (
 SELECT *, row_number() OVER (PARTITION BY reviewer_id, diner_idx ORDER BY review_date, review_id) AS rn FROM review) WHERE rn = 1""")
def b13(t):
    return C.keep_first(t.review, ["reviewer_id", "diner_idx"], ["review_date", "review_id"])


@query("b14_address_filter", """
SELECT diner_idx, address FROM diner WHERE contains(address, 'CHINA') OR contains(name, 'old')""")
def b14(t):
    return t.diner.where(C.address_contains("CHINA", "address") | C.address_contains("old", "name")).select("diner_idx", "address")


@query("b15_month_filter", """
SELECT review_id, CAST(review_date AS DATE) AS day FROM review WHERE strftime(review_date, '%Y-%m') IN ('1998-06', '1999-12')""")
def b15(t):
    return t.review.where(C.in_months("review_date", ["1998-06", "1999-12"])).select("review_id", F.to_date("review_date").alias("day"))


@query("b16_mean_per_pair", """
SELECT reviewer_id, diner_idx, round(avg(score), 6) AS mean_score FROM review GROUP BY 1, 2""")
def b16(t):
    return C.mean_per_pair(t.review, "reviewer_id", "diner_idx", "score").withColumn("mean_score", F.round("mean_score", 6))
