"""Canonical views over the test tables, once as DataFrames and once as SQL.

The test tables hold no restaurant reviews, so orders and line items play the review log,
customers the reviewers, parts the diners, events the review keywords, and documents the review
texts. Production callers skip this module and hand their own frames to the operators.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from savora.session import spread

# Half-open split borders: train [0,1), validation [1,2), test [2,3).
SPLIT_DATES = ("1998-06-01", "1999-01-01", "1999-07-01", "2000-01-01")
# Recency features are taken relative to this day instead of the wall clock.
AS_OF = "2001-09-01"
ID_STRIDE = 100_000_000

VIEW_SQL = {
    "review": f"""
        SELECT o.o_custkey AS reviewer_id, l.l_partkey AS diner_idx,
               o.o_orderkey * {ID_STRIDE} + l.l_partkey AS review_id,
               CAST(1 + CAST(max(l.l_quantity) AS INTEGER) % 5 AS INTEGER) AS score,
               max(o.o_orderdate) AS review_date
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
        GROUP BY o.o_custkey, l.l_partkey, o.o_orderkey""",
    "reviewer": """
        SELECT c_custkey AS reviewer_id, c_name AS name, CAST(c_custkey % 5 + 1 AS INTEGER) AS badge_level,
               c_mktsegment AS badge_grade, avg_score AS reviewer_avg
        FROM customer LEFT JOIN (SELECT reviewer_id AS rid, avg(score) AS avg_score FROM review GROUP BY 1) a
        ON c_custkey = a.rid""",
    "diner": """
        SELECT p_partkey AS diner_idx, p_name AS name, p_type AS large,
               CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_brand END AS middle,
               split_part(p_name, ' ', 1) AS small, CAST(p_size AS VARCHAR) AS detail,
               string_split(p_name, ' ') AS menus,
               [p_retailprice, p_retailprice * CAST(1.1 AS DOUBLE), p_retailprice * CAST(0.9 AS DOUBLE)] AS prices,
               37.4 + CAST((p_partkey * 7919) % 3000 AS DOUBLE) / 10000 AS lat,
               126.8 + CAST((p_partkey * 104729) % 3000 AS DOUBLE) / 10000 AS lon,
               r_name || ' ' || n_name AS address
        FROM part JOIN nation ON n_nationkey = p_partkey % 25 JOIN region ON r_regionkey = n_regionkey""",
    "diner_raw": """
        SELECT diner_idx, name,
               CASE WHEN diner_idx % 17 = 0 THEN 'N/A' WHEN diner_idx % 23 = 0 THEN NULL
                    ELSE CAST((diner_idx * 31) % 400 AS VARCHAR) END AS review_count_txt,
               CASE WHEN diner_idx % 13 = 0 THEN NULL
                    ELSE '[''' || replace(name, ' ', ''', ''') || '''' || CASE WHEN diner_idx % 7 = 0 THEN ', ''''' ELSE '' END || ']'
                    END AS menu_txt,
               CASE WHEN diner_idx % 19 = 0 THEN 'broken'
                    ELSE '[''' || CAST(CAST(floor(prices[1]) AS BIGINT) AS VARCHAR) || ''', ''market'', '''
                         || CAST(CAST(floor(prices[2]) AS BIGINT) AS VARCHAR) || ''']' END AS price_txt,
               CASE WHEN diner_idx % 29 = 0 THEN NULL
                    ELSE '[''(taste, ' || CAST(diner_idx % 50 AS VARCHAR) || ')'', ''(mood, ' || CAST(diner_idx % 9 AS VARCHAR)
                         || ')'', ''(taste, ' || CAST(diner_idx % 31 AS VARCHAR) || ')'', ''(view, 4)'']' END AS tag_txt,
               CASE WHEN diner_idx % 37 = 0 THEN 'x' ELSE CAST(lat AS VARCHAR) END AS lat_txt,
               lon
        FROM diner""",
    "keyword": """
        SELECT event_id AS keyword_id, event_id // 10 AS review_id, user_id, event_type AS term,
               CASE WHEN event_id % 41 = 0 THEN NULL ELSE event_type END AS category,
               CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS sentiment, ts
        FROM events""",
    "weather": """
        SELECT CAST(o_orderdate AS DATE) AS day, CAST(floor(avg(o_totalprice) / 10000) AS DOUBLE) AS temp,
               CAST(count(*) % 60 AS DOUBLE) AS rain
        FROM orders GROUP BY 1""",
    "docreview": """
        SELECT doc_id AS review_id, doc_id % 97 AS reviewer_id, doc_id % 200 AS diner_idx,
               CAST(1 + doc_id % 5 AS INTEGER) AS score,
               TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 366 AS INTEGER)) AS review_date, text
        FROM documents""",
    "train": f"""
        SELECT * FROM review WHERE review_date >= TIMESTAMP '{SPLIT_DATES[0]}' AND review_date < TIMESTAMP '{SPLIT_DATES[1]}'""",
    "val": f"""
        SELECT * FROM review WHERE review_date >= TIMESTAMP '{SPLIT_DATES[1]}' AND review_date < TIMESTAMP '{SPLIT_DATES[2]}'""",
    "test": f"""
        SELECT * FROM review WHERE review_date >= TIMESTAMP '{SPLIT_DATES[2]}' AND review_date < TIMESTAMP '{SPLIT_DATES[3]}'""",
}


class Tables:
    """Lazy DataFrames for one folder of test tables; nothing runs until a query does."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._raw: dict[str, DataFrame] = {}
        self._held: set[str] = set()

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._raw[name]

    @cached_property
    def review(self) -> DataFrame:
        return self._reviews(self.raw("orders"))

    @cached_property
    def _lines(self) -> DataFrame:
        li = self.raw("lineitem")
        return spread(li, li.count(), "l_orderkey")

    def _reviews(self, o: DataFrame) -> DataFrame:
        li = self._lines
        return (
            li.join(o, li.l_orderkey == o.o_orderkey)
            .groupBy("o_custkey", "l_partkey", "o_orderkey")
            .agg(F.max("l_quantity").alias("q"), F.max("o_orderdate").alias("review_date"))
            .select(
                F.col("o_custkey").alias("reviewer_id"),
                F.col("l_partkey").alias("diner_idx"),
                (F.col("o_orderkey") * F.lit(ID_STRIDE) + F.col("l_partkey")).alias("review_id"),
                (F.lit(1) + F.col("q").cast("int") % 5).cast("int").alias("score"),
                "review_date",
            )
        )

    @cached_property
    def reviewer(self) -> DataFrame:
        c = self.raw("customer")
        avgs = self.review.groupBy("reviewer_id").agg(F.avg("score").alias("reviewer_avg"))
        return c.select(
            F.col("c_custkey").alias("reviewer_id"),
            F.col("c_name").alias("name"),
            (F.col("c_custkey") % 5 + 1).cast("int").alias("badge_level"),
            F.col("c_mktsegment").alias("badge_grade"),
        ).join(avgs, "reviewer_id", "left")

    @cached_property
    def diner(self) -> DataFrame:
        p, n, r = self.raw("part"), self.raw("nation"), self.raw("region")
        key, price = F.col("p_partkey"), F.col("p_retailprice")
        return (
            p.join(n, n.n_nationkey == key % 25)
            .join(r, r.r_regionkey == n.n_regionkey)
            .select(
                key.alias("diner_idx"),
                F.col("p_name").alias("name"),
                F.col("p_type").alias("large"),
                F.when(key % 11 != 0, F.col("p_brand")).alias("middle"),
                F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)).alias("small"),
                F.col("p_size").cast("string").alias("detail"),
                F.split("p_name", " ").alias("menus"),
                F.array(price, price * 1.1, price * 0.9).alias("prices"),
                (F.lit(37.4) + ((key * 7919) % 3000).cast("double") / 10000).alias("lat"),
                (F.lit(126.8) + ((key * 104729) % 3000).cast("double") / 10000).alias("lon"),
                F.concat_ws(" ", "r_name", "n_name").alias("address"),
            )
        )

    @cached_property
    def diner_raw(self) -> DataFrame:
        key = F.col("diner_idx")

        def text(c: Column) -> Column:
            return c.cast("string")

        return self.diner.select(
            "diner_idx",
            "name",
            F.when(key % 17 == 0, F.lit("N/A"))
            .when(key % 23 == 0, F.lit(None).cast("string"))
            .otherwise(text((key * 31) % 400))
            .alias("review_count_txt"),
            F.when(
                key % 13 != 0,
                F.concat(
                    F.lit("['"), F.replace(F.col("name"), F.lit(" "), F.lit("', '")), F.lit("'"),
                    F.when(key % 7 == 0, F.lit(", ''")).otherwise(F.lit("")), F.lit("]"),
                ),
            ).alias("menu_txt"),
            F.when(key % 19 == 0, F.lit("broken"))
            .otherwise(
                F.concat(
                    F.lit("['"), text(F.floor(F.col("prices")[0]).cast("long")), F.lit("', 'market', '"),
                    text(F.floor(F.col("prices")[1]).cast("long")), F.lit("']"),
                )
            )
            .alias("price_txt"),
            F.when(
                key % 29 != 0,
                F.concat(
                    F.lit("['(taste, "), text(key % 50), F.lit(")', '(mood, "), text(key % 9),
                    F.lit(")', '(taste, "), text(key % 31), F.lit(")', '(view, 4)']"),
                ),
            ).alias("tag_txt"),
            F.when(key % 37 == 0, F.lit("x")).otherwise(text(F.col("lat"))).alias("lat_txt"),
            "lon",
        )

    @cached_property
    def keyword(self) -> DataFrame:
        e = self.raw("events")
        return e.select(
            F.col("event_id").alias("keyword_id"),
            F.floor(F.col("event_id") / 10).cast("long").alias("review_id"),
            "user_id",
            F.col("event_type").alias("term"),
            F.when(F.col("event_id") % 41 != 0, F.col("event_type")).alias("category"),
            (F.get_json_object("props", "$.k").cast("double") / 100).alias("sentiment"),
            "ts",
        )

    @cached_property
    def weather(self) -> DataFrame:
        return (
            self.raw("orders")
            .groupBy(F.to_date("o_orderdate").alias("day"))
            .agg(
                F.floor(F.avg("o_totalprice") / 10000).cast("double").alias("temp"),
                (F.count("*") % 60).cast("double").alias("rain"),
            )
        )

    @cached_property
    def docreview(self) -> DataFrame:
        d = self.raw("documents")
        key = F.col("doc_id")
        return d.select(
            key.alias("review_id"),
            (key % 97).alias("reviewer_id"),
            (key % 200).alias("diner_idx"),
            (F.lit(1) + key % 5).cast("int").alias("score"),
            F.expr("cast(date_add(date'2024-01-01', cast(doc_id % 366 as int)) as timestamp_ntz)").alias("review_date"),
            "text",
        )

    def hold(self, *names: str) -> "Tables":
        """Write the named views once for this query, which reads them several times."""
        from savora.session import materialise

        for name in names:
            if name not in self._held:
                self.__dict__[name] = materialise(getattr(self, name))
                self._held.add(name)
        return self

    def _between(self, i: int) -> DataFrame:
        """Reviews of one split. A review belongs to one order, so the dates filter the orders, where
        the scan can use them, and not the joined and grouped rows."""
        from savora.operators.splits import date_range

        if "review" in self._held:
            return date_range(self.review, SPLIT_DATES[i], SPLIT_DATES[i + 1])
        return self._reviews(date_range(self.raw("orders"), SPLIT_DATES[i], SPLIT_DATES[i + 1], "o_orderdate"))

    @cached_property
    def train(self) -> DataFrame:
        return self._between(0)

    @cached_property
    def val(self) -> DataFrame:
        return self._between(1)

    @cached_property
    def test(self) -> DataFrame:
        return self._between(2)
