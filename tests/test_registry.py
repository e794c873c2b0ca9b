import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PICK = ["a5_schema_violations", "b10_pinned_users", "c8_simplify_process", "d3_stratified_split", "e20_user_combined_score", "f2_popular_recommender",
        "g6_user_recommendation", "h5_bias_baseline", "i5_random_walks", "j12_diversity_rerank", "k5_warm_cold_rollup", "l15_adopt_orphans", "m16_monthly_mean",
        "n12_seasonal_spearman", "o7_keyword_cosine"]
NAMES = list(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else PICK


def norm(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda v: float(f"{v:.8g}") + 0.0 if isinstance(v, float) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert norm([tuple(r) for r in df.collect()], df.columns) == norm(cur.fetchall(), names)


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
