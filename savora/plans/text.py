"""O: text operators over documents, menus and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from savora.functions import text as X
from savora.operators import texts as O
from savora.operators.blocks import block_topk
from savora.plans.registry import query

STOP = ["the", "and", "der", "los", "les"]
TOK = "[x for x in string_split_regex(lower(text), '[^\\p{L}]+') if length(x) >= 3 AND x NOT IN ('the', 'and', 'der', 'los', 'les')]"
TF = f"""tf AS (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest({TOK}) AS word FROM documents) GROUP BY 1, 2),
 idf AS (SELECT word, ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1),
 w AS (SELECT doc_id, word, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)) AS weight FROM tf JOIN idf USING (word)),
 tags AS (SELECT * FROM (SELECT doc_id, word, round(weight, 9) AS weight, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, word) AS place FROM w) WHERE place <= 5)"""


def _docs(t):
    return t.raw("documents").select("doc_id", "text")


def _tokens():
    return X.tokens("text", STOP, 3)


def _tfidf(t):
    return O.tfidf(_docs(t), "doc_id", "text", STOP, 3)


@query("o1_normalise_texts", """
SELECT min(review_id) AS review_id, diner_idx, reviewer_id, md5(clean) AS clean_md5, length(clean) AS n_chars FROM (
 SELECT review_id, diner_idx, reviewer_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[\\r\\n]+', ' ', 'g'), '[^\\p{L}\\p{N}_ ]', '', 'g'), ' +', ' ', 'g')) AS clean FROM docreview)
WHERE clean <> '' GROUP BY diner_idx, reviewer_id, clean""")
def o1(t):
    out = O.normalised_texts(t.docreview, "review_id", "text", ["diner_idx", "reviewer_id"])
    return out.select("review_id", "diner_idx", "reviewer_id", F.md5("clean").alias("clean_md5"), F.length("clean").cast("long").alias("n_chars"))


@query("o2_tokens", f"SELECT doc_id, CAST(len(l) AS BIGINT) AS n_tokens, md5(array_to_string(l, ' ')) AS tokens_md5 FROM (SELECT doc_id, {TOK} AS l FROM documents)")
def o2(t):
    return _docs(t).select("doc_id", F.size(_tokens()).cast("long").alias("n_tokens"), F.md5(F.array_join(_tokens(), " ")).alias("tokens_md5"))


@query("o3_tfidf", f"WITH {TF} SELECT doc_id, word, round(weight, 6) AS weight FROM w")
def o3(t):
    return _tfidf(t)[0].select("doc_id", "word", F.round("weight", 6).alias("weight"))


@query("o4_top_tags", f"WITH {TF} SELECT doc_id, word, CAST(place AS INTEGER) AS place FROM tags")
def o4(t):
    return O.top_tags(_tfidf(t)[0], "doc_id", 5).select("doc_id", "word", "place")


@query("o5_word_totals", f"WITH {TF} SELECT word, round(sum(weight), 6) AS total FROM w GROUP BY 1")
def o5(t):
    return O.word_totals(_tfidf(t)[0]).withColumn("total", F.round("total", 6))


MARKERS = {"english": ("the", "EN"), "german": ("der", "DE")}


@query("o6_keyword_markers", """
SELECT doc_id, CASE WHEN contains(text, 'the') THEN 'EN' END AS english, CASE WHEN contains(text, 'der') THEN 'DE' END AS german, md5(replace(replace(text, 'the', ''), 'der', '')) AS rest_md5 FROM documents""")
def o6(t):
    return O.markers(_docs(t), "text", MARKERS).select("doc_id", "english", "german", F.md5("text").alias("rest_md5"))


COS = f"""{TF}, kt AS (SELECT doc_id, word, idf FROM tags JOIN idf USING (word)), kn AS (SELECT doc_id, sqrt(sum(idf * idf)) AS n FROM kt GROUP BY 1),
 cs AS (SELECT kt.doc_id, round(sum(w.weight * kt.idf / n), 6) AS cosine FROM kt JOIN kn USING (doc_id) JOIN w ON w.doc_id = kt.doc_id AND w.word = kt.word GROUP BY 1)"""


def _cosine(t):
    weights, idf = _tfidf(t)
    keywords = O.top_tags(weights, "doc_id", 5).select("doc_id", "word")
    return O.keyword_cosine(weights, keywords, idf, "doc_id").withColumn("cosine", F.round("cosine", 6))


@query("o7_keyword_cosine", f"WITH {COS} SELECT doc_id, cosine, CAST(cosine < 0.3 AS INTEGER) AS low FROM cs")
def o7(t):
    return _cosine(t).withColumn("low", (F.col("cosine") < 0.3).cast("int"))


@query("o7_cosine_summary", f"WITH {COS} SELECT count(*) AS n, round(avg(cosine), 6) AS mean, round(stddev_samp(cosine), 5) AS std, min(cosine) AS min, round(quantile_cont(cosine, 0.5), 6) AS median, max(cosine) AS max FROM cs")
def o7b(t):
    from savora.functions.ordering import quantiles
    from savora.session import materialise

    cs = materialise(_cosine(t))
    med = quantiles(cs, [], "cosine", {"median": 0.5}).select("median").scalar()
    return cs.agg(
        F.count("*").alias("n"), F.round(F.avg("cosine"), 6).alias("mean"), F.round(F.stddev_samp("cosine"), 5).alias("std"), F.min("cosine").alias("min"), F.max("cosine").alias("max")
    ).withColumn("median", F.round(med, 6))


SENT = """sents AS (SELECT doc_id, place, s AS sentence FROM (SELECT doc_id, generate_subscripts(l, 1) - 1 AS place, trim(unnest(l)) AS s FROM (
 SELECT doc_id, string_split_regex(text, '[.!?\\n]+') AS l FROM documents)) WHERE length(s) >= 10)"""


def _sentences(t):
    return O.sentence_rows(_docs(t), ["doc_id"], "text")


@query("o8_sentences", f"WITH {SENT} SELECT doc_id, CAST(place AS INTEGER) AS place, md5(sentence) AS sentence_md5, length(sentence) AS n_chars FROM sents")
def o8(t):
    return _sentences(t).select("doc_id", "place", F.md5("sentence").alias("sentence_md5"), F.length("sentence").cast("long").alias("n_chars"))


@query("o9_menu_mentions", f"""
WITH {SENT}, m AS (SELECT DISTINCT unnest(menus) AS menu FROM diner) SELECT doc_id, CAST(place AS INTEGER) AS place, menu FROM sents JOIN m ON contains(sentence, menu)""")
def o9(t):
    menus = t.diner.select(F.explode("menus").alias("menu")).distinct()
    return O.mentions(_sentences(t), ["doc_id", "place"], menus)


@query("o10_menus_per_category", "SELECT large, menu, row_number() OVER (PARTITION BY large ORDER BY menu) AS place FROM (SELECT DISTINCT large, unnest(menus) AS menu FROM diner)")
def o10(t):
    return O.sorted_children(t.diner.select("large", F.explode("menus").alias("menu")), "large", "menu")


@query("o11_menu_counter", "SELECT menu, count(*) AS n FROM (SELECT unnest(menus) AS menu FROM diner) GROUP BY 1 HAVING count(*) >= 250")
def o11(t):
    return O.menu_counter(t.diner.select(F.explode("menus").alias("menu")), 250)


@query("o12_item_documents", """
WITH l AS (SELECT diner_idx, string_agg(text, chr(10) || '---' || chr(10) ORDER BY review_date DESC, review_id DESC) AS reviews FROM (
  SELECT *, row_number() OVER (PARTITION BY diner_idx ORDER BY review_date DESC, review_id DESC) AS rn FROM docreview WHERE text IS NOT NULL) WHERE rn <= 5 GROUP BY 1),
 d AS (SELECT d.diner_idx, 'name: ' || name || chr(10) || 'category: ' || coalesce(large, '') || chr(10) || 'middle: ' || coalesce(middle, '') || chr(10) || 'menu: ' || array_to_string(menus, ', ') || chr(10)
  || 'address: ' || address || chr(10) || 'reviews:' || chr(10) || coalesce(reviews, 'none') AS document FROM diner d LEFT JOIN l ON l.diner_idx = d.diner_idx)
SELECT diner_idx, md5(document) AS document_md5, length(document) AS n_chars FROM d""")
def o12(t):
    reviews = O.joined_latest(t.docreview, "diner_idx", "text", [F.desc("review_date"), F.desc("review_id")], 5)
    fields = [("name", F.col("name")), ("category", F.col("large")), ("middle", F.col("middle")), ("menu", O.first_menus(F.col("menus"), 10)), ("address", F.col("address"))]
    out = O.item_documents(t.diner, reviews, "diner_idx", fields)
    return out.select("diner_idx", F.md5("document").alias("document_md5"), F.length("document").cast("long").alias("n_chars"))


@query("o13_representative_reviews", """
WITH r AS (SELECT diner_idx, text, score, row_number() OVER (PARTITION BY diner_idx ORDER BY review_date DESC, review_id DESC) AS p FROM docreview WHERE text IS NOT NULL),
 h AS (SELECT diner_idx, text, row_number() OVER (PARTITION BY diner_idx ORDER BY review_date DESC, review_id DESC) + 3 AS p FROM docreview WHERE text IS NOT NULL AND score >= 4),
 u AS (SELECT diner_idx, text, min(p) AS p FROM (SELECT diner_idx, text, p FROM r WHERE p <= 3 UNION ALL SELECT * FROM h WHERE p <= 5) GROUP BY 1, 2)
SELECT diner_idx, md5(string_agg(text, chr(10) || '---' || chr(10) ORDER BY p)) AS reviews_md5, count(*) AS n FROM u GROUP BY 1""")
def o13(t):
    out = O.representative_reviews(t.docreview, "diner_idx", "text", "review_date", "review_id")
    return out.select("diner_idx", F.md5("reviews").alias("reviews_md5"), "n")


@query("o14_first_menus", """
SELECT diner_idx, CASE WHEN menus[1] = menus[2] THEN menus[1] ELSE array_to_string(menus[1:2], ', ') END AS menus FROM diner""")
def o14(t):
    return t.diner.select("diner_idx", O.first_menus(F.col("menus"), 2).alias("menus"))


@query("o15_vector_search", """
WITH n AS (SELECT vec_id, [x::DOUBLE for x in embedding] AS v, sqrt(list_sum([x::DOUBLE * x::DOUBLE for x in embedding])) AS norm FROM embeddings),
 s AS (SELECT a.vec_id AS query_id, b.vec_id AS item, round(list_dot_product(a.v, b.v) / (a.norm * b.norm), 6) AS score FROM n a JOIN n b ON a.vec_id <> b.vec_id)
SELECT query_id, item, score, CAST(pos AS INTEGER) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS pos FROM s) WHERE pos <= 10""")
def o15(t):
    e = t.raw("embeddings")
    q = e.select(F.col("vec_id").alias("user"), F.col("embedding").alias("vec"))
    i = e.select(F.col("vec_id").alias("item"), F.col("embedding").alias("vec"))
    return block_topk(q, i, 10, normalise=True, skip_same=True).withColumnRenamed("user", "query_id")


@query("o16_cluster_representatives", """
SELECT cluster, arg_min(small, (-n, small)) AS representative, max(n) AS n FROM (SELECT CAST(detail AS INTEGER) % 7 - 1 AS cluster, small, count(*) AS n FROM diner GROUP BY 1, 2) WHERE cluster <> -1 GROUP BY 1""")
def o16(t):
    rows = t.diner.select((F.col("detail").cast("int") % 7 - 1).alias("cluster"), "small")
    return O.cluster_representatives(rows, "cluster", "small")
