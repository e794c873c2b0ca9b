"""Review texts: tokens, TF-IDF, tags, sentences and item documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from savora.functions import text as X
from savora.functions.ordering import bucket_of, prefix_sums, splitters
from savora.operators.popularity import top_per_group
from savora.session import materialise

SHORT_LIST = 256


def normalised_texts(df: DataFrame, key: str, text: str, by: Sequence[str] = ()) -> DataFrame:
    """Clean texts, empty ones dropped, each distinct row of (`by`, text) once under its lowest id. Copies
    are counted away map-side, so one text repeated very often costs one row per task."""
    clean = df.select(key, *by, X.normalise(text).alias("clean")).where(F.col("clean") != "")
    return clean.groupBy(*by, "clean").agg(F.min(key).alias(key)).select(key, *by, "clean")


def term_counts(df: DataFrame, key: str, text: str, stop: Sequence[str] = (), min_length: int = 1, letters: str = X.LETTERS) -> DataFrame:
    """Word counts per document. Stop-words are filtered after the explode, in generated code,
    and counts are combined before the shuffle."""
    rows = df.select(key, F.explode(X.pieces(text, letters)).alias("word")).where(F.length("word") >= min_length)
    if stop:
        rows = rows.where(~F.col("word").isin(list(stop)))
    return rows.groupBy(key, "word").agg(F.count("*").alias("tf"))


def idf_table(counts: DataFrame, n_docs: Column) -> DataFrame:
    """Smoothed inverse document frequency ln((1+n)/(1+df)) + 1."""
    df = counts.groupBy("word").agg(F.count("*").alias("df"))
    return df.select("word", "df", (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def weigh(counts: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """(key, word, weight) with unit length per document."""
    raw = counts.join(idf.select("word", "idf"), "word").select(key, "word", (F.col("tf") * F.col("idf")).alias("__w"))
    # Dealt by text before the squares that the window adds up are made, which else would travel as one more number.
    raw = raw.repartition(F.col(key))
    # A document's group is its own vocabulary, so the window costs one shuffle and no join back.
    norm = F.sqrt(F.sum(F.col("__w") * F.col("__w")).over(W.partitionBy(key)))
    return raw.select(key, "word", (F.col("__w") / norm).alias("weight"))


def tfidf(df: DataFrame, key: str, text: str, stop: Sequence[str] = (), min_length: int = 1) -> tuple[DataFrame, DataFrame]:
    """(weights, idf) over all documents; documents without words count towards n."""
    counts = materialise(term_counts(df, key, text, stop, min_length))
    idf = materialise(idf_table(counts, df.agg(F.count("*")).scalar()))
    return weigh(counts, idf, key), idf


def top_tags(weights: DataFrame, key: str, n: int) -> DataFrame:
    rounded = weights.withColumn("weight", F.round("weight", 9))
    return top_per_group(rounded, [key], [F.desc("weight"), F.asc("word")], n, rank="place")


def word_totals(weights: DataFrame) -> DataFrame:
    return weights.groupBy("word").agg(F.sum("weight").alias("total"))


def markers(df: DataFrame, text: str, rules: dict[str, tuple[str, str]]) -> DataFrame:
    """Per rule (column -> (needle, label)): label where the text holds the needle; the needles
    are then cut out of the text."""
    out = df.select("*", *[F.when(F.col(text).contains(n), label).alias(c) for c, (n, label) in rules.items()])
    cut = F.col(text)
    for needle, _ in rules.values():
        cut = F.replace(cut, F.lit(needle), F.lit(""))
    return out.withColumn(text, cut)


def keyword_cosine(weights: DataFrame, keywords: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """Cosine of each text and its keywords, 0 without a common word. keywords: (key, word).

    All branches group by text, and none reads texts without a key, so that keywords cut from the same weights share
    their shuffle. A text's keywords meet its words as one map: a join on the word too would deal the weights anew.
    """
    known = keywords.where(F.col(key).isNotNull())
    kw = weigh(known.groupBy(key, "word").agg(F.count("*").alias("tf")), idf, key)
    packed = kw.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("word", "weight"))).alias("__k"))
    dots = weights.join(packed, key).groupBy(key).agg(F.sum(F.col("weight") * F.col("__k")[F.col("word")]).alias("cosine"))
    none = keywords.where(F.col(key).isNull()).select(key, F.lit(0.0).alias("cosine")).distinct()
    return known.select(key).distinct().join(dots, key, "left").fillna(0.0, subset=["cosine"]).unionByName(none)


def sentence_rows(df: DataFrame, keys: Sequence[str], text: str, min_length: int = 10) -> DataFrame:
    """One row per sentence of at least `min_length` characters, with its place in the text."""
    return df.select(*keys, F.posexplode(X.sentences(text)).alias("place", "sentence")).where(F.length("sentence") >= min_length)


def mentions(sentences: DataFrame, keys: Sequence[str], menus: DataFrame) -> DataFrame:
    """(keys, menu) for every menu that occurs anywhere in the sentence. menus: (menu).

    A short menu list, checked by count, is tested name by name. A longer one is a trie cut at two letters: a table of
    heads (one letter for names of one letter) with the lengths of the names below each. Every place of a sentence meets
    the lengths of its head only, and the cut pieces meet the names; both are joins, and nothing but the length
    of the longest name, a scalar of the plan, is known beforehand. Null and empty sentences mention nothing.
    """
    menus = materialise(menus.select("menu").where("menu <> ''").distinct())
    if menus.count() <= SHORT_LIST:
        names = menus.agg(F.collect_list("menu")).scalar()
        return sentences.withColumn("__names", names).select(
            *keys, F.explode(F.filter("__names", lambda m: F.col("sentence").contains(m))).alias("menu")
        )
    heads = menus.select(F.substring("menu", 1, 2).alias("head"), F.length("menu").alias("len")).distinct()
    longest = menus.agg(F.max(F.length("menu"))).scalar()
    places = sentences.where("sentence <> ''").select(*keys, F.col("sentence").alias("__s"), F.explode(F.sequence(F.lit(1), F.length("sentence"))).alias("__i"))
    # A name may start at any place, with its own rest of the sentence and no more than the longest name needs. Equal
    # rests of one sentence are one row.
    rests = places.select(*keys, F.substr("__s", "__i", longest).alias("__rest")).distinct()
    headed = rests.withColumn("head", F.explode(F.array_distinct(F.array(F.substring("__rest", 1, 1), F.substring("__rest", 1, 2)))))
    cut = headed.join(heads, "head").where(F.col("len") <= F.length("__rest")).select(*keys, F.substr("__rest", F.lit(1), F.col("len")).alias("menu"))
    return cut.distinct().join(menus, "menu", "left_semi").select(*keys, "menu")


def sorted_children(df: DataFrame, parent: str, child: str) -> DataFrame:
    """Distinct (parent, child) with the child's place in name order, in long form, since a
    category may have any number of menu names."""
    pairs = materialise(df.where(F.col(parent).isNotNull() & F.col(child).isNotNull()).select(parent, child).distinct())
    placed = prefix_sums(pairs, [parent], bucket_of(F.col(child), splitters(pairs, F.col(child))), [F.col(child)], {"place": F.lit(1).cast("long")})
    return placed.withColumn("place", F.col("place") + 1)


def menu_counter(menus: DataFrame, threshold: int) -> DataFrame:
    return menus.groupBy("menu").agg(F.count("*").alias("n")).where(F.col("n") >= threshold)


def joined_latest(
    review: DataFrame, item: str, text: str, order: Sequence[Column], n: int, sep: str = "\n---\n"
) -> DataFrame:
    """Each item's n latest texts, whole, joined newest first; missing texts are skipped."""
    top = top_per_group(review.where(F.col(text).isNotNull()), [item], order, n, rank="__p")
    packed = F.array_sort(F.collect_list(F.struct("__p", F.col(text).alias("t"))))
    return top.groupBy(item).agg(F.array_join(F.transform(packed, lambda s: s["t"]), sep).alias("reviews"))


def item_documents(diner: DataFrame, reviews: DataFrame, item: str, fields: Sequence[tuple[str, Column]]) -> DataFrame:
    """One text per item: "label: value" lines and its reviews."""
    lines = [F.concat(F.lit(f"{label}: "), F.coalesce(value.cast("string"), F.lit(""))) for label, value in fields]
    body = F.concat(F.lit("reviews:\n"), F.coalesce("reviews", F.lit("none")))
    return diner.join(reviews, item, "left").select(item, F.concat_ws("\n", *lines, body).alias("document"))


def representative_reviews(review: DataFrame, item: str, text: str, date: str, tie: str, sep: str = "\n---\n") -> DataFrame:
    """Three latest reviews and the two latest with score 4 or more, repeated texts once."""
    rows = review.where(F.col(text).isNotNull()).select(item, date, tie, "score", F.col(text).alias("t"))
    latest = [F.desc(date), F.desc(tie)]
    a = top_per_group(rows, [item], latest, 3, rank="p").select(item, "p", "t")
    b = top_per_group(rows.where("score >= 4"), [item], latest, 2, rank="p").select(item, (F.col("p") + 3).alias("p"), "t")
    first = a.unionByName(b).groupBy(item, "t").agg(F.min("p").alias("p"))
    packed = F.array_sort(F.collect_list(F.struct("p", "t")))
    return first.groupBy(item).agg(F.array_join(F.transform(packed, lambda s: s["t"]), sep).alias("reviews"), F.count("*").alias("n"))


def first_menus(menus: Column, k: int, sep: str = ", ") -> Column:
    return F.array_join(F.slice(F.array_distinct(menus), 1, k), sep)


def cluster_representatives(df: DataFrame, cluster: str, member: str, noise: int = -1) -> DataFrame:
    """Most frequent member per cluster, ties by name; the noise cluster has none."""
    counts = df.where(F.col(cluster) != noise).groupBy(cluster, member).agg(F.count("*").alias("n"))
    return counts.groupBy(cluster).agg(F.min_by(member, F.struct((-F.col("n")).alias("a"), F.col(member).alias("b"))).alias("representative"), F.max("n").alias("n"))
