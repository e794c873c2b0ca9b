"""Quality rules with thresholds learned per language and source from mergeable quantile sketches.

Native throughout. The sketch is a histogram whose buckets double in width every `SUB` buckets (relative
error 1/32): an integer measure is mapped to the lower edge of its bucket, and a group's sketch is its
table of (edge, count). Sketches merge by adding counts, in any order, so map-side combining splits hot
groups, and reruns agree. Thresholds are quartile fences; groups with few documents use the merged sketch
of their language, then of the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from savora.llm.common import BLANKS, words
from savora.session import materialise

WINDOW = 8
SUB_BITS = 6
MIN_GROUP = 50
FENCE = 3
# Measures in millionths, with the slack that is added to the fence and whether a low value fails as well.
MEASURES = {
    "word_length": (1_000_000, True),
    "symbol_share": (50_000, False),
    "emphasis": (300_000, False),
    "dup_line_share": (300_000, False),
    "repeat_share": (200_000, False),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _count_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts, the measures and `base_failed`; null and empty texts have no words and zero
    counts. Existing columns of the same names are replaced.

    Repeated windows compare 64-bit hashes inside one text.
    """
    keep = [c for c in df.columns if c not in {*COUNTS, *MEASURES, "base_failed"}]
    body = F.coalesce(F.col(text), F.lit(""))
    filled = F.filter(F.split(body, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    step = df.select(*keep, words(F.col(text)).alias("__w"), filled.alias("__lines"), body.alias("__body"))
    step = step.select(
        *keep, "__w", F.size("__w").cast("long").alias("n_words"),
        (F.length("__body") - _count_of(F.col("__body"), BLANKS)).cast("long").alias("word_chars"),
        _count_of(F.col("__body"), "#*$%&|<>").alias("n_symbols"), _count_of(F.col("__body"), "!?").alias("__marks"),
        F.size("__lines").cast("long").alias("__n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
    )
    hashes = F.when(
        F.size("__w") >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.greatest(F.size("__w") - (WINDOW - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(F.col("__w"), i, WINDOW))),
    )
    rest = [c for c in step.columns if c != "__w"]
    step = step.select(*rest, hashes.alias("__h"))
    twice = F.size(F.array_distinct("__h")) < F.size("__h")
    ordered = F.when(twice, F.sort_array(F.transform("__h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    step = step.select(*rest, ordered.alias("__s"))
    s = F.col("__s")
    again = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
    step = step.select(*rest, F.sort_array(F.transform(again, lambda x: x["i"])).alias("__p"))
    p = F.col("__p")
    covered = F.aggregate(F.transform(p, lambda x, i: F.coalesce(F.least(F.get(p, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0).cast("long"), lambda a, b: a + b)
    step = step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("__p")

    def share(top: str, of: str) -> Column:
        return F.when(F.col(of) > 0, F.floor(F.col(top) * 1_000_000 / F.col(of))).otherwise(0).cast("long")

    out = step.select(
        "*", share("word_chars", "n_words").alias("word_length"), share("n_symbols", "word_chars").alias("symbol_share"),
        share("__marks", "n_words").alias("emphasis"), share("n_dup_lines", "__n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
    )
    return out.drop("__marks", "__n_lines")


def edge(value: Column) -> Column:
    """Lower edge of the sketch bucket of a non-negative integer."""
    width = F.greatest(F.length(F.bin(value)) - SUB_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, width), width)


def sketches(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """One mergeable sketch per (language, source, measure): rows (lang, source, measure, edge, count).
    Documents that fail the base rules do not shape the thresholds."""
    long = measured.where(~F.col("base_failed")).select(
        F.col(lang).alias("lang"), F.col(source).alias("source"),
        F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), edge(F.col(m)).alias("edge")) for m in MEASURES])).alias("x"),
    )
    return long.groupBy("lang", "source", "x.measure", "x.edge").agg(F.count("*").alias("count"))


def thresholds(sketch: DataFrame, min_group: int = MIN_GROUP, fence: int = FENCE) -> DataFrame:
    """Per (lang, source): n_own and one low_/high_ pair per measure. Null languages and sources are
    groups of their own. An empty sketch gives an empty table."""

    def fences(keys: list[str], tag: str) -> DataFrame:
        merged = sketch.groupBy(*keys, "measure", "edge").agg(F.sum("count").alias("count"))
        run = W.partitionBy(*keys, "measure").orderBy("edge")
        ranked = merged.select("*", F.sum("count").over(run).alias("upto"), F.sum("count").over(W.partitionBy(*keys, "measure")).alias("n"))
        q = [F.min(F.when(4 * F.col("upto") >= k * F.col("n"), F.col("edge"))).alias(f"q{k}") for k in (1, 3)]
        cut = ranked.groupBy(*keys, "measure").agg(*q, F.max("n").alias("n"))
        reach = fence * (F.col("q3") - F.col("q1")) + F.col("slack")
        slack = F.create_map(*[F.lit(x) for m, (v, _) in MEASURES.items() for x in (m, v)])
        cut = cut.withColumn("slack", slack[F.col("measure")])
        cut = cut.select(*keys, "measure", "n", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))
        wide = [F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{side}_{m}{tag}") for m in MEASURES for side in ("low", "high")]
        return cut.groupBy(*keys).agg(F.max("n").alias(f"n{tag}"), *wide)

    own, by_lang, whole = fences(["lang", "source"], "_own"), fences(["lang"], "_lang"), fences([], "_all")
    up = by_lang.withColumnRenamed("lang", "__lang")
    both = own.join(up, own["lang"].eqNullSafe(up["__lang"])).drop("__lang")
    one = {c: whole.select(c).scalar() for c in whole.columns if c != "n_all"}

    def pick(name: str) -> Column:
        return F.when(F.col("n_own") >= min_group, F.col(f"{name}_own")).when(F.col("n_lang") >= min_group, F.col(f"{name}_lang")).otherwise(one[f"{name}_all"]).alias(name)

    return both.select("lang", "source", "n_own", *[pick(f"{side}_{m}") for m in MEASURES for side in ("low", "high")])


def judge(measured: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Add `kept`: false if the base rules fail or any measure is outside its group's fences. A group
    without a sketch (all its documents failed the base rules) has no limits and no document to keep."""
    t = limits.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), *[c for c in limits.columns if c.startswith(("low_", "high_"))])
    cond = measured[lang].eqNullSafe(t["__lang"]) & measured[source].eqNullSafe(t["__source"])
    inside = F.lit(True)
    for m, (_, two_sided) in MEASURES.items():
        inside = inside & (F.col(m) <= F.col(f"high_{m}"))
        if two_sided:
            inside = inside & (F.col(m) >= F.col(f"low_{m}"))
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(False))
    return measured.join(t, cond, "left").select(*measured.columns, kept.alias("kept"))


def quality_filter(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of `df` that pass, with its own columns; equal rows are judged alike and all stay. Null
    texts fail the base rules.

    The measures are written once, with their rows: a filter on them that Catalyst pushed into their
    projection would compute them anew for every word.
    """
    own = df.columns
    measured = materialise(measure(df.select(F.struct(*own).alias("__row"), F.col(text).alias("__t"), F.col(lang).alias("__qlang"), F.col(source).alias("__qsource")), "__t").drop("__t"))
    limits = thresholds(materialise(sketches(measured, "__qlang", "__qsource")))
    return judge(measured, limits, "__qlang", "__qsource").where("kept").select(*[F.col("__row")[c].alias(c) for c in own])
