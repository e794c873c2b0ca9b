"""Category hierarchy rules, simplification, imputation and tree counts.

Frames carry the levels large, middle, small, detail. Rule tables are parameters; `load_rules`
reads them from a YAML file with the sections used below.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from savora.functions import text as X
from savora.functions.hashing import hash_int
from savora.operators.blocks import block_topk
from savora.operators.popularity import top_per_group
from savora.session import materialise

LEVELS = ("large", "middle", "small", "detail")

# Category names the default moves refer to.
CHICKEN = "치킨"
CHICKEN_KEPT = ("프라이드치킨", "구운치킨", "닭강정")
CHICKEN_GRILLED = "숯불치킨"
CHICKEN_OTHER = "치킨전문점"
WESTERN = "양식"
SECTION_ALIAS = {"패밀리레스토랑": "양식", "샐러드": "양식"}
EXTRA_SECTION = {"양식": "치킨"}


def load_rules(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def _is(col: str, values: Sequence[str]) -> Column:
    """Membership that is false, not null, for a null category."""
    return F.coalesce(F.col(col).isin(list(values)), F.lit(False))


def _update(df: DataFrame, cond: Column, **new: Column) -> DataFrame:
    """All given columns at once where `cond` holds, from the values before the update."""
    hit = df.withColumn("__hit", cond)
    return hit.select(*[F.when(F.col("__hit"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in df.columns])


def split_brand(
    df: DataFrame, large: str = CHICKEN, kept: Sequence[str] = CHICKEN_KEPT, listed: Sequence[str] = (),
    yes: str = CHICKEN_GRILLED, no: str = CHICKEN_OTHER,
) -> DataFrame:
    """Brand names of one large category move to small; middle tells listed brands from others."""
    cond = _is("large", [large]) & ~_is("middle", kept)
    return _update(df, cond, small=F.col("middle"), middle=F.when(_is("middle", listed), yes).otherwise(F.lit(no)))


def lower_level(df: DataFrame, level: str, mapping: dict[str, Sequence[str]]) -> DataFrame:
    """Listed categories become a lower level of another one, level by level in rule order."""
    if level not in ("large", "middle"):
        raise ValueError("level must be large or middle")
    for after, before in mapping.items():
        cond = _is(level, before)
        if level == "large":
            df = _update(df, cond, detail=F.col("small"), small=F.col("middle"), middle=F.col("large"), large=F.lit(after))
        else:
            df = _update(df, cond, detail=F.col("small"), small=F.col("middle"), middle=F.lit(after))
    return df


@dataclass(frozen=True)
class PartMove:
    after: str
    part_large: str
    part_middles: Sequence[str]
    new_middle: str
    before: Sequence[str]


def partly_lower(df: DataFrame, moves: Sequence[PartMove]) -> DataFrame:
    """Some middles of a category change their large category; the rest is lowered under it."""
    for m in moves:
        df = _update(df, _is("large", [m.part_large]) & _is("middle", m.part_middles), large=F.lit(m.after))
        df = _update(
            df, _is("large", m.before),
            detail=F.col("small"), small=F.col("middle"), middle=F.lit(m.new_middle), large=F.lit(m.after),
        )
    return df


def integrate_middles(df: DataFrame, mapping: dict[str, dict[str, Sequence[str]]]) -> DataFrame:
    """Per large category several middles become one."""
    for large, news in mapping.items():
        for new, old in news.items():
            df = _update(df, _is("large", [large]) & _is("middle", old), middle=F.lit(new))
    return df


def rename_middles(df: DataFrame, mapping: dict[str, dict[str, str]]) -> DataFrame:
    """New names by (large, middle), all at once."""
    new = F.col("middle")
    for large, names in mapping.items():
        for old, name in names.items():
            new = F.when(_is("large", [large]) & _is("middle", [old]), name).otherwise(new)
    return df.withColumn("middle", new)


def process_all(df: DataFrame, rules: dict) -> DataFrame:
    """The rule steps in their fixed order."""
    df = split_brand(df, listed=rules["chicken_category"]["구이"])
    df = lower_level(df, "large", rules.get("lowering_large_categories", {}))
    df = lower_level(df, "middle", rules.get("lowering_middle_categories", {}))
    moves = [
        PartMove(after, m["partly_lowering_large_category"], m["partly_lowering_middle_categories"], m["changing_middle_category"], m["lowering_large_categories"])
        for after, m in rules.get("partly_lowering_large_categories", {}).items()
    ]
    df = partly_lower(df, moves)
    df = integrate_middles(df, rules.get("integrate_diner_category_middle", {}))
    return rename_middles(df, rules.get("rename_diner_category_middle", {}))


# --- simplification -------------------------------------------------------------------------

def rule_table(spark: SparkSession, mapping: dict[str, dict[str, Sequence[str]]]) -> DataFrame:
    """(section, simplified, original, prio) in rule order."""
    rows = [(s, new, o) for s, news in mapping.items() for new, olds in news.items() for o in olds]
    return spark.createDataFrame(
        [(s, n, o, i) for i, (s, n, o) in enumerate(rows)], "section string, simplified string, original string, prio int"
    )


def simplify_pairs(
    pairs: DataFrame, rules: DataFrame, alias: dict[str, str] | None = None, extra: dict[str, str] | None = None
) -> DataFrame:
    """(large, middle) -> simplified: exact match in the own section, then in the extra one, then
    either name containing the other, own section first; else the name itself.

    Only distinct pairs are matched, and a pair meets just the rules of its sections.
    """
    alias = SECTION_ALIAS if alias is None else alias
    extra = EXTRA_SECTION if extra is None else extra
    base = pairs.select("large", "middle").where("large is not null and middle is not null and middle <> ''").distinct()
    own = F.col("large")
    for a, b in alias.items():
        own = F.when(F.col("large") == a, b).otherwise(own)
    more = F.lit(None).cast("string")
    for a, b in extra.items():
        more = F.when(F.col("__own") == a, b).otherwise(more)
    sections = base.withColumn("__own", own).withColumn("__more", more).select(
        "large", "middle",
        F.inline(F.array(F.struct(F.col("__own").alias("section"), F.lit(0).alias("far")), F.struct(F.col("__more").alias("section"), F.lit(1).alias("far")))),
    )
    m, o = F.lower("middle"), F.lower("original")
    stage = F.when(F.col("middle") == F.col("original"), F.col("far")).when(m.contains(o) | o.contains(m), F.col("far") + 2)
    hits = sections.join(rules, "section").withColumn("stage", stage).where("stage is not null")
    return hits.groupBy("large", "middle").agg(F.min_by("simplified", F.struct("stage", "prio")).alias("simplified"))


def simplify(df: DataFrame, rules: DataFrame, large: str | Column = "large", middle: str = "middle", out: str = "simplified", **sections) -> DataFrame:
    """Add the simplified form of `middle`, the value itself without a rule."""
    big = F.col(large) if isinstance(large, str) else large
    work = df.withColumn("__l", big)
    table = simplify_pairs(work.select(F.col("__l").alias("large"), F.col(middle).alias("middle")), rules, **sections)
    t = table.select(F.col("large").alias("__l"), F.col("middle").alias("__m"), F.col("simplified").alias("__s"))
    cond = (work["__l"] == t["__l"]) & (work[middle] == t["__m"])
    return work.join(t, cond, "left").withColumn(out, F.coalesce("__s", F.col(middle))).select(*df.columns, out)


@dataclass(frozen=True)
class SimplifyPlan:
    """Moves around the simplification; defaults are the fixed names of the category data."""

    # (large, middle, new large, take middle from the lower levels)
    before: Sequence[tuple[str, str, str, bool]] = (("간식", "닭강정", "치킨", False), ("한식", "분식", "분식", True))
    # categories named like their own middle, retried with small and detail
    generic: Sequence[str] = ("분식",)
    # (large or None, middles or None, new large)
    after: Sequence[tuple[str | None, Sequence[str] | None, str]] = (
        ("간식", ("닭강정",), "치킨"), ("한식", ("일반도시락",), "도시락"), ("샐러드", None, "양식"),
        (None, ("패밀리레스토랑", "스테이크하우스", "이탈리안"), "양식"), ("일식", ("전통일식집",), "기타"), ("일식", ("기타",), "기타"),
    )
    sections: dict = field(default_factory=dict)


def simplify_process(df: DataFrame, rules: DataFrame, plan: SimplifyPlan | None = None) -> DataFrame:
    plan = plan or SimplifyPlan()
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    for large, middle, new, lower in plan.before:
        cond = _is("large", [large]) & _is("middle", [middle])
        better = F.coalesce(filled("small"), filled("detail"), F.col("middle")) if lower else F.col("middle")
        df = _update(df, cond, large=F.lit(new), middle=better)
    df = simplify(df, rules, out="__s", **plan.sections).withColumn("middle", F.col("__s")).drop("__s")
    for name in plan.generic:
        a = simplify(df, rules, large=F.lit(name), middle="small", out="__a", **plan.sections)
        b = simplify(a, rules, large=F.lit(name), middle="detail", out="__b", **plan.sections)
        changed = lambda new, old: F.when((F.col(old) != "") & (F.col(new) != F.col(old)), F.col(new))
        b = b.withColumn("__n", F.coalesce(changed("__a", "small"), changed("__b", "detail"), F.col("middle")))
        df = _update(b, _is("large", [name]) & _is("middle", [name]), middle=F.col("__n")).drop("__a", "__b", "__n")
    for large, middles, new in plan.after:
        cond = F.lit(True)
        if large is not None:
            cond = cond & _is("large", [large])
        if middles is not None:
            cond = cond & _is("middle", middles)
        df = _update(df, cond, large=F.lit(new))
    return df


# --- imputation -----------------------------------------------------------------------------

def holdout(key: Column, seed: str = "knn") -> Column:
    """One row in five, by hash."""
    return hash_int(seed, key) % 10 < 2


def _codes(known: DataFrame, col: str) -> DataFrame:
    """0-based codes of the sorted values per large category; the values form a taxonomy level,
    so a category has few of them."""
    vals = known.where(F.col(col).isNotNull()).select("large", col).distinct()
    return vals.withColumn(f"{col}_code", F.dense_rank().over(W.partitionBy("large").orderBy(col)) - 1)


def _encode(df: DataFrame, codes: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    for col, table in codes:
        df = df.join(table, ["large", col], "left").withColumn(f"{col}_code", F.coalesce(f"{col}_code", F.lit(-1)))
    return df


def nearest_coded(spots: DataFrame, points: DataFrame, k: int, width: int = 4) -> DataFrame:
    """The k nearest rows of every spot (large, s0, d0) among points (large, small_code, detail_code, middle, cnt) of
    its category, as (large, s0, d0, middle, d2, use) with `use` of the point's `cnt` rows taken.

    Spots look at the three by three cells around them. All points nearer than one cell width plus 1 lie there, since
    codes are whole numbers; spots with k rows that near are done, the others go on with cells twice as wide until one
    block holds the plane. Equally near points are taken in the order of codes and label.
    """
    spot = ["large", "s0", "d0"]
    points = materialise(points)
    todo = materialise(spots.join(points.select("large").distinct(), "large", "left_semi"))
    codes = points.select("small_code", "detail_code").unionByName(todo.select(F.col("s0").alias("small_code"), F.col("d0").alias("detail_code")))
    span = codes.select(F.max(F.greatest("small_code", "detail_code"))).first()[0]
    parts = []
    while span is not None and not todo.isEmpty():
        # The last cells hold every code from -1 up, on either side of a spot.
        last = width > span + 1
        at = lambda c: F.floor(F.col(c) / width)
        step = F.sequence(F.lit(-1), F.lit(1))
        cells = todo.select(*spot, F.explode(F.transform(step, lambda x: at("s0") + x)).alias("cx")).select(
            "*", F.explode(F.transform(step, lambda y: at("d0") + y)).alias("cy")
        )
        d2 = ((F.col("small_code") - F.col("s0")) ** 2 + (F.col("detail_code") - F.col("d0")) ** 2).cast("double")
        near = cells.join(points.withColumn("cx", at("small_code")).withColumn("cy", at("detail_code")), ["large", "cx", "cy"]).withColumn("d2", d2)
        near = materialise(near.drop("cx", "cy") if last else near.where(F.col("d2") < (width + 1) ** 2).drop("cx", "cy"))
        if not last:
            done = materialise(near.groupBy(*spot).agg(F.sum("cnt").alias("n")).where(F.col("n") >= k).select(*spot))
            near = near.join(done, spot, "left_semi")
        w = W.partitionBy(*spot).orderBy("d2", "small_code", "detail_code", "middle").rowsBetween(W.unboundedPreceding, -1)
        parts.append(near.withColumn("before", F.coalesce(F.sum("cnt").over(w), F.lit(0))).where(F.col("before") < k).select(
            *spot, "middle", "d2", F.least(F.col("cnt"), F.lit(k) - F.col("before")).alias("use")
        ))
        if last:
            break
        todo = materialise(todo.join(done, spot, "left_anti"))
        width *= 2
    if not parts:
        return todo.join(points, "large").select(*spot, "middle", F.lit(0.0).alias("d2"), F.col("cnt").alias("use")).limit(0)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def knn_impute(df: DataFrame, key: str, k: int = 5, predict: Column | None = None, seed: str = "knn") -> DataFrame:
    """Predicted middle by distance-weighted vote of the k nearest training rows of the same
    large category, on label-coded small and detail.

    Rows sharing (large, small, detail, middle) are one point with a count, and rows to predict
    share one answer per (large, small, detail); `nearest_coded` finds their neighbours. Without `predict` the rows lacking a
    middle are predicted. Returns (key, large, predicted).
    """
    known = df.where("middle is not null and large is not null")
    wanted = F.col("middle").isNull() if predict is None else predict
    codes = [(c, _codes(known, c)) for c in ("small", "detail")]
    # Fit on four fifths, as the imputer keeps the model it was evaluated with.
    train = known.where(~holdout(F.col(key), seed))
    ok = known.groupBy("large").agg(F.count("*").alias("n"), F.count_distinct("middle").alias("m")).where("n >= 2 and m >= 2").select("large")
    points = (
        _encode(train.join(ok, "large", "left_semi"), codes).groupBy("large", "small_code", "detail_code", "middle")
        .agg(F.count("*").alias("cnt"))
    )
    asked = _encode(df.where(wanted & F.col("large").isNotNull()), codes).select(key, "large", "small_code", "detail_code")
    spots = asked.select("large", F.col("small_code").alias("s0"), F.col("detail_code").alias("d0")).distinct()
    taken = nearest_coded(spots, points, k)
    votes = taken.groupBy("large", "s0", "d0", "middle").agg(
        F.sum(F.when(F.col("d2") == 0, F.col("use")).otherwise(0)).alias("same"),
        F.sum(F.when(F.col("d2") > 0, F.col("use") / F.sqrt("d2")).otherwise(0.0)).alias("other"),
    )
    # Rows at distance 0 outvote all others; ties go to the first label.
    best = votes.groupBy("large", "s0", "d0").agg(
        F.max("same").alias("any_same"),
        F.min_by("middle", F.struct((-F.col("same")).alias("a"), F.col("middle").alias("b"))).alias("by_same"),
        F.min_by("middle", F.struct((-F.round("other", 9)).alias("a"), F.col("middle").alias("b"))).alias("by_other"),
    ).select("large", "s0", "d0", F.when(F.col("any_same") > 0, F.col("by_same")).otherwise(F.col("by_other")).alias("predicted"))
    answers = best.select("large", F.col("s0").alias("small_code"), F.col("d0").alias("detail_code"), "predicted")
    return asked.join(answers, ["large", "small_code", "detail_code"], "left").select(key, "large", "predicted")


def _text_features(base: DataFrame, key: str, col: str, size: int, letters: str) -> DataFrame:
    """(key, array of `size`): TF-IDF of a text over the most frequent words of its large
    category, learned from the known rows."""
    words = base.select("large", key, "known", F.explode(X.tokens(col, min_length=2, letters=letters)).alias("word"))
    tf = materialise(words.groupBy("large", key, "known", "word").agg(F.count("*").alias("tf")))
    vocab = tf.where("known").groupBy("large", "word").agg(F.sum("tf").alias("c"), F.count("*").alias("df"))
    vocab = top_per_group(vocab, ["large"], [F.desc("c"), F.asc("word")], size, rank="p")
    n = base.where("known").groupBy("large").agg(F.count("*").alias("n"))
    idf = F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0
    raw = tf.join(vocab.join(n, "large").select("large", "word", "p", idf.alias("idf")), ["large", "word"])
    # At most `size` entries per row.
    packed = raw.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("p", (F.col("tf") * F.col("idf")).alias("w")))).alias("m"),
        F.sqrt(F.sum(F.col("tf") * F.col("idf") * F.col("tf") * F.col("idf"))).alias("norm"),
    )
    dense = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda p: F.coalesce(F.try_element_at("m", p) / F.col("norm"), F.lit(0.0)))
    return packed.select(key, dense.alias("__t"))


def knn_impute_with_text(
    df: DataFrame, key: str, texts: dict[str, int], k: int = 5, predict: Column | None = None, seed: str = "knn",
    letters: str = "a-z0-9가-힣",
) -> DataFrame:
    """`knn_impute` with TF-IDF features of texts (column -> number of words) next to the coded
    levels. Rows differ now, so neighbours come from blocked distance products per category."""
    wanted = F.col("middle").isNull() if predict is None else predict
    known = df.where("middle is not null and large is not null")
    codes = [(c, _codes(known, c)) for c in ("small", "detail")]
    ok = known.groupBy("large").agg(F.count("*").alias("n"), F.count_distinct("middle").alias("m")).where("n >= 2 and m >= 2").select("large")
    base = df.where(F.col("large").isNotNull()).withColumn("known", F.col("middle").isNotNull()).withColumn("asked", wanted)
    base = materialise(_encode(base, codes))
    parts = [F.array(F.col("small_code").cast("double"), F.col("detail_code").cast("double"))]
    work = base
    for i, (col, size) in enumerate(texts.items()):
        work = work.join(_text_features(base, key, col, size, letters).withColumnRenamed("__t", f"__t{i}"), key, "left")
        parts.append(F.coalesce(f"__t{i}", F.array(*[F.lit(0.0)] * size)))
    work = materialise(work.select(key, "large", "middle", "known", "asked", F.concat(*parts).alias("x")))
    # 2xy - |x|^2 - |y|^2 as one dot product: the nearest rows have the highest score.
    sq = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    q = work.where("asked").select(F.col(key).alias("user"), "large", F.concat(F.transform("x", lambda v: 2.0 * v), F.array(F.lit(-1.0), -sq)).alias("vec"))
    train = work.where(F.col("known") & ~holdout(F.col(key), seed)).join(ok, "large", "left_semi")
    it = train.select(F.col(key).alias("item"), "large", F.concat("x", F.array(sq, F.lit(1.0))).alias("vec"))
    near = block_topk(q, it, k, within="large").join(train.select(F.col(key).alias("item"), "middle"), "item")
    d = F.sqrt(F.greatest(-F.col("score"), F.lit(0.0)))
    votes = near.groupBy("user", "middle").agg(
        F.count_if(F.col("score") >= 0).alias("same"), F.sum(F.when(F.col("score") < 0, 1.0 / d).otherwise(0.0)).alias("other")
    )
    best = votes.groupBy("user").agg(
        F.max("same").alias("any_same"),
        F.min_by("middle", F.struct((-F.col("same")).alias("a"), F.col("middle").alias("b"))).alias("by_same"),
        F.min_by("middle", F.struct((-F.round("other", 6)).alias("a"), F.col("middle").alias("b"))).alias("by_other"),
    ).select(F.col("user").alias(key), F.when(F.col("any_same") > 0, F.col("by_same")).otherwise(F.col("by_other")).alias("predicted"))
    return work.where("asked").select(key, "large").join(best, key, "left")


def imputer_quality(scored: DataFrame) -> DataFrame:
    """Accuracy and macro / support-weighted precision, recall and F1 per large category.
    scored: (large, actual, predicted)."""
    confusion = scored.groupBy("large", "actual", "predicted").agg(F.count("*").alias("n"))
    entries = F.array(
        F.struct(F.col("actual").alias("label"), F.lit("a").alias("side")), F.struct(F.col("predicted").alias("label"), F.lit("p").alias("side"))
    )
    sides = confusion.select("large", "n", (F.col("actual") == F.col("predicted")).alias("hit"), F.inline(entries))
    per = sides.groupBy("large", "label").agg(
        F.sum(F.when((F.col("side") == "a") & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("side") == "a", F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("side") == "p", F.col("n")).otherwise(0)).alias("claimed"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    p = zero(F.try_divide(F.col("tp").cast("double"), F.col("claimed")))
    r = zero(F.try_divide(F.col("tp").cast("double"), F.col("support")))
    per = per.withColumn("p", p).withColumn("r", r).withColumn("f", zero(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"))))
    names = {"p": "precision", "r": "recall", "f": "f1"}
    return per.groupBy("large").agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        *[F.avg(c).alias(f"{n}_macro") for c, n in names.items()],
        *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"{n}_weighted") for c, n in names.items()],
    )


# --- tree statistics ------------------------------------------------------------------------

def path_counts(df: DataFrame, key: str, levels: Sequence[str] = LEVELS) -> DataFrame:
    """Distinct items per category path prefix; paths with a missing level are left out."""
    sets = [list(levels[: i + 1]) for i in range(len(levels))]
    grouped = df.select(key, *levels).distinct().groupingSets(sets, *levels).agg(
        F.count(key).alias("diner_count"), F.grouping_id(*levels).alias("__gid")
    )
    depth = F.lit(len(levels)) - F.length(F.regexp_replace(F.bin("__gid"), "0", ""))
    complete = F.lit(True)
    for i, c in enumerate(levels):
        complete = complete & ((F.col("depth") <= i) | F.col(c).isNotNull())
    return grouped.withColumn("depth", depth.cast("int")).where(complete).drop("__gid")


def change_patterns(before: DataFrame, after: DataFrame, key: str, col: str = "middle") -> DataFrame:
    """(before, after, n, pattern): kept, renamed, split (one to many) or merged (many to one)."""
    m = before.select(key, F.col(col).alias("before")).join(after.select(key, F.col(col).alias("after")), key)
    counts = m.where("before is not null and after is not null").groupBy("before", "after").agg(F.count("*").alias("n"))
    out = counts.groupBy("before").agg(F.count("*").alias("fan_out"))
    into = counts.groupBy("after").agg(F.count("*").alias("fan_in"))
    one = F.when(F.col("fan_out") > 1, "split").when(F.col("before") == F.col("after"), "kept").otherwise("renamed")
    return counts.join(out, "before").join(into, "after").select(
        "before", "after", "n", one.alias("pattern"), (F.col("fan_in") > 1).cast("int").alias("merged")
    )


def children(df: DataFrame, parent: str, child: str) -> DataFrame:
    """Sorted child names per parent; the distinct names of a taxonomy are few."""
    pairs = df.where(F.col(parent).isNotNull() & F.col(child).isNotNull()).select(parent, child).distinct()
    return pairs.groupBy(parent).agg(F.array_sort(F.collect_list(child)).alias("children"))
