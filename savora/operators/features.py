"""User and item features, each a function from frames to one row per id."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from savora.functions.ordering import quantiles


# --- feature store --------------------------------------------------------------------------

class FeatureStore:
    """Features by name; asked-for ones are joined to the full list of ids."""

    def __init__(self, key: str):
        self.key = key
        self._makers: dict[str, Callable[..., DataFrame]] = {}

    def register(self, name: str, maker: Callable[..., DataFrame]) -> "FeatureStore":
        self._makers[name] = maker
        return self

    def build(self, spine: DataFrame, wanted: dict[str, dict]) -> DataFrame:
        unknown = [n for n in wanted if n not in self._makers]
        if unknown:
            raise ValueError(f"unknown features: {', '.join(unknown)}")
        out = spine.select(self.key)
        for name, params in wanted.items():
            out = out.join(self._makers[name](**params), self.key, "left")
        return out


def small_domain(df: DataFrame, col: str, limit: int = 10_000) -> list:
    """Sorted distinct values of a column that become columns of their own; more than a table can have is an error, and
    `limit` bounds what comes to the driver."""
    rows = df.where(F.col(col).isNotNull()).select(col).distinct().orderBy(col).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{col} has more than {limit} values")
    return [r[0] for r in rows]


# --- item features --------------------------------------------------------------------------

def review_counts(review: DataFrame, spine: DataFrame, key: str, out: str) -> DataFrame:
    counts = review.groupBy(key).agg(F.count("*").alias(out))
    return spine.select(key).join(counts, key, "left").fillna(0, subset=[out])


def count_bucket(col: str | Column) -> Column:
    """Right-closed bins (-1,0], (0,10], (10,50], (50,200], (200,inf) -> 0..4."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c <= 0, 0).when(c <= 10, 1).when(c <= 50, 2).when(c <= 200, 3).otherwise(4)


def tag_scores(tags: Column, names: dict[str, str]) -> dict[str, Column]:
    """tag -> column with the number in its last "(tag, n)" entry, 0 without one."""
    out = {}
    for tag, alias in names.items():
        mine = F.filter(tags, lambda x: F.regexp_extract(x, r"^\(\s*'?([^',]+)'?\s*,", 1) == tag)
        number = F.regexp_extract(F.element_at(mine, -1), r",\s*(\d+)\s*\)$", 1)
        out[alias] = F.when(F.size(mine) > 0, number.try_cast("int")).otherwise(0)
        out[alias] = F.coalesce(out[alias], F.lit(0))
    return out


def median_of_list(arr: Column) -> Column:
    s = F.array_sort(arr)
    n = F.size(arr)
    mid = F.floor((n - 1) / 2).cast("int")
    upper = F.floor(n / 2).cast("int")
    return F.when(n > 0, (F.get(s, mid) + F.get(s, upper)) / 2.0)


PRICE_COLUMNS = ("min_price", "max_price", "mean_price", "median_price", "menu_count")


def price_stats(df: DataFrame, key: str, texts: Column, token: str) -> DataFrame:
    """min, max, mean, median and size of each price list without the variable-price token; a
    null list is unknown, a token-only list counts 0, unknown values take the column median."""
    work = df.select(F.col(key), texts.alias("__t")).withColumn(
        "__p", F.transform(F.filter("__t", lambda x: x != token), lambda x: x.try_cast("double"))
    )
    p = F.col("__p")
    known = F.size(p) > 0
    mean = F.aggregate(p, F.lit(0.0), lambda a, x: a + x) / F.size(p)
    raw = work.select(
        key,
        F.array_min(p).alias("min_price"),
        F.array_max(p).alias("max_price"),
        F.when(known, mean).alias("mean_price"),
        median_of_list(p).alias("median_price"),
        F.when(F.size("__t") > 0, F.size(p).cast("double")).alias("menu_count"),
    )
    long = raw.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in PRICE_COLUMNS])))
    med = quantiles(long, ["name"], "value", {"median": 0.5})
    fills = med.agg(
        F.struct(*[F.max(F.when(F.col("name") == c, F.col("median"))).alias(c) for c in PRICE_COLUMNS])
    ).scalar()
    return raw.select(key, *[F.coalesce(F.col(c), fills[c]).alias(c) for c in PRICE_COLUMNS])


def item_mean_score(review: DataFrame, spine: DataFrame, key: str, score: str, out: str = "mean_review_score") -> DataFrame:
    means = review.groupBy(key).agg(F.avg(score).alias(out))
    return spine.select(key).join(means, key, "left").fillna(0.0, subset=[out])


def one_hot(df: DataFrame, col: str, values: Sequence[str], drop_first: bool = False) -> DataFrame:
    """0/1 columns for the given sorted values; a null category has no 1."""
    kept = list(values)[1:] if drop_first else list(values)
    return df.select("*", *[F.coalesce((F.col(col) == v).cast("int"), F.lit(0)).alias(f"{col}_{v}") for v in kept])


def bayesian_average(review: DataFrame, spine: DataFrame, key: str, value: str, k: int = 5, out: str = "bayesian_score") -> DataFrame:
    """(mean*n + mu*k)/(n+k) with mu the mean of item means; items without reviews get 0."""
    stats = review.groupBy(key).agg(F.count("*").alias("__n"), F.avg(value).alias("__m"))
    mu = stats.agg(F.avg("__m")).scalar()
    scored = stats.select(key, ((F.col("__m") * F.col("__n") + mu * k) / (F.col("__n") + k)).alias(out))
    return spine.select(key).join(scored, key, "left").fillna(0.0, subset=[out])


# --- menus ----------------------------------------------------------------------------------

# Stop-words, amount units and kept letters of Korean menu names.
MENU_STOPWORDS = ("1인분", "1인세트", "세트", "추가", "가격표", "가격", "참고", "오시는 길", "내부에 추천메뉴", "추가")
MENU_UNITS = r"\d+(?:g|kg|개|mm|ml|L|원)\s*"
MENU_KEEP = r"[^\uAC00-\uD7A3\s]"


def clean_menu(
    menu: Column, stopwords: Sequence[str], units: str, keep: str, min_length: int = 1, parentheses: str = r"\([^)]*\)"
) -> Column:
    """Menu name without parentheses, amounts and stop-words, reduced to the kept characters.

    Stop-words are taken out in list order: a name that equals one is dropped, otherwise it is
    removed as a word at either end, as a word inside, or as a prefix or suffix of a compound.
    """
    base = F.regexp_replace(F.regexp_replace(menu, parentheses, ""), units, "")

    def without(name: Column, word: Column) -> Column:
        size, cut = F.length(name), F.length(word)
        at_edge = name.startswith(F.concat(word, F.lit(" "))) | name.endswith(F.concat(F.lit(" "), word))
        inside = F.concat(F.lit(" "), word, F.lit(" "))
        return (
            F.when(name == word, F.lit(None).cast("string"))
            .when(at_edge, F.trim(F.replace(name, word, F.lit(""))))
            .when(name.contains(inside), F.trim(F.replace(name, inside, F.lit(" "))))
            .when(name.startswith(word), F.trim(F.substr(name, cut + 1)))
            .when(name.endswith(word), F.trim(F.substr(name, F.lit(1), size - cut)))
            .otherwise(name)
        )

    words = F.array(*[F.lit(w) for w in stopwords]).cast("array<string>")
    folded = F.aggregate(words, base, without)
    text = F.trim(F.regexp_replace(F.regexp_replace(folded, keep, ""), r"\s+", " "))
    return F.when(F.length(text) >= min_length, text)


def clean_menu_list(menus: Column, **params) -> Column:
    """Cleaned names of a list; unreadable lists and dropped names vanish."""
    cleaned = F.transform(F.coalesce(menus, F.array().cast("array<string>")), lambda m: clean_menu(m, **params))
    return F.filter(cleaned, lambda x: x.isNotNull())


def menu_frequency(df: DataFrame, category: str, menus: str) -> DataFrame:
    return (
        df.where(F.col(category).isNotNull()).select(category, F.explode(menus).alias("menu"))
        .where(F.col("menu") != "").groupBy(category, "menu").agg(F.count("*").alias("n"))
    )


def frequent_menus(freq: DataFrame, category: str, min_count: int, top: int | None = None) -> DataFrame:
    from savora.operators.popularity import top_per_group

    kept = freq.where(F.col("n") >= min_count)
    return kept if top is None else top_per_group(kept, [category], [F.desc("n"), F.asc("menu")], top)


def valid_menus(df: DataFrame, key: str, category: str, menus: str, frequent: DataFrame, out: str = "valid_menus") -> DataFrame:
    """Menus of each row that are frequent in its own category, order and copies kept."""
    rows = df.select(key, category, F.posexplode(menus).alias("__p", "menu"))
    kept = (
        rows.join(frequent.select(category, "menu"), [category, "menu"], "left_semi")
        .groupBy(key).agg(F.sort_array(F.collect_list(F.struct("__p", "menu"))).alias("__l"))
        .select(key, F.transform("__l", lambda s: s["menu"]).alias(out))
    )
    return df.join(kept, key, "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def multi_hot(df: DataFrame, category: str, menus: str, wanted: dict[str, Sequence[str]]) -> DataFrame:
    """0/1 column per (category, menu) of a bounded list."""
    cols = []
    for cat, names in wanted.items():
        for m in names:
            safe = "".join(ch if ch.isalnum() or ch == "_" else "_" for ch in m)
            hit = (F.col(category) == cat) & F.array_contains(menus, m)
            cols.append(F.coalesce(hit.cast("int"), F.lit(0)).alias(f"menu_{cat}_{safe}"))
    return df.select("*", *cols)


# --- user features --------------------------------------------------------------------------

def category_counts(review: DataFrame, user: str, category: str, values: Sequence[str], names: dict[str, str] | None = None) -> DataFrame:
    """One count column per category value. Conditional sums need one shuffle of per-user
    partial rows, where a pivot would group by user and category first."""
    names = names or {}
    return review.groupBy(user).agg(*[F.count_if(F.col(category) == v).alias(names.get(v, v)) for v in values])


def user_mean_score(review: DataFrame, user: str, score: str, out: str = "user_mean_score") -> DataFrame:
    return review.groupBy(user).agg(F.avg(score).alias(out))


def activity_pattern(review: DataFrame, user: str, date: str, as_of: str) -> DataFrame:
    """Reviews per weekday (Monday 0) and days since the last one."""
    day = F.weekday(F.col(date))
    return review.groupBy(user).agg(
        *[F.count_if(day == i).alias(f"day_{i}") for i in range(7)],
        F.datediff(F.lit(as_of).cast("date"), F.max(date)).alias("days_since_last_review"),
    )


def review_weights(review: DataFrame, score: str, average: str, date: str, as_of: str, decay_days: int = 1095) -> DataFrame:
    """date_weight fades after 90 days down to 0.01; score_diff is the distance to the own mean."""
    days = F.datediff(F.lit(as_of).cast("date"), F.col(date))
    fade = 1.0 - F.greatest(F.lit(0), days - 90) / F.lit(float(decay_days))
    return review.withColumn("date_weight", F.greatest(fade, F.lit(0.01))).withColumn(
        "score_diff", F.col(score) - F.col(average)
    )


def scaled(df: DataFrame, ranges: dict[str, tuple[float, float]], names: dict[str, str]) -> DataFrame:
    """Min-max scaling of several columns with one extra pass; a constant column becomes the
    lower border."""
    ends = df.agg(
        F.struct(*[F.min(c).cast("double").alias(f"lo_{c}") for c in ranges], *[F.max(c).cast("double").alias(f"hi_{c}") for c in ranges])
    ).scalar()
    cols = []
    for c, (lo, hi) in ranges.items():
        width = ends[f"hi_{c}"] - ends[f"lo_{c}"]
        unit = F.try_divide(F.col(c).cast("double") - ends[f"lo_{c}"], width)
        cols.append(F.when(width == 0, F.lit(lo)).otherwise(unit * (hi - lo) + lo).alias(names[c]))
    return df.select("*", *cols)


def combined_score(weighted: DataFrame, badge: str = "badge_level", w: tuple[float, float, float] = (0.3, 0.2, 0.5)) -> DataFrame:
    out = scaled(
        weighted,
        {badge: (0.1, 1.0), "date_weight": (0.1, 1.0), "score_diff": (-0.5, 1.0)},
        {badge: "badge_scaled", "date_weight": "date_scaled", "score_diff": "score_scaled"},
    )
    return out.withColumn(
        "combined_score", F.col("badge_scaled") * w[0] + F.col("date_scaled") * w[1] + F.col("score_scaled") * w[2]
    )


def user_scaled_scores(scored: DataFrame, user: str) -> DataFrame:
    return scored.groupBy(user).agg(*[F.avg(c).alias(c) for c in ("date_scaled", "score_scaled", "combined_score")])


def merge_features(pairs: DataFrame, users: DataFrame, items: DataFrame, user: str, item: str) -> DataFrame:
    return pairs.join(users, user, "left").join(items, item, "left").fillna(0)


def first_attributes(rows: DataFrame, spine: DataFrame, key: str, cols: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Each id's earliest attribute values, 0 for ids without rows."""
    first = rows.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("__f"))
    out = spine.select(key).join(first, key, "left").select(key, *[F.col(f"__f.{c}").alias(c) for c in cols])
    return out.fillna(0, subset=list(cols))


def review_profile(review: DataFrame, user: str, text: str, date: str, windows: dict[str, tuple[str, str]]) -> DataFrame:
    """Per user: reviews, texts, mean text length and reviews per period."""
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    return review.groupBy(user).agg(
        F.count("*").alias("n_reviews"), F.count(text).alias("n_texts"), F.avg(F.length(text)).alias("mean_length"),
        *[F.count_if((F.col(date) >= ts(a)) & (F.col(date) < ts(b))).alias(n) for n, (a, b) in windows.items()],
    )


def steady_writers(profile: DataFrame, windows: Sequence[str]) -> DataFrame:
    """Users active in every period whose texts are at least as long as the average user's."""
    mean = profile.agg(F.avg("mean_length")).scalar()
    cond = F.col("mean_length") >= mean
    for w in windows:
        cond = cond & (F.col(w) > 0)
    return profile.where(cond)
