"""List-wise ranking: boosted histogram trees whose gradients are NDCG swaps inside each user's list.

Only swaps that touch the first `k` places change NDCG@k, so a round needs the top `k` of every list next to each of its rows,
never a whole list: the tops come from a ranked window that is cut before its shuffle, meet the rows in one join on the
user, and whatever a row does to the top rows is emitted as partial sums. Histograms are sums, so these
parts go into them as they are. A tree level is one aggregate by (node, feature, bin); the driver sees only those
sums, bounded by 2^depth x features x bins, and each round writes its rows once.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from savora.functions.hashing import hash_int
from savora.functions.ordering import bucket_of
from savora.operators.evaluation import ideal_gain
from savora.session import materialise, release, shuffled

SIGMA = 1.0


@dataclass
class ListwiseRanker:
    """Trees over binned features. A node is (feature, bin, left, right): values below cut `bin`, and nulls, go left."""

    features: list[str]
    cuts: list[list[float]]
    rate: float
    trees: list = field(default_factory=list)
    history: list[float] = field(default_factory=list)  # NDCG@k of the validation lists, per round

    def binned(self) -> Column:
        return F.array(*[F.when(F.col(f).isNotNull(), bucket_of(F.col(f).cast("double"), c)).otherwise(-1).cast("int") for f, c in zip(self.features, self.cuts)])

    def value(self, tree, bins: Column) -> Column:
        if not isinstance(tree, (list, tuple)):
            return F.lit(float(tree))
        f, b, left, right = tree
        return F.when(F.get(bins, F.lit(f)) <= b, self.value(left, bins)).otherwise(self.value(right, bins))

    def score(self, df: DataFrame, out: str = "pred") -> DataFrame:
        """`df` with the sum of all trees; rows without a feature go left at its splits."""
        work = df.withColumn("__bins", self.binned())
        total = sum((self.value(t, F.col("__bins")) * self.rate for t in self.trees), F.lit(0.0))
        return work.withColumn(out, F.round(total, 9)).drop("__bins")

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "model string").coalesce(1).write.text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "ListwiseRanker":
        return ListwiseRanker(**json.loads(spark.read.text(path).first()[0]))


def _tops(rows: DataFrame, k: int) -> DataFrame:
    """The first k rows of each user's list as one row, by score, ties by item."""
    place = F.row_number().over(W.partitionBy("user").orderBy(F.desc("score"), F.asc("item")))
    cut = rows.select("user", "item", "target", "score", "bins", place.alias("pos")).where(F.col("pos") <= k)
    return cut.groupBy("user").agg(F.sort_array(F.collect_list(F.struct("pos", "item", "target", "score", "bins"))).alias("top"))


def mean_ndcg(rows: DataFrame, k: int) -> float:
    """Mean NDCG@k over the users with a positive row."""
    place = F.row_number().over(W.partitionBy("user").orderBy(F.desc("score"), F.asc("item")))
    gains = rows.select("user", "target", place.alias("pos")).where(F.col("pos") <= k).groupBy("user").agg(F.sum(F.col("target") / F.log2(F.col("pos") + 1.0)).alias("dcg"))
    liked = rows.where("target > 0").groupBy("user").agg(F.count("*").alias("m"))
    return shuffled(liked).join(gains, "user").agg(F.avg(F.col("dcg") / ideal_gain(F.col("m"), k))).first()[0] or 0.0


def swap_gradients(rows: DataFrame, k: int) -> DataFrame:
    """Rows with the gradient g and curvature h of NDCG@k (rows with `own`), and what rows below the tops add to top
    rows. The sums over a (user, item) are its gradient; users without a positive row have none."""
    liked = rows.where("target > 0").groupBy("user").agg(F.count("*").alias("m"))
    tops = _tops(rows, k).join(shuffled(liked), "user").select("user", "top", ideal_gain(F.col("m"), k).alias("ideal"))
    joined = rows.join(shuffled(tops), "user", "left")
    kinds = rows.schema
    schema = rows.select("user", "item", "target", "bins", "score", F.lit(0.0).alias("g"), F.lit(0.0).alias("h"), F.lit(True).alias("own")).schema
    arrow = to_arrow_schema(schema)
    names = [f.name for f in kinds]
    sigma, discount = SIGMA, 1.0 / np.log2(np.arange(2, k + 2))

    def run(batches):
        for batch in batches:
            data = {n: batch.column(n) for n in (*names, "top", "ideal")}
            n = batch.num_rows
            target, score = data["target"].to_numpy(zero_copy_only=False).astype(float), data["score"].to_numpy(zero_copy_only=False)
            ideal = np.array([x if x else np.inf for x in data["ideal"].to_pylist()])
            offsets = data["top"].offsets.to_numpy()
            size = np.where(data["top"].is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
            flat = data["top"].flatten()  # lists that are null hold nothing
            row = np.repeat(np.arange(n), size)
            at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            if len(row):
                top_target, top_score = flat.field("target").to_numpy(zero_copy_only=False).astype(float), flat.field("score").to_numpy(zero_copy_only=False)
                same = np.array(flat.field("item").to_pylist(), object) == np.array(data["item"].to_pylist(), object)[row]
                own_place = np.zeros(n)
                np.maximum.at(own_place, row[same], discount[at[same]])
                better = np.sign(target[row] - top_target)
                swing = np.abs(own_place[row] - discount[at]) * np.abs(np.exp2(target[row]) - np.exp2(top_target)) / ideal[row]
                rho = 1.0 / (1.0 + np.exp(np.clip(sigma * better * (score[row] - top_score), -50, 50)))
                lam, curve = sigma * rho * swing * better, sigma * sigma * rho * (1.0 - rho) * swing
                g, h = np.bincount(row, lam, n), np.bincount(row, curve, n)
                below = (own_place[row] == 0) & (curve > 0)
            else:
                g = h = np.zeros(n)
                below = np.zeros(0, bool)
            own = [*(data[c] for c in ("user", "item", "target", "bins", "score")), pa.array(g), pa.array(h), pa.array(np.ones(n, bool))]
            yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(own, arrow)], schema=arrow)
            if below.any():
                users = data["user"].to_pylist()
                number: dict = {}
                code = np.array([number.setdefault(u, len(number)) for u in users])[row[below]] * len(discount) + at[below]
                keys, first, inverse = np.unique(code, return_index=True, return_inverse=True)
                pick = np.flatnonzero(below)[first]
                part = [
                    data["user"].take(pa.array(row[pick])), *[flat.field(c).take(pa.array(pick)) for c in ("item", "target", "bins", "score")],
                    pa.array(-np.bincount(inverse, lam[below], len(keys))), pa.array(np.bincount(inverse, curve[below], len(keys))), pa.array(np.zeros(len(keys), bool)),
                ]
                yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(part, arrow)], schema=arrow)

    return joined.select(*names, "top", "ideal").mapInArrow(run, schema)


def _grow(work: DataFrame, depth: int, l2: float, least: float) -> object:
    """One tree, level by level, from sums per (node, feature, bin)."""
    nodes: dict[int, object] = {1: None}  # heap numbers; children of n are 2n and 2n + 1
    splits: dict[int, tuple[int, int]] = {}
    sums: dict[int, tuple[float, float]] = {}

    def place(n: int) -> Column:
        if n not in splits:
            return F.lit(n)
        f, b = splits[n]
        return F.when(F.get("bins", F.lit(f)) <= b, place(2 * n)).otherwise(place(2 * n + 1))

    open_ = [1]
    for _ in range(depth):
        here = work.select(place(1).alias("node"), F.posexplode("bins").alias("f", "b"), "g", "h").where(F.col("node").isin(open_))
        table: dict[int, dict[int, list]] = {}
        for r in here.groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            table.setdefault(r["node"], {}).setdefault(r["f"], []).append((r["b"], r["g"], r["h"]))
        made = []
        for n, by_feature in sorted(table.items()):
            best = None
            for f, entries in sorted(by_feature.items()):
                entries.sort()
                all_g, all_h = sum(e[1] for e in entries), sum(e[2] for e in entries)
                sums.setdefault(n, (all_g, all_h))
                g = h = 0.0
                for b, eg, eh in entries[:-1]:
                    g, h = g + eg, h + eh
                    if min(h, all_h - h) < least:
                        continue
                    gain = round(g * g / (h + l2) + (all_g - g) ** 2 / (all_h - h + l2) - all_g * all_g / (all_h + l2), 9)
                    if gain > 0 and (best is None or gain > best[0]):
                        best = (gain, f, b, (g, h), (all_g - g, all_h - h))
            if best:
                _, f, b, left, right = best
                splits[n] = (f, b)
                sums[2 * n], sums[2 * n + 1] = left, right
                made += [2 * n, 2 * n + 1]
        open_ = made
        if not open_:
            break

    def build(n: int):
        if n in splits:
            return [*splits[n], build(2 * n), build(2 * n + 1)]
        g, h = sums.get(n, (0.0, 0.0))
        return g / (h + l2)

    return build(1)


def _prepared(df: DataFrame, model: ListwiseRanker) -> DataFrame:
    """One row per (user, item) with its highest target; of equal ones the smallest bins."""
    rows = df.select("user", "item", F.col("target").cast("int").alias("target"), model.binned().alias("bins")).where("user is not null and target is not null")
    return rows.groupBy("user", "item").agg(F.max(F.struct("target", "bins")).alias("r")).select("user", "item", "r.target", "r.bins", F.lit(0.0).alias("score"))


def fit_listwise(train: DataFrame, features: Sequence[str], valid: DataFrame | None = None, k: int = 20, rounds: int = 100, depth: int = 3, rate: float = 0.1, bins: int = 32, patience: int = 100, l2: float = 1.0, least: float = 1e-3) -> ListwiseRanker:
    """Ranker for (user, item, target, features). With `valid`, fitting stops when NDCG@k of its lists has not risen for
    `patience` rounds, and the trees after the best round are dropped."""
    train = materialise(train)
    probs = [(i + 1) / bins for i in range(bins - 1)]
    found = train.approxQuantile(list(features), probs, 0.001)
    model = ListwiseRanker(list(features), [sorted({float(x) for x in c if not math.isnan(x)}) for c in found], rate)
    rows = _prepared(train, model)
    held = None if valid is None else materialise(_prepared(valid, model))
    best, written = (-1.0, 0), None
    for _ in range(rounds):
        work = materialise(swap_gradients(materialise(rows) if written is None else rows, k))
        if written is not None:
            release(written)
        written = work
        tree = _grow(work, depth, l2, least)
        model.trees.append(tree)
        step = model.value(tree, F.col("bins")) * rate
        rows = work.where("own").select("user", "item", "target", "bins", (F.col("score") + step).alias("score"))
        if held is None:
            continue
        scored = materialise(held.withColumn("score", F.col("score") + step))
        release(held)
        held = scored
        model.history.append(mean_ndcg(held, k))
        if model.history[-1] > best[0] + 1e-12:
            best = (model.history[-1], len(model.trees))
        elif len(model.trees) - best[1] >= patience:
            break
    if held is not None:
        model.trees = model.trees[: best[1]]
    return model


def out_of_fold_lists(pairs: DataFrame, features: Sequence[str], folds: int, seed: str, **params) -> DataFrame:
    """Every pair scored by a ranker that has not seen its user's list; lists are never divided."""
    work = materialise(pairs.withColumn("fold", (hash_int(seed, F.col("user")) % folds).cast("int")))
    out = None
    for k in range(folds):
        one = fit_listwise(work.where(F.col("fold") != k), features, **params).score(work.where(F.col("fold") == k))
        out = one if out is None else out.unionByName(one)
    return out
