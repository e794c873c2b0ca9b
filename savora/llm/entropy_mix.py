"""Mixing sources to target weights by entropy balancing.

Among all document rates between 0 and `CAP` that give each source its target of words, the ones closest
to 1 in entropy are exp(tilt * size), cut at the cap. The tilts solve the convex dual by Newton steps; each
step is one distributed aggregate over (source, size) counts, kept inside a shrinking bracket. The rates
are then rounded to whole copies by error diffusion in bounded, hashed buckets of each source.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from savora.llm.common import n_words
from savora.session import materialise

CAP = 2.0
TOTAL = 1.5
WEIGHTS = (3, 1, 2)  # repeating, by source in code point order, null last
TOLERANCE = 1e-6
MAX_STEPS = 60  # the bracket halves at least every other step, so this bounds the error, not the data
ROUND_ROWS = 2_000


def source_targets(sizes: DataFrame, source: str = "source", size: str = "size", weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """source, n, source_size, weight, target. Targets share `total` of all sizes by weight; a target stops
    at `cap` times its source and the excess goes to the others, so target = min(cap * size, level *
    weight) with one level for all. Windows here run over one row per source."""
    per = sizes.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"), F.sum(size).alias("source_size"), F.min(F.when(F.col(size) > 0, F.col(size))).alias("least"))
    by_name = W.orderBy(F.col("source").isNull(), F.col("source"))
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place + 1).cast("double"))
    room = F.col("source_size") * cap
    before = W.orderBy(room / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, -1)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(whole) * total - F.coalesce(F.sum(room).over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("__level", level).withColumn("__open", room >= F.col("__level") * F.col("weight"))
    per = per.withColumn("__first", F.min(F.when(F.col("__open"), F.struct(room / F.col("weight"), F.col("__level").alias("l")))).over(whole)["l"])
    return per.select("source", "n", "source_size", "least", "weight", F.least(room, F.coalesce(F.col("__first") * F.col("weight"), room)).alias("target"))


def tilts(sizes: DataFrame, targets: DataFrame, source: str = "source", size: str = "size", cap: float = CAP, tolerance: float = TOLERANCE) -> DataFrame:
    """source, scale and tilt per source: rates min(cap, exp(tilt * size / scale)) give the target. Sources at
    their cap, or without words, take every document `cap` times."""
    counts = materialise(sizes.where(F.col(size) > 0).groupBy(F.col(source).alias("source"), F.col(size).alias("size")).agg(F.count("*").alias("count")))
    t = targets.where("source_size > 0").select("*", (F.col("source_size") / F.col("n")).alias("scale"))
    top = F.log(F.lit(cap)) * F.col("scale") / F.col("least")
    state = materialise(t.select(
        F.col("source").alias("s"), "scale", "target", F.lit(-1024.0).alias("low"), top.alias("high"),
        F.when(F.col("target") >= F.col("source_size") * cap, top).otherwise(F.least(F.log(F.col("target") / F.col("source_size")), top)).alias("tilt"), (F.col("target") >= F.col("source_size") * cap).alias("fixed"),
    ))
    for _ in range(MAX_STEPS):
        x = F.col("size") / F.col("scale")
        free = F.col("tilt") * x < math.log(cap)
        rate = F.when(free, F.exp(F.col("tilt") * x)).otherwise(F.lit(cap))
        joined = counts.join(state, counts["source"].eqNullSafe(state["s"]))
        keys = ["s", "scale", "target", "low", "high", "tilt", "fixed"]
        sums = joined.groupBy(*keys).agg(F.sum(F.col("count") * F.col("size") * rate).alias("got"), F.sum(F.when(free, F.col("count") * F.col("size") * x * rate).otherwise(0.0)).alias("slope"))
        over = F.col("got") > F.col("target")
        stepped = sums.withColumns({"low": F.when(over, F.col("low")).otherwise(F.col("tilt")), "high": F.when(over, F.col("tilt")).otherwise(F.col("high")), "miss": F.abs(F.col("got") - F.col("target")) / F.col("target")})
        newton = F.col("tilt") + (F.col("target") - F.col("got")) / F.col("slope")
        settled = F.col("fixed") | (F.col("miss") <= tolerance)
        tilt = F.when(settled, F.col("tilt")).when((F.col("slope") > 0) & (newton > F.col("low")) & (newton < F.col("high")), newton).otherwise((F.col("low") + F.col("high")) / 2)
        state = materialise(stepped.select("s", "scale", "target", "low", "high", tilt.alias("tilt"), settled.alias("fixed")))
        if state.where("not fixed").isEmpty():
            break
    return state.select(F.col("s").alias("source"), "scale", "tilt")


def _diffuse(rate: np.ndarray, size: np.ndarray, cap: int) -> np.ndarray:
    """Copies for documents sorted by falling size: floor or ceiling of each rate, whichever leaves the
    smaller error; then single copies move wherever that shrinks what is left."""
    copies, error = np.empty(len(rate), np.int64), 0.0
    sizes = size.tolist()
    for i, r in enumerate(rate.tolist()):
        low = min(cap, int(r + 1e-9))
        c = low
        if r - low > 1e-9 and low < cap and abs(error + (r - low - 1) * sizes[i]) < abs(error + (r - low) * sizes[i]):
            c = low + 1
        error += (r - c) * sizes[i]
        copies[i] = c
    for i, s in enumerate(sizes):
        if s and error >= s / 2 + 1e-9 and copies[i] < cap:
            copies[i], error = copies[i] + 1, error - s
        elif s and -error >= s / 2 + 1e-9 and copies[i] > 0:
            copies[i], error = copies[i] - 1, error + s
    return copies


def mix(df: DataFrame, carry: tuple[str, ...] = ("doc_id",), text: str = "text", source: str = "source", cap: float = CAP) -> DataFrame:
    """The carried columns, source, size, source_size, target, rate, copies and taken of every row. Null
    texts have size 0; carried columns win over added ones of the same name; a null source is a source; documents without words keep one copy. Equal
    rows are rounded one by one. An empty table gives an empty result."""
    work = materialise(df.select(F.struct(*carry).alias("row"), F.col(source).alias("source"), n_words(F.col(text)).alias("size")))
    targets = materialise(source_targets(work, cap=cap))
    solved = tilts(work, targets, cap=cap).withColumnRenamed("source", "s")
    per = targets.join(solved, targets["source"].eqNullSafe(solved["s"]), "left").select(F.col("source").alias("s"), "n", "source_size", "target", "scale", "tilt")
    rows = work.join(per, work["source"].eqNullSafe(per["s"]))
    rate = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(F.least(F.lit(cap), F.exp(F.col("tilt") * F.col("size") / F.col("scale"))))
    bucket = F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / ROUND_ROWS))
    rows = rows.select("row", "source", "size", "source_size", "target", rate.alias("rate"), bucket.alias("bucket"), F.xxhash64("row", "size").alias("tie"))
    kind = rows.schema["row"].dataType.simpleString()
    out = f"row {kind}, source {rows.schema['source'].dataType.simpleString()}, size long, source_size long, target double, rate double, copies long"
    names = ["row", "source", "size", "source_size", "target", "rate"]

    def rounded(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "tie"], ascending=[False, True], kind="stable")
        return group[names].assign(copies=_diffuse(group["rate"].to_numpy(), group["size"].to_numpy(), int(cap)))

    made = rows.groupBy("source", "bucket").applyInPandas(rounded, out)
    added = {"source": F.col("source"), "size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "rate": F.col("rate"), "copies": F.col("copies"), "taken": F.col("copies") * F.col("size")}
    return made.select(*[F.col("row")[c].alias(c) for c in carry], *[v.alias(n) for n, v in added.items() if n not in carry])


def apply_copies(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Rows repeated by their copies; rows with none go."""
    return mixed.where("copies > 0").select(*columns, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy")).select(*columns)
