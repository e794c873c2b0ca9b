"""Blocked products: all-pairs scoring without a cross join and without emitting the pairs.

Both sides are cut into hash blocks of bounded size. A task gets one block of each side,
multiplies them with NumPy and hands on only the best k per query, or sums per item pair.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from savora.functions.ordering import global_order
from savora.operators.popularity import top_per_group
from savora.session import materialise

# Blocks hold at least FEWEST rows and at most MOST, and between them a side falls into SIDE_BLOCKS. A row is sent once per block
# of the other side, so what is moved grows with the number of blocks.
FEWEST, MOST, SIDE_BLOCKS = 16_384, 262_144, 12
QUERY_CHUNK = 256
ITEM_CHUNK = 2048
SLICE = 20_000


def block_size(rows: int) -> int:
    """Rows in a block of a side of `rows` rows."""
    return max(FEWEST, min(MOST, -(-rows // SIDE_BLOCKS)))


def _blocks(df: DataFrame, size: int | None) -> Column:
    """Number of blocks for a frame, as a scalar subquery."""
    n = F.count("*")
    rows = F.greatest(F.lit(FEWEST), F.least(F.lit(MOST), F.ceil(n / SIDE_BLOCKS))) if size is None else F.lit(size)
    return df.agg(F.greatest(F.ceil(n / rows), F.lit(1)).cast("int")).scalar()


def _block_of(id_col: Column, n: Column) -> Column:
    return F.pmod(F.xxhash64(id_col.cast("long")), n).cast("int")


def _scorer(normalise: bool, skip_same: bool, digits: int):
    """A task function: of every query its `ask` best items of a block that score at least its `floor`.

    Scores are first taken in single precision for a chunk of queries and items at a time. Only those that come within rounding
    of a query's last place so far are taken again in double precision, so the result is that of all scores in double precision.
    Dot products meet items by falling length, and a query leaves out chunks that cannot reach its last place.
    """
    # Task functions carry all they need: executors have NumPy, not this package.
    query_chunk, item_chunk, stretch, unit = QUERY_CHUNK, ITEM_CHUNK, 256, 10.0**-digits

    def best(qid: np.ndarray, ask: np.ndarray, floor: np.ndarray, qm: np.ndarray, iid: np.ndarray, im: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if normalise:
            qm = qm / np.maximum(np.linalg.norm(qm, axis=1, keepdims=True), 1e-12)
            im = im / np.maximum(np.linalg.norm(im, axis=1, keepdims=True), 1e-12)
        # Numbers that all queries share add the same to an item's scores; only the others make a bound by length loose.
        own = np.flatnonzero((qm != qm[0]).any(axis=0)) if not normalise else np.arange(qm.shape[1])
        shared = np.setdiff1d(np.arange(qm.shape[1]), own)
        add = im[:, shared] @ qm[0, shared]
        qlen, ilen = np.linalg.norm(qm[:, own], axis=1), np.linalg.norm(im[:, own], axis=1)
        most = max(np.abs(qm).max(initial=0.0), np.abs(im).max(initial=0.0))
        plain = bool(np.isfinite(qm).all() and np.isfinite(im).all() and most < 1e15)
        bounded = plain and not normalise
        order = np.lexsort((iid, -(ilen * qlen.mean() + add))) if bounded else np.argsort(iid, kind="stable")
        iid, im, ilen, add = iid[order], im[order], ilen[order], add[order]
        small = np.float32 if plain else np.float64
        sm = im.astype(small)
        # Rounding of single-precision products and of the numbers in them.
        loose = (im.shape[1] + 4) * 2.0 ** (-23 if plain else -52) * np.linalg.norm(im, axis=1).max(initial=0.0)
        starts = np.arange(0, len(iid), item_chunk)
        if bounded:
            top_add, top_len = (np.maximum.reduceat(x, starts) for x in (add, ilen))
            pivot = max(float(qlen.mean()), 1e-30)
            top_key = np.maximum.reduceat(ilen * pivot + add, starts)
        out = []
        # Queries of like numbers to ask for share a chunk.
        turn = np.lexsort((qlen, ask))
        for lo in range(0, len(qid), query_chunk):
            some = turn[lo : lo + query_chunk]
            q, wanted, least = qm[some], ask[some], np.where(np.isnan(floor[some]), -np.inf, floor[some])
            slack = 2 * unit + loose * np.linalg.norm(q, axis=1) if plain else np.full(len(some), np.inf)
            qs, last, last_id = q.astype(small), np.full(len(some), -np.inf), np.zeros(len(some), iid.dtype)
            first = int(wanted.max()) + skip_same
            held, fresh, n_fresh = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)], [], 0
            if bounded:
                share = (qlen[some] / pivot)[:, None]
                reach = np.where(share <= 1, share * top_key + (1 - share) * top_add, top_key + (share - 1) * pivot * top_len)
                reach = np.minimum(reach, qlen[some][:, None] * top_len + top_add) * (1 + 1e-9) + np.abs(reach) * 2e-9 + slack[:, None]

            def merge():
                row, item, value = (np.concatenate([h, *f]) for h, f in zip(held, zip(*fresh)))  # noqa: B023
                sort = np.lexsort((iid[item], -value, row))
                row, item, value = row[sort], item[sort], value[sort]
                begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                place = np.arange(len(row)) - np.repeat(begin, np.diff(np.append(begin, len(row))))
                end = place == wanted[row] - 1  # noqa: B023
                last[row[end]], last_id[row[end]] = value[end], iid[item[end]]  # noqa: B023
                keep = place < wanted[row]  # noqa: B023
                held[:] = row[keep], item[keep], value[keep]  # noqa: B023

            for number, at in enumerate(starts):
                bar = np.maximum(least, last)
                rows = np.flatnonzero(reach[:, number] >= bar) if bounded else None
                if rows is not None and not rows.size:
                    continue
                if rows is None or rows.size > 0.8 * len(some):
                    rows = np.arange(len(some))
                scores = (qs if rows.size == len(some) else qs[rows]) @ sm[at : at + item_chunk].T
                bar = bar[rows] - slack[rows] - np.where(np.isinf(bar[rows]), 0, np.abs(bar[rows])) * 1e-9
                if plain and number == 0 and first < scores.shape[1]:
                    bar = np.maximum(bar, np.partition(scores, -first, axis=1)[:, -first].astype(float) - 2 * slack[rows])
                # The best of every stretch first: few stretches hold a score that counts.
                wide = stretch if scores.shape[1] % stretch == 0 else scores.shape[1]
                each = scores.shape[1] // wide
                hit = np.flatnonzero(np.fmax.reduce(scores.reshape(len(rows), each, wide), axis=2) >= bar[:, None])
                if not hit.size:
                    continue
                r, c = np.divmod(np.flatnonzero(scores.reshape(-1, wide)[hit] >= bar[hit // each, None]), wide)
                r, c = rows[hit[r] // each], hit[r] % each * wide + c
                if r.size > scores.size // 8:
                    exact = np.round(q[rows] @ im[at : at + item_chunk].T, digits) + 0.0
                    r, c = np.nonzero(exact >= np.maximum(least, last)[rows, None])
                    value, r = exact[r, c], rows[r]
                else:
                    value = np.round(np.einsum("nd,nd->n", q[r], im[at + c]), digits) + 0.0
                c = c + at
                keep = (value >= least[r]) & (value > -np.inf) & ((value > last[r]) | (value == last[r]) & (iid[c] < last_id[r]))
                if skip_same:
                    keep &= iid[c] != qid[some[r]]
                fresh.append((r[keep], c[keep], value[keep]))
                n_fresh += int(keep.sum())
                if number == 0 or n_fresh > max(1024, int(wanted.sum())):
                    merge()
                    fresh, n_fresh = [], 0
            if fresh:
                merge()
            out.append((qid[some[held[0]]], iid[held[1]], held[2]))
        return tuple(np.concatenate([o[i] for o in out]) for i in range(3))

    def score(group: pa.Table) -> pa.Table:
        kind = group["kind"].to_numpy()
        sides = []
        for n in (0, 1):
            part = group.filter(pa.array(kind == n)).combine_chunks()
            size = pc.list_value_length(part["vec"])[0].as_py() if len(part) else 0
            sides.append((part, pc.list_flatten(part["vec"]).to_numpy().astype(np.float64).reshape(len(part), size)))
        (qs, qm), (its, im) = sides
        names = ["user", "item", "score"]
        if not len(qs) or not len(its):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        with np.errstate(invalid="ignore", over="ignore"):
            found = best(qs["id"].to_numpy(), qs["ask"].to_numpy(), qs["floor"].to_numpy(zero_copy_only=False).astype(float), qm, its["id"].to_numpy(), im)
        return pa.table([pa.array(x) for x in found], names=names)

    return score


def _best_in_blocks(rows: DataFrame, normalise: bool, skip_same: bool, digits: int) -> DataFrame:
    """Of every query its `ask` best items of every item block that score at least its `floor`, as (user, item, score).

    rows: (g, qb, ib, kind, id, ask, floor, vec) with kind 0 for queries and 1 for items; a null floor is none.
    """
    return rows.groupBy("g", "qb", "ib").applyInArrow(_scorer(normalise, skip_same, digits), "user long, item long, score double")


def _meet(queries: DataFrame, items: DataFrame, seen: DataFrame | None, asks: DataFrame | None, nq: Column, k: int, normalise: bool, skip_same: bool, digits: int) -> DataFrame:
    """Best k unseen items per query. queries: (user, vec, g, ib) once per item block to meet, items: (item, vec, g, ib).
    With a column `floor`, items that score less are left out.

    A query asks a block for k items more than it has seen there, and seen pairs are joined away afterwards,
    so no task holds the lists of its users.
    """
    none = F.lit(None).cast("long")
    if asks is not None:
        queries = queries.join(asks, ["user", "ib"], "left")
    floor = F.col("floor") if "floor" in queries.columns else F.lit(None)
    more = F.lit(0) if asks is None else F.coalesce("seen", F.lit(0))
    q = queries.select(
        "g", _block_of(F.col("user"), nq).alias("qb"), "ib", F.lit(0).alias("kind"), F.col("user").alias("id"), (more + k).cast("long").alias("ask"), floor.cast("double").alias("floor"), "vec"
    )
    i = items.select(
        "g", F.explode(F.sequence(F.lit(0), nq - 1)).alias("qb"), "ib", F.lit(1).alias("kind"), F.col("item").alias("id"), none.alias("ask"), none.cast("double").alias("floor"), "vec"
    )
    part = _best_in_blocks(q.unionByName(i), normalise, skip_same, digits)
    if seen is not None:
        part = part.join(seen, ["user", "item"], "left_anti")
    return top_per_group(part, ["user"], [F.desc("score"), F.asc("item")], k, rank="pos")


def _side(df: DataFrame, name: str, g: Column) -> DataFrame:
    return df.select(F.col(name).cast("long").alias(name), F.col("vec").cast("array<double>").alias("vec"), g.alias("g"))


def _pairs(seen: DataFrame) -> DataFrame:
    return seen.select(F.col("user").cast("long").alias("user"), F.col("item").cast("long").alias("item")).distinct()


def block_topk(
    queries: DataFrame, items: DataFrame, k: int, seen: DataFrame | None = None, normalise: bool = False,
    skip_same: bool = False, digits: int = 6, query_block: int | None = None, item_block: int | None = None,
    within: str | None = None, shared: int = 0,
) -> DataFrame:
    """Best k items per query by dot product (cosine with `normalise`).

    queries: (user, vec), items: (item, vec), both ids unique, seen: (user, item) pairs that may not appear. With
    `within`, a column of both sides, queries only meet items of their own value. `shared`: how many last numbers are
    the same in all query vectors, which makes bounds on scores closer.
    Returns (user, item, score, pos). Scores are rounded before ranking, so the order does not
    depend on the order of float additions. Dot products over more than one block of items are pruned by
    `pruned_topk`; the rows are the same.
    """
    if within is not None and seen is not None:
        raise ValueError("seen pairs carry no group; filter them beforehand")
    part_key = F.lit("") if within is None else F.col(within).cast("string")
    i = materialise(_side(items, "item", part_key))
    if within is None and not normalise and i.count() > (item_block or FEWEST):
        return pruned_topk(queries, i, k, seen, skip_same, digits, query_block, item_block, shared)[0]
    nq, ni = _blocks(queries, query_block), _blocks(i, item_block)
    q = _side(queries, "user", part_key).withColumn("ib", F.explode(F.sequence(F.lit(0), ni - 1)))
    block = _block_of(F.col("item"), ni)
    asks = None
    if seen is not None:
        seen = _pairs(seen)
        asks = seen.groupBy("user", block.alias("ib")).agg(F.count("*").alias("seen"))
    return _meet(q, i.withColumn("ib", block), seen, asks, nq, k, normalise, skip_same, digits)


def _length(vec: str) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x))


def pruned_topk(
    queries: DataFrame, items: DataFrame, k: int, seen: DataFrame | None = None, skip_same: bool = False,
    digits: int = 6, query_block: int | None = None, item_block: int | None = None, shared: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """`block_topk` by dot product over blocks of falling vector length, and (user, blocks): the blocks a query met.

    By Cauchy-Schwarz no item scores more than the query's length times its own, plus what the last `shared` numbers give,
    which are the same in all queries. Blocks hold items by falling bound for a query of mean length, and their largest length,
    shared part and bound limit the scores of any query. Rounds of 1, 2, 4, ... blocks raise each query's k-th score; a query
    meets a block only if the limit reaches that score (with the rounding added, so ties are found), and leaves when no
    later block's does. Blocks hand on only items that reach that score.
    """
    none = F.lit("")
    own, same = (f"slice(vec, 1, size(vec) - {shared})", f"slice(vec, size(vec) - {shared} + 1, {shared})")
    active = materialise(_side(queries, "user", none).withColumn("len", _length(F.expr(own))).withColumn("blocks", F.lit(0)))
    spark = active.sparkSession
    n_items, figures = items.count(), active.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), F.first(F.expr(same)).alias("shared")).first()
    pivot = figures["mean"] if figures["mean"] and figures["mean"] > 1e-30 else 1.0
    item_block = item_block or block_size(n_items)
    query_block = query_block or max(1024, min(MOST, -(-figures["n"] // (2 * SIDE_BLOCKS))))
    gives = F.aggregate(F.zip_with(F.expr(same), F.lit(figures["shared"]).cast("array<double>"), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) if shared and figures["n"] else F.lit(0.0)
    measured = _side(items, "item", none).withColumn("len", _length(F.expr(own))).withColumn("add", gives).withColumn("key", F.col("len") * pivot + F.col("add"))
    ordered = global_order(measured, F.struct((-F.col("key")).alias("a"), F.col("item").alias("b")), rank="rn")
    placed = materialise(ordered.select("item", "vec", "g", "len", "add", "key", F.floor((F.col("rn") - 1) / item_block).cast("int").alias("ib")))
    n_blocks = -(-n_items // item_block)
    most = placed.groupBy("ib").agg(*[F.max(c).alias(c) for c in ("len", "add", "key")])
    # Three numbers per block of items.
    limits = materialise(most.agg(F.array_sort(F.collect_list(F.struct("ib", "len", "add", "key"))).alias("m"))).agg(F.first("m")).scalar()

    def limit(m: Column) -> Column:
        """The highest score of a block for a query of length len."""
        times = F.col("len") / pivot
        by_key = F.when(times <= 1, times * m["key"] + (1 - times) * m["add"]).otherwise(m["key"] + (times - 1) * pivot * m["len"])
        high = F.least(F.col("len") * m["len"] + m["add"], by_key)
        return high + (F.abs(by_key) + F.col("len") * m["len"] + F.abs(m["add"])) * 1e-9 + 2 * 10.0**-digits

    asks = None
    if seen is not None:
        seen = materialise(_pairs(seen))
        asks = materialise(seen.join(placed.select("item", "ib"), "item").groupBy("user", "ib").agg(F.count("*").alias("seen")))
    best = spark.createDataFrame([], "user long, item long, score double, pos int")
    met = active.select("user", "blocks")
    lo, width = 0, 1
    while lo < n_blocks:
        hi = min(lo + width, n_blocks)
        kth = best.where(F.col("pos") == k).select("user", F.col("score").alias("kth"))
        reach = F.filter(F.sequence(F.lit(lo), F.lit(n_blocks - 1)), lambda b: F.col("kth").isNull() | (limit(F.get("limits", b)) >= F.col("kth")))
        active = materialise(
            active.drop("blocks", "floor").join(kth, "user", "left").withColumn("limits", limits).withColumn("reach", reach)
            .withColumnRenamed("kth", "floor").where("size(reach) > 0").withColumn("blocks", F.filter("reach", lambda b: b < hi)).drop("limits", "reach")
        )
        n = active.count()
        if n == 0:
            break
        met = met.unionByName(active.select("user", F.size("blocks").alias("blocks")))
        q = active.select("user", "vec", "g", "floor", F.explode("blocks").alias("ib"))
        its = placed.where((F.col("ib") >= lo) & (F.col("ib") < hi)).select("item", "vec", "g", "ib")
        found = _meet(q, its, seen, asks, F.lit(-(-n // query_block)), k, False, skip_same, digits)
        both = best.drop("pos").unionByName(found.drop("pos"))
        best = materialise(top_per_group(both, ["user"], [F.desc("score"), F.asc("item")], k, rank="pos"))
        lo, width = hi, width * 2
    return best, met.groupBy("user").agg(F.sum("blocks").alias("blocks"))


def sliced_join(left: DataFrame, right: DataFrame, key: str, size: int = SLICE) -> DataFrame:
    """`left.join(right, key)` in which no key value is met by more than about size x size rows in one task.

    Values with more than `size` rows on a side are cut into slices there, by hash of the row, and every pair of
    slices is a join key of its own. The table of such values has at most one row per `size` rows of input. Rows
    without a key are left out, as in the plain join.
    """
    count = lambda df, name: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    hot = materialise(count(left, "__l").join(count(right, "__r"), key).where("__l > 1 or __r > 1"))
    if hot.isEmpty():
        return left.join(right, key)

    def spread(df: DataFrame, own: str, other: str) -> DataFrame:
        known = df.join(hot, key, "left")
        mine = F.coalesce(F.pmod(F.xxhash64(*df.columns), F.col(f"__{own}")).cast("int"), F.lit(0)).alias(f"__s{own}")
        theirs = F.explode(F.sequence(F.lit(0), F.coalesce(f"__{other}", F.lit(1)) - 1)).alias(f"__s{other}")
        return known.select(*df.columns, mine, theirs)

    return spread(left, "l", "r").join(spread(right, "r", "l"), [key, "__sl", "__sr"]).drop("__sl", "__sr")


def heavy_pair_sums(heavy: DataFrame, users_per_slice: int = 256, item_block: int = 1024) -> DataFrame:
    """Co-occurrence sums of item pairs over users with very many items.

    heavy: (user, item, value). Every (item block, item block, user slice) is one bounded dense
    product, so a user with millions of items is spread over many tasks and a pair leaves a
    task once per slice, however many of its users share it. Returns (a, b, co, dot), a < b.
    """
    n_items = heavy.select("item").distinct()
    n_users = heavy.select("user").distinct()
    nb, ns = _blocks(n_items, item_block), _blocks(n_users, users_per_slice)
    base = heavy.select(
        "user", "item", "value", _block_of(F.col("item"), nb).alias("own"), _block_of(F.col("user"), ns).alias("slice")
    )
    rows = base.select(
        "user", "item", "value", "own", "slice", F.explode(F.sequence(F.lit(0), nb - 1)).alias("other")
    ).select(
        "user", "item", "value", "own", "slice",
        F.least("own", "other").alias("ba"), F.greatest("own", "other").alias("bb"),
    )

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        ba, bb = int(pdf["ba"].iloc[0]), int(pdf["bb"].iloc[0])
        users, u = np.unique(pdf["user"].to_numpy(np.int64), return_inverse=True)
        out = []

        def dense(part: pd.DataFrame, uu: np.ndarray):
            ids, col = np.unique(part["item"].to_numpy(np.int64), return_inverse=True)
            val, one = np.zeros((users.size, ids.size)), np.zeros((users.size, ids.size))
            val[uu, col] = part["value"].to_numpy(float)
            one[uu, col] = 1.0
            return ids, val, one

        left = (pdf["own"] == ba).to_numpy()
        right = (pdf["own"] == bb).to_numpy()
        if left.any() and right.any():
            xi, xv, xo = dense(pdf[left], u[left])
            yi, yv, yo = dense(pdf[right], u[right])
            dot, co = xv.T @ yv, xo.T @ yo
            r, c = np.nonzero(co)
            keep = (xi[r] < yi[c]) if ba == bb else np.ones(r.size, dtype=bool)
            r, c = r[keep], c[keep]
            out.append(pd.DataFrame({
                "a": np.minimum(xi[r], yi[c]), "b": np.maximum(xi[r], yi[c]), "co": co[r, c].astype("int64"), "dot": dot[r, c],
            }))
        if not out:
            return pd.DataFrame({"a": [], "b": [], "co": [], "dot": []}).astype({"a": "int64", "b": "int64", "co": "int64", "dot": "float64"})
        return out[0]

    return rows.groupBy("ba", "bb", "slice").applyInPandas(product, "a long, b long, co long, dot double")
