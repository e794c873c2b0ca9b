"""Graphs of users, items and metadata: edges, walks, negatives and neighbour aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from savora.functions.hashing import hash_int, hash_uniform
from savora.functions.ordering import bucket_of, prefix_sums, splitters
from savora.operators.ids import id_mapping
from savora.operators.popularity import top_per_group
from savora.session import cut_lineage, materialise, shuffled

# --- edges ----------------------------------------------------------------------------------


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    )


def user_item_edges(review: DataFrame, user: Column, item: Column, weight: Column | None, order: Sequence[str]) -> DataFrame:
    """One edge per pair; the last review's weight wins, 1 without weights."""
    pair = review.groupBy(user.alias("src"), item.alias("dst"))
    if weight is None:
        return pair.agg(F.lit(1.0).alias("weight"))
    return pair.agg(F.max_by(weight.cast("double"), F.struct(*order)).alias("weight"))


def metadata_edges(items: DataFrame, item: Column, meta: Column, neighbors: Column) -> DataFrame:
    """Item to its own metadata node and to the neighbouring ones."""
    own = items.select(item.alias("src"), meta.alias("dst"))
    near = items.select(item.alias("src"), F.explode(neighbors).alias("dst"))
    return own.unionByName(near).where("src is not null and dst is not null").distinct().withColumn("weight", F.lit(1.0))


def node_types(parts: dict[str, DataFrame]) -> DataFrame:
    """(id, meta) from one id frame per type; the column of each frame is its id."""
    out = None
    for meta, df in parts.items():
        one = df.select(F.col(df.columns[0]).alias("id")).where("id is not null").distinct().withColumn("meta", F.lit(meta))
        out = one if out is None else out.unionByName(one)
    return out


# --- transitions ----------------------------------------------------------------------------

def first_step(edges: DataFrame) -> DataFrame:
    """Probability w / sum of weights of the source node."""
    totals = edges.groupBy("src").agg(F.sum("weight").alias("__t"))
    return edges.join(totals, "src").select("src", "dst", (F.col("weight") / F.col("__t")).alias("prob"))


def triangle_weights(edges: DataFrame) -> DataFrame:
    """(prev, cur, tri): weight from cur to nodes that are also neighbours of prev.

    Triangles are listed once, from their lowest-degree corner: then even hubs meet at most
    sqrt(2 * edges) later neighbours, where a plain self-join would list degree squared.
    """
    edges = materialise(edges)
    deg = edges.groupBy("src").agg(F.count("*").alias("d"))
    ds = deg.select("src", F.col("d").alias("d1"))
    dd = deg.select(F.col("src").alias("dst"), F.col("d").alias("d2"))
    lower = (F.col("d1") < F.col("d2")) | ((F.col("d1") == F.col("d2")) & (F.col("src") < F.col("dst")))
    up = edges.select("src", "dst").join(ds, "src").join(dd, "dst").where(lower).select("src", "dst")
    x = up.select("src", F.col("dst").alias("b"))
    y = up.select(F.col("src"), F.col("dst").alias("c"))
    wedge = x.join(y, "src").where(F.col("b") != F.col("c"))
    closed = wedge.join(up.select(F.col("src").alias("b"), F.col("dst").alias("c")), ["b", "c"]).select(F.col("src").alias("a"), "b", "c")
    corners = F.array(*[
        F.struct(F.col(p).alias("prev"), F.col(c).alias("src"), F.col(d).alias("dst"))
        for p, c, d in (("a", "b", "c"), ("a", "c", "b"), ("b", "a", "c"), ("b", "c", "a"), ("c", "a", "b"), ("c", "b", "a"))
    ])
    return (
        closed.select(F.inline(corners)).join(edges, ["src", "dst"]).groupBy("prev", F.col("src").alias("cur"))
        .agg(F.sum("weight").alias("tri"))
    )


def second_order(edges: DataFrame, p: float, q: float) -> DataFrame:
    """(p,q)-biased transitions in closed form, one row per directed edge prev -> cur.

    A next node dst gets w(cur,dst) times `back` when dst is prev, `near` when it neighbours
    prev, else `far`. Listing every (prev, cur, dst) would take the sum of squared degrees; the
    three factors say the same with one row per edge.
    """
    totals = edges.groupBy(F.col("src").alias("cur")).agg(F.sum("weight").alias("total"))
    steps = edges.select(F.col("dst").alias("prev"), F.col("src").alias("cur"), F.col("weight").alias("w_back"))
    tri = triangle_weights(edges)
    norm = F.col("w_back") / p + F.col("tri") + (F.col("total") - F.col("w_back") - F.col("tri")) / q
    return (
        steps.join(totals, "cur").join(tri, ["prev", "cur"], "left").fillna(0.0, subset=["tri"])
        .withColumn("norm", norm)
        .select("prev", "cur", "norm", (1.0 / (F.col("norm") * p)).alias("back"), (1.0 / F.col("norm")).alias("near"), (1.0 / (F.col("norm") * q)).alias("far"))
    )


# --- walks ----------------------------------------------------------------------------------

def numbered_neighbors(edges: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Edges with the 0-based place of dst among the source's neighbours, and the degree of dst.

    Places come from bucketed prefix sums, so a hub's neighbours are never sorted in one task.
    A walker picks place hash % degree: one equi-join on (src, place) per step that no hub skews.
    """
    group = ["src", *extra]
    cuts = splitters(edges, F.col("dst"))
    placed = prefix_sums(edges, group, bucket_of(F.col("dst"), cuts), [F.col("dst")], {"place": F.lit(1).cast("long")})
    return placed


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("deg"))


def uniform_walks(edges: DataFrame, walks_per_node: int, length: int, seed: str, checkpoint_every: int = 5) -> DataFrame:
    """Walks of `length` nodes on a graph without weights: equally likely next nodes, in long
    form (start, walk, step, node). Graphs are both-way, so a walk never meets a dead end unless
    its start has no neighbour."""
    edges = materialise(edges.select("src", "dst"))
    deg = materialise(degrees(edges))
    nbr = numbered_neighbors(edges).join(deg.select(F.col("src").alias("dst"), F.col("deg").alias("next_deg")), "dst", "left")
    nbr = materialise(nbr.select("src", "place", "dst", F.coalesce("next_deg", F.lit(0)).alias("next_deg")))
    front = deg.select(
        F.col("src").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(walks_per_node - 1))).alias("walk"),
        F.col("src").alias("node"), "deg",
    )
    done = front.select("start", "walk", F.lit(0).alias("step"), "node")
    for step in range(1, length):
        pick = hash_int(seed, F.col("start"), F.col("walk"), F.lit(step)) % F.col("deg")
        front = (
            front.where("deg > 0").select("start", "walk", F.col("node").alias("src"), pick.alias("place"))
            .join(nbr, ["src", "place"]).select("start", "walk", F.col("dst").alias("node"), F.col("next_deg").alias("deg"))
        )
        if step % checkpoint_every == 0:
            front = cut_lineage(front)
        done = done.unionByName(front.select("start", "walk", F.lit(step).alias("step"), "node"))
    return done


# Weights are resolved to this fraction of a node's largest; sums of whole units leave neither gaps nor overlaps.
UNITS = 1_000_000_000
CELLS_PER_ROW = 65_536


def unit_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, units): weights in units of each node's largest one, at least one unit. Edges without a positive
    weight are never walked and go. The largest weight does not depend on the order of additions."""
    edges = edges.select("src", "dst", "weight").where("weight > 0")
    most = edges.groupBy("src").agg(F.max("weight").alias("__most"))
    units = F.round(F.col("weight") / F.col("__most") * UNITS).cast("long")
    return edges.join(most, "src").select("src", "dst", F.greatest(units, F.lit(1).cast("long")).alias("units"))


def weight_sums(units: DataFrame) -> DataFrame:
    """(src, deg, total): degree and sum of weight units."""
    return units.groupBy("src").agg(F.count("*").alias("deg"), F.sum("units").alias("total"))


def weighted_neighbors(edges: DataFrame) -> DataFrame:
    """Edges laid out by cumulative weight, for draws in proportion to it, with degree and total of dst.

    The total of a node with d neighbours is cut into d equal cells, and an edge is listed in every
    cell that its interval [lo, hi) meets: at most 2d entries, two per draw on average. A draw is one
    equi-join on (src, cell) that no hub skews, however uneven the weights are.
    """
    units = materialise(unit_edges(edges))
    sums = materialise(weight_sums(units))
    cuts = splitters(units, F.col("dst"))
    placed = prefix_sums(units, ["src"], bucket_of(F.col("dst"), cuts), [F.col("dst")], {"lo": F.col("units")})

    def cell(at: Column, slack: float) -> Column:
        raw = F.floor(at.cast("double") * F.col("deg") / F.col("total") + slack)
        return F.greatest(F.least(raw, F.col("deg") - 1), F.lit(0).cast("long"))

    laid = placed.join(sums, "src").withColumn("hi", F.col("lo") + F.col("units"))
    laid = laid.select("src", "dst", "lo", "hi", cell(F.col("lo"), -1e-6).alias("a"), cell(F.col("hi"), 1e-6).alias("z"))
    # Two levels: one edge may cover nearly all cells of a hub.
    laid = laid.withColumn("a", F.explode(F.sequence("a", "z", F.lit(CELLS_PER_ROW).cast("long"))))
    laid = laid.withColumn("cell", F.explode(F.sequence("a", F.least(F.col("z"), F.col("a") + CELLS_PER_ROW - 1))))
    after = sums.select(F.col("src").alias("dst"), F.col("deg").alias("next_deg"), F.col("total").alias("next_total"))
    zero = F.lit(0).cast("long")
    return laid.join(after, "dst", "left").select(
        "src", "cell", "dst", "lo", "hi", F.coalesce("next_deg", zero).alias("next_deg"), F.coalesce("next_total", zero).alias("next_total")
    )


def _draw(walkers: DataFrame, nbr: DataFrame, uniform: Column) -> DataFrame:
    """Walkers (node, deg, total, ...) with the neighbour that `uniform` in [0, 1) draws, as dst."""
    at = walkers.where("deg > 0").withColumn("__u", uniform).withColumn("src", F.col("node"))
    at = at.withColumn("cell", F.floor(F.col("__u") * F.col("deg"))).withColumn("__x", F.col("__u") * F.col("total"))
    return at.join(nbr, ["src", "cell"]).where("lo <= __x and __x < hi").drop("src", "cell", "lo", "hi", "__u", "__x")


def _starts(sums: DataFrame, walks_per_node: int) -> DataFrame:
    walk = F.explode(F.sequence(F.lit(0), F.lit(walks_per_node - 1))).alias("walk")
    return sums.select(F.col("src").alias("start"), walk, F.col("src").alias("node"), "deg", "total")


def weighted_walks(edges: DataFrame, walks_per_node: int, length: int, seed: str, checkpoint_every: int = 5) -> DataFrame:
    """Walks whose next node is drawn in proportion to the edge weights (p = q = 1), in long form
    (start, walk, step, node). A walk ends early at a node without neighbours."""
    edges = materialise(edges)
    nbr = materialise(weighted_neighbors(edges))
    front = _starts(materialise(weight_sums(unit_edges(edges))), walks_per_node)
    done = front.select("start", "walk", F.lit(0).alias("step"), "node")
    for step in range(1, length):
        front = _draw(front, nbr, hash_uniform(seed, F.col("start"), F.col("walk"), F.lit(step))).select(
            "start", "walk", F.col("dst").alias("node"), F.col("next_deg").alias("deg"), F.col("next_total").alias("total")
        )
        if step % checkpoint_every == 0:
            front = cut_lineage(front)
        done = done.unionByName(front.select("start", "walk", F.lit(step).alias("step"), "node"))
    return done


def biased_walks(edges: DataFrame, walks_per_node: int, length: int, p: float, q: float, seed: str, tries: int = 8, most_tries: int = 512) -> DataFrame:
    """(p,q)-biased weighted walks by rejection.

    A walker draws neighbours by weight and keeps the first one whose bias passes its threshold;
    that is exactly the biased distribution, and needs neither the transition table nor a look at
    all neighbours of a hub. Weights do not lower the chance of a draw to be kept, which is at least
    min(1, 1/p, 1/q) / max(1, 1/p, 1/q); walkers without one go into another round with twice the
    draws, until none is left. Draws after one that is kept in any case are not made.
    """
    edges = materialise(edges)
    nbr = materialise(weighted_neighbors(edges))
    pairs = edges.where("weight > 0").select(F.col("src").alias("prev"), "dst", F.lit(1).alias("__near")).distinct()
    pairs = materialise(pairs)
    top = max(1.0, 1.0 / p, 1.0 / q)
    front = _starts(weight_sums(unit_edges(edges)), walks_per_node).withColumn("prev", F.lit(None).cast(edges.schema["src"].dataType))
    front = cut_lineage(front)
    done = front.select("start", "walk", F.lit(0).alias("step"), "node")
    # A draw under `sure` is kept whatever it is (with room for rounding), so nothing is drawn after it.
    sure = min(1.0, 1.0 / p, 1.0 / q) / top * (1 - 1e-9)
    for step in range(1, length):
        # Rounds that nearly all walkers end in share their joins.
        open_walkers, moved, rounds = front.where("deg > 0"), None, [0, 1, 2]
        while True:
            key = lambda round_no, t: [F.col("start"), F.col("walk"), F.lit(step), round_no, t]  # noqa: B023, E731
            draws, lists, still = open_walkers, [], F.lit(True)
            for r in rounds:
                n = min(tries * 2**r, most_tries)
                one = lambda t: F.struct(F.lit(r).alias("round"), t.alias("t"), hash_uniform(seed, F.lit("keep"), *key(F.lit(r), t)).alias("k"))  # noqa: B023, E731
                draws = draws.withColumn(f"__c{r}", F.when(still, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one)))
                kept = F.transform(f"__c{r}", lambda x: F.col("prev").isNull() | (x["k"] < sure))
                draws = draws.withColumn(f"__f{r}", F.coalesce(F.array_position(kept, True), F.lit(0)).cast("int"))
                lists.append(F.when(F.col(f"__f{r}") > 0, F.slice(f"__c{r}", F.lit(1), F.greatest(F.col(f"__f{r}"), F.lit(1)))).otherwise(F.coalesce(f"__c{r}", F.slice(f"__c{rounds[0]}", 1, 0))))
                still = still & (F.col(f"__f{r}") == 0)
            draws = draws.select(*open_walkers.columns, F.inline(F.concat(*lists)))
            drawn = _draw(draws, nbr, hash_uniform(seed, F.lit("pick"), *key(F.col("round"), F.col("t"))))
            drawn = drawn.join(pairs, ["prev", "dst"], "left") if step > 1 else drawn.withColumn("__near", F.lit(None).cast("int"))
            bias = F.when(F.col("prev").isNull(), F.lit(top)).when(F.col("dst") == F.col("prev"), F.lit(1.0 / p)).when(
                F.col("__near") == 1, F.lit(1.0)).otherwise(F.lit(1.0 / q))
            taken = drawn.where(F.col("k") * F.lit(top) < bias).groupBy("start", "walk", F.col("node").alias("prev")).agg(
                F.min_by(F.struct(F.col("dst").alias("node"), F.col("next_deg").alias("deg"), F.col("next_total").alias("total")), F.struct("round", "t")).alias("b"))
            taken = cut_lineage(taken.select("start", "walk", "prev", "b.*"))
            moved = taken if moved is None else moved.unionByName(taken)
            open_walkers = cut_lineage(open_walkers.join(taken.select("start", "walk"), ["start", "walk"], "left_anti"))
            if open_walkers.isEmpty():
                break
            rounds = [rounds[-1] + 1]
        front = cut_lineage(moved)
        done = done.unionByName(front.select("start", "walk", F.lit(step).alias("step"), "node"))
    return done


def typed_neighbors(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, meta of dst, dst, prob): neighbours of each type are equally likely."""
    typed = edges.select("src", "dst").join(nodes.select(F.col("id").alias("dst"), "meta"), "dst")
    sizes = typed.groupBy("src", "meta").agg(F.count("*").alias("n"))
    return typed.join(sizes, ["src", "meta"]).select("src", "meta", "dst", "n", (1.0 / F.col("n")).alias("prob"))


def metapath_walks(edges: DataFrame, nodes: DataFrame, path: Sequence[str], walks_per_node: int, seed: str) -> DataFrame:
    """Walks whose node types follow `path`; only complete ones, one row (start, walk, step, node)
    per node."""
    nodes = materialise(nodes)
    typed = materialise(edges.select("src", "dst").join(nodes.select(F.col("id").alias("dst"), "meta"), "dst").select("src", "meta", "dst"))
    nbr = materialise(numbered_neighbors(typed, ["meta"]).select("src", "meta", "place", "dst"))
    sizes = materialise(nbr.groupBy("src", "meta").agg(F.count("*").alias("deg")))

    def towards(meta: str) -> DataFrame:
        return sizes.where(F.col("meta") == meta).drop("meta")

    # Each move carries the degree its walker needs next, so walkers never meet on a hub's key.
    moves = {}
    for meta, then in zip(path[1:-1], path[2:]):
        if (meta, then) not in moves:
            moves[meta, then] = materialise(nbr.where(F.col("meta") == meta).drop("meta").join(towards(then).withColumnRenamed("src", "dst"), "dst"))
    front = nodes.where(F.col("meta") == path[0]).join(towards(path[1]), F.col("id") == F.col("src")).select(
        F.col("id").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(walks_per_node - 1))).alias("walk"),
        F.col("id").alias("node"), "deg", F.array("id").alias("nodes"),
    )
    for step, meta in enumerate(path[1:], start=1):
        pick = hash_int(seed, F.col("start"), F.col("walk"), F.lit(step)) % F.col("deg")
        last = step == len(path) - 1
        move = nbr.where(F.col("meta") == meta).drop("meta").withColumn("deg", F.lit(0)) if last else moves[meta, path[step + 1]]
        front = (
            front.select("start", "walk", "nodes", F.col("node").alias("src"), pick.alias("place")).join(move, ["src", "place"])
            .select("start", "walk", F.col("dst").alias("node"), "deg", F.concat("nodes", F.array("dst")).alias("nodes"))
        )
    return front.select("start", "walk", F.posexplode("nodes").alias("step", "node"))


# --- negatives for walks --------------------------------------------------------------------

def uniform_negatives(nodes: DataFrame, per_node: int, seed: str) -> DataFrame:
    """`per_node` equally likely nodes for each start node (start, draw, node)."""
    nodes = materialise(nodes.select("id").distinct())
    idx = id_mapping(nodes, "id", "idx")
    n = nodes.select("id").distinct().agg(F.count("*")).scalar()
    draws = nodes.select(F.col("id").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(per_node - 1))).alias("draw"))
    return draws.withColumn("idx", hash_int(seed, F.col("start"), F.col("draw")) % n).join(idx, "idx").select(
        "start", "draw", F.col("id").alias("node")
    )


def typed_negatives(nodes: DataFrame, per_node: int, seed: str) -> DataFrame:
    """Like `uniform_negatives`, drawn among nodes of the start node's own type."""
    nodes = materialise(nodes)
    cuts = splitters(nodes, F.col("id"))
    placed = prefix_sums(nodes, ["meta"], bucket_of(F.col("id"), cuts), [F.col("id")], {"idx": F.lit(1).cast("long")})
    sizes = nodes.groupBy("meta").agg(F.count("*").alias("n"))
    draws = nodes.join(sizes, "meta").select(
        F.col("id").alias("start"), "meta", "n", F.explode(F.sequence(F.lit(0), F.lit(per_node - 1))).alias("draw")
    )
    return draws.withColumn("idx", hash_int(seed, F.col("start"), F.col("draw")) % F.col("n")).join(
        placed.select("meta", "idx", F.col("id").alias("node")), ["meta", "idx"]
    ).select("start", "meta", "draw", "node")


# --- neighbour aggregation ------------------------------------------------------------------

def sample_neighbors(edges: DataFrame, size: int, seed: str) -> DataFrame:
    """At most `size` neighbours per node without replacement, by hash order."""
    h = hash_int(seed, F.col("src"), F.col("dst"))
    return top_per_group(edges.withColumn("__h", h), ["src"], [F.asc("__h"), F.asc("dst")], size).drop("__h")


def aggregate_vectors(rows: DataFrame, key: str, vec: str, dim: int, how: str = "mean", weight: Column | None = None) -> DataFrame:
    """Element-wise mean, max or (weighted) sum of vectors per key: one aggregate per dimension
    with map-side combine, so hubs need neither a list of vectors nor an exploded row per element."""
    fn = {"mean": F.avg, "max": F.max, "sum": F.sum}[how]
    w = F.lit(1.0) if weight is None else weight
    work = rows.withColumn("__w", w)
    out = work.groupBy(key).agg(*[fn(F.get(vec, F.lit(i)).cast("double") * F.col("__w")).alias(f"__d{i}") for i in range(dim)])
    return out.select(key, F.array(*[f"__d{i}" for i in range(dim)]).alias(vec))


def l2_normalise(vec: str) -> Column:
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(vec, lambda x: x / norm)).otherwise(F.col(vec))


def sage_layers(edges: DataFrame, features: DataFrame, dim: int, layers: int, sample: int, seed: str, how: str = "mean") -> DataFrame:
    """Neighbour aggregation without learned weights: per layer the normalised concatenation of
    own and aggregated neighbour vector, folded back to `dim` by adding the halves."""
    h = features.select("id", F.transform("vec", lambda x: x.cast("double")).alias("vec"))
    for layer in range(layers):
        near = sample_neighbors(edges.select("src", "dst"), sample, f"{seed}-{layer}")
        msg = near.join(h.withColumnRenamed("id", "dst"), "dst")
        agg = aggregate_vectors(msg, "src", "vec", dim, how).select(F.col("src").alias("id"), F.col("vec").alias("nvec"))
        zero = F.array(*[F.lit(0.0)] * dim)
        joined = h.join(agg, "id", "left").select("id", F.zip_with("vec", F.coalesce("nvec", zero), lambda a, b: a + b).alias("vec"))
        h = joined.select("id", l2_normalise("vec").alias("vec"))
        if layer + 1 < layers:
            h = cut_lineage(h)
    return h


def light_propagation(edges: DataFrame, features: DataFrame, dim: int, layers: int, drop_ratio: float = 0.0, seed: str = "drop") -> DataFrame:
    """Mean over layers 0..L of D^-1/2 A D^-1/2 applied repeatedly; edges may be dropped by hash."""
    if drop_ratio > 0:
        pair = [F.least("src", "dst"), F.greatest("src", "dst")]
        edges = edges.where(hash_uniform(seed, *pair) >= drop_ratio)
    return propagate(normalised_edges(edges), features, dim, layers)


def normalised_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, w) of D^-1/2 A D^-1/2, written: layer sums read it once per layer and degrees never change."""
    edges = materialise(edges)
    strength = edges.groupBy("src").agg(F.sum("weight").alias("__s"))
    return materialise(
        edges.join(shuffled(strength), "src").join(shuffled(strength.select(F.col("src").alias("dst"), F.col("__s").alias("__t"))), "dst")
        .select("src", "dst", (F.col("weight") / (F.sqrt("__s") * F.sqrt("__t"))).alias("w"))
    )


def propagate(norm: DataFrame, features: DataFrame, dim: int, layers: int) -> DataFrame:
    """Mean of the features after 0..L steps over normalised edges. Linear, and its own transpose where edges go both ways."""
    features = materialise(features)
    h = features.select("id", F.transform("vec", lambda x: x.cast("double")).alias("vec"))
    total = h
    zero = F.array(*[F.lit(0.0)] * dim)
    for layer in range(layers):
        msg = norm.join(shuffled(h.withColumnRenamed("id", "dst")), "dst")
        step = aggregate_vectors(msg, "src", "vec", dim, "sum", F.col("w")).withColumnRenamed("src", "id")
        h = cut_lineage(features.select("id").join(shuffled(step), "id", "left").select("id", F.coalesce("vec", zero).alias("vec")))
        total = total.join(shuffled(h.withColumnRenamed("vec", "__n")), "id").select("id", F.zip_with("vec", "__n", lambda a, b: a + b).alias("vec"))
    return total.select("id", F.transform("vec", lambda x: x / F.lit(float(layers + 1))).alias("vec"))


def pairwise_gradients(vectors: DataFrame, triples: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """Gradient (id, vec) of the summed pairwise-ranking loss -ln sigmoid(u.(p - n)) by vector, and the rows
    (loss) of all triples (user, positive, negative). Hub nodes are aggregated map-side, a dimension at a time."""
    side = lambda name: shuffled(vectors.select(F.col("id").alias(name), F.col("vec").alias(f"v_{name}")))
    rows = triples.select("user", "positive", "negative").join(side("user"), "user").join(side("positive"), "positive").join(side("negative"), "negative")
    away = F.zip_with("v_positive", "v_negative", lambda a, b: a - b)
    margin = F.aggregate(F.zip_with("v_user", away, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    rows = materialise(rows.select("user", "positive", "negative", "v_user", away.alias("away"), margin.alias("margin")).withColumn("pull", 1 / (1 + F.exp("margin"))))
    parts = (
        rows.select(F.col("user").alias("id"), F.col("away").alias("vec"), (-F.col("pull")).alias("w"))
        .unionByName(rows.select(F.col("positive").alias("id"), F.col("v_user").alias("vec"), (-F.col("pull")).alias("w")))
        .unionByName(rows.select(F.col("negative").alias("id"), F.col("v_user").alias("vec"), F.col("pull").alias("w")))
    )
    return aggregate_vectors(parts, "id", "vec", dim, "sum", F.col("w")), rows.select(F.log1p(F.exp(-F.col("margin"))).alias("loss"))


def fit_light(edges: DataFrame, triples, start: DataFrame, dim: int, layers: int, epochs: int = 10, rate: float = 0.1, l2: float = 1e-4) -> tuple[DataFrame, list[float]]:
    """Start vectors learned by pairwise ranking of the propagated ones, and the mean loss before every epoch.

    `triples(epoch)` gives (user, positive, negative) node ids. The gradient by the propagated vectors goes back
    through the propagation, which is its own transpose, by the same joins. A node's step is divided by the norm
    of the whole gradient's mean, so the rate does not depend on the number of triples.
    """
    norm = normalised_edges(edges)
    start, history = materialise(start.select("id", F.transform("vec", lambda x: x.cast("double")).alias("vec"))), []
    for epoch in range(epochs):
        out = materialise(propagate(norm, start, dim, layers))
        grad, losses = pairwise_gradients(out, triples(epoch), dim)
        history.append(losses.agg(F.avg("loss")).first()[0] or 0.0)
        zero = F.array(*[F.lit(0.0)] * dim)
        full = start.select("id").join(shuffled(grad), "id", "left").select("id", F.coalesce("vec", zero).alias("vec"))
        back = materialise(propagate(norm, full, dim, layers))
        size = back.agg(F.sqrt(F.avg(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)))).first()[0] or 1.0
        pulled = F.zip_with("vec", "g", lambda a, b: a * (1 - rate * l2) - b * F.lit(rate / max(size, 1e-12)))
        start = materialise(start.join(shuffled(back.withColumnRenamed("vec", "g")), "id").select("id", pulled.alias("vec")))
    return start, history


def hash_vectors(nodes: DataFrame, dim: int, seed: str) -> DataFrame:
    """Reproducible start vectors in [-0.5, 0.5)."""
    return nodes.select("id", F.array(*[hash_uniform(seed, F.col("id"), F.lit(i)) - 0.5 for i in range(dim)]).alias("vec"))
