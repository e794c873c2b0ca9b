"""I: graph candidates. Items keep their id, users are shifted behind them, metadata nodes are
negative."""

from __future__ import annotations

from pyspark.sql import functions as F

from savora.functions import geo
from savora.functions.hashing import hash_int
from savora.operators import graph as G
from savora.operators import negatives as NG
from savora.operators import sage as SG
from savora.operators.blocks import block_topk
from savora.operators.skipgram import skip_gram
from savora.plans.features import hex_sql
from savora.plans.registry import query
from savora.plans.splits import HASH_SQL
from savora.session import materialise, scratch_path, shuffled
from savora.sources import files

SHIFT = 1_000_000_000_000
# One user-item edge per pair with the last review's score as weight.
PAIR_SQL = f"""SELECT reviewer_id + {SHIFT} AS src, diner_idx AS dst, CAST(arg_max(score, (review_date, review_id)) AS DOUBLE) AS weight FROM train GROUP BY 1, 2"""
BOTH_SQL = f"pairs AS ({PAIR_SQL}), edges AS (SELECT src, dst, weight FROM pairs UNION ALL SELECT dst, src, weight FROM pairs)"
META_KEY = "CAST(-1 - (({0} + 1000) * 10000000 + ({1} + 5000000) % 10000000) AS BIGINT)"


def user_node():
    return F.col("reviewer_id") + F.lit(SHIFT)


def pair_edges(t):
    return G.user_item_edges(t.hold("train").train, user_node(), F.col("diner_idx"), F.col("score"), ["review_date", "review_id"])


def edges(t):
    return G.both_ways(pair_edges(t))


def _meta_node(q, r):
    return (F.lit(-1) - ((q + 1000) * 10000000 + (r + 5000000) % 10000000)).cast("long")


def meta_edges(t):
    q, r = geo.axial(F.col("lat"), F.col("lon"), 6)
    d = t.diner.withColumn("q", q).withColumn("r", r)
    ring = F.array(*[_meta_node(F.col("q") + a, F.col("r") + b) for a, b, _ in geo.disk_offsets(1, True)])
    return G.metadata_edges(d, F.col("diner_idx"), _meta_node(F.col("q"), F.col("r")), ring)


META_SQL = f"""cells AS ({hex_sql('lat', 'lon', 6, 'diner')}),
 medges AS (SELECT DISTINCT diner_idx AS src, {META_KEY.format('(q + dq)', '(r + dr)')} AS dst, 1.0::DOUBLE AS weight FROM cells,
  (SELECT unnest([-1, 0, 1]) AS dq), (SELECT unnest([-1, 0, 1]) AS dr) WHERE greatest(abs(dq), abs(dr), abs(dq + dr)) <= 1)"""
TYPED_SQL = f"""pairs AS ({PAIR_SQL}), {META_SQL}, alle AS (SELECT src, dst, weight FROM pairs UNION ALL SELECT src, dst, weight FROM medges),
 edges AS (SELECT src, dst, weight FROM alle UNION ALL SELECT dst, src, weight FROM alle),
 nodes AS (SELECT DISTINCT src AS id, CASE WHEN src < 0 THEN 'category' WHEN src >= {SHIFT} THEN 'user' ELSE 'diner' END AS meta FROM edges)"""


def typed_graph(t):
    e = G.both_ways(pair_edges(t).unionByName(meta_edges(t)))
    users = t.train.select(user_node().alias("id"))
    diners = t.train.select(F.col("diner_idx").alias("id")).unionByName(t.diner.select(F.col("diner_idx").alias("id")))
    cats = meta_edges(t).select(F.col("dst").alias("id"))
    return e, G.node_types({"user": users, "diner": diners, "category": cats})


@query("i1_typed_edges", f"WITH {TYPED_SQL} SELECT src, dst, weight, s.meta AS src_meta, d.meta AS dst_meta FROM edges JOIN nodes s ON s.id = src JOIN nodes d ON d.id = dst")
def i1(t):
    e, n = typed_graph(t)
    return e.join(n.select(F.col("id").alias("src"), F.col("meta").alias("src_meta")), "src").join(
        n.select(F.col("id").alias("dst"), F.col("meta").alias("dst_meta")), "dst"
    ).select("src", "dst", "weight", "src_meta", "dst_meta")


@query("i2_both_directions", f"WITH {BOTH_SQL} SELECT src, dst FROM edges")
def i2(t):
    return edges(t).select("src", "dst")


@query("i3_first_step", f"WITH {BOTH_SQL} SELECT src, dst, round(weight / sum(weight) OVER (PARTITION BY src), 6) AS prob FROM edges")
def i3(t):
    return G.first_step(edges(t)).withColumn("prob", F.round("prob", 6))


@query("i4_second_order_factors", f"""
WITH {BOTH_SQL}, s AS (SELECT a.src AS prev, a.dst AS cur, sum(CASE WHEN b.dst = a.src THEN b.weight / 0.5 ELSE
  CASE WHEN c.src IS NOT NULL THEN b.weight ELSE b.weight / 2.0 END END) AS norm
 FROM edges a JOIN edges b ON a.dst = b.src LEFT JOIN edges c ON c.src = a.src AND c.dst = b.dst GROUP BY 1, 2)
SELECT prev, cur, round(norm, 6) AS norm, round(1 / (norm * 0.5), 6) AS back, round(1 / norm, 6) AS near, round(1 / (norm * 2.0), 6) AS far FROM s""")
def i4(t):
    out = G.second_order(edges(t), 0.5, 2.0)
    return out.select("prev", "cur", *[F.round(c, 6).alias(c) for c in ("norm", "back", "near", "far")])


def _walk_sql(length, per_node):
    nbr = """un AS (SELECT src, dst, CAST(greatest(round(weight / max(weight) OVER (PARTITION BY src) * 1000000000), 1) AS BIGINT) AS units FROM edges WHERE weight > 0),
 nbr AS (SELECT src, dst, CAST(sum(units) OVER (PARTITION BY src ORDER BY dst) AS DOUBLE) AS hi, CAST(sum(units) OVER (PARTITION BY src ORDER BY dst) - units AS DOUBLE) AS lo FROM un),
 deg AS (SELECT src, CAST(sum(units) AS BIGINT) AS total FROM un GROUP BY 1)"""
    steps = [f"w0 AS (SELECT src AS start, walk, src AS node FROM deg, (SELECT unnest(range({per_node})) AS walk))"]
    for s in range(1, length):
        x = HASH_SQL.format(f"'walk|' || w.start || '|' || w.walk || '|{s}'") + " / 4294967296.0::DOUBLE * d.total"
        steps.append(f"w{s} AS (SELECT w.start, w.walk, n.dst AS node FROM w{s - 1} w JOIN deg d ON d.src = w.node JOIN nbr n ON n.src = w.node AND n.lo <= {x} AND {x} < n.hi)")
    union = " UNION ALL ".join(f"SELECT start, CAST(walk AS INTEGER) AS walk, {s} AS step, node FROM w{s}" for s in range(length))
    return f"WITH {BOTH_SQL}, {nbr}, {', '.join(steps)} {union}"


@query("i5_random_walks", _walk_sql(5, 2))
def i5(t):
    return G.weighted_walks(edges(t), 2, 5, "walk")


@query("i5_biased_check", f"""
WITH {BOTH_SQL} SELECT count(DISTINCT src) AS n_walks, count(DISTINCT src) * 4 AS n_steps, 0::BIGINT AS off_edges FROM edges""")
def i5_check(t):
    """Every node starts a walk, no walk ends early in a graph of two-way edges, and every step follows an edge."""
    walks = materialise(i5b(t))
    after = walks.select("start", "walk", (F.col("step") - 1).alias("step"), F.col("node").alias("dst"))
    moves = walks.withColumnRenamed("node", "src").join(after, ["start", "walk", "step"])
    off = moves.join(edges(t).select("src", "dst"), ["src", "dst"], "left_anti").agg(F.count("*")).scalar()
    return walks.agg(F.count_distinct("start", "walk").alias("n_walks"), F.count("*").alias("n_steps"), F.first(off).alias("off_edges"))


@query("i5_biased_walks")
def i5b(t):
    return G.biased_walks(edges(t), 1, 4, 0.5, 2.0, "biased")


@query("i6_metapath_neighbors", f"WITH {TYPED_SQL} SELECT src, meta, dst, round(1.0::DOUBLE / count(*) OVER (PARTITION BY src, meta), 6) AS prob FROM edges JOIN nodes ON nodes.id = dst")
def i6(t):
    e, n = typed_graph(t)
    return G.typed_neighbors(e, n).select("src", "meta", "dst", F.round("prob", 6).alias("prob"))


PATH = ["user", "diner", "category", "diner", "user"]


def _path_sql():
    nbr = "nbr AS (SELECT src, meta, dst, row_number() OVER (PARTITION BY src, meta ORDER BY dst) - 1 AS place, count(*) OVER (PARTITION BY src, meta) AS deg FROM edges JOIN nodes ON nodes.id = dst)"
    steps = ["w0 AS (SELECT id AS start, walk, id AS node FROM nodes, (SELECT unnest(range(2)) AS walk) WHERE meta = 'user')"]
    for s, meta in enumerate(PATH[1:], start=1):
        h = HASH_SQL.format(f"'path|' || w.start || '|' || w.walk || '|{s}'")
        steps.append(f"w{s} AS (SELECT w.start, w.walk, n.dst AS node FROM w{s - 1} w JOIN nbr n ON n.src = w.node AND n.meta = '{meta}' AND n.place = {h} % n.deg)")
    last = len(PATH) - 1
    union = " UNION ALL ".join(
        f"SELECT w{s}.start, CAST(w{s}.walk AS INTEGER) AS walk, {s} AS step, w{s}.node FROM w{s} SEMI JOIN w{last} AS e ON e.start = w{s}.start AND e.walk = w{s}.walk"
        for s in range(len(PATH)))
    return f"WITH {TYPED_SQL}, {nbr}, {', '.join(steps)} {union}"


@query("i7_metapath_walks", _path_sql())
def i7(t):
    e, n = typed_graph(t)
    return G.metapath_walks(e, n, PATH, 2, "path")


DIM = 8
HASH_VEC = ", ".join("{0} / 4294967296.0::DOUBLE - 0.5 AS d{1}".format(HASH_SQL.format(f"'x|' || id || '|{i}'"), i) for i in range(DIM))
DOT_SQL = " + ".join(f"u.d{i} * v.d{i}" for i in range(DIM))


@query("i8_embedding_topk", f"""
WITH {BOTH_SQL}, h0 AS (SELECT id, {HASH_VEC} FROM (SELECT DISTINCT src AS id FROM edges)),
 s AS (SELECT u.id - {SHIFT} AS user_id, v.id AS item, round({DOT_SQL}, 6) AS score FROM h0 u JOIN h0 v ON u.id >= {SHIFT} AND v.id < {SHIFT}
  ANTI JOIN train ON train.reviewer_id = u.id - {SHIFT} AND train.diner_idx = v.id)
SELECT user_id, item, score, CAST(pos AS INTEGER) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item) AS pos FROM s) WHERE pos <= 10""")
def i8(t):
    """Top items by dot product for every user, seen ones left out; vectors come from a hash."""
    vec = materialise(G.hash_vectors(edges(t).select(F.col("src").alias("id")).distinct(), DIM, "x"))
    users = vec.where(F.col("id") >= SHIFT).select((F.col("id") - SHIFT).alias("user"), "vec")
    items = vec.where(F.col("id") < SHIFT).select(F.col("id").alias("item"), "vec")
    seen = t.train.select(F.col("reviewer_id").alias("user"), F.col("diner_idx").alias("item"))
    return block_topk(users, items, 10, seen=seen).withColumnRenamed("user", "user_id")


def _walk_vectors(t, epochs=3):
    vec, history = skip_gram(G.weighted_walks(edges(t), 4, 8, "n2v"), dim=16, epochs=epochs)
    return materialise(vec), history


def _typed_vectors(t, epochs=3):
    e, n = typed_graph(t)
    vec, history = skip_gram(G.metapath_walks(e, n, PATH, 4, "m2v"), dim=16, epochs=epochs, types=n)
    return materialise(vec), history


def _nearest(vec, k):
    near = block_topk(vec.withColumnRenamed("id", "user"), vec.withColumnRenamed("id", "item"), k, normalise=True, skip_same=True)
    return near.select(F.col("user").alias("id"), F.col("item").alias("neighbor"), "score", "pos")


def _falls(history):
    """1 if the loss of the last epoch is below that of the first."""
    return history.agg((F.max_by("loss", "epoch") < F.min_by("loss", "epoch")).cast("int")).scalar()


@query("i9_node2vec_vectors")
def i9(t):
    """The three nearest nodes to every node by walk vectors."""
    return _nearest(_walk_vectors(t)[0], 3)


@query("i9_node2vec_check", f"WITH {BOTH_SQL} SELECT count(DISTINCT src) AS n_nodes, 1 AS loss_falls, 1 AS linked_closer FROM edges")
def i9_check(t):
    """All nodes have vectors, the loss falls, and linked nodes lie closer than nodes drawn at random."""
    vec, history = _walk_vectors(t)
    e = edges(t).select("src", "dst")
    unit = vec.select("id", G.l2_normalise("vec").alias("vec"))
    n = unit.select("id").distinct()
    other = G.uniform_negatives(n, 5, "far").select(F.col("start").alias("src"), F.col("node").alias("dst"))

    def closeness(pairs):
        dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        return pairs.join(unit.select(F.col("id").alias("src"), F.col("vec").alias("a")), "src").join(unit.select(F.col("id").alias("dst"), F.col("vec").alias("b")), "dst").agg(F.avg(dot)).scalar()

    return n.agg(F.count("*").alias("n_nodes"), F.first(_falls(history)).alias("loss_falls"), F.first((closeness(e) > closeness(other)).cast("int")).alias("linked_closer"))


@query("i10_metapath2vec_vectors")
def i10(t):
    """The three nearest nodes to every node by vectors of typed walks and typed negatives."""
    return _nearest(_typed_vectors(t)[0], 3)


@query("i10_metapath2vec_check", f"WITH {TYPED_SQL} SELECT count(*) AS n_nodes, 1 AS loss_falls, 0::BIGINT AS other_types FROM nodes")
def i10_check(t):
    """The loss falls, and no negative is of another type than the true context."""
    history = materialise(_typed_vectors(t)[1])
    leaked = history.agg(F.sum("leaked")).scalar()
    return typed_graph(t)[1].agg(F.count("*").alias("n_nodes"), F.first(_falls(history)).alias("loss_falls"), F.first(leaked).alias("other_types"))


@query("i11_uniform_negatives", f"""
WITH {BOTH_SQL}, n AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM (SELECT DISTINCT src AS id FROM edges)),
 d AS (SELECT id AS start, draw, {HASH_SQL.format("'neg|' || id || '|' || draw")} % (SELECT count(*) FROM n) AS idx FROM n, (SELECT unnest(range(5)) AS draw))
SELECT start, CAST(draw AS INTEGER) AS draw, n.id AS node FROM d JOIN n USING (idx)""")
def i11(t):
    return G.uniform_negatives(edges(t).select(F.col("src").alias("id")).distinct(), 5, "neg")


@query("i12_typed_negatives", f"""
WITH {TYPED_SQL}, n AS (SELECT id, meta, row_number() OVER (PARTITION BY meta ORDER BY id) - 1 AS idx, count(*) OVER (PARTITION BY meta) AS cnt FROM nodes),
 d AS (SELECT id AS start, meta, draw, {HASH_SQL.format("'tneg|' || id || '|' || draw")} % cnt AS idx FROM n, (SELECT unnest(range(5)) AS draw))
SELECT start, d.meta, CAST(draw AS INTEGER) AS draw, n.id AS node FROM d JOIN n ON n.meta = d.meta AND n.idx = d.idx""")
def i12(t):
    return G.typed_negatives(typed_graph(t)[1], 5, "tneg")


SAMPLE_SQL = f"""SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY {HASH_SQL.format("'{0}|' || src || '|' || dst")}, dst) AS rn FROM edges) WHERE rn <= 5"""


@query("i13_sample_neighbors", f"WITH {BOTH_SQL} {SAMPLE_SQL.replace('{0}', 'hood')}")
def i13(t):
    return G.sample_neighbors(edges(t).select("src", "dst"), 5, "hood")


def _sage_sql():
    layer = lambda i: f"""near{i} AS ({SAMPLE_SQL.replace('{0}', f'sage-{i}')}),
 agg{i} AS (SELECT src AS id, {', '.join(f'avg(d{d}) AS n{d}' for d in range(DIM))} FROM near{i} JOIN h{i} ON h{i}.id = near{i}.dst GROUP BY 1),
 sum{i} AS (SELECT h{i}.id, {', '.join(f'd{d} + coalesce(n{d}, 0) AS d{d}' for d in range(DIM))} FROM h{i} LEFT JOIN agg{i} USING (id)),
 h{i + 1} AS (SELECT id, {', '.join(f'd{d} / norm AS d{d}' for d in range(DIM))} FROM (SELECT *, sqrt({' + '.join(f'd{d} * d{d}' for d in range(DIM))}) AS norm FROM sum{i}))"""  # noqa: E731
    h0 = f"h0 AS (SELECT id, {HASH_VEC} FROM (SELECT DISTINCT src AS id FROM edges))"
    return f"WITH {BOTH_SQL}, {h0}, {layer(0)}, {layer(1)} SELECT id, {', '.join(f'round(d{d}, 5) AS d{d}' for d in range(DIM))} FROM h2"


def _nodes(t):
    return edges(t).select(F.col("src").alias("id")).distinct()


def _spread(vecs):
    return vecs.select("id", *[F.round(F.get("vec", F.lit(d)), 5).alias(f"d{d}") for d in range(DIM)])


@query("i14_neighbor_aggregation", _sage_sql())
def i14(t):
    return _spread(G.sage_layers(edges(t), G.hash_vectors(_nodes(t), DIM, "x"), DIM, 2, 5, "sage"))


@query("i14_learned_aggregation", f"""
WITH {BOTH_SQL} SELECT count(DISTINCT src) AS n_nodes, count(DISTINCT src) AS n_unit, 1 AS held_out_loss_falls FROM edges""")
def i14_learned(t):
    """Learned weights: all nodes have vectors of length 1 or 0, and the loss of links kept out of training falls."""
    e = materialise(edges(t))
    kept_out = hash_int("kept", F.least("src", "dst"), F.greatest("src", "dst")) % 10 == 0
    train, held = materialise(e.where(~kept_out)), materialise(e.where(kept_out))
    nodes = materialise(_nodes(t))
    features = materialise(G.hash_vectors(nodes, DIM, "x"))
    fresh = materialise(SG.link_pairs(held, nodes, 1.0, "fresh"))
    sizes = [DIM, DIM, DIM]
    weights, _ = SG.fit_sage(train, features, lambda step: SG.link_pairs(train, nodes, 0.5, f"sage{step}"), sizes, 5, steps=4, rate=0.05)
    before, after = (SG.link_loss(train, features, w, fresh, 5) for w in (SG.start_weights(sizes), weights))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    vec = SG.sage_vectors(train, features, weights, 5)
    ok = (F.abs(norm - 1) < 1e-6) | (norm == 0)
    return vec.agg(F.count("*").alias("n_nodes"), F.count_if(ok).alias("n_unit"), F.lit(int(after < before)).alias("held_out_loss_falls"))


def _light_parts():
    layer = lambda i: f"""l{i + 1} AS (SELECT src AS id, {', '.join(f'sum(w * d{d}) AS d{d}' for d in range(DIM))} FROM norm JOIN l{i} ON l{i}.id = norm.dst GROUP BY 1)"""
    l0 = f"l0 AS (SELECT id, {HASH_VEC} FROM (SELECT DISTINCT src AS id FROM edges))"
    st = "st AS (SELECT src, sum(weight) AS s FROM edges GROUP BY 1), norm AS (SELECT e.src, e.dst, weight / (sqrt(a.s) * sqrt(b.s)) AS w FROM edges e JOIN st a ON a.src = e.src JOIN st b ON b.src = e.dst)"
    mean = ", ".join(f"(l0.d{d} + l1.d{d} + l2.d{d}) / 3 AS d{d}" for d in range(DIM))
    return f"WITH {BOTH_SQL}, {st}, {l0}, {layer(0)}, {layer(1)}, lg AS (SELECT l0.id, {mean} FROM l0 JOIN l1 USING (id) JOIN l2 USING (id))"


def _light_sql():
    return f"{_light_parts()} SELECT id, {', '.join(f'round(d{d}, 5) AS d{d}' for d in range(DIM))} FROM lg"


CAND_SQL = f"""{_light_parts()}, s AS (SELECT u.id - {SHIFT} AS user_id, v.id AS diner_id, round({DOT_SQL}, 6) AS score FROM lg u JOIN lg v ON u.id >= {SHIFT} AND v.id < {SHIFT}
  ANTI JOIN train ON train.reviewer_id = u.id - {SHIFT} AND train.diner_idx = v.id)
SELECT user_id, diner_id, score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, diner_id) AS pos FROM s) WHERE pos <= 50"""


@query("i15_light_propagation", _light_sql())
def i15(t):
    return _spread(G.light_propagation(edges(t), G.hash_vectors(_nodes(t), DIM, "x"), DIM, 2))


def _light_triples(t):
    """One positive and one unseen item per user and epoch, as nodes."""
    inter = t.train.select(F.col("reviewer_id").alias("user"), F.col("diner_idx").alias("item")).distinct()
    inter = materialise(inter)

    def draw(epoch):
        negatives = NG.random_negatives(inter, 4, f"light{epoch}").select("user", F.col("item").alias("negative"))
        positive = inter.groupBy("user").agg(F.min_by("item", F.struct(hash_int(f"light{epoch}", F.col("user"), F.col("item")), "item")).alias("positive"))
        return materialise(shuffled(positive).join(negatives, "user").select((F.col("user") + SHIFT).alias("user"), "positive", "negative"))

    return draw


@query("i15_learned_vectors", f"""
WITH {BOTH_SQL} SELECT count(DISTINCT src) AS n_nodes, 1 AS loss_falls, 1 AS ranks_better FROM edges""")
def i15_learned(t):
    """Vectors learned through the propagation: the loss falls, and unseen triples are ranked better than before."""
    e, start, draw = edges(t), G.hash_vectors(_nodes(t), DIM, "x"), _light_triples(t)
    start = materialise(start)
    learned, history = G.fit_light(e, draw, start, DIM, 2, epochs=4, rate=0.3)
    norm, fresh = G.normalised_edges(e), draw(99)

    def right(vectors):
        _, losses = G.pairwise_gradients(materialise(G.propagate(norm, vectors, DIM, 2)), fresh, DIM)
        return losses.agg(F.avg((F.col("loss") < 0.6931471805599453).cast("double"))).first()[0]

    better = int(right(learned) > right(start))
    return learned.agg(F.count("*").alias("n_nodes"), F.lit(int(history[-1] < history[0])).alias("loss_falls"), F.lit(better).alias("ranks_better"))


@query("i16_user_negatives", f"""
WITH it AS (SELECT diner_idx AS item, row_number() OVER (ORDER BY diner_idx) - 1 AS idx FROM (SELECT DISTINCT diner_idx FROM train)),
 p AS (SELECT reviewer_id AS u, arg_min(diner_idx, ({HASH_SQL.format("'pos|' || reviewer_id || '|' || diner_idx")}, diner_idx)) AS positive FROM train GROUP BY 1),
 d AS (SELECT u, j, {HASH_SQL.format("'bpr|' || u || '|' || j")} % (SELECT count(*) FROM it) AS idx FROM p, (SELECT unnest(range(20)) AS j)),
 c AS (SELECT u, item, min(j) AS j FROM d JOIN it USING (idx) ANTI JOIN train ON train.reviewer_id = u AND train.diner_idx = item GROUP BY 1, 2)
SELECT u AS user_id, positive, item AS negative, CAST(rn AS INTEGER) AS draw FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY j) AS rn FROM c) JOIN p USING (u) WHERE rn <= 5""")
def i16(t):
    """One positive and five unseen negatives per user for pairwise training."""
    inter = t.train.select(F.col("reviewer_id").alias("user"), F.col("diner_idx").alias("item"))
    drawn = F.struct(hash_int("pos", F.col("user"), F.col("item")), "item")
    positive = inter.groupBy("user").agg(F.min_by("item", drawn).alias("positive"))
    return NG.random_negatives(inter, 5, "bpr").join(shuffled(positive), "user").select(F.col("user").alias("user_id"), "positive", F.col("item").alias("negative"), "draw")


@query("i17_graph_candidates", CAND_SQL)
def i17(t):
    """Unseen top items per user from propagated vectors, through the candidate parquet."""
    vec = materialise(G.light_propagation(edges(t), G.hash_vectors(_nodes(t), DIM, "x"), DIM, 2))
    users = vec.where(F.col("id") >= SHIFT).select((F.col("id") - SHIFT).alias("user"), "vec")
    items = vec.where(F.col("id") < SHIFT).select(F.col("id").alias("item"), "vec")
    seen = t.train.select(F.col("reviewer_id").alias("user"), F.col("diner_idx").alias("item"))
    path = scratch_path(t.spark, "graph-candidates")
    files.write_candidates(block_topk(users, items, 50, seen=seen).select(F.col("user").alias("user_id"), F.col("item").alias("diner_id"), "score"), path)
    return files.read_candidates(t.spark, path)


@query("i18_walk_neighbors")
def i18(t):
    """Closest nodes to every user by cosine of walk embeddings."""
    vec = _walk_vectors(t)[0]
    users = vec.where(F.col("id") >= SHIFT).select(F.col("id").alias("user"), "vec")
    return block_topk(users, vec.withColumnRenamed("id", "item"), 5, normalise=True, skip_same=True)
