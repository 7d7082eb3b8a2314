"""Vector arithmetic, exact and approximate neighbours, and what is built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..context import scratch_path
from ..functions import vectors as V
from ..operators import retrieval as R
from ..operators.cells import ann_search, build_index, ingest, maintain, open_index, train_index, upsert_index
from ..operators.embedding import embed_column
from ..operators.graph import build_graph, graph_search, open_graph
from ..operators.neighbours import knn_join, knn_single
from ..operators.tree import build_tree, open_tree, tree_search
from . import sql as S
from . import views
from .registry import query

# The shares of a category that the sweep asks for.
FRACTIONS = (0.05, 0.10, 0.20, 0.40, 0.80)


def shown(near):
    """Neighbour rows as they are compared: six decimals."""
    return near.select("query_id", "item_id", F.round("dist", 6).alias("dist"),
                       F.col("rank").cast("bigint").alias("rank"))


def against_profile(t):
    """Every vector next to the mean vector of its label."""
    means = views.profiles(t).select(F.col("id").alias("label"), F.col("embedding").alias("mean"))
    return views.vectors(t).join(means, "label")


PAIRS = S.with_(S.VECTORS, S.PROFILES) + "SELECT vec.id, {0} AS {1} FROM vec JOIN profile ON vec.label = profile.id"


@query("l2_normalize", S.with_(S.VECTORS, S.PROFILES, """
    unit AS (SELECT vec.id, list_transform(vec.v, lambda x: x / (1 + vec.label)) AS w FROM vec),
    len AS (SELECT id, w, sqrt(list_dot_product(w, w)) AS n FROM unit),
    out AS (SELECT id, list_transform(w, lambda x: x / n) AS v FROM len)""") + S.long_form("out"))
def _(t):
    shrunk = F.transform("embedding", lambda x: x.cast("double") / (1 + F.col("label")))
    return views.long_form(views.vectors(t).select("id", V.l2_normalize(shrunk).alias("v")), "id", "v")


@query("cosine_similarity", PAIRS.format("round(list_cosine_similarity(vec.v, profile.v), 6)", "cosine"))
def _(t):
    cosine = V.cosine_similarity(F.col("embedding"), F.col("mean"))
    return against_profile(t).select("id", F.round(cosine, 6).alias("cosine"))


@query("cosine_distance", PAIRS.format("round(1 - list_cosine_similarity(vec.v, profile.v), 6)", "dist"))
def _(t):
    dist = V.cosine_distance(F.col("embedding"), F.col("mean"))
    return against_profile(t).select("id", F.round(dist, 6).alias("dist"))


@query("l2_distance", PAIRS.format("round(list_distance(vec.v, profile.v), 6)", "dist"))
def _(t):
    dist = V.l2_distance(F.col("embedding"), F.col("mean"))
    return against_profile(t).select("id", F.round(dist, 6).alias("dist"))


@query("mean_pool", S.with_(S.VECTORS, S.PROFILES, """
    tok AS (SELECT vec.id, b, CASE label % 3 WHEN 0 THEN (x + m) / 2 WHEN 1 THEN x ELSE NULL END AS x FROM (
        SELECT id, label, unnest(v) AS x, unnest(range(len(v))) AS b FROM vec) vec
        JOIN (SELECT id AS pid, unnest(v) AS m, unnest(range(len(v))) AS mb FROM profile)
        ON label = pid AND b = mb)""") +
       "SELECT id, CAST(b AS BIGINT) AS dim, round(x, 6) + 0.0 AS value FROM tok WHERE x IS NOT NULL")
def _(t):
    pairs = against_profile(t)
    tokens = F.array(F.col("embedding").cast("array<double>"), F.col("mean"))
    kind = F.col("label") % 3
    mask = F.array(F.when(kind == 2, 0).otherwise(1), F.when(kind == 0, 1).otherwise(0))
    return views.long_form(pairs.select("id", V.mean_pool(tokens, mask).alias("v")), "id", "v")


@query("mean_profile", S.with_(S.VECTORS, S.PROFILES, """
    out AS (SELECT n_nationkey AS id, COALESCE(v, list_transform(range(64), lambda x: 0.0)) AS v
            FROM nation LEFT JOIN profile ON n_nationkey = profile.id)""") + S.long_form("out"))
def _(t):
    members = t.nation.select(F.col("n_nationkey").alias("id"))
    return views.long_form(V.profile_or_zero(members, views.profiles(t), "id", 64), "id", "embedding")


NEIGHBOURS = "SELECT query_id, item_id, round(dist, 6) AS dist, rank FROM near"


@query("knn_join", S.with_(S.VECTORS, S.nearest("near", "vec", "vec")) + NEIGHBOURS)
def _(t):
    v = views.vectors(t)
    return shown(knn_join(v, v, 5, query_id="id", item_id="id"))


@query("knn_join_large", S.with_(S.VECTORS, S.nearest("near", "vec", "vec")) + NEIGHBOURS)
def _(t):
    """The plan for two sides that are both too large to send, on whole tables."""
    v = views.vectors(t)
    return shown(knn_join(v, v, 5, query_id="id", item_id="id", strategy="blocks", block_rows=200))


@query("knn_single", S.with_(S.VECTORS, """
    mid AS (SELECT list(x ORDER BY b) AS v FROM (SELECT b, avg(x) AS x FROM (
        SELECT unnest(v) AS x, unnest(range(len(v))) AS b FROM vec) GROUP BY 1))""") + """
    SELECT id AS item_id, round(dist, 6) AS dist FROM (
        SELECT vec.id, round(list_distance(vec.v, mid.v), 9) AS dist FROM vec, mid) ORDER BY dist, id LIMIT 5""")
def _(t):
    v = views.vectors(t)
    middle = V.mean_profile(v.withColumn("all", F.lit(1)), "all", "embedding").first()["embedding"]
    near = knn_single(v, middle, 5, item_id="id")
    return near.select("item_id", F.round("dist", 6).alias("dist"))


@query("knn_batch_collection", S.with_(S.VECTORS, S.PROFILES, S.nearest("near", "profile", "vec", metric="cosine")) +
       "SELECT query_id, item_id, round(dist, 6) AS dist, rank, label FROM near JOIN vec ON item_id = vec.id")
def _(t):
    v = views.vectors(t)
    near = R.knn_payload(views.profiles(t), v, ["label"], 5, "id", "id", "cosine")
    return near.select("query_id", "item_id", F.round("dist", 6).alias("dist"),
                       F.col("rank").cast("bigint").alias("rank"), "label")


VOTE = S.with_(
    "doc AS (SELECT doc_id AS id, text, toxic FROM documents JOIN labels USING (doc_id))",
    "msg AS (SELECT conv_id || '-' || turn AS id, text FROM conversations)",
    S.hashed("dv", "doc"), S.hashed("mv", "msg"), S.nearest("near", "mv", "dv")) + """
    SELECT query_id, CAST(SUM(toxic) AS BIGINT) AS votes, SUM(toxic) >= 3 AS predicted
    FROM near JOIN doc ON item_id = doc.id GROUP BY query_id"""


@query("knn_vote", VOTE)
def knn_vote(t):
    corpus = embed_column(views.labelled_documents(t), "text").withColumn("spam", F.col("spam").cast("boolean"))
    arriving = embed_column(views.messages(t), "text")
    return R.knn_vote(arriving.drop("text"), corpus.drop("text"), "spam", 5, 3, "id", "id", width=64)


FACES = "face AS (SELECT *, '/img/p' || label || '/' || id || '.png' AS path FROM vec)"


def faces(t):
    path = F.concat(F.lit("/img/p"), F.col("label"), F.lit("/"), F.col("id"), F.lit(".png"))
    return views.vectors(t).withColumn("path", path)


@query("knn_payload", S.with_(S.VECTORS, FACES, S.nearest("near", "face", "face")) +
       "SELECT query_id, item_id, rank, path FROM near JOIN face ON item_id = id")
def _(t):
    f = faces(t)
    near = R.knn_payload(f, f, ["path"], 5, "id", "id")
    return near.select("query_id", "item_id", F.col("rank").cast("bigint").alias("rank"), "path")


@query("knn_blob", S.with_(S.VECTORS, FACES, S.nearest("near", "face", "face")) +
       "SELECT query_id, item_id, hex(encode(path)) AS image_hex FROM near JOIN face ON item_id = id")
def _(t):
    f = faces(t).withColumn("image", F.col("path").cast("binary"))
    near = R.knn_payload(f, f, ["image"], 5, "id", "id")
    return near.select("query_id", "item_id", F.hex("image").alias("image_hex"))


@query("knn_two_step_fetch", S.with_(S.VECTORS, FACES, S.PROFILES, S.nearest("near", "profile", "vec")) +
       "SELECT id, path FROM face WHERE id IN (SELECT item_id FROM near)")
def _(t):
    near = knn_join(views.profiles(t), views.vectors(t), 5, query_id="id", item_id="id")
    return R.fetch_by_ids(near, faces(t).select("id", "path"), "id")


SHOP = (S.VECTORS, S.PROFILES, S.CUSTOMERS, S.PURCHASES, S.CATALOGUE)
RATED = "EXISTS (SELECT 1 FROM review r WHERE r.product_id = prod.product_id AND rating >= 4)"


def matched(t, queries):
    return knn_join(queries, views.customers(t), 5, query_id="id", item_id="id")


@query("knn_purchases", S.with_(*SHOP, S.nearest("near", "profile", "cust")) + f"""
    SELECT DISTINCT prod.product_id, name FROM near JOIN bought ON item_id = customer_id
    JOIN prod USING (product_id) WHERE {RATED}""")
def _(t):
    return R.knn_purchases(matched(t, views.profiles(t)), views.purchases(t), views.products(t), views.reviews(t))


@query("knn_purchases_per_query", S.with_(*SHOP, S.nearest("near", "vec", "cust")) + f"""
    SELECT DISTINCT query_id, prod.product_id, name FROM near JOIN bought ON item_id = customer_id
    JOIN prod USING (product_id) WHERE {RATED}""")
def _(t):
    return R.knn_purchases(matched(t, views.vectors(t)), views.purchases(t), views.products(t),
                           views.reviews(t), per_query=True)


@query("knn_hybrid_filter", S.with_(*SHOP, S.nearest("near", "profile", "cust")) + """
    SELECT DISTINCT prod.product_id, name, price FROM near JOIN bought ON item_id = customer_id
    JOIN prod USING (product_id) WHERE category = 'ECONOMY' AND price BETWEEN 900 AND 1000""")
def _(t):
    return R.knn_hybrid(matched(t, views.profiles(t)), views.purchases(t), views.products(t), "ECONOMY", 900, 1000)


RANGES = """
    ranked AS (SELECT category, price, row_number() OVER (PARTITION BY category ORDER BY price) AS pos,
                      count(*) OVER (PARTITION BY category) AS n FROM prod),
    ranges AS (SELECT category, fraction, min(price) AS low,
                      min(CASE WHEN pos = least(n, greatest(1, CAST(round_even(fraction * n, 0) AS BIGINT))) THEN price END) AS high,
                      CAST(max(n) AS BIGINT) AS in_category
               FROM ranked, (SELECT unnest([0.05, 0.10, 0.20, 0.40, 0.80]::DOUBLE[]) AS fraction) GROUP BY 1, 2)"""


@query("price_range_for_fraction", S.with_(S.CATALOGUE, RANGES) + "SELECT * FROM ranges")
def _(t):
    return R.price_range(views.products(t), FRACTIONS)


@query("fraction_sweep", S.with_(*SHOP, RANGES, S.nearest("near", "profile", "cust"), """
    hit AS (SELECT DISTINCT product_id FROM near JOIN bought ON item_id = customer_id)""") + """
    SELECT category, fraction, low, high, CAST(count(*) AS BIGINT) AS eligible,
           CAST(count(hit.product_id) AS BIGINT) AS matched
    FROM ranges JOIN prod USING (category) LEFT JOIN hit ON hit.product_id = prod.product_id
    WHERE price BETWEEN low AND high GROUP BY 1, 2, 3, 4""")
def _(t):
    return R.fraction_sweep(matched(t, views.profiles(t)), views.purchases(t), views.products(t), FRACTIONS)


@query("eligible_products", S.with_(S.PURCHASES, S.CATALOGUE) + """
    SELECT CAST(count(e.product_id) AS BIGINT) AS eligible, CAST(count(*) AS BIGINT) AS products,
           round(count(e.product_id) / count(*), 6) AS share
    FROM prod LEFT JOIN (SELECT product_id FROM bought INTERSECT SELECT product_id FROM review WHERE rating >= 4) e
    ON prod.product_id = e.product_id""")
def _(t):
    share = R.eligible_counts(views.purchases(t), views.reviews(t), views.products(t))
    return share.withColumn("share", F.round("share", 6))


@query("membership_filter", S.with_(S.VECTORS, S.PROFILES, S.CUSTOMERS, S.nearest("near", "profile", "cust")) +
       "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT item_id FROM near)")
def _(t):
    near = matched(t, views.profiles(t))
    return R.semi_join_ids(t.orders.select("o_orderkey", "o_custkey"), near, "o_custkey", "item_id")


@query("build_ann_index", "SELECT vec_id AS item_id, true AS in_nearest_cell, true AS within_radius FROM embeddings")
def _(t):
    """What holds for every item of an index, whatever its cells are."""
    index = build_index(views.vectors(t), scratch_path(t.spark, "index"), item_id="id")
    centers = F.lit([[float(x) for x in c] for c in index.centroids])
    nearest = F.array_min(F.transform(centers, lambda c: V.l2_distance(F.col("embedding"), c)))
    own = V.l2_distance(F.col("embedding"), F.get(centers, F.col("cell")))
    stored = index.items(t.spark).join(index.cells(t.spark), "cell")
    return stored.select("item_id", (own <= nearest + 1e-9).alias("in_nearest_cell"),
                         (own <= F.col("radius") + 1e-6).alias("within_radius"))


@query("ann_search", S.with_(S.VECTORS, S.nearest("near", "vec", "vec")) + NEIGHBOURS)
def _(t):
    v = views.vectors(t)
    path = scratch_path(t.spark, "index")
    build_index(v, path, item_id="id")
    return shown(ann_search(open_index(t.spark, path), v, 5, nprobe=2, exact=True, query_id="id"))


@query("ann_search_cosine", S.with_(S.VECTORS, S.PROFILES, S.nearest("near", "profile", "vec", metric="cosine")) + NEIGHBOURS)
def _(t):
    index = build_index(views.vectors(t), scratch_path(t.spark, "index"), metric="cosine", item_id="id")
    return shown(ann_search(index, views.profiles(t), 5, nprobe=1, exact=True, query_id="id"))


@query("tree_search", S.with_(S.VECTORS, S.nearest("near", "vec", "vec")) + NEIGHBOURS)
def _(t):
    v = views.vectors(t)
    index = build_tree(v, scratch_path(t.spark, "tree"), item_id="id")
    return shown(tree_search(open_tree(t.spark, index.path), v, 5, exact=True, query_id="id"))


@query("ann_search_probes", "SELECT vec_id AS query_id, CAST(5 AS BIGINT) AS found, true AS self_first FROM embeddings")
def _(t):
    """Which other neighbours the probed cells hold depends on the cells; that a
    stored vector finds itself first, among k, does not."""
    v = views.vectors(t)
    index = build_index(v, scratch_path(t.spark, "index"), item_id="id")
    near = ann_search(index, v, 5, nprobe=4, query_id="id")
    first = F.max((F.col("rank") == 1) & (F.col("item_id") == F.col("query_id")))
    return near.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), first.alias("self_first"))


@query("graph_search", "SELECT vec_id AS query_id, CAST(5 AS BIGINT) AS found, true AS self_first FROM embeddings")
def _(t):
    """Which other neighbours a walk meets depends on the graph; recall is held against the full search in the tests."""
    v = views.vectors(t)
    index = build_graph(v, scratch_path(t.spark, "graph"), m=16, ef_construction=100, item_id="id")
    near = graph_search(open_graph(t.spark, index.path), v, 5, query_id="id")
    first = F.max((F.col("rank") == 1) & (F.col("item_id") == F.col("query_id")))
    return near.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), first.alias("self_first"))


STORED = S.with_(S.VECTORS) + """
    SELECT id AS item_id, label, CAST(b AS BIGINT) AS dim, round(x, 6) + 0.0 AS value
    FROM (SELECT id, label, unnest(v) AS x, unnest(range(len(v))) AS b FROM vec)"""


def stored(items):
    """All that a load has stored of an item."""
    return (items.select("item_id", "label", F.posexplode("embedding").alias("dim", "x"))
            .select("item_id", "label", F.col("dim").cast("bigint").alias("dim"),
                    (F.round(F.col("x").cast("double"), 6) + F.lit(0.0)).alias("value")))


@query("ingest_indexed", STORED)
def _(t):
    v = views.vectors(t).withColumnRenamed("id", "item_id")
    index = train_index(v, scratch_path(t.spark, "index"), 16)
    for name, half in (("low", F.col("label") < 5), ("high", F.col("label") >= 5), ("low", F.col("label") < 5)):
        ingest(v.where(half), index.path, "immediate", trained=index, batch=name)
    return stored(open_index(t.spark, index.path).items(t.spark))


@query("ingest_deferred", STORED)
def _(t):
    index = ingest(views.vectors(t), scratch_path(t.spark, "index"), "deferred", item_id="id")
    return stored(index.items(t.spark))


@query("ingest_no_index", STORED)
def _(t):
    path = scratch_path(t.spark, "plain")
    ingest(views.vectors(t), path, "none", item_id="id")
    return stored(t.spark.read.parquet(f"{path}/items"))


UPSERTED = """
    now AS (SELECT id, v, label FROM vec WHERE label <> 3
            UNION ALL SELECT id, list_reverse(v), label FROM vec WHERE label = 3
            UNION ALL SELECT id + 1000000, v, label FROM vec WHERE label = 4)"""


def upserted(t):
    """An index after other vectors for the ids of one label, which lie in other cells, and copies under new ids."""
    v = views.vectors(t)
    index = build_index(v, scratch_path(t.spark, "index"), item_id="id")
    turned = v.where("label = 3").withColumn("embedding", F.reverse("embedding"))
    copies = v.where("label = 4").withColumn("id", F.col("id") + 1_000_000)
    for _ in range(2):  # the second time changes nothing
        upsert_index(index, turned.unionByName(copies), "second", item_id="id")
    return index


@query("index_upsert", S.with_(S.VECTORS, UPSERTED, S.nearest("near", "vec", "now")) + NEIGHBOURS)
def _(t):
    return shown(ann_search(upserted(t), views.vectors(t), 5, nprobe=2, exact=True, query_id="id"))


@query("index_upsert_items", S.with_(S.VECTORS, UPSERTED) + """
    SELECT id AS item_id, label, CAST(b AS BIGINT) AS dim, round(x, 6) + 0.0 AS value
    FROM (SELECT id, label, unnest(v) AS x, unnest(range(len(v))) AS b FROM now)""")
def _(t):
    return stored(upserted(t).items(t.spark))


@query("index_maintained", S.with_(S.VECTORS, UPSERTED, S.nearest("near", "vec", "now")) + NEIGHBOURS)
def _(t):
    """The same rows after many small upserts, with merges and splits between them."""
    v = views.vectors(t)
    index = build_index(v, scratch_path(t.spark, "index"), item_id="id")
    turned = v.where("label = 3").withColumn("embedding", F.reverse("embedding"))
    changes = turned.unionByName(v.where("label = 4").withColumn("id", F.col("id") + 1_000_000))
    for n in range(4):
        upsert_index(index, changes.where(F.pmod(F.xxhash64("id"), F.lit(4)) == n), f"part-{n}", item_id="id")
        if n % 2:
            rows = index.items(t.spark).count()
            index = maintain(index, t.spark, most_batches=3, most_rows=max(8, rows // 16))
    return shown(ann_search(open_index(t.spark, index.path), v, 5, nprobe=2, exact=True, query_id="id"))


@query("ann_vote", S.with_(S.VECTORS, S.nearest("near", "vec", "vec")) + """
    SELECT query_id, CAST(SUM(CAST(label >= 5 AS INT)) AS BIGINT) AS votes, SUM(CAST(label >= 5 AS INT)) >= 3 AS predicted
    FROM near JOIN vec ON item_id = vec.id GROUP BY query_id""")
def _(t):
    v = views.vectors(t)
    index = build_index(v, scratch_path(t.spark, "index"), item_id="id")
    near = ann_search(index, v, 5, nprobe=2, exact=True, query_id="id")
    labels = index.items(t.spark).select("item_id", (F.col("label") >= 5).alias("label"))
    return R.vote(near, v, labels, "id", "item_id")


@query("ann_payload", S.with_(S.VECTORS, FACES, S.PROFILES, S.nearest("near", "profile", "face")) +
       "SELECT query_id, item_id, rank, path FROM near JOIN face ON item_id = id")
def _(t):
    index = build_index(faces(t), scratch_path(t.spark, "index"), item_id="id")
    near = ann_search(index, views.profiles(t), 5, nprobe=2, exact=True, query_id="id")
    return R.attach_payload(near, index.items(t.spark), "item_id", ["path"]).select(
        "query_id", "item_id", F.col("rank").cast("bigint").alias("rank"), "path")


@query("ann_purchases", S.with_(*SHOP, S.nearest("near", "profile", "cust")) + f"""
    SELECT DISTINCT prod.product_id, name FROM near JOIN bought ON item_id = customer_id
    JOIN prod USING (product_id) WHERE {RATED}""")
def _(t):
    index = build_index(views.customers(t), scratch_path(t.spark, "index"), item_id="id")
    near = ann_search(index, views.profiles(t), 5, nprobe=2, exact=True, query_id="id")
    return R.knn_purchases(near, views.purchases(t), views.products(t), views.reviews(t))
