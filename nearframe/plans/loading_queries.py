"""Sources and sinks, document assembly, relational loading."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..context import scratch_path
from ..functions.text import parent_label
from ..operators import constraints as K
from ..operators import documents as D
from ..operators import loading as L
from ..sources import generators as G
from ..sources import images as I
from ..sources import points as P
from ..sources import reviews as Rv
from . import sql as S
from . import views
from .registry import query

REVIEW_FILE = "rev AS (SELECT CAST(doc_id AS INTEGER) AS id, toxic AS spam, text FROM documents JOIN labels USING (doc_id))"


def listed(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def chosen(values, number):
    """``pick`` in SQL."""
    return f"{listed(values)}[CAST(({number}) % {len(values)} AS INTEGER) + 1]"


@query("read_reviews", S.with_(REVIEW_FILE) + "SELECT * FROM rev")
def _(t):
    path = scratch_path(t.spark, "reviews")
    rows = views.labelled_documents(t).select("id", "spam", "text")
    rows.write.csv(path, sep="|", header=True, quote='"', escape='"', quoteAll=True)
    return Rv.read_reviews(t.spark, path)


_TEXT = chosen(Rv.TEMPLATES, S.number("'42'", "'template'", "doc_id"))
for _slot, _words in (("adj", Rv.ADJECTIVES), ("category", [c.lower() for c in Rv.CATEGORIES]),
                      ("use", Rv.USES), ("detail", Rv.DETAILS)):
    _number = S.number("'42'", f"'{_slot}'", "doc_id")
    _TEXT = f"replace({_TEXT}, '{{{_slot}}}', {chosen(_words, _number)})"


@query("synthetic_reviews", f"SELECT doc_id AS id, 0 AS spam, {_TEXT} AS text FROM documents")
def _(t):
    return Rv.synthetic_reviews(t.documents, "doc_id")


@query("legit_filter", S.with_(REVIEW_FILE) + "SELECT CAST(id AS BIGINT) AS id, spam, text FROM rev WHERE spam = 0")
def _(t):
    return L.legit(views.labelled_documents(t)).select("id", "spam", "text")


@query("sample_n", "SELECT doc_id, text FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 200")
def _(t):
    return L.sample_n(t.documents.select("doc_id", "text"), 200, "doc_id")


@query("labelled_reviews", S.with_(REVIEW_FILE) + "SELECT text, spam = 1 AS spam FROM rev")
def _(t):
    return L.labelled(views.labelled_documents(t))


@query("split_db_query", """
    SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= (SELECT count(*) * 4 // 5 FROM documents)
                        THEN 'corpus' ELSE 'query' END AS role FROM documents""")
def _(t):
    ids = t.documents.select("doc_id")
    corpus, pool = L.split_corpus(ids, "doc_id", ids.count() * 4 // 5)
    return corpus.withColumn("role", F.lit("corpus")).unionByName(pool.withColumn("role", F.lit("query")))


PATHS = """path AS (SELECT vec_id, label, '/img/p' || label || '/' || vec_id || CASE vec_id % 4
               WHEN 0 THEN '.png' WHEN 1 THEN '.jpg' WHEN 2 THEN '.jpeg' ELSE '.txt' END AS path FROM embeddings)"""


def image_paths(t):
    ending = F.element_at(F.array(*map(F.lit, (".png", ".jpg", ".jpeg", ".txt"))), (F.col("vec_id") % 4 + 1).cast("int"))
    return t.embeddings.select("vec_id", F.concat(F.lit("/img/p"), F.col("label"), F.lit("/"), F.col("vec_id"), ending).alias("path"))


@query("scan_images", S.with_(PATHS, """
    dir AS (SELECT 'p' || label AS label, row_number() OVER (ORDER BY 'p' || label) - 1 AS pos, count(*) OVER () AS dirs
            FROM path GROUP BY label HAVING count(*) >= 48)""", """
    slot AS (SELECT label, pos + r * dirs AS dir_no FROM dir, range(25) AS x(r) WHERE pos + r * dirs < 25)""", """
    file AS (SELECT 'p' || label AS label, path, row_number() OVER (PARTITION BY label ORDER BY
             CASE WHEN path LIKE '%.png' THEN 0 WHEN path LIKE '%.jpg' THEN 1 ELSE 2 END, path) AS n
             FROM path WHERE path NOT LIKE '%.txt')""") +
       "SELECT CAST(dir_no AS INTEGER) AS dir_no, label, CAST(n AS BIGINT) AS n, path FROM slot JOIN file USING (label) WHERE n > 4 AND n <= 20")
def _(t):
    out = I.pick_images(image_paths(t), 25, 16, 4, min_files=48)
    return out.withColumn("n", F.col("n").cast("bigint"))


@query("label_from_path", "SELECT page_id, string_split(url, '/')[-2] AS label FROM pages")
def _(t):
    return t.pages.select("page_id", parent_label(F.col("url")).alias("label"))


@query("read_blobs", "SELECT page_id, md5(html) AS digest FROM pages")
def _(t):
    files = t.pages.select(F.col("url").alias("path"), "page_id", F.encode("html", "UTF-8").alias("content"))
    path = F.concat_ws("#", "path", "page_id")
    rows = t.pages.select("page_id", F.concat_ws("#", "url", "page_id").alias("path"))
    blobs = I.join_blobs(rows, "path", files.select(path.alias("path"), "content"))
    return blobs.select("page_id", F.md5("content").alias("digest"))


@query("image_corpus", S.with_(PATHS, """
    img AS (SELECT path, row_number() OVER (ORDER BY md5('42|' || path), path) - 1 AS pos, count(*) OVER () AS n
            FROM path WHERE path NOT LIKE '%.txt')""") +
       "SELECT CAST(pos + r * n AS BIGINT) AS pos, path FROM img, range(10) AS x(r) WHERE pos + r * n < 2 * (SELECT count(*) FROM embeddings)")
def _(t):
    return I.recycle_images(image_paths(t), 2 * t.embeddings.count())


RULES = [
    K.Unique("lineitem key", "lineitem", ["l_orderkey", "l_linenumber"]),
    K.Unique("order key", "orders", ["o_orderkey"]),
    K.Unique("part name", "part", ["p_name"]),
    K.NotNull("document text", "documents", "text"),
    K.Between("rating", "review", "rating", 2, 4),
    K.ForeignKey("order customer", "orders", "o_custkey", "embeddings", "vec_id"),
    K.ForeignKey("label document", "labels", "doc_id", "documents", "doc_id"),
]


@query("check_constraints", """
    SELECT 'lineitem key' AS rule, l_orderkey || '|' || l_linenumber AS key, count(*) AS n
    FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
    UNION ALL SELECT 'order key', CAST(o_orderkey AS VARCHAR), count(*) FROM orders GROUP BY o_orderkey HAVING count(*) > 1
    UNION ALL SELECT 'part name', p_name, count(*) FROM part GROUP BY p_name HAVING count(*) > 1
    UNION ALL SELECT 'document text', NULL, count(*) FROM documents WHERE text IS NULL HAVING count(*) > 0
    UNION ALL SELECT 'rating', CAST(1 + doc_id % 5 AS VARCHAR), count(*) FROM documents
              WHERE NOT (1 + doc_id % 5 BETWEEN 2 AND 4) GROUP BY 1 + doc_id % 5
    UNION ALL SELECT 'order customer', CAST(o_custkey AS VARCHAR), count(*) FROM orders
              WHERE o_custkey NOT IN (SELECT vec_id FROM embeddings) GROUP BY o_custkey
    UNION ALL SELECT 'label document', CAST(doc_id AS VARCHAR), count(*) FROM labels
              WHERE doc_id NOT IN (SELECT doc_id FROM documents) GROUP BY doc_id""")
def _(t):
    tables = {n: getattr(t, n) for n in ("lineitem", "orders", "part", "documents", "embeddings", "labels")}
    return K.check_constraints({**tables, "review": views.reviews(t)}, RULES)


@query("vector_upsert", S.with_(S.VECTORS,
    "out AS (SELECT c_custkey AS id, COALESCE(list_transform(v, lambda x: -x), list_transform(range(64), lambda x: 0.0)) AS v "
    "FROM customer LEFT JOIN vec ON c_custkey = id "
    "UNION ALL SELECT id, list_transform(v, lambda x: -x) FROM vec WHERE id NOT IN (SELECT c_custkey FROM customer))") +
    S.long_form("out"))
def _(t):
    path = scratch_path(t.spark, "points")
    blank = t.customer.select(F.col("c_custkey").alias("id"), F.array_repeat(F.lit(0.0).cast("float"), 64).alias("embedding"))
    P.create_points(path, blank)
    v = views.vectors(t).select("id", "embedding")
    twice = v.withColumn("batch", F.lit(0)).unionByName(
        v.withColumn("embedding", F.transform("embedding", lambda x: x * -1)).withColumn("batch", F.lit(1)))
    P.upsert_points(t.spark, path, twice.where("batch = 0"), "id", "batch")
    P.upsert_points(t.spark, path, twice, "id", "batch")
    return views.long_form(P.read_points(t.spark, path, "id"), "id", "embedding")


@query("vector_add", S.with_(S.VECTORS, """
    rows AS (SELECT CAST(doc_id AS VARCHAR) AS id, text, lang, source, CAST(label AS VARCHAR) AS label, v
             FROM documents JOIN vec ON doc_id = vec.id)""") + """
    SELECT id, text AS document, lang, source, label, NULL::BIGINT AS dim, NULL::DOUBLE AS value FROM rows
    UNION ALL SELECT id, NULL, NULL, NULL, NULL, CAST(b AS BIGINT), round(x, 6) + 0.0
              FROM (SELECT id, unnest(v) AS x, unnest(range(len(v))) AS b FROM rows)""")
def _(t):
    """All that is stored of a point: its document and payload, and then its vector."""
    path = scratch_path(t.spark, "collection")
    rows = t.documents.join(t.embeddings, F.col("doc_id") == F.col("vec_id"))
    for part in (rows.where("label < 5"), rows.where("label >= 5")):
        P.add_points(path, P.as_documents(part, "doc_id", "embedding", "text", ["lang", "source", "label"]))
    stored = t.spark.read.parquet(path)
    head = stored.select("id", "document", *[F.col("metadata")[m].alias(m) for m in ("lang", "source", "label")])
    return head.unionByName(views.long_form(stored, "id", "embedding"), allowMissingColumns=True)


TOP = "top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY review_id) AS rn FROM review) WHERE rn <= 5)"
TEXTS = """
    rtext AS (SELECT product_id, string_agg(review_text, ' | ' ORDER BY review_id) AS reviews FROM top GROUP BY 1),
    ctext AS (SELECT product_id, string_agg(category_name, ', ' ORDER BY category_name) AS categories FROM cat GROUP BY 1),
    itext AS (SELECT product_id, string_agg(category_name, ', ' ORDER BY pos) AS categories FROM cat GROUP BY 1)"""
FILLED = """SELECT prod.product_id, name, description, price, COALESCE(reviews, 'No reviews') AS reviews,
            COALESCE(categories, 'Uncategorized') AS categories
            FROM prod LEFT JOIN rtext USING (product_id) LEFT JOIN {} USING (product_id)"""
WHOLE = ("name || '. ' || description || '. Price: $' || CAST(CAST(price AS DECIMAL(12,2)) AS VARCHAR) || '. Reviews: ' || "
         "reviews || '. Categories: ' || categories")
ASSEMBLED = (S.CATALOGUE, TOP, TEXTS)


@query("top_n_per_key", S.with_(S.CATALOGUE, TOP) + "SELECT product_id, review_id FROM top")
def _(t):
    return D.top_n_per_key(views.reviews(t), "product_id", "review_id", 5).select("product_id", "review_id")


@query("ordered_string_agg", S.with_(*ASSEMBLED) + """
    SELECT product_id, reviews AS joined, 'reviews' AS kind FROM rtext UNION ALL SELECT product_id, categories, 'by name' FROM ctext
    UNION ALL SELECT product_id, categories, 'by input' FROM itext""")
def _(t):
    first = D.top_n_per_key(views.reviews(t), "product_id", "review_id", 5)
    cats = views.categories(t)
    joined = [(D.join_text(first, "product_id", "review_text", "review_id", " | ", "joined"), "reviews"),
              (D.join_names(cats, "product_id", "category_name", ", ", "joined"), "by name"),
              (D.join_text(cats, "product_id", "category_name", "pos", ", ", "joined"), "by input")]
    a, b, c = [df.withColumn("kind", F.lit(kind)) for df, kind in joined]
    return a.unionByName(b).unionByName(c)


@query("left_join_defaults", S.with_(*ASSEMBLED) + FILLED.format("ctext"))
def _(t):
    first = D.top_n_per_key(views.reviews(t), "product_id", "review_id", 5)
    texts = D.join_text(first, "product_id", "review_text", "review_id", " | ", "reviews")
    names = D.join_names(views.categories(t), "product_id", "category_name", ", ", "categories")
    return D.attach_texts(views.products(t), texts, names).drop("category")


@query("format_price", "SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) AS price FROM part")
def _(t):
    return t.part.select("p_partkey", D.format_price(F.col("p_retailprice")).alias("price"))


@query("null_concat", S.with_(*ASSEMBLED,
    "part_null AS (SELECT p_partkey AS product_id, p_size FROM part)",
    f"filled AS ({FILLED.format('ctext')})",
    "holes AS (SELECT f.* REPLACE (CASE WHEN p_size > 40 THEN NULL ELSE description END AS description, "
    "CASE WHEN p_size < 5 THEN NULL ELSE price END AS price) FROM filled f JOIN part_null USING (product_id))") +
    f"SELECT product_id, {WHOLE} AS document FROM holes")
def _(t):
    size = t.part.select(F.col("p_partkey").alias("product_id"), "p_size")
    holes = (views.products(t).join(size, "product_id")
             .withColumn("description", F.when(F.col("p_size") <= 40, F.col("description")))
             .withColumn("price", F.when(F.col("p_size") >= 5, F.col("price"))))
    return D.build_documents(holes, views.reviews(t), views.categories(t))


@query("build_document", S.with_(*ASSEMBLED, f"filled AS ({FILLED.format('ctext')})") +
       f"SELECT product_id, {WHOLE} AS document FROM filled")
def build_document(t):
    return D.build_documents(views.products(t), views.reviews(t), views.categories(t))


@query("build_document_input_order", S.with_(*ASSEMBLED, f"filled AS ({FILLED.format('itext')})") +
       f"SELECT product_id, {WHOLE} AS document FROM filled")
def _(t):
    return D.build_documents(views.products(t), views.reviews(t), views.categories(t), category_order="pos")


@query("embed_documents", S.with_(*ASSEMBLED, f"filled AS ({FILLED.format('ctext')})",
                                  f"whole AS (SELECT product_id AS id, {WHOLE} AS text FROM filled)",
                                  S.hashed("wv", "whole", dims=32)) + S.long_form("wv"))
def _(t):
    out = D.embed_documents(views.products(t), views.reviews(t), views.categories(t), model="hash-32")
    return views.long_form(out.withColumnRenamed("product_id", "id"), "id", "embedding")


_I = "p_partkey"
GENERATED = f"""
    gen AS (SELECT {_I} AS ordinal,
        {chosen(G.PRODUCT_ADJECTIVES, _I)} || ' ' || {chosen(Rv.CATEGORIES, _I)} || ' Item ' || {_I} AS name,
        'High-quality ' || lower({chosen(Rv.CATEGORIES, _I)}) || ' product featuring durable construction and modern design.' AS description,
        CAST(19.99 + ({_I} % 10) * 10 AS DOUBLE) AS price, CAST(50 + ({_I} * 7) % 200 AS INTEGER) AS stock,
        p_name AS body FROM part),
    gen_review AS (SELECT ordinal, j AS pos, CAST(3 + j % 3 AS INTEGER) AS rating, body AS review_text
                   FROM gen, range(5) AS x(j) WHERE j < 2 + ordinal % 4),
    gen_cat AS (SELECT ordinal, j AS pos, {chosen(Rv.CATEGORIES, 'ordinal + j')} AS category_name
                FROM gen, range(3) AS x(j) WHERE j < 1 + ordinal % 3)"""


def generated(t):
    return G.generate_products(t.part, "p_partkey", "p_name")


@query("generate_products", S.with_(GENERATED) + """
    SELECT ordinal, name, description, price, stock,
           (SELECT CAST(count(*) AS BIGINT) FROM gen_review r WHERE r.ordinal = gen.ordinal) AS n_reviews,
           (SELECT CAST(count(*) AS BIGINT) FROM gen_cat c WHERE c.ordinal = gen.ordinal) AS n_categories FROM gen""")
def _(t):
    return generated(t).select(
        "ordinal", "name", "description", F.col("price").cast("double").alias("price"), "stock",
        F.size("reviews").cast("bigint").alias("n_reviews"), F.size("categories").cast("bigint").alias("n_categories"))


NESTED = (*ASSEMBLED, """
    told AS (SELECT product_id, row_number() OVER (PARTITION BY product_id ORDER BY review_id) - 1 AS pos, rating, review_text
             FROM review JOIN prod USING (product_id))""", """
    named AS (SELECT product_id, row_number() OVER (PARTITION BY product_id ORDER BY pos) - 1 AS pos, category_name FROM cat)""")


@query("flatten_nested", S.with_(*NESTED) + """
    SELECT 'review' AS kind, product_id AS parent, CAST(pos AS BIGINT) AS pos, review_text AS child, CAST(rating AS BIGINT) AS rating FROM told
    UNION ALL SELECT 'category', product_id, CAST(pos AS BIGINT), category_name, NULL FROM named""")
def _(t):
    _, review, category = L.flatten_products(views.nested_products(t), "ordinal")
    a = review.select(F.lit("review").alias("kind"), F.col("ordinal").alias("parent"), F.col("pos").cast("bigint").alias("pos"),
                      F.col("review_text").alias("child"), F.col("rating").cast("bigint").alias("rating"))
    b = category.select(F.lit("category").alias("kind"), F.col("ordinal").alias("parent"), F.col("pos").cast("bigint").alias("pos"),
                        F.col("category_name").alias("child"), F.lit(None).cast("bigint").alias("rating"))
    return a.unionByName(b)


@query("map_generated_keys", "SELECT c_name, c_custkey, c_acctbal FROM customer")
def _(t):
    inputs = t.customer.select("c_name", "c_acctbal")
    return L.map_generated_keys(inputs, t.customer.select("c_name", "c_custkey"), "c_name", "c_custkey")


@query("assign_keys", """
    SELECT o_orderkey, o_totalprice, CAST(100 + row_number() OVER (ORDER BY o_orderpriority, o_orderkey) - 1 AS BIGINT) AS id FROM orders""")
def _(t):
    rows = t.orders.select("o_orderkey", "o_totalprice", "o_orderpriority")
    return L.assign_keys(rows, "o_orderpriority", "o_orderkey", start=100).drop("o_orderpriority")


@query("load_product_family", S.with_(*NESTED, f"filled AS ({FILLED.format('itext')})", f"""
    keyed AS (SELECT product_id AS ordinal, row_number() OVER (ORDER BY product_id) AS key, prod.* EXCLUDE (product_id) FROM prod)""", """
    kr AS (SELECT key, row_number() OVER (ORDER BY key, pos) AS child, review_text, rating FROM told JOIN keyed ON ordinal = product_id)""",
    f"whole AS (SELECT key AS id, {WHOLE} AS text FROM filled JOIN (SELECT ordinal, key FROM keyed) ON ordinal = product_id)",
    S.hashed("wv", "whole", dims=32)) + """
    SELECT 'name' AS kind, key AS product_id, NULL::BIGINT AS child, name AS text, NULL::DOUBLE AS number FROM keyed
    UNION ALL SELECT 'description', key, NULL, description, NULL FROM keyed
    UNION ALL SELECT 'price', key, NULL, NULL, price FROM keyed
    UNION ALL SELECT 'stock', key, NULL, NULL, p_size FROM keyed JOIN part ON p_partkey = ordinal
    UNION ALL SELECT 'review', key, child, review_text, rating FROM kr
    UNION ALL SELECT 'category', key, NULL, category_name, NULL FROM named JOIN keyed ON ordinal = product_id
    UNION ALL SELECT 'vector', id, CAST(b AS BIGINT), NULL, round(x, 6) + 0.0
              FROM (SELECT id, unnest(v) AS x, unnest(range(len(v))) AS b FROM wv)""")
def _(t):
    """All columns of the three stored tables, one value per row."""
    path = scratch_path(t.spark, "family")
    L.load_product_family(views.nested_products(t), path, backend="hash", model="hash-32")
    tables = {n: t.spark.read.parquet(f"{path}/{n}") for n in ("product", "review", "product_category")}

    def rows(table, kind, text=None, number=None, child=None):
        return tables[table].select(
            F.lit(kind).alias("kind"), "product_id", (F.col(child) if child else F.lit(None)).cast("bigint").alias("child"),
            (F.col(text) if text else F.lit(None)).cast("string").alias("text"),
            (F.col(number) if number else F.lit(None)).cast("double").alias("number"))

    vector = views.long_form(tables["product"], "product_id", "embedding")
    parts = [rows("product", "name", "name"), rows("product", "description", "description"), rows("product", "price", number="price"),
             rows("product", "stock", number="stock"), rows("review", "review", "review_text", "rating", "review_id"),
             rows("product_category", "category", "category_name"),
             vector.select(F.lit("vector").alias("kind"), "product_id", F.col("dim").alias("child"),
                           F.lit(None).cast("string").alias("text"), F.col("value").alias("number"))]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _sql_between(low, high, *parts):
    return f"({low} + {S.number(*parts)} % {high - low + 1})"


_U = f"({S.number(chr(39) + '42' + chr(39), chr(39) + 'tier' + chr(39), 'c_custkey')} / 4294967296.0)"
_DRAW = f"({S.number(chr(39) + '42' + chr(39), chr(39) + 'reviewed' + chr(39), 'customer_id', 'product_id')} / 4294967296.0)"
SHOP = f"""
    size AS (SELECT greatest(50, count(*) * 5) AS n FROM customer),
    buyer AS (SELECT c_custkey AS id, CASE WHEN {_U} < 0.5 THEN 'bronze' WHEN {_U} < 0.8 THEN 'silver'
              WHEN {_U} < 0.95 THEN 'gold' ELSE 'platinum' END AS tier FROM customer),
    list AS (SELECT id, tier, CASE WHEN tier IN ('gold', 'platinum') THEN {_sql_between(8, 15, "'42'", "'buys'", 'id')}
             ELSE {_sql_between(2, 6, "'42'", "'buys'", 'id')} END AS wanted,
             {S.number("'42'", "'start'", 'id')} % (SELECT n FROM size) AS start,
             1 + {S.number("'42'", "'step'", 'id')} % 3 AS step FROM buyer),
    buy AS (SELECT id AS customer_id, tier, (start + j * step) % (SELECT n FROM size) + 1 AS product_id
            FROM list, range(15) AS x(j) WHERE j < wanted),
    rate AS (SELECT customer_id, product_id, CASE WHEN tier IN ('gold', 'platinum')
             THEN {_sql_between(3, 5, "'42'", "'rating'", 'customer_id', 'product_id')}
             ELSE {_sql_between(1, 5, "'42'", "'rating'", 'customer_id', 'product_id')} END AS rating
             FROM buy WHERE {_DRAW} < 0.7)"""


@query("generate_commerce", S.with_(SHOP) + """
    SELECT customer_id, tier, buy.product_id, CAST(rating AS INTEGER) AS rating, round(10.0 + price_draw * 190.0, 2) AS price
    FROM buy LEFT JOIN rate USING (customer_id, product_id)
    JOIN (SELECT i + 1 AS product_id, %s / 4294967296.0 AS price_draw FROM (SELECT unnest(range((SELECT n FROM size))) AS i)) p
    ON p.product_id = buy.product_id""" % S.number("'42'", "'price'", "i"))
def _(t):
    shop = G.generate_commerce(t.customer.select(F.col("c_custkey").alias("customer_id")))
    buyers = shop["customers"].select("customer_id", "tier")
    return (shop["purchases"].join(buyers, "customer_id")
            .join(shop["reviews"].select("customer_id", "product_id", "rating"), ["customer_id", "product_id"], "left")
            .join(shop["products"].select("product_id", "price"), "product_id")
            .select("customer_id", "tier", "product_id", "rating", "price"))


@query("dedupe_insert", """
    SELECT DISTINCT p_name || ' ' || p_brand AS name FROM part
    WHERE p_name || ' ' || p_brand NOT IN (SELECT p_name || ' ' || p_brand FROM part WHERE p_type = 'ECONOMY')""")
def _(t):
    name = F.concat("p_name", F.lit(" "), "p_brand").alias("name")
    stored = t.part.where("p_type = 'ECONOMY'").select(name).distinct()
    return L.insert_new(stored, t.part.select(name), "name")


@query("lookup_foreign_key", """
    SELECT c_custkey, n_name, n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def _(t):
    named = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    return L.attach_fk(named, t.nation, "n_name", "n_nationkey").select("c_custkey", "n_name", "n_nationkey")


@query("insert_returning", """
    SELECT doc_id, CAST((SELECT max(p_partkey) FROM part) + row_number() OVER (ORDER BY source, doc_id) AS BIGINT) AS id FROM documents""")
def _(t):
    stored = t.part.select(F.col("p_partkey").alias("id"))
    return L.insert_returning(t.documents.select("doc_id", "source"), stored, ["source", "doc_id"]).select("doc_id", "id")
