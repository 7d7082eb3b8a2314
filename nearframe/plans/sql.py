"""Fragments of the SQL counterparts."""

from __future__ import annotations


def number(*parts: str) -> str:
    """``stable_number`` in SQL; parts are SQL expressions."""
    joined = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(md5({joined}), 1, 8) AS BIGINT)"


def hashed(name: str, source: str, key: str = "id", text: str = "text", dims: int = 64) -> str:
    """Common tables that end in ``{name}(id, v)``, the hash embedding of a source."""
    return f"""
    {name}_tok AS (SELECT {key} AS id, unnest(string_split_regex(lower({text}), '[ \\t\\n\\x0B\\f\\r]+')) AS t
                   FROM {source}),
    {name}_sum AS (SELECT id, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % {dims} AS b,
                          SUM(CASE WHEN CAST('0x' || substr(md5(t), 9, 1) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END) AS s
                   FROM {name}_tok WHERE t <> '' GROUP BY 1, 2),
    {name}_len AS (SELECT id, sqrt(CAST(SUM(s * s) AS DOUBLE)) AS n FROM {name}_sum GROUP BY 1),
    {name}_all AS (SELECT {key} AS id, b FROM {source}, range({dims}) AS r(b)),
    {name}_val AS (SELECT a.id, a.b, CAST(CAST(CASE WHEN n > 0 THEN COALESCE(s, 0) / n ELSE 0 END AS FLOAT) AS DOUBLE) AS x
                   FROM {name}_all a LEFT JOIN {name}_sum s ON a.id = s.id AND a.b = s.b
                   LEFT JOIN {name}_len l ON a.id = l.id),
    {name} AS (SELECT id, list(x ORDER BY b) AS v FROM {name}_val GROUP BY 1)"""


def nearest(name: str, queries: str, items: str, k: int = 5, metric: str = "l2") -> str:
    """Common table ``{name}(query_id, item_id, dist, rank)`` from sources of ``(id, v)``."""
    if metric == "l2":
        dist = "list_distance(q.v, x.v)"
    else:
        dist = "1 - list_cosine_similarity(q.v, x.v)"
    return f"""
    {name} AS (SELECT query_id, item_id, dist, CAST(rank AS BIGINT) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, item_id) AS rank FROM (
            SELECT q.id AS query_id, x.id AS item_id, round({dist}, 9) + 0.0 AS dist
            FROM {queries} q, {items} x)) WHERE rank <= {k})"""


def long_form(source: str, key: str = "id", vector: str = "v") -> str:
    """Select one row per vector position, values rounded to six decimals."""
    return (f"SELECT {key}, CAST(b AS BIGINT) AS dim, round(x, 6) + 0.0 AS value FROM (SELECT {key}, "
            f"unnest({vector}) AS x, unnest(range(len({vector}))) AS b FROM {source})")


VECTORS = "vec AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
PROFILES = """
    profile_dim AS (SELECT label, b, avg(x) AS x FROM (
        SELECT label, unnest(v) AS x, unnest(range(len(v))) AS b FROM vec) GROUP BY 1, 2),
    profile AS (SELECT label AS id, list(x ORDER BY b) AS v FROM profile_dim GROUP BY 1)"""
CUSTOMERS = """
    cust AS (SELECT c_custkey AS id, CAST(embedding AS DOUBLE[]) AS v FROM customer
             JOIN embeddings ON c_custkey = vec_id)"""
PURCHASES = """
    bought AS (SELECT o_custkey AS customer_id, l_partkey AS product_id FROM orders
               JOIN lineitem ON o_orderkey = l_orderkey)"""
CATALOGUE = """
    prod AS (SELECT p_partkey AS product_id, p_name AS name, p_brand || ' ' || p_type AS description,
                    p_retailprice AS price, p_type AS category FROM part),
    review AS (SELECT doc_id AS review_id, CAST(floor(doc_id / 7) AS BIGINT) AS product_id,
                      1 + doc_id % 5 AS rating, text AS review_text FROM documents),
    cat AS (SELECT p_partkey AS product_id, p_brand AS category_name, 0 AS pos FROM part WHERE p_size > 15
            UNION ALL SELECT p_partkey, p_type, 1 FROM part WHERE p_size > 30)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n"
