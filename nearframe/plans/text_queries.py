"""Embedding columns, their storage and their options."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..context import scratch_path
from ..functions import subwords
from ..functions.text import text_counters, tokens, with_options
from ..functions.vectors import reduce_dims
from ..operators import embedding as E
from ..operators import loading as L
from . import sql as S
from . import views
from .registry import query

DOCS = "doc AS (SELECT doc_id AS id, text FROM documents)"
EMBEDDED = S.with_(DOCS, S.hashed("dv", "doc")) + S.long_form("dv")


def docs(t):
    return t.documents.select(F.col("doc_id").alias("id"), "text")


@query("embed_texts", EMBEDDED)
def _(t):
    return views.long_form(E.embed_column(docs(t), "text"), "id", "embedding")


@query("embed_batched", EMBEDDED)
def _(t):
    return views.long_form(E.embed_column(docs(t), "text", batch_size=32), "id", "embedding")


@query("embed_single", S.with_("msg AS (SELECT conv_id || '-' || turn AS id, text FROM conversations)",
                               S.hashed("mv", "msg")) + S.long_form("mv"))
def _(t):
    return views.long_form(E.embed_column(views.messages(t), "text", batch_size=1), "id", "embedding")


def character_shares(_model):
    """A backend in plain Python: shares of digits, letters, spaces and the rest."""
    def encode(texts):
        rows = []
        for text in texts:
            digits = sum(c in "0123456789" for c in text)
            letters = sum(c in "abcdefghijklmnopqrstuvwxyz" for c in text)
            spaces = text.count(" ")
            n = max(len(text), 1)
            rows.append([digits / n, letters / n, spaces / n, (len(text) - digits - letters - spaces) / n])
        return rows
    return encode


E.register_backend("character_shares", character_shares, {"four": 4})


@query("embed_backends", """
    WITH c AS (SELECT doc_id AS id, greatest(length(text), 1) AS n,
                      length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS d,
                      length(text) - length(regexp_replace(text, '[a-z]', '', 'g')) AS l,
                      length(text) - length(replace(text, ' ', '')) AS s, length(text) AS a FROM documents)
    SELECT id, round(CAST(CAST(d / n AS FLOAT) AS DOUBLE), 5) AS digits, round(CAST(CAST(l / n AS FLOAT) AS DOUBLE), 5) AS letters, round(CAST(CAST(s / n AS FLOAT) AS DOUBLE), 5) AS spaces,
           round(CAST(CAST((a - d - l - s) / n AS FLOAT) AS DOUBLE), 5) AS rest FROM c""")
def _(t):
    v = E.embed_column(docs(t), "text", "character_shares", "four")
    names = ("digits", "letters", "spaces", "rest")
    return v.select("id", *[F.round(F.col("embedding")[i].cast("double"), 5).alias(n) for i, n in enumerate(names)])


@query("embed_options", S.with_("""
    cut AS (SELECT doc_id AS id, 'query: ' || array_to_string(list_reverse(list_slice(list_reverse(
            list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')), 1, 12)), ' ') AS text
            FROM documents)""", S.hashed("cv", "cut"), """
    head AS (SELECT id, list_slice(v, 1, 32) AS h FROM cv),
    len AS (SELECT id, h, sqrt(list_dot_product(h, h)) AS n FROM head),
    out AS (SELECT id, list_transform(h, lambda x: x / n) AS v FROM len WHERE n > 0)""") + S.long_form("out"))
def _(t):
    cut = docs(t).withColumn("text", with_options(F.col("text"), 12, "left", prompt_name="query"))
    v = E.embed_column(cut, "text").withColumn("v", reduce_dims(F.col("embedding"), 32))
    return views.long_form(v, "id", "v")


@query("embed_raw", S.with_("""
    tok AS (SELECT doc_id AS id, unnest(string_split_regex(lower(text), '[ \\t\\n\\x0B\\f\\r]+')) AS t FROM documents),
    part AS (SELECT id, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 32 AS dim,
                    SUM(CASE WHEN CAST('0x' || substr(md5(t), 9, 1) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END) AS s
             FROM tok WHERE t <> '' GROUP BY 1, 2)""") + """
    SELECT d.doc_id AS id, CAST(r.b AS BIGINT) AS dim, CAST(coalesce(s, 0) AS DOUBLE) AS value
    FROM documents d CROSS JOIN range(32) AS r(b) LEFT JOIN part ON part.id = d.doc_id AND part.dim = r.b""")
def _(t):
    """Vectors as they are counted, without unit length."""
    return views.long_form(E.embed_column(docs(t), "text", "hash", "hash-32", normalize=False), "id", "embedding")


@query("embed_metadata", """
    SELECT lang, count(text) AS inputs, CAST(sum(length(text)) AS BIGINT) AS chars,
           CAST(sum(len(list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> ''))) AS BIGINT) AS tokens
    FROM documents GROUP BY lang""")
def _(t):
    return text_counters(t.documents, "text", "lang")


@query("compare_backends", S.with_(DOCS, "asked AS (SELECT doc_id AS id, 'passage: ' || text AS text FROM documents)",
    S.hashed("dv", "doc"), S.hashed("cv", "asked")) + """
    SELECT dv.id, round(list_cosine_similarity(dv.v, cv.v), 6) AS cosine FROM dv JOIN cv ON dv.id = cv.id
    WHERE abs(1 - list_cosine_similarity(dv.v, cv.v)) > 0.001""")
def _(t):
    plain = E.embed_column(docs(t), "text")
    asked = E.embed_column(docs(t).withColumn("text", with_options(F.col("text"), prompt="passage: ")), "text")
    return E.compare_backends(plain, asked, "id", 0.001).withColumn("cosine", F.round("cosine", 6))


@query("embed_images", """
    WITH b AS (SELECT page_id AS id, unnest(regexp_extract_all(hex(encode(html)), '..')) AS h FROM pages),
    n AS (SELECT id, CAST('0x' || h AS BIGINT) AS dim, count(*) AS c FROM b GROUP BY 1, 2),
    l AS (SELECT id, sqrt(CAST(sum(c * c) AS DOUBLE)) AS s FROM n GROUP BY 1)
    SELECT n.id, n.dim, round(CAST(CAST(c / s AS FLOAT) AS DOUBLE), 6) AS value FROM n JOIN l ON n.id = l.id""")
def _(t):
    files = t.pages.select(F.col("page_id").alias("id"), F.encode("html", "UTF-8").alias("content"))
    return views.long_form(E.embed_images(files), "id", "embedding").where("value > 0")


@query("embed_and_store", EMBEDDED)
def _(t):
    path = scratch_path(t.spark, "stored")
    E.embed_column(docs(t), "text").write.parquet(path)
    return views.long_form(t.spark.read.parquet(path), "id", "embedding")


@query("store_external_vectors", S.with_(
    "out AS (SELECT doc_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM documents JOIN embeddings ON doc_id = vec_id)") +
    S.long_form("out"))
def _(t):
    path = scratch_path(t.spark, "stored")
    L.store_vectors(docs(t), views.vectors(t), "id").write.parquet(path)
    return views.long_form(t.spark.read.parquet(path), "id", "embedding")


ARRAYS = """
    arr AS (SELECT conv_id || '-' || turn AS id, list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS word
            FROM conversations),
    zip AS (SELECT id, unnest(range(len(word))) AS pos, word, list_filter(word, lambda w: length(w) > 4) AS long FROM arr)"""


def arrays(t):
    word = tokens(F.col("text"))
    return views.messages(t).select("id", word.alias("word"), F.filter(word, lambda w: F.length(w) > 4).alias("long"))


@query("zip_arrays", S.with_(ARRAYS) + "SELECT id, pos, word[pos + 1] AS word, long[pos + 1] AS long FROM zip")
def _(t):
    return L.zip_arrays(arrays(t), ["word", "long"], "id").withColumn("pos", F.col("pos").cast("bigint"))


@query("unnest_ordinality", S.with_(ARRAYS) +
       "SELECT id, pos + 1 AS ordinal, word[pos + 1] AS word, long[pos + 1] AS long FROM zip")
def _(t):
    out = L.unnest_ordinality(arrays(t), ["word", "long"], "id")
    return out.withColumn("ordinal", F.col("ordinal").cast("bigint"))


@query("reembed_update", S.with_(DOCS,
    "renewed AS (SELECT doc_id AS id, 'passage: ' || text AS text FROM documents JOIN labels USING (doc_id))",
    S.hashed("dv", "doc"), S.hashed("rv", "renewed"),
    "out AS (SELECT dv.id, COALESCE(rv.v, dv.v) AS v FROM dv LEFT JOIN rv ON dv.id = rv.id)") + S.long_form("out"))
def _(t):
    stored = E.embed_column(docs(t), "text")
    renewed = views.labelled_documents(t).withColumn("text", with_options(F.col("text"), prompt="passage: "))
    return views.long_form(L.reembed(stored, E.embed_column(renewed, "text"), "id"), "id", "embedding")


@query("clear_embeddings", "SELECT vec_id AS id, label, true AS cleared FROM embeddings")
def _(t):
    return E.clear_embeddings(views.vectors(t)).select("id", "label", F.col("embedding").isNull().alias("cleared"))


@query("missing_embeddings", S.with_(DOCS, S.hashed("dv", "doc"),
    "out AS (SELECT dv.id, COALESCE(CAST(embedding AS DOUBLE[]), dv.v) AS v FROM dv LEFT JOIN embeddings ON dv.id = vec_id)") +
    S.long_form("out"))
def _(t):
    partly = docs(t).join(views.vectors(t).select("id", "embedding"), "id", "left")
    return views.long_form(E.embed_missing(partly, "text"), "id", "embedding")


@query("embed_json_array", S.with_("""
    part AS (SELECT conv_id || '-' || turn || '/' || pos AS id, CASE pos WHEN 0 THEN role ELSE text END AS text
             FROM conversations, (SELECT unnest([0, 1]) AS pos))""", S.hashed("pv", "part")) + S.long_form("pv"))
def _(t):
    call = t.conversations.select(
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"),
        F.to_json(F.array("role", "text")).alias("texts"))
    out = E.embed_json_array(call, "id", "texts")
    return views.long_form(out.withColumn("id", F.concat("id", F.lit("/"), F.col("pos").cast("string"))), "id", "embedding")


# A small vocabulary, each piece at the start of a word and, marked, inside one.
PIECES = [*"abcdefghijklmnopqrstuvwxyz", "an", "at", "de", "en", "er", "es", "ha", "he", "in", "la", "le", "nd", "on", "or", "re",
          "sch", "st", "th", "the", "ti", "tion", "un", "ver", "wh", ".", ","]
TOKENS = ["[UNK]", *PIECES, *["##" + p for p in PIECES]]


@query("subword_tokens", f"""
    WITH RECURSIVE
    voc AS (SELECT unnest(range({len(TOKENS)})) AS token, unnest({TOKENS}) AS piece),
    w AS (SELECT doc_id AS id, unnest(list_filter(string_split_regex(lower(text), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) AS word
          FROM documents),
    u AS (SELECT DISTINCT word FROM w),
    fit AS (SELECT word, i, arg_max(token, n) AS token, max(n) AS n FROM (
                SELECT word, i, n, CASE WHEN i > 1 THEN '##' ELSE '' END || substr(word, i, n) AS piece FROM (
                    SELECT word, unnest(range(1, length(word) + 1)) AS i FROM u), range(1, 5) AS r(n) WHERE i + n - 1 <= length(word))
            JOIN voc USING (piece) GROUP BY ALL),
    walk(word, place, tokens, total) AS (
        SELECT word, 1::BIGINT, 0::BIGINT, 0::BIGINT FROM u
        UNION ALL SELECT walk.word, place + n, tokens + 1, total + token FROM walk JOIN fit ON fit.word = walk.word AND i = place),
    cut AS (SELECT word, max(CASE WHEN place > length(word) THEN tokens END) AS tokens, max(CASE WHEN place > length(word) THEN total END) AS total
            FROM walk GROUP BY word)
    SELECT id, count(*) - count(tokens) AS n_unknown, sum(coalesce(tokens, 1))::BIGINT AS n_tokens, sum(coalesce(total, 0))::BIGINT AS id_sum
    FROM w JOIN cut USING (word) GROUP BY id""")
def _(t):
    cut = subwords.subword_ids(t.spark, subwords.Vocabulary(TOKENS))
    rows = docs(t).withColumn("ids", cut(F.col("text"))).where(F.size("ids") > 0)
    total = F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select("id", F.size(F.filter("ids", lambda x: x == 0)).cast("bigint").alias("n_unknown"),
                       F.size("ids").cast("bigint").alias("n_tokens"), total.alias("id_sum"))


@query("embed_token_budget", EMBEDDED)
def _(t):
    return views.long_form(E.embed_column(docs(t), "text", token_budget=4096), "id", "embedding")
