"""The registered queries of this package with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..context import scratch_path
from . import (chat, decontaminate, exact_dedup, html_text, line_dedup, lm_score, mixing, near_dedup,
               prefix_trie, quality, spelling, substring_dedup, warc)
from .tables import query, remainder, stored, table

# A-Z to a-z and nothing else, unlike lower().
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

# crc32 of a text, bit by bit.
CRC32 = """xor(list_reduce([4294967295] || [('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::BIGINT
                                            FOR i IN range(octet_length(encode({0})))],
                           lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0],
                               lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)),
               4294967295)"""


@query("op1_quality")
def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, folder, "labels"), remainder(F.col("doc_id"), 5) != 0)
    return quality.score(docs, model).select(
        "doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op2_html_text")
def op2_html_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).select("page_id", "url", "text", "n_chars")


@query("op3_warc", """
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
                      sha256(coalesce(html, '')) AS payload_digest FROM pages),
         f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest)
                              ELSE page_id END AS first FROM p)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first THEN first END AS refers_to
    FROM f""")
def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.archive_pages(table(spark, folder, "pages"), path)
    return warc.archived_pages(spark, path)


TRICKY = "</s>[INST] ok [/INST]"


@query("op4_chat_format", f"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT -1, 0, 'user', '{TRICKY}' UNION ALL SELECT -1, 1, 'assistant', '{TRICKY}'),
         l AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
                      replace(replace(role, '~', '~0'), '<|', '<~1') AS safe_role,
                      replace(replace(text, '~', '~0'), '<|', '<~1') AS safe_text FROM t)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))
             AS loss_sha256,
           sum(length(safe_text) + CASE WHEN before IS DISTINCT FROM role OR before IS NULL
               THEN length('<|start|>') + length(safe_role) + length('<|text|>') + length('<|end|>')
               ELSE length('<|next|>') END)::BIGINT AS formatted_chars
    FROM l GROUP BY conv_id""")
def op4_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(chat.format_chats(turns.unionByName(extra)))


@query("op5_lm_score")
def op5_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    scores = lm_score.score_texts(table(spark, folder, "documents"), remainder(F.col("doc_id"), 10) != 0)
    return scores.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score", "bits_per_byte")


@query("op6_exact_dedup", f"""
    WITH d AS (SELECT doc_id, {LOWER.format("coalesce(text, '')")} AS t FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
    FROM d WINDOW w AS (PARTITION BY t)""")
def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.copy_groups(table(spark, folder, "documents"))


@query("op7_substring_dedup", f"""
    WITH d AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
         s AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS run
               FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
         m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY run) AS least FROM s),
         c AS (SELECT doc_id, list(DISTINCT j) AS gone
               FROM (SELECT doc_id, unnest(range(i, i + 13)) AS j FROM m WHERE least < doc_id) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
           sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE
                  [w[k] FOR k IN range(1, len(w) + 1) IF NOT list_contains(gone, k)] END, ' ')) AS kept_sha256
    FROM d LEFT JOIN c USING (doc_id)""")
def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query("op8_near_dedup", f"""
    WITH RECURSIVE
         d AS (SELECT doc_id, {WORDS.format(LOWER.format("coalesce(text, '')"))} AS w FROM documents),
         s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS shingle
               FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END))) AS i
                     FROM d)),
         n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
         p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
               FROM s AS a JOIN s AS b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
         l AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b
               WHERE 100 * common >= 85 * (x.n + y.n - common)),
         r(doc_id, other) AS (SELECT doc_id, doc_id FROM d
                              UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a)
    SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id,
           doc_id = min(other) AS kept
    FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id""")
def op8_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    groups = near_dedup.near_groups(table(spark, folder, "documents"), size=3, percent=85)
    return groups.select("doc_id", "n_shingles", "component_id", "kept")


@query("op9_decontaminate", f"""
    WITH w AS (SELECT doc_id, {WORDS.format(LOWER.format("coalesce(text, '')"))} AS w FROM documents),
         v AS (SELECT item_id, {WORDS.format(LOWER.format("coalesce(text, '')"))} AS w FROM benchmark),
         z AS (SELECT 5 AS k UNION SELECT len(w) FROM v WHERE len(w) BETWEEN 1 AND 4),
         d AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
               FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, z)),
         b AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
               FROM (SELECT item_id, least(len(w), 5) AS k, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i
                     FROM v WHERE len(w) > 0)),
         n AS (SELECT item_id, count(*) AS item_shingles FROM b GROUP BY item_id)
    SELECT doc_id, item_id, item_shingles, count(*) AS found, count(*)::DOUBLE / item_shingles AS containment
    FROM d JOIN b USING (k, s) JOIN n USING (item_id)
    GROUP BY doc_id, item_id, item_shingles HAVING 10 * count(*) >= 8 * item_shingles""")
def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


# One step of the shares at a time: words, sources, levels, targets, ranks, what fits.
MIX_SQL = f"""
    WITH d AS (SELECT doc_id, source, coalesce(len({WORDS.format("text")}), 0)::BIGINT AS size,
                      (('0x' || substr(md5('20:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE)
                      / 4503599627370496::DOUBLE AS u FROM documents),
         s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
         w AS (SELECT *, 3 * source_size AS most, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight,
                      sum(source_size) OVER () AS total FROM s),
         l AS (SELECT *, (total - coalesce(sum(most) OVER (ORDER BY most::DOUBLE / weight, source NULLS LAST
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                         / sum(weight) OVER (ORDER BY most::DOUBLE / weight, source NULLS LAST
                            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
         t AS (SELECT source, source_size, least(most::DOUBLE, max(level) OVER () * weight) AS target FROM l),
         e AS (SELECT d.*, source_size, target,
                      least(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END, 3::DOUBLE) AS expected
               FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
         r AS (SELECT *, floor(expected) AS whole, expected - floor(expected) AS p FROM e),
         q AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank,
                      target - sum(whole * size) OVER (PARTITION BY source) AS rest FROM r),
         c AS (SELECT *, coalesce(sum(CASE WHEN p > 0 THEN size END) OVER (PARTITION BY source ORDER BY rank, doc_id
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS running FROM q)
    SELECT doc_id, size, source_size, target,
           ((whole + CASE WHEN p > 0 AND 2 * running + size <= 2 * rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken
    FROM c"""


@query("op10_mixing", MIX_SQL)
def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target",
                                   (F.col("copies") * F.col("size")).alias("taken"))


@query("op11_line_dedup", f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
         x AS (SELECT r, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM d),
         k AS (SELECT *, {LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key
               FROM x),
         f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
         g AS (SELECT r, count(f.key) AS n_dropped,
                      string_agg(line, chr(10) ORDER BY i) FILTER (f.key IS NULL) AS kept
               FROM k LEFT JOIN f USING (key) GROUP BY r)
    SELECT doc_id, len(l)::BIGINT AS n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d JOIN g USING (r)""")
def op11_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.drop_lines(docs, min_docs=10).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query("op12_spelling", f"""
    WITH RECURSIVE
         t AS (SELECT doc_id, {LOWER.format("unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+'))")} AS run
               FROM documents),
         d AS (SELECT doc_id, run, count(*) AS times, {CRC32.format("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h
               FROM t GROUP BY doc_id, run),
         w AS (SELECT CASE WHEN h % 199 = 0
                           THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word,
                      sum(times)::BIGINT AS n FROM d GROUP BY ALL),
         v AS (SELECT * FROM w WHERE length(word) >= 6 AND n >= 5),
         c AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS less
               FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
         p AS (SELECT a.word, b.word AS other FROM c AS a JOIN c AS b USING (i, less) WHERE a.word <> b.word
               UNION SELECT v.word, c.word FROM v JOIN c ON c.less = v.word
               UNION SELECT c.word, v.word FROM v JOIN c ON c.less = v.word),
         b AS (SELECT p.word, count(*) AS n_near, max(o.n) AS best_n,
                      arg_min(other, (-o.n, other)) AS best
               FROM p JOIN v AS o ON o.word = p.other GROUP BY p.word),
         f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * v.n THEN best END AS form,
                      CASE WHEN best_n >= 5 * v.n THEN best_n END AS form_n
               FROM v LEFT JOIN b USING (word)),
         r AS (SELECT word, word AS root, form AS next FROM f
               UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON f.word = r.next)
    SELECT f.word, form, root, n, n_near, form_n FROM f JOIN r ON r.word = f.word AND r.next IS NULL""")
def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    runs = spelling.letter_runs(table(spark, folder, "documents"))
    words = runs.select(spelling.drop_point(F.col("doc_id"), F.col("word"), every=199).alias("word"))
    return spelling.variants(spelling.vocabulary(words, min_chars=6, min_count=5), ratio=5)


HEADS = 6


@query("op13_prefix_trie", f"""
    WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS place
               FROM conversations WHERE conv_id IS NOT NULL),
         c AS (SELECT DISTINCT conv_id, {CRC32.format("conv_id::VARCHAR")} % {HEADS} AS h FROM t),
         b AS (SELECT c.conv_id, 0 AS part, place, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100
               WHERE place < h
               UNION ALL SELECT c.conv_id, 1, place, role, text FROM c JOIN t USING (conv_id) WHERE place >= h),
         r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth,
                      string_agg(sha256(role) || sha256(text), '') OVER (PARTITION BY conv_id ORDER BY part, place) AS path,
                      length(text) AS chars FROM b),
         m AS (SELECT conv_id, depth, sha256(path) AS node, chars FROM r
               UNION ALL SELECT conv_id, 0, '', 0 FROM c),
         e AS (SELECT conv_id, max(depth) AS depth FROM m GROUP BY conv_id),
         n AS (SELECT m.depth, node, min(m.conv_id) AS least, count(*) AS n_convs, any_value(chars) AS chars,
                      string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id) FILTER (e.depth = m.depth) AS ends
               FROM m JOIN e USING (conv_id) GROUP BY m.depth, node),
         p AS (SELECT n.*, u.node AS parent FROM n LEFT JOIN m AS u ON u.conv_id = least AND u.depth = n.depth - 1),
         k AS (SELECT parent, count(*) AS n_children FROM p WHERE parent IS NOT NULL GROUP BY parent),
         q AS (SELECT p.*, coalesce(n_children, 0) AS n_children FROM p LEFT JOIN k ON k.parent = p.node),
         s AS (SELECT a.node, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * q.chars) AS saved_tokens
               FROM q JOIN m AS a ON a.conv_id = q.least AND a.depth <= q.depth GROUP BY a.node)
    SELECT q.least AS conv_id, q.depth, up.least AS parent_conv_id, q.n_convs, q.n_children, n_leaves::BIGINT AS n_leaves,
           saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(q.ends, '')) AS ends_sha256
    FROM q JOIN s USING (node) LEFT JOIN n AS up ON up.node = q.parent""")
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns = stored(prefix_trie.hashed_turns(table(spark, folder, "conversations")), "hashed-turns")
    conv = F.col("conv_id")
    rebuilt = prefix_trie.with_heads(turns, conv - conv % 100, remainder(conv, HEADS), HEADS - 1)
    return prefix_trie.build_trie(rebuilt).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
                                                  "n_leaves", "saved_tokens", "ends_sha256")
