"""Line deduplication on column expressions: which lines stay, as a compressed bitmap per document.

A text is split at ``\\n``. The key of a line is the line without white space at
both ends and with A-Z in lower case; a line with an empty key always stays.
Keys are hashed to 64 bits. The hashes are range-partitioned and sorted by
document and position behind them, so one pass over each partition sees all
lines of a key together, the first occurrence first, and can tell in how many
documents the key is. Only the places of lines that go leave this pass. They are
put together to words of 64 lines per document, and words in which every line
stays are left out.

The most frequent keys are counted before: four for every shuffle partition, so
no other key has more than a quarter of a partition's share of the lines. Their
counts are sent to the tasks and their lines are dealt by document, not by key.

Defined results
---------------
* A null or empty text is one empty line. ``\\r`` before ``\\n`` is white space of the line.
* Every row is a document; rows that are repeated, or share an id, count each.
* ``keep="first"``: of a key's lines the one in the smallest document stays, by id
  (null last), then text hash, then position; repeated rows keep it each.
* An empty table gives an empty result. Very long texts are split whole.
* Lines count as equal when the 64-bit hashes of their keys agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import free_names

SPACE = " \t\n\x0b\f\r"
# Lines in a word of a bitmap; a shift by 6 bits.
WORD_BITS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Keys for each shuffle partition whose lines are dealt by document.
HOT_PER_PARTITION = 4


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; texts of ASCII alone take the faster function."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_hashes(text: Column) -> Column:
    """The hash of every line's key; null for an empty key."""
    inner = F.transform(lines_of(text), lambda line: F.trim(line, F.lit(SPACE)))
    return F.transform(inner, lambda key: F.when(key != "", F.xxhash64(lower_ascii(key))))


def _placed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per document: its id, the hash of its text, and its lines as (hash, position), sorted."""
    lines = F.transform(line_hashes(F.col(text)), lambda h, i: F.struct(h.alias("h"), i.alias("pos")))
    return docs.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("t"),
                       F.sort_array(F.filter(lines, lambda x: x["h"].isNotNull())).alias("lines"))


def _is_first(lines: Column, i: Column) -> Column:
    """Whether line ``i`` of the sorted lines is the first of its key in the document."""
    return (i == 0) | (F.get(lines, i - 1)["h"] != F.get(lines, i)["h"])


def drop_places(docs: DataFrame, min_docs: int = 10, keep: str = "none", doc_id: str = "doc_id",
                text: str = "text") -> DataFrame:
    """(doc, t, pos) of every line that goes: its key is in at least ``min_docs`` documents.

    With ``keep="first"`` the first occurrence of such a key stays.
    """
    if keep not in ("none", "first"):
        raise ValueError(f"keep is 'none' or 'first', not {keep!r}")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = _placed(docs, doc_id, text)
    place = F.struct(F.col("doc").isNull().alias("last"), "doc", "t", "pos")
    once = placed.select("doc", "t", F.explode(F.filter("lines", lambda x, i: _is_first(F.col("lines"), i))).alias("x"))
    counts = once.select("doc", "t", "x.h", "x.pos").groupBy(F.col("h").alias("hot")).agg(
        F.count(F.lit(1)).alias("hot_docs"), *([F.min(place).alias("hot_first")] if keep == "first" else []))
    hot = counts.orderBy(F.desc("hot_docs"), "hot").limit(HOT_PER_PARTITION * parts)
    flagged = F.transform("lines", lambda x, i: F.struct(
        x["h"].alias("h"), x["pos"].alias("pos"), _is_first(F.col("lines"), i).alias("first")))
    rows = placed.select("doc", "t", F.explode(flagged).alias("x")).select("doc", "t", "x.*")
    rows = rows.join(F.broadcast(hot), F.col("h") == F.col("hot"), "left").drop("hot")
    # The upper half of a hash, as a share of its range, names its partition.
    by_range = F.shiftright(F.shiftrightunsigned("h", 32) * parts, 32).cast("int")
    rows = rows.withColumn("part", F.when(F.col("hot_docs").isNull(), by_range)
                           .otherwise(F.pmod(F.xxhash64("doc", "t"), F.lit(parts)).cast("int")))
    group = Window.partitionBy("part", "h")
    ordered = group.orderBy(F.asc_nulls_last("doc"), "t", "pos")
    found = (rows.repartitionById(parts, "part")
             .withColumn("docs", F.coalesce("hot_docs", F.sum(F.col("first").cast("long")).over(
                 group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))))
    if keep == "first":
        smallest = F.first(place).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        found = found.withColumn("stays", place == F.coalesce("hot_first", smallest)).where("NOT stays")
    return found.where(F.col("docs") >= min_docs).select("doc", "t", "pos")


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, keep: str = "none", doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """(doc, t, n_dropped, keep) of every document that loses a line.

    ``keep`` is the bitmap in words of 64 lines, sorted, as (word, bits) with the
    lowest bit first; a word that is not there keeps all its lines.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % WORD_BITS)
    words = (drop_places(docs, min_docs, keep, doc_id, text).repartition("doc", "t")
             .groupBy("doc", "t", F.shiftright("pos", 6).alias("word"))
             .agg(F.bit_or(bit).alias("gone")))
    return words.groupBy("doc", "t").agg(
        F.sum(F.bit_count("gone")).alias("n_dropped"),
        F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits")))).alias("keep"))


def kept_text(text: Column, keep: Column) -> Column:
    """The lines of ``text`` that a bitmap keeps, joined by ``\\n``."""
    def with_gap(word: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(-1)).otherwise(F.get(keep, i - 1)["word"])
        return F.concat(F.array_repeat(F.lit(-1).cast("long"), word["word"] - before - 1), F.array(word["bits"]))

    def stays(every: Column, i: Column) -> Column:
        bits = F.coalesce(F.get(every, F.shiftright(i, 6)), F.lit(-1).cast("long"))
        return F.getbit(bits, i % WORD_BITS) == 1

    # An array of one bitmap, so that it is unfolded once and not for every line.
    unfolded = F.array(F.flatten(F.transform(keep, with_gap)))
    lines = F.transform(unfolded, lambda every: F.filter(lines_of(text), lambda line, i: stays(every, i)))
    return F.array_join(F.get(lines, F.lit(0)), "\n")


def drop_lines(docs: DataFrame, min_docs: int = 10, keep: str = "none", doc_id: str = "doc_id",
               text: str = "text") -> DataFrame:
    """``docs`` with n_lines, n_dropped, the bitmap ``keep`` and ``kept_text``."""
    n_lines, n_dropped, bitmap, kept, t = free_names(docs, "n_lines", "n_dropped", "keep", "kept_text", "text_hash")
    maps = keep_bitmaps(docs, min_docs, keep, doc_id, text).select(
        F.col("doc").alias("_doc"), F.col("t").alias("_t"), F.col("n_dropped").alias("_n"), F.col("keep").alias("_keep"))
    left = docs.withColumn(t, F.xxhash64(text))
    joined = left.join(maps, left[doc_id].eqNullSafe(maps["_doc"]) & (left[t] == maps["_t"]), "left")
    return joined.select(
        *(left[c] for c in docs.columns), F.size(lines_of(left[text])).cast("long").alias(n_lines),
        F.coalesce("_n", F.lit(0)).cast("long").alias(n_dropped),
        F.coalesce("_keep", F.array().cast("array<struct<word:int,bits:bigint>>")).alias(bitmap),
        F.when(F.col("_n").isNull(), F.coalesce(left[text], F.lit("")))
        .otherwise(kept_text(left[text], F.col("_keep"))).alias(kept))
