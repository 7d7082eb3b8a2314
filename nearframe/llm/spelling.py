"""Spelling variants: words one inserted, deleted or replaced code point apart, and the form each goes back to.

If two words differ by one code point at place ``i`` of the longer one, with ``m``
code points, they have the ``i`` before and the ``m - 1 - i`` behind in common. The
places of ``m`` are cut into bands, and a word joins, for both lengths ``m`` it can
have in a pair and every band, the group of words with equal code points outside
that band. Within a group words are padded code-point matrices, compared in tiles
of block pairs: they are near exactly if common prefix plus common suffix reaches
``m - 1``. A pair is reported in the one band its common prefix ends in. A group
too large for a block is cut into blocks, and each pair of blocks is a unit of
work of its own, so no task holds more than two blocks.

Defined results
---------------
* A null or empty text has no words. Repeated rows and rows with one id count each.
* Words are told apart by their code points; a word has no upper length.
* The form of a word is its near word with the largest count, on ties the first in
  code-point order, if that count is at least ``ratio`` times the word's own. Forms
  have larger counts than their words, so following them ends.
* An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .line_dedup import lower_ascii
from .tables import stored

RUN = r"[A-Za-zÀ-ÿ]+"
BANDS = 3
# A block of words has at most this many rows, and about this many code points if words are long.
BLOCK_ROWS, BLOCK_POINTS = 1024, 1 << 20
TILE = 256
# Code points compared at a time.
PIECE = 1 << 21
# Paddings are no code points and differ from each other, so no comparison runs past a word.
PAD, OTHER_PAD = 0x110000, 0x110001
NEAR_SCHEMA = pa.schema([("word", pa.string()), ("other", pa.string()), ("other_n", pa.int64())])


def letter_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, word) of every maximal run of letters, A-Z in lower case."""
    runs = F.explode(F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0)))
    return docs.select(F.col(doc_id).alias("doc_id"), runs.alias("run")).select("doc_id", lower_ascii(F.col("run")).alias("word"))


def drop_point(doc_id: Column, word: Column, every: int) -> Column:
    """``word`` without one code point if ``every`` divides the crc32 of ``<doc_id>:<word>``."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % F.char_length(word)).cast("int")
    return F.when(h % every == 0, F.concat(F.left(word, at), F.substr(word, at + 2))).otherwise(word)


def vocabulary(words: DataFrame, min_chars: int = 6, min_count: int = 5) -> DataFrame:
    """(word, n) of the words of at least ``min_chars`` code points found ``min_count`` times."""
    return (words.where(F.char_length("word") >= min_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= min_count))


def _grouped(vocab: DataFrame) -> DataFrame:
    """Rows of (m, band, unit, part, solo, word, n): a word in every unit of comparisons it belongs to."""
    size = F.char_length("word")
    m, band = F.col("m"), F.col("band")
    start, stop = F.floor(band * m / BANDS).cast("int"), F.floor((band + 1) * m / BANDS).cast("int")
    keyed = (vocab.select("word", "n", F.explode(F.array(size, size + 1)).alias("m"))
             .select("*", F.explode(F.array(*map(F.lit, range(BANDS)))).alias("band"))
             .select("*", F.xxhash64(m, band, F.left("word", start), F.right("word", m - stop)).alias("g")))
    sizes = keyed.groupBy("g").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    rows = F.greatest(F.lit(1), F.least(F.lit(BLOCK_ROWS), F.floor(F.lit(BLOCK_POINTS) / m)))
    blocks = keyed.join(sizes, "g").withColumn("blocks", F.ceil(F.col("size") / rows).cast("int"))
    blocks = blocks.withColumn("part", F.pmod(F.xxhash64("word"), "blocks").cast("int"))
    pairs = blocks.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return pairs.select("m", "band", F.xxhash64("g", F.least("part", "with"), F.greatest("part", "with")).alias("unit"),
                        "part", (F.col("part") == F.col("with")).alias("solo"), "word", "n")


def _padded(words: list[str], lengths: np.ndarray, pad: int) -> np.ndarray:
    """One row of code points for each word, padded by one at least."""
    out = np.full((len(words), lengths.max() + 1), pad, np.uint32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    return out


def _near(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Near words of whole units, as (word, other) both ways."""
    unit, part, m, band = (np.asarray(rows.column(c)) for c in ("unit", "part", "m", "band"))
    solo = np.asarray(rows.column("solo").combine_chunks().cast(pa.int8())).astype(bool)
    words = rows.column("word").to_pylist()
    size = np.array([len(w) for w in words])
    back = [w[::-1] for w in words]
    left, right = _padded(words, size, PAD), _padded(words, size, OTHER_PAD)
    left_back, right_back = _padded(back, size, PAD), _padded(back, size, OTHER_PAD)
    piece = max(1, PIECE // left.shape[1])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for a in range(0, len(words), TILE):
        x = slice(a, min(a + TILE, len(words)))
        for b in range(a, len(words), TILE):
            if b > a and unit[b] != unit[x.stop - 1]:
                break
            y = slice(b, min(b + TILE, len(words)))
            longer = np.maximum(size[x, None], size[None, y])
            mask = ((unit[x, None] == unit[None, y]) & (band[x, None] == band[None, y])
                    & (m[x, None] == longer) & (m[None, y] == longer)
                    & (solo[x, None] | (part[x, None] != part[None, y])))
            i, j = np.nonzero(np.triu(mask, 1) if a == b else mask)
            for at in range(0, len(i), piece):
                p, q = i[at:at + piece] + a, j[at:at + piece] + b
                prefix = np.argmin(left[p] == right[q], 1)
                suffix = np.argmin(left_back[p] == right_back[q], 1)
                near = ((prefix + suffix >= m[p] - 1) & (prefix >= band[p] * m[p] // BANDS)
                        & (prefix < (band[p] + 1) * m[p] // BANDS))
                found.append((p[near], q[near]))
    if found:
        p, q = (np.concatenate(side) for side in zip(*found))
        text, n = rows.column("word").combine_chunks(), rows.column("n").combine_chunks()
        one, two = np.concatenate([p, q]), np.concatenate([q, p])
        yield pa.RecordBatch.from_arrays([text.take(one), text.take(two), n.take(two)], schema=NEAR_SCHEMA)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the sorted rows between units and compare what is together."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        unit, m = np.asarray(rows.column("unit")), np.asarray(rows.column("m"))
        starts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        held = rows.slice(int(starts[-1]))
        yield from _in_parts(rows.slice(0, int(starts[-1])), starts[:-1], m)
    if held is not None:
        yield from _near(held)


def _in_parts(rows: pa.Table, starts: np.ndarray, m: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Units together as long as their matrices stay small; ``m`` does not fall."""
    at = 0
    while at < len(starts):
        to = at + 1
        ends = np.append(starts[1:], rows.num_rows)
        while to < len(starts) and (ends[to] - starts[at]) * m[ends[to] - 1] <= BLOCK_POINTS:
            to += 1
        yield from _near(rows.slice(int(starts[at]), int(ends[to - 1] - starts[at])))
        at = to


def near_words(vocab: DataFrame) -> DataFrame:
    """(word, other, other_n) for all words of ``vocab`` (word, n) one code point apart, both ways."""
    parts = int(vocab.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _grouped(vocab).repartition(parts, "unit").sortWithinPartitions("m", "unit")
    return rows.mapInArrow(_search, "word string, other string, other_n bigint")


def last_forms(links: DataFrame, longest: int) -> DataFrame:
    """(word, root) from (word, form): every form is followed to its last.

    ``longest`` bounds the links of a chain. Each round doubles how far a word
    sees, and is written to the shared folder.
    """
    roots = links.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(1, longest)))):
        roots = stored(roots, "roots")
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = roots.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return roots


def variants(vocab: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``vocab`` (word, n)."""
    if ratio < 2:
        raise ValueError("a form has to be more frequent than its word")
    vocab = stored(vocab, "vocabulary")
    best = (near_words(vocab).groupBy("word")
            .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best")))
    is_form = -F.col("best.minus") >= ratio * F.col("n")
    words = stored(vocab.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.minus")).alias("form_n")), "words")
    most, least = words.agg(F.max("n"), F.min("n")).first()
    longest = 0 if most is None else int(math.log(most / least, ratio) + 1e-9)
    roots = last_forms(words.where("form IS NOT NULL"), longest)
    return words.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
