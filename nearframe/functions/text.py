"""Text preparation before embedding, and stable hash numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Separators of the whitespace tokenizer, shared by all backends and checks.
SPACES = r"[ \t\n\x0B\f\r]+"

# Bytes of text that a task works on at a time.
PIECE_BYTES = 2 << 20


def pieces(column: pa.Array) -> Iterator[pa.Array]:
    """Cut a column between rows so that what is made of a part stays small; one longer text is a part of its own.

    A batch is bounded in rows, not in bytes of text. Columns of neither text nor bytes are not cut.
    """
    kind = column.type
    if not (pa.types.is_string(kind) or pa.types.is_large_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_binary(kind)):
        yield column
        return
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0)), dtype=np.int64)
    start, done = 0, 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(ends, done + PIECE_BYTES, "right")))
        yield column.slice(start, stop - start)
        start, done = stop, int(ends[min(stop, len(column)) - 1])


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda t: t != "")


# Prompts that a request may ask for by name.
_PROMPTS: dict[str, str] = {"query": "query: ", "passage": "passage: "}


def register_prompt(name: str, prompt: str) -> None:
    _PROMPTS[name] = prompt


def with_options(text: Column, truncate_to: int | None = None, side: str = "right",
                 prompt: str | None = None, prompt_name: str | None = None) -> Column:
    """Apply request options: cut tokens off one side, then put a prompt in front, literal or by name."""
    if prompt is not None and prompt_name is not None:
        raise ValueError("give a prompt or the name of one")
    if prompt_name is not None:
        if prompt_name not in _PROMPTS:
            raise ValueError(f"unknown prompt {prompt_name!r}; known: {sorted(_PROMPTS)}")
        prompt = _PROMPTS[prompt_name]
    if side not in ("left", "right"):
        raise ValueError("side is 'left' or 'right'")
    if truncate_to is not None:
        words = tokens(text)
        if side == "right":
            words = F.slice(words, 1, truncate_to)
        else:
            words = F.reverse(F.slice(F.reverse(words), 1, truncate_to))
        text = F.array_join(words, " ")
    if prompt is not None:
        text = F.concat(F.lit(prompt), text)
    return text


def text_counters(df: DataFrame, text: str, *by: str) -> DataFrame:
    """Inputs, characters and tokens per batch key."""
    body = F.col(text)
    return df.groupBy(*by).agg(
        F.count(body).alias("inputs"),
        F.coalesce(F.sum(F.length(body)), F.lit(0)).alias("chars"),
        F.coalesce(F.sum(F.size(tokens(body))), F.lit(0)).cast("bigint").alias("tokens"),
    )


def stable_number(*parts: Column | str) -> Column:
    """A number in [0, 2^32) from the MD5 of the joined parts."""
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    digest = F.md5(F.concat_ws(":", *cols).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def pick(values: list[str], number: Column) -> Column:
    """Element of a fixed list chosen by ``number`` modulo its length."""
    choices = F.array(*[F.lit(v) for v in values])
    return F.element_at(choices, (number % len(values)).cast("int") + 1)


def parent_label(path: Column) -> Column:
    """Name of the folder that holds a file."""
    return F.try_element_at(F.split(path, "/"), F.lit(-2))
