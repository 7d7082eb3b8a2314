import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from nearframe.llm.words import Words, runs, slices

TEXT = st.text(alphabet="ab \t\n\x0b\x1c\x85é　A", max_size=40)


def split(text, lower=False):
    data = (text or "").encode()
    return re.findall(rb"[^\x20\x09-\x0D]+", data.lower() if lower else data)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6), st.integers(1, 6))
def test_words_and_runs(texts, n):
    column = pa.array(["skipped", *texts], pa.string()).slice(1)
    words = Words(column, lower=True)
    expected = [split(t, True) for t in texts]
    found = [words.data[a:b].tobytes() for a, b in zip(words.starts, words.ends)]
    assert [found[a:b] for a, b in zip(words.first[:-1], words.first[1:])] == expected
    hashes, where, bounds = runs(words, words.hashes(), n, short=True)
    codes = {}
    for i, own in enumerate(expected):
        want = [tuple(own[k:k + n]) for k in range(len(own) - n + 1)] or ([tuple(own)] if own else [])
        mine = hashes[bounds[i]:bounds[i + 1]].tolist()
        assert len(mine) == len(want)
        for code, run in zip(mine, want):
            assert codes.setdefault(code, run) == run
    assert len(set(codes.values())) == len(codes)


def test_long_words_and_slices():
    column = pa.array(["x" * 300, "x" * 299, "x" * 300, "y " * 1000])
    hashes = Words(column).hashes()
    assert hashes[0] == hashes[2] != hashes[1] and len(np.unique(hashes[3:])) == 1
    batch = pa.RecordBatch.from_arrays([column], names=["text"])
    parts = list(slices(batch, limit=700))
    assert [p.num_rows for p in parts] == [2, 1, 1]
    assert pa.Table.from_batches(parts).column("text").to_pylist() == column.to_pylist()
    assert len(Words(parts[1].column("text"))) == 1
