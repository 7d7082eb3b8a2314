import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from nearframe.llm.substring_dedup import ANCHOR, remove_repeats
from nearframe.llm.words import Words, spans
from made_texts import prose


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def brute(texts, n):
    """What is left of every row."""
    first = {}
    for doc_id, text in texts:
        own, rank = words(text), float("inf") if doc_id is None else doc_id
        for i in range(len(own) - n + 1):
            run = tuple(own[i:i + n])
            first[run] = min(first.get(run, rank), rank)
    out = []
    for doc_id, text in texts:
        own, rank = words(text), float("inf") if doc_id is None else doc_id
        keep = [True] * len(own)
        for i in range(len(own) - n + 1):
            if first[tuple(own[i:i + n])] < rank:
                keep[i:i + n] = [False] * n
        out.append((doc_id, len(own), keep.count(False), b" ".join(w for w, k in zip(own, keep) if k).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length, slab", [(13, 1 << 20), (13, 1), (7, 200), (5, 1)])
def test_equal_to_brute_force(documents, texts, small_batches, length, slab):
    got = remove_repeats(documents, length, slab=slab).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=repr) == brute(texts, length)
    for r in got:
        assert sum(s.stop - s.start for s in r.repeats) == r.n_removed
        assert all(s.stop - s.start >= length for s in r.repeats)
        assert all(a.stop < b.start for a, b in zip(r.repeats, r.repeats[1:]))


def test_empty_table_and_short_length(documents):
    assert remove_repeats(documents.limit(0)).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(documents, 4)


def test_a_phrase_in_very_many_documents(spark):
    """Different windows around one anchor are told apart, however many there are, across slabs too."""
    phrases = [" ".join(f"p{i}x{j}" for j in range(ANCHOR)) for i in range(20_000)]
    small = [spans(Words(pa.array([p])).hashes(), ANCHOR)[0] for p in phrases]
    phrase, n = phrases[int(np.argmin(small))], 300_000
    rows = spark.range(n, numPartitions=8).selectExpr(
        "id doc_id", "concat_ws(' ', 'a', hex(xxhash64(id, 1)), 'b', hex(xxhash64(id, 2)), '%s', 'c', "
                     "hex(xxhash64(id, 3)), 'd', hex(xxhash64(id, 4))) text" % phrase)
    got = remove_repeats(rows.unionAll(rows.where("doc_id < 10").selectExpr("doc_id + %d" % n, "text")), 13, slab=1)
    removed = {r.doc_id: r.n_removed for r in got.where("n_removed > 0").select("doc_id", "n_removed").collect()}
    assert removed == {n + i: 13 for i in range(10)}


@pytest.mark.parametrize("slab", [1 << 20, 1])
@pytest.mark.parametrize("shared", [None, 7])
def test_rows_with_one_id(spark, small_batches, shared, slab):
    """Rows that share an id (or have none) keep their own marks, whatever stands beside them."""
    p, q = prose(1, 20), prose(2, 20)
    # Texts with one checksum of 24 bits, of which one repeats the first document.
    plain = {zlib.crc32(t.encode()) & 0xFFFFFF: t for t in (prose(100 + i, 30) for i in range(10_000))}
    tails = (f"{p} {prose(-i, 4)}" for i in range(100, 30_000))
    alike = next((t, plain[c]) for t in tails if (c := zlib.crc32(t.encode()) & 0xFFFFFF) in plain)
    # The repeated windows of one row end where those of the next begin.
    texts = [p, f"{prose(4, 8)} {q}", *alike, *[f"{prose(5, 3)} {p}"] * 20, None]
    rows = [(1, f"{p} {q}"), *((shared, t) for t in texts)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 13, slab=slab).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=repr) == brute(rows, 13)


def test_what_is_shuffled_is_small():
    """Texts come compressed and whole; an anchor's hash has zeros below the bits that rows are joined on."""
    import numpy as np
    import pyarrow as pa

    from nearframe.llm import substring_dedup as S

    texts = [" ".join(f"w{(i * k) % 97}" for i in range(400)) for k in range(1, 20)] + [None, ""]
    ids = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, ids, pa.array(texts)], names=["key", "doc_id", "text_id", "text"])
    rows = [r for part in S._pack(iter([batch])) for r in part.to_pylist()]
    whole = [pa.Codec("zstd").decompress(r["packed"], r["size"], asbytes=True).decode() for r in rows]
    assert whole == [t or "" for t in texts]
    assert sum(len(r["packed"]) for r in rows) < sum(r["size"] for r in rows) / 2
    seeds = [r for part in S._seeds(13, 1 << 20)(iter([batch])) for r in part.to_pylist() if r["extensions"]]
    assert seeds and not any(np.array([r["seed"] for r in seeds]).view(np.uint64) & np.uint64((1 << 24) - 1))
