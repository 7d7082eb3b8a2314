import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from nearframe.llm import prefix_trie
from nearframe.llm.prefix_trie import build_trie, hashed_turns, with_heads
from nearframe.llm.tables import remainder, stored

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuild(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(turns, key=lambda x: x[0])] for c, turns in convs.items()}
    out = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


def brute(convs):
    nodes = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    children = defaultdict(set)
    for path in nodes:
        if path:
            children[path[:-1]].add(path)
    leaves, saved, out = {}, {}, []
    for path in sorted(nodes, key=len, reverse=True):
        leaves[path] = sum(leaves[c] for c in children[path]) if children[path] else 1
        saved[path] = sum(saved[c] for c in children[path]) + (len(nodes[path]) - 1) * (len(path[-1][1]) if path else 0)
        ends = sorted(c for c in nodes[path] if len(convs[c]) == len(path))
        out.append((min(nodes[path]), len(path), min(nodes[path[:-1]]) if path else None, len(nodes[path]),
                    len(children[path]), leaves[path], saved[path],
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def trie(df):
    turns = stored(hashed_turns(df), "turns")
    conv = F.col("conv_id")
    got = build_trie(with_heads(turns, conv - conv % 100, remainder(conv, 6), 5)).select(*COLUMNS).collect()
    return sorted(map(tuple, got), key=str)


@pytest.fixture(scope="module")
def rows():
    """Shared heads, copies, ends inside others, hundreds without their first conversation, empty and null fields."""
    pick, out = random.Random(3), []
    for c in [*range(100, 260), *range(305, 330), *range(-130, -90), -1, 0, 7, 10**12 + 3]:
        for t in range(pick.choice([1, 1, 2, 3, 4, 7, 9])):
            out.append((c, t, pick.choice(["user", "assistant", None, ""]), pick.choice(["a", "bé", "", None, "long " * 9])))
    out += [(400, t, "user", f"turn {t} \U0001F600") for t in range(70)]
    out += [(c, t, "user", f"turn {t} \U0001F600") for c in range(401, 430) for t in range(c - 395)]
    out += [(c, t, "user", "same") for c in range(1000, 1090) for t in range(3)]
    out += [(500, None, "user", "first"), (500, 3, "user", "x" * 60_000), (500, 2, "user", "b"), (None, 1, "user", "nobody's")]
    out += [(501, 1, "user", "twice")] * 2
    pick.shuffle(out)
    return out


@pytest.mark.parametrize("convs, turns", [(4096, 1 << 18), (7, 1 << 18), (1, 1), (4096, 40)])
def test_equal_to_brute_force(spark, rows, small_batches, monkeypatch, convs, turns):
    monkeypatch.setattr(prefix_trie, "SHARD_CONVS", convs)
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", turns)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    assert trie(df) == brute(rebuild(rows))


def test_turnless_and_clashing_names(spark):
    # Conversations shorter than what they give up, and a first conversation that is shorter still.
    rows = [(c, 0, "user", "only") for c in range(700, 712)] + [(c, 0, "user", "x") for c in range(850, 870)]
    made = rebuild(rows)
    assert any(not t for t in made.values())
    df = spark.createDataFrame([(*r, b"n", 1, 2) for r in rows],
                               "conv_id long, turn long, role string, text string, node binary, place int, chars int")
    assert trie(df) == brute(made)


def test_order_of_turns_with_one_number(spark):
    rows = [(1, 0, "user", t) for t in "dacb"]
    frames = [spark.createDataFrame(r, "conv_id long, turn long, role string, text string") for r in (rows, rows[::-1])]
    a, b = (sorted(map(str, hashed_turns(f).collect())) for f in frames)
    assert a == b and len(a) == 4


def test_empty_table_and_deep_conversation(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie(empty) == []
    deep = [(300, t, "user", str(t % 7)) for t in range(3000)]
    got = trie(spark.createDataFrame(deep, "conv_id long, turn long, role string, text string"))
    assert len(got) == 3001 and {r[5] for r in got} == {1}
