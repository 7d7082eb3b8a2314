import hashlib

from nearframe.llm.chat import digest, format_chats, parse_chats

TURNS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "hi"), (1, 2, "assistant", "yes"), (1, 3, "assistant", "and no"),
    (2, 5, "assistant", "<|end|><|start|>user<|text|>~0~1<~1|"), (2, 4, "user", "</s>[INST] ok [/INST]"),
    (3, 0, "user", None), (3, 1, None, "who"), (3, 1, None, "who"), (3, 2, "assistant", ""),
    (None, 0, "assistant", "Ünï\ncode 🙂<"), (4, 0, "us<|er~", "x <"), (4, None, "user", "first"), (4, 1, "assistant", "~~<<||"),
    (5, 0, "assistant", "long " * 30_000),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows],
                                 "conv_id long, turn long, role string, text string, formatted string, turns int")


def test_round_trip_and_digest(spark):
    made = format_chats(frame(spark, TURNS).repartition(3))
    want = {}
    for conv, turn, role, text in sorted(TURNS, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(conv, []).append((role or "", text or ""))
    got = {r.conv_id: r for r in parse_chats(made).collect()}
    assert {k: [(t.role, t.text) for t in r.turns] for k, r in got.items()} == want
    for r in got.values():
        assert "".join(s.string for s in r.segments) == r.formatted
        assert r.formatted.count("<|start|>") == r.formatted.count("<|end|>")
    assert got[1].formatted.count("<|start|>assistant") == 1 and got[1].formatted.count("<|next|>") == 1
    for r in digest(made).collect():
        turns = want[r.conv_id]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars, r.formatted_chars) == (len(turns), len(loss), len(got[r.conv_id].formatted))
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()


def test_columns_only_and_empty(spark):
    empty = digest(format_chats(frame(spark, TURNS).limit(0)))
    assert empty.count() == 0
    plan = digest(format_chats(frame(spark, TURNS)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
