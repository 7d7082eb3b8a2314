import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearframe.functions.text import register_prompt, with_options
from nearframe.operators import embedding as E
from nearframe.operators import loading as L

TEXTS = ["the cat sat", "The  CAT\nsat", "", None, 'a | "quoted"\nline', "x " * 5000, "été ÇA"]


def frame(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")


def by_hand(text, dims):
    v = np.zeros(dims)
    for t in text.lower().split():
        h = hashlib.md5(t.encode()).hexdigest()
        v[int(h[:8], 16) % dims] += 1 if int(h[8], 16) % 2 == 0 else -1
    n = np.sqrt((v * v).sum())
    return (v / n if n else v).astype(np.float32)


def test_hash_backend_equals_its_rule(spark):
    rows = E.embed_column(frame(spark), "text", model="hash-32").collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        if r["text"] is None:
            assert r["embedding"] is None
        else:
            assert np.allclose(r["embedding"], by_hand(r["text"], 32), atol=1e-7)


@pytest.mark.parametrize("batch_size", [1, 2, 32, None])
def test_result_does_not_depend_on_batch_size(spark, batch_size):
    want = {r["id"]: r["embedding"] for r in E.embed_column(frame(spark), "text").collect()}
    got = {r["id"]: r["embedding"] for r in E.embed_column(frame(spark), "text", batch_size=batch_size).collect()}
    assert got == want


def test_token_blocks_do_not_change_the_result(spark, monkeypatch):
    import pyarrow as pa

    texts = pa.array([f"word{i} other{i % 3}" for i in range(50)])
    whole = E._hash_encoder("hash-32")(texts)
    monkeypatch.setattr(E, "TOKEN_BLOCK", 40)
    assert np.array_equal(E._hash_encoder("hash-32")(texts), whole)


def test_unknown_backend_and_model_are_refused_before_any_job(spark):
    with pytest.raises(ValueError, match="unknown embedding backend"):
        E.embed_column(frame(spark), "text", "nope")
    with pytest.raises(ValueError, match="has no model"):
        E.embed_column(frame(spark), "text", "hash", "hash-7")


def test_own_backend_and_width_check(spark):
    E.register_backend("lengths", lambda model: lambda texts: [[len(t), 1.0] for t in texts], {"two": 2, "three": 3})
    out = {r["id"]: r["embedding"] for r in E.embed_column(frame(spark), "text", "lengths", "two").collect()}
    assert out[0] == [11.0, 1.0] and out[3] is None
    with pytest.raises(Exception, match="expected"):
        E.embed_column(frame(spark), "text", "lengths", "three").collect()


def test_factory_runs_once_per_worker(spark, tmp_path):
    """Worker processes are reused by later tasks, and columns and SQL calls share their encoders."""
    log = tmp_path / "calls"

    def factory(model):
        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        return lambda texts: [[1.0] for _ in texts]

    E.register_backend("counted", factory, {"m": 1})
    E.register_sql(spark)
    df = spark.range(0, 1000, 1, 6).select("id", F.col("id").cast("string").alias("text"))
    for _ in range(2):
        assert E.embed_column(df, "text", "counted", "m", batch_size=10).where("embedding is not null").count() == 1000
    df.createOrReplaceTempView("counted_texts")
    for call in ("embed_text('counted', 'm', text)", "embed_texts('counted', 'm', array(text, text))"):
        assert spark.sql(f"select {call} as v from counted_texts").where("v is not null").count() == 1000
    pids = log.read_text().split()
    assert len(pids) == len(set(pids))


def test_a_backend_registered_anew_is_made_again(spark):
    for value in (1.0, 2.0):
        E.register_backend("changing", lambda model, value=value: lambda texts: [[value] for _ in texts], {"m": 1})
        got = E.embed_column(frame(spark), "text", "changing", "m").where("text is not null").select("embedding").distinct()
        assert [r["embedding"] for r in got.collect()] == [[value]]


def test_normalize_and_named_prompts(spark):
    raw = E.embed_column(frame(spark), "text", model="hash-8", normalize=False).collect()
    unit = E.embed_column(frame(spark), "text", model="hash-8", normalize=True).collect()
    for a, b in zip(raw, unit):
        if a["text"] is None:
            assert a["embedding"] is None
            continue
        v = np.array(a["embedding"])
        assert np.array_equal(v, v.round()) and np.allclose(b["embedding"], by_hand(a["text"], 8), atol=1e-6)
    E.register_backend("long", lambda model: lambda texts: [[3.0, 4.0] for _ in texts], {"m": 2})
    assert np.allclose(E.embed_column(frame(spark), "text", "long", "m", normalize=True).first()["embedding"], [0.6, 0.8])
    with pytest.raises(ValueError, match="unit vectors only"):
        E.embed_column(frame(spark), "text", "long", "m", normalize=False)
    register_prompt("mine", "m: ")
    asked = frame(spark).select(with_options(F.col("text"), prompt_name="mine").alias("t"),
                                with_options(F.col("text"), prompt_name="query").alias("q")).first()
    assert (asked["t"], asked["q"]) == ("m: the cat sat", "query: the cat sat")
    for options in ({"prompt_name": "none"}, {"prompt": "a", "prompt_name": "mine"}):
        with pytest.raises(ValueError):
            with_options(F.col("text"), **options)


def test_vector_is_computed_once(spark):
    plan = E.embed_column(frame(spark), "text").where("embedding is not null").select("id", F.explode("embedding"))
    assert plan._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_sql_functions(spark):
    E.register_sql(spark)
    row = spark.sql("""
        select embed_text('hash', 'hash-64', 'the cat sat') t, embed_text('hash', 'hash-64', cast(null as string)) none,
               embed_image('byte_histogram', 'bytes-256', cast('ab' as binary)) i""").first()
    assert np.allclose(row["t"], by_hand("the cat sat", 64)) and row["none"] is None
    assert row["i"][ord("a")] == pytest.approx(2 ** -0.5) and sum(x > 0 for x in row["i"]) == 2
    with pytest.raises(Exception, match="unknown embedding backend"):
        spark.sql("select embed_text('nope', 'm', 'x')").collect()


def test_sql_array_form_keeps_order_and_zips_by_position(spark):
    E.register_sql(spark)
    spark.createDataFrame([(1, ["a", None, "b c"]), (2, []), (3, None), (4, ["a"])], "k int, texts array<string>") \
        .createOrReplaceTempView("calls")
    out = {r["k"]: r["v"] for r in spark.sql("select k, embed_texts('hash', 'hash-32', texts) v from calls").collect()}
    assert out[2] == [] and out[3] is None and out[1][1] is None and out[1][0] == out[4][0]
    assert np.allclose(out[1][2], by_hand("b c", 32))
    rows = spark.sql("""select k, inline(arrays_zip(texts, v)) as (t, e)
                        from (select k, texts, embed_texts('hash', 'hash-32', texts) v from calls)""").collect()
    assert all(r["e"] is None or np.allclose(r["e"], by_hand(r["t"], 32)) for r in rows) and len(rows) == 4


def test_sql_distances(spark):
    E.register_sql(spark)
    row = spark.sql("""select l2_distance(array(3, 4), array(0, 8)) l, cosine_similarity(array(3f, 4f), array(0f, 8f)) c,
                       cosine_distance(array(0, 0), array(1, 0)) z""").first()
    assert tuple(row) == pytest.approx((5.0, 0.8, 1.0))


def test_images_follow_their_bytes(spark):
    df = spark.createDataFrame([(1, bytearray(b"aab")), (2, bytearray(b"")), (3, None)], "id int, content binary")
    out = {r["id"]: r["embedding"] for r in E.embed_images(df).collect()}
    assert out[1][97] == pytest.approx(2 / 5 ** 0.5) and out[1][98] == pytest.approx(1 / 5 ** 0.5)
    assert set(out[2]) == {0.0} and out[3] is None


def test_json_array_and_varargs(spark):
    df = spark.createDataFrame([(1, '["a", "b c", null]', "a", "b c")], "k int, j string, x string, y string")
    want = {t: list(by_hand(t, 64)) for t in ("a", "b c")}
    out = E.embed_json_array(df, "k", "j").collect()
    assert sorted((r["pos"], r["text"]) for r in out) == [(0, "a"), (1, "b c"), (2, None)]
    assert all(np.allclose(r["embedding"], want[r["text"]]) for r in out if r["text"])
    out = E.embed_varargs(df, "k", ["x", "y"]).collect()
    assert [r["text"] for r in sorted(out, key=lambda r: r["pos"])] == ["a", "b c"]


def test_clear_then_embed_missing_then_update(spark):
    stored = E.embed_column(frame(spark), "text")
    before = {r["id"]: r["embedding"] for r in stored.collect()}
    cleared = E.clear_embeddings(stored)
    assert cleared.where("embedding is not null").count() == 0
    assert {r["id"]: r["embedding"] for r in E.embed_missing(cleared, "text").collect()} == before
    other = spark.createDataFrame([(0, [9.0] * 64), (99, [1.0] * 64)], "id int, embedding array<float>")
    after = {r["id"]: r["embedding"] for r in L.reembed(stored, other, "id").collect()}
    assert after[0] == [9.0] * 64 and {k: v for k, v in after.items() if k} == {k: v for k, v in before.items() if k}


def test_embed_missing_leaves_present_vectors(spark):
    df = spark.createDataFrame([(1, "a", [7.0]), (2, "b", None)], "id int, text string, embedding array<float>")
    E.register_backend("fixed", lambda m: lambda texts: [[float(ord(t))] for t in texts], {"m": 1})
    out = {r["id"]: r["embedding"] for r in E.embed_missing(df, "text", "fixed", "m").collect()}
    assert out == {1: [7.0], 2: [98.0]}


def test_backends_that_disagree_are_reported(spark):
    a = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "id int, embedding array<double>")
    b = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 1.0])], "id int, embedding array<double>")
    assert [(r["id"], r["cosine"]) for r in E.compare_backends(a, b, "id").collect()] == [(2, 0.0)]
