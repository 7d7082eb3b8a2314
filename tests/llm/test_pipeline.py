from collections import defaultdict

import __spark_entry__ as entry
import corpus_pipeline
import test_mixing as mixed
import test_near_dedup as near
from made_texts import mutate, prose
from nearframe.llm import exact_dedup
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF).cache()
        assert kept.columns == columns
        assert kept.exceptAll(before).count() == 0, name
        if name == "quality classifier":
            good = before.join(labels.where("quality = 1"), "doc_id", "left_semi")
            bad = before.join(labels.where("quality = 0"), "doc_id", "left_semi")
            assert good.join(kept, "doc_id", "left_anti").count() <= 0.02 * good.count()
            assert bad.join(kept, "doc_id", "left_semi").count() <= 0.1 * bad.count()
        if name == "exact dedup":
            assert kept.count() == before.select(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                                                             "abcdefghijklmnopqrstuvwxyz")).distinct().count()
    mixed = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert 0 < mixed.count() <= kept.count() and mixed.where("copies > 3").count() == 0


def test_queries_are_registered():
    names = set(entry.queries())
    for n in range(1, 14):
        assert any(name.startswith(f"op{n}_") for name in names)
    assert "pipeline" in names and exact_dedup
    assert set(entry.oracle_sql()) <= names


def test_run_equals_brute_force(spark, tmp_path):
    """All rows of run() on planted copies, near copies and benchmark passages, given the classifier's decisions."""
    good = [prose(i, 60 + i) for i in range(40)]
    rows = list(enumerate(good)) + [(100 + i, " ".join(f"${j * i % 97} !!" for j in range(40))) for i in range(40)]
    rows += [(200 + i, t.upper()) for i, t in enumerate(good[:5])] + [(300 + i, mutate(good[6], i, 1)) for i in range(6)]
    passage = prose(999, 25)
    rows += [(400 + i, f"{prose(700 + i, 50)} {passage} {prose(800 + i, 30)}") for i in range(4)]
    names = ["web", "books", "code", None]
    source = {i: names[i % 4] for i, _ in rows}
    for name, made, schema in (
            ("documents", [(i, t, "en", source[i], len(t)) for i, t in rows],
             "doc_id long, text string, lang string, source string, n_chars long"),
            ("labels", [(i, int(not 100 <= i < 200), 0) for i, _ in rows], "doc_id long, quality int, toxic int"),
            ("benchmark", [(1, passage), (2, prose(5000, 20)), (3, good[30][:80])], "item_id long, text string")):
        spark.createDataFrame(made, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_low_quality(spark, docs, str(tmp_path)).collect()]
    assert {i for i, _ in rows if i < 100 or i >= 200} & {i for i, _ in kept}

    def runs(text):
        return near.shingles(text, 5)

    exact = {}
    for i, t in kept:
        exact[t.lower()] = max(exact.get(t.lower(), (-1, "")), (i, t))
    single = sorted(exact.values())
    component = {i: least for i, _, least in near.brute(single, 5, 80)[0]}
    apart = [(i, t) for i, t in single if component[i] == i]
    items = [runs(t) for t in (passage, prose(5000, 20), good[30][:80])]
    clean = [(i, t) for i, t in apart if not any(len(s & runs(t)) >= 0.8 * len(s) - 1e-9 for s in items)]
    assert len(kept) > len(single) > len(apart) > len(clean) > 20

    sizes = defaultdict(int)
    for i, t in clean:
        sizes[source[i]] += mixed.words(t)
    want = []
    for name, target in mixed.targets(sizes).items():
        own = [(i, t) for i, t in clean if source[i] == name]
        whole, p = divmod(min(target / sizes[name], 3), 1)
        running, left = 0, target - whole * sizes[name]
        for i, t in sorted(own, key=lambda r: mixed.u(r[0])):
            size = mixed.words(t)
            copies = int(whole) + (p > 0 and 2 * running + size <= 2 * left)
            running += size
            if copies:
                want.append((i, t, source[i], copies))
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "text", "source", "copies").collect()
    assert sorted(map(tuple, got)) == sorted(want, key=lambda r: r[0])


def test_stages_on_odd_rows_and_empty_tables(spark, tmp_path):
    """Null ids, texts and sources, empty texts, repeated rows, a further column; then no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, copies int"
    rows = [(None, None, None, None, None, 1), (None, prose(1, 30), "en", "a", 1, 1), (3, "", "en", None, 0, 2),
            (4, prose(1, 30).upper(), None, "a", 1, 1), (4, prose(1, 30).upper(), None, "a", 1, 1), (5, " \n ", "en", "a", 3, 1),
            (6, prose(2, 4000), "en", "b", 9, 1)]
    labels = [(3, 1, 0), (4, 1, None), (None, 0, 0), (77, 0, 1), (6, None, None)]
    for name, some in (("odd", True), ("none", False)):
        folder = f"{tmp_path}/{name}"
        for table, made, columns in (("documents", rows, schema), ("labels", labels, "doc_id long, quality int, toxic int"),
                                     ("benchmark", [(1, None), (2, ""), (None, prose(9, 20))], "item_id long, text string")):
            spark.createDataFrame(made if some else [], columns).write.parquet(f"{folder}/{table}.parquet")
        kept = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, function in corpus_pipeline.STAGES[:-1]:
            kept = function(spark, kept, folder)
            assert kept.columns == [c.split()[0] for c in schema.split(", ")], stage
        # One null or empty text, one white text that differs from it, the larger id of the copies, the long text.
        left = sorted((r.doc_id or -1, r.text or "") for r in kept.collect())
        assert [i for i, _ in left] == ([3, 4, 5, 6] if some else [])
        mixed = corpus_pipeline.run(spark, folder)
        assert mixed.columns[:6] == kept.columns and mixed.count() <= len(left)
