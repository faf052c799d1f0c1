from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline
from attestry import session
from attestry.llm import simhash


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, rows = docs.count(), docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, sf)
        assert rows.columns == docs.columns, name
        after = rows.count()
        assert 0 < after <= before, name
        before = after
    tables = session.written(spark)
    packed = corpus_pipeline.run(spark, sf).collect()
    assert len({r["doc_id"] for r in packed}) == before
    assert session.written(spark) == tables + 1  # what the stages wrote on their way is deleted


def test_odd_rows_pass_every_stage(spark, odd_docs, no_docs, clashes, sf):
    labels = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert labels
    for start in (odd_docs, no_docs):
        rows = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, sf)
            assert rows.columns == start.columns, name
            assert all(r[c] in (None, f"own {c}") for r in rows.collect() for c in clashes), name
        corpus_pipeline.pack_sequences(spark, start, sf).count()


def test_long_texts_pass_every_stage(spark, long_docs, sf):
    rows = long_docs
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        rows = stage(spark, rows, sf)
    assert rows.count() > 0
    lengths = {r["doc_id"]: r["n"] for r in corpus_pipeline.pack_sequences(spark, long_docs, sf).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert lengths.keys() == set(range(5)) and lengths[0] > 1_000_000


def test_one_row_stays_of_each_group_and_no_other_goes(spark, sf):
    t = {c: " ".join(f"{c}{i}" for i in range(6)) for c in "abcdefgh"}
    apart = [(1, t["a"], "x"), (1, t["b"], "x"), (2, t["c"], "x")]  # one id with unlike texts
    crossed = [(5, t["d"], "x"), (3, t["d"], "x"), (5, t["e"], "x")]  # an id that goes with one text and stays with another
    without = [(None, t["f"], "x"), (6, t["f"], "x"), (None, t["g"], None), (None, t["g"], None)]
    repeated = [(4, t["h"], "z"), (4, t["h"], "y"), (4, t["h"], "y")]
    keep = lambda rows: sorted(map(tuple, corpus_pipeline.keep_one_copy(spark, spark.createDataFrame(rows, "doc_id long, text string, spare string"), sf).collect()), key=str)
    kept = keep([*apart, *crossed, *without, *repeated])
    assert [r[:2] for r in kept] == sorted([(1, t["a"]), (1, t["b"]), (2, t["c"]), (3, t["d"]), (5, t["e"]), (6, t["f"]), (None, t["g"]), (4, t["h"])], key=str)
    assert [r for r in kept if r[0] == 4] == keep(repeated[::-1])  # whatever the order of the rows


def test_near_copies_go_by_five_words(spark, sf):
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]

    def changed(words, places):
        return [f"new{rng.random()}" if i in places else w for i, w in enumerate(words)]

    texts = [base] + [changed(base, {40 * k + 20 for k in range(m)}) for m in (1, 3, 5)]  # similarities from 0.97 to 0.84
    texts += [changed(base, {20 * k + 10 for k in range(14)}), [f"v{rng.randrange(5000)}" for _ in range(300)]]  # 0.6 and none
    texts += [base[:260], base[:40]]  # 0.87 and 0.12
    texts += [base[:4], base[:4]]  # too short for a shingle
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s1", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.keep_one_copy(spark, docs, sf).collect()}
    assert kept == {0, 4, 5, 7, 8}


def test_near_copies_against_all_pairs(spark):
    rng = random.Random(7)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(20, 200))]
        for _ in range(6):
            texts.append(" ".join(words))
            words = [f"w{rng.randrange(3000)}" if rng.random() < 0.02 else w for w in words]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["root"] for r in simhash.near_copies(docs).collect()}
    assert len({(got[i], r) for i, r in enumerate(root)}) == len(set(got.values())) == len(set(root)) < len(texts)


def test_mixture_stage_meets_its_weights(spark, sf):
    rows, text = [], "one two three four five six seven eight nine ten"
    for lang, count in (("en", 700), ("de", 100), ("fr", 100), ("es", 100)):
        for source, n in (("s1", count), ("s12", 2 * count)):
            rows += [(len(rows) + i, text, lang, source, len(text)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.keep_mixture(spark, docs, sf).collect()
    share = lambda col, value: sum(r[col] == value for r in kept) / len(kept)
    assert abs(len(kept) - len(rows) / 2) <= 8
    assert abs(share("source", "s1") - 0.6) < 0.01 and abs(share("source", "s12") - 0.4) < 0.01
    for lang, target in (("en", 0.55), ("de", 0.15)):
        # web holds 100 of the 135 documents that a language of 0.15 is due; what is short goes to its siblings
        curated = [r for r in kept if r["source"] == "s12"]
        assert abs(sum(r["lang"] == lang for r in curated) / len(curated) - target) < 0.01
