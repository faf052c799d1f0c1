"""What grows with the input: shuffled rows, files, timers and tasks; and results on larger keys and ties."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import functions as F

from attestry.functions import similarity as S
from attestry.operators import enrichment as R
from attestry.operators import evidence as E
from attestry.operators import identity as I
from attestry.operators import matching as M
from attestry.operators.clustered import ClusteredRows
from attestry.operators.trigram_index import TrigramIndex
from attestry.plans import made_pages
from attestry.streaming import breakers


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_texts_lose_no_pair_and_shuffle_no_posting(spark):
    rng = random.Random(3)
    syllables = ["ka", "ri", "é", "ता", "𝒳y", "7", "to", "na", "a"]
    texts = sorted({" ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) + rng.choice(["", "-", ". "]) for _ in range(rng.randint(1, 5))) for _ in range(160)}) + ["", "...", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    a, b = df.select(F.col("t").alias("left_text")), df.select(F.col("t").alias("right_text"))
    want = a.crossJoin(b).withColumn("similarity", S.trigram_similarity(F.col("left_text"), F.col("right_text"))).filter("left_text IS NOT NULL AND right_text IS NOT NULL AND similarity > 0.4")
    pairs = M.similarity_join(df, df, "t", "t", 0.4, most_pairs=0, block_bytes=700)
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, want.collect())) and pairs.count() > 200
    assert "CoGroupsInArrow" in plan_of(pairs) and "explode(grams" not in plan_of(pairs)


class Kept:
    """States and timers of one key in memory, counting the calls that are read."""

    def __init__(self):
        self.read, self.timers = 0, set()

    def getValueState(self, name, schema):
        cell = {}
        return type("Value", (), {"exists": lambda s: "v" in cell, "get": lambda s: cell["v"], "update": lambda s, v: cell.update(v=v), "clear": lambda s: cell.clear()})()

    def getListState(self, name, schema):
        held, kept = [], self

        def get(s):
            kept.read += len(held)
            return iter(list(held))

        return type("List", (), {"appendList": lambda s, v: held.extend(v), "get": get, "clear": lambda s: held.clear(), "put": lambda s, v: held.extend(v)})()

    def getMapState(self, name, key, value):
        held, kept = {}, self

        def get(s, k):
            kept.read += len(held[k][0])
            return held[k]

        return type("Map", (), {"containsKey": lambda s, k: k in held, "getValue": get, "updateValue": lambda s, k, v: held.update({k: v}), "removeKey": lambda s, k: held.pop(k, None), "keys": lambda s: iter(list(held))})()

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


def test_a_breaker_reads_its_waiting_calls_a_few_times_only():
    class Watermark:
        def getCurrentWatermarkInMs(self):
            return self.at

    kept, now, told = Kept(), Watermark(), []
    breaker = breakers.Breaker(10**12)
    breaker.init(kept)
    calls = [(pd.Timestamp(i * 60_000, unit="ms"), i, 1.0, False) for i in range(2000)]
    for batch in range(4):
        some = calls[batch * 500 : batch * 500 + 500]
        list(breaker.handleInputRows(("k",), iter([pd.DataFrame(some, columns=["at", "id", "value", "failed"]).astype({"at": "datetime64[us]"})]), now))
        now.at = batch * 500 * 60_000
        for at in sorted(t for t in kept.timers if t <= now.at):
            kept.timers.discard(at)
            told += [r for out in breaker.handleExpiredTimer(("k",), now, None) for r in out["id"].tolist()]
    assert told == list(range(1501)) and kept.read < 3 * 2000


def test_the_first_of_rows_that_tie_is_told_by_more_columns(spark):
    left = spark.createDataFrame([("k",), ("none",)], "key string")
    right = spark.createDataFrame([("k", 1, n, f"v{n}") for n in (5, 3, 9)], "key string, rank int, row int, value string")
    got = R.first_match(left, right, "key", ["rank", "row"], ["value"])
    assert sorted(map(tuple, got.collect())) == [("k", "v3"), ("none", None)]


def test_kept_columns_of_a_new_key_are_those_of_the_row_that_wins(spark):
    schema = "k string, id long, name string"
    old, new = spark.createDataFrame([("a", 1, "old")], schema), spark.createDataFrame([("a", 7, "x"), ("b", 3, "first"), ("b", 9, "last")], schema)
    got = I.upsert(old, new, keys=["k"], keep=["id"], order="id")
    assert sorted(map(tuple, got.collect())) == [("a", 1, "x"), ("b", 9, "last")]


def test_a_mean_that_just_reaches_the_score_stops_the_tiers(spark):
    import itertools

    low = next(c for c in itertools.product(range(30, 100), repeat=3) if sum(c) == 195 and sum(x / 100 for x in c) / 3 < 0.65)
    rows = [("r", "api", "identity", "S", x / 100, 1.0) for x in low] + [("r", "live", "identity", "S", 1.0, 1.0)]
    got = E.stop_tiers(spark.createDataFrame(rows, "run_id string, tier string, kind string, source string, quality_score double, confidence double").coalesce(1), stop_score=0.65)
    assert [r["stopped_after"] for r in got.collect()] == ["api"] * 3


def test_pages_of_customers_are_made_by_all_cores(spark, sf):
    assert made_pages._pages(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_digests_and_vectors_are_computed_once(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "a"), (None, "x")], "x string, y string")
    got = df.select(S.cosine(S.hash_embedding(F.col("x"), 32), S.hash_embedding(F.col("y"), 32)).alias("c"))
    assert plan_of(got).count("sha2(") == 2 and round(got.collect()[1][0], 9) == 1.0


def test_clustered_rows_keep_to_a_number_of_files(spark, tmp_path):
    store = ClusteredRows(spark, f"file://{tmp_path}/many", ["id"])
    store.build(spark.range(1200), per_part=1)
    assert 100 < store._parts().count() <= 512
    assert [r["id"] for r in store.page(5, 100).collect()] == list(range(400, 500))


def test_a_kept_index_shuffles_postings_and_not_pairs(spark, tmp_path):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["alpha", "beta", "gam", "deltas", "é", "ता"]) for _ in range(rng.randint(0, 5))) for _ in range(80)]
    index = TrigramIndex(spark, f"file://{tmp_path}/index", buckets=4)
    index.refresh(spark.createDataFrame(list(enumerate(texts)), "id long, text string"))
    asked = spark.createDataFrame([("q1", "alpha beta"), ("q2", "ता é gam"), ("q3", ""), ("q4", "zzz")], "query_id string, query string")
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = asked.crossJoin(rows).select("query_id", "id", S.trigram_similarity(F.col("query"), F.col("text")).alias("similarity")).filter("similarity > 0.35")
    for block in (4_000_000, 10):
        pairs = index.similar(asked, block_postings=block)
        assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, want.collect())) and pairs.count() > 40
        assert "CoGroupsInArrow" in plan_of(pairs)
