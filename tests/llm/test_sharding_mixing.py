from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from attestry.llm import mixing, queries, sharding


def test_shards_match_the_mixture(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    rows = sharding.interleave_shards(docs, shards=8, per_bucket=50).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == 1000 and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    for source, total in Counter(r["source"] for r in rows).items():
        by_shard = Counter(r["shard"] for r in rows if r["source"] == source)
        assert all(abs(by_shard[s] - total / 8) <= 2 for s in range(8))


def test_buckets_do_not_change_the_shards(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 4).cast("string").alias("source"))
    pick = lambda n: sorted(map(tuple, sharding.interleave_shards(docs, per_bucket=n).collect()))
    assert pick(10) == pick(10_000)


def test_shard_query(spark, sf):
    rows = queries.op6_interleave_shards(spark, sf).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and {r["law"] for r in rows} == {"rows"}


def test_odd_shards(odd_docs, no_docs):
    rows = sharding.interleave_shards(odd_docs, shards=4, tie_cols=("text",)).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == odd_docs.count() and max(sizes.values()) - min(sizes.values()) <= 1
    assert sharding.interleave_shards(no_docs).count() == 0


def leaves(spark, rows):
    return spark.createDataFrame(rows, "d string, s string, capacity double, wd double, ws double")


def budget(spark, rows, total):
    out = mixing.budgets(leaves(spark, rows), ["d", "s"], total, ["wd", "ws"])
    return {(r["d"], r["s"]): round(r["budget"], 6) for r in out.collect()}


def test_shortage_goes_to_siblings_before_ancestors(spark):
    rows = [("x", "a", 10.0, 0.5, 1.0), ("x", "b", 1000.0, 0.5, 1.0), ("y", "c", 1000.0, 0.5, 1.0)]
    assert budget(spark, rows, 200.0) == {("x", "a"): 10, ("x", "b"): 90, ("y", "c"): 100}
    rows = [("x", "a", 10.0, 0.5, 1.0), ("x", "b", 20.0, 0.5, 1.0), ("y", "c", 1000.0, 0.5, 1.0)]
    assert budget(spark, rows, 200.0) == {("x", "a"): 10, ("x", "b"): 20, ("y", "c"): 170}
    assert budget(spark, rows, 5000.0) == {("x", "a"): 10, ("x", "b"): 20, ("y", "c"): 1000}
    rows = [("x", "a", 10.0, 0.0, 1.0), ("y", "c", 50.0, 1.0, 1.0), ("y", "e", 50.0, 1.0, 0.0)]
    assert budget(spark, rows, 80.0) == {("x", "a"): 0, ("y", "c"): 50, ("y", "e"): 0}


def test_prefix_and_epochs(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 20, "small").otherwise("big").alias("source"), F.lit("one two three four").alias("text"))
    take = lambda total, epochs: mixing.mix(docs, {"source": F.col("source")}, [F.lit(1.0)], F.lit(4), total=total, max_epochs=epochs, per_bucket=16)
    rows = take(400.0, 3).collect()
    count = Counter(r["source"] for r in rows)
    assert count == {"small": 50, "big": 50}  # two whole epochs and ten rows of a third
    assert Counter(r["epoch"] for r in rows if r["source"] == "small") == {0: 20, 1: 20, 2: 10}
    assert max(Counter((r["doc_id"], r["epoch"]) for r in rows).values()) == 1
    assert sorted(map(tuple, rows)) == sorted(map(tuple, take(400.0, 3).collect()))
    assert Counter(r["source"] for r in take(400.0, 1).collect()) == {"small": 20, "big": 80}


def test_odd_mixture(odd_docs, no_docs):
    rows = queries.mixture(odd_docs).collect()
    assert 0 < len(rows) <= odd_docs.count()
    assert queries.mixture(no_docs).count() == 0


def slow_budgets(tree, total):
    """Water-filling by halving: ``tree`` is {name: (weight, capacity or subtree)}; leaves' budgets by path."""

    def take(weight, held):
        return 0.0 if weight <= 0 else held if not isinstance(held, dict) else sum(take(w, h) for w, h in held.values())

    def fill(children, total, path, out):
        caps = {k: take(w, h) for k, (w, h) in children.items()}
        low, high = 0.0, 1e9
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(caps[k], max(w, 0) * mid) for k, (w, _) in children.items()) < total else (low, mid)
        for k, (w, held) in children.items():
            own = min(caps[k], max(w, 0) * high)
            if isinstance(held, dict):
                fill(held, own, (*path, k), out)
            else:
                out[(*path, k)] = own
        return out

    return fill(tree, total, (), {})


def test_budgets_against_water_filling(spark):
    rng = random.Random(4)
    for trial in range(6):
        tree = {f"d{i}": (rng.choice([0.0, 1.0, 2.5]), {f"s{j}": (rng.choice([0.0, 0.0, 1.0, 3.0]), float(rng.randrange(1, 200))) for j in range(rng.randrange(1, 5))}) for i in range(4)}
        rows = [(d, s, float(c), wd, ws) for d, (wd, held) in tree.items() for s, (ws, c) in held.items()]
        total = float(rng.randrange(1, 900))
        got, want = budget(spark, rows, total), slow_budgets(tree, total)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in want), trial


def test_budget_that_a_weightless_child_cannot_take(spark):
    rows = [("x", "a", 100.0, 1.0, 0.0), ("x", "b", 10.0, 1.0, 1.0), ("y", "c", 1000.0, 1.0, 1.0)]
    assert budget(spark, rows, 100.0) == {("x", "a"): 0, ("x", "b"): 10, ("y", "c"): 90}


def test_clashing_names_are_kept(spark):
    names = "doc_id long, text string, lang string, source string, n_chars long, epoch string, shard string, slot string, _row int, _key int, c0 int, _sum int, C1 int"
    docs = spark.createDataFrame([(i, "a b c", "en", "s1", 5, "e", "sh", "sl", i, i, i, i, i) for i in range(40)], names)
    rows = queries.mixture(docs, share=0.5).collect()
    assert len(rows) == 20 and all(r["shard"] == "sh" and r["_row"] == r["c0"] == r["C1"] == r["doc_id"] and r["epoch"] == 0 for r in rows)
    rows = sharding.interleave_shards(docs, shards=4).collect()
    assert len(rows) == 40 and all(r["epoch"] == "e" and r["_key"] == r["_sum"] == r["doc_id"] and r["shard"] in range(4) for r in rows)
