from __future__ import annotations

import random
import statistics

import __spark_entry__
from pyspark.sql import functions as F

from attestry.operators import matching as M
from attestry.operators import running
from attestry.operators import scoring as P
from attestry.plans import catalogue, validate
from attestry.streaming import events as V


def run(query, name):
    q = query.format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()


def test_stream_rollup_is_the_batch_rollup(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.mode("overwrite").parquet(f"file://{tmp_path}/in/e")
    make = lambda df: V.tumbling_rollup(df, "ts", ["event_type"], {"n": F.count(F.lit(1)), "v": F.round(F.sum("value"), 4)}, late="40 days")
    stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in/e")
    run(make(stream).writeStream.outputMode("complete"), "rollup")
    assert sorted(map(tuple, spark.table("rollup").collect())) == sorted(map(tuple, make(spark.read.parquet(f"{sf}/events.parquet")).collect()))


def test_load_and_excess(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "u1", None]), rng.randrange(3000), i) for i in range(400)]
    df = spark.createDataFrame(rows, "user string, s long, i long").withColumn("at", F.timestamp_seconds("s"))
    got = {r["i"]: r["offered"] for r in V.offered_load(df, "user", "at", 60).collect()}
    assert got == {i: sum(u == v and s - 60 < t <= s for v, t, _ in rows) for u, s, i in rows}
    excess = {(r["user"], r["hour"].timestamp()): (r["offered"], r["excess"]) for r in V.over_limit(df, "user", "at", 600, 5).collect()}
    for u, s, _ in rows:
        n = sum(u == v and t // 600 == s // 600 for v, t, _ in rows)
        assert excess[u, s // 600 * 600] == (n, max(0, n - 5))


def test_failure_runs(spark):
    rows = [("a", i, f) for i, f in enumerate([1, 1, 0, 1, 0, 1, 1, 1])] + [("b", 9, 1), ("c", 1, 0), ("d", 1, None)]
    df = spark.createDataFrame(rows, "k string, i long, f int")
    got = V.failure_runs(df, "k", ["i"], F.col("f") == 1).collect()
    assert sorted((r["k"], r["failures"], r["first"], r["last"]) for r in got) == [("a", 2, 0, 1), ("a", 3, 5, 7)]


def test_running_by_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "x", None]), i, rng.choice([None, 1, 2, 5]), rng.choice([None, None, f"v{i}"])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i long, n int, v string")
    got = {r["i"]: (r["s"], r["c"]) for r in running.running(df, ["k"], [F.col("i")], {"s": F.col("n"), "c": F.lit(1)}, per_range=40).collect()}
    filled = {r["i"]: r["v"] for r in running.carried(df, ["k"], "i", ["v"], per_range=40).collect()}
    for k, i, _, _ in rows:
        before = [r for r in rows if r[0] == k and r[1] < i]
        assert got[i] == (sum(r[2] or 0 for r in before), len(before))
        assert filled[i] == next((r[3] for r in reversed(rows[: i + 1]) if r[0] == k and r[3]), None)
    q = running.quantiles(df, [], "n", {"mid": 0.5}, {"top": 0.99}, per_range=1).first()
    known = sorted(r[2] for r in rows if r[2])
    assert (q["mid"], q["top"], q["n"]) == (statistics.median(known), known[int(len(known) * 0.99)], len(known))
    assert running.running(df.limit(0), ["k"], [F.col("i")], {"s": F.col("n")}).count() == 0


def test_typed_events(spark):
    rows = [("batch/created", '{"batchId": 1, "institutionCount": 5}'), ("batch/created", '{"batchId": 1}'), ("batch/created", "broken"), ("other", "{}")]
    got = V.typed(spark.createDataFrame(rows, "name string, data string"), "batch/created").select("valid").collect()
    assert sorted(r["valid"] for r in got) == [False, False, True]


def test_idempotent_stream(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, s long").select("k", F.timestamp_seconds("s").alias("ts")).write.parquet(f"file://{tmp_path}/in")
    run(V.idempotent(spark.readStream.schema("k string, ts timestamp").parquet(f"file://{tmp_path}/in"), ["k"], "ts").writeStream, "once")
    assert spark.table("once").count() == 2


def test_resolution_finds_misspelt_names(spark):
    names = ["Indian Institute of Technology Delhi", "Anna University", "University of Delhi", "Jadavpur University", "Goa Medical College"]
    pool = spark.createDataFrame([("institution", i, n, n, None, None) for i, n in enumerate(names)], "type string, id long, name string, match_text string, source string, external_id string")
    asked = ["IIT Delhi", "Dr. Anna Universty", "DU", "Jadavpur Univ", "goa medical colege"]
    found = {r["input"]: r["name"] for r in M.resolve(spark.createDataFrame([(a,) for a in asked], "input string"), pool, threshold=0.3).filter("rank = 1").collect()}
    assert found == dict(zip(asked, names))
    manual = spark.createDataFrame([("MANUAL", "DU", 7, "Deccan Union")], "source string, external_id string, institution_id long, name_as_source string")
    hit = M.resolve(spark.createDataFrame([("DU",)], "input string"), pool, manual).collect()
    assert [(r["id"], r["confidence"], r["method"]) for r in hit] == [(7, 1.0, "identity")]


def test_prefix_of_similarity_join_is_exact(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abc", k=rng.randrange(1, 6))) for _ in range(80)]
    df = spark.createDataFrame([(w,) for w in words], "w string")

    def grams(s):
        return {f"  {s} "[i : i + 3] for i in range(len(s) + 1)}

    want = {(a, b) for a in set(words) for b in set(words) if len(grams(a) & grams(b)) / len(grams(a) | grams(b)) > 0.35}
    assert {(r[0], r[1]) for r in M.similarity_join(df, df, "w", "w").collect()} == want


def test_flagship(spark, sf):
    rows = catalogue.flagship(spark, sf).collect()
    assert len(rows) > 0 and {r["verdict"] for r in rows} <= {"Genuine", "Likely Genuine", "Likely Fake", "Fake", "Insufficient Evidence"}
    listed = [r for r in rows if r["terminal_rule"] == "UGC_FAKE"]
    assert listed and all(r["verdict"] == "Fake" and r["score"] == 0 for r in listed)


def test_fast_path(spark):
    as_of = F.to_timestamp(F.lit("2024-02-01"))
    asked = spark.createDataFrame([("A  b",), ("c",), ("d",), ("e",)], "input string")
    cached = spark.createDataFrame([("a b", "Genuine")], "normalized_name string, verdict string")
    inst = spark.createDataFrame([(1, "c", "Fake", "2024-01-30"), (2, "d", "Fake", "2023-01-01")], "id long, normalized_name string, verdict string, d string").select("id", "normalized_name", "verdict", F.to_timestamp("d").alias("last_validated_at"), F.lit(None).cast("timestamp").alias("deleted_at"))
    entries = spark.createDataFrame([("d", "UGC_FAKE"), ("c", "UGC")], "normalized_name string, authority_code string")
    got = {r["normalized_name"]: (r["level"], r["verdict"]) for r in validate.fast_path(asked, cached, inst, entries, as_of).collect()}
    assert got == {"a b": ("L0", "Genuine"), "c": ("L1", "Fake"), "d": ("L1.5", "Fake")}


def test_verdict_words(spark):
    got = spark.createDataFrame([("Genuine",), ("Fake",)], "v string").coalesce(1).select(P.verdict_color(F.col("v")), P.is_positive(F.col("v")), P.is_negative(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [("green", True, False), ("red", False, True)]


def test_entry_contract(spark):
    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
