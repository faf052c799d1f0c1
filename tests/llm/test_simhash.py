from __future__ import annotations

import random
import uuid

import pytest
import xxhash
from pyspark.sql import functions as F

from attestry import session
from attestry.llm import queries, simhash


def slow_fingerprint(text, width=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low:
        if c in " \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    words += [word] * bool(word)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_fingerprint_is_the_contract(spark):
    texts = ["", None, "One", "one  TWO", "a b c", "a b c d a b c", "Ä Ö ü É a\x1cb c d e f", "x " * 500 + "y z"]
    for t in texts:
        assert simhash.fingerprint(t) % (1 << 64) == slow_fingerprint(t)


def test_query_against_brute_force(spark, sf):
    got = {r["doc_id"]: r for r in queries.op8_simhash(spark, sf).collect()}
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    fps = [slow_fingerprint(t) for _, t in docs]
    roots = slow_components(fps)
    lowest = {}
    for (i, _), root in zip(docs, roots):
        lowest[root] = min(i, lowest.get(root, i))
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{fp:016x}", lowest[root]) for (i, _), fp, root in zip(docs, fps, roots)}


@pytest.mark.parametrize("cap", [0, 4, 10_000])
def test_links_connect_what_all_pairs_would(spark, cap):
    rng = random.Random(cap)
    fps = {rng.getrandbits(64) for _ in range(40)}
    center = rng.getrandbits(64)
    fps |= {center ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(120)} | {center, center ^ (1 << 63), 0, 3, 1 << 63}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.candidate_links(spark.createDataFrame([(f,) for f in signed], "fp long"), 2, cap)
    pairs = [(r["a"], r["b"]) for r in links.collect()]
    assert all(bin((a ^ b) % (1 << 64)).count("1") <= 2 for a, b in pairs)
    roots = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    slow = slow_components(fps)
    assert len({(roots.get(f, f), s) for f, s in zip(signed, slow)}) == len({roots.get(f, f) for f in signed}) == len(set(slow))


def test_odd_rows(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["component_id"] == by_id[2]["component_id"] == 1
    assert by_id[3]["fp"] == by_id[4]["fp"] == by_id[6]["fp"] == 0 and by_id[6]["component_id"] == 3
    assert by_id[None]["component_id"] is None
    assert simhash.near_duplicates(no_docs).count() == 0


def test_long_chain_settles(spark):
    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {(r["node"], r["root"]) for r in simhash.components(links).collect()} == {(i, 0) for i in range(1, 301)}


def test_components_take_no_round_more_than_needed(spark):
    def rounds(pairs):
        links = spark.createDataFrame(pairs, "a long, b long")
        since = session.written(spark)
        roots = {(r["node"], r["root"]) for r in simhash.components(links).collect()}
        return roots, session.written(spark) - since - 1  # the links themselves are written once

    star = [(0, i) for i in range(1, 50)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    assert rounds(star) == ({(i, 0) for i in range(1, 50)} | {(101, 100)}, 0)
    assert rounds([(5, 9), (3, 5), (3, 9)]) == ({(5, 3), (9, 3)}, 1)
    rng = random.Random(3)
    for _ in range(3):
        pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
        root = list(range(60))
        for a, b in pairs:
            root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
        assert rounds(pairs)[0] == {(i, r) for i, r in enumerate(root) if i != r}


def tasks_of(spark, run):
    """How many tasks ``run`` takes with 32 shuffle partitions that are never merged, and broadcasts only where they are asked for."""
    held = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    sc, group = spark.sparkContext, str(uuid.uuid4())
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        sc.setJobGroup(group, "counted")
        run()
        told = sc.statusTracker()
        stages = {s for job in told.getJobIdsForGroup(group) for s in told.getJobInfo(job).stageIds}
        return sum(info.numCompletedTasks for info in map(told.getStageInfo, stages) if info)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)


def test_few_nodes_meet_their_lowest_neighbour_without_a_shuffle(spark):
    rng = random.Random(4)
    links = session.saved(spark.createDataFrame([(rng.randrange(400), rng.randrange(400)) for _ in range(300)], "a long, b long"), "test-links")
    found = {}
    few, many = (tasks_of(spark, lambda n=n: found.update({n: sorted(map(tuple, simhash.components(links, broadcast_rows=n).collect()))})) for n in (100_000, 0))
    assert found[100_000] == found[0]
    assert few < many


def test_driver_heap_is_given_back_between_phases(spark, sf, monkeypatch):
    jvm, used = spark.sparkContext._jvm.java.lang.Runtime.getRuntime(), []

    def watched(session_):
        session.tidy(session_)
        used.append((jvm.totalMemory() - jvm.freeMemory()) >> 20)

    monkeypatch.setattr(simhash, "tidy", watched)
    assert simhash.near_copies(spark.read.parquet(f"{sf}/documents.parquet")).count() == 200
    assert len(used) >= 6 and max(used) < used[0] + 100
