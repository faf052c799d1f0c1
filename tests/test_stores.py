from __future__ import annotations

import json
import random
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from attestry.operators import analytics as A
from attestry.operators import matching as M
from attestry.operators.backfill import DoneKeys
from attestry.operators.clustered import ClusteredRows
from attestry.operators.trigram_index import TrigramIndex
from attestry.sources import connectors, html_tables, paged
from attestry.streaming import breakers
from attestry.streaming.latest import LatestTable, write_latest


@pytest.fixture(scope="module")
def service():
    """An interface that answers by state and page; one state fails twice and then answers, one always fails, one is no array."""
    tries = {}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            state = parse_qs(urlparse(self.path).query)["state"][0]
            tries[state] = tries.get(state, 0) + 1
            if state == "Broken" or state == "Shaky" and tries[state] < 3:
                self.send_error(503)
                return
            rows = {"rows": []} if state == "Odd" else [[f"{state}-{i}", f"College {i}", "Road", "District", "Govt", "N", "N", 7] for i in range(3)] + [["short"]]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(rows).encode())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/", tries
    server.shutdown()


def test_pages_are_partitions_and_failures_are_told(spark, service):
    base, tries = service
    pages = [{"state": s, "page": 0, "url": f"{base}?state={s}"} for s in ("Goa", "Kerala", "Shaky", "Broken", "Odd")]
    rows = paged.read_pages(spark, pages, pause=0.01)
    assert rows.rdd.getNumPartitions() == 5
    got = rows.collect()
    assert sorted((r["state"], r["error"].split(":")[0]) for r in got if r["error"]) == [("Broken", "HTTPError"), ("Odd", "ValueError")]
    assert tries["Shaky"] == 3 and sum(r["state"] == "Shaky" for r in got) == 4
    assert next(r["cells"] for r in got if r["state"] == "Goa" and r["row"] == 0) == ["Goa-0", "College 0", "Road", "District", "Govt", "N", "N", "7"]
    tries.clear()
    few = rows.filter("state = 'Goa' AND row >= 1")
    assert few.rdd.getNumPartitions() == 1 and few.count() == 3 and set(tries) == {"Goa"}
    assert rows.filter(F.col("state").isin("Goa", "Kerala")).rdd.getNumPartitions() == 2
    drafts = connectors.aicte_drafts(rows).collect()
    assert len(drafts) == 9 and {d["external_id"] for d in drafts if d["state"] == "Goa"} == {"Goa-0", "Goa-1", "Goa-2"}
    assert paged.failed_pages(rows).count() == 2 and paged.read_pages(spark, []).count() == 0


TABLES = {
    "spans": ("<table><tr><th rowspan=2>a<th colspan=2>b<tr><td>c<td>d</table>", [(0, None, [["a", "b", "b"], ["a", "c", "d"]])]),
    "rest of the group": ("<table><tbody><tr><td rowspan=0>x<td>1<tr><td>2<tbody><tr><td>3</table>", [(0, None, [["x", "1"], ["x", "2"], ["3"]])]),
    "crossing": ("<table><tr><td>1<td rowspan=3>2<td>3<tr><td colspan=1>4<td>5<tr><td>6</table>", [(0, None, [["1", "2", "3"], ["4", "2", "5"], ["6", "2"]])]),
    "beyond the table": ("<table><tr><td rowspan=99999999999>1<td colspan=bad>2</table>", [(0, None, [["1", "2"]])]),
    "nested": ("<table><tr><td>out<table><tr><td>in</table>side<td>b</table>", [(1, "0:0", [["in"]]), (0, None, [["outside", "b"]])]),
    "not closed": ("<TABLE><TR><TD>a &amp; b&nbsp;c<!-- <td>no --><script>if (a<td) x</script><TD>d<br>e", [(0, None, [["a & b c", "d e"]])]),
    "none": ("<p>no table</p><td>x</td>", []),
    "empty": ("<table></table><table><tr></table>", [(1, None, [[]])]),
}


def test_tables_with_spans(spark):
    pages = spark.createDataFrame([(k, html) for k, (html, _) in TABLES.items()] + [("null", None)], "name string, html string")
    found = {}
    for r in html_tables.expand_tables(pages).orderBy("name", "table_no", "row").collect():
        found.setdefault(r["name"], {}).setdefault((r["table_no"], r["parent"]), []).append(r["cells"])
    assert found == {k: {(n, p): rows for n, p, rows in want} for k, (_, want) in TABLES.items() if want}


def test_repeated_cells_and_links_are_told(spark):
    html = "<table><tr><td rowspan=2 colspan=2><a href='/x'>a</a><td>b<tr><th>c <a href=\"/y\">y</a></table>"
    rows = html_tables.expand_tables(spark.createDataFrame([(html,)], "html string")).orderBy("row").collect()
    assert [(r["cells"], r["spanned"], r["links"], r["header"]) for r in rows] == [(["a", "a", "b"], [False, True, False], ["/x"], False), (["a", "a", "c y"], [True, True, False], ["/y"], True)]


def test_a_wide_table_in_proportion(spark):
    html = "<table>" + "<tr><td rowspan=2>x<td colspan=3>y" * 20_000 + "</table>"
    assert html_tables.expand_tables(spark.createDataFrame([(html,)], "html string")).count() == 20_000


def plain(spark, rows, queries, threshold=0.35):
    left, right = spark.createDataFrame(queries, "query_id long, query string"), spark.createDataFrame(rows, "id long, text string")
    pairs = M.similarity_join(left, right, "query", "text", threshold)
    met = left.join(pairs, left["query"] == pairs["left_text"]).join(right, right["text"] == pairs["right_text"])
    return sorted((r["query_id"], r["id"], round(r["similarity"], 9)) for r in met.collect())


def test_a_kept_index_is_the_direct_join(spark, tmp_path):
    rng = random.Random(3)
    name = lambda: " ".join(rng.choice(["anna", "delhi", "college", "of", "arts", "science", "new", "ünï"]) for _ in range(rng.randint(1, 4)))
    index = TrigramIndex(spark, f"file://{tmp_path}/index", buckets=4)
    queries = [(i, name()) for i in range(8)] + [(99, "")]
    asked = spark.createDataFrame(queries, "query_id long, query string")
    assert index.similar(asked).count() == 0
    state = {i: name() for i in range(60)}
    told = []
    for step in range(4):
        if step:
            for i in rng.sample(sorted(state), 10):
                del state[i]
            state.update({i: name() for i in rng.sample(range(90), 12)})
        told.append(index.refresh(spark.createDataFrame(sorted(state.items()), "id long, text string")))
        got = sorted((r["query_id"], r["id"], round(r["similarity"], 9)) for r in index.similar(asked).collect())
        assert got == plain(spark, sorted(state.items()), queries)
    assert told[0] == {"added": 60, "removed": 0, "changed": 0} and len(index.generations()) == 4
    assert index.refresh(spark.createDataFrame(sorted(state.items()), "id long, text string")) == {"added": 0, "removed": 0, "changed": 0} and len(index.generations()) == 4
    patterns = spark.createDataFrame([(p, p) for p in ("LHI c", "ne", "nna", "ÜNÏ", "zzz", "%")], "pattern_id string, pattern string")
    want = sorted((p, i) for p in ("LHI c", "ne", "nna", "ÜNÏ", "zzz", "%") for i, t in state.items() if p.lower() in t)
    assert sorted(map(tuple, index.containing(patterns).collect())) == want
    index.compact()
    assert len(index.generations()) == 1 and sorted(map(tuple, index.containing(patterns).collect())) == want


def test_a_search_reads_the_buckets_of_its_trigrams(spark, tmp_path):
    index = TrigramIndex(spark, f"file://{tmp_path}/index", buckets=64)
    index.refresh(spark.range(300).select("id", F.concat(F.lit("name "), "id").alias("text")))
    plan = index._postings(spark.createDataFrame([("nam",), ("ame",)], "gram string"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket#") or "PartitionFilters: [isnotnull" in plan or "bucket#" in plan.split("PartitionFilters:")[1][:200]


def test_both_ways_of_the_similarity_join(spark):
    rng = random.Random(4)
    texts = [(" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(4)) for _ in range(4)),) for _ in range(80)]
    df = spark.createDataFrame(texts, "t string")
    pick = lambda **how: sorted((r["left_text"], r["right_text"], round(r["similarity"], 9)) for r in M.similarity_join(df, df, "t", "t", 0.5, **how).collect())
    counted = pick()
    assert counted == pick(most_met=0) == pick(most_met=0, broadcast_grams=0) == pick(broadcast_bytes=0) and len(counted) > 80


def test_latest_table_and_replays(spark, tmp_path):
    table = LatestTable(spark, f"file://{tmp_path}/latest", buckets=4)
    make = lambda rows: spark.createDataFrame(rows, "run_id string, seq long, step string")
    read = lambda: sorted(map(tuple, table.read().select("run_id", "seq", "step").collect()))
    assert table.read() is None
    table.merge(make([("a", 1, "x"), ("b", 5, "y"), ("a", 2, "z")]), 0)
    table.merge(make([]), 1)
    table.merge(make([("a", 2, "later"), ("b", 4, "old"), ("c", None, "n")]), 2)
    want = [("a", 2, "later"), ("b", 5, "y"), ("c", None, "n")]
    assert read() == want
    table.merge(make([("a", 9, "replayed")]), 2)
    table.merge(make([("a", 9, "replayed")]), 0)
    assert read() == want
    table.sweep()
    assert read() == want
    # a batch that was lost after it had written its files, before it was logged
    lost = make([("a", 50, "lost"), ("d", 50, "lost")]).withColumn("_batch", F.lit(3).cast("long")).withColumn("bucket", table._bucket()).withColumn("version", F.lit(3).cast("long"))
    lost.write.mode("append").partitionBy("version", "bucket").parquet(f"file://{tmp_path}/latest/runs")
    assert read() == want
    table.merge(make([("a", 3, "three")]), 3)
    assert read() == [("a", 3, "three"), *want[1:]]


def test_latest_table_from_a_stream(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"r{rng.randrange(6)}", i, f"s{i}") for i in range(60)]
    rng.shuffle(rows)
    for part in range(3):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], "run_id string, seq long, step string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("run_id string, seq long, step string").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    write_latest(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/cp", buckets=2).trigger(availableNow=True).start().awaitTermination()
    last = {}
    for r in sorted(rows, key=lambda r: r[1]):
        last[r[0]] = r
    assert sorted(map(tuple, LatestTable(spark, f"file://{tmp_path}/out", buckets=2).read().collect())) == sorted(last.values())


CALLS = "key string, at timestamp, id long, value double, failed boolean"


def slow_states(calls, idle):
    """State after every call, folded in the order of their time."""
    out, state = {}, {}
    for key, at, number, value, failed in sorted(calls, key=lambda c: (c[1], c[2])):
        s = state.get(key)
        if s is None or (at - s[3]).total_seconds() > idle:
            s = (None, 0, 0, at)
        state[key] = s = (value if s[0] is None else (s[0] + value) / 2, s[1] + 1, s[2] + 1 if failed else 0, at)
        out[key, number] = s[:3]
    return out


def breaker_calls(seed, n=120):
    import datetime as dt

    rng, at, calls = random.Random(seed), dt.datetime(2024, 1, 1), []
    for i in range(n):
        at += dt.timedelta(seconds=rng.choice([0, 5, 60, 200, 4000]))
        calls.append((rng.choice(["a", "a", "b", "c"]), at, i, float(rng.randrange(100)), rng.random() < 0.5))
    return calls


@pytest.mark.parametrize("seed", range(2))
def test_breaker_stream_is_the_batch_and_late_calls_take_their_place(spark, tmp_path, seed):
    import datetime as dt

    calls = breaker_calls(seed)
    want = slow_states(calls, 3600)
    last = {}
    for (key, number), s in sorted(want.items(), key=lambda x: (calls[x[0][1]][1], x[0][1])):
        last[key] = (number, *s)
    batch = breakers.breaker_states(spark.createDataFrame(calls, CALLS), 3600, per_range=25)
    got = {r["key"]: (r["id"], r["blended"], r["calls"], r["failures"]) for r in batch.collect()}
    assert got.keys() == last.keys() and all(got[k] == pytest.approx(last[k]) for k in got)
    swapped = [c for i in range(0, len(calls), 8) for c in reversed(calls[i : i + 8])]  # late by up to eight calls
    parts = [swapped[:50], swapped[50:90], swapped[90:], [(k, calls[-1][1] + dt.timedelta(days=9), -1, 0.0, False) for k in "abc"]]
    for part in parts:
        spark.createDataFrame(part, CALLS).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(CALLS).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    told = breakers.breaker_stream(stream, "12 hours", 3600)
    told.writeStream.outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).format("parquet").start(f"file://{tmp_path}/out").awaitTermination()
    rows = spark.read.schema(told.schema).parquet(f"file://{tmp_path}/out").filter("id >= 0").collect()
    assert len(rows) == len(calls)
    assert all((r["blended"], r["calls"], r["failures"]) == pytest.approx(want[r["key"], r["id"]]) for r in rows)


def test_merged_sketches_stay_within_their_bound(spark):
    rng = random.Random(6)
    rows = [(f"2024-01-0{1 + i % 3} {i % 24:02d}:00:00", rng.lognormvariate(0, 2)) for i in range(30_000)] + [("2024-01-01 00:00:00", None)]
    df = spark.createDataFrame(rows, "at string, v double").withColumn("at", F.to_timestamp("at"))
    hours = A.rollup_sketches(df, "at", "v")
    assert hours.count() == 24  # each hour of the day is of one day only
    for r in A.merged_rollup(hours, quantiles={"p50": 0.5, "p99": 0.99}).collect():
        day = sorted(v for at, v in rows if v is not None and at.startswith(str(r["day"])[:10]))
        assert r["total"] == len(day) and r["mean"] == pytest.approx(sum(day) / len(day))
        for name, p in (("p50", 0.5), ("p99", 0.99)):
            assert abs(sum(v <= r[name] for v in day) / len(day) - p) < 0.01


def test_clustered_pages_are_those_of_a_sort(spark, tmp_path):
    rng = random.Random(7)
    rows = [(rng.choice([None, *range(12)]), rng.choice(["x", "y", None]), i) for i in range(230)]
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "", r[2]))
    store = ClusteredRows(spark, f"file://{tmp_path}/c", ["a", "b", "id"])
    store.build(spark.createDataFrame(rows, "a int, b string, id long"), per_part=30)
    assert store._parts().count() >= 6
    pick = lambda df: [(r["a"], r["b"], r["id"]) for r in df.collect()]
    for number in (1, 3, 8, 20):
        assert pick(store.page(number, 30)) == ordered[(number - 1) * 30 : number * 30]
    seen, cursor = [], None
    while True:
        got = store.after(cursor, 47).collect()
        seen += [(r["a"], r["b"], r["id"]) for r in got]
        if len(got) < 47:
            break
        cursor = got[-1]["cursor"]
    assert seen == ordered
    back, cursor = [], None
    while len(back) < 230:
        got = store.after(cursor, 60, backward=True).collect()
        back += [(r["a"], r["b"], r["id"]) for r in got]
        cursor = got[-1]["cursor"]
    assert back == ordered[::-1]
    assert "part#" in store.after(store.encode(dict(zip(("a", "b", "id"), ordered[100]))), 10)._jdf.queryExecution().toString().split("PartitionFilters:")[1][:60]


def test_no_rows_to_page_through(spark, tmp_path):
    store = ClusteredRows(spark, f"file://{tmp_path}/none", ["id"])
    store.build(spark.createDataFrame([], "id long"))
    assert store.page(1, 10).count() == 0 and store.after(None, 10).count() == 0


def test_keys_that_are_not_done(spark, tmp_path):
    done = DoneKeys(spark, f"file://{tmp_path}/done", buckets=3)
    make = lambda keys: spark.createDataFrame([(k,) for k in keys], "key string")
    asked = make([f"n{i % 700}" for i in range(1400)] + [None, ""])
    read = lambda: {r["key"] for r in done.missing(asked).collect()}
    everything = {f"n{i}" for i in range(700)} | {""}
    assert read() == everything and done.missing(asked).count() == 701
    done.add(make([f"n{i}" for i in range(0, 700, 2)] + [None]))
    done.add(make([f"n{i}" for i in range(0, 700, 7)]))
    done.add(make([]))
    assert read() == {k for k in everything if not k or int(k[1:]) % 2 and int(k[1:]) % 7}
    assert done.missing(make([])).count() == 0
