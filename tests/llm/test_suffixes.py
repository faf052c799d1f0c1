from __future__ import annotations

import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attestry.llm import queries, suffixes

SF = "/root/testdata/sf0.001"


def slow_spans(texts, window):
    """Maximal covered runs per text, from a count of every window."""
    raw = [(t or "").encode() for t in texts]
    held = Counter(b[i : i + window] for b in raw for i in range(len(b) - window + 1))
    out = []
    for b in raw:
        spans = []
        for i in range(len(b) - window + 1):
            if held[b[i : i + window]] > 1:
                if spans and spans[-1][1] >= i:
                    spans[-1][1] = i + window
                else:
                    spans.append([i, i + window])
        out.append(spans)
    return out


def check(spark, texts, window=400, **settings):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in suffixes.remove_repeats(docs, window, **settings).collect()}
    assert len(rows) == len(texts)
    for i, (text, want) in enumerate(zip(texts, slow_spans(texts, window))):
        raw = (text or "").encode()
        assert [[s["start"], s["end"]] for s in rows[i]["spans"]] == want, i
        borders = [0, *[x for s in want for x in s], len(raw)]
        assert rows[i]["kept"] == b"".join(raw[a:b] for a, b in zip(borders[::2], borders[1::2])) and rows[i]["n_bytes"] == len(raw)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab\0é", min_size=1, max_size=90))
def test_suffixes_and_common_prefixes(text):
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    order = sorted(range(len(raw)), key=lambda i: raw[i:])
    sa = suffixes.suffix_array(data)
    assert sa.tolist() == order

    def shared(a, b):
        k = 0
        while k < 16 and max(a, b) + k < len(raw) and raw[a + k] == raw[b + k]:
            k += 1
        return k

    assert suffixes.common_prefixes(data, sa, 16, lanes=3).tolist() == [0] + [shared(a, b) for a, b in zip(order, order[1:])]


def test_contexts_hold_each_window_once():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 101, 5000).astype(np.uint8)
    data[3000:4000] = data[500:1500]
    starts = np.concatenate((np.arange(0, 2000), np.arange(2500, 4601)))
    name, whole, first, last, end, times = suffixes.contexts(data, starts, 400)
    assert np.concatenate([np.arange(a, b + 1) for a, b in zip(first, end)]).tolist() == starts.tolist()
    name_of = {int(i): n for n, a, b in zip(name, first, end) for i in range(a, b + 1)}
    assert all(name_of[500 + k] == name_of[3000 + k] for k in range(601))
    body = {}
    for n, w, a, b in zip(name, whole, first, last):
        assert body.setdefault((n, w), data[a : b + 400].tobytes()) == data[a : b + 400].tobytes()


def test_passages_between_unlike_texts(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghij é", k=rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(120), "x" * 399, "y" * 401, prose(70)[:400]]
    texts = [prose(60) + passages[i % 4] + prose(50) + passages[i % 3] for i in range(40)]
    texts += [texts[0], texts[1][5:-3], passages[0], "ab" * 600, "word " * 300 + prose(100) + "word " * 81, "", None, "short"]
    check(spark, texts)
    check(spark, texts, shard_bytes=3000)  # hashes with many shards, met by their names
    check(spark, texts, map_bits=6)  # full maps keep nothing from travelling, with the same result
    check(spark, texts[:20], window=120)


def test_the_repeats_of_one_text_with_itself(spark):
    check(spark, ["z" * 2000])
    check(spark, ["q" * 400, "r" * 401])
    check(spark, ["only once " + "".join(random.Random(1).choices("abc", k=900))])


def test_a_hot_passage_with_unlike_neighbours(spark):
    rng = random.Random(11)
    passage = "".join(rng.choices("klmnop ", k=430))
    texts = ["".join(rng.choices("abcdef ", k=300)) + passage + "".join(rng.choices("ghijkl ", k=300)) for _ in range(120)]
    check(spark, texts, shard_bytes=8000)


def test_whole_table_against_counts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in queries.op11_suffix_dedup(spark, SF).collect()}
    assert len(got) == len(rows)
    for row, spans in zip(rows, slow_spans([r["text"] for r in rows], 400)):
        out = got[row["doc_id"]]
        assert (out["n_bytes"], out["n_removed"], out["n_spans"]) == (len((row["text"] or "").encode()), sum(e - s for s, e in spans), len(spans))


def test_odd_rows(spark, odd_docs, no_docs):
    out = suffixes.remove_repeats(odd_docs)
    assert out.count() == odd_docs.count()
    assert out.columns == [*[c for c in odd_docs.columns if c not in ("n_bytes", "spans")], "n_bytes", "spans", "kept"]
    long = out.filter("doc_id = 5").first()
    assert [tuple(s) for s in long["spans"]] == [(0, 200_000)] and long["kept"] == b""
    assert long["row"] == "own row" and out.filter("doc_id IS NULL").first()["kept"] == b"no id here, only text"
    assert suffixes.remove_repeats(no_docs).count() == 0


def test_long_texts(spark, long_docs):
    rows = {r["doc_id"]: r for r in suffixes.remove_repeats(long_docs).select("doc_id", "n_bytes", "spans").collect()}
    assert [tuple(s) for s in rows[0]["spans"]] == [(0, 5_000_000)] and [tuple(s) for s in rows[1]["spans"]] == [(0, 2_000_000)]
    assert rows[2]["spans"] == [] and [tuple(s) for s in rows[3]["spans"]] == [(0, 2_000_000)] and [tuple(s) for s in rows[4]["spans"]] == [(0, 2_000_000)]


def test_repeated_rows_are_places_of_their_own(spark):
    text = "".join(random.Random(2).choices("abcdefgh", k=500))
    docs = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    assert [r["kept"] for r in suffixes.remove_repeats(docs).collect()] == [b"", b""]
    assert suffixes.remove_repeats(docs.limit(1)).filter(F.size("spans") > 0).count() == 0
