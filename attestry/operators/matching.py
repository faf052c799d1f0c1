"""Approximate name matching: exact set-similarity join, top-k candidates, rerank and fusion."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import similarity as S
from ..session import saved, ship, small

RECALL = 0.35
RECALL_LIMIT = 50
RESULT = 0.5
RESULT_LIMIT = 5
REVIEW_BELOW = 0.9


def distinct_texts(strings: DataFrame, text: str) -> DataFrame:
    """Distinct texts that hold a word: (``text``, ``words``, three spaces between any two, as the trigrams of each are padded).

    Dealt out by text over a fixed number of partitions, as little text makes much work further on."""
    spark = strings.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = strings.select(F.col(text).alias("text")).filter("text IS NOT NULL").repartition(parts, "text").distinct()
    return texts.withColumn("words", F.array_join(S.words(F.col("text")), "   ")).filter("words <> ''")


def gram_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of each entry of ``words``: (entry, trigram), by entry; a trigram is its three code points, 21 bits each."""
    code = np.frombuffer("".join(f"  {w} " for w in words).encode("utf-32-le"), "<u4").astype(np.int64)
    entry = np.repeat(np.arange(len(words)), [len(w) + 3 for w in words])
    inside = np.flatnonzero((code[1:-1] != 32) | (code[2:] != 32))  # else between two words
    known, gram = np.unique(code[inside] << 42 | code[inside + 1] << 21 | code[inside + 2], return_inverse=True)
    both = np.unique(entry[inside] * len(known) + gram)
    return both // len(known), known[both % len(known)]


def close_entries(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], sizes: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each entry of ``left``: (entry, entries of ``right`` above the threshold, their similarities). Both sides are (entry,
    trigram), by entry; ``sizes`` has how many trigrams each entry of ``right`` has in all.

    A pair above the threshold t shares more than t n of the n trigrams of the left text, so among the n - floor(t n) that are
    rarest on the right one is shared. Only these are counted; where all others together could still be enough, they are too."""
    known = np.unique(left[1])
    at = np.minimum(np.searchsorted(known, right[1]), len(known) - 1)
    held = known[at] == right[1]
    entry, gram = right[0][held], at[held]
    begins = np.searchsorted(entry, np.arange(len(sizes) + 1))
    by_gram = np.argsort(gram, kind="stable")
    posted, places = entry[by_gram], np.searchsorted(gram[by_gram], np.arange(len(known) + 1))
    often = np.diff(places)
    asked, mine = np.searchsorted(known, left[1]), np.searchsorted(left[0], np.arange(left[0][-1] + 2))
    least = threshold / (1 + threshold) * sizes - 1e-9
    marked = np.zeros(len(known), np.int64)
    for i in range(len(mine) - 1):
        grams = asked[mine[i] : mine[i + 1]]
        rest = int(np.floor(threshold * len(grams) - 1e-9)) if len(grams) else 0
        first = grams[np.argsort(often[grams], kind="stable")][: len(grams) - rest]
        met = np.concatenate([posted[places[g] : places[g + 1]] for g in first]) if len(first) else posted[:0]
        counted = np.bincount(met, minlength=len(sizes))
        may = np.flatnonzero(counted > np.maximum(least + (threshold / (1 + threshold) * len(grams) - rest), 0))
        if len(may):
            marked[grams] = 1
            lengths = begins[may + 1] - begins[may]
            flat = np.repeat(begins[may] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            shared = np.add.reduceat(marked[gram[flat]], np.cumsum(lengths) - lengths)  # each of them shares one at least
            marked[grams] = 0
            similarity = shared / (len(grams) + sizes[may] - shared)
            near = similarity > threshold
            if near.any():
                yield i, may[near], similarity[near]


def similarity_join(left: DataFrame, right: DataFrame, left_text: str, right_text: str, threshold: float = RECALL, broadcast_grams: int = 300_000, broadcast_bytes: int = 32 << 20, most_met: int = 300_000_000, most_pairs: int = 10_000_000, block_bytes: int = 4 << 20) -> DataFrame:
    """Pairs (``left_text``, ``right_text``, ``similarity``) of distinct texts above the threshold, strictly.

    If all pairs of texts are ``most_pairs`` at most and the postings that would meet, summed up beforehand from the
    trigrams' counts on both sides, ``most_met``, postings meet and are counted per pair, which gives the similarity. Else
    texts are dealt by hash into blocks of about ``block_bytes``, and each pair of blocks is one task, which counts by the rarest
    trigrams and verifies by whole sets (``close_entries``). So nothing is shuffled but the texts, each once a block of the
    other side: a short side is one block, and then the work moves in proportion to the long one. Both ways give the same
    pairs: none above the threshold is lost, whatever the frequencies. If the left side has at most ``broadcast_grams``
    postings (20 bytes each) and ``broadcast_bytes`` of text, the postings that meet find it broadcast.
    """
    spark = ship(left.sparkSession)
    mine, theirs = saved(distinct_texts(left, left_text), "left-texts"), saved(distinct_texts(right, right_text), "right-texts")
    size, held = [df.agg(F.count(F.lit(1)).alias("texts"), F.coalesce(F.sum(F.octet_length("words")), F.lit(0)).alias("bytes")).first() for df in (mine, theirs)]

    if size["texts"] * held["texts"] <= most_pairs:
        keyed = lambda df: df.select("text", F.xxhash64("text").alias("id"), S.trigrams(F.col("text")).alias("grams")).select("text", "id", F.transform("grams", lambda g: F.xxhash64(g)).alias("grams"), F.size("grams").alias("n"))
        asking, asked = saved(keyed(mine), "left-grams"), saved(keyed(theirs), "right-grams")
        postings = asking.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        few = F.broadcast if postings <= broadcast_grams and size["bytes"] <= broadcast_bytes else (lambda df: df)
        counts = lambda df, n: df.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias(n))
        if (counts(asked, "held").join(counts(asking, "asked"), "gram").agg(F.sum(F.col("held") * F.col("asked"))).first()[0] or 0) <= most_met:
            named = lambda df, k: df.select(F.col("id").alias(k), F.col("text").alias(f"{k}_text"))
            post = lambda df, k: df.select(F.col("id").alias(k), F.col("n").alias(f"{k}_n"), F.explode("grams").alias("gram"))
            shared = post(asked, "b").join(few(post(asking, "a")), "gram").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.first("a_n").alias("a_n"), F.first("b_n").alias("b_n"))
            close = shared.select("a", "b", (F.col("c") / (F.col("a_n") + F.col("b_n") - F.col("c"))).alias("similarity")).filter(F.col("similarity") > threshold)
            return close.join(few(named(asking, "a")), "a").join(named(asked, "b"), "b").select(F.col("a_text").alias("left_text"), F.col("b_text").alias("right_text"), "similarity")

    cores = spark.sparkContext.defaultParallelism
    a_blocks = max(1, -(-size["bytes"] // block_bytes))
    b_blocks = max(-(-held["bytes"] // block_bytes), -(-3 * cores // a_blocks))
    block = lambda count: F.pmod(F.xxhash64("text"), F.lit(count))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    tasks = min(2 * a_blocks * b_blocks, 20_000)
    dealt = lambda df: df.repartition(tasks, "a_block", "b_block").groupBy("a_block", "b_block")

    def close(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0),)]
        if len(mine) and len(theirs):
            a, b = gram_rows(mine["words"].to_pylist()), gram_rows(theirs["words"].to_pylist())
            found += [(np.full(len(near), i), near, similarity) for i, near, similarity in close_entries(a, b, np.bincount(b[0], minlength=len(theirs)), threshold)]
        i, near, similarity = (np.concatenate(x) for x in zip(*found))
        return pa.table({"left_text": mine["text"].take(pa.array(i)), "right_text": theirs["text"].take(pa.array(near)), "similarity": similarity})

    a = mine.withColumn("a_block", block(a_blocks)).withColumn("b_block", every(b_blocks))
    b = theirs.withColumn("b_block", block(b_blocks)).withColumn("a_block", every(a_blocks))
    return dealt(a).cogroup(dealt(b)).applyInArrow(close, "left_text string, right_text string, similarity double")


def overlap_join(texts: DataFrame, text: str, tokens: str, share: float) -> DataFrame:
    """Pairs (``a`` < ``b``) of distinct texts whose token sets share at least ``share`` of the smaller set, or are equal.

    A pair shares at least ceil(share m) of the smaller set's m tokens, so one of its first m - ceil(share m) + 1, the
    rarest first, is among them: only these look for partners, among all tokens of the larger sets."""
    rows = texts.select(F.col(text).alias("text"), F.array_distinct(tokens).alias("tokens")).filter("text IS NOT NULL").distinct().withColumn("n", F.size("tokens")).filter("n > 0")
    rows = saved(rows, "token-sets")
    posted = rows.select("text", "n", F.explode("tokens").alias("token"))
    held = posted.groupBy("token").agg(F.count(F.lit(1)).alias("held"))
    ranked = posted.join(small(held, 1_000_000), "token").withColumn("at", F.row_number().over(Window.partitionBy("text").orderBy("held", "token")) - 1)
    asking = ranked.filter(F.col("at") <= F.col("n") - F.ceil(F.col("n") * share - 1e-9)).select(F.col("text").alias("s"), F.col("n").alias("sn"), "token")
    met = asking.join(posted.select(F.col("text").alias("t"), F.col("n").alias("tn"), "token"), "token").filter("s <> t AND sn <= tn")
    pairs = met.select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).distinct()
    side = lambda k: rows.select(F.col("text").alias(k), F.col("tokens").alias(f"{k}_t"))
    whole = pairs.join(side("a"), "a").join(side("b"), "b")
    return whole.filter(F.size(F.array_intersect("a_t", "b_t")) >= share * F.least(F.size("a_t"), F.size("b_t")) - 1e-9).select("a", "b")


def candidate_union(institutions: DataFrame, identities: DataFrame, entries: DataFrame) -> DataFrame:
    """Names to match against, from three tables: (``type``, ``id``, ``name``, ``match_text``, ``source``, ``external_id``).

    Deleted institutions are left out. A registry entry is compared by its canonical name, else its normal form.
    """
    none = F.lit(None).cast("string")
    a = institutions.filter("deleted_at IS NULL").select(F.lit("institution").alias("type"), F.col("id").cast("long").alias("id"), F.col("canonical_name").alias("name"), F.col("normalized_name").alias("match_text"), none.alias("source"), none.alias("external_id"))
    b = identities.select(F.lit("identity").alias("type"), F.col("id").cast("long").alias("id"), F.col("name_as_source").alias("name"), F.col("normalized_name").alias("match_text"), "source", "external_id")
    c = entries.select(F.lit("registry").alias("type"), F.col("id").cast("long").alias("id"), F.col("canonical_name").alias("name"), F.coalesce("canonical_name", "normalized_name").alias("match_text"), F.col("authority_code").alias("source"), "external_id")
    return a.unionByName(b).unionByName(c)


def find_candidates(queries: DataFrame, candidates: DataFrame, query_id: str = "query_id", text: str = "query", limit: int = RECALL_LIMIT, threshold: float = RECALL, limit_scope: str = "total", sources: list[str] | None = None) -> DataFrame:
    """The ``limit`` most similar candidates of each query: (query id, candidate columns, ``similarity``, ``rank``).

    ``limit_scope`` is ``total`` or ``per_source`` (per candidate type). ``sources`` restricts registry candidates only.
    Ties go by type, then id.
    """
    pool = candidates if sources is None else candidates.filter((F.col("type") != "registry") | F.col("source").isin(sources))
    pairs = similarity_join(queries, pool, text, "match_text", threshold)
    found = queries.select(query_id, F.col(text).alias("left_text")).join(pairs, "left_text").join(pool.withColumnRenamed("match_text", "right_text"), "right_text")
    part = [query_id] if limit_scope == "total" else [query_id, "type"]
    order = Window.partitionBy(*part).orderBy(F.desc("similarity"), "type", "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).drop("left_text").withColumnRenamed("right_text", "match_text")


def cosine_topk(queries: DataFrame, candidates: DataFrame, id_col: str, vector_col: str, pairs: DataFrame, k: int) -> DataFrame:
    """Rerank given pairs (``query_id``, ``candidate_id``) by cosine; per query the ``k`` best, ties by candidate."""
    q = queries.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("_q"))
    c = candidates.select(F.col(id_col).alias("candidate_id"), F.col(vector_col).alias("_c"))
    scored = pairs.join(q, "query_id").join(c, "candidate_id").select("query_id", "candidate_id", S.cosine(F.col("_q"), F.col("_c")).alias("cosine"))
    best = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "candidate_id")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def cosine_search(vectors: DataFrame, query: Column, k: int, id_col: str, vector_col: str, query_rows: int = 1024, candidate_rows: int = 8192) -> DataFrame:
    """The ``k`` rows of largest cosine for each row where ``query`` holds, against all rows but itself, exactly.

    Queries and candidates are dealt by hash into blocks of bounded size; each pair of blocks is one matrix product, and
    keeps ``k`` rows a query. Zero vectors have cosine 0; null vectors take no part; all have one length."""
    rows = saved(vectors.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(query, F.lit(False)).alias("asks")), "vectors")
    n = rows.agg(F.count(F.lit(1)).alias("all"), F.count_if("asks").alias("asked")).first()
    asked_blocks, held_blocks = max(1, -(-n["asked"] // query_rows)), max(1, -(-n["all"] // candidate_rows))
    block = lambda count, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(count))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    asked = rows.filter("asks").withColumn("qb", block(asked_blocks, 1)).withColumn("cb", every(held_blocks))
    held = rows.withColumn("cb", block(held_blocks, 2)).withColumn("qb", every(asked_blocks))

    def best(left, right):
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "candidate_id": [], "cosine": []})
        right = right.sort_values("id", ignore_index=True)
        unit = lambda part: (m := np.array(part["v"].tolist(), float)) / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        scores = unit(left) @ unit(right).T
        ids, out = right["id"].to_numpy(), []
        for own, row in zip(left["id"].tolist(), scores):
            row[ids == own] = -np.inf
            edge = np.partition(row, -min(k, len(row)))[-min(k, len(row))]
            near = np.flatnonzero((row >= edge - 1e-12) & (row > -np.inf))
            out += [(own, int(ids[i]), float(row[i])) for i in near[np.lexsort((ids[near], -row[near]))][:k]]
        return pd.DataFrame(out, columns=["query_id", "candidate_id", "cosine"])

    found = asked.groupBy("qb", "cb").cogroup(held.groupBy("qb", "cb")).applyInPandas(best, "query_id long, candidate_id long, cosine double")
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "candidate_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def resolve(
    inputs: DataFrame,
    candidates: DataFrame,
    identities: DataFrame | None = None,
    text: str = "input",
    limit: int = RESULT_LIMIT,
    threshold: float = RESULT,
    embed=None,
    by_id_only: bool = False,
    dims: int = 32,
) -> DataFrame:
    """Resolve input names: (``input``, ``type``, ``id``, ``name``, ``source``, ``confidence``, ``method``, ``scores``, ``needs_review``).

    An identity entered by hand under the very input ends the search with confidence 1. Otherwise the name is
    normalised and written out in up to five variants; the first variant that finds a candidate gives its trigram
    similarity; ``embed`` (a function from a text column to a vector column) gives the vector similarity of raw input
    and raw name, one half if absent or zero; a candidate whose name holds the state found in the input gets the state
    bonus. Fused scores from ``threshold`` on are ranked, ``limit`` each. ``by_id_only`` merges candidates of equal id
    from different tables.
    """
    asked = inputs.select(F.col(text).alias("input")).filter("input IS NOT NULL").distinct()
    manual = None
    if identities is not None:
        hit = identities.filter("source = 'MANUAL'").groupBy(F.col("external_id").alias("input")).agg(F.min(F.struct("institution_id", "name_as_source")).alias("m"))
        manual = asked.join(hit, "input").select("input", F.lit("institution").alias("type"), F.col("m.institution_id").cast("long").alias("id"), F.col("m.name_as_source").alias("name"), F.lit("MANUAL").alias("source"), F.lit(1.0).alias("confidence"), F.lit("identity").alias("method"), F.struct(F.lit(1.0).alias("trigram"), F.lit(1.0).alias("vector"), F.lit(0.0).alias("state_match"), F.lit(1.0).alias("final")).alias("scores"), F.lit(False).alias("needs_review"), F.lit(1).alias("rank"))
        asked = asked.join(manual.select("input"), "input", "left_anti")
    named = asked.withColumn("_name", N.normalize_name(F.col("input")))
    variants = named.select("input", F.col("_name.state").alias("state"), F.posexplode(N.expand_variants(F.col("_name.normalized"))).alias("variant_no", "variant")).withColumn("query", F.lower("variant"))
    pool = candidates.withColumn("match_text", F.lower("match_text"))
    hits = find_candidates(variants.withColumn("query_id", F.struct("input", "variant_no", "state")), pool)
    key = ["id"] if by_id_only else ["type", "id"]
    first = Window.partitionBy("query_id.input", *key).orderBy("query_id.variant_no", "rank")
    kept = hits.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select(F.col("query_id.input").alias("input"), F.col("query_id.state").alias("state"), "type", "id", "name", "source", "similarity")
    vector = F.lit(None).cast("double")
    if embed is not None:  # each text once, not each pair
        texts = lambda c: saved(kept.select(c).filter(F.col(c).isNotNull()).distinct().withColumn(f"_{c}_vector", embed(F.col(c))), "vectors")
        kept = saved(kept, "resolved")
        kept = kept.join(texts("input"), "input", "left").join(texts("name"), "name", "left")
        vector = S.cosine(F.col("_input_vector"), F.col("_name_vector"))
    state_match = F.when(F.contains(F.lower("name"), F.col("state")), 1.0).otherwise(0.0)
    scored = kept.withColumn("vector", F.coalesce(F.nullif(vector, F.lit(0.0)), F.lit(0.5))).withColumn("state_match", state_match)
    scored = scored.withColumn("confidence", S.fused(F.col("similarity"), F.col("vector"), F.col("state_match"))).filter(F.col("confidence") >= threshold)
    order = Window.partitionBy("input").orderBy(F.desc("confidence"), "type", "id")
    method = F.when(F.col("similarity") >= 1.0, "exact").otherwise("trigram" if embed is None else "fusion")
    out = (
        scored.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= limit)
        .select("input", "type", "id", "name", "source", "confidence", method.alias("method"), F.struct(F.col("similarity").alias("trigram"), "vector", "state_match", F.col("confidence").alias("final")).alias("scores"), (F.col("confidence") < REVIEW_BELOW).alias("needs_review"), "rank")
    )
    return out if manual is None else out.unionByName(manual)


def variant_index_join(names: DataFrame, targets: DataFrame, name: str, target: str, order: str) -> DataFrame:
    """Match by any shared variant: the longest variant decides, then its place, then the target that came first."""
    mine = names.select(F.col(name).alias("name")).distinct().select("name", F.posexplode(N.depository_variants(F.col("name"))).alias("pos", "variant"))
    first = Window.partitionBy("variant").orderBy(order)
    theirs = targets.select(F.col(target).alias("target"), order, F.explode(N.depository_variants(F.col(target))).alias("variant")).withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    best = Window.partitionBy("name").orderBy(F.desc(F.length("variant")), "pos", order)
    return mine.join(theirs, "variant").withColumn("_b", F.row_number().over(best)).filter("_b = 1").select("name", "target", "variant")


def merge_candidates(found: DataFrame, keys: list[str], limit: int = 5) -> DataFrame:
    """Of candidates with equal (type, id) the most confident stays; per input the ``limit`` best."""
    one = Window.partitionBy(*keys, "type", "id").orderBy(F.desc("confidence"))
    top = Window.partitionBy(*keys).orderBy(F.desc("confidence"), "type", "id")
    return found.withColumn("_n", F.row_number().over(one)).filter("_n = 1").drop("_n").withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= limit)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def priority_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_first", F.row_number().over(w)).filter("_first = 1").drop("_first")
