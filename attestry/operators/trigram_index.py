"""A trigram index that is kept: postings in buckets of files, changed by what differs between two states of the indexed rows.

Each build writes a generation: the rows that are new, changed or gone, and postings of the first two. A posting counts if
its generation is the last that touched its row, so a search reads the buckets of its own trigrams, and of the rows only
those that generations after the base have touched. ``compact`` makes a new base of all generations.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import similarity as S
from ..session import saved, ship, small
from .matching import RECALL, close_entries

ROWS = "id long, text string, n int, digest long, live boolean"


class TrigramIndex:
    """Rows (``id``, ``text``) under a folder: ``rows`` and ``postings`` by generation, and ``log``, which a build writes last, so
    that a build that was lost is as if it had not begun; its files are replaced by the next one."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _read(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.root}/{name}")
        except AnalysisException as missing:
            if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    def generations(self) -> list[int]:
        """The generations that count: the last base and those after it."""
        log = self._read("log")
        told = [] if log is None else sorted((r["gen"], r["base"]) for r in log.collect())
        base = max((g for g, b in told if b), default=0)
        return [g for g, _ in told if g >= base]

    def _part(self, name: str, generations: list[int]) -> DataFrame:
        return self._read(name).filter(F.col("gen").isin(generations))

    def rows(self) -> DataFrame:
        """The indexed rows as they are now, with the generation that last touched them."""
        generations = self.generations()
        if not generations:
            return self.spark.createDataFrame([], f"{ROWS}, gen int").drop("live")
        held = self._part("rows", generations)
        last = held.groupBy("id").agg(F.max_by(F.struct("text", "n", "digest", "live", "gen"), "gen").alias("r")).select("id", "r.*")
        return last.filter("live").drop("live")

    def _write(self, changed: DataFrame, gen: int, base: bool) -> None:
        changed.write.mode("overwrite").parquet(f"{self.root}/rows/gen={gen}")
        rows = self.spark.read.schema(ROWS).parquet(f"{self.root}/rows/gen={gen}")
        posted = rows.filter("live").select("id", "n", F.explode(S.trigrams(F.col("text"))).alias("gram")).withColumn("bucket", self.bucket(F.col("gram")))
        dealt = posted.repartition("bucket").sortWithinPartitions("bucket", "gram")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/postings/gen={gen}")
        self.spark.range(1).select(F.lit(gen).alias("gen"), F.lit(base).alias("base")).coalesce(1).write.mode("append").parquet(f"{self.root}/log")

    def bucket(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.buckets)).cast("int")

    def refresh(self, rows: DataFrame) -> dict[str, int]:
        """Bring the index to the state of ``rows`` (``id``, unique; ``text``, null counts as empty) and tell what changed.

        If nothing differs, nothing is written. Only rows that differ are posted."""
        now = rows.select("id", F.coalesce("text", F.lit("")).alias("text"))
        now = now.select("id", "text", F.size(S.trigrams(F.col("text"))).alias("n"), F.xxhash64("text").alias("digest"))
        generations = self.generations()
        if not generations:
            new = now.withColumn("live", F.lit(True))
            counts = {"added": new.count(), "removed": 0, "changed": 0}
        else:
            old = self.rows().select("id", F.col("digest").alias("_old"))
            met = now.join(old, "id", "full")
            kind = F.when(F.col("_old").isNull(), "added").when(F.col("digest").isNull(), "removed").when(F.col("digest") != F.col("_old"), "changed")
            differs = saved(met.withColumn("kind", kind).filter("kind IS NOT NULL"), "index-changes")
            told = {r["kind"]: r["n"] for r in differs.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
            counts = {k: told.get(k, 0) for k in ("added", "removed", "changed")}
            new = differs.select("id", "text", "n", "digest", (F.col("kind") != "removed").alias("live"))
        if any(counts.values()) or not generations:
            self._write(new, max(generations, default=0) + 1, base=not generations)
        return counts

    def compact(self) -> None:
        """Write all rows as one base; earlier generations are no longer read."""
        gen = max(self.generations(), default=0) + 1
        self._write(self.rows().drop("gen").withColumn("live", F.lit(True)), gen, base=True)

    def _postings(self, grams: DataFrame) -> DataFrame:
        """Postings (``gram``, ``id``, ``n``) of the trigrams ``gram``, from their buckets, without those that no longer count."""
        generations = self.generations()
        if not generations:
            return self.spark.createDataFrame([], "gram string, id long, n int")
        wanted = [r[0] for r in grams.select(self.bucket(F.col("gram"))).distinct().collect()]  # as many as there are buckets at most
        held = self._part("postings", generations).filter(F.col("bucket").isin(wanted)).join(small(grams.select("gram").distinct()), "gram", "left_semi")
        if len(generations) > 1:
            later = self._part("rows", generations[1:]).groupBy("id").agg(F.max("gen").alias("_last"))
            held = held.join(small(later), "id", "left").filter("_last IS NULL OR _last = gen")
        return held.select("gram", "id", "n")

    def similar(self, queries: DataFrame, threshold: float = RECALL, block_postings: int = 4_000_000) -> DataFrame:
        """Pairs (``query_id``, ``id``, ``similarity``) above the threshold for ``queries`` (``query_id``, ``query``): shared over united trigrams.

        Postings are dealt by their row into blocks, where they meet all queries of a block (``close_entries``): what is shuffled is each
        posting once a block of queries, not each pair of a query and a row that share a trigram."""
        ship(self.spark)
        key = lambda g: reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(F.ascii(F.substring(g, i + 1, 1)).cast("long"), 42 - 21 * i) for i in range(3)])
        asked = saved(queries.select("query_id", F.explode(S.trigrams(F.col("query"))).alias("gram")), "index-asked")
        held = self._postings(asked).select("id", "n", key("gram").alias("gram"))
        cores = self.spark.sparkContext.defaultParallelism
        a_blocks = max(1, -(-asked.count() // block_postings))
        b_blocks = max(-(-(self.rows().agg(F.sum("n")).first()[0] or 0) // block_postings), -(-3 * cores // a_blocks))
        block = lambda c, count: F.pmod(F.xxhash64(c), F.lit(count))
        every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
        dealt = lambda df: df.repartition(min(2 * a_blocks * b_blocks, 20_000), "a_block", "b_block").groupBy("a_block", "b_block")
        a = asked.select("query_id", key("gram").alias("gram"), block("query_id", a_blocks).alias("a_block")).withColumn("b_block", every(b_blocks))
        b = held.withColumn("b_block", block("id", b_blocks)).withColumn("a_block", every(a_blocks))

        def close(mine: pa.Table, theirs: pa.Table) -> pa.Table:
            query, row = (t[c].combine_chunks().dictionary_encode() for t, c in ((mine, "query_id"), (theirs, "id")))
            found = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0),)]
            if len(mine) and len(theirs):
                entries, sizes = [x.indices.to_numpy().astype(np.int64) for x in (query, row)], np.zeros(len(row.dictionary), np.int64)
                sizes[entries[1]] = theirs["n"].to_numpy()
                order = [np.argsort(e, kind="stable") for e in entries]
                sides = [(e[o], t["gram"].to_numpy()[o]) for e, o, t in zip(entries, order, (mine, theirs))]
                found += [(np.full(len(near), i), near, similarity) for i, near, similarity in close_entries(*sides, sizes, threshold)]
            i, near, similarity = (np.concatenate(x) for x in zip(*found))
            return pa.table({"query_id": query.dictionary.take(pa.array(i)), "id": row.dictionary.take(pa.array(near)), "similarity": similarity})

        told = T.StructType([asked.schema["query_id"], T.StructField("id", T.LongType()), T.StructField("similarity", T.DoubleType())])
        return dealt(a).cogroup(dealt(b)).applyInArrow(close, told)

    def containing(self, patterns: DataFrame) -> DataFrame:
        """Pairs (``pattern_id``, ``id``) of rows whose text holds the pattern, whatever its case, for ``patterns`` (``pattern_id``, ``pattern``).

        A row must have all trigrams inside the pattern's words; what has them is verified on its text. Patterns without
        such a trigram look at all rows."""
        words = F.regexp_extract_all(F.lower("pattern"), F.lit(r"[\p{L}\p{N}]{3,}"), F.lit(0))
        grams = F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))
        told = patterns.select("pattern_id", "pattern", grams.alias("g")).withColumn("_all", F.size("g"))
        asked = told.filter("_all > 0").select("pattern_id", "pattern", "_all", F.explode("g").alias("gram"))
        met = self._postings(asked).join(asked, "gram").groupBy("pattern_id", "id").agg(F.count(F.lit(1)).alias("_c"), F.first("_all").alias("_all"), F.first("pattern").alias("pattern"))
        may = met.filter("_c = _all").select("pattern_id", "pattern", "id")
        rows = self.rows().select("id", "text")
        holds = F.contains(F.lower("text"), F.lower("pattern"))
        found = rows.join(may, "id").filter(holds).select("pattern_id", "id")
        short = told.filter("_all = 0").select("pattern_id", "pattern")
        if short.isEmpty():
            return found
        return found.unionByName(rows.join(F.broadcast(short), holds).select("pattern_id", "id"))
