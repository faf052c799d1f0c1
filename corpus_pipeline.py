"""Corpus pipeline over ``documents``: quality, near-dedup, secrets, mixture, packing. Each stage is one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import packing, quality, queries, secrets, simhash
from attestry.llm.columns import set_aside
from attestry.session import discard, saved, spread, written

#: Most ids (8 bytes each) that the near-dedup stage broadcasts.
BROADCAST_IDS = 1_000_000
#: Token budget of the mixing stage as a share of its input. At 1 every leaf would be full and the weights decide nothing;
#: at a half the weights hold wherever a domain or language has at least half of its target share in the input.
MIXTURE_SHARE = 0.5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects; it learns from the labels of the rows at hand.

    Null and empty texts are judged as empty ones; repeated rows are judged alike, with or without an id; without labels
    all stay; an empty table stays empty. Columns of any name keep their values."""
    model = queries.quality_model(spark, sf_dir, docs)
    own, back = set_aside(docs, text=F.col("text"))
    return quality.score(own, model, threshold=0.3).filter("predicted = 1").select(*back())


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group one row stays: the one with the smallest id (none counts last), then by the hash of
    its text, then by its other columns.

    Groups are linked by a similarity of 0.8 or more over sets of five words, whatever the fingerprints' distance; texts
    without words, null ones too, are one group. Rows are told apart by id and text, so an id that comes with unlike texts
    loses none of them; of rows that are alike in all columns one stays. An empty table stays empty. Columns of any name
    keep their values. Up to ``BROADCAST_IDS`` keys of rows that go are broadcast, so texts are not shuffled; beyond
    that the join shuffles."""
    own, back = set_aside(docs, id=F.col("doc_id"), key=F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id"), simhash.text_hash(F.col("text"))))
    groups = saved(simhash.near_copies(docs, width=5, similarity=0.8).withColumn("key", F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_key"))), "near-groups")
    first = groups.groupBy("root").agg(F.min_by("key", F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("stays"))
    found = saved(groups.join(first, "root").groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.max(F.col("key") != F.col("stays")).alias("goes")).filter("rows > 1 OR goes"), "near-copies")
    counts = found.agg(F.count_if("goes").alias("gone"), F.count_if(~F.col("goes")).alias("repeated")).first()
    few = lambda keys, n: F.broadcast(keys) if n <= BROADCAST_IDS else keys
    kept = own.join(few(found.filter("goes").select("key"), counts["gone"]), "key", "left_anti")
    if not counts["repeated"]:
        return kept.select(*back())
    repeated = few(found.filter(~F.col("goes")).select("key"), counts["repeated"])
    columns = [c for c in own.columns if c.startswith("c")]
    order = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    once = kept.join(repeated, "key", "left_semi").groupBy("key").agg(F.min_by(F.struct(*columns), order).alias("row")).select("row.*")
    return kept.join(repeated, "key", "left_anti").select(*columns).unionByName(once).select(*back())


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays, repeated ones and those of null or empty text too; the secrets in its text are replaced by marks
    and ``n_chars`` follows. An empty table stays empty. Columns of any other name keep their values."""
    own, back = set_aside(docs, text=F.col("text"))
    clean = secrets.redact(secrets.scan_secrets(own))
    changed = {"text": F.col("text"), "n_chars": F.when(F.size("spans") > 0, F.length("text").cast("long"))}
    old = dict(zip(docs.columns, back()))
    return clean.select(*[F.coalesce(changed[n], F.col(f"c{i}")).alias(n) if n in changed else old[n] for i, n in enumerate(docs.columns)])


def keep_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A mixture by the target weights in one epoch, so no row comes twice: ``MIXTURE_SHARE`` of the words at hand.

    Null languages and sources are nodes of their own; texts without words, null ones too, cost nothing and follow their
    leaf's order; repeated rows are taken together; an empty table stays empty. Columns of any name keep their values."""
    own, back = set_aside(docs, **{c: F.col(c) for c in ("doc_id", "text", "lang", "source")})
    return queries.mixture(own, max_epochs=1, share=MIXTURE_SHARE).select(*back())


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every row with their sequence and place. Null and empty texts are one piece of the end id; repeated
    rows are packed each for itself; an empty table gives none. Other columns are not read."""
    pieces = packing.token_pieces(docs, queries.vocabulary(), capacity=2048)
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity=2048)


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", keep_one_copy),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", keep_mixture),
    ("best-fit packing", pack_sequences),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, each written as Parquet in the shared folder and read again by the next. What a
    stage wrote on its way is deleted once its result is written."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    since = written(spark)
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(spark, since, keep=1)
    return docs
