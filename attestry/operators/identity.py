"""Identity graph: links from institutions to sources, merges, aliases, canonical names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dictionaries as D
from ..session import small
from .chains import chain_ends
from .matching import priority_first

KEY = ["institution_id", "source", "external_id"]


def upsert(old: DataFrame, new: DataFrame, keys: list[str] = KEY, keep: list[str] | None = None, order: str | None = None) -> DataFrame:
    """Old rows with new ones over them: of equal keys the new row wins, columns in ``keep`` stay as they were; a key that
    is new has them from the row that wins.

    Of several new rows of one key the last by ``order`` wins (any, without it)."""
    cols = old.columns
    both = old.select(*cols, F.lit(0).alias("_new"), F.lit(None).cast("string").alias("_ord")).unionByName(new.select(*cols, F.lit(1).alias("_new"), (F.col(order) if order else F.lit(None)).cast("string").alias("_ord")))
    w = Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc_nulls_last("_ord"))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = both.withColumn("_n", F.row_number().over(w))
    for c in keep or []:
        ranked = ranked.withColumn(f"_keep_{c}", F.last(F.when(F.col("_new") == 0, F.col(c)), ignorenulls=True).over(whole))
    won = ranked.filter("_n = 1")
    return won.select(*[F.coalesce(f"_keep_{c}", c).alias(c) if c in (keep or []) else F.col(c) for c in cols])


def any_order(columns: list[str]) -> Column:
    """An order of rows by all their columns, for want of another: alike on every run."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of ``new`` whose key is not in ``old``; of several rows of one key the first by ``order``, then by all columns."""
    cond = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    fresh = new.alias("n").join(old.alias("o"), cond, "left_anti")
    return priority_first(fresh, keys, [*([F.col(order)] if order else []), any_order(new.columns)])


def update_filled(old: DataFrame, new: DataFrame, key: str, columns: list[str], order: str | None = None) -> DataFrame:
    """Old rows with the filled columns of the new row of equal key; of several the first by ``order``, then by all columns."""
    first = priority_first(new, [key], [*([F.col(order)] if order else []), any_order(new.columns)])
    fresh = first.select(key, *[F.nullif(F.col(c), F.lit("")).alias(f"_new_{c}") for c in columns])
    joined = old.join(fresh, key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in old.columns])


def merge_institutions(institutions: DataFrame, identities: DataFrame, runs: DataFrame, merges: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """Merge institutions by a mapping (``from_id``, ``to_id``): identities and runs point to the target, the source row
    goes, and an audit row tells.

    Merges chain: a target that is merged itself is followed to the end, and a cycle becomes its smallest id, so nothing
    points to a row that goes. Of several targets of one institution the smallest counts; a merge of or into an
    institution that does not exist is none. Rows that would repeat an identity of the target are dropped, the smallest
    id stays. The mapping is broadcast while it is small, else joined on its one row an institution."""
    ids = institutions.select("id").distinct()
    known = merges.join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi").join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi")
    step = small(chain_ends(known.select("from_id", "to_id")))

    def repoint(rows: DataFrame) -> DataFrame:
        met = rows.join(step, rows["institution_id"] == step["from_id"], "left")
        return met.select(*[F.coalesce("to_id", "institution_id").alias(c) if c == "institution_id" else rows[c] for c in rows.columns])

    before = F.to_json(F.struct(F.col("from_id").alias("id"), F.col("to_id").alias("merged_into")))
    after = F.to_json(F.struct(F.col("to_id").alias("id"), F.lit(True).alias("received_identities")))
    audit = step.select(F.lit("system").alias("actor"), F.lit("MERGE").alias("action"), F.lit("institutions").alias("entity"), F.col("from_id").cast("string").alias("entity_id"), before.alias("before"), after.alias("after"), F.lit("Merged duplicate institution").alias("reason"), as_of.alias("at"))
    return {
        "institutions": institutions.join(step, institutions["id"] == step["from_id"], "left_anti"),
        "identities": priority_first(repoint(identities), KEY, [F.col("id")]),
        "runs": repoint(runs),
        "audit_log": audit,
    }


def unlink(identities: DataFrame, identity_id: int) -> DataFrame:
    return identities.filter(F.col("id") != identity_id)


def alias_view(institutions: DataFrame, identities: DataFrame) -> DataFrame:
    """Every name of every institution: its own and those that sources use."""
    links = identities.select(F.col("institution_id").alias("id"), F.col("name_as_source").alias("alias"), F.col("normalized_name").alias("alias_normalized"), "source")
    return institutions.select("id", "canonical_name").join(links, "id", "left")


def aliases(identities: DataFrame) -> DataFrame:
    return identities.select("institution_id", F.col("name_as_source").alias("alias")).filter("alias IS NOT NULL").distinct()


def canonical_names(identities: DataFrame, priority: list[str] | None = None) -> DataFrame:
    """Per institution the name that the first source in the priority list uses; other sources give none."""
    order = priority or D.CANONICAL_PRIORITY
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("source"))
    named = identities.withColumn("_rank", rank).filter("_rank > 0 AND name_as_source IS NOT NULL")
    return named.groupBy("institution_id").agg(F.min(F.struct("_rank", "name_as_source")).getField("name_as_source").alias("canonical_name"))


def identities_of(identities: DataFrame, institution_id: int, source: str | None = None) -> DataFrame:
    cond = F.col("institution_id") == institution_id
    if source:
        cond = cond & (F.col("source") == source)
    return identities.filter(cond).orderBy("source", F.desc("created_at"), "id")


def has_source(institutions: DataFrame, identities: DataFrame, source: str) -> DataFrame:
    """Institutions that the source knows."""
    return institutions.join(identities.filter(F.col("source") == source), institutions["id"] == identities["institution_id"], "left_semi")


def by_identity(identities: DataFrame, source: str, external_id: str) -> DataFrame:
    return identities.filter((F.col("source") == source) & (F.col("external_id") == external_id)).select("institution_id").orderBy("institution_id").limit(1)
