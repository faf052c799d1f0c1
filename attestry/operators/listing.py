"""Lists for readers: filters, orders, pages, cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..functions import similarity as S


def filtered(rows: DataFrame, equal: dict | None = None, contains: dict[str, str] | None = None) -> DataFrame:
    """Rows that equal the given values and hold the given texts, whatever their case; None asks for nothing."""
    cond = F.lit(True)
    for column, value in (equal or {}).items():
        if value is not None:
            cond = cond & (F.col(column) == value)
    for column, text in (contains or {}).items():
        if text:
            cond = cond & F.ilike(F.col(column), F.lit(f"%{text}%"))
    return rows.filter(cond)


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) in the order, which must end with a unique column."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def page_totals(rows: DataFrame, size: int) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"), F.ceil(F.count(F.lit(1)) / size).cast("long").alias("total_pages"))


def keyset(rows: DataFrame, key: str, cursor: str | None, size: int, backward: bool = False, inclusive: bool = True) -> DataFrame:
    """Rows from a cursor on, with ``next_cursor``. Forward pages start with the cursor's row (``inclusive``)."""
    at = X.decode_cursor(F.lit(cursor))
    step = F.col(key) < at if backward else (F.col(key) >= at if inclusive else F.col(key) > at)
    kept = rows if cursor is None else rows.filter(F.coalesce(step, F.lit(True)))
    return kept.orderBy(F.desc(key) if backward else F.col(key)).limit(size).withColumn("next_cursor", X.encode_cursor(F.col(key)))


def name_search(institutions: DataFrame, identities: DataFrame, text: str, limit: int = 5) -> DataFrame:
    """Institutions whose own name, or a name that a source gives them, holds the text, whatever its case: (``id``,
    ``name``, ``confidence``, ``rank``). Of several names of one institution the most confident counts, then by name."""
    holds = lambda c: F.contains(F.lower(c), F.lit(text.lower()))
    own = institutions.filter(holds("canonical_name")).select("id", F.col("canonical_name").alias("name"))
    linked = identities.filter(holds("name_as_source")).select(F.col("institution_id").alias("id"), F.col("name_as_source").alias("name"))
    scored = own.unionByName(linked).withColumn("confidence", S.positional_confidence(F.lit(text), F.col("name")))
    best = scored.groupBy("id").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "name")).alias("b")).select("id", "b.name", (-F.col("b.c")).alias("confidence"))
    top = best.orderBy(F.desc("confidence"), "id").limit(limit)  # so the window below sees ``limit`` rows
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("confidence"), "id")))
