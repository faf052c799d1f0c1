"""Columns of any name beside an operator's own."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_aside(rows: DataFrame, **made: Column) -> tuple[DataFrame, Callable[..., list[Column]]]:
    """``rows`` with its columns renamed by place (``c0``, ``c1``, ...) beside the columns ``made`` of them, and a function
    that gives the old columns back under their names, without those that it is told are replaced.

    So no name of the rows can clash with one of the operator's own. Names match as Spark resolves them, in any case.
    """
    names = rows.columns
    quoted = [F.col("`" + n.replace("`", "``") + "`") for n in names]
    held = rows.select(*[c.alias(f"c{i}") for i, c in enumerate(quoted)], *[c.alias(n) for n, c in made.items()])

    def back(*replaced: str) -> list[Column]:
        gone = {r.lower() for r in replaced}
        return [F.col(f"c{i}").alias(n) for i, n in enumerate(names) if n.lower() not in gone]

    return held, back


def values(column: pa.Array, rows: int = 512) -> Iterator:
    """A batch's values a few at a time, so that a worker never holds the batch a second time as Python objects."""
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).to_pylist()
    pa.default_memory_pool().release_unused()
    try:  # workers serve many stages: what a batch needed goes back to the system
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not every C library has it
        pass
