"""Evaluating expensive expressions once."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def bind(rows: DataFrame, *keep: str, **columns: Column) -> DataFrame:
    """Add columns that are computed exactly once per row.

    Columns added the plain way are substituted into later filters and
    projections, and a pattern or a JSON text is then read several times. The
    rows of a generator are final: what follows refers to its output.
    """
    record = F.struct(*[c.alias(name) for name, c in columns.items()])
    return rows.select(*(keep or ("*",)), F.inline(F.array(record)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression of a value that is computed once, also within lambda functions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def share(rows: DataFrame, *by: str) -> DataFrame:
    """Rows that several branches of a plan use, computed once: they meet in one exchange by `by`.

    All other columns travel as one, so that every branch asks for the same exchange, which Spark
    then makes once. For small rows only: logs stay where they are.
    """
    by = by or ("run_id", "part")
    others = [c for c in rows.columns if c not in by]
    packed = rows.select(*by, F.array(F.struct(*others)).alias("_shared")).repartition(*by)
    return packed.select(*by, F.inline("_shared")).select(*rows.columns)
