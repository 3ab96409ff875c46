"""Turn rows of the test tables into raw logs.

The answer to a query over rendered logs is known from the rows alone, so the
SQL that checks it never looks at a log.

A log is built in parts of at most PART_ROWS rows, whose key is a range of a
unique number, so that no run gathers an unbounded group in one task.
"""

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

PART_ROWS = 32_768


def fill(template: str, values: Mapping[str, Column]) -> Column:
    """A text with `{name}` places filled in."""
    pieces = [
        values[piece[1:-1]].cast("string") if piece[1:-1] in values and piece[0] == "{" else F.lit(piece)
        for piece in re.split(r"(\{\w+\})", template)
        if piece
    ]
    return F.concat(*pieces) if pieces else F.lit("")


def assemble(lines: DataFrame, keys: tuple[str, ...], head: Column | str = "", tail: Column | str = "") -> DataFrame:
    """lines(keys..., part, seq, text) -> one log per key and part, lines by seq.

    The head comes before the first part of a key, the tail after its last.
    """
    by_part = lines.groupBy(*keys, "part").agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("all"))
    as_column = lambda v: F.lit(v) if isinstance(v, str) else v
    body = F.concat(F.array_join(F.col("all.text"), "\n"), F.lit("\n"))
    if isinstance(head, str) and isinstance(tail, str) and not head + tail:
        return by_part.select(*keys, "part", body.alias("log"))
    parts = Window.partitionBy(*keys).orderBy("part")
    first, last = F.lag("part").over(parts).isNull(), F.lead("part").over(parts).isNull()
    placed = by_part.withColumn("first", first).withColumn("last", last)
    log = F.concat(F.when(F.col("first"), as_column(head)).otherwise(""), body, F.when(F.col("last"), as_column(tail)).otherwise(""))
    return placed.select(*keys, "part", log.alias("log"))


def part_of(seq: Column) -> Column:
    return F.shiftright(seq, PART_ROWS.bit_length() - 1)
