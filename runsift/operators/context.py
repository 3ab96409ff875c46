"""Context of lines in tables of lines: headers, gates, look-ahead, paths.

These work on tables with one row per line, where a run may be one row or most
of the table. Rows are therefore grouped into blocks (a bounded range of the
line order); windows over lines run inside one block, and only one row per
block takes part in the window over a whole run.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from runsift.functions.nesting import enclosing_by_level


def carry(
    lines: DataFrame,
    value: Column,
    name: str,
    keys: tuple[str, ...] = ("run_id",),
    block: str = "part",
    order: tuple[str, ...] = ("seq",),
    backward: bool = False,
    inclusive: bool = True,
) -> DataFrame:
    """Add the nearest earlier (or later) non-null value, across blocks.

    `block` must be a number that grows with the line order within the keys.
    Inclusive takes the line's own value into account.
    """
    way = (lambda c: F.col(c).desc()) if backward else (lambda c: F.col(c).asc())
    rows = lines.withColumn("_value", value)
    inside = Window.partitionBy(*keys, block).orderBy(*[way(c) for c in order])
    reach = inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    near = rows.withColumn("_near", F.last("_value", ignorenulls=True).over(reach))

    place = F.struct(*order)
    edge = (F.min_by if backward else F.max_by)(F.col("_value"), F.when(F.col("_value").isNotNull(), place))
    blocks = rows.groupBy(*keys, block).agg(edge.alias("_edge"))
    earlier = Window.partitionBy(*keys).orderBy(way(block)).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, block, F.last("_edge", ignorenulls=True).over(earlier).alias("_far"))

    joined = near.join(blocks, [*keys, block])
    return joined.withColumn(name, F.coalesce("_near", "_far")).drop("_value", "_near", "_far")


def section_gate(lines: DataFrame, marker: Column, name: str = "inside", **layout) -> DataFrame:
    """Add whether a line stands after the first marker line of its run."""
    opened = carry(lines, F.when(marker, F.lit(True)), name, inclusive=False, **layout)
    return opened.withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def leaf_lines(lines: DataFrame, level: str = "level", name: str = "is_leaf", **layout) -> DataFrame:
    """Add whether the next line of the run is not deeper. Lines without a level are skipped."""
    significant = lines.where(F.col(level).isNotNull())
    ahead = carry(significant, F.col(level), "_next", backward=True, inclusive=False, **layout)
    return ahead.withColumn(name, F.coalesce(F.col("_next") <= F.col(level), F.lit(True))).drop("_next")


def indent_paths(trees: DataFrame, items: str = "items") -> DataFrame:
    """trees(run_id, part, items array<struct<level, name>>) -> one row per item with its path."""
    placed = trees.withColumn("_inside", enclosing_by_level(F.col(f"{items}.level")))
    names = F.col(f"{items}.name")
    path = F.transform(
        F.col("_inside"), lambda at: F.transform(at, lambda i: F.element_at(names, i + 1))
    )
    rows = placed.select("run_id", "part", F.posexplode(F.arrays_zip(F.col(items).alias("item"), path.alias("path"))).alias("seq", "z"))
    return rows.select("run_id", "part", "seq", "z.item.*", F.concat("z.path", F.array("z.item.name")).alias("path"))


def latest_start(
    events: DataFrame,
    is_start: Column,
    value: Column,
    name: str,
    keys: tuple[str, ...] = ("run_id", "id"),
    block: str = "part",
    order: tuple[str, ...] = ("seq",),
) -> DataFrame:
    """Give every event the value of the latest start with the same keys before it."""
    return carry(events, F.when(is_start, value), name, keys=keys, block=block, order=order, inclusive=False)
