"""Names of the items in which an item stands, within a part of a log and across parts.

A part is walked once with a stack. What stands open at its end, and how much of what
earlier parts left open it closes, is one small row; these rows, in the order of parts,
give what each part begins within. Names are put together for the wanted items only, so
the work is in proportion to the items and to what comes out.
"""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from runsift.functions.binding import bind, share

STATE = "struct<paths: array<array<string>>, kept: array<int>, end_levels: array<int>, end_names: array<string>, kept_at_end: int>"


def _by_level() -> Callable:
    """Items enclose the deeper ones that follow; an item without a level only looks. Kept: what lies above the least level so far."""

    def walk(levels, names, wanted):
        stack, paths, kept, least = [], [], [], (1 << 31) - 1
        for level, name, is_wanted in zip(levels, names, wanted):
            if level is not None:
                while stack and stack[-1][0] >= level:
                    stack.pop()
                least = min(least, level)
            paths.append([n for _, n in stack] if is_wanted else None)
            kept.append(least)
            if level is not None:
                stack.append((level, name))
        return paths, kept, [level for level, _ in stack], [n for _, n in stack], least

    return walk


def _by_brackets() -> Callable:
    """Each item first closes a number of open items, then may open itself. Kept: minus the number of earlier ones closed so far."""

    def walk(closes, opens, names, wanted):
        stack, paths, kept, lost = [], [], [], 0
        for closed, opened, name, is_wanted in zip(closes, opens, names, wanted):
            closed = closed or 0
            lost += max(0, closed - len(stack))
            del stack[max(0, len(stack) - closed) :]
            paths.append(list(stack) if is_wanted else None)
            kept.append(-lost)
            if opened:
                stack.append(name)
        return paths, kept, [0] * len(stack), stack, -lost

    return walk


def _walked(make: Callable, *columns: Column) -> Column:
    kind = pa.struct([("paths", pa.list_(pa.list_(pa.string()))), ("kept", pa.list_(pa.int32())), ("end_levels", pa.list_(pa.int32())), ("end_names", pa.list_(pa.string())), ("kept_at_end", pa.int32())])

    def run(*arrays: pa.Array) -> pa.Array:
        walk = make()
        rows = [dict(zip(("paths", "kept", "end_levels", "end_names", "kept_at_end"), walk(*row))) for row in zip(*(a.to_pylist() for a in arrays))]
        return pa.array(rows, type=kind)

    # Said to be non-deterministic, as Spark then evaluates it once, whatever refers to its result.
    return F.arrow_udf(run, STATE).asNondeterministic()(*columns)


def _begun(states: DataFrame) -> DataFrame:
    """One row for each part: what it begins within, for each `kept` that its items ask for, and the indent of the item that follows it.

    The rows of a run stream through one task with one stack; they hold no log lines.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stack, last = None, [], None
        names = ["run_id", "part", "asked", "prefixes", "follows"]
        types = [pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.list_(pa.string())), pa.int32()]

        def batch_of(rows):
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if row["run_id"] != now:
                    if last is not None:
                        done.append((*last, None))
                    now, stack, last = row["run_id"], [], None
                by_level = row["by_level"]
                keep = (lambda k: [x for x in stack if x[0] < k]) if by_level else (lambda k: stack[: max(0, len(stack) + k)])
                if last is not None and row["first"] is not None:
                    done.append((*last, row["first"]))
                    last = None
                mine = (now, row["part"], row["asked"], [[n for _, n in keep(k)] for k in row["asked"]])
                if row["first"] is None:
                    done.append((*mine, None))
                else:
                    last = mine
                stack = keep(row["kept_at_end"]) + list(zip(row["end_levels"], row["end_names"]))
            if done:
                yield batch_of(done)
        if last is not None:
            yield batch_of([(*last, None)])

    return states.repartition("run_id").sortWithinPartitions("run_id", "part").mapInArrow(run, "run_id string, part long, asked array<int>, prefixes array<array<string>>, follows int")


def _with_paths(rows: DataFrame, walked: Column, chosen: DataFrame | None, indent: Column | None, by_level: bool) -> DataFrame:
    """rows(run_id, part, way, sure, items) -> one row for each wanted item, with its path and place."""
    # The items are walked once: the wanted ones and what a part leaves open meet in one exchange, one row for each part and way.
    size = F.size("items")
    first = F.lit(None).cast("int") if indent is None else F.when(size > 0, F.try_element_at(indent, F.lit(1)))
    bound = bind(rows, "run_id", "part", "way", "sure", items=F.col("items")).withColumns({"n": size, "first": first})
    bound = bound.withColumn("w", walked)
    zipped = F.arrays_zip(F.sequence(F.lit(0), size - 1).alias("seq"), F.col("items").alias("item"), F.col("w.paths").alias("inside"), F.col("w.kept").alias("kept"))
    wanted = F.when(size > 0, F.filter(zipped, lambda z: z["item"]["wanted"])).otherwise(F.slice(zipped, 1, 0))
    # A column of its own: a filter on the part would go below the exchange in one branch and split it in two.
    is_first = F.coalesce(F.col("part") == 0, F.lit(False)).alias("_first")
    walked_rows = share(bound.select("run_id", "part", is_first, "way", "sure", "n", "first", wanted.alias("told"), "w.end_levels", "w.end_names", "w.kept_at_end"))
    keys = ["run_id", "part", "_first", "way"]

    def of_chosen(table: DataFrame) -> DataFrame:
        if chosen is None:
            return table
        ways = chosen.groupBy("run_id", "part").agg(F.collect_set("way").alias("_ways"))
        return table.join(ways, ["run_id", "part"], "left").where(F.col("sure") | F.array_contains("_ways", F.col("way"))).drop("_ways")

    is_last = F.lit(False) if indent is None else F.col("z.seq") + 1 == F.col("n")
    told = walked_rows.select(*keys, "sure", "n", F.explode("told").alias("z"))
    told = told.select(*keys, "sure", "z.seq", is_last.alias("is_last"), "z.item.*", "z.inside", "z.kept")
    told = of_chosen(told)
    asked = F.array_distinct("told.kept")
    states = walked_rows.select(*keys, "sure", F.lit(by_level).alias("by_level"), F.when(F.col("part") > 0, asked).otherwise(F.array().cast("array<int>")).alias("asked"), "first", "end_levels", "end_names", "kept_at_end")
    begun = _begun(of_chosen(states).drop("_first", "way", "sure"))

    alone = F.col("_first") & ~F.col("is_last")
    place = F.array_position("asked", F.col("kept")).cast("int")
    prefix = F.when(place > 0, F.try_element_at("prefixes", place)).otherwise(F.array().cast("array<string>"))
    found = told.join(begun, ["run_id", "part"], "left").withColumn("path", F.when(alone, F.col("inside")).otherwise(F.concat(prefix, "inside")))
    if indent is not None:
        found = found.where(alone | ~F.col("is_last") | F.col("follows").isNull() | (F.col("follows") <= F.col("indent")))
    return found.drop("inside", "kept", "is_last", "way", "sure", "_first", "asked", "prefixes", "follows")


def with_level_paths(rows: DataFrame, chosen: DataFrame | None = None, leaves_by: str | None = None) -> DataFrame:
    """rows(run_id, part, items array<struct<level, name, wanted, ...>>) -> the wanted items, with the names they stand in (`path`).

    With several ways to read a part, rows has `way` and `sure`, and those that are not sure
    stay if `chosen` has them. With `leaves_by`, an item is wanted only if the next one
    (in whatever part) has no larger field of that name.
    """
    rows = rows if chosen is not None else rows.withColumns({"way": F.lit(""), "sure": F.lit(True)})
    indent = None
    if leaves_by:
        indent = F.col(f"items.{leaves_by}")
        follow = F.concat(F.slice(indent, 2, F.size("items")), F.array(F.lit(-1)))
        leaf = F.zip_with(F.col("items"), follow, lambda i, after: i.withField("wanted", i["wanted"] & (after <= i[leaves_by])))
        rows = rows.withColumn("items", leaf)
    walked = _walked(_by_level, F.col("items.level"), F.col("items.name"), F.col("items.wanted"))
    return _with_paths(rows, walked, chosen, indent, True)


def with_bracket_paths(rows: DataFrame) -> DataFrame:
    """rows(run_id, part, items array<struct<closes, opens, name, wanted, ...>>) -> the wanted items with their path."""
    rows = rows.withColumns({"way": F.lit(""), "sure": F.lit(True)})
    walked = _walked(_by_brackets, F.col("items.closes"), F.col("items.opens"), F.col("items.name"), F.col("items.wanted"))
    return _with_paths(rows, walked, None, None, False)
