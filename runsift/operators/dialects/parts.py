"""Context that reaches from one part of a log into later parts.

A part is read where it lies: within it, headers and gates are known. What its first
lines need from earlier parts is found from one small row for each part (its last
header, say, or whether it opened a gate), and joined to the few events that wait for
it. So no log text takes part in a shuffle, however a log was cut.
"""

from collections.abc import Iterator, Sequence
from itertools import accumulate
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from runsift.functions.binding import share
from runsift.functions.text import rx


class PartReader(Protocol):
    """Reads the logs of a batch of parts, one after the other."""

    #: Columns of what it finds: names and Arrow types.
    fields: tuple
    #: What it found, one row for each part; lists of records hold tuples.
    rows: list[tuple]

    def add(self, run_id: str | None, part: int | None, log: str) -> None: ...


def columns_of(found: PartReader) -> list[pa.Array]:
    columns = zip(*found.rows) if found.rows else [()] * len(found.fields)
    return [array_of(column, kind) for column, (_, kind) in zip(columns, found.fields)]


def array_of(values: Sequence, kind: pa.DataType) -> pa.Array:
    """An Arrow array; lists of records are laid out by column, which is faster than by record."""
    if not (pa.types.is_list(kind) and pa.types.is_struct(kind.value_type)):
        return pa.array(values, kind)
    flat = [record for each in values for record in each]
    columns = zip(*flat) if flat else [()] * kind.value_type.num_fields
    records = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind.value_type)], fields=list(kind.value_type))
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, values))], pa.int32()), records)


def read_parts(runs: DataFrame, *readers: type[PartReader]) -> DataFrame:
    """runs -> one small row for each part: run_id, part and what the readers find in its log.

    A log is taken up once for all readers, and the row is computed once for all that use it.
    """
    schema = pa.schema([("run_id", pa.string()), ("part", pa.int64()), *[field for reader in readers for field in reader.fields]])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [reader() for reader in readers]
            logs = batch.column("log")
            # Texts are made one at a time, so that a batch is not in memory twice.
            logs = logs.cast(pa.large_binary() if pa.types.is_large_string(logs.type) else pa.binary())
            for place, of in enumerate(zip(batch.column("run_id").to_pylist(), batch.column("part").to_pylist())):
                log = (logs[place].as_py() or b"").decode("utf-8", "replace")
                for each in found:
                    each.add(*of, log)
            columns = [batch.column("run_id"), batch.column("part"), *[array for each in found for array in columns_of(each)]]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return share(runs.select("run_id", "part", "log").mapInArrow(read, from_arrow_schema(schema)))


def from_earlier(runs: DataFrame, **values: Column) -> DataFrame:
    """(run_id, part, names of values...): the latest value that is not null of the parts before each part.

    Part 0 has none before it and is left out.
    """
    before = Window.partitionBy("run_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    told = runs.select("run_id", "part", *[value.alias(name) for name, value in values.items()])
    found = told.select("run_id", "part", *[F.last(name, ignorenulls=True).over(before).alias(name) for name in values])
    return found.where("part > 0")


def with_earlier(rows: DataFrame, name: str) -> DataFrame:
    """One small row for each part, with column `name` as the latest earlier part of the run has it; null in part 0 and where run or part are unknown."""
    before = Window.partitionBy("run_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    later = (F.col("part") > 0) & F.col("run_id").isNotNull()
    return rows.withColumn(name, F.last(name, ignorenulls=True).over(before)).withColumn(name, F.when(later, F.col(name)))


def from_next(runs: DataFrame, **values: Column) -> DataFrame:
    """(run_id, part, names of values...): the values of the part that follows, if there is one."""
    follow = Window.partitionBy("run_id").orderBy("part")
    told = runs.select("run_id", "part", *[value.alias(name) for name, value in values.items()])
    return told.select("run_id", "part", *[F.lead(name).over(follow).alias(name) for name in values])


def inherit(rows: DataFrame, runs: DataFrame, name: str, value: Column) -> DataFrame:
    """Fills column `name` where it is null: with the latest `value` of an earlier part of the run.

    Rows of part 0 and rows that have a value stay out of the join.
    """
    rows = share(rows)
    waits = F.col(name).isNull() & (F.col("part") > 0)
    given = rows.where(waits).drop(name).join(from_earlier(runs, **{name: value}), ["run_id", "part"], "left")
    return rows.where(~waits).unionByName(given)


def last_like(text: Column, line: str) -> Column:
    """The last line of a text that a pattern describes from its start; null if none does."""
    found = F.regexp_extract(text, rx(rf"\A(?s:.*)^({line})", lines=True), 1)
    return F.nullif(found, F.lit(""))


def has_line(text: Column, line: str) -> Column:
    """Whether a pattern describes the start of a line."""
    return text.rlike(rx(rf"^{line}", lines=True))
