"""Helpers that several operators share: stored intermediates, word tables, folds."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from runsift.session import shared_folder


#: Most bytes of a batch that goes from the JVM to Python; both sides hold some batches at a time.
BATCH_BYTES = 4 << 20
_MOST_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession):
    """While tables are written, workers get their rows in small batches, unless the session says how large they are."""
    if spark.conf.get(_MOST_BYTES, None) is not None:
        yield
        return
    spark.conf.set(_MOST_BYTES, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(_MOST_BYTES)


def _write(rows: DataFrame) -> tuple[DataFrame, str]:
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/rows-{uuid.uuid4().hex}"
    with small_batches(spark):
        rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path), path


def saved(rows: DataFrame) -> DataFrame:
    """Write rows to the cluster's shared folder and read them back.

    Cuts the lineage in a way that survives the loss of executors, and fixes the
    rows, so that a later pass sees the same ones.
    """
    return _write(rows)[0]


class Shelf:
    """Stored tables that are removed at the end of a step, as nothing reads them any more.

    What a step returns must be stored outside of its shelf, or not depend on it.
    """

    def __init__(self):
        self.tables: list[tuple[DataFrame, str]] = []

    def saved(self, rows: DataFrame) -> DataFrame:
        self.tables.append(_write(rows))
        return self.tables[-1][0]

    def only(self, *kept: DataFrame) -> None:
        """Removes all tables but these."""
        for table, path in self.tables:
            if not any(table is k for k in kept):
                spark = table.sparkSession
                folder = spark._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        self.tables = [(table, path) for table, path in self.tables if any(table is k for k in kept)]

    def __enter__(self) -> Shelf:
        return self

    def __exit__(self, *error) -> None:
        self.only()


def fold(doc_id: Column, n: int) -> Column:
    """The remainder of crc32 of the id's decimal text; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


#: Tables of this worker that can be computed anew; the first entry is the one in use.
_TABLES: list = []


def in_use(table) -> None:
    """A worker runs tasks of one stage after another; what an earlier stage knew is forgotten when another begins."""
    if not _TABLES or _TABLES[0] is not table:
        for other in _TABLES:
            if other is not table:
                other.clear()
        _TABLES[:] = [table]


class Memo(dict):
    """A table that computes missing values and forgets all of them when it is full.

    It bounds a worker's memory; what it holds never changes a result. One that
    outlives a task (`stays`) computes keys longer than LONG_KEY each time, and gives
    way to the tables of a later stage.
    """

    LONG_KEY = 100

    def __init__(self, make: Callable, limit: int, stays: bool = False):
        super().__init__()
        self.make, self.limit, self.stays = make, limit, stays

    def __missing__(self, key):
        if self.stays:
            if len(key) > self.LONG_KEY:
                return self.make(key)
            in_use(self)
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


def map_arrow(rows: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow for a function of single batches; batches without rows are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := function(batch)) is not None and out.num_rows:
                yield out

    return rows.mapInArrow(run, schema)


#: Rows of a batch that are Python objects at a time.
AT_A_TIME = 256


def values(column: pa.Array) -> Iterator:
    """A column's values in order, without a second copy of all its texts in memory."""
    for first in range(0, len(column), AT_A_TIME):
        yield from column.slice(first, AT_A_TIME).to_pylist()


def sample_ids(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """At most limit rows, those whose ids hash lowest: the same rows in every run.

    Only for fitting models; a top-k, so no task holds more than limit rows.
    """
    return rows.orderBy(F.xxhash64(key), key).limit(limit)


def stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
