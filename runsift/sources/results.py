"""Result logs: JSON lines that grow from run to run.

A log is a folder. Every write has a folder of its own in it (`write=<id>`), which
counts once a commit record names it; the number of the record gives the order of
the writes. A write that fails, or is repeated with the same id, leaves no second
copy, and records stay as the caller wrote them. Folders without commit records,
written by others, are read as they are, in the order of their files' names.
"""

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from runsift.functions.binding import bind
from runsift.functions.variants import as_index, is_true
from runsift.sources.files import file_system

COMMITS = "_commits"


def committed(spark: SparkSession, path: str) -> dict[str, int]:
    """Ids of the writes that count, with their numbers; one small record for each."""
    files, where = file_system(spark, f"{path}/{COMMITS}")
    if not files.exists(where):
        return {}
    names = [f.getPath().getName() for f in files.listStatus(where)]
    return {name.split("-", 1)[1]: int(name.split("-", 1)[0]) for name in names if "-" in name}


def _commit(spark: SparkSession, path: str, write_id: str) -> None:
    """Takes the next free number, which only one writer can create, and names the write with it.

    A writer that is lost in between leaves a number that is never used.
    """
    number = max(committed(spark, path).values(), default=-1) + 1
    while True:
        files, where = file_system(spark, f"{path}/{COMMITS}/{number:012d}")
        try:
            files.create(where, False).close()
            break
        except Exception as error:
            if "exist" not in str(error).lower():
                raise
            number += 1
    files, where = file_system(spark, f"{path}/{COMMITS}/{number:012d}-{write_id}")
    files.create(where, False).close()


def write_results(records: DataFrame, path: str, resume: bool = False, write_id: str | None = None) -> None:
    """One JSON object per line with sorted fields; appended on resume, else in place of what is there.

    With a `write_id` of the caller's (letters, digits and dashes) a repeated
    write finds that it has been done.
    """
    spark, write_id = records.sparkSession, write_id or uuid.uuid4().hex
    if not resume:
        files, where = file_system(spark, path)
        files.delete(where, True)
    elif write_id in committed(spark, path):
        return
    records.select(sorted(records.columns)).write.mode("overwrite").json(f"{path}/write={write_id}")
    _commit(spark, path, write_id)


def parse_results(lines: DataFrame) -> DataFrame:
    """lines(value, ...) -> (index, valid, seq, ...); unusable lines are left out.

    A line counts if it is an object whose `index` is a whole number, a number
    to cut, or digits. `valid` is read as a truth value. `seq` orders the
    records, since distributed files have no line numbers.
    """
    kept = [c for c in lines.columns if c != "value"]
    rows = bind(lines, r=F.try_parse_json("value"))
    rows = bind(
        rows,
        *kept,
        "r",
        i=F.try_variant_get("r", "$.index", "variant"),
        v=F.try_variant_get("r", "$.valid", "variant"),
        seq=F.try_variant_get("r", "$.seq", "bigint"),
    )
    rows = bind(rows, i_kind=F.schema_of_variant("i"), v_kind=F.schema_of_variant("v"))
    rows = bind(
        rows,
        index=as_index(F.col("i"), F.col("i_kind")),
        valid=is_true(F.col("v"), F.col("v_kind")),
    )
    return rows.where(F.col("index").isNotNull()).select(*kept, "index", "valid", "seq")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The records of a log, with `place`: number of the write, file, line.

    A line's place in its file is the block that it lies in and its number within.
    """
    order = committed(spark, path)
    source = spark.read.option("basePath", path) if order else spark.read
    lines = source.text([f"{path}/write={write_id}" for write_id in order] if order else path)
    name = F.col("_metadata.file_path")
    numbers = F.from_json(F.lit(json.dumps(order)), "map<string, bigint>")
    write = F.element_at(numbers, F.regexp_extract(name, "/write=([^/]+)/", 1)) if order else F.lit(0)
    place = F.struct(write.cast("bigint").alias("write"), name.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return parse_results(lines.select("value", place.alias("place")))


def latest_results(results: DataFrame) -> DataFrame:
    """The last record of each index: by `seq`, and where there is none by `place`."""
    order = F.struct(F.coalesce("seq", F.lit(-1)), *[c for c in ("place",) if c in results.columns])
    return results.groupBy("index").agg(F.max_by("valid", order).alias("valid"))


def run_summary(selected: DataFrame, results: DataFrame) -> DataFrame:
    """selected(index), latest results -> selected, completed, invalid in one row."""
    joined = selected.select("index").join(results.select("index", "valid"), "index", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("selected"),
        F.count("valid").alias("completed"),
        F.count_if(~F.col("valid")).alias("invalid"),
    )


def pending(selected: DataFrame, results: DataFrame) -> DataFrame:
    """Selected tasks without a record: what a resumed run has to do."""
    return selected.join(results.select("index"), "index", "left_anti")


def write_summary(summary: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").json(path)
