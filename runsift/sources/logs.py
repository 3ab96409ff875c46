"""Raw log files as runs."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Lines of one part of a log.
PART_LINES = 50_000
#: Bits of a part's number that count within a block of its file.
WITHIN = 20


def read_logs(spark: SparkSession, folder: str, suffix: str = ".log", part_lines: int = PART_LINES) -> DataFrame:
    """Files below a folder -> runs(run_id, parser, ..., part, log).

    The run is the file's name without its suffix; further columns come from
    folders named `column=value`, `parser` and `instance_id` among them. Bytes that
    are no UTF-8 become replacement characters. A file of any size is read in
    parts, cut between lines, where its blocks lie: nothing is shuffled. Numbers of parts grow
    along a file, the first is 0.
    """
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "false").text(folder)
    names = [c for c in lines.columns if c != "value"]
    path = F.col("_metadata.file_path")
    run_id = F.regexp_extract(F.url_decode(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\\+", "%2B")), r"^(.*?)(?:" + suffix.replace(".", "[.]") + r")?$", 1)
    rows = lines.select(run_id.alias("run_id"), F.col("_metadata.file_block_start").alias("block"), F.make_valid_utf8("value").alias("value"), *[F.col(c).cast("string").alias(c) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, number = None, [], 0

        def part() -> pa.RecordBatch:
            run_id, block, *rest = now
            columns = [[run_id], [(block << WITHIN) + number], ["\n".join(held) + "\n"], *[[x] for x in rest]]
            kinds = [pa.string(), pa.int64(), pa.string(), *[pa.string() for _ in rest]]
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["run_id", "part", "log", *names])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for run_id, block, value, *rest in zip(*columns):
                here = (run_id, block, *rest)
                if here != now or len(held) >= part_lines:
                    if held:
                        yield part()
                    number = number + 1 if here == now else 0
                    now, held = here, []
                held.append(value)
        if held:
            yield part()

    schema = "run_id string, part long, log string" + "".join(f", `{c}` string" for c in names)
    return rows.mapInArrow(run, schema)
