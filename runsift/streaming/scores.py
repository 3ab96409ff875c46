"""Scoring runs as their logs arrive, and keeping the latest verdicts."""

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from runsift.schema import RUNS
from runsift.sources.files import file_system, folders

#: Buckets of a table that is kept up to date, and of pieces that wait for each other.
BUCKETS = 64
#: A backlog is worked off in about as many batches, however large it is: each batch reads
#: the tasks, or the state of what came before, as a whole.
BATCHES = 8


def files_of_backlog(spark: SparkSession, path: str, least: int = 1, batches: int = BATCHES) -> int:
    """Files for each batch, so that all that wait in a folder are read in at most `batches` batches."""
    files, where = file_system(spark, path)
    waiting = sum(f.isFile() and f.getPath().getName()[0] not in "._" for f in files.listStatus(where))
    return max(least, -(-waiting // batches))


def stream_runs(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Runs that land as parquet files in a folder. A run arrives whole in one file."""
    reader = spark.readStream.schema(RUNS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def score_arrivals(
    runs: DataFrame, grade: Callable[[DataFrame], DataFrame], out: str, checkpoint: str
) -> StreamingQuery:
    """Grade each batch of new runs and write the rewards to `out`.

    Each batch overwrites a folder of its own, so a batch that is repeated
    after a failure leaves no second copy. The stream's checkpoint is the
    record of what has been scored.
    """

    def one_batch(batch: DataFrame, number: int) -> None:
        grade(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        runs.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def score_pieces(
    pieces: DataFrame, grade: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, patience: int = 100
) -> StreamingQuery:
    """Grade runs that arrive in pieces: rows of RUNS with `parts`, the number of parts of the run.

    Pieces stay where they were put, by bucket of the run; the state of a run is one row: which parts
    are there and since which batch it is open. A run is graded in the batch that
    completes it, from its own buckets. One that is open for `patience` batches
    is graded as it is, and parts of graded runs that arrive later go to `late` and change
    nothing. A batch that is repeated writes its own folders anew.
    Results: `out`/scores, with `complete`.
    """
    names = [c for c in pieces.columns]

    def one_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("bucket", F.pmod(F.xxhash64("run_id"), F.lit(BUCKETS))).write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/pieces/batch={number}")
        mine = spark.read.schema(batch.schema).option("basePath", f"{out}/pieces").parquet(f"{out}/pieces/batch={number}")
        seen = mine.groupBy("run_id").agg(F.max("parts").alias("parts"), F.collect_set("part").alias("seen"), F.lit(number).alias("since"))
        before = spark.read.parquet(f"{out}/open/batch={number - 1}") if number else seen.withColumn("graded", F.lit(False)).limit(0)
        known = before.select("run_id", F.col("parts").alias("b_parts"), F.col("seen").alias("b_seen"), F.col("since").alias("b_since"), "graded")
        nothing = F.array().cast("array<bigint>")
        state = known.join(seen, "run_id", "full").select(
            "run_id",
            F.coalesce(F.greatest("parts", "b_parts"), "parts", "b_parts").alias("parts"),
            F.array_union(F.coalesce("b_seen", nothing), F.coalesce("seen", nothing)).alias("seen"),
            F.coalesce("b_since", "since").alias("since"),
            F.coalesce("graded", F.lit(False)).alias("was"),
            F.col("seen").isNotNull().alias("touched"),
        )
        complete = F.size("seen") >= F.col("parts")
        due = ~F.col("was") & (complete | (F.col("since") + patience <= number))
        state = state.withColumns({"complete": complete, "due": due, "graded": F.col("was") | due})
        state.write.mode("overwrite").parquet(f"{out}/state/batch={number}")
        state = spark.read.parquet(f"{out}/state/batch={number}")
        state.select("run_id", "parts", "seen", "since", "graded").write.mode("overwrite").parquet(f"{out}/open/batch={number}")
        late = mine.join(state.where("was and touched").select("run_id"), "run_id", "left_semi")
        late.select("run_id", "part").write.mode("overwrite").parquet(f"{out}/late/batch={number}")

        ready = state.where("due").select("run_id", "complete", F.pmod(F.xxhash64("run_id"), F.lit(BUCKETS)).alias("bucket"))
        buckets = [r["bucket"] for r in ready.select("bucket").distinct().collect()]  # at most BUCKETS
        stored = spark.read.schema(batch.schema.add("bucket", "long").add("batch", "long")).option("basePath", f"{out}/pieces").parquet(f"{out}/pieces")
        stored = stored.where(F.col("bucket").isin(buckets) & (F.col("batch") <= number)).join(ready.select("run_id", "complete"), "run_id")
        graded = grade(stored.select(*names)).join(ready.select("run_id", "complete"), "run_id")
        graded.write.mode("overwrite").parquet(f"{out}/scores/batch={number}")

    return (
        pieces.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def keep_latest(results: DataFrame, out: str, checkpoint: str, keys: tuple[str, ...] = ("index",), buckets: int = BUCKETS) -> StreamingQuery:
    """Keep one row per key: the one with the greatest seq that has arrived.

    The table lies in hash buckets. A batch writes the buckets anew that it has rows
    for, into a folder of its own, and then a manifest that names the folder of every
    bucket; readers take the newest manifest. So a batch writes in proportion to what it
    touches, a repeated batch rewrites its own folder from the same input, and folders
    that no manifest names any longer can go (`remove_old`).
    """

    def one_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        rows = batch.withColumn("bucket", bucket)
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most `buckets`
        current = manifest(spark, out, number - 1) if number else {}
        old = [f"{out}/data/batch={current[b]}/bucket={b}" for b in touched if b in current]
        if old:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(*old).withColumn("bucket", bucket))
        newest = F.max_by(F.struct(*[c for c in batch.columns if c not in keys]), F.coalesce("seq", F.lit(-1))).alias("r")
        if touched:
            kept = rows.groupBy("bucket", *keys).agg(newest).select("bucket", *keys, "r.*")
            # One task writes a bucket: else every task would write a file in each.
            kept.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/data/batch={number}")
        named = {str(b): n for b, n in (current | dict.fromkeys(touched, number)).items()}
        spark.createDataFrame([(json.dumps(named),)], "value STRING").coalesce(1).write.mode("overwrite").text(f"{out}/manifests/batch={number}")

    return (
        results.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def manifest(spark: SparkSession, out: str, number: int) -> dict[int, int]:
    """The folder of every bucket after a batch: at most one entry for each bucket."""
    named = spark.read.text(f"{out}/manifests/batch={number}").first()["value"]
    return {int(b): n for b, n in json.loads(named).items()}


def newest_batch(spark: SparkSession, out: str) -> int:
    return max(int(p.rsplit("=", 1)[1]) for p in folders(spark, f"{out}/manifests") if "=" in p)


def latest_version(spark: SparkSession, out: str, batch: int | None = None) -> DataFrame:
    """The table that `keep_latest` has written, as of its newest batch or of a given one."""
    named = manifest(spark, out, newest_batch(spark, out) if batch is None else batch)
    return spark.read.parquet(*[f"{out}/data/batch={n}/bucket={b}" for b, n in named.items()])


def remove_old(spark: SparkSession, out: str) -> int:
    """Removes buckets that the newest manifest does not name; gives their number."""
    named = {f"batch={n}/bucket={b}" for b, n in manifest(spark, out, newest_batch(spark, out)).items()}
    old = [path for batch in folders(spark, f"{out}/data") for path in folders(spark, batch) if "bucket=" in path and "/".join(path.rsplit("/", 2)[1:]) not in named]
    for path in old:
        files, where = file_system(spark, path)
        files.delete(where, True)
    return len(old)
