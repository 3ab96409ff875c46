"""Streaming queries: logs land as files and are scored as they arrive."""

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from runsift.operators.conflicts import normalize_results
from runsift.operators.extract import extract_test_results
from runsift.operators.scoring import expected_vs_observed, score_counts, with_reward
from runsift.schema import RUNS
from runsift.session import shared_folder
from runsift.streaming.scores import files_of_backlog, keep_latest, latest_version, remove_old, score_arrivals, score_pieces, stream_runs
from runsift.sources.logs import read_logs
from runsift.workload.catalogue import SQL_LATEST, result_lines
from runsift.sources.results import parse_results
from runsift.workload.registry import entry, table
from runsift.workload.rendering import fill

# Rows of a file that lands: the number of files grows with the data, that of batches does up to a bound.
FILE_ROWS = 5000
PIECE_ROWS = 50_000
# A customer is a task and an order of the customer a run with one log line.


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@entry(
    "incremental_scores",
    """select 'order-' || o_orderkey as run_id, case when o_orderstatus = 'F' then 0 else 1 end::bigint as f2p_passed, 1::bigint as f2p_total,
      case when o_orderstatus = 'F' then 0.0::double else 1.0::double end as reward from orders""",
)
def _(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "FAIL").otherwise("PASS")
    values = {"word": status, "name": F.col("o_custkey")}
    runs = orders.select(
        F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("run_id"),
        F.col("o_custkey").cast("string").alias("instance_id"),
        F.lit("gotest").alias("parser"),
        F.lit(0).cast("bigint").alias("part"),
        fill("=== RUN\n--- {word}: Test{name} (0.01s)\n", values).alias("log"),
        F.lit(0).alias("exit_code"),
    )
    landing, out, checkpoint = (fresh(spark, n) for n in ("landing", "scores", "progress"))
    runs.write.option("maxRecordsPerFile", FILE_ROWS).parquet(landing)
    expected = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("instance_id"), F.lit("F2P").alias("grp"), F.lit(0).alias("pos"),
        F.concat(F.lit("Test"), F.col("c_custkey").cast("string")).alias("raw_id"),
    ).withColumn("norm_id", F.col("raw_id"))

    def grade(batch: DataFrame) -> DataFrame:
        results = normalize_results(extract_test_results(batch, ["gotest"]), 2)
        facts = batch.select("run_id", "instance_id", "exit_code").distinct()
        seen = expected_vs_observed(facts, expected, results)
        return with_reward(score_counts(seen, ("run_id", "exit_code")))

    score_arrivals(stream_runs(spark, landing, files_of_backlog(spark, landing)), grade, out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select("run_id", "f2p_passed", "f2p_total", "reward")


@entry("incremental_latest", f"select * from {SQL_LATEST}")
def _(spark, sf_dir):
    landing, out, checkpoint = (fresh(spark, n) for n in ("records", "latest", "progress"))
    parse_results(result_lines(spark, sf_dir)).write.option("maxRecordsPerFile", FILE_ROWS).parquet(landing)
    arriving = spark.readStream.schema("index BIGINT, valid BOOLEAN, seq BIGINT").option("maxFilesPerTrigger", files_of_backlog(spark, landing)).parquet(landing)
    keep_latest(arriving, out, checkpoint).awaitTermination()
    remove_old(spark, out)
    return latest_version(spark, out).select("index", "valid")


@entry(
    "incremental_pieces",
    """select 'order-' || o_orderkey as run_id, case when o_orderstatus = 'F' then 1 else 2 end::bigint as f2p_passed, 2::bigint as f2p_total, true as complete
      from orders""",
)
def _(spark, sf_dir):
    # Every run is cut into three pieces, and pieces land in three rounds: a suite's name, its first test, its second one.
    orders = table(spark, sf_dir, "orders")
    name = F.col("o_custkey").cast("string")
    texts = (F.concat(F.lit("Suite"), name, F.lit(" (App)\n")), F.lit(" \u2714 first [1 ms]\n"), F.concat(F.lit(" "), F.when(F.col("o_orderstatus") == "F", "\u2718").otherwise("\u2714"), F.lit(" second\n")))
    landing, out, checkpoint = (fresh(spark, n) for n in ("landing", "scores", "progress"))
    for part, text in enumerate(texts):
        piece = orders.select(
            F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("run_id"), name.alias("instance_id"), F.lit("phpunit").alias("parser"),
            F.lit(part).cast("bigint").alias("part"), text.alias("log"), F.lit(0).alias("exit_code"), F.lit(len(texts)).alias("parts"),
        )
        piece.write.mode("append").option("maxRecordsPerFile", PIECE_ROWS).parquet(landing)
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("instance_id"))
    expected = customers.select("instance_id", F.lit("F2P").alias("grp"), F.posexplode(F.transform(F.array(F.lit("first"), F.lit("second")), lambda t: F.concat(F.lit("Suite"), F.col("instance_id"), F.lit(" > "), t))).alias("pos", "raw_id")).withColumn("norm_id", F.col("raw_id"))

    def grade(runs: DataFrame) -> DataFrame:
        results = normalize_results(extract_test_results(runs, ["phpunit"]), 2)
        facts = runs.select("run_id", "instance_id", "exit_code").distinct()
        return with_reward(score_counts(expected_vs_observed(facts, expected, results), ("run_id", "exit_code")))

    arriving = spark.readStream.schema(RUNS + ", parts INT").option("maxFilesPerTrigger", files_of_backlog(spark, landing, least=4)).parquet(landing)
    score_pieces(arriving, grade, out, checkpoint).awaitTermination()
    return spark.read.parquet(f"{out}/scores").select("run_id", "f2p_passed", "f2p_total", "complete")


@entry("raw_logs", "select 'file-' || (o_custkey % 64) as run_id, count(*) filter (where o_orderstatus = 'F') as failed, count(*) as tests from orders group by 1")
def _(spark, sf_dir):
    # Orders of a customer group are the lines of one log file, in a folder named for their parser.
    orders = table(spark, sf_dir, "orders")
    folder = fresh(spark, "logs")
    word = F.when(F.col("o_orderstatus") == "F", "FAIL").otherwise("PASS")
    line = F.concat(F.lit("--- "), word, F.lit(": T"), F.col("o_orderkey").cast("string"), F.lit(" (0.01s)"))
    lines = orders.select(line.alias("value"), F.lit("gotest").alias("parser"), F.concat(F.lit("file-"), (F.col("o_custkey") % 64).cast("string")).alias("run"))
    lines.repartition("run").write.partitionBy("parser", "run").text(folder)
    runs = read_logs(spark, folder).withColumn("run_id", F.col("run"))
    found = extract_test_results(runs, ["gotest"])
    return found.groupBy("run_id").agg(F.count_if(F.col("status") == "FAILED").alias("failed"), F.count(F.lit(1)).alias("tests"))
