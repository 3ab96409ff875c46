"""How runs are stored so that reading them prunes well."""

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_runs(runs: DataFrame, path: str, mode: str = "append") -> None:
    """Store runs by parser: reading one dialect then opens its folders only.

    Rows are rebalanced by parser: a parser that most runs use is split by size.
    """
    runs.hint("rebalance", F.col("parser")).write.mode(mode).partitionBy("parser").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
