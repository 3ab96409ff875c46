"""Files and folders in whatever store a path names."""

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path as it sees it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def path_exists(spark: SparkSession, path: str) -> bool:
    files, where = file_system(spark, path)
    return files.exists(where)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Folders directly below a path."""
    files, where = file_system(spark, path)
    return [str(f.getPath().toString()) for f in files.listStatus(where) if f.isDirectory()]
