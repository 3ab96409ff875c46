"""The task catalogue: sharded parquet, row numbers, the index of usable tasks."""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from runsift.functions.binding import bind
from runsift.functions.commands import coerce_commands
from runsift.functions.variants import as_text
from runsift.sources.files import path_exists

# Rows of one file that are numbered together.
BLOCK_ROWS = 65_536


def read_tasks(spark: SparkSession, folder: str, fallback: str | None = "data/data.parquet") -> DataFrame:
    """`data.parquet` alone if the folder has one, else every parquet file below it."""
    if path_exists(spark, f"{folder}/data.parquet"):
        return spark.read.parquet(f"{folder}/data.parquet")
    if fallback is not None and not path_exists(spark, folder):
        return spark.read.parquet(fallback)
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(folder)


def shard_layout(rows: DataFrame) -> DataFrame:
    """(path, num_rows, offset) per file, in path order; reads no columns.

    The running sum is over one row per file. Paths are ordered folder by
    folder, as a directory walk lists them.
    """
    files = rows.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("num_rows"))
    before = Window.orderBy(F.split("path", "/")).rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("offset", F.coalesce(F.sum("num_rows").over(before), F.lit(0)))


def with_raw_index(rows: DataFrame) -> DataFrame:
    """Number rows from 0 in shard order: shard offset + place in the file.

    The layout has one row per file, as the driver's own list of files has; it is
    broadcast, because by path all rows of a file would meet in one task.
    """
    layout = shard_layout(rows).select(F.col("path").alias("_path"), F.col("offset").alias("_offset"))
    placed = rows.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row"))
    joined = placed.join(F.broadcast(layout), "_path")
    return joined.withColumn("raw_index", F.col("_offset") + F.col("_row")).drop("_path", "_row", "_offset")


def config_columns(tasks: DataFrame) -> DataFrame:
    """Add `commands`, `log_parser`, `config_kind`, `cmd_kind` from install_config.

    install_config is JSON text or a struct; test_cmd is a string or a list.
    The kinds tell an object from other values and from broken text. Each JSON
    text is parsed once per row.
    """
    kind = tasks.schema["install_config"].dataType
    if isinstance(kind, StructType):
        config = F.to_variant_object(F.col("install_config"))
    else:
        config = F.try_parse_json("install_config")
    rows = bind(tasks, _config=config)
    rows = bind(
        rows,
        _cmd=F.try_variant_get("_config", "$.test_cmd", "variant"),
        _parser=F.try_variant_get("_config", "$.log_parser", "variant"),
        config_kind=F.when(F.col("install_config").isNull(), "VOID")
        .when(F.col("_config").isNull(), "BROKEN")
        .when(F.schema_of_variant("_config").startswith("OBJECT"), "OBJECT")
        .otherwise("OTHER"),
    )
    rows = bind(rows, cmd_kind=F.schema_of_variant("_cmd"))
    rows = bind(
        rows,
        commands=coerce_commands(F.col("_cmd"), F.col("cmd_kind")),
        log_parser=F.when(F.schema_of_variant("_parser") == "STRING", as_text(F.col("_parser"))),
    )
    return rows.drop("_config", "_cmd", "_parser")


def is_usable() -> Column:
    """The config is an object with at least one command."""
    return (F.col("config_kind") == "OBJECT") & F.col("commands").isNotNull()


def test_list(raw: Column) -> Column:
    """Names in the JSON text of a list; null gives an empty list.

    Broken text raises, as reading the task does; `lists_are_sound` finds such
    rows beforehand.
    """
    parsed = F.from_json(F.nullif(F.trim(raw), F.lit("null")), "array<string>", {"mode": "FAILFAST"})
    return F.coalesce(parsed, F.array().cast("array<string>"))


def lists_are_sound(raw: Column) -> Column:
    value = F.try_parse_json(raw)
    kind = F.schema_of_variant(value)
    return raw.isNull() | F.coalesce(kind.startswith("ARRAY") | (kind == "VOID"), F.lit(False))


def normalize_tasks(tasks: DataFrame, quarantine: bool = False) -> DataFrame:
    """Make the two test lists arrays, whatever form they are stored in.

    With `quarantine`, rows whose lists are broken get empty lists and are
    marked in `broken_lists` instead of failing the query.
    """
    sound = F.lit(True)
    for name in ("FAIL_TO_PASS", "PASS_TO_PASS"):
        if name not in tasks.columns:
            continue
        if tasks.schema[name].dataType.typeName() == "string":
            good = lists_are_sound(F.col(name))
            sound = sound & good
            tasks = tasks.withColumn(f"_{name}", test_list(F.when(good, F.col(name)) if quarantine else F.col(name)))
        else:
            empty = F.array().cast("array<string>")
            tasks = tasks.withColumn(f"_{name}", F.coalesce(F.col(name), empty))
    if quarantine:
        tasks = tasks.withColumn("broken_lists", ~sound)
    for name in ("FAIL_TO_PASS", "PASS_TO_PASS"):
        if f"_{name}" in tasks.columns:
            tasks = tasks.withColumn(name, F.col(f"_{name}")).drop(f"_{name}")
    return tasks


def valid_tasks(tasks: DataFrame) -> DataFrame:
    """Tasks whose config is an object with at least one command."""
    return config_columns(tasks).where(is_usable())


def task_index(tasks: DataFrame) -> DataFrame:
    """(public_index, raw_index) of the usable tasks, dense and in raw order.

    Usable rows are counted per block of a file; block counts are summed up
    within each file and file counts over the files, so the only window over
    rows works on one block of at most BLOCK_ROWS rows.
    """
    placed = tasks.select(
        "install_config",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.row_index").alias("row"),
        F.floor(F.col("_metadata.row_index") / BLOCK_ROWS).cast("bigint").alias("block"),
    )
    flagged = config_columns(placed).select("path", "block", "row", is_usable().alias("usable"))
    blocks = flagged.groupBy("path", "block").agg(F.count_if("usable").alias("used"), F.count(F.lit(1)).alias("rows"))
    files = blocks.groupBy("path").agg(F.sum("used").alias("file_used"), F.sum("rows").alias("file_rows"))
    earlier_files = Window.orderBy(F.split("path", "/")).rowsBetween(Window.unboundedPreceding, -1)
    files = files.select(
        "path",
        F.coalesce(F.sum("file_used").over(earlier_files), F.lit(0)).alias("file_public"),
        F.coalesce(F.sum("file_rows").over(earlier_files), F.lit(0)).alias("file_raw"),
    )
    earlier_blocks = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("block_public", F.coalesce(F.sum("used").over(earlier_blocks), F.lit(0)))
    offsets = blocks.join(files, "path").select(
        "path", "block", (F.col("file_public") + F.col("block_public")).alias("public"), "file_raw"
    )
    in_block = Window.partitionBy("path", "block").orderBy("row")
    numbered = flagged.where("usable").withColumn("n", F.row_number().over(in_block) - 1)
    return numbered.join(offsets, ["path", "block"]).select(
        (F.col("public") + F.col("n")).alias("public_index"), (F.col("file_raw") + F.col("row")).alias("raw_index")
    )


def index_totals(tasks: DataFrame) -> DataFrame:
    """Number of rows and of usable rows."""
    return config_columns(tasks.select("install_config")).agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(is_usable()).alias("num_valid")
    )


def write_index(index: DataFrame, path: str) -> None:
    index.write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str, total_rows: int) -> DataFrame:
    """Read an index; numbers outside the catalogue make it unusable."""
    index = spark.read.parquet(path)
    if "raw_index" not in index.columns:
        raise ValueError(f"{path} does not contain raw indexes")
    low, high = index.agg(F.min("raw_index"), F.max("raw_index")).first()
    if low is not None and (low < 0 or high >= total_rows):
        raise ValueError(f"{path} contains indexes outside 0..{total_rows - 1}")
    return index


def with_public_index(tasks: DataFrame, index: DataFrame) -> DataFrame:
    """Tasks that carry raw_index, joined with their public number."""
    return tasks.join(index, "raw_index")


def task_at(tasks: DataFrame, public_index: int, columns: list[str]) -> DataFrame:
    """Chosen columns of one task; the scan reads only these and the key."""
    if not columns:
        raise ValueError("columns must not be empty")
    return tasks.where(F.col("public_index") == public_index).select(*columns)


def selected_tasks(tasks: DataFrame, wanted: DataFrame, key: str = "raw_index") -> DataFrame:
    """Tasks whose number is wanted. Spark broadcasts the numbers if they are few."""
    return tasks.join(wanted.select(key), key, "left_semi")
