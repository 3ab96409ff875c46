"""Choosing tasks: ranges, shards, caps, samples."""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from runsift.functions.tasks import image_cache_key

# Tasks and ranges meet in blocks of 65,536 ids.
BLOCK_BITS = 16
# Slices of a key that are ranked on their own.
SLICES = 64


def parse_ranges(spark: SparkSession, spec: str) -> DataFrame:
    """`1,3-8,12` -> ranges(lo, hi), inclusive. Negative or reversed ones are errors."""
    found = []
    for item in (piece.strip() for piece in spec.split(",")):
        if not item:
            continue
        low, dash, high = item.partition("-")
        lo, hi = int(low), int(high) if dash else int(low)
        if lo < 0 or hi < lo:
            raise ValueError(f"invalid index range: {item!r}")
        found.append((lo, hi))
    return spark.createDataFrame(found, "lo BIGINT, hi BIGINT")


def reversed_ranges(ranges: DataFrame) -> DataFrame:
    """Ranges that cannot be meant: negative or ending before they start."""
    return ranges.where((F.col("lo") < 0) | (F.col("hi") < F.col("lo")))


def in_ranges(tasks: DataFrame, ranges: DataFrame, key: str = "public_index") -> DataFrame:
    """Tasks inside at least one range, each once.

    A task is inside if the farthest end of all ranges that start at or below it
    reaches it. Tasks and starts of ranges meet in blocks of ids, where that end is
    a running maximum; what reaches into a block from below is one row for each
    block. So a task is shuffled once, however many and wide the ranges are.
    """
    block = lambda at: F.shiftright(at, BLOCK_BITS)
    ids = F.col(key).cast("bigint")
    starts = ranges.select(F.greatest("lo", F.lit(0)).cast("bigint").alias("_at"), F.col("hi").cast("bigint").alias("_to")).where("_at <= _to")
    starts = starts.groupBy("_at").agg(F.max("_to").alias("_to")).withColumn("_block", block(F.col("_at")))
    blocks = tasks.where(ids >= 0).select(block(ids).alias("_block")).distinct().withColumn("_to", F.lit(None).cast("bigint"))
    blocks = blocks.unionByName(starts.select("_block", "_to")).groupBy("_block").agg(F.max("_to").alias("_to"))
    below = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each block
    from_below = blocks.select("_block", F.lit(-1).cast("bigint").alias("_at"), F.max("_to").over(below).alias("_to"))
    placed = tasks.where(ids >= 0).withColumns({"_at": ids, "_block": block(ids), "_task": F.lit(True)})
    both = placed.unionByName(starts.unionByName(from_below), allowMissingColumns=True)
    so_far = Window.partitionBy("_block").orderBy("_at", F.col("_task").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = both.withColumn("_to", F.max("_to").over(so_far)).where("_task and _to >= _at")
    return reached.select(*tasks.columns)


def out_of_range(ranges: DataFrame, total: int, show: int = 10) -> DataFrame:
    """The smallest `show` distinct ids of the ranges that the catalogue lacks.

    Of each range only its first `show` such ids can be among them.
    """
    first = F.greatest(F.col("lo"), F.lit(total).cast("bigint"))
    beyond = ranges.where(F.col("hi") >= total).select(
        F.explode(F.sequence(first, F.least(F.col("hi"), first + (show - 1)))).alias("id")
    )
    return beyond.distinct().orderBy("id").limit(show)


def modulo_shard(tasks: DataFrame, shard: int, shards: int, key: str = "public_index", most: int | None = None) -> DataFrame:
    """Every `shards`-th task, then at most `most` of them in order."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    if not 0 <= shard < shards:
        raise ValueError(f"shard must be in 0..{shards - 1}; got {shard}")
    if most is not None and most < 1:
        raise ValueError("most must be at least 1")
    mine = tasks.where(F.col(key) % shards == shard)
    return mine if most is None else mine.orderBy(key).limit(most)


def stratum(language: Column) -> Column:
    return F.coalesce(F.nullif(language, F.lit("")), F.lit("unknown"))


def stratified_sample(tasks: DataFrame, per_language: int | None, seed: int = 0, key: str = "public_index") -> DataFrame:
    """At most `per_language` tasks of each language, the same ones for a seed.

    Tasks are drawn in the order of a seeded hash. They are ranked within
    slices of each language first, so that only `per_language` rows of each
    slice meet in one task, however common a language is.
    """
    if per_language is not None and per_language < 1:
        raise ValueError("per_language must be at least 1")
    named = tasks.withColumn("stratum", stratum(F.col("language")))
    if per_language is None:
        return named
    order = (F.xxhash64(F.lit(seed), F.col(key)), F.col(key))
    return first_of_each(named, ("stratum",), order, per_language, F.col(key), "_n").drop("_n")


def first_of_each(rows: DataFrame, keys: tuple[str, ...], order: tuple[Column, ...], limit: int, spread: Column, number: str) -> DataFrame:
    """The first `limit` rows of each key, numbered from 1.

    First within SLICES slices by the hash of `spread`, then among what is
    left, so one key's rows need not all sort in one task.
    """
    sliced = rows.withColumn("_slice", F.pmod(F.hash(F.lit(17), spread), F.lit(SLICES)))
    some = sliced.withColumn(number, F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*order)))
    some = some.where(F.col(number) <= limit).drop(number, "_slice")
    return some.withColumn(number, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(number) <= limit)


def cached_only(tasks: DataFrame, listing: DataFrame, reference: Column) -> DataFrame:
    """Tasks whose image is in the cache listing(file_key, size) and not empty."""
    present = listing.where(F.col("size") > 0).select(F.col("file_key").alias("_key"))
    return tasks.withColumn("_key", image_cache_key(reference)).join(present, "_key", "left_semi").drop("_key")
