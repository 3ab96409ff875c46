"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed hash; a source's budget is a threshold on it. Sizes are
summed by source and leading hash bits, which tells the bucket in which the budget
ends; only that bucket is summed again by the next bits, until its documents share
all 60 bits. A document then is taken or not by comparing its hash with the
threshold: nothing is sorted, a rerun takes the same documents, and a larger budget
takes all that a smaller one takes. A target above its source's size takes whole
rounds of the source first, and the threshold gives what is left of it.

The documents at the threshold itself share what is left in proportion to their
sizes (rounded down), so a source's taken words miss its target only by the target's
fraction and by less than a word for each row with that very hash.

Edge cases: null and blank texts have size 0 and are taken 0 times; a null source is
a source, the last one; null ids hash like empty text; repeated rows are documents
each, with one hash; sources without words have target 0; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from runsift.llm.common import saved

#: Bits of a hash and of one histogram: at most 4,096 sums for each source at a time.
BITS, STEP = 60, 12
#: A table of at most so many sources, and so many bytes of names, may be sent to every task.
SENT_ROWS, SENT_BYTES = 100_000, 8 << 20


def n_words(text: Column) -> Column:
    """Number of runs without blanks (space, tab to carriage return)."""
    bare = F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    counted = F.size(F.split(bare, r"[\x20\x09-\x0D]+"))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.lit(0)).otherwise(counted).cast("long")


def stable_hash(doc_id: Column) -> Column:
    """The first 60 bits of the MD5 of the id's decimal text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def numbered(sources: DataFrame) -> DataFrame:
    """Adds `place`: from 0, in order of code points, null last.

    Sources are dealt out by ranges; a place is the place within the range and
    the number of sources in ranges before it.
    """
    dealt = sources.repartitionByRange(F.col("source").isNull(), F.col("source"))
    dealt = saved(dealt.withColumn("deal", F.spark_partition_id()))
    inside = Window.partitionBy("deal").orderBy(F.col("source").asc_nulls_last())
    earlier = Window.orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    ranges = dealt.groupBy("deal").agg(F.count(F.lit(1)).alias("n"))
    ranges = ranges.select("deal", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return dealt.withColumn("row", F.row_number().over(inside) - 1).join(ranges, "deal").withColumn("place", F.col("before") + F.col("row")).drop("deal", "row", "before")


def with_targets(sources: DataFrame, most: int) -> DataFrame:
    """Adds `target` to sources(source, source_size, weight): all sizes shared by weight, none above `most` times its own.

    Each round stops the sources whose share is above that and shares anew among
    the others; only the two sums of a round reach the driver.
    """
    size, weight = F.col("source_size").cast("decimal(38,0)"), F.col("weight").cast("decimal(20,0)")
    total, weights = sources.agg(F.sum(size), F.sum(weight)).first()
    if total is None:
        return sources.withColumn("target", F.lit(0.0))
    share, among = int(total), int(weights)
    while True:
        above = size * most * among < F.lit(share).cast("decimal(38,0)") * weight
        stopped, lost = sources.where(above).agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum(weight), F.lit(0))).first()
        left = (int(total) - int(stopped) * most, int(weights) - int(lost))
        if left == (share, among):
            break
        share, among = left
    return sources.withColumn("target", F.when(above, (F.col("source_size") * most).cast("double")).otherwise(F.lit(float(share)) * F.col("weight") / F.lit(float(among))))


def thresholds(docs: DataFrame, budgets: DataFrame, first: DataFrame, near) -> DataFrame:
    """budgets(source, left) -> source, at, left, there: the hash at which each source's budget ends,
    what is left of it there, and the words that documents with that very hash hold."""
    state, sums, shift = budgets, first, BITS - STEP
    while True:
        upto = F.sum("size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        ends = sums.withColumn("upto", upto).join(near(state), sums["source"].eqNullSafe(state["source"])).drop(state["source"])
        ends = ends.where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("size") <= F.col("left")))
        state = saved(ends.select("source", F.col("bucket").alias("at"), (F.col("left") - F.col("upto") + F.col("size")).alias("left"), F.col("size").alias("there")))
        if shift == 0:
            return state
        within = docs.join(near(state.select(F.col("source").alias("of"), "at")), docs["source"].eqNullSafe(F.col("of")) & (F.shiftrightunsigned("hash", shift) == F.col("at")))
        docs = saved(within.select("source", "hash", "size"))
        shift -= STEP
        sums = docs.groupBy("source", F.shiftrightunsigned("hash", shift).alias("bucket")).agg(F.sum("size").alias("size"))


def mix(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """rows(doc_id, text, source) -> doc_id, source, size, source_size, target, taken.

    `weights` are dealt to the sources in their order, over and over; `taken` counts
    the words that the mix takes of a document, repeats included, at most `most`
    times its size.
    """
    docs = saved(rows.select("doc_id", "source", n_words(F.col("text")).alias("size"), stable_hash(F.col("doc_id")).alias("hash")))
    first = saved(docs.groupBy("source", F.shiftrightunsigned("hash", BITS - STEP).alias("bucket")).agg(F.sum("size").alias("size")))
    sources = numbered(first.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = saved(with_targets(saved(sources.withColumn("weight", weight)), most))
    n, name_bytes = sources.agg(F.count(F.lit(1)), F.sum(F.octet_length("source"))).first()
    near = F.broadcast if n <= SENT_ROWS and (name_bytes or 0) <= SENT_BYTES else (lambda table: table)

    words = F.round("target").cast("long")
    has_words = sources.where("source_size > 0")
    rounds = has_words.select("source", F.expr("cast(round(target) as bigint) div source_size").alias("rounds"), (words % F.col("source_size")).alias("left"))
    ends = thresholds(docs.where("size > 0").select("source", "hash", "size"), rounds.select("source", "left"), first, near)
    plan = sources.join(rounds.select(F.col("source").alias("of"), "rounds"), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    plan = plan.join(ends.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    plan = saved(plan.select(F.col("source").alias("of"), "source_size", "target", "rounds", "at", "left", "there"))
    found = docs.join(near(plan), F.col("source").eqNullSafe(F.col("of")), "left")
    at_end = F.expr("cast(size as decimal(19,0)) * cast(left as decimal(19,0)) div cast(there as decimal(19,0))")
    more = F.when(F.col("hash") < F.col("at"), F.col("size")).when(F.col("hash") == F.col("at"), at_end).otherwise(F.lit(0))
    taken = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("size") * F.col("rounds") + more).cast("long")
    return found.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))
