"""Removal of lines that many sites share, by HyperLogLog sketches of sites per line.

Lines are compared by the hash of their trimmed text. Per line hash a sketch of
the sites merges by aggregation; where its estimate is near the threshold, the
sites are counted exactly. A line on at least `MIN_SITES` sites is boilerplate and
goes from every document but the first that has it (the smallest doc_id), so its
text is not lost to the corpus. Lines of fewer than `MIN_WORDS` words are left
alone: short sentences fall together by chance.

Edge cases: null and empty texts stay as they are; a null site counts as no
site; a text may lose all its lines and is then empty; a line that repeats in
its first document stays there once; rows that repeat (same id and text) are one document; with equal
smallest ids the smaller text hash is first; null ids come last; an empty table
gives no rows; further columns are passed through, and names that start with
_line_ are this module's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from runsift.llm.bitset import bitset, only_keys
from runsift.llm.common import saved

MIN_SITES, MIN_WORDS = 3, 4
#: Log2 of a sketch's size; its relative standard error is 1.04 / sqrt(size).
SKETCH = 12


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def shared_lines(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """All lines of enough words (_line_key, _line_at, line, site), stored; and of those on enough sites (line, keep_key, keep_at)."""
    key = F.xxhash64(id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), key.alias("_line_key"), F.col(site_col).cast("string").alias("site"), F.posexplode(lines_of(F.col(text_col))).alias("_line_at", "line"))
    rows = rows.withColumn("line", F.trim("line"))
    words = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    rows = saved(rows.where((F.col("line") != "") & (words >= min_words)).select("doc_id", "_line_key", "_line_at", F.xxhash64("line").alias("line"), "site"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_line_key", "_line_at"))
    spread = rows.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH))).alias("sites"), first.alias("first"))
    slack = max(1.0, 3 * 1.04 / 2 ** (SKETCH / 2) * min_sites)
    spread = saved(spread.where(F.col("sites") >= min_sites - slack).select("line", "sites", F.col("first._line_key").alias("keep_key"), F.col("first._line_at").alias("keep_at")))
    near = spread.where(F.col("sites") <= min_sites + slack)
    exact = rows.join(near.select("line"), "line", "left_semi").groupBy("line", "site").agg(F.lit(1).alias("one")).groupBy("line").agg(F.count("site").alias("exact"))
    sure = spread.where(F.col("sites") > min_sites + slack)
    counted = near.join(exact, "line").where(F.col("exact") >= min_sites)
    return rows, saved(sure.select("line", "keep_key", "keep_at").unionAll(counted.select("line", "keep_key", "keep_at")))


def without_shared_lines(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """The documents with shared lines removed; _line_removed counts them.

    Only documents that may lose lines, by a bit set of their keys, meet the decisions in a join.
    """
    rows, shared = shared_lines(docs, min_sites, min_words, id_col, text_col, site_col)
    gone = rows.join(shared, "line").where("not (_line_key = keep_key and _line_at = keep_at)")
    gone = saved(gone.groupBy("_line_key").agg(F.collect_set("_line_at").alias("_line_gone")))
    rows = docs.withColumn("_line_key", F.xxhash64(id_col, text_col))
    touched = bitset(gone, "_line_key")
    kept = F.filter(lines_of(F.col(text_col)), lambda _, i: ~F.array_contains("_line_gone", i))
    text = F.when(F.col("_line_gone").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    cut = only_keys(rows, "_line_key", touched).join(gone.hint("merge"), "_line_key", "left")
    cut = cut.withColumn(text_col, text).withColumn("_line_removed", F.coalesce(F.size("_line_gone"), F.lit(0))).drop("_line_key", "_line_gone")
    whole = only_keys(rows, "_line_key", touched, among=False).withColumn("_line_removed", F.lit(0)).drop("_line_key")
    return cut.unionByName(whole)
