"""Reading the state of a repository from the text a run reports."""

from pyspark.sql import Column, DataFrame, functions as F

from runsift.functions.text import LINE_END, strip

PREVIEW_LINES = 200


def repository_state(
    states: DataFrame,
    text: Column,
    begin: str = "STATUS_BEGIN",
    end: str = "STATUS_END",
    count: str = "CHANGED_ENTRY_COUNT=",
    digest: str = "TRACKED_DIFF_HASH=",
) -> DataFrame:
    """Add the changed files between the markers, their count and the diff hash.

    A missing marker gives an empty preview; of repeated lines the last usable
    one counts.
    """
    rows = states.withColumn("_lines", F.split(text, LINE_END))
    rows = rows.withColumn("_from", F.array_position("_lines", begin).cast("int"))
    after = F.when(F.col("_from") > 0, F.slice("_lines", F.col("_from") + 1, F.size("_lines")))
    rows = rows.withColumn("_after", F.coalesce(after, F.array().cast("array<string>")))
    stop = F.array_position("_after", end).cast("int")
    shown = F.when(stop > 0, F.slice("_after", F.lit(1), F.least(stop - 1, F.lit(PREVIEW_LINES))))

    def values(prefix: str) -> Column:
        lines = F.filter("_lines", lambda x: x.startswith(prefix))
        return F.transform(lines, lambda x: strip(F.substring(x, F.lit(len(prefix) + 1), F.char_length(x))))

    numbers = F.filter(F.transform(values(count), lambda x: x.try_cast("bigint")), lambda n: n.isNotNull())
    return rows.select(
        *states.columns,
        F.coalesce(shown, F.array().cast("array<string>")).alias("changed_files_preview"),
        F.try_element_at(numbers, F.lit(-1)).alias("changed_entry_count"),
        F.try_element_at(values(digest), F.lit(-1)).alias("tracked_diff_hash"),
    )
