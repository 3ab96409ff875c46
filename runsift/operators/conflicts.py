"""Settling repeated sightings of a test."""

from pyspark.sql import Column, DataFrame, functions as F

from runsift.functions.text import normalize_test_name
from runsift.schema import ERROR, FAILED, PASSED, SKIPPED

SEVERITY = {PASSED: 0, SKIPPED: 0, FAILED: 1, ERROR: 2}
PRECEDENCE = {PASSED: 0, SKIPPED: 1, FAILED: 2, ERROR: 3}
POLICIES = ("last", "first", "override", "severity", "precedence")


def settle(events: DataFrame) -> DataFrame:
    """Events -> one row per (run_id, test_id) with its status and first place.

    The highest prio wins, then the last or first place by the event's sign.
    One aggregate with map-side combining serves all dialects, so a test that
    is seen millions of times costs one partial row per task.
    """
    sign = F.col("sign")
    rank = F.struct(
        F.col("prio"), (sign * F.col("reading")).alias("reading"), (sign * F.col("part")).alias("part"), (sign * F.col("seq")).alias("seq"), (sign * F.col("sub")).alias("sub")
    )
    return events.groupBy("run_id", "test_id").agg(
        F.max(F.struct(rank.alias("rank"), F.col("status"))).getField("status").alias("status"),
        F.min(F.struct("reading", "part", "seq", "sub")).alias("first_pos"),
    )


def _rank(status: Column, ranks: dict[str, int]) -> Column:
    chosen = None
    for name, value in ranks.items():
        chosen = (F if chosen is None else chosen).when(status == name, value)
    return chosen.otherwise(-1)


def dedupe(
    sightings: DataFrame, policy: str, keys: tuple[str, ...] = ("run_id", "test_id"), order: str = "seq", status: str = "status"
) -> DataFrame:
    """One status per key under a policy, for any table of sightings.

    last / first: by order. override: a pass never replaces anything and
    anything else always replaces. severity: only a strictly worse status
    replaces. precedence: an equal or worse status replaces.
    `order` must be a number that is unique within a key.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy: {policy!r}")
    state, place = F.col(status), F.col(order)
    if policy == "last":
        best = F.max_by(state, place)
    elif policy == "first":
        best = F.min_by(state, place)
    elif policy == "override":
        best = F.coalesce(F.max_by(state, F.when(state != PASSED, place)), F.lit(PASSED))
    elif policy == "severity":
        best = F.max_by(state, F.struct(_rank(state, SEVERITY).alias("r"), (-place).alias("p")))
    else:
        best = F.max_by(state, F.struct(_rank(state, PRECEDENCE).alias("r"), place.alias("p")))
    return sightings.groupBy(*keys).agg(best.alias(status))


def normalize_results(results: DataFrame, passes: int = 1) -> DataFrame:
    """Re-key results by normalised name.

    Names that fall together keep the status of the raw name that was first
    seen last, even where another raw name was updated later; so the place of
    the first sighting travels with every row. Each pass is its own step.

    Every step combines before it shuffles, so thousands of raw names that
    differ in their timing only do not gather in one task. The last one leaves
    the rows partitioned by (run_id, name), as the join with the expected tests
    needs them.
    """
    rows = results.withColumn("final_id", normalize_test_name(F.col("test_id"), passes))
    for left in reversed(range(passes)):
        # After the last pass the name is the final one.
        keys = ["run_id", "final_id"]
        if left:
            # Most names are final after one pass; null says so, and no name travels twice.
            name = normalize_test_name(F.coalesce("test_id", "final_id"))
            rows = rows.withColumn("test_id", F.nullif(name, F.col("final_id")))
            keys.append("test_id")
        rows = rows.groupBy(*keys).agg(
            F.max(F.struct("first_pos", "status")).getField("status").alias("status"),
            F.min("first_pos").alias("first_pos"),
        )
    return rows.select("run_id", F.col("final_id").alias("test_id"), "status", "first_pos")


def first_source_wins(*sources: DataFrame, keys: tuple[str, ...] = ("run_id", "test_id")) -> DataFrame:
    """Union of result tables where a key keeps the row of the earliest table."""
    stacked = None
    for number, source in enumerate(sources):
        tagged = source.select(*keys, "status", F.lit(number).alias("source"))
        stacked = tagged if stacked is None else stacked.unionByName(tagged)
    return stacked.groupBy(*keys).agg(F.min_by("status", "source").alias("status"), F.min("source").alias("source"))
