"""Expected tests against observed statuses, reduced to rewards."""

from pyspark.sql import Column, DataFrame, functions as F

from runsift.functions.commands import is_ordinary_exit
from runsift.functions.text import normalize_test_name
from runsift.operators.select import first_of_each
from runsift.schema import NOT_FOUND, PASSED, UNREADABLE

F2P, P2P, PROBE = "F2P", "P2P", "PROBE"
# Stage and message of a failure that kept a run from being tested: a patch that
# did not apply, a phase that broke, a parser that raised. Null for sound runs.
ERROR_COLUMNS = ("error_stage", "error")


def expected_tests(tasks: DataFrame, passes: int = 1, probe: bool = False) -> DataFrame:
    """tasks -> (instance_id, grp, pos, raw_id, norm_id), duplicates kept.

    With `probe` every task also expects the mark of an unreadable log, in a
    group of its own. It gives each task at least one row and lets one join
    find both the tests and the broken logs.
    """

    def entries(column: str, grp: str) -> Column:
        listed = F.coalesce(F.col(column), F.array().cast("array<string>"))
        return F.transform(
            listed, lambda t, i: F.struct(F.lit(grp).alias("grp"), i.alias("pos"), t.alias("raw_id"))
        )

    groups = [entries("FAIL_TO_PASS", F2P), entries("PASS_TO_PASS", P2P)]
    if probe:
        mark = F.struct(F.lit(PROBE).alias("grp"), F.lit(-1).alias("pos"), F.lit(UNREADABLE).alias("raw_id"))
        groups.append(F.array(mark))
    listed = tasks.select("instance_id", F.explode(F.concat(*groups)).alias("t")).select("instance_id", "t.*")
    return listed.withColumn("norm_id", normalize_test_name(F.col("raw_id"), passes))


def run_facts(runs: DataFrame) -> DataFrame:
    """One row per run, whatever the number of log parts; the log is not read.

    Where runs say why they failed (`error_stage`, `error`), that is kept.
    """
    return runs.select("run_id", "instance_id", "exit_code", *[c for c in ERROR_COLUMNS if c in runs.columns]).distinct()


def expected_vs_observed(runs: DataFrame, expected: DataFrame, results: DataFrame) -> DataFrame:
    """Every expected test of every run with its status, NOT_FOUND if unseen.

    `results` are normalised and hold one row per (run_id, test_id). A run
    whose task is unknown keeps one row without a test.
    """
    wanted = runs.join(expected, "instance_id", "left")
    seen = results.select("run_id", F.col("test_id").alias("norm_id"), "status")
    joined = wanted.join(seen, ["run_id", "norm_id"], "left")
    missing = F.when(F.col("grp").isNotNull(), F.lit(NOT_FOUND))
    return joined.select(
        *[c for c in runs.columns], "grp", "pos", "raw_id", "norm_id", F.coalesce("status", missing).alias("status")
    )


def reward(f2p_passed: Column, f2p_total: Column, p2p_passed: Column, p2p_total: Column, mode: str = "binary") -> Column:
    """Binary: 1.0 if every expected test passed. Partial: mean pass rate of the non-empty groups."""
    binary = F.when((f2p_passed == f2p_total) & (p2p_passed == p2p_total), F.lit(1.0)).otherwise(F.lit(0.0))
    if mode.strip().lower() not in {"partial", "fractional"}:
        return binary
    f2p = F.try_divide(f2p_passed.cast("double"), f2p_total.cast("double"))
    p2p = F.try_divide(p2p_passed.cast("double"), p2p_total.cast("double"))
    return F.coalesce((f2p + p2p) / F.lit(2.0), f2p, p2p, binary)


def score_counts(observed: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Passed, total, unseen and not passing, per group; duplicates count each time."""

    def count(grp: str, condition: Column | None = None) -> Column:
        mine = F.coalesce(F.col("grp") == grp, F.lit(False))
        return F.count_if(mine if condition is None else mine & condition)

    passed, unseen = F.col("status") == PASSED, F.col("status") == NOT_FOUND
    return observed.groupBy(*keys).agg(
        count(F2P, passed).alias("f2p_passed"),
        count(F2P).alias("f2p_total"),
        count(F2P, unseen).alias("f2p_not_found"),
        count(P2P, passed).alias("p2p_passed"),
        count(P2P).alias("p2p_total"),
        count(P2P, unseen).alias("p2p_not_found"),
        count(F2P, ~passed).alias("f2p_nonpassing"),
        count(P2P, ~passed).alias("p2p_nonpassing"),
        F.coalesce(F.bool_or((F.col("grp") == PROBE) & ~unseen), F.lit(False)).alias("unreadable"),
        F.bool_and(F.col("grp").isNull()).alias("unknown_task"),
    )


def with_reward(counts: DataFrame, mode: str = "binary") -> DataFrame:
    """Reward of the tests, and the final one: 0.0 for broken runs, among them those with an error."""
    tests = reward(F.col("f2p_passed"), F.col("f2p_total"), F.col("p2p_passed"), F.col("p2p_total"), mode)
    sound = is_ordinary_exit(F.col("exit_code")) & ~F.col("unreadable") & ~F.col("unknown_task")
    for column in ERROR_COLUMNS:
        if column in counts.columns:
            sound = sound & F.col(column).isNull()
    return counts.withColumn("test_reward", tests).withColumn(
        "reward", F.when(sound, F.col("test_reward")).otherwise(F.lit(0.0))
    )


def status_detail(observed: DataFrame, grp: str, limit: int = 200, only_nonpassing: bool = False) -> DataFrame:
    """Listing of one group per run: the first `limit` tests and a closing line.

    The listing is ranked within slices of a run before it is ranked as a whole, so of
    a run with millions of tests at most `limit` rows of each slice meet in one
    task; the count of the rest is an aggregate.
    """
    rows = observed.where(F.col("grp") == grp)
    if only_nonpassing:
        rows = rows.where(F.col("status") != PASSED)
    shown = first_of_each(rows, ("run_id",), (F.col("pos"),), max(limit, 0), F.col("pos"), "n")
    shown = shown.select(
        "run_id", "n", F.concat(F.lit("  "), "raw_id", F.lit(": "), "status").alias("text")
    )
    omitted = rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("total")).where(F.col("total") > max(limit, 0))
    omitted = omitted.select(
        "run_id",
        F.lit(max(limit, 0) + 1).alias("n"),
        F.concat(F.lit("  ... "), (F.col("total") - max(limit, 0)).cast("string"), F.lit(" additional result(s) omitted")).alias("text"),
    )
    return shown.unionByName(omitted)
