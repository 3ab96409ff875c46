"""Verdicts on the two phases of a task: before the fix and with it."""

from pyspark.sql import Column, DataFrame, functions as F

from runsift.functions.commands import is_ordinary_exit
from runsift.operators.scoring import F2P, P2P
from runsift.schema import ERROR, FAILED, NOT_FOUND, PASSED, UNREADABLE

BASE, GOLD = "base", "gold"


def expected_states(runs: DataFrame, expected: DataFrame, results: DataFrame) -> DataFrame:
    """One row per run and test name, expected or seen.

    Expected tests and results are grouped and stacked instead of joined, with
    map-side combining, and a name that is listed or seen very often adds one
    partial row per task. Normalised results lie by run and name already, and so
    do the grouped expected tests, so stacking them needs no further shuffle.
    Columns: in_f2p and in_p2p (times listed), status, seen.
    """
    wanted = runs.join(expected, "instance_id").groupBy("run_id", F.col("norm_id").alias("test_id")).agg(
        F.sum(F.when(F.col("grp") == F2P, 1).otherwise(0)).alias("in_f2p"),
        F.sum(F.when(F.col("grp") == P2P, 1).otherwise(0)).alias("in_p2p"),
        F.lit(None).cast("string").alias("status"),
    )
    none = F.lit(0).cast("bigint")
    seen = results.select("run_id", "test_id", none.alias("in_f2p"), none.alias("in_p2p"), "status")
    stacked = wanted.unionByName(seen).groupBy("run_id", "test_id").agg(
        F.sum("in_f2p").alias("in_f2p"), F.sum("in_p2p").alias("in_p2p"), F.max("status").alias("seen_status")
    )
    expected_here = (F.col("in_f2p") > 0) | (F.col("in_p2p") > 0)
    return stacked.select(
        "run_id",
        "test_id",
        "in_f2p",
        "in_p2p",
        F.when(expected_here, F.coalesce("seen_status", F.lit(NOT_FOUND))).alias("status"),
        F.col("seen_status").isNotNull().alias("seen"),
    )


def _conditions() -> dict[str, Column]:
    status = F.col("status")
    f2p, p2p = F.col("in_f2p") > 0, F.col("in_p2p") > 0
    told = status.isin(PASSED, FAILED, ERROR)
    return {
        "missing": (f2p | p2p) & (status == NOT_FOUND),
        "shared": f2p & p2p,
        "base_wrong_f2p": f2p & ~told,
        "base_wrong_p2p": p2p & ~f2p & (status != PASSED),
        "base_wrong_shared": f2p & p2p & ~told,
        "base_failures": f2p & status.isin(FAILED, ERROR),
        "gold_wrong_f2p": f2p & (status != PASSED),
        "gold_wrong_p2p": p2p & (status != PASSED),
    }


def assess_phases(runs: DataFrame, states: DataFrame) -> DataFrame:
    """runs(run_id, instance_id, phase, exit_code) + states -> one verdict per run."""
    c = _conditions()

    def times(condition: Column, column: str) -> Column:
        return F.sum(F.when(condition, F.col(column)).otherwise(0))

    counts = states.groupBy("run_id").agg(
        F.count_if(F.col("seen") & (F.col("test_id") != UNREADABLE)).alias("parsed_test_count"),
        F.count_if(c["missing"]).alias("missing_count"),
        F.count_if(c["shared"]).alias("shared_expected_count"),
        times(c["base_wrong_f2p"], "in_f2p").alias("base_wrong_f2p"),
        times(c["base_wrong_p2p"], "in_p2p").alias("base_wrong_p2p"),
        F.count_if(c["base_wrong_shared"]).alias("base_wrong_shared"),
        F.count_if(c["base_failures"]).alias("base_failures"),
        times(c["gold_wrong_f2p"], "in_f2p").alias("gold_wrong_f2p"),
        times(c["gold_wrong_p2p"], "in_p2p").alias("gold_wrong_p2p"),
        F.coalesce(F.bool_or(F.col("test_id") == UNREADABLE), F.lit(False)).alias("unreadable"),
    )
    known = runs.where(F.col("phase").isin(BASE, GOLD)).join(counts, "run_id", "left")
    is_base = F.col("phase") == BASE

    def number(base: Column | str, gold: Column | str) -> Column:
        as_column = lambda v: F.col(v) if isinstance(v, str) else v
        return F.coalesce(F.when(is_base, as_column(base)).otherwise(as_column(gold)), F.lit(0)).cast("bigint")

    zero = F.lit(0)
    rows = known.select(
        "run_id",
        "instance_id",
        "phase",
        F.col("exit_code").alias("test_exit_code"),
        F.coalesce("parsed_test_count", zero).alias("parsed_test_count"),
        F.coalesce("missing_count", zero).alias("missing_count"),
        number("base_wrong_f2p", "gold_wrong_f2p").alias("wrong_fail_to_pass_count"),
        number("base_wrong_p2p", "gold_wrong_p2p").alias("wrong_pass_to_pass_count"),
        number("base_failures", zero).alias("observed_fail_to_pass_failure_count"),
        F.coalesce("shared_expected_count", zero).alias("shared_expected_count"),
        number("base_wrong_shared", zero).alias("wrong_shared_count"),
        F.coalesce("unreadable", F.lit(False)).alias("unreadable"),
    )
    no_failure = is_base & (F.col("observed_fail_to_pass_failure_count") == 0)
    valid = (
        is_ordinary_exit(F.col("test_exit_code"))
        & ~F.col("unreadable")
        & (F.col("missing_count") == 0)
        & (F.col("wrong_fail_to_pass_count") == 0)
        & (F.col("wrong_pass_to_pass_count") == 0)
        & (F.col("wrong_shared_count") == 0)
        & ~no_failure
    )
    return rows.withColumn("no_fail_to_pass_failure", no_failure).withColumn("valid", valid)


def unknown_phases(runs: DataFrame) -> DataFrame:
    """Runs that no verdict exists for."""
    return runs.where(~F.coalesce(F.col("phase").isin(BASE, GOLD), F.lit(False)))


def assess_detail(runs: DataFrame, states: DataFrame) -> DataFrame:
    """The lists behind a verdict, in long form: (run_id, list, test_id, status, times).

    A list of a run has no bound, so it is a set of rows, not an array. `times`
    says how often a name counts in its list.
    """
    c = _conditions()
    once = F.lit(1).cast("bigint")

    def item(condition: Column, name: str, times: Column = once) -> Column:
        return F.when(condition, F.struct(F.lit(name).alias("list"), times.cast("bigint").alias("times")))

    is_base = F.col("phase") == BASE
    in_f2p, in_p2p = F.col("in_f2p"), F.col("in_p2p")
    lists = F.array(
        item(F.lit(True), "expected_results"),
        item(c["missing"], "missing"),
        item(c["shared"], "shared_expected"),
        item(F.when(is_base, c["base_wrong_f2p"]).otherwise(c["gold_wrong_f2p"]), "wrong_fail_to_pass", in_f2p),
        item(F.when(is_base, c["base_wrong_p2p"]).otherwise(c["gold_wrong_p2p"]), "wrong_pass_to_pass", in_p2p),
        item(is_base & c["base_failures"], "observed_fail_to_pass_failures"),
        item(is_base & c["base_wrong_shared"], "wrong_shared"),
    )
    expected_only = states.where((F.col("in_f2p") > 0) | (F.col("in_p2p") > 0))
    rows = expected_only.join(runs.select("run_id", "phase"), "run_id")
    return (
        rows.select("run_id", "test_id", "status", F.explode(lists).alias("l"))
        .where("l is not null")
        .select("run_id", "l.list", "test_id", "status", "l.times")
    )


def task_verdicts(metadata: DataFrame, phases: DataFrame, executed: bool = True) -> DataFrame:
    """A task is valid if its definition is, and its base and its gold phase are there and valid.

    Tasks with an invalid definition are not run, so they have no phases. With
    executed=False only definitions were checked, and phases count as far as there are any.
    """
    both = F.lit(True) if not executed else F.bool_or(F.col("phase") == BASE) & F.bool_or(F.col("phase") == GOLD)
    per_task = phases.groupBy("instance_id").agg(
        (F.bool_and("valid") & both).alias("phases_valid"), F.count(F.lit(1)).alias("phases")
    )
    joined = metadata.select("instance_id", F.col("valid").alias("metadata_valid")).join(per_task, "instance_id", "left")
    return joined.select(
        "instance_id",
        "metadata_valid",
        F.coalesce("phases", F.lit(0)).alias("phases"),
        (F.col("metadata_valid") & F.coalesce("phases_valid", F.lit(not executed))).alias("valid"),
    )
