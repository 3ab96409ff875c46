"""Runs and tasks in, rewards out: one lazy plan."""

from collections.abc import Iterable

from pyspark.sql import DataFrame

from runsift.operators.conflicts import normalize_results
from runsift.operators.extract import extract_test_results
from runsift.operators.scoring import ERROR_COLUMNS, expected_tests, expected_vs_observed, run_facts, score_counts, with_reward

# Grading normalises names when they are read and again when they are scored.
GRADING_PASSES = 2


def observe_runs(
    runs: DataFrame, tasks: DataFrame, dialects: Iterable[str] | None = None, passes: int = GRADING_PASSES
) -> DataFrame:
    """Expected tests of every run with their statuses."""
    results = normalize_results(extract_test_results(runs, dialects), passes)
    return expected_vs_observed(run_facts(runs), expected_tests(tasks, passes, probe=True), results)


def grade_runs(
    runs: DataFrame, tasks: DataFrame, dialects: Iterable[str] | None = None, mode: str = "binary"
) -> DataFrame:
    """One row per run: counts per group and the reward.

    The raw log leaves the plan in its first stage. What is shuffled is one
    row per (run, test): to settle repeated sightings and for each pass of
    normalising names, combined on the map side every time. The last of these
    partitionings, by (run, name), is where results meet the expected tests;
    the final exchange carries one partial row per run and task.
    """
    observed = observe_runs(runs, tasks, dialects)
    told = [c for c in ERROR_COLUMNS if c in runs.columns]
    return with_reward(score_counts(observed, ("run_id", "instance_id", "exit_code", *told)), mode)
