"""Checking a catalogue: select, sample, resume, validate, assess."""

from pyspark.sql import DataFrame, functions as F

from runsift.operators.assess import assess_phases, expected_states, task_verdicts
from runsift.operators.conflicts import normalize_results
from runsift.operators.extract import extract_test_results
from runsift.operators.scoring import expected_tests
from runsift.operators.select import cached_only, in_ranges, modulo_shard, stratified_sample
from runsift.operators.validate import validate_metadata
from runsift.sources.results import latest_results, pending, read_results, run_summary, write_results, write_summary

# Phase checks normalise names once on each side.
PHASE_PASSES = 1


def select_tasks(
    tasks: DataFrame,
    ranges: DataFrame | None = None,
    per_language: int | None = None,
    seed: int = 0,
    listing: DataFrame | None = None,
    only_valid: bool = False,
    shard: int = 0,
    shards: int = 1,
    most: int | None = None,
    recorded: DataFrame | None = None,
) -> DataFrame:
    """Tasks to check. The order matters and is kept: ranges, filters, sample
    over the whole catalogue, then the shard, the cap and what is still open."""
    chosen = tasks if ranges is None else in_ranges(tasks, ranges)
    if only_valid:
        sound = validate_metadata(chosen).where("valid").select("public_index")
        chosen = chosen.join(sound, "public_index", "left_semi")
    if listing is not None:
        chosen = cached_only(chosen, listing, F.col("image_name"))
    if per_language is not None:
        chosen = stratified_sample(chosen, per_language, seed)
    chosen = modulo_shard(chosen, shard, shards, most=most)
    if recorded is not None:
        chosen = pending(chosen.withColumn("index", F.col("public_index")), recorded).drop("index")
    return chosen


def check_tasks(tasks: DataFrame, runs: DataFrame, dialects: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(phase verdicts, task verdicts) of tasks from their stored base and gold runs.

    Runs of tasks whose definition is invalid are not assessed.
    """
    metadata = validate_metadata(tasks)
    facts = runs.select("run_id", "instance_id", "phase", "exit_code").distinct()
    facts = facts.join(metadata.where("valid").select("instance_id"), "instance_id", "left_semi")
    # All logs are read; results meet the facts by run, so that no log goes into a join.
    results = normalize_results(extract_test_results(runs, dialects), PHASE_PASSES)
    states = expected_states(facts, expected_tests(tasks, PHASE_PASSES), results)
    phases = assess_phases(facts, states)
    return phases, task_verdicts(metadata, phases)


def record_checks(selected: DataFrame, records: DataFrame, path: str, write_id: str | None = None) -> DataFrame:
    """Appends records(index, valid, ...) to the result log at `path` and writes the summary beside it, which it returns.

    `selected(index)` are the tasks that were to be checked; earlier records of
    the log count for them. A repeated call with the same `write_id` adds nothing.
    """
    write_results(records, path, resume=True, write_id=write_id)
    summary = run_summary(selected, latest_results(read_results(records.sparkSession, path)))
    write_summary(summary, f"{path}.summary")
    return records.sparkSession.read.json(f"{path}.summary")
