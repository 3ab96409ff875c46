"""Score and phase queries over runs rendered from lineitem.

An order is a run and its own task, a line a test; orders without lines are
runs that expect nothing. Lines with return flag R
fail; lines with number 3 are left out of the log; line status F puts a test
into the fail-to-pass group, O into pass-to-pass. The test name holds every
column its status depends on, so equal names never disagree.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from runsift.operators.assess import assess_detail, assess_phases, expected_states, task_verdicts
from runsift.operators.conflicts import normalize_results
from runsift.operators.extract import extract_test_results
from runsift.operators.scoring import expected_vs_observed, run_facts, score_counts, status_detail, with_reward
from runsift.functions.text import normalize_test_name
from runsift.schema import UNREADABLE
from runsift.workload.registry import entry, table
from runsift.workload.rendering import fill

NAME = "t/{flag}/p{part}.py::t{line}_s{supp}"
SQL_NAME = "'t/' || l_returnflag || '/p' || l_partkey || '.py::t' || l_linenumber || '_s' || l_suppkey"
SQL_ROWS = f"""rows as (
  select l_orderkey, l_orderkey % 4 as exit_code, l_linenumber, {SQL_NAME} as id,
    case when l_linestatus = 'F' then 'F2P' else 'P2P' end as grp,
    case when l_linenumber = 3 then 'NOT_FOUND' when l_returnflag = 'R' then 'FAILED' else 'PASSED' end as status
  from lineitem)"""


def run_id() -> Column:
    return F.concat(F.lit("run-"), F.col("l_orderkey").cast("string"))


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its place in the file, which orders the log."""
    raw = table(spark, sf_dir, "lineitem")
    placed = raw.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_partkey", "l_suppkey", F.col("_metadata.row_index").alias("row"))
    values = {"flag": F.col("l_returnflag"), "part": F.col("l_partkey"), "line": F.col("l_linenumber"), "supp": F.col("l_suppkey")}
    return (placed).select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "row", fill(NAME, values).alias("id")
    )


def log_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """runs(run_id, instance_id, parser, part, log).

    The lines of an order lie all over the table, so its log arrives in as many
    parts, each with some noise around it. Nothing has to be gathered, whatever
    the share of one order.
    """
    rows = sightings(spark, sf_dir).where("l_linenumber <> 3")
    values = {"word": F.when(F.col("l_returnflag") == "R", "FAILED").otherwise("PASSED"), "id": F.col("id")}
    return rows.select(
        run_id().alias("run_id"),
        F.col("l_orderkey").cast("string").alias("instance_id"),
        F.lit("parse_log_pytest").alias("parser"),
        F.col("row").alias("part"),
        fill("collected items\n{word} {id} - some words\n  at line 3\n\ndone PASSED\n", values).alias("log"),
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per run: its task and exit code, whether or not it left a log."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("run-"), key.cast("string")).alias("run_id"),
        key.cast("string").alias("instance_id"),
        (key % 4).cast("int").alias("exit_code"),
    )


def expected(spark: SparkSession, sf_dir: str, passes: int = 2) -> DataFrame:
    tests = sightings(spark, sf_dir).select(
        F.col("l_orderkey").cast("string").alias("instance_id"),
        F.when(F.col("l_linestatus") == "F", "F2P").otherwise("P2P").alias("grp"),
        F.col("row").alias("pos"),
        F.col("id").alias("raw_id"),
        normalize_test_name(F.col("id"), passes).alias("norm_id"),
    )
    probes = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("instance_id"),
        F.lit("PROBE").alias("grp"),
        F.lit(-1).cast("bigint").alias("pos"),
        F.lit(UNREADABLE).alias("raw_id"),
        F.lit(UNREADABLE).alias("norm_id"),
    )
    return tests.unionByName(probes)


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = normalize_results(extract_test_results(log_runs(spark, sf_dir), ["pytest"]), 2)
    return expected_vs_observed(facts(spark, sf_dir), expected(spark, sf_dir), results)


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_counts(observed(spark, sf_dir), ("run_id", "instance_id", "exit_code"))


SQL_COUNTS = f"""with {SQL_ROWS}, counts as (
  select 'run-' || o_orderkey as run_id, o_orderkey % 4 as exit_code,
    count(*) filter (where grp = 'F2P' and status = 'PASSED') as f2p_passed,
    count(*) filter (where grp = 'F2P') as f2p_total,
    count(*) filter (where grp = 'P2P' and status = 'PASSED') as p2p_passed,
    count(*) filter (where grp = 'P2P') as p2p_total,
    count(*) filter (where grp = 'F2P' and status = 'NOT_FOUND') as f2p_not_found,
    count(*) filter (where grp = 'P2P' and status = 'NOT_FOUND') as p2p_not_found,
    count(*) filter (where grp = 'F2P' and status <> 'PASSED') as f2p_nonpassing,
    count(*) filter (where grp = 'P2P' and status <> 'PASSED') as p2p_nonpassing
  from orders left join rows on l_orderkey = o_orderkey group by o_orderkey),
scored as (
  select *, case when f2p_passed = f2p_total and p2p_passed = p2p_total then 1.0::double else 0.0::double end as binary_reward,
    case when f2p_total > 0 and p2p_total > 0 then (f2p_passed::double / f2p_total + p2p_passed::double / p2p_total) / 2.0::double
         when f2p_total > 0 then f2p_passed::double / f2p_total
         when p2p_total > 0 then p2p_passed::double / p2p_total else 1.0::double end as partial_reward
  from counts)
"""


@entry("expected_vs_observed", f"with {SQL_ROWS} select 'run-' || o_orderkey as run_id, grp, id as raw_id, status from orders left join rows on l_orderkey = o_orderkey where grp is not null")
def _(spark, sf_dir):
    return observed(spark, sf_dir).where("grp <> 'PROBE'").select("run_id", "grp", "raw_id", "status")


@entry("score_counts", SQL_COUNTS + "select run_id, f2p_passed, f2p_total, p2p_passed, p2p_total from scored")
def _(spark, sf_dir):
    return counts(spark, sf_dir).select("run_id", "f2p_passed", "f2p_total", "p2p_passed", "p2p_total")


@entry("reward_binary", SQL_COUNTS + "select run_id, f2p_passed, f2p_total, p2p_passed, p2p_total, binary_reward as reward from scored")
def _(spark, sf_dir):
    scored = with_reward(counts(spark, sf_dir))
    return scored.select("run_id", "f2p_passed", "f2p_total", "p2p_passed", "p2p_total", F.col("test_reward").alias("reward"))


@entry("reward_errors", SQL_COUNTS + """select run_id, case when split_part(run_id, '-', 2)::bigint % 5 = 0 then 'patch' end as error_stage,
  case when exit_code in (0, 1) and split_part(run_id, '-', 2)::bigint % 5 > 0 then binary_reward else 0.0::double end as reward from scored""")
def _(spark, sf_dir):
    failed = F.col("instance_id").cast("bigint") % 5 == 0
    told = facts(spark, sf_dir).withColumn("error_stage", F.when(failed, "patch")).withColumn("error", F.when(failed, "hunk 3 failed"))
    results = normalize_results(extract_test_results(log_runs(spark, sf_dir), ["pytest"]), 2)
    seen = expected_vs_observed(told, expected(spark, sf_dir), results)
    return with_reward(score_counts(seen, ("run_id", "exit_code", "error_stage", "error"))).select("run_id", "error_stage", "reward")


@entry("reward_partial", SQL_COUNTS + "select run_id, partial_reward as reward from scored")
def _(spark, sf_dir):
    return with_reward(counts(spark, sf_dir), " Partial").select("run_id", F.col("test_reward").alias("reward"))


@entry(
    "reward_final",
    SQL_COUNTS + "select run_id, exit_code, case when exit_code between 0 and 1 then partial_reward else 0.0::double end as reward from scored",
)
def _(spark, sf_dir):
    return with_reward(counts(spark, sf_dir), "fractional").select("run_id", F.col("exit_code").cast("bigint").alias("exit_code"), "reward")


@entry(
    "nonpassing_counts",
    SQL_COUNTS + "select run_id, f2p_not_found, p2p_not_found, f2p_nonpassing, p2p_nonpassing from scored",
)
def _(spark, sf_dir):
    return counts(spark, sf_dir).select("run_id", "f2p_not_found", "p2p_not_found", "f2p_nonpassing", "p2p_nonpassing")


# --- phases ---------------------------------------------------------------------
# Each run is assessed in both phases. Tests whose supplier number is divisible
# by 7 are listed in both groups.

SQL_STATES = f"""with {SQL_ROWS}, listed as (
  select 'run-' || l_orderkey as run_id, l_orderkey, exit_code, id, max(status) as status,
    count(*) filter (where grp = 'F2P' or supp % 7 = 0) as in_f2p, count(*) filter (where grp = 'P2P' or supp % 7 = 0) as in_p2p
  from (select *, cast(split_part(id, '_s', 2) as bigint) as supp from rows) group by all)
"""
SQL_CHECKS = """, checks as (
  select 'run-' || o_orderkey as run_id, o_orderkey as l_orderkey, o_orderkey % 4 as exit_code,
    count(*) filter (where status <> 'NOT_FOUND') as parsed_test_count,
    count(*) filter (where status = 'NOT_FOUND') as missing_count,
    count(*) filter (where in_f2p > 0 and in_p2p > 0) as shared_expected_count,
    coalesce(sum(in_f2p) filter (where status not in ('PASSED', 'FAILED', 'ERROR')), 0)::bigint as base_f,
    coalesce(sum(in_p2p) filter (where in_f2p = 0 and status <> 'PASSED'), 0)::bigint as base_p,
    count(*) filter (where in_f2p > 0 and in_p2p > 0 and status not in ('PASSED', 'FAILED', 'ERROR')) as base_s,
    count(*) filter (where in_f2p > 0 and status in ('FAILED', 'ERROR')) as base_seen,
    coalesce(sum(in_f2p) filter (where status <> 'PASSED'), 0)::bigint as gold_f,
    coalesce(sum(in_p2p) filter (where status <> 'PASSED'), 0)::bigint as gold_p
  from orders left join listed on l_orderkey = o_orderkey group by o_orderkey)
"""
SQL_BASE = """select run_id, parsed_test_count, missing_count, base_f as wrong_fail_to_pass_count, base_p as wrong_pass_to_pass_count,
  base_s as wrong_shared_count, base_seen as observed_fail_to_pass_failure_count, shared_expected_count,
  exit_code between 0 and 1 and missing_count = 0 and base_f = 0 and base_p = 0 and base_s = 0 and base_seen > 0 as valid from checks"""
SQL_GOLD = """select run_id, parsed_test_count, missing_count, gold_f as wrong_fail_to_pass_count, gold_p as wrong_pass_to_pass_count,
  0::bigint as wrong_shared_count, 0::bigint as observed_fail_to_pass_failure_count, shared_expected_count,
  exit_code between 0 and 1 and missing_count = 0 and gold_f = 0 and gold_p = 0 as valid from checks"""


def phase_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = normalize_results(extract_test_results(log_runs(spark, sf_dir), ["pytest"]), 1)
    listed = expected(spark, sf_dir, passes=1).where("grp <> 'PROBE'")
    both = F.regexp_extract("raw_id", r"_s(\d+)$", 1).cast("bigint") % 7 == 0
    groups = F.when(both, F.array(F.lit("F2P"), F.lit("P2P"))).otherwise(F.array("grp"))
    listed = listed.withColumn("grp", F.explode(groups))
    return expected_states(facts(spark, sf_dir), listed, results)


def phase_verdicts(spark: SparkSession, sf_dir: str, phase: str) -> DataFrame:
    runs = facts(spark, sf_dir).withColumn("phase", F.lit(phase))
    return assess_phases(runs, phase_states(spark, sf_dir))


VERDICT_COLUMNS = (
    "run_id", "parsed_test_count", "missing_count", "wrong_fail_to_pass_count", "wrong_pass_to_pass_count",
    "wrong_shared_count", "observed_fail_to_pass_failure_count", "shared_expected_count", "valid",
)


@entry("assess_base", SQL_STATES + SQL_CHECKS + SQL_BASE)
def _(spark, sf_dir):
    return phase_verdicts(spark, sf_dir, "base").select(*VERDICT_COLUMNS)


@entry("assess_gold", SQL_STATES + SQL_CHECKS + SQL_GOLD)
def _(spark, sf_dir):
    return phase_verdicts(spark, sf_dir, "gold").select(*VERDICT_COLUMNS)


@entry(
    "assess_detail",
    SQL_STATES
    + """select run_id, 'expected_results' as list, id as test_id, status, 1::bigint as times from listed
    union all select run_id, 'missing', id, status, 1 from listed where status = 'NOT_FOUND'
    union all select run_id, 'shared_expected', id, status, 1 from listed where in_f2p > 0 and in_p2p > 0
    union all select run_id, 'wrong_fail_to_pass', id, status, in_f2p from listed where in_f2p > 0 and status = 'NOT_FOUND'
    union all select run_id, 'wrong_pass_to_pass', id, status, in_p2p from listed where in_p2p > 0 and in_f2p = 0 and status <> 'PASSED'
    union all select run_id, 'observed_fail_to_pass_failures', id, status, 1 from listed where in_f2p > 0 and status = 'FAILED'
    union all select run_id, 'wrong_shared', id, status, 1 from listed where in_f2p > 0 and in_p2p > 0 and status = 'NOT_FOUND'""",
)
def _(spark, sf_dir):
    runs = facts(spark, sf_dir).withColumn("phase", F.lit("base"))
    return assess_detail(runs, phase_states(spark, sf_dir))


@entry(
    "task_verdict",
    SQL_STATES
    + SQL_CHECKS
    + f""", both_phases as (
    select l_orderkey, b.valid and g.valid and l_orderkey % 7 not in (1, 2, 3) as valid from checks c join ({SQL_BASE}) b using (run_id) join ({SQL_GOLD}) g using (run_id))
    select l_orderkey::varchar as instance_id, l_orderkey % 3 <> 0 as metadata_valid, valid and l_orderkey % 3 <> 0 as valid from both_phases""",
)
def _(spark, sf_dir):
    states = phase_states(spark, sf_dir)
    runs = facts(spark, sf_dir)
    phases = F.explode(F.array(F.lit("base"), F.lit("gold")))
    # One run id per phase; both phases of a task share the states of its run.
    # Some tasks lack the base phase, some the gold one, some both.
    seventh = F.col("instance_id").cast("bigint") % 7
    missing = ((seventh == 1) & (F.col("phase") == "base")) | ((seventh == 2) & (F.col("phase") == "gold")) | (seventh == 3)
    both = runs.withColumn("phase", phases).where(~missing)
    verdicts = assess_phases(both, states)
    metadata = runs.select("instance_id", (F.col("instance_id").cast("bigint") % 3 != 0).alias("valid"))
    return task_verdicts(metadata, verdicts).select("instance_id", "metadata_valid", "valid")


# --- listings ---------------------------------------------------------------------
# A user is a run and an event one of its tests; the listing shows five.


def event_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("run_id"),
        F.lit("P2P").alias("grp"),
        F.col("event_id").alias("pos"),
        F.concat(F.lit("test "), F.col("event_id").cast("string")).alias("raw_id"),
        F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "view", "NOT_FOUND").otherwise("PASSED").alias("status"),
    )


@entry(
    "status_detail",
    """with wrong as (
      select 'user-' || user_id as run_id, 'test ' || event_id as id, case event_type when 'error' then 'FAILED' else 'NOT_FOUND' end as status,
        row_number() over (partition by user_id order by event_id) as n, count(*) over (partition by user_id) as total
      from events where event_type in ('error', 'view'))
    select run_id, n, '  ' || id || ': ' || status as text from wrong where n <= 5
    union all select distinct run_id, 6, '  ... ' || (total - 5) || ' additional result(s) omitted' from wrong where total > 5""",
)
def _(spark, sf_dir):
    return status_detail(event_tests(spark, sf_dir), "P2P", limit=5, only_nonpassing=True).withColumn("n", F.col("n").cast("bigint"))
