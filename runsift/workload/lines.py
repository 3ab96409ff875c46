"""Queries on lines: conflicts, context, markers, counters."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from runsift.functions.commands import stage_exit_rollup
from runsift.operators.conflicts import dedupe, first_source_wins
from runsift.operators.context import carry, indent_paths, latest_start, leaf_lines, section_gate
from runsift.operators.diagnostics import repository_state
from runsift.operators.dialects.suites import class_status, suite_status
from runsift.operators.dialects.tables import occurrence_status
from runsift.workload.dialects import SQL_POLICY
from runsift.workload.registry import entry, table
from runsift.workload.rendering import PART_ROWS, assemble, part_of

# --- conflicts: a user is a run, event_id % 20 a test, the event type its status --

SQL_SEEN = """(select user_id as run_id, event_id % 20 as test_id, event_id as seq,
  case event_type when 'error' then 'ERROR' when 'view' then 'SKIPPED' when 'click' then 'FAILED' else 'PASSED' end as status from events)"""


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "error", "ERROR").when(kind == "view", "SKIPPED").when(kind == "click", "FAILED").otherwise("PASSED")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), (F.col("event_id") % 20).alias("test_id"), F.col("event_id").alias("seq"), status.alias("status")
    )


for _policy in ("last", "first", "override", "severity", "precedence"):
    entry(
        f"dedupe_{_policy}", f"select run_id, test_id, {SQL_POLICY[_policy]} as status from {SQL_SEEN} group by run_id, test_id"
    )(lambda spark, sf_dir, policy=_policy: dedupe(seen(spark, sf_dir), policy))


@entry(
    "occurrence_status",
    """select user_id as run_id, event_id % 200 as test_id, case when count(*) >= 2 then 'PASSED' else 'ERROR' end as status
      from events group by 1, 2""",
)
def _(spark, sf_dir):
    keyed = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), (F.col("event_id") % 200).alias("test_id"))
    counted = keyed.groupBy("run_id", "test_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("run_id", "test_id", occurrence_status(F.col("n")).alias("status"))


@entry(
    "fallback_union",
    f"""select run_id, test_id, coalesce(a, b) as status, case when a is null then 1 else 0 end as source from (
      select run_id, test_id, arg_max(status, seq) filter (where status = 'FAILED') as a, arg_max(status, seq) filter (where status <> 'FAILED') as b
      from {SQL_SEEN} group by 1, 2)""",
)
def _(spark, sf_dir):
    rows = seen(spark, sf_dir)
    first = dedupe(rows.where("status = 'FAILED'"), "last")
    second = dedupe(rows.where("status <> 'FAILED'"), "last")
    return first_source_wins(first, second)


@entry(
    "counter_status",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey,
      case when l_quantity::int % 3 > 0 or l_linenumber % 2 > 0 then 'FAILED' when l_suppkey % 4 > 0 then 'SKIPPED' else 'PASSED' end as class_status,
      case when l_quantity::int % 3 > 0 then 'FAILED' when l_linenumber % 2 > 0 then 'ERROR' when l_suppkey % 4 = 3 then 'SKIPPED' else 'PASSED' end as suite_status
      from lineitem""",
)
def _(spark, sf_dir):
    failures, errors, skipped = F.col("l_quantity").cast("int") % 3, F.col("l_linenumber") % 2, F.col("l_suppkey") % 4
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        class_status(failures, errors, skipped).alias("class_status"),
        suite_status(F.lit(3), failures, errors, skipped).alias("suite_status"),
    )


# --- context: events as lines of a user's log ------------------------------------


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), part_of(F.col("event_id")).alias("part"), F.col("event_id").alias("seq"), "event_type"
    )


@entry(
    "carry_forward",
    """select event_id as seq, last_value(case when event_type = 'signup' then event_id end ignore nulls)
      over (partition by user_id order by event_id rows between unbounded preceding and current row) as header from events""",
)
def _(spark, sf_dir):
    header = F.when(F.col("event_type") == "signup", F.col("seq"))
    return carry(event_lines(spark, sf_dir), header, "header").select("seq", "header")


@entry(
    "section_gate",
    """select event_id as seq, coalesce(max(case when event_type = 'error' then 1 end)
      over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) = 1 as inside from events""",
)
def _(spark, sf_dir):
    return section_gate(event_lines(spark, sf_dir), F.col("event_type") == "error").select("seq", "inside")


@entry(
    "leaf_lines",
    """select event_id as seq, coalesce(lead(event_id % 4) over (partition by user_id order by event_id) <= event_id % 4, true) as is_leaf
      from events where event_type <> 'view'""",
)
def _(spark, sf_dir):
    level = F.when(F.col("event_type") != "view", F.col("seq") % 4)
    return leaf_lines(event_lines(spark, sf_dir).withColumn("level", level)).select("seq", "is_leaf")


@entry(
    "start_done_join",
    """select event_id as seq, last_value(case when event_type = 'signup' then event_id end ignore nulls)
      over (partition by user_id, event_id % 3 order by event_id rows between unbounded preceding and 1 preceding) as started from events""",
)
def _(spark, sf_dir):
    rows = event_lines(spark, sf_dir).withColumn("id", F.col("seq") % 3)
    return latest_start(rows, F.col("event_type") == "signup", F.col("seq"), "started").select("seq", "started")


@entry(
    "indent_paths",
    """select o_orderkey as seq, 'a' || o_orderkey || '/b' || o_orderkey || case when o_orderkey % 2 = 0 then '' else '/c' || o_orderkey end
      || '/leaf' as path from orders""",
)
def _(spark, sf_dir):
    # Each order adds a branch of three or four levels to its customer's tree.
    key = F.col("o_orderkey").cast("string")

    def node(level: int, name):
        return F.struct(F.lit(level).alias("level"), name.alias("name"), F.col("o_orderkey").alias("id"))

    odd = F.col("o_orderkey") % 2 == 1
    branch = F.array(
        node(0, F.concat(F.lit("a"), key)), node(2, F.concat(F.lit("b"), key)), F.when(odd, node(3, F.concat(F.lit("c"), key))), node(7, F.lit("leaf"))
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("run_id"), part_of(F.col("o_orderkey")).alias("part"), F.col("o_orderkey").alias("seq"),
        F.filter(branch, lambda n: n.isNotNull()).alias("branch"),
    )
    trees = orders.groupBy("run_id", "part").agg(F.sort_array(F.collect_list(F.struct("seq", "branch"))).alias("b"))
    trees = trees.select("run_id", "part", F.flatten("b.branch").alias("items"))
    return indent_paths(trees).where("level = 7").select(F.col("id").alias("seq"), F.array_join("path", "/").alias("path"))


# --- markers -----------------------------------------------------------------------


@entry(
    "stage_exit_rollup",
    """select user_id as run_id, count(*) as stages, count(*) filter (where event_id % 4 > 0) as failed_stages,
      coalesce(arg_min(event_id % 4, event_id) filter (where event_id % 4 > 0), 0)::bigint as exit_code from events group by 1""",
)
def _(spark, sf_dir):
    key = F.col("event_id")
    line = F.concat(
        F.lit("output\n[TEST_COMMAND_END index="), F.floor(key / 8).cast("string"), F.lit(" stage="), (key % 8).cast("string"),
        F.lit(" exit_code="), (key % 4).cast("string"), F.lit("]"),
    )
    lines = table(spark, sf_dir, "events").select("user_id", part_of(key).alias("part"), key.alias("seq"), line.alias("text"))
    logs = assemble(lines, ("user_id",)).select(F.col("user_id").alias("run_id"), "log")
    return stage_exit_rollup(logs).select("run_id", "stages", "failed_stages", F.col("exit_code").cast("bigint").alias("exit_code"))


@entry(
    "repo_diagnostics",
    """select o_orderkey, case when o_orderkey % 4 = 0 then 0 else 2 end::bigint as previewed,
      case when o_orderkey % 4 > 0 then ' M a' || o_orderkey || '.py' end as first_entry,
      case when o_orderkey % 3 > 0 then o_custkey end as changed_entry_count, 'h' || o_orderkey as diff_hash from orders""",
)
def _(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    end = F.when(F.col("o_orderkey") % 4 == 0, "").otherwise("STATUS_END\n")
    count = F.when(F.col("o_orderkey") % 3 == 0, "many").otherwise(F.concat(F.lit(" "), F.col("o_custkey").cast("string")))
    text = F.concat(
        F.lit("noise\nSTATUS_BEGIN\n M a"), key, F.lit(".py\n?? b\n"), end, F.lit("CHANGED_ENTRY_COUNT="), count,
        F.lit("\nTRACKED_DIFF_HASH= h"), key, F.lit("\n"),
    )
    states = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("state"))
    found = repository_state(states, F.col("state"))
    return found.select(
        "o_orderkey",
        F.size("changed_files_preview").cast("bigint").alias("previewed"),
        F.try_element_at("changed_files_preview", F.lit(1)).alias("first_entry"),
        "changed_entry_count",
        F.col("tracked_diff_hash").alias("diff_hash"),
    )
