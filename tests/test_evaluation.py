"""Scores, phases, selection, catalogue and streams on small tables."""

import json
import os
import re

import pytest
from pyspark.sql import functions as F

from runsift import extract_test_results, grade_runs, register_extractor
from runsift.operators.extract import REGISTRY
from runsift.operators.assess import assess_detail, assess_phases, expected_states
from runsift.functions.text import normalize_test_name
from runsift.operators.conflicts import dedupe, normalize_results
from runsift.operators.context import carry, leaf_lines, section_gate
from runsift.operators.scoring import expected_tests
from runsift.operators.select import in_ranges, modulo_shard, out_of_range, parse_ranges, stratified_sample
from runsift.operators.validate import validate_metadata
from runsift.plans.grade import observe_runs
from runsift.plans.checking import check_tasks, record_checks, select_tasks
from runsift.plans.storage import read_runs, write_runs
from runsift.schema import RUNS, TASKS
from runsift.sources.catalogue import (
    config_columns, index_totals, load_index, normalize_tasks, read_tasks, shard_layout, task_index, with_public_index,
    with_raw_index, write_index,
)
from runsift.sources.results import latest_results, pending, read_results, run_summary, write_results

LISTS = "instance_id STRING, FAIL_TO_PASS ARRAY<STRING>, PASS_TO_PASS ARRAY<STRING>"


def grade(spark, log, f2p, p2p, mode="binary", code=0, parser="pytest"):
    tasks = spark.createDataFrame([("t", f2p, p2p)], LISTS)
    runs = spark.createDataFrame([("r", "t", parser, 0, log, code)], RUNS)
    return grade_runs(runs, tasks, [parser], mode).first()


def test_rewards(spark):
    log = "PASSED a\nPASSED c\nFAILED b\nPASSED d\nPASSED e\nPASSED f"
    row = grade(spark, log, ["a", "b"], ["c", "d", "e", "x"], "partial")
    assert row["reward"] == (0.5 + 0.75) / 2 == 0.625
    assert (row["f2p_passed"], row["f2p_total"], row["p2p_not_found"]) == (1, 2, 1)
    assert grade(spark, log, ["a", "a"], [], "Fractional ")["reward"] == 1.0
    assert grade(spark, log, ["a"], None)["reward"] == 1.0
    assert grade(spark, log, ["b"], ["a"])["reward"] == 0.0
    assert grade(spark, log, [], [], "partial")["reward"] == 1.0
    assert grade(spark, log, [], [], "other")["reward"] == 1.0


@pytest.mark.parametrize("code,reward", [(-1, 0.0), (0, 1.0), (1, 1.0), (2, 0.0), (124, 0.0)])
def test_exit_codes(spark, code, reward):
    assert grade(spark, "PASSED a", ["a"], [], code=code)["reward"] == reward


def test_broken_log_and_unknown_task_give_nothing(spark):
    row = grade(spark, "a PASSED\nPASSED", ["a"], [], parser="pytest_v2")
    assert (row["unreadable"], row["f2p_passed"], row["reward"]) == (True, 1, 0.0)
    tasks = spark.createDataFrame([("t", ["a"], [])], LISTS)
    runs = spark.createDataFrame([("r", "other", "pytest", 0, "PASSED a", 0), ("s", "t", "pytest", 0, None, 0)], RUNS)
    rows = {r["run_id"]: r for r in grade_runs(runs, tasks, ["pytest"]).collect()}
    assert (rows["r"]["unknown_task"], rows["r"]["reward"]) == (True, 0.0)
    assert (rows["s"]["f2p_not_found"], rows["s"]["reward"]) == (1, 0.0)


def test_unknown_parser_is_unreadable(spark):
    tasks = spark.createDataFrame([("t", [], [])], LISTS)
    rows = [("r", "t", "parse_log_nobody_knows", 0, "x", 0), ("s", "t", None, 0, "x", 0), ("u", "t", "parse_log_jq", 0, "x", 0)]
    graded = grade_runs(spark.createDataFrame(rows, RUNS), tasks)
    assert {r["run_id"]: (r["unreadable"], r["reward"]) for r in graded.collect()} == {
        "r": (True, 0.0), "s": (True, 0.0), "u": (False, 1.0),
    }


def test_many_timings_of_one_name(spark):
    tasks = spark.createDataFrame([("t", ["x"], [])], LISTS)
    log = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda i: F.concat(F.lit("[PASSED] x ["), i.cast("string"), F.lit(" ms]"))), "\n")
    runs = spark.range(2).select(
        F.col("id").cast("string").alias("run_id"), F.lit("t").alias("instance_id"), F.lit("jest_json").alias("parser"),
        F.lit(0).cast("bigint").alias("part"), F.concat(log, F.when(F.col("id") == 1, "\n[FAILED] x [9999 ms]").otherwise("")).alias("log"),
        F.lit(0).alias("exit_code"),
    )
    assert {r["run_id"]: r["reward"] for r in grade_runs(runs, tasks, ["jest_json"]).collect()} == {"0": 1.0, "1": 0.0}


def test_one_name_in_both_groups_and_duplicates(spark):
    row = grade(spark, "--- PASS: a (1s) (1s)", ["a (2s)", "a (3s)"], ["a"], parser="gotest")
    assert (row["f2p_passed"], row["f2p_total"], row["p2p_passed"]) == (2, 2, 1)


def test_renamed_results_follow_the_first_sighting(spark):
    # `a [2 ms]` is first seen after `a`, so it decides, although `a` is updated last.
    log = "[PASSED] a\n[FAILED] a [2 ms]\n[PASSED] a"
    runs = spark.createDataFrame([("r", "jest_json", 0, log)], "run_id STRING, parser STRING, part BIGINT, log STRING")
    rows = normalize_results(extract_test_results(runs, ["jest_json"])).collect()
    assert [(r["test_id"], r["status"]) for r in rows] == [("a", "FAILED")]


def test_policies(spark):
    seen = [(1, "PASSED"), (2, "FAILED"), (3, "PASSED"), (4, "ERROR"), (5, "SKIPPED")]
    df = spark.createDataFrame([("r", "t", s, st) for s, st in seen], "run_id STRING, test_id STRING, seq BIGINT, status STRING")
    got = {p: dedupe(df, p).first()["status"] for p in ("last", "first", "override", "severity", "precedence")}
    assert got == {"last": "SKIPPED", "first": "PASSED", "override": "SKIPPED", "severity": "ERROR", "precedence": "ERROR"}
    with pytest.raises(ValueError):
        dedupe(df, "newest")


def test_parts_of_a_run_are_merged_in_order(spark):
    rows = [("r", "t", "gotest", p, f"--- {w}: a (1s)\n--- PASS: b{p} (1s)", 0) for p, w in enumerate(["PASS", "FAIL", "SKIP"])]
    got = extract_test_results(spark.createDataFrame(rows, RUNS).repartition(3), ["gotest"]).collect()
    assert {r["test_id"]: r["status"] for r in got} == {"a": "SKIPPED", "b0": "PASSED", "b1": "PASSED", "b2": "PASSED"}


def test_custom_extractor(spark):
    def find(log):
        for line in log.split("\n"):
            name, status = line.split("=")
            yield name, status

    register_extractor("custom_pairs", find)
    rows = [("r", "custom_pairs", 0, "a=PASSED\na=FAILED"), ("s", "custom_pairs", 0, "nothing")]
    runs = spark.createDataFrame(rows, "run_id STRING, parser STRING, part BIGINT, log STRING")
    got = {(r["run_id"], r["status"]) for r in extract_test_results(runs, ["custom_pairs"]).collect()}
    assert got == {("r", "FAILED"), ("s", "ERROR")}


def verdict(spark, phase, results, f2p, p2p, code=0):
    tasks = spark.createDataFrame([("t", f2p, p2p)], LISTS)
    runs = spark.createDataFrame([("r", "t", phase, code)], "run_id STRING, instance_id STRING, phase STRING, exit_code INT")
    seen = spark.createDataFrame([("r", k, s) for k, s in results.items()], "run_id STRING, test_id STRING, status STRING")
    states = expected_states(runs, expected_tests(tasks), seen)
    return assess_phases(runs, states).first(), assess_detail(runs, states)


def test_phases(spark):
    base, detail = verdict(spark, "base", {"f": "FAILED", "g": "PASSED", "p": "PASSED", "z": "PASSED"}, ["f", "g"], ["p"], 1)
    assert base["valid"] and base["parsed_test_count"] == 4 and base["observed_fail_to_pass_failure_count"] == 1
    assert {(r["list"], r["test_id"]) for r in detail.where("list like 'obs%'").collect()} == {("observed_fail_to_pass_failures", "f")}
    base, _ = verdict(spark, "base", {"f": "PASSED", "p": "PASSED"}, ["f"], ["p"])
    assert not base["valid"] and base["no_fail_to_pass_failure"]
    base, detail = verdict(spark, "base", {"f": "SKIPPED", "p": "FAILED"}, ["f", "f"], ["p", "m"])
    assert (base["wrong_fail_to_pass_count"], base["wrong_pass_to_pass_count"], base["missing_count"]) == (2, 2, 1)
    assert {r["test_id"]: r["times"] for r in detail.where("list = 'wrong_fail_to_pass'").collect()} == {"f": 2}
    # The same test under two timings: either status is fine before the fix, but it must pass after it.
    base, _ = verdict(spark, "base", {"s": "FAILED"}, ["s (1s)"], ["s (2s)"])
    assert base["valid"] and base["shared_expected_count"] == 1
    gold, _ = verdict(spark, "gold", {"s": "FAILED"}, ["s (1s)"], ["s (2s)"])
    assert not gold["valid"] and gold["wrong_pass_to_pass_count"] == 1
    gold, _ = verdict(spark, "gold", {"f": "PASSED", "p": "PASSED"}, ["f"], ["p"])
    assert gold["valid"] and gold["observed_fail_to_pass_failure_count"] == 0
    assert not verdict(spark, "gold", {"f": "PASSED"}, ["f"], [], code=2)[0]["valid"]


TASK = dict(repo="o/r", base_commit="c", patch="d", test_patch="d", problem_statement="p", image_name="i", language="go",
            FAIL_TO_PASS=["a"], PASS_TO_PASS=["b"])


def task(name, cmd=("pytest",), parser="parse_log_gotest", **other):
    config = {"test_cmd": list(cmd) if cmd is not None else None, "log_parser": parser, "install": None, "base_image_name": None}
    return {"instance_id": name, **TASK, "install_config": config, **other}


def test_metadata(spark):
    rows = [
        task("good"), task("cmd", cmd=[" "]), task("parser", parser="what"), task("empty", FAIL_TO_PASS=[]),
        task("twice", PASS_TO_PASS=["a"]), task("alias", FAIL_TO_PASS=["a (1s)"], PASS_TO_PASS=["a (2s)"]), task("nopatch", patch=""),
    ]
    got = {r["instance_id"]: r for r in validate_metadata(spark.createDataFrame(rows, TASKS)).collect()}
    assert got["good"]["valid"] and got["good"]["test_command_count"] == 1
    assert got["cmd"]["errors"] == ["test_cmd must contain at least one nonempty command"]
    assert got["parser"]["errors"] == ["unknown log parser: 'what'"]
    assert got["empty"]["errors"] == ["FAIL_TO_PASS is empty"]
    assert got["twice"]["errors"] == ["1 test(s) occur verbatim in both FAIL_TO_PASS and PASS_TO_PASS"]
    assert got["alias"]["valid"] and got["alias"]["normalized_cross_group_aliases"] == ["a"]
    assert got["nopatch"]["errors"] == ["patch is empty or not a string"]


def test_tasks_are_checked_from_stored_runs(spark, tmp_path):
    tasks = spark.createDataFrame([task("t"), task("bad", patch="")], TASKS)
    logs = {"base": "--- FAIL: a (1s)\n--- PASS: b (1s)", "gold": "--- PASS: a (1s)\n--- PASS: b (1s)"}
    rows = [(f"{t}-{p}", t, "gotest", 0, log, 1, p) for t in ("t", "bad") for p, log in logs.items()]
    write_runs(spark.createDataFrame(rows, RUNS + ", phase STRING"), str(tmp_path / "runs"))
    phases, verdicts = check_tasks(tasks, read_runs(spark, str(tmp_path / "runs")))
    assert {(r["run_id"], r["valid"]) for r in phases.collect()} == {("t-base", True), ("t-gold", True)}
    assert {r["instance_id"]: (r["phases"], r["valid"]) for r in verdicts.collect()} == {"t": (2, True), "bad": (0, False)}


def test_catalogue_over_shards(spark, tmp_path):
    commands = ['"pytest"', '""', '["a", "b"]', "[]"]
    rows = [(f"t{i}", json.dumps({"test_cmd": json.loads(c)})) for i, c in enumerate(commands)]
    for shard in (0, 1):
        df = spark.createDataFrame(rows[2 * shard : 2 * shard + 2], "instance_id STRING, install_config STRING")
        df.coalesce(1).write.parquet(str(tmp_path / "data" / f"part-{shard}"))
    tasks = read_tasks(spark, str(tmp_path / "data"))
    assert [(r["num_rows"], r["offset"]) for r in shard_layout(tasks).orderBy("offset").collect()] == [(2, 0), (2, 2)]
    index = task_index(tasks)
    assert sorted(map(tuple, index.select("public_index", "raw_index").collect())) == [(0, 0), (1, 2)]
    assert tuple(index_totals(tasks).first()) == (4, 2)
    named = with_public_index(with_raw_index(tasks), index)
    assert {r["public_index"]: r["instance_id"] for r in named.collect()} == {0: "t0", 1: "t2"}
    path = str(tmp_path / "index")
    write_index(index, path)
    assert load_index(spark, path, 4).count() == 2
    with pytest.raises(ValueError):
        load_index(spark, path, 2)


def test_lists_as_text(spark):
    rows = [(1, '["a", "b"]', None), (2, "[]", "null"), (3, '["open', "[]")]
    df = spark.createDataFrame(rows, "id INT, FAIL_TO_PASS STRING, PASS_TO_PASS STRING")
    got = {r["id"]: r for r in normalize_tasks(df, quarantine=True).collect()}
    assert (got[1]["FAIL_TO_PASS"], got[1]["PASS_TO_PASS"], got[1]["broken_lists"]) == (["a", "b"], [], False)
    assert (got[2]["PASS_TO_PASS"], got[3]["broken_lists"]) == ([], True)
    with pytest.raises(Exception):
        normalize_tasks(df).collect()


def test_config_kinds(spark):
    df = spark.createDataFrame([(None,), ("{bad",), ("[1]",), ('{"test_cmd": 3}',)], "install_config STRING")
    got = [(r["config_kind"], r["commands"]) for r in config_columns(df).collect()]
    assert got == [("VOID", None), ("BROKEN", None), ("OTHER", None), ("OBJECT", None)]


def test_selection(spark):
    tasks = spark.range(20).select(F.col("id").alias("public_index"), F.when(F.col("id") % 2 == 0, "go").alias("language"))
    ranges = parse_ranges(spark, "1,3-5, 4-6,19-25")
    assert sorted(r[0] for r in in_ranges(tasks, ranges).select("public_index").collect()) == [1, 3, 4, 5, 6, 19]
    assert [r[0] for r in out_of_range(ranges, 20).collect()] == [20, 21, 22, 23, 24, 25]
    for bad in ("5-3", "-2"):
        with pytest.raises(ValueError):
            parse_ranges(spark, bad)
    assert [r[0] for r in modulo_shard(tasks, 1, 4, most=2).select("public_index").collect()] == [1, 5]
    with pytest.raises(ValueError):
        modulo_shard(tasks, 4, 4)
    first = stratified_sample(tasks, 3, seed=1).select("stratum", "public_index").collect()
    again = stratified_sample(tasks.repartition(5), 3, seed=1).select("stratum", "public_index").collect()
    assert sorted(first) == sorted(again) and {r["stratum"] for r in first} == {"go", "unknown"} and len(first) == 6
    recorded = spark.createDataFrame([(1, True)], "index BIGINT, valid BOOLEAN")
    chosen = select_tasks(tasks, ranges, shard=1, shards=2, recorded=recorded)
    assert sorted(r["public_index"] for r in chosen.collect()) == [3, 5, 19]


def test_result_log(spark, tmp_path):
    path = str(tmp_path / "log")
    lines = ['{"index": 1, "seq": 1, "valid": true}', "broken {", "[1]", '{"index": "2", "seq": 2}', '{"index": 2.9, "seq": 3, "valid": "false"}',
             '{"index": 1, "seq": 4, "valid": 0}', '{"index": null, "valid": true}', '{"index": "x"}', '{"index": true, "seq": 5, "valid": [0]}']
    spark.createDataFrame([(x,) for x in lines], "value STRING").coalesce(1).write.text(path)
    latest = latest_results(read_results(spark, path))
    assert {r["index"]: r["valid"] for r in latest.collect()} == {1: True, 2: True}
    selected = spark.createDataFrame([(1,), (2,), (3,)], "index BIGINT")
    assert [r["index"] for r in pending(selected, latest).collect()] == [3]
    assert tuple(run_summary(selected, latest).first()) == (3, 2, 0)
    more = spark.createDataFrame([(True, 9, 3)], "valid BOOLEAN, seq BIGINT, index BIGINT")
    out = str(tmp_path / "out")
    write_results(more, out)
    write_results(more, out, resume=True)
    assert [r["value"] for r in spark.read.text(out).collect()] == ['{"index":3,"seq":9,"valid":true}'] * 2
    # A repeated write adds nothing, one that was not committed does not count, and later writes win.
    later = spark.createDataFrame([(False, 3)], "valid BOOLEAN, index BIGINT")
    for _ in range(2):
        write_results(later.drop("seq"), str(tmp_path / "two"), resume=True, write_id="a")
    write_results(later.withColumn("valid", F.lit(True)), str(tmp_path / "two"), resume=True, write_id="b")
    later.write.json(str(tmp_path / "two" / "write=lost"))
    again = read_results(spark, str(tmp_path / "two"))
    assert again.count() == 2 and [(r["index"], r["valid"]) for r in latest_results(again).collect()] == [(3, True)]
    for _ in range(2):
        summary = record_checks(selected, later, str(tmp_path / "two"), write_id="c")
    assert [tuple(r[c] for c in ("selected", "completed", "invalid")) for r in summary.collect()] == [(3, 1, 1)]


def test_context_across_blocks_of_one_long_run(spark):
    # One run holds nearly all lines; headers are far apart and cross many blocks.
    lines = spark.range(5000).select(
        F.when(F.col("id") % 1000 == 999, "small").otherwise("big").alias("run_id"), F.expr("id div 64").alias("part"), F.col("id").alias("seq")
    )
    header = F.when(F.col("seq") % 1500 == 0, F.col("seq"))
    got = carry(lines, header, "header")
    assert got.where("run_id = 'big' and header <> seq div 1500 * 1500").count() == 0
    assert got.where("run_id = 'small' and header is not null").count() == 0
    gate = section_gate(lines, F.col("seq") == 2000)
    assert gate.where("inside").count() == 5000 - 2001 - 3 and gate.where("inside and seq <= 2000").count() == 0
    leaves = leaf_lines(lines.withColumn("level", F.col("seq") % 2))
    assert leaves.where("run_id = 'big' and is_leaf and seq % 2 = 0 and seq not in (998, 1998, 2998, 3998, 4998)").count() == 0


def test_hot_task_is_graded_whole(spark):
    # A third of all runs belong to one task, and one run sees one test thousands of times.
    tasks = spark.createDataFrame([(f"t{i}", ["T"], []) for i in range(50)], LISTS)
    runs = spark.range(300).select(
        F.concat(F.lit("r"), F.col("id")).alias("run_id"),
        F.when(F.col("id") % 3 == 0, "t0").otherwise(F.concat(F.lit("t"), F.col("id") % 50)).alias("instance_id"),
        F.lit("gotest").alias("parser"), F.lit(0).cast("bigint").alias("part"),
        F.repeat(F.lit("--- PASS: T (1s)\n"), F.when(F.col("id") == 0, 5000).otherwise(1)).alias("log"), F.lit(0).alias("exit_code"),
    )
    graded = grade_runs(runs, tasks, ["gotest"])
    assert graded.count() == 300 and graded.where("reward = 1.0").count() == 300


@pytest.mark.parametrize("name", sorted(n for n, d in REGISTRY.entries.items() if not d.whole))
def test_plan_keeps_logs_out_of_shuffles(spark, tmp_path_factory, name):
    tasks = spark.createDataFrame([("t", ["a"], [])], LISTS)
    path = str(tmp_path_factory.getbasetemp() / "stored")
    if not os.path.exists(path):
        write_runs(spark.createDataFrame([("r", "t", n, k, "--- PASS: a (1s)", 0) for n in REGISTRY.entries for k in (0, 1)], RUNS), path)
    plan = observe_runs(read_runs(spark, path), tasks, [name])._jdf.queryExecution().executedPlan()
    exchanges = [line for line in plan.toString().split("\n") if "Exchange" in line]
    assert exchanges and "PartitionFilters: [parser#" in plan.toString()
    assert "CartesianProduct" not in plan.toString() and "BroadcastNestedLoopJoin" not in plan.toString()
    # Below no exchange does a column come through that is a log or a piece of one.
    nodes = exchange_nodes(plan)
    # Of reports that must be well-formed as a whole, the pieces of one that is cut are put together.
    texts = "log|body|all|chunks|lines|items|text|pieces?" if name not in WHOLE_REPORTS else "log|body|all|chunks|lines|items|text"
    assert nodes and not [o for node in nodes for o in outputs_of(node) if re.match(rf"({texts})#", o)]


WHOLE_REPORTS = ("combined_test_reports", "gradlew_v1", "r_junit", "doctest")


def exchange_nodes(plan):
    """Exchanges of a plan, also inside adaptive ones."""
    todo, found = [plan], []
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.initialPlan())
            continue
        if "Exchange" in node.nodeName():
            found.append(node)
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def outputs_of(node):
    return [node.output().apply(i).toString() for i in range(node.output().size())]


def test_numbering_does_not_gather_the_rows_of_a_file(spark, tmp_path):
    spark.range(40).selectExpr("id as o_orderkey").coalesce(1).write.parquet(str(tmp_path / "orders"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        numbered = with_raw_index(spark.read.parquet(str(tmp_path / "orders")))
        assert "hashpartitioning(_path" not in numbered._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, numbered.collect())) == [(i, i) for i in range(40)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_states_of_normalised_results_need_no_further_shuffle(spark):
    runs = spark.createDataFrame([("r", "t", 0), (None, "t", 0)], "run_id string, instance_id string, exit_code int")
    listed = [("t", "F2P", "a"), ("t", "P2P", "a"), ("t", "F2P", "a"), ("t", "P2P", "b"), ("t", "P2P", None), ("u", "F2P", "z")]
    expected = spark.createDataFrame(listed, "instance_id string, grp string, norm_id string")
    seen = [("r", "a", "PASSED"), ("r", "c", "FAILED"), (None, "b", "ERROR")]
    results = spark.createDataFrame(seen, "run_id string, test_id string, status string").withColumn("first_pos", F.lit(1))
    states = expected_states(runs, expected, normalize_results(results, 1))
    above_union = states._jdf.queryExecution().executedPlan().toString().partition("Union")[0]
    assert "Exchange" not in above_union
    got = {(r.run_id, r.test_id): (r.in_f2p, r.in_p2p, r.status, r.seen) for r in states.collect()}
    assert got == {
        ("r", "a"): (2, 1, "PASSED", True), ("r", "b"): (0, 1, "NOT_FOUND", False), ("r", None): (0, 1, "NOT_FOUND", False),
        ("r", "c"): (0, 0, None, True),
        (None, "a"): (2, 1, "NOT_FOUND", False), (None, "b"): (0, 1, "ERROR", True), (None, None): (0, 1, "NOT_FOUND", False),
    }


def test_names_that_need_one_pass_or_two_meet_as_before(spark):
    """Of names that fall together, the first pass decides among its own names before the second does."""
    names = ["x", "x [2 ms]", "x [2 ms] (1s)", "x (1s)", "y [1 ms] (3s)", "y (3s)", " y", "", None, "z (1s) [2 ms] (4s)", "z [9 ms] (1s)"]
    rows = [(run, name, f"S{i}{run}", i * 7 % 11) for run in ("r", None) for i, name in enumerate(names)]
    results = spark.createDataFrame(rows, "run_id string, test_id string, status string, first_pos int")
    once = {r[0]: r[1] for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", normalize_test_name(F.col("n"))).collect()}
    twice = {r[0]: r[1] for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", normalize_test_name(F.col("n"), 2)).collect()}
    assert any(once[n] != twice[n] for n in names)
    expected = {}
    for run in ("r", None):
        of_run = [r for r in rows if r[0] == run]
        steps = {}
        for _, name, status, at in of_run:
            steps.setdefault((twice[name], once[name]), []).append((at, status))
        finals = {}
        for (final, _), seen in steps.items():
            finals.setdefault(final, []).append((min(seen)[0], max(seen)[1]))
        expected |= {(run, final): (max(seen)[1], min(seen)[0]) for final, seen in finals.items()}
    got = normalize_results(results, 2)
    assert {(r.run_id, r.test_id): (r.status, r.first_pos) for r in got.collect()} == expected
    assert "nullif(" in got._jdf.queryExecution().logical().toString()
