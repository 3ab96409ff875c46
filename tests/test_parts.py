"""Logs in parts: reports and trees cut anywhere between lines, files of any size, runs that arrive in pieces."""

import random

import pytest
from pyspark.sql import functions as F

from runsift.operators.dialects.parts import columns_of
from runsift.operators.dialects.suites import BuildReader, CounterReader
from runsift.operators.dialects.xml_text import OUT, TAG, WAIT, CaseReader
from runsift.operators.extract import extract_test_results
from runsift.operators.nesting import with_bracket_paths, with_level_paths
from runsift.schema import RUNS
from runsift.sources import logs
from runsift.sources.logs import read_logs
from runsift.streaming.scores import files_of_backlog, keep_latest, latest_version, remove_old, score_pieces

PIECES = {
    "junit": ['<testcase name="a%d" classname="c"/>', '<testcase name="b%d">', '<testcase classname="k"\n name="d%d"\n>', "</testcase>", "<failure/>", "<error>x\n", "<skipped/>", "noise\n", "<testcase >\n", "\n", '<testcase name="e%d"\n/>', "x" * 1500 + "\n"],
    "js_3": ["ok %d - a {\n", "  ok %d - b\n", "}\n", "}}\n", "not ok %d - c # time=1\n", "noise\n", "\n"],
    "haskell_v2": ["Test suite t: RUNNING...\n", "A\n", "  b%d\n", "    c%d FAILED [1]\n", "      d%d\n", "Failures:\n", "  1) A, b%d\n", "Finished in 1s\n", "Mod.A\n", "\n", "  e PENDING\n"],
    "calypso": ["run ./node_modules/.bin/jest --ci\n", "  Suite %d\n", "    Inner %d\n", "      ✓ t%d (3ms)\n", "      ✕ u%d\n", "Test Suites: 1\n", "noise\n"],
    "r_v2": ["* checking a%d ...\n", "* checking b%d ... OK\n", " NOTE\n", "WARNING: x\n", "text\n", "* checking c%d ... ERROR\n", " WARNING\n"],
    "r": ["✔ |  60 | a%d [1.2s]\n", "✖ | 2 | b%d\n", "── Failed tests ──\n", "Failure ('f'): a%d\n", "Error ('f'): c%d\n", "[ FAIL 1 ]\n", "text\n"],
    "julia": ["Test Summary: | Pass  Fail  Total\n", "Test Summary: | Pass  Error  Total\n", "Test Summary:\n", "  a%d | 1 1 2\n", "b%d | 3 3\n", "text\n"],
    "cpp": ["x::a%d PASSED\n", "y::b%d FAILED\n", "=================================== FAILURES ===================================\n", "_" * 27 + " a%d " + "_" * 27 + "\n", "text\n"],
    "ocaml_v2": ["Running[%d]: (./a.exe)\n", "Running[%d]: (./b.exe)\n", "Output[%d]:\n", "OK\n", "Fatal\n", "skip\n", "\n"],
    "kotlin_junit": ["Running A%d\n", "Tests run: 1, Failures: 0, Errors: 0, Skipped: 0\n", "Tests run: 1, Failures: 1, Errors: 0, Skipped: 0\n", "text\n"],
    "java_mvn": ["[INFO] Running c.A%d\n", "Tests run: 1, Failures: 0, Errors: 0, Skipped: 1\n", "[ERROR] c.B%d.t:3 x\n", "Tests run: 1, Failures: 1, Errors: 0, Skipped: 0 in c.C%d\n", "-Dtest=Z%d\n", "BUILD SUCCESS\n", '<testcase name="t%d">\n', "</testcase>\n"],
    "django": ["t%d (a.B) ... ok\n", "u%d (a.B) ... noise\n", "ok\n", "v%d ... Internal Server Error: /x/\n", "w%d ... Testing against Django installed in x\n", "y silenced).\n", "w%d ... FAIL\n", "text\n"],
    "lein": ["lein test a%d b%d\n".replace("b%d", "b"), "lein test :only c%d/t\n", "FAIL in (x)\n", "ERROR in (y)\n", "text\n"],
    "scala_v3": ["[info] S%d\n", "[info] - a%d (3 ms)\n", "[info] - b *** FAILED ***\n", "text\n"],
}


def cut(log: str, lines: int) -> list[str]:
    pieces = log.split("\n")
    parts = [p + "\n" for p in pieces[:-1]] + [pieces[-1]]
    return ["".join(parts[k : k + lines]) for k in range(0, len(parts), lines)]


@pytest.mark.parametrize("name", sorted(PIECES))
def test_random_logs_read_the_same_however_they_are_cut(spark, name):
    rng = random.Random(name)
    logs_ = ["".join(t.replace("%d", str(rng.randrange(5))) for t in (rng.choice(PIECES[name]) for _ in range(rng.randrange(1, 25)))) for _ in range(60)]
    rows = [(f"{i}/{every}", name, part, text) for i, log in enumerate(logs_) for every in (10_000, 1, 3) for part, text in enumerate(cut(log, every))]
    runs = spark.createDataFrame(rows, "run_id STRING, parser STRING, part BIGINT, log STRING").repartition(5)
    found: dict[str, dict] = {}
    for row in extract_test_results(runs, [name]).collect():
        found.setdefault(row["run_id"], {})[row["test_id"]] = row["status"]
    for i, log in enumerate(logs_):
        whole = found.get(f"{i}/10000", {})
        assert found.get(f"{i}/1", {}) == whole, log
        assert found.get(f"{i}/3", {}) == whole, log
    assert found


def test_paths_of_a_deep_chain_are_linear(spark):
    deep = 100_000
    items = spark.range(1).select(F.lit("r").alias("run_id"), F.lit(0).cast("bigint").alias("part"), F.transform(F.sequence(F.lit(0), F.lit(deep)), lambda i: F.struct(i.alias("level"), i.cast("string").alias("name"), (i == deep).alias("wanted"))).alias("items"))
    assert [len(r["path"]) for r in with_level_paths(items).select("path").collect()] == [deep]


def test_brackets_across_parts(spark):
    kind = "run_id string, part bigint, items array<struct<closes int, opens boolean, name string, wanted boolean>>"
    rows = [("r", 0, [(0, True, "a", True), (0, True, "b", True)]), ("r", 1, [(0, False, "c", True), (1, False, None, False), (0, True, "d", True)]), ("r", 2, []), ("r", 3, [(2, False, None, False), (9, False, None, False), (0, False, "e", True)])]
    got = with_bracket_paths(spark.createDataFrame(rows, kind)).collect()
    assert {r["name"]: list(r["path"]) for r in got} == {"a": [], "b": ["a"], "c": ["a", "b"], "d": ["a"], "e": []}


def test_log_files(spark, tmp_path, monkeypatch):
    folder = tmp_path / "parser=gotest" / "instance_id=t 1"
    folder.mkdir(parents=True)
    (folder / "run-1.log").write_bytes(b"--- PASS: a\xff (1s)\n--- FAIL: b (1s)\r\n" + b"noise\n" * 30 + b"--- SKIP: c (1s)")
    (folder / "run-2.log").write_bytes(b"")
    monkeypatch.setattr(logs, "PART_LINES", 7)
    runs = read_logs(spark, str(tmp_path), part_lines=7)
    assert set(runs.columns) == {"run_id", "part", "log", "parser", "instance_id"} and runs.count() == 5
    assert runs.agg(F.min("part")).first()[0] == 0 and runs.select("part").distinct().count() == 5
    found = {r["test_id"]: r["status"] for r in extract_test_results(runs, ["gotest"]).collect()}
    assert found == {"a�": "PASSED", "b": "FAILED", "c": "SKIPPED"}


def test_runs_in_pieces(spark, tmp_path):
    kind = RUNS + ", parts INT"
    land = lambda rows: spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    land([("whole", "t", "gotest", 0, "--- PASS: a (1s)\n", 0, 1), ("two", "t", "gotest", 1, "--- FAIL: b (1s)\n", 0, 2), ("late", "t", "gotest", 0, "--- PASS: a (1s)\n", 0, 3)])
    land([("two", "t", "gotest", 0, "--- PASS: a (1s)\n", 0, 2)])
    land([("other", "t", "gotest", 0, "", 0, 1)])
    land([("late", "t", "gotest", 2, "--- PASS: c (1s)\n", 0, 3), ("two", "t", "gotest", 1, "--- FAIL: b (1s)\n", 0, 2)])
    arriving = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")

    def grade(runs):
        return extract_test_results(runs, ["gotest"]).groupBy("run_id").agg(F.sort_array(F.collect_list("test_id")).alias("tests"))

    score_pieces(arriving, grade, out, str(tmp_path / "progress"), patience=2).awaitTermination()
    got = {(r["run_id"], tuple(r["tests"]), r["complete"], r["batch"]) for r in spark.read.parquet(f"{out}/scores").collect()}
    assert got == {("whole", ("a",), True, 0), ("two", ("a", "b"), True, 1), ("late", ("a",), False, 2)}
    assert {(r["run_id"], r["part"]) for r in spark.read.parquet(f"{out}/late").collect()} == {("late", 2), ("two", 1)}


def test_latest_rewrites_touched_buckets_only(spark, tmp_path):
    kind = "index BIGINT, valid BOOLEAN, seq BIGINT"
    spark.range(1000).select(F.col("id").alias("index"), F.lit(False).alias("valid"), F.col("id").alias("seq")).coalesce(1).write.parquet(str(tmp_path / "in"))
    for n in range(5):
        spark.createDataFrame([(n, True, 10_000 + n), (7, n == 4, 20_000 + n)], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    keep_latest(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), out, str(tmp_path / "progress"), buckets=16).awaitTermination()
    assert spark.read.parquet(f"{out}/data").where("batch > 0").select("batch", "bucket").distinct().count() <= 10
    removed = remove_old(spark, out)
    table = latest_version(spark, out)
    assert removed > 0 and remove_old(spark, out) == 0
    assert table.count() == 1000 and sorted(r["index"] for r in table.where("valid").collect()) == [0, 1, 2, 3, 4, 7]


def test_a_backlog_is_read_in_a_bounded_number_of_batches(spark, tmp_path):
    kind = "index BIGINT, valid BOOLEAN, seq BIGINT"
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(0, 400, 1, 40).selectExpr("id % 90 as index", "id % 7 = 0 as valid", "id as seq").write.parquet(folder)
    assert files_of_backlog(spark, folder) == 5 and files_of_backlog(spark, folder, least=60) == 60
    arriving = spark.readStream.schema(kind).option("maxFilesPerTrigger", files_of_backlog(spark, folder)).parquet(folder)
    keep_latest(arriving, out, str(tmp_path / "progress"), buckets=4).awaitTermination()
    latest = {n % 90: n % 7 == 0 for n in range(400)}
    assert {r["index"]: r["valid"] for r in latest_version(spark, out).collect()} == latest
    assert spark.read.parquet(f"{out}/data").select("batch").distinct().count() == 8
    # A bucket of a batch is one file, however many tasks there are.
    files = spark.read.parquet(f"{out}/data").select("batch", "bucket", F.input_file_name().alias("file")).distinct()
    assert files.groupBy("batch", "bucket").count().where("count > 1").count() == 0


@pytest.mark.parametrize("name", ["r_v2", "ocaml_v2", "junit", "doctest", "haskell_v2", "java_mvn"])
def test_what_lines_say_is_computed_once_for_all_branches(spark, name):
    runs = spark.createDataFrame([("r", name, 0, "x\n"), ("r", name, 1, "y\n")], "run_id STRING, parser STRING, part BIGINT, log STRING")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = extract_test_results(runs, [name])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    shared = [line for line in plan.splitlines() if "ReusedExchange" in line and "_shared" in line]
    assert shared, plan


@pytest.mark.parametrize("name", ["dart", "calypso", "js_3"])
def test_what_branches_use_is_read_once(spark, name):
    rows = [("r", name, n, "x\n", None) for n in range(2)]
    runs = spark.createDataFrame(rows, "run_id STRING, parser STRING, part BIGINT, log STRING, exit_code INT")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = extract_test_results(runs, [name])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    if name == "dart":
        readings = [line for line in plan.splitlines() if "posexplode" in line and "split(log" in line]
        assert len(readings) == 1, plan
        return
    assert any("ReusedExchange" in line and "_shared" in line for line in plan.splitlines()), plan
    assert sum("REPARTITION_BY_COL" in line and "part#" in line and "ReusedExchange" not in line for line in plan.splitlines()) == 1, plan
    assert sum("EvalPython" in line for line in plan.splitlines()) <= 1, plan


@pytest.mark.parametrize("name", ["junit", "java_mvn", "maven"])
def test_logs_are_read_in_one_pass_for_all_branches(spark, name):
    runs = spark.createDataFrame([("r", name, n, "x\n") for n in range(2)], "run_id STRING, parser STRING, part BIGINT, log STRING")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        plan = extract_test_results(runs, [name])._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sum("MapInArrow read(" in line for line in plan) == 1, plan
    # The walk along the parts is shared as well.
    walks = sum("MapInArrow _along(" in line for line in plan) - sum("ReusedExchange" in line and "way#" in line for line in plan)
    assert walks <= 1, plan
    # Nothing but the reader looks into a log.
    assert not [line for line in plan if "Generate" in line and "log#" in line], plan


def read_alone(reader, log, part=1):
    each = reader()
    each.add("r", part, log)
    return {name: column.to_pylist()[0] for (name, _), column in zip(reader.fields, columns_of(each))}


def test_a_case_is_kept_once_with_the_ways_that_hold_it():
    log = '<testcase name="a"/>\n<testcase name="b">\n<testcase name="c"><error/></testcase>\n<testcase name="d"/>\n<testcase name="e"><skipped/>'
    found = read_alone(CaseReader, log)
    # b holds c: a part that begins in a tag finds b up to the same end; one that waits for an end begins behind it.
    assert [(c["key"], c["status"], c["open"], c["ways"]) for c in found["cases"]] == [
        ("a", "PASSED", False, OUT), ("b", "ERROR", False, OUT | TAG), ("d", "PASSED", False, OUT | TAG | WAIT), ("e", "SKIPPED", True, OUT | TAG | WAIT),
    ]
    assert (found["first_out"], found["first_tag"], found["first_wait"]) == (3, 3, 3)
    nested = read_alone(CaseReader, '<testcase name="a">\n<testcase name="b">\n</testcase>')
    assert [(c["key"], c["ways"]) for c in nested["cases"]] == [("a", OUT), ("b", TAG)]
    first = read_alone(CaseReader, log, part=0)
    assert {c["ways"] for c in first["cases"]} == {OUT} and first["first_tag"] is None


def test_a_part_has_one_small_row_however_many_lines_wait():
    waiting = read_alone(BuildReader, "BUILD SUCCESS\n" * 1000 + "[INFO] BUILD FAILURE\n-Dtest=x\nBUILD SUCCESS\n")
    assert [w["status"] for w in waiting["nameless"]] == ["PASSED", "FAILED"] and [b["test_id"] for b in waiting["builds"]] == ["x"] and waiting["last_test"] == "x"
    counted = read_alone(CounterReader, "Tests run: 1, Failures: 0, Errors: 0, Skipped: 0\n" * 1000 + "[INFO] Running c.A\n")
    assert len(counted["unowned"]) == 1 and counted["counted"] == [] and counted["announced"] == ["c.A"] and counted["last_class"] == "c.A"
    # Announced classes of a run without an id stay, as nothing tells that it has results.
    both = "[INFO] Running c.A\nTests run: 1, Failures: ٣, Errors: 0, Skipped: 0\n"
    assert read_alone(CounterReader, both)["announced"] == [] and [e["status"] for e in read_alone(CounterReader, both)["counted"]] == ["FAILED"]
