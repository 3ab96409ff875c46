"""Text, command and task functions against worked examples."""

import pytest
from pyspark.sql import functions as F

from runsift.functions.commands import coerce_test_cmd, command_stages, stage_exit_rollup
from runsift.functions.tasks import image_reference, render_prompt
from runsift.functions.text import bound_excerpt, bound_text, normalize_test_name
from runsift.operators.diagnostics import repository_state
from runsift.operators.extract import dialect_of, parser_names, resolve_parser


def column(spark, values, name="x"):
    return spark.createDataFrame([(v,) for v in values], f"{name} STRING")


@pytest.mark.parametrize("passes", [1, 2])
def test_names(spark, passes):
    cases = {
        "plain name": ("plain name",) * 2,
        "   x\x1c ": ("x",) * 2,
        "\x1b[31mred\x1b[0m [1.34 ms]": ("red",) * 2,
        "a ran 3 tests in 29.08 msec all ok": ("a ran 3 tests all ok",) * 2,
        "b (1.234s)": ("b",) * 2,
        "b ( 2 MS )  ": ("b",) * 2,
        "x [2 ms] (1s)": ("x [2 ms]", "x"),
        "x (1s) [2 ms]": ("x",) * 2,
        "y in 3 seconds": ("y in 3 seconds",) * 2,
        "p[1-2]": ("p[1-2]",) * 2,
    }
    df = column(spark, list(cases)).select("x", normalize_test_name(F.col("x"), passes).alias("n"))
    assert {r["x"]: r["n"] for r in df.collect()} == {k: v[passes - 1] for k, v in cases.items()}


def test_bounded_text(spark):
    row = column(spark, ["abcdefghij"]).select(
        bound_text(F.col("x"), 5, "cut").alias("a"), bound_text(F.col("x"), 10).alias("b"),
        bound_text(F.col("x"), 0).alias("c"), bound_excerpt(F.col("x"), 4).alias("d"),
    ).first()
    assert row["a"] == "ab\n\n... [cut: 5 characters omitted] ...\n\nhij"
    assert (row["b"], row["c"]) == ("abcdefghij", "")
    assert row["d"] == "ab\n... [preflight truncated 6 characters] ...\nij"


def test_commands(spark):
    cases = {
        '"pytest"': ["pytest"], '""': None, '["a", " ", null, 3, "b "]': ["a", "b "], "[]": None, "3": None,
        "null": None, '{"a": 1}': None, "broken": None, '[" "]': None,
    }
    rows = coerce_test_cmd(column(spark, list(cases)), "x").collect()
    assert {r["x"]: r["commands"] for r in rows} == cases


def test_stages(spark):
    cases = {
        "a && b": ["a", "b"],
        " a ": ["a"],
        "a && 'b && c'": ["a", "'b && c'"],
        "(a && b) && {c && d;} && [ e && f ]": ["(a && b)", "{c && d;}", "[ e && f ]"],
        "a \\&& b": ["a \\&& b"],
        "a && ": ["a && "],
        "&& a": ["&& a"],
        "a && && b": ["a && && b"],
        "a &&& b": ["a", "& b"],
        ") a && b": [") a", "b"],
        "'it\\'s && x' && y": ["'it\\'s && x'", "y"],
        '"open && b': ['"open && b'],
        "`a && b` && c & d": ["`a && b`", "c & d"],
        "a && 'b\\": ["a", "'b\\"],
    }
    tasks = spark.createDataFrame([(k, [k]) for k in cases], "instance_id STRING, commands ARRAY<STRING>")
    got: dict[str, list] = {}
    for r in command_stages(tasks).orderBy("instance_id", "stage_index").collect():
        got.setdefault(r["instance_id"], []).append(r["stage"])
    assert got == cases


def test_stage_exits(spark):
    log = "\n".join(f"[TEST_COMMAND_END index={c} stage={s} exit_code={e}]" for c, s, e in [(0, 0, 0), (1, 0, 2), (0, 1, 3)])
    runs = spark.createDataFrame([("a", log), ("b", "[TEST_COMMAND_END index=0 stage=0 exit_code=0]")], "run_id STRING, log STRING")
    assert {r["run_id"]: (r["stages"], r["failed_stages"], r["exit_code"]) for r in stage_exit_rollup(runs).collect()} == {
        "a": (3, 2, 3), "b": (1, 0, 0),
    }


def test_repository_state(spark):
    text = "x\nSTATUS_BEGIN\n M a\n?? b\nSTATUS_END\nCHANGED_ENTRY_COUNT= 2\nCHANGED_ENTRY_COUNT=no\nTRACKED_DIFF_HASH=abc \n"
    many = "STATUS_BEGIN\n" + "\n".join(f"?? {i}" for i in range(300)) + "\nSTATUS_END"
    states = spark.createDataFrame([(1, text), (2, "STATUS_BEGIN\n M a"), (3, many)], "id INT, state STRING")
    rows = {r["id"]: r for r in repository_state(states, F.col("state")).collect()}
    assert rows[1]["changed_files_preview"] == [" M a", "?? b"]
    assert (rows[1]["changed_entry_count"], rows[1]["tracked_diff_hash"]) == (2, "abc")
    assert (rows[2]["changed_files_preview"], rows[2]["changed_entry_count"]) == ([], None)
    assert len(rows[3]["changed_files_preview"]) == 200


def test_images_and_prompt(spark):
    df = column(spark, ["hosted/a/x:1", "other/x"]).select(image_reference(F.col("x"), "hosted/a/", "public/").alias("r"))
    assert [r["r"] for r in df.collect()] == ["public/x:1", "other/x"]
    text = column(spark, ["repo"]).select(render_prompt(F.col("x"), F.lit("go"), F.lit("bug"), F.lit("/w")).alias("p")).first()["p"]
    assert text.startswith("You are a software engineer working on the repository **repo** (language: go).\n\n## Problem")
    assert text.endswith("only fix the source code.")


def test_parsers(spark):
    assert parser_names()["parse_log_sbt"] == "junit"
    df = column(spark, ["parse_log_flask", "parse_logs_r_junit", "gotest", "nope", None]).select("x", dialect_of(F.col("x")).alias("d"))
    assert {r["x"]: r["d"] for r in df.collect()} == {
        "parse_log_flask": "pytest", "parse_logs_r_junit": "r_junit", "gotest": "gotest", "nope": None, None: None,
    }
    df = spark.createDataFrame([(None, "django/django"), ("nope", "iterative/dvc"), (None, None)], "p STRING, r STRING")
    assert [r[0] for r in df.select(resolve_parser(F.col("p"), F.col("r"))).collect()] == ["django", "pytest", "pytest"]
