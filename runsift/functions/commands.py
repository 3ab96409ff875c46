"""Test commands: read the string-or-list field, cut commands into stages."""

from pyspark.sql import Column, DataFrame, functions as F

from runsift.functions.binding import bind
from runsift.functions.text import is_blank, strip


def coerce_commands(value: Column, kind: Column) -> Column:
    """Commands of a `test_cmd` value, given with its kind.

    A string gives one command, a list its non-blank strings, in the original
    spelling. Anything else, or nothing left, gives null.
    """
    items = F.try_variant_get(value, "$", "array<variant>")
    texts = F.transform(
        items, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    )
    one = F.array(F.try_variant_get(value, "$", "string"))
    listed = F.when(kind == "STRING", one).when(kind.startswith("ARRAY"), texts)
    kept = F.filter(listed, lambda c: c.isNotNull() & ~is_blank(c))
    return F.nullif(kept, F.array().cast("array<string>"))


def coerce_test_cmd(rows: DataFrame, raw: str, name: str = "commands") -> DataFrame:
    """Add the commands in a column with the JSON text of `test_cmd` values."""
    parsed = bind(rows, _value=F.try_parse_json(raw))
    kinds = bind(parsed, _kind=F.schema_of_variant("_value"))
    return bind(kinds, **{name: coerce_commands(F.col("_value"), F.col("_kind"))}).drop("_value", "_kind")


# Pieces of a command: an escaped character, a quoted text (to the end if it is
# not closed), `&&`, a bracket, a plain run, anything else.
PIECES = (
    r"(?s)(\\.|'[^'\\]*+(?:\\.[^'\\]*+)*+(?:'|\\?\z)"
    r'|"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?\z)'
    r"|`[^`\\]*+(?:\\.[^`\\]*+)*+(?:`|\\?\z)"
    r"""|&&|[(){}\[\]]|[^\\'"`&(){}\[\]]++|.)"""
)
OPENERS, CLOSERS = "({[", ")}]"


def _cut(command: Column) -> Column:
    """Texts between the `&&` outside quotes and brackets, stripped.

    A fold over the pieces of the command tracks the three bracket depths.
    """
    start = F.struct(
        F.lit(0).alias("round"),
        F.lit(0).alias("curly"),
        F.lit(0).alias("square"),
        F.lit("").alias("stage"),
        F.array().cast("array<string>").alias("done"),
    )

    def depth(now: Column, piece: Column, kind: int) -> Column:
        opened, closed = piece == OPENERS[kind], piece == CLOSERS[kind]
        return F.when(opened, now + 1).when(closed, F.greatest(now - 1, F.lit(0))).otherwise(now)

    def step(state: Column, piece: Column) -> Column:
        cut = (piece == "&&") & (state["round"] + state["curly"] + state["square"] == 0)
        return F.struct(
            depth(state["round"], piece, 0).alias("round"),
            depth(state["curly"], piece, 1).alias("curly"),
            depth(state["square"], piece, 2).alias("square"),
            F.when(cut, "").otherwise(F.concat(state["stage"], piece)).alias("stage"),
            F.when(cut, F.concat(state["done"], F.array(state["stage"]))).otherwise(state["done"]).alias("done"),
        )

    pieces = F.regexp_extract_all(command, F.lit(PIECES), F.lit(1))
    return F.aggregate(
        pieces, start, step, lambda s: F.transform(F.concat(s["done"], F.array(s["stage"])), strip)
    )


def command_stages(tasks: DataFrame, commands: str = "commands") -> DataFrame:
    """One row per stage: (instance_id, command_index, stage_index, stage).

    Commands are cut at top-level `&&`; a blank stage makes the command whole.
    """
    rows = tasks.select("instance_id", F.posexplode(commands).alias("command_index", "command"))
    joined = F.col("command").contains("&&")
    rows = bind(rows, cut=F.when(joined, _cut(F.col("command"))).otherwise(F.array(strip(F.col("command")))))
    whole = joined & F.exists("cut", lambda s: s == "")
    stages = F.when(whole, F.array("command")).otherwise(F.col("cut"))
    return rows.select("instance_id", "command_index", F.posexplode(stages).alias("stage_index", "stage"))


def stage_exit_rollup(runs: DataFrame, marker: str = "TEST_COMMAND_END") -> DataFrame:
    """Exit code of each stage marker line and the first non-zero one per run.

    A marker line is `[<marker> index=<command> stage=<stage> exit_code=<code>]`.
    """
    pattern = rf"(?m)^\[{marker} index=(\d+) stage=(\d+) exit_code=(\d+)\]\s*$"
    found = [F.regexp_extract_all("log", F.lit(pattern), F.lit(i)) for i in (1, 2, 3)]
    stages = runs.select("run_id", F.explode(F.arrays_zip(*[f.alias(n) for f, n in zip(found, "abc")])).alias("m"))
    stages = stages.select(
        "run_id",
        F.col("m.a").cast("int").alias("command_index"),
        F.col("m.b").cast("int").alias("stage_index"),
        F.col("m.c").cast("int").alias("code"),
    )
    place = F.col("command_index").cast("bigint") * 2**31 + F.col("stage_index")
    per_run = stages.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("stages"),
        F.count_if(F.col("code") != 0).alias("failed_stages"),
        F.min_by("code", F.when(F.col("code") != 0, place)).alias("first_code"),
    )
    return per_run.select(
        "run_id", "stages", "failed_stages", F.coalesce("first_code", F.lit(0)).alias("exit_code")
    )


def is_ordinary_exit(code: Column) -> Column:
    """0 and 1 are outcomes of a test suite; other codes are broken runs."""
    return F.coalesce(code.between(0, 1), F.lit(False))
