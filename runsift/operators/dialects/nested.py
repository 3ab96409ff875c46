"""Dialects in which nesting names the test: trees, braces, event streams.

Within a part, Arrow helpers keep a stack and give the wanted items the names they
stand in; what a part leaves open for later parts is one small row (`nesting`).
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from runsift.functions.binding import bind
from runsift.functions.text import LINE_END, before_last, matches, remove, rstrip, strip
from runsift.functions.variants import as_text, is_true
from runsift.operators.dialects.base import (
    LINE_FEED,
    Dialect,
    emit,
    event_columns,
    later,
    log_lines,
    lookup,
    strong,
    unreadable,
    weak,
)
from runsift.operators.dialects.line_rules import JS_TIMING, OK_NOT
from runsift.operators.dialects.parts import from_earlier, read_parts
from runsift.operators.dialects.suites import BuildReader, CounterReader, announced_classes, build_events, counter_events
from runsift.operators.dialects.xml_text import CaseReader, case_events
from runsift.operators.nesting import with_bracket_paths, with_level_paths
from runsift.schema import ERROR, FAILED, PASSED, SKIPPED


def blanks_ahead(line: Column) -> Column:
    return F.char_length(line) - F.char_length(F.ltrim(line))


def any_blanks_ahead(line: Column) -> Column:
    return F.char_length(line) - F.char_length(remove(line, r"^\s+"))


# --- Jest behind a build command: indented suites -------------------------------

JEST_COMMAND = " ./node_modules/.bin/jest "
JEST_MARKS = {"✓": PASSED, "✕": FAILED}


def read_indented_jest(runs: DataFrame) -> DataFrame:
    """Marked lines below indented suite lines, after each test command.

    Reading stops at the summary of a command and goes on with the next one;
    the suites stay open in between. A marked line of another shape breaks
    the log. A part may begin within the output of an earlier part's command: it
    is read both ways, and the way that the earlier parts tell stays.
    """
    chunks = F.split("log", r"\Q" + JEST_COMMAND + r"\E")

    def summary(x: Column) -> Column:
        return x.startswith("Test Suites") | x.startswith("  ● ")

    def reported(chunk: Column) -> Column:
        lines = F.split(chunk, LINE_FEED)
        stop = F.array_position(F.transform(lines, summary), True).cast("int")
        return F.when(stop > 0, F.slice(lines, F.lit(1), stop - 1)).otherwise(lines)

    def item(line: Column) -> Column:
        mark = F.substring(strip(line), 1, 1)
        is_mark, deep = mark.isin(*JEST_MARKS), any_blanks_ahead(line)
        return F.struct(
            F.when(~is_mark & (deep > 0), deep).alias("level"), strip(line).alias("name"), is_mark.alias("wanted"), deep.alias("deep"),
        )

    own = F.flatten(F.transform(F.slice(chunks, 2, F.size(chunks)), reported))
    ways = F.array(F.struct(F.lit(False).alias("inside"), own.alias("lines")), F.when(F.col("part") > 0, F.struct(F.lit(True).alias("inside"), F.concat(reported(chunks[0]), own).alias("lines"))))
    rows = runs.select("run_id", "part", F.explode(ways).alias("w")).where("w is not null")
    items = F.filter(F.transform("w.lines", item), lambda i: i["wanted"] | i["level"].isNotNull())
    last = F.try_element_at(chunks, F.lit(-1))
    ends_open = F.when(F.size(chunks) > 1, ~F.exists(F.split(last, LINE_FEED), summary)).when(F.exists(F.split(chunks[0], LINE_FEED), summary), False)
    before_part = from_earlier(runs, inside=ends_open)
    begun = before_part.select("run_id", "part", F.coalesce("inside", F.lit(False)).alias("way"))
    rows = rows.select("run_id", "part", F.col("w.inside").alias("way"), (F.col("part") == 0).alias("sure"), items.alias("items"))
    told = with_level_paths(rows, begun)

    # `✓ name (3ms)`, the time only needed for nothing but the name.
    mark, behind = F.left(F.col("name"), F.lit(1)), F.substr(F.col("name"), F.lit(2))
    name = F.when(matches(behind, r"\(\d+ms\)$"), before_last(behind, "(")).otherwise(behind)
    fits = (F.col("deep") > 0) & matches(behind, r"^\s") & F.when(matches(behind, r"\(\d+ms\)"), matches(behind, r"\(\d+ms\)$")).otherwise(True)
    key = strip(F.concat(F.array_join("path", " - "), F.lit(" - "), F.substr(rstrip(name), F.lit(2))))
    return emit(told, F.when(fits, strong(key, lookup(mark, JEST_MARKS))).otherwise(unreadable()))


# --- Haskell: a tree of two blanks per level --------------------------------------

UNCHANGED = "Golden and Actual output didn't change"
# Build output that is no tree, for logs without a start line.
BUILD_NOISE = (
    "Downloading", "Building", "Installing", "Completed", "Starting", "Preprocessing", "Configuring",
    "Linking", "Resolving dependencies", "Build profile", "In order, the following will be built",
    "Error:", "Test suite ", "Running ",
)
FAILURES_END = ("To rerun use:", "Randomized with seed", "Finished in ", "Test suite ")


def first_match(lines: Column, test) -> Column:
    return F.array_position(F.transform(lines, test), True).cast("int")


def any_of(tests) -> Column:
    return reduce(Column.__or__, tests)


def first_part(runs: DataFrame, **places: Column) -> DataFrame:
    """One row for each run: the first part in which a place is over 0, by name."""
    found = [F.min(F.when(place > 0, F.col("part"))).alias(name) for name, place in places.items()]
    return runs.groupBy(F.col("run_id").alias("of_run")).agg(*found)


def read_spec_tree(runs: DataFrame) -> DataFrame:
    """Leaves of the tree between the start line and `Failures:`.

    The names listed below `Failures:` fail whatever the tree says. The tree begins
    below the first start line of the run; in runs without one at the first line
    that looks like a tree, or else at the first line. A part is read in each way that
    may hold for it, and the way that the run's first such lines tell stays.
    """
    logs = runs.select("run_id", "part", F.split("log", LINE_END).alias("all"))

    def looks_like_tree(line: Column) -> Column:
        return (line != "") & ~line.startswith(" ") & line.contains(".") & ~any_of([line.contains(t) for t in BUILD_NOISE])

    logs = logs.withColumns({
        "end": first_match(F.col("all"), lambda x: strip(x) == "Failures:"),
        "start": first_match(F.col("all"), lambda x: x.startswith("Test suite ") & x.contains(": RUNNING...")),
        "guess": first_match(F.col("all"), looks_like_tree),
    })
    bounds = first_part(logs, end_part=F.col("end"), start_part=F.col("start"), guess_part=F.col("guess"))

    # Ways to read a part: from a line on (counted from 1).
    ways = F.array(
        F.when(F.col("start") > 0, F.struct(F.lit("start").alias("way"), (F.col("start") + 1).alias("first"))),
        F.when(F.col("guess") > 0, F.struct(F.lit("guess").alias("way"), F.col("guess").alias("first"))),
        F.struct(F.lit("whole").alias("way"), F.lit(1).alias("first")),
    )
    sure = (F.col("part") == 0) & (F.col("start") > 0)
    ways = F.when(sure, F.slice(ways, 1, 1)).otherwise(ways)
    cut = logs.select("run_id", "part", "all", "end", sure.alias("sure"), F.explode(ways).alias("w")).where("w is not null").select("run_id", "part", "all", "end", "sure", "w.*")
    past = F.when(F.col("end") > 0, F.col("end")).otherwise(F.size("all") + 1)
    tree = F.slice("all", F.col("first"), F.greatest(past - F.col("first"), F.lit(0)))

    def item(line: Column) -> Column:
        text = strip(line)
        # `name FAILED [1]`; `name PENDING why`, whatever the case.
        is_failed = matches(text, r"\sFAILED\s*\[\d+\]$")
        waits = F.regexp_extract(text, r"(?iU)^(.*?)\s+(?:PENDING|SKIPPED)\b", 1)
        is_pending = matches(text, r"\s(?:PENDING|SKIPPED)\b", nocase=True)
        name = F.when(is_failed, rstrip(before_last(text, "FAILED"))).when(is_pending, strip(waits)).otherwise(text)
        return F.struct(
            F.floor(blanks_ahead(line) / 2).cast("int").alias("level"),
            name.alias("name"),
            F.lit(True).alias("wanted"),
            F.when(is_failed, FAILED).when(is_pending, SKIPPED).otherwise(PASSED).alias("status"),
            blanks_ahead(line).alias("indent"),
        )

    items = F.transform(F.filter(tree, lambda x: (strip(x) != "") & (strip(x) != UNCHANGED)), item)
    rows = cut.select("run_id", "part", "way", "sure", items.alias("items"))
    of_run = F.col("run_id") == F.col("of_run")
    chosen = runs.select("run_id", "part").join(bounds, of_run).where(F.coalesce(F.col("end_part") >= F.col("part"), F.lit(True)))
    chosen = chosen.select(
        "run_id", "part",
        F.when(F.col("start_part") == F.col("part"), "start").when(F.col("start_part") < F.col("part"), "whole").when(F.col("start_part") > F.col("part"), "none")
        .when(F.col("guess_part") == F.col("part"), "guess").when(F.col("guess_part") > F.col("part"), "none").otherwise("whole").alias("way"),
    )
    leaves = with_level_paths(rows, chosen, leaves_by="indent")
    key = F.array_join(F.filter(F.concat("path", F.array("name")), lambda s: s != ""), ".")
    tree_events = emit(leaves, strong(key, F.col("status")))

    # `1) A, b, c` below the first `Failures:`, up to the first line that ends the list.
    listed = logs.select("run_id", "part", F.posexplode(F.transform("all", strip)).alias("seq", "line"), "end")
    line = F.col("line")
    stop = any_of([line.startswith(t) for t in FAILURES_END])
    listed = listed.where(stop | matches(line, r"^\d+\)\s"))
    first_end = logs.where("end > 0").groupBy(F.col("run_id").alias("of_run")).agg(F.min(F.struct("part", F.col("end").alias("seq"))).alias("from"))
    listed = listed.join(first_end, of_run).where(F.struct("part", "seq") >= F.col("from"))
    closed = listed.where(stop).groupBy(F.col("of_run").alias("closed_run")).agg(F.min(F.struct("part", "seq")).alias("to"))
    listed = listed.where(~stop).join(closed, F.col("run_id") == F.col("closed_run"), "left").where(F.coalesce(F.struct("part", "seq") < F.col("to"), F.lit(True)))
    names = F.transform(F.split(strip(F.substr(line, F.instr(line, ")") + 1)), ","), strip)
    return tree_events.unionByName(later(emit(listed, strong(F.array_join(names, "."), FAILED), certain=True)))


# --- TAP with braces ----------------------------------------------------------------


def read_braced_tap(runs: DataFrame) -> DataFrame:
    """`ok 1 - name {` opens a block, a line of `}` closes as many."""
    lines = F.filter(F.transform(F.split("log", LINE_END), strip), lambda x: x != "")

    def item(line: Column) -> Column:
        closing = F.replace(line, F.lit("}"), F.lit("")) == ""
        opens = line.endswith("{")
        text = F.when(opens, rstrip(F.rtrim(line, F.lit("{")))).otherwise(line)
        told = F.regexp_extract(text, r"(?U)^(?:not )?ok\s+\d+\s+-\s+(.*)$", 1)
        bare = strip(remove(told, r"\s+#(?s:.*)$"))
        name = strip(remove(bare, JS_TIMING))
        named = ~closing & (name != "")
        return F.struct(
            F.when(closing, F.char_length(line)).otherwise(0).alias("closes"),
            (named & opens).alias("opens"),
            F.when(named, name).alias("name"),
            named.alias("wanted"),
            F.when(F.lower(told).rlike("# skip|# todo"), SKIPPED).otherwise(lookup(F.when(text.startswith("ok"), "ok").otherwise("not ok"), OK_NOT)).alias("status"),
        )

    items = F.filter(F.transform(lines, item), lambda i: i["wanted"] | (i["closes"] > 0))
    named = with_bracket_paths(runs.select("run_id", "part", items.alias("items")))
    key = F.array_join(F.concat("path", F.array("name")), " :: ")
    status = F.col("status")
    return emit(named, F.when(status == PASSED, weak(key, PASSED)).otherwise(strong(key, status)))


# --- Dart: a stream of JSON events ----------------------------------------------------


def read_dart_events(runs: DataFrame) -> DataFrame:
    """`testStart` gives an id its name, `testDone` gives it a result.

    Only these two kinds of events, a few fields each, leave their row: they meet by id.
    """
    # Every step is computed once: a text is parsed once, and fields are read for the kind of event that has them.
    lines = bind(log_lines(runs, LINE_END), "run_id", "part", "seq", line=strip(F.col("line")))
    lines = lines.where((F.col("line").startswith("{") | F.col("line").startswith("[")) & F.col("line").contains("test"))
    is_list = F.col("line").startswith("[")
    values = bind(lines, "run_id", "part", "seq", is_list=is_list, value=F.try_parse_json("line")).where("value is not null")
    items = F.when(F.col("is_list"), F.try_variant_get("value", "$", "array<variant>")).otherwise(F.array("value"))
    events = values.select("run_id", "part", "seq", F.posexplode(items).alias("sub", "e"))

    def at(path: str) -> Column:
        return F.try_variant_get("e", path, "variant")

    place = ("run_id", "part", "seq", "sub")
    events = bind(events, *place, "e", type=as_text(F.col("e"), "$.type")).where(F.col("type").isin("testStart", "testDone"))
    starts = F.col("type") == "testStart"
    events = bind(
        events, *place, starts=starts, id=F.to_json(F.when(starts, at("$.test.id")).otherwise(at("$.testID"))),
        name=F.when(starts, at("$.test.name")), result=F.when(~starts, as_text(F.col("e"), "$.result")),
        hidden=F.when(~starts, at("$.hidden")), skipped=F.when(~starts, at("$.skipped")),
    ).where(F.col("id") != "null")
    starts, result = F.col("starts"), F.col("result")
    events = bind(
        events, *place, "starts", "id", "result", "hidden", "skipped",
        kind=F.schema_of_variant("name"), said=as_text(F.col("name")), true=F.when(starts, is_true(F.col("name"))).otherwise(False),
    )
    is_start = starts & F.col("true") & ~F.coalesce(F.col("said").startswith("loading "), F.lit(False))
    is_done = ~starts & (F.col("hidden").isNull() | ~is_true(F.col("hidden")))
    skipped = F.when(F.col("skipped").isNotNull(), F.when(is_true(F.col("skipped")), SKIPPED))
    status = F.coalesce(lookup(result, {"success": PASSED, "failure": FAILED, "error": ERROR}), skipped)
    events = events.where(is_start | is_done).select(
        *place, "id", F.when(starts, F.col("said")).alias("name"), F.when(~starts, status).alias("status"),
        (starts & (F.col("kind") != "STRING")).alias("broken"),
    )
    # The events of an id, a few fields each, meet in one shuffle; an event that lacks a key belongs to nothing.
    before = Window.partitionBy("run_id", "id").orderBy("part", "seq", "sub").rowsBetween(Window.unboundedPreceding, -1)
    events = events.where("run_id is not null and part is not null").withColumn("name", F.coalesce("name", F.last("name", ignorenulls=True).over(before)))
    events = events.where("broken or (status is not null and name is not null)")
    one = F.when(F.col("broken"), unreadable()).otherwise(strong(F.col("name"), F.col("status")))
    told = events.select("run_id", "part", F.col("seq").cast("bigint").alias("seq"), "sub", one.alias("e"))
    return event_columns(told.select("run_id", "part", "seq", "sub", "e.*"))


# --- Surefire with fallbacks --------------------------------------------------------


def read_surefire(runs: DataFrame) -> DataFrame:
    """Surefire lines first; reports and single builds fill in what is unknown.

    A run that yields nothing else has its announced classes as passed. All are read in one pass over the logs.
    """
    parts = read_parts(runs, CounterReader, CaseReader, BuildReader)
    found = counter_events(parts).unionByName(case_events(parts)).unionByName(build_events(parts, prio=0))
    # Compared null-safe, so that both sides use the one exchange of parts: Spark would else keep null keys out of it on one side.
    runs_found = found.select(F.col("run_id").alias("of_run")).distinct()
    bare = announced_classes(parts).join(runs_found, F.col("run_id").eqNullSafe(F.col("of_run")) & F.col("run_id").isNotNull(), "left_anti")
    return found.unionByName(bare.select(found.columns))


DIALECTS = (
    Dialect("calypso", read_indented_jest),
    Dialect("haskell_v2", read_spec_tree),
    Dialect("js_3", read_braced_tap),
    Dialect("dart", read_dart_events),
    Dialect("java_mvn", read_surefire),
)
