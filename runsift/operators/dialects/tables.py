"""Dialects with tables, gated parts or a second reading of the log."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from runsift.functions.text import BLANKS, LINE_END, before, before_last, last_word, matches, remove, rstrip, rx, strip, strip_ansi, without_right, without_time
from runsift.operators.dialects.base import (
    LINE_FEED,
    Dialect,
    LineReader,
    emit,
    emit_log,
    later,
    log_lines,
    lookup,
    one_line_per_feed,
    sections,
    strong,
    weak,
)
from runsift.operators.dialects.line_rules import JS_TIMING
from runsift.operators.dialects.parts import from_earlier, has_line, last_like
from runsift.schema import ERROR, FAILED, PASSED, SKIPPED


def clean_lines(log: Column) -> Column:
    return F.transform(F.split(log, LINE_END), strip)


def first_place(lines: Column, test) -> Column:
    """Number of the first line (from 1) that passes a test; 0 if none does."""
    return F.array_position(F.transform(lines, test), True).cast("int")


def either(tests: list[Column]) -> Column:
    return reduce(Column.__or__, tests)


# --- C++ bindings tested from Python ------------------------------------------

BANNER = "=================================== FAILURES ==================================="
UNDERLINE = "_" * 27
CPP_STATUSES = (PASSED, FAILED, SKIPPED, ERROR)


def read_cpp(runs: DataFrame) -> DataFrame:
    """`path::name STATUS` lines up to the failures banner, then headers only.

    The first banner of a run may stand in an earlier part.
    """
    line = F.col("line")

    def banner(x: Column) -> Column:
        return x.startswith(BANNER)

    cut = runs.select("run_id", "part", clean_lines(F.col("log")).alias("all")).withColumn("banner", first_place(F.col("all"), banner))
    lines = cut.select("run_id", "part", "banner", F.posexplode("all").alias("seq", "line"))
    # `____ name ____`: the name lies between the underlines.
    headed = line.startswith(UNDERLINE + " ") & line.endswith(" " + UNDERLINE)
    told = F.translate(line, "\t", " ")
    lines = lines.where(headed | either([told.contains(f" {s}") for s in CPP_STATUSES]))
    above = (F.col("banner") == 0) | (F.col("seq") + 1 < F.col("banner"))
    lines = lines.withColumn("above", above)
    # Below the banner for sure, above it for sure, or above it unless an earlier part has one.
    first = runs.where(has_line(one_line_per_feed(F.col("log")), rf"\s*{BANNER}")).groupBy(F.col("run_id").alias("of_run")).agg(F.min("part").alias("first_part"))
    unsure = lines.where("above and part > 0").join(first, (F.col("run_id") == F.col("of_run")) & (F.col("first_part") < F.col("part")), "left")
    unsure = unsure.withColumn("above", F.col("first_part").isNull()).drop("of_run", "first_part")
    lines = lines.where("not above or part = 0").unionByName(unsure)
    found = None
    for status in CPP_STATUSES:
        name = F.substring_index(rstrip(before(told, f" {status}")), "::", -1)
        one = weak(name, status) if status == PASSED else strong(name, status)
        found = (F if found is None else found).when(told.contains(f" {status}"), one)
    header = F.when(headed, strong(strip(F.btrim(line, F.lit("_"))), FAILED))
    return emit(lines.where("above"), found).unionByName(later(emit(lines.where("not above"), header)))


KEYWORDS = ((r"(?i)\bSKIPPED\b", SKIPPED), (r"(?i)\b(FAILED|FAIL|FAILURE)\b", FAILED), (r"(?i)\b(OK|PASSED)\b", PASSED))


def cpp_summary_line(line: Column) -> Column:
    """`group ran N tests in T msec outcome`, `[i/n] name... WORD` lines, and lines that hold a keyword."""
    keyword = None
    for pattern, status in KEYWORDS:
        keyword = (F if keyword is None else keyword).when(line.rlike(pattern), status)

    # group, "ran", count, "tests in", time, unit, outcome
    ran = F.split(F.regexp_replace(line, r"(?i)\s+ran\s+(?=\d+\s+tests\s+in\s+\d)", "\x00"), "\x00")
    words = F.split(F.try_element_at(ran, F.lit(2)), rx(r"\s+"))
    word_at = lambda i: F.try_element_at(words, F.lit(i))
    is_summary = (F.size(ran) == 2) & (F.size(words) > 5) & word_at(4).try_cast("double").isNotNull() & F.lower(word_at(5)).isin("msec", "sec")
    outcome = F.array_join(F.slice(words, 6, F.size(words)), " ")
    key = F.concat_ws(" ", strip(ran[0]), F.lit("ran"), word_at(1), F.lit("tests"), outcome)
    summary = strong(key, F.when(outcome.rlike(r"(?i)\bfailed\b"), FAILED).otherwise(PASSED))

    # The last three dots with one word behind them end the name.
    state = strip(F.substring_index(line, "...", -1))
    named = strip(before_last(line, "..."))
    named = F.when(matches(named, r"^\[\d+/\d+\]"), strip(F.substr(named, F.instr(named, "]") + 1))).otherwise(named)
    is_dotted = line.contains("...") & (state != "") & ~matches(state, r"\s")
    return (
        F.when(is_summary, summary)
        .when(is_dotted, strong(named, F.coalesce(keyword, F.lit(ERROR))))
        .when(keyword.isNotNull(), strong(line, keyword))
    )


# --- Julia: a summary table ----------------------------------------------------


def table_status(numbers: Column, lead: Column, has_fail: Column, has_error: Column) -> Column:
    """Status of a table row from its whole numbers (pass, ..., total).

    Which column a number stands in depends on how many there are, on the
    columns named in the header and, for two, on the blanks before the first.
    """

    def number(i: int) -> Column:
        return F.try_element_at(numbers, F.lit(i)).try_cast("decimal(38,0)")

    count = F.size(numbers)
    return (
        F.when(count == 2, F.when((lead >= 10) | (number(1) != number(2)), ERROR).otherwise(PASSED))
        .when(
            count == 3,
            F.when(~(number(2) > 0), PASSED).when(has_fail & ~has_error, FAILED).otherwise(ERROR),
        )
        .otherwise(F.when(number(3) > 0, ERROR).when(number(2) > 0, FAILED).otherwise(PASSED))
    )


SUMMARY, COLUMNS = "Test Summary:", "| Pass"


def read_julia(runs: DataFrame) -> DataFrame:
    """Rows below `Test Summary:`; a header that names `| Pass` sets the columns.

    Which columns the latest header has, and whether any summary line came before,
    may be known from earlier parts only.
    """
    header = r"(?=.*Test Summary:)(?=.*\| Pass).*"

    def columns(head: Column) -> Column:
        named = F.try_element_at(F.split(head, r"\|"), F.lit(2))
        return F.when(head.contains(SUMMARY) & head.contains(COLUMNS), F.concat(F.when(named.contains("Fail"), "F").otherwise(""), F.when(named.contains("Error"), "E").otherwise("")))

    text = one_line_per_feed(F.col("log"))
    cut = sections(runs, header).withColumn("columns", columns(before(F.col("body"), "\n")))
    cut = cut.withColumn("all", F.split("body", LINE_FEED)).withColumn("opened", F.array_position(F.transform("all", lambda x: x.contains(SUMMARY)), True))
    rows = cut.select("run_id", "part", "section", "columns", "opened", F.posexplode("all").alias("row", "line"))
    line = F.col("line")
    cells = F.substr(line, F.instr(line, "|") + 1)
    numbers = F.filter(F.split(strip(cells), rx(r"\s+")), lambda p: p.rlike(r"(?U)^\d+$"))
    rows = rows.where(line.contains("|") & ~line.contains(SUMMARY) & (F.size(numbers) >= 2) & matches(line, r"\S\s+\|"))
    rows = rows.select(
        "run_id", "part", (F.col("section").cast("bigint") * 2**31 + F.col("row")).alias("seq"), "columns",
        F.when((F.col("opened") > 0) & (F.col("row") >= F.col("opened")), True).alias("opened"),
        strip(before(line, "|")).alias("name"), numbers.alias("numbers"), (F.char_length(cells) - F.char_length(F.ltrim(cells, F.lit(BLANKS)))).alias("lead"),
    )
    # A row in the first section of a later part waits for both.
    waits = F.col("columns").isNull() & (F.col("part") > 0)
    far = from_earlier(runs, far_columns=columns(last_like(text, header)), far_opened=F.when(text.contains(SUMMARY), True))
    given = rows.where(waits).join(far, ["run_id", "part"], "left").withColumns({"columns": F.col("far_columns"), "opened": F.coalesce("opened", "far_opened")}).drop("far_columns", "far_opened")
    rows = rows.where(~waits).unionByName(given).where("opened or columns is not null")
    known = F.coalesce("columns", F.lit(""))
    status = table_status(F.col("numbers"), F.col("lead"), known.contains("F"), known.contains("E"))
    return emit(rows, strong(F.col("name"), status))


# --- R: context lines, then the failures part ------------------------------------

FAILED_TESTS, RESULTS = ("── Failed tests ──", "== Failed tests =="), ("[ FAIL", "══ Results ══")


def read_r(runs: DataFrame) -> DataFrame:
    """`✔ | 60 | name [1.2s]` lines; then the first failed-tests part, which may reach over several parts of the log."""
    line = F.col("line")
    context = log_lines(runs, LINE_END).withColumn("line", strip(line)).where(line.startswith("✔ ") | line.startswith("✖ ") | matches(line, r"^[✔✖]\s"))
    cells = F.split(line, r"\|", 3)
    named = without_time(strip(F.try_element_at(cells, F.lit(3))), "[", "]")
    passed = F.substring(line, 1, 1) == "✔"
    told = F.when((strip(F.substring(cells[0], 2, 1 << 20)) == "") & (strip(named) != ""), strong(named, F.when(passed, PASSED).otherwise(FAILED)))

    all_lines = clean_lines(F.col("log"))
    starts = lambda x: either([x.startswith(t) for t in FAILED_TESTS])
    stops = lambda x: either([x.startswith(t) for t in RESULTS])
    cut = runs.where(either([F.col("log").contains(t) for t in ("Failed tests", "[ FAIL", "Results", "Failure", "Error")])).select("run_id", "part", all_lines.alias("all"))
    cut = cut.withColumn("start", first_place(F.col("all"), starts)).withColumn("stop", first_place(F.col("all"), stops))
    stop_after = first_place(F.slice("all", F.col("start") + 1, F.size("all")), stops)
    cut = cut.withColumn("end", F.when((F.col("start") > 0) & (stop_after > 0), F.col("start") + stop_after).otherwise(0))
    details = cut.select("run_id", "part", "start", "end", "stop", F.posexplode("all").alias("seq", "line"))
    details = details.where((line.startswith("Failure") | line.startswith("Error")) & matches(line, r"^(Failure|Error)\s+\([^)]+\):\s+\S"))
    place = F.col("seq") + 1
    within = (F.col("start") > 0) & (place > F.col("start")) & ((F.col("end") == 0) | (place < F.col("end")))

    # Of the earlier parts: the first one with a start, whether it ended there, and the last one with a stop.
    so_far = Window.partitionBy("run_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    marks = cut.where("start > 0 or stop > 0 or part > 0").select("run_id", "part", "start", "end", "stop")
    opened = F.when(F.col("start") > 0, F.struct("part", (F.col("end") > 0).alias("ended")))
    far = marks.select("run_id", "part", F.first(opened, ignorenulls=True).over(so_far).alias("opened"), F.max(F.when(F.col("stop") > 0, F.col("part"))).over(so_far).alias("stopped")).where("part > 0")
    given = details.where("part > 0").join(far, ["run_id", "part"], "left")
    reached = F.col("opened").isNotNull() & ~F.col("opened.ended") & (F.coalesce(F.col("stopped"), F.col("opened.part")) <= F.col("opened.part"))
    given = given.where(F.when(F.col("opened").isNull(), within).otherwise(reached & ((F.col("stop") == 0) | (place < F.col("stop")))))
    details = details.where("part = 0").where(within).unionByName(given.select(details.columns))
    name = without_time(strip(F.substr(line, F.instr(line, "):") + 2)), "[", "]")
    return emit(context, told).unionByName(later(emit(details, strong(name, F.when(line.startswith("Failure"), FAILED).otherwise(ERROR)), certain=True)))


# --- JavaScript: a mark in front -------------------------------------------------

PASS_MARKS = ("✔", "✓")
FAIL_MARKS = ("✘", "✖", "✕", "×")
SKIP_MARKS = ("○", "◌", "◦", "⚪")
SKIP_WORDS = ("(skipped)", "[skip]", "[skipped]", "[pending]", "[todo]")


def marked_line(line: Column) -> Column:
    """Lines led by one of four sets of marks, or holding a word for skipped."""
    mark = F.substring(line, 1, 1)
    worded = either([F.lower(line).contains(text) for text in SKIP_WORDS])
    told = strip(F.substr(line, F.lit(2)))
    told = F.when(told.startswith("[") & told.contains("]:"), strip(F.substr(told, F.instr(told, "]:") + 2))).otherwise(told)
    told = F.when(told.startswith(":"), strip(F.substr(told, F.lit(2)))).otherwise(told)
    name = strip(remove(told, JS_TIMING))
    bare = line
    for text in SKIP_WORDS:
        bare = F.replace(bare, F.lit(text), F.lit(""))
    bare = strip(remove(strip(bare), JS_TIMING))
    return (
        F.when(mark.isin(*PASS_MARKS) & (name != ""), weak(name, PASSED))
        .when(mark.isin(*FAIL_MARKS) & (name != ""), strong(name, FAILED))
        .when(mark.isin(*SKIP_MARKS) & (name != ""), strong(name, SKIPPED))
        .when(~mark.isin(*PASS_MARKS, *FAIL_MARKS, *SKIP_MARKS) & worded & (bare != ""), strong(bare, SKIPPED))
    )


# --- Scala: colour codes around marked lines ---------------------------------------


SCALA_MARKS = {"+": PASSED, "x": FAILED}


def bare_colours(line: Column) -> Column:
    return strip(F.regexp_replace(strip_ansi(line), r"\[[0-9]{1,2}m", ""))


def coloured_scala_line(line: Column) -> Column:
    """`+ name 3ms` and `x name 3ms` once colours are off, with or without their escape sign."""
    mark = F.left(line, F.lit(1))
    told = strip(F.substr(line, F.lit(2)))
    name = rstrip(without_right(told, F.char_length(last_word(told))))
    timed = last_word(told).rlike("^[0-9]+([.][0-9]+)?(m|μ|n)?s$")
    spaced = matches(line, r"^.\s") & (name != "")
    return F.when(mark.isin(*SCALA_MARKS) & timed & spaced, strong(name, lookup(mark, SCALA_MARKS)))


# --- OCaml: suite, number and name behind the status ------------------------------

OCAML_WORDS = {
    "OK": PASSED, "PASS": PASSED, "FAIL": FAILED, "FAILED": FAILED, "ERROR": ERROR, "ERR": ERROR,
    "SKIP": SKIPPED, "SKIPPED": SKIPPED, "TODO": SKIPPED,
}


def ocaml_suite_line(line: Column) -> Column:
    """`[WORD]  suite  3  name`: the parts without the word make the key."""
    told = F.substr(line, F.instr(line, "]") + 1)
    # suite, number and name; the first number with blanks around it parts them
    number = F.regexp_extract(told, rx(r"\s(\d+)\s"), 1)
    place = F.regexp_instr(told, F.lit(rx(r"\s\d+\s")))
    suite, name = strip(F.left(told, place)), strip(F.substr(told, place + 1 + F.char_length(number)))
    word = F.substr(before(line, "]"), F.lit(2))
    hit = line.startswith("[") & line.contains("]") & (number != "") & matches(told, r"^\s") & word.rlike("^[A-Z]+$") & (name != "")
    key = F.array_join(F.filter(F.array(suite, number, name), lambda p: p != ""), " ")
    status = lookup(word, OCAML_WORDS, ERROR)
    return F.when(hit, F.when(status == PASSED, weak(key, PASSED)).otherwise(strong(key, status)))


# --- Dart: a test that is named twice has passed ----------------------------------


def occurrence_status(sightings: Column) -> Column:
    return F.when(sightings >= 2, PASSED).otherwise(ERROR)


def read_dart_counts(runs: DataFrame) -> DataFrame:
    """`[pkg]: 00:01 +3: /p/t.dart: name`; sightings are counted over all parts."""
    line = F.col("line")
    lines = log_lines(runs, LINE_END).withColumn("line", strip(line))
    lines = lines.where(line.startswith("[") & line.contains(".dart:") & ~F.lower(line).contains("loading") & matches(line, r"^\[[^\]]+\]:\s+\d+:\d+\s+\+\d+:\s+/[^:]+\.dart:\s+\S"))
    path = F.regexp_extract(line, r"(/[^:]+\.dart):", 1)
    name = strip(F.substr(line, F.instr(line, ".dart:") + 6))
    seen = lines.select("run_id", "part", F.col("seq").cast("bigint").alias("seq"), F.concat(path, F.lit(": "), name).alias("key"))
    seen = seen.groupBy("run_id", "key").agg(F.min(F.struct("part", "seq")).alias("at"), F.count(F.lit(1)).alias("n"))
    seen = seen.select("run_id", "at.part", "at.seq", "key", "n")
    return emit(seen, strong(F.col("key"), occurrence_status(F.col("n"))), certain=True)


# --- Browser runner: failures in the whole text ------------------------------------


BROWSER = r"[\d.]+[^\S\r\n]\(.+?\)[^\S\r\n](.*)FAILED$"


def read_browser_failures(runs: DataFrame) -> DataFrame:
    """`Chrome 1.2 (OS) nameFAILED`; the version may stand on the line below, and that in the next part."""
    text = strip_ansi(F.col("log"))
    names = F.regexp_extract_all(text, F.lit(rf"(?dUm)Chrome\s{BROWSER}"), F.lit(1))
    inside = emit_log(runs.where(F.col("log").contains("FAILED")), F.transform(names, lambda n: strong(n, FAILED)))
    first = before(text, "\n")
    heads = runs.where("part > 0").select("run_id", "part", F.lit(-1).alias("seq"), F.when(first.rlike(rf"(?dU)^{BROWSER}"), F.regexp_extract(first, rf"(?dU)^{BROWSER}", 1)).alias("name")).where("name is not null")
    ended = from_earlier(runs, ended=text.endswith("Chrome\n")).where("ended")
    return inside.unionByName(emit(heads.join(ended, ["run_id", "part"]), strong(F.col("name"), FAILED)))


DIALECTS = (
    Dialect("cpp", read_cpp),
    LineReader(cpp_summary_line).dialect("cpp_v3"),
    Dialect("julia", read_julia),
    Dialect("r", read_r),
    LineReader(marked_line).dialect("js_4"),
    LineReader(coloured_scala_line, prepare=bare_colours).dialect("scala_v2"),
    LineReader(ocaml_suite_line).dialect("ocaml"),
    Dialect("dart_v2", read_dart_counts),
    Dialect("chart_js", read_browser_failures),
)
