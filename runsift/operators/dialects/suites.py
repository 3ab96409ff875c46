"""Dialects in which a header names the suite of the lines below it.

Within a part the log is cut before each header (`sections`), so that the header is
carried down by the cut itself. Lines above the first header of a part inherit the
last header of the parts before it (`parts.inherit`).
"""

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from runsift.functions.binding import bind, share
from runsift.functions.text import BLANKS, LINE_END, before, before_last, last_word, matches, rstrip, rx, strip, without_right, without_time, word
from runsift.operators.context import latest_start
from runsift.operators.dialects.base import (
    LINE_FEED,
    Dialect,
    LineReader,
    emit,
    emit_each,
    emit_log,
    event,
    event_columns,
    log_lines,
    lookup,
    one_line_per_feed,
    ranked,
    section_lines,
    sections,
    strong,
    unreadable,
    weak,
)
from runsift.operators.dialects.line_rules import WORST
from runsift.operators.dialects.parts import inherit, last_like, read_parts, with_earlier
from runsift.schema import ERROR, FAILED, PASSED, SKIPPED




def first_line(body: Column) -> Column:
    return before(body, "\n")


def after(text: Column, mark: str) -> Column:
    """Text behind the first `mark`; empty if there is none."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substr(text, at + len(mark))).otherwise("")


# --- PHP: `Suite (Class)` above marked lines -------------------------------

SUITE_AND_CLASS = r"\w.* \(.+\)$"
PHP_MARKS = {"✔": PASSED, "✘": FAILED, "↩": SKIPPED}


def read_phpunit(runs: DataFrame) -> DataFrame:
    def suite(head: Column) -> Column:
        return F.when(matches(head, "^" + SUITE_AND_CLASS), before_last(head, " ("))

    cut = sections(runs, SUITE_AND_CLASS, any_line_end=False).withColumn("suite", suite(first_line(F.col("body"))))
    line = strip(F.col("line"))
    mark = F.left(line, F.lit(1))
    lines = section_lines(cut, "suite").where(mark.isin(*PHP_MARKS))
    name = without_time(strip(F.substr(line, F.lit(2))), "[", "]")
    lines = lines.select("run_id", "part", "seq", "suite", name.alias("name"), lookup(mark, PHP_MARKS).alias("status"))
    lines = inherit(lines, runs, "suite", suite(last_like(F.col("log"), SUITE_AND_CLASS)))
    key = F.concat(F.coalesce("suite", F.lit("None")), F.lit(" > "), "name")
    return emit(lines, strong(key, F.col("status")), certain=True)


# --- Ruby: one capitalised word above test lines; the worst sighting counts --

CAPITALISED = r"[A-Z][A-Za-z0-9_]*\s*$"
RUBY_WORDS = {
    "PASS": PASSED, "PASSED": PASSED, "FAIL": FAILED, "FAILURE": FAILED,
    "ERROR": ERROR, "SKIP": SKIPPED, "SKIPPED": SKIPPED,
}


def read_ruby_tests(runs: DataFrame) -> DataFrame:
    """A test's name begins with `test` and has no capitals; its status is the last word before the time."""
    head = first_line(F.col("body"))
    cut = sections(runs, CAPITALISED).withColumn("suite", F.when(matches(head, "^" + CAPITALISED), rstrip(head)))
    bare = without_time(strip(F.col("line")), "(", ")")
    status = last_word(bare)
    lines = section_lines(cut, "suite").where(strip(F.col("line")).startswith("test") & status.isin(*RUBY_WORDS))
    lines = lines.select("run_id", "part", "seq", "suite", rstrip(without_right(bare, F.length(status))).alias("name"), lookup(status, RUBY_WORDS).alias("status"))
    lines = lines.where((F.col("name") != "") & ~F.col("name").rlike("[A-Z]"))
    lines = inherit(lines, runs, "suite", rstrip(last_like(one_line_per_feed(F.col("log")), CAPITALISED)))
    key = F.concat(F.coalesce(F.concat("suite", F.lit("::")), F.lit("")), "name")
    return emit(lines, ranked(key, F.col("status"), {PASSED: 0, SKIPPED: 0, FAILED: 1, ERROR: 2}, sign=-1), certain=True)


# --- Maven, one test per build ----------------------------------------------

BUILD_WORDS = {"BUILD SUCCESS": PASSED, "BUILD FAILURE": FAILED}
NO_TEST_NAME = "---NO TEST NAME FOUND YET---"
TEST_OPTION = "-Dtest="
HAS_TEST = re.compile(rf"{TEST_OPTION}\S")

#: Events of a part in order, and what waits for a name from earlier parts.
FOUND = pa.list_(pa.struct([("seq", pa.int64()), ("sub", pa.int32()), ("test_id", pa.string()), ("status", pa.string()), ("prio", pa.int32()), ("sign", pa.int32())]))
WAITING = pa.list_(pa.struct([("seq", pa.int64()), ("status", pa.string())]))


def tested(line: str) -> str | None:
    """The test that a line with the option names: the word behind the last option."""
    return next(iter(line.rpartition(TEST_OPTION)[2].split(None, 1)), None)


class BuildReader:
    """`-Dtest=name` lines, and below each lines that end with BUILD SUCCESS or FAILURE.

    Of lines that wait for a name the first and the last are kept: they share the name, and the last one counts.
    """

    fields = (("builds", FOUND), ("nameless", WAITING), ("last_test", pa.string()))

    def __init__(self):
        self.rows = []

    def add(self, run_id: str | None, part: int | None, log: str) -> None:
        builds, nameless, name, last = [], [], None, None
        if TEST_OPTION in log or "BUILD " in log:
            section = row = 0
            for place, line in enumerate(log.split("\n")):
                if TEST_OPTION in line and HAS_TEST.search(line):
                    section, row = section + (place > 0), 0
                    name = last = tested(line)
                if "BUILD " in line and (status := BUILD_WORDS.get(line.rstrip()[-13:])):
                    seq = section * 2**31 + row
                    if name is not None:
                        builds.append((seq, 0, name, status, 1, 1))
                    else:
                        nameless = [*nameless[:1], (seq, status)]
                row += 1
        self.rows.append((builds, nameless, last))


def read_builds(runs: DataFrame) -> DataFrame:
    """`-Dtest=name` lines, and below each lines that end with BUILD SUCCESS or FAILURE."""
    return build_events(read_parts(runs, BuildReader))


def build_events(parts: DataFrame, prio: int = 1) -> DataFrame:
    """Rows of parts (`BuildReader`) -> events."""
    found = parts.select("run_id", "part", F.inline("builds"))
    waits = with_earlier(parts.select("run_id", "part", "nameless", "last_test"), "last_test")
    waits = waits.select("run_id", "part", "last_test", F.inline(F.when(F.col("part").isNotNull(), F.col("nameless"))))
    name = F.coalesce("last_test", F.lit(NO_TEST_NAME))
    waits = waits.select("run_id", "part", "seq", F.lit(0).alias("sub"), event(name, F.col("status")).alias("e")).select("run_id", "part", "seq", "sub", "e.*")
    return event_columns(found.unionByName(waits).withColumn("prio", F.lit(prio)))


# --- Surefire: `Running class`, then a line of counters ----------------------

COUNTERS = r",\s*".join(rf"{label}:\s*(\d+)" for label in ("Tests run", "Failures", "Errors", "Skipped"))


def counter_values(text: Column) -> list[Column]:
    """Tests, failures, errors, skipped; exact at any size."""
    return [F.regexp_extract(text, rx(COUNTERS), i).try_cast("decimal(38,0)") for i in (1, 2, 3, 4)]


def class_status(failures: Column, errors: Column, skipped: Column) -> Column:
    """Status of a class from its counters; errors count as failures."""
    return F.when((failures > 0) | (errors > 0), FAILED).when(skipped > 0, SKIPPED).otherwise(PASSED)


def suite_status(tests: Column, failures: Column, errors: Column, skipped: Column) -> Column:
    """Status of a whole suite from its counters; errors are kept apart."""
    return (
        F.when(failures > 0, FAILED).when(errors > 0, ERROR).when(skipped == tests, SKIPPED).otherwise(PASSED)
    )


def read_kotlin(runs: DataFrame) -> DataFrame:
    """Only the first counters below `Running class` belong to the class."""
    header, counted = r"\s*Running\s+\S.*", rf"\s*{COUNTERS}"

    def class_name(head: Column) -> Column:
        return F.when(matches(head, f"^{header}"), strip(after(head, "Running")))

    first = F.regexp_extract("body", rx(rf"^{counted}.*$", lines=True), 0)
    cut = sections(runs, header).withColumn("name", class_name(first_line(F.col("body")))).withColumn("first", first)
    rows = cut.where("first <> ''").select("run_id", "part", F.col("section").alias("seq"), "name", class_status(*counter_values(F.col("first"))[1:]).alias("status"))
    # Whoever counted last has used up the class announced before.
    latest = last_like(one_line_per_feed(F.col("log")), rf"(?:{header}|{counted}.*)")
    rows = inherit(rows, runs, "name", F.when(latest.isNotNull(), F.coalesce(class_name(latest), F.lit(""))))
    return emit(rows, strong(F.nullif("name", F.lit("")), F.col("status")))


CLASS = r"[\w.$]+"
ANNOUNCED = re.compile(rf"\s*(?:\[INFO\]\s+)?Running\s+({CLASS})\s*")
METHOD_FAILED = re.compile(rf"\[ERROR\]\s+({CLASS})\.({CLASS}?)(?::\d+)?\b")
COUNTED = re.compile(COUNTERS)


def is_positive(digits: str) -> bool:
    """Whether a count is over 0; one that no decimal of 38 digits holds is not known."""
    return digits != "0" and 0 < len("".join(str(int(d)) for d in digits).lstrip("0")) <= 38


class CounterReader:
    """Class counters, failure lines and announced classes.

    `[ERROR] class.method` overwrites and makes the class FAILED where nothing
    is known; counters count only where nothing is known. Counters without
    ` in class` belong to the class announced before, if they come first. Where a part
    counts anything, the announced classes of its run, if that has an id, are of no use.
    """

    #: unowned: the counters that wait for a class from an earlier part; last_class: who would own counters below, empty if the class is used up.
    fields = (("counted", FOUND), ("unowned", WAITING), ("last_class", pa.string()), ("announced", pa.list_(pa.string())))

    def __init__(self):
        self.rows = []

    def add(self, run_id: str | None, part: int | None, log: str) -> None:
        found, unowned, last, announced = [], [], None, []
        if "Running" in log or "Tests run:" in log or "[ERROR]" in log:
            section = row = 0
            running, first = None, True

            def add(sub: int, key: str, status: str, prio: int, sign: int) -> None:
                found.append((section * 2**31 + row, sub, key, status, prio, sign))

            for place, raw in enumerate(log.splitlines()):
                if "Running" in raw and (head := ANNOUNCED.fullmatch(raw)):
                    section, row, first = section + (place > 0), 0, True
                    running = last = head[1]
                    announced.append(running)
                    continue
                line = raw.strip()
                counts = COUNTED.search(line) if "Tests run:" in line else None
                if counts:
                    last = ""
                if line.startswith("[ERROR]") and (failed := METHOD_FAILED.match(line)):
                    add(0, f"{failed[1]}.{failed[2]}", ERROR if "Exception" in line and "AssertionError" not in line else FAILED, 3, 1)
                    add(1, failed[1], FAILED, 2, -1)
                elif counts:
                    _, failures, errors, skipped = counts.groups()
                    status = FAILED if is_positive(failures) or is_positive(errors) else SKIPPED if is_positive(skipped) else PASSED
                    if " in " in line:
                        owner = line.rpartition(" in ")[2].strip().rstrip(".:;")
                    else:
                        owner = running if first else ""
                    if owner:
                        add(0, owner, status, 2, -1)
                    elif owner is None:
                        unowned.append((section * 2**31 + row, status))
                    first = False
                else:
                    continue
                row += 1
        self.rows.append((found, unowned, last, [] if found and run_id is not None else announced))


def counter_events(parts: DataFrame) -> DataFrame:
    """Rows of parts (`CounterReader`) -> events of counters and failure lines."""
    found = parts.select("run_id", "part", F.inline("counted"))
    waits = with_earlier(parts.select("run_id", "part", "unowned", "last_class"), "last_class")
    waits = waits.where("last_class <> ''").select("run_id", "part", "last_class", F.inline("unowned"))
    waits = waits.select("run_id", "part", "seq", F.lit(0).alias("sub"), event(F.col("last_class"), F.col("status"), prio=2, sign=-1).alias("e"))
    return event_columns(found.unionByName(waits.select("run_id", "part", "seq", "sub", "e.*")))


def announced_classes(parts: DataFrame) -> DataFrame:
    """Rows of parts (`CounterReader`) -> announced classes as passed, of parts that count nothing."""
    return emit_log(parts.where("size(announced) > 0"), F.transform("announced", lambda name: strong(name, PASSED)))


MODULE_WORDS = {"SUCCESS": PASSED, "FAILURE": FAILED, "SKIPPED": SKIPPED}


def maven_module_line(line: Column) -> Column:
    """`[INFO] module ..... WORD` lines of a build, and one entry for the whole suite from the first counters."""
    # The name ends before the dots, the word stands behind them.
    dotted = rx(r"\s\.+\s+(" + "|".join(MODULE_WORDS) + r")\b.*$")
    told = strip(after(line, "[INFO]"))
    is_module = line.startswith("[INFO]") & matches(line, r"^\[INFO\]\s") & told.rlike(dotted)
    name = rstrip(F.regexp_replace(told, dotted, ""))
    module = strong(F.nullif(name, F.lit("")), lookup(F.regexp_extract(told, dotted, 1), MODULE_WORDS))
    return F.when(is_module, module).when(matches(line, COUNTERS), weak(F.lit("__suite__"), suite_status(*counter_values(line))))


# --- Scala: a suite line above test lines ------------------------------------

# Build messages that look like suite lines but are none.
NOT_A_SUITE = (
    "Run completed", "Total number", "Suites:", "Tests:", "All tests",
    "compiling", "done compiling", "loading", "welcome to", "set current",
)
SCALA_MARKS = {
    "PASSED": PASSED, "FAILED": FAILED, "ERROR": ERROR, "ABORTED": ERROR, "SKIPPED": SKIPPED,
    "IGNORED": SKIPPED, "CANCELED": SKIPPED, "CANCELLED": SKIPPED, "PENDING": SKIPPED,
}
#: An [info] line that is no test (a dash after one blank) and no build message.
SCALA_SUITE = rf"\s*(?!\[info\] -)\[info\]\s(?!-)(?!.*(?:{'|'.join(NOT_A_SUITE)})).*\S.*$"


def read_scala_suites(runs: DataFrame) -> DataFrame:
    def suite(head: Column) -> Column:
        return F.when(matches(head, f"^{SCALA_SUITE}"), F.nullif(strip(after(head, "[info]")), F.lit("")))

    cut = sections(runs, SCALA_SUITE).withColumn("suite", suite(first_line(F.col("body"))))
    line = strip(F.col("line"))
    lines = section_lines(cut, "suite").where(line.startswith("[info] -") & matches(line, r"^\[info\] -\s+\S"))
    told = strip(after(line, "-"))
    # ` *** MARK ***` at the end, or else a time in parentheses.
    mark = F.regexp_extract(told, r"\*\*\* ([A-Z]+) \*\*\*$", 1)
    bare = F.when(mark != "", rstrip(without_right(told, F.length(mark) + 8))).otherwise(told)
    name = strip(F.regexp_replace(bare, r"\(\d+ \S+\)$", ""))
    lines = lines.select("run_id", "part", "seq", "suite", name.alias("name"), mark.alias("mark"))
    lines = inherit(lines, runs, "suite", suite(last_like(one_line_per_feed(F.col("log")), SCALA_SUITE)))
    key = F.concat(F.coalesce(F.concat("suite", F.lit(": ")), F.lit("")), "name")
    mark = F.col("mark")
    return emit(lines, F.when(mark == "", weak(key, PASSED)).otherwise(strong(key, F.coalesce(lookup(mark, SCALA_MARKS), mark))), certain=True)


# --- Clojure: `lein test namespace` above failure lines -----------------------

LEIN = r"\s*lein test .*\S.*"


def read_lein(runs: DataFrame) -> DataFrame:
    """`lein test a b` announces namespaces, `lein test :only a/t` one; a failure belongs to the latest."""

    def spaces(head: Column) -> Column:
        words = F.split(strip(after(head, "lein test ")), rx(r"\s+"))
        only = F.filter(F.array(before(F.array_join(F.slice(words, 2, F.size(words)), " "), "/")), lambda s: s != "")
        return F.when(matches(head, f"^{LEIN}"), F.when(words[0] == ":only", only).otherwise(words))

    cut = sections(runs, LEIN).withColumn("spaces", spaces(first_line(F.col("body"))))
    line = strip(F.col("line"))
    failed = F.when(line.startswith("FAIL in"), FAILED).when(line.startswith("ERROR in"), ERROR)
    is_head = F.col("spaces").isNotNull() & (F.col("row") == 0)
    lines = section_lines(cut, "spaces").where(is_head | failed.isNotNull())
    lines = lines.select("run_id", "part", "seq", "spaces", F.when(~is_head, failed).alias("failed"))
    lines = inherit(lines, runs, "spaces", spaces(last_like(one_line_per_feed(F.col("log")), LEIN)))
    current = F.try_element_at("spaces", F.lit(-1))
    events = F.when(F.col("failed").isNull(), F.transform("spaces", lambda s: weak(s, PASSED))).otherwise(F.array(strong(current, F.col("failed"))))
    return emit_each(lines, events)


# --- R CMD check: the outcome may come lines below the check -------------------

CHECK_WORDS = {
    "OK": PASSED, "NOTE": PASSED, "NOTES": PASSED, "WARNING": FAILED, "WARNINGS": FAILED,
    "ERROR": ERROR, "ERRORS": ERROR, "FAIL": FAILED, "FAILED": FAILED, "SKIPPED": SKIPPED,
}
#: What every word begins with.
CHECK_STEMS = ("OK", "NOTE", "WARNING", "ERROR", "FAIL", "SKIPPED")


def read_package_checks(runs: DataFrame) -> DataFrame:
    """`* checking x ... WORD`, or the word at the head of a later line.

    A check without its word waits for the next line that starts with one and
    swallows all lines before it. So lines that start with a word part a run
    into stretches: in each the first waiting check, if any, ends the reading,
    and the word that opens the next stretch is its outcome.
    """
    line = F.col("line")
    lines = bind(log_lines(runs, LINE_END), "run_id", "part", "seq", line=strip(line))
    # Words and checks are looked for in steps, each computed once, and only in lines that can hold one.
    is_check = line.startswith("* checking ")
    starts = F.ltrim(line, F.lit(".:!" + BLANKS))
    may_lead = reduce(Column.__or__, [F.upper(F.left(starts, F.lit(len(w)))) == w for w in CHECK_STEMS])
    may_noise = F.left(line, F.lit(1)).isin(".", ":", "!")
    lines = lines.where(is_check | may_lead | may_noise)
    bare = strip(F.ltrim(line, F.lit(".:!")))
    lines = bind(
        lines, "run_id", "part", "seq",
        bare=bare, lead=F.when(may_lead, F.upper(word(bare, 0))), told=F.when(is_check, strip(after(line, "* checking "))),
        noise=F.when(may_noise, matches(line, r"^[.:!]+\s*[.:!]*$")).otherwise(False),
    )
    lead, told = F.col("lead"), F.col("told")
    bare_lead = F.rtrim(lead, F.lit(".:!"))
    lead_word = F.when(bare_lead.isin(*CHECK_WORDS), F.when((lead == bare_lead) | word(F.col("bare"), 1).isNull(), bare_lead))
    is_check = told.contains(" ...")
    outcome = F.substring_index(told, " ... ", -1)
    stated = F.when(is_check & ~told.endswith("..."), F.when(outcome.rlike("^[A-Z]+$"), F.struct(before_last(told, " ... ").alias("name"), outcome.alias("word"))))
    waiting = F.when(is_check & told.endswith(" ..."), before_last(told, " ..."))
    lines = bind(lines, "run_id", "part", "seq", "noise", word=lead_word, stated=stated, waiting=waiting)
    lines = share(lines.where("word is not null or stated is not null or waiting is not null or noise"))

    # The stretch of a line: the place of the latest word at or above it.
    within = Window.partitionBy("run_id", "part").orderBy("seq")
    lines = lines.withColumn("stretch", F.last(F.when(F.col("word").isNotNull(), F.struct("part", "seq")), ignorenulls=True).over(within))
    opened = F.when(F.col("word").isNotNull(), F.struct("part", "seq"))
    latest = lines.groupBy("run_id", "part").agg(F.max(opened).alias("stretch"))
    every_part = runs.select("run_id", "part").join(latest, ["run_id", "part"], "left")
    lines = inherit(lines, every_part, "stretch", F.col("stretch"))
    stretches = lines.groupBy("run_id", "stretch").agg(F.min(F.when(F.col("waiting").isNotNull(), F.struct("part", "seq", "waiting"))).alias("first"), F.max("word").alias("word"))
    follow = Window.partitionBy("run_id").orderBy(F.col("stretch").asc_nulls_first())  # one small row for each word
    stretches = stretches.withColumn("next", F.lead("word").over(follow)).where("first is not null")
    outcome = F.when(F.col("next").isNull(), weak(F.col("first.waiting"), PASSED)).otherwise(strong(F.col("first.waiting"), lookup(F.col("next"), CHECK_WORDS)))
    ended = emit(stretches.select("run_id", F.col("first.part").alias("part"), F.col("first.seq").alias("seq"), "next", "first"), outcome, certain=True)

    of_run = stretches.select(F.col("run_id").alias("of_run"), F.col("stretch").alias("of"), "first")
    placed = lines.where("stated is not null or noise").join(of_run, F.col("of").eqNullSafe(F.col("stretch")) & (F.col("run_id") == F.col("of_run")), "left")
    swallowed = F.col("first").isNotNull() & (F.struct("part", "seq") > F.struct("first.part", "first.seq"))
    found = F.when(F.col("noise") & swallowed, unreadable()).when(F.col("stated").isNotNull() & ~swallowed, strong(F.col("stated.name"), lookup(F.col("stated.word"), CHECK_WORDS, PASSED)))
    return ended.unionByName(emit(placed, found))


# --- OCaml builds: announced runs and their numbered outputs -------------------

ANNOUNCED_RUN, OUTPUT_OF_RUN = r"\s*Running\[\d+\]:\s+\(.+\)\s*$", r"\s*Output\[\d+\]:"


def read_dune(runs: DataFrame) -> DataFrame:
    """`Running[3]: (command)` names run 3, `Output[3]:` opens its output.

    A piece of an output is reduced to what it says inside its log row; pieces of
    one output in several parts are put together, and announcements and outputs
    meet by number, one small row each.
    """
    header = f"(?:{ANNOUNCED_RUN}|{OUTPUT_OF_RUN})"
    cut = bind(sections(runs, header), head=strip(first_line(F.col("body"))))
    head = F.col("head")
    may_run, may_output = head.startswith("Running["), head.startswith("Output[")
    cut = bind(cut, is_run=F.when(may_run, matches(head, f"^{ANNOUNCED_RUN}")).otherwise(False), is_output=F.when(may_output, matches(head, f"^{OUTPUT_OF_RUN}")).otherwise(False))
    is_run, is_output = F.col("is_run"), F.col("is_output")
    number = F.ltrim(F.regexp_extract(head, r"\[(\d+)\]", 1), F.lit("0"))
    command = strip(F.substring_index(F.regexp_extract(head, r"\((.*)\)$", 1), "&&", -1))
    command = strip(F.when(command.startswith("exec "), F.substr(command, F.lit(6))).otherwise(command))
    command = F.when(command.startswith("./"), F.substr(command, F.lit(3))).otherwise(command)
    cut = bind(cut, number=F.when(is_run | is_output, number), command=F.when(is_run, command))
    number, command = F.col("number"), F.col("command")
    name = F.coalesce(F.nullif(F.substring_index(word(command, 0), "/", -1), F.lit("")), F.concat(F.lit("run_"), number))
    said = F.filter(F.transform(F.split("body", LINE_FEED), lambda x: F.upper(strip(x))), lambda x: x != "")
    cut = bind(cut, "run_id", "part", "section", "is_run", "is_output", "number", "command", said=said)
    said = F.col("said")
    said = F.when(is_run | is_output, F.slice(said, 2, F.size(said))).otherwise(said)
    pieces = cut.select(
        "run_id", "part",
        F.when(is_run | is_output, F.struct("part", "section")).alias("at"),
        F.when(is_run | is_output, F.struct(is_run.alias("is_run"), number.alias("number"), F.when(is_run, name).alias("name"))).alias("opens"),
        (F.size(said) > 0).alias("said"),
        F.exists(said, lambda x: x.rlike("FAIL|ERROR|EXCEPTION|CRASH|FATAL")).alias("failed"),
        F.exists(said, lambda x: x.contains("SKIP")).alias("skipped"),
    )
    heads = F.size(F.split(one_line_per_feed(F.col("log")), rx(rf"(?=^{header})", lines=True))) - 1
    pieces = inherit(pieces, runs, "at", F.when(last_like(one_line_per_feed(F.col("log")), header).isNotNull(), F.struct(F.col("part"), heads.alias("section"))))
    steps = pieces.where("at is not null").groupBy("run_id", "at").agg(F.max("opens").alias("opens"), F.max("said").alias("said"), F.max("failed").alias("failed"), F.max("skipped").alias("skipped"))
    verdict = F.when(F.col("opens.is_run") | ~F.col("said"), None).when(F.col("failed"), FAILED).when(F.col("skipped"), SKIPPED).otherwise(PASSED)
    steps = steps.select("run_id", F.col("at.part").alias("part"), F.col("at.section").alias("seq"), F.col("opens.number").alias("id"), F.col("opens.is_run").alias("is_run"), F.col("opens.name").alias("announced"), verdict.alias("verdict"))
    steps = latest_start(share(steps), F.col("is_run"), F.col("announced"), "name")
    return emit(steps.where("verdict is not null and name is not null"), ranked(F.col("name"), F.col("verdict"), WORST, sign=1), certain=True)


DIALECTS = (
    Dialect("phpunit", read_phpunit),
    Dialect("ruby_v1", read_ruby_tests),
    Dialect("maven", read_builds),
    Dialect("kotlin_junit", read_kotlin),
    LineReader(maven_module_line).dialect("java_mvn_v2"),
    Dialect("scala_v3", read_scala_suites),
    Dialect("lein", read_lein),
    Dialect("r_v2", read_package_checks),
    Dialect("ocaml_v2", read_dune),
)
