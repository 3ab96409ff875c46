"""Dialects whose lines stand for themselves, as a table of facts about the lines.

A `Form` says what a runner prints: the words or marks and what they stand for, whether
they stand ahead of the test's name or behind it, what comes before them, and which
tails (times, brackets) are no part of the name. One reader takes all forms apart with
text functions: words are parted by any blanks, the mark is taken, tails are cut, and
the rest is the name.

Words and marks are fixed values: they are what the test frameworks print.
"""

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, functions as F

from runsift.functions.text import ANSI, BLANKS, LINE_END, before_last, rstrip, rx, strip, without_right, word
from runsift.operators.dialects.base import LINE_FEED, Dialect, LineReader, as_is, lookup, ranked, strong, weak
from runsift.schema import ERROR, FAILED, PASSED, SKIPPED

# Kinds of tails. A number may have decimals.
NUMBER = r"\d+(?:\.\d+)?"
#: `(3 ms)` and `[2 s]` and bare `3 ms`, as JavaScript runners write them.
JS_TIMING = rf"(?i)\s*\(?\s*{NUMBER}\s*m?s\s*\)?\s*$"
MILLIS = r"\s\(\d+\s*m?s\)$"
DECIMAL_MILLIS = rf"\s\({NUMBER}\s*m?s\)$"
SECONDS = rf"\s+\({NUMBER}s\)$"
ELIXIR_TIME = rf"\s+\({NUMBER}ms\)$"
LINE_REFERENCE = r"\s+\[L#\d+\]$"
PARENTHESES = r"\s+\([^)]+\)$"
LAST_PARENTHESES = r"\s\([^(]*\)$"
BRACKETS = r"\s+\[.*\]$"
BARE_MILLIS = r"\s(?:\d+\s*m?s?|\[skipped\])$"
IN_FILE = r"\s+in\s+\S+$"
COLUMN = r"\s{2,}.*$"
#: The PHP runner's times, once parted by a column and once by a blank.
PHP_TIME = rf"\s+{NUMBER}s\b.*$"

# Order of severity for runners that keep the worst sighting.
WORST = {PASSED: 0, SKIPPED: 1, FAILED: 2, ERROR: 3}

PASS_FAIL = {"PASS": PASSED, "FAIL": FAILED}
PASS_FAIL_SKIP = PASS_FAIL | {"SKIP": SKIPPED}
OK_NOT = {"ok": PASSED, "not ok": FAILED}
DOT_MARKS = {".": PASSED, "F": FAILED, "E": FAILED}


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(BLANKS))


def behind(text: Column, n: int | Column) -> Column:
    return F.substr(text, F.lit(n) + 1 if isinstance(n, int) else n + 1)


@dataclass(frozen=True)
class Number:
    """Digits, and what closes them: `1)`."""

    close: str = ""


@dataclass(frozen=True)
class Form:
    """One kind of line."""

    #: What the mark says; a form without a mark has one entry, for the empty text.
    marks: Mapping[str, str]
    #: Words and numbers ahead of the mark, parted by blanks.
    lead: tuple["str | Number", ...] = ()
    #: What parts mark and name; a blank stands for one or more, an empty text for any number.
    gap: str = " "
    #: The mark stands behind the name.
    last: bool = False
    #: Tails that must be there, and tails that may be; cut in this order.
    needs: tuple[str, ...] = ()
    tails: tuple[str, ...] = ()
    #: Only where nothing else is known of the test.
    weak: bool = False
    nocase: bool = False

    def head(self, line: Column) -> tuple[list[Column], Column]:
        """Conditions, and what is left behind the lead."""
        conditions, rest = [], line
        for text in self.lead:
            if isinstance(text, Number):
                digits = F.regexp_extract(rest, r"^\d+", 0)
                conditions += [digits != "", behind(rest, F.length(digits)).startswith(text.close)]
                rest = behind(rest, F.length(digits) + len(text.close))
            else:
                conditions.append(self.same(rest).startswith(text))
                rest = behind(rest, len(text))
            conditions.append(lstrip(rest) != rest)
            rest = lstrip(rest)
        return conditions, rest

    def same(self, text: Column) -> Column:
        return F.lower(text) if self.nocase else text

    def without_tails(self, text: Column) -> tuple[list[Column], Column]:
        conditions = []
        for tail in self.needs:
            conditions.append(text.rlike(rx(tail)))
            text = F.regexp_replace(text, rx(tail), "")
        for tail in self.tails:
            text = F.regexp_replace(text, rx(tail), "")
        return conditions, text

    def found(self, line: Column) -> tuple[Column, Column, Column]:
        """Whether the line has this form, the name and the status."""
        marks = {self.folded(m): s for m, s in self.marks.items()}
        longest = sorted(marks, key=len, reverse=True)
        conditions, rest = self.head(line)
        if self.last:
            more, rest = self.without_tails(rest)
            conditions += more
            hits = [(m, self.same(rest).endswith(m)) for m in longest]
        else:
            hits = [(m, self.same(rest).startswith(m)) for m in longest]
        size = status = None
        for mark, hit in hits:
            size = (F if size is None else size).when(hit, len(mark))
            status = (F if status is None else status).when(hit, marks[mark])
        conditions.append(status.isNotNull())
        if self.last:
            name = without_right(rest, size)
            if self.gap:
                conditions.append(rstrip(name) != name)
            name = rstrip(name)
        else:
            name = behind(rest, size)
            if self.gap == " ":
                conditions.append(lstrip(name) != name)
            elif self.gap:
                conditions.append(name.startswith(self.gap))
                name = behind(name, len(self.gap))
            more, name = self.without_tails(strip(name))
            conditions += more
        name = strip(name)
        return reduce(Column.__and__, conditions) & (name != ""), name, status

    def folded(self, mark: str) -> str:
        return mark.lower() if self.nocase else mark


def one_of(status: str, *marks: str) -> dict[str, str]:
    return dict.fromkeys(marks, status)


def always(status: str) -> dict[str, str]:
    return {"": status}


def reader(name: str, *forms: Form, line_end: str = LINE_FEED, prepare: Callable[[Column], Column] = strip, skip: Callable[[Column], Column] | None = None, rename=None, by_rank: bool = False) -> Dialect:
    """A dialect of forms; the first one that a line has counts."""

    def event(line: Column) -> Column:
        cases = []
        for form in forms:
            hit, key, status = form.found(line)
            key = rename(key) if rename else key
            one = ranked(key, status, WORST, sign=1) if by_rank else weak(key, status) if form.weak else strong(key, status)
            cases.append(F.when(hit if skip is None else hit & ~skip(line), one))
        return F.coalesce(*cases)

    return LineReader(event, line_end, prepare).dialect(name)


def special(name: str, event: Callable[[Column], Column], line_end: str = LINE_FEED, prepare: Callable[[Column], Column] = strip) -> Dialect:
    return LineReader(event, line_end, prepare).dialect(name)


def any_end(*args, **more) -> Dialect:
    """Lines may end in any way."""
    return reader(*args, line_end=LINE_END, **more)


def colours_off(text: Column) -> Column:
    return F.regexp_replace(text, "\x1b\\[[0-9;]*m", "")


def colours_to_blanks(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(text, "\x1b\\[[0-9;]*m", " "), ANSI, ""))


# --- forms that need more than a mark, a name and tails ------------------------------


def bracketed_result(line: Column) -> Column:
    """`[  OK ] name (3 ms)`: the word in the first brackets, a tail in parentheses."""
    inside = strip(F.substring_index(F.substring_index(line, "]", 1), "[", -1))
    status = lookup(inside, {"OK": PASSED, "FAILED": FAILED})
    told = behind(line, F.instr(line, "]"))
    hit = line.contains("[") & line.contains("]") & status.isNotNull() & told.rlike(r"^\s.*\s\([^(]*\)$")
    return F.when(hit, strong(F.regexp_replace(F.substr(told, F.lit(2)), r"\s\([^(]*\)$", ""), status))


def mark_behind_equals(line: Column) -> Column:
    """`name. x = 1 s = .`: the last mark behind an equals sign."""
    left = before_last(line, "=")
    name = before_last(left, ". ")
    told = behind(line, F.length(name) + 2)
    mark = F.right(F.regexp_replace(behind(told, F.instr(told, "=")), "[^.FE]", ""), F.lit(1))
    return F.when(line.contains("=") & left.contains(". ") & (name != "") & (mark != ""), strong(name, lookup(mark, DOT_MARKS)))


def dots_behind(line: Column) -> Column:
    """`name ....` or `name ..F`."""
    dots = F.concat(F.lit("."), F.substring_index(line, " .", -1))
    after = F.ltrim(dots, F.lit("."))
    status = F.when(after.startswith("F"), FAILED).when(F.length(dots) - F.length(after) >= 2, PASSED)
    return F.when(line.contains(" .") & status.isNotNull(), strong(before_last(line, " ."), status))


def mark_behind_colon(line: Column) -> Column:
    """`test: name: F`, the first word may lack."""
    told = F.substring_index(line, ":", -1)
    mark = F.left(strip(told), F.lit(1))
    ends = ~strip(told).rlike(r"(?U)^[A-Z]\w")
    name = before_last(line, ":")
    name = F.when(name.startswith("test: "), behind(name, 6)).otherwise(name)
    hit = line.contains(":") & told.rlike(r"^\s+\S") & ends & (name != "")
    return F.when(hit & mark.isin(".", "E", "F", "O"), strong(name, lookup(mark, DOT_MARKS | {"O": SKIPPED})))


def word_behind_dash(line: Column) -> Column:
    """`name - passed`; the last dash with one of the words behind it parts them."""
    told = F.substring_index(line, " - ", -1)
    status = F.when(told.startswith("passed"), PASSED).when(told.startswith("failed"), FAILED)
    name = before_last(line, " - ")
    return F.when(line.contains(" - ") & status.isNotNull() & (name != ""), strong(name, status))


def four_words(line: Column) -> Column:
    """`test name ... ok`."""
    words = F.split(line, rx(r"\s+"))
    status = lookup(F.try_element_at(words, F.lit(4)), {"ok": PASSED, "FAILED": FAILED})
    hit = line.startswith("test") & (F.size(words) == 4) & (words[0] == "test") & (F.try_element_at(words, F.lit(3)) == "...")
    return F.when(hit & status.isNotNull(), strong(F.try_element_at(words, F.lit(2)), status))


def numbered_of_all(line: Column) -> Column:
    """`3/9 Test #3: name ....   Passed  0.1 sec`: dots part name and word."""
    told = strip(behind(line, F.instr(line, ":")))
    outcome = F.lower(F.regexp_extract(told, rx(r"\s\.+\s+(\w+)"), 1))
    status = lookup(outcome, {"passed": PASSED, "failed": FAILED, "skipped": SKIPPED, "timeout": FAILED})
    name = strip(F.regexp_replace(told, rx(r"\s\.+\s+\w+.*$"), ""))
    return F.when(line.rlike(rx(r"^\s*\d+/\d+\s+Test\s+#\d+:\s+\S", nocase=True)) & status.isNotNull(), strong(name, status))


def piped(line: Column) -> Column:
    """`Success || name`, `Fail || name`, `Skip || name`; a failure stays."""
    head, name = rstrip(F.substring_index(line, "||", 1)), strip(behind(line, F.instr(line, "||") + 1))
    found = F.when(head.isin("Fail", "Failed"), strong(name, FAILED)).when(F.lower(head).isin("skip", "skipped"), weak(name, SKIPPED)).when(head == "Success", weak(name, PASSED))
    return F.when(line.contains("||") & (name != ""), found)


PHP_MARKS = {"✓": PASSED, "✔": PASSED, "⨯": FAILED, "x": FAILED, "X": FAILED, "-": SKIPPED}
PHP_NOISE = ("___", "---", "Tests:", "Duration:")


def php_line(line: Column) -> Column:
    """`✓ name  0.03s`, `⨯ name`, `- name`, `FAIL  suite`, or a line that says it was skipped."""
    bare = strip(line)
    noise = reduce(Column.__or__, [bare.startswith(text) for text in PHP_NOISE])
    timeless = strip(F.regexp_replace(bare, PHP_TIME, ""))
    first = word(bare, 0)
    told = strip(behind(timeless, F.length(first)))
    status = lookup(first, PHP_MARKS)
    suite = F.upper(first).isin("FAIL", "FAILED") & (told != "")
    skipped = F.lower(bare).contains("(skipped)") | F.lower(bare).rlike(r"\bskipped\b")
    name = F.when(status.isNotNull(), told).otherwise(timeless)
    found = (
        F.when(suite, strong(told, FAILED))
        .when((told != "") & (status == PASSED), weak(told, PASSED))
        .when((told != "") & status.isNotNull(), strong(told, status))
        .when(skipped & (name != ""), weak(name, SKIPPED))
    )
    return F.when(~noise, found)


def timed_method(line: Column) -> Column:
    """`Class#test = 5.30 s = .`"""
    parts = F.split(line, rx(r"\s+=\s+"))
    status = lookup(F.left(F.try_element_at(parts, F.lit(3)), F.lit(1)), DOT_MARKS | {"S": SKIPPED})
    took = F.split(F.try_element_at(parts, F.lit(2)), rx(r"\s+"))
    timed = (F.size(took) == 2) & F.try_element_at(took, F.lit(1)).rlike(f"^{NUMBER}$") & (F.try_element_at(took, F.lit(2)) == "s")
    hit = line.contains("#") & (F.size(parts) == 3) & (F.length(F.try_element_at(parts, F.lit(3))) == 1) & timed & parts[0].rlike("^[^#]+#[^=]+$")
    return F.when(hit & status.isNotNull(), strong(parts[0], status))


HASKELL_WORDS = {"OK": PASSED, "PASS": PASSED, "FAIL": FAILED, "ERROR": ERROR, "SKIP": SKIPPED, "PENDING": SKIPPED}
HASKELL_NOISE = ("Test suite ", "Linking ", "Building ", "Running  ")
CHECKED = {"✓": PASSED, "✔": PASSED, "✗": FAILED, "✘": FAILED}
REPORTED = {"### Failure in:": FAILED, "### Error in:": ERROR}


def haskell_line(line: Column) -> Column:
    """`name: OK (0.1s)`, `name [✔]`, `✓ name (0.1s)`, `1) name`, `### Error in: name`."""
    bare = strip(line)
    noise = reduce(Column.__or__, [line.contains(text) for text in HASKELL_NOISE])
    # The first colon with one of the words behind it.
    colon = rx(r"\s*:\s*(" + "|".join(HASKELL_WORDS) + r")\b.*$")
    said, before_colon = F.regexp_extract(bare, colon, 1), strip(F.regexp_replace(bare, colon, ""))
    indented = lstrip(line) != line
    in_brackets = F.when(bare.endswith("]"), F.substring(F.right(bare, F.lit(2)), 1, 1))
    marked, first = lookup(in_brackets, CHECKED), lookup(F.left(bare, F.lit(1)), CHECKED)
    told = strip(behind(bare, 1))
    report = None
    for text, status in REPORTED.items():
        report = (F if report is None else report).when(bare.startswith(text) & (strip(behind(bare, len(text))) != ""), strong(strip(behind(bare, len(text))), status))
    name = rstrip(without_right(bare, F.lit(3)))

    def seen(key: Column, status: Column) -> Column:
        return F.when(status == PASSED, weak(key, PASSED)).otherwise(strong(key, status))

    return F.when(
        ~noise,
        F.coalesce(
            F.when((said != "") & (before_colon != ""), strong(before_colon, lookup(said, HASKELL_WORDS))),
            F.when(marked.isNotNull() & indented & without_right(bare, F.lit(2)).endswith(" ["), seen(name, marked)),
            F.when(first.isNotNull() & behind(bare, 1).rlike(r"^\s+\S"), seen(F.when(first == PASSED, strip(F.regexp_replace(told, r"\s+\([^)]+\)$", ""))).otherwise(told), first)),
            F.when(bare.rlike(r"^\d+\)\s+\S"), strong(strip(behind(bare, F.instr(bare, ")"))), FAILED)),
            report,
        ),
    )


FILE_AND_NAME = r"^\d+:\d+\s+\+\d+(?:\s+-\d+)?:\s+/"


def dart_line(line: Column) -> Column:
    """`00:01 +64 -1: /p/t.dart: name [E]`; without [E] it passed; `loading /p/t.dart [E]` is an error."""
    path = F.regexp_extract(line, r"(/[^:]+\.dart)", 1)
    name = strip(F.regexp_replace(behind(line, F.instr(line, ".dart: ") + 6), rx(r"\s+\[E\]$"), ""))
    key = F.concat(path, F.lit(": "), name)
    loading = line.rlike(rx(r"^\d+:\d+\s+\+\d+\s+-\d+:\s+loading\s+/[^:]+\.dart\s+\[E\]$"))
    tested = line.rlike(rx(FILE_AND_NAME)) & line.contains(".dart: ") & (name != "")
    return F.when(loading, strong(path, ERROR)).when(tested & line.endswith(" [E]"), strong(key, FAILED)).when(tested, weak(key, PASSED))


SCALA_OUTCOMES = {"*** FAILED ***": FAILED, "!!! CANCELED !!!": SKIPPED, "!!! IGNORED !!!": SKIPPED}


def scala_line(line: Column) -> Column:
    """`[info] - name (3 ms)`, with an outcome between stars or exclamation marks ahead of the parentheses."""
    told = F.regexp_replace(line, rx(r"^\[info\]\s+-\s+"), "")
    found = []
    for text, status in SCALA_OUTCOMES.items():
        needs = F.lit(True) if "IGNORED" in text else told.rlike(rx(r"\s\([^)]+\)$"))
        found.append(F.when(told.contains(f" {text}") & needs, strong(rstrip(F.substring_index(told, f" {text}", 1)), status)))
    passed = F.when(told.rlike(rx(r"\S\s+\([^)]+\)$")), weak(rstrip(F.regexp_replace(told, rx(r"\s+\([^)]+\)$"), "")), PASSED))
    return F.when(line.startswith("[info]") & (told != line), F.coalesce(*found, passed))


OCAML_WORDS = {
    **one_of(FAILED, "FAIL", "FAILED", "ERROR", "EXCEPTION", "CRASH", "FATAL", "KO", "PANIC"),
    **one_of(SKIPPED, "SKIP", "SKIPPED", "TODO", "PENDING", "DISABLED"),
    **one_of(PASSED, "OK", "PASS", "PASSED", "SUCCESS"),
}


def ocaml_line(line: Column) -> Column:
    """`[OK] name`: the worst sighting counts; blanks in names are single."""
    status = lookup(F.upper(F.substring_index(F.substr(line, F.lit(2)), "]", 1)), OCAML_WORDS)
    told = behind(line, F.instr(line, "]"))
    name = F.regexp_replace(strip(told), rx(r"\s+"), " ")
    return F.when(line.startswith("[") & line.contains("]") & status.isNotNull() & (lstrip(told) != told) & (name != ""), ranked(name, status, WORST, sign=1))


def swift_line(line: Column) -> Column:
    """`Test Case 'name' passed (0.1 seconds)`."""
    name, told = F.substring_index(behind(line, len("Test Case '")), "'", 1), F.split(F.substring_index(line, "'", -1), rx(r"\s+"))
    status = lookup(F.try_element_at(told, F.lit(2)), {"passed": PASSED, "failed": FAILED})
    timed = F.try_element_at(told, F.lit(3)).startswith("(") & (F.try_element_at(told, F.lit(4)) == "seconds)") & (F.size(told) == 4)
    return F.when(line.startswith("Test Case '") & (name != "") & timed & status.isNotNull(), strong(name, status))


def csharp_line(line: Column) -> Column:
    """Indented `Passed name [3 ms]`, `Failed name [3 ms]`, `Skipped name`, and `[xUnit.net 00:00:01.2]  name [FAIL]`."""
    bare = strip(line)
    first, told = word(bare, 0), strip(behind(bare, F.length(word(bare, 0))))
    timed = told.rlike(r"\s\[[^\[]+\]$")
    name = rstrip(F.regexp_replace(told, r"\s+\[[^\[]+\]$", ""))
    clocked = behind(bare, F.instr(bare, "]"))
    failed = strip(without_right(clocked, F.lit(len("[FAIL]"))))
    of_word = (
        F.when((first == "Failed") & timed, strong(name, FAILED)).when(first == "Skipped", strong(name, SKIPPED)).when((first == "Passed") & timed, weak(name, PASSED))
    )
    hit = line.startswith("[xUnit.net ") & bare.endswith(" [FAIL]") & (failed != "")
    return F.when(hit, strong(failed, FAILED)).when((lstrip(line) != line) & (name != ""), of_word)


JS = (JS_TIMING,)

DIALECTS = (
    reader("gotest", Form(PASS_FAIL_SKIP, lead=("---",), gap=":", needs=(LAST_PARENTHESES,))),
    any_end(
        "elixir",
        Form(always(SKIPPED), lead=("*", "test"), gap="", needs=(r"\s+\(skipped\)\s+\[L#\d+\]$",)),
        Form(always(FAILED), lead=(Number(")"), "test"), gap="", needs=(PARENTHESES,)),
        Form(always(PASSED), lead=("*", "test"), gap="", needs=(LINE_REFERENCE,), tails=(ELIXIR_TIME,), weak=True),
    ),
    reader(
        "redis",
        Form({"[ok]": PASSED}, gap=": ", tails=(MILLIS,)),
        Form({"[err]": FAILED}, gap=": ", tails=(MILLIS, IN_FILE)),
        Form(one_of(SKIPPED, "[skip]", "[ignore]"), gap=": ", tails=(MILLIS,)),
    ),
    reader("jq", Form(PASS_FAIL, gap=": ")),
    reader("micropython_test", Form({"pass": PASSED, "FAIL": FAILED, "skip": SKIPPED})),
    special("googletest", bracketed_result),
    special("minitest", mark_behind_equals),
    special("cucumber", dots_behind),
    special("ruby_unit", mark_behind_colon),
    special("rspec_transformed_json", word_behind_dash),
    special("cargo", four_words),
    reader("ant", Form({"[PASS]": PASSED, "[FAIL]": FAILED, "[ERR]": FAILED}, lead=("[junit]",))),
    reader("gradle_custom", Form({"PASSED": PASSED, "FAILED": FAILED}, last=True, tails=(SECONDS,)), skip=lambda line: line.startswith(">")),
    reader("marked", Form(always(FAILED), lead=(Number(")"),), gap=""), prepare=as_is),
    reader("react_pdf", Form(PASS_FAIL, tails=(DECIMAL_MILLIS,)), prepare=as_is),
    reader("jest", Form({"✓": PASSED, "✕": FAILED, "○": SKIPPED}, tails=(MILLIS,))),
    reader("jest_json", Form({"[PASSED]": PASSED, "[FAILED]": FAILED})),
    reader("vitest", Form({"✓": PASSED, "×": FAILED, "↓": SKIPPED}, tails=(BARE_MILLIS,))),
    reader("tap", *[Form(always(status), lead=(words, Number()), gap="") for words, status in OK_NOT.items()]),
    any_end("cpp_v2", Form({"passed": PASSED}, lead=("Test",), last=True, weak=True), Form({"failed": FAILED, "skipped": SKIPPED}, lead=("Test",), last=True)),
    special("cpp_v4", numbered_of_all, LINE_END, as_is),
    special("lua_nvim", piped, LINE_END, lambda text: rstrip(colours_off(text))),
    special("php_v1", php_line, LINE_END, rstrip),
    special("ruby_v2", timed_method, LINE_END),
    special("haskell", haskell_line, LINE_END, lambda text: rstrip(colours_off(text))),
    any_end(
        "js",
        Form({"-": SKIPPED}, tails=JS),
        Form(always(FAILED), lead=(Number(")"),), gap="", needs=(":$",), tails=JS),
        Form(always(FAILED), lead=("[W]", Number(")")), gap="", tails=JS),
        Form({"✔": PASSED}, tails=JS, weak=True),
    ),
    any_end("js_2", Form({"-": SKIPPED}, tails=JS), Form(always(FAILED), lead=(Number(")"),), gap="", tails=JS), Form({"✔": PASSED}, tails=JS, weak=True)),
    any_end("npx", Form({"✔": PASSED}, tails=(r"\s+\(\d+(?:ms)?\)$",)), Form(always(FAILED), lead=(Number(")"),), gap="", tails=(PARENTHESES,))),
    special("dart_v3", dart_line, LINE_END),
    special("scala", scala_line, LINE_END),
    special("ocaml_v3", ocaml_line, LINE_END),
    any_end("ocaml_v4", Form({s: s for s in (PASSED, FAILED, SKIPPED, ERROR)}, tails=(COLUMN,)), prepare=colours_to_blanks, by_rank=True),
    special("swift", swift_line, LINE_END),
    special("csharp", csharp_line, LINE_END, rstrip),
)
