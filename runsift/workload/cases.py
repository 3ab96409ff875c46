"""How each dialect writes a test: the templates behind the round-trip queries.

`{n}` is the test, `{s}` a suite, `{i}` a unique number. `lines` maps a status
to the text that reports it, `key` is the name the dialect should yield, and
`policy` how sightings of one name are settled.
"""

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Case:
    lines: tuple[tuple[str, str], ...]
    key: str = "{n}"
    policy: str = "last"
    head: str = "some output before\n"
    tail: str = "some output after\n"
    also: tuple[tuple[str, str, str], ...] = field(default=())


P, F_, S, E = "PASSED", "FAILED", "SKIPPED", "ERROR"


def case(*lines, **more) -> Case:
    return Case(tuple(lines), **more)


CASES: dict[str, Case] = {
    # lines that stand for themselves
    "pytest": case((P, "PASSED t/{n}.py::x"), (F_, "FAILED t/{n}.py::x - assert 1"), (S, "SKIPPED t/{n}.py::x why"), (E, "ERROR t/{n}.py::x"), key="t/{n}.py::x"),
    "pytest_options": case((P, "PASSED t.py::{n}[/a/b/c]x"), (F_, "FAILED t.py::{n}[/z/c] - no"), (E, "ERROR t.py::{n}[/c]"), key="t.py::{n}[/c]"),
    "matplotlib": case((P, "PASSED t.py::{n}[MouseButton.LEFT]"), (F_, "FAILED t.py::{n}[MouseButton.LEFT] - x"), key="t.py::{n}[1]"),
    "pytest_v2": case((P, "t.py::{n} PASSED"), (F_, "\x1b[31mFAILED\x1b[0m t.py::{n} - x"), (E, "t.py::{n} ERROR"), key="t.py::{n}"),
    "pytest_nebo": case((P, "[gw3] [ 12%] PASSED t.py::{n} in 1.2s"), (F_, "t.py::{n} FAILED [ 12%] in 1.2s"), (S, "SKIPPED t.py::{n}"), key="t.py::{n}"),
    "seaborn": case((P, "t.py::{n} PASSED [ 10%]"), (F_, "FAILED t.py::{n} - x"), key="t.py::{n}"),
    "django": case((P, "{n} (app.T) ... ok"), (F_, "{n} (app.T) ... FAIL"), (S, "{n} (app.T) ... skipped 'why'"), (E, "{n} (app.T) ... ERROR"), (P, "{n} (app.T) ... noise\nok"), key="{n} (app.T)"),
    "sympy": case((P, "test_{n} ok"), (F_, "test_{n} F [FAIL]"), (E, "test_{n} E"), key="test_{n}"),
    "gotest": case((P, "--- PASS: {n} (0.01s)"), (F_, "    --- FAIL: {n} (0.02s)"), (S, "--- SKIP: {n} (0.00s)")),
    "elixir": case((P, "  * test {n} (1.2ms) [L#4]"), (F_, "  1) test {n} (App.Test)"), (S, "  * test {n} (skipped) [L#9]"), policy="override"),
    "redis": case((P, "[ok]: {n} (12 ms)"), (F_, "[err]: {n} in tests/a.tcl"), (S, "[ignore]: {n}")),
    "jq": case((P, "PASS: {n}"), (F_, "FAIL: {n}")),
    "micropython_test": case((P, "pass  {n}"), (F_, "FAIL  {n}"), (S, "skip  {n}")),
    "googletest": case((P, "[       OK ] {n} (3 ms)"), (F_, "[  FAILED  ] {n} (3 ms)")),
    "minitest": case((P, "{n}. test_x = 0.01 s = ."), (F_, "{n}. test_x = 0,01 s = F")),
    "cucumber": case((P, "{n} ...."), (F_, "{n} ..F")),
    "ruby_unit": case((P, "test: {n}: ."), (F_, "test: {n}: F"), (S, "test: {n}: O")),
    "rspec_transformed_json": case((P, "{n} - passed"), (F_, "{n} - failed")),
    "cargo": case((P, "test {n} ... ok"), (F_, "test {n} ... FAILED"), (P, "test {n} ... ok\ntest other ... ignored")),
    "ant": case((P, "    [junit] [PASS] {n}"), (F_, "    [junit] [ERR] {n}")),
    "gradle_custom": case((P, "A > {n} PASSED (1.2s)"), (F_, "A > {n} FAILED"), key="A > {n}"),
    "marked": case((F_, "1) {n} ")),
    "react_pdf": case((P, "PASS {n} (1.2 s)"), (F_, "FAIL {n}")),
    "jest": case((P, "  ✓ {n} (3 ms)"), (F_, "  ✕ {n}"), (S, "  ○ {n}")),
    "jest_json": case((P, "[PASSED] {n}"), (F_, "[FAILED] {n}")),
    "vitest": case((P, " ✓ {n} 3ms"), (F_, " × {n}"), (S, " ↓ {n} [skipped]")),
    "tap": case((P, "ok 3 {n}"), (F_, "not ok 3 {n}")),
    "cpp_v2": case((P, "Test {n}     passed"), (F_, "Test {n}     failed"), (S, "Test {n}     skipped"), policy="override"),
    "cpp_v3": case((P, "[12/414] {n}... OK"), (F_, "[12/414] {n}... FAILED"), (S, "{n}... skipped"), (E, "{n} ... crash")),
    "cpp_v4": case((P, "3/9 Test  #3: {n} ....   Passed  0.1 sec"), (F_, "3/9 Test  #3: {n} ....***Failed\n3/9 Test #3: {n} ... Timeout"), (S, "3/9 Test #3: {n} ... Skipped")),
    "lua_nvim": case((P, "\x1b[32mSuccess\x1b[0m || {n}\t"), (F_, "Fail || {n}"), policy="override"),
    "php_v1": case((P, "  ✓ {n}   0.03s"), (F_, "  ⨯ {n}   0.03s"), (S, "  - {n}"), policy="override"),
    "ruby_v2": case((P, "T#{n} = 5.30 s = ."), (F_, "T#{n} = 5.30 s = E"), (S, "T#{n} = 0.00 s = S"), key="T#{n}"),
    "haskell": case((P, "  {n}: OK (0.01s)"), (F_, "  ✗ {n}"), (S, "  {n}: PENDING"), (E, "### Error in: {n}")),
    "js": case((P, "    ✔ {n} (5ms)"), (F_, "    [W] 1) {n}"), (S, "    - {n}"), policy="override"),
    "js_2": case((P, "    ✔ {n} (5ms)"), (F_, "    2) {n}"), (S, "    - {n}"), policy="override"),
    "js_4": case((P, "✔ [p/q]: {n} (5ms)"), (F_, "× {n}"), (S, "{n} [todo]"), policy="override"),
    "npx": case((P, "    ✔ {n} (5ms)"), (F_, "  1) {n} (module)")),
    "dart_v3": case((P, "00:01 +64: /p/t.dart: {n}"), (F_, "00:02 +8 -1: /p/t.dart: {n} [E]"), key="/p/t.dart: {n}", policy="override"),
    "scala": case((P, "[info] - {n} (3 ms)"), (F_, "[info] - {n} *** FAILED *** (3 ms)"), (S, "[info] - {n} !!! IGNORED !!!"), policy="override"),
    "scala_v2": case((P, "\x1b[32m  + \x1b[0m\x1b[32m{n}\x1b[0m \x1b[90m3ms\x1b[0m"), (F_, "  x {n} 3ms")),
    "ocaml": case((P, "[OK]   suite   3   {n}"), (F_, "[FAIL]   suite   3   {n}"), (S, "[SKIP] suite 3 {n}"), (E, "[WHAT] suite 3 {n}"), key="suite 3 {n}", policy="override"),
    "ocaml_v3": case((P, "[OK] a  {n}"), (F_, "[panic] a {n}"), (S, "[TODO] a {n}"), key="a {n}", policy="precedence"),
    "ocaml_v4": case((P, "\x1b[32mPASSED\x1b[0m {n}   x"), (F_, "FAILED {n}"), (S, "SKIPPED {n}"), (E, "ERROR {n}"), policy="precedence"),
    "swift": case((P, "Test Case '{n}' passed (0.1 seconds)"), (F_, "Test Case '{n}' failed (0.1 seconds)")),
    "csharp": case((P, "  Passed {n} [3 ms]"), (F_, "[xUnit.net 00:00:01.2]     {n} [FAIL]"), (S, "  Skipped {n}"), policy="override"),
    # headers, gates, tables
    "phpunit": case((P, "Suite{s} (App\\T)\n ✔ {n} [1.34 ms]"), (F_, "Suite{s} (App\\T)\n ✘ {n}"), (S, "Suite{s} (App\\T)\n ↩ {n}"), key="Suite{s} > {n}"),
    "ruby_v1": case((P, "Suite{s}\n  test_{n}      PASS (0.02s)"), (F_, "Suite{s}\n  test_{n}   FAILURE (0.1s)"), (S, "Suite{s}\n  test_{n}  SKIP"), (E, "Suite{s}\n  test_{n}  ERROR (0.0s)"), key="Suite{s}::test_{n}", policy="severity"),
    "maven": case((P, "+ mvn -q -Dtest={n} test\n[INFO] BUILD SUCCESS"), (F_, "+ mvn -Dtest={n}\n[INFO] BUILD FAILURE")),
    "kotlin_junit": case((P, "Running {n}\nTests run: 3, Failures: 0, Errors: 0, Skipped: 0"), (F_, "Running {n}\nTests run: 3, Failures: 0, Errors: 1, Skipped: 2"), (S, "Running {n}\nTests run: 3, Failures: 0, Errors: 0, Skipped: 1\nTests run: 1, Failures: 1, Errors: 0, Skipped: 0")),
    "java_mvn_v2": case((P, "[INFO] {n} .......... SUCCESS [  1.2 s]"), (F_, "[INFO] {n} .......... FAILURE [  1.2 s]"), (S, "[INFO] {n} .......... SKIPPED")),
    "scala_v3": case((P, "[info] Suite{s}\n[info] - {n} (3 milliseconds)"), (F_, "[info] Suite{s}\n[info] - {n} *** FAILED ***"), (S, "[info] Suite{s}\n[info] - {n} *** CANCELED ***"), key="Suite{s}: {n}", policy="override"),
    "lein": case((P, "lein test ns.{n}"), (F_, "lein test :only ns.{n}/t\n\nFAIL in (t) (x.clj:3)"), (E, "lein test ns.{n}\nERROR in (t) (x.clj:3)"), key="ns.{n}", policy="override"),
    "r_v2": case((P, "* checking {n} ... OK"), (P, "* checking {n} ...\n  some text\n NOTE"), (F_, "* checking {n} ...\nWARNING: x\n WARNING"), (E, "* checking {n} ... ERROR")),
    "ocaml_v2": case((P, "Running[{i}]: (cd x && ./{n}.exe)\nOutput[{i}]:\nOK"), (F_, "Running[{i}]: (exec ./{n}.exe -v)\nOutput[{i}]:\nfatal thing\nskip"), (S, "Running[{i}]: (./{n}.exe)\nOutput[{i}]:\nskipped"), key="{n}.exe", policy="precedence"),
    "cpp": case((P, "t/a.py::{n} PASSED [ 1%]"), (F_, "t/a.py::{n} FAILED [ 1%]"), (S, "t/a.py::{n} SKIPPED (why)"), (E, "t/a.py::{n} ERROR"), policy="override"),
    "julia": case((P, "  {n}   |   12     12  0.3s"), (F_, "  {n}   |   12   1   0  13  0.3s"), (E, "  {n}   |             2   2  0.3s"), head="noise | 1 2\nTest Summary: | Pass  Fail  Error  Total  Time\n"),
    "r": case((P, "✔ |  60 | {n} [1.2s]"), (F_, "✖ | 2 2 9 | {n}")),
    "dart_v2": case((P, "[pkg]: 00:01 +{i}: /p/t.dart: {n}"), key="/p/t.dart: {n}", policy="twice"),
    "chart_js": case((F_, "Chrome 1.2 (Linux) {n}FAILED")),
    # reports and trees
    "junit": case((P, '<testcase name="{n}" classname="c.C"/>'), (F_, '<testcase classname="c.C" name="{n}">\n<failure message="x"/></testcase>'), (S, '<testcase classname="c.C" name="{n}"><skipped/></testcase>'), (E, '<testcase classname="c.C" name="{n}"><error>x</error></testcase>'), key="c.C {n}"),
    "combined_test_reports": case((P, '<testcase classname="c" name="{n}"/>'), (F_, '<testcase classname="c" name="{n}"><failure>a &lt; b</failure></testcase>'), (S, '<testcase classname="c" name="{n}"><skipped/></testcase>'), (E, '<testcase classname="c" name="{n}"><error/></testcase>'), key="c::{n}", head='noise\n<?xml version="1.0" encoding="utf-8"?>\n<testsuites><testsuite name="x">\n', tail="</testsuite></testsuites>\nnoise\n"),
    "gradlew_v1": case((P, '<testcase classname="c" name="{n}"/>'), (F_, '<testcase classname="c" name="{n}"><failure/></testcase>'), (S, '<testcase classname="c" name="{n}"><skipped/><failure/></testcase>'), (E, '<testcase classname="c" name="{n}"><error/></testcase>'), key="{n} (c)", head='noise\n<?xml version="1.0"?>\n<testsuite name="x">\n', tail="</testsuite>\nnoise\n"),
    "r_junit": case((P, '<testcase classname="c" name="{n}"/>'), (F_, '<testcase classname="c" name="{n}"><failure/></testcase>'), (S, '<testcase classname="c" name="{n}"><skipped/></testcase>'), (E, '<testcase classname="c" name="{n}"><error/><skipped/></testcase>'), key="c::{n}", head='noise\n<?xml version="1.0"?>\n<testsuites><testsuite name="x">\n', tail="</testsuite></testsuites>\nnoise\n"),
    "doctest": case((P, '<TestCase name="T{s}"><SubCase name="{n}"><Expression success="true"/></SubCase></TestCase>'), (F_, '<TestCase name="T{s}"><SubCase name="{n}"><Expression success="true"/><Expression success="false"><Original>a &lt; b</Original></Expression></SubCase></TestCase>'), key="T{s} > {n}", head='noise\n<doctest binary="b">\n', tail="</doctest>\nnoise\n"),
    "calypso": case((P, "  Suite {s}\n    ✓ {n} (3ms)"), (F_, "  Suite {s}\n    ✕ {n}"), key="Suite {s} - {n}", head="run ./node_modules/.bin/jest --ci\n", tail="Test Suites: 1 passed\n    ✓ not read (1ms)\n"),
    "haskell_v2": case((P, "M{s}\n  {n}"), (F_, "M{s}\n  {n} FAILED [1]"), (S, "M{s}\n  {n} PENDING why"), key="M{s}.{n}", head="noise\nTest suite x: RUNNING...\n\n", tail="\nFailures:\n\n  nothing listed\n"),
    "js_3": case((P, "ok 1 - suite{s} {\n    ok 2 - {n} # time=1ms\n}"), (F_, "ok 1 - suite{s} {\n    not ok 2 - {n} (3ms)\n}"), key="suite{s} :: {n}", policy="override", also=(("suite{s}", P, "override"),)),
    "dart": case((P, '{"test":{"id":{i},"name":"{n}"},"type":"testStart"}\n{"testID":{i},"result":"success","hidden":false,"type":"testDone"}'), (F_, '[{"test":{"id":{i},"name":"{n}"},"type":"testStart"}]\n{"testID":{i},"result":"failure","type":"testDone"}'), (E, '{"test":{"id":{i},"name":"{n}"},"type":"testStart"}\n{"testID":{i},"result":"error","type":"testDone"}'), (S, '{"test":{"id":{i},"name":"{n}"},"type":"testStart"}\n{"testID":{i},"skipped":true,"type":"testDone"}')),
    "java_mvn": case((P, "[INFO] Running c.{n}\n[INFO] Tests run: 3, Failures: 0, Errors: 0, Skipped: 0, Time elapsed: 1 s - in c.{n}"), (F_, "[INFO] Running c.{n}\nTests run: 3, Failures: 1, Errors: 0, Skipped: 0"), (S, "Running c.{n}\nTests run: 3, Failures: 0, Errors: 0, Skipped: 1 in c.{n}."), key="c.{n}", policy="first"),
}

# The extraction families of the coverage list, as sets of dialects.
FAMILIES: dict[str, tuple[str, ...]] = {
    "extract_line_rules": ("pytest", "gotest", "cargo", "jest", "vitest", "tap", "redis", "swift"),
    "extract_override": ("elixir", "cpp_v2", "js", "scala", "csharp", "ocaml", "dart_v3"),
    "extract_severity": ("ruby_v1", "ocaml_v3", "ocaml_v4"),
    "extract_suite_context": ("phpunit", "maven", "kotlin_junit", "scala_v3", "lein", "r_v2"),
    "extract_section": ("cpp", "julia", "r"),
    "extract_nested": ("calypso", "haskell_v2", "js_3"),
    "extract_junit": ("junit", "combined_test_reports", "gradlew_v1", "r_junit", "doctest"),
    "extract_json_events": ("dart",),
    "extract_counters": ("kotlin_junit", "java_mvn_v2", "julia"),
    "extract_composite": ("java_mvn",),
    "extract_multiline": ("chart_js", "django", "sympy"),
}
