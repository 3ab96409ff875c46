"""Small hand-written logs per dialect, with the statuses they must give.

All logs are read in one job, each dialect from its own runs.
"""

import pytest

from runsift.operators.extract import extract_test_results
from runsift.schema import UNREADABLE

P, F_, S, E = "PASSED", "FAILED", "SKIPPED", "ERROR"
BROKEN = {UNREADABLE: E}
BANNER = "=================================== FAILURES ==================================="
RULE = "___________________________"
JEST = "yarn ./node_modules/.bin/jest --ci\n"

LOGS = [
    ("pytest", "PASSED a\nFAILED b - x - y\nSKIPPED [1] c\nERROR d\r\nPASSED\n PASSED e\nPASSEDX f", {"a": P, "b": F_, "[1]": S, "d": E, "f": "PASSEDX"}),
    ("pytest", "FAILED - late\nPASSED a\u00a0b", {"late": F_, "a": P}),
    ("pytest", "FAILED a\nPASSED a", {"a": P}),
    ("pytest", "", {}),
    ("pytest_options", "PASSED t[/a/b/c]\nPASSED t[//a/b]\nPASSED t[/a/*]\nPASSED t[x]y\nPASSED t[", {"t[/c]": P, "t[//a/b]": P, "t[/a/*]": P, "t[x]": P, "t[": P}),
    ("matplotlib", "PASSED t[MouseButton.LEFT-MouseButton.RIGHT]", {"t[1-3]": P}),
    ("pytest_v2", "a PASSED\n\x1b[31mFAILED\x1b[0m b - x\nERROR\tc d", {"a": P, "b": F_, "d": "ERRORc"}),
    ("pytest_v2", "a PASSED\nFAILED", BROKEN),
    ("pytest_nebo", "[gw1] [ 3%] PASSED a b in 1s\n[gw1] [ 3%] NOPE x\nt FAILED [ 1%] in 1.5s\nSKIPPED s in x\nERROR e", {"a b": P, "t": F_, "s": S, "e": E}),
    ("seaborn", "FAILED a - x\nb PASSED [ 1%]\nx y PASSED z\nPASSED c", {"a": F_, "b": P, "c": P}),
    ("seaborn", "PASSED", BROKEN),
    ("django", "t1 (a.B) ... ok\nt2 (a.B) ... noise\nmore\nok\nt3 ... skipped 'x'\nt4 ... FAIL\nFAIL: t5 (a.B)\nERROR: t6 (x)\nt7 ... ERROR", {"t1 (a.B)": P, "t2 (a.B)": P, "t3": S, "t4": F_, "t5": F_, "t6": E, "t7": E}),
    ("django", "ok\nx ...  OK\n--version is equivalent to version", {"x": P, "--version is equivalent to version": P}),
    ("django", "t9 ... Internal Server Error: /a/b/\nok\nt10 ... Testing against Django installed in '/x\ny silenced).\nok", {"t9": P, "t10": P}),
    ("django", "Applying sites.0002_alter_domain_unique...test_no_migrations (m.T) ... ok", {"test_no_migrations (m.T)": P}),
    ("django", "FAIL:", BROKEN),
    ("sympy", "____ sympy/a.py:test_x ____\ntest_a ok\ntest_b F [FAIL]\ntest_c E\ntest_d ok [OK]", {"sympy/a.py:test_x": F_, "test_a": P, "test_b": F_, "test_c": E, "test_d": P}),
    ("gotest", "    --- PASS: T/sub (0.0s)\n--- FAIL: U (1s)\n--- SKIP: V (0s)\n--- PASS: W", {"T/sub": P, "U": F_, "V": S}),
    ("elixir", "* test a [L#1]\n* test b (1.5ms) [L#2]\n* test c (skipped) [L#3]\n1) test a (M)\n* test a [L#1]", {"a": F_, "b": P, "c": S}),
    ("ruby_v1", "Suite\n  test_a  PASS (0.1s)\n  test_a  SKIP\n  test_b  ERROR\n  test_b  FAIL (1s)\nFinished in 1s", {"Suite::test_a": P, "Suite::test_b": E}),
    ("ruby_v1", "  test_x  FAILURE", {"test_x": F_}),
    ("redis", "[ok]: a (12 ms)\n[err]: b in tests/x.tcl\n[skip]: c\n[ignore]: d", {"a": P, "b": F_, "c": S, "d": S}),
    ("jq", "  PASS: a b\nFAIL: c", {"a b": P, "c": F_}),
    ("doctest", 'x<doctest><TestCase name="A"><SubCase name="b"><Expression success="true"/><SubCase name="c"><Expression success="false"/></SubCase></SubCase><SubCase name="d"/></TestCase></doctest>y', {"A > b": F_, "A > c": F_, "A > d": P}),
    ("doctest", '<doctest><TestCase name="A &lt; B"><SubCase><Expression success="true"/></SubCase></TestCase></doctest>', {"A < B > None": P}),
    ("doctest", "<doctest><open></doctest>", BROKEN),
    ("doctest", "<doctest> never closed", BROKEN),
    ("micropython_test", "pass  a\nFAIL  b\nskip  c", {"a": P, "b": F_, "c": S}),
    ("googletest", "[       OK ] A.b (1 ms)\n[  FAILED  ] A.c (1 ms)\n[  FAILED  ] A.d", {"A.b": P, "A.c": F_}),
    ("minitest", "a. x = 1 s = .\nb. x = 1,0 s = E", {"a": P, "b": F_}),
    ("cucumber", "a ....\nb ..F", {"a": P, "b": F_}),
    ("ruby_unit", "test: a: .\ntest: b: F\nc: O\nd: E", {"a": P, "b": F_, "c": S, "d": F_}),
    ("rspec_transformed_json", "a - b - passed\nc - failed\nd - pending", {"a - b": P, "c": F_}),
    ("cargo", "test a ... ok\ntest b ... FAILED\ntest c ... ignored", {"a": P, "b": F_}),
    ("phpunit", " ✔ early\nFoo Bar (App\\Foo)\n ✔ a [1.34 ms]\n ✘ b\n ↩ c", {"None > early": P, "Foo Bar > a": P, "Foo Bar > b": F_, "Foo Bar > c": S}),
    ("maven", "BUILD SUCCESS\n+ mvn -Dtest=A\nx BUILD FAILURE\n", {"---NO TEST NAME FOUND YET---": P, "A": F_}),
    ("ant", "  [junit] [PASS] a\n[junit] [ERR] b", {"a": P, "b": F_}),
    ("kotlin_junit", "Tests run: 1, Failures: 0, Errors: 0, Skipped: 0\nRunning A\nTests run: 1, Failures: 0, Errors: 1, Skipped: 0\nTests run: 1, Failures: 0, Errors: 0, Skipped: 0\nRunning B\nTests run: 1, Failures: 0, Errors: 0, Skipped: 1", {"A": F_, "B": S}),
    ("gradle_custom", "A > b PASSED (1.2s)\nA > c FAILED\n> no PASSED\nd SKIPPED", {"A > b": P, "A > c": F_}),
    ("calypso", f"  not yet\n{JEST}  Outer\n    Inner\n      ✓ a (3ms)\n    Other\n      ✕ b\nTest Suites: 1\n      ✓ unread\n{JEST}      ✓ c", {"Outer - Inner - a": P, "Outer - Other - b": F_, "Outer - Other - c": P}),
    ("calypso", f"{JEST}✓ at the margin", BROKEN),
    ("chart_js", "\x1b[31mChrome 1.2 (Linux) a b FAILED\x1b[0m\nChrome 3 (x) c FAILED", {"a b ": F_, "c ": F_}),
    ("marked", "1) a \n 2) b", {"a": F_}),
    ("react_pdf", "PASS a (1.2 s)\nFAIL b\n PASS c", {"a": P, "b": F_}),
    ("jest", "  ✓ a (3 ms)\n  ✕ b\n  ○ c", {"a": P, "b": F_, "c": S}),
    ("jest_json", "[PASSED] a\n[FAILED] b", {"a": P, "b": F_}),
    ("vitest", "✓ a 3ms\n× b\n↓ c [skipped]", {"a": P, "b": F_, "c": S}),
    ("tap", "ok 1 a\nnot ok 2 b\nok c", {"a": P, "b": F_}),
    ("cpp", f"t.py::a PASSED x\nt.py::a FAILED\nb SKIPPED\nc ERROR\n{BANNER}\nt.py::d PASSED\n{RULE} e {RULE}\n{RULE} b {RULE}", {"a": F_, "b": F_, "c": E, "e": F_}),
    ("cpp_v2", "Test a  passed\nTest a  failed\nTest a  passed\nTest b  skipped", {"a": F_, "b": S}),
    ("cpp_v3", "AES ran 12 tests in 3.1 msec all ok\nX ran 2 tests in 1 sec 1 tests failed\n[1/4] n... OK\nn2... weird\nthis line FAILED here\nskipped ok ...  done\nno ok_here", {"AES ran 12 tests all ok": P, "X ran 2 tests 1 tests failed": F_, "n": P, "n2": E, "this line FAILED here": F_, "skipped ok": S}),
    ("cpp_v4", " 1/9 Test #1: a ...  Passed\n2/9 Test #2: b .....***Failed\n3/9 Test #3: c ... timeout", {"a": P, "c": F_}),
    ("lua_nvim", "\x1b[32mSuccess\x1b[0m || a\nFail || a\nskip || b\nSuccess || b\nSuccess: 2", {"a": F_, "b": S}),
    ("java_mvn", "[INFO] Running c.A\n[INFO] Tests run: 1, Failures: 0, Errors: 0, Skipped: 0\n[INFO] Running c.B\n[ERROR] c.B.t:12 boom\n[ERROR] c.B.u:3 NullPointerException\nTests run: 2, Failures: 1, Errors: 0, Skipped: 0 in c.B.", {"c.A": P, "c.B.t": F_, "c.B.u": E, "c.B": F_}),
    ("java_mvn", "[INFO] Running c.A\n[INFO] Running c.B", {"c.A": P, "c.B": P}),
    ("java_mvn", '<testcase name="t" classname="C"/>\n-Dtest=Z\nBUILD FAILURE', {"C t": P, "Z": F_}),
    ("junit", '<testcase classname="c" name="a"><failure/></testcase><testcase name="b"/>\n<testcase name="" /><testcase classname="c" name="open"> <error', {"c a": F_, "b": P, "c open": E}),
    ("junit", '<testcase name="x&lt;y" classname="k"><skipped/></testcase>', {"k x&lt;y": S}),
    ("java_mvn_v2", "[INFO] A - b ....... SUCCESS [ 1 s]\n[INFO] C .... FAILURE\nTests run: 2, Failures: 0, Errors: 1, Skipped: 0\nTests run: 2, Failures: 1, Errors: 0, Skipped: 0", {"A - b": P, "C": F_, "__suite__": E}),
    ("php_v1", "  ✓ a   0.03s\n  ⨯ b 0.1s\n  x c\n  - d\n  FAIL  Tests\\T\n  ✓ b\nTests: 1 failed\nfoo (skipped)", {"a": P, "b": F_, "c": F_, "d": S, "Tests\\T": F_, "foo (skipped)": S}),
    ("ruby_v2", "T#a = 1.0 s = .\nT#b = 1.0 s = E\nT#c = 1 s = S", {"T#a": P, "T#b": F_, "T#c": S}),
    ("haskell", "  a: OK (0.1s)\n  ✓ b (1s)\n  ✗ b\n  c [✔]\n  1) d\n### Error in: e\n  f: PENDING\nLinking x: OK", {"a": P, "b": F_, "c": P, "d": F_, "e": E, "f": S}),
    ("haskell_v2", "noise\nTest suite t: RUNNING...\n\nA\n  b\n    c\n    d FAILED [1]\n    Golden and Actual output didn't change\n  e\n    # PENDING\nFailures:\n  1) A, b, c\n  x\nFinished in 1s\n  2) A, z", {"A.b.c": F_, "A.b.d": F_, "A.e.#": S}),
    ("haskell_v2", "Building x.y\nMod.A\n  one\n  two", {"Mod.A.one": P, "Mod.A.two": P}),
    ("js", "✔ a (5ms)\n- b\n[W] 1) c\n2) d:\n1) e\n✔ c", {"a": P, "b": S, "c": F_, "d": F_}),
    ("js_2", "✔ a 12s\n1) a\n- (3ms)", {"a": F_}),
    ("js_3", "ok 1 - s {\n  ok 1 - a # time=1\n  not ok 2 - b (3ms)\n  ok 3 - c# skip\n}\n}\nok 2 - a", {"s": P, "s :: a": P, "s :: b": F_, "s :: c# skip": S, "a": P}),
    ("js_4", "✔ [tag]: a (5ms)\n✓ : b\n× a\n○ c\n⚪ d\nsome [skipped] thing\n✔", {"a": F_, "b": P, "c": S, "d": S, "some  thing": S}),
    ("gradlew_v1", '<?xml version="1.0"?>\n<testsuite>\n<testcase name="a" classname="C"/>\n<testcase name="b"><skipped/><failure/></testcase>\n</testsuite>\n  <?xml version="1.0"?>\n<testsuite><testcase name="z"/>\n</testsuite>', {"a (C)": P, "b": S}),
    ("julia", "early | 1 2\nTest Summary: | Pass  Total\na | 2 2 0.1s\nb | 1 2\nTest Summary: | Pass  Error  Total\n  c | 1 1 2\n  d |             3 3\nTest Summary: | Pass Fail Total\ne | 1 1 2\nf | 5 0 0 5\ng | 5 1 0 0 6", {"a": P, "b": E, "c": E, "d": E, "e": F_, "f": P, "g": F_}),
    ("npx", "  ✔ a (5ms)\n  1) b c (mod)\n  ✔ b c", {"a": P, "b c": P}),
    ("r", "✔ | 60 | a [1.2s]\n✖ | 2 2 9 | b\nError (x): early\n── Failed tests ──\nFailure ('f:1'): t1\nError ('f:2'): a\n[ FAIL 1 ]\nFailure ('f:3'): late", {"a": E, "b": F_, "t1": F_}),
    ("r_v2", "* checking a ... OK\n* checking b ...\n text\n* checking no ... ERROR\nWARNING: x\n WARNING\n* checking c ... WHAT\n* checking d ...\nend", {"a": P, "b": F_, "c": P, "d": P}),
    ("r_v2", "* checking b ...\n..\nOK", BROKEN),
    ("lein", "FAIL in early\nlein test a.b c.d\nFAIL in (x)\nlein test :only e.f/t\nERROR in (y)\nlein test :only\nFAIL in (z)\nlein test a.b", {"a.b": P, "c.d": F_, "e.f": E}),
    ("dart", '{"type":"testStart","test":{"id":1,"name":"a"}}\n{"type":"testDone","testID":1,"result":"success"}\n{"type":"testStart","test":{"id":2,"name":"loading x"}}\n{"type":"testDone","testID":2,"result":"error"}\n[{"type":"testStart","test":{"id":3,"name":"b"}},{"type":"testDone","testID":3,"result":"success","hidden":true}]\n{"type":"testDone","testID":9,"result":"error"}\n{"type":"testStart","test":{"id":"1","name":"c"}}\n{"type":"testDone","testID":1,"result":"failure"}', {"a": F_}),
    ("dart_v2", "[p]: 00:01 +1: /a/t.dart: x\n[p]: 00:01 +2: /a/t.dart: x\n[p]: 00:02 +3: /a/t.dart: y\n[p]: 00:02 +3: /a/t.dart: loading z", {"/a/t.dart: x": P, "/a/t.dart: y": E}),
    ("dart_v3", "00:01 +1: /p/t.dart: a\n00:01 +1 -1: /p/t.dart: a [E]\n00:02 +1 -2: loading /p/u.dart [E]\n00:03 +1 -2: /p/t.dart: b", {"/p/t.dart: a": F_, "/p/u.dart": E, "/p/t.dart: b": P}),
    ("scala", "[info] - a (3 ms)\n[info] - a *** FAILED *** (3 ms)\n[info] - b !!! CANCELED !!! (1 s)\n[info] - c !!! IGNORED !!!", {"a": F_, "b": S, "c": S}),
    ("scala_v2", "\x1b[32m  + \x1b[0m\x1b[32ma\x1b[0m \x1b[90m3ms\x1b[0m\n[31m  x [0m[31mb[0m [90m3ms[0m", {"a": P, "b": F_}),
    ("scala_v3", "[info] - lone\n[info] Suite:\n[info] - a (3 milliseconds)\n[info] - a *** FAILED ***\n[info] loading x\n[info] - b *** ODD ***", {"lone": P, "Suite:: a": F_, "Suite:: b": "ODD"}),
    ("ocaml", "[OK]  s  1  a\n[FAIL]  s  1  a\n[OK]  s  1  a\n[ODD] s 2 b", {"s 1 a": F_, "s 2 b": E}),
    ("ocaml_v2", "Running[1]: (cd x && exec ./a/t.exe -v)\nRunning[2]: (./u.exe)\nlost FAIL\nOutput[2]:\nfine\nOutput[1]:\nsome Exception\nOK\nOutput[7]:\nFAIL", {"u.exe": P, "t.exe": F_}),
    ("ocaml_v3", "[ok] a  b\n[SKIP] a b\n[x] c\n[Panic] d", {"a b": S, "d": F_}),
    ("ocaml_v4", "\x1b[32mPASSED\x1b[0m a b   x\nFAILED a b\nPASSED a b", {"a b": F_}),
    ("r_junit", 'x <?xml version="1.0"?><testsuites><testsuite><testcase name="a" classname="c"/><testcase name="b"><error/></testcase></testsuite></testsuites> <?xml version="1.0"?><testsuites><testsuite><testcase name="z"/></testsuite></testsuites>', {"c::a": P, "b": E}),
    ("combined_test_reports", '<?xml version="1.0"?><testsuites><testcase name="a &amp; b"/><!-- <testcase name="no"/> --></testsuites> <?xml version="1.0"?><testsuites><open></testsuites> <?xml version="1.0"?><testsuites><testcase classname="c" name="z"><x><failure/></x><skipped/></testcase></testsuites>', {"None::a & b": P, "c::z": S}),
    ("swift", "Test Case 'A.b' passed (0.1 seconds)\nTest Case 'A.c' failed (1.0 seconds)", {"A.b": P, "A.c": F_}),
    ("csharp", "  Passed a [3 ms]\n  Failed b [1 s]\n  Skipped c\n[xUnit.net 00:00:01.2]   a [FAIL]\nPassed d [1 ms]", {"a": F_, "b": F_, "c": S}),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(str(i), name, 0, log) for i, (name, log, _) in enumerate(LOGS)]
    runs = spark.createDataFrame(rows, "run_id STRING, parser STRING, part BIGINT, log STRING").repartition(4)
    by_run: dict[str, dict[str, str]] = {}
    for row in extract_test_results(runs).collect():
        by_run.setdefault(row["run_id"], {})[row["test_id"]] = row["status"]
    return by_run


@pytest.mark.parametrize("number", range(len(LOGS)), ids=[f"{i}-{name}" for i, (name, _, _) in enumerate(LOGS)])
def test_dialect(found, number):
    _, _, expected = LOGS[number]
    got = found.get(str(number), {})
    if UNREADABLE in expected:
        assert UNREADABLE in got
    else:
        assert got == expected


@pytest.fixture(scope="module")
def found_in_parts(spark):
    """The same logs, with every line a part of its own."""
    rows = [(str(i), name, n, part) for i, (name, log, _) in enumerate(LOGS) for n, part in enumerate(cut_at_line_feeds(log))]
    runs = spark.createDataFrame(rows, "run_id STRING, parser STRING, part BIGINT, log STRING").repartition(4)
    by_run: dict[str, dict[str, str]] = {}
    for row in extract_test_results(runs).collect():
        by_run.setdefault(row["run_id"], {})[row["test_id"]] = row["status"]
    return by_run


def cut_at_line_feeds(log: str) -> list[str]:
    pieces = log.split("\n")
    return [p + "\n" for p in pieces[:-1]] + [pieces[-1]]


@pytest.mark.parametrize("number", range(len(LOGS)), ids=[f"{i}-{name}" for i, (name, _, _) in enumerate(LOGS)])
def test_parts_do_not_change_the_answer(found, found_in_parts, number):
    assert found_in_parts.get(str(number), {}) == found.get(str(number), {})


def test_every_dialect_has_a_log():
    from runsift.operators.extract import REGISTRY

    assert {name for name, _, _ in LOGS} >= {n for n in REGISTRY.entries if not n.startswith("custom")}
