"""Dialects that print XML test reports into the log."""

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from runsift.functions.binding import bind, share
from runsift.functions.nesting import sub_cases
from runsift.operators.dialects.base import Dialect, emit_log, event_columns, strong, unreadable
from runsift.operators.dialects.parts import from_earlier
from runsift.operators.dialects.xml_text import read_junit_text
from runsift.schema import ERROR, FAILED, PASSED, SKIPPED

# --- Reports read as documents: a malformed document says nothing -------------

XML_OPTIONS = {"mode": "PERMISSIVE", "ignoreSurroundingSpaces": "false", "nullValue": "\x00"}
WELL_FORMED = "_corrupt_record STRING, runsift_none STRING"
CASE = "_name STRING, _classname STRING, failure ARRAY<STRING>, error ARRAY<STRING>, skipped ARRAY<STRING>"
INSIDE_TAG = r"""(?:[^>"'/]++|"[^"]*+"|'[^']*+'|/(?!>))*+"""
CASE_ELEMENT = rf"(?s)<testcase(?=[\s/>]){INSIDE_TAG}(?:/>|>.*?</testcase\s*>)"


# A case without children whose attributes hold nothing to decode.
PLAIN_CASE = r"""^<testcase(?:\s+[\w:.-]+\s*=\s*"[^"&\t\n\r]*+")*+\s*/>$"""


def read_case(xml: Column) -> Column:
    """Attributes and children of a test case element.

    Most cases passed and are plain tags, whose attributes need no XML reader.
    """

    def attribute(name: str) -> Column:
        shape = rf"""\s{name}\s*=\s*"([^"]*)\""""
        return F.when(xml.rlike(shape), F.regexp_extract(xml, shape, 1))

    none = F.lit(None).cast("array<string>")
    plain = F.struct(
        attribute("name").alias("_name"), attribute("classname").alias("_classname"),
        none.alias("failure"), none.alias("error"), none.alias("skipped"),
    )
    return F.when(xml.rlike(PLAIN_CASE), plain).otherwise(F.from_xml(xml, CASE, XML_OPTIONS))


def is_well_formed(document: Column) -> Column:
    return F.from_xml(document, WELL_FORMED, XML_OPTIONS)["_corrupt_record"].isNull()


def has_root(document: Column, name: str) -> Column:
    return document.rlike(rf"(?s)^(?:<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>\[]*>|\s)*<{name}[\s/>]")


def without_hidden_text(document: Column) -> Column:
    """Comments and CDATA may hold text that looks like tags."""
    return F.regexp_replace(document, r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>", "")


def case_rows(documents: DataFrame) -> DataFrame:
    """Test cases of documents(run_id, part, document, body), in order.

    The well-formed documents are cut into their test case elements, and each
    element is read by the XML reader on its own.
    """
    good = documents.where(is_well_formed(F.col("body")))
    cases = good.select(
        "run_id",
        "part",
        "document",
        F.posexplode(F.regexp_extract_all(without_hidden_text(F.col("body")), F.lit(CASE_ELEMENT), F.lit(0))).alias("case", "xml"),
    )
    cases = cases.select("run_id", "part", (F.col("document").cast("bigint") * 2**31 + F.col("case")).alias("seq"), "xml")
    return cases.select("run_id", "part", "seq", F.inline(F.array(read_case(F.col("xml")))))


@dataclass(frozen=True)
class Marks:
    """Where a document begins and ends in a log."""

    start: str
    end: str
    #: Both stand at the start of a line, and a new start drops a document without an end.
    by_line: bool = False

    def first(self, mark: str, closing: bool) -> str:
        ahead = r"(?m:^)[^\S\n]*" if self.by_line else ""
        return ahead + re.escape(mark) + (r"[^\n]*" if self.by_line and closing else "")

    def whole(self) -> str:
        """A document: up to the first end behind its start."""
        between = rf"(?:(?!{self.first(self.start, False)}).)*?" if self.by_line else ".*?"
        return rf"(?s){self.opening()}{between}{self.first(self.end, True)}"

    def opening(self) -> str:
        return ("(?m:^)" if self.by_line else "") + re.escape(self.start)

    def head(self) -> str:
        """What belongs to a document that began earlier, up to its end."""
        between = rf"(?:(?!{self.first(self.start, False)}).)*?" if self.by_line else ".*?"
        return rf"(?s)\A{between}{self.first(self.end, True)}"

    def tail(self) -> str:
        """A document without its end."""
        again = f"(?!.*{self.first(self.start, False)})" if self.by_line else ""
        return rf"(?s){self.opening()}{again}.*\z"


def documents_of(runs: DataFrame, marks: Marks) -> DataFrame:
    """Documents of logs, closed or cut off: (run_id, part, document, body).

    Documents within a part are taken where they lie. A document that reaches over
    parts is put together from its pieces, one document at a time; a part's small row says
    whether it begins within one.
    """
    log = F.col("log")
    hit = runs.where(log.contains(marks.start))
    whole = hit.select("run_id", "part", F.posexplode(F.regexp_extract_all(log, F.lit(marks.whole()), F.lit(0))).alias("document", "body"))

    # How a part leaves off: behind its last end, or all of it if it has none.
    rest = F.regexp_replace(log, rf"(?s)\A.*{marks.first(marks.end, True)}", "")
    tail = F.regexp_extract(rest, marks.tail(), 0)
    has_end = log.rlike(f"(?s){marks.first(marks.end, True)}")
    leaves = F.when(tail != "", F.struct(F.col("part").alias("of"), F.lit(True).alias("open"))).when(has_end, F.struct(F.col("part").alias("of"), F.lit(False).alias("open")))
    begun = from_earlier(runs, doc=leaves).where("doc.open").select("run_id", "part", F.col("doc.of").alias("of"))

    head = F.regexp_extract(log, marks.head(), 0)
    piece = F.when(head != "", head).when(~has_end & ~log.rlike(f"(?s){marks.first(marks.start, False)}") | F.lit(not marks.by_line) & ~has_end, log)
    begins = hit.where(tail != "").select("run_id", F.col("part").alias("of"), "part", tail.alias("piece"))
    goes_on = runs.where("part > 0").select("run_id", "part", piece.alias("piece")).where("piece is not null").join(begun, ["run_id", "part"])
    joined = begins.unionByName(goes_on).groupBy("run_id", F.col("of").alias("part")).agg(F.sort_array(F.collect_list(F.struct("part", "piece"))).alias("pieces"))
    spanning = joined.select("run_id", "part", F.lit(1 << 30).alias("document"), F.array_join(F.col("pieces.piece"), "").alias("body"))
    return whole.unionByName(spanning)


def case_events(cases: DataFrame, key: Column, order: tuple[str, ...]) -> DataFrame:
    status = None
    words = {"failure": FAILED, "error": ERROR, "skipped": SKIPPED}
    for child in order:
        status = (F if status is None else status).when(F.col(child).isNotNull(), words[child])
    found = cases.select("run_id", "part", "seq", F.lit(0).alias("sub"), strong(key, status.otherwise(PASSED)).alias("e"))
    return event_columns(found.select("run_id", "part", "seq", "sub", "e.*"))


SUITES = Marks("<?xml", "</testsuites>")
SUITE_LINES = Marks("<?xml", "</testsuite>", by_line=True)


def reports(runs: DataFrame, marks: Marks, root: str) -> DataFrame:
    """Closed documents with that root."""
    documents = documents_of(runs, marks)
    return documents.where(F.col("body").rlike(rf"</{root}>\s*\z") & has_root(F.col("body"), root))


def of_first(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows (run_id, part, document, ...) of the first of some documents of each run; no text takes part."""
    first = documents.groupBy(F.col("run_id").alias("of_run")).agg(F.min(F.struct("part", "document")).alias("first"))
    same = (F.col("run_id") == F.col("of_run")) & (F.col("part") == F.col("first.part")) & (F.col("document") == F.col("first.document"))
    return rows.join(first, same).drop("of_run", "first")


def read_combined_reports(runs: DataFrame) -> DataFrame:
    """Every `<?xml ... </testsuites>` in the log; key `class::name`."""
    cases = case_rows(reports(runs, SUITES, "testsuites"))
    key = F.concat_ws("::", F.coalesce("_classname", F.lit("None")), F.coalesce("_name", F.lit("None")))
    return case_events(cases, key, ("failure", "skipped", "error"))


def read_first_report(runs: DataFrame) -> DataFrame:
    """The first `<?xml ... </testsuites>` in the log."""
    closed = documents_of(runs, SUITES).where(F.col("body").endswith("</testsuites>"))
    cases = case_rows(closed.where(has_root(F.col("body"), "testsuites")))
    cases = of_first(cases.withColumn("document", F.shiftright("seq", 31)), closed)
    name, owner = F.coalesce("_name", F.lit("")), F.coalesce("_classname", F.lit(""))
    key = F.when(owner == "", name).otherwise(F.concat(owner, F.lit("::"), name))
    return case_events(cases, key, ("failure", "error", "skipped"))


def read_suite_reports(runs: DataFrame) -> DataFrame:
    """Blocks from a line `<?xml` to a line `</testsuite>`; key `name (class)`."""
    cases = case_rows(reports(runs, SUITE_LINES, "testsuite"))
    name, owner = F.coalesce("_name", F.lit("")), F.coalesce("_classname", F.lit(""))
    key = F.when((owner == "") | (name == ""), name).otherwise(F.concat(name, F.lit(" ("), owner, F.lit(")")))
    return case_events(cases, key, ("skipped", "failure", "error"))


# --- C++ doctest: nested sub-cases ---------------------------------------------

DOCTEST = Marks("<doctest", "</doctest>")
DOCTEST_TAG = rf"(?s)</?(?:TestCase|SubCase|Expression)(?=[\s/>]){INSIDE_TAG}/?>"
TAG = "_name STRING, _success STRING"


def read_doctest(runs: DataFrame) -> DataFrame:
    """`case > sub-case`, passed if all expressions within it succeeded.

    The first report of a run counts; one that is not closed or not well-formed makes
    the log unreadable. A report's tags are walked within its row.
    """
    body = F.col("body")
    documents = bind(documents_of(runs, DOCTEST), good=F.when(body.endswith("</doctest>"), is_well_formed(body)).otherwise(False))

    tags = F.when(F.col("good"), F.regexp_extract_all(without_hidden_text(body), F.lit(DOCTEST_TAG), F.lit(0)))
    # What a tag is, whether it closes or opens one, and its attributes.
    item = lambda t: F.struct(
        F.regexp_extract(t, r"^</?(\w+)", 1).alias("kind"),
        F.when(t.startswith("</") & ~t.startswith("</Expression"), 1).otherwise(0).alias("closes"),
        (~t.startswith("<Expression") & ~t.startswith("</") & ~t.endswith("/>")).alias("opens"),
        F.when(~t.startswith("</"), F.from_xml(F.regexp_replace(t, "/?>$", "/>"), TAG, XML_OPTIONS)).alias("x"),
    )
    read = bind(documents, "run_id", "part", "document", "good", items=F.transform(tags, item))
    cases = sub_cases(F.col("items.kind"), F.col("items.closes"), F.col("items.opens"), F.col("items.x._name"), F.col("items.x._success"))
    # No text goes further than this: sub-cases with their outcome, one row for each document.
    told = share(read.select("run_id", "part", "document", "good", cases.alias("cases")))
    first = of_first(told, told)
    found = first.where("good").select("run_id", "part", F.posexplode("cases").alias("place", "f"))
    key = F.concat("f.case", F.lit(" > "), "f.name")
    events = found.select("run_id", "part", F.col("place").cast("bigint").alias("seq"), F.lit(0).alias("sub"), strong(key, F.when(F.col("f.failed"), FAILED).otherwise(PASSED)).alias("e"))
    return event_columns(events.select("run_id", "part", "seq", "sub", "e.*")).unionByName(emit_log(first.where(~F.col("good")), F.array(unreadable())))


DIALECTS = (
    Dialect("junit", read_junit_text),
    Dialect("combined_test_reports", read_combined_reports),
    Dialect("gradlew_v1", read_suite_reports),
    Dialect("r_junit", read_first_report),
    Dialect("doctest", read_doctest),
)
