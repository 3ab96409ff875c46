"""Building blocks for reading log dialects.

A dialect turns rows (run_id, part, log) into events: "at this place the log
says this test has this status". Everything here works within one log row, and no
log leaves its row. What lines need from earlier parts of their log is carried
over by small rows (`parts`, `nesting`), so that the answer does not depend on how
a log was cut.

How repeated sightings of a test are settled is carried by two numbers, `prio`
and `sign`: the event with the highest prio wins, and among equals the last
one (sign 1) or the first one (sign -1).
"""

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from runsift.functions.text import LINE_END, rx, strip
from runsift.schema import ERROR, UNREADABLE

EVENT_COLUMNS = ("run_id", "reading", "part", "seq", "sub", "test_id", "status", "prio", "sign")

LINE_FEED = "\n"


@dataclass(frozen=True)
class Dialect:
    """How to read one kind of log: runs(run_id, part, log) -> events."""

    name: str
    read: Callable[[DataFrame], DataFrame]
    #: It sees one text at a time and needs the whole log in it (extractors of users).
    whole: bool = False
    #: Set if every line stands for itself.
    lines: "LineReader | None" = None


def event(key: Column, status: Column | str, prio: int | Column = 1, sign: int = 1) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        key.alias("test_id"),
        as_column(status).alias("status"),
        as_column(prio).cast("int").alias("prio"),
        F.lit(sign).alias("sign"),
    )


def strong(key: Column, status: Column | str) -> Column:
    """An event that overwrites what was known; the last one counts."""
    return event(key, status)


def weak(key: Column, status: Column | str) -> Column:
    """An event that counts only where nothing else is known; the first one."""
    return event(key, status, prio=0, sign=-1)


def ranked(key: Column, status: Column, ranks: Mapping[str, int], sign: int) -> Column:
    """An event that yields to events of higher rank."""
    rank = F.lit(-1)
    for name, value in ranks.items():
        rank = F.when(status == name, F.lit(value)).otherwise(rank)
    return event(key, status, rank, sign)


def unreadable() -> Column:
    """The log breaks its dialect here; the whole run counts as unreadable."""
    return event(F.lit(UNREADABLE), ERROR, prio=9)


def log_lines(runs: DataFrame, line_end: str = LINE_FEED, text: str = "log") -> DataFrame:
    return runs.select(
        "run_id", "part", F.posexplode(F.split(text, line_end)).alias("seq", "line")
    )


def event_columns(rows: DataFrame) -> DataFrame:
    """Event columns; the name is marked as never null, so that joins on it
    need no null check."""
    name = F.coalesce("test_id", F.lit("")).alias("test_id")
    return rows.select("run_id", F.lit(0).alias("reading"), "part", "seq", "sub", name, "status", "prio", "sign")


def emit(found: DataFrame, one: Column, certain: bool = False) -> DataFrame:
    """Rows with at most one event each, or exactly one if that is certain."""
    rows = found.select(
        "run_id", "part", F.col("seq").cast("bigint").alias("seq"), F.lit(0).alias("sub"), F.inline(F.array(one))
    )
    if not certain:
        rows = rows.where("test_id is not null")
    return event_columns(rows)


def emit_each(found: DataFrame, several: Column) -> DataFrame:
    """Rows with an array of events each, in order; null events are left out."""
    rows = found.select("run_id", "part", F.col("seq").cast("bigint").alias("seq"), F.posexplode(several).alias("sub", "e"))
    return event_columns(rows.where("e.test_id is not null").select("run_id", "part", "seq", "sub", "e.*"))


def emit_log(runs: DataFrame, several: Column) -> DataFrame:
    """Events computed for a log as a whole: their order gives the place."""
    rows = runs.select("run_id", "part", F.posexplode(several).alias("place", "e")).where("e.test_id is not null")
    return event_columns(rows.select("run_id", "part", F.col("place").cast("bigint").alias("seq"), F.lit(0).alias("sub"), "e.*"))


def later(events: DataFrame) -> DataFrame:
    """Events of a second reading of the log: they come after all of the first, whatever part they are in."""
    return events.withColumn("reading", F.lit(1))


def whole_logs(runs: DataFrame) -> DataFrame:
    """Joins the parts of each run, in order; a part without a final line end gets one.

    Only for extractors that users write as a function of one text: a run's log
    then is one row, as it is for whoever wrote it.
    """
    parts = F.sort_array(F.collect_list(F.struct("part", "log")))
    joined = runs.groupBy("run_id").agg(parts.alias("parts"))
    ended = F.transform("parts", lambda p: F.when(p["log"].endswith("\n") | (p["log"] == ""), p["log"]).otherwise(F.concat(p["log"], F.lit("\n"))))
    log = F.when(F.size("parts") == 1, F.col("parts")[0]["log"]).otherwise(F.array_join(ended, ""))
    return joined.select("run_id", F.lit(0).cast("bigint").alias("part"), log.alias("log"))


def one_line_per_feed(text: Column) -> Column:
    """Turn every kind of line end into a line feed."""
    other = text.rlike("[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
    return F.when(other, F.regexp_replace(text, LINE_END, "\n")).otherwise(text)


def sections(runs: DataFrame, header: str, any_line_end: bool = True) -> DataFrame:
    """Cut each log before every header line: (run_id, part, section, body).

    This is how a header is carried forward to the lines below it without a
    window: within a section the header is simply the first line. Only the
    section with number 0 may lack one.
    """
    text = one_line_per_feed(F.col("log")) if any_line_end else F.col("log")
    return runs.select(
        "run_id", "part", F.posexplode(F.split(text, rx(rf"(?=^{header})", lines=True))).alias("section", "body")
    )


def section_lines(cut: DataFrame, *carried: str) -> DataFrame:
    """Lines of sections with the columns carried down to them."""
    exploded = cut.select(
        "run_id", "part", "section", *carried, F.posexplode(F.split("body", LINE_FEED)).alias("row", "line")
    )
    return exploded.withColumn("seq", F.col("section").cast("bigint") * 2**31 + F.col("row"))


def lookup(text: Column, table: Mapping[str, str], other: str | None = None) -> Column:
    result = F.lit(other)
    by_status: dict[str, list[str]] = {}
    for token, status in table.items():
        by_status.setdefault(status, []).append(token)
    chosen = None
    for status, tokens in by_status.items():
        chosen = (F if chosen is None else chosen).when(text.isin(tokens), F.lit(status))
    return chosen.otherwise(result)


def as_is(line: Column) -> Column:
    return line


@dataclass(frozen=True)
class LineReader:
    """How a dialect reads a line that stands for itself: the line's event, or null."""

    event: Callable[[Column], Column]
    line_end: str = LINE_END
    prepare: Callable[[Column], Column] = strip

    def dialect(self, name: str) -> Dialect:
        def read(runs: DataFrame) -> DataFrame:
            return read_lines(runs.withColumn("dialect", F.lit(name)), {name: self})

        return Dialect(name, read, lines=self)


def read_lines(runs: DataFrame, readers: Mapping[str, LineReader]) -> DataFrame:
    """runs(run_id, part, log, dialect) -> events of all dialects that read line by line, in one pass.

    Lines are prepared once, as rows; each is then read by its own dialect's forms.
    """
    ways: dict[tuple, list[str]] = {}
    for name, reader in readers.items():
        ways.setdefault((reader.line_end, reader.prepare), []).append(name)
    lines = found = None
    for (line_end, prepare), names in ways.items():
        cut = F.split("log", line_end)
        lines = (F if lines is None else lines).when(F.col("dialect").isin(names), cut if prepare is as_is else F.transform(cut, prepare))
    for name, reader in readers.items():
        found = (F if found is None else found).when(F.col("dialect") == name, reader.event(F.col("line")))
    rows = runs.select("run_id", "part", "dialect", F.posexplode(lines).alias("seq", "line"))
    return emit(rows, found)


@dataclass
class Registry:
    """Dialects by name."""

    entries: dict[str, Dialect] = field(default_factory=dict)

    def add(self, *dialects: Dialect) -> None:
        for dialect in dialects:
            self.entries[dialect.name] = dialect
