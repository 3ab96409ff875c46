"""Test cases of XML reports that are read as text, across the parts of a log.

A case may begin in one part of a log and end in another, even within its tag. Every
part but the first is read in each way in which it may begin: outside of cases (OUT),
inside a case's tag (TAG), or inside a case that waits for its end (WAIT). Most cases of a
part are the same in all ways, so a case is kept once, with the ways that hold it. One
small row for each part says how it would leave off after each way; in the order of
parts these tell the way that holds, and what the cases between parts came to.
"""

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from runsift.functions.binding import share
from runsift.operators.dialects.base import event, event_columns
from runsift.operators.dialects.parts import read_parts
from runsift.schema import ERROR, FAILED, PASSED, SKIPPED

# Fixed value: how far an unclosed test case is looked into.
UNCLOSED_WINDOW = 4096
# Children that decide about a case, the first that is there.
CHILDREN = (("<failure", FAILED), ("<error", ERROR), ("<skipped", SKIPPED))
BEGIN, END = "<testcase", "</testcase>"

CASE = re.compile(r"<testcase\b")
NAMED = re.compile(r'[^>]*\bname="[^"]+"')
ATTRIBUTE = re.compile(r'\b(\w+)="([^"]*)"')

#: Ways in which a part may begin; NONE: it holds no case of its own.
OUT, TAG, WAIT, NONE = 1, 2, 4, 0


def name_and_owner(text: str) -> tuple[str | None, str | None]:
    """Name and class name in the text of a tag; the last ones if repeated."""
    name = owner = None
    if 'name="' in text:
        for attribute, value in ATTRIBUTE.findall(text):
            if attribute == "name":
                name = value
            elif attribute == "classname":
                owner = value
    return name, owner


def case_key(name: str | None, owner: str | None) -> str | None:
    if not owner or not name:
        return None if owner else name or None
    return f"{owner} {name}".strip()


def flags(text: str, start: int = 0, end: int | None = None) -> int:
    """Which children a stretch of text holds, one bit each."""
    found, bit = 0, 1
    for child, _ in CHILDREN:
        if text.find(child, start, end) >= 0:
            found |= bit
        bit <<= 1
    return found


#: Status by children that are there.
STATUS = [next((status for at, (_, status) in enumerate(CHILDREN) if found >> at & 1), PASSED) for found in range(1 << len(CHILDREN))]


class _Cases:
    """The cases of a log, from any place on.

    A tag that closes itself is a case, and so is all up to the next end. A tag without a name is none. A named tag
    behind which no end comes (open) sees a window of text.
    """

    def __init__(self, log: str):
        self.log, self.last_end = log, log.rfind(END)

    def at(self, start: int) -> tuple[int, str | None, str, bool, int, int] | None:
        """(end, key, status, open, text seen in the window, where what waits for an end begins) of a case; None if its tag is cut."""
        log = self.log
        close = log.find(">", start + len(BEGIN))
        if close < 0:
            return None
        behind = close + 1
        tag = log[start:behind]
        name, owner = name_and_owner(tag)
        key = case_key(name, owner)
        if tag[len(BEGIN) : -1].rstrip().endswith("/"):
            return behind, key, PASSED, False, 0, -1
        if not name and not NAMED.match(log, start + len(BEGIN)):
            return behind, None, PASSED, False, 0, -1
        if behind <= self.last_end:
            end = log.find(END, behind) + len(END)
            return end, key, STATUS[flags(log, behind, end)], False, 0, -1
        until = min(len(log), behind + UNCLOSED_WINDOW)
        return behind, key, STATUS[flags(log, behind, until)], key is not None and not tag.endswith(END), until - behind, behind

    def find(self, start: int, known: dict[int, int]) -> tuple[list[tuple], int]:
        """Cases from a place on, each with its start, up to the first known one; and that one's number."""
        found = []
        while begin := CASE.search(self.log, start):
            at = begin.start()
            if at in known:
                return found, known[at]
            case = self.at(at)
            if case is None:
                break
            found.append((at, *case))
            start = case[0]
        return found, len(known)


_CASE = pa.struct([("key", pa.string()), ("status", pa.string()), ("open", pa.bool_()), ("seen", pa.int32()), ("ways", pa.int32())])
# Facts about a part, by bits: a case's end, the end of a tag, the head of a tag closes itself, the part ends in a tag, ...
HAS_END, HAS_CLOSE, HEAD_CLOSES, IN_TAG = 1, 2, 4, 8
# ... and children up to the first end, in all, behind the first tag's end up to a case's end, in the window behind it,
# and behind the case that is open at the end, for each way: three bits each.
TO_END, IN_ALL, BEHIND_TAG, IN_WINDOW = 4, 7, 10, 13
OPEN = {OUT: 16, TAG: 19, WAIT: 22}


class CaseReader:
    """What parts say about test cases: small rows, with names and outcomes only."""

    fields = (
        ("cases", pa.list_(_CASE)), ("first_out", pa.int32()), ("first_tag", pa.int32()), ("first_wait", pa.int32()),
        ("facts", pa.int32()), ("seen", pa.int32()), ("head_name", pa.string()), ("head_owner", pa.string()),
        ("tail_name", pa.string()), ("tail_owner", pa.string()), ("size", pa.int64()), *[(f"next_{i}", pa.int64()) for i in range(len(CHILDREN))],
    )

    def __init__(self):
        self.rows = []

    def add(self, run_id: str | None, part: int | None, log: str) -> None:
        cases, firsts, facts, seen, head, tail = [], (None, None, None), 0, 0, (None, None), (None, None)
        starts = {OUT: 0}
        close, end = log.find(">"), log.find(END)
        children = [log.find(child) for child, _ in CHILDREN]
        if part != 0:
            if end >= 0:
                starts[WAIT] = end + len(END)
            if close >= 0:
                starts[TAG] = close + 1
            facts, seen, head = self._beginning(log, close, end, children)
        if BEGIN in log:
            cases, firsts, opened = self._read(log, starts)
            cut = CASE.search(log, log.rfind(">") + 1)
            tail = name_and_owner(log[cut.start() :]) if cut else tail
            facts |= opened | (IN_TAG if cut else 0)
        self.rows.append((cases, *firsts, facts, seen, *head, *tail, len(log), *[at + 1 if at >= 0 else None for at in children]))

    def _beginning(self, log: str, close: int, end: int, children: list[int]) -> tuple[int, int, tuple]:
        """What a case finds here that began earlier."""
        head = log if close < 0 else log[:close]
        facts = (HAS_END if end >= 0 else 0) | (HAS_CLOSE if close >= 0 else 0) | (HEAD_CLOSES if head.rstrip(" ").endswith("/") else 0)
        seen = 0 if close < 0 else min(UNCLOSED_WINDOW, len(log) - close - 1)
        if max(children) >= 0:
            for at, place in enumerate(children):
                if place >= 0:
                    facts |= 1 << at + IN_ALL | (1 << at + TO_END if end < 0 or place < end else 0)
            if close >= 0:
                to = log.find(END, close + 1)
                facts |= flags(log, close + 1, to if to >= 0 else None) << BEHIND_TAG | flags(log, close + 1, close + 1 + seen) << IN_WINDOW
        return facts, seen, name_and_owner(head)

    def _read(self, log: str, starts: dict[int, int]) -> tuple[list, tuple, int]:
        """A part's cases; the first open one of each way, and what is behind it."""
        text = _Cases(log)
        out, _ = text.find(0, {})
        ways, common, extra = {OUT: out}, {OUT: 0}, {}
        if len(starts) > 1:
            numbers = {case[0]: n for n, case in enumerate(out)}
            for way in (TAG, WAIT):
                if way in starts:
                    own, common[way] = text.find(starts[way], numbers)
                    for case in own:
                        extra[case[0]] = (case, way | (extra[case[0]][1] if case[0] in extra else NONE))
                    ways[way] = own + out[common[way] :]
        tag, wait = common.get(TAG, len(out)), common.get(WAIT, len(out))
        held = [(case, OUT | (TAG if n >= tag else NONE) | (WAIT if n >= wait else NONE)) for n, case in enumerate(out)]
        if extra:
            held = sorted(held + list(extra.values()))
        cases: list[tuple] = []
        first: dict[int, int] = {}
        for (_, _, key, status, is_open, seen, _), of in held:
            if key is None:
                continue
            if is_open:
                for way in starts:
                    if of & way:
                        first.setdefault(way, len(cases))
            cases.append((key, status, is_open, seen, of))
        opened, past = 0, text.last_end + len(END) if text.last_end >= 0 else 0
        for way in first:
            waits = next((case[6] for case in ways[way] if case[6] >= 0 and case[0] >= past), None)
            opened |= flags(log, waits) << OPEN[way] if waits is not None else 0
        return cases, (first.get(OUT), first.get(TAG), first.get(WAIT)), opened


_FOUND = pa.list_(pa.struct([("part", pa.int64()), ("seq", pa.int64()), ("test_id", pa.string()), ("status", pa.string())]))
_ALONG = pa.schema([("run_id", pa.string()), ("part", pa.int64()), ("way", pa.int32()), ("open_way", pa.int32()), ("from_first", pa.bool_()), *[(f"next_{i}", pa.int64()) for i in range(len(CHILDREN))], ("found", _FOUND)])
ALONG = "run_id string, part long, way int, open_way int, from_first boolean, next_0 long, next_1 long, next_2 long, found array<struct<part: long, seq: long, test_id: string, status: string>>"


def beyond(found: int, is_open: bool, seen: int, after: list[int | None]) -> str:
    """Status of a case that no end follows: own children decide in their order; those of later parts count if they lie wholly within the window."""
    for at, (child, status) in enumerate(CHILDREN):
        if found >> at & 1 or is_open and after[at] is not None and seen + after[at] - 1 + len(child) <= UNCLOSED_WINDOW:
            return status
    return PASSED


class _Along:
    """Walks the parts of a run in order.

    state: None outside of cases, ("tag", part, name, owner) inside a tag, or
    ("case", part, key, flags) inside a case that waits for its end. Parts since that
    case began wait for the answer to whether an end comes: if none does, their tags stand
    for themselves, and so do tags that are cut between them (cut: name, owner).
    """

    def __init__(self, run_id: str | None):
        self.run_id, self.state, self.cut, self.waiting = run_id, None, None, []

    def end(self, unclosed: bool) -> list[tuple]:
        """Rows of the parts that wait. A part that begins outside of cases, and nothing else, needs none."""
        waiting, self.waiting, self.cut = self.waiting, [], None
        if not unclosed:
            return [row for part, way, spans, *_ in waiting for row in self.row(part, way, spans)]
        rows: list[tuple] = []
        after: list[int | None] = [None] * len(CHILDREN)
        for part, way, spans, open_way, loose, size, here in reversed(waiting):
            if loose and loose[0] is not None and self.run_id is not None and part is not None:
                key, found, seen = loose
                spans = [*spans, (part, 1, key, beyond(found, seen is not None, seen or 0, after))]
            from_first = open_way is None
            rows.append((self.run_id, part, way, way if from_first else open_way, from_first, *after, spans))
            after = [at if at is not None else None if far is None else size + far for at, far in zip(here, after)]
        return rows[::-1]

    def row(self, part: int | None, way: int, spans: list[tuple]) -> list[tuple]:
        return [(self.run_id, part, way, None, False, None, None, None, spans)] if way != OUT or spans else []

    def leave(self, part: int | None, facts: int, key: str | None, way: int, tail: tuple) -> None:
        """The state behind text that begins outside of cases."""
        self.cut = None
        if key:
            self.state = ("case", part, key, facts >> OPEN[way] & 7)
            self.cut = tail if facts & IN_TAG else None
        elif facts & IN_TAG:
            self.state = ("tag", part, *tail)
        else:
            self.state = None

    def step(self, part, facts, seen, head_name, head_owner, tail_name, tail_owner, key_out, key_tag, key_wait, size, *here) -> list[tuple]:
        out, spans, loose, tail = [], [], None, (tail_name, tail_owner)
        # open_way: how the part is read if no end comes; None: as it holds, from the first open case on.
        state, way, open_way = self.state, OUT, None
        if state is None:
            self.leave(part, facts, key_out, OUT, tail)
        elif state[0] == "tag":
            name, owner = head_name or state[2], head_owner or state[3]
            if not facts & HAS_CLOSE:
                way, open_way, self.state = NONE, NONE, ("tag", state[1], name, owner)
            elif facts & HEAD_CLOSES or not name:
                way = TAG
                spans = [(state[1], 1, case_key(name, owner), PASSED)] if name else []
                out += self.end(False)
                self.leave(part, facts, key_tag, TAG, tail)
            elif facts & HAS_END:
                way, spans = WAIT, [(state[1], 1, case_key(name, owner), STATUS[facts >> BEHIND_TAG & 7])]
                out += self.end(False)
                self.leave(part, facts, key_wait, WAIT, tail)
            else:
                key = case_key(name, owner)
                way, open_way, loose = NONE, TAG, (key, facts >> IN_WINDOW & 7, seen)
                self.state = ("case", state[1], key, facts >> BEHIND_TAG & 7)
                self.cut = tail if facts & IN_TAG else None
        elif facts & HAS_END:
            way, spans = WAIT, [(state[1], 1, state[2], STATUS[state[3] | facts >> TO_END & 7])]
            out += self.end(False)
            self.leave(part, facts, key_wait, WAIT, tail)
        else:
            way, open_way = NONE, OUT
            self.state = ("case", state[1], state[2], state[3] | facts >> IN_ALL & 7)
            if self.cut:
                name, owner = head_name or self.cut[0], head_owner or self.cut[1]
                if not facts & HAS_CLOSE:
                    open_way, self.cut = NONE, (name, owner)
                else:
                    open_way = TAG
                    if name:
                        key = case_key(name, owner)
                        loose = (key, 0, None) if facts & HEAD_CLOSES else (key, facts >> IN_WINDOW & 7, seen)
            if open_way != NONE:
                self.cut = tail if facts & IN_TAG else None
        if self.state is None:
            return out + self.end(False) + self.row(part, way, spans)
        self.waiting.append((part, way, spans, open_way, loose, size, here))
        return out


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of parts, in order -> the way in which each begins if not outside of cases, the cases that end in it after beginning earlier, and how it is read if its run's last case has no end."""
    walk = _Along(None)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        found = [[dict(zip(("part", "seq", "test_id", "status"), span)) for span in spans] for spans in columns[-1]]
        return pa.record_batch([pa.array(c, t) for c, t in zip([*columns[:-1], found], _ALONG.types)], schema=_ALONG)

    for batch in batches:
        starts = batch.column("starts")
        if walk.state is None and not pc.any(starts).as_py():
            continue  # no case reaches over the parts of this batch
        done: list[tuple] = []
        for run_id, start, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if run_id != walk.run_id:
                done += walk.end(True)
                walk = _Along(run_id)
            if start or walk.state is not None:
                done += walk.step(*row)
        if done:
            yield batch_of(done)
    if rows := walk.end(True):
        yield batch_of(rows)


def read_junit_text(runs: DataFrame) -> DataFrame:
    """`<testcase>` elements wherever they stand; a part's own cases, and those that reach over parts."""
    return case_events(read_parts(runs.where((F.col("part") > 0) | F.col("log").contains(BEGIN)), CaseReader))


def case_events(parts: DataFrame) -> DataFrame:
    """Rows of parts (`CaseReader`) -> events."""
    key_of = lambda first: F.get("cases", F.col(first))["key"]
    told = parts.select(
        "run_id", "part", "facts", "seen", "head_name", "head_owner", "tail_name", "tail_owner",
        key_of("first_out").alias("key_out"), key_of("first_tag").alias("key_tag"), key_of("first_wait").alias("key_wait"),
        "size", "next_0", "next_1", "next_2",
    )
    starts = F.col("key_out").isNotNull() | (F.col("facts").bitwiseAND(IN_TAG) != 0)
    told = told.select("run_id", starts.alias("starts"), *told.columns[1:])
    along = share(told.repartition("run_id").sortWithinPartitions("run_id", "part").mapInArrow(_along, ALONG))

    rows = parts.where("size(cases) > 0").select("run_id", "part", "first_out", "first_tag", "first_wait", "cases")
    # Compared null-safe, so that the two sides ask for the same exchanges as all others do: Spark would else keep null keys out of this one.
    ways = along.drop("found").withColumnsRenamed({"run_id": "of_run", "part": "of_part"})
    rows = rows.join(ways, F.col("run_id").eqNullSafe(F.col("of_run")) & F.col("part").eqNullSafe(F.col("of_part")), "left").drop("of_run", "of_part")
    # A part without a row in `along` begins outside of cases; where run or part are unknown, none but the first part can be told.
    known = F.col("run_id").isNotNull() & F.col("part").isNotNull()
    rows = rows.withColumn("holds", F.when(F.col("part") == 0, OUT).when(known, F.coalesce("way", F.lit(OUT))).otherwise(NONE))
    rows = rows.withColumn("open_way", F.when(known, F.col("open_way")))

    def first_of(way: Column) -> Column:
        return F.when(way == OUT, F.col("first_out")).when(way == TAG, F.col("first_tag")).when(way == WAIT, F.col("first_wait"))

    rows = rows.select(
        "run_id", "part", "holds", first_of(F.col("holds")).alias("until"), "open_way", F.when(F.col("from_first"), first_of(F.col("open_way"))).otherwise(0).alias("since"),
        "next_0", "next_1", "next_2", F.posexplode("cases").alias("place", "c"),
    )
    held = lambda way: F.col("c.ways").bitwiseAND(F.col(way)) != 0
    here = held("holds") & (F.col("until").isNull() | (F.col("place") < F.col("until")))
    # Cases behind which no end comes in the whole run: each tag stands for itself and sees a window of text behind it.
    unclosed = held("open_way") & (F.col("place") >= F.col("since"))
    status = F
    for at, (child, word) in enumerate(CHILDREN):
        reaches = F.col("c.open") & (F.col("c.seen") + F.col(f"next_{at}") - 1 + len(child) <= UNCLOSED_WINDOW)
        status = status.when((F.col("c.status") == word) | F.coalesce(reaches, F.lit(False)), word)
    status = F.when(F.col("here"), F.col("c.status")).otherwise(status.otherwise(PASSED))
    rows = rows.withColumn("here", F.coalesce(here, F.lit(False))).where(F.col("here") | unclosed)
    seq, sub = F.when(F.col("here"), 0).otherwise(F.col("place") + 2), F.when(F.col("here"), F.col("place")).otherwise(0)
    own = rows.select("run_id", "part", seq.cast("bigint").alias("seq"), sub.alias("sub"), event(F.col("c.key"), status).alias("e"))

    # A case stands at the end of the part in which it begins.
    spans = along.select("run_id", F.inline("found")).where("test_id is not null")
    spans = spans.select("run_id", "part", "seq", F.lit(0).alias("sub"), event(F.col("test_id"), F.col("status")).alias("e"))
    return event_columns(own.unionByName(spans).select("run_id", "part", "seq", "sub", "e.*"))
