"""From raw logs to per-test statuses."""

from collections.abc import Callable, Iterable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType

from runsift.operators.conflicts import settle
from runsift.operators.dialects import base, line_rules, nested, python_tests, suites, tables, xml_reports

REGISTRY = base.Registry()
for _family in (line_rules, python_tests, suites, tables, xml_reports, nested):
    REGISTRY.add(*_family.DIALECTS)

# Other names under which logs ask for a dialect.
ALIASES = {
    "astroid": "pytest", "flask": "pytest", "marshmallow": "pytest", "pvlib": "pytest", "pyvista": "pytest",
    "sqlfluff": "pytest", "xarray": "pytest", "pydantic": "pytest", "dvc": "pytest",
    "pydicom": "pytest_options", "requests": "pytest_options", "pylint": "pytest_options",
    "astropy": "pytest_v2", "scikit": "pytest_v2", "sphinx": "pytest_v2",
    "sbt": "junit", "ocaml_v5": "ocaml_v4",
}
# Names that do not follow the pattern parse_log_<dialect>.
SPECIAL_NAMES = {
    "parse_combined_test_reports": "combined_test_reports",
    "parse_lue_nvim": "lua_nvim",
    "parse_lua_nvim": "lua_nvim",
    "parse_java_mvn": "java_mvn",
    "parse_java_mvn_v2": "java_mvn_v2",
    "parse_logs_r_junit": "r_junit",
    "parse_logs_kotlin_junit": "kotlin_junit",
}
# Dialect of repositories that do not name one.
REPOSITORY_DIALECT = {
    "astropy/astropy": "pytest_v2", "django/django": "django", "marshmallow-code/marshmallow": "pytest",
    "matplotlib/matplotlib": "matplotlib", "mwaskom/seaborn": "seaborn", "pallets/flask": "pytest",
    "psf/requests": "pytest_options", "pvlib/pvlib-python": "pytest", "pydata/xarray": "pytest",
    "pydicom/pydicom": "pytest_options", "pylint-dev/astroid": "pytest", "pylint-dev/pylint": "pytest_options",
    "pytest-dev/pytest": "pytest", "pyvista/pyvista": "pytest", "scikit-learn/scikit-learn": "pytest_v2",
    "sqlfluff/sqlfluff": "pytest", "sphinx-doc/sphinx": "pytest_v2", "sympy/sympy": "sympy",
    "pydantic/pydantic": "pydantic", "iterative/dvc": "dvc",
}


def _regular_name(name: str) -> str:
    return f"parse_log_{name}"


def parser_names() -> dict[str, str]:
    """Every accepted parser name and the dialect it stands for."""
    irregular = {"combined_test_reports"}
    names = {_regular_name(d): d for d in REGISTRY.entries if d not in irregular}
    names |= {_regular_name(alias): ALIASES.get(d, d) for alias, d in ALIASES.items()}
    return names | SPECIAL_NAMES


def dialect_of(parser: Column) -> Column:
    """Dialect of a parser name; null for names nobody knows.

    The table of names is small and fixed, so it is part of the expression and
    needs no join.
    """
    by_dialect: dict[str, list[str]] = {}
    for name, dialect in parser_names().items():
        by_dialect.setdefault(dialect, []).append(name)
    chosen = None
    for dialect, names in by_dialect.items():
        known = names + [dialect] if dialect not in names else names
        chosen = (F if chosen is None else chosen).when(parser.isin(known), dialect)
    return chosen


def resolve_parser(parser: Column, repo: Column) -> Column:
    """Dialect by parser name, else by repository, else the pytest dialect."""
    by_repo = None
    for name, dialect in REPOSITORY_DIALECT.items():
        by_repo = (F if by_repo is None else by_repo).when(repo == name, ALIASES.get(dialect, dialect))
    return F.coalesce(dialect_of(parser), by_repo.otherwise("pytest"))


def register_extractor(name: str, find: Callable[[str], Iterable[tuple[str, str]]]) -> None:
    """Add a dialect that the building blocks cannot express.

    `find` gets one log text and yields (test name, status) in order; a later
    sighting replaces an earlier one. It runs in Arrow batches on the log
    column; an exception makes the run unreadable.
    """
    unreadable = base.UNREADABLE

    def run(logs: pa.Array) -> pa.Array:
        found = []
        for log in logs.to_pylist():
            try:
                found.append([{"test_id": k, "status": s} for k, s in find(log or "")])
            except Exception:
                found.append([{"test_id": unreadable, "status": "ERROR"}])
        kind = pa.list_(pa.struct([("test_id", pa.string()), ("status", pa.string())]))
        return pa.array(found, type=kind)

    def read(runs: DataFrame) -> DataFrame:
        found = F.arrow_udf(run, "array<struct<test_id: string, status: string>>")("log")
        events = F.transform(found, lambda e: base.strong(e["test_id"], e["status"]))
        return base.emit_log(runs, events)

    REGISTRY.add(base.Dialect(name, read, whole=True))


def dialects_in(runs: DataFrame) -> list[str]:
    """Dialects that occur in the runs: one pass over one narrow column.

    At most as many rows as there are dialects reach the driver.
    """
    found = runs.select(dialect_of(F.col("parser")).alias("d")).where("d is not null").distinct().collect()
    return sorted(row["d"] for row in found)


def extract_events(runs: DataFrame, dialects: Iterable[str] | None = None) -> DataFrame:
    """Events of all runs, before repeated sightings are settled.

    Dialects whose lines stand for themselves read their runs in one pass, each
    other dialect its own share; with the runs stored by parser
    (`plans.storage.write_runs`) a share is a set of directories, and otherwise a
    filter that the scan gets pushed down.
    """
    names = list(dialects) if dialects is not None else dialects_in(runs)
    unknown = [n for n in names if n not in REGISTRY.entries]
    if unknown:
        raise ValueError(f"unknown dialects: {unknown}")
    accepted = parser_names()
    shares = []
    # Not cast where it is one already: an alias would make branches of a union differ that are the same.
    part = F.col("part") if runs.schema["part"].dataType == LongType() else F.col("part").cast("bigint").alias("part")
    if dialects is None:
        # Runs whose parser nobody knows cannot be read; the log is not touched.
        lost = runs.where(dialect_of(F.col("parser")).isNull())
        lost = lost.select("run_id", F.col("part").cast("bigint").alias("part"), F.lit(0).alias("seq"))
        shares.append(base.emit(lost, base.unreadable(), certain=True))

    def share(*of: str) -> DataFrame:
        """Runs of some dialects, with the dialect's name."""
        known = {d: [n for n, given in accepted.items() if given == d] + [d] for d in of}
        mine = runs.where(F.col("parser").isin([n for each in known.values() for n in each]))
        dialect = None
        for d, each in known.items():
            dialect = (F if dialect is None else dialect).when(F.col("parser").isin(each), d)
        return mine.select("run_id", part, "log", dialect.alias("dialect"))

    by_line = {name: REGISTRY.entries[name].lines for name in names if REGISTRY.entries[name].lines}
    if by_line:
        shares.append(base.read_lines(share(*by_line), by_line))
    for name in names:
        dialect = REGISTRY.entries[name]
        if not dialect.lines:
            mine = share(name).drop("dialect")
            shares.append(dialect.read(base.whole_logs(mine) if dialect.whole else mine))
    if not shares:
        raise ValueError("no dialects to read")
    return reduce(DataFrame.unionByName, shares).select(*base.EVENT_COLUMNS)


def extract_test_results(runs: DataFrame, dialects: Iterable[str] | None = None) -> DataFrame:
    """runs(run_id, parser, part, log) -> (run_id, test_id, status, first_pos).

    `dialects` names the dialects to read; left out, the runs are asked which
    ones occur, and runs whose parser is unknown yield the row UNREADABLE, as
    does every log that breaks its dialect.
    """
    return settle(extract_events(runs, dialects))
