"""Round-trip queries: orders become logs, logs become statuses again."""

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from runsift.operators.extract import REGISTRY, extract_test_results, register_extractor
from runsift.workload.cases import CASES, FAMILIES, Case
from runsift.workload.registry import entry, table
from runsift.workload.rendering import assemble, fill, part_of

# A customer is a run and an order a sighting: the order key gives the test,
# the suite and the status, and is the position in the log.
TESTS, SUITES = 6, 3


def sighting_values() -> dict[str, Column]:
    key = F.col("o_orderkey")
    return {
        "n": F.concat(F.lit("case_"), (key % TESTS).cast("string")),
        "s": F.floor(key / TESTS) % SUITES,
        "i": key,
    }


def pick(case: Case) -> Column:
    return F.floor(F.col("o_orderkey") / (TESTS * SUITES)) % len(case.lines)


def rendered(orders: DataFrame, name: str) -> DataFrame:
    """Orders -> runs(run_id, parser, part, log) in one dialect."""
    case, values = CASES[name], sighting_values()
    text = None
    for number, (_, template) in enumerate(case.lines):
        line = fill(template, values)
        text = line if text is None else F.when(pick(case) == number, line).otherwise(text)
    lines = orders.select(
        F.concat(F.lit(f"{name}-"), F.col("o_custkey").cast("string")).alias("run_id"),
        part_of(F.col("o_orderkey")).alias("part"),
        F.col("o_orderkey").alias("seq"),
        text.alias("text"),
    )
    return assemble(lines, ("run_id",), case.head, case.tail).withColumn("parser", F.lit(name))


def sql_text(template: str) -> str:
    filled = (
        template.replace("'", "''")
        .replace("{n}", f"' || 'case_' || (o_orderkey % {TESTS}) || '")
        .replace("{s}", f"' || ((o_orderkey // {TESTS}) % {SUITES}) || '")
    )
    return f"'{filled}'"


SQL_POLICY = {
    "last": "arg_max(status, seq)",
    "first": "arg_min(status, seq)",
    "override": "coalesce(arg_max(status, seq) filter (where status <> 'PASSED'), 'PASSED')",
    "severity": (
        "arg_max(status, case status when 'ERROR' then 2 when 'FAILED' then 1 else 0 end * 1000000000000 - seq)"
    ),
    "precedence": (
        "arg_max(status, case status when 'ERROR' then 3 when 'FAILED' then 2 when 'SKIPPED' then 1 else 0 end"
        " * 1000000000000 + seq)"
    ),
    "twice": "case when count(*) >= 2 then 'PASSED' else 'ERROR' end",
}


def case_sql(name: str, where: str = "true") -> str:
    case = CASES[name]
    words = " ".join(f"when {i} then '{status}'" for i, (status, _) in enumerate(case.lines))
    chosen = f"case (o_orderkey // {TESTS * SUITES}) % {len(case.lines)} {words} end"

    def block(key: str, status: str, policy: str) -> str:
        return (
            f"select run_id, test_id, {SQL_POLICY[policy]} as status from (select '{name}-' || o_custkey as run_id, "
            f"{sql_text(key)} as test_id, {status} as status, o_orderkey as seq from orders where {where}) group by run_id, test_id"
        )

    blocks = [block(case.key, chosen, case.policy)]
    blocks += [block(key, f"'{status}'", policy) for key, status, policy in case.also]
    return " union all ".join(blocks)


def _dialect_query(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        runs = rendered(table(spark, sf_dir, "orders"), name)
        return extract_test_results(runs, [name]).select("run_id", "test_id", "status")

    return query


def _family_query(members: tuple[str, ...]):
    """Every customer writes in one of the family's dialects."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders = table(spark, sf_dir, "orders")
        runs = None
        for number, name in enumerate(members):
            share = rendered(orders.where(F.col("o_custkey") % len(members) == number), name)
            runs = share if runs is None else runs.unionByName(share)
        return extract_test_results(runs, members).select("run_id", "test_id", "status")

    return query


# --- a dialect of the user's own ----------------------------------------------------

OWN = "custom_marks"


def marked_tests(log: str) -> Iterator[tuple[str, str]]:
    """`+ name` passed, `- name` failed."""
    for line in log.split("\n"):
        mark, _, name = line.partition(" ")
        if mark in ("+", "-"):
            yield name, "PASSED" if mark == "+" else "FAILED"


if OWN not in REGISTRY.entries:
    register_extractor(OWN, marked_tests)


@entry(
    "extract_custom",
    f"""select 'own-' || o_custkey as run_id, 'case_' || (o_orderkey % {TESTS}) as test_id,
      arg_max(case when o_orderstatus = 'F' then 'FAILED' else 'PASSED' end, o_orderkey) as status from orders group by 1, 2""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.when(F.col("o_orderstatus") == "F", "- ").otherwise("+ ")
    lines = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("own-"), F.col("o_custkey").cast("string")).alias("run_id"),
        part_of(F.col("o_orderkey")).alias("part"),
        F.col("o_orderkey").alias("seq"),
        F.concat(mark, sighting_values()["n"]).alias("text"),
    )
    runs = assemble(lines, ("run_id",), "started\n").withColumn("parser", F.lit(OWN))
    return extract_test_results(runs, [OWN]).select("run_id", "test_id", "status")


for _name in CASES:
    entry(f"dialect_{_name}", case_sql(_name))(_dialect_query(_name))
for _family, _members in FAMILIES.items():
    _sql = " union all ".join(case_sql(m, f"o_custkey % {len(_members)} = {i}") for i, m in enumerate(_members))
    entry(_family, _sql)(_family_query(_members))
