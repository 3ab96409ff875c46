"""Catalogue, selection and validation queries over tasks made from orders.

An order is a task. Its customer number decides how the config is written
(string, list, blank, empty list, none), so usable and unusable rows mix.
"""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from runsift.functions.binding import bind
from runsift.functions.commands import coerce_test_cmd, command_stages
from runsift.functions.tasks import image_cache_key, image_reference, render_prompt
from runsift.functions.text import bound_text, normalize_test_name, strip_ansi
from runsift.operators.extract import resolve_parser
from runsift.operators.select import cached_only, in_ranges, modulo_shard, out_of_range, stratified_sample
from runsift.operators.validate import group_overlap, validate_metadata
from runsift.sources.catalogue import (
    config_columns,
    index_totals,
    load_index,
    normalize_tasks,
    read_tasks,
    selected_tasks,
    shard_layout,
    task_at,
    task_index,
    valid_tasks,
    with_public_index,
    with_raw_index,
    write_index,
)
from runsift.session import shared_folder
from runsift.sources.results import latest_results, parse_results, pending, read_results, run_summary, write_results
from runsift.workload.registry import entry, table

TABLES = (
    "benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels",
    "lineitem", "nation", "orders", "pages", "part", "region", "supplier",
)
HOSTED, PUBLIC = "hosted/team/", "registry.example/public/"


def config_text() -> Column:
    """install_config of an order, as JSON text."""
    kind = F.col("o_custkey") % 5
    parser = F.when(F.col("o_orderkey") % 9 == 0, "no_such_parser").otherwise("parse_log_gotest")
    command = (
        F.when(kind == 0, '"make test && cat \'a && b\' && (x && y)"')
        .when(kind == 1, '["pytest -q", "  ", "go test ./... && cat r.xml"]')
        .when(kind == 2, '"   "')
        .when(kind == 3, "[]")
    )
    return F.when(
        kind < 4, F.concat(F.lit('{"test_cmd": '), command, F.lit(', "log_parser": "'), parser, F.lit('"}'))
    )


def language() -> Column:
    key = F.col("o_orderkey")
    return F.when(key % 11 == 0, "").when(key % 13 != 0, F.col("o_orderpriority"))


SQL_LANGUAGE = "case when o_orderkey % 11 = 0 then '' when o_orderkey % 13 <> 0 then o_orderpriority end"
SQL_STRATUM = f"coalesce(nullif({SQL_LANGUAGE}, ''), 'unknown')"


def image() -> Column:
    return F.concat(
        F.when(F.col("o_orderstatus") == "O", HOSTED).otherwise("other.example/"),
        F.lit("img-"), (F.col("o_orderkey") % 100).cast("string"),
    )


SQL_REFERENCE = (
    f"case when o_orderstatus = 'O' then '{PUBLIC}' else 'other.example/' end || 'img-' || (o_orderkey % 100)"
)


def with_config(orders: DataFrame) -> DataFrame:
    """Orders as tasks; file metadata stays reachable for row numbers."""
    return orders.withColumn("install_config", config_text())


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_config((table(spark, sf_dir, "orders"))).select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        F.concat(F.lit("task-"), F.col("o_orderkey").cast("string")).alias("instance_id"),
        F.col("o_orderkey").alias("public_index"),
        "install_config",
        language().alias("language"),
        image().alias("image_name"),
    )


SQL_USABLE = "o_custkey % 5 in (0, 1)"


@entry(
    "shard_layout",
    "select name, num_rows, coalesce(sum(num_rows) over (order by name rows between unbounded preceding and 1 preceding), 0)::bigint"
    ' as "offset" from ('
    + " union all ".join(f"select '{t}.parquet' as name, count(*) as num_rows from {t}" for t in TABLES)
    + ")",
)
def _(spark, sf_dir):
    everything = spark.read.schema("none INT").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(sf_dir)
    return shard_layout(everything).select(F.substring_index("path", "/", -1).alias("name"), "num_rows", "offset")


@entry("raw_index", "select o_orderkey, o_orderkey as raw_index from orders")
def _(spark, sf_dir):
    return with_raw_index(table(spark, sf_dir, "orders")).select("o_orderkey", "raw_index")


@entry(
    "public_index",
    f"select o_orderkey as raw_index, row_number() over (order by o_orderkey) - 1 as public_index from orders where {SQL_USABLE}",
)
def _(spark, sf_dir):
    return task_index(with_config(table(spark, sf_dir, "orders"))).select("raw_index", "public_index")


@entry(
    "index_map",
    f"""select 'task-' || o_orderkey as instance_id, o_orderkey as raw_index, row_number() over (order by o_orderkey) - 1 as public_index
    from orders where {SQL_USABLE}""",
)
def _(spark, sf_dir):
    orders = with_config(table(spark, sf_dir, "orders"))
    numbered = with_raw_index(orders)
    named = numbered.select("raw_index", F.concat(F.lit("task-"), F.col("o_orderkey").cast("string")).alias("instance_id"))
    return with_public_index(named, task_index(orders)).select("instance_id", "raw_index", "public_index")


@entry("task_source", "select o_orderkey, count(*) as times from orders group by o_orderkey")
def _(spark, sf_dir):
    # A folder of shards, then the same folder with one data.parquet, which alone counts.
    folder = f"{shared_folder(spark)}/tasks-{uuid.uuid4().hex}"
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    orders.where("o_orderkey % 2 = 0").write.parquet(f"{folder}/shards/even.parquet")
    orders.where("o_orderkey % 2 = 1").write.parquet(f"{folder}/shards/odd.parquet")
    whole = f"{folder}/whole"
    orders.where("o_orderkey < 0").write.parquet(f"{whole}/other.parquet")
    orders.write.parquet(f"{whole}/data.parquet")
    sharded = read_tasks(spark, f"{folder}/shards")
    return sharded.intersectAll(read_tasks(spark, whole)).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("times"))


@entry(
    "index_roundtrip",
    f"select o_orderkey as raw_index, row_number() over (order by o_orderkey) - 1 as public_index from orders where {SQL_USABLE}",
)
def _(spark, sf_dir):
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    orders = table(spark, sf_dir, "orders")
    write_index(task_index(with_config(orders)), path)
    return load_index(spark, path, orders.count()).select("raw_index", "public_index")


@entry("index_totals", f"select count(*) as total_rows, count(*) filter (where {SQL_USABLE}) as num_valid from orders")
def _(spark, sf_dir):
    return index_totals(with_config(table(spark, sf_dir, "orders")))


@entry(
    "valid_tasks",
    f"select 'task-' || o_orderkey as instance_id, case o_custkey % 5 when 0 then 1 else 2 end::bigint as commands from orders where {SQL_USABLE}",
)
def _(spark, sf_dir):
    return valid_tasks(tasks(spark, sf_dir)).select("instance_id", F.size("commands").cast("bigint").alias("commands"))


@entry("task_point_lookup", f"select 'task-' || o_orderkey as instance_id, {SQL_LANGUAGE} as language from orders where o_orderkey = 77")
def _(spark, sf_dir):
    return task_at(tasks(spark, sf_dir), 77, ["instance_id", "language"])


@entry(
    "selected_rows_semi",
    "select o_orderkey, o_totalprice from orders where o_orderkey in (select user_id * 3 from events where event_type = 'signup')",
)
def _(spark, sf_dir):
    wanted = table(spark, sf_dir, "events").where("event_type = 'signup'").select((F.col("user_id") * 3).alias("raw_index"))
    return selected_tasks(with_raw_index(table(spark, sf_dir, "orders")), wanted).select("o_orderkey", "o_totalprice")


@entry(
    "normalize_lists",
    """select o_orderkey, case when o_custkey % 4 in (0, 1) then 0 when o_custkey % 4 = 2 then 2 else 1 end::bigint as n,
    case when o_custkey % 4 >= 2 then 'a' || o_orderkey end as first, o_custkey % 7 = 0 as broken from orders""",
)
def _(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    text = (
        F.when(F.col("o_custkey") % 4 == 1, "[]")
        .when(F.col("o_custkey") % 4 == 2, F.concat(F.lit('["a'), key, F.lit('", "b"]')))
        .when(F.col("o_custkey") % 4 == 3, F.concat(F.lit('["a'), key, F.lit('"]')))
    )
    broken = F.when(F.col("o_custkey") % 7 == 0, '["open').otherwise("null")
    raw = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("FAIL_TO_PASS"), broken.alias("PASS_TO_PASS"))
    rows = normalize_tasks(raw, quarantine=True)
    return rows.select(
        "o_orderkey",
        F.size("FAIL_TO_PASS").cast("bigint").alias("n"),
        F.try_element_at("FAIL_TO_PASS", F.lit(1)).alias("first"),
        F.col("broken_lists").alias("broken"),
    )


@entry(
    "coerce_commands",
    """select o_orderkey, case o_custkey % 6 when 0 then 'run ' || o_orderkey when 1 then 'a|  b ' end as commands from orders""",
)
def _(spark, sf_dir):
    raw = (
        F.when(F.col("o_custkey") % 6 == 0, F.concat(F.lit('"run '), F.col("o_orderkey").cast("string"), F.lit('"')))
        .when(F.col("o_custkey") % 6 == 1, '["a", " ", 3, null, "  b "]')
        .when(F.col("o_custkey") % 6 == 2, '{"a": "b"}')
        .when(F.col("o_custkey") % 6 == 3, "17")
        .when(F.col("o_custkey") % 6 == 4, '["\\t"]')
    )
    rows = (table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw")))
    return coerce_test_cmd(rows, "raw").select("o_orderkey", F.array_join("commands", "|").alias("commands"))


@entry(
    "command_stages",
    """select 'task-' || o_orderkey as instance_id, c as command_index, s as stage_index, t as stage from orders, (values
      (0, 0, 0, 'make test'), (0, 0, 1, 'cat ''a && b'''), (0, 0, 2, '(x && y)'),
      (1, 0, 0, 'pytest -q'), (1, 1, 0, 'go test ./...'), (1, 1, 1, 'cat r.xml')) v(k, c, s, t) where k = o_custkey % 5""",
)
def _(spark, sf_dir):
    return command_stages(config_columns(tasks(spark, sf_dir)))


@entry(
    "image_ref",
    f"select o_orderkey, {SQL_REFERENCE} as reference from orders",
)
def _(spark, sf_dir):
    return tasks(spark, sf_dir).select("o_orderkey", image_reference(F.col("image_name"), HOSTED, PUBLIC).alias("reference"))


@entry("image_key", f"select o_orderkey, sha256({SQL_REFERENCE}) as cache_key from orders")
def _(spark, sf_dir):
    reference = image_reference(F.col("image_name"), HOSTED, PUBLIC)
    return tasks(spark, sf_dir).select("o_orderkey", image_cache_key(reference).alias("cache_key"))


@entry(
    "cached_semi",
    f"""select o_orderkey from orders where {SQL_REFERENCE} in (
      select 'other.example/img-' || (s_suppkey % 100) from supplier where s_acctbal > 0
      union all select '{PUBLIC}img-' || (s_suppkey % 50) from supplier where s_acctbal > 0)""",
)
def _(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier")
    names = F.explode(
        F.array(
            F.concat(F.lit("other.example/img-"), (F.col("s_suppkey") % 100).cast("string")),
            F.concat(F.lit(f"{PUBLIC}img-"), (F.col("s_suppkey") % 50).cast("string")),
        )
    )
    listing = suppliers.select(names.alias("name"), "s_acctbal")
    listing = listing.select(F.sha2("name", 256).alias("file_key"), F.greatest(F.floor("s_acctbal"), F.lit(0)).alias("size"))
    listing = listing.withColumn("size", F.when(F.col("size") == 0, (F.col("size") > 0).cast("int")).otherwise(1))
    return cached_only(tasks(spark, sf_dir), listing, image_reference(F.col("image_name"), HOSTED, PUBLIC)).select("o_orderkey")


@entry(
    "render_prompt",
    """select doc_id, md5('You are a software engineer working on the repository **' || source || '** (language: ' || lang
      || ').' || chr(10) || chr(10) || '## Problem Statement' || chr(10) || chr(10) || text || chr(10) || chr(10)
      || '## Instructions' || chr(10) || chr(10) || 'The repository is cloned at `/work/' || doc_id
      || '` and checked out to the commit before the fix. Your task is to modify the code so that the failing tests pass.'
      || chr(10) || chr(10) || 'Use the available tools to explore the codebase, understand the problem, make edits, and then call `submit_answer` when you are done.'
      || chr(10) || chr(10) || 'Do NOT modify or create tests — only fix the source code.') as prompt_md5 from documents""",
)
def _(spark, sf_dir):
    workdir = F.concat(F.lit("/work/"), F.col("doc_id").cast("string"))
    prompt = render_prompt(F.col("source"), F.col("lang"), F.col("text"), workdir)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(prompt.cast("binary")).alias("prompt_md5"))


@entry(
    "bound_text",
    """select doc_id, case when length(text) <= 301 then text else substring(text, 1, 150) || chr(10) || chr(10) || '... [text cut: '
      || (length(text) - 301) || ' characters omitted] ...' || chr(10) || chr(10) || right(text, 151) end as bounded from documents""",
)
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", bound_text(F.col("text"), 301, "text cut").alias("bounded"))


@entry("strip_ansi", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag || ' ' || l_partkey as text from lineitem")
def _(spark, sf_dir):
    lines = (table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))
    painted = F.concat(
        F.lit("\x1b[1;31m"), "l_returnflag", F.lit("\x1b[0m \x1b[K"), F.col("l_partkey").cast("string"), F.lit("\x1bM"),
    )
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", strip_ansi(painted).alias("text"))


@entry(
    "normalize_names",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, 'p' || l_partkey || ' case' as once_or_twice,
      'p' || l_partkey || ' case' || case when l_linenumber % 5 = 4 then ' [2 ms]' else '' end as once from lineitem""",
)
def _(spark, sf_dir):
    lines = (table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    noise = (
        F.when(F.col("l_linenumber") % 5 == 0, F.concat(F.lit(" ["), F.col("l_suppkey").cast("string"), F.lit(".5 ms] ")))
        .when(F.col("l_linenumber") % 5 == 1, " (1.2S)")
        .when(F.col("l_linenumber") % 5 == 2, " in 3.25 msec")
        .when(F.col("l_linenumber") % 5 == 3, "\x1b[0m")
        .otherwise(" [2 ms] (1s)")
    )
    name = F.concat(F.lit(" p"), F.col("l_partkey").cast("string"), F.lit(" case"), noise)
    return bind(lines, name=name).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        normalize_test_name(F.col("name"), 2).alias("once_or_twice"), normalize_test_name(F.col("name"), 1).alias("once"),
    )


@entry(
    "resolve_parser",
    """select o_orderkey, case o_orderkey % 6 when 0 then 'gotest' when 1 then 'ocaml_v4' when 2 then 'lua_nvim'
      when 3 then 'sympy' when 4 then 'pytest_v2' else 'pytest' end as dialect from orders""",
)
def _(spark, sf_dir):
    kind = F.col("o_orderkey") % 6
    parser = F.when(kind == 0, "parse_log_gotest").when(kind == 1, "parse_log_ocaml_v5").when(kind == 2, "parse_lue_nvim").when(kind == 3, "what")
    repo = F.when(kind == 3, "sympy/sympy").when(kind == 4, "sphinx-doc/sphinx").otherwise("some/repo")
    return table(spark, sf_dir, "orders").select("o_orderkey", resolve_parser(parser, repo).alias("dialect"))


# --- selection -------------------------------------------------------------------


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One range of task numbers per nation, overlapping in places."""
    lo = F.col("n_nationkey") * 131
    return table(spark, sf_dir, "nation").select(lo.alias("lo"), (lo + F.col("n_regionkey") * 60 + 5).alias("hi"))


def wide_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, and one from the middle of the catalogue to far beyond its end."""
    beyond = table(spark, sf_dir, "region").where("r_regionkey = 1").select(F.lit(7001).cast("bigint").alias("lo"), F.lit(10**15).alias("hi"))
    return ranges(spark, sf_dir).unionByName(beyond)


SQL_RANGES = "(select n_nationkey * 131 as lo, n_nationkey * 131 + n_regionkey * 60 + 5 as hi from nation)"
SQL_WIDE = f"(select * from {SQL_RANGES} union all select 7001, 1000000000000000 from region where r_regionkey = 1)"


@entry("range_select", f"select o_orderkey from orders where exists (select 1 from {SQL_WIDE} r where o_orderkey between r.lo and r.hi)")
def _(spark, sf_dir):
    return in_ranges(tasks(spark, sf_dir), wide_ranges(spark, sf_dir)).select("o_orderkey")


@entry(
    "out_of_range",
    f"""select distinct u.id from (select unnest(range(greatest(lo, n.total), least(hi, n.total + 20) + 1)) as id
      from {SQL_WIDE}, (select count(*) as total from orders) n where hi >= n.total) u order by u.id limit 10""",
)
def _(spark, sf_dir):
    return out_of_range(wide_ranges(spark, sf_dir), table(spark, sf_dir, "orders").count())


@entry("modulo_shard", "select o_orderkey from orders where o_orderkey % 8 = 3 order by o_orderkey limit 100")
def _(spark, sf_dir):
    return modulo_shard(tasks(spark, sf_dir), 3, 8, most=100).select("o_orderkey")


@entry(
    "stratified_sample",
    f"select {SQL_STRATUM} as language, least(count(*), 40) as picked, true as from_catalogue from orders group by 1",
)
def _(spark, sf_dir):
    # Which tasks are drawn depends on the hash, so the check is on the contract:
    # the size of each stratum, and that the drawn tasks are distinct members of it.
    everything = tasks(spark, sf_dir)
    drawn = stratified_sample(everything, 40, seed=7)
    back = drawn.select("public_index", "stratum").join(
        everything.select("public_index", F.coalesce(F.nullif("language", F.lit("")), F.lit("unknown")).alias("own")), "public_index"
    )
    return back.groupBy(F.col("stratum").alias("language")).agg(
        F.countDistinct("public_index").alias("picked"), F.bool_and(F.col("own") == F.col("stratum")).alias("from_catalogue")
    )


# --- validation --------------------------------------------------------------------


def checked_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks with two lists that overlap in spelling or only in name."""
    key = F.col("o_orderkey")
    text = key.cast("string")
    f2p = F.when(key % 8 == 0, F.array().cast("array<string>")).otherwise(
        F.array(F.concat(F.lit("t"), text), F.concat(F.lit("slow"), text, F.lit(" (1.5s)")))
    )
    p2p = F.array(
        F.when(key % 6 == 0, F.concat(F.lit("t"), text)).otherwise(F.concat(F.lit("u"), text)),
        F.when(key % 5 == 0, F.concat(F.lit("slow"), text, F.lit(" (2s)"))).otherwise("v"),
    )
    return tasks(spark, sf_dir).select(
        "*",
        F.when(key % 10 != 3, "c0ffee").otherwise("").alias("base_commit"),
        F.lit("diff").alias("patch"),
        F.when(key % 7 != 2, "diff").alias("test_patch"),
        f2p.alias("FAIL_TO_PASS"),
        p2p.alias("PASS_TO_PASS"),
    )


@entry(
    "group_overlap",
    """select o_orderkey, case when o_orderkey % 6 = 0 and o_orderkey % 8 <> 0 then 't' || o_orderkey else '' end as verbatim,
      case when o_orderkey % 5 = 0 and o_orderkey % 8 <> 0 then 'slow' || o_orderkey else '' end as aliases from orders""",
)
def _(spark, sf_dir):
    return group_overlap(checked_tasks(spark, sf_dir)).select(
        "o_orderkey", F.array_join("verbatim", ",").alias("verbatim"), F.array_join("aliases", ",").alias("aliases")
    )


@entry(
    "validate_metadata",
    """with e as (select o_orderkey, o_custkey % 5 as k, concat_ws('|',
      case when o_custkey % 5 = 4 then 'install_config is not an object' end,
      case when o_custkey % 5 = 4 then 'test_cmd must be a string or list of strings'
           when o_custkey % 5 in (2, 3) then 'test_cmd must contain at least one nonempty command' end,
      case when o_custkey % 5 = 4 then 'unknown log parser: None' when o_orderkey % 9 = 0 then 'unknown log parser: ''no_such_parser''' end,
      case when o_orderkey % 8 = 0 then 'FAIL_TO_PASS is empty' end,
      case when o_orderkey % 6 = 0 and o_orderkey % 8 <> 0 then '1 test(s) occur verbatim in both FAIL_TO_PASS and PASS_TO_PASS' end,
      case when o_orderkey % 10 = 3 then 'base_commit is empty or not a string' end,
      case when o_orderkey % 7 = 2 then 'test_patch is empty or not a string' end) as errors from orders)
    select 'task-' || o_orderkey as instance_id, case k when 0 then 1 when 1 then 2 else 0 end::bigint as test_command_count,
      case when o_orderkey % 8 = 0 then 0 else 2 end::bigint as fail_to_pass_count,
      case when o_orderkey % 5 = 0 and o_orderkey % 8 <> 0 then 1 else 0 end::bigint as alias_count, errors = '' as valid, errors from e""",
)
def _(spark, sf_dir):
    rows = validate_metadata(checked_tasks(spark, sf_dir))
    return rows.select(
        "instance_id",
        F.col("test_command_count").cast("bigint").alias("test_command_count"),
        F.col("fail_to_pass_count").cast("bigint").alias("fail_to_pass_count"),
        F.col("normalized_cross_group_alias_count").cast("bigint").alias("alias_count"),
        "valid",
        F.array_join("errors", "|").alias("errors"),
    )


# --- result logs -----------------------------------------------------------------
# An event is a line of a result log; some lines are broken in various ways.

SQL_USED = "event_id % 17 not in (3, 4, 5)"


def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    index = (
        F.when(key % 17 == 1, F.concat(F.lit('"'), F.col("user_id").cast("string"), F.lit('"')))
        .when(key % 17 == 2, F.concat(F.col("user_id").cast("string"), F.lit(".7")))
        .when(key % 17 == 3, "null")
        .otherwise(F.col("user_id").cast("string"))
    )
    valid = (
        F.when(F.col("event_type") == "error", F.when(key % 2 == 0, "false").otherwise("0"))
        .when(F.col("event_type") == "view", '"false"')
        .otherwise("true")
    )
    good = F.concat(
        F.lit('{"index": '), index, F.lit(', "seq": '), key.cast("string"),
        F.when(F.col("event_type") == "signup", "").otherwise(F.concat(F.lit(', "valid": '), valid)), F.lit("}"),
    )
    line = F.when(key % 17 == 4, '{"index": 1, "va').when(key % 17 == 5, "[1, 2]").otherwise(good)
    return (table(spark, sf_dir, "events")).select(line.alias("value"))


SQL_LATEST = f"""(select user_id as "index", arg_max(event_type not in ('error', 'signup'), event_id) as valid
  from events where {SQL_USED} group by user_id)"""


@entry("results_latest", f"select * from {SQL_LATEST}")
def _(spark, sf_dir):
    return latest_results(parse_results(result_lines(spark, sf_dir)))


@entry(
    "results_roundtrip",
    """select user_id as "index", coalesce(max(event_type in ('view', 'signup')) filter (where event_type <> 'purchase'), true) as valid
      from events group by user_id""",
)
def _(spark, sf_dir):
    # Two writes to one log, the second of which is repeated; what is written later counts.
    path = f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events")
    early = events.where("event_type = 'purchase'").select(F.col("user_id").alias("index"), F.lit(True).alias("valid")).distinct()
    late = events.where("event_type <> 'purchase'").groupBy(F.col("user_id").alias("index")).agg(F.max(F.col("event_type").isin("view", "signup")).alias("valid"))
    write_results(early, path)
    for _ in range(2):
        write_results(late, path, resume=True, write_id="late")
    return latest_results(read_results(spark, path))


def wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("index"))


@entry("resume_anti", f'select c_custkey as "index" from customer where c_custkey not in (select "index" from {SQL_LATEST})')
def _(spark, sf_dir):
    return pending(wanted(spark, sf_dir), latest_results(parse_results(result_lines(spark, sf_dir))))


@entry(
    "run_summary",
    f"""select count(*) as selected, count(r.valid) as completed, count(*) filter (where not r.valid) as invalid
    from customer c left join {SQL_LATEST} r on c.c_custkey = r."index\"""",
)
def _(spark, sf_dir):
    return run_summary(wanted(spark, sf_dir), latest_results(parse_results(result_lines(spark, sf_dir))))
