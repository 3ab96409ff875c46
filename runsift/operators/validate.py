"""Checks on task definitions."""

from pyspark.sql import Column, DataFrame, functions as F

from runsift.functions.binding import bind
from runsift.functions.text import normalize_test_name
from runsift.operators.extract import dialect_of
from runsift.sources.catalogue import config_columns

NEEDED = ("instance_id", "base_commit", "image_name", "patch", "test_patch")
PREVIEW = 20
SCHEMA_VERSION = 1


def group_overlap(tasks: DataFrame) -> DataFrame:
    """Add `verbatim` (same spelling in both lists) and `aliases` (same name
    after normalising, but not verbatim), both sorted."""
    f2p, p2p = F.col("FAIL_TO_PASS"), F.col("PASS_TO_PASS")

    def normal(names: Column) -> Column:
        return F.transform(names, lambda n: normalize_test_name(n))

    tasks = bind(tasks, verbatim=F.array_sort(F.array_intersect(f2p, p2p)))
    shared = F.array_intersect(normal(f2p), normal(p2p))
    return bind(tasks, aliases=F.array_sort(F.array_except(shared, normal(F.col("verbatim")))))


def validate_metadata(tasks: DataFrame) -> DataFrame:
    """One record per task: counts, alias preview, errors, verdict.

    Everything is computed within the task's row; nothing is shuffled.
    """
    rows = group_overlap(config_columns(tasks))
    is_object = F.col("config_kind") == "OBJECT"
    listed = F.coalesce((F.col("cmd_kind") == "STRING") | F.col("cmd_kind").startswith("ARRAY"), F.lit(False))
    parser = F.when(is_object, F.col("log_parser"))
    overlap = F.size("verbatim")
    errors = [
        F.when(~is_object, "install_config is not an object"),
        F.when(~(is_object & listed), "test_cmd must be a string or list of strings").when(
            F.col("commands").isNull(), "test_cmd must contain at least one nonempty command"
        ),
        F.when(
            dialect_of(parser).isNull(),
            F.concat(
                F.lit("unknown log parser: "),
                F.coalesce(F.concat(F.lit("'"), parser, F.lit("'")), F.lit("None")),
            ),
        ),
        F.when(F.size("FAIL_TO_PASS") == 0, "FAIL_TO_PASS is empty"),
        F.when(
            overlap > 0,
            F.concat(
                overlap.cast("string"),
                F.lit(" test(s) occur verbatim in both FAIL_TO_PASS and PASS_TO_PASS"),
            ),
        ),
        *[F.when(F.coalesce(F.col(c), F.lit("")) == "", f"{c} is empty or not a string") for c in NEEDED],
    ]
    rows = bind(rows, found=F.filter(F.array(*errors), lambda e: e.isNotNull()))
    found = F.col("found")
    indexes = [c for c in ("index", "raw_index", "public_index") if c in tasks.columns]
    return rows.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.lit("metadata").alias("mode"),
        *indexes,
        "instance_id",
        "image_name",
        "language",
        parser.alias("parser"),
        F.coalesce(F.size(F.when(is_object, F.col("commands"))), F.lit(0)).alias("test_command_count"),
        F.size("FAIL_TO_PASS").alias("fail_to_pass_count"),
        F.size("PASS_TO_PASS").alias("pass_to_pass_count"),
        F.size("aliases").alias("normalized_cross_group_alias_count"),
        F.slice("aliases", 1, PREVIEW).alias("normalized_cross_group_aliases"),
        (F.size(found) == 0).alias("valid"),
        found.alias("errors"),
    )
