"""Table layouts shared by all operators (Spark DDL)."""

TASKS = (
    "instance_id STRING, repo STRING, base_commit STRING, patch STRING, test_patch STRING, "
    "problem_statement STRING, image_name STRING, language STRING, "
    "FAIL_TO_PASS ARRAY<STRING>, PASS_TO_PASS ARRAY<STRING>, "
    "install_config STRUCT<test_cmd: ARRAY<STRING>, log_parser: STRING, install: ARRAY<STRING>, base_image_name: STRING>"
)

# One row per part of a log. A run whose log fits in one row has part 0 only.
# Long logs may arrive as several parts, cut between any two lines; their numbers
# grow from 0. Parts are read where they lie, and the answer is that of the whole log.
# A run may also say why it failed, in error_stage STRING and error STRING.
RUNS = "run_id STRING, instance_id STRING, parser STRING, part BIGINT, log STRING, exit_code INT"

EXPECTED = "instance_id STRING, grp STRING, pos INT, raw_id STRING, norm_id STRING"

RESULTS = (
    "run_id STRING, test_id STRING, status STRING, "
    "first_pos STRUCT<reading: INT, part: BIGINT, seq: BIGINT, sub: INT>"
)

PASSED, FAILED, SKIPPED, ERROR = "PASSED", "FAILED", "SKIPPED", "ERROR"
STATUSES = (PASSED, FAILED, SKIPPED, ERROR)
NOT_FOUND = "NOT_FOUND"

# A run whose log its dialect cannot read has one result row with this key.
# NUL cannot occur in a test name that came through a text log intact.
UNREADABLE = "\x00unreadable"
