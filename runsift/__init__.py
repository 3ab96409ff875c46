"""Bulk evaluation of software test runs on Spark.

Logs of test runs go in; per-test statuses, rewards, phase verdicts and
summaries come out, all as DataFrames.
"""

from runsift.operators.extract import extract_test_results, register_extractor
from runsift.plans.grade import grade_runs

__all__ = ["extract_test_results", "grade_runs", "register_extractor"]
