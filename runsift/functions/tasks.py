"""Scalar functions on task attributes."""

from pyspark.sql import Column, functions as F


def image_reference(image: Column, hosted_prefix: str, public_prefix: str) -> Column:
    """Public name of an image that a hosted registry renamed."""
    return F.when(
        image.startswith(hosted_prefix),
        F.concat(F.lit(public_prefix), F.substring(image, F.lit(len(hosted_prefix) + 1), F.char_length(image))),
    ).otherwise(image)


def image_cache_key(reference: Column) -> Column:
    return F.sha2(reference, 256)


def render_prompt(repo: Column, language: Column, problem: Column, workdir: Column) -> Column:
    """Instruction text for one task (fixed wording)."""
    return F.concat(
        F.lit("You are a software engineer working on the repository **"), repo,
        F.lit("** (language: "), language,
        F.lit(").\n\n## Problem Statement\n\n"), problem,
        F.lit("\n\n## Instructions\n\nThe repository is cloned at `"), workdir,
        F.lit(
            "` and checked out to the commit before the fix. Your task is to modify the code so that the "
            "failing tests pass.\n\n"
            "Use the available tools to explore the codebase, understand the problem, make edits, and then "
            "call `submit_answer` when you are done.\n\n"
            "Do NOT modify or create tests — only fix the source code."
        ),
    )
