"""Mixing by thresholds, held against a plain version that sorts."""

import hashlib
import random
import re
from fractions import Fraction

from pyspark.sql import functions as F

from runsift.llm import mixing
from runsift.llm.mixing import mix
from tests.llm.conftest import prose

SCHEMA = "doc_id long, text string, source string, size string, hash int, target int, taken int"


def plain_mix(rows, weights=(1, 2, 3), most=3):
    """(doc_id, source, size) -> sorted (doc_id, source, size, source_size, target, taken)."""
    by_source = {}
    for doc_id, source, size in rows:
        key = int(hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:15], 16)
        by_source.setdefault(source, []).append((key, size, doc_id))
    order = sorted(by_source, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    held = {s: sum(size for _, size, _ in docs) for s, docs in by_source.items()}
    total, stopped = sum(held.values()), set()
    while True:
        open_ones = [s for s in order if s not in stopped]
        share = Fraction(total - sum(most * held[s] for s in stopped), sum(weight[s] for s in open_ones)) if open_ones else 0
        above = {s for s in open_ones if share * weight[s] > most * held[s]}
        if not above:
            break
        stopped |= above
    out = []
    for source, docs in by_source.items():
        target = most * held[source] if source in stopped else share * weight[source]
        words = int(target + Fraction(1, 2))
        rounds, left = divmod(words, held[source]) if held[source] else (0, 0)
        upto = 0
        for key in sorted({k for k, _, _ in docs}):
            same = [(size, doc_id) for k, size, doc_id in docs if k == key]
            there = sum(size for size, _ in same)
            for size, doc_id in same:
                more = size if upto + there <= left else size * (left - upto) // there if upto <= left and there else 0
                out.append((str(doc_id), str(source), size, held[source], round(float(target), 6), size * rounds + more))
            upto += there
    return sorted(out)


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def got(frame, **more):
    return sorted((str(r["doc_id"]), str(r["source"]), r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mix(frame, **more).collect())


def documents(n=400):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randrange(0, 40)), rng.choice(["hot"] * 6 + ["a", "b", "é", "z", "\U0001f600", None]), "x", 1, 2, 3) for i in range(n)]
    rows += [(i, text, "tiny", "x", 1, 2, 3) for i, text in [(1, "two words"), (2, None), (3, ""), (4, " \t\x0b one\x0c\n"), (5, "a b c")]]
    rows += [(None, "no id here", "a", "x", 1, 2, 3), (None, "nor here", "a", "x", 1, 2, 3), (900, prose(rng, 20_000), "b", "x", 1, 2, 3), (901, None, "empty", "x", 1, 2, 3)]
    return rows + rows[:40] + rows[3:4] * 50  # repeated rows share a hash


def test_mix_is_the_plain_one(spark):
    rows = documents()
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5)) == plain_mix([(r[0], r[2], n_words(r[1])) for r in rows])


def test_mix_with_other_weights_and_joins_that_send_nothing(spark, monkeypatch):
    rows = documents(150)
    monkeypatch.setattr(mixing, "SENT_ROWS", 0)
    want = plain_mix([(r[0], r[2], n_words(r[1])) for r in rows], weights=(5, 1), most=2)
    assert got(spark.createDataFrame(rows, SCHEMA), weights=(5, 1), most=2) == want


def test_mix_of_few_and_none(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in mix(spark.createDataFrame([(1, None, None, "", 0, 0, 0)], SCHEMA)).collect()] == [(1, None, 0, 0, 0.0, 0)]
    assert [r["taken"] for r in mix(spark.createDataFrame([(1, "a b c", "s", "", 0, 0, 0)], SCHEMA)).collect()] == [3]


def test_budgets_are_nested_and_met(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 9).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    small, large = (mix(rows, weights=w) for w in ((1, 1, 1, 1, 1, 1, 1, 1), (6, 1, 1, 1, 1, 1, 1, 1)))
    sums = large.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.expr("taken - 3 * size")).alias("over")).collect()
    assert all(abs(r["taken"] - r["target"]) < 1 and r["over"] <= 0 for r in sums)
    both = small.where("source = 'big'").join(large.select("doc_id", F.col("taken").alias("more")), "doc_id")
    assert both.where("taken > more").count() == 0 and both.where("taken < more").count() > 0


def test_plan_has_no_python(spark):
    plan = mix(spark.createDataFrame(documents(30), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Sort [hash"))
