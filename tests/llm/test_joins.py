"""Top-k search and Jaccard components, held against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from runsift.llm import common, jaccard
from runsift.llm.graph import components
from runsift.llm.jaccard import near_duplicates, one_of_each, verified
from runsift.llm.topk import top_k
from tests.llm.conftest import prose


def plain_top_k(rows, k=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {(i, tuple(v)) for i, v in ok if i % 50 == 0}
    out = []
    for q, v in queries:
        scored = sorted(((-sum(a * b for a, b in zip(v, x)), i) for i, x in ok if i != q))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def test_top_k(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], 1, 2) for i in range(400)]
    rows += [(1000 + i, [0.5] * 8, 1, 2) for i in range(60)]  # ties
    rows += [(50, rows[50][1], 1, 2), (7, rows[9][1], 1, 2), (100, [9.0] * 8, 1, 2)]  # repeated ids
    rows += [(None, [1.0] * 8, 1, 2), (901, None, 1, 2), (902, [1.0, None, *[1.0] * 6], 1, 2), (903, [float("nan")] * 8, 1, 2), (904, [float("inf")] * 8, 1, 2), (905, [2.0], 1, 2), (906, [], 1, 2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell int, score int")
    got = top_k(frame, F.col("vec_id") % 50 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == plain_top_k(rows)


def test_top_k_of_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert top_k(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0]), (1, [1.0])], schema)
    assert [tuple(r) for r in top_k(two, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 65536)]


def plain_components(rows):
    sets = []
    for _, text, *_ in rows:
        words = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
        words = [w for w in words if w]
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    low = {}
    for i, (doc, *_) in enumerate(rows):
        key = find(i)
        low[key] = min((x for x in (low.get(key), doc) if x is not None), default=None)
    return sorted(((r[0] is None, r[0] or 0, len(sets[i]), low[find(i)] or 0) for i, r in enumerate(rows)))


@pytest.fixture(scope="module")
def copies():
    """Copies, near copies on both sides of the threshold, chains of them, a shared passage, small texts."""
    rng = random.Random(3)
    rows, i = [], 10
    passage = prose(rng, 40)
    for _ in range(14):
        base = prose(rng, rng.choice((8, 30, 90, 150)), 5000).split()
        for _ in range(rng.randint(1, 9)):
            rows.append((i, " ".join(base), "en", "a"))
            i += 1
            if rng.random() < 0.8:
                base = list(base)
                for _ in range(rng.choice((0, 1, 2, 3))):
                    base[rng.randrange(len(base))] = f"x{rng.randrange(9999)}"
        rows.append((i, prose(rng, 30, 5000) + " " + passage, "en", "a"))
        i += 1
    rows += [(1, "one", "en", "a"), (2, "ONE\n", "en", "a"), (3, "a b c d", "en", "a"), (4, "A B c D", "en", "a"), (5, "É b c d", "en", "a"), (6, "é b c d", "en", "a"), (7, None, "en", "a"), (8, "", "en", "a"), (9, "", "en", "a"), (None, "one", "en", "a"), (None, "no other like this", "en", "a")]
    rng.shuffle(rows)
    return rows + rows[:5]


def test_components_of_documents(frame, copies):
    got = near_duplicates(frame(copies)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == plain_components(copies)


def test_one_of_each_keeps_whole_rows(frame, copies):
    kept = one_of_each(frame(copies))
    assert kept.columns == frame(copies[:1]).columns
    ids = [r.doc_id for r in kept.collect()]
    expected = {d for none, d, n, c in plain_components(copies) if not none and d == c}
    assert {i for i in ids if i is not None} == expected and len(ids) == len(set(ids))
    assert one_of_each(frame([])).count() == 0


def test_components_of_hubs_and_chains(spark):
    links = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (2000, 1999)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(400)) and all(got[1000 + i] == 1000 for i in range(61)) and got[2000] == 1999
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sets_that_share_a_passage_only_meet_nobody(spark, frame, monkeypatch):
    """Each text has a passage of all and a few words of its own: no two are linked, and no two are compared."""
    rng = random.Random(8)
    passage = prose(rng, 120, 9000)
    rows = [(i, f"{passage} " + " ".join(f"own{i}x{k}" for k in range(16 + i % 3)), "en", "a") for i in range(60)]
    # Near copies, linked only through one that stood alone; and a text that is alone.
    rows += [(100 + i, prose(random.Random(2), 60, 5000) + f" end{i}", "en", "a") for i in range(4)] + [(200, prose(rng, 50, 5000), "en", "a")]
    compared = []

    def counted(pairs, nodes, docs):
        compared.append(pairs.distinct().count())
        return verified(pairs, nodes, docs)

    monkeypatch.setattr(jaccard, "verified", counted)
    got = near_duplicates(frame(rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == plain_components(rows)
    assert compared[-1] == 0 and sum(compared[1:]) <= len(rows)


def test_bounds_on_shared_tokens_hold_for_sizes_in_between(spark):
    """What a range of sizes needs is never more than what one of its sizes needs."""
    rows = spark.range(1, 90).selectExpr("id as n").crossJoin(spark.range(1, 90).selectExpr("id as low")).crossJoin(spark.range(0, 40, 7).selectExpr("id as width"))
    rows = rows.withColumn("high", F.expr("low + width")).withColumn("nb", F.explode(F.sequence("low", "high"))).crossJoin(spark.range(1, 14).selectExpr("id as shared"))
    lost = rows.where(jaccard.enough_shared("shared", "n", "nb") & ~jaccard.enough_for_some(F.col("shared"), "n", "low", "high"))
    assert lost.count() == 0


def test_a_step_leaves_no_tables_but_its_result(spark, tmp_path, monkeypatch):
    """Links that take several rounds: all tables on the way are gone, and the result can still be read."""
    monkeypatch.setattr(common, "shared_folder", lambda _: str(tmp_path))
    found = components(spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long"))
    assert len(list(tmp_path.iterdir())) <= 1
    assert {tuple(r) for r in found.collect()} == {(i, 0) for i in range(21)}


def test_documents_leave_few_tables(frame, copies, tmp_path, monkeypatch):
    """The first pass, the components by set and the links found in each of at most six steps; not the matrix of tokens."""
    monkeypatch.setattr(common, "shared_folder", lambda _: str(tmp_path))
    got = near_duplicates(frame(copies))
    assert len(list(tmp_path.iterdir())) <= 8
    assert got.count() == len(copies)
