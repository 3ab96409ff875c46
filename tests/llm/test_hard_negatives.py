"""Products in a residue number system and hard negatives, held against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from runsift.llm import hard_negatives as module
from runsift.llm.hard_negatives import hard_negatives
from runsift.llm.residues import base, products, residues

SCHEMA = "vec_id long, embedding array<double>, label int, v int, slice int, score int"


@pytest.mark.parametrize("size, width", [(3, 1), (300, 64), (1 << 20, 7), (1 << 40, 5), ((1 << 62) - 1, 3), (90, 3000)])
def test_products_are_exact(size, width):
    rng = random.Random(size)
    rows = [[float(rng.randrange(-size, size + 1)) for _ in range(width)] for _ in range(6)] + [[float(size)] * width, [-float(size)] * width]
    exact = [[sum(int(a) * int(b) for a, b in zip(x, y)) for y in rows] for x in rows]
    primes = base(width * size * size + 1)
    r = residues(np.array(rows), primes)
    got = products(r, r, primes)
    top = (1 << 63) - 1
    assert got.tolist() == [[max(-top - 1, min(top, s)) for s in row] for row in exact]


def plain(rows, positives=5, negatives=3):
    sound = [(i, [math.floor(256 * x) for x in v], (lab + 1) % 10 if i % 7 == 0 else lab) for i, v, lab, *_ in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, av, al in {(i, tuple(v), lab) for i, v, lab in sound if i % 50 == 0}:
        scored = [(-sum(x * y for x, y in zip(av, v)), i, lab) for i, v, lab in sound if i != a]
        for ps, p, _ in sorted(s for s in scored if s[2] == al)[:positives]:
            fit = sorted(s for s in scored if s[2] != al and 50 * -ps <= 100 * -s[0] <= 95 * -ps)[:negatives]
            out += [(a, p, r + 1, n, -ps, -ns) for r, (ns, n, _) in enumerate(fit)]
    return sorted(out)


def mined(frame):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(frame, label, F.col("vec_id") % 50 == 0)


def vectors():
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0.3, 0.5) for _ in range(6)], rng.choice([1] * 5 + [2, 3, 4]), 7, 7, 7) for i in range(420)]
    rows += [(1000 + i, [0.5] * 6, 1 + i % 2, 7, 7, 7) for i in range(60)]  # ties, and one vector for many
    rows += [(2000, [0.25] * 6, 9, 7, 7, 7), (50, rows[50][1], rows[50][2], 7, 7, 7), (7, rows[9][1], 1, 7, 7, 7)]  # a label of its own, repeated ids
    rows += [(None, [1.0] * 6, 1, 7, 7, 7), (901, None, 1, 7, 7, 7), (902, [1.0, None, *[1.0] * 4], 1, 7, 7, 7), (903, [float("nan")] * 6, 1, 7, 7, 7), (904, [float("inf")] * 6, 1, 7, 7, 7), (905, [1.0] * 6, None, 7, 7, 7)]
    return rows + [(906, [2.0], 1, 7, 7, 7), (907, [], 1, 7, 7, 7), (950, [0.0] * 6, 1, 7, 7, 7), (100, [3e6] * 6, 2, 7, 7, 7), (908, [-3e6] * 6, 3, 7, 7, 7), (909, [1e6] * 6, 3, 7, 7, 7)]


def test_hard_negatives_are_the_plain_ones(spark):
    rows = vectors()
    got = mined(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == plain(rows)


def test_many_slices_and_blocks_give_the_same(spark, monkeypatch):
    rows = vectors()
    monkeypatch.setattr(module, "SLICE", 40)
    monkeypatch.setattr(module, "BLOCK", 3)
    assert sorted(map(tuple, mined(spark.createDataFrame(rows, SCHEMA)).collect())) == plain(rows)


def test_few_and_none(spark):
    assert mined(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mined(spark.createDataFrame([(50, [1.0], 1, 0, 0, 0), (1, [0.75], 2, 0, 0, 0)], SCHEMA)).count() == 0  # no positive
    got = mined(spark.createDataFrame([(50, [1.0], 1, 0, 0, 0), (1, [0.75], 2, 0, 0, 0), (2, [1.0], 1, 0, 0, 0)], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(50, 2, 1, 1, 65536, 49152)]


def test_repeated_candidates_are_rows_each(spark):
    rows = [(50, [1.0], 1, 0, 0, 0), (1, [1.0], 1, 0, 0, 0)] + [(3, [0.75], 2, 0, 0, 0)] * 2
    assert sorted(tuple(r)[2:4] for r in mined(spark.createDataFrame(rows, SCHEMA)).collect()) == [(1, 3), (2, 3)]


def test_scores_beyond_a_long_stay_at_its_end(spark):
    rows = [(50, [1e30, 1.0], 1, 0, 0, 0), (1, [1e30, 0.0], 1, 0, 0, 0), (2, [1e-3, 2.0], 2, 0, 0, 0)]
    assert mined(spark.createDataFrame(rows, SCHEMA)).count() == 0
