"""Hard negatives against plain inner products."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from firnline.llm import hardneg

SCHEMA = "vec_id long, embedding array<float>, label int"


def slow(rows, rules=hardneg.Rules(), moved=True, anchor=lambda i: i % 100 == 0):
    by = {}
    for i, x, k in rows:
        if i is None or x is None or k is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        q = (int(math.fmod(k + 1, 10)) if moved and i % 7 == 0 else k, [math.floor(256 * float(np.float32(v))) for v in x])
        by[i] = min(by.get(i, q), q)
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=False))
    out = []
    for a, (k, x) in by.items():
        if not anchor(a):
            continue
        order = sorted((-dot(x, y), i, l) for i, (l, y) in by.items() if i != a)
        for s, i, _ in [o for o in order if o[2] == k][: rules.positives]:
            fit = [o for o in order if o[2] != k and rules.low * -s <= 100 * -o[0] <= rules.high * -s][: rules.negatives]
            out += [(a, i, r, n, -s, -t) for r, (t, n, _) in enumerate(fit, 1)]
    return sorted(out)


def got(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def made(n=1500, dims=12, seed=3):
    rng = random.Random(seed)
    common = [rng.gauss(0, 0.3) for _ in range(dims)]
    rows = [(i, common if i % 3 == 1 else [rng.gauss(0.1, 0.3) for _ in range(dims)], rng.choice([0, 0, 0, 1, 2, 9])) for i in range(n)]
    rows += [(-700, [0.5] * dims, 9), (2000, [0.0] * dims, 1), (2100, [], 1), (2200, [0.2, -0.7], 2), (2300, [-0.9] * dims, 77)]
    rows += [(2400, None, 1), (2500, [0.1] * dims, None), (None, [0.1] * dims, 1), (2600, [0.1, None], 1), (2700, [float("nan")] + [0.1] * 3, 1), (2800, [float("inf")], 1)]
    rows += [(300, rows[300][1], rows[300][2]), (5, [0.3] * dims, 0), (400, [9.5] * dims, 0)]
    rng.shuffle(rows)
    return rows


def test_against_products(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "TILE", (7, 60))
    rows = made()
    df = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], SCHEMA + ", x string, score double").repartition(6)
    expected = slow(rows)
    assert len(expected) > 300 and got(hardneg.hard_negatives(df)) == expected


def test_many_blocks_and_other_rules(spark):
    rows = made(600, 5, 8)
    rules = hardneg.Rules(positives=2, negatives=3, low=-50, high=100)
    vectors = hardneg.integer_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("label"))
    found = got(hardneg.mine(vectors, F.col("vec_id") % 20 == 0, rules, block_rows=16))
    assert found == slow(rows, rules, False, lambda i: i % 20 == 0)


def test_empty(spark):
    assert hardneg.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hardneg.hard_negatives(spark.createDataFrame([(1, [0.5], 2), (3, [0.5], 1)], SCHEMA)).count() == 0
    assert hardneg.hard_negatives(spark.createDataFrame([(100, [], 2), (3, [], 2), (4, [], 1)], SCHEMA)).count() == 1


def test_intervals_hold_the_scores():
    rng = np.random.default_rng(1)
    x, y = rng.integers(-200, 200, (6, 9)), rng.integers(-200, 200, (40, 9))
    planes = 9
    slices = np.stack([((y + 256) >> j & 1).astype(np.float32) for j in range(planes - 1, -1, -1)])
    widths = []

    def hopeless(rows, low, high):
        exact = x @ y.T
        assert rows is None and (low <= exact).all() and (exact <= high).all()
        widths.append((high - low).max())
        return np.zeros(low.shape, bool)

    rows, cols, score = hardneg.scored(hardneg.Block(np.arange(6), np.zeros(6), x, planes), slices, np.ones((6, 40), bool), hopeless)
    assert (score == (x @ y.T)[rows, cols]).all() and len(score) == 240
    assert widths == sorted(widths, reverse=True) and widths[-1] == 0
