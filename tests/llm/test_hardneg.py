"""Hard negatives against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from invoicelake.llm import hardneg
from invoicelake.llm.hardneg import MOST, hard_negatives, scores_of

SCHEMA = "vec_id bigint, embedding array<double>, label int, score string, rank string, vector string"


def brute(rows, step=10):
    best = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, v)
        best[i] = min(best.get(i, row), row)
    data = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in best.items()}

    def score(a, b):
        return max(-MOST, min(MOST, sum(x * y for x, y in zip(data[a][1], data[b][1], strict=False))))

    out = set()
    for a in (i for i in data if i % step == 0):
        others = sorted(((-score(a, b), b) for b in data if b != a))
        positives = [(s, b) for s, b in others if data[b][0] == data[a][0]][:5]
        for p, b in positives:
            window = [(s, c) for s, c in others if data[c][0] != data[a][0] and 80 * -p <= 100 * -s <= 100 * -p][:5]
            out |= {(a, b, k + 1, c, -p, -s) for k, (s, c) in enumerate(window)}
    return out


def found(spark, rows, label=None):
    data = [(i, v, l, "old", "old", "old") for i, v, l in rows]
    return hard_negatives(spark.createDataFrame(data, SCHEMA), F.col("vec_id") % 10 == 0, label)


def as_set(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def near(rng, center, spread):
    return [x + rng.uniform(-spread, spread) for x in center]


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "BLOCK", 7)  # several blocks of anchors
    monkeypatch.setattr(hardneg, "ROWS", 64)  # several steps a block of rows
    rng = random.Random(1)
    centers = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(3)]
    rows = [(i, near(rng, rng.choice(centers), 0.2), rng.randrange(4)) for i in range(400)]
    out = found(spark, rows)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = as_set(out)
    assert got == brute(rows) and len(got) > 500


def test_ties_copies_and_repeated_rows(spark):
    one = [0.5, -0.25, 0.125]
    rows = [(i, one, i % 3) for i in range(120)]  # one vector for all, so only ids decide
    rows += [(5, one, 0), (10, [0.1, 0.1, 0.1], 2), (10, [0.1, 0.0, 0.1], 2), (20, one, 2)]
    rows += [(i, [0.0, 0.0, 0.0], i % 2) for i in range(200, 220)]  # scores of zero
    assert as_set(found(spark, rows)) == brute(rows)


def test_odd_rows_take_no_part(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, 1.5], 1), (2, [1.0, 1.4], 2), (3, [1.0, None], 2), (4, [inf, 1.0], 2)]
    rows += [(5, [nan, 1.0], 1), (6, None, 2), (7, [1.0, 1.4], None), (None, [1.0, 1.4], 2), (8, [], 2), (9, [1.0], 1)]
    rows += [(10, [-1.0, -1.0], 1), (11, [1.0, 1.3, 9.0], 2), (30, [], 3), (40, [2.0], 7)]
    got = as_set(found(spark, rows))
    assert got == brute(rows) and got
    assert not found(spark, []).collect()
    assert not found(spark, [(1, [1.0], 1), (2, [1.0], 2)]).collect()  # no anchor
    assert not found(spark, [(0, [1.0], 1), (2, [1.0], 2)]).collect()  # no positive
    assert not found(spark, [(0, [1.0], 1), (2, [1.0], 1)]).collect()  # no negative


def test_labels_may_be_an_expression(spark):
    rng = random.Random(2)
    rows = [(i, near(rng, [0.4, 0.4, 0.4], 0.3), rng.randrange(3)) for i in range(100)]
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 3).otherwise(F.col("label"))
    assert as_set(found(spark, rows, changed)) == brute([(i, v, (l + 1) % 3 if i % 7 == 0 else l) for i, v, l in rows])


def test_scores_are_exact():
    rng = np.random.default_rng(0)
    for top in (300, 1 << 25, 1 << 40):
        a, b = rng.integers(-top, top, (5, 9)).astype(float), rng.integers(-top, top, (7, 11)).astype(float)
        expected = [[max(-MOST, min(MOST, sum(int(x) * int(y) for x, y in zip(r, s)))) for s in b] for r in a]
        assert scores_of(a, b).tolist() == expected
