"""Hard negatives against all scores in plain Python: ties, windows of every width, odd rows and very large numbers."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from foretide.llm import hard_negatives

SCHEMA = "vec_id long, label long, embedding array<double>, score long, anchor string, windows int, dim int"


def _plain(rows, scale, positives, negatives, low, high, every):
    whole = []
    for i, label, v in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, label, [math.floor(scale * x) for x in v]))
    clamp = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    anchors, out = {(i, label, tuple(v)) for i, label, v in whole if i is not None and i % every == 0}, []
    for i, label, v in anchors:
        scored = [(clamp(sum(a * b for a, b in zip(v, w, strict=True))), j, other) for j, other, w in whole if len(w) == len(v)]
        best = sorted((x for x in scored if x[2] == label and x[1] != i), key=order)[:positives]
        for p, j, _ in best:
            hard = sorted((x for x in scored if x[2] != label and low * p <= 100 * x[0] <= high * p), key=order)[:negatives]
            out += [(i, j, rank, n, p, s) for rank, (s, n, _) in enumerate(hard, 1)]
    return out


def _rows(seed, dim, size):
    rng = random.Random(seed)
    vector = lambda: [rng.choice((-1, 0, 1, 2)) * rng.choice((0.25, 1.0)) for _ in range(dim)]
    hot = [1.0] * dim
    rows = [(i, rng.randrange(3), hot if rng.random() < 0.3 else vector()) for i in range(size)]
    rows += [(None, 1, hot), (None, 2, vector()), (10, 1, vector()), (10, 1, vector()), (20, 0, hot), (20, 0, hot), (20, 1, hot)]
    rows += [(30, None, hot), (40, 1, None), (50, 1, [*hot[1:], None]), (60, 1, [*hot[1:], math.nan]), (70, 2, [*hot[1:], math.inf]), (80, 1, []), (81, 1, []), (82, 2, [])]
    rows += [(90 + i, i % 2, [1.0, 2.0]) for i in range(15)]
    return rows


@pytest.mark.parametrize(("seed", "bits", "few", "block", "scale"), [(1, 6, 64, (2048, 8192), 256), (2, 3, 1, (10, 70), 256), (3, 2, 0, (100, 100), 7)])
def test_all_scores(spark, seed, bits, few, block, scale):
    rows = _rows(seed, 6, 150)
    docs = spark.createDataFrame([(*r, 1, "a", 2, 3) for r in rows], SCHEMA)
    for positives, negatives, low, high in ((5, 10, 30, 90), (2, 3, 0, 100)):
        got = hard_negatives.hard_negatives(docs, F.col("vec_id") % 10 == 0, positives, negatives, low, high, scale, bits, few, block).collect()
        want = _plain(rows, scale, positives, negatives, low, high, 10)
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and len(want) > 50


def test_large_numbers(spark):
    rows = [(i, i % 2, [(-1.0) ** (i % 5) * 10.0 ** (i % 11), float(i)]) for i in range(60)] + [(100, 0, [1e300, 1.0]), (101, 0, [1e9, 1e9]), (102, 1, [9e8, 3e8])]
    docs = spark.createDataFrame([(*r, 1, "a", 2, 3) for r in rows], SCHEMA)
    got = hard_negatives.hard_negatives(docs, F.col("vec_id") % 5 == 0, few=2).collect()
    want = _plain(rows, 256, 5, 10, 30, 90, 5)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and want


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hard_negatives.hard_negatives(empty, F.col("vec_id") % 10 == 0).count() == 0
    one = spark.createDataFrame([(10, 1, [1.0], 1, "a", 2, 3)], SCHEMA)
    assert hard_negatives.hard_negatives(one, F.col("vec_id") % 10 == 0).count() == 0
