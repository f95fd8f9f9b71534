"""MinHash near-dedup against all pairs of sets: families, frequent passages, short and odd texts."""

from __future__ import annotations

import random

import numpy as np
import pytest

from foretide.llm import minhash
from tests.llm.test_operators import ODD, SCHEMA


def _set(text, k):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def _components(rows, k=4, similarity=80):
    """(doc_id, n, component_id, kept) of each row, by all pairs of sets."""
    sets = [_set(t, k) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= similarity * len(a | sets[j]):
                label[root(i)] = root(j)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        low.setdefault(root(i), []).append(doc_id)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [x for x in low[root(i)] if x is not None]
        c = min(ids) if ids and sets[i] else doc_id if not sets[i] else None
        out.append((doc_id, len(sets[i]), c, doc_id == c))
    return out


def _corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 7)))
    words = lambda n: [word() for _ in range(n)]
    texts, passage = [], words(40)
    texts += [" ".join(words(rng.randint(5, 30)) + passage + words(rng.randint(5, 30))) for _ in range(40)]  # a frequent passage, alike by less
    texts += [" ".join(passage + words(rng.randint(2, 14))) for _ in range(25)]  # around the similarity itself
    for size in (30, 12, 3):  # copies of one original, alike to it and less to each other
        original = words(rng.randint(60, 120))
        texts.append(" ".join(original))
        for _ in range(size):
            copy = list(original)
            for _ in range(rng.randint(1, 4)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    chain = words(60)
    texts += [" ".join(chain[i : i + 30]) for i in range(0, 30, 2)]  # each like the next one
    texts += [" ".join(words(n)) for n in (1, 2, 3, 4, 5, 6)] + ["one two", "One  TWO", "one two\n", "a b c d e f g h i", "a b c d e f g h", "b c d e f g h i"]
    rng.shuffle(texts)
    return [(3 * i + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "block"), [(1, 1 << 23), (2, 4000), (3, 9000)])
def test_all_pairs(spark, seed, block):
    rows = _corpus(seed)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()
    want = _components(rows)
    assert sorted(map(tuple, got)) == sorted(want)
    assert 0 < sum(not w[3] for w in want) < len(want) - 60


def test_other_shingles_and_similarity(spark):
    rows = _corpus(4)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2, similarity=60, rows=2).collect()
    assert sorted(map(tuple, got)) == sorted(_components(rows, 2, 60))


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, None, None, None, 1, "k", "h", 3) for i, t in ODD], SCHEMA)
    got = minhash.near_duplicates(docs).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, _components(ODD)))
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_bins_of_short_sets():
    """Bins of small sets agree with a chance of the similarity; every bin holds a hash of the set."""
    rng = np.random.default_rng(1)
    for n, common in ((1, 1), (5, 4), (10, 8), (200, 160)):
        shares = []
        for _ in range(60):
            x = np.unique(rng.integers(0, 2**64, 2 * n - common, np.uint64))
            rng.shuffle(x)
            a, b = np.sort(x[:n]), np.sort(x[n - common :])
            u, v = minhash.bins_of(a), minhash.bins_of(b)
            assert set(u.tolist()) <= set(a.tolist()) and set(v.tolist()) <= set(b.tolist())
            shares.append((u == v).mean())
        assert abs(np.mean(shares) - common / (2 * n - common)) < 0.05
