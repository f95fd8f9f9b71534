from __future__ import annotations

import random
import string

from foretide.llm import simhash


def test_no_pair_at_the_threshold_is_left_out(spark):
    """Pairs whose shingles have a similarity of 86 / 106, about 0.81: fingerprints met 0.82 of such."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices(string.ascii_lowercase, k=6))
    rows = []
    for i in range(200):
        one = [word() for _ in range(100)]
        other = list(one)
        other[rng.randint(10, 40)], other[rng.randint(60, 90)] = word(), word()
        rows += [(2 * i, " ".join(one)), (2 * i + 1, " ".join(other))]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i in range(200) if got[2 * i] != got[2 * i + 1]] == [] and len(set(got.values())) == 200
