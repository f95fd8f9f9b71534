from __future__ import annotations

from foretide.llm import lm


def test_tasks_learn_from_all_positions(spark, monkeypatch):
    """What the averaged parameters are weighted by is every word and end of every text."""
    texts = spark.createDataFrame([(" ".join(f"w{i * k % 17}" for k in range(i % 90)),) for i in range(400)], "text string").repartition(3)
    seen, averaged = [], lm.averaged

    def kept(network, parts):
        seen.append(sum(r.seen for r in parts.select("member", "seen").distinct().collect()))
        averaged(network, parts)

    monkeypatch.setattr(lm, "averaged", kept)
    model = lm.learn(texts, sample=500)
    assert seen == [model.tokens] == [400 + sum(i % 90 for i in range(400))]
