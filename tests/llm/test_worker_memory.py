"""What a Python worker of the pipeline holds: nothing between texts in packing, no steps of training in the tagger, a text once in language ID."""

from __future__ import annotations

import random
import string
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from foretide.llm import language_id, packing, pii


def test_packing_keeps_no_words(monkeypatch):
    class Task:
        get = classmethod(lambda cls: cls())
        partitionId = staticmethod(lambda: 0)  # noqa: N815

    monkeypatch.setattr(packing, "TaskContext", Task)
    run = packing._pieces(public_tokenizers.path(packing.VOCABULARY), None, packing.END, packing.SEQUENCE)
    rng = random.Random(6)
    batch = lambda n: pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([" ".join("".join(rng.choices(string.ascii_lowercase, k=9)) for _ in range(100)) for _ in range(n)])], ["doc_id", "text"])
    assert sum(b.num_rows for b in run(iter([batch(1)]))) == 1  # the tables are read
    texts = batch(500)
    tracemalloc.start()
    try:
        assert len({d for b in run(iter([texts])) for d in b.column(0).to_pylist()}) == 500
        assert tracemalloc.get_traced_memory()[0] < 1_000_000
    finally:
        tracemalloc.stop()


def test_scores_keep_no_steps():
    tagger = pii.Tagger.fresh(np.random.default_rng(1), pii.HIDDEN)
    chars = pii.codes("call 0171 555 0199 or write to a at b dot com " * 800)
    want = tagger.forward(chars[None, : pii.WINDOW])[0][0, :20]
    tracemalloc.start()
    try:
        scores = pii._scores(tagger, [(chars, 0, len(chars))])[0]
        assert tracemalloc.get_traced_memory()[1] < 30_000_000
    finally:
        tracemalloc.stop()
    assert np.allclose(scores[:20], want, atol=1e-5)


@pytest.mark.parametrize("name", ["text", "Text"])
def test_language_reads_a_text_once(spark, monkeypatch, name):
    texts = [None if i % 50 == 0 else f"{'some' if i % 2 else 'other'} words {i}" for i in range(600)]
    docs = spark.createDataFrame([*enumerate(texts)], f"doc_id long, {name} string")
    seen, plain = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *a, **b: seen.append((self.columns, f)) or plain(self, f, *a, **b))
    found = language_id.identify(docs, [("a", b"some words some words"), ("b", b"other words other words")])
    (columns, run), want = seen[0], {i: "und" if t is None else "a" if "some" in t else "b" for i, t in enumerate(texts)}
    assert columns == ["row"]
    assert {r.row.doc_id: r.lang_pred for r in found.collect()} == want
    rows = pa.StructArray.from_arrays([pa.array(range(600)), pa.array(texts)], ["doc_id", name]).slice(3)
    batches = list(run(iter([pa.RecordBatch.from_arrays([rows], ["row"])])))
    assert max(b.num_rows for b in batches) <= 256
    assert [r for b in batches for r in b.column(0).to_pylist()] == rows.to_pylist()
    assert [x for b in batches for x in b.column(1).to_pylist()] == [want[i] for i in range(3, 600)]
