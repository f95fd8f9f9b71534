"""What a position costs op2_lm_scoring: words are cut and looked up for many texts at once, and neighbours share what a step reads."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from foretide.llm import lm

ODD = ["", " ", "A", "\tAé\x0b\x0c b\x85c D\r\n", "end ", " x", "", "İI \x1c\x1f I", "日本 ÄB", "a" * 300, "é", "\x00 Z\x00"]


def _plain(text: str) -> list[bytes]:
    return [re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(rb"[^\x20\x09-\x0D]+", text.encode())]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_words_of_many_texts(kind):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choices("aB \n\x0bé", k=rng.randint(0, 12))) for _ in range(500)]
    for column in (pa.array(texts, kind), pa.array(["left", *texts, "out"], kind).slice(1, len(texts)), pa.array(["", ""], kind), pa.array([], kind)):
        words, n = lm.words_in(column)
        each = [_plain(t) for t in column.to_pylist()]
        assert words.to_pylist() == [w for own in each for w in own] and n.tolist() == [len(own) for own in each]


def test_symbols_of_many_words():
    words = [w for t in ODD for w in _plain(t)] * 2
    symbols = lm.Symbols({w: i + 1 for i, w in enumerate(dict.fromkeys(words[::3]))})
    found = symbols.of(pa.array(words, pa.binary()), pa.array(list(symbols.own), pa.binary()))
    assert found.tolist() == [symbols.own.get(w) or symbols.word_class(w) for w in words]
    assert symbols.of(pa.array([], pa.binary()), pa.array([], pa.binary())).tolist() == []


def _texts() -> tuple[lm.Symbols, list[pa.RecordBatch]]:
    rng = random.Random(5)
    texts = [" ".join(f"w{int(rng.expovariate(0.1))}" for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["", ""]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[a : a + 70])], ["text"]) for a in range(0, len(texts), 70)]
    return lm.Symbols({b"w%d" % i: i + 1 for i in range(12)}), batches


def test_minibatches_of_texts_as_they_stand(monkeypatch):
    """They hold the windows of all positions, in order, whatever the pieces are, and their slopes are those of the windows."""
    symbols, batches = _texts()
    want = list(lm._minibatches(lm._windows(symbols, 1.0, 2, iter(batches)), 256))
    network = lm.Network(np.arange(symbols.size, 0, -1.0), size=6)
    for together in (lm.TOGETHER, 300, 1):
        monkeypatch.setattr(lm._pieces, "__defaults__", (together,))
        got = list(lm._stretches(symbols, iter(batches), 256))
        assert [len(follows) for _, follows in got] == [len(w) for w in want]
        for (line, follows), windows in zip(got, want, strict=True):
            assert (line[follows[:, None] - [*range(1, lm.CONTEXT + 1), 0]] == windows).all()
            a = {k: v.copy() for k, v in network.gradient((line, follows), np.random.default_rng(7)).items()}
            b = network.gradient(windows, np.random.default_rng(7))
            assert all(np.allclose(a[k], v, atol=1e-6) for k, v in b.items())


def test_neighbours_share_their_contexts(monkeypatch):
    """A step of a task reads a vector for each word, not for each word of each context."""
    symbols, batches = _texts()
    network, read, rows = lm.Network(np.arange(symbols.size, 0, -1.0), size=6), [], lm.Network._rows

    def counted(self, name, of, which):
        read.append(len(which) if of is self.p["word"] else 0)
        return rows(self, name, of, which)

    monkeypatch.setattr(lm.Network, "_rows", counted)
    steps = list(lm._stretches(symbols, iter(batches), 1024))
    network.train(iter(steps), 0.1, 1)
    n, texts = sum(len(follows) for _, follows in steps), sum(b.num_rows for b in batches)
    assert n < sum(read) <= n + lm.CONTEXT * (texts + len(steps))
