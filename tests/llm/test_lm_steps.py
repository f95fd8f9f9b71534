"""What tasks go on from: the parameters and what steps have seen, without the arrays that steps write over."""

from __future__ import annotations

import pickle

import numpy as np

from foretide.llm import lm


def test_steps_go_on_in_tasks():
    network = lm.Network(np.arange(40, 0, -1.0), size=5)
    windows = np.random.default_rng(1).integers(0, 40, (600, lm.CONTEXT + 1))
    network.train(iter([windows]), 0.1, 1)
    sent = pickle.loads(pickle.dumps(network))
    assert not sent.room and all((sent.seen[k] == v).all() for k, v in network.seen.items())
    before = sent.flat()
    sent.train(iter([windows]), 0.1, 2)
    assert 0 < np.abs(sent.flat() - before).max() < 0.1  # a first step of its own would be of 0.1


def test_slopes_are_sums_over_positions(monkeypatch):
    """Without noise, slopes of a batch are the mean of its positions' own."""
    network = lm.Network(np.arange(40, 0, -1.0), size=5)
    windows = np.random.default_rng(2).integers(0, 40, (64, lm.CONTEXT + 1))
    monkeypatch.setattr(lm, "_sigmoid", lambda x: np.zeros_like(x))  # all told right are pulled, no noise is pushed
    whole = {k: v.copy() for k, v in network.gradient(windows, np.random.default_rng(3)).items()}
    parts = [{k: v.copy() for k, v in network.gradient(windows[i : i + 1], np.random.default_rng(3)).items()} for i in range(64)]
    for k, v in whole.items():
        assert np.allclose(v, sum(p[k] for p in parts) / 64, atol=1e-6), k
