"""Baum-Welch over whole texts: the counts against plain recursions, and passes until the likelihood settles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceloom.llm import hmm


def plain(m, x, classes):
    """Starts, transitions, emissions and log likelihood of one sequence by unscaled sums over all of it."""
    k, n = len(m.start), len(x)
    alpha, beta, told = np.zeros((n, k)), np.ones((n, k)), 0.0
    for t in range(n):
        alpha[t] = (m.start if t == 0 else alpha[t - 1] @ m.step) * m.emit[x[t]]
        told += np.log(alpha[t].sum())
        alpha[t] /= alpha[t].sum()
    for t in range(n - 2, -1, -1):
        beta[t] = m.step @ (m.emit[x[t + 1]] * beta[t + 1])
        beta[t] /= beta[t].sum()
    gamma = alpha * beta
    gamma /= gamma.sum(1, keepdims=True)
    steps, emits = np.zeros((k, k)), np.zeros((classes, k))
    for t in range(n - 1):
        both = alpha[t][:, None] * m.step * (m.emit[x[t + 1]] * beta[t + 1])[None]
        steps += both / both.sum()
    np.add.at(emits, x, gamma)
    return gamma[0], steps, emits, told


@pytest.mark.parametrize("chunk", [1 << 18, 1000, 150, 7])
def test_whole_counts_equal_plain_ones(monkeypatch, chunk):
    monkeypatch.setattr(hmm, "CHUNK", chunk)
    rng = np.random.default_rng(4)
    m = hmm.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(9), 3).T)
    lengths = np.array([1, 5, 700, 64, 65, 64, 130, 2, 300])
    ids = rng.integers(0, 9, lengths.sum()).astype(np.int32)
    parts = [plain(m, x, 9) for x in np.split(ids, np.cumsum(lengths)[:-1])]
    got = hmm.expected_counts(m, ids, lengths, 9)
    for a, b in zip(got, map(sum, zip(*parts, strict=True)), strict=True):
        assert a == pytest.approx(b)
    assert got[1].sum() == pytest.approx(len(ids) - len(lengths))


def test_training_settles_on_whole_texts(spark):
    # what follows the first 20,000 bytes alternates between two vocabularies; nothing before it does
    tail = " ".join(" ".join(f"{'ab'[i % 2]}{j}" for j in range(40)) for i in range(40))
    texts = [("same " * 4100 + tail).encode() for _ in range(4)]
    rows = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)], "pick long, text binary")
    counts = hmm.count_words(rows)
    words = hmm.vocabulary(counts)
    sample = hmm.first_texts(rows, 4)
    assert sample == texts
    model = hmm.train(rows, words, states=3, passes=100)
    better, told = hmm.training_pass(rows, words, model)
    _, after = hmm.training_pass(rows, words, better)
    assert after - told <= 2 * hmm.SETTLED * abs(told)
    assert rows.where(F.length("text") > 20_000).count() == 4
