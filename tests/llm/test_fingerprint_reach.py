"""Offers left out for their price: the same fingerprints whatever the reach, and few offers left of a long text."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_operators import ODD, SPLIT, make, plain_sample, seeds

from traceloom.llm import fingerprints
from traceloom.llm.common import Workspace


def texts():
    rng = random.Random(4)
    mixed = [" ".join(f"w{min(int(rng.paretovariate(0.8)), 90)}" for _ in range(n)) for n in (3, 40, 300)]
    return ODD + mixed + ["x" * 3000 + " a b c d e f g", "one", " \t\n "]


@pytest.mark.parametrize("reach", [1e-9, 2.0, fingerprints.REACH])
def test_same_fingerprints_for_any_reach(spark, reach):
    whole = [t or "" for t in texts()]
    rows = {r.doc_id: r for r in fingerprints.fingerprint(make(spark, texts()), reach=reach).collect()}
    assert sorted(rows) == list(range(len(whole)))
    for i, t in enumerate(whole):
        m = len(t) // 3
        for text, shown in ((t, rows[i].fingerprint), (t[: len(t) - m] + whole[i - 1][:m], rows[i].edited_fingerprint)):
            bag = Counter(SPLIT.findall(text))
            assert shown == "".join(f"{plain_sample(bag, s):08x}" for s in seeds(fingerprints.COORDINATES) if bag)


def test_few_offers_of_a_long_text_take_logarithms(spark):
    """Of 64 offers a word; all of them were priced before."""
    long_text = " ".join(f"w{i}" for i in range(3000))
    with Workspace(spark, "reach") as work:
        counts = fingerprints.weights(fingerprints.edited_texts(make(spark, [long_text]), work)).cache()
        words = counts.count()
        near = fingerprints.near_offers(counts, 64, fingerprints.REACH)
        assert 64 * 5 < near.count() < 0.05 * 64 * words
        assert near.select(F.countDistinct("coordinate")).first()[0] == 64
        assert fingerprints.near_offers(counts, 64, None).count() == 64 * words
        counts.unpersist()
