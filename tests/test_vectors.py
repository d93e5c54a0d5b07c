"""The inverted file against the exact search."""

import numpy as np
import pytest

from traceloom.operators import vectors
from traceloom.plans import registry

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, asked, top):
    ids, x = [i for i, _ in rows], np.array([v if v else [0.0] * 8 for _, v in rows], np.float64)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
    found = {}
    for i, q in zip(ids, x, strict=True):
        if i in asked:
            told = sorted((-round(float(q @ v), 12), j) for j, v in zip(ids, x, strict=True) if j != i)[:top]
            found[i] = [(j, -c) for c, j in told]
    return found


def shown(df):
    out = {}
    for r in df.orderBy("query", "rank").collect():
        out.setdefault(r.query, []).append((r.vec_id, r.cosine))
    return out


@pytest.mark.parametrize("block", [vectors.BLOCK, 7])
def test_all_probes_are_the_exact_search(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(150)] + [(200 + i, [1.0] + [0.0] * 7) for i in range(40)] + [(300, None), (301, [0.0] * 8)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = shown(vectors.nearest(df, df.where("vec_id % 20 = 0"), 5, cells=6, probes=6))
    want = plain(rows, {i for i, _ in rows if i % 20 == 0}, 5)
    assert {q: [j for j, _ in r] for q, r in got.items()} == {q: [j for j, _ in r] for q, r in want.items()}
    for q, r in got.items():
        assert [c for _, c in r] == pytest.approx([c for _, c in want[q]])


def test_no_vectors(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert vectors.nearest(df, df).count() == 0


def test_recall_on_the_table(spark, sf_dir):
    got = shown(registry.queries()["embedding_cosine_topk"](spark, sf_dir))
    rows, asked = __import__("traceloom.plans.texts", fromlist=["x"]).asked_vectors(spark, sf_dir)
    exact = shown(vectors.nearest(rows, asked, 10, cells=8, probes=8))
    hits = [len({j for j, _ in got[q]} & {j for j, _ in r}) / len(r) for q, r in exact.items()]
    assert len(exact) == rows.where("vec_id % 20 = 0").count() and sum(hits) / len(hits) >= 0.9
