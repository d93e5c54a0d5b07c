"""Token edit similarity on whole texts, against the plain table."""

import random

import pytest
from pyspark.sql import functions as F

from traceloom.operators import texts
from traceloom.plans import registry


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_edit_distance_equals_the_table():
    rng = random.Random(3)
    draw = lambda n, k: [f"w{rng.randrange(k)}" for _ in range(n)]
    told = [([], []), ([], ["a"]), (["a"], []), (["a", "b"], ["b", "a"])]
    told += [(draw(rng.randrange(150), k), draw(rng.randrange(150), k)) for k in (2, 5, 40) for _ in range(40)]
    told += [(draw(700, 9), draw(640, 9)), (draw(900, 5000), draw(900, 5000))]
    for a, b in told:
        assert texts.edit_distance(a, b) == plain(a, b)


def test_items_that_differ_after_token_500(spark, tmp_path):
    head = [f"t{i % 211}" for i in range(500)]
    told = [head + [f"a{i}" for i in range(100)], head + [f"b{i}" for i in range(300)], head[:490], [], []]
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(told)], "item_id long, text string")
    rows.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.left: r.similarity for r in registry.queries()["token_edit_similarity"](spark, str(tmp_path)).collect()}
    want = {i: 1 - plain(a, b) / max(len(a), len(b)) if a or b else 1.0 for i, (a, b) in enumerate(zip(told, told[1:], strict=False))}
    assert got == pytest.approx(want) and got[0] < 1
    none = spark.createDataFrame([(None, ["a"])], "a array<string>, b array<string>")
    assert none.select(texts.token_edit_similarity(F.col("a"), F.col("b"))).first()[0] is None
