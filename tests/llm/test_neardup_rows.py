"""Near-duplicates where ids repeat with different texts or are null, and the pipeline's drop by row."""

import corpus_pipeline
import pytest

from traceloom.llm import neardup


def words(name, n, start=0):
    return [f"{name}{i}" for i in range(start, start + n)]


A = words("a", 101)
NEAR = " ".join([*A[:-1], "edit"])
OWN = " ".join(words("own", 1001))
LONE = words("null", 80)
ROWS = [
    (3, " ".join(A)), (5, NEAR), (5, OWN), (9, OWN + " more"), (5, None),
    (None, " ".join([*A[1:], "x"])), (None, " ".join(LONE)), (None, " ".join([*LONE[:-1], "y"])), (None, " ".join(words("other", 50))), (None, ""), (None, None),
    (7, "one two three four five"), (7, "one two three four five"), (8, ""), (None, "six seven eight nine"), (None, "six seven eight nine"),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(*r, f"s{i}") for i, r in enumerate(ROWS)], "doc_id long, text string, source string").repartition(3)


def test_an_id_with_several_texts_links_them(rows):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(rows, width=2).collect()]
    want = [
        (3, 100, 3, True), (5, 100, 3, False), (5, 1000, 3, False), (9, 1001, 3, False), (5, 0, 3, False), (None, 100, 3, False),
        (None, 79, None, True), (None, 79, None, False), (None, 49, None, True), (None, 0, None, True), (None, 0, None, True),
        (7, 4, 7, True), (7, 4, 7, True), (8, 0, 8, True), (None, 3, None, True), (None, 3, None, False),
    ]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_the_pipeline_drops_by_row(spark, rows):
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, rows, "").collect()]
    lone = [(i, t) for i, t in got if t and t.startswith("null")]
    assert len(lone) == 1 and lone[0] in ROWS
    got.remove(lone[0])
    want = [ROWS[0], (5, OWN), (5, None), (None, " ".join(words("other", 50))), (None, ""), (None, None), ROWS[11], (8, ""), ROWS[14]]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert corpus_pipeline.drop_near_duplicates(spark, rows.limit(0), "").count() == 0
