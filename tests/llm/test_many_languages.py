"""Language ID and the pipeline's threshold with more languages than the network was first sized for."""

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from traceloom.llm import langid

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def texts_of(language, n):
    """Words of two letters that only this language joins."""
    a, b = LETTERS[language % 26], LETTERS[(language % 26 + 1 + language // 26 * 5) % 26]
    return [" ".join([a + b] * (40 + i % 3)) for i in range(n)]


@pytest.fixture(scope="module")
def many(spark):
    # the 65th and later languages are the rarest; the last one's documents have no id
    rows = [(None if x == 69 else 100 * x + i, t, f"l{x:02}") for x in range(70) for i, t in enumerate(texts_of(x, 12 if x < 64 else 6))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_every_language_is_learned(many):
    network = langid.fit(many)
    assert network.languages == [f"l{x:02}" for x in range(70)]
    told = langid.predict(many, network).groupBy((F.col("lang") >= "l64").alias("late")).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right")).collect()
    assert len(told) == 2 and all(r.right > 0.9 for r in told)


def test_languages_share_the_sample(many, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_ALL", 150)
    languages, windows, answers = langid.sample_windows(many)
    assert len(languages) == 70 and {*answers.tolist()} == {*range(70)}
    assert np.bincount(answers).max() <= 2 * 3


@pytest.mark.parametrize("languages", [1, 2, 3, 4, 64, 500])
def test_threshold_is_near_a_guess(languages):
    least = corpus_pipeline.least_score(languages)
    assert least < 1 and (languages == 1 or 1 / languages < least <= 1.5 / languages)
    assert languages != 4 or least == pytest.approx(0.3)
