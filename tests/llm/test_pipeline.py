"""The pipeline and its stages against plain forms, and on odd tables."""

import hashlib
import math
import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_operators import plain_components, plain_taken

from traceloom.llm import langid, secrets
from traceloom.llm.common import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    """Two languages with alphabets of their own, near copies, secrets and junk."""
    rng = random.Random(8)
    words = {x: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(60)] for x, letters in (("aa", "abcdef"), ("zz", "uvwxyz"))}
    rows = []
    for i in range(40):
        lang = ("aa", "zz")[i % 2]
        rows.append((i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(20, 120))), lang, f"s{i % 3}"))
    for i in range(8):
        text = rows[3 * i][1].split()
        text[len(text) // 2] = "bad"
        rows.append((100 + i, " ".join(text), rows[3 * i][2], "s1"))
    rows += [(200, rows[0][1] + " password=abcdef1234 " + "0123456789abcdef" * 3, "aa", None), (201, "12345 !!", "aa", "s0"), (202, None, None, "s0"), (203, "", "zz", "s2"), (204, rows[5][1], "zz", "s2")]
    return [(i, t, x, s, len(t or "")) for i, t, x, s in rows]


def plain_prediction(network, text):
    """(language, score) of a text, one byte after another."""
    if text is None or not any(map(str.isalpha, text)):
        return "und", 0.0
    data = text.encode().lower()
    data = data.ljust(max(1, math.ceil(len(data) / langid.WINDOW)) * langid.WINDOW)
    pooled = np.zeros(len(network.languages))
    for low in range(0, len(data), langid.WINDOW):
        window = data[low : low + langid.WINDOW]
        logits = [network.bias.astype(float).copy() for _ in window]
        for d, order in zip(network.directions, (range(len(window)), reversed(range(len(window)))), strict=True):
            k = d.back.shape[1]
            state = np.zeros(k)
            for t in order:
                taken, pre = d.table[:, window[t]], d.back @ state
                update, opened = (np.tanh(taken[: 2 * k] + pre[: 2 * k]) / 2 + 0.5).reshape(2, k)
                new = np.tanh(opened * pre[2 * k :] + taken[2 * k :])
                state = new + update * (state - new)
                logits[t] += d.label @ state
        for t, byte in enumerate(window):
            if 97 <= byte <= 122 or byte >= 128:
                chance = np.exp(logits[t] - logits[t].max())
                pooled += chance / chance.sum()
    return network.languages[int(pooled.argmax())], pooled.max() / max(1, pooled.sum())


def plain_redaction(text):
    spans = []
    for r in secrets.RULES:
        spans += [m.span() for m in re.finditer(r.pattern, text or "") if len(m[r.group]) >= r.least]
    at, out = 0, ""
    for a, b in sorted(spans):
        if a >= at:
            out += text[at:a] + "[secret]"
        at = max(at, b)
    return out + text[at:] if spans else text


@pytest.fixture
def quick(monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 60)


def test_predictions_equal_plain_ones(spark, quick):
    docs = spark.createDataFrame(corpus(), DOCS)
    network = langid.fit(docs)
    rows = langid.predict(docs.select("doc_id", "text"), network).collect()
    assert len(rows) == len(corpus())
    for r in rows:
        language, score = plain_prediction(network, r.text)
        assert r.score == pytest.approx(score, abs=1e-4)
        assert r.lang_pred == language
    assert {r.lang_pred for r in rows if r.doc_id in (201, 202, 203)} == {"und"}
    marks = spark.createDataFrame([(1, "½ ²"), (2, "Ⅷ 4"), (3, "ª")], "doc_id long, text string")  # categories No, Nl and Lo
    assert [r.lang_pred == "und" for r in langid.predict(marks, network).orderBy("doc_id").collect()] == [True, True, False]


def test_sample_is_bounded_where_rows_repeat(spark, monkeypatch):
    rows = [(None, "same text", "aa", "s", 9)] * 3000 + [(None, f"zz {i}", "zz", "s", 9) for i in range(50)]
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 20)
    texts = langid.sample_texts(spark.createDataFrame(rows, DOCS))
    assert texts["aa"] == [b"same text"] and len(texts["zz"]) == 20
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 10)
    assert {x: len(t) for x, t in langid.sample_texts(spark.createDataFrame(rows, DOCS)).items()} == {"aa": 1, "zz": 1}


def test_pipeline_equals_plain_form(spark, tmp_path, quick):
    import sentencepiece

    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    network = langid.fit(table(spark, str(tmp_path), "documents"))
    least = corpus_pipeline.least_score(len(network.languages))
    told = {i: plain_prediction(network, t) for i, t, *_ in rows}
    kept = [r for r in rows if told[r[0]][0] != "und" and told[r[0]][1] >= least]
    component = plain_components({r[0]: r[1] for r in kept}, 5, 80)
    kept = [(i, plain_redaction(t), s) for i, t, _, s, _ in kept if component[i][1] == i]
    taken = plain_taken(kept, 10**6)
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter()
    for i, t, _ in kept:
        size, *_, words = taken[i]
        ids = model.encode(t, add_eos=True)
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()] += math.floor(words / size + 0.5)
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == +want and len(got) > 20


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, quick, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    base = [(1, "aa bb cc dd ee ff gg", "aa", "s", 20), (1, "aa bb cc dd ee ff gg", "aa", "s", 20), (None, "aa bb cc dd ee ff gg", "aa", None, 20), (None, None, None, None, None), (2, "", "zz", "s", 0), (3, "token=abcdefgh12 zz yy", "zz", "s", 21), (4, "zz yy ww vv " * 4000, "zz", "s", 48000)]
    docs = spark.createDataFrame(base, DOCS)
    for c in ("gone", "times", "mixed_id", "lang_pred", "score", "row", "first", "spans_hex", "size", "taken"):
        docs = docs.withColumn(c, F.lit("clash"))
    out, none = stage(spark, docs, ""), stage(spark, docs.limit(0), "")
    assert none.count() == 0
    if name != "pieces":
        assert out.columns == docs.columns == none.columns
        assert out.where("gone != 'clash' OR taken != 'clash'").count() == 0
    found = Counter(r.doc_id for r in out.collect())
    if name == "near_duplicates":
        assert found == {1: 1, None: 1, 2: 1, 3: 1, 4: 1}
    if name in ("secrets", "pieces"):
        assert found == {1: 2, None: 2, 2: 1, 3: 1, 4: 1}


def test_mixture_is_near_its_targets(spark, sf_dir):
    from traceloom.llm import mixing

    docs = table(spark, sf_dir, "documents")
    target = {r.source: (r.target, r.longest) for r in mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.max("target").alias("target"), F.max("size").alias("longest")).collect()}
    mixed = corpus_pipeline.mix_sources(spark, docs, sf_dir).select("source", mixing.word_count(F.col("text")).alias("n")).groupBy("source").agg(F.sum("n").alias("n")).collect()
    for r in mixed:
        assert abs(r.n - target[r.source][0]) <= 2 * target[r.source][1]
