"""Packing, periods and collocations against plain forms."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from traceloom.llm import collocations, packing, periods, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def make(spark, texts, langs=None):
    rows = [(i, t, langs[i] if langs else "en", "s", 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("length", "part", "f", "n", "times", "runs", "best", "offset"):
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3)


def sample(sf_dir):
    import pyarrow.parquet as pq

    return pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()


# packing


def best_fit(histogram, capacity):
    """Sequences that best fit, longest first, opens piece by piece."""
    rooms, opened = [], 0
    for length in sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True):
        fits = [r for r in rooms if r >= length]
        if fits:
            rooms.remove(min(fits))
        else:
            opened += 1
        rooms.append((min(fits) if fits else capacity) - length)
    return opened


def test_plan_is_best_fit_piece_by_piece():
    rng = random.Random(3)
    for _ in range(60):
        capacity, histogram = rng.choice([5, 16, 64]), Counter()
        for _ in range(rng.randint(0, 40)):
            histogram[rng.randint(1, capacity)] += rng.randint(1, 9)
        filled, ranks = defaultdict(list), Counter()
        for length, low, count, sequence, copies, at in packing.plan(histogram, capacity):
            assert low == ranks[length] and count % copies == 0
            ranks[length] += count
            for k in range(count):
                filled[sequence + k // copies].append((at + k % copies * length, length))
        assert ranks == histogram and len(filled) == best_fit(histogram, capacity)
        for places in filled.values():
            ends = np.cumsum([0] + [n for _, n in sorted(places)])
            assert [a for a, _ in sorted(places)] == ends[:-1].tolist() and ends[-1] <= capacity


def test_plan_grows_with_lengths_and_not_with_documents():
    few, many = ({n: k * (1 + n % 7) for n in range(1, 1025)} for k in (10, 10**9))
    assert len(packing.plan(many)) < 4 * 1024 and len(packing.plan(few)) < 4 * 1024


def check_packing(rows, texts, capacity, tokenizer):
    pieces, filled = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        filled[r.sequence_id].append((r.offset, r.length))
    for i, text in texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END]
        parts = sorted(pieces.pop(i), key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(-(-len(ids) // capacity)))
        at = 0
        for r in parts:
            assert r.start == at and r.length == (capacity if r.piece or len(ids) % capacity == 0 else len(ids) % capacity)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert not pieces
    for places in filled.values():
        ends = np.cumsum([0] + [n for _, n in sorted(places)])
        assert [a for a, _ in sorted(places)] == ends[:-1].tolist() and ends[-1] <= capacity
    return len(filled), sum(r.length for r in rows)


def test_packing_of_the_table(spark, sf_dir):
    from tokenizers import Tokenizer

    rows = queries.op11_packing(spark, sf_dir).collect()
    opened, tokens = check_packing(rows, {r["doc_id"]: r["text"] for r in sample(sf_dir)}, 1024, Tokenizer.from_file(TOKENIZER))
    assert opened == best_fit(Counter(r.length for r in rows), 1024) and opened <= 1.02 * tokens / 1024 + 1


def test_packing_of_odd_texts(spark):
    from tokenizers import Tokenizer

    texts = [None, "", " ", "a", "a", "x<|endoftext|>y", "é 中😀\x00", "word " * 5000, "z" * 9000, " " * 120000, "\n" * 300, "don't we'll  go\t\n "]
    docs = make(spark, texts)
    rows = packing.pack(docs, TOKENIZER, 64, with_ids=True).collect()
    check_packing(rows, dict(enumerate(texts)), 64, Tokenizer.from_file(TOKENIZER))
    whole = packing.sequences(packing.pack(docs, TOKENIZER, 64, with_ids=True)).collect()
    assert sum(len(s.input_ids) for s in whole) == sum(r.length for r in rows) and max(len(s.input_ids) for s in whole) <= 64
    by_place = {(r.sequence_id, r.offset): r.input_ids for r in packing.pack(docs, TOKENIZER, 64, with_ids=True).collect()}
    assert len(by_place) == len(rows)
    assert packing.pack(docs.limit(0), TOKENIZER).count() == 0
    twice = docs.union(docs.where("doc_id = 7")).union(docs.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))
    assert packing.pack(twice, TOKENIZER).count() == packing.pack(docs, TOKENIZER).count() + packing.pack(docs.where("doc_id in (3, 7)"), TOKENIZER).count()


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    fast, library, rng = packing.Encoder(TOKENIZER), Tokenizer.from_file(TOKENIZER), random.Random(5)
    letters = [*"abc's're 've  \n\n\t\r1234567890.,;-_<|>éüñ中文😀\x00\x85\xa0 'ªⅫ", "<|endoftext|>", "'ll", " the"]
    assert fast.fast is not None
    for _ in range(3000):
        text = "".join(rng.choices(letters, k=rng.randint(0, 40)))
        assert fast.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


# periods


def plain_runs(words, least):
    """Every stretch that a period keeps, extended word by word; of equal stretches the least period."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > start and i - start + q >= max(least, 2 * q):
                found.setdefault((start, i - start + q), q)
            i += i == start
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least", [2, 3, 5, 12])
def test_runs_equal_plain_ones(least):
    rng = random.Random(least)
    for _ in range(200):
        texts = []
        for _ in range(rng.randint(1, 4)):
            n, letters = rng.randint(0, 70), rng.choice([1, 2, 2, 3, 8])
            words = [rng.randrange(letters) for _ in range(n)]
            if rng.random() < 0.5 and n > 3:
                a, q = rng.randrange(n), rng.randint(1, 12)
                words = [words[i] if i < a else words[a + (i - a) % min(q, n - a)] for i in range(n)]
                words[rng.randrange(n)] = rng.choice([0, 99])
            texts.append(words)
        bounds = np.cumsum([0, *map(len, texts)])
        got = periods.find_runs(np.array([w for t in texts for w in t], np.int32), bounds, least)
        assert [got.get(i, []) for i in range(len(texts))] == [plain_runs(t, least) for t in texts]


def test_runs_of_long_texts():
    a, b = [0], [0, 1]
    while len(b) < 3000:
        a, b = b, b + a
    assert periods.find_runs(np.array(b, np.int32), np.array([0, len(b)]))[0] == plain_runs(b, 12)
    assert periods.find_runs(np.zeros(200_000, np.int32), np.array([0, 200_000])) == {0: [(0, 200_000, 1)]}


def plain_report(i, text, least=12):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(i).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words, least)
    dropped = {x for s, m, q in runs for x in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    told = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = " ".join(w for x, w in enumerate(words) if x not in dropped)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(told), sha(kept))


def test_periods_of_the_table(spark, sf_dir):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_periods(spark, sf_dir).collect()}
    rows = [r for r in sample(sf_dir) if len(r["text"] or "") < 8000]
    assert len(rows) > 150 and any(got[r["doc_id"]][0] for r in rows)
    for r in rows:
        assert got[r["doc_id"]] == plain_report(r["doc_id"], r["text"])


def test_periods_of_odd_texts(spark):
    texts = [None, "", " \t ", "a", "a b " * 20, "A b\x0ba b " * 7, "word " * 3000, " ".join("xyz"[i % 3] if i % 40 else f"w{i}" for i in range(400)), "ü\xa0ü " * 12 + "c", "same " * 11, "same " * 12]
    docs = make(spark, texts)
    rows = {r.doc_id: r for r in periods.collapse(docs).collect()}
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        assert rows[i].n_words == len(words) and [tuple(r) for r in rows[i].runs] == plain_runs(words[:400], 12) or i == 6
    assert [tuple(r) for r in rows[6].runs] == [(0, 3000, 1)] and rows[6].collapsed == "word"
    assert rows[9].runs == [] and rows[10].collapsed == "same"
    assert periods.report(periods.collapse(docs.limit(0))).count() == 0
    odd = docs.union(docs.where("doc_id = 4")).union(docs.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))
    assert periods.report(periods.collapse(odd)).count() == len(texts) + 2


def test_planted_words(spark):
    texts = ["one two  three\tfour five six seven eight nine ten " * (1 + i % 5) for i in range(60)] + ["", "  ", "x"]
    docs = make(spark, texts)
    for r in periods.report(periods.collapse(docs.withColumn("text", periods.planted(F.col("doc_id"), F.col("text"))))).collect():
        assert tuple(r)[1:] == plain_report(r.doc_id, texts[r.doc_id])


# collocations


def plain_collocations(rows, least, longest, top):
    counts, sizes = Counter(), Counter()
    for lang, text in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang or "und", tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    candidates = {k: n for k, n in counts.items() if len(k[1]) > 1 and n >= least}
    inside = {(lang, w[i : i + k]) for (lang, w), n in candidates.items() for k in range(2, len(w)) for i in range(len(w) - k + 1) if n >= candidates[lang, w[i : i + k]]}
    found = defaultdict(list)
    for (lang, w), a in candidates.items():
        if (lang, w) not in inside:
            f, n = (lambda x, lang=lang: counts[lang, x]), sizes[lang]
            score, k = min((1000 * a * n // (f(w[:k]) * f(w[k:])), k) for k in range(1, len(w)))
            found[lang].append((-score, -a, " ".join(w).encode(), f(w[:k]), f(w[k:])))
    return {(lang, i + 1, w.decode(), -a, x, y, sizes[lang], -s) for lang, told in found.items() for i, (s, a, w, x, y) in enumerate(sorted(told)[:top])}


def shown(df):
    return {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


@pytest.mark.parametrize("cut, bits", [(collocations.CUT, collocations.FILTER_BITS), ((1, 3, 2), 1 << 16)])
def test_collocations_equal_plain_ones(spark, monkeypatch, cut, bits):
    monkeypatch.setattr(collocations, "FILTER_BITS", bits)
    rng = random.Random(2)
    vocabulary = [*"abcdefgh", "É", "Üb", "new", "New", "york", "times\t", "x.y", "z\x0b", "w:", "a\xa0b"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 120))) for _ in range(80)] + ["to be or not to be " * 30, "same " * 500, None, "", " ; ,, ", "In THE end, in the end. " * 9]
    langs = [rng.choice(["en", "fr", None, "und"]) for _ in texts]
    for least, longest, top in ((4, 5, 2000), (10, 3, 5), (1, 2, 40)):
        got = shown(collocations.collocations(make(spark, texts, langs), least, longest, top, cut))
        assert got == plain_collocations(zip(langs, texts, strict=True), least, longest, top) and got


def test_chunks_own_every_word_once():
    rng = random.Random(4)
    for _ in range(300):
        words = [rng.choice([b"a", b"b", b"c", b"dd"]) for _ in range(rng.randint(1, 90))]
        owned = [(c.split(b" "), n) for c, n in collocations.chunks(words, 5, rng.randint(1, 6), rng.randint(6, 12), rng.randint(1, 9))]
        at = 0
        for held, n in owned:
            assert held == words[at : at + len(held)] and (len(held) == n + 4 or at + n == len(words))
            at += n
        assert at == len(words)


def test_collocations_of_nothing(spark):
    docs = make(spark, ["a b c", None])
    assert collocations.collocations(docs).count() == 0
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_exact_scores_beyond_64_bits(spark):
    big = 3_000_000_000_000_000
    frequent = spark.createDataFrame([("en", "a b", big - 7), ("en", "a", big - 5), ("en", "b", big - 3)], "lang string, phrase string, f long")
    sizes = spark.createDataFrame([("en", 7 * big)], "lang string, n long")
    (r,) = collocations.scored(frequent, sizes).collect()
    assert r.score == 1000 * (big - 7) * 7 * big // ((big - 5) * (big - 3))


def test_tasks_give_pair_counts_away_early(spark, monkeypatch):
    monkeypatch.setattr(collocations, "HELD", 16)
    texts = [" ".join(random.Random(i).choices("abcdefghijkl", k=60)) for i in range(40)]
    got = shown(collocations.collocations(make(spark, texts), 5, 4, 100))
    assert got == plain_collocations([("en", t) for t in texts], 5, 4, 100)
