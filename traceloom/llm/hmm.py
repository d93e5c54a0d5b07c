"""Language-model scoring by a hidden Markov model.

A text is a sequence of tokens: its words in ASCII lower case and one end. Hidden
states emit classes of tokens: each frequent word is a class of its own, as is the
end, and the other words fall into classes by their last two bytes. A class emits
its words by their corpus counts. So the tables that tasks hold are bounded by
``LEXICON`` and ``TAILS``, whatever the vocabulary, and the counts of rare words
come by a join.

Training takes its first guess from a bounded sample of documents and goes on with a few full
passes of Baum-Welch: each partition of the whole training
corpus adds up its expected counts of states, transitions and emissions over whole texts,
and the counts are summed across partitions.
Scoring runs the scaled forward recursion over whole texts.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import small_batches, stage

#: At most so many words are classes of their own.
LEXICON = 65_536
#: Classes of the other words.
TAILS = 512
STATES = 6
#: Documents of the sample that gives the first guess, and bytes of them in all; texts are whole.
SAMPLE_DOCS, SAMPLE_BYTES = 400, 8_000_000
SAMPLE_ROUNDS = 20
#: Baum-Welch passes over the whole training corpus: at most so many, and none after one that gains less than this share of the log likelihood.
PASSES, SETTLED = 3, 1e-4
#: Scoring cuts the recursion into blocks of this many tokens, without loss.
BLOCK = 256
#: Bytes of texts that a training task lays out at once.
TRAINED = 1 << 23
#: Tokens of training sequences or scoring blocks that one numpy step holds.
CHUNK = 1 << 18
#: The end token's key among the words; no word holds a space.
END = b" end"


class Lexicon(dict):
    """Word -> class. A word outside falls into a class by its last two bytes."""

    def __missing__(self, word: bytes) -> int:
        return self.first_tail + zlib.crc32(word[-2:]) % TAILS

    first_tail = 0


@dataclass
class Vocabulary:
    """What tasks need of the training counts: classes, and the counts of frequent words.

    words: of the lexicon, the end among them. counts: their counts. tail_tokens,
    tail_words: tokens and distinct words in each other class. tokens, distinct: in all.
    """

    words: list[bytes]
    counts: np.ndarray
    tail_tokens: np.ndarray
    tail_words: np.ndarray
    tokens: int
    distinct: int

    def lexicon(self) -> Lexicon:
        lexicon = Lexicon((w, i) for i, w in enumerate(self.words))
        lexicon.first_tail = len(self.words)
        return lexicon

    @property
    def classes(self) -> int:
        return len(self.words) + TAILS

    def class_counts(self) -> np.ndarray:
        return np.concatenate([self.counts, self.tail_tokens]).astype(float)


def tokens_of(text: bytes) -> list[bytes]:
    words = text.lower().split()
    words.append(END)
    return words


def count_words(texts: DataFrame) -> DataFrame:
    """(word, count) of all tokens of the texts; counted in each partition before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column("text"):
                counts.update(tokens_of(text.as_py()))
            if len(counts) > 300_000:
                yield told()
                counts.clear()
        if counts:
            yield told()

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Collect at most LEXICON words, those above a count, and totals by class of the others.

    The least count follows from a histogram of the counts in eighths of octaves.
    """
    step = F.floor(F.log2("n") * 8).cast("int")
    sizes = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).collect()
    room, least = LEXICON - 1, max((r.step for r in sizes), default=0) + 1
    for r in sorted(sizes, key=lambda r: -r.step):
        if r.words > room:
            break
        room, least = room - r.words, r.step
    rows = counts.where((step >= least) | (F.col("word") == F.lit(END))).collect()
    rows.sort(key=lambda r: (-r.n, bytes(r.word)))
    tail = F.pmod(F.crc32(F.substring("word", -2, 2)), F.lit(TAILS)).cast("int")
    rest = counts.where((step < least) & (F.col("word") != F.lit(END))).groupBy(tail.alias("tail")).agg(F.sum("n").alias("tokens"), F.count("*").alias("words")).collect()
    tail_tokens, tail_words = np.zeros(TAILS, np.int64), np.zeros(TAILS, np.int64)
    for r in rest:
        tail_tokens[r.tail], tail_words[r.tail] = r.tokens, r.words
    return Vocabulary([bytes(r.word) for r in rows], np.array([r.n for r in rows], np.int64), tail_tokens, tail_words, sum(r.tokens for r in sizes), sum(r.words for r in sizes))


@dataclass
class Model:
    """start (K), step (K, K) from row to column, emit (classes, K): each column a distribution."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray


def normalised(starts: np.ndarray, steps: np.ndarray, emits: np.ndarray, background: np.ndarray) -> Model:
    """Probabilities from expected counts, smoothed.

    A state's emissions lean towards the corpus distribution of the classes by as much weight
    as the state has kinds of classes: the more different ones it has seen, the more are to come.
    """
    start = starts + 1.0
    step = steps + 1.0
    kinds = 1.0 + np.minimum(emits, 1.0).sum(0)
    emit = emits + kinds * background[:, None]
    return Model(start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0))


def first_model(background: np.ndarray, states: int, seed: int) -> Model:
    """States that differ by seeded noise, and rather stay than change."""
    rng = np.random.default_rng(seed)
    noise = rng.gamma(2.0, 0.5, (len(background), states)) + 0.05
    emit = background[:, None] * noise
    step = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(step, 0.9 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), step, emit / emit.sum(0))


def segments_of(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut sequences laid end to end: start, length and document of each segment, in order."""
    pieces = -(-lengths // size)
    doc = np.repeat(np.arange(len(lengths)), pieces)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = (np.cumsum(lengths) - lengths)[doc] + within * size
    return start, np.minimum(size, lengths[doc] - within * size), doc


def expected_counts(model: Model, ids: np.ndarray, lengths: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of starts, transitions and emissions, and the log likelihood, of sequences laid end to end.

    Sequences that are too long to hold are done in blocks without loss: the forward states at the
    blocks' beginnings are kept, and a block's own are found again when the backward states reach it.
    """
    k = len(model.start)
    starts, steps, emits, told = np.zeros(k), np.zeros((k, k)), np.zeros((classes, k)), 0.0
    at, size = np.cumsum(lengths) - lengths, lengths
    ones, back = np.ones((k, 1)), np.ascontiguousarray(model.step.T)
    order = np.argsort(-size, kind="stable")
    low = 0
    while low < len(order):
        # as many as CHUNK tokens at the longest one's length
        high = min(len(order), low + max(1, CHUNK // int(size[order[low]])))
        some = order[low:high]
        low = high
        s, n = at[some], size[some]
        longest, count = int(n[0]), len(some)
        active = np.searchsorted(-n, -np.arange(longest), "left")  # sequences longer than t
        block = max(1, CHUNK // count)

        def forward(begin: int, end: int, now: np.ndarray) -> tuple[np.ndarray, ...]:
            """Of all tokens of the positions, position after position: where each position begins, the sequence's rank, token, emissions, states and scales."""
            m = active[begin:end]
            first = np.cumsum(m) - m
            rank = np.arange(int(m.sum())) - np.repeat(first, m)
            tokens = ids[s[rank] + np.repeat(np.arange(begin, end), m)]
            emit = model.emit[tokens]
            alpha, scale = np.empty_like(emit), np.empty((len(tokens), 1))
            for t, (place, live) in enumerate(zip(first.tolist(), m.tolist(), strict=True), begin):
                here, sums = alpha[place : place + live], scale[place : place + live]
                if t:
                    np.matmul(now[:live], model.step, out=here)
                    here *= emit[place : place + live]
                else:
                    np.multiply(now, emit[:live], out=here)
                np.matmul(here, ones, out=sums)
                here /= sums
                now = here
            return first, rank, tokens, emit, alpha, scale

        entering = [np.tile(model.start, (count, 1))]
        for begin in range(0, longest - block, block):
            first, *_, alpha, _ = forward(begin, begin + block, entering[-1])
            entering.append(alpha[first[-1] :].copy())
        later = None
        for begin in range((len(entering) - 1) * block, -1, -block):
            end = min(longest, begin + block)
            first, rank, tokens, emit, alpha, scale = forward(begin, end, entering[begin // block])
            told += float(np.log(scale).sum())
            m, places = active[begin:end], first.tolist()
            beta, weighed = np.ones_like(emit), emit
            weighed /= scale
            if later is not None:
                steps += alpha[places[-1] : places[-1] + len(later)].T @ later
            for place, live in zip(reversed(places), reversed(m.tolist()), strict=True):
                if later is not None:
                    np.matmul(later, back, out=beta[place : place + len(later)])
                later = weighed[place : place + live]
                later *= beta[place : place + live]
            if end - begin > 1:
                steps += alpha[np.repeat(first[:-1], m[1:]) + rank[first[1] :]].T @ weighed[first[1] :]
            alpha *= beta
            if begin == 0:
                starts += alpha[:count].sum(0)
            for j in range(k):
                emits[:, j] += np.bincount(tokens, alpha[:, j], classes)
    return starts, steps * model.step, emits, told


def log10_likelihood(model: Model, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Exact log10 probability of each sequence, by the scaled forward recursion.

    A sequence beyond one block is cut; later blocks are carried from every state
    at once, as a matrix, and the blocks of a sequence are then multiplied in order.
    """
    k, n_docs = len(model.start), len(lengths)
    at, size, doc = segments_of(lengths, BLOCK)
    part = np.arange(len(doc)) - np.searchsorted(doc, doc, "left")
    ends, logs = np.empty((len(at), k, k)), np.zeros((len(at), k))

    def forward(some: np.ndarray, whole: bool) -> None:
        """whole: blocks that begin a text, carried as one row from the start distribution."""
        some = some[np.argsort(-size[some], kind="stable")]
        rows = max(1, CHUNK // BLOCK // (1 if whole else k))
        for low in range(0, len(some), rows):
            mine = some[low : low + rows]
            n = size[mine]
            width = 1 if whole else k
            now = np.tile(model.start, (len(mine), 1, 1)) if whole else np.tile(np.eye(k), (len(mine), 1, 1))
            log, out = np.zeros((len(mine), width)), np.empty((len(mine), width, k))
            for t in range(int(n[0])):
                m = int(np.searchsorted(-n, -t, "left"))
                if m < len(now):
                    out[m : len(now)] = now[m:]
                    now = now[:m]
                moved = now if whole and t == 0 else (now.reshape(-1, k) @ model.step).reshape(now.shape)
                now = moved * model.emit[ids[at[mine[:m]] + t]][:, None, :]
                total = now.sum(2)
                now /= total[:, :, None]
                log[:m] += np.log(total)
            out[: len(now)] = now
            ends[mine, :width], logs[mine, :width] = out, log

    forward(np.flatnonzero(part == 0), True)
    forward(np.flatnonzero(part > 0), False)
    begin = np.flatnonzero(part == 0)
    state, told = ends[begin, 0], logs[begin, 0].copy()
    blocks = np.bincount(doc, minlength=n_docs)
    for j in range(1, int(blocks.max(initial=1))):
        live = np.flatnonzero(blocks > j)
        row = begin[live] + j
        top = logs[row].max(1)
        now = np.einsum("nk,nkj->nj", state[live] * np.exp(logs[row] - top[:, None]), ends[row])
        total = now.sum(1)
        state[live] = now / total[:, None]
        told[live] += np.log(total) + top
    return told / math.log(10)


def laid_out(lexicon: Lexicon, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all tokens end to end, and the texts' lengths."""
    words = [tokens_of(t) for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    ids = np.fromiter(map(lexicon.__getitem__, chain.from_iterable(words)), np.int32, int(lengths.sum()))
    return ids, lengths


def slices(texts: list[bytes], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes."""
    low, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield low, i + 1
            low, held = i + 1, 0
    if low < len(texts):
        yield low, len(texts)


def training_pass(texts: DataFrame, vocabulary: Vocabulary, model: Model) -> tuple[Model, float]:
    """One step of Baum-Welch over all texts; the log likelihood is the old model's."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast((vocabulary.words, model))
    classes, k = vocabulary.classes, len(model.start)
    names = [f"s{j}" for j in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model = shared.value
        lexicon = Lexicon((w, i) for i, w in enumerate(words))
        lexicon.first_tail = len(words)
        sums = [np.zeros(k), np.zeros((k, k)), np.zeros((classes, k)), 0.0]
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for low, high in slices(texts, TRAINED):
                sums = [a + b for a, b in zip(sums, expected_counts(model, *laid_out(lexicon, texts[low:high]), classes), strict=True)]
        emitted = np.flatnonzero(sums[2].any(1))
        # rows below 0: the starts, the transitions from each state, the log likelihood
        rows = np.concatenate([sums[2][emitted], sums[0][None], sums[1], np.full((1, k), sums[3])])
        at = np.concatenate([emitted, [-1], -2 - np.arange(k), [-2 - k]])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *[pa.array(rows[:, j]) for j in range(k)]], ["at", *names])

    counted = texts.select("text").mapInArrow(run, "at int, " + ", ".join(f"{n} double" for n in names))
    rows = counted.groupBy("at").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    emits, starts, steps, told = np.zeros((classes, k)), np.zeros(k), np.zeros((k, k)), 0.0
    for at, *values in rows.itertuples(index=False):
        if at >= 0:
            emits[at] = values
        elif at == -1:
            starts = np.array(values)
        elif at >= -1 - k:
            steps[-2 - at] = values
        else:
            told = values[0]
    shared.unpersist()
    counts = vocabulary.class_counts()
    return normalised(starts, steps, emits, (counts + 1) / (counts + 1).sum()), told


def first_texts(texts: DataFrame, ends: int) -> list[bytes]:
    """Whole texts in the order of ``pick``: at most SAMPLE_DOCS, and SAMPLE_BYTES in all; one beyond that is passed over."""
    chance = min(1.0, 2 * SAMPLE_DOCS / ends)
    near = texts.where(F.pmod(F.col("pick"), F.lit(1 << 20)) < math.ceil(chance * (1 << 20))).withColumn("bytes", F.length("text"))
    held, picks = 0, []
    for r in near.orderBy("pick", "bytes").select("pick", "bytes").limit(SAMPLE_DOCS).collect():
        if held + r.bytes <= SAMPLE_BYTES:
            held += r.bytes
            picks.append(r.pick)
    if not picks:
        return []
    rows = near.where(F.col("pick").isin(picks) & (F.col("bytes") <= SAMPLE_BYTES)).dropDuplicates(["pick"]).select("pick", "text").collect()
    return [bytes(r.text) for r in sorted(rows, key=lambda r: r.pick)]


def train(texts: DataFrame, vocabulary: Vocabulary, states: int = STATES, passes: int = PASSES, settled: float = SETTLED, seed: int = 11) -> Model:
    """A first guess from some texts, then passes over all of them, fewer if the log likelihood settles. texts: pick, text."""
    counts = vocabulary.class_counts()
    background = (counts + 1) / (counts + 1).sum()
    model = first_model(background, states, seed)
    ends = max(1, int(vocabulary.counts[vocabulary.words.index(END)]) if END in vocabulary.words else 1)
    if sample := first_texts(texts, ends):
        ids, lengths = laid_out(vocabulary.lexicon(), sample)
        for _ in range(SAMPLE_ROUNDS):
            model = normalised(*expected_counts(model, ids, lengths, vocabulary.classes)[:3], background)
    before = -math.inf
    for _ in range(passes):
        better, told = training_pass(texts, vocabulary, model)
        if told - before <= settled * abs(told):
            break
        model, before = better, told
    return model


def scored(texts: DataFrame, vocabulary: Vocabulary, model: Model) -> DataFrame:
    """Partial scores: a row for each text, and one for each of its rare words.

    The row of a text has the likelihood of its classes and the sums over its
    frequent words; its word is a space and the row's key, which no count has. A rare word's row
    has the word and how often it stands in the text.
    """
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast((vocabulary, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, model = shared.value
        lexicon, frequent = vocabulary.lexicon(), len(vocabulary.words)
        log_count = np.log10(np.concatenate([vocabulary.counts + 1.0, np.ones(TAILS)]))
        known = np.concatenate([(vocabulary.counts > 0).astype(np.int64), np.zeros(TAILS, np.int64)])
        # a class of rare words emits each by (count + 1) / (tokens + words + 1), the counts to be joined
        spread = np.concatenate([np.zeros(frequent), np.log10(vocabulary.tail_tokens + vocabulary.tail_words + 1.0)])
        for batch in batches:
            all_texts = batch.column("text").to_pylist()
            for low, high in slices(all_texts):
                texts = all_texts[low:high]
                ids, lengths = laid_out(lexicon, texts)
                starts = np.cumsum(lengths) - lengths
                hidden = log10_likelihood(model, ids, lengths) - np.add.reduceat(spread[ids], starts)
                base, seen = np.add.reduceat(log_count[ids], starts), np.add.reduceat(known[ids], starts)
                keys = batch.select(["doc_id", "held_out", "h"]).slice(low, len(texts))
                rare_doc, rare_word, rare_n = [], [], []
                is_rare = ids >= frequent
                for i in np.flatnonzero(np.add.reduceat(is_rare, starts)):
                    words = tokens_of(texts[i])
                    counts: dict[bytes, int] = {}
                    for at in np.flatnonzero(is_rare[starts[i] : starts[i] + lengths[i]]).tolist():
                        counts[words[at]] = counts.get(words[at], 0) + 1
                    rare_doc += [int(i)] * len(counts)
                    rare_word += counts
                    rare_n += counts.values()
                own = [f" {i} {h}".encode() for i, h in zip(keys.column("doc_id").to_pylist(), keys.column("h").to_pylist(), strict=True)]
                none = [None] * len(rare_doc)
                columns = [pa.array([*own, *rare_word], pa.binary()), pa.array([*[0] * len(own), *rare_n], pa.int64())]
                columns += [pa.array([*values.tolist(), *none], kind) for values, kind in ((lengths, pa.int64()), (seen, pa.int64()), (base, pa.float64()), (hidden, pa.float64()))]
                owner = keys.take(pa.array([*range(len(own)), *rare_doc], pa.int64()))
                yield pa.RecordBatch.from_arrays([*owner.columns, *columns], ["doc_id", "held_out", "h", "word", "times", "n_tokens", "seen", "base", "hidden"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "held_out", "h", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, h long, word binary, times long, n_tokens long, seen long, base double, hidden double")


def score_documents(docs: DataFrame, held_out: Column) -> DataFrame:
    """Train on the documents that aren't held out and score all.

    held_out: a boolean column. Returns doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score (unigram, add one) and score, the model's log10 probability.

    Edge cases: null and empty texts are the end token alone; rows equal in id and
    text get equal scores, each its own; a null doc_id is kept; with no
    training text every token is unknown; an empty table gives no rows; other
    columns are ignored.
    """
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    training = texts.where(~F.col("held_out")).select(F.xxhash64("doc_id", "text").alias("pick"), "text")
    counts = stage(count_words(training), "hmm-counts")
    words = vocabulary(counts)
    if not words.words:
        words = Vocabulary([END], np.zeros(1, np.int64), words.tail_tokens, words.tail_words, 0, 0)
    model = train(training, words)
    parts = scored(texts.withColumn("h", F.xxhash64("text")), words, model)
    joined = parts.join(counts.withColumnRenamed("n", "c"), "word", "left")
    rare = F.coalesce(F.col("times") * F.log10(F.col("c") + 1.0), F.lit(0.0))
    sums = joined.groupBy("doc_id", "held_out", "h").agg(
        F.count("n_tokens").alias("copies"), F.max("n_tokens").alias("n_tokens"), F.max("seen").alias("seen"), F.max("base").alias("base"), F.max("hidden").alias("hidden"),
        F.sum(rare).alias("rare"), F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("rare_seen"),
    )
    total = math.log10(words.tokens + words.distinct + 1)
    rare_each, rare_seen = F.col("rare") / F.col("copies"), (F.col("rare_seen") / F.col("copies")).cast("long")
    return sums.select(
        "doc_id", "held_out", "n_tokens", (F.col("seen") + rare_seen).alias("n_known"), F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + rare_each - F.col("n_tokens") * F.lit(total)).alias("base_score"), (F.col("hidden") + rare_each).alias("score"),
        F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")
