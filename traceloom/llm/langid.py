"""Language ID by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes, in ASCII lower case, are read in windows of ``WINDOW`` bytes. In
each window one recurrence runs forwards and one backwards, and both states label
every position with probabilities of the languages. The probabilities of the positions
that belong to letters are averaged over the whole text.

The network is trained in numpy by backpropagation through time, on all windows of the whole texts of
at most ``SAMPLE_DOCS`` labelled documents of each language, ``SAMPLE_BYTES`` in all. All languages are
learned; where they are many, they share ``SAMPLE_ALL`` documents, and each has at least one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.llm.common import small_batches

WINDOW = 64
HIDDEN = 8
#: Languages for which HIDDEN, BATCH and ROWS are meant; with more, states grow and numpy steps hold fewer windows.
MANY = 64
#: Bounds of the sample: documents of a language, documents and bytes of all. The bytes are shared evenly by the languages; a text
#: beyond its language's share is passed over, unless the language has no other.
SAMPLE_DOCS, SAMPLE_ALL, SAMPLE_BYTES = 300, 64 * 300, 4 << 20
#: At least so many passes over the sample, and so many steps.
EPOCHS, STEPS, BATCH, RATE = 2, 400, 256, 0.02
#: Windows that one numpy step holds.
ROWS = 4096
IS_LETTER = np.array([97 <= b <= 122 or b >= 128 for b in range(256)])
UNDETERMINED = "und"


@dataclass
class Direction:
    """One recurrence. table: (3H, 256) input of each byte to update, reset and new; back: (3H, H); label: (L, H).

    Update and reset are sigmoids, written as (tanh + 1) / 2 of weights that hold the half.
    """

    table: np.ndarray
    back: np.ndarray
    label: np.ndarray


@dataclass
class Network:
    languages: list[str]
    directions: list[Direction]
    bias: np.ndarray
    moments: list = field(default_factory=list)

    def arrays(self) -> list[np.ndarray]:
        return [*(a for d in self.directions for a in (d.table, d.back, d.label)), self.bias]


def new_network(languages: list[str], hidden: int | None = None, seed: int = 5) -> Network:
    hidden = hidden or HIDDEN * -(-max(1, len(languages) - 1).bit_length() // (MANY - 1).bit_length())
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(hidden), shape).astype(np.float32)
    return Network(languages, [Direction(draw(3 * hidden, 256), draw(3 * hidden, hidden), draw(len(languages), hidden)) for _ in range(2)], np.zeros(len(languages), np.float32))


def fewer(rows: int, network: Network) -> int:
    """Windows that one numpy step holds: probabilities take rows times languages."""
    return max(16, rows * MANY // max(MANY, len(network.languages)))


def step(d: Direction, taken: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The next state from the inputs (3H, R) and the state (H, R); also the gates (2H, R) and the new part."""
    k = len(h)
    pre = d.back @ h
    gates = taken[: 2 * k]
    gates += pre[: 2 * k]
    np.tanh(gates, out=gates)
    gates *= 0.5
    gates += 0.5
    new = pre[2 * k :]
    reset = new.copy()
    new *= gates[k:]
    new += taken[2 * k :]
    np.tanh(new, out=new)
    out = h - new
    out *= gates[:k]
    out += new
    return out, gates, np.stack([new, reset])


def softmax(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(0)
    np.exp(logits, out=logits)
    logits /= logits.sum(0)
    return logits


def label_windows(network: Network, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the letter positions of each window: probabilities (R, L), and how often each label is best (R, L)."""
    rows, length = windows.shape
    forward, backward = network.directions
    columns = np.ascontiguousarray(windows.T)
    logits = np.empty((length, len(network.languages), rows), np.float32)
    state = np.zeros((forward.back.shape[1], rows), np.float32)
    for t in range(length):
        state = step(forward, forward.table.take(columns[t], axis=1), state)[0]
        np.matmul(forward.label, state, out=logits[t])
    total, best = np.zeros((len(network.languages), rows), np.float32), np.zeros((len(network.languages), rows), np.float32)
    state = np.zeros_like(state)
    for t in range(length - 1, -1, -1):
        state = step(backward, backward.table.take(columns[t], axis=1), state)[0]
        now = logits[t]
        now += backward.label @ state
        now += network.bias[:, None]
        chance = softmax(now)
        chance *= IS_LETTER[columns[t]]
        total += chance
        best += (chance == chance.max(0)) & (chance > 0)
    return total.T, best.T


def cut(texts: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Windows of all texts, filled up with spaces, and how many each text has (at least one)."""
    counts = np.array([max(1, -(-len(t) // window)) for t in texts], np.int64)
    data = b"".join(t.ljust(int(c) * window) for t, c in zip(texts, counts, strict=True))
    return np.frombuffer(data, np.uint8).reshape(-1, window), counts


def train(network: Network, windows: np.ndarray, answers: np.ndarray, epochs: int = EPOCHS, seed: int = 6) -> Network:
    """Backpropagation through time with Adam on the cross-entropy of every letter position."""
    rng = np.random.default_rng(seed)
    arrays = network.arrays()
    network.moments = [(np.zeros_like(a), np.zeros_like(a)) for a in arrays]
    batch = fewer(BATCH, network)
    batches = -(-len(windows) // batch)
    epochs = max(epochs, -(-STEPS // batches))
    count, total = 0, epochs * batches
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for low in range(0, len(order), batch):
            some = order[low : low + batch]
            count += 1
            rate = RATE * (1 - 0.9 * count / total)
            for a, g, (m, v) in zip(arrays, gradients(network, windows[some], answers[some])[0], network.moments, strict=True):
                g = np.clip(g, -1, 1)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                a -= rate * (m / (1 - 0.9**count)) / (np.sqrt(v / (1 - 0.99**count)) + 1e-8)
    return network


def gradients(network: Network, windows: np.ndarray, answers: np.ndarray) -> tuple[list[np.ndarray], float]:
    """Gradients of the mean cross-entropy over letter positions, for each of network.arrays(), and the loss."""
    rows, length = windows.shape
    columns = windows.T
    runs = []
    logits = np.zeros((length, len(network.languages), rows)) + network.bias[:, None]
    for d, order in zip(network.directions, (range(length), range(length - 1, -1, -1)), strict=True):
        state = np.zeros((d.back.shape[1], rows), d.back.dtype)
        kept = []
        for t in order:
            out, gates, both = step(d, d.table.take(columns[t], axis=1), state)
            kept.append((t, state, out, gates, both))
            logits[t] += d.label @ out
            state = out
        runs.append(kept)
    letters = IS_LETTER[columns]
    weight = letters / max(1, letters.sum())
    chance = np.stack([softmax(x) for x in logits])
    right = np.eye(len(network.languages))[answers].T
    loss = -float((weight * np.log((chance * right).sum(1) + 1e-12)).sum())
    wrong = (chance - right) * weight[:, None]
    found = []
    for d, kept in zip(network.directions, runs, strict=True):
        k = d.back.shape[1]
        table, back, label = np.zeros(d.table.shape), np.zeros(d.back.shape), np.zeros(d.label.shape)
        carry = np.zeros((k, rows))
        for t, state, out, gates, (new, reset) in reversed(kept):
            label += wrong[t] @ out.T
            carry = carry + d.label.T @ wrong[t]
            update, open_ = gates[:k], gates[k:]
            d_new = carry * (1 - update) * (1 - new * new)
            # tanh form: the gate's slope is 2 g (1 - g)
            d_update = carry * (state - new) * 2 * update * (1 - update)
            d_open = d_new * reset * 2 * open_ * (1 - open_)
            inner = np.concatenate([d_update, d_open, d_new * open_])
            outer = np.concatenate([d_update, d_open, d_new])
            back += inner @ state.T
            for j in range(3 * k):
                table[j] += np.bincount(columns[t], outer[j], 256)
            carry = carry * update + d.back.T @ inner
        found += [table, back, label]
    return [*found, wrong.sum((0, 2))], loss


def sample_texts(docs: DataFrame) -> dict[str, list[bytes]]:
    """Whole texts of every language, within the sample's bounds. docs: doc_id, text, lang, none of the last two null.

    A text is picked by a hash of id and text, so equal rows count once.
    """
    spark = docs.sparkSession
    counts = docs.groupBy("lang").count().collect()
    if not counts:
        return {}
    each, room = max(1, min(SAMPLE_DOCS, SAMPLE_ALL // len(counts))), SAMPLE_BYTES // len(counts)
    chance = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, (2 * each + 20) / r["count"])))])
    keyed = docs.select("lang", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)).alias("pick"), F.octet_length("text").alias("bytes"), "text")
    order = Window.partitionBy("lang").orderBy("pick")
    first = lambda rows, n: rows.select("lang", "pick", "bytes").withColumn("at", F.row_number().over(order)).where(F.col("at") <= n).collect()
    near = first(keyed.where(F.col("pick") < chance[F.col("lang")] * float(1 << 40)), each)
    # a language whose rows are mostly equal can miss them all
    if missed := sorted({r["lang"] for r in counts} - {r.lang for r in near}):
        near += first(keyed.where(F.col("lang").isin(missed)), 1)
    chosen: dict[tuple[str, int], int] = {}
    held: dict[str, int] = {}
    for r in sorted(near, key=lambda r: (r.lang, r.pick)):
        if (r.lang, r.pick) not in chosen and held.get(r.lang, 0) + r.bytes <= room:
            chosen[r.lang, r.pick] = r.bytes
            held[r.lang] = held.get(r.lang, 0) + r.bytes
    for r in sorted(near, key=lambda r: r.bytes, reverse=True):
        if r.lang not in held:  # only long texts: the shortest
            chosen = {k: n for k, n in chosen.items() if k[0] != r.lang} | {(r.lang, r.pick): r.bytes}
    wanted = spark.createDataFrame(list(chosen), "lang string, pick long")
    # as many rows as the sample has documents, SAMPLE_ALL at most but for one a language
    rows = keyed.join(F.broadcast(wanted), ["lang", "pick"], "left_semi").dropDuplicates(["lang", "pick"]).select("lang", "pick", "text").collect()
    found: dict[str, list[bytes]] = {r["lang"]: [] for r in sorted(counts, key=lambda r: r["lang"])}
    for r in sorted(rows, key=lambda r: (r.lang, r.pick)):
        found[r.lang].append(r.text.encode().lower())
    return found


def sample_windows(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All languages, and the windows of their sampled texts that hold a letter."""
    texts = sample_texts(docs)
    if not texts:
        return [], np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64)
    cuts = [cut(x)[0] for x in texts.values()]
    windows = np.concatenate(cuts)
    answers = np.repeat(np.arange(len(cuts)), [len(w) for w in cuts])
    lettered = IS_LETTER[windows].any(1)
    return list(texts), windows[lettered], answers[lettered]


def fit(docs: DataFrame) -> Network:
    """Train on the labelled documents given; null langs and texts are left out."""
    languages, windows, answers = sample_windows(docs.select("doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL"))
    network = new_network(languages)
    return train(network, windows, answers) if len(windows) else network


def predict(docs: DataFrame, network: Network, text: str = "text") -> DataFrame:
    """The rows with lang_pred, score (the pooled probability) and agreement (share of letter positions with that label).

    Edge cases: a null text, or one without a letter, is ``und`` with score and
    agreement 0, as is every text if no language was learned; repeated rows
    get equal results; texts of any length are read to the end; an empty
    table gives no rows; other columns are kept, but those named like new ones.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(network)
    docs = docs.drop("lang_pred", "score", "agreement")
    names = [*docs.columns, "lang_pred", "score", "agreement"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        languages = np.array([*network.languages, UNDETERMINED], object)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            lettered = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool)
            best, score, agreed = np.full(len(texts), len(languages) - 1), np.zeros(len(texts)), np.zeros(len(texts))
            due = np.flatnonzero(lettered)
            if len(due) and network.languages:
                windows, counts = cut([texts[i].encode().lower() for i in due])
                rows = fewer(ROWS, network)
                sums = [label_windows(network, windows[low : low + rows]) for low in range(0, len(windows), rows)]
                first = np.cumsum(counts) - counts
                chance, votes = (np.add.reduceat(np.concatenate([s[j] for s in sums]).astype(float), first) for j in range(2))
                found = chance.argmax(1)
                best[due] = found
                score[due] = np.clip(chance[np.arange(len(due)), found] / np.maximum(1, chance.sum(1)), 0, 1)
                agreed[due] = votes[np.arange(len(due)), found] / np.maximum(1, votes.sum(1))
            columns = [*batch.columns, pa.array(languages[best].tolist(), pa.string()), pa.array(score), pa.array(agreed)]
            yield pa.RecordBatch.from_arrays(columns, names)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kept}, lang_pred string, score double, agreement double")


def identify(docs: DataFrame, held_out: Column) -> DataFrame:
    """Learn from the labelled documents that aren't held out, and predict all: doc_id, held_out, lang_pred, score, agreement."""
    told = docs.withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    network = fit(told.where(~F.col("held_out")))
    return predict(told.select("doc_id", "held_out", F.col("text").cast("string").alias("text")), network).drop("text")
