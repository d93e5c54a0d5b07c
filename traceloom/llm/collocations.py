"""Collocations from the phrases of a corpus, counted by prefix-free parsing.

A piece of text is cut into chunks before words that a hash picks, so equal
stretches are cut alike wherever they stand. A chunk also holds the first words of the next,
as many as a phrase needs beyond its first word; a phrase is counted in the chunk in which
it begins, so once. Equal chunks become one row of a dictionary with the number of times
they were parsed, and phrases are counted inside the distinct chunks, weighted so.

Only phrases of at least `least` occurrences count, and a phrase is never more
frequent than the words and word pairs in it. So the dictionary is read three times: for
the words; for hashes of the pairs of frequent words, whose counts can only be too high; and, exactly, for
phrases all of whose pairs may be frequent. What may be frequent is told by bitmaps of fixed size: more
frequent words and pairs than bits let more phrases through to the last count, and lose none.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.llm.common import Workspace, map_batches, small_batches

LEAST = 100
LONGEST = 5
TOP = 2000
#: A chunk has at least NEAR and at most FAR words of its own, but for the last of a piece; one word in TRIGGER begins a chunk.
CUT = NEAR, FAR, TRIGGER = 8, 64, 8
FILTER_BITS = 1 << 26
#: Entries of pair counts that a task holds before it gives them away.
HELD = 1 << 20
#: Rows and bytes of chunks that are counted together.
GATHERED = 1 << 17, 8 << 20
U = np.uint64
#: Bytes that end a piece, and what they become.
PIECES = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)


def chunks(words: list[bytes], longest: int, near: int = NEAR, far: int = FAR, trigger: int = TRIGGER) -> Iterator[tuple[bytes, int]]:
    """The chunks of a piece, each with how many of its words it owns: all but the overlap with the next chunk."""
    begin, n, over = 0, len(words), longest - 1
    if n > near + over:
        for i in range(near, n - over):
            if i - begin >= near and (i - begin >= far or zlib.crc32(words[i]) % trigger == 0):
                yield b" ".join(words[begin : i + over]), i - begin
                begin = i
    yield b" ".join(words[begin:]), n - begin


def parse(docs: DataFrame, longest: int, cut: tuple[int, int, int] = CUT) -> DataFrame:
    """lang, chunk, owned, times: the distinct chunks of each batch of texts."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: Counter[tuple[str, bytes, int]] = Counter()
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for piece in (text or "").encode().lower().translate(PIECES).split(b"\n"):
                if words := piece.split():
                    if len(words) < cut[0] + longest:
                        found[lang, b" ".join(words), len(words)] += 1
                    else:
                        found.update((lang, *c) for c in chunks(words, longest, *cut))
        lang, chunk, owned = zip(*found, strict=True) if found else ((), (), ())
        columns = [pa.array(lang, pa.string()), pa.array(chunk, pa.string()), pa.array(owned, pa.int32()), pa.array(found.values(), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["lang", "chunk", "owned", "times"])

    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return map_batches(texts, run, "lang string, chunk string, owned int, times long")


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of chunks put together up to GATHERED rows or bytes a batch, as chunks are short and words repeat."""
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= GATHERED[0] or size >= GATHERED[1]:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows, size = [], 0, 0
    if rows:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def map_gathered(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(lambda batches: map(function, gathered(batches)), schema)


class Words:
    """The words of a batch of chunks as numbers, with what belongs to each place."""

    def __init__(self, batch: pa.RecordBatch):
        langs = batch.column("lang").dictionary_encode()
        split = pc.split_pattern(batch.column("chunk").cast(pa.large_string()), " ")
        words = split.values.dictionary_encode()
        starts = split.offsets.to_numpy()
        n = np.diff(starts)
        self.langs, self.vocabulary = langs.dictionary, words.dictionary
        self.code = words.indices.to_numpy().astype(np.int64)
        self.lang = np.repeat(langs.indices.to_numpy(), n).astype(np.int64)
        self.times = np.repeat(batch.column("times").to_numpy(), n)
        self.last = np.zeros(len(self.code), bool)
        self.last[starts[1:] - 1] = True
        self.owned = np.arange(len(self.code)) - np.repeat(starts[:-1], n) < np.repeat(batch.column("owned").to_numpy(), n)

    def hashes(self) -> np.ndarray:
        """A hash of each place's language and word."""
        keys, at = np.unique(self.lang * len(self.vocabulary) + self.code, return_inverse=True)
        lang, code = np.divmod(keys, len(self.vocabulary))
        return word_hashes(self.langs.take(pa.array(lang)), self.vocabulary.take(pa.array(code)))[at]


def word_hashes(langs: pa.Array, words: pa.Array) -> np.ndarray:
    seeds = {x: xxhash.xxh64_intdigest(x.encode()) for x in langs.unique().to_pylist()}
    return np.array([xxhash.xxh64_intdigest(w.encode(), seeds[x]) for x, w in zip(langs.to_pylist(), words.to_pylist(), strict=True)], U)


def pair_hashes(h: np.ndarray) -> np.ndarray:
    """A hash of each place's word and the next."""
    x = (h[:-1] * U(0x9E3779B97F4A7C15)) ^ (h[1:] + (h[:-1] >> U(29)))
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(keys, return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, at, counts)
    return found, total


def bitmap(spots: DataFrame) -> bytes:
    """FILTER_BITS bits with those named in `spot` set; at most FILTER_BITS / 65536 rows of 8 kB reach the driver."""

    def packed(group: pa.Table) -> pa.Table:
        bits = np.zeros(1 << 16, np.uint8)
        bits[group.column("spot").to_numpy() & 0xFFFF] = 1
        return pa.table({"block": group.column("block").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    out = bytearray(FILTER_BITS // 8)
    for r in spots.distinct().withColumn("block", F.shiftright("spot", 16)).groupBy("block").applyInArrow(packed, "block long, bits binary").collect():
        out[r.block << 13 : (r.block + 1) << 13] = r.bits
    return bytes(out)


def told(bits: bytes, h: np.ndarray) -> np.ndarray:
    """Which hashes have their bit set."""
    spot = h & U(8 * len(bits) - 1)
    return (np.frombuffer(bits, np.uint8)[spot >> U(3)] >> (spot & U(7)).astype(np.uint8)) & 1 == 1


def word_counts(dictionary: DataFrame) -> DataFrame:
    """lang, phrase, f of all single words."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(batch)
        keys, total = summed((w.lang * len(w.vocabulary) + w.code)[w.owned], w.times[w.owned])
        lang, code = np.divmod(keys, max(1, len(w.vocabulary)))
        return pa.RecordBatch.from_arrays([w.langs.take(pa.array(lang)), w.vocabulary.take(pa.array(code)).cast(pa.string()), pa.array(total)], ["lang", "phrase", "f"])

    return map_gathered(dictionary, run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def word_spots(words: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        h = word_hashes(batch.column("lang"), batch.column("phrase"))
        return pa.RecordBatch.from_arrays([pa.array((h & U(FILTER_BITS - 1)).astype(np.int64))], ["spot"])

    return map_batches(words.select("lang", "phrase"), run, "spot long")


def pair_spots(dictionary: DataFrame, words: bytes, least: int) -> DataFrame:
    """Bits of the pairs of frequent words whose hash comes up often enough."""
    small_batches(dictionary.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, size = [], [], 0

        def rows() -> tuple[np.ndarray, np.ndarray]:
            return summed(np.concatenate(keys), np.concatenate(counts))

        for batch in gathered(batches):
            w = Words(batch)
            h = w.hashes()
            good = told(words, h)
            pair = np.flatnonzero(w.owned[:-1] & ~w.last[:-1] & good[:-1] & good[1:])
            found, total = summed(pair_hashes(h)[pair], w.times[pair])
            keys.append(found)
            counts.append(total)
            size += len(found)
            if size > HELD:
                found, total = rows()
                keys, counts, size = [found], [total], len(found)
                if 2 * size > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(total)], ["pair", "f"])
                    keys, counts, size = [], [], 0
        if size:
            found, total = rows()
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(total)], ["pair", "f"])

    pairs = dictionary.mapInArrow(run, "pair long, f long").groupBy("pair").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return pairs.select(F.col("pair").bitwiseAND(F.lit(FILTER_BITS - 1)).alias("spot"))


def phrase_counts(dictionary: DataFrame, words: bytes, pairs: bytes, longest: int) -> DataFrame:
    """lang, phrase, f of the phrases of two words and more, all of whose words and pairs may be frequent."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(batch)
        h = w.hashes()
        good = told(words, h)
        linked = np.zeros(len(h), bool)
        linked[:-1] = ~w.last[:-1] & good[:-1] & good[1:]
        linked[:-1] &= told(pairs, pair_hashes(h))
        size = max(1, len(w.vocabulary))
        at = np.flatnonzero(linked & w.owned)
        langs, phrases, totals = [], [], []
        key = w.lang[at] * size + w.code[at]
        for k in range(2, longest + 1):
            if not len(at):
                break
            key = key * size + w.code[at + k - 1]
            _, one, group = np.unique(key, return_index=True, return_inverse=True)
            total = np.zeros(len(one), np.int64)
            np.add.at(total, group, w.times[at])
            begin = at[one]
            langs.append(w.langs.take(pa.array(w.lang[begin])))
            phrases.append(pc.binary_join_element_wise(*[w.vocabulary.take(pa.array(w.code[begin + j])) for j in range(k)], pa.scalar(" ", pa.large_string())).cast(pa.string()))
            totals.append(pa.array(total))
            on = linked[at + k - 1]
            at, key = at[on], group[on]
        columns = [pa.concat_arrays(c) if c else pa.array([], t) for c, t in ((langs, pa.string()), (phrases, pa.string()), (totals, pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "f"])

    return map_gathered(dictionary, run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def n_words(phrase: Column) -> Column:
    return F.length(phrase) - F.length(F.replace(phrase, F.lit(" "))) + 1


def scored(frequent: DataFrame, sizes: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of every frequent phrase of two words and more: the cut of the lowest score, the first of equal ones.

    The parts of a frequent phrase are frequent, so their counts are in the same table. Products are decimals of
    38 digits: a * n may have 35; beyond, Spark raises.
    """
    words = F.split("phrase", " ")
    cuts = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(words, 1, k), " ").alias("first"), F.array_join(F.slice(words, k + 1, F.size(words)), " ").alias("rest")))
    rows = frequent.where(F.col("phrase").contains(" ")).select("lang", "phrase", F.col("f").alias("a"), F.inline(cuts))
    left = frequent.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = frequent.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    both = rows.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(sizes, "lang")
    score = F.expr("(cast(a as decimal(19, 0)) * cast(n as decimal(19, 0)) * cast(1000 as decimal(4, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    low = both.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "a", "l", "r", "n")).alias("low"))
    return low.select("lang", "phrase", "low.a", "low.l", "low.r", "low.n", "low.score")


def covered(frequent: DataFrame) -> DataFrame:
    """lang, phrase, most: how often the most frequent longer phrase around a phrase of two words and more occurs."""
    words, n = F.split("phrase", " "), F.size(F.split("phrase", " "))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))))
    longer = frequent.where(n_words(F.col("phrase")) > 2)
    return longer.select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int | None = TOP, cut: tuple[int, int, int] = CUT) -> DataFrame:
    """Each language's phrases of 2 to `longest` words by score: lang, rank, phrase, a, l, r, n, score.

    a: occurrences of the phrase, at least `least`; l and r: of its parts at the cut of the lowest score; n: words of the language;
    score: floor(1000 a n / (l r)). A phrase inside a longer one that is as frequent goes. top: how many of each language, by score, count and phrase; None: all, unranked.

    Edge cases: a null text is empty; a null lang is `und`; repeated rows count each; an empty table gives no rows; other columns are ignored;
    texts of any length are read whole, and words and pieces may have any length.
    """
    with Workspace(docs.sparkSession, "collocations") as work:
        parsed = parse(docs, longest, cut).groupBy("lang", "chunk", "owned").agg(F.sum("times").alias("times"))
        dictionary = work.stage(parsed, "dictionary")
        sizes = dictionary.groupBy("lang").agg(F.sum(F.col("owned") * F.col("times")).alias("n"))
        words = work.stage(word_counts(dictionary).where(F.col("f") >= least), "words")
        word_bits = bitmap(word_spots(words))
        pair_bits = bitmap(pair_spots(dictionary, word_bits, least))
        phrases = phrase_counts(dictionary, word_bits, pair_bits, longest).where(F.col("f") >= least)
        frequent = work.stage(phrases.unionByName(words), "frequent")
        rows = scored(frequent, sizes).join(covered(frequent), ["lang", "phrase"], "left").where(F.col("most").isNull() | (F.col("most") < F.col("a")))
        columns = ["phrase", "a", "l", "r", "n", "score"]
        if top is None:
            return work.keep(rows.select("lang", *columns), "phrases")
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
        return work.keep(rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("lang", "rank", *columns), "phrases")
