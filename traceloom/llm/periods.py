"""Runs (stretches of words that repeat with a period) from maximal pairs.

Two equal stretches of words at x < y are a maximal pair if the words before them
differ and the words after them differ. With a distance q = y - x of at most
their common length m, they are the two ends of a stretch of q + m words with period q
which no neighbouring word extends: a run, without any extension. Each run comes up with
its smallest period and with multiples of it, at the same place: the least counts.

Maximal pairs come from the suffixes of a text in order, with the lengths of
the prefixes that neighbours share (LCP). Going bottom up through the tree of
LCP intervals, every node keeps lists of its places by the word to their left;
what a node's children have in common is the node's LCP, so places of different
children and different left words, not too far apart, are the maximal pairs.

A run of `least` words has m >= least / 2, so only places whose next `least` / 2
words occur twice in the text are put in order. A batch of texts is dealt with
at once, in arrays; suffixes are ordered by text first, so texts don't meet.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import WORD, id_crc, map_batches

LEAST = 12
U = np.uint64
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit numbers of small ones."""
    x = (x.astype(U) + U(1)) * U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(27))


def repeated_places(codes: np.ndarray, doc: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """Places whose next `width` words, all in one text, seem to occur twice in it, in order. Hashes may let a few others pass, and leave out none."""
    if len(codes) < width:
        return np.zeros(0, np.int64)
    many = len(codes) - width + 1
    words, h = mixed(codes), mixed(doc[:many])
    for k in range(width):
        h = h * U(0x100000001B3) + words[k : k + many]
    inside = np.flatnonzero(np.arange(many) + width <= ends[doc[:many]])
    h = h[inside]
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return inside[twice]


def gram_ranks(codes: np.ndarray, doc: np.ndarray, ends: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """Ranks of the next `width` words of each place, by text and then as sequences; what ends comes first."""
    bits = int(codes.max()) + 2
    fit = max(1, 62 // bits.bit_length())
    keys, limit = [doc[places].astype(np.int64)], ends[doc[places]]
    for low in range(0, width, fit):
        key = np.zeros(len(places), np.int64)
        for k in range(low, min(low + fit, width)):
            at = places + k
            key = key * bits + np.where(at < limit, codes[np.minimum(at, len(codes) - 1)].astype(np.int64) + 1, 0)
        keys.append(key)
    return dense(keys)


def dense(keys: list[np.ndarray]) -> np.ndarray:
    """Ranks of rows by several keys; equal rows have equal ranks."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        ordered = k[order]
        new[1:] |= ordered[1:] != ordered[:-1]
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.cumsum(new)
    return ranks


def ordered_suffixes(codes: np.ndarray, doc: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their suffixes, and how many words each shares with the one before (0: fewer than `width`, or another text).

    Only places whose next `width` words occur twice are there. Ranks by so many
    words are doubled in reach until no two are equal. The places a reach further on have ranks too:
    of two places that are still equal, these are places as well, or come right after one.
    """
    places = repeated_places(codes, doc, ends, width)
    if not len(places):
        return places, places
    further = places + width
    known = np.unique(np.concatenate([places, further[further < ends[doc[places]]]]))
    at = np.full(len(codes) + 1, -1, np.int64)
    at[known] = np.arange(len(known))
    limit = ends[doc[known]]
    ranks, reach, levels = gram_ranks(codes, doc, ends, known, width), width, []
    while True:
        levels.append((reach, ranks))
        counts = np.bincount(ranks)
        tied = np.flatnonzero(counts[ranks] > 1)
        if not len(tied):
            break
        on = known[tied] + reach
        on = np.where(on < limit[tied], at[np.minimum(on, len(codes))], -1)
        second = np.where(on >= 0, ranks[on], -1)
        # a rank leaves room for those that it is split into
        first = np.cumsum(counts) - counts
        order = np.lexsort((second, ranks[tied]))
        a, b = ranks[tied][order], second[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        begins = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        group = np.ones(len(order), bool)
        group[1:] = a[1:] != a[:-1]
        group_begins = np.maximum.accumulate(np.where(group, np.arange(len(order)), 0))
        split = first[ranks]
        split[tied[order]] = first[a] + begins - group_begins
        ranks, reach = split, 2 * reach
    mine = at[places]
    order = places[np.argsort(ranks[mine])]
    x, y = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(len(x), np.int64)
    for reach, ranks in reversed(levels):
        i, j = at[np.minimum(x, len(codes))], at[np.minimum(y, len(codes))]
        same = (i >= 0) & (j >= 0) & (x < len(codes)) & (y < len(codes))
        same[same] = ranks[i[same]] == ranks[j[same]]
        shared += reach * same
        x += reach * same
        y += reach * same
    here = ends[doc[order[1:]]]
    same = (shared >= width) & (doc[order[1:]] == doc[order[:-1]])
    for _ in range(width - 1):
        same &= (x < here) & (y < here)
        same[same] = codes[x[same]] == codes[y[same]]
        shared += same
        x += same
        y += same
    return order, np.concatenate([[0], np.where(shared >= width, shared, 0)])


class Node:
    """An interval of the tree: its places, sorted, and its places by the word to their left."""

    __slots__ = ("shared", "places", "lists")

    def __init__(self, shared: int, place: int | None = None, left: int = 0):
        self.shared = shared
        self.places = [] if place is None else [place]
        self.lists = {} if place is None else {left: [place]}

    def adopt(self, child: Node, left: np.ndarray, found: dict[tuple[int, int], int], least: int) -> None:
        """Report the pairs of a child with what is here, then take its places in. The smaller side is gone through, so a place moves log n times."""
        small, large, reach = child, self, self.shared
        if len(child.places) > len(self.places):
            small, large = self, child
        for c, places in small.lists.items():
            for x in places:
                low, high = bisect_left(large.places, x - reach), bisect_right(large.places, x + reach)
                if low == high:
                    continue
                if high - low <= len(large.lists):
                    near = [y for y in large.places[low:high] if left[y] != c]
                else:
                    near = [y for d, there in large.lists.items() if d != c for y in there[bisect_left(there, x - reach) : bisect_right(there, x + reach)]]
                for y in near:
                    period = abs(x - y)
                    if period + reach >= least:
                        key = (min(x, y), period + reach)
                        found[key] = min(period, found.get(key, period))
        for c, places in small.lists.items():
            there = large.lists.setdefault(c, [])
            for x in places:
                insort(large.places, x)
                insort(there, x)
        self.places, self.lists = large.places, large.lists


def maximal_pairs(places: list[int], shared: list[int], left: np.ndarray, found: dict[tuple[int, int], int], least: int) -> None:
    """Go bottom up through the LCP intervals of neighbouring suffixes; shared[i] is what places[i] has in common with places[i - 1]."""
    stack = [Node(0)]
    for i, place in enumerate(places):
        now = shared[i] if i else 0
        done = None
        while stack[-1].shared > now:
            done = stack.pop()
            if stack[-1].shared >= now:
                stack[-1].adopt(done, left, found, least) if stack[-1].shared else None
                done = None
        if done is not None:
            # a node between the one that is done and the one below
            node = Node(now)
            node.places, node.lists = done.places, done.lists
            stack.append(node)
        ahead = shared[i + 1] if i + 1 < len(places) else 0
        leaf = Node(max(now, ahead), place, int(left[place]))
        if ahead > now:
            stack.append(leaf)
        elif now:
            stack[-1].adopt(leaf, left, found, least)
    while len(stack) > 1:
        done = stack.pop()
        if stack[-1].shared:
            stack[-1].adopt(done, left, found, least)


def find_runs(codes: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> dict[int, list[tuple[int, int, int]]]:
    """Text number -> its runs of at least `least` words as (start, length, smallest period), by start and period.

    codes: words as numbers, of all texts one after the other; bounds: where the texts begin, and the end.
    """
    doc, ends = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), bounds[1:]
    order, shared = ordered_suffixes(codes, doc, ends, max(1, -(-least // 2)))
    if not len(order):
        return {}
    left = np.full(len(codes), -1, np.int64)
    left[1:] = codes[:-1]
    left[bounds[:-1][bounds[:-1] < len(codes)]] = -1
    # blocks of suffixes that share enough; a block has no pair if all its left words are one, or if no two places are as near as they must be
    begins = np.flatnonzero(shared == 0)
    sizes = np.diff(np.append(begins, len(order)))
    block = np.repeat(np.arange(len(begins)), sizes)
    lefts = left[order]
    mixed_left = np.minimum.reduceat(lefts, begins) < np.maximum.reduceat(lefts, begins)
    by_place = order[np.lexsort((order, block))]
    gaps = np.diff(by_place, prepend=0)
    gaps[begins] = len(codes) + 1
    near = np.minimum.reduceat(gaps, begins) <= np.maximum.reduceat(shared, begins)
    found: dict[tuple[int, int], int] = {}
    for b in np.flatnonzero(mixed_left & near):
        low, high = begins[b], begins[b] + sizes[b]
        maximal_pairs(order[low:high].tolist(), shared[low:high].tolist(), left, found, least)
    runs: dict[int, list[tuple[int, int, int]]] = {}
    for (start, length), period in found.items():
        d = int(doc[start])
        runs.setdefault(d, []).append((start - int(bounds[d]), length, period))
    return {d: sorted(r, key=lambda x: (x[0], x[2])) for d, r in runs.items()}


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts and where each text's begin, with the end."""
    parts = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    words, bounds = parts.values, parts.offsets.to_numpy()
    full = pc.not_equal(pc.binary_length(words), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return words.filter(full), before[bounds]


def collapse(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and the text without the repeats, collapsed.

    A run is a stretch of consecutive words with smallest period q, of at least max(`least`, 2 q) words, that no neighbouring word
    extends. collapsed: the words that no run contains after its first period, joined by one space.

    Edge cases: null, empty and blank texts have no words, no runs and an empty collapsed text; repeated rows are dealt with each; a null doc_id is
    kept; other columns are ignored; an empty table gives no rows. Texts are read whole, each in one task.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, bounds = split_words(pc.fill_null(batch.column("text"), ""))
        codes = words.dictionary_encode().indices.to_numpy()
        runs = find_runs(codes, bounds, least)
        stay = np.ones(len(words), bool)
        for d, found in runs.items():
            low, high = bounds[d], bounds[d + 1]
            stay[low:high] = kept_words(high - low, found)
        kept = np.concatenate([[0], np.cumsum(stay)])[bounds]
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(kept, pa.int64()), words.filter(pa.array(stay))), pa.scalar(" ", pa.large_string()))
        told = [[{"start": s, "length": n, "period": p} for s, n, p in runs.get(d, ())] for d in range(batch.num_rows)]
        columns = [batch.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), pa.array(told, pa.list_(RUN)), joined.cast(pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    return map_batches(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(doc_id: Column, text: Column) -> Column:
    """The text; of one in ten, by the crc32 of doc_id, the words from some place on repeat with a period of a third to a tenth of what is left."""
    h = id_crc(doc_id)
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    n = F.size(words)
    a = F.pmod(g, n)
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))
    int_ = lambda c: c.cast("int")
    period = F.array_repeat(F.slice(words, int_(a) + 1, int_(p)), int_(F.ceil((n - a) / p)))
    told = F.array_join(F.slice(F.concat(F.slice(words, 1, int_(a)), F.flatten(period)), 1, n), " ")
    return F.when((F.pmod(h, F.lit(10)) == 0) & text.rlike(WORD), told).otherwise(text)


def report(collapsed: DataFrame) -> DataFrame:
    """Digests of what collapse gives: doc_id, n_runs, the longest run, runs_sha256 and collapsed_sha256."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    rows = collapsed.withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
