"""Best-fit packing planned on the histogram of lengths.

Documents are tokenised once, cut into pieces of at most `capacity` tokens and
numbered, within each task, among its pieces of equal length. How many pieces
there are of each length is all that the plan needs: best fit, longest lengths
first, on counts. The plan has at most `capacity` lengths to deal with, whatever
the number of documents, so it runs on the driver. It gives slots: the pieces of
ranks low to low + count of a length fill the sequences from `sequence` on,
`copies` each. A piece finds its slot by joining on its rank within its length.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceloom.llm.common import small_batches, stage

CAPACITY = 1024
#: Id after every document.
END = 2
SLOT = "length int, low long, count long, sequence long, copies long, at int"
#: The text of byte-level vocabularies writes these bytes as themselves, the others in order from U+0100 on.
SHOWN = (range(33, 127), range(161, 173), range(174, 256))
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Ids of a byte-level BPE tokenizer file, as the tokenizers library gives them.

    Where merges are made in the order of the ids that they give, tiktoken finds the
    same ids by rank, many times faster; other files, and texts that its regex
    can't cut, go to the tokenizers library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.exact, self.fast = Tokenizer.from_file(path), None
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model = told["model"]
        vocabulary, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        plain = not any((told.get("normalizer"), model.get("dropout"), model.get("ignore_merges"), model.get("unk_token"))) and told["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        first = len(vocabulary) - len(merges)
        if plain and first == 256 and all(vocabulary.get("".join(m)) == first + i for i, m in enumerate(merges)) and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in told["added_tokens"]):
            import tiktoken

            shown = {b for r in SHOWN for b in r}
            byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
            ranks = {bytes(byte[c] for c in text): i for text, i in vocabulary.items()}
            special = {t["content"]: t["id"] for t in told["added_tokens"]}
            self.fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all")
            except ValueError:  # the regex steps back too often, as in very long runs of white space
                pass
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One for each Python worker, kept from task to task."""
    return Encoder(path)


def ranks_within(lengths: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Each piece's number among those of its length, counted on from `before`, which is brought up to date."""
    order = np.argsort(lengths, kind="stable")
    ordered = lengths[order]
    counts = np.bincount(lengths, minlength=len(before))
    first = np.cumsum(counts) - counts
    ranks = np.empty(len(lengths), np.int64)
    ranks[order] = np.arange(len(lengths)) - first[ordered] + before[ordered]
    before += counts
    return ranks


def cut(docs: DataFrame, tokenizer_path: str, capacity: int, with_ids: bool) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, the task's number and the piece's rank in it; and input_ids, if asked for."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length int, ids_crc32 long, part int, nth long" + ", input_ids array<int>" * with_ids
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before = encoder(tokenizer_path).ids, TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([END], np.uint32)
        for batch in batches:
            rows, numbers, starts, lengths, crcs, ids = [], [], [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                tokens = np.concatenate([encode(text or ""), end]).astype("<u4", copy=False)
                ends = list(range(len(tokens), 0, -capacity))[::-1]
                for no, (low, high) in enumerate(zip([0, *ends], ends)):
                    rows.append(row)
                    numbers.append(no)
                    starts.append(low)
                    lengths.append(high - low)
                    crcs.append(zlib.crc32(tokens[low:high]))
                if with_ids:
                    ids += [tokens[low:high].astype(np.int32) for low, high in zip([0, *ends], ends)]
            if not rows:
                continue
            nth = ranks_within(np.array(lengths), before)
            columns = [batch.column("doc_id").take(pa.array(rows)), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int32()), pa.array(crcs, pa.int64()), pa.array([part] * len(rows), pa.int32()), pa.array(nth)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]), pa.int32()), pa.array(np.concatenate(ids))))
                names.append("input_ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, low, count, sequence, copies, at) from the number of pieces of each length.

    Best fit, longest first: a piece goes where least room would do, or opens a sequence.
    Sequences that are filled alike have neighbouring numbers and are kept as ranges, so a step deals with many pieces at once.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> ranges of sequences: (first, how many)
    rooms: list[int] = []  # the keys of room, sorted
    slots, opened = [], 0

    def leave(left: int, first: int, many: int) -> None:
        if many and left:
            if not room[left]:
                insort(rooms, left)
            room[left].append((first, many))

    for length in sorted(histogram, reverse=True):
        low, left = 0, histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                size = rooms[at]
                first, many = room[size].pop()
                if not room[size]:
                    rooms.pop(at)
            else:
                size, first, many = capacity, opened, -(-left // (capacity // length))
                opened += many
            copies = size // length
            full = min(many, left // copies)
            for count, each in ((full, copies), (1 if full < many else 0, left - full * copies)):
                if count and each:
                    slots.append((length, low, count * each, first, each, capacity - size))
                    leave(size - each * length, first, count)
                    low, left, first, many = low + count * each, left - count * each, first + count, many - count
            leave(size, first, many)
    return slots


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, *, with_ids: bool = False) -> DataFrame:
    """Places of all pieces of all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and input_ids, if asked for.

    A document is its ids and the end id. Only what is longer than the capacity
    is cut, from its end, so the first piece may be shorter. Nothing is dropped or padded.

    Edge cases: a null or empty text is the end id alone; a null doc_id is kept;
    rows that repeat are documents of their own; an empty table gives no rows;
    other columns are ignored. Texts of any length are encoded whole, in one task each.
    """
    spark = docs.sparkSession
    pieces = stage(cut(docs, tokenizer_path, capacity, with_ids), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    # at most as many rows as there are tasks, for each length
    placed = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    slots = spark.createDataFrame(plan(histogram, capacity), SLOT)
    # what each task has of a length, by the slots that its ranks fall in
    end = F.col("before") + F.col("n")
    shares = placed.join(slots, "length").where((F.col("low") < end) & (F.col("low") + F.col("count") > F.col("before")))
    shares = shares.select("part", "length", (F.col("low") - F.col("before")).alias("from"), "count", "sequence", "copies", "at")
    nth = F.col("nth") - F.col("from")
    rows = pieces.join(shares, ["part", "length"]).where((nth >= 0) & (nth < F.col("count")))
    return rows.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
        (F.col("sequence") + F.floor(nth / F.col("copies"))).alias("sequence_id"), (F.col("at") + F.pmod(nth, F.col("copies")) * F.col("length")).cast("long").alias("offset"),
        *["input_ids"] * with_ids,
    )


def sequences(packed: DataFrame) -> DataFrame:
    """Whole sequences from what pack gives with ids: sequence_id, input_ids and, for each piece in order, where it begins.

    A sequence has at most `capacity` tokens, so that bounds what meets in a group.
    """
    held = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "input_ids"))).alias("held"))
    return held.select("sequence_id", F.flatten("held.input_ids").alias("input_ids"), F.col("held.offset").alias("starts"))
