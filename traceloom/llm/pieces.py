"""SentencePiece BPE encoding and decoding, exact, by backtracking.

A merge-type encoding is the only sequence of pieces in which every two
neighbours, merged anew on their own, come out as the same two. So the text is
cut greedily: the longest piece at each place, found by an Aho-Corasick automaton,
is taken if it is compatible with the piece before; else the next shorter one. A
place from which no way led on is marked in a bitfield and not tried again.

Where no piece of the model holds two neighbouring characters side by side, a text can
be cut between them: before space marks, before signs behind letters, around
characters that are in no piece. These cuts are found from the pieces. The segments between
them are encoded once and remembered, in a store of bounded size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import map_batches

SPACE = "▁"
STORED_SEGMENTS = 100_000
#: Pairs of neighbours whose compatibility is remembered.
KNOWN_PAIRS = 200_000


def cut_pattern(pieces: Iterable[str]) -> re.Pattern[str]:
    """Segments of a text: space marks, signs, then what is neither; or a run of ASCII characters that no piece has.

    signs: ASCII characters, no letters, that stand in pieces behind space marks and other signs only, and those other signs.
    """
    pieces = list(pieces)
    known = {c for p in pieces for c in p}
    joined = {(a, b) for p in pieces for a, b in zip(p, p[1:], strict=False)}
    if any(b == SPACE and a != SPACE for a, b in joined):
        raise ValueError("a piece holds a space mark behind another character")
    able = {c for c in known if not c.isalpha() and c != SPACE}
    while wrong := {b for a, b in joined if b in able and a not in able and a != SPACE}:
        able -= wrong
    signs = {c for c in able if c.isascii()}
    while more := {a for a, b in joined if b in signs and a not in signs and a != SPACE}:
        signs |= more
    sign = "".join(map(re.escape, sorted(signs)))
    alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in known and c != 32)
    rest = f"[^{SPACE}{sign}{alone}]"
    options = [f"{SPACE}+[{sign}]*{rest}*", f"[{sign}]+{rest}*", f"{rest}+"] if sign else [f"{SPACE}+{rest}*", f"{rest}+"]
    return re.compile("|".join([*options, *([f"[{alone}]+"] if alone else [])]))


class PieceModel:
    """Pieces, scores and settings of a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        n = processor.vocab_size()
        self.text = [processor.id_to_piece(i) for i in range(n)]
        self.eos, self.unknown = processor.eos_id(), processor.unk_id()
        special = [processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i) for i in range(n)]
        self.control = {i for i in range(n) if processor.is_control(i)}
        self.byte_of = {i: int(self.text[i][3:5], 16) for i in range(n) if processor.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        self.score = {self.text[i]: processor.get_score(i) for i in range(n) if not special[i]}
        self.id = {self.text[i]: i for i in range(n) if not special[i]}
        self.segment = cut_pattern(self.id)
        self.automaton = ahocorasick.Automaton()
        self.size = [len(t) for t in self.text]
        reachable = [p for p in self.id if len(p) == 1 or self.merge(p) == [p]]
        for piece in reachable:  # a piece that merging never yields can't stand in any encoding
            self.automaton.add_word(piece, self.id[piece])
        self.automaton.make_automaton()
        #: The longest piece that is a proper prefix of each, or -1.
        found = set(reachable)
        self.shorter = [-1] * n
        for piece in reachable:
            self.shorter[self.id[piece]] = next((self.id[piece[:k]] for k in range(len(piece) - 1, 0, -1) if piece[:k] in found), -1)
        self.known_pairs: dict[int, bool] = {}

    def merge(self, text: str) -> list[str]:
        """Plain merging of a short string: the best-scored neighbours first, the left ones among equals."""
        parts = list(text)
        score = self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Do two neighbours come out the same when their text is merged anew? A character that is no piece never merges."""
        pair = left << 24 | right
        known = self.known_pairs.get(pair)
        if known is None:
            n = len(self.text)
            known = left >= n or right >= n or self.merge(self.text[left] + self.text[right]) == [self.text[left], self.text[right]]
            if len(self.known_pairs) >= KNOWN_PAIRS:
                self.known_pairs.clear()
            self.known_pairs[pair] = known
        return known

    def cut(self, segment: str) -> list[int]:
        """Pieces of a segment, by id; a character that is no piece is the number of pieces plus its code point.

        The longest pieces from left to right are tried as they are first: if all
        neighbours are compatible, no place has to be given up.
        """
        n, size, compatible = len(segment), self.size, self.compatible
        out = [i for _, i in self.automaton.iter_long(segment)]
        if sum([size[i] for i in out]) == n and all(map(compatible, out, out[1:])):
            return out
        longest, unknown = [-1] * n, len(size)
        for end, i in self.automaton.iter(segment):  # by their ends, so the last one at a start is the longest
            longest[end - size[i] + 1] = i
        out, failed = [], bytearray(n // 8 + 1)
        at, piece = 0, longest[0]
        if piece < 0:
            piece = unknown + ord(segment[0])
        while True:
            end = at + (size[piece] if piece < unknown else 1)
            if not failed[end >> 3] >> (end & 7) & 1 and (not out or compatible(out[-1], piece)):
                out.append(piece)
                if end == n:
                    return out
                at, piece = end, longest[end]
                if piece < 0:
                    piece = unknown + ord(segment[end])
                continue
            piece = self.shorter[piece] if piece < unknown else -1
            while piece < 0:  # nothing fits here: give up this place, and shorten the piece before
                failed[at >> 3] |= 1 << (at & 7)
                last = out.pop()
                at -= size[last] if last < unknown else 1
                piece = self.shorter[last] if last < unknown else -1

    def encode_segment(self, segment: str) -> list[int]:
        """Ids of a segment; a character that is no piece falls back to the pieces of its UTF-8 bytes."""
        ids, unknown = self.cut(segment), len(self.size)
        if max(ids) < unknown:
            return ids
        return [x for i in ids for x in ([i] if i < unknown else [self.byte_id[b] for b in chr(i - unknown).encode()])]

    def normalise(self, text: str) -> str:
        """The model's normaliser: a space in front of any text, and marks for spaces."""
        return SPACE + text.replace(" ", SPACE) if text else ""

    def encode(self, text: str) -> list[int]:
        """Ids of a text with the end id."""
        return [i for s in self.segment.findall(self.normalise(text)) for i in self.encode_segment(s)] + [self.eos]

    def decode_ids(self, ids: list[int]) -> str:
        """Text of ids, with the front space still there; control ids have none."""
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if i not in self.control:
                out.append(self.text[i].replace(SPACE, " "))
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        return self.decode_ids(ids).removeprefix(" ")


class SegmentStore(dict):
    """Segment -> its ids as text with a space before each, in two generations of bounded size.

    When the young one is full it becomes the old one; what is asked for again moves back up.
    odd: decoded text of the segments whose ids decode to another text than their own, bounded too but for those of one text.
    """

    def __init__(self, model: PieceModel):
        super().__init__()
        self.model, self.old, self.odd = model, {}, {}

    def __missing__(self, segment: str) -> str:
        told = self.old.get(segment)
        if told is None:
            ids = self.model.encode_segment(segment)
            told = "".join(f" {i}" for i in ids)
            if (decoded := self.model.decode_ids(ids)) != segment.replace(SPACE, " "):
                self.odd[segment] = decoded
        if len(segment) <= 64:
            if len(self) >= STORED_SEGMENTS:
                self.old = dict(self)
                self.clear()
            self[segment] = told
        return told

    def room(self) -> None:
        """Between texts: begin anew if there are too many odd segments."""
        if len(self.odd) >= STORED_SEGMENTS:
            self.clear()
            self.old, self.odd = {}, {}

    def decoded(self, segments: list[str]) -> str:
        """The text that the segments' ids decode to."""
        if self.odd:
            segments = [self.odd.get(s, s) for s in segments]
        return "".join(segments).replace(SPACE, " ").removeprefix(" ")


@lru_cache(1)
def stored(path: str) -> SegmentStore:
    """One store for each Python worker, kept from task to task."""
    return SegmentStore(PieceModel(path))


def encode_documents(docs: DataFrame, model_path: str, *, with_ids: bool = False) -> DataFrame:
    """Encode every whole text with an end id and decode it again.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by one space),
    decoded_sha256 and, if asked for, input_ids.

    Edge cases: null and empty texts are the end id alone; equal texts give
    equal rows; texts without any space are one segment, encoded in linear
    time but for backtracking; an empty table gives no rows; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", input_ids array<int>" * with_ids

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        store = stored(model_path)
        normalise, split, end = store.model.normalise, store.model.segment.findall, f" {store.model.eos}"
        numbers, digests, decoded, all_ids = [], [], [], []
        for text in batch.column("text").to_pylist():
            store.room()
            segments = split(normalise(text or ""))
            ids = ("".join(map(store.__getitem__, segments)) + end)[1:]
            numbers.append(ids.count(" ") + 1)
            digests.append(hashlib.sha256(ids.encode()).hexdigest())
            decoded.append(hashlib.sha256(store.decoded(segments).encode()).hexdigest())
            if with_ids:
                all_ids.append(np.fromstring(ids, np.int32, sep=" "))
        columns = [batch.column("doc_id"), pa.array(numbers, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            columns.append(pa.array(all_ids, pa.list_(pa.int32())))
            names.append("input_ids")
        return pa.RecordBatch.from_arrays(columns, names)

    return map_batches(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, schema)
