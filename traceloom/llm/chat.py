"""Chat formatting with offset-aligned loss masks.

A whole conversation is rendered once and encoded once, with the offsets of its
tokens. The mask comes from intersecting the sorted spans of the turns to learn
from with the sorted spans of the tokens by binary search.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import map_batches

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that some template gives a meaning; inside texts they are escaped.
CONTROL = (START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
CONTROL_AT = re.compile("|".join(map(re.escape, CONTROL)))
TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)


def escape(text: str) -> str:
    """Double every backslash, then break each control string with one after its first character."""
    return CONTROL_AT.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    """A doubled backslash is one; a single one only breaks a control string and goes."""
    return re.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text


def escape_role(role: str) -> str:
    """A role stands on one line: a line feed in it is written as backslash, full stop."""
    return escape(role).replace("\n", "\\.")


def unescape_role(role: str) -> str:
    return re.sub(r"\\([\\.]?)", lambda m: "\n" if m[1] == "." else m[1], role)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the span of each turn's (escaped) text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str, tuple[int, int]]]:
    """Roles and texts back from a formatted conversation, and where the escaped texts stand."""
    return [(unescape_role(m[1]), unescape(m[2]), m.span(2)) for m in TURN.finditer(formatted)]


def masked_tokens(tokens: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which tokens touch a span, and the parts of the spans that tokens cover.

    tokens: (n, 2) offsets, sorted. spans: sorted and apart. A token that
    reaches beyond its span counts, cut to the span.
    """
    mask = np.zeros(len(tokens), bool)
    covered: list[tuple[int, int]] = []
    if not len(tokens) or not spans:
        return mask, covered
    starts, ends = tokens[:, 0], np.maximum.accumulate(tokens[:, 1])
    low, high = np.array(spans, np.int64).T
    first, last = np.searchsorted(ends, low, "right").tolist(), np.searchsorted(starts, high, "left").tolist()
    # between which tokens some characters are left out
    gaps = np.flatnonzero(starts[1:] > ends[:-1]) + 1
    gap = np.searchsorted(gaps, np.array(first) + 1).tolist()
    for (a, b), i, j, g in zip(spans, first, last, gap, strict=True):
        if a >= b or i >= j:
            continue
        mask[i:j] = True
        cuts = [x for x in gaps[g:].tolist() if x < j] if g < len(gaps) and gaps[g] < j else []
        for x, y in zip([i, *cuts], [*cuts, j], strict=True):
            covered.append((max(a, int(starts[x])), min(b, int(ends[y - 1]))))
    return mask, covered


def learned_text(text: str, spans: list[tuple[int, int]], tokens: np.ndarray) -> str:
    """What masked tokens hold of the spans, unescaped; a token outside all spans gives its raw text, at the end.

    tokens: (n, 2) offsets of the masked tokens.
    """
    touched, covered = masked_tokens(tokens, spans)
    pieces: list[str] = []
    last = None
    for a, b in covered:
        # an escape may lie across two parts that touch
        if a == last:
            pieces[-1] += text[a:b]
        else:
            pieces.append(text[a:b])
        last = b
    return "".join(map(unescape, pieces)) + "".join(text[a:b] for a, b in tokens[~touched].tolist())


@lru_cache(1)
def load_tokenizer(path: str):
    """The tokenizer with offsets that keep white space; control strings in texts are plain text to it."""
    from tokenizers import Tokenizer, processors

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
    return tokenizer


#: Characters that are encoded at once; an encoding takes many times their memory.
CHUNK = 1 << 18


def encodings(path: str, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Token ids and (n, 2) offsets of each text, a few texts at a time."""
    tokenizer, low, held = load_tokenizer(path), 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= CHUNK or i + 1 == len(texts):
            for e in tokenizer.encode_batch(texts[low : i + 1], add_special_tokens=False):
                yield np.array(e.ids, np.int32), np.array(e.offsets, np.int32).reshape(-1, 2)
            low, held = i + 1, 0


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column of one array a row."""
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else [], kind))


def format_conversations(rows: DataFrame, tokenizer_path: str, learn: str = "assistant") -> DataFrame:
    """conv_id, formatted, input_ids, loss_mask, token_starts, token_ends and loss_spans of every conversation.

    rows: conv_id, turn, role, text. A conversation is one string in the end, so
    its rows meet in one task; they are sorted there by turn (null first), role, text.

    Edge cases: null texts and roles are empty strings; equal rows stay, as turns
    of their own; a null conv_id is a conversation; an empty table gives no rows;
    other columns are ignored.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "role"))
    turns = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63))).alias("turn"), role, text)))
    grouped = rows.groupBy("conv_id").agg(turns.alias("turns"))
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column("turns")
        ends, flat = column.offsets.to_pylist(), column.values
        said = list(zip(flat.field("role").to_pylist(), flat.field("text").to_pylist(), strict=True))
        chats = [said[a:b] for a, b in zip(ends, ends[1:])]
        drawn = [render(x) for x in chats]
        ids, masks, starts, stops, covered = [], [], [], [], []
        for turns, (_, spans), (tokens, at) in zip(chats, drawn, encodings(tokenizer_path, [x for x, _ in drawn]), strict=True):
            mask, cover = masked_tokens(at, [s for (r, _), s in zip(turns, spans, strict=True) if r == learn])
            ids.append(tokens)
            masks.append(mask)
            starts.append(at[:, 0])
            stops.append(at[:, 1])
            covered.append([{"start": a, "end": b} for a, b in cover])
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        columns = [pa.array([x for x, _ in drawn], pa.string()), lists(ids, pa.int32()), lists(masks, pa.bool_()), lists(starts, pa.int32()), lists(stops, pa.int32()), pa.array(covered, span)]
        return pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns], ["conv_id", "formatted", "input_ids", "loss_mask", "token_starts", "token_ends", "loss_spans"])

    return map_batches(grouped, run, f"conv_id {kind}, formatted string, input_ids array<int>, loss_mask array<boolean>, token_starts array<int>, token_ends array<int>, loss_spans array<struct<start:long,end:long>>")


def read_back(formatted: DataFrame, learn: str = "assistant") -> DataFrame:
    """Digests of what the formatted conversations hold: turns, and the text that the mask's tokens hold."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        flat = {c: (batch.column(c).offsets.to_numpy(), batch.column(c).values.to_numpy(zero_copy_only=False)) for c in ("loss_mask", "token_starts", "token_ends")}
        part = lambda c, i: flat[c][1][flat[c][0][i] : flat[c][0][i + 1]]
        for i, text in enumerate(batch.column("formatted").to_pylist()):
            turns = parse(text)
            told = "".join(f"{r}\n{t}\n" for r, t, _ in turns)
            tokens = np.stack([part("token_starts", i), part("token_ends", i)], axis=1)[part("loss_mask", i)]
            lost = learned_text(text, [at for r, _, at in turns if r == learn], tokens)
            rows.append((len(turns), hashlib.sha256(told.encode()).hexdigest(), len(lost), hashlib.sha256(lost.encode()).hexdigest(), len(text)))
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return map_batches(formatted, run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
