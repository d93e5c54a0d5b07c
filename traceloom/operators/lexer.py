"""Tokens of Python sources as a table."""

from __future__ import annotations

import io
import keyword
import tokenize
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROGRAM = "program_id"
#: Kinds of tokens that are kept; comments, line ends and indentation go.
KINDS = {tokenize.NAME: "name", tokenize.NUMBER: "number", tokenize.OP: "operator", tokenize.STRING: "string"}
KEYWORDS = frozenset(keyword.kwlist)


def lexed(source: str | None) -> Iterator[tuple[str, str]]:
    """(kind, token in lower case) up to where the source can't be cut any further."""
    try:
        for t in tokenize.generate_tokens(io.StringIO(source or "").readline):
            if t.type in KINDS:
                yield KINDS[t.type], t.string.lower()
    except (tokenize.TokenError, SyntaxError):
        return


def tokens(sources: DataFrame) -> DataFrame:
    """program_id, at, kind (name, number, operator, string), token of program_id, source; a null source has none.

    Names that are keywords, as written in lower case, are of the kind ``keyword``: so True and None, in lower case here, are names.
    """
    kind = sources.schema[PROGRAM].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, kinds, found = [], [], [], []
            for row, source in enumerate(batch.column("source").to_pylist()):
                for at, (k, token) in enumerate(lexed(source)):
                    rows.append(row)
                    places.append(at)
                    kinds.append("keyword" if k == "name" and token in KEYWORDS else k)
                    found.append(token)
            columns = [batch.column(PROGRAM).take(pa.array(rows, pa.int64())), pa.array(places, pa.int32()), pa.array(kinds, pa.string()), pa.array(found, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [PROGRAM, "at", "kind", "token"])

    return sources.select(PROGRAM, F.col("source").cast("string").alias("source")).mapInArrow(run, f"{PROGRAM} {kind}, at int, kind string, token string")


def token_lists(table: DataFrame, kinds: tuple[str, ...] = ("name", "number", "operator", "string")) -> DataFrame:
    """doc_id, tokens: each program's tokens of some kinds, in order; without ``keyword`` among the kinds, keywords are left out."""
    held = F.array_sort(F.collect_list(F.struct("at", "token")))
    return table.where(F.col("kind").isin(*kinds)).groupBy(F.col(PROGRAM).alias("doc_id")).agg(F.transform(held, lambda t: t["token"]).alias("tokens"))


def token_sets(sources: DataFrame, kinds: tuple[str, ...] = ("name", "number", "operator", "string")) -> DataFrame:
    """doc_id, tokens: the distinct tokens of some kinds of program_id, source, in the order in which they are met, one row a source; as of ``token_lists``, a source without any has none."""
    kind = sources.schema[PROGRAM].dataType.simpleString()

    def told(source: str | None) -> list[str]:
        return list(dict.fromkeys(t for k, t in lexed(source) if ("keyword" if k == "name" and t in KEYWORDS else k) in kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(i, tokens) for i, source in enumerate(batch.column("source")) if (tokens := told(source.as_py()))]
            yield pa.RecordBatch.from_arrays([batch.column(PROGRAM).take(pa.array([i for i, _ in sets], pa.int64())), pa.array([t for _, t in sets], pa.list_(pa.string()))], ["doc_id", "tokens"])

    return sources.select(PROGRAM, F.col("source").cast("string").alias("source")).mapInArrow(run, f"doc_id {kind}, tokens array<string>")
