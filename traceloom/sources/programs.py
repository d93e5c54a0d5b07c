"""Program texts derived from canonical events, for operators on sources: what they show says nothing of real programs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.sources.staging import dealt
from traceloom.sources.traces import TRACE

PROGRAM = "program_id"


def statement() -> Column:
    """An event as Python: errors raise, purchases return, clicks are branches that assign, signups loops, all others plain calls."""
    k = F.abs(F.coalesce("k", F.lit(0))).cast("string")
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    name = F.col("function_name")
    return (
        F.when(F.col("event_type") == "exception", line("    raise E", (F.abs(F.coalesce("k", F.lit(0))) % 3).cast("string"), "()\n"))
        .when(F.col("event_type") == "return", line("    return ", k, "\n"))
        .when(name == "click", line("    if click(", k, "):\n        x = x + ", k, "\n"))
        .when(name == "signup", line("    for y in signup(", k, "):\n        pass\n"))
        .otherwise(line("    ", name, "(", k, ")\n"))
    )


def event_sources(events: DataFrame, order: Sequence[str] = ("seq",)) -> DataFrame:
    """program_id, source: a module with a function for each trace, in order, and in it a statement for each event. order: the columns that order the events of a trace.

    A source is one row, as a file is, so a program's statements meet in one row, those of a trace first. Programs are dealt once,
    in parts that parsers can share out.
    """
    told = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["text"]), "")
    rows = dealt(events.select(*TRACE, *order, statement().alias("text")), PROGRAM)
    bodies = rows.groupBy(*TRACE).agg(told(F.struct(*order, "text")).alias("body"))
    head = F.concat(F.lit("def day_"), F.col("input_idx").cast("string"), F.lit("(x):\n"), F.col("body"))
    return bodies.groupBy(PROGRAM).agg(told(F.struct("run_idx", "input_idx", head.alias("text"))).alias("source"))
