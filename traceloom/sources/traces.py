"""Canonical traces.

Every trace operator takes two tables:

events: program_id, run_idx, input_idx, seq, event_type (call, return, exception),
function_name, snapshot (map of variable to its repr), ts
traces: program_id, run_idx, input_idx, n_events, coverage (array), exception
(``Type: message`` or null), return_repr, execution_time_ms, truncated

They can be recorded by any tracer. Here they are derived from the event log and
from conversations; what the derived traces show says nothing of real programs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceloom.operators.ordering import joined_on

START = "2024-01-01"
SPLIT_DAY = 15
TRACE = ["program_id", "run_idx", "input_idx"]


def in_order(rows: DataFrame, by: list[str], slice_: str, order: list[str]) -> DataFrame:
    """The rows with seq, their number in order among those of one ``by``, from 0.

    slice_: a column that grows with the order. Rows are numbered within their slice, and slices are counted, so what has very many rows is spread over tasks.
    """
    counts = rows.groupBy(*by, slice_).agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy(*by).orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select(*by, slice_, F.coalesce(earlier, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy(*by, slice_).orderBy(*order)) - 1
    return joined_on(rows.withColumn("own", own), before, [*by, slice_]).withColumn("seq", (F.col("before") + F.col("own")).cast("int")).drop("own", "before", slice_)


def event_rows(log: DataFrame, start: str = START) -> DataFrame:
    """The canonical events without their number in the trace, and with event_id: ts and event_id are their order.

    A user's events of a day are a trace; days before SPLIT_DAY belong to version A of the user, later ones to B. Errors are exceptions, purchases returns, all others calls.
    """
    day = F.datediff(F.to_date("ts"), F.lit(start).cast("date"))
    k = F.nullif(F.regexp_extract("props", r'"k": *(-?[0-9]+)', 1), F.lit("")).cast("long")
    kind = F.when(F.col("event_type") == "error", "exception").when(F.col("event_type") == "purchase", "return").otherwise("call")
    value = F.when(F.col("k") % 10 == 0, "None").otherwise(F.col("value").cast("string"))
    snapshot = F.map_filter(
        F.create_map(F.lit("value"), value, F.lit("k"), F.col("k").cast("string"), F.lit("handle"), F.when(F.col("event_type") == "view", "<view>")),
        lambda name, r: r.isNotNull(),
    )
    named = log.withColumn("input_idx", day).withColumn("k", k).withColumn("program_id", F.concat(F.col("user_id").cast("string"), F.when(day < SPLIT_DAY, ":A").otherwise(":B")))
    return named.select("program_id", F.lit(0).alias("run_idx"), "input_idx", kind.alias("event_type"), F.col("event_type").alias("function_name"), snapshot.alias("snapshot"), "ts", "value", "k", "event_id")


def event_traces(log: DataFrame, start: str = START, cap: int | None = None) -> DataFrame:
    """The canonical events of ``event_rows``, numbered in each trace.

    All events are kept; with a cap those beyond it are cut, as by a tracer that records live.
    """
    rows = event_rows(log, start)
    ranked = in_order(rows.withColumn("minute", F.date_trunc("minute", "ts")), ["program_id", "input_idx"], "minute", ["ts", "event_id"])
    if cap is not None:
        ranked = ranked.where(F.col("seq") < cap)
    return ranked.select("program_id", "run_idx", "input_idx", "seq", "event_type", "function_name", "snapshot", "ts", "value", "k")


def trace_table(events: DataFrame, cap: int | None = None) -> DataFrame:
    """One row a trace. Lines covered are the events' k; the exception and the return value are the last ones seen.

    cap: the one that the events were cut to, if any; a trace that reaches it is truncated.
    """
    truncated = F.lit(False) if cap is None else F.max("seq") >= cap - 1
    last_exception = F.max(F.when(F.col("event_type") == "exception", F.struct("seq", F.concat(F.lit("E"), (F.col("k") % 3).cast("string"), F.lit(": "), F.col("value").cast("string")).alias("told"))))
    last_return = F.max(F.when(F.col("event_type") == "return", F.struct("seq", F.col("snapshot")["value"].alias("told"))))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    span = F.max(micros) - F.min(micros)
    return events.groupBy(*TRACE).agg(
        F.count("*").alias("n_events"), F.array_sort(F.collect_set("k")).alias("coverage"), last_exception["told"].alias("exception"),
        F.coalesce(last_return["told"], F.lit("None")).alias("return_repr"), (span / 1000).alias("execution_time_ms"), truncated.alias("truncated"),
    )


def conversation_traces(conversations: DataFrame) -> DataFrame:
    """A conversation is a program with one trace; turns are calls of their role."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.select(
        F.col("conv_id").cast("string").alias("program_id"), F.lit(0).alias("run_idx"), F.lit(0).alias("input_idx"), (F.row_number().over(order) - 1).alias("seq"),
        F.lit("call").alias("event_type"), F.coalesce("role", F.lit("")).alias("function_name"),
    )


def version_pairs(traces: DataFrame) -> DataFrame:
    """pair_id, left, right: both versions of each user that has both."""
    versions = traces.select("program_id").distinct().select(F.split_part("program_id", F.lit(":"), F.lit(1)).alias("pair_id"), "program_id")
    return versions.groupBy("pair_id").agg(F.min("program_id").alias("left"), F.max("program_id").alias("right")).where("left < right")
