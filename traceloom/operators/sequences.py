"""Order-aware features of traces: anonymous calls, n-grams, depth, runs, phases, precedence, exceptions.

What depends on order is found once, in two steps. ``in_traces`` looks along each trace. ``trace_order`` looks along the
traces of each program, one row a trace, and ``in_programs`` brings that to the events; so a program of any size is
spread over tasks by its traces, and a trace of any size by its chunks. Tables that have these columns already are taken as they are: staged once, they
serve all features by plain grouping.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.functions.measures import binary_entropy, entropy_parts, normalised_entropy, ratio
from traceloom.sources.staging import Workspace
from traceloom.sources.traces import TRACE

PROGRAM = "program_id"
#: Events of a trace that one task looks along at once.
CHUNK = 1 << 16
#: How many times as long the chunks of the next round are, where rounds are needed.
GROUP = 256


def is_call() -> Column:
    return F.col("event_type") == "call"


def anonymise(events: DataFrame) -> DataFrame:
    """program_id, function_name, idx: functions numbered in the order of their first call, run by run, input by input."""
    if "idx" in events.columns:
        return events.where("event_type = 'call'").select(PROGRAM, "function_name", "idx").distinct()
    first = events.where("event_type = 'call'").groupBy(PROGRAM, "function_name").agg(F.min(F.struct("run_idx", "input_idx", "seq")).alias("at"))
    return first.withColumn("idx", F.row_number().over(Window.partitionBy(PROGRAM).orderBy("at")) - 1).drop("at")


def with_index(events: DataFrame) -> DataFrame:
    """The events with the anonymous index of their function; null if it is never called."""
    return events if "idx" in events.columns else events.join(anonymise(events), [PROGRAM, "function_name"], "left")


def in_chunks(events: DataFrame) -> DataFrame:
    """The events with ``chunk``, the stretch of CHUNK events of their trace that they are in."""
    return events.withColumn("chunk", F.floor(F.col("seq") / CHUNK))


def seen_next() -> Column:
    """Type and index of a call or exception; null for other events."""
    return F.when(F.col("event_type").isin("call", "exception"), F.struct(F.col("event_type").alias("type"), F.when(is_call(), F.col("idx")).alias("idx")))


def within(rows: DataFrame, unit: list[str]) -> DataFrame:
    """The events with what stands around them in their unit, a stretch of a trace: s and low (running sum of the steps and its least), pos, prior, run_pos, next_type, next_name, after, next1, next2, next_seen."""
    up = Window.partitionBy(*unit).orderBy("seq")
    below = up.rowsBetween(Window.unboundedPreceding, -1)
    # looking ahead is looking back in descending order
    ahead = Window.partitionBy(*unit).orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    called = F.when(is_call(), F.col("idx"))
    rows = rows.withColumn("s", F.sum(step()).over(up)).withColumn("low", F.min("s").over(up))
    rows = rows.withColumn("pos", F.when(is_call(), F.sum(is_call().cast("long")).over(up) - 1)).withColumn("prior", F.last(called, ignorenulls=True).over(below))
    fresh = F.when(is_call() & (F.col("prior").isNull() | (F.col("prior") != F.col("idx"))), F.col("pos"))
    rows = rows.withColumn("run_pos", F.last(fresh, ignorenulls=True).over(up)).withColumn("next_type", F.lead("event_type").over(up)).withColumn("next_name", F.lead("function_name").over(up))
    if "snapshot" in rows.columns:
        rows = rows.withColumn("after", F.lead("snapshot").over(up))
    rows = rows.withColumn("next1", F.last(called, ignorenulls=True).over(ahead)).withColumn("next_seen", F.last(seen_next(), ignorenulls=True).over(ahead))
    return rows.withColumn("next2", F.last(F.when(is_call(), F.struct("next1")), ignorenulls=True).over(ahead)["next1"])


def ends_of(rows: DataFrame, unit: list[str], *more: Column) -> DataFrame:
    """One row a unit: its calls, the first three and the last, where its last run began, and its first call or exception. pos and run_pos count within the unit."""
    at = lambda n: F.max(F.when(F.col("pos") == n, F.col("idx")))
    opening = F.min(F.when(F.col("event_type").isin("call", "exception"), F.struct("seq", seen_next().alias("seen"))))["seen"]
    return rows.groupBy(*unit).agg(
        F.sum(is_call().cast("long")).alias("n_calls"), at(0).alias("first1"), at(1).alias("first2"), at(2).alias("first3"), F.max(F.when(is_call(), F.struct("pos", "idx")))["idx"].alias("last1"), F.max("run_pos").alias("last_run"), opening.alias("opening"), *more
    )


def carried(ends: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows of ``ends_of`` with what stands before and after each unit among those of one ``by``.

    calls_before, calls: calls before the unit, and in all. prior_call: the last call before. after1, after2: the next two calls after the
    unit. after_seen: type and index of the next call or exception. open_start: the number of the call with which
    the run began that the unit's first call belongs to. open_run: of the call with which the last run before the unit began.
    """
    up = Window.partitionBy(*by).orderBy(*order)
    below = up.rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.last(c, ignorenulls=True).over(below)
    after = lambda c: F.last(c, ignorenulls=True).over(ahead)
    some = F.col("n_calls") > 0
    rows = ends.withColumn("calls_before", F.coalesce(F.sum("n_calls").over(below), F.lit(0))).withColumn("calls", F.sum("n_calls").over(Window.partitionBy(*by)))
    rows = rows.withColumn("prior_call", before("last1")).withColumn("after1", after("first1")).withColumn("after_seen", after("opening"))
    rows = rows.withColumn("after2", after(F.when(some, F.struct(F.coalesce("first2", "after1").alias("i"))))["i"])
    fresh = some & (F.col("prior_call").isNull() | (F.col("first1") != F.col("prior_call")))
    rows = rows.withColumn("fresh", fresh).withColumn("last_start", F.when(some & (F.col("fresh") | (F.col("last_run") > 0)), F.col("calls_before") + F.col("last_run")))
    rows = rows.withColumn("open_run", before("last_start"))
    return rows.withColumn("open_start", F.when(F.col("fresh"), F.col("calls_before")).otherwise(F.col("open_run"))).drop("fresh", "last_start")


def stepped(ends: DataFrame) -> DataFrame:
    """Chunks with s_before and low_before: the sum of the steps before, and its least. ends: TRACE, chunk, total and least of each chunk.

    A chunk maps the depth d before it to max(d + total, total - least); only the sum and the least of all sums so far are carried.
    """
    below = Window.partitionBy(*TRACE).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    rows = ends.withColumn("s_before", F.coalesce(F.sum("total").over(below), F.lit(0)))
    return rows.withColumn("low_before", F.coalesce(F.min(F.col("s_before") + F.col("least")).over(below), F.lit(0)))


def clamped() -> Column:
    """The call depth after an event, from sums in its chunk and what is carried: S minus the least of 0 and S so far."""
    return F.col("s_before") + F.col("s") - F.least(F.lit(0), F.col("low_before"), F.col("s_before") + F.col("low"))


def with_next(events: DataFrame) -> DataFrame:
    """The events with next_type and next_name, as of ``in_traces``, and nothing else that is around them. Only what lies ahead of a chunk of a long trace comes by a join."""
    if "next_type" in events.columns:
        return events
    unit = [*TRACE, "chunk"]
    rows, up = in_chunks(events), Window.partitionBy(*unit).orderBy("seq")
    seen = F.struct("event_type", "function_name")
    long = events.where(F.col("seq") >= CHUNK).select(*TRACE).distinct()
    heads = rows.join(long, TRACE, "left_semi").groupBy(*unit).agg(F.min_by(seen, "seq").alias("head"))
    ahead = F.lead("head").over(Window.partitionBy(*TRACE).orderBy("chunk"))
    ends = heads.select(*unit, ahead.alias("ahead")).where("ahead IS NOT NULL")
    found = rows.withColumn("next", F.lead(seen).over(up)).join(ends, unit, "left").withColumn("next", F.coalesce("next", "ahead"))
    return found.select(*events.columns, F.col("next.event_type").alias("next_type"), F.col("next.function_name").alias("next_name"))


def in_traces(events: DataFrame) -> DataFrame:
    """The events with what stands around them in their trace.

    pos: number of the call in the trace, from 0. prior: index of the call before. run_pos: where the run of calls of one function
    began that the last call so far belongs to. depth: see ``depths``. next_type, next_name: of the event after; after: its snapshot. next1, next2: indices
    of the next two calls. next_seen: type and index of the next call or exception.

    A trace is looked along in chunks of CHUNK events. What lies before and after a chunk comes from one row for each chunk, so a trace of any size is
    spread over tasks.
    """
    if "pos" in events.columns:
        return events
    unit = [*TRACE, "chunk"]
    rows = within(in_chunks(with_index(events)), unit)
    head = F.min_by(F.struct("event_type", "function_name", *["snapshot"] * ("snapshot" in events.columns)), "seq")
    total = F.sum(step())
    ends = carried(ends_of(rows, unit, total.alias("total"), F.min("low").alias("least"), head.alias("head")), TRACE, ["chunk"])
    ends = stepped(ends).withColumn("ahead", F.lead("head").over(Window.partitionBy(*TRACE).orderBy("chunk")))
    rows = rows.join(ends.select(*unit, "calls_before", "prior_call", "after1", "after2", "after_seen", "open_start", "open_run", "s_before", "low_before", "ahead"), unit)
    inner = F.col("next1").isNotNull()
    last = F.col("next_type").isNull()
    begun = F.when(F.col("run_pos") > 0, F.col("calls_before") + F.col("run_pos")).when(F.col("run_pos") == 0, F.col("open_start")).otherwise(F.col("open_run"))
    found = {
        "depth": clamped(), "pos": F.col("calls_before") + F.col("pos"), "prior": F.coalesce("prior", "prior_call"), "run_pos": begun,
        "next_type": F.coalesce("next_type", "ahead.event_type"), "next_name": F.when(last, F.col("ahead.function_name")).otherwise(F.col("next_name")),
        "next1": F.coalesce("next1", "after1"), "next2": F.when(inner, F.coalesce("next2", "after1")).otherwise(F.col("after2")), "next_seen": F.coalesce("next_seen", "after_seen"),
    }
    if "snapshot" in events.columns:
        found["after"] = F.when(last, F.col("ahead.snapshot")).otherwise(F.col("after"))
    return rows.select(*[c for c in events.columns if c not in found and c not in ("idx", "chunk")], "idx", *[c.alias(n) for n, c in found.items()])


def trace_order(events: DataFrame) -> DataFrame:
    """One row a trace: n_calls, max_depth, path (its first three calls), and what ``carried`` tells of the traces of a program in order."""
    deepest = F.max(F.when(is_call(), F.col("depth")).otherwise(0))
    rows = carried(ends_of(in_traces(events), TRACE, deepest.alias("max_depth")), [PROGRAM], ["run_idx", "input_idx"])
    path = F.concat_ws("|", *[F.col(f"first{i}").cast("string") for i in (1, 2, 3)])
    return rows.select(*TRACE, "n_calls", "max_depth", path.alias("path"), "calls_before", "calls", "prior_call", "after1", "after2", "after_seen", "open_start")


def in_programs(events: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """The events with what stands around them in their program, across its traces. order: from ``trace_order``.

    gpos: number of the call in the program. flat1, flat2: the next two calls. pre: the last call before, or -1. upcoming: type and index of
    the next call or exception. run_length: at the last call of a run, how many calls it has. calls: of the program.
    """
    if "gpos" in events.columns:
        return events
    placed = in_traces(events)
    ends = (trace_order(placed) if order is None else order).select(*TRACE, "calls_before", "calls", "prior_call", "after1", "after2", "after_seen", "open_start")
    rows = placed.join(ends, TRACE)
    rows = rows.withColumn("gpos", F.col("calls_before") + F.col("pos")).withColumn("flat1", F.coalesce("next1", "after1"))
    rows = rows.withColumn("flat2", F.when(F.col("next1").isNotNull(), F.coalesce("next2", "after1")).otherwise(F.col("after2")))
    rows = rows.withColumn("pre", F.coalesce("prior", "prior_call", F.lit(-1))).withColumn("upcoming", F.coalesce("next_seen", "after_seen"))
    start = F.when(F.col("run_pos") > 0, F.col("calls_before") + F.col("run_pos")).otherwise(F.col("open_start"))
    last = is_call() & (F.col("flat1").isNull() | (F.col("flat1") != F.col("idx")))
    return rows.withColumn("run_length", F.when(last, F.col("gpos") - start + 1)).drop("calls_before", "prior_call", "after1", "after2", "after_seen", "open_start")


def call_sequence(events: DataFrame) -> DataFrame:
    """The calls with their anonymous index, their place in the trace (pos) and in the whole program (gpos)."""
    return in_programs(events).where("event_type = 'call'").select(*TRACE, "seq", "idx", "pos", "gpos")


def shares(counts: DataFrame, *keys: str) -> DataFrame:
    """Adds share: the part of the counts ``n`` of a program, or of more keys."""
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*(keys or [PROGRAM]))))


def call_frequency(events: DataFrame) -> DataFrame:
    """program_id, idx, n, share."""
    calls = with_index(events).where("event_type = 'call'")
    return shares(calls.groupBy(PROGRAM, "idx").agg(F.count("*").alias("n")))


def bracketed(*parts: str) -> Column:
    """(a,b,...); null if a part is."""
    known = F.lit(True)
    for p in parts:
        known = known & F.col(p).isNotNull()
    return F.when(known, F.concat(F.lit("("), F.concat_ws(",", *[F.col(p).cast("string") for p in parts]), F.lit(")")))


def gram(n: int, by_trace: bool = True) -> Column:
    """The n-gram that begins with a call; null where there aren't enough calls."""
    return bracketed("idx", *[f"{'next' if by_trace else 'flat'}{i}" for i in range(1, n)])


def call_ngrams(events: DataFrame, n: int, by_trace: bool = True) -> DataFrame:
    """program_id, gram ``(a,b,...)``, n, share, for n of 1 to 3. by_trace False lets grams run across the traces of a program."""
    rows = (in_traces if by_trace else in_programs)(events).where("event_type = 'call'")
    grams = rows.select(PROGRAM, gram(n, by_trace).alias("gram")).where("gram IS NOT NULL")
    return shares(grams.groupBy(PROGRAM, "gram").agg(F.count("*").alias("n")))


def event_gram() -> Column:
    """``type/function→type/function`` of an event and the one after; null at the end of a trace."""
    return F.when(F.col("next_type").isNotNull(), F.concat_ws("→", F.concat_ws("/", "event_type", "function_name"), F.concat_ws("/", "next_type", "next_name")))


def event_bigrams(events: DataFrame) -> DataFrame:
    """program_id, gram, n, within traces."""
    pairs = in_traces(events).select(PROGRAM, event_gram().alias("gram")).where("gram IS NOT NULL")
    return pairs.groupBy(PROGRAM, "gram").agg(F.count("*").alias("n"))


def step() -> Column:
    return F.when(F.col("event_type") == "call", 1).when(F.col("event_type") == "return", -1).otherwise(0)


def depths(events: DataFrame) -> DataFrame:
    """The events with the call depth after each: calls add one, returns take one, never below 0.

    With S the running sum, the clamped depth is S minus the running minimum of 0 and S. Sums run in chunks of a trace, and what is before a chunk is added.
    """
    if {"pos", "depth"} <= {*events.columns}:
        return events
    unit = [*TRACE, "chunk"]
    order = Window.partitionBy(*unit).orderBy("seq")
    rows = in_chunks(events).withColumn("s", F.sum(step()).over(order)).withColumn("low", F.min("s").over(order))
    ends = stepped(rows.groupBy(*unit).agg(F.sum(step()).alias("total"), F.min("low").alias("least")))
    joined = rows.join(ends.select(*unit, "s_before", "low_before"), unit).withColumn("depth", clamped())
    return joined.select(*[c for c in events.columns if c != "depth"], "depth")


def trace_depths(events: DataFrame) -> DataFrame:
    """Greatest call depth of each trace; a trace without a call has 0."""
    return depths(events).groupBy(*TRACE).agg(F.max(F.when(F.col("event_type") == "call", F.col("depth")).otherwise(0)).alias("max_depth"))


def run_lengths(events: DataFrame) -> DataFrame:
    """program_id, idx, length: each run of calls of one function, over the whole program."""
    return in_programs(events).where("run_length IS NOT NULL").select(PROGRAM, "idx", F.col("run_length").alias("length"))


def phase() -> Column:
    """The third of the program's calls that a call stands in, 0 to 2; the last takes the rest."""
    third = F.greatest(F.lit(1), F.floor(F.col("calls") / 3))
    return F.least(F.lit(2), F.floor(F.col("gpos") / third)).cast("int")


def phase_diversity(events: DataFrame) -> DataFrame:
    """program_id, phase (0 to 2), diversity: normalised entropy of the calls in each third; the last third takes the rest."""
    calls = in_programs(events).where("event_type = 'call'")
    counts = calls.groupBy(PROGRAM, phase().alias("phase"), "idx").agg(F.count("*").alias("n"))
    return diversity(counts, [PROGRAM, "phase"], "diversity")


def diversity(counts: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Normalised entropy of the counts ``n`` of each key."""
    total = F.sum("n").over(Window.partitionBy(*keys))
    parts = counts.withColumn("bits", entropy_parts(F.col("n"), total))
    return parts.groupBy(*keys).agg(normalised_entropy(F.sum("bits"), F.count("*")).alias(name))


def precedence(events: DataFrame) -> DataFrame:
    """program_id, i, j (i < j), n_ij, n_ji, p: how often i is called before j and after, and the share of before.

    Within a stretch of CHUNK calls of a trace, at each call the stretch's calls of other functions so far are counted. Across stretches and traces, a
    stretch's calls of one function meet the sum of another's calls in earlier ones. Work grows with calls times functions, not with pairs of calls.
    """
    unit = [*TRACE, "chunk"]
    calls = in_traces(events).where("event_type = 'call'").select(*TRACE, F.floor(F.col("pos") / CHUNK).alias("chunk"), "pos", "idx")
    counts = calls.groupBy(*unit, "idx").agg(F.count("*").alias("n"))
    so_far = F.sum((F.col("idx") == F.col("first")).cast("long")).over(Window.partitionBy(*unit, "first").orderBy("pos"))
    within_unit = calls.join(counts.select(*unit, F.col("idx").alias("first")), unit).withColumn("n", so_far).where("idx != first").select(PROGRAM, "first", F.col("idx").alias("second"), "n")
    functions = counts.select(PROGRAM, "idx").distinct()
    grid = counts.select(*unit).distinct().join(functions, PROGRAM).join(counts, [*unit, "idx"], "left")
    earlier = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy(PROGRAM, "idx").orderBy("run_idx", "input_idx", "chunk").rowsBetween(Window.unboundedPreceding, -1))
    sums = grid.select(*unit, F.col("idx").alias("first"), earlier.alias("earlier")).where("earlier > 0")
    across = sums.join(counts.withColumnRenamed("idx", "second"), unit).where("first != second").select(PROGRAM, "first", "second", (F.col("earlier") * F.col("n")).alias("n"))
    low, high = F.least("first", "second").alias("i"), F.greatest("first", "second").alias("j")
    side = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    pairs = within_unit.union(across).groupBy(PROGRAM, low, high).agg(side(F.col("first") < F.col("second")).alias("n_ij"), side(F.col("first") > F.col("second")).alias("n_ji"))
    return pairs.withColumn("p", F.col("n_ij") / (F.col("n_ij") + F.col("n_ji")))


def causal_entropy(pairs: DataFrame) -> DataFrame:
    """Mean binary entropy of the precedence shares."""
    return pairs.groupBy(PROGRAM).agg(F.avg(binary_entropy(F.col("p"))).alias("causal_entropy"))


def post() -> Column:
    """The function called next after an exception, unless another exception comes first; -1 stands for none."""
    return F.when(F.col("upcoming.type") == "call", F.col("upcoming.idx")).otherwise(-1)


def recovered() -> Column:
    return F.coalesce(F.col("upcoming.type") == "call", F.lit(False))


def exception_contexts(events: DataFrame, type_column: str = "function_name") -> DataFrame:
    """Each exception with the function called last before it, its type, and the one called next, unless another exception comes first.

    Over the whole program; -1 stands for none. The type is the raw function name, as in the evaluated form; name
    another column to take types from.
    """
    seen = in_programs(events).where("event_type = 'exception'")
    return seen.select(PROGRAM, "pre", F.col(type_column).alias("type"), post().alias("post"), recovered().alias("recovered"))


def exception_triples(events: DataFrame) -> DataFrame:
    return exception_contexts(events).groupBy(PROGRAM, bracketed("pre", "type", "post").alias("triple")).agg(F.count("*").alias("n"))


def recovery_rate(events: DataFrame) -> DataFrame:
    return exception_contexts(events).groupBy(PROGRAM).agg(F.avg(F.col("recovered").cast("int")).alias("recovery_rate"))


def phase_timing(events: DataFrame) -> DataFrame:
    """program_id, function_name, share: a function's share of a trace's events, averaged over all traces."""
    counts = events.groupBy(*TRACE, "function_name").agg(F.count("*").alias("n"))
    shares = counts.withColumn("part", F.col("n") / F.sum("n").over(Window.partitionBy(*TRACE)))
    traces = events.select(*TRACE).distinct().groupBy(PROGRAM).agg(F.count("*").alias("traces"))
    return shares.groupBy(PROGRAM, "function_name").agg(F.sum("part").alias("parts")).join(traces, PROGRAM).select(PROGRAM, "function_name", (F.col("parts") / F.col("traces")).alias("share"))


def closed_calls(events: DataFrame, chunk: int | None = None) -> DataFrame:
    """Calls that return: program_id, function_name, n, events (how many lie between call and return, summed).

    A return closes the innermost open call if the names match, and is else ignored. A chunk of a trace is gone through once with a stack of its own: what closes within is
    counted, and there remain, in order, the returns that met an empty stack and the calls still open. These are all that the next round, with chunks GROUP times as
    long, looks at; in the last round a chunk holds what remains of a trace. A stretch leaves no more than it is deep, so a hot trace never meets in one task.
    """
    size = chunk or CHUNK
    longest = events.agg(F.max("seq")).first()[0]
    rows = events.where("event_type IN ('call', 'return')").select(*TRACE, F.col("seq").cast("long").alias("seq"), (F.col("event_type") == "call").alias("opens"), "function_name")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in rows.columns) + ", n long, events long"
    done = None
    with Workspace(events.sparkSession, "closed-calls") as work:
        while True:
            last = longest is None or size > longest
            unit = rows.withColumn("chunk", F.floor(F.col("seq") / size))
            folded = work.stage(unit.groupBy(*TRACE, "chunk").applyInPandas(folder(last), schema), "folded")
            closed = folded.where("n IS NOT NULL").groupBy(PROGRAM, "function_name").agg(F.sum("n").alias("n"), F.sum("events").alias("events"))
            done = closed if done is None else done.union(closed)
            if last:
                whole = done.groupBy(PROGRAM, "function_name").agg(F.sum("n").alias("n"), F.sum("events").alias("events"))
                return work.keep(whole, "closed-calls")
            rows, size = folded.where("n IS NULL").drop("n", "events"), size * GROUP


def folder(last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda group: fold_calls(group, last)


def fold_calls(group: pd.DataFrame, last: bool) -> pd.DataFrame:
    """Calls closed in one chunk, counted by function, and, unless it is the last round, the events that remain."""
    group = group.sort_values("seq", kind="stable")
    open_at: list[int] = []
    left: list[int] = []
    counts: dict = {}
    names, seqs, opens = group["function_name"].tolist(), group["seq"].tolist(), group["opens"].tolist()
    for i, (name, opening) in enumerate(zip(names, opens, strict=True)):
        if opening:
            open_at.append(i)
        elif not open_at:
            left.append(i)
        elif names[open_at[-1]] == name:
            j = open_at.pop()
            n, events = counts.get(name, (0, 0))
            counts[name] = (n + 1, events + seqs[i] - seqs[j])
    rest = group.iloc[[] if last else left + open_at].drop(columns="chunk")
    closed = group.iloc[[0] * len(counts)].drop(columns="chunk").assign(function_name=list(counts)) if counts else rest.iloc[:0]
    told = pd.concat([rest.assign(n=None, events=None), closed.assign(n=[n for n, _ in counts.values()], events=[e for _, e in counts.values()])])
    return told.astype({"n": "Int64", "events": "Int64"})


def call_latency(events: DataFrame) -> DataFrame:
    """program_id, function_name, latency: mean distance in events from a call to its return, see ``closed_calls``."""
    return closed_calls(events).select(PROGRAM, "function_name", (F.col("events") / F.col("n")).alias("latency"))


def hot_path(events: DataFrame, top: int = 5, named: bool = False) -> DataFrame:
    """program_id, path, path_hash: the most called functions, by anonymous index or by name."""
    counts = call_frequency(events).drop("share") if not named else events.where("event_type = 'call'").groupBy(PROGRAM, F.col("function_name").alias("idx")).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(PROGRAM).orderBy(F.desc("n"), "idx"))).where(F.col("rank") <= top)
    paths = ranked.groupBy(PROGRAM).agg(F.array_sort(F.collect_list(F.struct("rank", F.col("idx").cast("string").alias("told")))).alias("ranked"))
    path = F.array_join(F.transform("ranked", lambda r: r["told"]), "|")
    return paths.select(PROGRAM, path.alias("path"), F.substring(F.sha2(path, 256), 1, 16).alias("path_hash"))


def loop_score(runs: DataFrame) -> DataFrame:
    """Coefficient of variation of the run lengths; 0 for fewer than two runs."""
    spread = F.when(F.count("*") < 2, 0.0).otherwise(ratio(F.stddev_pop("length"), F.avg("length")))
    return runs.groupBy(PROGRAM).agg(spread.alias("loop_score"))
