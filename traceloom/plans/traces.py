"""Queries on the traces derived from ``events`` and ``conversations``, and their SQL twins."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.operators import distances, genomes, sequences, states
from traceloom.plans.registry import query
from traceloom.sources import traces as sources
from traceloom.sources.staging import Workspace
from traceloom.sources.tables import read_table


def inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """events, traces and the pairs of versions, for queries that read them once."""
    events = sources.event_traces(read_table(spark, sf_dir, "events"))
    traces = sources.trace_table(events)
    return events, traces, sources.version_pairs(events)


#: Families that look across the traces of a program.
ACROSS = {"flat2", "trigrams", "triples", "runs", "phases"}


def staged(*families: str, with_traces: bool = True):
    """Turn a function of (events, traces, pairs, counted) into a query that reads ``events`` once.

    The canonical events with all that order tells of them, the traces and, of the families named, the occurrences are staged tables, as far as they are needed: only families
    across traces look along programs, and without ``with_traces`` there is no table of traces. The result is staged too, and the others are deleted.
    """

    def register(function):
        @wraps(function)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            with Workspace(spark, function.__name__) as work:
                events = work.stage(sequences.in_traces(sources.event_traces(read_table(spark, sf_dir, "events"))), "placed")
                traces = work.stage(sources.trace_table(events).join(sequences.trace_order(events), sources.TRACE), "traces") if with_traces or ACROSS & {*families} else None
                if ACROSS & {*families}:
                    events = work.stage(sequences.in_programs(events, traces), "events")
                counted = work.stage(genomes.occurrences(events, families), "occurrences") if families else None
                return work.keep(function(events, traces, sources.version_pairs(events if traces is None else traces), counted), "result")

        return run

    return register


#: The canonical tables in SQL. Every query below continues this WITH list.
BASE = """
WITH days AS (
  SELECT *, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS d, TRY_CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) AS k FROM events),
ev AS (
  SELECT user_id || CASE WHEN d < 15 THEN ':A' ELSE ':B' END AS program_id, d AS input_idx,
    row_number() OVER (PARTITION BY user_id, d ORDER BY ts, event_id) - 1 AS seq,
    CASE event_type WHEN 'error' THEN 'exception' WHEN 'purchase' THEN 'return' ELSE 'call' END AS et, event_type AS fn, value, k, ts
  FROM days),
firsts AS (SELECT program_id, fn, min(input_idx * 1000000 + seq) AS p FROM ev WHERE et = 'call' GROUP BY ALL),
anon AS (SELECT program_id, fn, row_number() OVER (PARTITION BY program_id ORDER BY p) - 1 AS idx FROM firsts),
calls AS (
  SELECT e.program_id, e.input_idx, e.seq, a.idx, row_number() OVER (PARTITION BY e.program_id, e.input_idx ORDER BY e.seq) - 1 AS pos,
    row_number() OVER (PARTITION BY e.program_id ORDER BY e.input_idx, e.seq) - 1 AS gpos
  FROM ev e JOIN anon a USING (program_id, fn) WHERE e.et = 'call'),
tr AS (
  SELECT program_id, input_idx, count(*) AS n_events, list_sort(list_distinct(list(k))) AS coverage,
    max_by('E' || (k % 3) || ': ' || value, seq) FILTER (et = 'exception') AS exception,
    coalesce(max_by(CASE WHEN k % 10 = 0 THEN 'None' ELSE CAST(value AS VARCHAR) END, seq) FILTER (et = 'return'), 'None') AS return_repr,
    (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000 AS ms
  FROM ev GROUP BY ALL),
vp AS (SELECT split_part(program_id, ':', 1) AS pair_id, min(program_id) AS l, max(program_id) AS r FROM (SELECT DISTINCT program_id FROM ev) GROUP BY ALL HAVING min(program_id) < max(program_id))
"""
FREQ = ", freq AS (SELECT *, n / sum(n) OVER (PARTITION BY program_id) AS share FROM (SELECT program_id, idx, count(*) AS n FROM calls GROUP BY ALL))"
GRAMS2 = """, big AS (SELECT *, n / sum(n) OVER (PARTITION BY program_id) AS share FROM (SELECT program_id, gram, count(*) AS n FROM (
  SELECT program_id, '(' || idx || ',' || lead(idx) OVER (PARTITION BY program_id, input_idx ORDER BY seq) || ')' AS gram FROM calls) WHERE gram IS NOT NULL GROUP BY ALL))"""
FLAT2 = """, flat2 AS (SELECT program_id, gram, count(*) AS n FROM (
  SELECT program_id, '(' || idx || ',' || lead(idx) OVER (PARTITION BY program_id ORDER BY gpos) || ')' AS gram FROM calls) WHERE gram IS NOT NULL GROUP BY ALL)"""
FLAT3 = """, tri AS (SELECT *, n / sum(n) OVER (PARTITION BY program_id) AS share FROM (SELECT program_id, gram, count(*) AS n FROM (
  SELECT program_id, '(' || idx || ',' || lead(idx) OVER w || ',' || lead(idx, 2) OVER w || ')' AS gram FROM calls WINDOW w AS (PARTITION BY program_id ORDER BY gpos)) WHERE gram IS NOT NULL GROUP BY ALL))"""
DEPTHS = """, sums AS (SELECT *, sum(CASE et WHEN 'call' THEN 1 WHEN 'return' THEN -1 ELSE 0 END) OVER (PARTITION BY program_id, input_idx ORDER BY seq) AS s FROM ev),
deep AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY program_id, input_idx ORDER BY seq)) AS depth FROM sums),
deepest AS (SELECT program_id, input_idx, max(CASE WHEN et = 'call' THEN depth ELSE 0 END) AS max_depth FROM deep GROUP BY ALL)"""
CONSISTENCY = """, placed AS (SELECT program_id, coverage, row_number() OVER (PARTITION BY program_id ORDER BY input_idx) AS at FROM tr),
near AS (SELECT a.program_id, CASE WHEN len(list_distinct(list_concat(a.coverage, b.coverage))) = 0 THEN 1.0 ELSE len(list_intersect(a.coverage, b.coverage)) / len(list_distinct(list_concat(a.coverage, b.coverage))) END AS j
  FROM placed a JOIN placed b ON a.program_id = b.program_id AND b.at BETWEEN a.at + 1 AND a.at + 5),
cons AS (SELECT p.program_id, coalesce(avg(j), 1.0) AS coverage_consistency FROM (SELECT DISTINCT program_id FROM tr) p LEFT JOIN near USING (program_id) GROUP BY ALL)"""
SIGNATURES = """, ncalls AS (SELECT program_id, input_idx, count(*) FILTER (et = 'call') AS c FROM ev GROUP BY ALL),
sigs AS (SELECT program_id, substr(md5(array_to_string(coverage, ',') || '|' || c || '|' || coalesce(split_part(exception, ':', 1), '')), 1, 8) AS signature, count(*) AS n FROM tr JOIN ncalls USING (program_id, input_idx) GROUP BY ALL)"""
STABILITY = """, paths AS (SELECT t.program_id, t.input_idx, coalesce(string_agg(c.idx, '|' ORDER BY c.pos), '') AS path FROM tr t LEFT JOIN (SELECT * FROM calls WHERE pos < 3) c USING (program_id, input_idx) GROUP BY ALL),
stable AS (SELECT program_id, max(n) / sum(n) AS hot_path_stability FROM (SELECT program_id, path, count(*) AS n FROM paths GROUP BY ALL) GROUP BY ALL)"""
CAUSALITY = """, told AS (SELECT d.program_id, coalesce(a.idx, -1) AS fnx, split_part(t.exception, ':', 1) AS cls, d.depth FROM deep d JOIN tr t USING (program_id, input_idx) LEFT JOIN anon a USING (program_id, fn) WHERE d.et = 'exception' AND t.exception IS NOT NULL),
cause AS (SELECT p.program_id, substr(sha256(coalesce(string_agg(fnx || ':' || cls || ':' || depth, '|' ORDER BY fnx, cls, depth), 'no_exceptions')), 1, 16) AS causality_hash FROM (SELECT DISTINCT program_id FROM tr) p LEFT JOIN told USING (program_id) GROUP BY ALL)"""
RUNS = """, fresh AS (SELECT program_id, idx, gpos, CASE WHEN idx = lag(idx) OVER (PARTITION BY program_id ORDER BY gpos) THEN 0 ELSE 1 END AS f FROM calls),
runs AS (SELECT program_id, run, idx, count(*) AS length FROM (SELECT *, sum(f) OVER (PARTITION BY program_id ORDER BY gpos) AS run FROM fresh) GROUP BY ALL)"""
PHASES = """, ph AS (SELECT program_id, least(2, gpos // greatest(1, c // 3)) AS phase, idx, count(*) AS n FROM (SELECT *, count(*) OVER (PARTITION BY program_id) AS c FROM calls) GROUP BY ALL)"""
PRECEDENCE = """, pr AS (SELECT program_id, least(x, o) AS i, greatest(x, o) AS j, sum(CASE WHEN o < x THEN sofar ELSE 0 END) AS n_ij, sum(CASE WHEN o > x THEN sofar ELSE 0 END) AS n_ji FROM (
  SELECT c.program_id, c.idx AS x, a.idx AS o, count(*) FILTER (c.idx = a.idx) OVER (PARTITION BY c.program_id, a.idx ORDER BY c.gpos) AS sofar FROM calls c JOIN anon a USING (program_id)) WHERE x <> o GROUP BY ALL)"""
CONTEXTS = """, ce AS (SELECT e.*, CASE WHEN e.et = 'call' THEN coalesce(a.idx, -1) END AS called FROM ev e LEFT JOIN anon a USING (program_id, fn) WHERE e.et IN ('call', 'exception')),
ctx AS (SELECT program_id, coalesce(pre, -1) AS pre, fn AS type, CASE WHEN nt = 'call' THEN ni ELSE -1 END AS post, coalesce(nt = 'call', false) AS recovered FROM (
  SELECT *, last_value(called IGNORE NULLS) OVER (PARTITION BY program_id ORDER BY input_idx, seq ROWS UNBOUNDED PRECEDING) AS pre, lead(et) OVER w AS nt, lead(called) OVER w AS ni FROM ce WINDOW w AS (PARTITION BY program_id ORDER BY input_idx, seq)) WHERE et = 'exception')"""
STATES = """, vars AS (
  SELECT program_id, input_idx, seq, unnest([{'var': 'value', 'r': CASE WHEN k % 10 = 0 THEN 'None' ELSE CAST(value AS VARCHAR) END}, {'var': 'k', 'r': CAST(k AS VARCHAR)}, {'var': 'handle', 'r': CASE WHEN fn = 'view' THEN '<view>' END}], recursive := true) FROM ev),
av AS (SELECT program_id, input_idx, seq, var, r, CASE WHEN r = 'None' THEN 'NULL' WHEN r LIKE '<%' THEN 'NON_NULL' WHEN CAST(TRY_CAST(r AS DOUBLE) AS DOUBLE) = 0 THEN 'ZERO' WHEN TRY_CAST(r AS DOUBLE) > 0 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS v FROM vars WHERE r IS NOT NULL),
steps AS (SELECT e.program_id, e.input_idx, e.seq, coalesce(a.idx, 0) AS func_idx, e.et = 'exception' AS x0, lead(e.et) OVER (PARTITION BY e.program_id, e.input_idx ORDER BY e.seq) = 'exception' AS x1 FROM ev e LEFT JOIN anon a USING (program_id, fn)),
live AS (SELECT * FROM steps WHERE x1 IS NOT NULL),
named AS (SELECT l.*, n.var FROM live l, (SELECT unnest(['value', 'k', 'handle']) AS var) n),
moves AS (SELECT n.*, coalesce(p.v, 'ABSENT') AS pre, coalesce(q.v, 'ABSENT') AS post FROM named n
  LEFT JOIN av p ON p.program_id = n.program_id AND p.input_idx = n.input_idx AND p.seq = n.seq AND p.var = n.var
  LEFT JOIN av q ON q.program_id = n.program_id AND q.input_idx = n.input_idx AND q.seq = n.seq + 1 AND q.var = n.var),
kinds AS (SELECT program_id, func_idx, pre, CASE
    WHEN pre = 'ABSENT' THEN CASE WHEN post = 'NULL' OR x1 THEN 'error_transition' WHEN var = 'handle' THEN 'resource_acquire' ELSE 'state_creation' END
    WHEN post = 'ABSENT' THEN CASE WHEN var = 'handle' THEN 'resource_release' WHEN x0 THEN 'error_recovery' ELSE 'state_deletion' END
    WHEN x0 AND NOT x1 THEN 'error_recovery' WHEN x1 THEN 'error_transition' ELSE 'state_mutation' END AS kind, post
  FROM moves WHERE pre <> post
  UNION ALL SELECT program_id, func_idx, CASE WHEN x0 THEN 'EXCEPTION_STATE' ELSE 'NORMAL' END, CASE WHEN x0 THEN 'error_recovery' ELSE 'error_transition' END, CASE WHEN x0 THEN 'NORMAL' ELSE 'EXCEPTION_STATE' END FROM live WHERE x0 <> x1),
trans AS (SELECT program_id, func_idx, pre, kind, post, count(*) AS n FROM kinds GROUP BY ALL)"""


def entropy_sql(table: str, keys: str, name: str) -> str:
    """Normalised entropy of the counts n."""
    return f"SELECT {keys}, CASE WHEN count(*) <= 1 THEN 0.0 ELSE -sum(n / t * log2(n / t)) / log2(count(*)) END AS {name} FROM (SELECT *, sum(n) OVER (PARTITION BY {keys}) AS t FROM {table}) GROUP BY ALL"


def met_sql(name: str, table: str, key: str, weight: str) -> str:
    """CTE of both sides' weights of each key of a pair: pair_id, key, a, b."""
    return f""", {name} AS (SELECT pair_id, key, sum(a) AS a, sum(b) AS b FROM (
  SELECT vp.pair_id, {key} AS key, CAST({weight} AS DOUBLE) AS a, 0.0 AS b FROM vp JOIN {table} t ON t.program_id = vp.l
  UNION ALL SELECT vp.pair_id, {key}, 0.0, CAST({weight} AS DOUBLE) FROM vp JOIN {table} t ON t.program_id = vp.r) GROUP BY ALL)"""


L1 = "least(1.0, sum(abs(a - b)) / 2)"
JACCARD = "1 - count(*) FILTER (a > 0 AND b > 0) / count(*)"
WEIGHTED = "1 - sum(least(a, b)) / sum(greatest(a, b))"


@query(BASE + "SELECT program_id, fn AS function_name, idx FROM anon")
def anon_call_index(spark, sf_dir):
    return sequences.anonymise(inputs(spark, sf_dir)[0])


@query(BASE + FREQ + " SELECT program_id, idx, n, round(share, 6) AS share FROM freq")
def call_freq(spark, sf_dir):
    return sequences.call_frequency(inputs(spark, sf_dir)[0])


@query(BASE + GRAMS2 + " SELECT program_id, gram, n, round(share, 6) AS share FROM big")
def call_bigrams(spark, sf_dir):
    return sequences.call_ngrams(inputs(spark, sf_dir)[0], 2)


@query(BASE + FLAT3 + " SELECT program_id, gram, n, round(share, 6) AS share FROM tri")
def call_trigrams(spark, sf_dir):
    return sequences.call_ngrams(inputs(spark, sf_dir)[0], 3, by_trace=False)


@query(BASE + DEPTHS + " SELECT program_id, CAST(depth AS BIGINT) AS depth, count(*) AS n FROM deep GROUP BY ALL")
def call_depth_profile(spark, sf_dir):
    return states.depth_profile(inputs(spark, sf_dir)[0])


@query(BASE + ", nn AS (SELECT program_id, idx, count(*) AS n FROM calls GROUP BY ALL), named AS (SELECT *, row_number() OVER (PARTITION BY program_id ORDER BY n DESC, idx) AS k FROM nn) SELECT program_id, string_agg(idx, '|' ORDER BY k) AS path, substr(sha256(string_agg(idx, '|' ORDER BY k)), 1, 16) AS path_hash FROM named WHERE k <= 5 GROUP BY ALL")
def hot_path_top5(spark, sf_dir):
    return sequences.hot_path(inputs(spark, sf_dir)[0])


def nested_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as one trace of calls that return: views, clicks and signups call, purchases and errors return, and k names one of three functions."""
    log = read_table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    k = F.coalesce(F.nullif(F.regexp_extract("props", r'"k": *(-?[0-9]+)', 1), F.lit("")).cast("long"), F.lit(0))
    kind = F.when(F.col("event_type").isin("purchase", "error"), "return").otherwise("call")
    ordered = sources.in_order(log, ["user_id"], "day", ["ts", "event_id"])
    return ordered.select(F.col("user_id").cast("string").alias("program_id"), F.lit(0).alias("run_idx"), F.lit(0).alias("input_idx"), "seq", kind.alias("event_type"), F.concat(F.lit("f"), (k % 3).cast("string")).alias("function_name"))


NESTED = """
WITH RECURSIVE ne AS (SELECT CAST(user_id AS VARCHAR) AS program_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, event_type NOT IN ('purchase', 'error') AS opens,
    'f' || (coalesce(TRY_CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT), 0) % 3) AS fn FROM events),
st AS (SELECT program_id, CAST(-1 AS BIGINT) AS seq, CAST([] AS STRUCT(fn VARCHAR, p BIGINT)[]) AS stack, CAST(NULL AS VARCHAR) AS fn, CAST(NULL AS BIGINT) AS took FROM (SELECT DISTINCT program_id FROM ne)
  UNION ALL SELECT e.program_id, e.seq, CASE WHEN e.opens THEN list_append(stack, {'fn': e.fn, 'p': e.seq}) WHEN len(stack) > 0 AND stack[-1].fn = e.fn THEN stack[1:len(stack) - 1] ELSE stack END,
    CASE WHEN NOT e.opens AND len(stack) > 0 AND stack[-1].fn = e.fn THEN e.fn END, CASE WHEN NOT e.opens AND len(stack) > 0 AND stack[-1].fn = e.fn THEN e.seq - stack[-1].p END
  FROM st JOIN ne e ON e.program_id = st.program_id AND e.seq = st.seq + 1)
"""


@query(NESTED + "SELECT program_id, fn AS function_name, round(avg(took), 6) AS latency FROM st WHERE took IS NOT NULL GROUP BY ALL")
def call_latency(spark, sf_dir):
    return sequences.call_latency(nested_events(spark, sf_dir))


@query(BASE + "SELECT program_id, count(*) AS n_traces, round(avg(CASE WHEN exception IS NOT NULL THEN 1 ELSE 0 END), 6) AS exception_rate, coalesce(string_agg(DISTINCT split_part(exception, ':', 1), ',' ORDER BY split_part(exception, ':', 1)), '') AS types FROM tr GROUP BY ALL")
def exception_rate(spark, sf_dir):
    from traceloom.functions.reprs import exception_class

    traces = inputs(spark, sf_dir)[1]
    types = F.array_join(F.array_sort(F.collect_set(exception_class(F.col("exception")))), ",")
    return traces.groupBy("program_id").agg(F.count("*").alias("n_traces"), F.avg(F.col("exception").isNotNull().cast("int")).alias("exception_rate"), types.alias("types"))


@query(BASE + CONSISTENCY + ", lines AS (SELECT program_id, count(DISTINCT k) AS coverage_size FROM ev GROUP BY ALL) SELECT program_id, coverage_size, round(coverage_consistency, 6) AS coverage_consistency FROM lines JOIN cons USING (program_id)")
def coverage_size(spark, sf_dir):
    events, traces, _ = inputs(spark, sf_dir)
    return genomes.trace_scalars(events, traces).select("program_id", "coverage_size", "coverage_consistency")


@query(BASE + DEPTHS + " SELECT program_id, round(avg(max_depth), 6) AS depth_mean, CAST(max(max_depth) AS BIGINT) AS depth_max, round(var_pop(max_depth), 6) AS depth_variance FROM deepest GROUP BY ALL")
def trace_depth_stats(spark, sf_dir):
    events = inputs(spark, sf_dir)[0]
    return sequences.trace_depths(events).groupBy("program_id").agg(F.avg("max_depth").alias("depth_mean"), F.max("max_depth").alias("depth_max"), F.var_pop("max_depth").alias("depth_variance"))


@query(BASE + "SELECT program_id, round(avg(n_events), 6) AS length_mean, round(stddev_pop(n_events), 6) AS length_std, min(n_events) AS length_min, max(n_events) AS length_max, round(avg(ms) / 1000, 3) AS time_mean, round(stddev_pop(ms) / 1000, 3) AS time_std FROM tr GROUP BY ALL")
def trace_length_stats(spark, sf_dir):
    events, traces, _ = inputs(spark, sf_dir)
    rows = genomes.trace_scalars(events, traces)
    return rows.select("program_id", "length_mean", "length_std", "length_min", "length_max", F.round(F.col("time_mean") / 1000, 3).alias("time_mean"), F.round(F.col("time_std") / 1000, 3).alias("time_std"))


@query(BASE + SIGNATURES + " SELECT program_id, round(input_sensitivity, 6) AS input_sensitivity FROM (" + entropy_sql("sigs", "program_id", "input_sensitivity") + ")")
def per_trace_signature_entropy(spark, sf_dir):
    events, traces, _ = inputs(spark, sf_dir)
    return sequences.diversity(genomes.trace_signatures(events, traces), ["program_id"], "input_sensitivity")


@query(BASE + STABILITY + " SELECT program_id, round(hot_path_stability, 6) AS hot_path_stability FROM stable")
def hot_path_stability(spark, sf_dir):
    return genomes.hot_path_stability(inputs(spark, sf_dir)[0])


@query(BASE + DEPTHS + CAUSALITY + " SELECT program_id, causality_hash FROM cause")
def exception_causality(spark, sf_dir):
    events, traces, _ = inputs(spark, sf_dir)
    return genomes.exception_causality(events, traces)


@query(BASE + PHASES + " SELECT program_id, phase, round(diversity, 6) AS diversity FROM (" + entropy_sql("ph", "program_id, phase", "diversity") + ")")
def phase_diversity(spark, sf_dir):
    return sequences.phase_diversity(inputs(spark, sf_dir)[0])


@query(BASE + RUNS + " SELECT program_id, idx, count(*) AS n_runs, max(length) AS longest, round(avg(length), 6) AS mean_length FROM runs GROUP BY ALL")
def run_lengths(spark, sf_dir):
    runs = sequences.run_lengths(inputs(spark, sf_dir)[0])
    return runs.groupBy("program_id", "idx").agg(F.count("*").alias("n_runs"), F.max("length").alias("longest"), F.avg("length").alias("mean_length"))


@query(BASE + RUNS + " SELECT program_id, round(CASE WHEN count(*) < 2 THEN 0.0 ELSE stddev_pop(length) / avg(length) END, 6) AS loop_score FROM runs GROUP BY ALL")
def loop_score(spark, sf_dir):
    return sequences.loop_score(sequences.run_lengths(inputs(spark, sf_dir)[0]))


@query(BASE + PRECEDENCE + " SELECT program_id, i, j, CAST(n_ij AS BIGINT) AS n_ij, CAST(n_ji AS BIGINT) AS n_ji, round(n_ij / (n_ij + n_ji), 6) AS p FROM pr")
def causal_precedence(spark, sf_dir):
    return sequences.precedence(inputs(spark, sf_dir)[0])


@query(BASE + CONTEXTS + " SELECT program_id, '(' || pre || ',' || type || ',' || post || ')' AS triple, count(*) AS n FROM ctx GROUP BY ALL")
def exception_triples(spark, sf_dir):
    return sequences.exception_triples(inputs(spark, sf_dir)[0])


@query(BASE + CONTEXTS + " SELECT program_id, round(avg(CASE WHEN recovered THEN 1 ELSE 0 END), 6) AS recovery_rate FROM ctx GROUP BY ALL")
def exception_recovery(spark, sf_dir):
    return sequences.recovery_rate(inputs(spark, sf_dir)[0])


@query(BASE + STATES + " SELECT program_id, func_idx, pre, kind, post, n FROM trans")
def state_transitions(spark, sf_dir):
    return states.state_transitions(inputs(spark, sf_dir)[0])


SNAPS = """, snaps AS (SELECT program_id, input_idx, seq, CASE WHEN k % 10 = 0 THEN 'None' ELSE CAST(value AS VARCHAR) END AS v, CAST(k AS VARCHAR) AS kk, coalesce(CASE WHEN fn = 'view' THEN '<view>' END, '') AS h FROM ev),
diffs AS (SELECT program_id, (v <> lag(v) OVER w)::INT + (kk <> lag(kk) OVER w)::INT + (h <> lag(h) OVER w)::INT AS c FROM snaps WINDOW w AS (PARTITION BY program_id, input_idx ORDER BY seq)),
spaces AS (SELECT program_id, count(DISTINCT (v, kk, h)) AS state_space_size FROM snaps GROUP BY ALL),
muts AS (SELECT program_id, avg(CASE WHEN c > 0 THEN 1 ELSE 0 END) AS mutation_rate, sum(c) AS changes FROM diffs WHERE c IS NOT NULL GROUP BY ALL)"""


@query(BASE + SNAPS + " SELECT program_id, state_space_size, round(coalesce(mutation_rate, 0.0), 6) AS mutation_rate, CAST(coalesce(changes, 0) AS BIGINT) AS state_transition_count FROM spaces LEFT JOIN muts USING (program_id)")
def state_summary(spark, sf_dir):
    return states.state_summary(inputs(spark, sf_dir)[0])


@query(BASE + STATES + " SELECT program_id, CASE WHEN r = 'None' THEN 'NoneType' WHEN r = '<view>' THEN 'view' WHEN regexp_matches(r, '^-?[0-9]+$') THEN 'int' ELSE 'float' END AS type, count(*) AS n FROM vars WHERE r IS NOT NULL GROUP BY ALL")
def heap_types(spark, sf_dir):
    return states.heap_types(inputs(spark, sf_dir)[0])


@query(BASE + ", two AS (SELECT program_id, et || '/' || fn || '→' || lead(et || '/' || fn) OVER (PARTITION BY program_id, input_idx ORDER BY seq) AS gram FROM ev) SELECT program_id, gram, count(*) AS n FROM two WHERE gram IS NOT NULL GROUP BY ALL")
def event_ngrams(spark, sf_dir):
    return sequences.event_bigrams(inputs(spark, sf_dir)[0])


TIMING = """, parts AS (SELECT *, n / sum(n) OVER (PARTITION BY program_id, input_idx) AS part FROM (SELECT program_id, input_idx, fn, count(*) AS n FROM ev GROUP BY ALL)),
ntr AS (SELECT program_id, count(*) AS t FROM tr GROUP BY ALL),
timing AS (SELECT program_id, fn, sum(part) / any_value(t) AS share FROM parts JOIN ntr USING (program_id) GROUP BY ALL)"""


@query(BASE + TIMING + " SELECT program_id, fn AS function_name, round(share, 6) AS share FROM timing")
def phase_timing(spark, sf_dir):
    return sequences.phase_timing(inputs(spark, sf_dir)[0])


@query(BASE + ", c AS (SELECT program_id, et, count(*) AS n FROM ev GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY program_id) AS t FROM c) SELECT program_id, round(-sum(n / t * ln(n / t)), 6) AS temporal_entropy FROM t GROUP BY ALL")
def temporal_entropy(spark, sf_dir):
    return genomes.temporal_entropy(inputs(spark, sf_dir)[0])


OUTPUTS = """, outs AS (SELECT program_id, CASE WHEN exception IS NOT NULL THEN 'exception' WHEN return_repr = 'None' THEN 'None' WHEN CAST(return_repr AS DOUBLE) = 0 THEN 'zero' WHEN CAST(return_repr AS DOUBLE) > 0 THEN 'positive_int' ELSE 'negative_int' END AS category, count(*) AS n FROM tr GROUP BY ALL)"""


@query(BASE + OUTPUTS.replace("CAST(return_repr", "TRY_CAST(return_repr") + " SELECT program_id, category, n FROM outs")
def output_categories(spark, sf_dir):
    return genomes.output_histogram(inputs(spark, sf_dir)[1])


@query(BASE + OUTPUTS.replace("CAST(return_repr", "TRY_CAST(return_repr") + " SELECT program_id, substr(sha256(string_agg(category || ':' || n, '|' ORDER BY category || ':' || n)), 1, 16) AS io_signature FROM outs GROUP BY ALL")
def io_signature(spark, sf_dir):
    return genomes.io_signature(inputs(spark, sf_dir)[1])


PATTERNS = """, whole AS (SELECT program_id, input_idx, string_agg(fn, '|' ORDER BY seq) AS pattern FROM ev WHERE et = 'call' GROUP BY ALL),
pats AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY program_id ORDER BY n DESC, pattern) AS k FROM (SELECT program_id, pattern, count(*) AS n FROM whole GROUP BY ALL)) WHERE k <= 10)"""


@query(BASE + PATTERNS + " SELECT program_id, pattern, n FROM pats")
def call_patterns(spark, sf_dir):
    return genomes.call_patterns(inputs(spark, sf_dir)[0])


@query(BASE + ", w AS (SELECT program_id, sum(ms) AS wall_ms FROM tr GROUP BY ALL) SELECT program_id, count(*) AS n_events, count(*) FILTER (et = 'call') AS n_calls, count(DISTINCT CASE WHEN et = 'call' THEN fn END) AS n_functions, round(avg(CASE WHEN et = 'exception' THEN 1 ELSE 0 END), 6) AS exception_fraction, round(any_value(wall_ms), 3) AS wall_ms FROM ev JOIN w USING (program_id) GROUP BY ALL")
def volume_stats(spark, sf_dir):
    events, traces, _ = inputs(spark, sf_dir)
    return genomes.volume(events, traces).withColumn("wall_ms", F.round("wall_ms", 3))


@query(BASE + GRAMS2 + met_sql("m", "big", "gram", "share") + f" SELECT pair_id, round({L1}, 6) AS distance FROM m GROUP BY ALL")
@staged("bigrams", with_traces=False)
def version_l1_distance(events, traces, pairs, counted):
    """Flagship: half the L1 distance of the call bigrams of both versions of a user."""
    return distances.kernels(genomes.weighted_occurrences(counted), pairs).select("pair_id", F.col("l1").alias("distance"))


@query(BASE + ", g AS (SELECT program_id, et || '/' || fn || '→' || lead(et || '/' || fn) OVER (PARTITION BY program_id, input_idx ORDER BY seq) AS gram FROM ev), gg AS (SELECT program_id, gram, count(*) AS n FROM g WHERE gram IS NOT NULL GROUP BY ALL)" + met_sql("m", "gg", "gram", "n") + f" SELECT pair_id, round({JACCARD}, 6) AS distance FROM m GROUP BY ALL")
@staged("event_bigrams", with_traces=False)
def version_jaccard(events, traces, pairs, counted):
    return distances.kernels(genomes.weighted_occurrences(counted), pairs).select("pair_id", F.col("jaccard").alias("distance"))


JSD_ROWS = ", sh AS (SELECT pair_id, a / sum(a) OVER w AS p, b / sum(b) OVER w AS q FROM m WINDOW w AS (PARTITION BY pair_id)), kl AS (SELECT pair_id, CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END AS z FROM sh)"


@query(BASE + ", fnc AS (SELECT program_id, fn, count(*) AS n FROM ev GROUP BY ALL)" + met_sql("m", "fnc", "fn", "n") + JSD_ROWS + " SELECT pair_id, round(least(1.0, sum(z) / 2), 6) AS divergence, round(sqrt(greatest(0.0, sum(z) / 2)), 6) AS root FROM kl GROUP BY ALL")
def version_jsd(spark, sf_dir):
    """Both divergences of the event mix: plain over ln 2, and the base-2 root."""
    events, _, pairs = inputs(spark, sf_dir)
    mix = genomes.histogram(events.groupBy("program_id", "function_name").agg(F.count("*").alias("n")), "mix", "function_name", "n")
    plain = distances.kernels(mix, pairs).select("pair_id", F.col("jsd").alias("divergence"))
    return plain.join(distances.rooted_jsd(mix, pairs).select("pair_id", F.col("jsd_root").alias("root")), "pair_id")


@query(BASE + STATES + met_sql("m", "trans", "func_idx || '|' || pre || '|' || kind || '|' || post", "n") + f" SELECT pair_id, round(coalesce(d, 0.0), 6) AS distance FROM vp LEFT JOIN (SELECT pair_id, {WEIGHTED} AS d FROM m GROUP BY ALL) USING (pair_id)")
@staged(with_traces=False)
def weighted_jaccard(events, traces, pairs, counted):
    return distances.distance_state(events, pairs)


SCALARS = (
    FREQ + GRAMS2 + DEPTHS + CONSISTENCY + SIGNATURES + CAUSALITY + ", sens AS (" + entropy_sql("sigs", "program_id", "sens") + """),
cls AS (SELECT program_id, split_part(exception, ':', 1) AS c, count(*) AS n FROM tr WHERE exception IS NOT NULL GROUP BY ALL),
rates AS (SELECT program_id, avg(CASE WHEN exception IS NOT NULL THEN 1.0 ELSE 0.0 END) AS rate FROM tr GROUP BY ALL),
lines AS (SELECT program_id, count(DISTINCT k) AS cov FROM ev GROUP BY ALL),
dm AS (SELECT program_id, avg(max_depth) AS dep FROM deepest GROUP BY ALL),
sc AS (SELECT * FROM rates JOIN lines USING (program_id) JOIN dm USING (program_id) JOIN cons USING (program_id) JOIN sens USING (program_id) JOIN cause USING (program_id))"""
    + met_sql("mf", "freq", "idx", "share") + met_sql("mb", "big", "gram", "share") + met_sql("mc", "cls", "c", "n") + f""",
df AS (SELECT pair_id, {L1} AS x FROM mf GROUP BY ALL), db AS (SELECT pair_id, {L1} AS x FROM mb GROUP BY ALL), dc AS (SELECT pair_id, {JACCARD} AS x FROM mc GROUP BY ALL),
parts3 AS (SELECT vp.pair_id, abs(a.cov - b.cov) / greatest(a.cov, b.cov, 1) AS coverage, coalesce(df.x, 0) AS calls, coalesce(db.x, 0) AS bigrams, 0.5 * coalesce(dc.x, 0) + 0.5 * abs(a.rate - b.rate) AS exception,
    abs(a.dep - b.dep) / greatest(a.dep, b.dep, 1.0) AS depth, abs(a.coverage_consistency - b.coverage_consistency) AS consistency, abs(a.sens - b.sens) AS sensitivity, CASE WHEN a.causality_hash = b.causality_hash THEN 0.0 ELSE 1.0 END AS causality
  FROM vp JOIN sc a ON a.program_id = vp.l JOIN sc b ON b.program_id = vp.r LEFT JOIN df USING (pair_id) LEFT JOIN db USING (pair_id) LEFT JOIN dc USING (pair_id)),
d3 AS (SELECT pair_id, greatest(0.0, least(1.0, 0.20 * coverage + 0.25 * bigrams + 0.20 * calls + 0.10 * exception + 0.10 * depth + 0.05 * consistency + 0.05 * sensitivity + 0.05 * causality)) AS distance FROM parts3)"""
)


@query(BASE + SCALARS + " SELECT pair_id, round(greatest(0.0, least(1.0, 0.30 * coverage + 0.30 * calls + 0.15 * exception + 0.15 * depth + 0.10 * consistency)), 6) AS distance FROM parts3")
@staged("calls", "bigrams")
def distance_v2(events, traces, pairs, counted):
    return distances.distance_v2(distances.behaviour_parts(events, traces, pairs, counted))


@query(BASE + SCALARS + " SELECT pair_id, round(distance, 6) AS distance FROM d3")
@staged("calls", "bigrams")
def distance_v3(events, traces, pairs, counted):
    return distances.distance_v3(distances.behaviour_parts(events, traces, pairs, counted))


TEMPORAL = (
    FLAT2 + FLAT3 + RUNS + PHASES + PRECEDENCE + CONTEXTS + ", h2 AS (" + entropy_sql("flat2", "program_id", "h2") + "), h3 AS (" + entropy_sql("tri", "program_id", "h3") + "), hp AS (" + entropy_sql("ph", "program_id, phase", "h") + """),
hp3 AS (SELECT program_id, coalesce(max(h) FILTER (phase = 0), 0) AS p0, coalesce(max(h) FILTER (phase = 1), 0) AS p1, coalesce(max(h) FILTER (phase = 2), 0) AS p2 FROM hp GROUP BY ALL),
rec AS (SELECT program_id, avg(CASE WHEN recovered THEN 1.0 ELSE 0.0 END) AS rec FROM ctx GROUP BY ALL),
lo AS (SELECT program_id, CASE WHEN count(*) < 2 THEN 0.0 ELSE stddev_pop(length) / avg(length) END AS lo FROM runs GROUP BY ALL),
ts AS (SELECT p.program_id, coalesce(h2, 0) AS h2, coalesce(h3, 0) AS h3, coalesce(p0, 0) AS p0, coalesce(p1, 0) AS p1, coalesce(p2, 0) AS p2, coalesce(rec, 0) AS rec, coalesce(lo, 0) AS lo
  FROM (SELECT DISTINCT program_id FROM ev) p LEFT JOIN h2 USING (program_id) LEFT JOIN h3 USING (program_id) LEFT JOIN hp3 USING (program_id) LEFT JOIN rec USING (program_id) LEFT JOIN lo USING (program_id)),
trip AS (SELECT program_id, pre || ',' || type || ',' || post AS key, count(*) AS n FROM ctx GROUP BY ALL), caus AS (SELECT program_id, i || ',' || j AS key, 1 AS n FROM pr WHERE n_ij / (n_ij + n_ji) > 0.5),
rm AS (SELECT program_id, idx, avg(length) AS m FROM runs GROUP BY ALL)"""
    + met_sql("mt", "tri", "gram", "share") + met_sql("mx", "trip", "t.key", "n") + met_sql("mk", "caus", "t.key", "n") + met_sql("mr", "rm", "idx", "m") + f""",
dt AS (SELECT pair_id, {L1} AS x FROM mt GROUP BY ALL), dx AS (SELECT pair_id, {JACCARD} AS x FROM mx GROUP BY ALL), dk AS (SELECT pair_id, {JACCARD} AS x FROM mk GROUP BY ALL),
dr AS (SELECT pair_id, least(1.0, sum(abs(a - b)) / greatest(max(a), max(b), 1.0) / 2) AS x FROM mr GROUP BY ALL),
d5t AS (SELECT vp.pair_id, greatest(0.0, least(1.0, 0.20 * coalesce(dt.x, 0) + 0.10 * (0.5 * abs(a.h2 - b.h2) + 0.5 * abs(a.h3 - b.h3)) + 0.10 * coalesce(dx.x, 0) + 0.15 * abs(a.rec - b.rec) + 0.15 * coalesce(dk.x, 0)
    + 0.10 * least(1.0, (abs(a.p0 - b.p0) + abs(a.p1 - b.p1) + abs(a.p2 - b.p2)) / 2) + 0.20 * least(1.0, 0.5 * coalesce(dr.x, 0) + 0.5 * abs(a.lo - b.lo) / greatest(a.lo, b.lo, 1.0)))) AS distance
  FROM vp JOIN ts a ON a.program_id = vp.l JOIN ts b ON b.program_id = vp.r LEFT JOIN dt USING (pair_id) LEFT JOIN dx USING (pair_id) LEFT JOIN dk USING (pair_id) LEFT JOIN dr USING (pair_id))"""
)


@query(BASE + TEMPORAL + " SELECT pair_id, round(distance, 6) AS distance FROM d5t")
@staged("flat2", "trigrams", "triples", "runs", "phases")
def distance_temporal(events, traces, pairs, counted):
    return distances.distance_temporal(distances.temporal_parts(events, pairs, counted))


@query(BASE + SCALARS + TEMPORAL + STATES + met_sql("ms", "trans", "func_idx || '|' || pre || '|' || kind || '|' || post", "n") + f""", d5s AS (SELECT pair_id, {WEIGHTED} AS distance FROM ms GROUP BY ALL)
SELECT pair_id, round(d3.distance, 6) AS v3, round(d5t.distance, 6) AS temporal, round(coalesce(d5s.distance, 0), 6) AS state, round(0.5 * d3.distance + 0.25 * d5t.distance + 0.25 * coalesce(d5s.distance, 0), 6) AS distance FROM d3 JOIN d5t USING (pair_id) LEFT JOIN d5s USING (pair_id)""")
@staged("calls", "bigrams", "flat2", "trigrams", "triples", "runs", "phases")
def distance_v5(events, traces, pairs, counted):
    return distances.distance_v5(events, traces, pairs, counted=counted)


FIRST = (
    TIMING + OUTPUTS.replace("CAST(return_repr", "TRY_CAST(return_repr") + PATTERNS + DEPTHS + SNAPS + """, lns AS (SELECT program_id, k, count(*) AS n FROM ev WHERE k IS NOT NULL GROUP BY ALL),
nms AS (SELECT *, n / sum(n) OVER (PARTITION BY program_id) AS share FROM (SELECT program_id, fn, count(*) AS n FROM ev WHERE et = 'call' GROUP BY ALL)),
gr AS (SELECT program_id, et || '/' || fn || '→' || lead(et || '/' || fn) OVER (PARTITION BY program_id, input_idx ORDER BY seq) AS gram FROM ev), grs AS (SELECT program_id, gram, count(*) AS n FROM gr WHERE gram IS NOT NULL GROUP BY ALL),
dps AS (SELECT *, n / sum(n) OVER (PARTITION BY program_id) AS share FROM (SELECT program_id, depth, count(*) AS n FROM deep GROUP BY ALL)),
tys AS (SELECT program_id, ty, count(*) AS n FROM (SELECT program_id, unnest([CASE WHEN v = 'None' THEN 'N' ELSE 'float' END, CASE WHEN kk IS NOT NULL THEN 'int' END, nullif(h, '')]) AS ty FROM snaps) WHERE ty IS NOT NULL GROUP BY ALL),
rs AS (SELECT program_id, avg(CASE WHEN exception IS NOT NULL THEN 1.0 ELSE 0.0 END) AS rate, avg(ms) AS t1, stddev_pop(ms) AS t2, min(ms) AS t3, max(ms) AS t4 FROM tr GROUP BY ALL),
ss AS (SELECT r.*, coalesce(mutation_rate, 0) AS mut FROM rs r LEFT JOIN muts USING (program_id))"""
    + met_sql("m1", "lns", "k", "n") + met_sql("m2", "nms", "fn", "share") + met_sql("m3", "grs", "gram", "n") + met_sql("m4", "timing", "fn", "share") + met_sql("m5", "dps", "depth", "share") + met_sql("m6", "tys", "ty", "n")
    + met_sql("m", "outs", "category", "n") + met_sql("m8", "pats", "pattern", "n") + JSD_ROWS + f""",
e1 AS (SELECT pair_id, {JACCARD} AS x FROM m1 GROUP BY ALL), e2 AS (SELECT pair_id, {L1} AS x FROM m2 GROUP BY ALL), e3 AS (SELECT pair_id, {JACCARD} AS x FROM m3 GROUP BY ALL), e4 AS (SELECT pair_id, {L1} AS x FROM m4 GROUP BY ALL),
e5 AS (SELECT pair_id, sqrt(sum((a - b) * (a - b))) / sqrt(2) AS x FROM m5 GROUP BY ALL), e6 AS (SELECT pair_id, {JACCARD} AS x FROM m6 GROUP BY ALL), e7 AS (SELECT pair_id, least(1.0, sum(z) / 2) AS x FROM kl GROUP BY ALL), e8 AS (SELECT pair_id, {JACCARD} AS x FROM m8 GROUP BY ALL),
v1 AS (SELECT vp.pair_id, 0.5 * coalesce(e1.x, 0) + 0.5 * coalesce(e2.x, 0) AS EXECUTION, (abs(a.mut - b.mut) + coalesce(e5.x, 0) + coalesce(e6.x, 0)) / 3 AS STATE,
    0.5 * least(sqrt(power(abs(a.t1 - b.t1) / greatest(a.t1, b.t1, 1e-12), 2) + power(abs(a.t2 - b.t2) / greatest(a.t2, b.t2, 1e-12), 2) + power(abs(a.t3 - b.t3) / greatest(a.t3, b.t3, 1e-12), 2) + power(abs(a.t4 - b.t4) / greatest(a.t4, b.t4, 1e-12), 2)) / 2, 1.0) + 0.5 * abs(a.rate - b.rate) AS RESOURCE,
    0.5 * coalesce(e3.x, 0) + 0.5 * coalesce(e4.x, 0) AS TEMPORAL, 0.5 * coalesce(e7.x, 0) + 0.5 * coalesce(e8.x, 0) AS INTERACTION
  FROM vp JOIN ss a ON a.program_id = vp.l JOIN ss b ON b.program_id = vp.r LEFT JOIN e1 USING (pair_id) LEFT JOIN e2 USING (pair_id) LEFT JOIN e3 USING (pair_id) LEFT JOIN e4 USING (pair_id) LEFT JOIN e5 USING (pair_id) LEFT JOIN e6 USING (pair_id) LEFT JOIN e7 USING (pair_id) LEFT JOIN e8 USING (pair_id))"""
)


@query(BASE + FIRST + " SELECT pair_id, round(EXECUTION, 6) AS EXECUTION, round(STATE, 6) AS STATE, round(RESOURCE, 6) AS RESOURCE, round(TEMPORAL, 6) AS TEMPORAL, round(INTERACTION, 6) AS INTERACTION FROM v1")
@staged("names", "event_bigrams", "depths")
def distance_dimensions(events, traces, pairs, counted):
    return distances.first_distances(events, traces, pairs, counted)


@query(BASE + FIRST + " SELECT pair_id, round((0.15 * STATE + 0.10 * RESOURCE + 0.10 * TEMPORAL + 0.10 * INTERACTION + 0.10 * EXECUTION) / 0.55, 6) AS distance FROM v1")
@staged("names", "event_bigrams", "depths")
def distance_v1(events, traces, pairs, counted):
    return distances.combined(distances.first_distances(events, traces, pairs, counted))


@query("WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS program_id, coalesce(role, '') AS fn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS s FROM conversations), f AS (SELECT program_id, fn, min(s) AS p FROM c GROUP BY ALL), a AS (SELECT *, row_number() OVER (PARTITION BY program_id ORDER BY p) - 1 AS idx FROM f), g AS (SELECT c.program_id, '(' || idx || ',' || lead(idx) OVER (PARTITION BY c.program_id ORDER BY s) || ')' AS gram FROM c JOIN a USING (program_id, fn)) SELECT program_id, gram, n, round(n / sum(n) OVER (PARTITION BY program_id), 6) AS share FROM (SELECT program_id, gram, count(*) AS n FROM g WHERE gram IS NOT NULL GROUP BY ALL)")
def conversation_bigrams(spark, sf_dir):
    return sequences.call_ngrams(sources.conversation_traces(read_table(spark, sf_dir, "conversations")), 2)


@query(BASE + ", c AS (SELECT program_id, input_idx, count(*) FILTER (et = 'call') AS calls FROM ev GROUP BY ALL), s AS (SELECT program_id, avg(calls) AS mean, stddev_pop(calls) AS std FROM c GROUP BY ALL) SELECT program_id, round(mean, 6) AS mean, round(std, 6) AS std, round(CASE WHEN mean = 0 THEN 0 ELSE std / abs(mean) END, 6) AS cv, CASE WHEN mean = 0 THEN false ELSE std / abs(mean) > 0.1 END AS noisy FROM s")
def noise_floor(spark, sf_dir):
    """Days stand for runs: how much the number of calls varies."""
    events = inputs(spark, sf_dir)[0]
    per_run = events.groupBy("program_id", "input_idx").agg(F.sum((F.col("event_type") == "call").cast("long")).alias("calls"))
    return genomes.noise_floor(per_run, ["program_id"], "calls")


@query(BASE + SCALARS + """, w AS (SELECT unnest([{'p': 'coverage', 'w': 0.20}, {'p': 'bigrams', 'w': 0.25}, {'p': 'calls', 'w': 0.20}, {'p': 'exception', 'w': 0.10}, {'p': 'depth', 'w': 0.10}, {'p': 'consistency', 'w': 0.05}, {'p': 'sensitivity', 'w': 0.05}, {'p': 'causality', 'w': 0.05}], recursive := true)),
u AS (UNPIVOT parts3 ON coverage, calls, bigrams, exception, depth, consistency, sensitivity, causality INTO NAME p VALUE v),
f AS (SELECT pair_id, p, CAST(w AS DOUBLE) AS w, v, sum(CAST(w AS DOUBLE) * v) OVER (PARTITION BY pair_id) AS d FROM u JOIN w USING (p)),
c AS (SELECT DISTINCT pair_id, 'full' AS config, d FROM f UNION ALL SELECT pair_id, 'only_' || p, v FROM f UNION ALL SELECT pair_id, 'without_' || p, (d - w * v) / (1 - w) FROM f)
SELECT pair_id, config, round(greatest(0.0, least(1.0, d)), 5) AS distance FROM (SELECT pair_id, config, any_value(d) AS d FROM c GROUP BY ALL)""")
@staged("calls", "bigrams")
def distance_ablations(events, traces, pairs, counted):
    rows = distances.ablations(distances.behaviour_parts(events, traces, pairs, counted))
    return rows.withColumn("distance", F.round("distance", 5))


@query(BASE + """, v AS (SELECT program_id, count(*) FILTER (et = 'call') AS c, count(DISTINCT CASE WHEN et = 'call' THEN fn END) AS f, avg(CASE WHEN et = 'exception' THEN 1.0 ELSE 0.0 END) AS x FROM ev GROUP BY ALL), t AS (SELECT program_id, sum(ms) AS w FROM tr GROUP BY ALL), vv AS (SELECT * FROM v JOIN t USING (program_id)),
s AS (SELECT pair_id, 1 / (1 + abs(a.w - b.w)) AS wall_ms, 1 / (1 + abs(a.c - b.c)) AS n_calls, 1 / (1 + abs(a.f - b.f)) AS n_functions, 1 / (1 + abs(a.x - b.x)) AS exception_fraction FROM vp JOIN vv a ON a.program_id = l JOIN vv b ON b.program_id = r)
SELECT pair_id, round(wall_ms, 6) AS wall_ms, round(n_calls, 6) AS n_calls, round(n_functions, 6) AS n_functions, round(exception_fraction, 6) AS exception_fraction, round(0.30 * wall_ms + 0.30 * n_calls + 0.25 * n_functions + 0.15 * exception_fraction, 6) AS similarity FROM s""")
def shortcut_similarity(spark, sf_dir):
    events, traces, pairs = inputs(spark, sf_dir)
    return distances.shortcut_similarity(genomes.volume(events, traces), pairs)


@query(BASE + """, lns AS (SELECT program_id, k, count(*) AS n FROM ev WHERE k IS NOT NULL GROUP BY ALL), nms AS (SELECT *, n / sum(n) OVER (PARTITION BY program_id) AS share FROM (SELECT program_id, fn, count(*) AS n FROM ev WHERE et = 'call' GROUP BY ALL)),
ty AS (SELECT *, n / sum(n) OVER (PARTITION BY program_id) AS share FROM (SELECT program_id, CASE WHEN return_repr = 'None' THEN 'N' ELSE 'f' END AS t, count(*) AS n FROM tr GROUP BY ALL)), cls AS (SELECT program_id, split_part(exception, ':', 1) AS c, count(*) AS n FROM tr WHERE exception IS NOT NULL GROUP BY ALL)"""
       + met_sql("m1", "nms", "fn", "share") + met_sql("m2", "lns", "k", "n") + met_sql("m3", "ty", "t.t", "share") + met_sql("m4", "cls", "c", "n")
       + f""", a1 AS (SELECT pair_id, {L1} AS x FROM m1 GROUP BY ALL), a2 AS (SELECT pair_id, {JACCARD} AS x FROM m2 GROUP BY ALL), a3 AS (SELECT pair_id, {L1} AS x FROM m3 GROUP BY ALL), a4 AS (SELECT pair_id, {JACCARD} AS x FROM m4 GROUP BY ALL)
SELECT pair_id, round(1 - (coalesce(a1.x, 0) + coalesce(a2.x, 0) + coalesce(a3.x, 0) + coalesce(a4.x, 0)) / 4, 6) AS similarity FROM vp LEFT JOIN a1 USING (pair_id) LEFT JOIN a2 USING (pair_id) LEFT JOIN a3 USING (pair_id) LEFT JOIN a4 USING (pair_id)""")
@staged()
def trace_similarity(events, traces, pairs, counted):
    return distances.trace_similarity(events, traces, pairs)


@query(BASE + SCALARS + FIRST.replace(DEPTHS, "") + """, v2 AS (SELECT pair_id, greatest(0.0, least(1.0, 0.30 * coverage + 0.30 * calls + 0.15 * exception + 0.15 * depth + 0.10 * consistency)) AS d FROM parts3), vv1 AS (SELECT pair_id, (0.15 * STATE + 0.10 * RESOURCE + 0.10 * TEMPORAL + 0.10 * INTERACTION + 0.10 * EXECUTION) / 0.55 AS d FROM v1)
SELECT pair_id, round(0.4 * vv1.d + 0.6 * v2.d, 6) AS distance FROM v2 JOIN vv1 USING (pair_id)""")
@staged("calls", "bigrams", "names", "event_bigrams", "depths")
def distance_hybrid(events, traces, pairs, counted):
    """The first distance stands for the static part."""
    first = distances.combined(distances.first_distances(events, traces, pairs, counted))
    return distances.hybrid(first, distances.distance_v2(distances.behaviour_parts(events, traces, pairs, counted)))
