"""Queries on program texts that Spark renders from ``events``: node tables, features, distances and all eight dimensions. Their SQL twins count the events instead."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.operators import canonical as canon
from traceloom.operators import distances, dimensions, genomes, identity, lexer, recorded, sequences, states, static, texts
from traceloom.plans.registry import query
from traceloom.plans.traces import BASE, FIRST, OUTPUTS, SNAPS, TIMING, inputs, met_sql
from traceloom.sources import traces as sources
from traceloom.sources.programs import event_sources
from traceloom.sources.staging import Workspace
from traceloom.sources.tables import read_table

#: Kinds of the nodes of a statement, in preorder.
KINDS = {
    "view": "Expr/Call/Name/Load/Constant", "click": "If/Call/Name/Load/Constant/Assign/Name/Store/BinOp/Name/Load/Add/Constant",
    "signup": "For/Name/Store/Call/Name/Load/Constant/Pass", "purchase": "Return/Constant", "error": "Raise/Call/Name/Load",
}
STATEMENTS = ", snip AS (SELECT *, abs(coalesce(k, 0)) AS kk, CASE fn " + " ".join(f"WHEN '{n}' THEN '{k}'" for n, k in KINDS.items()) + " END AS told FROM ev)"
NODES = STATEMENTS + """, nk AS (SELECT program_id, kind, count(*) AS n FROM (SELECT program_id, unnest(string_split(told, '/')) AS kind FROM snip
  UNION ALL SELECT program_id, unnest(['FunctionDef', 'arguments', 'arg']) FROM tr UNION ALL SELECT DISTINCT program_id, 'Module' FROM tr) GROUP BY ALL)"""
COUNTS = STATEMENTS + """, pc AS (SELECT program_id, count(*) FILTER (fn = 'view') AS v, count(*) FILTER (fn = 'click') AS c, count(*) FILTER (fn = 'signup') AS s, count(*) FILTER (fn = 'purchase') AS p, count(*) FILTER (fn = 'error') AS x, count(DISTINCT input_idx) AS f FROM ev GROUP BY ALL),
raised AS (SELECT program_id, list_sort(list_distinct(list('E' || (kk % 3)) FILTER (fn = 'error'))) AS es FROM snip GROUP BY ALL),
edges AS (SELECT program_id, 'day_' || input_idx AS caller, CASE WHEN fn = 'error' THEN 'E' || (kk % 3) ELSE fn END AS callee, count(*) AS n FROM snip WHERE fn <> 'purchase' GROUP BY ALL)"""
FLOW = "CASE WHEN v + 2 * c + 2 * s + p + x + f = 0 THEN 0.0 ELSE c / (v + 2 * c + 2 * s + p + x + f) END"


def root_gap(n: int) -> str:
    """Root divergence of a histogram of n keys with one of them used, against one that is empty."""
    m = (1 + 1 / n) / 2
    return f"sqrt((log2(1 / {m!r}) + {1 / n!r} * log2({1 / n!r} / {m!r}) + {(n - 1) / n!r} * log2(2)) / 2)"


PARTS = (
    COUNTS + met_sql("mbr", "(SELECT program_id, unnest([{'kind': 'If', 'w': c}, {'kind': 'For', 'w': s}], recursive := true) FROM pc WHERE c + s > 0)", "kind", "w") + met_sql("med", "edges", "caller || '→' || callee", "n") + f""",
sbr AS (SELECT pair_id, least(1.0, sum(abs(p - q)) / 2) AS x FROM (SELECT pair_id, CASE WHEN ta > 0 THEN a / ta ELSE 0 END AS p, CASE WHEN tb > 0 THEN b / tb ELSE 0 END AS q FROM (SELECT *, sum(a) OVER (PARTITION BY pair_id) AS ta, sum(b) OVER (PARTITION BY pair_id) AS tb FROM mbr)) GROUP BY ALL),
sed AS (SELECT pair_id, 1 - count(*) FILTER (a > 0 AND b > 0) / count(*) AS x FROM med GROUP BY ALL),
st3 AS (SELECT vp.pair_id, 0.5 * coalesce(sbr.x, 0) + 0.5 * coalesce(sed.x, 0) AS CONTROL,
    (CASE WHEN (a.v + a.c + a.s + a.p > 0) <> (b.v + b.c + b.s + b.p > 0) THEN {root_gap(5)} + 0.5 ELSE 0 END + CASE WHEN (a.c > 0) <> (b.c > 0) THEN {root_gap(7)} ELSE 0 END + abs({FLOW.replace('v +', 'a.v +').replace(' c ', ' a.c ').replace('* c', '* a.c').replace('* s', '* a.s').replace('+ p', '+ a.p').replace('+ x', '+ a.x').replace('+ f', '+ a.f')}
      - {FLOW.replace('v +', 'b.v +').replace(' c ', ' b.c ').replace('* c', '* b.c').replace('* s', '* b.s').replace('+ p', '+ b.p').replace('+ x', '+ b.x').replace('+ f', '+ b.f')})) / 6 AS DATA,
    0.4 * CASE WHEN len(coalesce(ra.es, [])) + len(coalesce(rb.es, [])) = 0 THEN 0 ELSE 1 - len(list_intersect(coalesce(ra.es, []), coalesce(rb.es, []))) / len(list_distinct(list_concat(coalesce(ra.es, []), coalesce(rb.es, [])))) END
      + 0.3 * abs(len(coalesce(ra.es, [])) - len(coalesce(rb.es, []))) / greatest(len(coalesce(ra.es, [])), len(coalesce(rb.es, [])), 1) / 6 AS ERROR
  FROM vp JOIN pc a ON a.program_id = vp.l JOIN pc b ON b.program_id = vp.r LEFT JOIN raised ra ON ra.program_id = vp.l LEFT JOIN raised rb ON rb.program_id = vp.r LEFT JOIN sbr USING (pair_id) LEFT JOIN sed USING (pair_id))"""
)


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.event_traces(read_table(spark, sf_dir, "events"))


def rendered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The sources of all programs, and the pairs of versions. Sources need the order of events only, not their numbers."""
    rows = sources.event_rows(read_table(spark, sf_dir, "events"))
    return event_sources(rows, ("ts", "event_id")), sources.version_pairs(rows)


def on_nodes(*columns: str, kinds: Iterable[str] | None = None, once: bool = False):
    """Turn a function of (tree, pairs) into a query that renders and parses every source once.

    The node table has the columns and kinds of nodes named, or all; it is staged unless it is read ``once``.
    """

    def decorate(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            with Workspace(spark, function.__name__) as work:
                texts, pairs = rendered(spark, sf_dir)
                tree = static.nodes(texts, columns or static.COLUMNS, kinds)
                return work.keep(function(tree if once else work.stage(tree, "nodes"), pairs), "result")

        run.__name__, run.__doc__ = function.__name__, function.__doc__
        return run

    return decorate


@query(BASE + NODES + " SELECT program_id, kind, n FROM nk")
@on_nodes("kind", once=True)
def source_nodes(tree, pairs):
    return tree.groupBy("program_id", "kind").agg(F.count("*").alias("n"))


@query(BASE + COUNTS + " SELECT program_id, caller, callee, n FROM edges")
@on_nodes("kind", "function", "name", kinds=["Call"], once=True)
def source_calls(tree, pairs):
    return static.call_edges(tree)


@query(BASE + COUNTS + " SELECT program_id, 1 + c + s AS complexity, round(CASE WHEN c = 0 OR s = 0 THEN 0.0 ELSE -(c / (c + s)) * log2(c / (c + s)) - (s / (c + s)) * log2(s / (c + s)) END, 6) AS branch_entropy FROM pc")
@on_nodes("kind", "extra", kinds=static.CONTROL_KINDS)
def source_control(tree, pairs):
    return static.control_summary(tree)


@query(BASE + COUNTS + f" SELECT program_id, round({FLOW}, 4) AS flow, v + 2 * c + s + p AS ints, c AS additions, 0 AS lists FROM pc")
@on_nodes("kind", "detail", "extra", kinds=static.DATA_KINDS, once=True)
def source_data(tree, pairs):
    rows = static.canonical_data(static.data_features(tree))
    return rows.select("program_id", "flow", F.col("`types:int`").alias("ints"), F.col("`arithmetic:Add`").alias("additions"), F.col("`containers:list`").alias("lists"))


@query(BASE + COUNTS + " SELECT program_id, x AS raises, 0 AS tries, array_to_string(coalesce(es, []), ',') AS raised, 'none' AS pattern, CAST(0 AS DOUBLE) AS coverage FROM pc LEFT JOIN raised USING (program_id)")
@on_nodes("kind", "name", "detail", "extra", "path", "in_handler", kinds=static.ERROR_KINDS, once=True)
def source_errors(tree, pairs):
    rows = static.canonical_errors(static.error_summary(tree))
    return rows.select("program_id", "raises", "tries", F.array_join("raised", ",").alias("raised"), "pattern", F.col("coverage").cast("double").alias("coverage"))


@query(BASE + PARTS + " SELECT pair_id, round(CONTROL, 6) AS CONTROL, round(DATA, 6) AS DATA, round(ERROR, 6) AS ERROR FROM st3")
@on_nodes("kind", "name", "function", "detail", "extra", "path", "in_handler", kinds={"Call", *static.CONTROL_KINDS, *static.DATA_KINDS, *static.ERROR_KINDS})
def static_dimensions(tree, pairs):
    """The three dimensions that sources alone tell."""
    return dimensions.distances_of(dimensions.Inputs(pairs, tree=tree))


@query(BASE + PARTS + " SELECT pair_id, round((0.20 * CONTROL + 0.15 * DATA + 0.10 * ERROR) / 0.45, 6) AS distance FROM st3")
@on_nodes("kind", "name", "function", "detail", "extra", "path", "in_handler", kinds={"Call", *static.CONTROL_KINDS, *static.DATA_KINDS, *static.ERROR_KINDS})
def static_distance(tree, pairs):
    return dimensions.distance_of(dimensions.Inputs(pairs, tree=tree))


@query(BASE + NODES + met_sql("mn", "nk", "kind", "n") + " SELECT pair_id, round(0.5 * count(*) FILTER (a > 0 AND b > 0) / count(*) + 0.5 * (1 - sum(abs(a - b)) / sum(a + b)), 6) AS similarity FROM mn GROUP BY ALL")
@on_nodes("kind", once=True)
def node_type_similarity(tree, pairs):
    return static.node_type_similarity(tree, pairs)


PRINTS = STATEMENTS + """, fp AS (SELECT program_id, row_number() OVER (PARTITION BY program_id ORDER BY input_idx) - 1 AS top, count(*) FILTER (fn IN ('click', 'signup')) AS branches, count(*) FILTER (fn = 'purchase') > 0 AS has_return_value, count(*) FILTER (fn = 'signup') > 0 AS has_loop,
  CASE WHEN count(*) FILTER (fn IN ('click', 'signup')) > 0 THEN 1 ELSE 0 END AS nesting_depth, CASE WHEN count(*) FILTER (fn <> 'error') > 0 THEN 'int' ELSE '' END AS literal_types, substr(sha256(string_agg(told, '/' ORDER BY seq)), 1, 8) AS body_hash FROM snip GROUP BY program_id, input_idx)"""


@query(BASE + PRINTS + " SELECT program_id, top, 1 AS params, branches, has_return_value, has_loop, false AS has_nested_loop, nesting_depth, literal_types, '' AS builtin_calls, body_hash, 0 AS module_calls FROM fp")
@on_nodes("kind", "name", "detail", "path", "top", "nested", "loops", "callee", "body", kinds=identity.PRINTED, once=True)
def function_fingerprints(tree, pairs):
    return identity.fingerprints(tree).select("program_id", "top", "params", "branches", "has_return_value", "has_loop", "has_nested_loop", "nesting_depth", "literal_types", "builtin_calls", "body_hash", "module_calls")


@query(BASE + PRINTS + " SELECT program_id, arg_min(top, branches * 1000000 + top) AS root, substr(sha256(string_agg(body_hash, '|' ORDER BY body_hash)), 1, 16) AS program_hash FROM fp GROUP BY ALL")
@on_nodes()
def program_identity(tree, pairs):
    return identity.program_identity(tree)


def both_inputs(spark: SparkSession, sf_dir: str, work: Workspace) -> dimensions.Inputs:
    """Events, traces, counted families and nodes of all programs, each staged once."""
    placed = work.stage(sequences.in_traces(canonical(spark, sf_dir)), "placed")
    tree = work.stage(static.nodes(event_sources(placed)), "nodes")
    traces = work.stage(sources.trace_table(placed), "traces")
    wanted = dimensions.families_of(dimensions.REGISTRY.values()) & set(genomes.COUNTED)
    return dimensions.Inputs(sources.version_pairs(traces), placed, traces, tree, work.stage(genomes.occurrences(placed, wanted), "counted"))


EIGHT = BASE + FIRST + PARTS


@query(EIGHT + " SELECT pair_id, round(CONTROL, 6) AS CONTROL, round(DATA, 6) AS DATA, round(ERROR, 6) AS ERROR, round(EXECUTION, 6) AS EXECUTION, round(STATE, 6) AS STATE, round(RESOURCE, 6) AS RESOURCE, round(TEMPORAL, 6) AS TEMPORAL, round(INTERACTION, 6) AS INTERACTION, round(0.20 * CONTROL + 0.15 * DATA + 0.15 * STATE + 0.10 * RESOURCE + 0.10 * TEMPORAL + 0.10 * ERROR + 0.10 * INTERACTION + 0.10 * EXECUTION, 6) AS distance FROM st3 JOIN v1 USING (pair_id)")
def distance_eight_dimensions(spark, sf_dir):
    """Static and dynamic dimensions of the same programs, and their weighted sum."""
    with Workspace(spark, "eight-dimensions") as work:
        inputs = both_inputs(spark, sf_dir, work)
        found = work.stage(dimensions.distances_of(inputs), "dimensions")
        return work.keep(found.join(dimensions.combined(found), "pair_id"), "result")


@query(EIGHT + " SELECT pair_id, round((0.20 * CONTROL + 0.10 * TEMPORAL) / 0.30, 6) AS distance FROM st3 JOIN v1 USING (pair_id)")
def distance_of_two_dimensions(spark, sf_dir):
    """Only what two dimensions need is computed."""
    with Workspace(spark, "two-dimensions") as work:
        told, pairs = rendered(spark, sf_dir)
        tree = work.stage(static.nodes(told, ("kind", "function", "name"), {"Call", *static.CONTROL_KINDS}), "nodes")
        events = canonical(spark, sf_dir)
        placed = work.stage(events.select(*sources.TRACE, "seq", "event_type", "function_name"), "events")
        inputs = dimensions.Inputs(work.stage(pairs, "pairs"), placed, sources.trace_table(events), tree)
        return work.keep(dimensions.distance_of(inputs, only=["CONTROL", "TEMPORAL"]), "result")


#: The kinds of all nodes level by level: the module, its functions, their arguments and statements, then what is below those.
LEVELS = {
    "view": ("Expr", "Call", "Name/Constant", "Load"), "click": ("If", "Call/Assign", "Name/Constant/Name/BinOp", "Load/Store/Name/Add/Constant", "Load"),
    "signup": ("For", "Name/Call/Pass", "Store/Name/Constant", "Load"), "purchase": ("Return", "Constant"), "error": ("Raise", "Call", "Name", "Load"),
}
LETTERS = {k: chr(65 + i) for i, k in enumerate(sorted({x for n in LEVELS.values() for p in n for x in p.split("/")} | {"Module", "FunctionDef", "arguments", "arg"}))}
SPELLED = {n: ["".join(LETTERS[k] for k in p.split("/")) for p in levels] for n, levels in LEVELS.items()}


def level_sql(depth: int) -> str:
    told = " ".join(f"WHEN '{n}' THEN '{s[depth]}'" for n, s in SPELLED.items() if len(s) > depth)
    first = f"'{LETTERS['arguments']}' || " if depth == 0 else f"'{LETTERS['arg']}' || " if depth == 1 else ""
    return f"coalesce(string_agg({first}m{depth}, '' ORDER BY input_idx), '') AS l{depth}" if told else ""


TREES = ", lv AS (SELECT program_id, input_idx, " + ", ".join(f"""string_agg(CASE fn {' '.join(f"WHEN '{n}' THEN '{s[d]}'" for n, s in SPELLED.items() if len(s) > d)} ELSE '' END, '' ORDER BY seq) AS m{d}""" for d in range(5)) + f""" FROM ev GROUP BY ALL),
ln AS (SELECT program_id, '{LETTERS['Module']}' || repeat('{LETTERS['FunctionDef']}', count(*)) || """ + " || ".join(level_sql(d).removesuffix(f" AS l{d}") for d in range(5)) + " AS t FROM lv GROUP BY ALL)"


@query(BASE + TREES + " SELECT pair_id, round(1 - levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t)), 6) AS similarity FROM vp JOIN ln a ON a.program_id = vp.l JOIN ln b ON b.program_id = vp.r")
def tree_edit_similarity(spark, sf_dir):
    """Edit similarity of linearised trees."""
    with Workspace(spark, "tree-edit") as work:
        texts_, pairs = rendered(spark, sf_dir)
        return work.keep(static.linear_similarity(work.stage(static.linear_texts(texts_), "kinds"), pairs), "result")


#: Tokens of a statement, as numbers of words; {k} is the number in it, {e} the exception.
TOKENS = {
    "view": ["view", "(", "{k}", ")"], "click": ["click", "(", "{k}", ")", ":", "x", "=", "x", "+", "{k}"], "signup": ["y", "signup", "(", "{k}", ")", ":"], "purchase": ["{k}"], "error": ["{e}", "(", ")"],
}


def list_sql(items: list[str]) -> str:
    return "[" + ", ".join({"{k}": "CAST(kk AS VARCHAR)", "{e}": "'e' || (kk % 3)"}.get(t, f"'{t}'") for t in items) + "]"


LEXED = STATEMENTS + ", tk AS (SELECT program_id, unnest(CASE fn " + " ".join(f"WHEN '{n}' THEN {list_sql(t)}" for n, t in TOKENS.items()) + """ END) AS token FROM snip
  UNION ALL SELECT program_id, unnest(['day_' || input_idx, '(', 'x', ')', ':']) FROM tr)"""


@query(BASE + LEXED + " SELECT program_id, token, count(*) AS n FROM tk GROUP BY ALL")
def source_tokens(spark, sf_dir):
    """Tokens of rendered sources, without keywords."""
    found = lexer.tokens(event_sources(canonical(spark, sf_dir))).where("kind != 'keyword'")
    return found.groupBy("program_id", "token").agg(F.count("*").alias("n"))


@query(BASE + LEXED + ", sets AS (SELECT program_id, list_distinct(list(token)) AS t FROM tk GROUP BY ALL) SELECT l AS \"left\", r AS \"right\", round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) AS jaccard FROM vp JOIN sets a ON a.program_id = l JOIN sets b ON b.program_id = r")
def source_token_jaccard(spark, sf_dir):
    with Workspace(spark, "source-tokens") as work:
        sources_ = work.stage(event_sources(canonical(spark, sf_dir)), "sources")
        sets = lexer.token_lists(lexer.tokens(sources_)).select("doc_id", F.array_distinct("tokens").alias("tokens"))
        return work.keep(texts.jaccard_of_pairs(sets, sources.version_pairs(sources_).drop("pair_id")), "result")


@query(BASE + NODES + LEXED.removeprefix(STATEMENTS) + met_sql("mn", "nk", "kind", "n") + """, kw AS (SELECT program_id, token FROM tk UNION ALL SELECT program_id, unnest(CASE fn WHEN 'click' THEN ['if'] WHEN 'signup' THEN ['for', 'in', 'pass'] WHEN 'purchase' THEN ['return'] WHEN 'error' THEN ['raise'] ELSE [] END) FROM snip UNION ALL SELECT program_id, 'def' FROM tr),
ks AS (SELECT program_id, list_distinct(list(token)) AS t FROM kw GROUP BY ALL), vol AS (SELECT program_id, sum(ms) AS w FROM tr GROUP BY ALL), nc AS (SELECT program_id, count(*) FILTER (et = 'call') AS c FROM ev GROUP BY ALL)
SELECT pair_id, 'ast_cosine' AS method, round(sum(a * b) / sqrt(sum(a * a)) / sqrt(sum(b * b)), 6) AS similarity FROM mn GROUP BY ALL
UNION ALL SELECT pair_id, 'token_jaccard', round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) FROM vp JOIN ks a ON a.program_id = l JOIN ks b ON b.program_id = r
UNION ALL SELECT pair_id, 'volume', round(1 - least(1.0, 0.5 * abs(a.w - b.w) / greatest(a.w, b.w, 1.0) + 0.5 * abs(c.c - d.c) / greatest(c.c, d.c, 1)), 6) FROM vp JOIN vol a ON a.program_id = l JOIN vol b ON b.program_id = r JOIN nc c ON c.program_id = l JOIN nc d ON d.program_id = r""")
def equal_conditions(spark, sf_dir):
    """Three plain methods on the same pairs: cosine of node kinds, Jaccard of all tokens, and sizes of what runs."""
    with Workspace(spark, "equal-conditions") as work:
        rows = sources.event_rows(read_table(spark, sf_dir, "events"))
        told = work.stage(event_sources(rows, ("ts", "event_id")), "sources")
        events = rows.withColumn("seq", F.struct("ts", "event_id"))  # for the last of a trace, an order does as well as numbers
        pairs = work.stage(sources.version_pairs(told), "pairs")
        kinds = static.nodes(told, ["kind"]).groupBy("program_id", "kind").agg(F.count("*").alias("n"))
        norms = [F.sqrt(F.sum(F.col(c) * F.col(c))) for c in ("a", "b")]
        met = distances.met(genomes.histogram(kinds, "kinds", "kind", "n"), pairs)
        cosine = met.groupBy("pair_id").agg((F.sum(F.col("a") * F.col("b")) / F.nullif(norms[0] * norms[1], F.lit(0.0))).alias("similarity")).select("pair_id", F.lit("ast_cosine").alias("method"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))
        sets = work.stage(lexer.token_sets(told, ("name", "number", "operator", "string", "keyword")), "sets")
        jaccard = texts.jaccard_of_pairs(sets, pairs.select("left", "right")).join(pairs, ["left", "right"]).select("pair_id", F.lit("token_jaccard").alias("method"), F.col("jaccard").alias("similarity"))
        sizes = distances.both_rows(pairs, genomes.volume(events, sources.trace_table(events)))
        gaps = 0.5 * distances.relative_gap("wall_ms") + 0.5 * distances.relative_gap("n_calls")
        volume = sizes.select("pair_id", F.lit("volume").alias("method"), (1 - F.least(F.lit(1.0), gaps)).alias("similarity"))
        return work.keep(cosine.union(jaccard).union(volume), "result")


@query(BASE + """, o AS (SELECT program_id, list(coalesce(exception, return_repr) ORDER BY input_idx) AS outs, avg(CASE WHEN exception IS NOT NULL THEN 1.0 ELSE 0.0 END) AS x, count(*) AS items, count(*) AS functions FROM tr GROUP BY ALL),
b AS (SELECT pair_id, CASE WHEN CAST(pair_id AS BIGINT) % 2 = 0 THEN 'EQUIV' ELSE 'CHANGED' END AS truth, a.outs = b.outs AS agree, abs(a.x - b.x) < 0.01 AS same_x, a.items = b.items AS same_n FROM vp JOIN o a ON a.program_id = l JOIN o b ON b.program_id = r),
v AS (SELECT unnest([{'method': 'label', 'r': agree = (truth = 'EQUIV')}, {'method': 'exception_fraction', 'r': same_x = (truth = 'EQUIV')}, {'method': 'volume', 'r': same_n = (truth = 'EQUIV')}, {'method': 'functions', 'r': same_n = (truth = 'EQUIV')}], recursive := true) FROM b)
SELECT method, count(*) AS pairs, count(*) FILTER (r) AS "right", round(count(*) FILTER (r) / count(*), 6) AS accuracy FROM v GROUP BY ALL""")
def hard_negative_shortcuts(spark, sf_dir):
    """What mere size tells of pairs whose truth is given: the ids' parity stands for it."""
    events, traces, pairs = inputs(spark, sf_dir)
    output = F.coalesce("exception", "return_repr")
    held = F.array_sort(F.collect_list(F.struct("input_idx", output.alias("o"))))
    sides = traces.groupBy("program_id").agg(F.transform(held, lambda x: x["o"]).alias("outputs"), F.avg(F.col("exception").isNotNull().cast("int")).alias("exceptions"), F.count("*").alias("items"), F.count("*").alias("functions"))
    rows = distances.both_rows(pairs, sides).withColumn("agree", F.col("a_outputs") == F.col("b_outputs")).withColumn("truth", F.when(F.col("pair_id").cast("long") % 2 == 0, "EQUIV").otherwise("CHANGED"))
    return recorded.shortcut_summary(recorded.shortcut_verdicts(rows))


@query(BASE + SNAPS + TIMING + OUTPUTS.replace("CAST(return_repr", "TRY_CAST(return_repr") + """, rt AS (SELECT program_id, avg(CASE WHEN exception IS NOT NULL THEN 1.0 ELSE 0.0 END) AS x FROM tr GROUP BY ALL)
SELECT program_id, 'scalar' AS family, 'mutation_rate' AS key, round(coalesce(mutation_rate, 0.0), 4) AS weight FROM spaces LEFT JOIN muts USING (program_id) UNION ALL SELECT program_id, 'scalar', 'exception_rate', round(x, 6) FROM rt
UNION ALL SELECT program_id, 'timing', fn, round(least(1.0, share), 6) FROM timing WHERE share > 0 UNION ALL SELECT program_id, 'outputs', category, n FROM outs""")
def canonical_features(spark, sf_dir):
    """Canonical scalars and histograms of every program, in the long form."""
    events, traces, _ = inputs(spark, sf_dir)
    rates = traces.groupBy("program_id").agg(F.avg(F.col("exception").isNotNull().cast("int")).alias("exception_rate"))
    scalars = canon.canonical_scalars(states.state_summary(events).join(rates, "program_id"))
    told = scalars.select("program_id", F.lit("scalar").alias("family"), F.explode(F.create_map(*[x for c in ("mutation_rate", "exception_rate") for x in (F.lit(c), F.col(c))])).alias("key", "weight"))
    rows = genomes.histogram(sequences.phase_timing(events), "timing", "function_name", "share").union(genomes.histogram(genomes.output_histogram(traces), "outputs", "category", "n"))
    return told.union(canon.canonical_histograms(rows).select("program_id", "family", "key", "weight"))
