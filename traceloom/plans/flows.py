"""Queries on program texts that Spark renders from ``events``: control flow, dependencies, matched functions and features that languages share. Their SQL twins count the events instead."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceloom.operators import flow, identity, languages
from traceloom.plans.programs import COUNTS, PRINTS, STATEMENTS, canonical, on_nodes
from traceloom.plans.registry import query
from traceloom.plans.traces import BASE, met_sql
from traceloom.sources import traces as sources
from traceloom.sources.programs import event_sources
from traceloom.sources.staging import Workspace


def on_sources(kernel):
    """Turn a function of (rows, pairs) into a query on the rows that a kernel finds in every source, each parsed once."""

    def decorate(function):
        def run(spark, sf_dir):
            with Workspace(spark, function.__name__) as work:
                rows = work.stage(kernel(event_sources(canonical(spark, sf_dir))), "rows")
                return work.keep(function(rows, sources.version_pairs(rows)), "result")

        run.__name__, run.__doc__ = function.__name__, function.__doc__
        return run

    return decorate


#: A function is a block; a branch adds three and four edges, a loop two and three.
FLOWS = COUNTS + ", fl AS (SELECT program_id, 1 + f + 3 * c + 2 * s AS blocks, 2 * c + s AS seqs, c AS branches, 2 * s AS loops FROM pc)"
GRAPHS = FLOWS + """, fe AS (SELECT * FROM (SELECT program_id, unnest([{'edge': 'seq', 'n': seqs}, {'edge': 'true', 'n': branches}, {'edge': 'false', 'n': branches}, {'edge': 'loop', 'n': loops}], recursive := true) FROM fl) WHERE n > 0),
fs AS (SELECT program_id, blocks + seqs + 2 * branches + loops AS n FROM fl)""" + met_sql("mf", "fe", "edge", "n")  # fmt: skip


@query(BASE + FLOWS + " SELECT program_id, blocks, seqs, branches AS trues, branches AS falses, loops FROM fl")
@on_sources(flow.control_flow)
def source_flow(rows, pairs):
    """Blocks and edges of each kind of every program."""
    kind = lambda k: F.count(F.when(F.col("edge") == k, 1))
    return rows.groupBy("program_id").agg(F.count("tokens").alias("blocks"), kind("seq").alias("seqs"), kind("true").alias("trues"), kind("false").alias("falses"), kind("loop").alias("loops"))


@query(BASE + GRAPHS + """, alike AS (SELECT pair_id, sum(least(a, b)) / sum(greatest(a, b)) AS w FROM mf GROUP BY ALL)
SELECT pair_id, round(0.5 * (1 - abs(a.n - b.n) / greatest(a.n, b.n, 1)) + 0.5 * coalesce(w, 1.0), 6) AS similarity FROM vp JOIN fs a ON a.program_id = l JOIN fs b ON b.program_id = r LEFT JOIN alike USING (pair_id)""")
@on_sources(flow.control_flow)
def source_flow_similarity(rows, pairs):
    return flow.flow_similarity(rows, pairs)


#: The tokens of a block end at a branch or a loop; what a branch assigns and what a loop passes are blocks of their own.
BLOCKS = STATEMENTS + """, cuts AS (SELECT *, coalesce(sum(CAST(fn IN ('click', 'signup') AS INT)) OVER (PARTITION BY program_id, input_idx ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block FROM snip),
bl AS (SELECT DISTINCT program_id, tokens, 1 AS n FROM (
  SELECT program_id, string_agg(CASE fn WHEN 'view' THEN 'Expr/Call' WHEN 'click' THEN 'If' WHEN 'signup' THEN 'For' WHEN 'purchase' THEN 'Return/<Literal>' ELSE 'Raise/Call' END, '/' ORDER BY seq) AS tokens FROM cuts GROUP BY program_id, input_idx, block
  UNION ALL SELECT program_id, 'Assign/<Name>/BinOp' FROM snip WHERE fn = 'click' UNION ALL SELECT program_id, 'Pass' FROM snip WHERE fn = 'signup'
  UNION ALL SELECT program_id, array_to_string(list_transform(range(count(*)), lambda i: 'FunctionDef'), '/') FROM tr GROUP BY program_id))"""  # fmt: skip


@query(BASE + BLOCKS + met_sql("mb", "bl", "tokens", "n") + " SELECT pair_id, round(count(*) FILTER (a > 0 AND b > 0) / count(*), 6) AS similarity FROM mb GROUP BY ALL")
@on_sources(flow.control_flow)
def source_block_similarity(rows, pairs):
    return flow.block_similarity(rows, pairs)


#: Branches define x from x and click, loops define y from signup; within a function each definition meets each use.
DEPENDENCIES = """, fn AS (SELECT program_id, CAST(bool_or(fn = 'click') AS INT) AS c, CAST(bool_or(fn = 'signup') AS INT) AS s FROM ev GROUP BY program_id, input_idx),
de AS (SELECT DISTINCT program_id, d || '→' || u AS edge, 1 AS n FROM (SELECT program_id, unnest(CASE WHEN c = 1 THEN ['x'] ELSE [] END || CASE WHEN s = 1 THEN ['y'] ELSE [] END) AS d, c, s FROM fn),
  LATERAL (SELECT unnest(CASE WHEN c = 1 THEN ['x', 'click'] ELSE [] END || CASE WHEN s = 1 THEN ['signup'] ELSE [] END) AS u)),
df AS (SELECT program_id, avg(CASE WHEN c + s = 0 THEN 0.0 ELSE (c + s) / (3 * c + 2 * s) END) AS ratio, avg(c) AS depth, any_value(coalesce(e.n, 0)) AS edges, 0 AS calls FROM fn LEFT JOIN (SELECT program_id, count(*) AS n FROM de GROUP BY ALL) e USING (program_id) GROUP BY ALL)"""


@query(BASE + DEPENDENCIES + " SELECT program_id, round(ratio, 6) AS ratio, round(depth, 6) AS depth, edges, calls FROM df")
@on_sources(flow.dependency_facts)
def source_dependencies(rows, pairs):
    return flow.dependency_features(rows)


def feature_gap(name: str) -> str:
    return f"abs(a.{name} - b.{name}) / greatest(a.{name}, b.{name}, 1e-9)"


@query(BASE + DEPENDENCIES + met_sql("md", "de", "edge", "n") + f""", graph AS (SELECT pair_id, count(*) FILTER (a > 0 AND b > 0) / count(*) AS g FROM md GROUP BY ALL)
SELECT pair_id, round(0.5 * (1 - ({' + '.join(map(feature_gap, ('ratio', 'depth', 'edges', 'calls')))}) / 4) + 0.5 * coalesce(g, 1.0), 6) AS similarity FROM vp JOIN df a ON a.program_id = l JOIN df b ON b.program_id = r LEFT JOIN graph USING (pair_id)""")
@on_sources(flow.dependency_facts)
def source_dependency_similarity(rows, pairs):
    return flow.dependency_similarity(rows, pairs)


def same(name: str, weight: float) -> str:
    return f"CASE WHEN a.{name} = b.{name} THEN {weight} ELSE 0.0 END"


def close(name: str, weight: float) -> str:
    return f"CASE WHEN a.{name} = b.{name} THEN {weight} ELSE {weight} * (1 - abs(a.{name} - b.{name}) / greatest(a.{name}, b.{name})) END"


#: Parts that rendered functions don't differ in weigh 5 among the equal ones (two before loops), 2 and 3.5 among the relative ones.
MATCHED = PRINTS + f""", cand AS (SELECT pair_id, a.top AS a, b.top AS b,
    ({same('body_hash', 4.0)} + {same('literal_types', 1.5)} + {same('has_return_value', 1.0)} + {same('has_loop', 1.0)} + 4.5 + 2.0 + {close('branches', 2.0)} + {close('nesting_depth', 1.5)} + 3.5) / 21.0 AS l
  FROM vp JOIN fp a ON a.program_id = vp.l JOIN fp b ON b.program_id = vp.r),
step AS (SELECT pair_id, CAST([] AS BIGINT[]) AS ua, CAST([] AS BIGINT[]) AS ub, NULL::BIGINT AS a, NULL::BIGINT AS b, NULL::DOUBLE AS l FROM vp
  UNION ALL SELECT pair_id, list_append(ua, m.a), list_append(ub, m.b), m.a, m.b, -m.l FROM (
    SELECT s.pair_id, any_value(s.ua) AS ua, any_value(s.ub) AS ub, min({{'l': -c.l, 'a': c.a, 'b': c.b}}) AS m FROM step s JOIN cand c ON c.pair_id = s.pair_id
    WHERE c.l >= 0.4 AND NOT list_contains(s.ua, c.a) AND NOT list_contains(s.ub, c.b) GROUP BY s.pair_id))"""  # fmt: skip


@query(BASE.replace("WITH", "WITH RECURSIVE", 1) + MATCHED + " SELECT pair_id, a, b, round(l, 6) AS likeness FROM step WHERE a IS NOT NULL")
@on_nodes()
def matched_functions(tree, pairs):
    """Functions of two versions, matched greedily by what renaming leaves."""
    return identity.matched_functions(identity.fingerprints(tree), pairs)


LANGUAGE = COUNTS + ", lf AS (SELECT program_id, f AS n_functions, s AS n_loops, c AS n_conditions, v + c + s + x AS n_calls, 1 + s + c AS complexity, p > 0 AS returns FROM pc)"


@query(BASE + LANGUAGE + " SELECT program_id, n_functions, n_loops, n_conditions, n_calls, complexity, false AS recursion, returns, false AS exceptions FROM lf")
@on_nodes()
def language_features(tree, pairs):
    """Features that programs of any language have."""
    return languages.python_features(tree)


@query(BASE + LANGUAGE + f""" SELECT pair_id, round(0.6 * (1 - ({' + '.join(f'abs(a.{n} - b.{n}) / greatest(a.{n}, b.{n}, 1)' for n in languages.NUMBERS)}) / 5) + 0.4 * (2 + CAST(a.returns = b.returns AS INT)) / 3, 6) AS similarity
FROM vp JOIN lf a ON a.program_id = l JOIN lf b ON b.program_id = r""")
@on_nodes()
def language_similarity(tree, pairs):
    return languages.feature_similarity(languages.python_features(tree), pairs)
