"""Queries on recorded outputs, methods compared, and audits of labels, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceloom.functions.measures import mann_whitney_power_of, mcnemar_power_of
from traceloom.operators import audits, genomes, metrics, recorded, texts
from traceloom.plans import scores, traces
from traceloom.plans.registry import query
from traceloom.plans.texts import SPLITS, customer_splits, items, next_pairs
from traceloom.sources.tables import read_table

OUTPUTS = traces.BASE + """, outs AS (SELECT program_id, row_number() OVER (PARTITION BY program_id ORDER BY input_idx) - 1 AS place, CASE WHEN exception IS NULL THEN return_repr END AS r, split_part(exception, ':', 1) AS x, ms FROM tr),
zip AS (SELECT pair_id, a.r AS ar, b.r AS br, a.x AS ax, b.x AS bx FROM vp JOIN outs a ON a.program_id = vp.l JOIN outs b ON b.program_id = vp.r AND b.place = a.place)"""
#: The reprs here are None or shortest decimals, so equal values have equal reprs but for rounding.
SAME = "(ar IS NOT DISTINCT FROM br OR coalesce(abs(TRY_CAST(ar AS DOUBLE) - TRY_CAST(br AS DOUBLE)) <= greatest(1e-9 * greatest(abs(TRY_CAST(ar AS DOUBLE)), abs(TRY_CAST(br AS DOUBLE))), 1e-12), false)) AND ax IS NOT DISTINCT FROM bx"
ORACLE = OUTPUTS + f""", judged AS (SELECT pair_id, count(*) AS n_tested, count(*) FILTER (NOT ({SAME})) AS n_diffs FROM zip GROUP BY ALL),
labelled AS (SELECT pair_id, coalesce(n_tested, 0) AS n_tested, coalesce(n_diffs, 0) AS n_diffs, CASE WHEN n_diffs > 0 THEN 'CHANGED' WHEN n_tested > 0 THEN 'LIKELY_EQUIVALENT' ELSE 'UNKNOWN' END AS label FROM vp LEFT JOIN judged USING (pair_id))"""


def outputs(spark, sf_dir):
    _, rows, pairs = traces.inputs(spark, sf_dir)
    return recorded.outputs_of(rows), pairs


@query(ORACLE + " SELECT * FROM labelled")
def oracle_labels(spark, sf_dir):
    return recorded.oracle_labels(*outputs(spark, sf_dir))


@query(ORACLE + """ SELECT pair_id, n_tested, n_diffs, CASE WHEN n_tested > 0 AND n_diffs > 0 AND CAST(pair_id AS BIGINT) % 2 = 1 THEN 'GT-T1' ELSE 'GT-T4' END AS tier,
  round(CASE WHEN n_tested = 0 THEN 0.5 WHEN n_diffs > 0 THEN 0.999 WHEN CAST(pair_id AS BIGINT) % 2 = 0 THEN least(power(0.05, 1 / n_tested), 0.9) ELSE least(0.5 + 0.45 * (1 - exp(-n_tested / 500)), 0.95) END, 6) AS confidence FROM labelled""")
def label_confidence(spark, sf_dir):
    """Even users stand for transformations that keep behaviour."""
    preserving = F.col("pair_id").cast("long") % 2 == 0
    return recorded.calibrated(recorded.oracle_labels(*outputs(spark, sf_dir)), preserving, F.lit(False)).drop("label")


@query(ORACLE + " SELECT pair_id, CASE WHEN label = 'LIKELY_EQUIVALENT' THEN 0 ELSE 1 END AS label FROM labelled")
def encoded_labels(spark, sf_dir):
    """Relations as numbers, the likely ones counting as certain."""
    told = recorded.oracle_labels(*outputs(spark, sf_dir)).select("pair_id", F.regexp_replace("label", "LIKELY_", "").alias("expected_label"))
    return metrics.encoded_labels(told).drop("expected_label")


REGRESSION = OUTPUTS + """, sides AS (SELECT program_id, avg(CASE WHEN x IS NULL THEN 0.0 ELSE 1.0 END) AS rate, coalesce(list_distinct(list(x) FILTER (x IS NOT NULL)), []) AS types, avg(ms) AS ms FROM outs GROUP BY ALL),
dv AS (SELECT pair_id, avg(CASE WHEN coalesce('EXC:' || ax, ar) IS DISTINCT FROM coalesce('EXC:' || bx, br) THEN 1.0 ELSE 0.0 END) AS output_divergence FROM zip GROUP BY ALL),
reg AS (SELECT pair_id, abs(a.rate - b.rate) AS exception_fraction, CASE WHEN len(list_distinct(list_concat(a.types, b.types))) = 0 THEN 0.0 ELSE 1 - len(list_intersect(a.types, b.types)) / len(list_distinct(list_concat(a.types, b.types))) END AS exception_types,
    least(1.0, ((greatest(a.ms, b.ms) + 1e-6) / (least(a.ms, b.ms) + 1e-6) - 1) / 10) AS volume_ratio, coalesce(output_divergence, 0.0) AS output_divergence
  FROM vp JOIN sides a ON a.program_id = vp.l JOIN sides b ON b.program_id = vp.r LEFT JOIN dv USING (pair_id))"""


@query(REGRESSION + " SELECT pair_id, round(exception_fraction, 6) AS exception_fraction, round(exception_types, 6) AS exception_types, round(volume_ratio, 6) AS volume_ratio, round(output_divergence, 6) AS output_divergence, round(0.3 * exception_fraction + 0.2 * exception_types + 0.1 * volume_ratio + 0.4 * output_divergence, 6) AS distance FROM reg")
def regression_distance(spark, sf_dir):
    return recorded.regression_distances(*outputs(spark, sf_dir))


@query(REGRESSION + """, k AS (SELECT *, CAST(pair_id AS BIGINT) % 4 AS kind, output_divergence > 0 AS o, exception_fraction > 0 OR exception_types > 0 AS e, volume_ratio > 0.05 AS v FROM reg)
SELECT kind, count(*) AS n, round(avg(o::INT), 6) AS by_output, round(avg(e::INT), 6) AS by_exception, round(avg(v::INT), 6) AS by_volume, count(*) FILTER (NOT e AND NOT v) AS n_silent, count(*) FILTER (NOT e AND NOT v AND o) AS silent_detected FROM k GROUP BY ALL""")
def detection_rates(spark, sf_dir):
    """Four groups of users stand for kinds of regressions."""
    rows = recorded.regression_distances(*outputs(spark, sf_dir)).withColumn("kind", F.col("pair_id").cast("long") % 4)
    return recorded.detection_rates(rows, "kind")


@query(traces.BASE + """, p AS (SELECT program_id, CASE WHEN k % 10 = 0 THEN 'None' WHEN value = 0 THEN 'float:zero' ELSE 'float:nonzero' END AS key FROM ev) SELECT program_id, key, count(*) AS n FROM p GROUP BY ALL""")
def input_partitions(spark, sf_dir):
    """Coarse classes of the events' values."""
    events = traces.inputs(spark, sf_dir)[0]
    return events.groupBy("program_id", recorded.partition_key(F.col("snapshot")["value"]).alias("key")).agg(F.count("*").alias("n"))


@query(traces.BASE + """, v AS (SELECT program_id, count(*) AS n_events, count(*) FILTER (et = 'call') AS n_calls, count(DISTINCT CASE WHEN et = 'call' THEN fn END) AS n_functions, avg(CASE WHEN et = 'exception' THEN 1.0 ELSE 0.0 END) AS x FROM ev GROUP BY ALL), t AS (SELECT program_id, sum(ms) AS w FROM tr GROUP BY ALL), vv AS (SELECT * FROM v JOIN t USING (program_id))
SELECT pair_id, round(least(1.0, (abs(a.n_events - b.n_events) + abs(a.n_calls - b.n_calls) + abs(a.n_functions - b.n_functions) + abs(a.x - b.x) + abs(a.w - b.w)) / greatest(a.n_events + b.n_events + a.n_calls + b.n_calls + a.n_functions + b.n_functions + a.x + b.x + a.w + b.w, 1)), 6) AS distance FROM vp JOIN vv a ON a.program_id = l JOIN vv b ON b.program_id = r""")
def flat_feature_distance(spark, sf_dir):
    events, rows, pairs = traces.inputs(spark, sf_dir)
    return recorded.flat_distance(genomes.volume(events, rows), pairs)


@query(scores.BASE + "SELECT n.lang, round(avg(CASE WHEN p.score < n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END), 6) AS auroc, (SELECT sum(label)::BIGINT FROM s) AS n_changed, CAST(count(DISTINCT n.pair_id) AS BIGINT) AS n_equivalent FROM s p, s n WHERE p.label = 1 AND n.label = 0 GROUP BY n.lang")
def type_auroc(spark, sf_dir):
    """Each language's items of label 0 against all of label 1."""
    return metrics.auroc_of_types(scores.scored(spark, sf_dir), "lang").select("lang", "auroc", F.col("n_positive").alias("n_changed"), F.col("n_negative").alias("n_equivalent"))


RANKED = scores.BASE + """, m AS (SELECT 'length' AS method, score AS x, label FROM s UNION ALL SELECT 'reciprocal', other, label FROM s UNION ALL SELECT 'mean', (score + other) / 2, label FROM s),
c AS (SELECT method, x AS t FROM m UNION SELECT method, 0.0 FROM m GROUP BY method HAVING min(x) > 0 UNION SELECT method, max(x) + 1e-6 FROM m GROUP BY method),
f AS (SELECT c.method, t, 2 * count(*) FILTER (x < t AND label = 1) / nullif(count(*) FILTER (x < t) + sum(label), 0) AS f1 FROM c JOIN m USING (method) GROUP BY ALL),
best AS (SELECT method, max(coalesce(f1, 0)) AS f1 FROM f GROUP BY ALL),
roc AS (SELECT p.method, avg(CASE WHEN p.x < n.x THEN 1.0 WHEN p.x = n.x THEN 0.5 ELSE 0 END) AS auroc FROM m p JOIN m n USING (method) WHERE p.label = 1 AND n.label = 0 GROUP BY ALL),
j AS (SELECT method, round(f1, 6) AS f1, round(auroc, 6) AS auroc FROM best JOIN roc USING (method))"""


@query(RANKED + " SELECT method, f1, auroc, row_number() OVER (ORDER BY f1 DESC, method) AS rank, round(f1 - max(f1) OVER (), 6) AS behind FROM j")
def ranked_methods(spark, sf_dir):
    """Three scores of the same items by their best F1."""
    rows = scores.scored(spark, sf_dir)
    methods = F.explode(F.array(*[F.struct(F.lit(n).alias("method"), c.alias("score")) for n, c in (("length", F.col("score")), ("reciprocal", F.col("other")), ("mean", (F.col("score") + F.col("other")) / 2))]))
    return metrics.ranked_methods(rows.select("label", methods.alias("m")).select("label", "m.*"))


@query(SPLITS + ", k AS (SELECT DISTINCT CAST(floor(c_acctbal / 10) AS BIGINT) AS step, split FROM customer JOIN sp USING (c_custkey)) SELECT step FROM k WHERE split = 'train' EXCEPT SELECT step FROM k WHERE split = 'test'")
def train_only_steps(spark, sf_dir):
    rows = customer_splits(spark, sf_dir).join(read_table(spark, sf_dir, "customer").select("c_custkey", F.floor(F.col("c_acctbal") / 10).alias("step")), "c_custkey")
    return audits.only_in(rows, "step", "train", "test")


@query("""WITH p AS (SELECT doc_id // 2 AS pair_id, CASE WHEN quality = 1 THEN 'SP-1' ELSE 'SC-1' END AS t, CASE WHEN toxic = 1 THEN 'CHANGED' WHEN doc_id % 9 > 0 THEN 'EQUIVALENT' END AS e FROM labels)
SELECT 'repeated_id' AS issue, (SELECT count(*) FROM (SELECT pair_id FROM p GROUP BY ALL HAVING count(*) > 1)) AS n UNION ALL SELECT 'label', count(*) FILTER ((t LIKE 'SP%' AND e <> 'EQUIVALENT') OR (t LIKE 'SC%' AND e = 'EQUIVALENT')) FROM p UNION ALL SELECT 'missing', count(*) FILTER (e IS NULL) FROM p""")
def label_issues(spark, sf_dir):
    """Labels of documents read as pairs of programs."""
    rows = read_table(spark, sf_dir, "labels")
    pairs = rows.select(
        F.expr("doc_id DIV 2").alias("pair_id"), F.col("doc_id").alias("base_id"), F.col("doc_id").alias("variant_id"), F.when(F.col("quality") == 1, "SP-1").otherwise("SC-1").alias("transformation_type"),
        F.when(F.col("toxic") == 1, "CHANGED").when(F.col("doc_id") % 9 > 0, "EQUIVALENT").alias("expected_label"),
    )
    return audits.label_issues(pairs)


@query("""WITH n AS (SELECT lang, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL), z AS (SELECT *, sqrt(n * 0.2) / 3 AS a, 0.5 * sqrt(3.141592653589793 / 3) * sqrt(n / 2) AS b, 1.959963984540054 AS c FROM n),
u AS (SELECT lang, n, unnest([{'k': 1, 'x': a - c}, {'k': 1, 'x': -a - c}, {'k': 2, 'x': b - c}, {'k': 2, 'x': -b - c}], recursive := true) FROM z), t AS (SELECT *, 1 / (1 + 0.3275911 * abs(x) / sqrt(2)) AS t FROM u),
q AS (SELECT *, 0.5 * t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-x * x / 2) AS q FROM t),
p AS (SELECT lang, n, k, greatest(0, least(1, sum(CASE WHEN x >= 0 THEN 1 - q ELSE q END))) AS power FROM q GROUP BY ALL)
SELECT lang, n, round(max(power) FILTER (k = 1), 6) AS mcnemar, round(max(power) FILTER (k = 2), 6) AS mann_whitney FROM p GROUP BY ALL""")
def power_by_language(spark, sf_dir):
    """Power of both tests at each language's number of labels: discordance 0.2, effect 0.5."""
    rows = read_table(spark, sf_dir, "labels").join(read_table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"))
    return rows.select("lang", "n", mcnemar_power_of(F.col("n"), 0.2).alias("mcnemar"), mann_whitney_power_of(F.col("n"), 0.5).alias("mann_whitney"))


GRAMS = """WITH w AS (SELECT item_id AS doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS w FROM benchmark), g AS (SELECT doc_id, unnest(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END) AS token FROM w), c AS (SELECT doc_id, token, count(*) AS n FROM g GROUP BY ALL),
i AS (SELECT token, ln(((SELECT count(*) FROM benchmark) + 1) / (count(*) + 1)) + 1 AS idf FROM c GROUP BY ALL), v AS (SELECT doc_id, token, n / sum(n) OVER (PARTITION BY doc_id) * idf AS w FROM c JOIN i USING (token)), nr AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM v GROUP BY ALL),
p AS (SELECT item_id AS l, item_id + 1 AS r FROM benchmark WHERE item_id + 1 IN (SELECT item_id FROM benchmark)), d AS (SELECT l, r, sum(a.w * b.w) AS dot FROM p JOIN v a ON a.doc_id = l JOIN v b ON b.doc_id = r AND b.token = a.token GROUP BY ALL)
SELECT l AS "left", r AS "right", round(coalesce(dot / (a.norm * b.norm), 0), 6) AS cosine FROM p LEFT JOIN d USING (l, r) LEFT JOIN nr a ON a.doc_id = l LEFT JOIN nr b ON b.doc_id = r"""


@query(GRAMS)
def gram_tfidf_cosine(spark, sf_dir):
    """TF-IDF over pairs of neighbouring words."""
    docs = items(spark, sf_dir)
    counts = texts.token_counts(docs, texts.word_grams("text", 2))
    weights = texts.idf(counts, docs.agg(F.count("*").alias("n_docs")))
    return texts.cosine_of_pairs(texts.tfidf(counts, weights), next_pairs(docs))


@query(scores.BASE + "SELECT lang, score, count(*) AS n, round(min(r) + (count(*) - 1) / 2, 6) AS mid_rank FROM (SELECT *, rank() OVER (PARTITION BY lang ORDER BY score) AS r FROM s) GROUP BY ALL")
def mid_ranks(spark, sf_dir):
    return metrics.mid_ranks(scores.scored(spark, sf_dir), ["lang"])


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 100")
def sampled_orders(spark, sf_dir):
    """A sampling operator: a hundred orders by a seeded hash."""
    return audits.subsample(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", 100)


@query("WITH m AS (SELECT DISTINCT p_brand, p_type FROM part), b AS (SELECT p_brand, count(*) AS held FROM part GROUP BY ALL) SELECT p_type, CAST(sum(held) AS BIGINT) AS n FROM m JOIN b USING (p_brand) GROUP BY ALL")
def applicable_parts(spark, sf_dir):
    """Brands as categories: to how many parts each type applies that some part of the brand has."""
    parts = read_table(spark, sf_dir, "part")
    return audits.applicability(parts, parts, "p_brand", "p_type")
