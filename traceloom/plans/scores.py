"""Queries that evaluate scores against labels, on ``labels`` joined to ``documents`` and on order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.functions.measures import cohens_h, hanley_mcneil_se
from traceloom.operators import metrics
from traceloom.plans.registry import query
from traceloom.sources.tables import read_table

#: Resamples of the bootstraps and permutations.
ROUNDS = 1000


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, lang, score, other, label, toxic: length in steps of 250 characters as a similarity with many ties."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = read_table(spark, sf_dir, "labels").join(docs, "doc_id")
    step = F.floor(F.col("n_chars") / 250).cast("double")
    return rows.select(F.col("doc_id").alias("pair_id"), "lang", "source", (step / (step + 4)).alias("score"), (1 / (1 + step)).alias("other"), (1 - F.col("quality")).cast("long").alias("label"), F.col("toxic").cast("long").alias("toxic"))


BASE = """WITH s AS (SELECT doc_id AS pair_id, lang, source, f / (f + 4) AS score, 1 / (1 + f) AS other, CAST(1 - quality AS BIGINT) AS label, CAST(toxic AS BIGINT) AS toxic
  FROM (SELECT *, CAST(floor(n_chars / 250) AS DOUBLE) AS f FROM labels JOIN documents USING (doc_id))),
lv AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM s GROUP BY ALL),
cum AS (SELECT *, coalesce(sum(pos) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pb, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM lv)
"""
AUROC = "CASE WHEN count(*) FILTER (a.label = 1) = 0 OR count(*) FILTER (a.label = 0) = 0 THEN 0.5 ELSE 0 END"


def brute(by: str = "") -> str:
    """AUROC by comparing all pairs, per stratum."""
    on = f"AND p.{by} = n.{by}" if by else ""
    key = f"p.{by}, " if by else ""
    return f"SELECT {key}avg(CASE WHEN p.score < n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) AS auroc, avg(CASE WHEN p.score = n.score THEN 1.0 ELSE 0 END) AS tie FROM s p JOIN s n ON p.label = 1 AND n.label = 0 {on} GROUP BY ALL"


def whole(rows: DataFrame) -> DataFrame:
    return rows.withColumn("stratum", F.lit("all"))


@query(BASE + ", b AS (" + brute() + ") SELECT 'all' AS stratum, round(auroc, 6) AS auroc, (SELECT sum(label)::BIGINT FROM s) AS n_positive, (SELECT sum(1 - label)::BIGINT FROM s) AS n_negative, round(tie, 6) AS tie_fraction FROM b")
def auroc_wmw(spark, sf_dir):
    return metrics.auroc(whole(scored(spark, sf_dir)), ["stratum"])


@query(BASE + ", b AS (" + brute("lang") + ") SELECT g.lang, round(coalesce(auroc, 0.5), 6) AS auroc, g.np AS n_positive, g.nn AS n_negative, round(coalesce(tie, 0), 6) AS tie_fraction FROM (SELECT lang, sum(label)::BIGINT AS np, sum(1 - label)::BIGINT AS nn FROM s GROUP BY ALL) g LEFT JOIN b USING (lang)")
def stratified_auroc(spark, sf_dir):
    return metrics.auroc(scored(spark, sf_dir), ["lang"])


@query(BASE + "SELECT 'all' AS stratum, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM (SELECT count(*) FILTER (score < 0.5 AND label = 1) AS tp, count(*) FILTER (score < 0.5 AND label = 0) AS fp, count(*) FILTER (score >= 0.5 AND label = 1) AS fn, count(*) FILTER (score >= 0.5 AND label = 0) AS tn FROM s)")
def confusion_metrics(spark, sf_dir):
    return metrics.confusion(whole(scored(spark, sf_dir)), 0.5, ["stratum"])


@query(BASE + ", c AS (SELECT score AS t FROM lv UNION SELECT 0.0 FROM lv HAVING min(score) > 0 UNION SELECT max(score) + 1e-6 FROM lv), f AS (SELECT t, 2 * count(*) FILTER (score < t AND label = 1) / nullif(count(*) FILTER (score < t) + sum(label), 0) AS f1 FROM c, s GROUP BY ALL) SELECT 'all' AS stratum, round(t, 6) AS threshold, round(f1, 6) AS f1 FROM f ORDER BY f.f1 DESC, t LIMIT 1")
def best_f1_threshold(spark, sf_dir):
    return metrics.best_threshold(whole(scored(spark, sf_dir)), ["stratum"])


@query(BASE + ", o AS (SELECT label, sum(label) OVER w AS tp, sum(1 - label) OVER w AS fp, sum(label) OVER () AS p, sum(1 - label) OVER () AS n FROM s WINDOW w AS (ORDER BY score, pair_id)) SELECT 'all' AS stratum, round(coalesce(max(tp / p) FILTER (fp / n <= 0.2), 0), 6) AS tpr FROM o")
def tpr_at_fpr(spark, sf_dir):
    return metrics.tpr_at_fpr(whole(scored(spark, sf_dir)), 0.2, ["stratum"], "pair_id")


@query(BASE + ", o AS (SELECT label, score, pair_id, sum(label) OVER w / row_number() OVER w AS pr, sum(label) OVER () AS p FROM s WINDOW w AS (ORDER BY score, pair_id)) SELECT 'all' AS stratum, round(sum(a), 6) AS auprc FROM (SELECT label / p * (pr + coalesce(lag(pr) OVER (ORDER BY score, pair_id), 1.0)) / 2 AS a FROM o)")
def auprc(spark, sf_dir):
    return metrics.auprc(whole(scored(spark, sf_dir)), ["stratum"], "pair_id")


EFFECTS = "avg(score) FILTER (label = 1) - avg(score) FILTER (label = 0)"


@query(BASE + f"SELECT 'all' AS stratum, round(({EFFECTS}) / stddev_pop(score) FILTER (label = 0), 6) AS glass_delta, round(({EFFECTS}) / sqrt(((count(*) FILTER (label = 1) - 1) * var_samp(score) FILTER (label = 1) + (count(*) FILTER (label = 0) - 1) * var_samp(score) FILTER (label = 0)) / (count(*) - 2)), 6) AS cohens_d FROM s")
def effect_sizes(spark, sf_dir):
    return metrics.effect_sizes(whole(scored(spark, sf_dir)), ["stratum"])


@query(BASE + ", r AS (SELECT lang, avg(label) AS p1, avg(toxic) AS p2 FROM s GROUP BY ALL) SELECT lang, round(2 * asin(sqrt(p1)) - 2 * asin(sqrt(p2)), 6) AS h FROM r")
def proportion_effect(spark, sf_dir):
    rates = scored(spark, sf_dir).groupBy("lang").agg(F.avg("label").alias("p1"), F.avg("toxic").alias("p2"))
    return rates.select("lang", cohens_h(F.col("p1"), F.col("p2")).alias("h"))


@query(BASE + ", b AS (" + brute() + "), q AS (SELECT auroc AS a, (SELECT sum(label) FROM s) AS p, (SELECT sum(1 - label) FROM s) AS n FROM b) SELECT 'all' AS stratum, round(sqrt((a * (1 - a) + (p - 1) * (a / (2 - a) - a * a) + (n - 1) * (2 * a * a / (1 + a) - a * a)) / (p * n)), 6) AS se FROM q")
def auroc_standard_error(spark, sf_dir):
    rows = metrics.auroc(whole(scored(spark, sf_dir)), ["stratum"])
    return rows.select("stratum", hanley_mcneil_se(F.col("auroc"), F.col("n_positive"), F.col("n_negative")).alias("se"))


def outcomes(rows: DataFrame) -> DataFrame:
    """Right or wrong of two thresholds on the same rows."""
    right = lambda t: (F.col("score") < t) == (F.col("label") == 1)
    return rows.select("*", right(0.3).alias("first"), right(0.6).alias("second"))


MCNEMAR = BASE + """, o AS (SELECT *, (score < 0.3) = (label = 1) AS x, (score < 0.6) = (label = 1) AS y FROM s), bc AS (SELECT source, count(*) FILTER (x AND NOT y) AS b, count(*) FILTER (y AND NOT x) AS c FROM o GROUP BY ALL),
st AS (SELECT *, CASE WHEN b + c = 0 THEN 0.0 ELSE power(greatest(abs(b - c) - 1, 0), 2) / (b + c) END AS statistic FROM bc), tt AS (SELECT *, 1 / (1 + 0.3275911 * sqrt(statistic) / sqrt(2)) AS t FROM st),
mc AS (SELECT *, least(1.0, t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-statistic / 2)) AS p_value FROM tt)"""


@query(MCNEMAR + " SELECT source, b, c, round(statistic, 6) AS statistic, round(p_value, 6) AS p_value FROM mc")
def mcnemar(spark, sf_dir):
    return metrics.mcnemar(outcomes(scored(spark, sf_dir)), ["source"])


@query(MCNEMAR + ", r AS (SELECT source AS test, p_value, row_number() OVER (ORDER BY p_value, source) AS rank, 0.05 / (count(*) OVER () - row_number() OVER (ORDER BY p_value, source) + 1) AS corrected_alpha FROM mc), h AS (SELECT *, coalesce(max(CASE WHEN p_value > corrected_alpha THEN 1 ELSE 0 END) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS stopped FROM r) SELECT test, round(p_value, 6) AS p_value, rank, round(corrected_alpha, 6) AS corrected_alpha, (NOT stopped AND p_value <= corrected_alpha) AS reject, stopped FROM h")
def holm_bonferroni(spark, sf_dir):
    tests = metrics.mcnemar(outcomes(scored(spark, sf_dir)), ["source"]).select(F.col("source").alias("test"), "p_value")
    return metrics.holm(tests)


HASH = "CAST(('0x' || substr(md5({}), 1, 8)) AS BIGINT)"


@query(BASE + f""", u AS (SELECT *, row_number() OVER (ORDER BY pair_id) - 1 AS no FROM s), d AS (SELECT r.range AS round, {HASH.format("'42|' || r.range || '|' || i.range")} % (SELECT count(*) FROM s) AS no FROM range({ROUNDS}) r, range((SELECT count(*) FROM s)) i),
x AS (SELECT round, score, label FROM d JOIN u USING (no)), g AS (SELECT round, score, sum(label) AS pos, sum(1 - label) AS neg FROM x GROUP BY ALL), w AS (SELECT *, coalesce(sum(pos) OVER (PARTITION BY round ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pb FROM g),
a AS (SELECT round, CASE WHEN sum(pos) * sum(neg) = 0 THEN 0.5 ELSE sum(neg * (pb + pos / 2)) / (sum(pos) * sum(neg)) END AS auroc FROM w GROUP BY ALL), k AS (SELECT auroc, row_number() OVER (ORDER BY auroc, round) - 1 AS place FROM a)
SELECT round(max(auroc) FILTER (place = floor(0.025 * {ROUNDS})), 6) AS low, round(max(auroc) FILTER (place = ceil(0.975 * {ROUNDS}) - 1), 6) AS high FROM k""")
def bootstrap_auroc(spark, sf_dir):
    return metrics.bootstrap_ci(scored(spark, sf_dir), ROUNDS)


@query(BASE + f""", u AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS no FROM (SELECT DISTINCT source FROM s WHERE source IS NOT NULL)), d AS (SELECT r.range AS round, {HASH.format("'42|' || r.range || '|' || i.range")} % (SELECT count(*) FROM u) AS no FROM range({ROUNDS}) r, range((SELECT count(*) FROM u)) i),
h AS (SELECT no, score, sum(label) AS pos, sum(1 - label) AS neg FROM s JOIN u USING (source) GROUP BY ALL), g AS (SELECT round, score, sum(pos) AS pos, sum(neg) AS neg FROM d JOIN h USING (no) GROUP BY ALL), w AS (SELECT *, coalesce(sum(pos) OVER (PARTITION BY round ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pb FROM g),
a AS (SELECT round, CASE WHEN sum(pos) * sum(neg) = 0 THEN 0.5 ELSE sum(neg * (pb + pos / 2)) / (sum(pos) * sum(neg)) END AS auroc FROM w GROUP BY ALL), k AS (SELECT auroc, row_number() OVER (ORDER BY auroc, round) - 1 AS place FROM a)
SELECT round(max(auroc) FILTER (place = floor(0.025 * {ROUNDS})), 6) AS low, round(max(auroc) FILTER (place = ceil(0.975 * {ROUNDS}) - 1), 6) AS high FROM k""")
def cluster_bootstrap_auroc(spark, sf_dir):
    """Sources are the clusters."""
    return metrics.bootstrap_ci(scored(spark, sf_dir), ROUNDS, unit="source")


@query(BASE + f""", u AS (SELECT *, row_number() OVER (ORDER BY pair_id) AS no FROM s), d AS (SELECT r.range AS round, label, row_number() OVER (PARTITION BY r.range ORDER BY {HASH.format("'42|' || r.range || '|' || pair_id")}, pair_id) AS no FROM s, range({ROUNDS}) r),
x AS (SELECT round, u.score, d.label FROM d JOIN u USING (no)), g AS (SELECT round, score, sum(label) AS pos, sum(1 - label) AS neg FROM x GROUP BY ALL), w AS (SELECT *, coalesce(sum(pos) OVER (PARTITION BY round ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pb FROM g),
a AS (SELECT round, sum(neg * (pb + pos / 2)) / (sum(pos) * sum(neg)) AS dealt FROM w GROUP BY ALL), b AS ({brute()}) SELECT round(b.auroc, 6) AS auroc, round(avg(CASE WHEN dealt >= b.auroc THEN 1 ELSE 0 END), 6) AS p_value FROM a, b GROUP BY b.auroc""")
def permutation_test(spark, sf_dir):
    return metrics.permutation_p(scored(spark, sf_dir), ROUNDS)


@query()
def permutation_test_levels(spark, sf_dir):
    """Labels split over distinct scores by the hypergeometric distribution; numpy's draws have no twin in SQL."""
    return metrics.permutation_p_of_levels(scored(spark, sf_dir), ROUNDS)


@query()
def swap_test_levels(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return metrics.swap_p_of_levels(rows.select(F.col("score").alias("a"), F.col("other").alias("b")), ROUNDS)


@query(BASE + f""", d AS (SELECT r.range AS round, avg((CASE WHEN {HASH.format("'42|' || r.range || '|' || pair_id")} % 2 = 0 THEN 1 ELSE -1 END) * (score - other)) AS dealt FROM s, range({ROUNDS}) r GROUP BY ALL), m AS (SELECT avg(score - other) AS delta FROM s)
SELECT round(delta, 6) AS delta, round(avg(CASE WHEN abs(dealt) >= abs(delta) THEN 1 ELSE 0 END), 6) AS p_value FROM d, m GROUP BY delta""")
def swap_test(spark, sf_dir):
    rows = scored(spark, sf_dir).select("pair_id", F.col("score").alias("a"), F.col("other").alias("b"))
    return metrics.swap_p(rows, ROUNDS)


@query(BASE + "SELECT lang, round(CASE WHEN stddev_pop(score) * stddev_pop(label) > 1e-12 THEN covar_pop(score, label) / (stddev_pop(score) * stddev_pop(label)) END, 6) AS pearson, round(quantile_cont(score, 0.25), 6) AS q25, round(quantile_cont(score, 0.9), 6) AS q90 FROM s GROUP BY ALL")
def score_summary(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("lang").agg(metrics.pearson("score", "label").alias("pearson"), F.percentile("score", F.lit(0.25)).alias("q25"), F.percentile("score", F.lit(0.9)).alias("q90"))


@query(BASE + ", t AS (SELECT CAST(unnest([0.2, 0.4, 0.6, 0.8]) AS DOUBLE) AS threshold) SELECT threshold, count(*) FILTER (score < threshold AND label = 1) AS detected, round(count(*) FILTER (score < threshold AND label = 1) / sum(label), 6) AS rate FROM s, t GROUP BY ALL")
def threshold_sweep(spark, sf_dir):
    """A few fixed thresholds against all rows."""
    grid = F.explode(F.array(*[F.lit(t) for t in (0.2, 0.4, 0.6, 0.8)]))
    rows = scored(spark, sf_dir).select("score", "label", grid.alias("threshold"))
    found = F.sum(((F.col("score") < F.col("threshold")) & (F.col("label") == 1)).cast("long"))
    return rows.groupBy("threshold").agg(found.alias("detected"), (found / F.sum("label")).alias("rate"))
