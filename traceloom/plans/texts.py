"""Queries on texts and vectors, and audits on the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceloom.operators import audits, genomes, texts, vectors
from traceloom.plans.registry import query
from traceloom.sources.staging import Workspace
from traceloom.sources.tables import read_table

WORDS = "WITH w AS (SELECT item_id AS doc_id, unnest(string_split_regex(lower(coalesce(text, '')), '\\s+')) AS token FROM benchmark), c AS (SELECT doc_id, token, count(*) AS n FROM w WHERE token <> '' GROUP BY ALL)"
TFIDF = WORDS + """, i AS (SELECT token, ln(((SELECT count(*) FROM benchmark) + 1) / (count(*) + 1)) + 1 AS idf FROM c GROUP BY ALL),
v AS (SELECT doc_id, token, n / sum(n) OVER (PARTITION BY doc_id) * idf AS w FROM c JOIN i USING (token)), nr AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM v GROUP BY ALL),
p AS (SELECT item_id AS l, item_id + 1 AS r FROM benchmark WHERE item_id + 1 IN (SELECT item_id FROM benchmark)), d AS (SELECT l, r, sum(a.w * b.w) AS dot FROM p JOIN v a ON a.doc_id = l JOIN v b ON b.doc_id = r AND b.token = a.token GROUP BY ALL)"""


def items(spark, sf_dir):
    return read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")


def next_pairs(rows):
    """Each id with the next one."""
    ids = rows.select("doc_id").distinct()
    return ids.select(F.col("doc_id").alias("left"), (F.col("doc_id") + 1).alias("right")).join(ids.select(F.col("doc_id").alias("right")), "right", "left_semi").select("left", "right")


@query(TFIDF + " SELECT l AS \"left\", r AS \"right\", round(coalesce(dot, 0) / (a.norm * b.norm), 6) AS cosine FROM p LEFT JOIN d USING (l, r) JOIN nr a ON a.doc_id = l JOIN nr b ON b.doc_id = r")
def tfidf_cosine(spark, sf_dir):
    docs = items(spark, sf_dir)
    counts = texts.token_counts(docs, texts.words())
    weights = texts.idf(counts, docs.agg(F.count("*").alias("n_docs")))
    return texts.cosine_of_pairs(texts.tfidf(counts, weights), next_pairs(docs))


@query(WORDS + ", s AS (SELECT doc_id, list(token) AS t FROM c GROUP BY ALL) SELECT a.doc_id AS \"left\", b.doc_id AS \"right\", round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) AS jaccard FROM s a JOIN s b ON b.doc_id = a.doc_id + 1")
def token_jaccard(spark, sf_dir):
    docs = items(spark, sf_dir)
    sets = docs.select("doc_id", F.array_distinct(F.filter(texts.words(), lambda t: t != "")).alias("tokens"))
    return texts.jaccard_of_pairs(sets, next_pairs(docs))


@query("WITH s AS (SELECT doc_id, list_sort(list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda x: x <> ''))) AS t FROM documents), f AS (SELECT * FROM s WHERE len(t) > 0), m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS class_id FROM f), h AS (SELECT doc_id, t FROM f JOIN (SELECT DISTINCT class_id AS doc_id FROM m) USING (doc_id)), l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM h a JOIN h b ON a.doc_id < b.doc_id AND 100 * least(len(a.t), len(b.t)) > 95 * greatest(len(a.t), len(b.t)) AND 100 * len(list_intersect(a.t, b.t)) > 95 * (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))), n AS (SELECT x, count(*) AS links FROM (SELECT a AS x FROM l UNION ALL SELECT b FROM l) GROUP BY ALL) SELECT doc_id, class_id, coalesce(links, 0) AS links FROM m LEFT JOIN n ON x = class_id")
def token_jaccard_neardup(spark, sf_dir):
    """Token-set Jaccard above 0.95, strictly: each document's class of equal sets, and the links of the class to others."""
    docs = read_table(spark, sf_dir, "documents")
    sets = docs.select("doc_id", F.array_distinct(F.filter(texts.words(), lambda t: t != "")).alias("tokens"))
    with Workspace(spark, "token-neardup") as work:
        members, pairs = texts.near_duplicate_classes(sets, 95, work)
        links = pairs.select(F.col("a").alias("class_id")).union(pairs.select("b")).groupBy("class_id").agg(F.count("*").alias("links"))
        return work.keep(members.join(links, "class_id", "left").select("doc_id", "class_id", F.coalesce("links", F.lit(0)).alias("links")), "rows")


@query("WITH b AS (SELECT DISTINCT trim(text) AS text FROM benchmark), l AS (SELECT source, doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) SELECT source, count(*) AS lines, count(*) FILTER (b.text IS NOT NULL) AS leaked FROM l LEFT JOIN b ON b.text = l.line GROUP BY ALL")
def leakage_overlap(spark, sf_dir):
    """Lines of documents that are items of the benchmark."""
    known = read_table(spark, sf_dir, "benchmark").select(F.trim("text").alias("line")).distinct().withColumn("hit", F.lit(1))
    lines = read_table(spark, sf_dir, "documents").select("source", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.trim("line"))
    return lines.join(known, "line", "left").groupBy("source").agg(F.count("*").alias("lines"), F.count("hit").alias("leaked"))


@query("WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY p_brand) AS t FROM c) SELECT p_brand, round(-sum(n / t * log2(n / t)), 6) AS bits, round(CASE WHEN count(*) <= 1 THEN 0 ELSE -sum(n / t * log2(n / t)) / log2(count(*)) END, 6) AS bits_normalised FROM t GROUP BY ALL")
def category_entropy(spark, sf_dir):
    counts = read_table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return genomes.shannon(counts, ["p_brand"], "bits")


@query("WITH b AS (SELECT range AS bin FROM range(20)), c AS (SELECT least(CAST(floor(o_totalprice / 25000) AS BIGINT), 19) AS bin, count(*) AS n FROM orders GROUP BY ALL) SELECT bin, bin * 25000 AS low, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (bin)")
def fixed_width_histogram(spark, sf_dir):
    return audits.histogram(read_table(spark, sf_dir, "orders"), "o_totalprice", 25000, 20)


SPLITS = "WITH o AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('42|' || c_custkey), c_custkey) - 1 AS place, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer), sp AS (SELECT c_custkey, c_mktsegment, CASE WHEN place < round_even(n * 0.5, 0) THEN 'train' WHEN place < round_even(n * 0.5, 0) + round_even(n * 0.15, 0) THEN 'dev' WHEN place < round_even(n * 0.5, 0) + 2 * round_even(n * 0.15, 0) THEN 'val' ELSE 'test' END AS split FROM o) "


def customer_splits(spark, sf_dir):
    return audits.assign_splits(read_table(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey")


@query(SPLITS + "SELECT * FROM sp")
def stratified_splits(spark, sf_dir):
    return customer_splits(spark, sf_dir)


@query(SPLITS + "SELECT c_mktsegment, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'dev') AS dev, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM sp GROUP BY ALL")
def split_counts(spark, sf_dir):
    return audits.split_counts(customer_splits(spark, sf_dir), "c_mktsegment")


@query(SPLITS + ", n AS (SELECT c_nationkey, split FROM customer JOIN sp USING (c_custkey)) SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, count(DISTINCT split) AS splits, count(*) AS n FROM n GROUP BY ALL HAVING count(DISTINCT split) > 1")
def cross_split_nations(spark, sf_dir):
    rows = customer_splits(spark, sf_dir).join(read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    return audits.shared_keys(rows, "c_nationkey")


@query(SPLITS + ", n AS (SELECT CAST(floor(c_acctbal / 50) AS BIGINT) AS bin, split FROM customer JOIN sp USING (c_custkey)) SELECT DISTINCT bin FROM n WHERE split = 'train' AND bin NOT IN (SELECT bin FROM n WHERE split = 'dev')")
def balances_of_one_split(spark, sf_dir):
    """Balances, in steps of 50, in train that dev lacks."""
    customers = read_table(spark, sf_dir, "customer").select("c_custkey", F.floor(F.col("c_acctbal") / 50).cast("long").alias("bin"))
    return audits.only_in(customer_splits(spark, sf_dir).join(customers, "c_custkey"), "bin", "train", "dev")


@query(SPLITS + ", f AS (SELECT split, o_orderpriority, count(*) AS n FROM orders JOIN sp ON o_custkey = c_custkey GROUP BY ALL) SELECT o_orderpriority, CAST(coalesce(sum(n) FILTER (split = 'train'), 0) AS BIGINT) AS train, CAST(coalesce(sum(n) FILTER (split = 'dev'), 0) AS BIGINT) AS dev, CAST(coalesce(sum(n) FILTER (split = 'val'), 0) AS BIGINT) AS val, CAST(coalesce(sum(n) FILTER (split = 'test'), 0) AS BIGINT) AS test FROM f GROUP BY ALL")
def split_family_distribution(spark, sf_dir):
    """How the kinds of rows (priorities for transformations) are dealt over splits."""
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    return audits.split_counts(orders.join(customer_splits(spark, sf_dir), "c_custkey"), "o_orderpriority")


@query(SPLITS + """, r AS (SELECT o_custkey AS program, o_orderdate AS pair_id, o_orderpriority AS family, floor(c_acctbal / 50) AS category, split FROM orders JOIN sp ON o_custkey = c_custkey JOIN customer USING (c_custkey)),
h AS (SELECT "check", subject, list_sort(list(DISTINCT split)) AS s, count(*) AS n FROM (SELECT 'program' AS "check", CAST(program AS VARCHAR) AS subject, split FROM r UNION ALL SELECT 'pair', strftime(pair_id, '%Y-%m-%d'), split FROM r
  UNION ALL SELECT 'family', family, split FROM r UNION ALL SELECT 'category', CAST(CAST(category AS BIGINT) AS VARCHAR), split FROM r) GROUP BY ALL)
SELECT "check", subject, array_to_string(s, ',') AS splits, n FROM h WHERE CASE "check" WHEN 'family' THEN list_contains(s, 'dev') AND list_contains(s, 'test') WHEN 'category' THEN list_contains(s, 'test') AND NOT list_contains(s, 'dev') ELSE len(s) > 1 END
UNION ALL SELECT 'orphan', CAST(c_custkey AS VARCHAR), '', 0 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def leakage_audit(spark, sf_dir):
    """Orders as pairs: days stand for their ids, customers for programs, priorities for families, balances in steps of 50 for categories."""
    customers = read_table(spark, sf_dir, "customer").select("c_custkey", F.floor(F.col("c_acctbal") / 50).cast("long").alias("category"))
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("pair_id"), F.col("o_orderpriority").alias("family"))
    rows = orders.join(customer_splits(spark, sf_dir), "c_custkey").join(customers, "c_custkey").withColumnRenamed("c_custkey", "program")
    return audits.leakage_audit(rows, customers.select(F.col("c_custkey").alias("program")))


@query("SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def repeated_texts(spark, sf_dir):
    return audits.repeated(read_table(spark, sf_dir, "documents"), ["text"])


@query("SELECT a.vec_id AS \"left\", b.vec_id AS \"right\", round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def embedding_cosine(spark, sf_dir):
    """Cosine of each stored vector with the next one's."""
    rows = read_table(spark, sf_dir, "embeddings")
    a, b = rows.select(F.col("vec_id").alias("left"), F.col("embedding").alias("ea")), rows.select((F.col("vec_id") - 1).alias("left"), F.col("vec_id").alias("right"), F.col("embedding").alias("eb"))
    return a.join(b, "left").select("left", "right", texts.dense_cosine(F.col("ea"), F.col("eb")).alias("cosine"))


@query()
def token_edit_similarity(spark, sf_dir):
    """Edit similarity over tokens of each benchmark item and the next one."""
    docs = items(spark, sf_dir)
    lists = docs.select("doc_id", F.filter(texts.words(), lambda t: t != "").alias("tokens"))
    a, b = lists.select(F.col("doc_id").alias("left"), F.col("tokens").alias("ta")), lists.select(F.col("doc_id").alias("right"), F.col("tokens").alias("tb"))
    return next_pairs(docs).join(a, "left").join(b, "right").select("left", "right", texts.token_edit_similarity(F.col("ta"), F.col("tb")).alias("similarity"))


@query("WITH c AS (SELECT item_id AS doc_id, unnest(list_transform(range(1, greatest(length(text) - 1, 1)), lambda i: substr(text, i, 3))) AS token FROM benchmark) SELECT doc_id, count(*) AS grams, count(DISTINCT token) AS distinct_grams FROM c WHERE length(token) = 3 GROUP BY ALL")
def char_gram_counts(spark, sf_dir):
    counts = texts.token_counts(items(spark, sf_dir), texts.char_grams("text", 3))
    return counts.groupBy("doc_id").agg(F.sum("n").alias("grams"), F.count("*").alias("distinct_grams"))


JOINT = """WITH w AS (SELECT item_id AS doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS t FROM benchmark), j AS (SELECT *, array_to_string(t, ' ') AS s FROM w),
f AS (SELECT doc_id, unnest(list_concat(list_transform(t, lambda x: 'W1:' || x), list_transform(range(1, len(t)), lambda i: 'W2:' || t[i] || '_' || t[i + 1]),
  list_transform(range(1, length(s) - 1), lambda i: 'C3:' || substr(s, i, 3)), list_transform(range(1, length(s) - 2), lambda i: 'C4:' || substr(s, i, 4)))) AS token FROM j),
c AS (SELECT doc_id, token, count(*) AS n FROM f GROUP BY ALL)"""


@query(JOINT + TFIDF.removeprefix(WORDS) + " SELECT l AS \"left\", r AS \"right\", round(coalesce(dot, 0) / (a.norm * b.norm), 6) AS cosine FROM p LEFT JOIN d USING (l, r) JOIN nr a ON a.doc_id = l JOIN nr b ON b.doc_id = r")
def joint_ngram_cosine(spark, sf_dir):
    """TF-IDF over words, word pairs and runs of characters in one vector."""
    docs = items(spark, sf_dir)
    counts = texts.joint_counts(docs.select("doc_id", F.filter(texts.words(), lambda t: t != "").alias("tokens")))
    weights = texts.idf(counts, docs.agg(F.count("*").alias("n_docs")))
    return texts.cosine_of_pairs(texts.tfidf(counts, weights), next_pairs(docs))


#: Neighbours of a vector that are told.
NEAREST = 10


def asked_vectors(spark, sf_dir):
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return rows, rows.where("vec_id % 20 = 0")


@query()
def embedding_cosine_topk(spark, sf_dir):
    """Every vector whose id is divisible by 20 against all, through the inverted file; its recall is tested against the exact search."""
    return vectors.nearest(*asked_vectors(spark, sf_dir), NEAREST)


@query("WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v), c AS (SELECT q.vec_id AS query, m.vec_id, round(list_dot_product(q.e, m.e) / (q.n * m.n), 6) AS cosine FROM u q JOIN u m ON q.vec_id % 20 = 0 AND q.vec_id <> m.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec_id) AS rank FROM c) SELECT query, rank, cosine FROM r WHERE rank <= 10")
def embedding_cosine_exact(spark, sf_dir):
    """The exact search: all cells are probed, in blocks."""
    rows, asked = asked_vectors(spark, sf_dir)
    return vectors.nearest(rows, asked, NEAREST, cells=16, probes=16).drop("vec_id")
