"""Similarity of texts: token counts, TF-IDF, n-grams, edit distance, near-duplicates above a strict bound."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from traceloom.functions.measures import ratio
from traceloom.sources.staging import Workspace


def token_counts(docs: DataFrame, tokens: Column) -> DataFrame:
    """doc_id, token, n."""
    return docs.select("doc_id", F.explode(tokens).alias("token")).where("token != ''").groupBy("doc_id", "token").agg(F.count("*").alias("n"))


def words(text: str = "text") -> Column:
    return F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+")


def word_grams(text: str, n: int) -> Column:
    """Runs of n words, joined by a space."""
    w = F.filter(words(text), lambda x: x != "")
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))


def char_grams(text: str, n: int) -> Column:
    c = F.coalesce(F.col(text), F.lit(""))
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: c.substr(i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def joint_features(tokens: Column) -> Column:
    """The features of a text in one list: words (W1), pairs of words (W2), and runs of 3 and 4 characters (C3, C4) of the words joined by a space."""
    runs = lambda n, made: F.when(n > 0, F.transform(F.sequence(F.lit(1), n), made)).otherwise(F.array().cast("array<string>"))
    joined = F.array_join(tokens, " ")
    words_ = F.transform(tokens, lambda t: F.concat(F.lit("W1:"), t))
    pairs = runs(F.size(tokens) - 1, lambda i: F.concat(F.lit("W2:"), F.element_at(tokens, i), F.lit("_"), F.element_at(tokens, i + 1)))
    chars = lambda n: runs(F.length(joined) - (n - 1), lambda i: F.concat(F.lit(f"C{n}:"), joined.substr(i, F.lit(n))))
    return F.concat(words_, pairs, chars(3), chars(4))


def hashed_features(features: Column) -> Column:
    """Features as numbers of 60 bits from md5, the same in any engine: so a vector's keys are longs, and two features share one only by chance."""
    return F.transform(features, lambda f: F.conv(F.substring(F.md5(f), 1, 15), 16, 10).cast("long"))


def joint_counts(lists: DataFrame) -> DataFrame:
    """doc_id, token (a hashed feature), n of doc_id, tokens: what ``idf``, ``tfidf`` and ``cosine_of_pairs`` take."""
    held = lists.select("doc_id", F.explode(hashed_features(joint_features(F.col("tokens")))).alias("token"))
    return held.groupBy("doc_id", "token").agg(F.count("*").alias("n"))


def idf(counts: DataFrame, n_docs: DataFrame) -> DataFrame:
    """token, idf = ln((N + 1) / (df + 1)) + 1. n_docs: one row, one column n_docs."""
    df = counts.groupBy("token").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n_docs)).select("token", (F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


#: What a token that the fitted documents lack weighs.
def unseen() -> Column:
    return F.log(F.lit(2.0)) + 1


def tfidf(counts: DataFrame, weights: DataFrame) -> DataFrame:
    """doc_id, token, weight: share of the document's tokens times idf."""
    share = F.col("n") / F.sum("n").over(Window.partitionBy("doc_id"))
    return counts.withColumn("tf", share).join(weights, "token", "left").select("doc_id", "token", (F.col("tf") * F.coalesce("idf", unseen())).alias("weight"))


def cosine_of_pairs(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """left, right, cosine of sparse vectors (doc_id, token, weight); 0 with an empty vector."""
    norms = vectors.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    a = vectors.select(F.col("doc_id").alias("left"), "token", F.col("weight").alias("wa"))
    b = vectors.select(F.col("doc_id").alias("right"), "token", F.col("weight").alias("wb"))
    dots = pairs.join(a, "left").join(b, ["right", "token"]).groupBy("left", "right").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    na, nb = norms.select(F.col("doc_id").alias("left"), F.col("norm").alias("na")), norms.select(F.col("doc_id").alias("right"), F.col("norm").alias("nb"))
    rows = pairs.join(dots, ["left", "right"], "left").join(na, "left", "left").join(nb, "right", "left")
    norm = F.coalesce(F.col("na") * F.col("nb"), F.lit(0.0))
    return rows.select("left", "right", ratio(F.coalesce("dot", F.lit(0.0)), norm).alias("cosine"))


def jaccard_of_pairs(sets: DataFrame, pairs: DataFrame, empty: float = 1.0) -> DataFrame:
    """left, right, jaccard of token sets (doc_id, tokens); two empty sets are equal."""
    a, b = sets.select(F.col("doc_id").alias("left"), F.col("tokens").alias("ta")), sets.select(F.col("doc_id").alias("right"), F.col("tokens").alias("tb"))
    both, either = F.size(F.array_intersect("ta", "tb")), F.size(F.array_union("ta", "tb"))
    return pairs.join(a, "left").join(b, "right").select("left", "right", ratio(both, either.cast("double"), empty).alias("jaccard"))


def dense_cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return ratio(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def edit_distance(a: list | str | None, b: list | str | None) -> int | None:
    """Levenshtein distance of two lists of any length: rows of the table as bits of one number (Myers, Hyyrö)."""
    if a is None or b is None:
        return None
    if not a:
        return len(b)
    places: dict = {}
    for i, t in enumerate(a):
        places[t] = places.get(t, 0) | 1 << i
    every, last, told = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = every, 0  # where the table grows and falls by one from row to row
    for t in b:
        same = places.get(t, 0)
        flat = same | down
        across = (((same & up) + up) ^ up) | same
        right, left = down | (every & ~(across | up)), up & across
        told += bool(right & last) - bool(left & last)
        right, left = (right << 1 | 1) & every, left << 1 & every
        up, down = left | (every & ~(flat | right)), right & flat
    return told


@F.pandas_udf(LongType())
def edit_distances(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distances of batches of lists, or of texts by their characters."""
    listed = lambda x: x if isinstance(x, str) else x.tolist()
    found = [None if x is None or y is None else edit_distance(listed(x), listed(y)) for x, y in zip(a, b, strict=True)]
    return pd.Series(found, dtype="Int64")


def token_edit_similarity(a: Column, b: Column, cap: int | None = None, text: bool = False) -> Column:
    """1 - edit distance / longer length of two whole token lists; with a cap, of their first ``cap`` tokens. text: of two texts, whose tokens are characters."""
    if cap is not None:
        a, b = (F.left(x, F.lit(cap)) if text else F.slice(x, 1, cap) for x in (a, b))
    length = F.length if text else F.size
    longest = F.greatest(length(a), length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - edit_distances(a, b) / longest)


def near_duplicate_classes(sets: DataFrame, percent: int, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """Classes of equal token sets, and the pairs of classes with 100 * intersection > percent * union.

    sets: doc_id, tokens (distinct). Returns (doc_id, class_id) and (a, b, jaccard), a < b, exact: two sets above the bound
    share a token among the rarest of each, all but as many as any partner must share. The first token that they share, in order of rarity, has
    enough tokens behind it in both; the join keeps no other pair. Empty sets are left out. Both tables are staged in ``work``.
    """
    keyed = sets.where(F.size("tokens") > 0).select("doc_id", F.array_sort("tokens").alias("tokens"))
    keyed = work.stage(keyed.withColumn("key", F.sha2(F.array_join("tokens", " "), 256)), "sets")
    classes = work.stage(keyed.groupBy("key").agg(F.min("doc_id").alias("class_id")), "classes")
    members = work.stage(keyed.select("doc_id", "key").join(classes, "key").select("doc_id", "class_id"), "members")
    heads = work.stage(keyed.join(classes.select(F.col("class_id").alias("doc_id"), "key"), ["doc_id", "key"], "left_semi").select("doc_id", "tokens", F.size("tokens").alias("n")), "heads")
    posted = heads.select("doc_id", "n", F.explode("tokens").alias("token"))
    often = posted.groupBy("token").agg(F.count("*").alias("often"))
    rarest = posted.join(often, "token").groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("held"))
    kept = F.col("n") - F.floor(F.col("n") * percent / 100)
    prefix = rarest.select("doc_id", "n", F.posexplode(F.slice("held", F.lit(1), kept.cast("int"))).alias("at", "h")).where("h.often > 1").select("doc_id", "n", "at", F.xxhash64("h.token").alias("token"))
    prefix = work.stage(prefix, "prefix")
    side = lambda s: prefix.select("token", *[F.col(c).alias(f"{s}_{c}") for c in ("doc_id", "n", "at")])
    most = F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"))
    reach = (100 + percent) * most > percent * (F.col("a_n") + F.col("b_n"))
    close = side("a").join(side("b"), "token").where("a_doc_id < b_doc_id").where(reach).select(F.col("a_doc_id").alias("a"), F.col("b_doc_id").alias("b")).distinct()
    ta, tb = heads.select(F.col("doc_id").alias("a"), F.col("tokens").alias("ta")), heads.select(F.col("doc_id").alias("b"), F.col("tokens").alias("tb"))
    both, either = F.size(F.array_intersect("ta", "tb")), F.size(F.array_union("ta", "tb"))
    found = work.stage(close, "close").join(ta, "a").join(tb, "b").where(100 * both > percent * either).select("a", "b", (both / either).alias("jaccard"))
    return members, work.stage(found, "pairs")
