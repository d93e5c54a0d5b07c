"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A document is a bag of words; a word's weight is its count. For each coordinate,
a word draws r and c from Gamma(2, 1) and b from a uniform, all by hashes of the
word and the coordinate. With weight w it offers t = floor(ln w / r + b) at
the price ln c - r (t - b) - r; the word of the lowest price is the document's
sample, with its t. Two documents share a coordinate's sample with a probability
equal to their generalised Jaccard similarity, sum of min over sum of max.

A price and a sample's identity are packed into one long, so the lowest price is the least long:
the samples of a document are plain minima.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.llm.common import Workspace

COORDINATES = 64
REACH = 20.0
SPACE = r"[\x20\x09-\x0D]"
LEAST = -(1 << 63)


def uniform(h: Column, at: int, bits: int) -> Column:
    """A number in (0, 1) from some bits of a hash."""
    return (F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << bits) - 1)).cast("double") + 0.5) / float(1 << bits)


def near_offers(counts: DataFrame, coordinates: int, reach: float | None) -> DataFrame:
    """(..., coordinate, own, edited): the offers of each term for each coordinate: price (high half) and identity (low half); null for a weight of 0.

    With a reach, offers that are surely dearer than ln(reach / words) are left out before a logarithm is taken: with c = -ln v and
    e^-r = x, the exponential of a price is c x^(t - b + 1), at least c x / w; for w = 1, where t is 0, at least c x / (1 - b + b x).
    And c is at least 2 (1 - v) / (1 + v).
    """
    rng = random.Random(20)
    most = [(reach or 0.0) * F.col(c) / F.greatest(f"{c}_words", F.lit(1)) for c in ("own", "edited")]
    told = counts.withColumn("limit", F.greatest(*most)).withColumn("single", (F.greatest("own", "edited") == 1).cast("double"))
    told = told.withColumn("own", F.log("own")).withColumn("edited", F.log("edited"))
    told = told.select("*", F.posexplode(F.array(*[F.lit(rng.getrandbits(63)) for _ in range(coordinates)])).alias("coordinate", "seed"))
    h = F.xxhash64(F.col("term").bitwiseXOR(F.col("seed")))
    g = F.xxhash64(h)
    v, x, b = uniform(h, 0, 32) * uniform(h, 32, 32), uniform(g, 0, 21) * uniform(g, 21, 21), uniform(g, 42, 21)
    if reach is not None:
        told = told.where(2.0 * (1.0 - v) * x <= F.col("limit") * (1.0 + v) * (1.0 - F.col("single") * b * (1.0 - x)))
    r, log_c = -F.log(x), F.log(-F.log(v))

    def offer(log_weight: Column) -> Column:
        t = F.floor(log_weight / r + b)
        high = fixed(log_c - r * (t - b + 1))
        return high.bitwiseOR(h.bitwiseXOR(t * 0x9E3779B1).bitwiseAND(F.lit((1 << 32) - 1)))

    return told.select("id", "h", "own_words", "edited_words", "coordinate", offer(F.col("own")).alias("own"), offer(F.col("edited")).alias("edited"))


def fixed(price: Column) -> Column:
    """A price in the high half of a long."""
    return F.shiftleft(((price + 128.0) * float(1 << 22)).cast("long"), 32)


def samples(both: DataFrame, coordinates: int, reach: float | None) -> DataFrame:
    """(id, h, own, edited): the identities of all coordinates' lowest offers; null where that of a coordinate isn't sure to be the lowest.

    The lowest price is exponential with the number of words as its rate, so it is above the reach with a chance of e^-reach.
    """
    least = near_offers(weights(both), coordinates, reach).groupBy("id", "h", "own_words", "edited_words", "coordinate").agg(F.min("own").alias("own"), F.min("edited").alias("edited"))
    if reach is not None:  # what was left out is no cheaper than this, to the last digit of a price
        sure = lambda c: F.col(c) < fixed(F.log(reach / F.greatest(f"{c}_words", F.lit(1))) - 2.0**-21)
        least = least.select("id", "h", "coordinate", *[F.when(sure(c), F.col(c)).alias(c) for c in ("own", "edited")])
    told = least.groupBy("id", "h").agg(F.sort_array(F.collect_list(F.struct("coordinate", "own", "edited"))).alias("all"), *[F.count(c).alias(f"n_{c}") for c in ("own", "edited")])
    return told.select("id", "h", *[F.when(F.col(f"n_{c}") == coordinates, identities(F.col(f"all.{c}"))).alias(c) for c in ("own", "edited")])


def identities(offers: Column) -> Column:
    """The offers' identities as an array of int."""
    return F.transform(offers, lambda s: F.shiftright(F.shiftleft(s, 32), 32).cast("int"))


def likeness(left: Column, right: Column) -> Column:
    """Share of equal coordinates; two empty documents (null) are alike, an empty one is like no other."""
    same = F.aggregate(F.zip_with(left, right, lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, v: s + v)
    return F.when(left.isNull() & right.isNull(), 1.0).when(left.isNull() | right.isNull(), 0.0).otherwise(same / F.size(left).cast("double"))


def hexed(samples: Column) -> Column:
    """The identities as hexadecimal digits, 8 a coordinate; an empty document has none."""
    digits = F.transform(samples, lambda s: F.lower(F.lpad(F.hex(s.cast("long").bitwiseAND(F.lit((1 << 32) - 1))), 8, "0")))
    return F.coalesce(F.array_join(digits, ""), F.lit(""))


def followers(rows: DataFrame, work: Workspace) -> DataFrame:
    """Each (id, h) row with the row that follows in descending id, h order, around the end.

    Only ids, text hashes and lengths are ordered: by ranges, a window in each,
    and the ranges' first rows joined to the ranges before.
    """
    ranged = work.stage(rows.repartitionByRange(F.col("id").desc(), F.col("h").desc()).withColumn("range", F.spark_partition_id()), "fingerprint-order")
    down = Window.partitionBy("range").orderBy(F.col("id").desc(), F.col("h").desc())
    told = F.struct("id", "h", "n")
    inner = ranged.withColumn("next", F.lead(told).over(down)).withColumn("prev", F.lag(told).over(down))
    ends = ranged.groupBy("range").agg(F.max(told).alias("first"), F.min(told).alias("last"))
    across = Window.orderBy("range")  # as many rows as there are ranges
    ends = ends.withColumn("after", F.coalesce(F.lead("first").over(across), F.first("first").over(across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    ends = ends.withColumn("before", F.coalesce(F.lag("last").over(across), F.last("last").over(across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    joined = inner.join(ends.select("range", "after", "before"), "range")
    return joined.select("id", "h", "n", "copies", F.coalesce("next", "after").alias("next"), F.coalesce("prev", "before").alias("prev"))


def edited_texts(docs: DataFrame, work: Workspace) -> DataFrame:
    """Each document's text with its edited text, its copies and the document before it.

    A text is dealt by its own key once; to the document before it goes only
    the part that the edit takes over.
    """
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    narrow = keyed.select("id", "h", F.length("text").alias("n")).groupBy("id", "h", "n").agg(F.count("*").alias("copies"))
    order = work.stage(followers(narrow, work).select("id", "h", "copies", "prev"), "order")
    texts = keyed.dropDuplicates(["id", "h"]).join(order, ["id", "h"]).withColumn("n", F.length("text"))
    donors = texts.select(F.col("prev.id").alias("id"), F.col("prev.h").alias("h"), F.col("text").substr(F.lit(1), F.floor(F.col("prev.n") / 3).cast("int")).alias("donor"))
    cut = F.floor(F.col("n") / 3).cast("int")
    both = texts.join(donors, ["id", "h"]).withColumn("kept", F.col("text").substr(F.lit(1), F.col("n") - cut))
    return both.withColumn("edited", F.concat("kept", "donor"))


def weights(both: DataFrame) -> DataFrame:
    """(id, h, own_words, edited_words, term, own, edited): counts of the words, by hash, in a text and in its edited text; all of them in each.

    The words up to the last white space before the cut are counted once for both.
    """
    shared = F.regexp_extract("kept", f"(?s)^.*{SPACE}", 0)
    parts = both.withColumn("shared", shared).withColumn("from", F.length("shared") + 1)
    rest = lambda c: F.col(c).substr(F.col("from"), F.length(c))
    words = lambda part: F.array_remove(F.split(part, f"{SPACE}+"), "")
    split = parts.select("id", "h", words(F.col("shared")).alias("s"), words(rest("text")).alias("o"), words(rest("edited")).alias("e"))
    rows = split.select("id", "h", (F.size("s") + F.size("o")).alias("own_words"), (F.size("s") + F.size("e")).alias("edited_words"), F.explode(F.array(
        F.struct(F.lit(1).alias("own"), F.lit(1).alias("edited"), F.col("s").alias("words")),
        F.struct(F.lit(1).alias("own"), F.lit(0).alias("edited"), F.col("o").alias("words")),
        F.struct(F.lit(0).alias("own"), F.lit(1).alias("edited"), F.col("e").alias("words")),
    )).alias("p")).select("id", "h", "own_words", "edited_words", "p.*")
    told = rows.select("id", "h", "own_words", "edited_words", "own", "edited", F.explode("words").alias("word"))
    return told.groupBy("id", "h", "own_words", "edited_words", F.xxhash64("word").alias("term")).agg(F.sum("own").alias("own"), F.sum("edited").alias("edited"))


def sampled(both: DataFrame, coordinates: int, reach: float | None) -> DataFrame:
    """What the result shows of each text, its samples, and whether they are sure: there where there are words."""
    word = "[^\\x20\\x09-\\x0D]"
    shown = both.select("id", "h", "n", "copies", "prev", F.unhex(F.sha2("edited", 256)).alias("sha"), F.col("text").rlike(word).alias("any_own"), F.col("edited").rlike(word).alias("any_edited"))
    told = shown.join(samples(both, coordinates, reach), ["id", "h"], "left")
    sure = [F.col(c).isNotNull() | ~F.col(f"any_{c}") for c in ("own", "edited")]
    return told.withColumn("sure", sure[0] & sure[1]).drop("any_own", "any_edited")


def fingerprint(docs: DataFrame, coordinates: int = COORDINATES, reach: float = REACH) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness.

    The edited text has its last third (rounded down) replaced by the first as
    many characters of the next document in descending doc_id, or all that has.

    Edge cases: a null text is empty; an empty text has the empty fingerprint;
    a null doc_id comes last; rows with equal doc_id are ordered by a hash of
    their text; rows equal in both count as one document and come out as often
    as they went in; an only document is its own next; an empty table gives no rows. doc_id is a whole number; the least long stands for null, and is shown as null.
    """
    with Workspace(docs.sparkSession, "fingerprints") as work:
        both = edited_texts(docs, work)
        rows = work.keep(sampled(both, coordinates, reach), "samples")
        late = rows.where("not sure")
        if not late.isEmpty():  # these few are done anew with all offers
            again = both.join(late.select("id", "h"), ["id", "h"], "left_semi")
            rows = rows.where("sure").unionByName(work.keep(sampled(again, coordinates, None), "late-samples"))
    following = rows.select(F.col("prev.id").alias("id"), F.col("prev.h").alias("h"), F.col("own").alias("following"))
    joined = rows.drop("prev", "sure").join(following, ["id", "h"])
    return joined.select(
        F.when(F.col("id") != LEAST, F.col("id")).alias("doc_id"), F.col("n").cast("long").alias("n_chars"), F.lower(F.hex("sha")).alias("edited_sha256"), hexed(F.col("own")).alias("fingerprint"), hexed(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"), F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")
