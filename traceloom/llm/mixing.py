"""Mixing sources to target weights by Sainte-Laguë apportionment.

Every source gets a target number of tokens. The targets are filled with blocks
of equally many tokens: block after block goes to the source with the highest
quotient ``votes / (2 * seats + 1)``, which gives an integer quota per source
and, in the same way, per shard of a source. Each shard then takes its quota from
its documents in a seeded order.

A source is cut into shards by a hash of the document, about ``SHARD_TOKENS``
tokens each, so a source that holds a third of all rows is spread over many
tasks. Sources and shards are tables of any length: no list of them reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.llm.common import WORD, Workspace
from traceloom.operators.ordering import numbered

SHARD_TOKENS = 1_000_000
BLOCK_TOKENS = 64
#: A source's rounding error is at most half a block, so no target should hold fewer blocks than this.
BLOCKS_PER_TARGET = 200
CYCLE = (5.0, 2.0, 1.0)
#: A source's target is at most so many times its size.
MOST = 2
#: Divisors that one pass tries, and passes: together they narrow the range of divisors 64^6 times. Seats in what is left of it go by quotient.
WAYS, PASSES = 64, 6
#: Seats between two divisors that are few enough to go by quotient.
BY_QUOTIENT = 10_000


def word_count(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_level(sources: DataFrame, share: float) -> float:
    """The tokens a unit of weight gets, where no source may have more than MOST times its size. sources: size, weight.

    A source is full if the level is above ``MOST * size / weight``. Each step shares what full sources
    leave among the others, which raises the level, until no further source is full.
    """
    level, full = -1.0, F.col("weight") * 0
    while True:
        full = F.col("weight") * level > MOST * F.col("source_size")
        left = share * F.sum("source_size") - F.sum(F.when(full, MOST * F.col("source_size")).otherwise(0))
        row = sources.agg(left.alias("left"), F.sum(F.when(~full, F.col("weight"))).alias("weights")).first()
        if not row.weights or row.left / row.weights <= level:
            return max(level, 0.0)
        level = row.left / row.weights


def apportion(parties: DataFrame, seats: DataFrame, work: Workspace) -> DataFrame:
    """Seats by highest quotients v/1, v/3, v/5, ..., at most ``cap`` each, ties to the lower party; in every group on its own.

    parties: grp, party, votes, cap. seats: grp, seats. Returns grp, party, quota: the same as awarding seat after seat.
    A divisor awards every quotient above it. Passes narrow down two of them, one that awards at most all seats and one
    that awards more; the seats between go by quotient. A group without room for all seats gives every party its cap.
    """
    live = work.stage(parties.where("votes > 0 AND cap > 0"), "parties")
    room = live.groupBy("grp").agg(F.min(F.col("votes") / (2 * F.col("cap") + 1)).alias("low"), F.max(2.0 * F.col("votes")).alias("high"), F.sum("cap").alias("room"))
    bounds = work.stage(room.join(seats, "grp").withColumn("above", F.col("room")).withColumn("upto", F.lit(0).cast("long")), "bounds")
    awarded = lambda d: F.least(F.col("cap"), F.greatest(F.lit(0).cast("long"), F.ceil((F.col("votes") / d - 1) / 2)))
    divisor = lambda k: F.col("low") * F.pow(F.col("high") / F.col("low"), k / float(WAYS))
    between = F.max(F.when(F.col("room") > F.col("seats"), F.col("above") - F.col("upto")))
    for _ in range(PASSES):
        if (bounds.agg(between.alias("m")).first()["m"] or 0) <= BY_QUOTIENT:
            break
        tried = live.join(bounds, "grp").groupBy(*bounds.columns).agg(*[F.sum(awarded(divisor(F.lit(k)))).alias(f"a{k}") for k in range(1, WAYS)])
        first = F.coalesce(*[F.when(F.col(f"a{k}") <= F.col("seats"), F.lit(k)) for k in range(1, WAYS)], F.lit(WAYS))
        tried = tried.select(*bounds.columns, first.alias("k"), F.array(*[F.col(f"a{k}") for k in range(1, WAYS)]).alias("sums"))
        high, low = F.when(F.col("k") == WAYS, F.col("high")).otherwise(divisor(F.col("k"))), F.when(F.col("k") == 1, F.col("low")).otherwise(divisor(F.col("k") - 1))
        above, upto = F.coalesce(F.get("sums", F.col("k") - 2), F.col("above")), F.coalesce(F.get("sums", F.col("k") - 1), F.col("upto"))
        bounds = work.stage(tried.select("grp", low.alias("low"), high.alias("high"), "room", "seats", above.alias("above"), upto.alias("upto")), "bounds")
    held = live.join(bounds, "grp").withColumn("got", awarded(F.col("high"))).withColumn("most", awarded(F.col("low")))
    left = held.groupBy("grp").agg((F.first("seats") - F.sum("got")).alias("left"))
    each = held.where("most > got").select("grp", "party", "votes", F.explode(F.sequence("got", F.col("most") - 1)).alias("s"))
    order = Window.partitionBy("grp").orderBy(F.desc(F.col("votes") / (2 * F.col("s") + 1)), "party", "s")
    extra = each.withColumn("place", F.row_number().over(order)).join(left, "grp").where("place <= left").groupBy("grp", "party").agg(F.count("*").alias("extra"))
    quota = F.when(F.col("room") <= F.col("seats"), F.col("cap")).otherwise(F.col("got") + F.coalesce("extra", F.lit(0)))
    given = held.join(extra, ["grp", "party"], "left").select("grp", "party", quota.alias("quota"))
    return parties.select("grp", "party").join(given, ["grp", "party"], "left").select("grp", "party", F.coalesce("quota", F.lit(0)).cast("long").alias("quota"))


def recipe(sized: DataFrame, share: float, cycle: Sequence[float], work: Workspace) -> DataFrame:
    """source, source_no, source_size, target, shards, block and quota of each source, in order of code points, null last."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # the order of UTF-8 bytes is that of the code points
    totals = numbered(totals, [F.col("source").isNull(), F.col("source")], work, "source_no")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.col("source_no") % len(cycle) + 1).cast("int"))
    totals = work.stage(totals.withColumn("weight", weight), "sources")
    level = water_level(totals, share)
    targets = totals.withColumn("target", F.least(F.col("weight") * level, (MOST * F.col("source_size")).cast("double")))
    told = targets.agg(F.min(F.when(F.col("target") > 0, F.col("target"))).alias("least"), F.sum("source_size").alias("all")).first()
    block = max(1, min(BLOCK_TOKENS, int((told["least"] or 0) // BLOCKS_PER_TARGET)))
    parties = targets.select(F.lit(0).alias("grp"), F.col("source_no").alias("party"), F.col("target").alias("votes"), (MOST * F.ceil(F.col("source_size") / block)).alias("cap"))
    seats = sized.sparkSession.range(1).select(F.lit(0).alias("grp"), F.lit(round(share * (told["all"] or 0) / block)).cast("long").alias("seats"))
    quotas = apportion(parties, seats, work).select(F.col("party").alias("source_no"), "quota")
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_TOKENS))
    rows = targets.join(quotas, "source_no").select(F.col("source").alias("of_source"), "source_no", "source_size", "target", shards.alias("shards"), F.lit(block).cast("long").alias("block"), "quota")
    return work.stage(rows, "recipe")


def mix(docs: DataFrame, *, seed: int = 7, share: float = 1.5, cycle: Sequence[float] = CYCLE) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document.

    A shard of ``n`` tokens has ``blocks`` blocks of equal length; with ``seats``
    seats it takes each token ``seats // blocks`` times, and the tokens of
    ``seats % blocks`` blocks once more: those from a seeded place on, around the
    end, with the documents in the order of a seeded hash.

    Edge cases: a null or empty text has size 0 and takes 0; a null source is a
    source of its own, last in order; equal rows are mixed as separate documents; null ids are
    told apart by their texts; an empty table gives no rows; other columns are ignored.
    """
    with Workspace(docs.sparkSession, "mixing") as work:
        # null ids are spread by their texts
        spread = lambda n: F.xxhash64(F.lit(seed + n), F.coalesce(F.col("doc_id").cast("string"), F.col("text")))
        sized = work.stage(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), spread(0).alias("rank"), spread(1).alias("deal")), "sized")
        recipes = recipe(sized, share, cycle, work)
        held = sized.join(recipes, sized["source"].eqNullSafe(recipes["of_source"])).drop("source", "of_source")
        # rows without words take none and fill no shard, however many a source has
        wordless = held.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
        ranked = held.where("size > 0")
        ranked = ranked.withColumn("shard", F.pmod(F.col("deal"), F.col("shards"))).drop("deal")
        shards = work.stage(ranked.groupBy("source_no", "shard").agg(F.sum("size").alias("shard_size"), F.first("block").alias("block"), F.first("quota").alias("quota")), "shards")
        blocks = F.when(F.col("shard_size") > 0, F.greatest(F.lit(1).cast("long"), F.expr("(shard_size + block DIV 2) DIV block"))).otherwise(F.lit(0).cast("long"))
        shards = shards.withColumn("blocks", blocks)
        parties = shards.select(F.col("source_no").alias("grp"), F.col("shard").alias("party"), F.col("shard_size").cast("double").alias("votes"), (MOST * F.col("blocks")).alias("cap"))
        quotas = apportion(parties, recipes.select(F.col("source_no").alias("grp"), F.col("quota").alias("seats")), work)
        quotas = shards.join(quotas.select(F.col("grp").alias("source_no"), F.col("party").alias("shard"), F.col("quota").alias("seats")), ["source_no", "shard"]).select("source_no", "shard", "shard_size", "blocks", "seats")
        before = Window.partitionBy("source_no", "shard").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
        start = F.coalesce(F.sum("size").over(before), F.lit(0))
        placed = ranked.withColumn("start", start).join(work.stage(quotas, "quotas"), ["source_no", "shard"])
        # the once-more run: from token `first`, `more` tokens long, wrapping around at the shard's end
        extra = F.expr("CASE WHEN blocks = 0 THEN 0L ELSE seats % blocks END")
        first_block = F.pmod(F.xxhash64(F.lit(seed + 2), "source_no", "shard"), F.greatest("blocks", F.lit(1)))
        edge = lambda k: F.expr(f"({k}) * shard_size DIV greatest(blocks, 1L)")
        overlap = lambda a, b: F.greatest(F.lit(0), F.least(F.col("start") + F.col("size"), b) - F.greatest(F.col("start"), a))
        placed = placed.withColumn("extra", extra).withColumn("b0", first_block)
        placed = placed.withColumn("e0", edge("b0")).withColumn("e1", edge("least(b0 + extra, blocks)")).withColumn("e2", edge("greatest(b0 + extra - blocks, 0L)"))
        whole = F.expr("CASE WHEN blocks = 0 THEN 0L ELSE seats DIV blocks END")
        taken = whole * F.col("size") + overlap(F.col("e0"), F.col("e1")) + overlap(F.lit(0), F.col("e2"))
        return work.keep(placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken")).unionByName(wordless), "rows")
