"""MinHash near-duplicates by an inverted join on signature coordinates.

A document is the set of its word shingles, as 64-bit hashes. A coordinate of its signature is
two minima; with its value it is a token under which the document is
posted. Two documents of the wanted similarity share at least ``needed`` tokens,
but for a chance below ``MISS``; so each must share a token of the other's prefix:
its rarest tokens, all but ``needed - 1``. Only prefixes are merged. The frequent
tokens behind them are skipped, and counted by probing the two signatures, minimum by minimum.
Pairs with enough matches are confirmed on the whole sets.

Equal sets are one node from the start. A list of many postings isn't expanded
into all pairs: in each round a few of its documents, the heads, meet those of the list that aren't in their
component yet. They have then met all, and leave the list. The first heads are the most central documents; after
them only documents outside the list's largest component are heads, and a list whose documents are one component
is done. So every pair that shares a prefix token is tried or is already connected, and no component is lost.

After the first round each document has a base, a head that many met, and a bitmap of the shingles by which
it differs from it. Two documents of one base whose differences have too little in common are
too far apart, and the join drops the pair. So edited copies that resemble each other too little needn't be tried.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.llm.common import Workspace, small_batches

COORDINATES = 64
MISS = 1e-6
NO_ID = (1 << 63) - 1
SALTS = 32
#: Heads of a list in the first round, and in the second; after that, times as many as the round before.
FIRST_HEADS, MORE_HEADS = 2, 64
#: The bitmap of a node's difference from its base.
LONGS = 4
BITS = [f"b{j}" for j in range(LONGS)]
#: Bits of the filter of wanted ids, 8 MB; the more ids it holds, the more others pass it.
FILTER_BITS = 1 << 26
U = np.uint64


def needed_matches(similarity: float, coordinates: int, miss: float = MISS) -> int:
    """The most matches that a pair of this similarity reaches but for a chance of ``miss``."""
    below = 0.0
    for t in range(coordinates + 1):
        below += math.comb(coordinates, t) * similarity**t * (1 - similarity) ** (coordinates - t)
        if below > miss:
            return max(1, t)
    return coordinates


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Distinct hashes of the shingles, sorted. Fewer words than the width are one shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for j in range(width):
        out = out * U(0x9E3779B97F4A7C15) + hashes[j : j + n]
    return np.unique(mixed(out))


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """(sets, coordinates) uint32 minima; no set may be empty."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    seeds = mixed(np.arange(1, 2 * coordinates + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
    out = np.empty((len(sets), coordinates), np.uint32)
    for j in range(coordinates):
        hashed = ((flat ^ seeds[2 * j]) * (seeds[2 * j + 1] | U(1))) >> U(32)
        out[:, j] = np.minimum.reduceat(hashed, starts)
    return out


def id_filter(ids: DataFrame) -> bytes:
    """A bitmap of hashed ids and texts (id, h), packed in blocks by tasks. One of the table is always found."""
    spots = ids.select(F.pmod(F.xxhash64("id", "h"), F.lit(FILTER_BITS)).alias("spot")).distinct()
    block = spots.withColumn("block", F.shiftright("spot", 16)).groupBy("block").applyInArrow(packed, "block long, bits binary")
    out = bytearray(FILTER_BITS // 8)
    for r in block.collect():
        out[r.block << 13 : (r.block + 1) << 13] = r.bits
    return bytes(out)


def packed(rows: pa.Table) -> pa.Table:
    bits = np.zeros(1 << 16, np.uint8)
    bits[rows.column("spot").to_numpy() & 0xFFFF] = 1
    return pa.table({"block": pa.array([rows.column("block")[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


def shingle_sets(texts: DataFrame, width: int, wanted: bytes | None, schema: str, told: Callable[[pa.RecordBatch, list[np.ndarray]], pa.RecordBatch]) -> DataFrame:
    """Apply ``told`` to each batch of texts (id, h, text) and its shingle sets, of those that pass the filter if there is one."""
    small_batches(texts.sparkSession)
    shared = texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = None if shared.value is None else np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            if bitmap is not None:
                spot = batch.column("spot").to_numpy()
                batch = batch.filter(pa.array((bitmap[spot >> 3] >> (spot & 7)) & 1 == 1))
            if batch.num_rows:
                yield told(batch, [shingle_set(t, width) for t in batch.column("text").to_pylist()])

    return texts.select("id", "h", "text", F.pmod(F.xxhash64("id", "h"), F.lit(FILTER_BITS)).alias("spot")).mapInArrow(run, schema)


def sketches(texts: DataFrame, width: int, coordinates: int, wanted: bytes | None = None, with_set: bool = False) -> DataFrame:
    """id, h, n (size of the shingle set), key (digest of the set), sig and, if asked for, grams (the set's bytes).

    A document without words has n 0 and neither key nor signature.
    """

    def told(batch: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
        full = [i for i, s in enumerate(sets) if len(s)]
        sig: list = [None] * len(sets)
        if full:
            for i, row in zip(full, signatures([sets[i] for i in full], coordinates).view(np.int32), strict=True):
                sig[i] = row
        key = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        columns = [batch.column("id"), batch.column("h"), pa.array([len(s) for s in sets], pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.list_(pa.int32()))]
        names = ["id", "h", "n", "key", "sig"]
        if with_set:
            columns.append(pa.array([s.tobytes() for s in sets], pa.binary()))
            names.append("grams")
        return pa.RecordBatch.from_arrays(columns, names)

    return shingle_sets(texts, width, wanted, "id long, h long, n long, key binary, sig array<int>" + ", grams binary" * with_set, told)


def prefix_postings(nodes: DataFrame, needed: int) -> DataFrame:
    """(rid, n, token, often, central) of each node's prefix, among the tokens that other nodes hold too.

    With m such tokens, and the others rarer, the prefix has m - needed + 1 of
    them; a node with fewer than ``needed`` has no partner. central: how often
    the node's tokens are held in all; the original of many edited copies has the most. often: how often the token is.
    """
    coordinate = lambda i: F.xxhash64(i, F.get("sig", 2 * i), F.get("sig", 2 * i + 1))
    tokens = F.transform(F.sequence(F.lit(0), (F.size("sig") / 2).cast("int") - 1), coordinate)
    posted = nodes.select("rid", "n", F.explode(tokens).alias("token"))
    often = posted.groupBy("token").agg(F.count("*").alias("often")).where("often > 1")
    held = posted.join(often, "token").groupBy("rid", "n").agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("held"))
    central = F.aggregate("held", F.lit(0).cast("long"), lambda s, h: s + h["often"])
    prefix = F.explode(F.slice("held", F.lit(1), F.size("held") - (needed - 1)))
    return held.where(F.size("held") >= needed).select("rid", "n", central.alias("central"), prefix.alias("p")).select("rid", "n", F.col("p.token").alias("token"), F.col("p.often").alias("often"), "central")


class Sets:
    """Signatures and shingle sets of the posted nodes, in a table bucketed by node, so that joins don't move it.

    Its files lie in the shared folder with the other staged tables and go with them; the catalogue has its name and buckets only.
    """

    def __init__(self, features: DataFrame, percent: int, work: Workspace):
        spark = features.sparkSession
        self.percent = percent
        self.name = f"neardup_{uuid.uuid4().hex}"
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        features.repartition(buckets, "rid").write.format("parquet").bucketBy(buckets, "rid").option("path", f"{work.path}/{self.name}").saveAsTable(self.name)
        self.table = spark.table(self.name)

    def drop(self) -> None:
        self.table.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}")

    def both(self, pairs: DataFrame, columns: list[str]) -> DataFrame:
        """The columns of x and p beside each pair. A p with many partners is salted."""
        side = lambda name: self.table.select(F.col("rid").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])
        salted = pairs.withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(SALTS)))
        right = salted.select("p", "salt").distinct().join(side("p"), "p")
        return salted.join(side("x"), "x").join(right, ["p", "salt"]).drop("salt")

    def matched(self, pairs: DataFrame, least: int) -> DataFrame:
        """The pairs with at least so many matching coordinates, and how many these are."""
        matches = F.aggregate(F.zip_with("x_sig", "p_sig", lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, v: s + v)
        return self.both(pairs, ["sig"]).select(*pairs.columns, matches.alias("matches")).where(F.col("matches") >= least)

    def linked(self, close: DataFrame) -> DataFrame:
        """The pairs whose sets are similar enough."""
        percent, names = self.percent, close.columns

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for a, b in zip(batch.column("x_grams").to_pylist(), batch.column("p_grams").to_pylist(), strict=True):
                    a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    keep.append(100 * both >= percent * (len(a) + len(b) - both))
                yield batch.filter(pa.array(keep, pa.bool_())).select(names)

        small_batches(close.sparkSession)
        return self.both(close, ["grams"]).mapInArrow(check, close.schema)

    def differences(self, based: DataFrame) -> DataFrame:
        """(rid, base, apart, slack, b0 to b3) of pairs (x, p): by how many shingles node and base differ, and a bitmap of these.

        slack: shingles less set bits.
        """

        def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bits, apart = np.zeros((batch.num_rows, 64 * LONGS), np.uint8), np.zeros(batch.num_rows, np.int64)
                for i, (a, b) in enumerate(zip(batch.column("x_grams").to_pylist(), batch.column("p_grams").to_pylist(), strict=True)):
                    either = np.setxor1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True)
                    bits[i, either % U(64 * LONGS)] = 1
                    apart[i] = len(either)
                longs = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
                columns = [batch.column("x"), batch.column("p"), pa.array(apart), pa.array(apart - bits.sum(1, dtype=np.int64)), *[pa.array(longs[:, j]) for j in range(LONGS)]]
                yield pa.RecordBatch.from_arrays(columns, ["rid", "base", "apart", "slack", *BITS])

        small_batches(based.sparkSession)
        return self.both(based, ["grams"]).mapInArrow(told, "rid long, base long, apart long, slack long, " + ", ".join(f"{b} long" for b in BITS))


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """(node, root) of an edge list (a, b): the least node that each node reaches.

    Every node takes the least label of its neighbours, then the label of its
    label, until nothing changes.
    """
    both = work.stage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "cc-edges")
    labels = work.stage(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "cc-labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(seen, labels["node"] == seen["a"]).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        lower = work.stage(lower, "cc-lower")
        jump = lower.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = work.stage(lower.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("far", "root")).alias("root")), "cc-labels")
        labels = new.select("node", "root")
        if new.where("old != root").limit(1).count() == 0:
            return labels


def relabel(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Replace ``label`` by its root where it has one."""
    found = roots.select(F.col("node").alias("label"), "root")
    return rows.join(found, "label", "left").withColumn("label", F.coalesce("root", "label")).select(*rows.columns)


def reachable(percent: int) -> Column:
    """Can x and p of a pair be similar enough? By the sizes of their sets, and by their differences from one base.

    Sets that differ from the base by X and P differ from each other by all of X and P but what is in both, twice; what
    is in both sets a bit in both bitmaps, but for the slack of the one that has less.
    """
    total = F.col("x_n") + F.col("p_n")
    sizes = 100 * F.least("x_n", "p_n") >= percent * F.greatest("x_n", "p_n")
    common = reduce(Column.__add__, [F.bit_count(F.col(f"x_{b}").bitwiseAND(F.col(f"p_{b}"))) for b in BITS]) + F.least("x_slack", "p_slack")
    apart = F.col("x_apart") + F.col("p_apart") - 2 * common
    return sizes & F.when(F.col("x_base") == F.col("p_base"), (100 + percent) * apart <= (100 - percent) * total).otherwise(True)


def meeting(state: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, p, x_label, p_label) of a list's postings and its heads, of different components, that can reach the threshold."""
    held = ("label", "n", "base", "apart", "slack", *BITS)
    side = lambda df, name: df.select("token", F.col("rid").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in held])
    pairs = side(state, "x").join(side(heads, "p"), "token").where("x != p AND x_label != p_label").where(reachable(percent))
    # two heads meet twice
    turned = F.col("x") < F.col("p")
    one = lambda a, b: F.when(turned, F.col(b)).otherwise(F.col(a)).alias(a)
    return pairs.select(one("x", "p"), one("p", "x"), one("x_label", "p_label"), one("p_label", "x_label")).distinct()


def with_bases(state: DataFrame, met: DataFrame, sets: Sets, work: Workspace) -> DataFrame:
    """Give each node a base, of the heads that it met with many matches the one that most nodes met so, and its difference from it."""
    ends = met.select(F.col("x").alias("rid"), F.col("p").alias("base")).union(met.select(F.col("p").alias("rid"), F.col("x").alias("base")))
    often = ends.groupBy("base").agg(F.count("*").alias("often"))
    best = ends.join(often, "base").groupBy("rid").agg(F.max(F.struct("often", "base")).alias("best"))
    based = best.join(state.select("rid").distinct(), "rid", "left_semi").select(F.col("rid").alias("x"), F.col("best.base").alias("p"))
    told = sets.differences(work.stage(based, "bases"))
    return state.drop("base", "apart", "slack", *BITS).join(told, "rid", "left")


def open_lists(state: DataFrame) -> DataFrame:
    """The lists with nodes of several components. minor: the node isn't of the one that has most of the list's; minors: how many aren't."""
    sizes = state.groupBy("token", "label").agg(F.count("*").alias("c"))
    major = sizes.groupBy("token").agg(F.max(F.struct("c", "label")).alias("most"), F.sum("c").alias("all"), F.count("*").alias("labels")).where("labels > 1")
    major = major.select("token", F.col("most.label").alias("major"), (F.col("all") - F.col("most.c")).alias("minors"))
    return state.drop("minor", "minors").join(major, "token").withColumn("minor", F.col("label") != F.col("major")).drop("major")


def node_labels(posted: DataFrame, sets: Sets, needed: int, work: Workspace) -> DataFrame:
    """(rid, label): the component of each node in the postings (rid, n, token, often, central)."""
    none = [F.lit(None).cast("long").alias(c) for c in ("base", "apart", "slack", *BITS)]
    state = work.stage(posted.select("rid", "n", "token", "central", F.col("rid").alias("label"), *none, F.lit(True).alias("minor"), F.col("often").alias("minors")), "state")
    labels = state.select("rid", "label").distinct()
    order = Window.partitionBy("token").orderBy(F.desc("central"), "rid")
    heads_each, first = FIRST_HEADS, True
    while not state.isEmpty():
        heads = state.where("minor").withColumn("at", F.row_number().over(order)).where(F.col("at") <= heads_each).drop("at")
        heads = work.stage(heads, "heads")
        pairs = work.stage(meeting(state, heads, sets.percent), "pairs")
        met = work.stage(sets.matched(pairs, needed // 2 if first else needed), "met")
        links = work.stage(sets.linked(met.where(F.col("matches") >= needed)), "links")
        # a list that had no more heads to come is done
        more = F.col("minors") > heads_each
        state = state.where(more).join(heads.where(more).select("token", "rid"), ["token", "rid"], "left_anti")
        if not links.isEmpty():
            roots = components(links.select(F.col("x_label").alias("a"), F.col("p_label").alias("b")), work)
            labels = work.stage(relabel(labels, roots), "labels")
            state = relabel(state, roots)
        state = work.stage(open_lists(state), "state")
        if first and not state.isEmpty():
            state = work.stage(with_bases(state, met, sets, work), "state")
        heads_each, first = (MORE_HEADS if first else heads_each * MORE_HEADS), False
    return labels


def text_components(docs: DataFrame, *, width: int = 5, percent: int = 80, coordinates: int = COORDINATES) -> DataFrame:
    """One row of each id and text, with its copies: id (NO_ID if null), h (the text's hash), n, copies, first, component.

    A node is a class of texts with equal shingle sets, named by the hash of one of them, so that an id with several
    texts is several nodes. Links join classes; first: the text is the least, by id and hash, of those that links
    reach. component: the least id that links reach if classes that share an id are linked too. A text without
    words is in no class; its component is its id's, if that has other texts.
    """
    with Workspace(docs.sparkSession, "neardup") as work:
        return work.keep(component_rows(docs, width, percent, coordinates, work), "rows")


def component_rows(docs: DataFrame, width: int, percent: int, coordinates: int, work: Workspace) -> DataFrame:
    """The rows of ``text_components``, not yet kept."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), text.alias("text")).withColumn("h", F.xxhash64("text"))
    known = work.stage(sketches(texts, width, coordinates), "sketches")
    each = known.groupBy("id", "h", "n", "key").agg(F.count("*").alias("copies"))
    # equal keys are equal sets, so any of a class has its size and signature
    classes = known.where("n > 0").groupBy("key").agg(F.min(F.struct("id", "h")).alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = work.stage(classes.select("key", F.col("rep.id").alias("id"), F.col("rep.h").alias("rid"), "n", "sig"), "classes")
    posted = work.stage(prefix_postings(classes, needed_matches((percent / 100) ** 2, coordinates // 2)), "postings")
    wanted = work.stage(classes.select("id", F.col("rid").alias("h")).join(posted.select(F.col("rid").alias("h")).distinct(), "h", "left_semi"), "wanted")
    features = sketches(texts, width, coordinates, id_filter(wanted), with_set=True).join(wanted, ["id", "h"], "left_semi")
    if not each.where("copies > 1 AND n > 0").isEmpty():
        features = features.dropDuplicates(["id", "h"])
    sets = Sets(features.withColumnRenamed("h", "rid").drop("id", "key"), percent, work)
    try:
        labels = node_labels(posted, sets, needed_matches(percent / 100, coordinates), work)
    finally:
        sets.drop()
    parts = classes.select("key", "id", "rid").join(labels, "rid", "left").withColumn("label", F.coalesce("label", "rid"))
    heads = parts.groupBy("label").agg(F.min(F.struct("id", "rid")).alias("head"))
    parts = work.stage(parts.join(heads, "label").withColumn("part", F.col("label")), "parts")
    several = known.where(F.col("key").isNotNull() & (F.col("id") != NO_ID)).groupBy("id").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    several = work.stage(several.where("low != high").select("id"), "several")
    if not several.isEmpty():
        held = each.join(several, "id", "left_semi").select("id", "key").join(parts.select("key", "label"), "key").select("id", "label").distinct()
        edges = held.join(held.groupBy("id").agg(F.min("label").alias("a")), "id").where("a != label").select("a", F.col("label").alias("b"))
        parts = relabel(parts, components(work.stage(edges, "shared-ids"), work))
    least = parts.groupBy("label").agg(F.min("head.id").alias("component"))
    parts = parts.join(least, "label").select("key", "head", "component")
    rows = each.join(parts, "key", "left")
    empty = rows.where("n = 0 AND id != " + str(NO_ID)).select("id").distinct()
    beside = rows.where("n > 0").join(empty, "id", "left_semi").groupBy("id").agg(F.min("component").alias("beside"))
    rows = rows.join(beside, "id", "left").withColumn("component", F.coalesce("component", "beside", "id"))
    first = F.col("head").isNull() | ((F.col("head.id") == F.col("id")) & (F.col("head.rid") == F.col("h")))
    return rows.select("id", "h", "n", "copies", first.alias("first"), "component")


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, coordinates: int = COORDINATES) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Documents are linked if the intersection of their shingle sets is at least
    ``percent`` per cent of the union; component_id is the least doc_id that
    links reach, and that document is kept.

    doc_id is a number, or text that is one. Edge cases: a document without words (null, empty or white space) is linked
    with nothing and kept; rows with one doc_id are one document, linked by any of
    their texts; each row with a null doc_id is a document of its own, last in order, and of a
    component of such rows alone, whose id is null, one is kept; an
    empty table gives no rows; other columns are ignored.
    """
    rows = text_components(docs, width=width, percent=percent, coordinates=coordinates)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    nameless = (F.col("component") == NO_ID) & ((F.col("n") == 0) | (F.col("first") & (F.col("copy") == 1)))
    kept = F.when(F.col("id") == NO_ID, nameless).otherwise(F.col("id") == F.col("component"))
    shown = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return rows.select(shown("id").alias("doc_id"), F.col("n").alias("n_shingles"), shown("component").alias("component_id"), kept.alias("kept"))


def drop_copies(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of documents, of each group of linked texts one: the least by doc_id, null ids last. Rows without words stay."""
    rows = text_components(docs, width=width, percent=percent).where("n > 0 AND (copies > 1 OR NOT first)")
    marks = rows.select(F.col("id").alias("marked_id"), F.col("h").alias("marked_h"), "first")
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("h"))
    same = (F.col("id") == F.col("marked_id")) & (F.col("h") == F.col("marked_h"))
    left = keyed.join(marks, same, "left_anti").select("row.*")
    repeated = marks.where("first")
    if repeated.isEmpty():
        return left
    return left.union(keyed.join(repeated, same, "left_semi").dropDuplicates(["id", "h"]).select("row.*"))
