"""Secret scans by a trigram inverted index, in DataFrame operations only.

From each rule's regex follows a Boolean query over trigrams (see ``trigrams``): every match of
``token`` holds ``tok``, ``oke`` and ``ken``. Documents are posted under the
trigrams that the queries name, the postings of a document are intersected and
united as its query asks, and the regex runs on the documents that are left.
A rule without mandatory trigrams runs on every document.

The queries match in lower case and on a superset: a posting that is no
match costs time, and never a result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.llm.trigrams import trigram_query


@dataclass(frozen=True)
class Rule:
    """A secret's pattern in the common syntax of Java, RE2 and Python.

    least: the fewest characters of ``group`` in a match that counts. A match too short is dropped, and its text stays consumed.
    java: a pattern in Java's syntax for the same matches, where the common one takes time that grows with the square of a text. Its matches may begin earlier: they count from
    the first ``lead`` on.
    """

    kind: str
    pattern: str
    group: int
    least: int
    base: bool = True
    java: str | None = None
    lead: str = ""

    @property
    def found_by(self) -> str:
        return self.java or self.pattern


#: A web token's characters. A token begins at the first eyJ of a stretch of these or nowhere in it, so a stretch is gone through once, from where it begins.
B64 = "[A-Za-z0-9_-]"


RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, base=False),
    Rule("repo_token", r"gh[pousr]_[A-Za-z0-9]+", 0, 40, base=False),
    Rule("web_token", rf"eyJ{B64}+\.eyJ{B64}+\.{B64}+", 0, 40, base=False, java=rf"(?<!{B64})(?>{B64}*?eyJ){B64}++\.eyJ{B64}++\.{B64}++", lead="eyJ"),
)
#: Bits of one mask of trigrams; more trigrams take more masks.
MASK_BITS = 63
#: Spans that are summed up one by one before blocks of them are.
RUN = 64
SPANS = "array<struct<start:int,end:int>>"


@lru_cache
def alphabet(rules: tuple[Rule, ...]) -> list[str]:
    """All trigrams that some query names."""
    return sorted({t for r in rules for alternative in trigram_query(r.pattern) for t in alternative})


def row_key(docs: DataFrame) -> Column:
    """Names a row by its id and text; rows that are equal in both share a key, and postings."""
    return F.xxhash64("doc_id", "text")


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(row_key, trigram) for each trigram of the queries that a document's lower-cased text holds, by its number in the alphabet."""
    low = F.lower("text")
    held = F.filter(F.array(*[F.when(F.contains(F.col("low"), F.lit(t)), F.lit(i)) for i, t in enumerate(alphabet(rules))]), lambda x: x.isNotNull())
    return docs.select(row_key(docs).alias("row_key"), low.alias("low")).select("row_key", F.explode(held).alias("trigram"))


def candidates(posted: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Intersect the postings: row_key and the kinds whose trigram query the document meets."""
    place = {t: divmod(i, MASK_BITS) for i, t in enumerate(alphabet(rules))}
    masks = range(-(-len(place) // MASK_BITS))
    bit = F.expr(f"shiftleft(1L, trigram % {MASK_BITS})")
    held = posted.groupBy("row_key").agg(*[F.bit_or(F.when(F.expr(f"trigram DIV {MASK_BITS}") == m, bit).otherwise(F.lit(0).cast("long"))).alias(f"held{m}") for m in masks])

    def met(alternative: list[str]) -> Column:
        wants = {m: sum(1 << b for n, b in map(place.get, alternative) if n == m) for m in masks}
        return reduce(Column.__and__, [F.col(f"held{m}").bitwiseAND(F.lit(w).cast("long")) == F.lit(w).cast("long") for m, w in wants.items() if w])

    meets = [F.when(reduce(Column.__or__, map(met, query)), F.lit(rule.kind)) for rule in rules if (query := trigram_query(rule.pattern))]
    kinds = F.filter(F.array(*meets), lambda x: x.isNotNull()) if meets else F.array().cast("array<string>")
    return held.select("row_key", kinds.alias("kinds")).where(F.size("kinds") > 0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with a value that is computed once: what stands in a lambda is computed at each of its uses."""
    return F.transform(F.array(value), body)[0]


def in_blocks(items: Column) -> Column:
    """Items in blocks of RUN. An accumulator is copied at each step, so prefixes are summed up in blocks and then over blocks: n items take n * RUN steps and n * n / RUN^2 copies, not n * n."""
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(items) / RUN).cast("int") - 1), lambda b: F.slice(items, b * RUN + 1, RUN))


def prefixes(totals: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each total, what the ones before it merge to, from 0."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("told"))
    return F.aggregate(totals, start, lambda acc, t: F.struct(merge(acc["at"], t).alias("at"), F.concat(acc["told"], F.array(acc["at"])).alias("told")), lambda acc: acc["told"])


def find_spans(text: Column, rule: Rule) -> Column:
    """Spans (start, end in code points) of a rule's matches, leftmost and non-overlapping, without those too short.

    Splitting at the matches gives the pieces between them; lengths of pieces
    and matches, summed up, give the places.
    """
    pieces, matches = F.split(text, rule.found_by, -1), F.regexp_extract_all(text, F.lit(rule.found_by), F.lit(0))
    value = matches if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.found_by), F.lit(rule.group))
    # characters of a match before it counts
    early = (lambda m: F.instr(m, rule.lead) - 1) if rule.lead else (lambda m: F.lit(0))
    # one step a match: its gap before, its own length, and the length that counts
    steps = F.zip_with(F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda a, b: F.struct((F.length(a) + early(b)).alias("gap"), (F.length(b) - early(b)).alias("n"))), value, lambda s, v: F.struct(s["gap"].alias("gap"), s["n"].alias("n"), (s["n"] if rule.group == 0 else F.length(v)).alias("counts")))
    taken = lambda block: F.aggregate(block, F.lit(0), lambda at, s: at + s["gap"] + s["n"])

    def spans(block: Column, before: Column) -> Column:
        end = lambda i: before + taken(F.slice(block, 1, i + 1))
        return F.transform(block, lambda s, i: let(end(i), lambda e: F.struct((e - s["n"]).alias("start"), e.alias("end"), s["counts"].alias("counts"))))

    whole = let(steps, lambda all_: F.when(F.size(all_) > 0, let(in_blocks(all_), lambda blocks: F.flatten(F.zip_with(blocks, prefixes(F.transform(blocks, taken), lambda x, y: x + y), spans)))))
    counted = F.filter(F.coalesce(whole, F.array().cast("array<struct<start:int,end:int,counts:int>>")), lambda s: s["counts"] >= rule.least)
    return F.transform(counted, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def masked(text: Column, spans: Column, mark: str) -> Column:
    """The text with a mark for each span; spans (sorted) that overlap become one. A block's stretch of the text is cut out once, and its pieces from that."""
    last = lambda block: F.array_max(F.transform(block, lambda s: s["end"]))

    def pieces(block: Column, before: Column) -> Column:
        stretch = text.substr(before + 1, F.greatest(F.lit(0), F.array_max(F.transform(block, lambda s: s["start"])) - before))
        at = lambda i: F.when(i == 0, before).otherwise(F.greatest(before, last(F.slice(block, 1, i))))
        one = lambda held: F.transform(block, lambda s, i: let(at(i), lambda a: F.when(s["start"] >= a, F.concat(held.substr(a - before + 1, s["start"] - a), F.lit(mark))).otherwise("")))
        return F.array_join(let(stretch, one), "")

    told = let(in_blocks(spans), lambda blocks: F.array_join(F.zip_with(blocks, prefixes(F.transform(blocks, last), F.greatest), pieces), ""))
    return F.when(F.size(spans) > 0, F.concat(told, text.substr(last(spans) + 1, F.length(text)))).otherwise(text)


def prefilter(rule: Rule) -> str:
    """A pattern that every counted match meets, to leave alone the texts without one."""
    return f"[0-9a-f]{{{rule.least}}}" if rule.kind == "hex" else rule.found_by


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with one more column a rule, ``spans_<kind>``: an array of (start, end).

    Edge cases: a null text is empty and has no spans; repeated rows are scanned
    each; spans of different kinds may overlap; very long texts are scanned whole; columns named like
    new ones are replaced; an empty table gives no rows.
    """
    found = candidates(postings(docs, rules), rules).withColumnRenamed("row_key", "found_key").withColumnRenamed("kinds", "found_kinds")
    kept = docs.withColumn("scan_key", row_key(docs))
    joined = kept.join(found, F.col("scan_key") == F.col("found_key"), "left")
    none = F.array().cast(SPANS)
    text = F.coalesce(F.col("text"), F.lit(""))
    for rule in rules:
        due = F.array_contains("found_kinds", rule.kind) & text.rlike(rule.found_by) if trigram_query(rule.pattern) else text.rlike(prefilter(rule))
        joined = joined.withColumn(f"spans_{rule.kind}", F.when(due, find_spans(text, rule)).otherwise(none))
    return joined.drop("scan_key", "found_key", "found_kinds")


def merged(kinds: list[str]) -> Column:
    """kind:start:end of all spans by start, then by the kinds' order, comma-joined."""


    def told(n: int, kind: str) -> Column:
        return F.transform(f"spans_{kind}", lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("n"), F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")).alias("told")))

    parts = [told(n, kind) for n, kind in enumerate(kinds)]
    return F.array_join(F.transform(F.array_sort(F.concat(*parts)), lambda s: s["told"]), ",")


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of each base kind, the digest of the base spans, and all spans, per document."""
    base = [r.kind for r in rules if r.base]
    counts = [F.size(f"spans_{k}").cast("long").alias(f"n_{k}") for k in base]
    return scan(docs.select("doc_id", "text"), rules).select("doc_id", *counts, F.sha2(merged(base), 256).alias("base_sha256"), merged([r.kind for r in rules]).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """The documents with every found span replaced by a mark; spans that overlap become one. n_chars follows the text."""
    columns = docs.columns
    scanned = scan(docs.select("doc_id", "text", F.struct("*").alias("row")), rules)
    spans = F.array_sort(F.concat(*[F.col(f"spans_{r.kind}") for r in rules]))
    told = scanned.withColumn("all_spans", spans).select("row", "all_spans", masked(F.col("text"), F.col("all_spans"), mark).alias("text"))
    new = {"text": F.col("text"), "n_chars": F.when(F.size("all_spans") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in columns else None}
    return told.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in columns])
