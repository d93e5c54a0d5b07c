"""From documents to token ids: language, near-duplicates, secrets, mixture, pieces.

Every stage is a function of (spark, docs, sf_dir). All but the last return the
columns of documents; each works on all rows that the one before it kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.llm import langid, mixing, neardup, pieces, secrets
from traceloom.llm.common import stage, table

#: A document goes if no language reaches this many times the pooled probability of a guess among the languages learned.
LEAST_GAIN = 1.2


def least_score(languages: int) -> float:
    """The least score that is told from a guess; a lone language has score 1, but for rounding."""
    return min(LEAST_GAIN / max(1, languages), 1 - 1e-6)


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter, or of no language that the network makes out, go.

    Edge cases: null and empty texts go; without any labelled text all go, as none can be made out; repeated rows stay
    or go together; texts of any length are read to the end; columns named like the prediction's are kept as they are.
    """
    network = langid.fit(docs)
    told = langid.predict(docs.select(F.col("text").cast("string").alias("text"), F.struct("*").alias("row")), network)
    return told.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= least_score(len(network.languages)))).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup on five-word shingles: of each group the row of the least id stays.

    Edge cases: repeated rows are one group; null ids come last, and of a group of them one row stays; rows without words stay all; an id
    with several texts is several documents.
    """
    return neardup.drop_copies(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scan: each secret is replaced by a mark; the documents stay.

    Edge cases: null and empty texts stay as they are; repeated rows are redacted each; n_chars follows the text.
    """
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixture: a document comes out as often, rounded, as the mix takes its words: not at all, once or twice.

    A shard's run of taken words begins and ends within a document, so a source is off its target by at most about one document a shard.
    Edge cases: documents without words go; a null source is one of its own; rows that share an id, or have none, come out as often as they do on average.
    """
    mixed = mixing.mix(docs).groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    chosen = mixed.select(F.col("doc_id").alias("mixed_id"), times.alias("times")).where("times > 0")
    joined = docs.select("doc_id", F.struct("*").alias("row")).join(chosen, F.col("doc_id").eqNullSafe(F.col("mixed_id")))
    return joined.select("row", F.explode(F.array_repeat(F.lit(1), F.col("times"))).alias("copy")).select("row.*")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding: token ids with an end id, and digests of the ids and the decoded text.

    Edge cases: null and empty texts are the end id alone; repeated rows are encoded each.
    """
    return pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True)


STAGES = [
    ("language", keep_identified),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixture", mix_sources),
    ("pieces", encode_pieces),
]

#: SQL can't express the network, the signatures or the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
