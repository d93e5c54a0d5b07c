"""Stored tables and files: Parquet tables, JSON lines of pairs, bundles, source texts, Java trace lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAIRS = (
    "pair_id string, base_id string, variant_id string, base_path string, variant_path string, transformation_type string, "
    "semantic_relation string, expected_label string, split string, seed int, gt_tier string, confidence double, hard_negative boolean"
)
BUNDLES = "program_id string, source_hash string, extraction_timestamp string, genome_version string, genomes map<string,string>, provenance map<string,string>, metadata map<string,string>"
#: TRACE (ENTER|EXIT|EXCEPTION) name depth=N [exception type]
JAVA_LINE = r"TRACE\s+(ENTER|EXIT|EXCEPTION)\s+(\S+)\s+depth=(\d+)(?:\s+(\S+))?"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_pairs(spark: SparkSession, path: str, split: str | None = None, tolerant: bool = True) -> DataFrame:
    """JSON lines of program pairs with a fixed schema; tolerant drops the lines that can't be parsed."""
    rows = spark.read.schema(PAIRS).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)
    return rows.where(F.col("split") == split) if split else rows


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """One row a source file: path, source."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("source"))


def write_results(rows: DataFrame, path: str, form: str = "json") -> None:
    """Results as partitioned files; an existing folder is replaced as a whole."""
    rows.write.mode("overwrite").format(form).save(path)


def write_bundles(bundles: DataFrame, path: str) -> None:
    write_results(bundles, path, "json")


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BUNDLES).json(path)


def bundle_text(bundles: DataFrame) -> DataFrame:
    """Each bundle as one JSON text."""
    return bundles.select("program_id", F.to_json(F.struct("*")).alias("bundle"))


def bundle_rows(texts: DataFrame) -> DataFrame:
    return texts.select(F.from_json("bundle", BUNDLES).alias("b")).select("b.*")


def round_trips(bundles: DataFrame) -> bool:
    """Do the bundles survive a turn through JSON? Maps are compared as sorted entries."""
    flat = lambda df: df.select(*[F.to_json(F.array_sort(F.map_entries(c))).alias(c) if t.startswith("map") else F.col(c) for c, t in df.dtypes])
    a, b = flat(bundles), flat(bundle_rows(bundle_text(bundles)))
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def source_hash(text: str = "source"):
    return F.substring(F.sha2(text, 256), 1, 16)


def java_traces(lines: DataFrame) -> DataFrame:
    """Trace events from the standard output of an instrumented Java program. lines: program_id, run_idx, input_idx, line_no, value.

    The exception's type is the fourth group of the line, which is where the writer puts it.
    """
    part = lambda n: F.regexp_extract("value", JAVA_LINE, n)
    kind = F.when(part(1) == "ENTER", "call").when(part(1) == "EXIT", "return").otherwise("exception")
    hit = lines.where(F.col("value").rlike(JAVA_LINE))
    return hit.select("program_id", "run_idx", "input_idx", F.col("line_no").alias("seq"), kind.alias("event_type"), part(2).alias("function_name"), part(3).cast("int").alias("depth"), F.nullif(part(4), F.lit("")).alias("exception_type"))
