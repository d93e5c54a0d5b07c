"""The live call stack against the batch form."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from traceloom.operators import sequences
from traceloom.plans.traces import nested_events
from traceloom.sources.tables import read_table
from traceloom.streaming import stack


@pytest.fixture
def rocks(spark):
    spark.conf.set(*stack.STATE_STORE)
    yield spark
    spark.conf.unset(stack.STATE_STORE[0])


def streamed(spark, tmp_path, files, gap="4000 days"):
    """The stream's rows; files arrive one after the other. Two last events of another trace move the watermark beyond them, and then beyond timers that were set meanwhile."""
    schema = "trace string, ts timestamp, order_id long, event_type string, function_name string"
    last = [spark.createDataFrame([("~", datetime.datetime(year, 1, 1), 0, "call", "x")], schema) for year in (2060, 2062)]
    for i, df in enumerate([*files, *last]):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for p in (tmp_path / "in").glob("part-*"):
            p.rename(tmp_path / "in" / f"{i:03}-{i}.parquet") if not p.name[0].isdigit() else None
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    query = stack.live_stack(live, late="60 days", gap=gap).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination(300)
    return [r for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.trace != "~"]


def test_stream_equals_batch_on_events(rocks, sf_dir, tmp_path):
    """Events arrive in any order within the watermark."""
    nested = nested_events(rocks, sf_dir)
    k = F.coalesce(F.nullif(F.regexp_extract("props", r'"k": *(-?[0-9]+)', 1), F.lit("")).cast("long"), F.lit(0))
    log = read_table(rocks, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("trace"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("order_id"),
        F.when(F.col("event_type").isin("purchase", "error"), "return").otherwise("call").alias("event_type"), F.concat(F.lit("f"), (k % 3).cast("string")).alias("function_name"),
    )
    files = [log.where(F.pmod(F.xxhash64("order_id"), F.lit(3)) == i) for i in range(3)]
    got = streamed(rocks, tmp_path, files)
    want = sequences.depths(nested).select("program_id", "seq", "function_name", "depth").collect()
    assert sorted((r.trace, r.seq, r.function_name, r.depth) for r in got if r.kind != "open") == sorted(tuple(r) for r in want)
    closed = {}
    for r in got:
        if r.kind == "closed":
            n, events = closed.get((r.trace, r.function_name), (0, 0))
            closed[r.trace, r.function_name] = (n + 1, events + r.took)
    batch = sequences.closed_calls(nested).collect()
    assert closed == {(r.program_id, r.function_name): (r.n, r.events) for r in batch} and len(batch) > 20


def test_quiet_traces_end(rocks, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rng = random.Random(0)
    rows = [("a", at + datetime.timedelta(minutes=i), i, k, n) for i, (k, n) in enumerate([("call", "f"), ("call", "g"), ("return", "f"), ("return", "g"), ("call", "h")])]
    rows.append(("a", at + datetime.timedelta(days=40), 9, "call", "k"))
    rng.shuffle(rows)
    df = rocks.createDataFrame(rows, "trace string, ts timestamp, order_id long, event_type string, function_name string")
    got = sorted((r.kind, r.seq, r.function_name, r.depth, r.took) for r in streamed(rocks, tmp_path, [df], gap="30 days"))
    assert got == [("closed", 3, "g", 0, 2), ("event", 0, "f", 1, None), ("event", 0, "k", 1, None), ("event", 1, "g", 2, None), ("event", 2, "f", 1, None), ("event", 4, "h", 1, None), ("open", 0, "f", 1, None), ("open", 0, "k", 1, None), ("open", 4, "h", 1, None)]
