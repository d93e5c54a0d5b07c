"""The source of trace lines: round trip, splits, pushed-down programs, stream."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull

from traceloom.operators import sequences
from traceloom.sources import lines, tables, traces

EVENTS = lines.SCHEMA


@pytest.fixture
def events(spark):
    rng, rows = random.Random(3), []
    for t in range(14):
        for i in range(rng.choice([1, 3, 30])):
            kind = rng.choice(["call", "return", "exception"])
            rows.append((f"p {t % 5}" if t % 5 else "ü%\n", t % 2, t, i, kind, rng.choice(["f", "g h", "", "100%", "é\t"]), rng.randint(0, 4), "Value Error" if kind == "exception" and i % 2 else None))
    return spark.createDataFrame(rows, EVENTS).repartition(3)


def told(df):
    return sorted(repr(tuple(r)) for r in df.select(*[c.split()[0] for c in EVENTS.split(", ")]).collect())


def test_round_trip(spark, events, tmp_path, monkeypatch):
    monkeypatch.setattr(lines, "STRETCH", 7)
    lines.write_lines(events, str(tmp_path))
    assert told(lines.read_lines(spark, str(tmp_path))) == told(events)
    assert all(p.name.endswith(".trace") for p in tmp_path.iterdir() if not p.name.endswith(".crc"))
    for size in (400, 2000):
        split = spark.read.format("trace_lines").option("splitBytes", size).load(str(tmp_path))
        assert told(split) == told(events)
    # any place of any file can be where a split ends
    for size in (1, 37):
        rows = [r for f in lines.listed(str(tmp_path)) for p in lines.splits([f], size) for b in lines.read_split(str(tmp_path), p, None) for r in b.to_pylist()]
        assert sorted(repr(tuple(r.values())) for r in rows) == told(events)
    assert lines.read_lines(spark, str(tmp_path / "none")).count() == 0


def test_programs_are_pushed_down(spark, events, tmp_path, monkeypatch):
    lines.write_lines(events, str(tmp_path))
    reader = lines.LineReader({"path": str(tmp_path)})
    assert list(reader.pushFilters([EqualTo(("program_id",), "p 1"), IsNotNull(("program_id",)), GreaterThan(("seq",), 3)])) == [GreaterThan(("seq",), 3)]
    assert list(reader.pushFilters([In(("program_id",), ("p 1", "p 2"))])) == [] and reader.programs == {"p 1"}
    parsed = []
    monkeypatch.setattr(lines, "LINE", type("Counted", (), {"search": staticmethod(lambda text, found=lines.LINE: parsed.append(text) or found.search(text))}))
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert {r["program_id"] for r in rows} == {"p 1"} and len(parsed) == len(rows) == events.where("program_id = 'p 1'").count()
    wanted = F.col("program_id").isin("p 3", "ü%\n")
    assert told(lines.read_lines(spark, str(tmp_path)).where(wanted).where("seq > 1")) == told(events.where(wanted).where("seq > 1"))


def test_lines_of_other_programs_and_noise_are_skipped(spark, tmp_path):
    (tmp_path / "a.trace").write_text('noise\nTRACE ENTER lost depth=1\nBEGIN {"program_id": "p", "run_idx": 0, "input_idx": 2, "seq": 5}\nhello\nTRACE ENTER f depth=1\n[x] TRACE EXCEPTION f depth=1 ValueError\nTRACE EXIT f depth=0')
    (tmp_path / "b.trace").write_text("")
    assert [tuple(r) for r in lines.read_lines(spark, str(tmp_path)).orderBy("seq").collect()] == [("p", 0, 2, 5, "call", "f", 1, None), ("p", 0, 2, 6, "exception", "f", 1, "ValueError"), ("p", 0, 2, 7, "return", "f", 0, None)]


def test_stream_reads_each_file_once(spark, events, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    lines.register(spark)
    for part in ("input_idx < 7", "input_idx >= 7"):
        lines.write_lines(events.where(part), str(source))
        stream = spark.readStream.format("trace_lines").option("splitBytes", 1000).load(str(source))
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(out).awaitTermination(120)
        assert told(spark.read.parquet(out)) == told(events if part.endswith(">= 7") else events.where(part))


def test_events_of_the_table_survive(spark, sf_dir, tmp_path):
    placed = sequences.in_traces(traces.event_traces(tables.read_table(spark, sf_dir, "events")))
    lines.write_lines(placed, str(tmp_path))
    back = lines.read_lines(spark, str(tmp_path))
    keys = ["program_id", "run_idx", "input_idx", "seq", "event_type", "function_name", "depth"]
    assert sorted(map(tuple, back.select(*keys).collect())) == sorted(map(tuple, placed.select(*keys).collect()))
