"""Change events: a stream in several batches leaves what replaying all at once leaves."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lexigrove.streaming.updates import SCHEMA, LiveCollection, from_events, reduced, replayed


def rows(*events):
    start = datetime(2024, 1, 1)
    return [(start + timedelta(minutes=i), i, *e, *([None] * (4 - len(e)))) for i, e in enumerate(events)]


def events(spark, *given):
    return spark.createDataFrame([(ts, seq, event, path, path2, text) for ts, seq, event, path, text, path2 in rows(*given)], SCHEMA)


def state(live):
    return sorted(map(tuple, live.current().collect()))


def test_generations_and_compaction(spark, tmp_path):
    live = LiveCollection(spark, str(tmp_path / "live"))
    assert state(live) == [] and not live.compact()
    live.apply(events(spark, ("WRITE", "a", "one"), ("WRITE", "b", "two"), ("WRITE", "a", "three"), ("WRITE", "e", "x")), 0)
    assert state(live) == [("a", "three"), ("b", "two"), ("e", "x")]
    later = events(spark, ("APPEND", "b", "+more"), ("UNLINK", "a"), ("RENAME", "e", None, "f"), ("CREATE", "c", ""), ("APPEND", "c", "y")).withColumn("ts", F.expr("ts + interval 1 day"))
    live.apply(later, 1)
    want = [("b", "two+more"), ("c", "y"), ("f", "x")]
    assert state(live) == want
    live.apply(later, 1)  # run again
    assert state(live) == want
    assert live.garbage() > 0.4 and live.compact() and state(live) == want and live.garbage() == 0


def test_reduction_keeps_what_matters(spark):
    given = events(spark, ("WRITE", "a", "1"), ("WRITE", "a", "2"), ("RENAME", "a", None, "b"), ("WRITE", "a", "3"), ("UNLINK", "a"))
    assert sorted(r.seq for r in reduced(given).collect()) == [1, 2, 4]


def test_stream_equals_replay(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source = from_events(table)
    source.repartition(4).write.parquet(str(tmp_path / "in"))
    live = LiveCollection(spark, str(tmp_path / "live"))
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live.follow(stream, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert len(live._folders("generation")) == 4
    assert state(live) == sorted(map(tuple, replayed(source).collect()))
