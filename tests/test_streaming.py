from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.streaming.ingest import Lakehouse, TransportFault
from tidemark.streaming.ttl import accepted
from tidemark.streaming.windows import near_in_window

ENVELOPE = "topic string, partition int, offset long, payload string, at timestamp"
T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)


def env(off, payload, minutes=0, topic="rss", part=0):
    return (topic, part, off, payload, T0 + timedelta(minutes=minutes))


def test_ingestion_outcomes(spark, tmp_path):
    lake = Lakehouse(spark, str(tmp_path / "lake"), halt=False)
    first = [env(1, '{"id": "a", "title": "Tesla beats"}'), env(1, '{"id": "a", "title": "Tesla beats"}'), env(2, "broken"), env(3, None), env(4, "[]"), env(-1, '{"id": "z"}'), (None, 0, 1, "{}", T0), env(5, '{"id": "b", "title": "x"}', part=None)]
    lake.add(spark.createDataFrame(first, ENVELOPE), 0)
    lake.add(spark.createDataFrame(first, ENVELOPE), 0)  # replayed batch
    assert lake.read("bronze").count() == 4 and lake.read("silver").count() == 1 and lake.read("faults").count() == 3
    second = [env(1, '{"id": "a", "title": "Tesla beats"}', 5), env(6, '{"title": "Tesla  beats ", "id": "a"}', 6), env(7, '{"id": "a", "title": "Tesla misses"}', 7), env(8, '{"id": "a", "title": "Tesla beats", "content_full": "more"}', 8), env(9, '{"id": "c", "title": "new"}', 9),
              env(10, '{"id": "a", "title": "Tesla beats", "published_at": "2026-01-01T00:00:00Z"}', 10), env(11, '{"id": "a", "title": "Tesla beats", "url": "u"}', 11)]
    lake.add(spark.createDataFrame(second, ENVELOPE), 1)
    outcome = {r["offset"]: r["outcome"] for r in lake.read("outcomes").collect()}
    assert outcome == {1: "inserted", 2: "rejected", 3: "rejected", 4: "rejected", 6: "redelivery", 7: "conflict", 8: "enrichment", 9: "inserted", 10: "conflict", 11: "redelivery"}
    assert {r["offset"]: r["provenance"] for r in lake.read("outcomes").collect()}[11] == "url"
    assert {r["id"]: r["title"] for r in lake.read("silver").collect()} == {"a": "Tesla beats", "c": "new"}
    lake.add(spark.createDataFrame([env(-1, '{"id": "z"}', 60)], ENVELOPE), 2)
    assert max(r["occurrences"] for r in lake.faults().collect()) == 2


def test_faults_halt_until_resolved(spark, tmp_path):
    lake = Lakehouse(spark, str(tmp_path / "lake"))
    batch = spark.createDataFrame([env(1, '{"id": "a", "title": "t"}'), env(-1, '{"id": "z"}')], ENVELOPE)
    for _ in range(2):  # also after a restart
        with pytest.raises(TransportFault):
            lake.add(batch, 0)
    assert lake.read("bronze").count() == 0 and lake.batches() == []
    fault = lake.unresolved().first()
    assert fault["occurrences"] == 1
    with pytest.raises(ValueError):
        lake.resolve(fault["fault_id"], "  ")
    lake.resolve(fault["fault_id"], "producer mended")
    with pytest.raises(ValueError):
        lake.resolve(fault["fault_id"], "twice")
    lake.add(batch, 0)
    assert lake.read("bronze").count() == 1 and lake.faults().first()["note"] == "producer mended"
    with pytest.raises(TransportFault):  # the same fault in another batch is open again
        lake.add(batch, 1)
    assert lake.unresolved().first()["occurrences"] == 2


def test_near_titles_in_a_stream_window(spark, tmp_path):
    src = str(tmp_path / "near")
    schema = "id string, title string, at timestamp"
    title = "Shares of Tesla slip as weak orders weigh on the outlook for the year"
    for batch in ([("a", title, 0)], [("b", title + " today", 60), ("c", "Something else altogether happens in the markets here", 61)], [("d", title, 24 * 60 + 30), (None, title, 5), ("e", None, 5)]):
        spark.createDataFrame([(i, t, T0 + timedelta(minutes=m)) for i, t, m in batch], schema).coalesce(1).write.mode("append").parquet(src)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = near_in_window(stream(), stream()).writeStream.format("memory").queryName("near_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["a"], r["b"]) for r in spark.table("near_out").collect()} == {("a", "b"), ("b", "d")}


def test_watermarked_windows(spark, tmp_path):
    src = str(tmp_path / "w")
    for batch in ([("k", 0), ("k", 59)], [("k", 300)], [("k", 302)], [("k", 1), ("k", 301)]):  # rows are dropped by the watermark before the last batch's
        spark.createDataFrame([(k, T0 + timedelta(minutes=m)) for k, m in batch], "key string, at timestamp").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("key string, at timestamp").option("maxFilesPerTrigger", 1).parquet(src)
    counted = stream.withWatermark("at", "1 hour").groupBy(F.window("at", "1 hour"), "key").count()
    q = counted.writeStream.format("memory").queryName("w_out").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    counts = {}
    for r in spark.table("w_out").collect():
        hour = r["window"]["start"].hour
        counts[hour] = max(counts.get(hour, 0), r["count"])
    assert counts[T0.hour] == 2 and sum(counts.values()) == 5


def test_stream_equals_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    for i in range(3):
        spark.createDataFrame([env(k, f'{{"id": "e{k % 4}", "title": "t{k}"}}', k) for k in range(i * 3, i * 3 + 5)], ENVELOPE).coalesce(1).write.mode("append").parquet(src)
    lake = Lakehouse(spark, str(tmp_path / "lake"))
    stream = spark.readStream.schema(ENVELOPE).option("maxFilesPerTrigger", 1).parquet(src)
    for _ in range(2):
        lake.run(stream, str(tmp_path / "checkpoint")).awaitTermination()
    assert lake.read("bronze").count() == 11 and lake.read("silver").count() == 4


def test_ttl_stream(spark, tmp_path):
    src = str(tmp_path / "ttl")
    schema = "key string, at timestamp"
    for batch in ([("a", 0), ("a", 5)], [("a", 12), (None, 1)], [("b", 40), ("a", 41), ("a", 41)]):
        spark.createDataFrame([(k, T0 + timedelta(minutes=m)) for k, m in batch], schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = accepted(stream, 600).writeStream.format("memory").queryName("ttl_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["key"], r["at"].minute) for r in spark.table("ttl_out").collect())
    assert got == [("a", 0), ("a", 12), ("a", 41), ("b", 40)]
