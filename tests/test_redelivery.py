from datetime import datetime, timezone

import pytest

from tidemark.operators.redelivery import RedeliveryIndex, kept_messages, local_dedup, redelivered_messages

SCHEMA = "kafka_topic string, event_id string, kafka_partition int, kafka_offset long, ingested_at timestamp, n string, b string"


def at(h):
    return datetime(2026, 1, 1, h, tzinfo=timezone.utc)


def brute(rows):
    best, count = {}, {}
    for topic, ident, part, off, when, *_ in rows:
        if ident is None:
            continue
        last = (when is None, when or at(0), part is None, part or 0, off is None, off or 0)
        key = (topic, ident)
        count[key] = count.get(key, 0) + 1
        if key not in best or last < best[key][0]:
            best[key] = (last, (topic, ident, part, off))
    return {v[1] for v in best.values()}, {v[1] for k, v in best.items() if count[k] > 1}


def test_every_message_once(spark):
    rows = [("rss", f"e{i % 37}", i % 3, i, at(i % 24), "x", "y") for i in range(400)]
    rows += [("rss", "hot", 0, 5000 - i, at(i % 24), "x", "y") for i in range(200)]  # a third of all rows
    rows += [(None, "e1", 1, 1, at(3), None, None), ("rss", None, 1, 2, at(3), None, None), ("sec", "late", None, None, None, None, None),
             ("sec", "late", 1, 7, at(5), None, None), ("sec", "", 0, 9, at(5), None, None), ("sec", "x" * 10000, 0, 10, at(6), None, None)]
    rows += rows[:50]
    df = spark.createDataFrame(rows, SCHEMA)
    kept, found = brute(rows)
    assert {tuple(r) for r in kept_messages(df).collect()} == kept
    assert {tuple(r) for r in redelivered_messages(df).collect()} == found


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert kept_messages(df).count() == 0 and redelivered_messages(df).count() == 0


def test_runs_are_merged_and_still_found(spark, tmp_path):
    index = RedeliveryIndex(spark, str(tmp_path / "index"), prefixes=4, merge_every=3)
    for day in range(7):
        batch = spark.createDataFrame([("t", f"id{i}", 0, 100 * day + i, at(day), "", "") for i in range(day * 10, day * 10 + 20)], SCHEMA)
        out = index.add(local_dedup(batch, "kafka_topic", "event_id", "ingested_at", "kafka_partition", "kafka_offset"), day).collect()
        assert sum(r["known"] for r in out) == (10 if day else 0)
        assert all(r["off"] < 100 * day for r in out if r["known"])
    assert len(index.manifest.load()["runs"]) < 3


def test_same_batch_twice_changes_nothing_found(spark, tmp_path):
    index = RedeliveryIndex(spark, str(tmp_path / "index"), prefixes=2)
    batch = local_dedup(spark.createDataFrame([("t", "a", 0, 1, at(0), "", "")], SCHEMA), "kafka_topic", "event_id", "ingested_at", "kafka_partition", "kafka_offset")
    assert [r["known"] for r in index.add(batch, 0).collect()] == [False]
    assert [r["known"] for r in index.add(batch, 1).collect()] == [True]
    assert pytest.approx(len(index.manifest.load()["runs"])) == 2
