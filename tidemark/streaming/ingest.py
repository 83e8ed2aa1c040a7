"""Replayable ingestion of a message log: append-only bronze, first-write-wins silver, one outcome per new message.

Each micro-batch writes its rows below batch=<id> of every table and becomes visible by one manifest replacement, so
bronze, silver and outcomes appear together and a replayed batch changes nothing. Envelope columns: topic, partition,
offset, payload (string), at (timestamp).

A message without sound coordinates is a fault. A batch that holds an unresolved fault records it and halts: nothing of the
batch becomes visible, and no batch is taken before every fault is resolved with a note. The replayed batch then passes; the
resolved message itself is left out. A fault that comes again in another batch is open again. With halt=False faults are
only recorded.

An outcome compares a delivery with the first one of its id, field by field (functions.records): conflict, enrichment, or
redelivery where neither remains. Late messages are accepted at any lateness; visibility follows their own arrival.

Defined results: null topic, negative or null partition or offset are faults; a repeated coordinate counts as replay; null, broken
or id-less payloads are 'rejected' and kept in bronze; ties go to the smaller coordinate; an empty batch publishes nothing.
"""
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.records import change_status, field_diff
from tidemark.operators.pit import first_writer, latest
from tidemark.shared import get_json, put_json

BRONZE = "topic string, partition int, offset long, payload string, at timestamp, id string"
SILVER = "id string, title string, payload string, topic string, partition int, offset long"
OUTCOMES = "topic string, partition int, offset long, id string, outcome string, conflicts string, enrichment string, provenance string"
FAULTS = "topic string, partition int, offset long, payload string, at timestamp, fault_id string"
SCHEMAS = {"bronze": BRONZE, "silver": SILVER, "outcomes": OUTCOMES, "faults": FAULTS}
COORDINATES = ["topic", "partition", "offset"]


class TransportFault(RuntimeError):
    """Ingestion halts: unresolved faults."""


class Lakehouse:
    """Manifest: batches that are visible, batches that recorded faults (visible or not), resolutions in order."""

    def __init__(self, spark: SparkSession, root: str, halt: bool = True):
        self.spark, self.root, self.halt, self.manifest = spark, root.rstrip("/"), halt, f"{root.rstrip('/')}/manifest.json"

    def _load(self) -> dict:
        return get_json(self.manifest) or {"batches": [], "faulty": [], "resolutions": []}

    def batches(self) -> list[int]:
        return self._load()["batches"]

    def read(self, name: str) -> DataFrame:
        """Published rows of a table; of faults also those of halted batches."""
        state = self._load()
        done = state["faulty"] if name == "faults" else state["batches"]
        if not done:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*[f"{self.root}/{name}/batch={b}" for b in done])

    def add(self, batch: DataFrame, batch_id: int) -> None:
        state = self._load()
        if batch_id in state["batches"]:
            return
        if self.halt:
            self.check()
        sound = F.col("topic").isNotNull() & (F.coalesce("topic", F.lit("")) != "") & (F.col("partition") >= 0) & (F.col("offset") >= 0)
        ok = F.coalesce(sound, F.lit(False))
        fault = F.sha2(F.to_json(F.struct("topic", "partition", "offset", F.base64(F.encode("payload", "utf-8")))), 256)
        if batch_id not in state["faulty"]:
            self._write(batch.where(~ok).withColumn("fault_id", fault).select("topic", "partition", "offset", "payload", "at", "fault_id"), "faults", batch_id)
            state["faulty"].append(batch_id)
            put_json(self.manifest, state)
            if self.halt:
                self.check()
        body = batch.withColumn("id", F.when(F.try_parse_json("payload").isNotNull(), F.get_json_object("payload", "$.id")))
        fresh = first_coordinates(body.where(ok)).join(self.read("bronze").select(*COORDINATES), COORDINATES, "left_anti")
        self._write(fresh.select("topic", "partition", "offset", "payload", "at", "id"), "bronze", batch_id)
        new = self._written("bronze", batch_id)
        known = self.read("silver")
        arrivals = new.where("id is not null").withColumn("title", F.get_json_object("payload", "$.title"))
        silver = first_writer(arrivals, known, "id", F.col("at"), F.col("topic"), F.col("partition"), F.col("offset"))
        self._write(silver.select("id", "title", "payload", "topic", "partition", "offset"), "silver", batch_id)
        stored = known.unionByName(self._written("silver", batch_id))
        first = stored.select("id", F.col("payload").alias("p0"), F.struct(*COORDINATES).alias("c0"))
        diff = field_diff(F.col("p0"), F.col("payload"))
        judged = new.join(first, "id", "left").withColumn("diff", F.when(F.col("c0") != F.struct(*COORDINATES), diff))
        outcome = F.when(F.col("id").isNull(), "rejected").when(F.col("diff").isNull(), "inserted").otherwise(change_status(F.col("diff")))
        self._write(judged.select(*COORDINATES, "id", outcome.alias("outcome"), "diff.conflicts", "diff.enrichment", "diff.provenance"), "outcomes", batch_id)
        state["batches"].append(batch_id)
        put_json(self.manifest, state)

    def _write(self, df: DataFrame, name: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch_id}")

    def _written(self, name: str, batch_id: int) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}/batch={batch_id}")

    def faults(self) -> DataFrame:
        """Current state of each fault: first and last seen, occurrences, note and time of the resolution that still holds (one that
        saw the last batch the fault came in)."""
        state = self._load()
        seen = self.read("faults").withColumn("batch", F.regexp_extract(F.input_file_name(), r"batch=(\d+)", 1).cast("long"))
        current = seen.groupBy("fault_id").agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.count(F.lit(1)).alias("occurrences"), F.max("batch").alias("last_batch"))
        notes = self.spark.createDataFrame([(r["fault_id"], r["note"], r["at"], r["batch"]) for r in state["resolutions"]], "fault_id string, note string, resolved_at string, seen_batch long")
        notes = latest(notes, ["fault_id"], F.desc("seen_batch"), F.desc("resolved_at"))
        holds = F.coalesce(F.col("seen_batch") >= F.col("last_batch"), F.lit(False))
        keep = lambda c: F.when(holds, F.col(c)).alias(c)
        return current.join(notes, "fault_id", "left").select("fault_id", "first_seen", "last_seen", "occurrences", "last_batch", keep("note"), keep("resolved_at"))

    def unresolved(self) -> DataFrame:
        return self.faults().where("note is null").orderBy("first_seen", "fault_id")

    def check(self) -> None:
        """Refuse to go on while a fault is unresolved."""
        if self._load()["faulty"] and not self.unresolved().isEmpty():
            raise TransportFault("unresolved transport faults: resolve each with a note before ingestion goes on")

    def resolve(self, fault_id: str, note: str) -> None:
        """Record a decision on an unresolved fault; the record itself stays for audit."""
        if not note or not note.strip():
            raise ValueError("a resolution needs a note")
        open_ = self.unresolved().where(F.col("fault_id") == fault_id).first()
        if open_ is None:
            raise ValueError("no such unresolved fault")
        state = self._load()
        state["resolutions"].append({"fault_id": fault_id, "note": note.strip(), "at": datetime.now(timezone.utc).isoformat(), "batch": open_["last_batch"]})
        put_json(self.manifest, state)

    def run(self, stream: DataFrame, checkpoint: str, once: bool = True):
        """foreachBatch sink; availableNow for one shot, else every two seconds. The reader bounds a batch (maxFilesPerTrigger,
        maxOffsetsPerTrigger: 500)."""
        writer = stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()


def first_coordinates(df: DataFrame) -> DataFrame:
    return latest(df, COORDINATES, F.col("at"), F.col("payload"))
