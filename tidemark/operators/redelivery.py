"""Messages delivered more than once: exactly one row of each message, by persisted sorted identifier runs.

Each batch is first deduplicated locally (map-side combined, so one identifier may hold any share of the rows),
then split by hash prefix. The task of a prefix binary-searches the persisted identifier runs of that prefix:
identifiers found there are redeliveries, the others are novel and become the batch's new immutable run.
Fewer than `merge_every` runs stay live: the newest are merged, with all older ones that are not at least twice as large.

Defined results: a null identifier is no message (neither kept nor found); a null topic is a topic of its own;
null ingested_at, partition or offset sort last; repeated rows and ties give the same kept row; an empty table
gives an empty result. Identity is the 128-bit MD5 of topic and identifier.
"""
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.runs import Manifest, compact, run_file, search_run, write_run
from tidemark.shared import materialize, scratch

LAST = 2**63 - 1
PREFIX_ROWS = 200_000  # rows of a prefix: one task's arrays stay small however many rows there are
PAYLOAD = np.dtype([("lo", "<u8"), ("at", "<i8"), ("part", "<i8"), ("off", "<i8")])
OUT = "topic string, id string, at long, part long, off long, n long, known boolean, batch long"


def _identity() -> Column:
    """MD5 of topic and identifier as 32 hexadecimal digits, in the JVM."""
    topic = F.coalesce(F.concat(F.lit("\u0001"), "topic"), F.lit("\u0000"))
    return F.md5(F.encode(F.concat(topic, F.lit("\u0000"), "id"), "UTF-8"))


def _halves(keys: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), ">u8").reshape(-1, 2)
    return both[:, 0].astype("<u8"), both[:, 1].astype("<u8")


class RedeliveryIndex:
    """Persisted identifier index. prefixes is fixed for its life; choose it so that a prefix holds some 100,000s."""

    def __init__(self, spark: SparkSession, root: str, prefixes: int = 32, merge_every: int = 4):
        self.spark, self.root, self.manifest = spark, root, Manifest(root)
        self.prefixes, self.merge_every = prefixes, merge_every

    def add(self, local: DataFrame, batch: int) -> DataFrame:
        """local: topic, id, at, part, off, n with one row per identifier. Returns OUT, one row per identifier:
        the kept row's coordinates (the index's where the identifier was known) and the batch's own count."""
        state = self.manifest.load()
        root, runs, name = self.root, [r[0] for r in state["runs"]], f"run-{state['batches']:06d}"

        def check(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            hi, lo = _halves(pdf["key"])
            order = np.argsort(hi, kind="stable")
            pdf, hi, lo = pdf.iloc[order].reset_index(drop=True), hi[order], lo[order]
            known = np.zeros(len(pdf), bool)
            kept = {c: pdf[c].to_numpy(np.int64).copy() for c in ("at", "part", "off")}
            for run in runs:
                w, rows = search_run(run_file(root, run, int(key[0])), PAYLOAD, hi)
                same = rows["lo"] == lo[w]
                known[w[same]] = True
                for c in kept:
                    kept[c][w[same]] = rows[c][same]
            novel = ~known
            if novel.any():
                rows = np.zeros(int(novel.sum()), PAYLOAD)
                rows["lo"] = lo[novel]
                for c in kept:
                    rows[c] = kept[c][novel]
                write_run(run_file(root, name, int(key[0])), hi[novel], rows)
            return pdf[["topic", "id"]].assign(**kept, n=pdf["n"], known=known, batch=batch)

        lead = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")  # the first 32 bits choose the prefix range
        prefixed = local.withColumn("key", _identity()).withColumn("prefix", F.shiftright(lead * self.prefixes, 32).cast("int")).withColumn("key", F.unhex("key"))
        out = materialize(prefixed.groupBy("prefix").applyInPandas(check, OUT), "redelivery")
        live = [*state["runs"], [name, 1]]  # names and the batches they hold
        if len(live) >= self.merge_every:
            k, size = 2, live[-1][1] + live[-2][1]
            while k < len(live) and live[-k - 1][1] < 2 * size:  # large old runs are left alone
                size += live[-k - 1][1]
                k += 1
            merged = compact(self.spark, root, [r[0] for r in live[-k:]], self.prefixes, PAYLOAD, f"merged-{state['batches']:06d}")
            live = [*live[:-k], [merged, size]]
        state = {"runs": live, "batches": state["batches"] + 1}
        self.manifest.save(state)
        return out


def local_dedup(df: DataFrame, topic: str, ident: str, at: str, part: str, off: str, *extra) -> DataFrame:
    """One row per identifier with the least coordinates and the count; partial aggregation runs before the shuffle."""
    first = F.min(F.struct(F.coalesce(F.unix_micros(F.col(at)), F.lit(LAST)).alias("at"),
                           F.coalesce(F.col(part).cast("long"), F.lit(LAST)).alias("part"),
                           F.coalesce(F.col(off).cast("long"), F.lit(LAST)).alias("off")))
    return (df.where(F.col(ident).isNotNull())
              .groupBy(*extra, F.col(topic).alias("topic"), F.col(ident).alias("id"))
              .agg(first.alias("m"), F.count(F.lit(1)).alias("n"))
              .select(*extra, "topic", "id", "m.*", "n"))


def replay(df: DataFrame, topic="kafka_topic", ident="event_id", at="ingested_at", part="kafka_partition",
           off="kafka_offset", batches: int = 4) -> DataFrame:
    """Run a whole table through a new index as consecutive batches of ingestion time."""
    spark = df.sparkSession
    slim = df.select(topic, ident, at, part, off)
    cuts = slim.select(F.percentile_approx(F.unix_micros(at), [k / batches for k in range(1, batches)], 1000).alias("q"),
                       F.count(F.lit(1)).alias("n")).first()
    when = F.coalesce(F.unix_micros(F.col(at)), F.lit(LAST))
    number = sum([(when > F.lit(c)).cast("int") for c in sorted(set(cuts["q"] or []))], F.lit(0))
    local = materialize(local_dedup(slim.withColumn("b", number), topic, ident, at, part, off, "b"), "batches", ["b"])
    prefixes = max(16, -(-cuts["n"] // PREFIX_ROWS))
    index = RedeliveryIndex(spark, scratch(spark, "redelivery-index"), prefixes)
    outs = [index.add(local.where(F.col("b") == b).drop("b"), b) for b in range(len(set(cuts["q"] or [])) + 1)]
    result = outs[0]
    for o in outs[1:]:
        result = result.unionByName(o)
    return result


def _coordinates(df: DataFrame) -> DataFrame:
    back = lambda c, t: F.when(F.col(c) != LAST, F.col(c)).cast(t)
    return df.select(F.col("topic").alias("kafka_topic"), F.col("id").alias("event_id"),
                     back("part", "int").alias("kafka_partition"), back("off", "bigint").alias("kafka_offset"), "n", "known")


def kept_messages(df: DataFrame) -> DataFrame:
    """One row of each message: every identifier once, in the batch in which it was novel."""
    return _coordinates(replay(df)).where(~F.col("known")).drop("n", "known")


def redelivered_messages(df: DataFrame) -> DataFrame:
    """Each message with more than one row, shown by the row kept."""
    return (_coordinates(replay(df)).where(F.col("known") | (F.col("n") > 1)).drop("n", "known").distinct())
