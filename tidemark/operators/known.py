"""Attributes as known at event time: for each event the fact with the greatest valid-time key among the facts of
its entity that were known strictly before the event (and valid strictly before its search time).

Facts of a shard are inserted in order of known time into a search tree over their (entity, valid, sequence)
rank. Insertion copies the path from root to leaf and leaves all older roots intact; an event picks the last
root older than its own known time by binary search and descends once for the greatest rank at most its own.
All events of a shard descend together, level by level, in arrays.

Shards: entities hash into shards sized by the counted rows. An entity with more than `hot` facts is split by
valid-time ranges (an event that finds nothing in its range asks the next earlier one, round by round); one with more
than `hot` events is split by event salt, its facts repeated per salt. Both counts are computed, not assumed.

Defined results: null entity, null known or null event time match nothing; facts with null valid time never
match; repeated facts and equal instants resolve by the highest sequence, then the highest payload; a null
sequence counts as lowest; events without a match come out with null.
"""
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.shared import materialize

SHARD_ROWS = 50_000


class PersistentTree:
    """Path-copied tree over ranks 0..n-1; insertion i (in the given order) makes root i.

    Node i * (depth + 1) + level is insertion i's copy at that level; kids and the greatest rank below are arrays.
    """

    def __init__(self, ranks: np.ndarray):
        n = len(ranks)
        self.depth = depth = max(1, int(n - 1).bit_length()) if n else 1
        levels = depth + 1
        self.kid = np.full((2, n * levels), -1, np.int64)
        self.most = np.full(n * levels, -1, np.int64)
        own = np.arange(n)
        for level in range(depth, -1, -1):
            node = own * levels + level
            if level == depth:
                self.most[node] = ranks
                continue
            below = ranks >> (depth - level - 1)
            side = below & 1
            order = np.lexsort((own, below >> 1))
            group, s = (below >> 1)[order], side[order]
            start = np.maximum.accumulate(np.where(np.r_[True, group[1:] != group[:-1]], np.arange(n), 0))
            for which in (0, 1):  # last insertion so far below the same node on this side
                last = np.maximum.accumulate(np.where(s == which, np.arange(n), -1))
                last = np.where(last >= start, last, -1)
                made = np.where(last >= 0, own[order][np.maximum(last, 0)] * levels + level + 1, -1)
                self.kid[which, node[order]] = made
            for which in (0, 1):
                k = self.kid[which, node]
                self.most[node] = np.where(k >= 0, np.maximum(self.most[node], self.most[np.maximum(k, 0)]), self.most[node])

    def floor(self, roots: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Greatest rank <= at in the version of each root index (-1: empty version); -1 where none."""
        node = np.where((roots >= 0) & (at >= 0), roots * (self.depth + 1), -1)
        best = np.full(len(at), -1, np.int64)
        if not len(self.most):
            return best
        for level in range(self.depth):
            right = (at >> (self.depth - level - 1)) & 1
            live = np.maximum(node, 0)
            left = self.kid[0, live]
            take = (node >= 0) & (right == 1) & (left >= 0)
            best = np.where(take, self.most[np.maximum(left, 0)], best)
            node = np.where(node >= 0, np.where(right == 1, self.kid[1, live], left), -1)
        return np.where(node >= 0, self.most[np.maximum(node, 0)], best)


def _search(events: pd.DataFrame, facts: pd.DataFrame) -> np.ndarray:
    """Payload per event, None where nothing was known; events: _e, _q; facts: _e, _known, _valid, _seq, _pay."""
    found = np.full(len(events), None, object)
    if not len(facts) or not len(events):
        return found
    codes, _ = pd.factorize(pd.concat([facts["_e"], events["_e"]]), use_na_sentinel=True)
    n = len(facts)
    pay = pd.factorize(facts["_pay"], sort=True)[0]
    valid, seq = facts["_valid"].to_numpy(np.int64), facts["_seq"].to_numpy(np.int64)
    order = np.lexsort((pay, seq, valid, codes[:n]))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    q = events["_q"].to_numpy(np.int64)
    both = np.lexsort((np.r_[np.ones(n), np.zeros(len(q))], np.r_[valid, q], codes))  # an event before facts of its own instant
    before = np.cumsum(both < n)
    at = np.empty(len(both), np.int64)
    at[both] = before - 1
    known = facts["_known"].to_numpy(np.int64)
    inserted = np.argsort(known, kind="stable")
    tree = PersistentTree(rank[inserted])
    root = np.searchsorted(known[inserted], q, "left") - 1
    hit = tree.floor(root, at[n:])
    fact = order[np.maximum(hit, 0)]
    ok = (hit >= 0) & (codes[:n][fact] == codes[n:])
    found[ok] = facts["_pay"].to_numpy(object)[fact[ok]]
    return found


def as_known(events: DataFrame, facts: DataFrame, entity: str, event_us: str, known_us: str, valid_us: str, seq: str,
             payload: str, out: str, hot: int = 200_000) -> DataFrame:
    """events plus column `out`: the payload (string) of the fact as known at event_us (microseconds, long)."""
    f = (facts.select(F.col(entity).cast("string").alias("_e"), F.col(known_us).alias("_known"), F.col(valid_us).alias("_valid"),
                      F.coalesce(F.col(seq).cast("long"), F.lit(-(2**62))).alias("_seq"), F.col(payload).cast("string").alias("_pay"))
              .where("_e is not null and _known is not null and _valid is not null and _pay is not null"))
    columns = events.columns
    e = events.withColumns({"_e": F.col(entity).cast("string"), "_q": F.col(event_us)})
    fc = f.groupBy("_e").agg(F.count(F.lit(1)).alias("nf")).where(F.col("nf") > hot)
    ec = e.groupBy("_e").agg(F.count(F.lit(1)).alias("ne")).where(F.col("ne") > hot)
    size = f.agg(F.count(F.lit(1)).alias("n")).first()["n"] + e.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    shards = max(4, int(np.ceil(size / SHARD_ROWS)))
    heavy = materialize(fc.join(ec, "_e", "full"), "known-heavy")  # at most rows / hot entities on either side
    has_heavy = not heavy.isEmpty()
    if has_heavy:  # valid-time cuts of the hot entities only
        cuts = f.join(heavy.where("nf is not null").select("_e"), "_e", "left_semi").groupBy("_e").agg(F.percentile_approx("_valid", [k / 64 for k in range(1, 64)], 1000).alias("cuts"))
        heavy = materialize(heavy.join(cuts, "_e", "left"), "known-cuts")
    else:
        heavy = heavy.withColumn("cuts", F.array().cast("array<bigint>"))
    heavy = heavy.select("_e", F.coalesce(F.array_distinct("cuts"), F.array().cast("array<bigint>")).alias("_cuts"), F.greatest(F.lit(1), F.ceil(F.coalesce("ne", F.lit(0)) / hot)).cast("int").alias("_salts"))
    home = F.pmod(F.xxhash64("_e"), F.lit(shards)).cast("int").alias("_shard")
    if has_heavy:
        f, e = f.join(heavy, "_e", "left"), e.join(heavy, "_e", "left")
        block = lambda c: F.coalesce(F.size(F.filter("_cuts", lambda x: x < F.col(c))), F.lit(0))
        f = f.withColumn("_block", block("_valid")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
        e = e.withColumn("_block", F.when(F.col("_cuts").isNotNull(), block("_q")).otherwise(0)).withColumn("_salt", F.pmod(F.hash("_q", F.monotonically_increasing_id()), F.coalesce("_salts", F.lit(1))).cast("int"))
    else:
        f, e = f.withColumns({"_block": F.lit(0), "_salt": F.lit(0)}), e.withColumns({"_block": F.lit(0), "_salt": F.lit(0)})
    keys = ["_shard", "_block", "_salt"]
    # a heavy entity's blocks are groups of their own; all other entities share block 0 of their shard
    f = f.select("_e", "_known", "_valid", "_seq", "_pay", home, "_block", "_salt")
    ready = e.where("_e is not null and _q is not null").select(*columns, "_e", "_q", home, "_block", "_salt")
    rest = e.where("_e is null or _q is null").select(*columns, F.lit(None).cast("string").alias(out))
    schema = T.StructType([*ready.schema.fields, T.StructField(out, T.StringType())])

    def find(events_pdf: pd.DataFrame, facts_pdf: pd.DataFrame) -> pd.DataFrame:
        return events_pdf.assign(**{out: _search(events_pdf, facts_pdf)})

    done = rest
    while True:
        found = ready.groupBy(*keys).cogroup(f.groupBy(*keys)).applyInPandas(find, schema)
        if not has_heavy:
            return done.unionByName(found.select(*columns, out))
        found = materialize(found, "known-round")
        open_ = found.where(F.col(out).isNull() & (F.col("_block") > 0))
        done = done.unionByName(found.where(F.col(out).isNotNull() | (F.col("_block") == 0)).select(*columns, out))
        if open_.isEmpty():
            return done
        ready = open_.drop(out).withColumn("_block", F.col("_block") - 1)


def predictions_as_known(predictions: DataFrame, annotations: DataFrame, eligibility: DataFrame, hot: int = 200_000) -> DataFrame:
    """Every prediction released, with the annotation and the eligibility decision known strictly before; 'none' where none."""
    p = predictions.where("released_at is not null").select("content_hash", "model_revision", F.unix_micros("released_at").alias("at_us"))
    a = annotations.select("content_hash", F.unix_micros("label_available_at").alias("known"), "seq_no", "decision_id")
    g = eligibility.select("content_hash", F.unix_micros("data_available_at").alias("known"), "seq_no", "decision_id")
    r = as_known(p, a, "content_hash", "at_us", "known", "known", "seq_no", "decision_id", "annotation_decision_id", hot)
    r = as_known(r, g, "content_hash", "at_us", "known", "known", "seq_no", "decision_id", "eligibility_decision_id", hot)
    return r.select("content_hash", "model_revision", F.coalesce("annotation_decision_id", F.lit("none")).alias("annotation_decision_id"), F.coalesce("eligibility_decision_id", F.lit("none")).alias("eligibility_decision_id"))
