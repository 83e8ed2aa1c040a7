"""Mixing sources to target weights by subset-sum budget fitting on exact token lengths.

The mix holds half the tokens of all documents. A source's budget is its target share of that, at most max_repeats
times its own tokens; what capped sources cannot give goes to the others in proportion to their shares, so the
mix keeps its size where the sources allow. Per source, documents are counted by exact length; whole passes
come first, then a proportional number of uses per length, of which a few are given back, then a bounded-knapsack dynamic
programme over all uses that max_repeats still allows meets the remaining budget. Documents are chosen within a length by seeded
hash order, and a second use of one comes after the first use of all others of its length.

The histogram of a source is one small group (distinct lengths, at most the square root of twice its tokens); the
documents are ranked in hash buckets, so a source or length with a third of all rows is never one task.

Defined results: documents of sources without target, or of null source, count towards the half and are not used;
empty texts add nothing and are left out; a target without documents, null share or null repeats gets nothing;
repeated target rows: the largest share holds.
"""
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.packing import sized
from tidemark.llm.tokens import VOCABULARY, ranked
from tidemark.shared import materialize

WINDOW = 20_000  # tokens that the dynamic programme has to meet at most, beyond the longest document
PLAN = "source string, n_tokens long, base int, extra long, n long"


def budgets(total: int, shares: dict[str, float], capacity: dict[str, int]) -> dict[str, int]:
    """Target tokens per source; capped ones give their rest to the others in proportion."""
    open_, fixed = {s for s in shares if shares[s] > 0 and capacity.get(s, 0) > 0}, {}
    while open_:
        rest, weight = total - sum(fixed.values()), sum(shares[s] for s in open_)
        over = {s for s in open_ if rest * shares[s] / weight >= capacity[s]}
        if not over:
            exact = {s: rest * shares[s] / weight for s in open_}
            fixed |= {s: int(exact[s]) for s in open_}
            for s in sorted(open_, key=lambda s: (int(exact[s]) - exact[s], s))[: total - sum(fixed.values())]:
                fixed[s] += 1
            break
        fixed |= {s: capacity[s] for s in over}
        open_ -= over
    return {s: fixed.get(s, 0) for s in shares}


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int, repeats: int = 1) -> np.ndarray:
    """How many uses of documents of each length (at most `repeats` of each document) meet the budget as closely as possible, never
    beyond."""
    take = (counts * (budget / max(1, int((lengths * counts).sum())))).astype(np.int64)
    left, rest = counts * repeats - take, budget - int((lengths * take).sum())
    order = np.random.default_rng(seed).permutation(len(lengths))
    for i in order:  # what proportion has fixed too early: one use of a length, until there is room to combine
        if take[i] and rest < WINDOW // 4:
            take[i] -= 1
            left[i] += 1
            rest += int(lengths[i])
    moved = True
    while rest > WINDOW and moved:  # seeded single uses until the remaining budget is small
        moved = False
        for i in order:
            if left[i] and lengths[i] <= rest - WINDOW // 2:
                take[i] += 1
                left[i] -= 1
                rest -= int(lengths[i])
                moved = True
    mask, reach, steps = (1 << (rest + 1)) - 1, 1, []
    for i in order:
        room, part = min(int(left[i]), rest // int(lengths[i])), 1
        while room and not reach >> rest & 1:
            n = min(part, room)
            steps.append((i, n, reach))
            reach = (reach | reach << n * int(lengths[i])) & mask
            room, part = room - n, part * 2
        if reach >> rest & 1:
            break
    at = reach.bit_length() - 1
    for i, n, before in reversed(steps):
        if not before >> at & 1:
            take[i] += n
            at -= n * int(lengths[i])
    return take


def mix(docs: DataFrame, targets: DataFrame, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """docs: doc_id, source, n_tokens (written). Returns (doc_id, source, n_tokens, uses) and the report per source."""
    spark = docs.sparkSession
    wanted = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    total = (docs.agg(F.sum("n_tokens").alias("t")).first()["t"] or 0) // 2
    own = docs.where("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"))
    rows = wanted.join(own, "source", "left").collect()  # one row per target
    have = {r["source"]: int(r["source_tokens"] or 0) for r in rows}
    shares = {r["source"]: float(r["target_share"] or 0) for r in rows}
    goal = budgets(total, shares, {r["source"]: have[r["source"]] * int(r["max_repeats"] or 0) for r in rows})
    allowed = {r["source"]: int(r["max_repeats"] or 0) for r in rows}
    table = spark.createDataFrame([(s, goal[s], have[s], allowed[s]) for s in goal], "source string, goal long, source_tokens long, allowed int")
    used = docs.where("n_tokens > 0").join(F.broadcast(table.select("source")), "source", "left_semi")
    histogram = used.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(table), "source")

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n_tokens")
        lengths, counts, all_ = pdf["n_tokens"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), int(pdf["source_tokens"].iloc[0])
        base, rest = divmod(int(pdf["goal"].iloc[0]), all_)
        extra = np.zeros(len(lengths), np.int64)
        for repeats in range(1, int(pdf["allowed"].iloc[0]) - base + 1):  # no more repeats than the budget needs
            tried = fit_budget(lengths, counts, rest, seed, repeats)
            if (lengths * tried).sum() > (lengths * extra).sum():
                extra = tried
            if (lengths * extra).sum() == rest:
                break
        return pd.DataFrame({"source": key[0], "n_tokens": lengths, "base": base, "extra": extra, "n": counts})

    plan = histogram.groupBy("source").applyInPandas(fit, PLAN)
    seeded = used.select("doc_id", "source", "n_tokens", F.xxhash64("doc_id", F.lit(seed)).alias("h")).withColumn("key", F.struct("h", "doc_id"))
    uses = F.col("base") + F.floor(F.col("extra") / F.col("n")).cast("int") + (F.col("rank") < F.col("extra") % F.col("n")).cast("int")
    chosen = ranked(seeded, ["source", "n_tokens"], "key").join(plan, ["source", "n_tokens"]).select("doc_id", "source", "n_tokens", uses.alias("uses")).where("uses > 0")
    chosen = materialize(chosen, "mix")
    actual = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("t"), F.count(F.lit(1)).alias("documents"), F.max("uses").alias("most_uses"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    mixed = sum(int(r["t"]) for r in actual.select("t").collect())  # one row per target
    report = (wanted.join(F.broadcast(table), "source", "left").join(actual, "source", "left")
              .select("source", "target_share", (F.coalesce("t", F.lit(0)) / F.lit(max(1, mixed))).alias("actual_share"), F.col("goal").alias("goal_tokens"),
                      F.coalesce("t", F.lit(0)).alias("actual_tokens"), "source_tokens", "max_repeats", zero("most_uses"), zero("documents"), F.lit(total).cast("long").alias("mix_tokens")))
    return chosen, report


def mix_documents(documents: DataFrame, targets: DataFrame, seed: int = 17, path: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    return mix(sized(documents, path, "source"), targets, seed)
