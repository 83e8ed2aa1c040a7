"""Near-duplicate titles: candidates by prefix, HyperMinHash screening, exact verification.

Candidates are complete: two sets whose Jaccard is at least THRESHOLD share at least that part of the larger one, so they
share an element among the first n - ceil(THRESHOLD n) + 1 of each in any order common to all sets. The order is by
rarity, so a key is a title's rarest word or pair of words and titles of one template rarely meet. At the first shared element
the places left in both sets bound what they can share, which drops most meetings before the pairs are formed.

A HyperMinHash sketch over all elements then estimates Jaccard: a register keeps the leading-zero count (6 bits) and the ten bits
behind the leading one of a minimum hash; the estimate is corrected for register collisions; pairs within MARGIN of
the threshold are verified exactly on the element sets.

Exact copies are folded first: pairs are found between distinct element sets, copies come back by membership. Keys are
equi-joined, so a hot key is split by the engine's skew handling; nothing is capped. A story with many retellings costs about
the square of their number, as its result does.

Defined results: null or wordless titles are alike to nothing; repeated ids count once.
"""
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.elements import THRESHOLD, by_rarity, class_id, common_elements, elements
from tidemark.operators.components import components
from tidemark.shared import get_bytes, materialize, put_bytes, scratch

MANTISSA = 10
ESTIMATORS = 64
MARGIN = 0.25  # 4.6 standard deviations of the estimate at the threshold


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (public splitmix constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def registers(flat: np.ndarray, starts: np.ndarray, count: int, seed: int) -> np.ndarray:
    """count registers (uint16) of every set; sets lie one after another in flat and are not empty."""
    base = _mix(flat.view(np.uint64) + np.uint64(seed))
    out = np.empty((len(starts), count), np.uint16)
    with np.errstate(over="ignore"):
        for j in range(count):
            low = np.minimum.reduceat(_mix(base + np.uint64(j + 1) * np.uint64(0x9E3779B97F4A7C15)), starts)
            zeros = (53 - np.frexp((low >> np.uint64(11)).astype(np.float64))[1]).astype(np.uint64)
            mantissa = (low << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
            out[:, j] = (zeros << np.uint64(MANTISSA)) | mantissa
    return out


def collision_rate(n: float, m: float) -> float:
    """Probability that two independent registers over n and m elements agree (leading zeros and mantissa)."""
    total, cells = 0.0, 2**MANTISSA
    for z in range(40):
        lo = 2.0 ** -(z + 1)
        p = (1 - lo) ** n - (1 - 2 * lo) ** n
        q = (1 - lo) ** m - (1 - 2 * lo) ** m
        total += p * q / cells
    return total


def corrected(matches: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimate from agreeing registers, less the agreement expected by collision."""
    chance = collision_rate(float(np.median(n)), float(np.median(m))) if len(n) else 0.0
    return np.clip((matches / ESTIMATORS - chance) / (1 - chance), 0, 1)


def title_classes(df: DataFrame, ident: str, title: str) -> tuple[DataFrame, DataFrame]:
    """members (id, cid) and classes (cid, elems), both on shared storage."""
    rows = df.where(F.col(ident).isNotNull()).select(F.col(ident).alias("id"), elements(F.col(title)).alias("elems")).where(F.size("elems") > 0)
    rows = materialize(rows.withColumn("cid", class_id(F.col("elems"))), "titles")
    return rows.select("id", "cid").distinct(), materialize(rows.groupBy("cid").agg(F.first("elems").alias("elems")), "title-classes")


def class_pairs(classes: DataFrame) -> DataFrame:
    """a, b: the class pairs with Jaccard >= THRESHOLD (a < b)."""
    spark = classes.sparkSession
    place = scratch(spark, "common")
    common = common_elements(classes)
    put_bytes(place, common.tobytes())

    def sketch(batches):
        table = np.frombuffer(get_bytes(place), np.int64).reshape(2, -1)
        for pdf in batches:
            if not len(pdf):
                continue
            flat, offsets = by_rarity(list(pdf["elems"]), table)
            sizes = np.diff(offsets)
            prefix = sizes - np.ceil(THRESHOLD * sizes).astype(np.int64) + 1
            whole = registers(flat, offsets[:-1], ESTIMATORS, 23)
            keys = [flat[at : at + k] for at, k in zip(offsets[:-1], prefix)]
            yield pd.DataFrame({"cid": pdf["cid"], "keys": keys, "sketch": [w.tobytes() for w in whole], "elems": pdf["elems"]})

    sketched = materialize(classes.mapInPandas(sketch, "cid binary, keys array<long>, sketch binary, elems array<long>"), "sketches")
    keyed = sketched.select("cid", F.size("elems").alias("n"), F.posexplode("keys").alias("place", "key"))
    one, two = (keyed.select("key", F.col("cid").alias(c), F.col("n").alias("n" + c), (F.col("n") - F.col("place")).alias("left" + c)) for c in "ab")
    # the first shared element: what is left of both, itself included, is all they can share
    enough = F.least("lefta", "leftb") >= THRESHOLD / (1 + THRESHOLD) * (F.col("na") + F.col("nb")) - 1e-6
    candidates = one.join(two, "key").where((F.col("a") < F.col("b")) & enough).select("a", "b").distinct()
    side = lambda c: sketched.select(F.col("cid").alias(c), F.col("sketch").alias("s" + c), F.col("elems").alias("e" + c))
    full = candidates.join(side("a"), "a").join(side("b"), "b")

    def verify(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            n, m = pdf["ea"].str.len().to_numpy(), pdf["eb"].str.len().to_numpy()
            sa, sb = (np.frombuffer(b"".join(pdf[c]), np.uint16).reshape(-1, ESTIMATORS) for c in ("sa", "sb"))
            guess = corrected((sa == sb).sum(1), n, m)
            near = np.flatnonzero(guess >= THRESHOLD - MARGIN)
            shared = np.array([len(frozenset(pdf["ea"].iat[i]).intersection(pdf["eb"].iat[i])) for i in near], np.int64)
            ok = shared >= THRESHOLD * (n[near] + m[near] - shared)
            yield pdf.iloc[near[ok]][["a", "b"]]

    return materialize(full.mapInPandas(verify, "a binary, b binary"), "title-pairs")


def alike_pairs(df: DataFrame, ident: str, title: str) -> DataFrame:
    """id_a, id_b of every two rows that are alike, copies included."""
    members, classes = title_classes(df, ident, title)
    pairs = class_pairs(classes)
    one, two = members.select(F.col("cid").alias("a"), F.col("id").alias("x")), members.select(F.col("cid").alias("b"), F.col("id").alias("y"))
    between = pairs.join(one, "a").join(two, "b").select("x", "y")
    copies = members.alias("l").join(members.alias("r"), "cid").where(F.col("l.id") < F.col("r.id")).select(F.col("l.id").alias("x"), F.col("r.id").alias("y"))
    both = between.unionByName(copies)
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def alike_groups(df: DataFrame, ident: str, title: str) -> DataFrame:
    """One row per document: id, group_id (least id joined by links, its own where alone), n_links (alike rows)."""
    members, classes = title_classes(df, ident, title)
    pairs = class_pairs(classes)
    sizes = members.groupBy("cid").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    links = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(sizes.select(F.col("cid").alias("b"), "n"), "b").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("linked"))
    label = components(pairs).withColumnRenamed("node", "cid")
    classed = sizes.join(label, "cid", "left").join(links, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    root = classed.groupBy("label").agg(F.min("first").alias("group_id"))
    per = classed.join(root, "label").select("cid", "group_id", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    grouped = members.join(per, "cid").select("id", "group_id", "n_links")
    alone = df.where(F.col(ident).isNotNull()).select(F.col(ident).alias("id")).distinct().join(members.select("id"), "id", "left_anti")
    return grouped.unionByName(alone.select("id", F.col("id").alias("group_id"), F.lit(0).cast("long").alias("n_links")))
