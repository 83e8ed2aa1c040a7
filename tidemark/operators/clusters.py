"""Forward-only clusters: every row points to its best earlier match or to none; roots by pointer jumping.

The best earlier match depends on pairwise facts only (window, score, polarity conflict, tie by arrival), so parents are
found by one candidate join and later rows never change earlier clusters. Candidates share a rare element of
their prefixes (prefix filter: no pair above the threshold is lost, no pair below is built in bulk).

Defined results: null titles have no candidates; rows without available_at are left out; ties go to the earlier row.
"""
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.text import conflict, jaccard, profile, shingles_of, tokens
from tidemark.operators.rarity import by_rarity, common_elements
from tidemark.shared import discard, get_bytes, materialize, put_bytes, scratch

ORDER = ["available_at", "observed_at", "version_id"]


def similar_rows(df: DataFrame, ident: str, elems: str, threshold: float, side: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """a, b, score, and c_a, c_b of each column c to keep: all pairs with Jaccard >= threshold (a < b), exact; with `side` only pairs of
    two sides, `a` on the lesser one. Callers fold equal sets first (folded), so that copies make no pairs.

    Rows go by number and elements as 64-bit hashes, so that neither names nor words are shuffled. Alike rows share one of the rarest
    n - ceil(threshold n) + 1 elements of each; at the first shared one, what is left of both bounds what they can share, which
    drops most meetings before pairs are formed.
    """
    rows = df.select(F.col(ident).alias("id"), *keep, (F.col(side) if side else F.lit(0)).alias("side"), F.transform(elems, lambda x: F.xxhash64(x)).alias("elems"))
    rows = materialize(rows.where(F.size("elems") > 0).withColumn("k", F.monotonically_increasing_id()), "similar")
    place = scratch(df.sparkSession, "common")
    put_bytes(place, common_elements(rows).tobytes())

    def prefixes(batches):
        table = np.frombuffer(get_bytes(place), np.int64).reshape(2, -1)
        for pdf in batches:
            if not len(pdf):
                continue
            flat, offsets = by_rarity(list(pdf["elems"]), table)
            sizes = np.diff(offsets)
            take = sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1
            of = np.repeat(np.arange(len(pdf)), take)
            at = np.arange(len(of)) - np.repeat(np.cumsum(take) - take, take)
            yield pd.DataFrame({"key": flat[offsets[of] + at], "k": pdf["k"].to_numpy()[of], "n": sizes[of], "left": sizes[of] - at, "side": pdf["side"].to_numpy()[of]})

    keys = rows.select("k", "side", "elems").mapInPandas(prefixes, f"key long, k long, n int, left int, side {dict(rows.dtypes)['side']}")
    one, two = (keys.select("key", *[F.col(c).alias(c + x) for c in ("k", "n", "left", "side")]) for x in "ab")
    order = F.col("sidea") < F.col("sideb") if side else F.col("ka") < F.col("kb")
    enough = F.least("lefta", "leftb") >= threshold / (1 + threshold) * (F.col("na") + F.col("nb")) - 1e-6
    met = one.join(two, "key").where(order & enough).select("ka", "kb").distinct()
    sets = lambda x: rows.select(F.col("k").alias("k" + x), F.col("elems").alias("e" + x))
    full = met.join(sets("a"), "ka").join(sets("b"), "kb").withColumn("score", jaccard(F.col("ea"), F.col("eb")))
    pairs = full.where(F.col("score") >= threshold).select("ka", "kb", "score")
    named = lambda x: rows.select(F.col("k").alias("k" + x), F.struct("id", *keep).alias("r" + x))
    pairs = pairs.join(named("a"), "ka").join(named("b"), "kb")
    if not side:
        swap = F.col("ra.id") > F.col("rb.id")
        pairs = pairs.select("score", F.when(swap, F.col("rb")).otherwise(F.col("ra")).alias("ra"), F.when(swap, F.col("ra")).otherwise(F.col("rb")).alias("rb"))
    return pairs.select(F.col("ra.id").alias("a"), F.col("rb.id").alias("b"), "score", *[F.col(f"r{x}.{c}").alias(f"{c}_{x}") for c in keep for x in "ab"])


def overlapping_rows(df: DataFrame, ident: str, elems: str, threshold: float) -> DataFrame:
    """a, b, score as of similar_rows, for low thresholds, where the result is itself about the square of the rows: no pair is ever moved.
    Each row goes with its set to the keys of its prefix, and a pair is judged and returned at the first element it shares."""
    rows = df.select(F.col(ident).alias("id"), F.transform(elems, lambda x: F.xxhash64(x)).alias("elems")).where(F.size("elems") > 0)
    rows = materialize(rows, "overlapping")
    place = scratch(df.sparkSession, "common")
    put_bytes(place, common_elements(rows).tobytes())

    def sort(batches):
        table = np.frombuffer(get_bytes(place), np.int64).reshape(2, -1)
        for pdf in batches:
            flat, offsets = by_rarity(list(pdf["elems"]), table)
            yield pd.DataFrame({"id": pdf["id"], "e": np.split(flat, offsets[1:-1]) if len(pdf) else []})

    n = F.size("e")
    keys = rows.mapInPandas(sort, "id string, e array<long>").withColumn("key", F.explode(F.slice("e", F.lit(1), (n - F.ceil(threshold * n - 1e-9) + 1).cast("int"))))
    one, two = (keys.select("key", F.col("id").alias(x), F.col("e").alias("e" + x)) for x in "ab")
    enough = F.least(F.size("ea"), F.size("eb")) >= threshold * F.greatest(F.size("ea"), F.size("eb")) - 1e-9
    shared = F.array_intersect("ea", "eb")
    met = one.join(two, "key").where((F.col("a") < F.col("b")) & enough).withColumn("shared", shared).where(F.get("shared", F.lit(0)) == F.col("key"))
    score = F.size("shared").cast("double") / (F.size("ea") + F.size("eb") - F.size("shared"))
    return met.select("a", "b", score.alias("score")).where(F.col("score") >= threshold)


def folded(df: DataFrame, ident: str, elems: str, text: str, *by: str) -> DataFrame:
    """One row per distinct element set (and columns `by`): the least ident, a text that has the set, copies. The text is moved
    in the set's place, as it is the smaller."""
    return df.groupBy(*by, set_id(F.col(elems)).alias("_set")).agg(F.min(ident).alias(ident), F.first(text).alias(text), F.count(F.lit(1)).alias("copies")).drop("_set")


def set_id(value: Column) -> Column:
    """128 bits that name an array or struct."""
    return F.unhex(F.md5(F.to_json(value)))


def jump(parents: DataFrame) -> DataFrame:
    """Adds root to rows of version_id, parent (null: root): doubling until nothing moves. Only rows with a parent are moved about."""
    cur = materialize(parents.where("parent is not null").select("version_id", F.col("parent").alias("root")), "roots")
    while True:
        up = cur.select(F.col("version_id").alias("root"), F.col("root").alias("next"))
        new = materialize(cur.join(up, "root", "left").select("version_id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(cur)
        cur = new.select("version_id", "root")
        if new.where("moved").isEmpty():
            return parents.join(cur, "version_id", "left").withColumn("root", F.coalesce("root", "version_id"))


def earliest_of_class(info: DataFrame, alike: DataFrame, window_hours: int) -> DataFrame:
    """version_id, parent, score: of the rows (version_id, t, o, class c) that ask, the best earlier row of the window in a class that is
    alike (a asks, b answers, score): highest score, then earliest. A frame over each pair of classes and day finds a class's
    earliest row, so copies never meet in pairs and no group is larger than two days of two classes."""
    span = window_hours * 3_600_000_000
    day = F.floor(F.col("t") / span)
    asks = info.where("asks").select(F.col("c").alias("a"), "version_id", "t", "o").join(alike, "a").withColumns({"day": day, "asking": F.lit(True)})
    held = info.select(F.col("c").alias("b"), "version_id", "t", "o").join(alike, "b").withColumns({"day": F.explode(F.array(day, day + 1)), "asking": F.lit(False)})
    columns = ["a", "b", "score", "t", F.struct("t", "o", "version_id").alias("me"), "day", "asking"]
    both = asks.select(columns).unionByName(held.select(columns))
    frame = Window.partitionBy("a", "b", "day").orderBy("t").rangeBetween(-span, 0)
    first = both.withColumn("first", F.min(F.when(~F.col("asking"), F.col("me"))).over(frame)).where(F.col("asking") & (F.col("first") < F.col("me")))
    best = first.groupBy(F.col("me.version_id").alias("version_id")).agg(F.min_by(F.struct("first.version_id", "score"), F.struct(-F.col("score"), "first")).alias("best"))
    return best.select("version_id", F.col("best.version_id").alias("parent"), "best.score")


def best_earlier(rows: DataFrame, method: str, threshold: float, window_hours: int) -> DataFrame:
    """version_id, parent, score of the rows (version_id, title, t, o, asks) that ask and have an alike earlier title (exact: equal squeezed
    lower-case title; lexical: shingle Jaccard) in the window without polarity conflict.

    Titles are folded to classes. Two classes whose spans lie more than the window apart, or that have one row between
    them, can't answer each other: such pairs end before any row is joined to them.
    """
    title = F.col("title")
    value = F.array_join(F.filter(F.split(F.lower(title), r"\s+"), lambda w: w != ""), " ") if method == "exact" else shingles_of(F.col("w"))
    info = rows.where(title.isNotNull()).withColumn("w", tokens(title)).withColumns({"p": profile(F.col("w")), "e": value})
    info = info if method == "exact" else info.where(F.size("e") > 0)
    info = materialize(info.select("version_id", "t", "o", "title", "p", "asks", set_id(F.struct("e", "p")).alias("c")), "cluster-info")
    span = [F.min("t").alias("since"), F.max("t").alias("until")]
    copies = info.groupBy("c").agg(F.first("p").alias("p"), F.count(F.lit(1)).alias("n")).where("n > 1")
    alike = copies.where(~conflict(F.col("p"), F.col("p"))).select(F.col("c").alias("a"), F.col("c").alias("b"), F.lit(1.0).alias("score"))
    if method == "lexical":
        classes = info.groupBy("c").agg(F.first("title").alias("title"), F.first("p").alias("p"), *span).withColumn("w", tokens(title)).withColumn("e", shingles_of(F.col("w"))).drop("w")
        pairs = similar_rows(classes, "c", "e", threshold, keep=("p", "since", "until"))
        pairs = materialize(pairs.where(~conflict(F.col("p_a"), F.col("p_b"))).drop("p_a", "p_b"), "cluster-pairs")
        back = pairs.toDF("b", "a", "score", "since_b", "since_a", "until_b", "until_a")
        met = (F.col("since_b") <= F.col("until_a")) & (F.col("until_b") >= F.col("since_a") - window_hours * 3_600_000_000)
        alike = alike.unionByName(pairs.unionByName(back).where(met).select("a", "b", "score"))
    return earliest_of_class(info, materialize(alike, "cluster-alike"), window_hours)


def find_parents(rows: DataFrame, method: str = "lexical", threshold: float = 0.75, window_hours: int = 24) -> DataFrame:
    """version_id, parent (null: starts a cluster) by the rule of assign_clusters."""
    if method not in ("article", "exact", "lexical") or not 0 < threshold <= 1 or window_hours <= 0:
        raise ValueError("unknown method, threshold or window")
    r = rows.where("version_id is not null and available_at is not null")
    r = materialize(r.select("version_id", "article_id", "title", F.unix_micros("available_at").alias("t"), F.coalesce(F.unix_micros("observed_at"), F.lit(-(2**62))).alias("o")), "cluster-rows")
    family = Window.partitionBy("article_id").orderBy("t", "o", "version_id")
    known = r.where("article_id is not null").withColumn("first", F.first("version_id").over(family))
    parents = known.where("first <> version_id").select("version_id", F.col("first").alias("parent"))
    if method != "article":
        asking = known.withColumn("asks", F.col("first") == F.col("version_id")).drop("first").unionByName(r.where("article_id is null").withColumn("asks", F.lit(True)))
        parents = parents.unionByName(best_earlier(asking, method, threshold, window_hours).select("version_id", "parent"))
    return materialize(r.select("version_id").join(parents, "version_id", "left"), "parents")


def assign_clusters(rows: DataFrame, method: str = "lexical", threshold: float = 0.75, window_hours: int = 24) -> DataFrame:
    """rows: version_id (unique), article_id, title, available_at, observed_at. Returns version_id, parent, cluster_id.

    A row joins its article's earlier rows first; else the best earlier row in the window (exact: equal squeezed
    lower-case title; lexical: shingle Jaccard) that has no polarity conflict with it; else it starts a cluster.
    """
    return jump(find_parents(rows, method, threshold, window_hours)).select("version_id", "parent", F.col("root").alias("cluster_id"))
