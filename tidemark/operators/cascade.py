"""Semantic neighbours in a sliding window, and the cascade of exact, lexical and semantic duplicate tiers.

The window of a row holds the rows of the last two hours; a search may ask for the newest `cap` of them only (jn14), the cascade
takes them all. Rows in order of arrival are written to block files of 1,000, each vector once, by the blocks' first rows (one in
1,000, on the driver). A block meets itself and every block before it that its first row's window reaches: one matrix product
for two blocks, a few such meetings a task, so that a task holds two blocks however many rows arrive at once. Of its
meetings the cascade keeps one partner a row, never the pairs.

Defined results: rows without usable vector have no semantic neighbours; filings and empty titles skip the lexical and
semantic tiers; ties in score go to the smaller id; null arrival times are left out.
"""
import io
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyarrow import feather
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.text import conflict_bits, entities, profile, tokens
from tidemark.operators.clusters import find_parents, jump
from tidemark.shared import discard, get_bytes, get_json, materialize, put_bytes, put_json, scratch

BLOCK = 1000
HOUR_US = 3_600_000_000


def arrival_rank(df: DataFrame, at: str = "t", ident: str = "id") -> DataFrame:
    """Adds rank (from 0) in the order of (at, id): ranks within hours, offset by the hours before (one row per hour)."""
    d = df.withColumn("_hour", F.floor(F.col(at) / HOUR_US))
    hours = d.groupBy("_hour").agg(F.count(F.lit(1)).alias("_n"))
    before = hours.select("_hour", F.coalesce(F.sum("_n").over(Window.orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return d.withColumn("_r", F.row_number().over(Window.partitionBy("_hour").orderBy(at, ident))).join(before, "_hour").withColumn("rank", F.col("_r") - 1 + F.col("_before")).drop("_hour", "_r", "_before")


def meetings(times: list[int], window_us: int, reach: int | None = None) -> list[list[tuple[int, int, int]]]:
    """Tasks of (block, first, last): the blocks, by the times of their first rows, that each one meets; `reach` bounds how far back."""
    pairs = []
    for b, t in enumerate(times):
        first = max(bisect_right(times, t - window_us) - 1, 0 if reach is None else b - reach, 0)  # its end may be held
        pairs.append((first, b + 1 - first))
    most = max(8, sum(n for _, n in pairs) // 4096)
    tasks, room = [[]], most
    for b, (first, left) in enumerate(pairs):
        while left:
            if not room:
                tasks.append([])
                room = most
            n = min(left, room)
            tasks[-1].append((b, first, first + n - 1))
            first, left, room = first + n, left - n, room - n
    return tasks


def meet(rows: DataFrame, judge, schema: str, threshold: float, window_s: int, cap: int | None, block: int) -> DataFrame:
    """What judge(asking block, [(held block, score, near)]) returns, where near marks the pairs within window, cap and threshold."""
    spark, window_us = rows.sparkSession, window_s * 1_000_000
    own = materialize(rows.where("t is not null and v is not null"), "window-rows")
    starts = sorted((r["t"], r["id"]) for r in arrival_rank(own.select("id", "t")).where(F.col("rank") % block == 0).collect())
    place = scratch(spark, "window-blocks")
    put_json(f"{place}/starts", starts)

    def spread(batches):
        starts = [tuple(x) for x in get_json(f"{place}/starts")]
        for pdf in batches:
            yield pdf.assign(block=[bisect_right(starts, x) - 1 for x in zip(pdf["t"], pdf["id"])])

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        feather.write_feather(pdf.drop(columns="block").sort_values(["t", "id"]).reset_index(drop=True), out, compression="uncompressed")
        put_bytes(f"{place}/{pdf['block'].iat[0]}", out.getvalue())
        return pd.DataFrame({"n": [len(pdf)]})

    def read(b: int) -> pd.DataFrame:
        pdf = feather.read_feather(io.BytesIO(get_bytes(f"{place}/{b}")))
        return pdf.assign(rank=b * block + np.arange(len(pdf)))

    def unit(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        n = np.linalg.norm(x, axis=1)
        return pdf[n > 0].drop(columns="v").reset_index(drop=True), x[n > 0] / n[n > 0, None]

    def held(q: pd.DataFrame, x: np.ndarray, since: int, blocks):
        for b in blocks:
            pdf = read(b)
            pdf = pdf[pdf["t"] > since]
            if len(pdf):
                h, y = unit(pdf)
                score = np.round(x @ y.T, 6)
                rank, t, of, at = h["rank"].to_numpy(), h["t"].to_numpy(), q["rank"].to_numpy()[:, None], q["t"].to_numpy()[:, None]
                near = (score >= threshold) & (rank < of) & (t > at - window_us)
                yield h, score, near if cap is None else near & (rank >= of - cap)

    def search(batches):
        tasks = get_json(f"{place}/tasks")
        for k in (k for pdf in batches for k in pdf["id"]):
            for b, first, last in tasks[k]:
                pdf = read(b)
                q, x = unit(pdf)
                yield judge(q, held(q, x, pdf["t"].iat[0] - window_us, range(first, last + 1)))

    kinds = ", ".join(f"{c} {kind}" for c, kind in own.dtypes)
    own.mapInPandas(spread, f"{kinds}, block long").groupBy("block").applyInPandas(write, "n long").agg(F.sum("n")).collect()
    discard(own)
    tasks = meetings([t for t, _ in starts], window_us, None if cap is None else -(-cap // block))
    put_json(f"{place}/tasks", tasks)
    return spark.range(0, len(tasks), 1, len(tasks)).mapInPandas(search, schema)


def window_neighbours(rows: DataFrame, threshold: float = 0.76, window_s: int = 7200, cap: int | None = None, block: int = BLOCK) -> DataFrame:
    """rows: id, t (microseconds), v (array<float>, equal lengths). a (earlier), b, score for pairs in the window, or among its newest `cap`."""

    def judge(q, others):
        a, b, scores = [np.array([], object)], [np.array([], object)], [np.array([])]
        for h, score, near in others:
            i, j = np.nonzero(near)
            a.append(h["id"].to_numpy(object)[j])
            b.append(q["id"].to_numpy(object)[i])
            scores.append(score[i, j])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b), "score": np.concatenate(scores)})

    return meet(rows.select("id", "t", "v"), judge, "a string, b string, score double", threshold, window_s, cap, block)


def sharing(one: pd.Series, two: pd.Series, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For one[i], two[j]: have the sets an element in common, or is one of them empty."""
    numbers: tuple[dict, dict] = {}, {}
    p, r = (np.array([known.setdefault(frozenset(e), len(known)) for e in sets], np.int64) for known, sets in zip(numbers, (one, two)))
    left, right = map(list, numbers)
    pairs, of = np.unique(p[i] * len(right) + r[j], return_inverse=True)
    return np.array([not x or not y or not x.isdisjoint(y) for x, y in ((left[k // len(right)], right[k % len(right)]) for k in pairs)], bool)[of]


def best_in_window(rows: DataFrame, threshold: float = 0.76, window_s: int = 7200, block: int = BLOCK) -> DataFrame:
    """rows: id, t, v, against and said (conflict_bits), e (entities). b, a, score: the best earlier row of the whole window without polarity
    conflict and with a common entity, where both have any: highest score, then smallest id."""

    def judge(q, others):
        best, who = np.full(len(q), -np.inf), np.full(len(q), "", object)
        for h, score, near in others:
            i, j = np.nonzero(near)
            clash = (q["against"].to_numpy()[i] & h["said"].to_numpy()[j]) | (q["said"].to_numpy()[i] & h["against"].to_numpy()[j])
            i, j = i[clash == 0], j[clash == 0]
            if not len(i):
                continue
            meets = sharing(q["e"], h["e"], i, j)
            i, j = i[meets], j[meets]
            names = h["id"].to_numpy(object)
            order = np.argsort(names)
            of = np.full(score.shape, -np.inf)
            of[i, np.argsort(order)[j]] = score[i, j]
            k = of.argmax(1)  # the first of equals
            top, name = of[np.arange(len(q)), k], names[order][k]
            better = (top > best) | ((top == best) & (top > -np.inf) & (name < who))
            best, who = np.where(better, top, best), np.where(better, name, who)
        return pd.DataFrame({"a": who, "b": q["id"], "score": best})[best > -np.inf]

    found = meet(rows.select("id", "t", "v", "against", "said", "e"), judge, "a string, b string, score double", threshold, window_s, None, block)
    return found.groupBy("b").agg(F.min_by(F.struct("a", "score"), F.struct(-F.col("score"), F.col("a"))).alias("best")).select("b", "best.a", "best.score")


def cascade(news: DataFrame, vectors: DataFrame, threshold: float = 0.76) -> DataFrame:
    """id, tier (lexical, semantic or none), parent, cluster_id of every row.

    news: id (unique), source, title, t; vectors: id, v. The semantic window holds all rows of its two hours that missed the lexical tier.
    """
    n = news.where("id is not null and t is not null").select("id", "source", "title", "t")
    fuzzy = n.where("source <> 'SEC' and trim(coalesce(title, '')) <> ''")
    as_rows = fuzzy.select(F.col("id").alias("version_id"), F.lit(None).cast("string").alias("article_id"), "title", F.timestamp_micros("t").alias("available_at"), F.timestamp_micros("t").alias("observed_at"))
    lexical = materialize(find_parents(as_rows, "lexical").where("parent is not null").select(F.col("version_id").alias("id"), F.col("parent").alias("p2")), "lexical")
    missed = fuzzy.join(lexical, "id", "left_anti")
    told = missed.join(vectors, "id").where("v is not null").withColumn("w", tokens(F.col("title"))).withColumn("p", profile(F.col("w")))
    told = told.select("id", "t", "v", *conflict_bits(F.col("p")), entities(F.col("title")).alias("e"))
    semantic = best_in_window(told, threshold).select(F.col("b").alias("id"), F.col("a").alias("p3"))
    both = n.join(lexical, "id", "left").join(semantic, "id", "left")
    tier = F.when(F.col("p2").isNotNull(), "lexical").when(F.col("p3").isNotNull(), "semantic").otherwise("none")
    parents = materialize(both.select(F.col("id").alias("version_id"), tier.alias("tier"), F.coalesce("p2", "p3").alias("parent")), "tiers")
    return jump(parents).select(F.col("version_id").alias("id"), "tier", "parent", F.col("root").alias("cluster_id"))
