"""Filling fixed-capacity containers: bulk-synchronous best fit over range-sorted documents and gaps.

Documents are sorted by size, largest first, and ranked within their size (distributed). One sweep per size matches
all documents of that size at once with the smallest gaps that hold them (the successor in the sorted gaps): document of rank r
takes the r-th such gap, so no two documents meet in one gap; gaps are updated and the next smaller size sweeps.
Gaps are runs of containers of equal gap. A sweep splits at most one run and opens at most two, so there are at most 3 x
capacity runs whatever the number of documents; this plan is all the driver holds. Documents find their container by rank in the plan.

Defined results: a document longer than the capacity is cut into full pieces and a rest; no other is cut; null and
empty texts have 0 tokens and lie in container 0; a repeated doc_id with the same size is one item each time.
"""
import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tokens import VOCABULARY, ranked, token_count
from tidemark.shared import get_bytes, materialize, put_bytes, scratch

CAPACITY = 2048


def plan_sweeps(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Segments (size, first rank, documents, first container, documents per container) and the containers used."""
    segments, gaps, open_gaps, used = [], {}, [], 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                bisect.insort(open_gaps, gap)
                gaps[gap] = []
            gaps[gap].append((first, n))

    for size in sorted((s for s in counts if s > 0), reverse=True):
        left, rank = counts[size], 0
        while left:
            i = bisect.bisect_left(open_gaps, size)
            if i < len(open_gaps):
                gap = open_gaps[i]
                first, n = gaps[gap].pop()
                take = min(n, left)
                if n > take:
                    gaps[gap].append((first + take, n - take))
                if not gaps[gap]:
                    del gaps[gap], open_gaps[i]
                segments.append((size, rank, take, first, 1))
                put(gap - size, first, take)
            else:
                per = capacity // size
                n = max(1, left // per)
                take = min(left, n * per)
                segments.append((size, rank, take, used, per))
                put(capacity - size * (take // n), used, n)
                used += n
            left, rank = left - take, rank + take
    return np.array(segments, np.int64).reshape(-1, 5), used


def pieces(docs: DataFrame, capacity: int) -> DataFrame:
    """docs: doc_id, n_tokens -> doc_id, piece, start_token, size; only a text longer than the capacity is cut."""
    last = F.greatest(F.ceil(F.col("n_tokens") / capacity) - 1, F.lit(0)).cast("int")
    p = docs.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    return p.select("doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("start_token"), F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - F.col("piece").cast("long") * capacity).alias("size"))


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start_token, n_tokens, container_id for docs with doc_id, n_tokens."""
    spark = docs.sparkSession
    items = materialize(pieces(docs, capacity).withColumn("key", F.struct("doc_id", "piece")), "pieces")
    counts = {int(r["size"]): int(r["n"]) for r in items.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # <= capacity + 1 rows
    segments, _ = plan_sweeps(counts, capacity)
    segments = segments[np.lexsort((segments[:, 1], segments[:, 0]))]
    place = scratch(spark, "sweeps")
    put_bytes(place, segments.tobytes())

    def assign(batches):
        seg = np.frombuffer(get_bytes(place), np.int64).reshape(-1, 5)
        for pdf in batches:
            size, rank = pdf["size"].to_numpy(), pdf["rank"].to_numpy()
            container = np.zeros(len(pdf), np.int64)
            for s in np.unique(size[size > 0]):
                a, b = np.searchsorted(seg[:, 0], s, "left"), np.searchsorted(seg[:, 0], s, "right")
                here = size == s
                i = a + np.searchsorted(seg[a:b, 1], rank[here], "right") - 1
                container[here] = seg[i, 3] + (rank[here] - seg[i, 1]) // seg[i, 4]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "piece": pdf["piece"], "start_token": pdf["start_token"], "n_tokens": size, "container_id": container})

    return ranked(items, ["size"], "key").select("doc_id", "piece", "start_token", "size", "rank").mapInPandas(assign, "doc_id long, piece int, start_token long, n_tokens long, container_id long")


def sized(documents: DataFrame, path: str = VOCABULARY, *extra: str) -> DataFrame:
    return materialize(documents.select("doc_id", *extra, token_count(F.col("text"), path).alias("n_tokens")), "sized")


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, path: str = VOCABULARY) -> DataFrame:
    return pack(sized(documents, path), capacity)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """containers, tokens, fill (share of room used), least_containers (by volume)."""
    per = packed.where("n_tokens > 0").groupBy("container_id").agg(F.sum("n_tokens").alias("t"))
    return per.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"), F.max("t").alias("fullest")).select(
        "containers", "tokens", "fullest", F.try_divide("tokens", F.col("containers") * capacity).alias("fill"), F.ceil(F.col("tokens") / capacity).alias("least_containers"))
