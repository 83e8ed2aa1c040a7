"""Token counts by a public byte-level BPE vocabulary; its file is a parameter and is shipped to the executors."""
import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the vocabulary's public split pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKET_ROWS = 50_000  # rows that one task ranks, about
_loaded: dict = {}
_shipped: set = set()


def encoding(path: str = VOCABULARY):
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _loaded[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """Tokens of the whole text; 0 for null and empty texts."""
    context = SparkSession.active().sparkContext
    if (context.applicationId, path) not in _shipped:
        context.addFile(path)
        _shipped.add((context.applicationId, path))
    name = os.path.basename(path)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(SparkFiles.get(name))
        for texts in batches:
            yield pd.Series([0 if not t else len(enc.encode_ordinary(t)) for t in texts], dtype="int64")

    return count(text)


def ranked(df: DataFrame, group: list[str], order: str) -> DataFrame:
    """Adds rank (from 0) within the group, ordered by (hash bucket of `order`, `order`), without one task per group:
    buckets are ranked apart and offset by the counts before them (at most groups x buckets rows). Their number follows
    the rows, so that the bucket of a group with all rows stays small. df is read three times: write it before."""
    buckets = max(16, -(-df.count() // BUCKET_ROWS))
    b = df.withColumn("_b", F.pmod(F.xxhash64(order, F.lit(101)), F.lit(buckets)).cast("int"))
    counts = b.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*group, "_b").orderBy(order)
    return b.withColumn("_r", F.row_number().over(within)).join(offsets, [*group, "_b"]).withColumn("rank", F.col("_r") - 1 + F.col("_before")).drop("_b", "_r", "_before")
