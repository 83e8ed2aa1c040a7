"""Point-in-time reads: what was visible at a cut-off. As-of reads include the cut-off, release reads exclude it.

Defined results: null visibility times are never visible; null flags and null filters' columns never pass; ties in
every top-k go to the smaller id; empty tables give empty results.
"""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def visible(at: Column, cutoff: str) -> Column:
    """Inclusive: visible at the cut-off itself."""
    return at <= F.timestamp_micros(F.lit(micros(cutoff)))


def released(at: Column, cutoff: str) -> Column:
    """Exclusive: released before the cut-off."""
    return at < F.timestamp_micros(F.lit(micros(cutoff)))


def micros(text: str) -> int:
    from datetime import datetime, timezone

    at = datetime.fromisoformat(text)
    if at.tzinfo is None:
        raise ValueError("a cut-off needs an offset")
    return int((at - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() * 1_000_000)


def news_as_of(news: DataFrame, cutoff: str, source: str | None = None, ticker: str | None = None, only_canonical: bool = False) -> DataFrame:
    # both bounds are written out so that they reach the scan; the computed maximum alone would not
    by = lambda c: F.col(c).isNull() | visible(F.col(c), cutoff)
    out = news.where(by("event_time") & by("ingested_time")).withColumn("effective_time", F.greatest("event_time", "ingested_time")).where(F.col("effective_time").isNotNull())
    if only_canonical:
        out = out.where(F.col("is_near_duplicate") == F.lit(False))
    if source:
        out = out.where(F.col("source") == source.upper())
    if ticker:
        out = out.where(F.array_contains("tickers_mentioned", ticker.upper()))
    return out


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """First row per key in the given order; ranks are limited before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def first_writer(incoming: DataFrame, stored: DataFrame | None, key: str, *order: Column) -> DataFrame:
    """Rows that a first-write-wins table takes: the first of each key, unless the key is stored already."""
    firsts = latest(incoming.where(F.col(key).isNotNull()), [key], *order)
    return firsts if stored is None else firsts.join(stored.select(key), key, "left_anti")


def vector_top_k(df: DataFrame, ident: str, vector: str, query: list[float], k: int) -> DataFrame:
    from tidemark.functions.vectors import cosine

    score = F.round(cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query])), 6)
    return df.select(ident, score.alias("score")).where("score is not null").orderBy(F.desc("score"), ident).limit(k)


def hash_sample(df: DataFrame, ident: str, group: str, seed: str, quota: int) -> DataFrame:
    """The `quota` rows of each group with the least seeded SHA-256: reproducible whatever the partitioning."""
    ranked = df.withColumn("priority", F.sha2(F.concat(F.lit(seed + ":"), F.col(ident).cast("string")), 256))
    w = Window.partitionBy(group).orderBy("priority", ident)
    return ranked.withColumn("r", F.row_number().over(w)).where(F.col("r") <= quota)
