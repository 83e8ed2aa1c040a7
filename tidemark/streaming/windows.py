"""Similar titles within a sliding window, as a stream: an interval join on the bands of minimum hashes.

State holds the rows of one window and its lateness; the engine drops what can no longer meet anything. A pair may share several bands:
each comes out once, in the first band that both have in common.

Defined results: null ids, titles or times never meet; a row does not meet itself; the earlier row is `a`, ties in time go by id.
"""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import jaccard, shingles


def _banded(stream: DataFrame, side: str, lateness: str) -> DataFrame:
    """One row per band; `side` prefixes the columns."""
    rows = stream.where("id is not null and title is not null and at is not null").withWatermark("at", lateness)
    rows = rows.select("id", "at", shingles(F.col("title")).alias("e")).where(F.size("e") > 0)
    mins = F.transform(F.sequence(F.lit(0), F.lit(127)), lambda i: F.array_min(F.transform("e", lambda x: F.xxhash64(x, i))))
    rows = rows.withColumn("m", mins)
    bands = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda b: F.xxhash64(b, F.slice("m", b * 4 + 1, F.lit(4))))
    rows = rows.withColumn("bands", bands).select("id", "at", "e", "bands", F.explode("bands").alias("band"))
    return rows.select(*[F.col(c).alias(f"{side}_{c}") for c in rows.columns])


def near_in_window(left: DataFrame, right: DataFrame, threshold: float = 0.75, hours: int = 24, lateness: str = "1 hour") -> DataFrame:
    """left, right: two reads of one stream (id, title, at). a (earlier), b, score for titles at most `hours` apart."""
    near = F.expr(f"a_band = b_band AND a_at <= b_at AND b_at <= a_at + INTERVAL {hours} HOURS")
    met = _banded(left, "a", lateness).join(_banded(right, "b", lateness), near)
    once = F.element_at(F.array_intersect("a_bands", "b_bands"), 1) == F.col("a_band")
    order = (F.col("a_at") < F.col("b_at")) | (F.col("a_id") < F.col("b_id"))
    scored = met.where(once & order & (F.col("a_id") != F.col("b_id"))).withColumn("score", jaccard(F.col("a_e"), F.col("b_e")))
    return scored.where(F.col("score") >= threshold).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "score")
