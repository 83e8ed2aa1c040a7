"""Exact quantiles per group without a group in one task.

Values are counted first; `CUTS` approximate quantiles of a group's values cut it into buckets; the counts of the buckets
say which bucket holds a wanted rank, and only those buckets' values are ordered.

Defined results: null values are left out, a group without values gives no row; null keys form a group of their own.
"""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CUTS = 128


def _same(keys: list[str], prefix: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(prefix + k))
    return out


def exact_quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """keys, n and one column per name in wanted: ('linear', q) interpolates between ranks q (n - 1), ('rank', q) is the value at
    rank floor(n q), counted from 0."""
    c = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    cuts = c.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("v", [k / CUTS for k in range(1, CUTS)], 1000)).alias("cuts"), F.sum("c").alias("n"))
    cuts = cuts.select(*[F.col(k).alias("g_" + k) for k in keys], "cuts", "n")
    c = c.join(cuts, _same(keys, "g_")).select(*keys, "v", "c", "n", F.size(F.filter("cuts", lambda x: x < F.col("v"))).alias("b"))
    buckets = c.groupBy(*keys, "b").agg(F.sum("c").alias("in"), F.max("n").alias("n"))
    upto = F.sum("in").over(Window.partitionBy(*keys).orderBy("b"))  # at most CUTS rows a group
    position = {name: F.col("n") * F.lit(q) if how == "rank" else (F.col("n") - 1) * F.lit(q) for name, (how, q) in wanted.items()}
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.least(F.floor(p) + 1, F.col("n") - 1)) for p in position.values()])))
    marked = buckets.withColumn("upto", upto).withColumn("below", F.col("upto") - F.col("in"))
    marked = marked.withColumn("ranks", F.filter(ranks, lambda r: (r >= F.col("below")) & (r < F.col("upto")))).where(F.size("ranks") > 0)
    marked = marked.select(*[F.col(k).alias("h_" + k) for k in keys], F.col("b").alias("h_b"), "below", "ranks")
    j = c.join(marked, _same([*keys, "b"], "h_")).withColumn("to", F.col("below") + F.sum("c").over(Window.partitionBy(*keys, "b").orderBy("v")))
    hit = j.withColumn("r", F.explode(F.filter("ranks", lambda r: (r < F.col("to")) & (r >= F.col("to") - F.col("c")))))
    found = hit.groupBy(*keys).agg(F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("r", "v"))).alias("at"))  # at most two ranks a name
    out = []
    for name, p in position.items():
        low = F.element_at("at", F.floor(p))
        between = low + (p - F.floor(p)) * (F.element_at("at", F.least(F.floor(p) + 1, F.col("n") - 1)) - low)
        out.append((low if wanted[name][0] == "rank" else between).alias(name))
    return found.select(*keys, "n", *out)
