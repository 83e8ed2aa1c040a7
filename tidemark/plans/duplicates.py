"""Queries of the semantic window and the duplicate cascade."""
from pyspark.sql import functions as F

from tidemark.operators.cascade import cascade, window_neighbours
from tidemark.sources.tables import table


def _vectors(s, d):
    v = table(s, d, "dedup_results").where((F.size("embedding") == 384) & F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    return v.groupBy(F.col("event_id").alias("id")).agg(F.min_by("embedding", "result_id").alias("v"))


def _news(s, d):
    return table(s, d, "silver_financial_news").select("id", "source", "title", F.unix_micros("ingested_time").alias("t"))


def jn14_semantic_window(s, d):
    return window_neighbours(_news(s, d).join(_vectors(s, d), "id"), cap=1000)


def str6_cascade(s, d):
    return cascade(_news(s, d), _vectors(s, d))


QUERIES = {f.__name__: f for f in (jn14_semantic_window, str6_cascade)}
SQL = {"jn14_semantic_window": """WITH v AS (SELECT event_id AS id, arg_min(embedding, result_id)::DOUBLE[] AS e FROM dedup_results WHERE len(embedding) = 384 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 GROUP BY 1),
 r AS (SELECT n.id, epoch_us(n.ingested_time) AS t, v.e, sqrt(list_dot_product(v.e, v.e)) AS n, row_number() OVER (ORDER BY n.ingested_time, n.id) AS rank FROM silver_financial_news n JOIN v USING (id))
 SELECT a.id AS a, b.id AS b, round(list_dot_product(a.e, b.e) / (a.n * b.n), 6) AS score FROM r a JOIN r b ON a.rank < b.rank AND a.rank >= b.rank - 1000 AND a.t > b.t - 7200000000 WHERE a.n > 0 AND b.n > 0 AND round(list_dot_product(a.e, b.e) / (a.n * b.n), 6) >= 0.76"""}
