"""Queries of the point-in-time engine over the project's tables, each beside its SQL."""
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as X
from tidemark.functions import vectors as V
from tidemark.operators import clusters, pit
from tidemark.operators.ranks import exact_quantiles
from tidemark.sources.tables import table

CUT = "2026-01-15T00:00:00+00:00"
CUT_SQL = "TIMESTAMPTZ '2026-01-15 00:00:00+00'"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


N = lambda c: F.count_if(c)
ALL = lambda: F.count(F.lit(1))
news = lambda s, d: table(s, d, "silver_financial_news")
filings = lambda s, d: table(s, d, "silver_sec_filings")
bronze = lambda s, d: table(s, d, "bronze_events_raw")
observations = lambda s, d: table(s, d, "source_observations")
labels = lambda s, d: table(s, d, "annotation_releases")
reviews = lambda s, d: table(s, d, "eligibility_release_requirements")
predictions = lambda s, d: table(s, d, "prediction_releases")
us = F.unix_micros

# ---- filters and projections -------------------------------------------------------------------------------------


@query(f"SELECT id, source, epoch_us(greatest(event_time, ingested_time)) AS effective_us FROM silver_financial_news WHERE greatest(event_time, ingested_time) <= {CUT_SQL} AND is_near_duplicate = FALSE AND source = 'RSS'")
def flt1_asof_news(s, d):
    return pit.news_as_of(news(s, d), CUT, "rss", only_canonical=True).select("id", "source", us("effective_time").alias("effective_us"))


@query(f"SELECT id, epoch_us(greatest(event_time, ingested_time)) AS effective_us FROM silver_financial_news WHERE greatest(event_time, ingested_time) <= {CUT_SQL} AND list_contains(tickers_mentioned, (SELECT min(t) FROM (SELECT unnest(tickers_mentioned) AS t FROM silver_financial_news)))")
def flt1_asof_ticker(s, d):
    least = news(s, d).select(F.explode("tickers_mentioned").alias("t")).agg(F.min("t").alias("t"))
    return pit.news_as_of(news(s, d), CUT).join(F.broadcast(least), F.array_contains("tickers_mentioned", F.col("t"))).select("id", us("effective_time").alias("effective_us"))


@query(f"SELECT accession_number, upper(trim(form_type)) AS form, epoch_us(ingested_time) AS effective_us FROM silver_sec_filings WHERE ingested_time <= {CUT_SQL} AND upper(trim(form_type)) IN ('8-K', '10-Q')")
def flt2_asof_filings(s, d):
    return filings(s, d).where(pit.visible(F.col("ingested_time"), CUT)).select("accession_number", F.upper(F.trim("form_type")).alias("form"), us("ingested_time").alias("effective_us")).where(F.col("form").isin("8-K", "10-Q"))


@query(f"SELECT id, epoch_us(available_at) AS available_us FROM source_observations WHERE available_at <= {CUT_SQL} AND nlp_eligible")
def flt3_asof_sealed(s, d):
    return observations(s, d).where(pit.visible(F.col("available_at"), CUT) & F.col("nlp_eligible")).select("id", us("available_at").alias("available_us"))


@query("SELECT id, source, title, url, schema_version FROM silver_financial_news WHERE is_near_duplicate = FALSE")
def flt4_canonical(s, d):
    return news(s, d).where("is_near_duplicate = false").select("id", "source", "title", "url", "schema_version")


@query("SELECT id, NOT coalesce(is_near_duplicate, FALSE) AND coalesce(trim(title), '') <> '' AND coalesce(json_extract_string(metadata, '$.nlp_eligible'), 'true') <> 'false' AND (source = 'RSS' OR (source = 'GDELT' AND coalesce(json_extract_string(metadata, '$.title_provenance'), '') = 'source_api')) AS eligible FROM silver_financial_news")
def flt6_headline_eligible(s, d):
    said = lambda n, default: F.coalesce(F.get_json_object("metadata", f"$.{n}"), F.lit(default))
    ok = ~F.coalesce("is_near_duplicate", F.lit(False)) & (F.coalesce(F.trim("title"), F.lit("")) != "") & (said("nlp_eligible", "true") != "false")
    return news(s, d).select("id", (ok & ((F.col("source") == "RSS") | ((F.col("source") == "GDELT") & (said("title_provenance", "") == "source_api")))).alias("eligible"))


@query("SELECT id, trim(coalesce(title, '')) <> '' AND ((source = 'RSS' AND title_provenance = 'source_feed') OR (source = 'GDELT' AND title_provenance = 'source_api')) AS ok, nlp_eligible FROM source_observations")
def flt7_nlp_eligible(s, d):
    ok = (F.trim(F.coalesce("title", F.lit(""))) != "") & (((F.col("source") == "RSS") & (F.col("title_provenance") == "source_feed")) | ((F.col("source") == "GDELT") & (F.col("title_provenance") == "source_api")))
    return observations(s, d).select("id", ok.alias("ok"), "nlp_eligible")


@query("SELECT accession_number, form_type FROM silver_sec_filings WHERE starts_with(upper(trim(form_type)), '8-K') OR starts_with(upper(trim(form_type)), '10-K') OR starts_with(upper(trim(form_type)), '10-Q')")
def flt8_monitored_forms(s, d):
    form = F.upper(F.trim("form_type"))
    return filings(s, d).where(form.startswith("8-K") | form.startswith("10-K") | form.startswith("10-Q")).select("accession_number", "form_type")


@query(f"SELECT b.kafka_topic, b.kafka_partition, b.kafka_offset FROM bronze_events_raw b JOIN (SELECT kafka_topic, kafka_partition, max(kafka_offset) AS base FROM bronze_events_raw WHERE ingested_at <= {CUT_SQL} GROUP BY 1, 2) m USING (kafka_topic, kafka_partition) WHERE b.kafka_offset > m.base AND b.ingested_at > {CUT_SQL}")
def flt9_boundary(s, d):
    b = bronze(s, d)
    at = F.timestamp_micros(F.lit(pit.micros(CUT)))
    base = b.where(F.col("ingested_at") <= at).groupBy("kafka_topic", "kafka_partition").agg(F.max("kafka_offset").alias("base"))
    return b.join(base, ["kafka_topic", "kafka_partition"]).where((F.col("kafka_offset") > F.col("base")) & (F.col("ingested_at") > at)).select("kafka_topic", "kafka_partition", "kafka_offset")


@query("SELECT id FROM silver_financial_news WHERE title LIKE '%shares slip%orders%' OR title LIKE 'Profit at %demand%'")
def flt11_like(s, d):
    return news(s, d).where("title LIKE '%shares slip%orders%' OR title LIKE 'Profit at %demand%'").select("id")


@query("SELECT id FROM silver_financial_news WHERE canonical_cluster_id IS NOT DISTINCT FROM url OR (is_near_duplicate IS NULL AND url IS NOT NULL)")
def flt13_null_safe(s, d):
    return news(s, d).where(F.col("canonical_cluster_id").eqNullSafe(F.col("url")) | (F.col("is_near_duplicate").isNull() & F.col("url").isNotNull())).select("id")


@query("SELECT kafka_topic, kafka_partition, kafka_offset, epoch_us(ingested_at) AS at_us FROM bronze_events_raw WHERE provenance_status IS NULL OR event_id IS NULL")
def flt15_unresolved(s, d):
    return bronze(s, d).where("provenance_status is null or event_id is null").select("kafka_topic", "kafka_partition", "kafka_offset", us("ingested_at").alias("at_us"))


# ---- joins -------------------------------------------------------------------------------------------------------


@query("SELECT b.kafka_topic, count(*) AS n, count(s.id) AS n_stored FROM (SELECT DISTINCT kafka_topic, event_id FROM bronze_events_raw WHERE event_id IS NOT NULL) b LEFT JOIN silver_financial_news s ON s.id = b.event_id GROUP BY 1")
def jn1_bronze_outcome(s, d):
    b = bronze(s, d).where("event_id is not null").select("kafka_topic", "event_id").distinct()
    return b.join(news(s, d).select("id"), F.col("id") == F.col("event_id"), "left").groupBy("kafka_topic").agg(ALL().alias("n"), F.count("id").alias("n_stored"))


@query("SELECT count(*) AS n FROM (SELECT DISTINCT event_id AS id FROM bronze_events_raw WHERE kafka_topic IN ('rss', 'gdelt') AND event_id IS NOT NULL) b FULL OUTER JOIN silver_financial_news o USING (id) WHERE b.id IS NULL OR o.id IS NULL")
def jn3_unmatched(s, d):
    b = bronze(s, d).where("kafka_topic in ('rss', 'gdelt') and event_id is not null").select(F.col("event_id").alias("b")).distinct()
    return b.join(news(s, d).select("id"), F.col("b") == F.col("id"), "full").where("b is null or id is null").agg(ALL().alias("n"))


@query("SELECT o.id, count(DISTINCT a.decision_id) AS n_labels, count(DISTINCT e.decision_id) AS n_reviews FROM (SELECT DISTINCT id FROM source_observations) o LEFT JOIN annotation_releases a ON a.content_hash = o.id LEFT JOIN eligibility_release_requirements e ON e.content_hash = o.id GROUP BY 1")
def jn5_ledger_counts(s, d):
    count = lambda t, c: t.groupBy(F.col("content_hash").alias("id")).agg(F.countDistinct("decision_id").alias(c))
    o = observations(s, d).select("id").distinct().join(count(labels(s, d), "n_labels"), "id", "left").join(count(reviews(s, d), "n_reviews"), "id", "left")
    return o.select("id", F.coalesce("n_labels", F.lit(0)).alias("n_labels"), F.coalesce("n_reviews", F.lit(0)).alias("n_reviews"))


@query("SELECT DISTINCT p.content_hash FROM prediction_releases p WHERE NOT EXISTS (SELECT 1 FROM annotation_releases a WHERE a.content_hash = p.content_hash AND a.label_available_at IS NOT NULL)")
def jn6_pending(s, d):
    return predictions(s, d).select("content_hash").distinct().join(labels(s, d).where("label_available_at is not null").select("content_hash"), "content_hash", "left_anti")


@query("SELECT content_hash, max(seq_no) AS seq_no, arg_max(decision_id, (seq_no, decision_id)) AS decision_id FROM annotation_releases GROUP BY 1")
def jn7_latest(s, d):
    return labels(s, d).groupBy("content_hash").agg(F.max("seq_no").alias("seq_no"), F.max_by("decision_id", F.struct("seq_no", "decision_id")).alias("decision_id"))


@query("SELECT id, canonical_cluster_id FROM silver_financial_news WHERE canonical_cluster_id IS NOT NULL AND canonical_cluster_id NOT IN (SELECT id FROM silver_financial_news)")
def jn8_dangling(s, d):
    n = news(s, d)
    return n.where("canonical_cluster_id is not null").select("id", "canonical_cluster_id").join(n.select(F.col("id").alias("canonical_cluster_id")), "canonical_cluster_id", "left_anti")


@query("SELECT id FROM silver_financial_news WHERE id IN (SELECT article_id FROM source_observations)")
def jn9_semi(s, d):
    return news(s, d).select("id").join(observations(s, d).select(F.col("article_id").alias("id")), "id", "left_semi")


@query(f"SELECT content_hash, arg_max_null(sentiment, (label_available_at, seq_no, decision_id)) AS sentiment FROM annotation_releases WHERE label_available_at < {CUT_SQL} GROUP BY 1")
def jn16_asof_decision(s, d):
    return labels(s, d).where(pit.released(F.col("label_available_at"), CUT)).groupBy("content_hash").agg(F.max_by("sentiment", F.struct("label_available_at", "seq_no", "decision_id")).alias("sentiment"))


@query("SELECT n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def jn17_star(s, d):
    t = lambda n: table(s, d, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(ALL().alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


# ---- aggregations ------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS total, count(*) FILTER (is_near_duplicate) AS duplicates, count(DISTINCT canonical_cluster_id) AS clusters, count(*) FILTER (len(tickers_mentioned) > 0) AS with_tickers, count(*) FILTER (source = 'RSS') AS rss FROM silver_financial_news")
def agg1_stats(s, d):
    return news(s, d).agg(ALL().alias("total"), N(F.col("is_near_duplicate")).alias("duplicates"), F.countDistinct("canonical_cluster_id").alias("clusters"), N(F.size("tickers_mentioned") > 0).alias("with_tickers"), N(F.col("source") == "RSS").alias("rss"))


@query("""SELECT count(*) FILTER (title IS NULL OR trim(title) = '') AS no_title, count(*) FILTER (url IS NULL) AS no_url, count(*) FILTER (content_snippet IS NULL) AS no_snippet,
 count(*) FILTER (content_snippet = '') AS empty_snippet, count(*) FILTER (metadata IS NULL) AS no_metadata, count(*) FILTER (event_time IS NULL) AS no_event_time, count(*) FILTER (event_time > ingested_time) AS early,
 count(*) FILTER (tickers_mentioned IS NULL) AS no_tickers, count(*) FILTER (is_near_duplicate AND canonical_cluster_id IS NULL) AS no_pointer, count(*) FILTER (NOT is_near_duplicate AND canonical_cluster_id IS NOT NULL) AS odd_pointer, count(*) FILTER (published_time LIKE '%Z') AS zulu FROM silver_financial_news""")
def agg2_quality_filters(s, d):
    conditions = {"no_title": "title is null or trim(title) = ''", "no_url": "url is null", "no_snippet": "content_snippet is null", "empty_snippet": "content_snippet = ''", "no_metadata": "metadata is null",
                  "no_event_time": "event_time is null", "early": "event_time > ingested_time", "no_tickers": "tickers_mentioned is null", "no_pointer": "is_near_duplicate and canonical_cluster_id is null",
                  "odd_pointer": "not is_near_duplicate and canonical_cluster_id is not null", "zulu": "published_time like '%Z'"}
    return news(s, d).agg(*[N(F.expr(c)).alias(k) for k, c in conditions.items()])


@query("SELECT e.source, coalesce(c.n, 0) AS n FROM (VALUES ('RSS'), ('GDELT'), ('SEC')) e(source) LEFT JOIN (SELECT source, count(*) AS n FROM silver_financial_news GROUP BY 1) c USING (source)")
def agg3_by_source(s, d):
    expected = s.createDataFrame([("RSS",), ("GDELT",), ("SEC",)], "source string")
    return expected.join(news(s, d).groupBy("source").agg(ALL().alias("n")), "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT epoch_us(min(ingested_time)) AS first_us, epoch_us(max(ingested_time)) AS last_us, round((epoch_us(max(ingested_time)) - epoch_us(min(ingested_time))) / 3600000000.0, 3) AS hours FROM silver_financial_news")
def agg4_span(s, d):
    a, b = us(F.min("ingested_time")), us(F.max("ingested_time"))
    return news(s, d).agg(a.alias("first_us"), b.alias("last_us"), F.round((b - a) / F.lit(3600000000.0), 3).alias("hours"))


@query("SELECT coalesce(max(try_cast(schema_version AS DOUBLE)), 0) AS version, count(DISTINCT article_id) AS articles FROM source_observations")
def agg5_version(s, d):
    return observations(s, d).agg(F.coalesce(F.max(F.col("schema_version").try_cast("double")), F.lit(0.0)).alias("version"), F.countDistinct("article_id").alias("articles"))


@query("SELECT kafka_topic, coalesce(provenance_status, 'none') AS status, count(*) AS n, epoch_us(min(ingested_at)) AS first_us, epoch_us(max(ingested_at)) AS last_us, sum(len(raw_payload))::BIGINT AS chars FROM bronze_events_raw GROUP BY 1, 2")
def agg8_outcomes(s, d):
    return bronze(s, d).groupBy("kafka_topic", F.coalesce("provenance_status", F.lit("none")).alias("status")).agg(ALL().alias("n"), us(F.min("ingested_at")).alias("first_us"), us(F.max("ingested_at")).alias("last_us"), F.sum(F.length("raw_payload")).alias("chars"))


@query("SELECT source, round(min(l), 6) AS least, round(median(l), 6) AS middle, round(max(l), 6) AS most, count(*) FILTER (l < 0) AS negative FROM (SELECT source, (epoch_us(ingested_time) - epoch_us(event_time)) / 1000000.0 AS l FROM silver_financial_news WHERE event_time IS NOT NULL) GROUP BY 1")
def agg9_lags(s, d):
    l = news(s, d).where("event_time is not null").select("source", ((us("ingested_time") - us("event_time")) / F.lit(1000000.0)).alias("l"))
    ends = l.groupBy("source").agg(F.round(F.min("l"), 6).alias("least"), F.round(F.max("l"), 6).alias("most"), N(F.col("l") < 0).alias("negative"))
    return ends.join(exact_quantiles(l, ["source"], "l", {"m": ("linear", 0.5)}), "source").select("source", "least", F.round("m", 6).alias("middle"), "most", "negative")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def agg10_percentiles(s, d):
    q = exact_quantiles(table(s, d, "events"), ["event_type"], "value", {"p50": ("linear", 0.5), "p95": ("linear", 0.95)})
    return q.select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("SELECT event_type, max(value) FILTER (r = floor(n * 0.95)) AS p95, max(value) FILTER (r = n // 2) AS upper_median FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY 1")
def agg11_nearest_rank(s, d):
    return exact_quantiles(table(s, d, "events"), ["event_type"], "value", {"p95": ("rank", 0.95), "upper_median": ("rank", 0.5)}).drop("n")


@query("SELECT f AS field, round(100.0 * avg(p), 1)::DOUBLE AS present FROM (UNPIVOT (SELECT (title IS NOT NULL)::INT AS title, (url IS NOT NULL)::INT AS url, (content_snippet IS NOT NULL AND content_snippet <> '')::INT AS content_snippet, (event_time IS NOT NULL)::INT AS event_time FROM silver_financial_news) ON COLUMNS(*) INTO NAME f VALUE p) GROUP BY 1")
def agg12_fill_rates(s, d):
    tests = {"title": "title is not null", "url": "url is not null", "content_snippet": "coalesce(content_snippet <> '', false)", "event_time": "event_time is not null"}
    sums = news(s, d).agg(ALL().alias("n"), *[N(F.expr(c)).alias(k) for k, c in tests.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.round(100.0 * F.col(k) / F.col("n"), 1).alias("present")) for k in tests])).alias("x")).select("x.*")


@query("SELECT kafka_topic, round(count(*) / ((epoch_us(max(ingested_at)) - epoch_us(min(ingested_at))) / 60000000.0), 6) AS per_minute FROM bronze_events_raw GROUP BY 1")
def agg13_throughput(s, d):
    return bronze(s, d).groupBy("kafka_topic").agg(F.round(F.try_divide(ALL(), (us(F.max("ingested_at")) - us(F.min("ingested_at"))) / F.lit(60000000.0)), 6).alias("per_minute"))


@query(f"SELECT kafka_topic, kafka_partition, greatest(0, max(kafka_offset) - coalesce(max(kafka_offset) FILTER (ingested_at <= {CUT_SQL}), -1)) AS lag FROM bronze_events_raw GROUP BY 1, 2")
def agg20_lag(s, d):
    done = F.max(F.when(pit.visible(F.col("ingested_at"), CUT), F.col("kafka_offset")))
    return bronze(s, d).groupBy("kafka_topic", "kafka_partition").agg(F.greatest(F.lit(0), F.max("kafka_offset") - F.coalesce(done, F.lit(-1))).alias("lag"))


@query("""WITH l AS (SELECT content_hash, arg_max_null(sentiment, (label_available_at, seq_no, decision_id)) AS actual FROM annotation_releases WHERE label_available_at IS NOT NULL GROUP BY 1),
 j AS (SELECT p.model_revision, l.actual, p.predicted_label, 1.0::DOUBLE / count(*) OVER (PARTITION BY p.content_hash) AS w FROM prediction_releases p JOIN l USING (content_hash) WHERE p.released_at IS NOT NULL)
 SELECT model_revision, actual, predicted_label, round(sum(w), 6) AS weight FROM j GROUP BY 1, 2, 3""")
def agg21_weighted_confusion(s, d):
    l = labels(s, d).where("label_available_at is not null").groupBy("content_hash").agg(F.max_by("sentiment", F.struct("label_available_at", "seq_no", "decision_id")).alias("actual"))
    p = predictions(s, d).where("released_at is not null")
    n = p.groupBy("content_hash").agg(ALL().alias("k"))
    j = p.join(l, "content_hash").join(n, "content_hash")
    return j.groupBy("model_revision", "actual", "predicted_label").agg(F.round(F.sum(1.0 / F.col("k")), 6).alias("weight"))


@query("SELECT l_returnflag, l_linestatus, grouping(l_returnflag) * 2 + grouping(l_linestatus) AS g, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus) HAVING count(*) > 10")
def agg22_cube(s, d):
    return table(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("g"), ALL().alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")).where("n > 10")


# ---- windows, top-k, sets ----------------------------------------------------------------------------------------


@query("SELECT content_hash, decision_id, seq_no FROM (SELECT DISTINCT content_hash, decision_id, seq_no FROM eligibility_release_requirements) QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY seq_no DESC, decision_id DESC) = 1")
def win1_latest(s, d):
    return pit.latest(reviews(s, d).select("content_hash", "decision_id", "seq_no").distinct(), ["content_hash"], F.desc("seq_no"), F.desc("decision_id"))


@query("SELECT content_hash, seq_no, decision_id, lag(decision_id) OVER (PARTITION BY content_hash ORDER BY seq_no, decision_id) AS previous FROM (SELECT DISTINCT content_hash, seq_no, decision_id FROM annotation_releases WHERE label_available_at IS NOT NULL)")
def win2_previous(s, d):
    r = labels(s, d).where("label_available_at is not null").select("content_hash", "seq_no", "decision_id").distinct()
    return r.withColumn("previous", F.lag("decision_id").over(Window.partitionBy("content_hash").orderBy("seq_no", "decision_id")))


@query("SELECT user_id, round(max(g), 6) AS longest, count(g) AS gaps FROM (SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1000000.0 AS g FROM events) GROUP BY 1")
def win3_gaps(s, d):
    e = table(s, d, "events").select("user_id", "event_id", us(F.col("ts").cast("timestamp")).alias("t"))
    g = e.withColumn("g", (F.col("t") - F.lag("t").over(Window.partitionBy("user_id").orderBy("t", "event_id"))) / F.lit(1000000.0))
    return g.groupBy("user_id").agg(F.round(F.max("g"), 6).alias("longest"), F.count("g").alias("gaps"))


@query("SELECT id, row_number() OVER (PARTITION BY coalesce(canonical_cluster_id, id) ORDER BY ingested_time, id) = 1 AS independent FROM silver_financial_news")
def win5_first_seen(s, d):
    n = news(s, d).withColumn("c", F.coalesce("canonical_cluster_id", "id"))
    first = n.groupBy("c").agg(F.min(F.struct("ingested_time", "id"))["id"].alias("first"))
    return n.join(first, "c").select("id", (F.col("id") == F.col("first")).alias("independent"))


@query("SELECT article_id, arg_min(id, (available_at, observed_at, id)) AS anchor FROM source_observations WHERE available_at IS NOT NULL GROUP BY 1")
def win6_anchor(s, d):
    return observations(s, d).where("available_at is not null").groupBy("article_id").agg(F.min_by("id", F.struct("available_at", "observed_at", "id")).alias("anchor"))


@query("SELECT id, rank() OVER w AS r, dense_rank() OVER w AS dr FROM silver_financial_news WINDOW w AS (PARTITION BY source, length(title) ORDER BY title, id)")
def win10_ranks(s, d):
    w = Window.partitionBy("source", F.length("title")).orderBy("title", "id")
    return news(s, d).select("id", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("dr"))


@query(f"SELECT id FROM silver_financial_news WHERE greatest(event_time, ingested_time) <= {CUT_SQL} ORDER BY greatest(event_time, ingested_time) DESC, id LIMIT 100")
def top1_newest(s, d):
    return pit.news_as_of(news(s, d), CUT).orderBy(F.desc("effective_time"), "id").limit(100).select("id")


@query("SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], q.e) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(q.e, q.e))), 6) AS score FROM embeddings a, (SELECT embedding::DOUBLE[] AS e FROM embeddings ORDER BY vec_id LIMIT 1) q ORDER BY score DESC, vec_id LIMIT 10")
def top2_vector_topk(s, d):
    e = table(s, d, "embeddings")
    q = e.orderBy("vec_id").limit(1).collect()[0]["embedding"]
    return pit.vector_top_k(e, "vec_id", "embedding", q, 10)


@query("SELECT id, source, priority FROM (SELECT id, source, sha256('v1:' || id) AS priority, row_number() OVER (PARTITION BY source ORDER BY sha256('v1:' || id), id) AS r FROM silver_financial_news) WHERE r <= 25")
def top5_hash_sample(s, d):
    return pit.hash_sample(news(s, d).select("id", "source"), "id", "source", "v1", 25).select("id", "source", "priority")


@query("SELECT content_hash FROM (SELECT DISTINCT content_hash FROM annotation_releases WHERE label_available_at IS NOT NULL AND content_hash IS NOT NULL) ORDER BY sha256('17:' || content_hash) LIMIT 64")
def top6_replay_sample(s, d):
    c = labels(s, d).where("label_available_at is not null and content_hash is not null").select("content_hash").distinct()
    return c.orderBy(F.sha2(F.concat(F.lit("17:"), "content_hash"), 256)).limit(64)


@query("SELECT 'missing' AS side, kafka_partition FROM ((SELECT DISTINCT kafka_partition FROM bronze_events_raw) EXCEPT (SELECT DISTINCT kafka_partition FROM bronze_events_raw WHERE kafka_topic = 'rss')) UNION ALL SELECT 'both', kafka_partition FROM ((SELECT DISTINCT kafka_partition FROM bronze_events_raw WHERE kafka_topic = 'sec') INTERSECT (SELECT DISTINCT kafka_partition FROM bronze_events_raw WHERE kafka_topic = 'rss'))")
def set5_set_operations(s, d):
    b = bronze(s, d)
    of = lambda t: b.where(F.col("kafka_topic") == t).select("kafka_partition")
    return b.select("kafka_partition").distinct().subtract(of("rss")).select(F.lit("missing").alias("side"), "kafka_partition").union(of("sec").intersect(of("rss")).select(F.lit("both").alias("side"), "kafka_partition"))


@query("SELECT content_hash, count(*) AS n FROM source_observations GROUP BY 1 HAVING count(*) > 1")
def set4_repeated_members(s, d):
    return observations(s, d).groupBy("content_hash").agg(ALL().alias("n")).where("n > 1")


# ---- text, hashes, vectors, times, JSON --------------------------------------------------------------------------


@query("SELECT id, array_to_string(list_filter(string_split_regex(regexp_replace(lower(title), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+'), lambda w: w <> ''), '|') AS tokens FROM silver_financial_news")
def txt1_tokens(s, d):
    return news(s, d).select("id", F.array_join(X.tokens(F.col("title")), "|").alias("tokens"))


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


#: entity codes of {0}: each name on its own between other characters than small letters, then tickers
ENTITIES_SQL = "list_sort(list_distinct(list_concat(list_transform(list_filter([" + ", ".join(f"{{{{'a': {_text(a)}, 'c': '{c}'}}}}" for a, c in sorted(X.ALIASES.items())) + r"], lambda x: regexp_matches(lower({0}), '(^|[^a-z])' || regexp_escape(x.a) || '($|[^a-z])')), lambda x: x.c), list_filter(list_concat(regexp_extract_all({0}, '\$([A-Z]{{1,5}})\b', 1), regexp_extract_all({0}, '(^|[^\w$])([A-Z]{{2,5}})\b', 2)), lambda w: w NOT IN (" + ", ".join(_text(w) for w in X.NO_TICKER) + ")))))"


@query(f"SELECT id, array_to_string({ENTITIES_SQL.format('title')}, ',') AS entities FROM silver_financial_news WHERE title IS NOT NULL")
def txt7_entities(s, d):
    return news(s, d).where("title is not null").select("id", F.array_join(X.entities(F.col("title")), ",").alias("entities"))


@query("SELECT doc_id, substring(trim(regexp_replace(text, '<[^>]+>', '', 'g')), 1, 500) AS plain FROM documents")
def txt9_strip_html(s, d):
    return table(s, d, "documents").select("doc_id", X.strip_tags(F.col("text")).alias("plain"))


@query("SELECT id, array_to_string(list_transform(list_filter(string_split_regex(replace(regexp_extract(rtrim(url, '/'), '([^/]*)$', 1), '.', '-'), '[-_]+'), lambda w: w NOT IN ('html', 'htm', 'php', '')), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS slug FROM silver_financial_news")
def txt11_slug(s, d):
    return news(s, d).select("id", X.slug_title(F.col("url")).alias("slug"))


@query("SELECT id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)', 1)), '^www\\.', '') AS host FROM silver_financial_news")
def txt12_host(s, d):
    return news(s, d).select("id", X.host(F.col("url")).alias("host"))


@query("SELECT accession_number, CASE WHEN length(cik) < 10 THEN lpad(cik, 10, '0') ELSE cik END AS cik, upper(trim(form_type)) AS form, trim(regexp_replace(company_name, '\\s+', ' ', 'g')) AS company FROM silver_sec_filings")
def txt15_filing_identity(s, d):
    return filings(s, d).select("accession_number", X.padded_cik(F.col("cik")).alias("cik"), F.upper(F.trim("form_type")).alias("form"), X.squeeze(F.col("company_name")).alias("company"))


@query("SELECT id, CASE WHEN len(regexp_extract_all(coalesce(title, ''), '[A-Za-z]+')) < 4 OR regexp_matches(coalesce(title, ''), '(?i)\\b[0-9a-f]{12,}\\b') THEN 'inspect_identifier_like_title' WHEN json_extract_string(metadata, '$.title_provenance') = 'url_slug' THEN 'synthetic_url_slug' WHEN source = 'GDELT' AND (starts_with(content_snippet, 'Source:') OR starts_with(content_snippet, 'Domain:')) THEN 'metadata_only_snippet' ELSE '' END AS flag FROM silver_financial_news")
def txt16_flag(s, d):
    return news(s, d).select("id", X.quality_flag(F.col("title"), F.col("source"), F.col("content_snippet"), F.get_json_object("metadata", "$.title_provenance")).alias("flag"))


@query("SELECT id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9$%]+'), lambda w: w NOT IN ('a', 'an', 'and', 'as', 'at', 'by', 'for', 'from', 'in', 'is', 'it', 'its', 'of', 'on', 'or', 's', 'the', 'to', 'with')))), ' ') AS hints FROM silver_financial_news")
def txt17_hints(s, d):
    return news(s, d).select("id", F.array_join(X.hint_words(F.col("title")), " ").alias("hints"))


@query("SELECT id, sha256(coalesce(nullif(url, ''), title)) AS identity FROM silver_financial_news")
def mth1_identity(s, d):
    return news(s, d).select("id", F.sha2(F.coalesce(F.nullif("url", F.lit("")), "title"), 256).alias("identity"))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id WHERE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))) >= 0.2")
def mth5_cosine_all(s, d):
    """Each query vector against all rows, whatever their label: blocks of vectors, one matrix product for each two."""
    e = table(s, d, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return V.block_pairs(e.where("id % 100 = 0"), e, 0.2).where("a <> b").select("a", "b", F.round("c", 6).alias("score"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: exp(x - list_max(embedding::DOUBLE[])))), 6) AS total, list_position(embedding, list_max(embedding)) - 1 AS best FROM embeddings")
def mth9_softmax(s, d):
    e = table(s, d, "embeddings")
    p = V.softmax(F.transform("embedding", lambda x: x.cast("double")))
    return e.select("vec_id", F.round(1.0 / F.array_max(p), 6).alias("total"), (F.array_position("embedding", F.array_max("embedding")) - 1).alias("best"))


@query("SELECT id, regexp_matches(published_time, '(Z|[+-][0-9]{2}:?[0-9]{2})$') AND try_cast(published_time AS TIMESTAMPTZ) IS NOT NULL AND regexp_matches(published_time, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}') AS strict FROM silver_financial_news")
def dt1_strict_iso(s, d):
    form = F.col("published_time").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})\z")
    at = F.try_to_timestamp(F.regexp_replace("published_time", r"(\.\d{6})\d+", "$1"))
    return news(s, d).select("id", (form & at.isNotNull()).alias("strict"))


@query("SELECT id, CASE WHEN regexp_full_match(published_time, '[0-9]{8}T[0-9]{6}Z') THEN epoch_us(try_strptime(published_time, '%Y%m%dT%H%M%SZ')) ELSE epoch_us(ingested_time) END AS at_us, CASE WHEN regexp_full_match(published_time, '[0-9]{8}T[0-9]{6}Z') THEN 'source' ELSE 'ingestion_fallback' END AS provenance FROM silver_financial_news")
def dt2_stamp_or_ingestion(s, d):
    stamp = F.col("published_time").rlike(r"^\d{8}T\d{6}Z\z")
    at = F.when(stamp, us(F.try_to_timestamp("published_time", F.lit("yyyyMMdd'T'HHmmss'Z'"))))
    return news(s, d).select("id", F.coalesce(at, us("ingested_time")).alias("at_us"), F.when(at.isNotNull(), "source").otherwise("ingestion_fallback").alias("provenance"))


@query("SELECT w, count(*) AS n FROM (SELECT CASE WHEN ingested_time < TIMESTAMPTZ '2025-12-01 00:00:00+00' THEN 0 WHEN ingested_time < TIMESTAMPTZ '2026-02-01 00:00:00+00' THEN 1 ELSE 2 END AS w FROM silver_financial_news) GROUP BY 1")
def dt7_windows(s, d):
    bounds = [pit.micros("2025-12-01T00:00:00+00:00"), pit.micros("2026-02-01T00:00:00+00:00")]
    return news(s, d).groupBy(sum([(us("ingested_time") >= b).cast("int") for b in bounds], F.lit(0)).alias("w")).agg(ALL().alias("n"))


@query("SELECT id, array_to_string(list_sort(list_distinct(list_transform(tickers_mentioned, lambda t: upper(t)))), ',') AS tickers FROM silver_financial_news WHERE tickers_mentioned IS NOT NULL")
def arr3_tickers(s, d):
    return news(s, d).where("tickers_mentioned is not null").select("id", F.array_join(F.array_sort(F.array_distinct(F.transform("tickers_mentioned", lambda t: F.upper(t)))), ",").alias("tickers"))


@query("SELECT kafka_topic, json_valid(raw_payload) IS TRUE AS valid, count(*) AS n FROM bronze_events_raw WHERE raw_payload IS NOT NULL GROUP BY 1, 2")
def jsn2_valid_payloads(s, d):
    return bronze(s, d).where("raw_payload is not null").groupBy("kafka_topic", F.try_parse_json("raw_payload").isNotNull().alias("valid")).agg(ALL().alias("n"))


# ---- validation, storage, clusters, streams ----------------------------------------------------------------------


@query(f"""WITH l AS (SELECT content_hash, arg_max(struct_pack(a := english, b := financially_relevant, c := genuine_headline), (data_available_at, seq_no, decision_id)) AS v FROM eligibility_release_requirements WHERE data_available_at < {CUT_SQL} GROUP BY 1)
 SELECT CASE WHEN v IS NULL THEN 'pending' WHEN 'no' IN (v.a, v.b, v.c) THEN 'excluded' WHEN 'uncertain' IN (v.a, v.b, v.c) THEN 'uncertain' ELSE 'included' END AS status, count(*) AS n FROM (SELECT DISTINCT id FROM source_observations) o LEFT JOIN l ON l.content_hash = o.id GROUP BY 1""")
def val6_status(s, d):
    answers = F.array("english", "financially_relevant", "genuine_headline")
    l = reviews(s, d).where(pit.released(F.col("data_available_at"), CUT)).groupBy(F.col("content_hash").alias("id")).agg(F.max_by(answers, F.struct("data_available_at", "seq_no", "decision_id")).alias("v"))
    status = F.when(F.col("v").isNull(), "pending").when(F.array_contains("v", "no"), "excluded").when(F.array_contains("v", "uncertain"), "uncertain").otherwise("included")
    return observations(s, d).select("id").distinct().join(l, "id", "left").groupBy(status.alias("status")).agg(ALL().alias("n"))


@query("SELECT kafka_topic, kafka_partition, kafka_offset, epoch_us(min(ingested_at)) AS first_us, count(*) AS occurrences FROM bronze_events_raw GROUP BY 1, 2, 3")
def snk1_first_write(s, d):
    return bronze(s, d).groupBy("kafka_topic", "kafka_partition", "kafka_offset").agg(us(F.min("ingested_at")).alias("first_us"), ALL().alias("occurrences"))


@query("SELECT id AS version_id, epoch_us(min(observed_at)) AS observed_us, epoch_us(greatest(max(available_at), min(observed_at))) AS available_us FROM source_observations GROUP BY 1")
def snk8_sealed(s, d):
    return observations(s, d).groupBy(F.col("id").alias("version_id")).agg(us(F.min("observed_at")).alias("observed_us"), us(F.greatest(F.max("available_at"), F.min("observed_at"))).alias("available_us"))


_TTL = """WITH RECURSIVE t AS (SELECT kafka_topic, event_id, epoch_us(ingested_at) AS t, row_number() OVER (PARTITION BY kafka_topic, event_id ORDER BY ingested_at, kafka_partition, kafka_offset) AS r FROM bronze_events_raw WHERE event_id IS NOT NULL),
 w AS (SELECT kafka_topic, event_id, r, t, t AS last, TRUE AS ok FROM t WHERE r = 1 UNION ALL SELECT t.kafka_topic, t.event_id, t.r, t.t, CASE WHEN t.t - w.last >= 3600000000 THEN t.t ELSE w.last END, t.t - w.last >= 3600000000 FROM w JOIN t ON t.kafka_topic = w.kafka_topic AND t.event_id = w.event_id AND t.r = w.r + 1)
 SELECT kafka_topic, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS suppressed FROM w GROUP BY 1"""


@query(_TTL)
def str1_exact_ttl(s, d):
    """Duplicates within an hour of the last accepted delivery are suppressed and do not extend it. Instants are folded to distinct
    ones per key. A delivery an hour or more after the one before it is accepted whatever came earlier, so keys are cut there and
    only stretches of dense deliveries are folded in order."""
    hour = 3_600_000_000
    t = bronze(s, d).where("event_id is not null").groupBy("kafka_topic", "event_id", us("ingested_at").alias("t")).agg(ALL().alias("c"))
    w = Window.partitionBy("kafka_topic", "event_id").orderBy("t")
    t = t.withColumn("fresh", F.coalesce(F.col("t") - F.lag("t").over(w) >= hour, F.lit(True)).cast("int")).withColumn("stretch", F.sum("fresh").over(w))
    runs = t.groupBy("kafka_topic", "event_id", "stretch").agg(F.sum("c").alias("n"), F.array_sort(F.collect_list("t")).alias("ts"))
    fold = F.aggregate("ts", F.struct(F.lit(None).cast("long").alias("last"), F.lit(0).cast("long").alias("k")), lambda a, x: F.when(a["last"].isNull() | (x - a["last"] >= hour), F.struct(x.alias("last"), (a["k"] + 1).alias("k"))).otherwise(a))
    r = runs.select("kafka_topic", "n", fold["k"].alias("k"))
    return r.groupBy("kafka_topic").agg(F.sum("k").alias("accepted"), F.sum(F.col("n") - F.col("k")).alias("suppressed"))


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS hour_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def str13_hourly(s, d):
    e = table(s, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("t", "1 hour").alias("w"), "event_type").agg(ALL().alias("n"), F.round(F.sum("value"), 4).alias("total")).select(us("w.start").alias("hour_us"), "event_type", "n", "total")


def _versions(s, d):
    return pit.latest(observations(s, d).where("available_at is not null").withColumnRenamed("id", "version_id"), ["version_id"], F.col("available_at"), F.col("observed_at")).select("version_id", "article_id", "title", "available_at", "observed_at")


_ARTICLE = "SELECT id AS version_id, first_value(id) OVER (PARTITION BY article_id ORDER BY available_at, observed_at, id) AS cluster_id FROM (SELECT id, any_value(article_id) AS article_id, min(available_at) AS available_at, arg_min(observed_at, available_at) AS observed_at FROM source_observations WHERE available_at IS NOT NULL GROUP BY 1)"


@query(_ARTICLE)
def pln1_clusters_article(s, d):
    return clusters.assign_clusters(_versions(s, d), "article").select("version_id", "cluster_id")
