"""Further queries of the point-in-time engine: ledgers, evidence, sketches and planning, each beside its SQL."""
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as X
from tidemark.functions import vectors as V
from tidemark.operators import clusters, pit
from tidemark.plans.reference import ENTITIES_SQL, ALL, CUT, CUT_SQL, N, bronze, filings, labels, news, observations, predictions, reviews, us
from tidemark.shared import materialize
from tidemark.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT a.kafka_topic, a.kafka_partition, a.kafka_offset, o.id FROM bronze_events_raw a LEFT JOIN (SELECT DISTINCT id FROM source_observations) o ON o.id = a.event_id WHERE a.kafka_topic = 'observations'")
def jn2_bronze_observation(s, d):
    o = observations(s, d).select("id").distinct()
    return bronze(s, d).where("kafka_topic = 'observations'").join(o, F.col("id") == F.col("event_id"), "left").select("kafka_topic", "kafka_partition", "kafka_offset", "id")


@query("SELECT kind, count(*) AS n, sum(k)::BIGINT AS members FROM (SELECT CASE WHEN count(*) = 1 THEN 'alone' ELSE 'story' END AS kind, count(*) AS k FROM (SELECT DISTINCT id, article_id FROM source_observations) GROUP BY article_id) GROUP BY 1")
def agg17_story_counts(s, d):
    k = observations(s, d).select("id", "article_id").distinct().groupBy("article_id").agg(ALL().alias("k"))
    return k.groupBy(F.when(F.col("k") == 1, "alone").otherwise("story").alias("kind")).agg(ALL().alias("n"), F.sum("k").alias("members"))


@query("SELECT sentiment, release_kind, count(DISTINCT decision_id) AS n FROM annotation_releases GROUP BY 1, 2")
def agg18_selection_counts(s, d):
    return labels(s, d).groupBy("sentiment", "release_kind").agg(F.countDistinct("decision_id").alias("n"))


@query("SELECT event_type, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, count(*) FILTER (value < 10) AS low FROM events GROUP BY 1")
def agg23_value_stats(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), N(F.col("value") < 10).alias("low"))


@query(f"SELECT source, round(100.0 * avg((len({ENTITIES_SQL.format("coalesce(title, '')")}) > 0)::INT), 1)::DOUBLE AS coverage, count(*) AS n FROM silver_financial_news GROUP BY 1")
def agg27_entity_coverage(s, d):
    return news(s, d).groupBy("source").agg(F.round(100 * F.avg((F.size(X.entities(F.coalesce("title", F.lit("")))) > 0).cast("double")), 1).alias("coverage"), ALL().alias("n"))


@query("SELECT accession_number FROM silver_sec_filings ORDER BY ingested_time, accession_number LIMIT 100")
def top8_fifo(s, d):
    return filings(s, d).orderBy("ingested_time", "accession_number").limit(100).select("accession_number")


@query("SELECT id FROM (SELECT DISTINCT id, available_at, observed_at FROM source_observations WHERE nlp_eligible AND available_at IS NOT NULL) ORDER BY available_at, observed_at, id LIMIT 50")
def top9_first_eligible(s, d):
    o = observations(s, d).where("nlp_eligible and available_at is not null").select("id", "available_at", "observed_at").distinct()
    return o.orderBy("available_at", "observed_at", "id").limit(50).select("id")


@query("SELECT doc_id, trim(regexp_replace(text, '<[^>]+>', ' ', 'g')) AS plain FROM documents")
def txt10_strip_spaced(s, d):
    return table(s, d, "documents").select("doc_id", F.trim(F.regexp_replace("text", "<[^>]+>", " ")).alias("plain"))


@query("SELECT url, regexp_extract(url, '/([0-9]{10}-[0-9]{2}-[0-9]+)', 1) AS accession, regexp_extract(url, '/([0-9]{7,10})/', 1) AS cik FROM silver_sec_filings WHERE url IS NOT NULL")
def txt14_filing_parts(s, d):
    return filings(s, d).where("url is not null").select("url", F.regexp_extract("url", "/([0-9]{10}-[0-9]{2}-[0-9]+)", 1).alias("accession"), F.regexp_extract("url", "/([0-9]{7,10})/", 1).alias("cik"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 5) AS norm FROM embeddings")
def mth7_norms(s, d):
    return table(s, d, "embeddings").select("vec_id", F.round(V.norm("embedding"), 5).alias("norm"))


@query("SELECT result_id, embedding IS NOT NULL AND len(embedding) = 384 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AS usable FROM dedup_results")
def mth11_finite(s, d):
    ok = F.col("embedding").isNotNull() & (F.size("embedding") == 384) & F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return table(s, d, "dedup_results").select("result_id", F.coalesce(ok, F.lit(False)).alias("usable"))


@query("SELECT sha256(kafka_topic || '|' || kafka_partition || '|' || kafka_offset || '|' || coalesce(raw_payload, '')) AS fault_id, count(*) AS occurrences, epoch_us(min(ingested_at)) AS first_us, epoch_us(max(ingested_at)) AS last_us FROM bronze_events_raw WHERE event_id IS NULL GROUP BY 1")
def snk6_fault_counts(s, d):
    fault = F.sha2(F.concat_ws("|", "kafka_topic", F.col("kafka_partition").cast("string"), F.col("kafka_offset").cast("string"), F.coalesce("raw_payload", F.lit(""))), 256)
    return bronze(s, d).where("event_id is null").groupBy(fault.alias("fault_id")).agg(ALL().alias("occurrences"), us(F.min("ingested_at")).alias("first_us"), us(F.max("ingested_at")).alias("last_us"))


@query("SELECT accession_number AS id, coalesce(json_extract_string(metadata, '$.form_type'), form_type, '8-K') AS form, CAST(coalesce(filing_date, CAST(ingested_time AT TIME ZONE 'UTC' AS DATE)) AS VARCHAR) AS filed FROM silver_sec_filings")
def snk3_filing_defaults(s, d):
    day = F.date_from_unix_date(F.floor(us("ingested_time") / 86_400_000_000).cast("int"))
    return filings(s, d).select(F.col("accession_number").alias("id"), F.coalesce(F.get_json_object("metadata", "$.form_type"), "form_type", F.lit("8-K")).alias("form"), F.coalesce("filing_date", day).cast("string").alias("filed"))


@query("SELECT id, json_extract_string(metadata, '$.feed_name') AS feed, json_extract_string(metadata, '$.author') AS author FROM silver_financial_news")
def jsn1_paths(s, d):
    return news(s, d).select("id", F.get_json_object("metadata", "$.feed_name").alias("feed"), F.get_json_object("metadata", "$.author").alias("author"))


@query("SELECT kafka_topic, event_id, to_base64(encode(coalesce(kafka_key, ''))) AS key64 FROM bronze_events_raw")
def jsn4_base64(s, d):
    return bronze(s, d).select("kafka_topic", "event_id", F.regexp_replace(F.base64(F.encode(F.coalesce("kafka_key", F.lit("")), "UTF-8")), r"\r?\n", "").alias("key64"))


@query("SELECT kafka_topic, CASE kafka_topic WHEN 'rss' THEN 'RSS' WHEN 'gdelt' THEN 'GDELT' WHEN 'sec' THEN 'SEC' END IS NOT DISTINCT FROM json_extract_string(CASE WHEN json_valid(raw_payload) THEN raw_payload END, '$.source') AS agrees, count(*) AS n FROM bronze_events_raw GROUP BY 1, 2")
def val3_topic_source(s, d):
    expected = F.when(F.col("kafka_topic") == "rss", "RSS").when(F.col("kafka_topic") == "gdelt", "GDELT").when(F.col("kafka_topic") == "sec", "SEC")
    said = F.when(F.try_parse_json("raw_payload").isNotNull(), F.get_json_object("raw_payload", "$.source"))
    return bronze(s, d).groupBy("kafka_topic", expected.eqNullSafe(said).alias("agrees")).agg(ALL().alias("n"))


@query("SELECT DISTINCT a.content_hash, a.decision_id, CASE WHEN o.id IS NULL THEN 'unknown content' WHEN a.label_available_at < o.available_at THEN 'before data' ELSE 'valid' END AS verdict FROM annotation_releases a LEFT JOIN (SELECT id, min(available_at) AS available_at FROM source_observations GROUP BY 1) o ON o.id = a.content_hash")
def pln3_label_validation(s, d):
    o = observations(s, d).groupBy(F.col("id").alias("content_hash")).agg(F.min("available_at").alias("available_at"), F.lit(True).alias("known"))
    verdict = F.when(F.col("known").isNull(), "unknown content").when(F.col("label_available_at") < F.col("available_at"), "before data").otherwise("valid")
    return labels(s, d).join(o, "content_hash", "left").select("content_hash", "decision_id", verdict.alias("verdict")).distinct()


@query(f"SELECT kafka_topic, kafka_partition, max(kafka_offset) AS high, CASE WHEN greatest(0, max(kafka_offset) - coalesce(max(kafka_offset) FILTER (ingested_at <= {CUT_SQL}), -1)) = 0 THEN 'drained' ELSE 'behind' END AS status FROM bronze_events_raw GROUP BY 1, 2")
def pln10_drain_status(s, d):
    done = F.max(F.when(pit.visible(F.col("ingested_at"), CUT), F.col("kafka_offset")))
    lag = F.greatest(F.lit(0), F.max("kafka_offset") - F.coalesce(done, F.lit(-1)))
    return bronze(s, d).groupBy("kafka_topic", "kafka_partition").agg(F.max("kafka_offset").alias("high"), F.when(lag == 0, "drained").otherwise("behind").alias("status"))


@query("SELECT content_hash, arg_max(decision_id, (seq_no, decision_id)) AS decision FROM eligibility_release_requirements WHERE content_hash NOT IN (SELECT content_hash FROM eligibility_release_requirements WHERE data_available_at IS NOT NULL AND content_hash IS NOT NULL) GROUP BY 1")
def pln15_unreleased_only(s, d):
    r = reviews(s, d)
    return r.join(r.where("data_available_at is not null").select("content_hash"), "content_hash", "left_anti").groupBy("content_hash").agg(F.max_by("decision_id", F.struct("seq_no", "decision_id")).alias("decision"))
