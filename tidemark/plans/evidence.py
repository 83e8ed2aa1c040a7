"""Queries on deliveries, ledgers, samples and plans: diffs, faults, broker state, windows, cohorts and gates, each beside its SQL."""
from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import records as R
from tidemark.functions import text as X
from tidemark.operators import pit
from tidemark.operators.ranks import exact_quantiles
from tidemark.plans.reference import ALL, CUT, CUT_SQL, N, bronze, filings, labels, news, observations, predictions, reviews, us
from tidemark.shared import materialize
from tidemark.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
CUT_US = pit.micros(CUT)
at_cut = lambda: F.timestamp_micros(F.lit(CUT_US))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- payload rules and diffs -------------------------------------------------------------------------------------

_STRICT = "regexp_matches({0}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}(\\.\\d{{1,6}})?(Z|[+-]\\d{{2}}:\\d{{2}})$') AND try_cast({0} AS TIMESTAMPTZ) IS NOT NULL"
_SQUEEZED = "nullif(trim(regexp_replace({0}, '\\s+', ' ', 'g')), '')"
_TOPIC_SOURCE = "CASE kafka_topic WHEN 'rss' THEN 'RSS' WHEN 'gdelt' THEN 'GDELT' WHEN 'sec' THEN 'SEC' END"
topic_source = lambda: F.when(F.col("kafka_topic") == "rss", "RSS").when(F.col("kafka_topic") == "gdelt", "GDELT").when(F.col("kafka_topic") == "sec", "SEC")


def _j(name: str, p: str = "p") -> str:
    return f"json_extract_string({p}, '$.{name}')"


_RULES = f"""WITH b AS (SELECT *, CASE WHEN json_valid(raw_payload) THEN raw_payload END AS p, {_TOPIC_SOURCE} AS expected FROM bronze_events_raw WHERE kafka_topic <> 'observations'),
 ruled AS (SELECT *, CASE WHEN raw_payload IS NULL THEN 'null payload' WHEN p IS NULL THEN 'not JSON' WHEN json_type(p) <> 'OBJECT' THEN 'not an object'
 WHEN NOT coalesce({_STRICT.format(_j('published_at'))}, FALSE) THEN 'published_at is no ISO time with offset' WHEN {_j('ingested_time')} IS NOT NULL AND NOT coalesce({_STRICT.format(_j('ingested_time'))}, FALSE) THEN 'ingested_time is no ISO time with offset'
 WHEN {_j('event_time')} IS NOT NULL AND NOT coalesce({_STRICT.format(_j('event_time'))}, FALSE) THEN 'event_time is no ISO time with offset' WHEN trim(coalesce({_j('id')}, '')) = '' OR trim(coalesce({_j('title')}, '')) = '' THEN 'blank id or title'
 WHEN {_j('source')} IS DISTINCT FROM expected THEN 'topic and source disagree' WHEN {_j('embedding')} IS NOT NULL AND coalesce(json_array_length(p, '$.embedding'), 0) <> 384 THEN 'embedding is not 384 finite numbers'
 WHEN {_j('semantic_score')} IS NOT NULL AND try_cast({_j('semantic_score')} AS DOUBLE) IS NULL THEN 'score is not finite' WHEN expected = 'SEC' AND {_j('metadata.accession_number')} <> '' AND {_j('metadata.accession_number')} <> {_j('id')} THEN 'accession number and id disagree' END AS error FROM b)"""


def _ruled(s, d):
    return bronze(s, d).where("kafka_topic <> 'observations'").withColumn("error", R.first_error(F.col("raw_payload"), topic_source()))


@query(f"{_RULES} SELECT kafka_topic, coalesce(error, 'valid') AS outcome, count(*) AS n FROM ruled GROUP BY 1, 2")
def val2_payload_rules(s, d):
    return _ruled(s, d).groupBy("kafka_topic", F.coalesce("error", F.lit("valid")).alias("outcome")).agg(ALL().alias("n"))


@query(f"{_RULES} SELECT DISTINCT kafka_topic, kafka_partition, kafka_offset, error FROM ruled WHERE error IS NOT NULL")
def flt5_rejections(s, d):
    return _ruled(s, d).where("error is not null").select("kafka_topic", "kafka_partition", "kafka_offset", "error").distinct()


def _instant(x: str) -> str:
    return f"CASE WHEN {_STRICT.format(x)} THEN epoch_us(try_cast({x} AS TIMESTAMPTZ))::VARCHAR ELSE {_SQUEEZED.format(x)} END"


def _diff_sql() -> str:
    both = lambda f: (f("o"), f("p"))
    squeezed = lambda n: both(lambda p: _SQUEEZED.format(_j(n, p)))
    sec, moved = f"coalesce({_j('source')} = 'SEC', FALSE)", f"(NOT coalesce({_j('source')} = 'SEC', FALSE) AND {_j('source', 'o')} IS DISTINCT FROM {_j('source')})"
    names = {"conflicts": [], "enrichment": [], "provenance": []}

    def record(group, name, pair, when="TRUE"):
        names[group].append(f"CASE WHEN ({pair[0]}) IS DISTINCT FROM ({pair[1]}) AND {when} THEN '{name}' END")

    def presence(name, pair, always, other):
        record("provenance", name, pair, f"({other} OR (NOT {always} AND ({pair[1]}) IS NULL))")
        record("conflicts", name, pair, f"(NOT {other} AND ({always} OR (({pair[0]}) IS NOT NULL AND ({pair[1]}) IS NOT NULL)))")
        record("enrichment", name, pair, f"(NOT {other} AND NOT {always} AND ({pair[0]}) IS NULL)")

    record("conflicts", "title", squeezed("title"))
    record("conflicts", "published_at", both(lambda p: _instant(_j("published_at", p))))
    presence("content_snippet", squeezed("content_snippet"), sec, moved)
    presence("content_full", squeezed("content_full"), sec, "FALSE")
    presence("event_time", both(lambda p: _instant(_j("event_time", p))), "FALSE", "FALSE")
    record("conflicts", "is_near_duplicate", squeezed("is_near_duplicate"))
    record("conflicts", "canonical_cluster_id", both(lambda p: f"coalesce(nullif({_j('canonical_cluster_id', p)}, ''), {_j('id', p)})"))
    padded = lambda x: f"CASE WHEN length({x}) < 10 THEN lpad({x}, 10, '0') ELSE {x} END"
    record("conflicts", "cik", both(lambda p: padded(_SQUEEZED.format(_j("metadata.cik", p)))), sec)
    record("conflicts", "form_type", both(lambda p: f"upper({_SQUEEZED.format(_j('metadata.form_type', p))})"), sec)
    record("conflicts", "company_name", squeezed("metadata.company_name"), sec)
    for n in ("embedding", "semantic_score", "schema_version"):
        record("enrichment", n, both(lambda p: _j(n, p)))
    record("enrichment", "tickers_mentioned", both(lambda p: f"coalesce(array_to_string(list_sort(list_distinct(list_transform(from_json(json_extract({p}, '$.tickers_mentioned'), '[\"VARCHAR\"]'), lambda t: upper(t)))), ','), '')"))
    record("provenance", "source", both(lambda p: _j("source", p)))
    record("provenance", "url", both(lambda p: _j("url", p)))
    record("provenance", "ingested_time", both(lambda p: _instant(_j("ingested_time", p))))
    meta = lambda p: f"coalesce(array_to_string(list_transform(list_sort(list_filter(json_keys({p}, '$.metadata'), lambda k: NOT ({sec} AND k IN ('cik', 'form_type', 'company_name', 'accession_number')))), lambda k: k || '=' || coalesce(json_extract_string({p}, '$.metadata.\"' || k || '\"'), '')), ','), '')"
    record("provenance", "metadata", both(meta))
    return ", ".join(f"concat_ws(',', {', '.join(v)}) AS {k}" for k, v in names.items())


_DIFF = f"""WITH b AS (SELECT kafka_topic, event_id, kafka_partition, kafka_offset, ingested_at, raw_payload AS p FROM bronze_events_raw WHERE kafka_topic <> 'observations' AND event_id IS NOT NULL AND json_valid(raw_payload) AND json_type(CASE WHEN json_valid(raw_payload) THEN raw_payload END) = 'OBJECT'),
 f AS (SELECT kafka_topic, event_id, arg_min(p, (ingested_at, kafka_partition, kafka_offset)) AS o FROM b GROUP BY 1, 2), j AS (SELECT DISTINCT kafka_topic, event_id, kafka_partition, kafka_offset, p, o FROM b JOIN f USING (kafka_topic, event_id)),
 diff AS (SELECT kafka_topic, event_id, kafka_partition, kafka_offset, {_diff_sql()} FROM j),
 stated AS (SELECT *, CASE WHEN conflicts <> '' THEN 'conflict' WHEN enrichment <> '' THEN 'enrichment' ELSE 'redelivery' END AS status FROM diff)"""


def _diffs(s, d):
    b = bronze(s, d).where(F.col("event_id").isNotNull() & (F.col("kafka_topic") != "observations") & R.is_object(F.col("raw_payload")))
    f = b.groupBy("kafka_topic", "event_id").agg(F.min_by("raw_payload", F.struct("ingested_at", "kafka_partition", "kafka_offset")).alias("o"))
    j = b.join(f, ["kafka_topic", "event_id"]).select("kafka_topic", "event_id", "kafka_partition", "kafka_offset", "raw_payload", "o").distinct()
    diff = j.withColumn("x", R.field_diff(F.col("o"), F.col("raw_payload")))
    return diff.select("kafka_topic", "event_id", "kafka_partition", "kafka_offset", "x.*", R.change_status(F.col("x")).alias("status"))


@query(f"{_DIFF} SELECT kafka_topic, event_id, kafka_partition, kafka_offset, conflicts, enrichment, provenance FROM stated WHERE conflicts <> '' OR enrichment <> '' OR provenance <> ''")
def cmp1_field_diff(s, d):
    return _diffs(s, d).where("conflicts <> '' or enrichment <> '' or provenance <> ''").drop("status")


@query(f"{_DIFF} SELECT kafka_topic, status, count(*) AS n FROM stated GROUP BY 1, 2")
def cmp2_status(s, d):
    return _diffs(s, d).groupBy("kafka_topic", "status").agg(ALL().alias("n"))


@query(f"{_DIFF} SELECT kafka_topic, kafka_partition, kafka_offset, conflicts FROM stated WHERE status = 'conflict'")
def flt5_conflicts(s, d):
    return _diffs(s, d).where("status = 'conflict'").select("kafka_topic", "kafka_partition", "kafka_offset", "conflicts")


@query("""WITH f AS (SELECT event_id AS id, arg_min(raw_payload, (ingested_at, kafka_topic, kafka_partition, kafka_offset)) AS p FROM bronze_events_raw WHERE kafka_topic IN ('rss', 'gdelt') AND json_valid(raw_payload) AND event_id IS NOT NULL GROUP BY 1)
 SELECT n.id, CASE WHEN p IS NULL THEN 'projection' ELSE 'first_event' END AS origin, CASE WHEN p IS NULL THEN n.title ELSE json_extract_string(p, '$.title') END AS title, CASE WHEN p IS NULL THEN n.published_time ELSE json_extract_string(p, '$.published_at') END AS published_at FROM silver_financial_news n LEFT JOIN f USING (id)""")
def cmp3_stored_event(s, d):
    """What a later delivery is compared with: the first delivery as it came, else what the silver row kept of it."""
    b = bronze(s, d).where(F.col("kafka_topic").isin("rss", "gdelt") & F.try_parse_json("raw_payload").isNotNull() & F.col("event_id").isNotNull())
    f = b.groupBy(F.col("event_id").alias("id")).agg(F.min_by("raw_payload", F.struct("ingested_at", "kafka_topic", "kafka_partition", "kafka_offset")).alias("p"))
    kept = F.col("p").isNull()
    pick = lambda name, own: F.when(kept, F.col(own)).otherwise(R.field(F.col("p"), name))
    return news(s, d).join(f, "id", "left").select("id", F.when(kept, "projection").otherwise("first_event").alias("origin"), pick("title", "title").alias("title"), pick("published_at", "published_time").alias("published_at"))


_MERGED = "list_transform(list_sort(list_filter(json_keys(metadata), lambda k: k <> 'author')), lambda k: k || '=' || coalesce(json_extract_string(metadata, '$.\"' || k || '\"'), ''))"


@query(f"SELECT id, array_to_string(list_concat({_MERGED}, ['source=' || source]), ',') AS merged FROM silver_financial_news WHERE metadata IS NOT NULL")
def jsn3_merged_metadata(s, d):
    """The metadata object without one field and with another appended, in key order."""
    return news(s, d).where("metadata is not null").select("id", F.concat_ws(",", F.array_join(F.array_sort(F.transform(
        F.map_entries(F.map_filter(F.from_json("metadata", "map<string,string>"), lambda k, v: k != "author")), lambda e: F.concat_ws("=", e["key"], F.coalesce(e["value"], F.lit(""))))), ","), F.concat(F.lit("source="), "source")).alias("merged"))


@query("SELECT kafka_topic, array_to_string(list_sort(list(k || '=' || n)), ',') AS counts FROM (SELECT kafka_topic, coalesce(provenance_status, 'none') AS k, count(*) AS n FROM bronze_events_raw GROUP BY 1, 2) GROUP BY 1")
def agg8_status_maps(s, d):
    """Counts by status as one map per topic (map1: built, sorted and read back as a map)."""
    c = bronze(s, d).groupBy("kafka_topic", F.coalesce("provenance_status", F.lit("none")).alias("k")).agg(ALL().alias("n"))
    m = c.groupBy("kafka_topic").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("m"))
    return m.select("kafka_topic", F.array_join(F.array_sort(F.transform(F.map_keys("m"), lambda k: F.concat_ws("=", k, F.element_at("m", k).cast("string")))), ",").alias("counts"))


# ---- deliveries: observations, faults, broker state --------------------------------------------------------------


@query("""WITH b AS (SELECT kafka_partition, kafka_offset, event_id, min(ingested_at) AS at FROM bronze_events_raw WHERE kafka_topic = 'observations' AND event_id IS NOT NULL GROUP BY 1, 2, 3)
 SELECT kafka_partition, kafka_offset, event_id, CASE WHEN row_number() OVER (PARTITION BY event_id ORDER BY b.at, kafka_partition, kafka_offset) = 1 THEN 'research_inserted' ELSE 'research_redelivery' END AS status FROM b""")
def snk4_observation_outcomes(s, d):
    b = bronze(s, d).where("kafka_topic = 'observations' and event_id is not null").groupBy("kafka_partition", "kafka_offset", "event_id").agg(F.min("ingested_at").alias("at"))
    me = F.struct("at", "kafka_partition", "kafka_offset")
    first = b.groupBy("event_id").agg(F.min(me).alias("first"))
    return b.join(first, "event_id").select("kafka_partition", "kafka_offset", "event_id", F.when(me == F.col("first"), "research_inserted").otherwise("research_redelivery").alias("status"))


@query("SELECT strftime(make_timestamp(first_us), '%Y-%m-%d') AS day, count(*) AS new_ids FROM (SELECT event_id, epoch_us(min(ingested_at)) AS first_us FROM bronze_events_raw WHERE kafka_topic IN ('rss', 'gdelt') AND event_id IS NOT NULL GROUP BY 1) GROUP BY 1")
def snk2_new_ids(s, d):
    first = bronze(s, d).where("kafka_topic in ('rss', 'gdelt') and event_id is not null").groupBy("event_id").agg(us(F.min("ingested_at")).alias("t"))
    return first.groupBy(F.date_from_unix_date(F.floor(F.col("t") / 86_400_000_000).cast("int")).cast("string").alias("day")).agg(ALL().alias("new_ids"))


_FAULT = "sha256('{\"headers\":[],\"key\":\"' || to_base64(encode(coalesce(kafka_key, ''))) || '\",\"offset\":' || coalesce(kafka_offset::VARCHAR, 'null') || ',\"partition\":' || coalesce(kafka_partition::VARCHAR, 'null') || ',\"payload\":\"' || to_base64(encode(coalesce(raw_payload, ''))) || '\",\"topic\":\"' || kafka_topic || '\"}')"


def fault_id(topic="kafka_topic", partition="kafka_partition", offset="kafka_offset", payload="raw_payload", key="kafka_key"):
    """SHA-256 of the coordinates, key, headers and payload as sorted JSON."""
    b64 = lambda c: F.regexp_replace(F.base64(F.encode(F.coalesce(c, F.lit("")), "UTF-8")), r"\r?\n", "")
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    return F.sha2(F.concat(F.lit('{"headers":[],"key":"'), b64(key), F.lit('","offset":'), number(offset), F.lit(',"partition":'), number(partition), F.lit(',"payload":"'), b64(payload), F.lit('","topic":"'), F.col(topic), F.lit('"}')), 256)


@query(f"SELECT {_FAULT} AS fault_id, count(*) AS occurrences FROM bronze_events_raw WHERE event_id IS NULL GROUP BY 1")
def mth14_fingerprints(s, d):
    return bronze(s, d).where("event_id is null").groupBy(fault_id().alias("fault_id")).agg(ALL().alias("occurrences"))


@query(f"""WITH f AS (SELECT {_FAULT} AS fault_id, min(kafka_topic) AS topic, epoch_us(min(ingested_at)) AS first_us, epoch_us(max(ingested_at)) AS last_us, count(*) AS occurrences FROM bronze_events_raw WHERE event_id IS NULL GROUP BY 1),
 r AS (SELECT *, topic IN ('rss', 'gdelt') AND first_us <= {CUT_US} AS resolved FROM f)
 SELECT fault_id, first_us, last_us, occurrences, CASE WHEN NOT resolved THEN 'open' WHEN last_us > {CUT_US} THEN 'reopened' ELSE 'resolved' END AS state FROM r""")
def snk7_resolution(s, d):
    """State of every fault after resolutions recorded at the cut-off (of the news topics' faults seen by then): a later occurrence reopens."""
    f = bronze(s, d).where("event_id is null").groupBy(fault_id().alias("fault_id")).agg(F.min("kafka_topic").alias("topic"), us(F.min("ingested_at")).alias("first_us"), us(F.max("ingested_at")).alias("last_us"), ALL().alias("occurrences"))
    notes = f.where(F.col("topic").isin("rss", "gdelt") & (F.col("first_us") <= CUT_US)).select("fault_id", F.lit(CUT_US).alias("resolved_us"))
    state = F.when(F.col("resolved_us").isNull(), "open").when(F.col("last_us") > F.col("resolved_us"), "reopened").otherwise("resolved")
    return f.join(notes, "fault_id", "left").select("fault_id", "first_us", "last_us", "occurrences", state.alias("state"))


_RETENTION_MS = 7 * 86_400_000
_BROKER = f"""WITH p AS (SELECT kafka_topic, kafka_partition, min(kafka_offset) AS log_start, max(kafka_offset) + 1 AS high, max(kafka_offset) FILTER (ingested_at <= {CUT_SQL}) + 1 AS committed FROM bronze_events_raw GROUP BY 1, 2),
 o AS (SELECT b.kafka_topic, b.kafka_partition, min(broker_timestamp_ms) AS oldest_unread_ms FROM bronze_events_raw b JOIN p USING (kafka_topic, kafka_partition) WHERE b.kafka_offset >= coalesce(p.committed, p.log_start) GROUP BY 1, 2)
 SELECT p.*, high - greatest(coalesce(committed, log_start), log_start) AS unread, oldest_unread_ms FROM p LEFT JOIN o USING (kafka_topic, kafka_partition)"""


def _broker(s, d):
    b = bronze(s, d)
    p = b.groupBy("kafka_topic", "kafka_partition").agg(F.min("kafka_offset").alias("log_start"), (F.max("kafka_offset") + 1).alias("high"), (F.max(F.when(pit.visible(F.col("ingested_at"), CUT), F.col("kafka_offset"))) + 1).alias("committed"))
    o = b.join(p, ["kafka_topic", "kafka_partition"]).where(F.col("kafka_offset") >= F.coalesce("committed", "log_start")).groupBy("kafka_topic", "kafka_partition").agg(F.min("broker_timestamp_ms").alias("oldest_unread_ms"))
    unread = F.col("high") - F.greatest(F.coalesce("committed", "log_start"), "log_start")
    return p.join(o, ["kafka_topic", "kafka_partition"], "left").select("kafka_topic", "kafka_partition", "log_start", "high", "committed", unread.alias("unread"), "oldest_unread_ms")


@query(_BROKER)
def src13_broker_state(s, d):
    return _broker(s, d)


@query(f"""WITH q AS ({_BROKER}), a AS (SELECT *, {CUT_US} // 1000 - oldest_unread_ms AS age_ms FROM q)
 SELECT kafka_topic || ':' || kafka_partition AS name, concat_ws('; ', CASE WHEN committed < log_start THEN (log_start - committed) || ' unread messages deleted' END, CASE WHEN unread > 0 AND age_ms > {_RETENTION_MS} * 0.5 THEN 'oldest unread message is ' || (age_ms // 3600000) || ' h old' END, CASE WHEN committed IS NULL THEN 'nothing committed' END) AS blockers FROM a""")
def val10_blockers(s, d):
    """What stands in the way of each partition, as text; empty where nothing does."""
    age = F.lit(CUT_US // 1000) - F.col("oldest_unread_ms")
    deleted = F.when(F.col("committed") < F.col("log_start"), F.concat((F.col("log_start") - F.col("committed")).cast("string"), F.lit(" unread messages deleted")))
    old = F.when((F.col("unread") > 0) & (age > _RETENTION_MS * 0.5), F.concat(F.lit("oldest unread message is "), F.floor(age / 3_600_000).cast("string"), F.lit(" h old")))
    return _broker(s, d).select(F.concat_ws(":", "kafka_topic", F.col("kafka_partition").cast("string")).alias("name"), F.concat_ws("; ", deleted, old, F.when(F.col("committed").isNull(), "nothing committed")).alias("blockers"))


@query("SELECT kafka_topic, epoch_us(ingested_at) AS batch_us, count(*) AS n, max(epoch_us(ingested_at) // 1000 - broker_timestamp_ms) AS most_delay_ms FROM bronze_events_raw GROUP BY 1, 2")
def str10_batch_delay(s, d):
    """Rows and storage delay of each committed batch."""
    return bronze(s, d).groupBy("kafka_topic", us("ingested_at").alias("batch_us")).agg(ALL().alias("n"), F.max(F.floor(us("ingested_at") / 1000) - F.col("broker_timestamp_ms")).alias("most_delay_ms"))


@query("SELECT kafka_topic, bucket, n, n - coalesce(lag(n) OVER (PARTITION BY kafka_topic ORDER BY bucket), 0) AS delta FROM (SELECT kafka_topic, epoch_us(ingested_at) // 5000000 AS bucket, count(*) AS n FROM bronze_events_raw GROUP BY 1, 2)")
def str12_throughput(s, d):
    """Messages per five seconds and their change; the frame runs over buckets."""
    c = bronze(s, d).groupBy("kafka_topic", F.floor(us("ingested_at") / 5_000_000).alias("bucket")).agg(ALL().alias("n"))
    return c.withColumn("delta", F.col("n") - F.coalesce(F.lag("n").over(Window.partitionBy("kafka_topic").orderBy("bucket")), F.lit(0)))


@query("SELECT kafka_topic, kafka_partition, count(DISTINCT kafka_offset) AS present, count(DISTINCT kafka_offset) FILTER (provenance_status = 'exact_bytes' AND event_id IS NOT NULL) AS complete, max(kafka_offset) - min(kafka_offset) + 1 AS expected, CASE WHEN count(DISTINCT kafka_offset) < max(kafka_offset) - min(kafka_offset) + 1 THEN 'rows missing' WHEN count(DISTINCT kafka_offset) FILTER (provenance_status = 'exact_bytes' AND event_id IS NOT NULL) < count(DISTINCT kafka_offset) THEN 'rows incomplete' ELSE 'reconciled' END AS verdict FROM bronze_events_raw GROUP BY 1, 2")
def agg19_reconcile(s, d):
    """Offsets of each partition against its range, in all and complete (pln8)."""
    k = ["kafka_topic", "kafka_partition"]
    offsets = bronze(s, d).groupBy(*k, "kafka_offset").agg(F.bool_or(F.coalesce((F.col("provenance_status") == "exact_bytes") & F.col("event_id").isNotNull(), F.lit(False))).alias("whole"))
    a = offsets.where("kafka_offset is not null").groupBy(*k).agg(ALL().alias("present"), N(F.col("whole")).alias("complete"), (F.max("kafka_offset") - F.min("kafka_offset") + 1).alias("expected"))
    return a.withColumn("verdict", F.when(F.col("present") < F.col("expected"), "rows missing").when(F.col("complete") < F.col("present"), "rows incomplete").otherwise("reconciled"))


@query("SELECT round(100.0 * (max((broker_timestamp_ms IS NOT NULL)::INT) + max((event_id IS NOT NULL)::INT) + max((kafka_topic = 'rss')::INT) + max((kafka_topic = 'sec')::INT) + max((coalesce(provenance_status = 'exact_bytes', FALSE))::INT) + (count(DISTINCT event_id) > 0)::INT) / 6)::INT AS score FROM bronze_events_raw")
def agg25_health(s, d):
    """Six checks in percent: broker seen, store seen, two topics with data, exact bytes kept, identifiers present."""
    tests = [F.col("broker_timestamp_ms").isNotNull(), F.col("event_id").isNotNull(), F.col("kafka_topic") == "rss", F.col("kafka_topic") == "sec", F.col("provenance_status") == "exact_bytes", F.col("event_id").isNotNull()]
    passed = sum((F.coalesce(F.max(t.cast("int")), F.lit(0)) for t in tests), F.lit(0))
    return bronze(s, d).agg(F.round(100.0 * passed / 6).cast("int").alias("score"))


_LATENCY = f"SELECT kafka_topic, kafka_offset, kafka_partition, broker_timestamp_ms - epoch_us(try_cast({_j('published_at', 'v')} AS TIMESTAMPTZ)) / 1000.0 AS l FROM (SELECT *, CASE WHEN json_valid(raw_payload) THEN raw_payload END AS v FROM bronze_events_raw) WHERE {_STRICT.format(_j('published_at', 'v'))}"


@query(f"SELECT kafka_topic, round(max(l) FILTER (r = n // 2), 3) AS p50, round(max(l) FILTER (r = floor(n * 0.95)), 3) AS p95, max(n) AS n FROM (SELECT *, row_number() OVER (PARTITION BY kafka_topic ORDER BY l) - 1 AS r, count(*) OVER (PARTITION BY kafka_topic) AS n FROM (SELECT * FROM (SELECT DISTINCT * FROM ({_LATENCY}) WHERE l >= 0) QUALIFY row_number() OVER (PARTITION BY kafka_topic ORDER BY kafka_offset DESC, kafka_partition, l) <= 200)) GROUP BY 1")
def agg26_latency_sample(s, d):
    """Publication to broker, negatives dropped, of the newest 200 messages of each topic; nearest ranks."""
    at = R.field(F.col("raw_payload"), "published_at")
    l = bronze(s, d).where(F.try_parse_json("raw_payload").isNotNull() & R.aware(at)).select("kafka_topic", "kafka_offset", "kafka_partition", (F.col("broker_timestamp_ms") - us(F.try_to_timestamp(at)) / F.lit(1000.0)).alias("l")).where("l >= 0").distinct()
    newest = l.withColumn("r", F.row_number().over(Window.partitionBy("kafka_topic").orderBy(F.desc("kafka_offset"), "kafka_partition", "l"))).where("r <= 200")
    q = exact_quantiles(newest, ["kafka_topic"], "l", {"p50": ("rank", 0.5), "p95": ("rank", 0.95)})
    return q.select("kafka_topic", F.round("p50", 3).alias("p50"), F.round("p95", 3).alias("p95"), "n")


_TTL_US = 7 * 86_400_000_000
_LEFT = f"SELECT {_TTL_US} - ({CUT_US} - max(epoch_us(ingested_at))) AS left_us FROM bronze_events_raw WHERE event_id IS NOT NULL AND ingested_at <= {CUT_SQL} GROUP BY kafka_topic, event_id"


@query(f"SELECT round(avg(left_us) / 1e6, 3) AS mean, round(min(left_us) / 1e6, 3) AS least, round(max(left_us) / 1e6, 3) AS most, (SELECT round(left_us / 1e6, 3) FROM (SELECT left_us, row_number() OVER (ORDER BY left_us) - 1 AS r, count(*) OVER () AS n FROM ({_LEFT}) WHERE left_us > 0) WHERE r = n // 2) AS upper_median, count(*) FILTER (left_us < 86400000000) AS soon FROM ({_LEFT}) WHERE left_us > 0")
def agg23_remaining_ttl(s, d):
    """Seconds that the seven-day keys still have at the cut-off; soon: under a day."""
    t = bronze(s, d).where(F.col("event_id").isNotNull() & pit.visible(F.col("ingested_at"), CUT)).groupBy("kafka_topic", "event_id").agg(us(F.max("ingested_at")).alias("t"))
    k = materialize(t.select((F.col("t") + _TTL_US - CUT_US).alias("left_us")).where("left_us > 0"), "ttl-left")
    a = k.agg(F.round(F.avg("left_us") / 1e6, 3).alias("mean"), F.round(F.min("left_us") / 1e6, 3).alias("least"), F.round(F.max("left_us") / 1e6, 3).alias("most"), N(F.col("left_us") < 86_400_000_000).alias("soon"))
    q = exact_quantiles(k.withColumn("g", F.lit(0)), ["g"], "left_us", {"m": ("rank", 0.5)}).select(F.round(F.col("m") / 1e6, 3).alias("upper_median"))
    return a.join(q)  # one row beside one row


@query("SELECT source, count(*) AS fetched, count(*) FILTER (is_near_duplicate) AS duplicates, count(*) FILTER (NOT is_near_duplicate) AS published, count(*) FILTER (trim(coalesce(title, '')) = '' OR event_time IS NULL) AS errors, round(100.0 * count(*) FILTER (is_near_duplicate) / count(*), 1)::DOUBLE AS dedup_rate, round(count(*) / ((epoch_us(max(ingested_time)) - epoch_us(min(ingested_time))) / 1000000.0), 6) AS per_second FROM silver_financial_news GROUP BY 1")
def agg24_source_sums(s, d):
    near, span = F.col("is_near_duplicate"), (us(F.max("ingested_time")) - us(F.min("ingested_time"))) / F.lit(1000000.0)
    return news(s, d).groupBy("source").agg(ALL().alias("fetched"), N(near).alias("duplicates"), N(~near).alias("published"), N((F.trim(F.coalesce("title", F.lit(""))) == "") | F.col("event_time").isNull()).alias("errors"), F.round(F.try_divide(100.0 * N(near), ALL()), 1).alias("dedup_rate"), F.round(F.try_divide(ALL(), span), 6).alias("per_second"))


@query("SELECT kafka_topic, kafka_partition FROM (SELECT DISTINCT kafka_topic, kafka_partition FROM bronze_events_raw)")
def agg7_partitions(s, d):
    return bronze(s, d).select("kafka_topic", "kafka_partition").distinct()


@query("SELECT count(DISTINCT article_id) AS articles, count(DISTINCT title) AS texts, count(DISTINCT id) AS versions FROM source_observations")
def agg6_distinct_counts(s, d):
    return observations(s, d).agg(F.countDistinct("article_id").alias("articles"), F.countDistinct("title").alias("texts"), F.countDistinct("id").alias("versions"))


@query(f"WITH a AS (SELECT DISTINCT kafka_topic, kafka_partition, kafka_offset FROM bronze_events_raw WHERE ingested_at <= {CUT_SQL}), b AS (SELECT DISTINCT kafka_topic, kafka_partition, kafka_offset FROM bronze_events_raw WHERE broker_timestamp_ms <= {CUT_US} // 1000) SELECT 'missing' AS side, * FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'added', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def set2_both_ways(s, d):
    """Rows produced but not stored by the cut-off, and the other way round."""
    k = ["kafka_topic", "kafka_partition", "kafka_offset"]
    a = bronze(s, d).where(pit.visible(F.col("ingested_at"), CUT)).select(k).distinct()
    b = bronze(s, d).where(F.col("broker_timestamp_ms") <= CUT_US // 1000).select(k).distinct()
    return b.subtract(a).select(F.lit("missing").alias("side"), *k).unionByName(a.subtract(b).select(F.lit("added").alias("side"), *k))


# ---- scans -------------------------------------------------------------------------------------------------------

_CATALOG = ["annotation_releases", "bronze_events_raw", "dedup_results", "documents", "prediction_releases", "silver_financial_news", "silver_sec_filings", "source_observations"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, TRUE AS present, count(*) AS n FROM {t}" for t in _CATALOG) + " UNION ALL SELECT 'no_such_table', FALSE, NULL")
def src10_catalog(s, d):
    from tidemark.sources.tables import exists

    found = [table(s, d, t).agg(ALL().alias("n")).select(F.lit(t).alias("name"), F.lit(True).alias("present"), "n") if exists(s, d, t) else s.range(1).select(F.lit(t).alias("name"), F.lit(False).alias("present"), F.lit(None).cast("long").alias("n")) for t in [*_CATALOG, "no_such_table"]]
    return reduce(lambda x, y: x.unionByName(y), found)


@query("SELECT range AS i, range % 4 AS partition, range // 4 AS off FROM range(10000)")
def src11_seed_rows(s, d):
    return s.range(10_000).select(F.col("id").alias("i"), F.pmod("id", F.lit(4)).alias("partition"), F.floor(F.col("id") / 4).alias("off"))


@query("SELECT accession_number, name, value FROM (UNPIVOT (SELECT accession_number, cik, company_name, form_type, schema_version FROM silver_sec_filings) ON cik, company_name, form_type, schema_version INTO NAME name VALUE value)")
def src12_rows_as_fields(s, d):
    f = filings(s, d).select("accession_number", "cik", "company_name", "form_type", "schema_version")
    return f.unpivot("accession_number", ["cik", "company_name", "form_type", "schema_version"], "name", "value").where("value is not null")


@query("SELECT decision_id, seq_no, content_hash, 'annotation' AS ledger, epoch_us(label_available_at) AS at_us FROM annotation_releases UNION ALL SELECT decision_id, seq_no, content_hash, 'eligibility', epoch_us(data_available_at) FROM eligibility_release_requirements")
def src9_ledger_scan(s, d):
    a = labels(s, d).select("decision_id", "seq_no", "content_hash", F.lit("annotation").alias("ledger"), us("label_available_at").alias("at_us"))
    return a.unionByName(reviews(s, d).select("decision_id", "seq_no", "content_hash", F.lit("eligibility").alias("ledger"), us("data_available_at").alias("at_us")))


# ---- joins -------------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT e.decision_id AS eligibility, a.decision_id AS annotation, e.content_hash FROM eligibility_release_requirements e JOIN annotation_releases a USING (content_hash)")
def jn4_decision_pairs(s, d):
    return reviews(s, d).select(F.col("decision_id").alias("eligibility"), "content_hash").distinct().join(labels(s, d).select(F.col("decision_id").alias("annotation"), "content_hash").distinct(), "content_hash").select("eligibility", "annotation", "content_hash")


@query("SELECT DISTINCT o.id, e.decision_id AS eligibility, a.decision_id AS annotation, p.model_revision FROM source_observations o LEFT JOIN eligibility_release_requirements e ON e.content_hash = o.id LEFT JOIN annotation_releases a ON a.content_hash = o.id LEFT JOIN prediction_releases p ON p.content_hash = o.id")
def jn5_ledger_chain(s, d):
    by = lambda t, c, n: t.select(F.col("content_hash").alias("id"), F.col(c).alias(n)).distinct()
    o = observations(s, d).select("id").distinct()
    return o.join(by(reviews(s, d), "decision_id", "eligibility"), "id", "left").join(by(labels(s, d), "decision_id", "annotation"), "id", "left").join(by(predictions(s, d), "model_revision", "model_revision"), "id", "left")


@query("SELECT p.content_hash, p.model_revision, CASE WHEN o.id IS NULL THEN 'no observation' WHEN a.content_hash IS NULL THEN 'no label' ELSE 'linked' END AS verdict FROM prediction_releases p LEFT JOIN (SELECT DISTINCT id FROM source_observations) o ON o.id = p.content_hash LEFT JOIN (SELECT DISTINCT content_hash FROM annotation_releases) a ON a.content_hash = p.content_hash")
def jn15_links(s, d):
    o = observations(s, d).select(F.col("id").alias("content_hash"), F.lit(True).alias("seen")).distinct()
    a = labels(s, d).select("content_hash", F.lit(True).alias("labelled")).distinct()
    return predictions(s, d).join(o, "content_hash", "left").join(a, "content_hash", "left").select("content_hash", "model_revision", F.when(F.col("seen").isNull(), "no observation").when(F.col("labelled").isNull(), "no label").otherwise("linked").alias("verdict"))


@query("SELECT h AS hint, r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey, (SELECT unnest(['broadcast', 'merge', 'shuffle_hash', 'shuffle_replicate_nl']) AS h) GROUP BY 1, 2")
def jn17_physical_joins(s, d):
    """The same join under each physical strategy (fixed tables of 25 and 5 rows)."""
    n, r = table(s, d, "nation"), table(s, d, "region")
    run = lambda h: n.join(r.hint(h), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(ALL().alias("n")).select(F.lit(h).alias("hint"), "r_name", "n")
    return reduce(lambda x, y: x.unionByName(y), map(run, ["broadcast", "merge", "shuffle_hash", "shuffle_replicate_nl"]))


@query("SELECT p.content_hash, p.model_revision, a.decision_id FROM prediction_releases p ASOF LEFT JOIN (SELECT content_hash, label_available_at, arg_max(decision_id, (seq_no, decision_id)) AS decision_id FROM annotation_releases WHERE label_available_at IS NOT NULL GROUP BY 1, 2) a ON p.content_hash = a.content_hash AND p.released_at > a.label_available_at WHERE p.released_at IS NOT NULL")
def jn18_asof(s, d):
    """As-of join by one frame over both sides: at equal instants an event comes before what it must not see."""
    a = labels(s, d).where("label_available_at is not null").groupBy("content_hash", us("label_available_at").alias("t")).agg(F.max_by("decision_id", F.struct("seq_no", "decision_id")).alias("decision_id"))
    p = predictions(s, d).where("released_at is not null").select("content_hash", us("released_at").alias("t"), "model_revision")
    both = p.withColumns({"decision_id": F.lit(None).cast("string"), "kind": F.lit(0)}).unionByName(a.withColumns({"model_revision": F.lit(None).cast("string"), "kind": F.lit(1)}))
    w = Window.partitionBy("content_hash").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("decision_id", F.last("decision_id", True).over(w)).where("kind = 0").select("content_hash", "model_revision", "decision_id")


@query("SELECT id, source FROM silver_financial_news WHERE coalesce(json_extract_string(metadata, '$.feed_name') NOT IN (SELECT publisher FROM publishers WHERE day_first), TRUE)")
def flt10_excluded_runs(s, d):
    """Rows whose run (feed) is not among the invalidated ones; rows without a run stay."""
    out = table(s, d, "publishers").where("day_first").select(F.col("publisher").alias("run"))
    n = news(s, d).select("id", "source", F.get_json_object("metadata", "$.feed_name").alias("run"))
    return n.join(out, "run", "left_anti").select("id", "source")


# ---- windows, samples, sets --------------------------------------------------------------------------------------


@query("SELECT source, feed, n, round(most / 60000000.0, 6) AS most_minutes, round(least / 60000000.0, 6) AS least_minutes FROM (SELECT source, feed, count(g) AS n, max(g) AS most, min(g) AS least FROM (SELECT source, feed, t - lag(t) OVER (PARTITION BY source, feed ORDER BY t) AS g FROM (SELECT DISTINCT source, json_extract_string(source_item, '$.feed_name') AS feed, epoch_us(observed_at) AS t FROM source_observations)) GROUP BY 1, 2)")
def win4_intervals(s, d):
    t = observations(s, d).select("source", F.get_json_object("source_item", "$.feed_name").alias("feed"), us("observed_at").alias("t")).distinct()
    g = t.withColumn("g", F.col("t") - F.lag("t").over(Window.partitionBy("source", "feed").orderBy("t")))
    minutes = lambda c: F.round(c / F.lit(60000000.0), 6)
    return g.groupBy("source", "feed").agg(F.count("g").alias("n"), minutes(F.max("g")).alias("most_minutes"), minutes(F.min("g")).alias("least_minutes"))


@query("SELECT content_hash, arg_max(release_kind, (label_available_at, seq_no, decision_id)) AS status, bool_or(sentiment IS NULL) AS unresolved_once FROM annotation_releases WHERE label_available_at IS NOT NULL GROUP BY 1")
def win9_last_status(s, d):
    return labels(s, d).where("label_available_at is not null").groupBy("content_hash").agg(F.max_by("release_kind", F.struct("label_available_at", "seq_no", "decision_id")).alias("status"), F.bool_or(F.col("sentiment").isNull()).alias("unresolved_once"))


@query("SELECT event_id, ntile(4) OVER w AS quarter, lead(event_id) OVER w AS next_event, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS of_three, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS in_hour FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def win10_frames(s, d):
    e = table(s, d, "events").select("event_id", "user_id", us(F.col("ts").cast("timestamp")).alias("t"))
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    return e.select("event_id", F.ntile(4).over(w).alias("quarter"), F.lead("event_id").over(w).alias("next_event"), F.count(F.lit(1)).over(w.rowsBetween(-2, 0)).alias("of_three"), F.count(F.lit(1)).over(Window.partitionBy("user_id").orderBy("t").rangeBetween(-3_600_000_000, 0)).alias("in_hour"))


@query("""WITH p AS (SELECT id, source, sha256('v1:' || id) AS h FROM silver_financial_news), q AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, id) AS r FROM p), t AS (SELECT * FROM q WHERE r <= 40),
 f AS (SELECT id, source, h FROM q WHERE r > 40 ORDER BY h, id LIMIT greatest(0, 120 - (SELECT count(*) FROM t))) SELECT id, source, 'quota' AS chosen FROM t UNION ALL SELECT id, source, 'fill' FROM f""")
def top5_quota_and_fill(s, d):
    """40 rows of each source by seeded hash, then the next by hash of all sources up to 120."""
    n = news(s, d).select("id", "source")
    quota = materialize(pit.hash_sample(n, "id", "source", "v1", 40).select("id", "source"), "quota")
    rest = n.join(quota.select("id"), "id", "left_anti").withColumn("h", F.sha2(F.concat(F.lit("v1:"), "id"), 256))
    fill = rest.orderBy("h", "id").limit(max(0, 120 - quota.count()))
    return quota.withColumn("chosen", F.lit("quota")).unionByName(fill.select("id", "source", F.lit("fill").alias("chosen")))


_SCORES = "SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id"


@query(f"SELECT a, arg_min(b, (-score, b)) AS best, max(score) AS score FROM ({_SCORES}) WHERE score >= 0.2 GROUP BY 1")
def top10_argmax(s, d):
    """The best other vector of every hundredth one (0.2 or more), the smaller id on a tie."""
    from tidemark.functions.vectors import block_pairs

    e = table(s, d, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    p = block_pairs(e.where("id % 100 = 0"), e, 0.1999).where("a <> b").select("a", "b", F.round("c", 6).alias("score")).where("score >= 0.2")
    return p.groupBy("a").agg(F.min_by("b", F.struct(-F.col("score"), "b")).alias("best"), F.max("score").alias("score"))


@query("SELECT article_id, 'story-' || sha256(string_agg(id, chr(10) ORDER BY id))[1:16] AS story_id, count(*) AS members FROM (SELECT DISTINCT article_id, id FROM source_observations WHERE article_id IS NOT NULL) GROUP BY 1")
def arr4_story_ids(s, d):
    """Stories as sorted member lists with an identity of their own (a story's members are the versions of one link)."""
    m = observations(s, d).where("article_id is not null").groupBy("article_id").agg(F.array_sort(F.collect_set("id")).alias("m"))
    return m.select("article_id", X.story_id(F.col("m")).alias("story_id"), F.size("m").cast("long").alias("members"))


@query("SELECT article_id, CASE WHEN count(*) = 1 THEN 'alone' ELSE 'multi' END AS kind, count(*) AS members, CASE WHEN count(*) > 1 THEN 'same link' END AS reason, NULL::VARCHAR AS error FROM (SELECT DISTINCT article_id, id FROM source_observations WHERE article_id IS NOT NULL) GROUP BY 1")
def txt18_answers(s, d):
    """Groupings written in the answer grammar and parsed back."""
    m = observations(s, d).where("article_id is not null").groupBy("article_id").agg(F.array_sort(F.collect_set("id")).alias("m"))
    numbers = F.array_join(F.transform("m", lambda x: F.pmod(F.xxhash64(x), F.lit(10**9)).cast("string")), " ")
    line = F.when(F.size("m") == 1, F.concat(F.lit("alone: "), numbers)).otherwise(F.concat(F.lit("  story: "), numbers, F.lit(" | same link  # checked")))
    p = m.select("article_id", X.parse_answer(line).alias("p"))
    return p.select("article_id", "p.kind", F.size("p.numbers").cast("long").alias("members"), "p.reason", "p.error")


# ---- text, times, hashes -----------------------------------------------------------------------------------------

_TICKERS = "list_filter(list_distinct(list_concat(regexp_extract_all(title, '\\$([A-Z]{1,5})\\b', 1), regexp_extract_all(title, '\\b([A-Z]{2,5})\\b', 1))), lambda t: t NOT IN (" + ", ".join(f"'{w}'" for w in X.LEGACY_NO_TICKER) + "))"


@query(f"SELECT id, array_to_string(list_sort({_TICKERS})[1:10], ',') AS tickers FROM silver_financial_news WHERE title IS NOT NULL")
def txt8_tickers(s, d):
    return news(s, d).where("title is not null").select("id", F.array_join(X.tickers(F.col("title")), ",").alias("tickers"))


@query("SELECT round(s / 20.0, 2)::DOUBLE AS similarity, round(1 - (1 - (s / 20.0) ** 4) ** 32, 6) AS probability FROM (SELECT unnest(range(0, 21)) AS s)")
def mth10_s_curve(s, d):
    """Probability that two sets meet in one of 32 bands of four minimum hashes."""
    x = F.col("id") / 20.0
    return s.range(21).select(F.round(x, 2).alias("similarity"), F.round(1 - F.pow(1 - F.pow(x, 4), 32), 6).alias("probability"))


_HASHES = "SELECT kafka_topic, event_id, arg_max(sha256(raw_payload), (ingested_at, kafka_partition, kafka_offset)) AS h FROM bronze_events_raw WHERE event_id IS NOT NULL AND raw_payload IS NOT NULL AND ingested_at"


@query(f"WITH o AS ({_HASHES} <= {CUT_SQL} GROUP BY 1, 2), n AS ({_HASHES} > {CUT_SQL} GROUP BY 1, 2) SELECT kafka_topic, CASE WHEN o.h IS NULL THEN 'extra' WHEN n.h IS NULL THEN 'missing' WHEN o.h <> n.h THEN 'changed' ELSE 'same' END AS verdict, count(*) AS n FROM o FULL JOIN n USING (kafka_topic, event_id) GROUP BY 1, 2")
def mth15_manifest_diff(s, d):
    """Two states of the messages by hash: same, changed, missing, extra."""
    b = bronze(s, d).where("event_id is not null and raw_payload is not null")
    last = lambda df, n: df.groupBy("kafka_topic", "event_id").agg(F.max_by(F.sha2("raw_payload", 256), F.struct("ingested_at", "kafka_partition", "kafka_offset")).alias(n))
    j = last(b.where(F.col("ingested_at") <= at_cut()), "o").join(last(b.where(F.col("ingested_at") > at_cut()), "n"), ["kafka_topic", "event_id"], "full")
    return j.groupBy("kafka_topic", F.when(F.col("o").isNull(), "extra").when(F.col("n").isNull(), "missing").when(F.col("o") != F.col("n"), "changed").otherwise("same").alias("verdict")).agg(ALL().alias("n"))


@query(f"SELECT id, CASE WHEN {_STRICT.format('published_time')} THEN 'feed:published' WHEN event_time IS NOT NULL THEN 'feed:updated' ELSE 'ingestion_fallback' END AS origin, CASE WHEN {_STRICT.format('published_time')} THEN epoch_us(try_cast(published_time AS TIMESTAMPTZ)) WHEN event_time IS NOT NULL THEN epoch_us(event_time) ELSE epoch_us(ingested_time) END AS at_us FROM silver_financial_news")
def dt3_feed_time(s, d):
    """First usable of the feed's own times, else the ingestion time, and which it was."""
    ok = R.aware(F.col("published_time"))
    return news(s, d).select("id", F.when(ok, "feed:published").when(F.col("event_time").isNotNull(), "feed:updated").otherwise("ingestion_fallback").alias("origin"), F.coalesce(F.when(ok, us(F.try_to_timestamp("published_time"))), us("event_time"), us("ingested_time")).alias("at_us"))


@query(f"WITH p AS (SELECT DISTINCT event_id AS id, {_j('published_at', 'v')} AS a FROM (SELECT *, CASE WHEN json_valid(raw_payload) THEN raw_payload END AS v FROM bronze_events_raw) WHERE kafka_topic IN ('rss', 'gdelt')) SELECT n.id, a = published_time AS same_text, try_cast(a AS TIMESTAMPTZ) = try_cast(published_time AS TIMESTAMPTZ) AS same_instant FROM silver_financial_news n JOIN p USING (id) WHERE {_STRICT.format('a')} AND {_STRICT.format('published_time')}")
def dt6_same_instant(s, d):
    """Delivered and stored time texts compared as instants, whatever their offsets."""
    p = bronze(s, d).where(F.col("kafka_topic").isin("rss", "gdelt") & F.try_parse_json("raw_payload").isNotNull()).select(F.col("event_id").alias("id"), R.field(F.col("raw_payload"), "published_at").alias("a")).distinct()
    j = news(s, d).select("id", "published_time").join(p, "id").where(R.aware(F.col("a")) & R.aware(F.col("published_time")))
    return j.select("id", (F.col("a") == F.col("published_time")).alias("same_text"), (F.try_to_timestamp("a") == F.try_to_timestamp("published_time")).alias("same_instant"))


# ---- streams as batches, groupings -------------------------------------------------------------------------------


@query("SELECT start * 1800000000 AS start_us, event_type, count(*) AS n FROM (SELECT event_type, unnest([epoch_us(ts) // 1800000000, epoch_us(ts) // 1800000000 - 1]) AS start FROM events) GROUP BY 1, 2")
def str13_sliding(s, d):
    e = table(s, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("t", "1 hour", "30 minutes").alias("w"), "event_type").agg(ALL().alias("n")).select(us("w.start").alias("start_us"), "event_type", "n")


@query("SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 1800000000 AS end_us, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, (coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= 1800000000, TRUE))::INT AS fresh FROM events)) GROUP BY user_id, g")
def str13_sessions(s, d):
    e = table(s, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy(F.session_window("t", "30 minutes").alias("w"), "user_id").agg(ALL().alias("n")).select("user_id", us("w.start").alias("start_us"), us("w.end").alias("end_us"), "n")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag) * 2 + grouping(l_linestatus) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def agg22_rollup(s, d):
    return table(s, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(ALL().alias("n"), F.grouping_id().alias("g"))


@query("SELECT o_orderstatus, o_orderpriority, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def agg22_grouping_sets(s, d):
    o = table(s, d, "orders")
    return o.groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(F.countDistinct("o_custkey").alias("customers"))


@query("SELECT count(DISTINCT l_orderkey) AS exact, TRUE AS close FROM lineitem")
def agg22_approximate(s, d):
    """The approximate distinct count within three of its standard deviations of the exact one."""
    a = table(s, d, "lineitem").agg(F.countDistinct("l_orderkey").alias("exact"), F.approx_count_distinct("l_orderkey", 0.02).alias("about"))
    return a.select("exact", (F.abs(F.col("about") - F.col("exact")) <= 0.06 * F.col("exact")).alias("close"))


_REPLICATES = 20


@query(f"""WITH l AS (SELECT content_hash, arg_max_null(sentiment, (label_available_at, seq_no, decision_id)) AS actual FROM annotation_releases WHERE label_available_at IS NOT NULL GROUP BY 1),
 j AS (SELECT p.content_hash, p.model_revision, l.actual, p.predicted_label AS guess, 1.0::DOUBLE / count(*) OVER (PARTITION BY p.content_hash) AS w FROM prediction_releases p JOIN l USING (content_hash) WHERE p.released_at IS NOT NULL AND l.actual IS NOT NULL),
 b AS (SELECT j.*, r.r AS replicate, CASE WHEN r.r = 0 THEN 1 ELSE ascii(md5(r.r || ':' || content_hash)[1:1]) % 3 END * w AS bw FROM j, (SELECT unnest(range(0, {_REPLICATES + 1})) AS r) r),
 s AS (SELECT model_revision, replicate, label, sum(tp) AS tp, sum(x) AS x FROM (SELECT model_revision, replicate, actual AS label, CASE WHEN actual = guess THEN bw ELSE 0 END AS tp, bw AS x FROM b UNION ALL SELECT model_revision, replicate, guess, 0, bw FROM b) GROUP BY 1, 2, 3)
 SELECT model_revision, replicate, round(avg(coalesce(2 * tp / nullif(x, 0), 0)), 6) AS macro_f1 FROM s GROUP BY 1, 2""")
def agg21_macro_f1(s, d):
    """Macro F1 of every model with one unit of weight per content, and group bootstrap: replicate 0 is the data, in the others
    each content counts 0, 1 or 2 times by a seeded hash. Two rows per prediction and replicate are summed at once."""
    l = labels(s, d).where("label_available_at is not null").groupBy("content_hash").agg(F.max_by("sentiment", F.struct("label_available_at", "seq_no", "decision_id")).alias("actual")).where("actual is not null")
    p = predictions(s, d).where("released_at is not null").join(l, "content_hash")
    p = p.join(p.groupBy("content_hash").agg(ALL().alias("k")), "content_hash").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(_REPLICATES))))
    times = F.when(F.col("replicate") == 0, 1).otherwise(F.ascii(F.substring(F.md5(F.concat_ws(":", F.col("replicate").cast("string"), "content_hash")), 1, 1)) % 3)
    b = p.withColumn("w", times * (1.0 / F.col("k")))
    hit = F.when(F.col("actual") == F.col("predicted_label"), F.col("w")).otherwise(0.0)
    sides = b.select("model_revision", "replicate", F.explode(F.array(F.struct(F.col("actual").alias("label"), hit.alias("tp"), "w"), F.struct(F.col("predicted_label").alias("label"), F.lit(0.0).alias("tp"), "w"))).alias("s"))
    f1 = sides.groupBy("model_revision", "replicate", "s.label").agg(F.sum("s.tp").alias("tp"), F.sum("s.w").alias("x"))
    return f1.groupBy("model_revision", "replicate").agg(F.round(F.avg(F.coalesce(F.try_divide(2 * F.col("tp"), F.col("x")), F.lit(0.0))), 6).alias("macro_f1"))


# ---- ledgers, windows and cohorts --------------------------------------------------------------------------------


@query("SELECT DISTINCT id, CASE WHEN content_hash IS DISTINCT FROM id THEN 'hash differs' WHEN trim(coalesce(article_id, '')) = '' THEN 'no article' ELSE 'verified' END AS verdict FROM source_observations")
def val4_observation_identity(s, d):
    return observations(s, d).select("id", F.when(~F.col("content_hash").eqNullSafe(F.col("id")), "hash differs").when(F.trim(F.coalesce("article_id", F.lit(""))) == "", "no article").otherwise("verified").alias("verdict")).distinct()


@query("SELECT DISTINCT decision_id, seq_no, content_hash, CASE WHEN trim(coalesce(annotator, '')) = '' THEN 'no annotator' WHEN sentiment NOT IN ('positive', 'negative', 'neutral') THEN 'unknown sentiment' WHEN sentiment IS NULL AND label_available_at IS NOT NULL THEN 'unresolved' WHEN release_kind NOT IN ('initial', 'recovery') THEN 'unknown kind' ELSE 'consistent' END AS verdict FROM annotation_releases")
def val5_annotation_rules(s, d):
    """The rules of a judgment that this table's columns can break, in order."""
    verdict = (F.when(F.trim(F.coalesce("annotator", F.lit(""))) == "", "no annotator").when(~F.col("sentiment").isin("positive", "negative", "neutral"), "unknown sentiment")
                .when(F.col("sentiment").isNull() & F.col("label_available_at").isNotNull(), "unresolved").when(~F.col("release_kind").isin("initial", "recovery"), "unknown kind").otherwise("consistent"))
    return labels(s, d).select("decision_id", "seq_no", "content_hash", verdict.alias("verdict")).distinct()


@query("""SELECT content_hash, decision_id, seq_no, CASE WHEN before_sealed IS NULL AND r > 1 THEN 'earlier one unreleased' WHEN label_available_at IS NULL THEN 'unreleased' WHEN label_available_at <= before_sealed THEN 'clock stands' ELSE 'advances' END AS verdict
 FROM (SELECT *, row_number() OVER w AS r, lag(label_available_at) OVER w AS before_sealed FROM (SELECT DISTINCT content_hash, decision_id, seq_no, label_available_at FROM annotation_releases) WINDOW w AS (PARTITION BY content_hash ORDER BY seq_no, decision_id))""")
def val7_revision_chain(s, d):
    """Each revision against the one before it: that one must be released, and the clock must have advanced."""
    c = labels(s, d).select("content_hash", "decision_id", "seq_no", "label_available_at").distinct()
    w = Window.partitionBy("content_hash").orderBy("seq_no", "decision_id")
    c = c.withColumns({"r": F.row_number().over(w), "b": F.lag("label_available_at").over(w)})
    verdict = F.when(F.col("b").isNull() & (F.col("r") > 1), "earlier one unreleased").when(F.col("label_available_at").isNull(), "unreleased").when(F.col("label_available_at") <= F.col("b"), "clock stands").otherwise("advances")
    return c.select("content_hash", "decision_id", "seq_no", verdict.alias("verdict"))


@query("WITH m AS (SELECT min(model_revision) AS r FROM prediction_releases), o AS (SELECT content_hash, predicted_label FROM prediction_releases, m WHERE model_revision = r), n AS (SELECT content_hash, model_revision, predicted_label FROM prediction_releases, m WHERE model_revision <> r) SELECT coalesce(n.content_hash, o.content_hash) AS content_hash, model_revision, CASE WHEN o.content_hash IS NULL THEN 'inserted' WHEN n.content_hash IS NULL THEN 'not repeated' WHEN o.predicted_label IS NOT DISTINCT FROM n.predicted_label THEN 'identical' ELSE 'mismatched' END AS verdict FROM o FULL JOIN n ON o.content_hash = n.content_hash")
def val8_rerun_compare(s, d):
    """Stored predictions (the least revision) against a re-run (the others); nothing is rewritten."""
    p = predictions(s, d)
    least = p.agg(F.min("model_revision").alias("r")).first()["r"]
    o = p.where(F.col("model_revision") == least).select("content_hash", F.col("predicted_label").alias("was"), F.lit(True).alias("had"))
    n = p.where(F.col("model_revision") != least).select("content_hash", "model_revision", F.col("predicted_label").alias("now"), F.lit(True).alias("has"))
    verdict = F.when(F.col("had").isNull(), "inserted").when(F.col("has").isNull(), "not repeated").when(F.col("was").eqNullSafe(F.col("now")), "identical").otherwise("mismatched")
    return o.join(n, "content_hash", "full").select("content_hash", "model_revision", verdict.alias("verdict"))


@query(f"""SELECT (SELECT count(*) FILTER (NOT coalesce(is_near_duplicate, FALSE) AND trim(coalesce(title, '')) <> '' AND (source = 'RSS' OR source = 'GDELT' AND json_extract_string(metadata, '$.title_provenance') = 'source_api')) >= 100 AND count(*) FILTER (trim(coalesce(title, '')) = '') = 0 AND count(*) FILTER (event_time > ingested_time) = 0 FROM silver_financial_news) AS headline_prototype,
 (SELECT count(DISTINCT source) = 2 FROM silver_financial_news WHERE source IN ('RSS', 'GDELT')) AND (SELECT count(*) > 0 FROM silver_sec_filings) AS all_sources_present,
 (SELECT {CUT_US} - epoch_us(max(t)) BETWEEN 0 AND 86400000000 FROM (SELECT max(ingested_time) AS t FROM silver_financial_news UNION ALL SELECT max(ingested_time) FROM silver_sec_filings)) AS fresh_collection,
 (SELECT epoch_us(max(t)) - epoch_us(min(t)) >= 259200000000 FROM (SELECT unnest([min(ingested_time), max(ingested_time)]) AS t FROM silver_financial_news UNION ALL SELECT unnest([min(ingested_time), max(ingested_time)]) FROM silver_sec_filings)) AS record_span,
 (SELECT count(*) = 0 FROM bronze_events_raw WHERE event_id IS NULL) AS no_unresolved_faults, (SELECT count(*) = 0 FROM silver_financial_news WHERE canonical_cluster_id IS NOT NULL AND canonical_cluster_id NOT IN (SELECT id FROM silver_financial_news)) AS references_valid""")
def val9_readiness(s, d):
    """Gates that these tables can answer; every part is one row."""
    n, f = news(s, d), filings(s, d)
    eligible = ~F.coalesce("is_near_duplicate", F.lit(False)) & (F.trim(F.coalesce("title", F.lit(""))) != "") & ((F.col("source") == "RSS") | ((F.col("source") == "GDELT") & F.coalesce(F.get_json_object("metadata", "$.title_provenance") == "source_api", F.lit(False))))
    a = n.agg(N(eligible).alias("e"), N(F.trim(F.coalesce("title", F.lit(""))) == "").alias("blank"), N(F.col("event_time") > F.col("ingested_time")).alias("early"), F.countDistinct(F.when(F.col("source").isin("RSS", "GDELT"), F.col("source"))).alias("sources"), us(F.min("ingested_time")).alias("n0"), us(F.max("ingested_time")).alias("n1"))
    b = f.agg(ALL().alias("filed"), us(F.min("ingested_time")).alias("f0"), us(F.max("ingested_time")).alias("f1"))
    c = bronze(s, d).agg((N(F.col("event_id").isNull()) == 0).alias("no_unresolved_faults"))
    dangling = n.where("canonical_cluster_id is not null").select(F.col("canonical_cluster_id").alias("id")).join(n.select("id"), "id", "left_anti").agg((ALL() == 0).alias("references_valid"))
    last, first = F.greatest("n1", "f1"), F.least("n0", "f0")
    return a.join(b).join(c).join(dangling).select(((F.col("e") >= 100) & (F.col("blank") == 0) & (F.col("early") == 0)).alias("headline_prototype"), ((F.col("sources") == 2) & (F.col("filed") > 0)).alias("all_sources_present"),
        (F.lit(CUT_US) - last).between(0, 86_400_000_000).alias("fresh_collection"), (last - first >= 259_200_000_000).alias("record_span"), "no_unresolved_faults", "references_valid")


_BOUNDS = ["2025-12-15T00:00:00+00:00", "2026-01-15T00:00:00+00:00", "2026-02-15T00:00:00+00:00", "2026-03-15T00:00:00+00:00"]
_BOUND_US = [pit.micros(b) for b in _BOUNDS]
_BUDGET = 64
_FIT = f"""WITH v AS (SELECT id, min(available_at) AS available_at FROM source_observations WHERE available_at IS NOT NULL GROUP BY 1), b AS (SELECT unnest(range(0, 3)) AS w, unnest([{', '.join(map(str, _BOUND_US[:3]))}]) AS t),
 e AS (SELECT b.w, a.content_hash, arg_max(a.decision_id, (a.label_available_at, a.seq_no, a.decision_id)) AS decision FROM b JOIN annotation_releases a ON epoch_us(a.label_available_at) < b.t JOIN v ON v.id = a.content_hash AND epoch_us(v.available_at) < b.t GROUP BY 1, 2),
 c AS (SELECT *, decision IS DISTINCT FROM lag(decision) OVER (PARTITION BY content_hash ORDER BY w) AS changed FROM e),
 r AS (SELECT *, row_number() OVER (PARTITION BY w, changed ORDER BY sha256('17:' || content_hash), content_hash) AS place FROM c)
 SELECT p.policy, w, content_hash, decision FROM r, (SELECT unnest(['frozen', 'retrain', 'sequential', 'replay']) AS policy) p WHERE w = 0 OR policy = 'retrain' OR (policy IN ('sequential', 'replay') AND changed) OR (policy = 'replay' AND place <= {_BUDGET})"""


@query(_FIT)
def pln2_policies(s, d):
    """What each adaptation policy fits at the start of each window: frozen only the first window's labels, retrain all eligible
    ones, sequential those that changed, replay also a bounded seeded sample of the others (top6, per window)."""
    v = observations(s, d).where("available_at is not null").groupBy(F.col("id").alias("content_hash")).agg(us(F.min("available_at")).alias("v"))
    a = labels(s, d).where("label_available_at is not null").join(v, "content_hash").withColumn("ready", F.greatest(us("label_available_at"), "v"))
    first = sum([(F.col("ready") >= b).cast("int") for b in _BOUND_US[:3]], F.lit(0))
    a = a.withColumn("f", first).where("f < 3").withColumn("w", F.explode(F.sequence("f", F.lit(2))))
    e = a.groupBy("w", "content_hash").agg(F.max_by("decision_id", F.struct("label_available_at", "seq_no", "decision_id")).alias("decision"))
    c = e.withColumn("changed", ~F.col("decision").eqNullSafe(F.lag("decision").over(Window.partitionBy("content_hash").orderBy("w"))))
    older = c.where(~F.col("changed")).withColumn("place", F.row_number().over(Window.partitionBy("w").orderBy(F.sha2(F.concat(F.lit("17:"), "content_hash"), 256), "content_hash"))).where(F.col("place") <= _BUDGET).drop("place").withColumn("kept", F.lit(True))
    r = c.join(older.select("w", "content_hash", "kept"), ["w", "content_hash"], "left").withColumn("policy", F.explode(F.array(*map(F.lit, ["frozen", "retrain", "sequential", "replay"]))))
    p = F.col("policy")
    fits = (F.col("w") == 0) | (p == "retrain") | (p.isin("sequential", "replay") & F.col("changed")) | ((p == "replay") & F.coalesce("kept", F.lit(False)))
    return r.where(fits).select("policy", "w", "content_hash", "decision")


@query(f"""WITH v AS (SELECT id, any_value(article_id) AS c, epoch_us(min(available_at)) AS t FROM source_observations WHERE available_at IS NOT NULL AND article_id IS NOT NULL GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY t, id) = 1 AS first FROM v)
 SELECT id, CASE WHEN t < {_BOUND_US[1]} THEN 0 WHEN t < {_BOUND_US[2]} THEN 1 ELSE 2 END AS w, first AS independent FROM r WHERE t >= {_BOUND_US[0]} AND t < {_BOUND_US[3]}""")
def pln2_cohort(s, d):
    """The evaluation cohort common to all policies: a version is independent where its cluster was never seen before."""
    v = observations(s, d).where("available_at is not null and article_id is not null").groupBy("id").agg(F.first("article_id").alias("c"), us(F.min("available_at")).alias("t"))
    first = v.groupBy("c").agg(F.min(F.struct("t", "id"))["id"].alias("first"))
    w = sum([(F.col("t") >= b).cast("int") for b in _BOUND_US[1:3]], F.lit(0))
    return v.where((F.col("t") >= _BOUND_US[0]) & (F.col("t") < _BOUND_US[3])).join(first, "c").select("id", w.alias("w"), (F.col("id") == F.col("first")).alias("independent"))


@query("""WITH o AS (SELECT id, min(available_at) AS at, min(content_hash) AS h FROM source_observations GROUP BY 1), l AS (SELECT DISTINCT content_hash, decision_id, label_available_at FROM annotation_releases), n AS (SELECT *, count(*) OVER (PARTITION BY content_hash, label_available_at) AS k FROM l)
 SELECT n.content_hash, decision_id, CASE WHEN o.id IS NULL OR o.h IS DISTINCT FROM n.content_hash THEN 'unknown content' WHEN label_available_at < o.at THEN 'before data' WHEN label_available_at IS NOT NULL AND k > 1 THEN 'ambiguous revision' ELSE 'valid' END AS verdict FROM n LEFT JOIN o ON o.id = n.content_hash""")
def pln3_label_rules(s, d):
    """Labels against the exact content version, its availability, and other revisions of the same instant."""
    o = observations(s, d).groupBy(F.col("id").alias("content_hash")).agg(F.min("available_at").alias("at"), F.min("content_hash").alias("h"))
    l = labels(s, d).select("content_hash", "decision_id", "label_available_at").distinct()
    l = l.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("content_hash", "label_available_at")))
    verdict = (F.when(~F.col("h").eqNullSafe(F.col("content_hash")) | F.col("h").isNull(), "unknown content").when(F.col("label_available_at") < F.col("at"), "before data")
                .when(F.col("label_available_at").isNotNull() & (F.col("k") > 1), "ambiguous revision").otherwise("valid"))
    return l.join(o, "content_hash", "left").select("content_hash", "decision_id", verdict.alias("verdict"))


@query(f"SELECT content_hash, arg_max(decision_id, (label_available_at, seq_no, decision_id)) AS decision_id FROM annotation_releases WHERE label_available_at < {CUT_SQL} AND annotator = 'reader-1' GROUP BY 1")
def pln6_one_annotator(s, d):
    a = labels(s, d).where(pit.released(F.col("label_available_at"), CUT) & (F.col("annotator") == "reader-1"))
    return a.groupBy("content_hash").agg(F.max_by("decision_id", F.struct("label_available_at", "seq_no", "decision_id")).alias("decision_id"))


@query(f"WITH r AS (SELECT DISTINCT content_hash FROM annotation_releases WHERE label_available_at < {CUT_SQL}) SELECT article_id, arg_min(id, (available_at, observed_at, id)) AS anchor, count(DISTINCT id) AS members FROM source_observations WHERE available_at IS NOT NULL AND article_id IN (SELECT article_id FROM source_observations WHERE id IN (SELECT content_hash FROM r)) GROUP BY 1")
def pln7_story_anchors(s, d):
    """Stories of which a judgment was released before the cut-off, each with its first available member."""
    r = labels(s, d).where(pit.released(F.col("label_available_at"), CUT)).select(F.col("content_hash").alias("id")).distinct()
    o = observations(s, d)
    told = o.join(r, "id", "left_semi").select("article_id").distinct()
    return o.where("available_at is not null").join(told, "article_id", "left_semi").groupBy("article_id").agg(F.min_by("id", F.struct("available_at", "observed_at", "id")).alias("anchor"), F.countDistinct("id").alias("members"))
