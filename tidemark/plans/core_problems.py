"""Queries of the core problems (2 to 5) over the project's tables, and their SQL where SQL can say the same."""
from pyspark.sql import functions as F

from tidemark.operators.instants import found_instants, named_fields, read_instants
from tidemark.operators.known import as_known, predictions_as_known
from tidemark.operators.late import period_report, period_text, replay
from tidemark.operators.redelivery import kept_messages, redelivered_messages
from tidemark.sources.tables import table


def p2_found(spark, d):
    return redelivered_messages(table(spark, d, "bronze_events_raw"))


def p2_kept(spark, d):
    return kept_messages(table(spark, d, "bronze_events_raw"))


def _fields(spark, d):
    t = lambda n: table(spark, d, n)
    return named_fields(t("silver_financial_news"), t("silver_sec_filings"), t("source_observations"), t("publishers"), t("zone_labels"))


def p3_found(spark, d):
    return found_instants(_fields(spark, d))


def p3_status(spark, d):
    """Records by status and reading, with the least and mean posterior of the reading chosen (null where none was)."""
    p = F.col("time_posterior")
    return _fields(spark, d).groupBy("field_name", "time_status", "time_reading").agg(F.count(F.lit(1)).alias("n"), F.round(F.min(p), 6).alias("least_posterior"), F.round(F.avg(p), 4).alias("mean_posterior"))


def _news_periods(spark, d):
    news = table(spark, d, "silver_financial_news").select("id", "source", "published_time", F.unix_micros("ingested_time").alias("arrival_us"), F.get_json_object("metadata", "$.feed_name").alias("feed"))
    read = read_instants(news, "published_time", F.col("feed"), table(spark, d, "publishers"), table(spark, d, "zone_labels"))
    delay = F.floor((F.col("arrival_us") - F.col("instant_us")) / 1_000_000)
    return replay(read.select("id", "source", F.col("instant_us").alias("event_us"), "arrival_us", delay.alias("delay_s")), ["source", "period_us"], "delay_s")


def p4_found(spark, d):
    log = _news_periods(spark, d).log()
    return log.where(F.col("fate").isin("corrects", "refused")).select("id", period_text(F.col("period_us")).alias("period_hour"), "fate")


def p4_periods(spark, d):
    report = period_report(_news_periods(spark, d).state(), ["source", "period_us"])
    return report.withColumn("period_hour", period_text(F.col("period_us"))).drop("period_us")


def _known(spark, d):
    return predictions_as_known(table(spark, d, "prediction_releases"), table(spark, d, "annotation_releases"), table(spark, d, "eligibility_release_requirements"))


def p5_found(spark, d):
    return _known(spark, d).where("annotation_decision_id <> 'none' or eligibility_decision_id <> 'none'")


def p5_known(spark, d):
    return _known(spark, d)


def p5_versions(spark, d):
    """Both axes: for each news row the version of its article with the latest observed_at (valid time) among those that were available
    (known time) before the row was ingested, and observed before that too."""
    news = table(spark, d, "silver_financial_news").where("ingested_time is not null").select("id", F.unix_micros("ingested_time").alias("at_us"))
    seen = table(spark, d, "source_observations").select("article_id", F.unix_micros("available_at").alias("known"), F.unix_micros("observed_at").alias("valid"), F.lit(0).alias("seq"), F.col("id").alias("version"))
    facts = seen.distinct()
    return as_known(news, facts.withColumnRenamed("article_id", "id"), "id", "at_us", "known", "valid", "seq", "version", "version_id").select("id", "version_id")


QUERIES = {f.__name__: f for f in (p2_found, p2_kept, p3_found, p3_status, p4_found, p4_periods, p5_found, p5_known, p5_versions)}

_FIRST = """SELECT kafka_topic, event_id, kafka_partition, kafka_offset FROM (
  SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY kafka_topic, event_id) AS n FROM bronze_events_raw WHERE event_id IS NOT NULL
  WINDOW w AS (PARTITION BY kafka_topic, event_id ORDER BY ingested_at, kafka_partition, kafka_offset)) WHERE r = 1"""
_KNOWN = """WITH a AS (SELECT p.content_hash, p.model_revision, arg_max(a.decision_id, (a.label_available_at, a.seq_no)) AS x FROM prediction_releases p
  JOIN annotation_releases a ON a.content_hash = p.content_hash AND a.label_available_at < p.released_at GROUP BY 1, 2),
 g AS (SELECT p.content_hash, p.model_revision, arg_max(e.decision_id, (e.data_available_at, e.seq_no)) AS x FROM prediction_releases p
  JOIN eligibility_release_requirements e ON e.content_hash = p.content_hash AND e.data_available_at < p.released_at GROUP BY 1, 2)
 SELECT p.content_hash, p.model_revision, coalesce(a.x, 'none') AS annotation_decision_id, coalesce(g.x, 'none') AS eligibility_decision_id
 FROM prediction_releases p LEFT JOIN a USING (content_hash, model_revision) LEFT JOIN g USING (content_hash, model_revision) WHERE p.released_at IS NOT NULL"""
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?\s*([AaPp][Mm]\b)?\s*(.*)$"
_PARTS = {  # form -> (pattern, names of its groups)
    "iso": (r"^(\d{4})-(\d{2})-(\d{2})[Tt ]\s*" + _TIME, "y mo d h mi s f half tail"),
    "compact": (r"^(\d{4})(\d{2})(\d{2})[Tt](\d{2})(\d{2})(\d{2})\s*(.*)$", "y mo d h mi s tail"),
    "stamp": (r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$", "y mo d h mi s"),
    "mail": (r"^(?:[A-Za-z]{3},?\s+)?(\d{1,2}) ([A-Za-z]{3,9}) (\d{4}) " + _TIME, "d mo y h mi s f half tail"),
    "cdate": (r"^[A-Za-z]{3} ([A-Za-z]{3})\s+(\d{1,2}) (\d{2}):(\d{2}):(\d{2}) (\d{4})$", "mo d h mi s y"),
    "long": (r"^([A-Za-z]{3,9}) (\d{1,2}), (\d{4}) " + _TIME, "mo d y h mi s f half tail"),
    "dotted": (r"^(\d{1,2})\.(\d{1,2})\.(\d{4}) " + _TIME, "d mo y h mi s f half tail"),
    "dmy": (r"^(\d{1,2})/(\d{1,2})/(\d{4}) " + _TIME, "d mo y h mi s f half tail"),
}


def _group(name: str) -> str:
    """The named part of whichever form a text has; month first where the registry says so."""
    out = []
    for form, (pattern, names) in _PARTS.items():
        wanted = {"d": "mo", "mo": "d"}.get(name, name) if form == "dmy" else name
        if name in names.split():
            value = lambda n: f"regexp_extract(x, '{pattern.replace(chr(39), chr(39) * 2)}', {names.split().index(n) + 1})"
            out.append(f"WHEN form = '{form}' THEN " + (f"CASE WHEN day_first THEN {value(name)} ELSE {value(wanted)} END" if wanted != name else value(name)))
    return f"nullif(CASE {' '.join(out)} END, '') AS {name}"


_FORMS = " ".join(f"WHEN regexp_matches(x, '{pattern}') THEN '{form}'" for form, (pattern, _) in _PARTS.items())
_INSTANTS = f"""WITH raw AS (SELECT 'published_time' AS field_name, id AS record_key, published_time AS time_text, json_extract_string(metadata, '$.feed_name') AS feed, NULL AS zone0 FROM silver_financial_news
  UNION ALL SELECT 'source_time_raw', id, source_time_raw, json_extract_string(source_item, '$.feed_name'), NULL FROM source_observations
  UNION ALL SELECT 'acceptance_time', accession_number, acceptance_time, NULL, 'America/New_York' FROM silver_sec_filings),
 named AS (SELECT field_name, record_key, time_text, regexp_replace(time_text, '^\\s+|\\s+$', '', 'g') AS x, coalesce(zone0, p.zone_name) AS own_zone, CASE WHEN zone0 IS NOT NULL THEN FALSE ELSE p.day_first END AS day_first FROM raw LEFT JOIN publishers p ON p.publisher = raw.feed),
 formed AS (SELECT *, CASE {_FORMS} END AS form FROM named),
 parts AS (SELECT *, {', '.join(_group(n) for n in ('y', 'mo', 'd', 'h', 'mi', 's', 'f', 'half', 'tail'))} FROM formed),
 months AS (SELECT unnest(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec']) AS name, unnest(range(1, 13)) AS number),
 dated AS (SELECT parts.*, try_cast(y || '-' || lpad(coalesce(m.number::VARCHAR, mo), 2, '0') || '-' || lpad(d, 2, '0') AS DATE) AS day, h::INT AS hh, mi::INT AS mm, coalesce(s, '0')::INT AS ss, rpad(coalesce(f, '0')[1:6], 6, '0')::BIGINT AS ff,
   regexp_extract(coalesce(tail, ''), '^([Zz]|[+-]\\d{{2}}:?\\d{{0,2}})(?:\\[.*\\])?$', 1) AS off FROM parts LEFT JOIN months m ON m.name = lower(mo[1:3]) AND NOT regexp_matches(mo, '^\\d')),
 clocked AS (SELECT *, CASE WHEN day IS NOT NULL AND mm < 60 AND ss < 60 AND CASE WHEN half IS NULL THEN hh < 24 ELSE hh BETWEEN 1 AND 12 END
   THEN epoch_us(day::TIMESTAMP) + ((CASE WHEN half IS NULL THEN hh ELSE hh % 12 + CASE WHEN lower(half) = 'pm' THEN 12 ELSE 0 END END * 60 + mm) * 60 + ss) * 1000000::BIGINT + ff END AS local_us,
   CASE WHEN lower(off) = 'z' THEN 0 WHEN off <> '' THEN (CASE WHEN off[1] = '-' THEN -1 ELSE 1 END) * (off[2:3]::INT * 60 + coalesce(nullif(replace(off[4:], ':', ''), ''), '0')::INT) END AS minutes FROM dated),
 zoned AS (SELECT c.*, l.utc_offset_minutes AS label_minutes, CASE WHEN tail IS NULL THEN own_zone WHEN l.zone_name IS NOT NULL THEN l.zone_name ELSE tail END AS zone FROM clocked c LEFT JOIN zone_labels l ON l.zone_label = upper(tail)),
 known AS (SELECT z.*, t.name IS NOT NULL AS zone_known FROM zoned z LEFT JOIN (SELECT DISTINCT name FROM pg_timezone_names()) t ON t.name = z.zone),
 shifted AS (SELECT *, CASE WHEN zone_known THEN make_timestamp(local_us) AT TIME ZONE zone END AS late FROM known),
 instants AS (SELECT field_name, record_key, time_text, CASE
   WHEN regexp_matches(x, '^\\d{{10}}$') THEN x::BIGINT * 1000000 WHEN regexp_matches(x, '^\\d{{13}}$') THEN x::BIGINT * 1000 WHEN regexp_matches(x, '^\\d{{16}}$') THEN x::BIGINT WHEN regexp_matches(x, '^\\d{{19}}$') THEN x::BIGINT // 1000
   WHEN form = 'dmy' AND day_first IS NULL THEN NULL WHEN minutes IS NOT NULL THEN local_us - minutes * 60000000::BIGINT WHEN label_minutes IS NOT NULL THEN local_us - label_minutes * 60000000::BIGINT
   WHEN (late - INTERVAL 1 HOUR) AT TIME ZONE zone = make_timestamp(local_us) THEN epoch_us(late) - 3600000000 ELSE epoch_us(late) END AS instant_us FROM shifted)"""
_FATES = _INSTANTS + """, fates AS (SELECT n.id, n.source, instant_us - instant_us % 3600000000 AS period_us, epoch_us(ingested_time) - (instant_us - instant_us % 3600000000 + 3600000000) AS lag, floor((epoch_us(ingested_time) - instant_us) / 1000000.0)::BIGINT AS delay_s
  FROM silver_financial_news n JOIN instants i ON i.record_key = n.id AND i.field_name = 'published_time' WHERE instant_us IS NOT NULL AND ingested_time IS NOT NULL),
 periods AS (SELECT *, strftime(make_timestamp(period_us), '%Y-%m-%dT%H') AS period_hour FROM fates)"""
SQL = {
    "p3_found": _INSTANTS + r" SELECT DISTINCT field_name, record_key, instant_us FROM instants WHERE instant_us IS NOT NULL AND NOT regexp_full_match(time_text, '\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z')",
    "p4_found": _FATES + " SELECT id, period_hour, CASE WHEN lag <= 259200000000 THEN 'corrects' ELSE 'refused' END AS fate FROM periods WHERE lag > 0",
    "p4_periods": _FATES + """ SELECT source, period_hour, count(*) FILTER (lag <= 0) AS n_first, count(*) FILTER (lag > 0 AND lag <= 259200000000) AS n_corrections, count(*) FILTER (lag <= 259200000000) AS n_final, count(*) FILTER (lag > 259200000000) AS n_refused,
 CASE WHEN count(*) FILTER (lag <= 259200000000) > 0 THEN count(DISTINCT delay_s) FILTER (lag <= 259200000000) END AS n_distinct, min(delay_s) FILTER (lag <= 259200000000) AS least, max(delay_s) FILTER (lag <= 259200000000) AS most, median(delay_s) FILTER (lag <= 259200000000) AS median FROM periods GROUP BY 1, 2""",
    "p2_found": _FIRST + " AND n > 1",
    "p2_kept": _FIRST,
    "p5_found": f"SELECT * FROM ({_KNOWN}) WHERE annotation_decision_id <> 'none' OR eligibility_decision_id <> 'none'",
    "p5_known": _KNOWN,
    "p5_versions": "SELECT n.id, arg_max(o.id, (o.observed_at, o.id)) AS version_id FROM silver_financial_news n LEFT JOIN source_observations o ON o.article_id = n.id AND o.available_at < n.ingested_time AND o.observed_at < n.ingested_time WHERE n.ingested_time IS NOT NULL GROUP BY 1",
}
