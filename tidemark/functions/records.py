"""Message payloads as JSON texts: validation by ordered rules, and the three-way field diff of two deliveries.

Defined results: a null or broken payload has an error and no diff; a field that is absent, null or blank counts as missing; fields
not named here are not compared (but metadata as a whole is).
"""
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import padded_cik, squeeze

STRICT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})$"
TIMES = ["published_at", "ingested_time", "event_time"]
SEC_IDENTITY = ["cik", "form_type", "company_name", "accession_number"]


def field(payload: Column, name: str) -> Column:
    return F.get_json_object(payload, f"$.{name}")


def is_object(payload: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(payload)).startswith("OBJECT"), F.lit(False))


def aware(text: Column) -> Column:
    """A strict ISO time with offset that names an instant."""
    return F.coalesce(text.rlike(STRICT) & F.try_to_timestamp(text).isNotNull(), F.lit(False))


def instant(text: Column) -> Column:
    """Microseconds as text where the time is strict, else the squeezed text; equal instants are equal whatever their offset."""
    return F.coalesce(F.when(aware(text), F.unix_micros(F.try_to_timestamp(text)).cast("string")), F.nullif(squeeze(text), F.lit("")))


def first_error(payload: Column, expected_source: Column, required: tuple = ("published_at",)) -> Column:
    """Text of the first rule that the payload breaks, null where it is valid."""
    blank = lambda n: F.trim(F.coalesce(field(payload, n), F.lit(""))) == ""
    rules = F.when(payload.isNull(), "null payload").when(F.try_parse_json(payload).isNull(), "not JSON").when(~is_object(payload), "not an object")
    for name in TIMES:
        value = field(payload, name)
        rules = rules.when((value.isNotNull() | F.lit(name in required)) & ~aware(value), f"{name} is no ISO time with offset")
    score = field(payload, "semantic_score")
    vector = F.from_json(field(payload, "embedding"), "array<double>")
    rules = rules.when(blank("id") | blank("title"), "blank id or title").when(~field(payload, "source").eqNullSafe(expected_source), "topic and source disagree")
    rules = rules.when(field(payload, "embedding").isNotNull() & ~F.coalesce((F.size(vector) == 384) & F.forall(vector, lambda x: x.isNotNull()), F.lit(False)), "embedding is not 384 finite numbers")
    rules = rules.when(score.isNotNull() & score.try_cast("double").isNull(), "score is not finite")
    accession = field(payload, "metadata.accession_number")
    return rules.when((expected_source == "SEC") & (accession != "") & (accession != field(payload, "id")), "accession number and id disagree")


def metadata_text(payload: Column, without: Column) -> Column:
    """The metadata object's fields but for some, in one order."""
    entries = F.map_entries(F.map_filter(F.from_json(field(payload, "metadata"), "map<string,string>"), lambda k, v: ~F.array_contains(without, k)))
    return F.coalesce(F.array_join(F.array_sort(F.transform(entries, lambda e: F.concat_ws("=", e["key"], F.coalesce(e["value"], F.lit(""))))), ","), F.lit(""))


def field_diff(old: Column, new: Column) -> Column:
    """Struct of conflicts, enrichment and provenance: comma-separated names of the fields that differ between a stored delivery and
    a later one. Filing identity and filing text always conflict; what only fills a gap enriches."""
    plain = lambda n: (F.nullif(squeeze(field(old, n)), F.lit("")), F.nullif(squeeze(field(new, n)), F.lit("")))
    sec = F.coalesce(field(new, "source") == "SEC", F.lit(False))
    groups: dict[str, list] = {"conflicts": [], "enrichment": [], "provenance": []}

    def record(group: str, name: str, a: Column, b: Column, when: Column | None = None) -> None:
        differs = ~a.eqNullSafe(b)
        groups[group].append(F.when(differs if when is None else differs & when, F.lit(name)))

    def by_presence(name: str, a: Column, b: Column, always: Column, moved: Column) -> None:
        """A change conflicts, a gap filled enriches, a loss is provenance; `always`: any difference conflicts, `moved`: none does."""
        record("provenance", name, a, b, moved | (~always & b.isNull()))
        record("conflicts", name, a, b, ~moved & (always | (a.isNotNull() & b.isNotNull())))
        record("enrichment", name, a, b, ~moved & ~always & a.isNull())

    record("conflicts", "title", *plain("title"))
    record("conflicts", "published_at", instant(field(old, "published_at")), instant(field(new, "published_at")))
    other_source = ~sec & ~field(old, "source").eqNullSafe(field(new, "source"))
    by_presence("content_snippet", *plain("content_snippet"), sec, other_source)
    by_presence("content_full", *plain("content_full"), sec, F.lit(False))
    by_presence("event_time", instant(field(old, "event_time")), instant(field(new, "event_time")), F.lit(False), F.lit(False))
    record("conflicts", "is_near_duplicate", *plain("is_near_duplicate"))
    own = lambda p: F.coalesce(F.nullif(field(p, "canonical_cluster_id"), F.lit("")), field(p, "id"))
    record("conflicts", "canonical_cluster_id", own(old), own(new))
    of = lambda p, n: F.nullif(squeeze(field(p, f"metadata.{n}")), F.lit(""))
    record("conflicts", "cik", padded_cik(of(old, "cik")), padded_cik(of(new, "cik")), sec)
    record("conflicts", "form_type", F.upper(of(old, "form_type")), F.upper(of(new, "form_type")), sec)
    record("conflicts", "company_name", of(old, "company_name"), of(new, "company_name"), sec)
    for name in ("embedding", "semantic_score", "schema_version"):
        record("enrichment", name, field(old, name), field(new, name))
    tickers = lambda p: F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform(F.from_json(field(p, "tickers_mentioned"), "array<string>"), lambda t: F.upper(t)))), ","), F.lit(""))
    record("enrichment", "tickers_mentioned", tickers(old), tickers(new))
    record("provenance", "source", field(old, "source"), field(new, "source"))
    record("provenance", "url", field(old, "url"), field(new, "url"))
    record("provenance", "ingested_time", instant(field(old, "ingested_time")), instant(field(new, "ingested_time")))
    left_out = F.when(sec, F.array(*map(F.lit, SEC_IDENTITY))).otherwise(F.array().cast("array<string>"))
    record("provenance", "metadata", metadata_text(old, left_out), metadata_text(new, left_out))
    return F.struct(*[F.concat_ws(",", *names).alias(g) for g, names in groups.items()])


def change_status(diff: Column) -> Column:
    return F.when(diff["conflicts"] != "", "conflict").when(diff["enrichment"] != "", "enrichment").otherwise("redelivery")
