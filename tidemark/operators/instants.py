"""Mixed timestamp formats and time zones: one UTC instant (microseconds since 1970) per text, or none.

Every text is read under each reading it admits (ISO, compact stamp, count since 1970, mail date, C date, long
date, dotted date, slashed date day first, slashed date month first), or taken for noise that states no time. Per
source, expectation-maximisation fits the mixture of these; each text contributes the likelihood it has under each
valid reading. The registry's word for a slashed reading enters as `STRENGTH` prior counts, so that many texts outweigh it in
the posterior: time_posterior falls where a source's texts speak against its registry, or are mostly noise. The choice for a
registered source is still the registry's alone (the slashed reading that it denies has no weight in it, and noise takes no
text that states a time). For other sources, where `infer_order` allows a mixture, the posterior chooses: below `certain`
a text is 'ambiguous', one that is likelier noise than any reading is 'impossible'. A source that is not registered has no
zone; a text without a source that can be judged is one whose slashed date stays 'ambiguous'.

Defined results: null, empty or unreadable text gives no instant with status 'unreadable'; impossible dates or
times 'impossible'; no time of day 'no_time'; no zone known 'no_zone'; slashed date of an unnamed source
'ambiguous'. A local time that occurs twice is the earlier instant, a skipped one uses the offset before the
change. Results do not depend on the session time zone. Extra columns pass through.
"""
import zoneinfo

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.shared import materialize

# English month names by their first three letters.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?\s*([AaPp][Mm](?![A-Za-z]))?"
TAIL = r"\s*(.*)"
MONTH = r"([A-Za-z]{3,9})\.?"
WEEKDAY = r"(?:(?:[Mm]on|[Tt]ue|[Ww]ed|[Tt]hu|[Ff]ri|[Ss]at|[Ss]un)[a-z]*,?\s+)?"
#: reading -> (pattern, groups of year, month, day, hour, minute, second, fraction, half day, tail)
READINGS = {
    "iso": (rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})[Tt\s]\s*{TIME}{TAIL}\z", (1, 2, 3, 4, 5, 6, 7, 8, 9)),
    "compact": (r"^(\d{4})(\d{2})(\d{2})[Tt](\d{2})(\d{2})(\d{2})?(?:[.,](\d+))?()\s*(\D.*)?\z", (1, 2, 3, 4, 5, 6, 7, 8, 9)),
    "stamp": (r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})(\d{3})?()()\z", (1, 2, 3, 4, 5, 6, 7, 8, 9)),
    "mail": (rf"^{WEEKDAY}(\d{{1,2}})[\s-]{MONTH}[\s-](\d{{4}}),?\s+{TIME}{TAIL}\z", (3, 2, 1, 4, 5, 6, 7, 8, 9)),
    "cdate": (rf"^{WEEKDAY}{MONTH}\s+(\d{{1,2}})\s+{TIME}\s+(\d{{4}}){TAIL}\z", (8, 1, 2, 3, 4, 5, 6, 7, 9)),
    "long": (rf"^{WEEKDAY}{MONTH}\s+(\d{{1,2}}),?\s+(\d{{4}}),?\s+(?:at\s+)?{TIME}{TAIL}\z", (3, 1, 2, 4, 5, 6, 7, 8, 9)),
    "dotted": (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),?\s+{TIME}{TAIL}\z", (3, 2, 1, 4, 5, 6, 7, 8, 9)),
    "slash_dmy": (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),?\s+{TIME}{TAIL}\z", (3, 2, 1, 4, 5, 6, 7, 8, 9)),
    "slash_mdy": (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),?\s+{TIME}{TAIL}\z", (3, 1, 2, 4, 5, 6, 7, 8, 9)),
}
COUNTS = {10: 1_000_000, 13: 1_000, 16: 1, 19: -1_000}  # digits -> microseconds per unit (negative: units per microsecond)
ALL = [*READINGS, "count"]
DMY, MDY = ALL.index("slash_dmy"), ALL.index("slash_mdy")
OFFSET = r"^([Zz]|[+-]\d{2}(?::?\d{2})?)\s*(?:\[[^\]]*\])?\z"
PLAIN = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z\z"
DAY_US = 86_400_000_000
STRENGTH = 1000.0  # prior counts of the slashed reading that the registry names: as good as so many texts, however many the source has
NOISE = 0.005  # likelihood of any text as noise, beside 1 of a valid reading
WEAK = 1e-3  # prior count of every other reading


def _zones(spark) -> list[str]:
    """Zone names that both the text may use and the JVM can convert."""
    java = set(spark._jvm.java.time.ZoneId.getAvailableZoneIds())
    return sorted(z for z in zoneinfo.available_timezones() if z in java)


def _split(x: Column, pattern: str, groups: tuple) -> Column:
    """The nine parts of a matching text in READINGS order; what the text lacks is empty."""
    return F.split(F.regexp_replace(x, pattern, "\u0001".join(f"${g}" for g in groups)), "\u0001", -1)


def _number(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{1,4}\z"), c.cast("int"))


def _date_us(y: Column, mo: Column, d: Column) -> Column:
    """Midnight in microseconds, null where there is no such date."""
    named = F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(mo, 1, 3))).cast("int"), F.lit(0))
    y, mo, d = _number(y), F.coalesce(_number(mo), named), _number(d)
    first = F.when(y.between(1, 9999) & mo.between(1, 12) & (d >= 1), F.make_date(y, mo, F.lit(1)))
    return F.when(d <= F.dayofmonth(F.last_day(first)), (F.unix_date(first).cast("long") + d - 1) * DAY_US)


def _clock_us(h: Column, mi: Column, s: Column, f: Column, half: Column) -> Column:
    """Time of day in microseconds, null where there is no such time; missing seconds are zero, more digits cut off."""
    h, mi, s, pm = _number(h), _number(mi), F.coalesce(_number(s), F.lit(0)), F.lower(half)
    hour = (F.when((pm == "") & h.between(0, 23), h)
             .when((pm != "") & h.between(1, 12), h % 12 + F.when(pm == "pm", 12).otherwise(0)))
    us = (hour.cast("long") * 3600 + mi * 60 + s) * 1_000_000 + F.rpad(F.substring(f, 1, 6), 6, "0").cast("long")
    return F.when(mi.between(0, 59) & s.between(0, 59), us)


def _digits(x: Column) -> Column:
    value = F.lit(None).cast("long")
    for n, unit in COUNTS.items():
        number = F.when(F.length(x) == n, x.cast("decimal(20,0)"))
        us = number * unit if unit > 0 else F.floor(number / -unit)
        value = F.coalesce(value, us.cast("long"))
    return F.when(x.rlike(r"^\d+\z"), value)


def fit_readings(counts: DataFrame, rounds: int = 1000) -> DataFrame:
    """Expectation-maximisation per source over aggregated counts.

    counts: source, registered, day_first, mask (bits of valid readings), n. A source's group holds one row per
    mask, so its size is bounded by the readings, not by the rows. Returns source and two lists (of ALL, then of noise):
    _evidence, the mixture fitted to the texts, and weights, by which a reading is chosen: the same, but none for the slashed
    reading that the registry denies.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("mask")  # sums in one order
        masks, n = pdf["mask"].to_numpy(np.int64), pdf["n"].to_numpy(float)
        valid = np.c_[(masks[:, None] >> np.arange(len(ALL))) & 1, np.full(len(masks), NOISE)].astype(float)
        prior = np.full(len(ALL) + 1, WEAK)
        registered = pdf["registered"].iloc[0]
        named, denied = (DMY, MDY) if pdf["day_first"].iloc[0] else (MDY, DMY)
        if registered:
            prior[named] = STRENGTH
        weight = prior / prior.sum()
        for _ in range(rounds):
            like = valid * weight
            posterior = like / like.sum(1, keepdims=True)
            new = (posterior * n[:, None]).sum(0) + prior
            new /= new.sum()
            if np.abs(new - weight).max() < 1e-12:
                break
            weight = new
        weight[-1] *= NOISE
        choice = weight.copy()
        if registered:
            choice[denied] = 0.0
        return pd.DataFrame({"source": pdf["source"].iloc[0], "weights": [list(map(float, choice))], "_evidence": [list(map(float, weight))]})

    return counts.groupBy("source").applyInPandas(fit, "source string, weights array<double>, _evidence array<double>")


def read_instants(df: DataFrame, text: str, source: Column, publishers: DataFrame, labels: DataFrame,
                  default_zone: Column | None = None, default_day_first: Column | None = None,
                  infer_order: bool = False, certain: float = 0.99) -> DataFrame:
    """Adds instant_us (long), time_status, time_reading and time_posterior (of the reading chosen). source names the
    publisher of the row (null: not named).

    default_zone and default_day_first hold where they are not null, for rows of tables that have no publishers (filings).
    """
    spark = df.sparkSession
    names = _zones(spark)
    pub = publishers.select(F.col("publisher").alias("_src"), F.col("zone_name").alias("_pub_zone"), F.col("day_first").alias("_pub_day_first"))
    pub = pub.where(F.col("_src").isNotNull()).dropDuplicates(["_src"])
    lab = labels.select(F.upper("zone_label").alias("_label"), F.col("utc_offset_minutes").alias("_lab_off"), F.col("zone_name").alias("_lab_zone")).dropDuplicates(["_label"])
    x = F.regexp_replace(F.col(text), r"(?U)\A[\s\p{Cf}]+|[\s\p{Cf}]+\z", "")
    work = df.withColumn("_x", x).withColumn("_src", source.cast("string")).join(pub, "_src", "left")
    if default_zone is not None:
        work = work.withColumns({"_pub_zone": F.coalesce(default_zone, "_pub_zone"), "_pub_day_first": F.coalesce(default_day_first, "_pub_day_first")})
    kind, parts = F.when(F.col("_x").rlike(r"^(\d{10}|\d{13}|\d{16}|\d{19})\z"), len(READINGS)), None
    for i, (k, (pattern, groups)) in enumerate(READINGS.items()):
        if i != MDY:  # both slashed readings share a shape
            kind = kind.when(F.col("_x").rlike(pattern), i)
            parts = (F.when if parts is None else parts.when)(F.col("_kind") == i, _split(F.col("_x"), pattern, groups))
    work = work.withColumn("_kind", kind).withColumn("_parts", parts)
    part = [F.get("_parts", F.lit(i)) for i in range(9)]
    work = work.withColumns({"_clock": _clock_us(*part[3:8]), "_tail": F.trim(part[8])})
    us = F.when(F.col("_kind") == len(READINGS), _digits(F.col("_x"))).otherwise(_date_us(*part[:3]) + F.col("_clock"))
    work = work.withColumns({"_us": us, "_us2": F.when(F.col("_kind") == DMY, _date_us(part[0], part[2], part[1]) + F.col("_clock"))})
    mask = F.when(F.col("_us").isNotNull(), F.expr("shiftleft(1L, _kind)")).otherwise(F.lit(0).cast("long")) + F.when(F.col("_us2").isNotNull(), 1 << MDY).otherwise(0)
    work = work.withColumn("_mask", mask)
    registered = F.col("_pub_zone").isNotNull()
    judged = registered | F.lit(infer_order)
    # texts without a mixture keep keys of their own, so that they don't meet in one task
    apart = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64("_x"), F.lit(1000)).cast("string"))
    work = work.withColumn("_key", F.when(registered, F.coalesce("_src", F.lit("*"))).when(F.lit(infer_order), F.concat(F.lit("?"), F.coalesce("_src", F.lit("")))).otherwise(apart))
    # parsed once, read twice: by the fit, which a missing text tells nothing, and by the choice
    work = materialize(work.drop("_parts", "_clock"), "readings")
    counts = (work.where(judged & (F.length("_x") > 0)).groupBy(F.col("_key").alias("source"), F.col("_mask").alias("mask"))
                  .agg(F.count(F.lit(1)).alias("n"), F.first("_pub_day_first", True).alias("day_first"), F.bool_or(registered).alias("registered")))
    counts = counts.withColumn("day_first", F.coalesce("day_first", F.lit(False)))
    work = work.join(fit_readings(counts).withColumnRenamed("source", "_key"), "_key", "left")
    # weight and evidence of each valid reading of the text and of noise; without a mixture only a slashed date is open
    fitted, slashed = F.col("weights").isNotNull(), F.col("_kind") == DMY
    weight = lambda valid, i, of="weights": F.when(F.col(valid).isNotNull(), F.coalesce(F.get(of, i), F.lit(1.0))).otherwise(F.lit(0.0))
    noise = lambda of: F.coalesce(F.get(of, F.lit(len(ALL))), F.lit(0.0))
    work = work.withColumns({"_w": weight("_us", F.col("_kind")), "_w2": weight("_us2", F.lit(MDY)), "_noise": F.when(registered, F.lit(0.0)).otherwise(noise("weights")),
                             "_e": weight("_us", F.col("_kind"), "_evidence"), "_e2": weight("_us2", F.lit(MDY), "_evidence")})
    second = F.col("_w2") > F.col("_w")
    work = work.withColumns({"_top": F.greatest("_w", "_w2"), "_post": F.try_divide(F.when(second, F.col("_e2")).otherwise(F.col("_e")), F.col("_e") + F.col("_e2") + noise("_evidence"))})
    stated = (F.col("_top") > 0) & (F.col("_top") >= F.col("_noise"))
    sure = F.try_divide("_top", F.col("_w") + F.col("_w2") + F.col("_noise"))
    work = (work.withColumn("_i", F.when(stated, F.when(second, F.lit(MDY)).otherwise(F.col("_kind"))))
                .withColumn("_local", F.when(stated, F.when(second, F.col("_us2")).otherwise(F.col("_us"))))
                .withColumn("_open", stated & F.when(fitted, sure < certain).otherwise(slashed))
                .withColumn("_reading", F.get(F.array(*map(F.lit, ALL)), F.col("_i"))))
    bare = F.regexp_replace("_tail", r"^\[(.*)\]\z", "$1")
    work = work.withColumn("_label", F.upper(bare)).join(F.broadcast(lab) if labels.count() <= 10_000 else lab, "_label", "left")
    offset = F.regexp_extract("_tail", OFFSET, 1)
    minutes = (F.when(F.lower(offset) == "z", F.lit(0))
                .otherwise((F.substring(offset, 2, 2).cast("int") * 60 + F.coalesce(F.nullif(F.regexp_extract(offset, r"(\d{2})\z", 1), F.lit("")).cast("int") * (F.length(offset) > 3).cast("int"), F.lit(0)))
                           * F.when(F.substring(offset, 1, 1) == "-", -1).otherwise(1)))
    has_offset = F.col("_tail").rlike(OFFSET) & (F.abs(minutes) <= 18 * 60)
    zone = (F.when(F.col("_tail") == "", F.col("_pub_zone"))
             .when(F.col("_lab_zone").isNotNull(), F.col("_lab_zone"))
             .otherwise(bare))
    zone = F.when(zone.isin(names), zone)
    converted = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("_local"), zone))
    instant = (F.when(F.col("_reading") == "count", F.col("_local"))
                .when(F.col("_open"), F.lit(None))
                .when(has_offset, F.col("_local") - minutes.cast("long") * 60_000_000)
                .when(F.col("_lab_off").isNotNull(), F.col("_local") - F.col("_lab_off").cast("long") * 60_000_000)
                .when(zone.isNotNull(), converted))
    status = (F.when(F.col("_x").isNull() | (F.col("_x") == ""), "unreadable")
               .when(instant.isNotNull(), "read").when(F.col("_open"), "ambiguous")
               .when(F.col("_i").isNotNull(), F.when(F.col("_tail") == "", "no_zone").otherwise("unreadable"))
               .when(F.col("_x").rlike(r"^(\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4}|\d{8})\z"), "no_time")
               .when(F.col("_kind").isNotNull(), "impossible").otherwise("unreadable"))
    return work.select(*[F.col(c) for c in df.columns], instant.cast("long").alias("instant_us"), status.alias("time_status"), F.col("_reading").alias("time_reading"), F.when(F.col("_i").isNotNull() & fitted, F.col("_post")).alias("time_posterior"))


def named_fields(news: DataFrame | None, filings: DataFrame | None, observations: DataFrame | None, publishers: DataFrame, labels: DataFrame) -> DataFrame:
    """The three time columns of the project as field_name, record_key, time_text, instant_us, time_status, time_reading."""
    feed = lambda c: F.get_json_object(c, "$.feed_name")
    slim = lambda df, field, key, of, zone=None: df.select(
        F.lit(field).alias("field_name"), F.col(key).alias("record_key"), F.col(field).alias("time_text"), of.cast("string").alias("feed"),
        F.lit(zone).cast("string").alias("zone0"), F.lit(None if zone is None else False).cast("boolean").alias("day_first0"))
    parts = [slim(df, *how) for df, how in (
        (news, ("published_time", "id", feed("metadata"))), (observations, ("source_time_raw", "id", feed("source_item"))),
        (filings, ("acceptance_time", "accession_number", F.lit(None), "America/New_York"))) if df is not None]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return read_instants(rows, "time_text", F.col("feed"), publishers, labels, F.col("zone0"), F.col("day_first0")).drop("feed", "zone0", "day_first0")


def found_instants(fields: DataFrame) -> DataFrame:
    """Records whose text determines an instant and is not already exactly YYYY-MM-DDTHH:MM:SSZ; repeats once."""
    return (fields.where(F.col("instant_us").isNotNull() & ~F.col("time_text").rlike(PLAIN))
                  .select("field_name", "record_key", "instant_us").distinct())
