from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from tidemark.operators.instants import found_instants, named_fields, read_instants

PUBLISHERS = [("NY", "America/New_York", False), ("London", "Europe/London", True), ("Sydney", "Australia/Sydney", True)]
LABELS = [("EST", "fixed", -300, None), ("EDT", "fixed", -240, None), ("IST", "fixed", 330, None), ("GMT", "fixed", 0, None), ("ET", "region", None, "America/New_York")]


def us(y, mo, d, h=0, mi=0, s=0, frac=0, offset=0):
    t = datetime(y, mo, d, h, mi, s, tzinfo=timezone.utc) - timedelta(minutes=offset)
    return int((t - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1)) + frac


CASES = [
    ("2026-01-02T03:04:05Z", None, us(2026, 1, 2, 3, 4, 5)), (" \t2026-01-02t03:04:05z\n", None, us(2026, 1, 2, 3, 4, 5)),
    ("2026-01-02T03:04:05.123456789Z", None, us(2026, 1, 2, 3, 4, 5, 123456)), ("2026-01-02 03:04:05,5Z", None, us(2026, 1, 2, 3, 4, 5, 500000)),
    ("2026-01-02T03:04+05:30", None, us(2026, 1, 2, 3, 4, offset=330)), ("2026-01-02 03:04:05-04", None, us(2026, 1, 2, 3, 4, 5, offset=-240)),
    ("20260102T030405-0330", None, us(2026, 1, 2, 3, 4, 5, offset=-210)), ("2026-01-02T03:04:05+01:00[Europe/Berlin]", "NY", us(2026, 1, 2, 3, 4, 5, offset=60)),
    ("2026-01-02 03:04:05 America/New_York", None, us(2026, 1, 2, 3, 4, 5, offset=-300)), ("2026-01-02 03:04:05 America/New_York", "London", us(2026, 1, 2, 3, 4, 5, offset=-300)),
    ("Fri, 02 Jan 2026 03:04:05 EST", "London", us(2026, 1, 2, 3, 4, 5, offset=-300)), ("Thu, 02 Jul 2026 03:04:05 EST", None, us(2026, 7, 2, 3, 4, 5, offset=-300)),
    ("2 July 2026 03:04 ET", None, us(2026, 7, 2, 3, 4, offset=-240)), ("January 2, 2026 12:04 AM ET", None, us(2026, 1, 2, 0, 4, offset=-300)),
    ("January 2, 2026 12:04 PM", "NY", us(2026, 1, 2, 12, 4, offset=-300)), ("Fri Jan  2 03:04:05 2026", "NY", us(2026, 1, 2, 3, 4, 5, offset=-300)),
    ("03/04/2026 10:11:12", "NY", us(2026, 3, 4, 10, 11, 12, offset=-300)), ("03/04/2026 10:11:12", "London", us(2026, 4, 3, 10, 11, 12, offset=60)),
    ("03/04/2026 10:11 PM", "London", us(2026, 4, 3, 22, 11, offset=60)), ("25/12/2025 10:11:12", "NY", None), ("03/04/2026 10:11:12", None, None), ("03/04/2026 10:11:12", "Nobody", None),
    ("03.04.2026 10:11", "NY", us(2026, 4, 3, 10, 11, offset=-240)), ("1767323045", None, us(2026, 1, 2, 3, 4, 5)), ("1767323045678", None, us(2026, 1, 2, 3, 4, 5, 678000)),
    ("1767323045678901", None, us(2026, 1, 2, 3, 4, 5, 678901)), ("20260102030405", "NY", us(2026, 1, 2, 3, 4, 5, offset=-300)), ("20260102030405", None, None),
    ("2025-11-02T01:30:00", "NY", us(2025, 11, 2, 1, 30, offset=-240)), ("2026-03-08T02:30:00", "NY", us(2026, 3, 8, 2, 30, offset=-300)),
    ("2026-03-29T01:30:00", "London", us(2026, 3, 29, 1, 30)), ("2025-10-05T02:30:00", "Sydney", us(2025, 10, 5, 2, 30, offset=600)),
    ("2026-01-02", "NY", None), ("2026-02-30T10:00:00Z", "NY", None), ("2026-01-02T25:00:00Z", "NY", None), ("2026-13-02T05:00:00Z", "NY", None), ("0000-00-00 00:00:00", "NY", None),
    ("2026-01-02T03:04:05", None, None), ("January 2, 2026 13:04 PM", "NY", None), ("just now", "NY", None), ("", "NY", None), (None, "NY", None), ("10:42", "NY", None),
    ("2026-01-02 03:04:05 Nowhere/Land", "NY", None), ("x" * 50000, "NY", None), ("2024-02-29T00:00:00Z", None, us(2024, 2, 29)), ("2025-02-29T00:00:00Z", None, None),
]


def frames(spark):
    return spark.createDataFrame(PUBLISHERS, "publisher string, zone_name string, day_first boolean"), spark.createDataFrame(LABELS, "zone_label string, label_kind string, utc_offset_minutes int, zone_name string")


def test_reading_rules(spark):
    df = spark.createDataFrame([(i, t, p, "clash") for i, (t, p, _) in enumerate(CASES)], "i int, t string, feed string, zone_name string")
    got = {r["i"]: r for r in read_instants(df, "t", F.col("feed"), *frames(spark)).collect()}
    wrong = [(t, p, want, got[i]["instant_us"], got[i]["time_status"]) for i, (t, p, want) in enumerate(CASES) if got[i]["instant_us"] != want]
    assert not wrong
    assert got[0]["zone_name"] == "clash" and all((r["instant_us"] is None) == (r["time_status"] != "read") for r in got.values())


def test_zones_agree_with_python(spark):
    hours = [datetime(2025, 10, 20) + timedelta(minutes=37 * k) for k in range(0, 6000)]
    zones = {"NY": "America/New_York", "London": "Europe/London", "Sydney": "Australia/Sydney"}
    rows = [(f"{t:%Y-%m-%dT%H:%M:%S}", z) for t in hours for z in zones]
    out = read_instants(spark.createDataFrame(rows, "t string, feed string"), "t", F.col("feed"), *frames(spark)).collect()
    for r in out:
        local = datetime.fromisoformat(r["t"]).replace(tzinfo=ZoneInfo(zones[r["feed"]]), fold=0)
        assert r["instant_us"] == int(local.timestamp()) * 1_000_000


def test_mixture_decides_order_where_allowed(spark):
    rows = [(f"{d:02d}/01/2026 10:00:00Z", "wire") for d in range(1, 29)]
    rows.append(("32/13/2026 10:00:00Z", "wire"))
    out = read_instants(spark.createDataFrame(rows, "t string, feed string"), "t", F.lit(None).cast("string"), *frames(spark), infer_order=True).collect()
    assert {r["time_reading"] for r in out if r["instant_us"]} == {"slash_dmy"} and sum(r["instant_us"] is not None for r in out) > 20
    closed = read_instants(spark.createDataFrame(rows, "t string, feed string"), "t", F.lit(None).cast("string"), *frames(spark)).collect()
    assert {r["time_status"] for r in closed} == {"ambiguous", "impossible"} and [r["t"] for r in closed if r["time_status"] == "impossible"] == ["32/13/2026 10:00:00Z"]


def test_posterior_chooses_the_order(spark, monkeypatch):
    """With the fit replaced by equal weights, the same texts of registered sources stay open: the mixture decides them."""
    from tidemark.operators import instants

    rows = [("03/04/2026 10:11:12", "NY"), ("03/04/2026 10:11:12", "London"), ("25/12/2025 10:11:12", "NY"), ("2026-01-02T03:04:05Z", "NY")]
    read = lambda: {(r["t"], r["feed"]): r for r in read_instants(spark.createDataFrame(rows, "t string, feed string"), "t", F.col("feed"), *frames(spark)).collect()}
    fitted = read()
    assert fitted[rows[0]]["time_reading"] == "slash_mdy" and fitted[rows[1]]["time_reading"] == "slash_dmy"
    assert fitted[rows[2]]["time_status"] == "impossible" and 0.99 <= fitted[rows[0]]["time_posterior"] < 1
    real = instants.fit_readings
    monkeypatch.setattr(instants, "fit_readings", lambda counts: real(counts).withColumn("weights", F.array_repeat(F.lit(0.1), len(instants.ALL) + 1)))
    flat = read()
    assert flat[rows[0]]["time_status"] == flat[rows[1]]["time_status"] == "ambiguous" and flat[rows[0]]["instant_us"] is None


def test_what_a_source_writes_moves_the_posterior(spark, tmp_path, monkeypatch):
    """The registry chooses, so p3_found is the same whatever the texts say; p3_status tells how far they bear it out."""
    from tidemark.operators import instants
    from tidemark.plans.core_problems import p3_found, p3_status

    news = ([("NY", "03/04/2026 10:11:12")] * 5 + [("NY", "25/12/2025 10:11:12")] * 4000 + [("London", "25/12/2025 10:11:12")] * 50 + [("London", "03/04/2026 10:11:12")] * 5
            + [("Sydney", "2026-01-02 03:04:05Z")] * 5 + [("Sydney", "just now")] * 3000)
    spark.createDataFrame([(str(i), t, f'{{"feed_name": "{f}"}}') for i, (f, t) in enumerate(news)], "id string, published_time string, metadata string").write.parquet(f"{tmp_path}/silver_financial_news.parquet")
    spark.createDataFrame([("f1", "20260102030405")], "accession_number string, acceptance_time string").write.parquet(f"{tmp_path}/silver_sec_filings.parquet")
    spark.createDataFrame([], "id string, source_time_raw string, source_item string").write.parquet(f"{tmp_path}/source_observations.parquet")
    for df, name in zip(frames(spark), ("publishers", "zone_labels")):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    found = lambda: {tuple(r) for r in p3_found(spark, str(tmp_path)).collect()}
    status = lambda: {(r["time_status"], r["time_reading"]): r for r in p3_status(spark, str(tmp_path)).where("field_name = 'published_time'").collect()}
    rows, told = found(), status()
    instant = {"NY": us(2026, 3, 4, 10, 11, 12, offset=-300), "London": us(2026, 4, 3, 10, 11, 12, offset=60), "Sydney": us(2026, 1, 2, 3, 4, 5)}
    want = {("published_time", str(i), us(2025, 12, 25, 10, 11, 12) if t.startswith("25/") else instant[f]) for i, (f, t) in enumerate(news) if t != "just now" and (f, t[:2]) != ("NY", "25")}
    assert rows == want | {("acceptance_time", "f1", us(2026, 1, 2, 3, 4, 5, offset=-300))}
    assert told["read", "slash_mdy"]["n"] == 5 and told["read", "slash_mdy"]["least_posterior"] < 0.5  # 4,000 texts against the registry's word
    assert told["read", "iso"]["n"] == 5 and told["read", "iso"]["least_posterior"] < 0.5  # nearly all of the source is noise
    assert told["read", "slash_dmy"]["n"] == 55 and told["read", "slash_dmy"]["least_posterior"] > 0.99
    assert told["impossible", None]["n"] == 4000 and told["unreadable", None]["n"] == 3000
    # without the texts (the registry's prior alone in place of the fit) the posterior tells nothing
    real = instants.fit_readings
    monkeypatch.setattr(instants, "fit_readings", lambda counts: real(counts.withColumn("n", F.lit(0))))
    assert found() == rows and all(r["least_posterior"] > 0.99 for (s, _), r in status().items() if s == "read")


def test_fields(spark):
    filings = spark.createDataFrame([("f1", "20260102030405"), ("f2", "2026-01-02T03:04:05Z"), ("f3", "01/02/2026 03:04 AM")], "accession_number string, acceptance_time string")
    seen = spark.createDataFrame([("o1", "2 July 2026 03:04 ET", '{"feed_name": "NY"}')] * 2, "id string, source_time_raw string, source_item string")
    rows = {tuple(r) for r in found_instants(named_fields(None, filings, seen, *frames(spark))).collect()}
    assert rows == {("acceptance_time", "f1", us(2026, 1, 2, 3, 4, 5, offset=-300)), ("acceptance_time", "f3", us(2026, 1, 2, 3, 4, offset=-300)), ("source_time_raw", "o1", us(2026, 7, 2, 3, 4, offset=-240))}
    none = spark.createDataFrame([], "accession_number string, acceptance_time string")
    assert found_instants(named_fields(None, none, None, *frames(spark))).count() == 0
