"""Per-period aggregates by event time, corrected as late rows arrive, with a cut-off for lateness.

The state of a period is a multiset: value -> count. A late row only adjusts counts; exact medians, distinct
counts and extremes are re-derived from cumulative counts. Cumulation runs in two levels (buckets of values, then
the one bucket that holds the wanted rank), so a period with any share of the rows is never one task's row list.

Defined results: a row without event time or arrival has no period ('no_period') and enters no aggregate; null
group columns form their own group; null values count as rows but enter no median, distinct or extreme;
repeated rows count each time; an empty table gives an empty result.
"""
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tidemark.shared import discard, drop, get_json, materialize, put_json, scratch

HOUR_US = 3_600_000_000
BUCKET = 4096
LAST = 2**40  # batch of rows without arrival


def period_text(start_us: Column) -> Column:
    """YYYY-MM-DDTHH of a UTC period start, independent of the session time zone."""
    day = F.date_from_unix_date(F.floor(start_us / (24 * HOUR_US)).cast("int")).cast("string")
    return F.concat(day, F.lit("T"), F.lpad(F.pmod(F.floor(start_us / HOUR_US), F.lit(24)).cast("string"), 2, "0"))


def with_fates(df: DataFrame, event_us: Column, arrival_us: Column, period_us: int = HOUR_US, cutoff_us: int = 72 * HOUR_US) -> DataFrame:
    """Adds period_us and fate: on_time (arrived by the period's end), corrects (up to and including the cut-off
    after it), refused (later), no_period."""
    start = event_us - F.pmod(event_us, F.lit(period_us))
    lag = arrival_us - (start + period_us)
    fate = (F.when(lag.isNull(), "no_period").when(lag <= 0, "on_time").when(lag <= cutoff_us, "corrects").otherwise("refused"))
    return df.withColumns({"period_us": F.when(lag.isNotNull(), start), "fate": fate})


def multiset_state(fates: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A batch in the state's form: keys, value, n_first (on time), n_all (with corrections), n_refused; map-side combined."""
    return (fates.where(F.col("fate") != "no_period").groupBy(*keys, F.col(value).alias("value"))
                 .agg(F.count_if(F.col("fate") == "on_time").alias("n_first"), F.count_if(F.col("fate") != "refused").alias("n_all"),
                      F.count_if(F.col("fate") == "refused").alias("n_refused")))


def apply_late(state: DataFrame, late: DataFrame, keys: list[str]) -> DataFrame:
    """Adjusts the counts of a stored state by those of later rows (both in multiset_state's form)."""
    return state.unionByName(late).groupBy(*keys, "value").agg(*[F.sum(c).alias(c) for c in ("n_first", "n_all", "n_refused")])


class PeriodState:
    """The stored multiset of every period, corrected batch by batch as rows arrive.

    A batch is written once, as a log of its rows with their periods and fates; the manifest names the logs that hold. Every
    `merge_every` batches their value counts adjust the stored state (apply_late) in a new table; reading adds the few
    logs behind it. A batch costs what its own rows cost; a batch number that was added before changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], value: str, period_us: int = HOUR_US, cutoff_us: int = 72 * HOUR_US, merge_every: int = 8):
        self.spark, self.root, self.keys, self.value, self.merge_every = spark, root, keys, value, merge_every
        self.period_us, self.cutoff_us, self.manifest = period_us, cutoff_us, f"{root}/manifest.json"

    def _load(self) -> dict:
        return get_json(self.manifest) or {"batches": [], "state": None, "behind": [], "log": None, "form": None}

    def add(self, rows: DataFrame, batch: int) -> None:
        """rows: the columns to keep in the log, event_us, arrival_us and the value; keys other than period_us are columns."""
        held = self._load()
        if batch in held["batches"]:
            return
        logged = with_fates(rows, F.col("event_us"), F.col("arrival_us"), self.period_us, self.cutoff_us)
        logged.write.mode("overwrite").parquet(f"{self.root}/log/{batch:06d}")
        held |= {"batches": [*held["batches"], batch], "behind": [*held["behind"], batch], "log": logged.schema.json()}
        old = held["state"]
        if len(held["behind"]) >= self.merge_every:
            merged, path = self._state(held), f"{self.root}/state/{batch:06d}"
            merged.write.mode("overwrite").parquet(path)
            held |= {"state": path, "behind": [], "form": merged.schema.json()}
        put_json(self.manifest, held)
        if old and old != held["state"]:
            drop(old)

    def _read(self, form: str, *paths: str) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(json.loads(form))).parquet(*paths)

    def _log(self, held: dict, batches: list[int]) -> DataFrame:
        return self._read(held["log"], *[f"{self.root}/log/{b:06d}" for b in batches])

    def _state(self, held: dict) -> DataFrame:
        stored = self._read(held["form"], held["state"]) if held["state"] else None
        if not held["behind"]:
            return stored
        late = multiset_state(self._log(held, held["behind"]), self.keys, self.value)
        return late if stored is None else apply_late(stored, late, self.keys)

    def state(self) -> DataFrame:
        """keys, value, n_first, n_all, n_refused with all corrections so far."""
        return self._state(self._load())

    def log(self) -> DataFrame:
        """Every row added, with period_us and fate."""
        held = self._load()
        return self._log(held, held["batches"])


def replay(rows: DataFrame, keys: list[str], value: str, batch_us: int = 7 * 24 * HOUR_US) -> PeriodState:
    """Run a whole table (event_us, arrival_us, value, keys, columns for the log) through a new state in batches of arrival time;
    rows without arrival come last."""
    spark = rows.sparkSession
    held = materialize(rows.withColumn("batch", F.coalesce(F.floor(F.col("arrival_us") / batch_us), F.lit(LAST))), "late-batches", ["batch"])
    state = PeriodState(spark, scratch(spark, "periods"), keys, value)
    numbers = sorted(r["batch"] for r in held.select("batch").distinct().collect())  # one row per batch
    for i, number in enumerate(numbers):
        state.add(held.where(F.col("batch") == number).drop("batch"), i)
    if not numbers:
        state.add(rows, 0)
    discard(held)
    return state


def _same(keys: list[str], prefix: str) -> Column:
    """Null-safe equality of the keys with their prefixed copies; an equi-join condition."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(prefix + k))
    return out


def derive(state: DataFrame, keys: list[str], count: str) -> DataFrame:
    """keys, n, n_distinct, least, most, median (mean of the two middle values) by cumulative counts."""
    s = state.where(F.col(count) > 0).withColumn("c", F.col(count)).withColumn("b", F.floor(F.col("value") / BUCKET))
    known = F.col("value").isNotNull()
    buckets = s.groupBy(*keys, "b").agg(F.sum("c").alias("all"), F.sum(F.when(known, F.col("c")).otherwise(0)).alias("n"),
                                        F.count("value").alias("d"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    up = Window.partitionBy(*keys).orderBy(F.col("b").asc_nulls_last())
    ranked = (buckets.withColumn("upto", F.sum("n").over(up)).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
                     .withColumn("r1", F.floor((F.col("total") + 1) / 2)).withColumn("r2", F.floor(F.col("total") / 2) + 1))
    whole = ranked.groupBy(*keys).agg(F.sum("all").alias("n"), F.sum("d").alias("n_distinct"), F.min("lo").alias("least"), F.max("hi").alias("most"))
    holds = lambda r, upto, n: (F.col(upto) >= F.col(r)) & (F.col(upto) - F.col(n) < F.col(r))
    middle = ranked.where(holds("r1", "upto", "n") | holds("r2", "upto", "n")).select(*[F.col(k).alias("m_" + k) for k in keys], F.col("b").alias("m_b"), (F.col("upto") - F.col("n")).alias("below"), "r1", "r2")
    j = s.join(middle, _same(keys, "m_") & (F.col("b") == F.col("m_b")))
    within = Window.partitionBy(*keys, "b").orderBy("value")
    j = j.withColumn("upto", F.col("below") + F.sum("c").over(within))
    mid = j.groupBy(*keys).agg(((F.min(F.when(holds("r1", "upto", "c"), F.col("value"))) + F.min(F.when(holds("r2", "upto", "c"), F.col("value")))) / F.lit(2.0)).alias("median"))
    mid = mid.select(*[F.col(k).alias("m_" + k) for k in keys], "median")
    return whole.join(mid, _same(keys, "m_"), "left").select(*keys, "n", "n_distinct", "least", "most", "median")


def period_report(state: DataFrame, keys: list[str]) -> DataFrame:
    """Per group and period, from the state alone: counts before and after correction, refused rows, and re-derived statistics."""
    counts = state.groupBy(*keys).agg(F.sum("n_first").alias("n_first"), F.sum(F.col("n_all") - F.col("n_first")).alias("n_corrections"), F.sum("n_refused").alias("n_refused"))
    stats = derive(state, keys, "n_all").select(*[F.col(k).alias("s_" + k) for k in keys], F.col("n").alias("n_final"), "n_distinct", "least", "most", "median")
    return counts.join(stats, _same(keys, "s_"), "left").select(*keys, "n_first", "n_corrections", F.coalesce("n_final", F.lit(0)).alias("n_final"), "n_refused", "n_distinct", "least", "most", "median")
