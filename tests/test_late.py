import random
from statistics import median

from pyspark.sql import functions as F

from tidemark.operators.late import HOUR_US, PeriodState, apply_late, derive, multiset_state, period_report, period_text, replay, with_fates

SCHEMA = "id int, source string, e long, a long, value long"


def rows(n=3000):
    r = random.Random(5)
    out = [(i, r.choice(["A", "A", "B", None]), r.randrange(0, 50 * HOUR_US), 0, r.randrange(-9000, 9000)) for i in range(n)]
    out = [(i, s, e, e + r.randrange(-HOUR_US, 120 * HOUR_US), v) for i, s, e, _, v in out]
    return out + [(n, "A", None, 5, 1), (n + 1, "A", 5, None, 1), (n + 2, "A", 5, HOUR_US, None), (n + 3, "A", 5, HOUR_US + 1, 7), (n + 4, "A", 5, 73 * HOUR_US, 7), (n + 5, "A", 5, 73 * HOUR_US + 1, 7)]


def fate(e, a):
    if e is None or a is None:
        return "no_period"
    lag = a - (e - e % HOUR_US + HOUR_US)
    return "on_time" if lag <= 0 else "corrects" if lag <= 72 * HOUR_US else "refused"


def test_fates_and_report(spark):
    data = rows()
    f = with_fates(spark.createDataFrame(data, SCHEMA), F.col("e"), F.col("a"))
    assert {r["id"]: r["fate"] for r in f.collect()} == {r[0]: fate(r[2], r[3]) for r in data}
    groups = {}
    for _, s, e, a, v in data:
        if fate(e, a) != "no_period":
            groups.setdefault((s, e - e % HOUR_US), []).append((fate(e, a), v))
    got = {(r["source"], r["period_us"]): r for r in period_report(multiset_state(f, ["source", "period_us"], "value"), ["source", "period_us"]).collect()}
    assert got.keys() == groups.keys()
    for k, g in groups.items():
        r, accepted = got[k], [v for x, v in g if x != "refused"]
        known = [v for v in accepted if v is not None]
        assert (r["n_first"], r["n_final"], r["n_refused"]) == (sum(x == "on_time" for x, _ in g), len(accepted), len(g) - len(accepted))
        assert r["median"] == (median(known) if known else None) and r["n_distinct"] == (len(set(known)) if accepted else None)
        assert (r["least"], r["most"]) == ((min(known), max(known)) if known else (None, None))


def test_late_rows_adjust_stored_counts(spark):
    f = with_fates(spark.createDataFrame(rows(500), SCHEMA), F.col("e"), F.col("a")).cache()
    keys = ["source", "period_us"]
    whole = multiset_state(f, keys, "value")
    parts = apply_late(multiset_state(f.where("id % 3 = 0"), keys, "value"), multiset_state(f.where("id % 3 <> 0"), keys, "value"), keys)
    as_set = lambda d: {tuple(r) for r in derive(d, keys, "n_all").collect()}
    assert as_set(whole) == as_set(parts)


def test_replayed_batches_give_the_state_of_the_whole(spark):
    df = spark.createDataFrame(rows(800), SCHEMA).selectExpr("id", "source", "e as event_us", "a as arrival_us", "value")
    keys = ["source", "period_us"]
    whole = with_fates(df, F.col("event_us"), F.col("arrival_us"))
    state = replay(df, keys, "value", 12 * HOUR_US)
    held = state._load()
    assert len(held["batches"]) > state.merge_every and held["state"] and len(held["behind"]) < state.merge_every
    as_set = lambda d: {tuple(r) for r in d.collect()}
    assert as_set(state.state().select(*keys, "value", "n_first", "n_all", "n_refused")) == as_set(multiset_state(whole, keys, "value").select(*keys, "value", "n_first", "n_all", "n_refused"))
    assert as_set(state.log().select("id", "fate")) == as_set(whole.select("id", "fate"))
    before = state.state().count()
    state.add(df, held["batches"][0])  # a batch delivered again
    assert state.state().count() == before


def test_late_batch_corrects_a_stored_period(spark, tmp_path):
    state = PeriodState(spark, str(tmp_path / "s"), ["source", "period_us"], "value", merge_every=1)
    batch = lambda *r: spark.createDataFrame(list(r), "source string, event_us long, arrival_us long, value long")
    report = lambda: period_report(state.state(), ["source", "period_us"]).first()
    state.add(batch(("A", 5, 6, 10), ("A", 6, 7, 20)), 0)
    assert (report()["median"], report()["n_final"]) == (15.0, 2)
    state.add(batch(("A", 7, 2 * HOUR_US, 90), ("A", 7, 80 * HOUR_US, 91)), 1)
    assert (report()["median"], report()["n_first"], report()["n_final"], report()["n_refused"], report()["most"]) == (20.0, 2, 3, 1, 90)


def test_empty_and_text(spark):
    empty = spark.createDataFrame([], SCHEMA).selectExpr("id", "source", "e as event_us", "a as arrival_us", "value")
    state = replay(empty, ["source", "period_us"], "value")
    assert period_report(state.state(), ["source", "period_us"]).count() == 0 and state.log().count() == 0
    assert spark.range(1).select(period_text(F.lit(1_767_319_200_000_000)).alias("p")).first()["p"] == "2026-01-02T02"
