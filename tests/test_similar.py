"""Queries on similar titles move what the rows are worth, not what one template's rows make in pairs."""
import random
from datetime import datetime, timedelta, timezone

import pytest

from tidemark.functions import text as X
from tidemark.plans.similarity import QUERIES

N = 900


def moved(spark, run):
    """What run() returns, and the bytes that the stages it started wrote for shuffles."""
    sc = spark.sparkContext

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty(60_000)
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {(found.apply(i).stageId(), found.apply(i).attemptId()): found.apply(i).shuffleWriteBytes() for i in range(found.size())}

    before = stages()
    got = run()
    return got, sum(n for k, n in stages().items() if k not in before)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """One template with names of its own in each title; every tenth title is another one with a word added."""
    r, start = random.Random(8), datetime(2026, 1, 1, tzinfo=timezone.utc)
    name = lambda: "".join(r.choice("bcdfgklmnprstv") + r.choice("aeiou") for _ in range(4)).capitalize()
    rows = []
    for i in range(N):
        t = f"Union at {name()} Energy ends {name()} strike, accepts {r.randrange(5, 30)}% raise at {name()} sites from June" if i % 10 or not i else rows[r.randrange(i)][2] + " again"
        rows.append((f"id{r.randrange(10**9):09d}-{i}", r.choice(["RSS", "GDELT"]), t, start + timedelta(hours=i % 400)))
    d = tmp_path_factory.mktemp("similar")
    spark.createDataFrame(rows, "id string, source string, title string, ingested_time timestamp").coalesce(1).write.parquet(f"{d}/silver_financial_news.parquet")
    return str(d)


@pytest.fixture(scope="module")
def pairs(spark, folder):
    """By brute force: a < b -> score, between the least ids of each shingle set."""
    sets = {}
    for x in spark.read.parquet(f"{folder}/silver_financial_news.parquet").select("id", X.shingles(X.F.col("title")).alias("e")).collect():
        e = frozenset(x["e"])
        sets[e] = min(x["id"], sets.get(e, x["id"]))
    one = sorted((i, e) for e, i in sets.items())
    scores = {(a, b): len(x & y) / len(x | y) for k, (a, x) in enumerate(one) for b, y in one[k + 1 :]}
    return {k: round(v, 6) for k, v in scores.items() if v >= 0.75}


def test_jn13_moves_no_pairs_of_a_template(spark, folder, pairs):
    got, n = moved(spark, lambda: [tuple(x) for x in QUERIES["jn13_lsh_pairs"](spark, folder).collect()])
    assert len(got) == len(pairs) > 50 and {(a, b): s for a, b, s in got} == pairs
    assert n < 1_500 * N


def test_mth4_moves_rows_as_numbers(spark, folder, pairs):
    got, n = moved(spark, lambda: QUERIES["mth4_jaccard_pairs"](spark, folder).collect())
    assert {(x["a"], x["b"]): x["score"] for x in got} == pairs and all(x["copies_a"] >= 1 and x["copies_b"] >= 1 for x in got)
    assert n < 400 * N


def test_jn12_ends_pairs_apart_in_time(spark, folder):
    """Each title's best earlier one of a day, by brute force; pairs further apart are dropped before rows are joined to them."""
    rows = spark.read.parquet(f"{folder}/silver_financial_news.parquet")
    rows = sorted((x["ingested_time"], x["id"], set(x["e"])) for x in rows.select("id", "ingested_time", X.shingles(X.F.col("title")).alias("e")).collect())
    want = {}
    for n, (t, i, e) in enumerate(rows):
        near = [(-len(e & y) / len(e | y), s, j) for s, j, y in rows[:n] if s >= t - timedelta(days=1) and len(e & y) >= 0.75 * len(e | y)]
        if near:
            want[i] = (min(near)[2], round(-min(near)[0], 6))
    got, n = moved(spark, lambda: {x["id"]: (x["parent"], x["score"]) for x in QUERIES["jn12_best_within_day"](spark, folder).collect()})
    assert got == want and len(want) > 10
    assert n < 1_500 * N


def test_str6_moves_a_vector_once(spark):
    """A day of rows, of which only the end of a block is held for the next one's window."""
    from tidemark.operators.cascade import window_neighbours

    r = random.Random(3)
    rows = [(f"i{k:04d}", k * 60_000_000, [r.gauss(0, 1) for _ in range(384)]) for k in range(1440)]
    rows += [("twin", 1200 * 60_000_000 + 1, rows[1110][2]), ("late", 1400 * 60_000_000 + 1, rows[1200][2])]
    df = spark.createDataFrame(rows, "id string, t long, v array<float>")
    got, n = moved(spark, lambda: [tuple(x) for x in window_neighbours(df, cap=500).collect()])
    assert got == [("i1110", "twin", 1.0)]
    assert n < 1.6 * len(rows) * 384 * 4


def test_jn11_moves_no_pairs(spark):
    """Most rows of one template overlap: far more pairs than rows come out, none of them is shuffled."""
    from tidemark.operators.clusters import overlapping_rows

    r = random.Random(5)
    sets = {f"id{k:03d}": sorted({f"w{r.randrange(40)}" for _ in range(4)} | {"port", "strike", "union", "sites"}) for k in range(300)}
    scores = {(a, b): len(set(x) & set(y)) / len(set(x) | set(y)) for a, x in sets.items() for b, y in sets.items() if a < b}
    want = {k: v for k, v in scores.items() if v >= 0.3}
    df = spark.createDataFrame(list(sets.items()), "id string, e array<string>")
    got, n = moved(spark, lambda: [tuple(x) for x in overlapping_rows(df, "id", "e", 0.3).collect()])
    assert len(got) == len(want) > 100 * len(sets) and {(a, b): s for a, b, s in got} == want
    assert n < 2_000 * len(sets)
