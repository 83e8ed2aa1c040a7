import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions.text import NEGATIVE, POSITIVE, conflict, conflict_bits
from tidemark.operators.cascade import arrival_rank, best_in_window, cascade, meetings, window_neighbours

HOUR = 3_600_000_000


def test_window_against_brute_force(spark):
    r = random.Random(2)
    base = np.random.default_rng(2).standard_normal((6, 16))
    rows = [(f"i{k:03d}", r.randrange(0, 30) * HOUR // 4, [float(x) for x in base[r.randrange(6)] + 0.3 * np.random.default_rng(k).standard_normal(16)]) for k in range(200)]
    rows += [("zero", HOUR, [0.0] * 16), ("none", HOUR, None), ("late", None, [1.0] * 16)]
    order = sorted((x for x in rows if x[1] is not None and x[2] is not None), key=lambda x: (x[1], x[0]))
    want = set()
    for n, b in enumerate(order):
        for a in order[max(0, n - 15) : n]:
            x, y = np.array(a[2]), np.array(b[2])
            if a[1] > b[1] - 2 * HOUR and np.linalg.norm(x) * np.linalg.norm(y) > 0 and round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 6) >= 0.76:
                want.add((a[0], b[0]))
    df = spark.createDataFrame(rows, "id string, t long, v array<double>")
    got = [(x["a"], x["b"]) for x in window_neighbours(df, cap=15).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    assert [x["id"] for x in arrival_rank(df.where("t is not null and v is not null")).orderBy("rank").collect()] == [x[0] for x in order]


def test_cascade(spark):
    news = [("a", "RSS", "Oil surges on supply fears in the northern fields today", 0), ("b", "GDELT", "Oil surges on supply fears in the northern fields", HOUR), ("c", "RSS", "Crude jumps as supplies tighten", 1 * HOUR + 5),
            ("d", "RSS", "Crude plunges as supplies tighten", 1 * HOUR + 6), ("e", "SEC", "Oil surges on supply fears in the northern fields today", 2), ("f", "RSS", None, 3), ("g", "RSS", "Crude jumps", 9 * HOUR)]
    vec = [(i, [1.0, 0.1]) for i in "abcdefg"]
    out = {x["id"]: x for x in cascade(spark.createDataFrame(news, "id string, source string, title string, t long"), spark.createDataFrame(vec, "id string, v array<double>")).collect()}
    assert {k: (v["tier"], v["cluster_id"]) for k, v in out.items()} == {"a": ("none", "a"), "b": ("lexical", "a"), "c": ("semantic", "a"), "d": ("none", "d"), "e": ("none", "e"), "f": ("none", "f"), "g": ("none", "g")}


def test_cascade_asks_the_whole_window(spark):
    """1,100 rows lie between a row and its only like."""
    g = np.random.default_rng(4)
    rows = [(f"m{k:04d}", "RSS", f"w{k} x{k} y{k} z{k}", 1_000 + k, g.standard_normal(64)) for k in range(1100)]
    rows += [("first", "RSS", "Harbour strike widens", 0, rows[0][4] * -1), ("last", "RSS", "Dockers walk out", HOUR, rows[0][4] * -2), ("after", "RSS", "Ports shut", 2 * HOUR, rows[0][4] * -3)]
    news = spark.createDataFrame([x[:4] for x in rows], "id string, source string, title string, t long")
    vec = spark.createDataFrame([(x[0], [float(y) for y in x[4]]) for x in rows], "id string, v array<float>")
    out = {x["id"]: (x["tier"], x["parent"], x["cluster_id"]) for x in cascade(news, vec).collect()}
    assert len(out) == len(rows) and out["last"] == ("semantic", "first", "first") and out["after"] == ("semantic", "last", "first")
    assert sum(tier != "none" for tier, _, _ in out.values()) == 2


def test_best_of_the_window_against_its_pairs(spark):
    r, g = random.Random(6), np.random.default_rng(6)
    base = g.standard_normal((5, 16))
    words = lambda: sorted(r.sample([*POSITIVE, *NEGATIVE], r.choice([0, 0, 1, 2])))
    rows = [(f"i{r.randrange(10**6):06d}{k}", r.randrange(0, 40) * HOUR // 8, [float(x) for x in base[r.randrange(5)] + r.choice([0, 0.3]) * g.standard_normal(16)], (words(), words()), sorted(r.sample("ABCD", r.randrange(3)))) for k in range(240)]
    df = spark.createDataFrame(rows, "id string, t long, v array<float>, p struct<pos: array<string>, neg: array<string>>, e array<string>").cache()
    side = lambda c: df.select(F.col("id").alias(c), F.col("p").alias("p" + c), F.col("e").alias("e" + c))
    gate = (F.size("ea") == 0) | (F.size("eb") == 0) | F.arrays_overlap("ea", "eb")
    pairs = window_neighbours(df, block=7)
    order = sorted(rows, key=lambda x: (x[1], x[0]))
    unit = {x[0]: np.array(x[2], np.float32).astype(float) / np.linalg.norm(np.array(x[2], np.float32).astype(float)) for x in rows}
    assert {(x["a"], x["b"]) for x in pairs.collect()} == {(a[0], b[0]) for n, b in enumerate(order) for a in order[:n] if a[1] > b[1] - 2 * HOUR and round(float(unit[a[0]] @ unit[b[0]]), 6) >= 0.76}
    ok = pairs.join(side("a"), "a").join(side("b"), "b").where(gate & ~conflict(F.col("pa"), F.col("pb")))
    want = {(x["b"], x["a"]) for x in ok.groupBy("b").agg(F.min_by("a", F.struct(-F.col("score"), F.col("a"))).alias("a")).collect()}
    for block in (7, 1000):
        got = best_in_window(df.select("id", "t", "v", *conflict_bits(F.col("p")), "e"), block=block).collect()
        assert len(got) == len(want) > 100 and {(x["b"], x["a"]) for x in got} == want


def test_meetings_reach_the_window():
    r = random.Random(7)
    times = sorted(r.randrange(0, 40) for _ in range(300))
    met = [(b, h) for task in meetings(times, 5) for b, first, last in task for h in range(first, last + 1)]
    assert len(met) == len(set(met)) and max(sum(last + 1 - first for _, first, last in task) for task in meetings(times, 5)) <= 8
    assert set(met) >= {(b, h) for b in range(300) for h in range(b + 1) if h == b or times[h + 1] > times[b] - 5}
    assert meetings([], 5) == [[]]
