import random
import re
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest

from tidemark.llm import history_dedup
from tidemark.llm.history_dedup import refused_pairs, refused_titles
from tidemark.llm.near_duplicates import ESTIMATORS, alike_groups, alike_pairs, collision_rate, corrected, registers

SCHEMA = "id string, title string, ingested_time timestamp, cid string, elems string, n int"
T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)


def elements(title):
    w = [x for x in re.split(r"\W+", (title or "").lower()) if x]
    return set(w) | set(zip(w, w[1:]))


def alike(a, b):
    x, y = elements(a), elements(b)
    return bool(x & y) and len(x & y) >= 0.75 * len(x | y)


def data(n=260):
    r = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        if i % 3 == 2:
            t = rows[r.randrange(len(rows))][1] or "x"
            w = t.split() or ["x"]
            how = r.randrange(4)
            if how == 0:
                w[r.randrange(len(w))] = r.choice(words)
            elif how == 1:
                w.insert(r.randrange(len(w)), r.choice(words))
            elif how == 2:
                w = [x.upper() for x in w]
            t = " ".join(w)
        else:
            t = f"Shares of {r.choice(words)} {r.choice(words)} slip as " + " ".join(r.choice(words) for _ in range(8)) + " weigh on outlook"
        rows.append((f"id{r.randrange(10**9):09d}", t, T0 + timedelta(hours=r.randrange(24 * 40)), "c", "e", 1))
    rows += [("n1", None, T0, None, None, None), ("n2", None, T0, None, None, None), ("e1", "", T0, None, None, None), ("e2", "...", T0, None, None, None), ("one", "Solo", T0, None, None, None), ("two", "solo!", None, None, None, None)]
    rows += [(f"hot{i}", "Third of all rows carry this very same long headline today", T0 + timedelta(days=i % 35), "", "", 0) for i in range(30)]
    rows += [("long", "word " * 3000 + "end", T0, "", "", 0), ("long2", "word " * 3000 + "end", T0 + timedelta(days=3), "", "", 0)]
    return rows + rows[:3]


def test_pairs_and_groups(spark):
    rows = data()
    t = {i: x for i, x, *_ in rows}
    ids = sorted(t)
    want = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if alike(t[a], t[b])}
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in alike_pairs(df, "id", "title").collect()]
    assert len(got) == len(set(got)) and not set(got) - want and len(set(got)) >= 0.98 * len(want)
    groups = {r["id"]: r for r in alike_groups(df, "id", "title").collect()}
    assert groups.keys() == t.keys() and all(groups[a]["group_id"] == groups[b]["group_id"] for a, b in got)
    assert all(groups[i]["n_links"] == sum(i in p for p in got) for i in ids)


def test_hot_story_loses_no_pair(spark):
    r = random.Random(4)
    base = [f"s{i}" for i in range(17)]
    rows = []
    for i in range(900):
        w = list(base) if i % 3 == 0 else [f"w{r.randrange(2000)}" for _ in range(12)]
        for _ in range(1 + i % 2 if i % 3 == 0 else 0):
            w.insert(r.randrange(len(w)), f"e{r.randrange(3000)}")
        rows.append((f"i{i:04d}", " ".join(w)))
    sets = [(i, elements(t)) for i, t in rows]
    want = {(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :] if len(x & y) >= 0.75 * len(x | y)}
    got = [tuple(p) for p in alike_pairs(spark.createDataFrame(rows, "id string, title string"), "id", "title").collect()]
    assert len(want) > 1000 and len(got) == len(set(got)) and set(got) == want


def sequential(rows):
    accepted, out, seen = [], set(), set()
    for i, t, at, *_ in sorted(set(r[:3] for r in rows), key=lambda r: (r[2] is None, r[2] or T0, r[0])):
        hit = next((a for a, x in accepted if alike(x, t)), None)
        if hit:
            out.add((min(hit, i), max(hit, i)))
        else:
            accepted.append((i, t))
    return out


@pytest.mark.parametrize("days, solo, renew, block", [(1, 5_000, 50, 2_000), (14, 0, 50, 10), (60, 0, 1_000, 2_000)])
def test_refused_rows_follow_the_sequential_rule(spark, monkeypatch, days, solo, renew, block):
    """Single days in one task each, and spread batches with hot keys cut into blocks; the order renewed on the way."""
    monkeypatch.setattr(history_dedup, "RENEW", renew)
    monkeypatch.setattr(history_dedup, "BLOCK", block)
    rows = data()
    got = [tuple(r) for r in refused_pairs(spark.createDataFrame(rows, SCHEMA), batch_days=days, solo=solo).collect()]
    assert len(got) == len(set(got)) and set(got) == sequential(rows)


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert refused_titles(df).count() == 0 and alike_pairs(df, "id", "title").count() == 0 and alike_groups(df, "id", "title").count() == 0


def test_registers_estimate_jaccard():
    rng = np.random.default_rng(2)
    truth, guess = [], []
    for shared in (20, 60, 90):
        a = rng.integers(-(2**62), 2**62, 100)
        b = np.r_[a[:shared], rng.integers(-(2**62), 2**62, 100 - shared)]
        reg = registers(np.r_[a, b], np.array([0, 100]), ESTIMATORS * 16, 5)
        agree = (reg[0] == reg[1]).sum() / 16
        truth.append(shared / (200 - shared))
        guess.append(corrected(np.array([agree]), np.array([100]), np.array([100]))[0])
    assert np.allclose(truth, guess, atol=0.06) and 0 < collision_rate(100, 100) < 0.01
