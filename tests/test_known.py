import random

import numpy as np

from tidemark.operators.known import PersistentTree, as_known

E = "entity string, t long, known string, extra string"
K = "entity string, known long, valid long, seq long, pay string, t long"


def brute(events, facts):
    out = []
    for entity, t, *_ in events:
        best = None
        for e, known, valid, seq, pay, _ in facts:
            if None in (e, known, valid, pay, t) or e != entity or known >= t or valid >= t:
                continue
            key = (valid, -(2**62) if seq is None else seq, pay)
            if best is None or key > best:
                best = key
        out.append((entity, t, best[2] if best else None))
    return sorted(out, key=str)


def check(spark, events, facts, hot):
    got = as_known(spark.createDataFrame(events, E), spark.createDataFrame(facts, K), "entity", "t", "known", "valid", "seq", "pay", "found", hot)
    assert got.columns == ["entity", "t", "known", "extra", "found"]
    assert sorted(((r["entity"], r["t"], r["found"]) for r in got.collect()), key=str) == brute(events, facts)


def data(n, seed):
    r = random.Random(seed)
    name = lambda: "hot" if r.random() < 0.4 else r.choice(["a", "b", "c", None])
    facts = [(name(), r.choice([None, *range(60)]), r.choice([None, *range(60)]), r.choice([None, 1, 2]), f"d{r.randrange(20)}", 0) for _ in range(n)]
    events = [(name(), r.choice([None, *range(70)]), "x", "y") for _ in range(n)]
    return events, facts + facts[:10]


def test_against_brute_force(spark):
    check(spark, *data(300, 1), hot=10_000)


def test_hot_entities_are_split(spark):
    check(spark, *data(300, 2), hot=20)


def test_boundary_and_empty(spark):
    check(spark, [("a", 5, "", ""), ("a", 6, "", "")], [("a", 5, 5, 1, "x", 0), ("a", 5, 5, 2, "y", 0)], 100)
    check(spark, [("a", 5, "", "")], [], 100)
    assert as_known(spark.createDataFrame([], E), spark.createDataFrame([], K), "entity", "t", "known", "valid", "seq", "pay", "found").count() == 0


def test_old_roots_stay():
    ranks = np.random.default_rng(3).permutation(97)
    tree = PersistentTree(ranks)
    for root in range(-1, 97):
        have = sorted(ranks[: root + 1])
        for q in range(-1, 97, 5):
            want = max([x for x in have if x <= q], default=-1)
            assert tree.floor(np.array([root]), np.array([q]))[0] == want
