import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.mixing import budgets, fit_budget, mix
from tidemark.llm.packing import fill_report, pack, pack_documents, plan_sweeps
from tidemark.llm.tokens import encoding


def check_packed(rows, docs, capacity):
    load, seen = Counter(), {}
    for r in rows:
        load[r["container_id"]] += r["n_tokens"]
        seen.setdefault(r["doc_id"], []).append((r["piece"], r["start_token"], r["n_tokens"]))
    assert max(load.values(), default=0) <= capacity
    for doc, n in docs:
        p = sorted(seen[doc])
        assert sum(x[2] for x in p) == n and [x[1] for x in p] == [capacity * x[0] for x in p] and len(p) == max(1, -(-n // capacity))
    return sum(1 for v in load.values() if v)


def test_pack(spark):
    r = random.Random(1)
    docs = [(i, r.choice([0, 1, 7, 100, 100, 100, r.randrange(1, 400), r.randrange(1, 2000)])) for i in range(2000)]
    got = pack(spark.createDataFrame(docs, "doc_id long, n_tokens long"), 300)
    used = check_packed(got.collect(), docs, 300)
    report = fill_report(got, 300).first()
    assert report["containers"] == used and report["fill"] > 0.98


def test_texts(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "a b c d e f " * 500)], "doc_id long, text string")
    rows = pack_documents(docs, 64).collect()
    enc = encoding()
    check_packed(rows, [(1, len(enc.encode_ordinary("hello world"))), (2, 0), (3, 0), (4, len(enc.encode_ordinary("a b c d e f " * 500)))], 64)
    assert pack_documents(docs.limit(0), 64).count() == 0
    tokens = enc.encode_ordinary("a b c d e f " * 500)
    pieces = sorted((r["start_token"], r["n_tokens"]) for r in rows if r["doc_id"] == 4)
    assert enc.decode([t for s, n in pieces for t in tokens[s : s + n]]) == "a b c d e f " * 500


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=12))
def test_plan_places_every_document_once(counts):
    segments, used = plan_sweeps(counts, 50)
    placed, load = Counter(), Counter()
    for size, rank, n, first, per in segments:
        placed[int(size)] += int(n)
        for k in range(n):
            load[int(first) + k // int(per)] += int(size)
    assert placed == Counter(counts) and all(v <= 50 for v in load.values()) and len(load) == used
    least = max(sum(s * c for s, c in counts.items()) / 50, sum(c for s, c in counts.items() if s > 25))
    assert used <= 1.7 * least + 1


def test_budget_is_met():
    lengths, counts = np.array([3, 7, 50, 900, 30_000]), np.array([100, 80, 900, 400, 3])
    for budget in (0, 1, 3, 1000, 123_457, 400_000):
        take = fit_budget(lengths, counts, budget, 5)
        assert (take <= counts).all() and (take >= 0).all()
        assert budget - int((take * lengths).sum()) in ((0,) if budget not in (1,) else (1,))


def test_budgets_fill_up():
    got = budgets(1000, {"a": 0.5, "b": 0.3, "c": 0.2, "d": 0.0}, {"a": 100, "b": 900, "c": 900, "d": 5})
    assert got == {"a": 100, "b": 540, "c": 360, "d": 0} and sum(budgets(10**6, {"a": 0.5, "b": 0.5}, {"a": 10, "b": 10}).values()) == 20


def test_mix(spark):
    r = random.Random(3)
    docs = [(i, r.choice(["big"] * 5 + ["mid", "mid", "small", None, "other"]), r.randrange(0, 60)) for i in range(3000)] + [(9000, "tiny", 5)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("big", 0.3, 1), ("mid", 0.5, 3), ("small", 0.15, 4), ("tiny", 0.05, 2), ("gone", 0.0, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    chosen, report = mix(df, targets)
    rows, rep = chosen.collect(), {x["source"]: x for x in report.collect()}
    used = Counter()
    for x in rows:
        assert 1 <= x["uses"] <= rep[x["source"]]["max_repeats"]
        used[x["source"]] += x["uses"] * x["n_tokens"]
    assert len({x["doc_id"] for x in rows}) == len(rows)
    total = sum(d[2] for d in docs) // 2
    assert abs(sum(used.values()) - total) <= 10 and used["tiny"] == 10 and rep["gone"]["actual_tokens"] == 0
    assert all(rep[s]["actual_tokens"] == used[s] for s in rep) and abs(sum(x["actual_share"] for x in rep.values()) - 1) < 1e-9
    assert {tuple(x) for x in mix(df, targets)[0].collect()} == {tuple(x) for x in rows}
    assert mix(df.limit(0), targets)[0].count() == 0 and pytest.approx(0.5, abs=0.1) == rep["mid"]["actual_share"]
