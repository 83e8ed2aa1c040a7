"""Column functions of payloads, answers and exact quantiles, against hand-made cases and plain Python."""
import json
import random
from statistics import median

from pyspark.sql import functions as F

from tidemark.functions import records as R
from tidemark.functions import text as X
from tidemark.operators.ranks import exact_quantiles


def test_exact_quantiles(spark):
    r = random.Random(3)
    rows = [(k, float(r.randrange(50) if k == "hot" else r.random() * 1e6)) for k in ["hot"] * 900 + ["b"] * 301 + [None] * 7 + ["one"]]
    rows += [("b", None), ("void", None), ("neg", -5.0), ("neg", -5.0), ("neg", 2.0)]
    wanted = {"mid": ("linear", 0.5), "p95": ("rank", 0.95), "upper": ("rank", 0.5)}
    got = {x["k"]: x for x in exact_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", wanted).collect()}
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    assert got.keys() == groups.keys()
    for k, vs in groups.items():
        vs.sort()
        assert got[k]["n"] == len(vs) and abs(got[k]["mid"] - median(vs)) < 1e-9 * max(1, abs(median(vs)))
        assert got[k]["p95"] == vs[int(len(vs) * 0.95)] and got[k]["upper"] == vs[len(vs) // 2]
    assert exact_quantiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", wanted).count() == 0


OK = {"id": "a", "title": "t", "source": "RSS", "published_at": "2026-01-01T00:00:00Z"}


def test_payload_rules(spark):
    cases = [(None, "null payload"), ("{", "not JSON"), ("[1]", "not an object"), (json.dumps(OK), None), (json.dumps(OK | {"published_at": "2026-01-01T00:00:00"}), "published_at is no ISO time with offset"),
             (json.dumps(OK | {"event_time": "soon"}), "event_time is no ISO time with offset"), (json.dumps(OK | {"title": "  "}), "blank id or title"), (json.dumps(OK | {"source": "SEC"}), "topic and source disagree"),
             (json.dumps(OK | {"embedding": [1.0, 2.0]}), "embedding is not 384 finite numbers"), (json.dumps(OK | {"embedding": [0.5] * 384}), None), (json.dumps(OK | {"semantic_score": "high"}), "score is not finite"), ("", "not JSON")]
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(cases)], "i int, p string")
    got = {r["i"]: r["e"] for r in df.select("i", R.first_error(F.col("p"), F.lit("RSS")).alias("e")).collect()}
    assert [got[i] for i in range(len(cases))] == [e for _, e in cases]


def test_field_diff(spark):
    sec = {"id": "f", "title": "[8-K] X", "source": "SEC", "metadata": {"cik": "123", "form_type": "8-k"}}
    cases = [(OK, OK | {"title": " t "}, "", "", ""), (OK, OK | {"published_at": "2026-01-01T01:00:00+01:00"}, "", "", ""), (OK, OK | {"published_at": "2026-01-01T01:00:00Z"}, "published_at", "", ""),
             (OK, OK | {"content_full": "x"}, "", "content_full", ""), (OK | {"content_full": "x"}, OK, "", "", "content_full"), (OK | {"content_full": "x"}, OK | {"content_full": "y"}, "content_full", "", ""),
             (OK, OK | {"tickers_mentioned": ["aapl", "AAPL"]}, "", "tickers_mentioned", ""), (OK | {"canonical_cluster_id": "a"}, OK, "", "", ""), (OK, OK | {"metadata": {"k": "v"}, "url": "u"}, "", "", "url,metadata"),
             (OK | {"content_snippet": "x"}, OK | {"content_snippet": "y", "source": "GDELT"}, "", "", "content_snippet,source"), (sec, sec | {"metadata": {"cik": "0000000123", "form_type": "8-K"}}, "", "", ""),
             (sec, sec | {"metadata": {"cik": "124", "form_type": "8-K", "company_name": "Y"}}, "cik,company_name", "", ""), (sec, sec | {"content_full": "text"}, "content_full", "", "")]
    df = spark.createDataFrame([(i, json.dumps(a), json.dumps(b)) for i, (a, b, *_) in enumerate(cases)], "i int, a string, b string")
    got = {r["i"]: tuple(r["d"]) for r in df.select("i", R.field_diff(F.col("a"), F.col("b")).alias("d")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2:] for c in cases]


def test_answers_and_tickers(spark):
    cases = [("story: 1 7 | same deal", ("multi", ["1", "7"], "same deal", None)), ("alone: 2 4  # later", ("alone", ["2", "4"], None, None)), ("uncertain: 3|", (None, ["3"], None, "a reason is needed")),
             ("story: 1 | x", (None, ["1"], "x", "a story needs at least two")), ("tale: 1 2", (None, [], None, "not story:, uncertain: or alone:")), ("# only a remark", (None, [], None, None)), ("story: 1 1 | x", (None, ["1", "1"], "x", "a number is repeated"))]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r["i"]: tuple(r["p"]) for r in df.select("i", X.parse_answer(F.col("t")).alias("p")).collect()}
    assert [got[i] for i in range(len(cases))] == [c for _, c in cases]
    one = spark.createDataFrame([("THE $F and NVDA, AAPL of USD $TOOLONG",)], "t string").select(X.tickers(F.col("t")).alias("x")).first()["x"]
    assert one == ["AAPL", "F", "NVDA"]


def test_profile_round_trip(spark):
    t = spark.createDataFrame([("beats and never rises",), ("",), ("plain words",)], "t string")
    for r in t.select(X.profile(X.tokens(F.col("t"))).alias("p")).select("p", X.parse_profile(X.profile_text(F.col("p"))).alias("q")).collect():
        assert r["p"] == r["q"]
