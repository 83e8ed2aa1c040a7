"""Every query with SQL gives the rows of its SQL; text rules by hand-made cases; clusters against the greedy rule."""
import glob
import math
import os
from datetime import datetime, timedelta, timezone

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import vectors as V
from tidemark.operators.clusters import assign_clusters
from tidemark.operators.components import components
from tidemark.operators.pit import micros, vector_top_k
from tidemark.plans import core_problems, duplicates, evidence, ledgers, reference, similarity

DATA = "/root/testdata/sf0.001"
MODULES = (core_problems, reference, ledgers, duplicates, similarity, evidence)
QUERIES, SQL = ({k: v for m in MODULES for k, v in getattr(m, what).items()} for what in ("QUERIES", "SQL"))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if v is None or v is False or v is True or isinstance(v, str):
        return str(v)
    return "None" if isinstance(v, float) and math.isnan(v) else f"{float(v):.9g}" if abs(v) < 2**50 else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    order = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    cur = duck.execute(SQL[name])
    columns = [c[0] for c in cur.description]
    want = sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in cur.fetchall())
    assert sorted(columns) == order and got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def one(spark, *columns, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(*columns).first()


def test_polarity(spark):
    prof = lambda t: one(spark, X.profile_text(X.profile(X.tokens(F.col("t")))).alias("p"), t=t)["p"]
    assert prof("Tesla beats estimates, shares rallies") == "+beat,+rally"
    assert prof("Tesla did not beat estimates") == "-beat"
    assert prof("Fed hiking; stocks slid and topped, cutting") == "+hike,+top,-cut,-slide"
    assert prof("not a b c beat") == "+beat" and prof("") == "" and prof(None) is None
    clash = lambda a, b: one(spark, X.conflict(X.profile(X.tokens(F.col("a"))), X.profile(X.tokens(F.col("b")))).alias("c"), a=a, b=b)["c"]
    assert clash("upgrade", "downgrades") and clash("soar", "plunged") and clash("beats", "fails to beat")
    assert not clash("beats", "beats and rises") and not clash("Oil surges as stocks slide", "Oil rallies as stocks slide") and not clash("flat", "down")


def test_shingles_and_entities(spark):
    assert one(spark, X.shingles(F.col("t")).alias("s"), t="Gold Jumps")["s"] == ["__POLAR_ANCHOR_1__jump", "__POLAR_ANCHOR_2__jump", "gold", "gold jumps", "jumps"]
    ent = lambda t: one(spark, X.entities(F.col("t")).alias("e"), t=t)["e"]
    assert ent("Bank of England and the Fed; Teslas, $XYZ and CEO of IBM") == ["BOE", "FED", "IBM", "XYZ"]
    assert ent("Bank of England and the Fed") == ["BOE", "FED"]
    assert ent("") == [] and ent("Goldman Sachs upgrades Ford") == ["F", "GS"]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [2.0, 0.0]), (4, None), (5, [0.0, 1.0])], "id int, v array<double>")
    assert [tuple(r) for r in vector_top_k(df, "id", "v", [1.0, 0.0], 2).collect()] == [(1, 1.0), (3, 1.0)]
    assert df.where("id = 2").select(V.unit(F.col("v")).alias("u")).first()["u"] == [0.0, 0.0]
    with pytest.raises(ValueError):
        micros("2026-01-01T00:00:00")


def test_cosine_pairs_across_labels_and_blocks(spark):
    df = spark.createDataFrame([(i, [float(i % 7 - 3), float(i % 5 - 2), 1.0]) for i in range(60)] + [(90, [0.0, 0.0, 0.0]), (91, [1.0])], "id long, e array<double>")
    v = {r["id"]: r["e"] for r in df.collect() if r["id"] < 60}
    cos = lambda x, y: sum(a * b for a, b in zip(x, y)) / math.sqrt(sum(a * a for a in x) * sum(b * b for b in y))
    want = {(a, b) for a in v for b in v if a % 2 == 0 and cos(v[a], v[b]) >= 0.21}
    got = [(r["a"], r["b"]) for r in V.block_pairs(df.where("id % 2 = 0"), df.where("id <> 91"), 0.21, size=8).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    everything = {tuple(r) for r in QUERIES["mth5_cosine_all"](spark, DATA).collect()}
    assert len(everything) == 147


def greedy(rows, method, spark):
    """Row by row, as the sequential rule says."""
    import re

    lex = X.inflections()

    def shingle(t):
        w = re.sub(r"[^\w\s]", " ", t.lower()).split()
        return set(w) | {f"{a} {b}" for a, b in zip(w, w[1:])} | {f"__{k}__{lex[x]}" for x in w if x in lex for k in (1, 2)}

    done, families, out = [], {}, {}
    for v, a, t, at in sorted(rows, key=lambda r: (r[3], r[0])):
        root, best = families.get(a), 0.0
        if root is None:
            for pv, pt, pat in done:
                if pat >= at - timedelta(hours=24):
                    x, y = shingle(t), shingle(pt)
                    s = float(" ".join(t.lower().split()) == " ".join(pt.lower().split())) if method == "exact" else len(x & y) / len(x | y) if x | y else 0.0
                    if s >= 0.75 and s > best:
                        root, best = out[pv], s
        out[v] = families[a] = root or v
        done.append((v, t, at))
    return out


@pytest.mark.parametrize("method", ["exact", "lexical"])
def test_clusters_follow_the_greedy_rule(spark, method):
    t0 = datetime(2026, 1, 1, tzinfo=timezone.utc)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi".split()
    rows = [(f"v{i:03d}", f"a{i % 45}", " ".join(words[(i * 7 + k) % 3 : (i * 7 + k) % 3 + 12] + [words[i % 5]]), t0 + timedelta(hours=i // 2)) for i, k in ((i, i % 2) for i in range(120))]
    df = spark.createDataFrame([(*r, r[3]) for r in rows], "version_id string, article_id string, title string, available_at timestamp, observed_at timestamp")
    got = {r["version_id"]: r["cluster_id"] for r in assign_clusters(df, method).collect()}
    assert got == greedy(rows, method, spark)
    prefix = {r["version_id"]: r["cluster_id"] for r in assign_clusters(df.where("version_id < 'v060'"), method).collect()}
    assert prefix == {k: v for k, v in got.items() if k < "v060"}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20] + [(50, 50)], "a int, b int")
    got = {r["node"]: r["label"] for r in components(edges).collect()}
    assert got == {i: 0 if i <= 20 else 21 for i in range(41)} | {50: 50}
