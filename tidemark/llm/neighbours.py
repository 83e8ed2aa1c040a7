"""Most similar vectors for every vector: randomly rotated one-bit codes with error bounds, then exact reranking.

Vectors are normalised and exact copies folded into classes (the smallest ids of a class answer for it). Centroids
are fitted on a bounded sample (`sample` vectors, documented parameter); every vector is then indexed: assigned
to its nearest centroid and written, in blocks of at most `block`, to index files on shared storage holding the
rotated residual's sign bits, its correction scalars and the vector as it came. Each block of queries reads the codes
of the lists it probes, estimates every inner product from the packed bits and the scalars, keeps the
candidates whose upper error bound reaches the k-th best lower bound, and reranks those by exact cosine.

Only indexes cross the network as files; no vector is collected, no list is sampled. Lists of any length are cut
into blocks, so a group with a third of all rows is many tasks.

Defined results: null, wrong length, non-finite or all-zero vectors neither ask nor answer; ties in the cosine
rounded to 6 decimals go to the smaller id; fewer than k others give fewer rows; repeated ids count once.
"""
import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.shared import discard, get_bytes, materialize, open_fs, put_bytes, scratch

EPSILON = 1.9  # width of the error bound in standard deviations


def usable(df: DataFrame, ident: str, vector: str, dim: int) -> DataFrame:
    """id, v for the vectors that ask and answer; unordered repeats of an id are folded."""
    v = F.col(vector)
    ok = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return df.where(F.col(ident).isNotNull() & v.isNotNull() & ok).select(F.col(ident).cast("long").alias("id"), v.cast("array<float>").alias("v"))


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def fit_centroids(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means on the bounded sample; empty centroids restart at random vectors."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmax(x[i : i + 8192] @ c.T, axis=1) for i in range(0, len(x), 8192)])
        order = np.argsort(near, kind="stable")
        starts = np.searchsorted(near[order], np.arange(k))
        count = np.bincount(near, minlength=k)
        sums = np.add.reduceat(x[order], np.minimum(starts, len(x) - 1), axis=0)
        sums[count == 0] = x[rng.choice(len(x), int((count == 0).sum()))]
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


def encode(x: np.ndarray, c: np.ndarray, rot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits and (residual norm, <code, residual direction>, <residual, centroid>) per vector."""
    r = x - c
    norm = np.linalg.norm(r, axis=1)
    turned = (r / np.maximum(norm, 1e-12)[:, None]) @ rot
    code = np.packbits(turned > 0, axis=1)
    fit = np.abs(turned).sum(1) / np.sqrt(x.shape[1])
    return code, np.stack([norm, np.maximum(fit, 1e-6), r @ c], 1).astype(np.float32)


def estimate(code: np.ndarray, scalars: np.ndarray, c: np.ndarray, q: np.ndarray, rot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries x codes) and their error bounds."""
    d = q.shape[1]
    rq = q - c
    nq = np.linalg.norm(rq, axis=1)
    turned = (rq / np.maximum(nq, 1e-12)[:, None]) @ rot
    sign = np.unpackbits(code, axis=1, count=d).astype(np.float32)
    dot = (2.0 * (turned @ sign.T) - turned.sum(1, keepdims=True)) / np.sqrt(np.float32(d))
    scale = nq[:, None] * scalars[:, 0]
    est = (q @ c)[:, None] + scalars[:, 2] + scale * (dot / scalars[:, 1])
    err = scale * (EPSILON * np.sqrt(np.maximum(1 - scalars[:, 1] ** 2, 0) / (d - 1)) / scalars[:, 1])
    return est, err


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision."""
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _save(uri: str, **arrays: np.ndarray) -> None:
    buffer = io.BytesIO()
    for name in ("code", "scalars", "id"):
        np.save(buffer, arrays[name])
    put_bytes(uri + ".codes", buffer.getvalue())
    put_bytes(uri + ".vecs", arrays["x"].astype("<f4").tobytes())


def _codes(uri: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    buffer = io.BytesIO(get_bytes(uri + ".codes"))
    return np.load(buffer), np.load(buffer), np.load(buffer)


def _vectors(uri: str, rows: np.ndarray, dim: int) -> np.ndarray:
    """Exact vectors of some rows (ascending) of a block, neighbouring rows in one read."""
    fs, path = open_fs(uri + ".vecs")
    out = np.empty((len(rows), dim), np.float32)
    cuts = np.r_[0, np.flatnonzero(np.diff(rows) > 16) + 1, len(rows)]
    with fs.open_input_file(path) as f:
        for a, b in zip(cuts[:-1], cuts[1:]):
            first, last = int(rows[a]), int(rows[b - 1]) + 1
            part = np.frombuffer(f.read_at((last - first) * dim * 4, first * dim * 4), "<f4").reshape(-1, dim)
            out[a:b] = part[rows[a:b] - first]
    return out


def most_similar(df: DataFrame, ident: str, vector: str, dim: int, k: int = 5, lists: int | None = None, probes: int = 12,
                 sample: int = 10_000, block: int = 4096, seed: int = 7) -> DataFrame:
    """id, other, similarity (rounded to 6), place: the k most similar others of every usable vector."""
    spark = df.sparkSession
    root = scratch(spark, "vector-index")
    base = usable(df, ident, vector, dim)
    key = base.select("id", F.sha2(F.to_json("v"), 256).alias("class"), "v")
    # a class is all exact copies of a vector; its k + 1 smallest ids answer for it (rank limits run before the shuffle)
    members = materialize(key.select("id", "class"), "vector-members")
    place = Window.partitionBy("class").orderBy("id")
    heads = members.distinct().withColumn("r", F.row_number().over(place)).where(F.col("r") <= k + 1)
    heads = heads.groupBy("class").agg(F.array_sort(F.collect_list("id")).alias("ids"))  # at most k + 1 ids
    firsts = key.groupBy("class").agg(F.min_by("v", "id").alias("v"), F.min("id").alias("id"))
    classes = materialize(firsts.select("id", "class", "v"), "vector-classes")
    n = classes.count()
    empty = spark.createDataFrame([], "id long, other long, similarity double, place int")
    if n < 1:
        return empty
    lists = lists or max(1, min(4096, int(round(np.sqrt(n)))))
    picked = classes.select("v").where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)) < sample).limit(2 * sample).toPandas()["v"] if n > sample else classes.select("v").toPandas()["v"]
    x = np.stack(picked.to_numpy()).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lists = min(lists, len(x))
    cents = fit_centroids(x, lists, seed=seed)
    put_bytes(f"{root}/centroids.npy", cents.tobytes())  # lists x dim, at most 4096 x dim floats

    def centroids() -> np.ndarray:
        return np.frombuffer(get_bytes(f"{root}/centroids.npy"), np.float32).reshape(-1, dim)

    def unit(v: pd.Series) -> np.ndarray:
        return _unit(np.stack(v.to_numpy())).astype(np.float32)

    def assign(batches):
        c = centroids()
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"id": pdf["id"], "list": np.argmax(unit(pdf["v"]) @ c.T, axis=1), "v": pdf["v"]})

    assigned = materialize(classes.select("id", "v").mapInPandas(assign, "id long, list int, v array<float>"), "vector-lists")
    discard(classes)  # the lists hold the vectors now
    sizes = assigned.groupBy("list").agg(F.count(F.lit(1)).alias("n"))  # at most `lists` rows
    split = {int(r["list"]): int(np.ceil(r["n"] / block)) for r in sizes.collect()}
    blocks = spark.createDataFrame([(a, b) for a, b in split.items()], "list int, blocks int")
    cut = assigned.join(F.broadcast(blocks), "list").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

    def write(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        code, scalars = encode(unit(pdf["v"]), centroids()[key[0]], rotation(dim, seed))
        _save(f"{root}/{key[0]:05d}-{key[1]:05d}", code=code, scalars=scalars, id=pdf["id"].to_numpy(np.int64), x=np.stack(pdf["v"].to_numpy()))
        return pd.DataFrame({"list": [key[0]], "block": [key[1]], "n": [len(pdf)]})

    written = materialize(cut.groupBy("list", "block").applyInPandas(write, "list int, block int, n int"), "vector-blocks")
    discard(assigned)  # the index holds them now

    def search(batches):
        c, rot = centroids(), rotation(dim, seed)
        for pdf in batches:
            for lst, blk in zip(pdf["list"], pdf["block"]):
                yield _search_block(root, int(lst), int(blk), split, c, rot, dim, k, min(probes, len(c)))

    tasks = max(1, min(written.count(), 16 * spark.sparkContext.defaultParallelism))
    found = materialize(written.repartition(tasks, "list", "block").mapInPandas(search, "id long, other long, similarity double"), "vector-found")
    # expand classes: candidates of a class are its own ids and the ids of its k best classes
    own = F.explode("ids")
    first_of = heads.select(F.element_at("ids", 1).alias("head"), "class", "ids")
    near = found.join(first_of.select(F.col("head").alias("other"), "ids"), "other").select("id", own.alias("other"), "similarity")
    self_ = first_of.where(F.size("ids") > 1).select(F.col("head").alias("id"), own.alias("other"), F.lit(1.0).alias("similarity"))
    best = Window.partitionBy("id").orderBy(F.col("similarity").desc(), "other")
    top = near.unionByName(self_).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    top = top.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("r", "other", "similarity"))).alias("c"))
    top = top.join(first_of.select(F.col("head").alias("id"), "class"), "id").select("class", "c")
    salts = 16  # copies of one vector may be a third of all rows: spread them, the class's short list is repeated
    spread = top.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    all_ = members.distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).join(spread, ["class", "salt"])
    mine = all_.select("id", F.slice(F.filter("c", lambda s: s["other"] != F.col("id")), 1, k).alias("c"))
    return mine.select("id", F.posexplode("c").alias("p", "s")).select("id", F.col("s.other").alias("other"), F.col("s.similarity").alias("similarity"), (F.col("p") + 1).alias("place"))


def _search_block(root, lst, blk, split, c, rot, dim, k, probes) -> pd.DataFrame:
    _, _, ids = _codes(f"{root}/{lst:05d}-{blk:05d}")
    out = []
    for a in range(0, len(ids), 512):
        qid = ids[a : a + 512]
        exact = _unit(_vectors(f"{root}/{lst:05d}-{blk:05d}", np.arange(a, a + len(qid)), dim))
        q = exact.astype(np.float32)
        near = q @ c.T
        probed = np.argpartition(-near, probes - 1, axis=1)[:, :probes]
        asks = np.zeros((len(qid), len(c)), bool)
        asks[np.arange(len(qid))[:, None], probed] = True
        floor = np.full((len(qid), k), -2.0, np.float32)  # k best lower bounds so far
        kept = []
        order = np.argsort(-asks.sum(0), kind="stable")
        for target in order[: int((asks.any(0)).sum())]:
            rows = np.flatnonzero(asks[:, target])
            for b in range(split.get(int(target), 0)):
                uri = f"{root}/{int(target):05d}-{b:05d}"
                code, scalars, oid = _codes(uri)
                est, err = estimate(code, scalars, c[target], q[rows], rot)
                est = np.where(oid[None, :] == qid[rows][:, None], -9.0, est)
                low = est - err
                top = -np.partition(-low, min(k, low.shape[1]) - 1, axis=1)[:, :k]
                floor[rows] = -np.sort(-np.concatenate([floor[rows], top], 1), axis=1)[:, :k]
                i, j = np.nonzero(est + err >= floor[rows][:, -1:] - 1e-6)
                kept.append((rows[i], np.full(len(i), len(kept)), j, (est + err)[i, j], oid[j], uri))
        best_s, best_i, best_o = [], [], []
        for i, _, j, up, oid, uri in kept:  # rerank what the final bound still admits, block by block
            live = up >= floor[i, -1] - 1e-6
            if live.any():
                i, j, o = i[live], j[live], oid[live]
                need, at = np.unique(j, return_inverse=True)
                v = _unit(_vectors(uri, need, dim))
                for s in range(0, len(i), 16384):
                    best_s.append(np.einsum("ij,ij->i", exact[i[s : s + 16384]], v[at[s : s + 16384]]))
                best_i.append(i)
                best_o.append(o)
        if best_i:
            s, i, o = np.round(np.concatenate(best_s), 6), np.concatenate(best_i), np.concatenate(best_o)
            rank = np.lexsort((o, -s, i))
            s, i, o = s[rank], i[rank], o[rank]
            nth = np.arange(len(i)) - np.searchsorted(i, i, "left")
            keep = nth < k
            out.append(pd.DataFrame({"id": qid[i[keep]], "other": o[keep], "similarity": s[keep]}))
    return pd.concat(out) if out else pd.DataFrame({"id": pd.Series(dtype="int64"), "other": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})


def similar_pairs(top: DataFrame) -> DataFrame:
    """Each pair of which at least one is among the most similar of the other, the smaller id first."""
    return top.select(F.least("id", "other").alias("result_id_a"), F.greatest("id", "other").alias("result_id_b")).distinct()
