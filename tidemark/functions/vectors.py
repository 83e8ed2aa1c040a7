"""Vector functions as Column expressions, in double precision; a zero or null vector gives null, never NaN."""
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def block_pairs(queries: DataFrame, rows: DataFrame, least: float, size: int = 2048) -> DataFrame:
    """a (of queries), b (of rows), c: cosine of at least `least`; both have id, e (array<double>). Queries are dealt to blocks of
    about `size`, rows are cut by Arrow batch; zero vectors and other lengths are like nothing."""
    blocks = max(1, -(-queries.count() // size))

    def packed(batches):
        for pdf in batches:
            for n, part in pdf.groupby(pdf["e"].str.len()):
                yield pd.DataFrame({"n": [n], "ids": [part["id"].to_numpy()], "v": [np.stack(part["e"].to_numpy()).tobytes()]})

    def unit(v: bytes, n: int) -> np.ndarray:
        m = np.frombuffer(v).reshape(-1, n)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, norm, out=np.full_like(m, np.nan), where=norm > 0)

    def product(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                c = unit(r.qv, r.n) @ unit(r.v, r.n).T
                i, j = np.nonzero(c >= least)
                yield pd.DataFrame({"a": np.asarray(r.qids)[i], "b": np.asarray(r.ids)[j], "c": c[i, j]})

    form = "n int, ids array<long>, v binary"
    dealt = queries.where(F.size("e") > 0).repartition(blocks, "id").mapInPandas(packed, form)
    dealt = dealt.select("n", F.col("ids").alias("qids"), F.col("v").alias("qv"))
    return rows.where(F.size("e") > 0).mapInPandas(packed, form).join(dealt, "n").mapInPandas(product, "a long, b long, c double")
