"""A total order of hashed elements by rarity, the same for every set.

First come all elements that are not common (by hash), then the common ones by document count. The table of common elements
(in at least 1 of `SHARE` sets, and in 3) can hold at most SHARE x (mean elements per set) rows, whatever the collection's size,
so it may go to the driver and tasks.
"""
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 50_000


def least_count(n: int, share: int = SHARE) -> int:
    """Document count from which an element of n sets is common."""
    return max(3, -(-n // share))


def common_elements(classes: DataFrame, share: int = SHARE) -> np.ndarray:
    """(hash, count) of common elements, ordered by hash."""
    least = least_count(classes.count(), share)
    rows = (classes.select(F.explode("elems").alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least)).toPandas()
    out = np.array([rows["e"].to_numpy(np.int64), rows["c"].to_numpy(np.int64)])
    return out[:, np.argsort(out[0])]


def rarity(flat: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Document count of common elements, 0 of all others."""
    if not common.shape[1]:
        return np.zeros(len(flat), np.int64)
    at = np.minimum(np.searchsorted(common[0], flat), common.shape[1] - 1)
    return np.where(common[0][at] == flat, common[1][at], 0)


def by_rarity(lists: list[np.ndarray], common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All lists' elements, each list's rarest first, and the offsets of the lists."""
    sizes = np.array([len(x) for x in lists], np.int64)
    offsets = np.r_[0, np.cumsum(sizes)]
    flat = np.concatenate(lists).astype(np.int64) if len(lists) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(lists)), sizes)
    return flat[np.lexsort((flat, rarity(flat, common), owner))], offsets
