"""Immutable sorted runs on shared storage: sorted 64-bit keys with fixed-width payloads, one file per key range.

File: row count, fence keys (every FENCE-th key), keys, payload rows. A lookup reads the fences, then only
the blocks around the wanted keys, so its cost follows the batch and not the history behind it.
"""
import numpy as np
from pyarrow import fs as pafs

from tidemark.shared import get_json, open_fs, put_bytes, put_json

FENCE = 512


def run_file(root: str, run: str, part: int) -> str:
    return f"{root}/{run}/{part:06d}.run"


def write_run(uri: str, keys: np.ndarray, payload: np.ndarray) -> None:
    """keys: uint64, any order; payload: structured array of equal length."""
    order = np.argsort(keys, kind="stable")
    keys, payload = np.ascontiguousarray(keys[order], "<u8"), np.ascontiguousarray(payload[order])
    put_bytes(uri, np.array([len(keys)], "<i8").tobytes(), keys[::FENCE].tobytes(), keys.tobytes(), payload.tobytes())


def read_run(uri: str, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    fs, path = open_fs(uri)
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return np.zeros(0, "<u8"), np.zeros(0, dtype)
    with fs.open_input_file(path) as f:
        raw = f.read()
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    at = 8 + 8 * ((n + FENCE - 1) // FENCE)
    return np.frombuffer(raw, "<u8", n, at), np.frombuffer(raw, dtype, n, at + 8 * n)


def search_run(uri: str, dtype: np.dtype, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary search of sorted wanted keys: (index into wanted, payload) for each equal key in the run."""
    none = np.zeros(0, np.int64), np.zeros(0, dtype)
    fs, path = open_fs(uri)
    if not len(wanted) or fs.get_file_info(path).type == pafs.FileType.NotFound:
        return none
    index, found = [], []
    with fs.open_input_file(path) as f:
        n = int(np.frombuffer(f.read_at(8, 0), "<i8")[0])
        if not n:
            return none
        blocks = (n + FENCE - 1) // FENCE
        fences = np.frombuffer(f.read_at(8 * blocks, 8), "<u8")
        keys_at = 8 + 8 * blocks
        data_at = keys_at + 8 * n
        lo = np.maximum(np.searchsorted(fences, wanted, "left") - 1, 0)
        hi = np.maximum(np.searchsorted(fences, wanted, "right") - 1, 0)
        first = 0
        while first < len(wanted):  # one read per stretch of neighbouring blocks
            last, end = first, hi[first]
            while last + 1 < len(wanted) and lo[last + 1] <= end + 1:
                last += 1
                end = max(end, hi[last])
            start, stop = int(lo[first]) * FENCE, min(n, (int(end) + 1) * FENCE)
            keys = np.frombuffer(f.read_at(8 * (stop - start), keys_at + 8 * start), "<u8")
            w = wanted[first : last + 1]
            left, right = np.searchsorted(keys, w, "left"), np.searchsorted(keys, w, "right")
            count = right - left
            if count.sum():
                a, b = int(left[count > 0].min()), int(right[count > 0].max())
                rows = np.frombuffer(f.read_at(dtype.itemsize * (b - a), data_at + dtype.itemsize * (start + a)), dtype)
                at = np.repeat(left - a, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                index.append(np.repeat(np.arange(first, last + 1), count))
                found.append(rows[at])
            first = last + 1
    return (np.concatenate(index), np.concatenate(found)) if index else none


class Manifest:
    """The live runs of an index; replaced as a whole after each finished batch or merge."""

    def __init__(self, root: str):
        self.root, self.uri = root, f"{root}/manifest.json"

    def load(self) -> dict:
        return get_json(self.uri) or {"runs": [], "batches": 0}

    def save(self, state: dict) -> None:
        put_json(self.uri, state)


def full_level(runs: list, fan: int) -> list:
    """Runs are [name, level]: those of the lowest level that holds `fan` or more, else none. Merging them into one run of the
    next level keeps the number of live runs logarithmic and rewrites every entry a logarithmic number of times."""
    for level in sorted({r[1] for r in runs}):
        same = [r for r in runs if r[1] == level]
        if len(same) >= fan:
            return same
    return []


def compact(spark, root: str, runs: list[str], parts: int, dtype: np.dtype, name: str) -> str:
    """Merge runs into one, range by range, in parallel; the old files stay until the manifest changes."""

    def merge(batches):
        for batch in batches:
            for part in batch["part"]:
                pieces = [read_run(run_file(root, r, part), dtype) for r in runs]
                keys = np.concatenate([k for k, _ in pieces])
                if len(keys):
                    write_run(run_file(root, name, part), keys, np.concatenate([p for _, p in pieces]))
            yield batch[["part"]]

    tasks = max(1, min(parts, 2 * spark.sparkContext.defaultParallelism))
    spark.range(0, parts, 1, tasks).withColumnRenamed("id", "part").mapInPandas(merge, "part long").write.format("noop").mode("overwrite").save()
    return name
