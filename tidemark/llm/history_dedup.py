"""New batches against all accepted history: multi-key sorted neighbourhoods over persisted key ranges.

Every title has several sort keys: its rarest n - ceil(0.75 n) + 1 elements in one fixed order, so that two alike titles
share at least one key. Accepted titles lie in immutable runs sorted by key, one file per key range; a new batch
binary-searches the runs and compares each new record only with the window of entries that have its key and a fitting
size, reading just the blocks around its keys and those entries' elements. Within the batch the same windows are
compared. Accepted titles become a new run; `fan` runs of a level are merged into one of the next level, so a
batch sees logarithmically many runs. A day's work therefore follows the day, not the history.

The rule is sequential (by ingested_time, then id; refused rows refuse nothing), its result does not depend on
how rows are cut into batches. Small batches are taken in order by one task (at most `solo` rows a task). A larger
one is spread: history search by key range and salt, windows within the batch by key range, hot keys in
pairs of blocks, and the rule solved in rounds: rows with no undecided earlier alike row are accepted, what they are alike to
is refused, refused rows lose their say. Both ways give the same rows.

The order of elements is by document count and is renewed, with all keys, whenever the rows added have doubled, so
words that turn common later do not stay keys; each renewal reads the accepted rows once.

Defined results: null or wordless titles are accepted and refuse nothing; a null ingested_time comes last; exact
copies repeat the earliest row's partner; repeated whole rows count once; empty batches change nothing.
"""
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.elements import THRESHOLD, alike, by_rarity, class_id, elements, least_count
from tidemark.runs import Manifest, compact, full_level, read_run, run_file, search_run, write_run
from tidemark.shared import discard, get_bytes, materialize, open_fs, put_bytes, scratch

LAST = 2**63 - 1
CHUNK = 1_000_000
BLOCK = 2_000  # rows of a key that one task compares with each other
SALT_ROWS = 20_000  # new rows of a key range that one task searches in the history
RENEW = 1_000  # rows from which the order of elements may be renewed
ENTRY = np.dtype([("sig", "<u8"), ("size", "<i4"), ("batch", "<i4"), ("home", "<i4"), ("off", "<i8"), ("len", "<i4")])
EDGE = "b string, b_at long, a string, a_at long, old boolean"
PAIR = "id_a string, id_b string"


def _blob(root: str, batch: int, home: int) -> str:
    return f"{root}/rows-{batch:06d}/{home:06d}.bin"


def _record(at: int, ident: str, elems) -> bytes:
    raw = ident.encode()
    return np.array([at, len(raw), len(elems)], "<i8").tobytes() + raw + np.asarray(elems, "<i8").tobytes()


def _parse(raw: bytes) -> tuple[int, str, np.ndarray]:
    at, n, k = (int(x) for x in np.frombuffer(raw, "<i8", 3))
    return at, raw[24 : 24 + n].decode(), np.frombuffer(raw[24 + n : 24 + n + 8 * k], "<i8")


def _records(raw: bytes):
    """offset, length, at, id, elements of every record of a blob."""
    at = 0
    while at < len(raw):
        _, n, k = (int(x) for x in np.frombuffer(raw[at : at + 24], "<i8"))
        length = 24 + n + 8 * k
        yield at, length, *_parse(raw[at : at + length])
        at += length


def _signatures(lists: list) -> np.ndarray:
    """64 bits per element set, one set bit per element's residue."""
    sizes = np.array([len(x) for x in lists], np.int64)
    bits = np.uint64(1) << (np.concatenate(lists).astype(np.int64).view(np.uint64) >> np.uint64(58))
    return np.bitwise_or.reduceat(bits, np.r_[0, np.cumsum(sizes)[:-1]])


def _may_be_alike(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """False only where the sets cannot be alike: each bit of one side alone is an element that the other lacks."""
    need = np.ceil(THRESHOLD / (1 + THRESHOLD) * (n + m) - 1e-9)
    return (np.minimum(n, m) >= THRESHOLD * np.maximum(n, m)) & (np.bitwise_count(a & ~b) <= n - need) & (np.bitwise_count(b & ~a) <= m - need)


def _prefix(lists: list, table: np.ndarray) -> list[np.ndarray]:
    flat, offsets = by_rarity(lists, table)
    out = []
    for i in range(len(lists)):
        n = int(offsets[i + 1] - offsets[i])
        out.append(flat[offsets[i] : offsets[i] + n - int(np.ceil(THRESHOLD * n)) + 1])
    return out


def _order(root: str, name: str) -> np.ndarray:
    return np.frombuffer(get_bytes(f"{root}/{name}") or b"", np.int64).reshape(2, -1)


def _counted(lists: list, n: int) -> np.ndarray:
    """(hash, count) of the common elements of some lists, ordered by hash."""
    values, counts = np.unique(np.concatenate(lists).astype(np.int64), return_counts=True)
    keep = counts >= least_count(n)
    return np.array([values[keep], counts[keep]])


def _history(root: str, runs: list, part: int, keys: np.ndarray, size: np.ndarray, sig: np.ndarray) -> dict:
    """{(batch, home): {(off, len): rows}} of the stored entries that may be alike to new rows; keys (sorted), size and sig
    are per (row, key), rows are their positions."""
    old: dict = {}
    wanted, first_of, count = np.unique(keys, return_index=True, return_counts=True)
    for run in runs:
        w, entries = search_run(run_file(root, run, part), ENTRY, wanted)
        total = np.cumsum(count[w])
        cuts = np.unique(np.r_[0, np.searchsorted(total, np.arange(CHUNK, total[-1], CHUNK), "left") + 1, len(w)]) if len(w) else [0]
        for lo, hi in zip(cuts[:-1], cuts[1:]):  # every record of a key against every entry of it, a bounded number at once
            n = count[w[lo:hi]]
            e = np.repeat(np.arange(lo, hi), n)
            i = np.arange(len(e)) - np.repeat(np.cumsum(n) - n, n) + first_of[w][e]
            near = _may_be_alike(sig[i], size[i], entries["sig"][e], entries["size"][e].astype(np.int64))
            for i, x in zip(i[near], entries[e[near]]):
                old.setdefault((int(x["batch"]), int(x["home"])), {}).setdefault((int(x["off"]), int(x["len"])), set()).add(int(i))
    return old


def _stored(root: str, old: dict):
    """at, id, elements and the rows that ask, of every stored record in `old`."""
    for (batch, home), places in old.items():
        fs, path = open_fs(_blob(root, batch, home))
        with fs.open_input_file(path) as f:
            for (off, length), who in sorted(places.items()):
                yield *_parse(f.read_at(length, off)), who


def _entries(batch: int, home: int, sizes, sigs, offs, lens) -> np.ndarray:
    out = np.zeros(len(sizes), ENTRY)
    out["batch"], out["home"], out["sig"], out["size"], out["off"], out["len"] = batch, home, sigs, sizes, offs, lens
    return out


class NeighbourhoodIndex:
    """Manifest: runs as [name, level, rows], batches, rows added, the name of the order and the rows at its making."""

    def __init__(self, spark: SparkSession, root: str, ranges: int = 16, fan: int = 4, solo: int = 5_000):
        self.spark, self.root, self.ranges, self.fan, self.solo = spark, root, ranges, fan, solo
        self.manifest = Manifest(root)

    def add(self, rows: DataFrame, n: int) -> None:
        """One batch. rows: id, at (microseconds), elems, cid; n: how many."""
        self.add_all(rows.withColumn("batch", F.lit(0)), [(0, n)])

    def add_all(self, rows: DataFrame, batches: list[tuple[int, int]]) -> None:
        """Consecutive batches, each against all before it. rows has a column batch; batches names them in order, with their
        counts. Small ones that together have at most `solo` rows share a task, in which each is still searched, decided and
        written on its own."""
        todo = list(batches)
        while todo:
            take, n = 1, todo[0][1]
            while take < len(todo) and n + todo[take][1] <= self.solo:
                n += todo[take][1]
                take += 1
            now, todo = todo[:take], todo[take:]
            state = {"rows": 0, "order": None, "ordered": 0} | self.manifest.load()
            some = rows.where((F.size("elems") > 0) & F.col("batch").isin([k for k, _ in now]))
            batch = state["batches"]
            live = (self._alone if n <= self.solo else self._spread)(some, now, state)
            state |= {"batches": batch + len(now), "rows": state["rows"] + n, "order": state["order"] or f"order-{batch:06d}.bin", "ordered": state["ordered"] or now[0][1]}
            if state["rows"] >= 2 * max(state["ordered"], RENEW):
                live = [self._renew(state)]
            while full := full_level(live, self.fan):
                level = full[0][1] + 1
                name = compact(self.spark, self.root, [r[0] for r in full], self.ranges, ENTRY, f"merged-{batch:06d}-{level}")
                live = [*[r for r in live if r not in full], [name, level, sum(r[2] for r in full)]]
            self.manifest.save(state | {"runs": live})

    def _keep(self, refused: DataFrame, batch: int) -> None:
        refused.write.mode("overwrite").parquet(f"{self.root}/refused/first={batch}")

    def refused(self) -> DataFrame:
        """Refused rows of all batches as id_a (accepted), id_b (refused)."""
        if not self.manifest.load()["batches"]:
            return self.spark.createDataFrame([], PAIR)
        return self.spark.read.schema(PAIR).parquet(f"{self.root}/refused").select("id_a", "id_b")

    # -- small batches: one task, in order -------------------------------------------------------------------------

    def _steps(self, days: list[tuple[int, int]], state: dict) -> tuple[list, list]:
        """What each day reads, merges and writes, and the runs that live afterwards; follows from the counts alone."""
        steps, live = [], list(state["runs"])
        for i, (key, n) in enumerate(days):
            low = [r for r in live if r[1] == 0]
            merge = low if len(low) + 1 >= self.fan and n + sum(r[2] for r in low) <= self.fan * self.solo else []
            run = [f"run-{state['batches'] + i:06d}", 1 if merge else 0, n + sum(r[2] for r in merge)]
            steps.append((key, state["batches"] + i, [r[0] for r in live], run[0], [r[0] for r in merge]))
            live = [*[r for r in live if r not in merge], run]
        return steps, live

    def _alone(self, rows: DataFrame, days: list[tuple[int, int]], state: dict) -> list:
        root, ranges, decide = self.root, self.ranges, self._decide
        steps, live = self._steps(days, state)
        order = state["order"] or f"order-{state['batches']:06d}.bin"
        unordered = not state["order"]

        def one(pdf: pd.DataFrame, batch: int, runs: list, name: str, merge: list, first_order: bool) -> list:
            out, flat, made = [], np.zeros(0, np.int64), np.zeros(0, ENTRY)
            if len(pdf):
                pdf = pdf.sort_values(["at", "id"]).reset_index(drop=True)
                heads = pdf.drop_duplicates("cid").reset_index(drop=True)
                lists = [np.asarray(x, np.int64) for x in heads["elems"]]
                if first_order:
                    put_bytes(f"{root}/{order}", _counted(lists, len(lists)).tobytes())
                keys = _prefix(lists, _order(root, order))
                partner = decide(root, runs, ranges, heads, lists, keys)
                first = dict(zip(heads["cid"], zip(heads["id"], partner)))
                for ident, cid in zip(pdf["id"], pdf["cid"]):
                    head, by = first[cid]
                    if by is not None or ident != head:
                        out.append((by or head, ident))
                kept = [i for i, by in enumerate(partner) if by is None]
                if kept:
                    records = [_record(heads["at"][i], heads["id"][i], lists[i]) for i in kept]
                    put_bytes(_blob(root, batch, 0), *records)
                    lengths = np.array([len(r) for r in records], np.int64)
                    flat = np.concatenate([keys[i] for i in kept])
                    made = _entries(batch, 0, [len(lists[i]) for i in kept], _signatures([lists[i] for i in kept]), np.cumsum(lengths) - lengths, lengths)
                    made = np.repeat(made, [len(keys[i]) for i in kept])
            part = np.mod(flat, ranges)
            for r in range(ranges):
                pieces = [read_run(run_file(root, m, r), ENTRY) for m in merge]
                k = np.concatenate([flat[part == r].view(np.uint64), *[p[0] for p in pieces]])
                if len(k):
                    write_run(run_file(root, name, r), k, np.concatenate([made[part == r], *[p[1] for p in pieces]]))
            return out

        def run(batches):
            pdf = pd.concat([pd.DataFrame(columns=["id", "at", "elems", "cid", "batch"]), *(b for b in batches if len(b))])
            first = unordered
            for key, batch, runs, name, merge in steps:
                day = pdf[pdf["batch"] == key]
                yield pd.DataFrame(one(day, batch, runs, name, merge, first), columns=["id_a", "id_b"])
                first = first and not len(day)

        self._keep(rows.select("id", "at", "elems", "cid", "batch").coalesce(1).mapInPandas(run, PAIR), state["batches"])
        return live

    @staticmethod
    def _decide(root: str, runs: list, ranges: int, heads: pd.DataFrame, lists: list, keys: list) -> list:
        """The first accepted alike row of every head (in order), None where it is accepted."""
        ids, ats = heads["id"].to_numpy(object), heads["at"].to_numpy(np.int64)
        sizes, sigs = np.array([len(x) for x in lists], np.int64), _signatures(lists)
        owner, flat = np.repeat(np.arange(len(keys)), [len(k) for k in keys]), np.concatenate(keys)
        sets = [frozenset(x.tolist()) for x in lists]
        best: list = [None] * len(lists)  # (at, id) of the first accepted alike row
        for part in range(ranges):
            here = np.flatnonzero(np.mod(flat, ranges) == part)
            here = here[np.argsort(flat[here].view(np.uint64), kind="stable")]
            rows = owner[here]
            for at, ident, elems, who in _stored(root, _history(root, runs, part, flat[here].view(np.uint64), sizes[rows], sigs[rows])):
                have = frozenset(elems.tolist())
                for i in {int(rows[x]) for x in who}:
                    if (best[i] is None or (at, ident) < best[i]) and alike(sets[i], have):
                        best[i] = (at, ident)
        window: dict = {}  # key -> accepted heads of this batch that have it
        for i in range(len(lists)):
            if best[i] is None or best[i] > (ats[0], ids[0]):
                near = np.unique(np.fromiter((j for k in keys[i].tolist() for j in window.get(k, ())), np.int64))
                near = near[_may_be_alike(sigs[i], sizes[i], sigs[near], sizes[near])] if len(near) else near
                for j in near:  # in order of (at, id)
                    if alike(sets[i], sets[j]):
                        mine = (int(ats[j]), ids[j])
                        best[i] = mine if best[i] is None else min(best[i], mine)
                        break
            if best[i] is None:
                for k in keys[i].tolist():
                    window.setdefault(k, []).append(i)
        return [None if b is None else b[1] for b in best]

    # -- a large batch: spread over the cluster --------------------------------------------------------------------

    def _spread(self, rows: DataFrame, days: list[tuple[int, int]], state: dict) -> list:
        n = days[0][1]
        root, ranges, batch, runs = self.root, self.ranges, state["batches"], [r[0] for r in state["runs"]]
        first = F.struct("at", "id")
        heads = rows.groupBy("cid").agg(F.min(first).alias("h"), F.first("elems").alias("elems")).select("cid", F.col("h.id").alias("id"), F.col("h.at").alias("at"), "elems")
        heads = materialize(heads, "heads")
        order = state["order"] or f"order-{batch:06d}.bin"
        if not state["order"]:
            put_bytes(f"{root}/{order}", self._common(heads, n).tobytes())
        keys = materialize(heads.select("id", "at", "elems").mapInPandas(_keyed(root, order), "id string, at long, elems array<long>, keys array<long>, sig long"), "keyed")
        spread = keys.select("id", "at", "elems", "sig", F.explode("keys").alias("key")).withColumn("range", F.pmod(F.col("key"), F.lit(ranges)).cast("int"))
        salts = max(1, -(-n * 8 // (ranges * SALT_ROWS)))

        def against(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.iloc[np.argsort(pdf["key"].to_numpy(np.int64).view(np.uint64), kind="stable")]
            ids, ats, lists = pdf["id"].to_numpy(object), pdf["at"].to_numpy(np.int64), pdf["elems"].to_numpy(object)
            sizes, sigs = pdf["elems"].str.len().to_numpy(np.int64), pdf["sig"].to_numpy(np.int64).view(np.uint64)
            out = []
            for a_at, a, elems, who in _stored(root, _history(root, runs, int(key[0]), pdf["key"].to_numpy(np.int64).view(np.uint64), sizes, sigs)):
                have = frozenset(elems.tolist())
                out += [(ids[i], ats[i], a, a_at, True) for i in {ids[i]: i for i in who}.values() if alike(frozenset(lists[i].tolist()), have)]
            return pd.DataFrame(out, columns=["b", "b_at", "a", "a_at", "old"])

        def within(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            sizes, k = pdf["elems"].str.len().to_numpy(np.int64), pdf["key"].to_numpy(np.int64)
            at = np.lexsort((sizes, k))
            pdf, sizes, k = pdf.iloc[at], sizes[at], k[at]
            ids, ats, lists = pdf["id"].to_numpy(object), pdf["at"].to_numpy(np.int64), pdf["elems"].to_numpy(object)
            sigs, block = pdf["sig"].to_numpy(np.int64).view(np.uint64), pdf["block"].to_numpy(np.int64)
            split = key[1] != key[2]
            out, seen = [], set()
            ends = np.searchsorted(k, k, "right")
            for i in np.flatnonzero(ends > np.arange(len(k)) + 1):  # window: equal key, size up to n / threshold
                stop = i + 1 + np.searchsorted(sizes[i + 1 : ends[i]], sizes[i] / THRESHOLD, "right")
                near = _may_be_alike(sigs[i], sizes[i], sigs[i + 1 : stop], sizes[i + 1 : stop])
                mine = None
                for j in i + 1 + np.flatnonzero(near & (block[i + 1 : stop] != block[i]) if split else near):
                    if ids[i] == ids[j] or (ids[i], ids[j]) in seen:
                        continue
                    seen.add((ids[i], ids[j]))
                    mine = mine or frozenset(lists[i].tolist())
                    if alike(mine, frozenset(lists[j].tolist())):
                        (aa, a), (ba, b) = sorted(((ats[i], ids[i]), (ats[j], ids[j])))
                        out.append((b, ba, a, aa, False))
            return pd.DataFrame(out, columns=["b", "b_at", "a", "a_at", "old"])

        # keys of more than BLOCK rows are cut into blocks, and each pair of blocks is a task of its own
        hot = spread.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > BLOCK).select("key", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
        cut = spread.join(hot, "key", "left").withColumn("block", F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))).cast("int"))
        cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
        group = F.when(F.col("blocks").isNull(), F.col("range").cast("long")).otherwise(F.col("key"))
        meet = cut.select(group.alias("g"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.col("blocks").isNull().alias("cool"), "id", "at", "elems", "sig", "key", "block")
        new = meet.groupBy("g", "i", "j", "cool").applyInPandas(within, EDGE)
        if runs:
            asked = spread.withColumn("salt", F.pmod(F.xxhash64("id", "key"), F.lit(salts)).cast("int"))
            new = new.unionByName(asked.groupBy("range", "salt").applyInPandas(against, EDGE))
        edges = materialize(new.distinct(), "alike")
        refused = materialize(edges.where("old").select(F.col("b").alias("id")).distinct(), "refused-ids")
        live, gone, made = edges.where(~F.col("old")).select("a", "b"), refused, [refused]
        while True:
            live = materialize(live.join(gone.withColumnRenamed("id", "b"), "b", "left_anti").join(gone.withColumnRenamed("id", "a"), "a", "left_anti"), "live")
            made.append(live)
            if live.isEmpty():
                break
            roots = live.select("a").distinct().join(live.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
            gone = materialize(live.join(roots, "a", "left_semi").select(F.col("b").alias("id")).distinct(), "gone")
            made.append(gone)
            refused = refused.unionByName(gone)
        partner = edges.join(refused.withColumnRenamed("id", "a"), "a", "left_anti").groupBy("b").agg(F.min(F.struct("a_at", "a"))["a"].alias("partner")).withColumnRenamed("b", "id")
        decided = materialize(heads.select("cid", "id").join(partner, "id", "left"), "decided")
        per_class = decided.select("cid", F.col("id").alias("head"), "partner")
        self._keep(rows.select("id", "cid").distinct().join(per_class, "cid").select(F.coalesce("partner", "head").alias("id_a"), F.col("id").alias("id_b")).where(F.col("id_a") != F.col("id_b")), batch)
        accepted = keys.join(decided.where("partner is null").select("id"), "id", "left_semi").withColumn("home", F.pmod(F.xxhash64("id"), F.lit(ranges)).cast("int"))

        def store(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["at", "id"])
            records = [_record(a, i, e) for a, i, e in zip(pdf["at"], pdf["id"], pdf["elems"])]
            put_bytes(_blob(root, batch, int(key[0])), *records)
            lengths = np.array([len(r) for r in records], np.int64)
            return pd.DataFrame({"keys": pdf["keys"], "sig": pdf["sig"], "size": pdf["elems"].str.len(), "batch": batch, "home": key[0], "off": np.cumsum(lengths) - lengths, "len": lengths})

        stored = materialize(accepted.groupBy("home").applyInPandas(store, PLACED), "stored")
        name = f"run-{batch:06d}"
        self._write(stored, name)
        for df in (*made, heads, keys, edges, decided, stored):
            discard(df)
        return [*state["runs"], [name, 0, n]]

    def _common(self, rows: DataFrame, n: int) -> np.ndarray:
        counts = rows.select(F.explode("elems").alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least_count(n)).toPandas()
        out = np.array([counts["e"].to_numpy(np.int64), counts["c"].to_numpy(np.int64)])
        return out[:, np.argsort(out[0])]

    def _write(self, placed: DataFrame, name: str) -> None:
        """A run from placed rows, one file per key range."""
        root, ranges = self.root, self.ranges

        def index(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            entry = _entries(0, 0, pdf["size"].to_numpy(), pdf["sig"].to_numpy(np.int64).view(np.uint64), pdf["off"].to_numpy(), pdf["len"].to_numpy())
            entry["batch"], entry["home"] = pdf["batch"].to_numpy(), pdf["home"].to_numpy()
            write_run(run_file(root, name, int(key[0])), pdf["key"].to_numpy(np.int64).view(np.uint64), entry)
            return pd.DataFrame({"n": [len(pdf)]})

        entries = placed.select(F.explode("keys").alias("key"), "sig", "size", "batch", "home", "off", "len").withColumn("range", F.pmod(F.col("key"), F.lit(ranges)).cast("int"))
        entries.groupBy("range").applyInPandas(index, "n long").write.format("noop").mode("overwrite").save()

    def _renew(self, state: dict) -> list:
        """Order and keys of all accepted rows anew; returns the one run that holds them."""
        root, ranges, batch = self.root, self.ranges, state["batches"]

        def read(batches):
            for pdf in batches:
                for i in pdf["id"]:
                    raw = get_bytes(_blob(root, int(i) // ranges, int(i) % ranges))
                    got = list(_records(raw)) if raw else []
                    if got:
                        offs, lens, _, _, lists = zip(*got)
                        yield pd.DataFrame({"elems": lists, "sig": _signatures(list(lists)).view(np.int64), "size": [len(x) for x in lists], "batch": int(i) // ranges, "home": int(i) % ranges, "off": offs, "len": lens})

        tasks = min(batch * ranges, 2 * self.spark.sparkContext.defaultParallelism)
        rows = materialize(self.spark.range(0, batch * ranges, 1, tasks).mapInPandas(read, PLACED.replace("keys", "elems")), "accepted")
        name, order = f"renewed-{batch:06d}", f"order-{batch:06d}-renewed.bin"
        put_bytes(f"{root}/{order}", self._common(rows, state["rows"]).tobytes())

        def keyed(batches):
            table = _order(root, order)
            for pdf in batches:
                if len(pdf):
                    yield pdf.assign(keys=_prefix(list(pdf["elems"]), table))[["keys", "sig", "size", "batch", "home", "off", "len"]]

        self._write(rows.mapInPandas(keyed, PLACED), name)
        discard(rows)
        state |= {"order": order, "ordered": state["rows"]}
        return [name, int(np.log(max(1, batch)) / np.log(self.fan)) + 1, state["rows"]]


PLACED = "keys array<long>, sig long, size int, batch int, home int, off long, len int"


def _keyed(root: str, order: str):
    def keyed(batches):
        table = _order(root, order)
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"id": pdf["id"], "at": pdf["at"], "elems": pdf["elems"], "keys": _prefix(list(pdf["elems"]), table), "sig": _signatures(list(pdf["elems"])).view(np.int64)})

    return keyed


def refused_titles(df: DataFrame, ident: str = "id", title: str = "title", at: str = "ingested_time", batch_days: int = 1, solo: int = 5_000) -> DataFrame:
    """Replays a whole table in batches of ingestion days; id_a accepted row, id_b refused row, each refused row once."""
    spark = df.sparkSession
    rows = df.where(F.col(ident).isNotNull()).select(F.col(ident).alias("id"), F.coalesce(F.unix_micros(F.col(at)), F.lit(LAST)).alias("at"), elements(F.col(title)).alias("elems"))
    rows = rows.withColumn("cid", class_id(F.col("elems"))).dropDuplicates(["id"])
    day = F.floor(F.col("at") / 86_400_000_000)
    rows = materialize(rows.withColumn("batch", F.floor(day / batch_days)).hint("rebalance", "batch"), "history", ["batch"])
    found = rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).orderBy("batch").collect()  # one row per batch
    total, most = sum(r["n"] for r in found), max([r["n"] for r in found], default=0)
    index = NeighbourhoodIndex(spark, scratch(spark, "neighbourhood"), max(1, -(-most // 5_000), -(-total // 100_000)), solo=solo)
    index.add_all(rows, [(r["batch"], r["n"]) for r in found])
    discard(rows)
    return index.refused()


def refused_pairs(df: DataFrame, batch_days: int = 1, solo: int = 5_000) -> DataFrame:
    """Pairs with the smaller id first."""
    r = refused_titles(df, batch_days=batch_days, solo=solo)
    return r.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
