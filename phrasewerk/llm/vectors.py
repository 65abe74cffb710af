"""Problem 2: the most similar vectors of every vector, by balanced posting lists.

A bounded sample fits the lists' centroids. A graph over them, held in memory, finds the centroids near a vector: it is
entered at the hubs nearest to the vector and walked from centroid to neighbouring centroid as long as that comes nearer.
A vector lies in the list of its nearest centroid and, when it is near a border, in those that are almost as near; a
search looks into the lists whose distance is within a ratio of the nearest one's. A list of very many rows is cut, in
the task that searches it, into lists of its own; beyond what a task may hold it is cut into parts, both of the rows
that lie there and of those that ask. Exact copies beyond a number are answered without search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from phrasewerk.llm.common import usable_vector

DIM = 64
#: Rows for each list; the sample's rows for each list; most lists of the first level (and so at most MOST_LISTS * SAMPLE_PER_LIST sampled rows, 66 MB).
LIST_ROWS, SAMPLE_PER_LIST, MOST_LISTS = 400, 16, 16_384
#: From so many rows on a list has lists of its own; a part of a list holds so many rows at most.
OWN_LISTS, PART_ROWS = 8_000, 100_000
#: Rows that a task of the search gets.
TASK_ROWS = 30_000
#: Numbers of parts and of cells (part that asks, part that lies) of a list.
PARTS = 1 << 20
CELLS = PARTS * PARTS
#: Copies of one vector beyond this number, and this share of all rows (so there are at most 20,000 such vectors), are answered at once.
MANY_COPIES, MANY_SHARE = 2_000, 5e-5
#: A vector lies in lists up to this ratio of its nearest centroid's distance; a thresholded search and a full one look into lists up to these.
LIE_RATIO, NEAR_RATIO, FULL_RATIO = 1.03, 1.08, 1.35
#: A full search looks into at least so many lists; the index looks into so many at most (what that costs is in the measured recall).
FULL_LISTS, MOST_LOOKED = 8, 64
#: Hubs at which the graph is entered, and neighbours of a centroid in it.
ENTRIES, BESIDE = 4, 32


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; rows of zeros stay."""
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64))
    return (vectors / np.where(norms > 0, norms, 1)[:, None]).astype(np.float32)


def _means(x: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    sums = np.stack([np.bincount(at, weights=x[:, d], minlength=k) for d in range(x.shape[1])], axis=1)
    return sums, np.bincount(at, minlength=k)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    step = max(1, 8_000_000 // max(1, len(c)))
    return np.concatenate([(x[a : a + step] @ c.T).argmax(1) for a in range(0, len(x), step)]) if len(x) else np.zeros(0, np.int64)


class ListGraph:
    """Centroids of balanced lists and the graph that finds the ones near a vector."""

    def __init__(self, sample: np.ndarray, n_lists: int, seed: int = 7, rounds: int = 6):
        x, rng = unit(sample), np.random.RandomState(seed)
        k = max(1, min(n_lists, len(x)))
        c = x[rng.choice(len(x), k, replace=False)].copy() if len(x) else np.zeros((1, DIM), np.float32)
        for r in range(rounds if len(x) else 0):
            at = _nearest(x, c)
            sums, n = _means(x, at, k)
            c = np.where((n > 0)[:, None], unit(sums), c).astype(np.float32)
            if r < rounds - 2:  # balance: the emptiest lists move to members of the fullest
                full, empty = np.argsort(-n)[: k // 8], np.argsort(n)[: k // 8]
                for i, j in zip(full, empty):
                    if n[i] > 2.5 * len(x) / k and n[j] < 0.4 * len(x) / k:
                        c[j] = x[rng.choice(np.flatnonzero(at == i))]
        self.centroids = c
        self.share = np.bincount(_nearest(x, c), minlength=k) / max(1, len(x))
        n_hubs = max(1, int(np.sqrt(k) * 2)) if k > 64 else 1
        self.hubs = c[rng.choice(k, n_hubs, replace=False)]
        near = min(k, max(64, 4 * int(np.sqrt(k))))
        links: list[np.ndarray] = []
        two = np.argsort(-(c @ self.hubs.T), axis=1)[:, :2] if n_hubs > 1 else np.zeros((k, 1), int)
        for h in range(n_hubs):
            s = c @ self.hubs[h]
            top = np.argpartition(-s, near - 1)[:near] if near < k else np.arange(k)
            links.append(np.union1d(top, np.flatnonzero((two == h).any(1))))
        self.links = links
        beside = min(k, BESIDE + 1)
        self.beside = np.empty((k, beside), np.int32)  # a table of its own: slices would keep every centroid's order of all others
        for a in range(0, k, 256):
            s = c[a : a + 256] @ c.T
            self.beside[a : a + 256] = np.argpartition(-s, beside - 1, axis=1)[:, :beside] if beside < k else np.arange(k)

    def near(self, x: np.ndarray, ratio: float, least: int = 1, most: int = MOST_LOOKED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, list, distance / nearest distance) of the *least* nearest lists and those within *ratio*, at most *most* for a row."""
        best, at = np.full(len(x), np.inf, np.float32), np.zeros(len(x), np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def visit(rows: np.ndarray, node: np.ndarray, links: list[np.ndarray] | np.ndarray) -> None:
            """Looks at the centroids linked to each row's node."""
            order = np.argsort(node, kind="stable")
            of, starts = np.unique(node[order], return_index=True)
            for h, some in zip(of, np.split(rows[order], starts[1:])):
                link = links[h]
                d = np.sqrt(np.maximum(0, 2 - 2 * (x[some] @ self.centroids[link].T)))
                m = d.argmin(1)
                dm = d[np.arange(len(some)), m]
                nearer = dm < best[some]
                best[some], at[some] = np.where(nearer, dm, best[some]), np.where(nearer, link[m], at[some])
                use = d <= (best[some] * ratio + 1e-6)[:, None]
                if least > 1:
                    k = min(least, d.shape[1])
                    np.put_along_axis(use, np.argpartition(d, k - 1, axis=1)[:, :k], True, axis=1)
                i, j = np.nonzero(use)
                found.append((some[i], link[j], d[i, j]))

        n_hubs, rows = len(self.hubs), np.arange(len(x))
        if len(x):
            s = x @ self.hubs.T
            top = np.argpartition(-s, ENTRIES - 1, axis=1)[:, :ENTRIES] if ENTRIES < n_hubs else np.tile(np.arange(n_hubs), (len(x), 1))
            for e in range(top.shape[1]):
                visit(rows, top[:, e], self.links)
        while len(rows) and len(self.centroids) > 64:  # fewer are all linked to the one hub
            before = best[rows].copy()
            visit(rows, at[rows], self.beside)
            rows = rows[best[rows] < before]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        row, lst, d = (np.concatenate(v) for v in zip(*found))
        if least == 1:
            keep = d <= best[row] * ratio + 1e-6
            row, lst, d = row[keep], lst[keep], d[keep]
        order = np.lexsort((lst, d, row))
        row, lst, d = row[order], lst[order], d[order]
        _, once = np.unique(row.astype(np.int64) * len(self.centroids) + lst, return_index=True)
        once.sort()
        row, lst, d = row[once], lst[once], d[once]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = (rank < least) | ((rank < most) & (d <= best[row] * ratio + 1e-6))
        return row[keep], lst[keep], (d / np.maximum(best[row], 1e-6))[keep]


def matrix(col: pa.Array) -> np.ndarray:
    """Rows of a list or binary column as a matrix."""
    if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type):
        width = np.int64 if pa.types.is_large_binary(col.type) else np.int32
        ends = np.frombuffer(col.buffers()[1], width)[col.offset : col.offset + len(col) + 1]
        return np.frombuffer(col.buffers()[2], np.float32, count=(ends[-1] - ends[0]) // 4, offset=int(ends[0])).reshape(len(col), -1)
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(col), -1)


def packed(x: np.ndarray) -> pa.Array:
    """A matrix as a binary column of float32 rows."""
    x = np.ascontiguousarray(x, np.float32)
    ends = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * 4)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(x.tobytes())])


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 30_000) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def scan_list(ids: np.ndarray, x: np.ndarray, base: np.ndarray, asks: np.ndarray, k: int, least: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, other id, cosine) of the k nearest base rows of each asking row, itself left out; equal cosines by id. A list of many rows is searched by lists of its own."""
    b_ids, where = np.unique(ids[base], return_index=True)
    b = x[base][where]
    q_ids, where = np.unique(ids[asks], return_index=True)
    q = x[asks][where]
    if len(b) <= OWN_LISTS:
        return _scanned(q_ids, q, b_ids, b, k, least)
    n_lists = len(b) // LIST_ROWS
    graph = ListGraph(b[:: max(1, len(b) // (n_lists * SAMPLE_PER_LIST))], n_lists, rounds=4)
    out = []
    lie, lie_list, _ = graph.near(b, LIE_RATIO)
    ask, ask_list, _ = graph.near(q, NEAR_RATIO if least is not None else FULL_RATIO, 1 if least is not None else FULL_LISTS)
    lie, ask = lie[np.argsort(lie_list, kind="stable")], ask[np.argsort(ask_list, kind="stable")]
    lie_list, ask_list = np.sort(lie_list), np.sort(ask_list)
    for n in np.intersect1d(lie_list, ask_list):
        mine, theirs = lie[slice(*np.searchsorted(lie_list, [n, n + 1]))], ask[slice(*np.searchsorted(ask_list, [n, n + 1]))]
        out.append(_scanned(q_ids[theirs], q[theirs], b_ids[mine], b[mine], k, least))
    return tuple(np.concatenate(v) for v in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _scanned(q_ids: np.ndarray, q: np.ndarray, b_ids: np.ndarray, b: np.ndarray, k: int, least: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, 4_000_000 // max(1, len(b)))
    for a in range(0, len(q), step):
        s = q[a : a + step] @ b.T
        if least is not None:
            i, j = np.nonzero(s >= least - 1e-5)
        elif len(b) > k + 1:  # the k best and itself, and all that may be equal to the last of them
            last = np.partition(s, len(b) - k - 1, axis=1)[:, len(b) - k - 1]
            i, j = np.nonzero(s >= last[:, None] - 1e-5)
        else:
            i, j = (v.ravel() for v in np.indices(s.shape))
        keep = q_ids[a + i] != b_ids[j]
        i, j = i[keep], j[keep]
        cut = 0
        while cut < len(i):  # dense neighbourhoods keep k of each row, block by block of whole rows
            end = min(len(i), cut + 500_000)
            end = len(i) if end == len(i) else int(np.searchsorted(i, i[end - 1], side="right"))
            ii, jj = i[cut:end], j[cut:end]
            cut = end
            cos = np.einsum("ij,ij->i", q[a + ii].astype(np.float64), b[jj].astype(np.float64))
            order = np.lexsort((b_ids[jj], -cos, ii))
            ii, jj, cos = ii[order], jj[order], cos[order]
            keep = np.arange(len(ii)) - np.searchsorted(ii, ii) < k
            if least is not None:
                keep &= cos >= least
            out.append((q_ids[a + ii[keep]], b_ids[jj[keep]], cos[keep]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(v) for v in zip(*out))


def fit_lists(rows: DataFrame, n: int, key: str, vector: str) -> ListGraph:
    """The lists for *n* rows, fitted on at most MOST_LISTS * SAMPLE_PER_LIST rows chosen by the hash of their key."""
    n_lists = max(1, min(MOST_LISTS, n // LIST_ROWS))
    want = n_lists * SAMPLE_PER_LIST
    parts = 1_000_000
    share = max(1, min(parts, round(parts * want / max(1, n))))
    sample = rows.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(parts)) < share).select(vector).limit(2 * want).toArrow().column(0)
    x = np.concatenate([np.zeros((0, DIM), np.float32), *(matrix(c) for c in sample.chunks if len(c))])
    del sample
    return ListGraph(x, n_lists)


def most_similar(rows: DataFrame, k: int = 5, least: float | None = None, asks: Column | None = None, key: str = "entry_id", vector: str = "phrase_vector") -> DataFrame:
    """(key, other, cosine, rank): the *k* most similar rows of each asking row among all rows, itself left out.

    *asks* marks the rows that ask (all, if None). With *least* only neighbours of at least that cosine come out, which
    lets the search look into fewer lists. Equal cosines go by the smaller key. Vectors that are null, all zero, not of
    64 values or not finite, and rows without a key, take no part; rows repeated under one key count once. Approximate:
    recall against brute force is measured in the tests and the README.
    """
    spark = rows.sparkSession
    good = rows.where(F.col(key).isNotNull() & usable_vector(F.col(vector), DIM))
    good = good.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), (F.lit(True) if asks is None else F.coalesce(asks, F.lit(False))).alias("asks"), F.xxhash64(vector).alias("h"))
    counts = good.groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))
    total, most_copies = counts.agg(F.sum("n"), F.max(F.when(F.col("low") < F.col("high"), F.col("n")))).first()
    total = total or 0
    enough = max(MANY_COPIES, int(MANY_SHARE * total))
    outcome = "id long, other long, cosine double"
    graph = spark.sparkContext.broadcast(fit_lists(good, total, "id", "v"))  # at most MOST_LISTS centroids, 4 MB, and their links
    parts = np.minimum(PARTS, np.maximum(1, np.ceil(graph.value.share * total / PART_ROWS))).astype(np.int64)

    searched, answered = good, None
    if (most_copies or 0) > enough:
        hot = F.broadcast(counts.where((F.col("n") > enough) & (F.col("low") < F.col("high"))).select("h"))  # at most 1 / MANY_SHARE
        first = Window.partitionBy("h", "v").orderBy("id")
        heads = good.join(hot, "h").select("h", "v", "id").groupBy("h", "v", "id").agg(F.lit(1).alias("one"))
        heads = heads.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
        ends = heads.groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("heads"))  # k + 1 of each
        with_heads = good.join(F.broadcast(ends), ["h", "v"], "left")  # at most 1 / MANY_SHARE vectors, 7 MB
        is_rest = F.coalesce((F.size("heads") > k) & ~F.array_contains("heads", F.col("id")), F.lit(False))
        searched = with_heads.where(~is_rest).select("id", "v", "asks", "h")
        answered = with_heads.where(is_rest & F.col("asks")).select("id", F.explode(F.slice("heads", 1, k)).alias("other"), F.lit(1.0).alias("cosine")).distinct()

    ratio = NEAR_RATIO if least is not None else FULL_RATIO

    def to_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = graph.value
        for t in _gathered(batches):
            x = unit(matrix(t["v"].chunk(0)))
            ids, ask = t["id"].to_numpy(), t["asks"].to_numpy(zero_copy_only=False).astype(bool)
            row, lst, rel = own.near(x, max(ratio, LIE_RATIO), 1 if least is not None else FULL_LISTS)
            base = rel <= LIE_RATIO + 1e-6
            wants = ask[row]
            use = base | wants
            row, lst, base, wants = row[use], lst[use], base[use], wants[use]
            n = parts[lst]
            mine = np.abs(ids[row] * 2_654_435_761 % 1_000_003) % n
            one = np.flatnonzero(n == 1)
            cells = [(lst[one] * CELLS, row[one], base[one], wants[one])]
            for flag, own_first in ((base, False), (wants, True)):  # a row of a cut list meets all parts of the other kind
                sel = np.flatnonzero((n > 1) & flag)
                at = np.repeat(sel, n[sel])
                step = np.arange(len(at)) - np.repeat(np.cumsum(n[sel]) - n[sel], n[sel])
                i, j = (mine[at], step) if own_first else (step, mine[at])
                cells.append((lst[at] * CELLS + i * PARTS + j, row[at], np.full(len(at), not own_first), np.full(len(at), own_first)))
            cell, row, base, wants = (np.concatenate(v) for v in zip(*cells))
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(ids[row]), pa.array(base), pa.array(wants), packed(x[row])], ["list", "id", "lies", "asks", "v"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            cols = [t[c].to_numpy(zero_copy_only=False) for c in ("id", "lies", "asks")]
            got = scan_list(cols[0], matrix(t["v"].chunk(0)), cols[1].astype(bool), cols[2].astype(bool), k, least)
            if len(got[0]):
                yield pa.RecordBatch.from_arrays([pa.array(g) for g in got], ["id", "other", "cosine"])

        for b in batches:
            at = b["list"].to_numpy()
            if not len(at):
                continue
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for i, j in zip(cuts, cuts[1:]):
                if held and held[-1]["list"][0].as_py() != at[i]:
                    yield from done()
                    held = []
                held.append(b.slice(i, j - i))
        if held:
            yield from done()

    lists = searched.select("id", "v", "asks").mapInArrow(to_lists, "list long, id long, lies boolean, asks boolean, v binary")
    tasks = max(1, -(-2 * total // TASK_ROWS))  # a row lies in or asks about two lists on average
    found = lists.repartition(tasks, "list").sortWithinPartitions("list").mapInArrow(scan, outcome)
    if answered is not None:
        found = found.unionByName(answered)
    best = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    once = found.groupBy("id", "other").agg(F.max("cosine").alias("cosine"))
    top = once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return top.select(F.col("id").alias(key), "other", "cosine", "rank")


def near_pairs(rows: DataFrame, least: float = 0.95, k: int = 5, key: str = "entry_id", vector: str = "phrase_vector") -> DataFrame:
    """(id_a, id_b): pairs of at least cosine *least* of which one is among the other's *k* most similar rows, the smaller key first."""
    top = most_similar(rows, k, least, None, key, vector)
    return top.select(F.least(key, "other").alias("id_a"), F.greatest(key, "other").alias("id_b")).distinct()
