"""Problem 8: texts packed into containers of a fixed number of tokens, by pattern packing.

Only the histogram of lengths decides: patterns of few distinct lengths, each as often as it goes, that fill a container
are enumerated, their repeat counts are fitted to the histogram by non-negative least squares and rounded down, and what
remains is packed best-fit, longest first. The plan is a list of runs of equal containers, as long as there are lengths and patterns at most; each
item finds its container from its length and its rank among the items of that length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from phrasewerk.llm.common import written
from phrasewerk.llm.tokens import TOKENIZER, token_count

#: Tokens of a container; buckets of the fitted histogram; most distinct lengths in a pattern; items of a length that are ranked in one part, and most parts.
#: The share of the fitted counts that is taken, rounded down: the rest fills what remains open.
CAPACITY, BUCKETS, PATTERN_LENGTHS, TAKEN, PART_ROWS, MOST_PARTS = 2048, 64, 3, 0.98, 100_000, 4_096

Run = tuple[int, tuple[int, ...]]


def patterns(buckets: int, most: int) -> list[tuple[int, ...]]:
    """Every descending tuple of bucket numbers from 1 on with at most *most* different ones whose sum is *buckets*; the last of *most* comes once."""
    out: list[tuple[int, ...]] = []

    def grow(left: int, top: int, sofar: tuple[int, ...], kinds: int) -> None:
        if left == 0:
            out.append(sofar)
        elif kinds == most - 1:
            if left <= top:
                out.append((*sofar, left))
        else:
            for b in range(min(left, top), 0, -1):
                for again in range(1, left // b + 1):
                    grow(left - b * again, b - 1, (*sofar, *[b] * again), kinds + 1)

    grow(buckets, buckets, (), 0)
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 that minimises |a x - b|: the active-set method; only the columns in use are solved for."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    limit = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    barred = np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        slope = np.where(free | barred, -np.inf, a.T @ (b - a @ x))
        j = int(slope.argmax())
        if slope[j] <= limit:
            break
        free[j] = True
        while True:
            at = np.flatnonzero(free)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (z > 1e-12).all():
                x[:] = 0
                x[at] = z
                barred[:] = False
                break
            down = at[z <= 1e-12]
            zz = z[z <= 1e-12]
            step = np.min(np.where(x[down] > zz, x[down] / np.maximum(x[down] - zz, 1e-300), 0.0))
            x[at] += step * (z - x[at])
            gone = at[(x[at] <= 1e-12)]
            x[gone] = 0
            free[gone] = False
            if not free.any() or j in gone:
                break
        if not free[j]:  # it can't help before another one has come in
            barred[j] = True
    return x


def plan(counts: np.ndarray, capacity: int = CAPACITY, buckets: int = BUCKETS, most: int = PATTERN_LENGTHS, fitted_runs: list[Run] | None = None) -> list[Run]:
    """Runs (containers, their lengths) that hold counts[n] items of each length n in 1..capacity exactly once.

    *fitted_runs* takes up the runs that the fitted patterns made, before the residuals are put in.
    """
    left = counts.astype(np.int64).copy()
    left[0] = 0
    buckets = min(buckets, capacity)
    width = -(-capacity // buckets)
    half = width // 2
    bucket_of = np.minimum((np.arange(capacity + 1) + half) // width, capacity // width)  # the nearest; the shortest, of bucket 0, are left for the rest
    whole = capacity // width
    got = patterns(whole, most)
    a = np.zeros((whole, len(got)))
    for j, p in enumerate(got):
        a[:, j] = np.bincount(np.array(p) - 1, minlength=whole)
    histogram = np.bincount(bucket_of, weights=left, minlength=whole + 2)[1 : whole + 1]
    fitted = np.floor(TAKEN * nnls(a, histogram) + 1e-6).astype(np.int64)
    present = [int(n) for n in np.flatnonzero(left)]
    opened: list[Run] = []

    def largest(high: int) -> int:
        while (i := bisect_left(present, high + 1) - 1) >= 0:
            if left[present[i]]:
                return present[i]
            present.pop(i)
        return 0

    for j in sorted(np.flatnonzero(fitted), key=lambda j: got[j], reverse=True):
        again, p = int(fitted[j]), got[j]
        while again > 0:
            chosen: list[int] = []
            room = capacity
            for i, b in enumerate(p):
                n = largest(room if i == len(p) - 1 else min(room, b * width + width - half - 1))  # the last one fills what the others left
                if not n:
                    break
                chosen.append(n)
                left[n] -= 1
                room -= n
            if not chosen:
                break
            need = {n: chosen.count(n) for n in chosen}
            times = 1 + min(again - 1, *(int(left[n]) // m for n, m in need.items()))
            for n, m in need.items():
                left[n] -= m * (times - 1)
            opened.append((times, tuple(chosen)))
            again -= times
    if fitted_runs is not None:
        fitted_runs += opened
    # what remains: best fit, longest first, over classes of containers with the same room
    room_of: dict[int, list[Run]] = {}
    rooms: list[int] = []

    def put(run: Run) -> None:
        r = capacity - sum(run[1])
        if r not in room_of:
            room_of[r] = []
            insort(rooms, r)
        room_of[r].append(run)

    for run in opened:
        put(run)
    for n in range(capacity, 0, -1):
        c = int(left[n])
        while c:
            i = bisect_left(rooms, n)
            if i == len(rooms):
                each = capacity // n
                if c >= each:
                    put((c // each, (n,) * each))
                if c % each:
                    put((1, (n,) * (c % each)))
                break
            r = rooms[i]
            times, held = room_of[r].pop()
            if not room_of[r]:
                del room_of[r]
                rooms.pop(i)
            used = min(times, c)
            if times > used:
                put((times - used, held))
            put((used, (*held, n)))
            c -= used
    return [run for r in sorted(room_of) for run in room_of[r]]


class Places:
    """Container of an item from its length and its rank among the items of that length."""

    def __init__(self, runs: list[Run], capacity: int = CAPACITY):
        by: dict[int, list[tuple[int, int, int]]] = {}
        base = 0
        for times, held in runs:
            for n in set(held):
                by.setdefault(n, []).append((times * held.count(n), base, times))
            base += times
        self.containers = base
        self.by = {n: tuple(np.array(v, np.int64) for v in zip(*x)) for n, x in by.items()}
        self.starts = {n: np.concatenate([[0], np.cumsum(x[0])]) for n, x in self.by.items()}

    def of(self, n: np.ndarray, rank: np.ndarray) -> np.ndarray:
        out = np.full(len(n), -1, np.int64)
        for length in np.unique(n):
            if length in self.by:
                at = np.flatnonzero(n == length)
                i = np.searchsorted(self.starts[length], rank[at], side="right") - 1
                _, base, times = self.by[length]
                out[at] = base[i] + (rank[at] - self.starts[length][i]) % times[i]
        return out


def items_of(sizes: DataFrame, key: str, capacity: int) -> DataFrame:
    """(key, piece_no, first_token, n_tokens): an item for each text, several full ones and a rest for a text beyond the capacity."""
    last = F.greatest(F.lit(0), F.ceil(F.col("n") / F.lit(capacity)) - 1)
    items = sizes.select(key, "n", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("piece_no"))
    first = F.col("piece_no") * capacity
    return items.select(key, "piece_no", first.alias("first_token"), F.least(F.col("n") - first, F.lit(capacity)).cast("int").alias("n_tokens"))


def pack(documents: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str = TOKENIZER) -> DataFrame:
    """(key, piece_no, first_token, n_tokens, container_id): the container of every text, from 0 on.

    A text is cut only if it is larger than a container, then into full ones and a rest. Texts without tokens (null,
    empty) take no room: they come out with n_tokens 0 and container_id null. Rows repeated under one key count once
    (the longest text stays); rows of equal texts under different keys are different items.
    """
    return pack_sizes(documents.select(key, token_count(F.col(text), path).alias("n")), key, capacity)


def pack_sizes(sizes: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """As pack, for a table (key, n) of sizes; null sizes are 0."""
    spark = sizes.sparkSession
    once = sizes.groupBy(key).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"))
    items = written(items_of(once, key, capacity), "items")
    histogram = items.groupBy("n_tokens").agg(F.count("*").alias("c")).toPandas()  # at most capacity + 1 rows
    lengths, c = histogram["n_tokens"].to_numpy(np.int64), histogram["c"].to_numpy(np.int64)
    counts = np.zeros(capacity + 1, np.int64)
    counts[lengths] = c
    parts_of = np.ones(capacity + 1, np.int64)
    parts_of[lengths] = np.minimum(MOST_PARTS, -(-c // PART_ROWS))  # frequent lengths, 0 too, are ranked in parts
    n_parts = F.get(F.array(*[F.lit(int(x)) for x in parts_of]), F.col("n_tokens"))
    items = items.withColumn("part", F.pmod(F.xxhash64(key, "piece_no"), n_parts).cast("int"))
    many = items.where(F.col("n_tokens").isin([int(n) for n in np.flatnonzero((parts_of > 1) & (np.arange(capacity + 1) > 0))])) if (parts_of[1:] > 1).any() else items.limit(0)
    counted = many.groupBy("n_tokens", "part").agg(F.count("*").alias("c")).toPandas().sort_values(["n_tokens", "part"])  # at most the items' number / PART_ROWS, and capacity * MOST_PARTS rows
    offsets = {}
    for n, own in counted.groupby("n_tokens"):
        offsets[int(n)] = np.zeros(parts_of[int(n)], np.int64)
        offsets[int(n)][own["part"].to_numpy(np.int64)] = (own["c"].cumsum() - own["c"]).to_numpy(np.int64)
    sent = spark.sparkContext.broadcast((Places(plan(counts, capacity), capacity), offsets))

    @F.pandas_udf("long")
    def container(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        places, before = sent.value
        for n, part, rank in batches:
            n, part, rank = n.to_numpy(np.int64), part.to_numpy(np.int64), rank.to_numpy(np.int64) - 1
            for length in np.intersect1d(n, list(before)):
                at = n == length
                rank[at] += before[length][part[at]]
            yield pd.Series(places.of(n, rank))

    rank = F.row_number().over(Window.partitionBy("n_tokens", "part").orderBy(key, "piece_no"))
    placed = items.withColumn("rank", rank).withColumn("c", container("n_tokens", "part", "rank"))
    return placed.select(key, "piece_no", "first_token", "n_tokens", F.when(F.col("n_tokens") > 0, F.col("c")).alias("container_id"))


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(n_containers, n_tokens, unused_share) of a packing; one row, with share null for no containers."""
    used = packed.where("container_id is not null").agg((F.max("container_id") + 1).alias("n"), F.sum("n_tokens").alias("t"))
    return used.select(F.coalesce("n", F.lit(0)).alias("n_containers"), F.coalesce("t", F.lit(0)).alias("n_tokens"), (1 - F.col("t") / (F.col("n") * capacity)).alias("unused_share"))
