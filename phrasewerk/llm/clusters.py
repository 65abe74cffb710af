"""Problem 6: groups of similar vectors within each process, by parallel pivot clustering.

Rounds: in order of a hash, a vector without a similar one before it is a pivot and absorbs its similar neighbours. The
first round takes every row, each process in parts of bounded size; what comes out, pivots with the direction and number
of what they absorbed, goes into the next round in fewer parts. When a round no longer makes it much less (single rows
that belong to no group stay what they are), the neighbours across parts are found block by block as edges, and the
local minima are decided on the edges. So the rounds depend on the logarithm of the sizes, not on the rows without a
group. Then members are reassigned to the closest pivot and medoids and directions are taken anew, a few times.

Groups that show within one part come first. The rows that reach none of them go through the rounds among themselves,
down to pairs of rows: pairs that come about by chance grow as the square of such rows, so they must not meet all rows.
What is a group there joins the others, all members are reassigned, and rows that reach no group go through the rounds
again until no new group appears. Groups never come to the driver.

A part's vectors are one value, of length one, so a pass over them moves no single rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from phrasewerk.llm.common import usable_vector, written
from phrasewerk.llm.vectors import DIM, matrix, packed, unit
from phrasewerk.sources.store import scratch_dir

#: Rows of a part, directions that meet a part in one value, probes of a block of pairs.
PART, DIRECTIONS, PROBES = 16_384, 65_536, 2_000
#: Groups whose directions have at least this cosine are one.
SAME = 0.65
#: From so many rows on, a pivot stands for a direction; before, for its rows.
FEW = 4
#: Defaults for processes without a setting.
DISTANCE, MIN_SIZE = 0.7, 4
#: Times the members are reassigned and directions taken anew.
REFINED = 3
#: A round that leaves more than this share of its pivots is the last one in parts.
SHRINKS = 0.8
#: Processes and groups up to this number are broadcast with their settings or sizes.
FEW_ROWS = 100_000
#: Rows and pivots whose cosines are taken at once; parts whose rows meet those of others in one task; tasks in which a process's sums are added up.
ROWS_AT, PIVOTS_AT, MEETING, CELLS = 512, 2_048, 4, 16

_STATE = "process_name string, distance double, id long, n long, v binary"
_PARTS = "process_name string, part int, distance double, ids binary, v binary, phrases array<string>"


def settings(config: DataFrame) -> DataFrame:
    """(process_name, distance, min_size): one row for each process; nulls take the defaults, of repeated rows the smallest."""
    rows = config.where("process_name is not null").groupBy("process_name").agg(F.min("config.graph.distance").alias("d"), F.min("config.graph.min_size").alias("m"))
    return rows.select("process_name", F.coalesce(F.col("d"), F.lit(DISTANCE)).cast("double").alias("distance"), F.coalesce(F.col("m"), F.lit(MIN_SIZE)).cast("long").alias("min_size"))


def _hinted(small: DataFrame, n: int | None = None) -> DataFrame:
    """A table that is broadcast in joins only if it has few rows; *n* is their number where it is known."""
    n = small.limit(FEW_ROWS + 1).count() if n is None else n
    return F.broadcast(small) if n <= FEW_ROWS else small


def _in_parts(rows: DataFrame, each: DataFrame) -> tuple[DataFrame, DataFrame, str | None]:
    """(process_name, part, distance, ids, v, phrases): one row for each part, bucketed by process and part; all (process_name, part); and the table's name.

    *rows* (process_name, distance, entry_id, phrase, v) come with the number of their process's parts in *each*. Of rows
    repeated under one entry_id the least (phrase, vector) stays. The table lies in the shared folder in buckets, so that
    passes over it need no shuffle. Where the session's catalog takes no tables it is a plain one, without a name, and
    passes shuffle it.
    """
    spark = rows.sparkSession
    buckets = max(1, each.agg(F.sum("parts")).first()[0] or 1)

    def once(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids = t["entry_id"].to_numpy()
        if len(np.unique(ids)) < len(ids):
            x = matrix(t["v"].chunk(0))
            phrases = t["phrase"].to_pylist()
            order = sorted(range(len(ids)), key=lambda i: (ids[i], phrases[i] is None, phrases[i] or "", x[i].tobytes()))
            t = t.take(pa.array([i for k, i in enumerate(order) if not k or ids[i] != ids[order[k - 1]]])).combine_chunks()
            ids = t["entry_id"].to_numpy()
        phrases = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), t["phrase"].chunk(0))
        one = {k: t[k].slice(0, 1) for k in ("process_name", "part", "distance")}
        return pa.table(one | {"ids": pa.array([ids.tobytes()], pa.binary()), "v": pa.array([unit(matrix(t["v"].chunk(0))).tobytes()], pa.binary()), "phrases": phrases})

    cells = rows.withColumn("part", F.pmod(F.xxhash64("entry_id"), F.col("parts")).cast("int")).select("process_name", "part", "distance", "entry_id", "phrase", "v")
    made = cells.repartition(buckets, "process_name", "part").groupBy("process_name", "part").applyInArrow(once, _PARTS)
    name = f"vectors_{uuid.uuid4().hex}"
    every = written(each.select("process_name", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), "parts")
    try:
        spark.catalog.tableExists(name)
    except Exception:  # noqa: BLE001 - a catalog that can't be set up
        return written(made, "vectors"), every, None
    made.write.bucketBy(buckets, "process_name", "part").option("path", f"{scratch_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name), every, name


def _drop(spark: SparkSession, name: str | None) -> None:
    if name:
        spark.sql(f"DROP TABLE {name}")  # its files go with the scratch folder


def usable_rows(entries: DataFrame, config: DataFrame, phrase: str = "phrase", vector: str = "phrase_vector") -> tuple[DataFrame, DataFrame, str | None]:
    """The entries with a usable vector, each once, as _in_parts gives them; of rows repeated under one entry_id the least (process, phrase, vector) stays."""
    good = entries.where(F.col("entry_id").isNotNull() & F.col("process_name").isNotNull() & usable_vector(F.col(vector), DIM))
    good = good.select(F.col("entry_id").cast("long").alias("entry_id"), "process_name", F.col(phrase).alias("phrase"), F.col(vector).cast("array<float>").alias("v"))
    sizes = good.groupBy("process_name").agg(F.ceil(F.count("*") / F.lit(PART)).cast("int").alias("parts"))
    each = written(sizes.join(settings(config), "process_name", "left").select("process_name", "parts", F.coalesce("distance", F.lit(DISTANCE)).alias("distance")), "processes")
    rows = good.join(_hinted(each), "process_name")
    # the second delivery of an entry has its process and so its part; should one come with another process, the least stays
    moved = good.select("entry_id", "process_name").distinct().groupBy("entry_id").agg(F.count("*").alias("n"), F.min("process_name").alias("process_name")).where("n > 1").select("entry_id", F.col("process_name").alias("_own"))
    if not moved.isEmpty():
        rows = rows.join(moved, "entry_id", "left").where("_own is null or process_name = _own")
    return _in_parts(rows, each)


def _order(ids: np.ndarray, n: np.ndarray, by_weight: bool) -> np.ndarray:
    """Places in order of a hash of the id, heavier pivots first if asked for."""
    h = ids.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    h ^= h >> np.uint64(31)
    return np.lexsort((ids, h, -n)) if by_weight else np.lexsort((ids, h))


def _least(n: np.ndarray, m: np.ndarray, distance: float) -> np.ndarray:
    """The cosine from which pivots of n and of m rows are similar: members at the limit whose deviations are independent, a member and its direction, two directions."""
    a, b = (n >= FEW)[:, None], (m >= FEW)[None, :]
    return np.where(a & b, SAME, np.where(a | b, distance, max(0.4, distance**2))).astype(np.float32)


def _closest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, cosine) of the row of *c* that is closest to each row of *x*, the first of equals; block by block, so that cosines stay in the processor's cache."""
    best, cosine = np.zeros(len(x), np.int64), np.full(len(x), -2, np.float32)
    for b in range(0, len(c), PIVOTS_AT):
        turned = c[b : b + PIVOTS_AT].T
        for a in range(0, len(x), ROWS_AT):
            s = x[a : a + ROWS_AT] @ turned
            at = s.argmax(1)
            s = s[np.arange(len(s)), at]
            nearer = s > cosine[a : a + ROWS_AT]
            best[a : a + ROWS_AT][nearer], cosine[a : a + ROWS_AT][nearer] = at[nearer] + b, s[nearer]
    return best, cosine


def _similar(n: np.ndarray, x: np.ndarray, places: np.ndarray, m: np.ndarray, c: np.ndarray, distance: float) -> tuple[np.ndarray, np.ndarray]:
    """(place, cosine) of the closest similar pivot of each row; without one, the cosine is -2."""
    best, cosine = np.zeros(len(x), np.int64), np.full(len(x), -2, np.float32)
    for kind in (m >= FEW, m < FEW):  # within a kind of pivots a row has one limit
        if kind.any():
            at, s = _closest(x, c[kind])
            at = places[kind][at]
            nearer = (s >= _least(n, m[kind][:1], distance)[:, 0]) & ((s > cosine) | (s == cosine) & (at < best))
            best[nearer], cosine[nearer] = at[nearer], s[nearer]
    return best, cosine


def absorbed(ids: np.ndarray, n: np.ndarray, x: np.ndarray, distance: float, by_weight: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(places of the pivots, number of the pivot that each row belongs to): pivots are the rows without a similar pivot before them."""
    order = _order(ids, n, by_weight)
    pivots, c, k = np.zeros(len(ids), np.int64), np.zeros(x.shape, np.float32), 0
    for a in range(0, len(order), 512):
        at = order[a : a + 512]
        if k:
            at = at[_similar(n[at], x[at], np.arange(k), n[pivots[:k]], c[:k], distance)[1] < -1]
        near = x[at] @ x[at].T >= _least(n[at], n[at], distance)
        free, picked = np.ones(len(at), bool), []
        for i in range(len(at)):
            if free[i]:
                picked.append(i)
                free &= ~near[i]
        pivots[k : k + len(picked)], c[k : k + len(picked)] = at[picked], x[at[picked]]
        k += len(picked)
    pivots = pivots[:k]
    owner = _similar(n, x, np.arange(k), n[pivots], c[:k], distance)[0]
    owner[pivots] = np.arange(k)
    return pivots, owner


def _sums(owner: np.ndarray, k: int, x: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = x * weights[:, None]
    return np.stack([np.bincount(owner, weights=w[:, d], minlength=k) for d in range(x.shape[1])], axis=1), np.bincount(owner, weights=weights, minlength=k).astype(np.int64)


def _state(process: str, distance: float, ids, n, x) -> pa.Table:
    return pa.table({"process_name": pa.array([process] * len(ids), pa.string()), "distance": pa.array([distance] * len(ids), pa.float64()), "id": pa.array(ids, pa.int64()), "n": pa.array(n, pa.int64()), "v": packed(unit(x))})


def _pivots(process: str, distance: float, ids: np.ndarray, n: np.ndarray, x: np.ndarray, by_weight: bool = False) -> pa.Table:
    """One round within a part."""
    pivots, owner = absorbed(ids, n, x, distance, by_weight)
    sums, size = _sums(owner, len(pivots), x, n)
    return _state(process, distance, ids[pivots], size, sums)


def _part(t: pa.Table, k: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """ids and vectors of a part or of packed directions."""
    return np.frombuffer(t["ids"][k].as_buffer(), np.int64), np.frombuffer(t["v"][k].as_buffer(), np.float32).reshape(-1, DIM)


def _first_round(parts: DataFrame) -> DataFrame:
    """The first round of all rows of a table of parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            for k in range(t.num_rows):
                ids, x = _part(t, k)
                yield from _pivots(t["process_name"][k].as_py(), t["distance"][k].as_py(), ids, np.ones(len(ids), np.int64), x).to_batches()

    return written(parts.select("process_name", "distance", "ids", "v").mapInArrow(run, _STATE), "pivots")


def _round(by_weight: bool):
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        return _pivots(t["process_name"][0].as_py(), t["distance"][0].as_py(), t["id"].to_numpy(), t["n"].to_numpy(), unit(matrix(t["v"].chunk(0))), by_weight)

    return run


def _edges(state: DataFrame, sizes: DataFrame) -> DataFrame:
    """(process_name, a, b, cosine): similar pivots of a process, found in pairs of several parts; no task holds more than two such."""
    parts = F.ceil(F.col("parts") / F.lit(MEETING)).cast("int")
    mine = state.join(sizes, "process_name").withColumn("parts", parts).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    pairs = mine.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = pairs.select("process_name", "distance", "id", "n", "v", "mine", F.least("mine", "o").alias("i"), F.greatest("mine", "o").alias("j"))

    def meet(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        x, ids, n = matrix(t["v"].chunk(0)), t["id"].to_numpy(), t["n"].to_numpy()
        mine, i, j, distance = t["mine"].to_numpy(), t["i"][0].as_py(), t["j"][0].as_py(), t["distance"][0].as_py()
        a, b = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        some = n[[np.argmin(n), np.argmax(n)]]
        least = _least(some, some, distance).min()  # the least of their limits
        out = []
        for h in range(0, len(b), PIVOTS_AT):
            turned = x[b[h : h + PIVOTS_AT]].T
            for k in range(0, len(a) if i != j else min(len(a), h + PIVOTS_AT), ROWS_AT):
                s = x[a[k : k + ROWS_AT]] @ turned
                hits = np.flatnonzero(s >= least)  # in one dimension, which is much faster
                p, q = hits // s.shape[1], hits % s.shape[1]
                left, right, cosine = a[k + p], b[h + q], s[p, q]
                few = (n[left] < FEW).astype(int) + (n[right] < FEW)
                keep = (cosine >= np.array([SAME, distance, max(0.4, distance**2)], np.float32)[few]) & ((left != right) if i != j else (left < right))
                out.append((ids[left[keep]], ids[right[keep]], cosine[keep].astype(np.float64)))
        u, w, c = (np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"process_name": pa.array([t["process_name"][0].as_py()] * len(u), pa.string()), "a": u, "b": w, "cosine": c})

    return pairs.groupBy("process_name", "i", "j").applyInArrow(meet, "process_name string, a long, b long, cosine double")


def _added(partial: DataFrame) -> DataFrame:
    """Rows of _STATE with equal process and id added up."""

    def add(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, owner = np.unique(t["id"].to_numpy(), return_inverse=True)
        n = t["n"].to_numpy()
        sums, size = _sums(owner, len(ids), matrix(t["v"].chunk(0)).astype(np.float64), n)
        return _state(t["process_name"][0].as_py(), t["distance"][0].as_py(), ids, size, sums)

    cells = partial.withColumn("cell", F.pmod(F.xxhash64("id"), F.lit(CELLS)))
    return cells.groupBy("process_name", "cell").applyInArrow(add, _STATE)


def _by_edges(state: DataFrame, sizes: DataFrame, by_weight: bool) -> DataFrame:
    """Local minima on the neighbour edges: a pivot without a neighbour before it stays and absorbs its neighbours, round by round until no edge is left."""
    rank = F.struct((-F.col("n") if by_weight else F.lit(0)).alias("w"), F.xxhash64("id").alias("h"), F.col("id").alias("i"))
    ranks = state.select("id", rank.alias("r"))
    edges = written(_edges(state, sizes), "similar")  # both directions are read from it, the pairs are met once
    both = edges.select("a", "b", "cosine").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))
    both = written(both.join(ranks.toDF("a", "ra"), "a").join(ranks.toDF("b", "rb"), "b"), "edges")
    owners, left = None, both
    while not left.isEmpty():
        minima = left.groupBy("a").agg(F.min("rb").alias("rb"), F.first("ra").alias("ra")).where("ra < rb").select("a")
        won = left.join(minima, "a").groupBy("b").agg(F.max(F.struct("cosine", F.col("a").alias("o")))["o"].alias("owner"))
        won = written(won.select(F.col("b").alias("id"), "owner"), "owners")
        owners = won if owners is None else owners.unionByName(won)
        gone = won.select("id").unionByName(minima.select(F.col("a").alias("id")))
        gone = written(gone, "gone")
        left = written(left.join(gone.toDF("a"), "a", "left_anti").join(gone.toDF("b"), "b", "left_anti"), "edges")
    if owners is None:
        return state
    moved = state.join(owners, "id", "left").select("process_name", "distance", F.coalesce("owner", "id").alias("id"), "n", "v")
    return written(_added(moved), "pivots")


def collapsed(state: DataFrame, by_weight: bool = False) -> DataFrame:
    """Rounds over (process_name, distance, id, n, v) until no two pivots of a process are similar."""
    before = None
    while True:
        sizes = state.groupBy("process_name").agg(F.count("*").alias("k"))
        sizes = sizes.select("process_name", F.ceil(F.col("k") / F.lit(PART)).cast("int").alias("parts"), "k")
        most, total, n = sizes.agg(F.max("parts"), F.sum("k"), F.count("*")).first()
        sizes = _hinted(sizes.drop("k"), n)
        if most is not None and most > 1 and before is not None and total > SHRINKS * before:
            return _by_edges(state, sizes, by_weight)
        cells = state.join(sizes, "process_name").withColumn("part", F.pmod(F.xxhash64("id", F.lit(total or 0)), F.col("parts")).cast("int")).drop("parts")
        state = written(cells.groupBy("process_name", "part").applyInArrow(_round(by_weight), _STATE), "pivots")
        if most is None or most <= 1:
            return state
        before = total


_ASSIGNED = "entry_id long, process_name string, grp long, cosine double, phrase string"


def _packed_directions(found: DataFrame) -> DataFrame:
    """(process_name, ids, v): a process's directions in order of their ids, in one value or, where they are very many, several."""
    sizes = found.groupBy("process_name").agg(F.ceil(F.count("*") / F.lit(DIRECTIONS)).cast("int").alias("blocks"))

    def pack(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        order = np.argsort(t["id"].to_numpy(), kind="stable")
        return pa.table({"process_name": t["process_name"].slice(0, 1), "ids": pa.array([t["id"].to_numpy()[order].tobytes()], pa.binary()), "v": pa.array([matrix(t["v"].chunk(0))[order].tobytes()], pa.binary())})

    blocks = found.select("process_name", "id", "v").join(_hinted(sizes), "process_name").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).drop("blocks")
    return written(blocks.groupBy("process_name", "block").applyInArrow(pack, "process_name string, ids binary, v binary"), "packed")


def _assigned(rows: DataFrame, parts: DataFrame, found: DataFrame, what: str) -> DataFrame:
    """Each row with the closest direction of its process, if within the process's distance.

    *what*: "members" gives _ASSIGNED, "rest" the rows (_STATE) that reach none, "sums" the sums of each direction's
    members (_STATE). The directions of a process go to each of its parts.
    """
    sent = parts.join(_packed_directions(found), "process_name", "left" if what == "rest" else "inner")

    def best_of(t: pa.Table, d: pa.Table) -> tuple:
        """The part's ids and vectors, the closest direction of each and its cosine; of equal cosines the least id."""
        ids, x = _part(t)
        best, cos = np.zeros(len(ids), np.int64), np.full(len(ids), -2.0, np.float32)
        for k in range(d.num_rows):
            if d["ids"][k].is_valid:
                of, c = _part(d, k)
                at, s = _closest(x, c)
                nearer = (s > cos) | (s == cos) & (of[at] < best)
                best[nearer], cos[nearer] = of[at[nearer]], s[nearer]
        return ids, x, best, cos

    def members(t: pa.Table, d: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({"entry_id": pa.array([], pa.int64()), "process_name": pa.array([], pa.string()), "grp": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64()), "phrase": pa.array([], pa.string())})
        ids, _, best, cos = best_of(t, d)
        use = np.flatnonzero(cos >= t["distance"][0].as_py())
        return pa.table({"entry_id": ids[use], "process_name": pa.array([t["process_name"][0].as_py()] * len(use), pa.string()), "grp": best[use], "cosine": cos[use].astype(np.float64), "phrase": t["phrases"].combine_chunks().flatten().take(pa.array(use))})

    def rest(t: pa.Table, d: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _state("", 0.0, [], [], np.zeros((0, DIM)))
        ids, x, _, cos = best_of(t, d)
        use = np.flatnonzero(cos < t["distance"][0].as_py())
        return _state(t["process_name"][0].as_py(), t["distance"][0].as_py(), ids[use], np.ones(len(use), np.int64), x[use])

    def sums(t: pa.Table, d: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _state("", 0.0, [], [], np.zeros((0, DIM)))
        _, x, best, cos = best_of(t, d)
        use = np.flatnonzero(cos >= t["distance"][0].as_py())
        of, owner = np.unique(best[use], return_inverse=True)
        total, size = _sums(owner, len(of), x[use], np.ones(len(use)))
        return pa.table({"process_name": pa.array([t["process_name"][0].as_py()] * len(of), pa.string()), "distance": pa.array([t["distance"][0].as_py()] * len(of), pa.float64()), "id": pa.array(of, pa.int64()), "n": pa.array(size, pa.int64()), "v": packed(total / np.maximum(size, 1)[:, None])})

    run, schema = {"members": (members, _ASSIGNED), "rest": (rest, _STATE), "sums": (sums, _STATE)}[what]
    if what != "members":
        rows = rows.drop("phrases")
    return rows.groupBy("process_name", "part").cogroup(sent.groupBy("process_name", "part")).applyInArrow(run, schema)


def _recomputed(rows: DataFrame, parts: DataFrame, found: DataFrame) -> DataFrame:
    """Each direction anew as the mean of its members."""
    return written(_added(_assigned(rows, parts, found, "sums")), "directions")


def _refined(rows: DataFrame, parts: DataFrame, found: DataFrame) -> DataFrame:
    """Members reassigned and directions taken anew, those that are one now collapsed, a few times."""
    for _ in range(REFINED):
        found = collapsed(_recomputed(rows, parts, found), by_weight=True)
    return _recomputed(rows, parts, found)


def _enough(state: DataFrame, least: DataFrame, n: Column) -> DataFrame:
    """The pivots of at least so many rows as *n* makes of their process's smallest size."""
    return state.join(least, "process_name", "left").where(F.col("n") >= n).select(*state.columns)


def _among_rest(rest: DataFrame, large: DataFrame, least: DataFrame, enough: Column) -> DataFrame:
    """The groups that rows which reach none of *large* form among themselves."""
    each = written(rest.groupBy("process_name").agg(F.ceil(F.count("*") / F.lit(PART)).cast("int").alias("parts")), "processes")
    rows = rest.select("process_name", "distance", F.col("id").alias("entry_id"), F.lit(None).cast("string").alias("phrase"), "v").join(_hinted(each), "process_name")
    rows, parts, name = _in_parts(rows, each)
    # pivots of two rows may still grow; those of one don't, unless one row makes a group
    found = _enough(collapsed(_first_round(rows)), least, F.least(enough, F.lit(2)))
    found = _enough(_refined(rows, parts, found), least, enough)
    # a row that began a group and lies outside it now may begin another
    taken = F.when(F.col("_taken").isNotNull(), -1 - F.col("id")).otherwise(F.col("id")).alias("id")
    found = written(found.join(large.select("id", F.lit(1).alias("_taken")), "id", "left").select("process_name", "distance", taken, "n", "v"), "found")
    _drop(rest.sparkSession, name)
    return found


def groups(entries: DataFrame, config: DataFrame) -> DataFrame:
    """(entry_id, process_name, grp, size, cosine, phrase): the entries that belong to a group, with the cosine to its direction.

    Entries without a usable vector, process or entry_id are in no group; an entry delivered twice counts once; processes
    without a configuration take the defaults. grp is the entry_id of the pivot that began the group (-1 less it, should
    it have begun two). Existing labels are not used.
    """
    rows, parts, name = usable_rows(entries, config)
    least = _hinted(written(settings(config).select("process_name", "min_size"), "settings"))
    enough = F.coalesce("min_size", F.lit(MIN_SIZE))
    state = _first_round(rows)  # every row is in the first round
    found = _enough(collapsed(state.where(F.col("n") >= FEW)), least, enough)
    large, before = written(_enough(_refined(rows, parts, found), least, enough), "kept"), None
    while True:
        rest = written(_assigned(rows, parts, large, "rest"), "rest")
        if before is not None and rest.join(before, "id", "left_anti").isEmpty():
            break  # all of them were there before, when groups were looked for
        more = _among_rest(rest, large, least, enough)
        if more.isEmpty():
            break
        kept = written(_enough(_refined(rows, parts, large.unionByName(more)), least, enough), "kept")
        if kept.count() <= large.count():  # no new group
            break
        large, before = kept, rest.select("id")
    members = written(_assigned(rows, parts, large, "members"), "groups")
    _drop(entries.sparkSession, name)
    sizes = members.groupBy("grp").agg(F.count("*").alias("size"))
    return members.join(_hinted(sizes), "grp").select("entry_id", "process_name", "grp", "size", "cosine", "phrase")


def described(members: DataFrame, typical: int = 3) -> DataFrame:
    """(process_name, grp, size, medoid, phrases): each group with its medoid and its most typical phrases, ties by entry_id.

    For vectors of length one the member with the largest sum of cosines to all members is the one closest to the
    direction of their mean, so the medoid needs no pairs.
    """
    closest = Window.partitionBy("grp").orderBy(F.desc("cosine"), "entry_id")
    top = members.withColumn("r", F.row_number().over(closest)).where(F.col("r") <= typical)
    out = top.groupBy("process_name", "grp", "size").agg(F.min_by("entry_id", "r").alias("medoid"), F.sort_array(F.collect_list(F.struct("r", "phrase"))).alias("p"))
    return out.select("process_name", "grp", "size", "medoid", F.col("p.phrase").alias("phrases"))


def probe_pairs(members: DataFrame, probes: DataFrame) -> DataFrame:
    """(id_a, id_b): pairs of probed entries in one group, the smaller entry_id first; large groups meet block by block."""
    asked = probes.where("entry_id is not null").select("entry_id").distinct()
    hit = written(members.join(asked, "entry_id").select("entry_id", "grp"), "probed")
    blocks = hit.groupBy("grp").agg(F.ceil(F.count("*") / F.lit(PROBES)).cast("int").alias("n"))
    hit = hit.join(_hinted(blocks), "grp").withColumn("mine", F.pmod(F.xxhash64("entry_id"), F.col("n")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    a = hit.select(F.col("entry_id").alias("id_a"), "grp", F.col("mine").alias("i"), others.alias("j"))
    b = hit.select(F.col("entry_id").alias("id_b"), "grp", others.alias("i"), F.col("mine").alias("j"))
    return a.join(b, ["grp", "i", "j"]).where("id_a < id_b").select("id_a", "id_b")
