"""Phrase graphs as tables: nodes (graph_id, node_id, ...) and edges (graph_id, src, dst, weight), src < dst."""

from __future__ import annotations

import html
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasewerk.functions import text as T
from phrasewerk.operators.numbering import numbered
from phrasewerk.sources.store import written

#: Edges of a graph that are worked on in one task.
PART_EDGES = 200_000
#: Pairs of nodes of a graph whose paths are compared at once.
NEAR_AT_ONCE = 200_000
#: Numbers of a matrix that are worked on at once where it is passed over many times.
CACHED = 32_768
#: The largest significance: -ln of the smallest positive double is cut here.
MOST = 709.782712893384


def mirrored(edges: DataFrame, *keep: str) -> DataFrame:
    """(graph_id, node, other, keep...): each edge from both ends."""
    one = edges.select("graph_id", F.col("src").alias("node"), F.col("dst").alias("other"), *keep)
    return one.unionByName(edges.select("graph_id", F.col("dst").alias("node"), F.col("src").alias("other"), *keep))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, the root of each, which edges join two trees) of edges taken in order; roots are the smallest ids of their trees."""
    ids, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    up, kept = list(range(len(ids))), np.zeros(len(a), bool)
    for e, (x, y) in enumerate(zip(codes[: len(a)].tolist(), codes[len(a) :].tolist())):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x != y:
            up[max(x, y)] = min(x, y)
            kept[e] = True
    for i in range(len(up)):  # parents come before their children
        up[i] = up[up[i]]
    return ids, np.array(up, int), kept


def _within_parts(edges: DataFrame, run, schema: str, salt: int) -> tuple[DataFrame, bool]:
    """*run* on parts of at most PART_EDGES edges of each graph, written; and whether every graph was one part."""
    sizes = written(edges.groupBy("graph_id").agg(F.ceil(F.count("*") / F.lit(PART_EDGES)).cast("int").alias("_parts")), "sizes")
    most = sizes.agg(F.max("_parts")).first()[0] or 1
    parts = edges.join(sizes, "graph_id").withColumn("_part", F.pmod(F.xxhash64("src", "dst", F.lit(salt)), F.col("_parts")).cast("int")).drop("_parts")
    return written(parts.groupBy("graph_id", "_part").applyInPandas(run, schema), "forest"), most <= 1


def _thinned(edges: DataFrame, run, schema: str) -> tuple[DataFrame, bool]:
    """Edges thinned out part by part until each graph is one part (then True) or a round leaves more than nine tenths.

    What a part's forest leaves out is in no forest of the whole, so nothing is lost.
    """
    n, salt = edges.count(), 0
    while True:
        edges, whole = _within_parts(edges, run, schema, salt)
        left = edges.count()
        if whole or left > 0.9 * n:
            return edges, whole
        n, salt = left, salt + 1


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, node_id, component): the smallest node id that can be reached; isolated nodes are their own.

    Parts of a graph's edges are thinned to links between their nodes and the smallest one they reach. Graphs that do
    not fit a part in the end go on by labels that spread to neighbours and jump to their label's label, about log n
    rounds for a path of n nodes; each round is written to the shared folder.
    """
    kind = edges.schema["graph_id"].dataType.simpleString()

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, root, _ = _forest(pdf["src"].to_numpy(), pdf["dst"].to_numpy())
        own = root != np.arange(len(ids))
        return pd.DataFrame({"graph_id": pdf["graph_id"].iloc[0], "src": ids[root[own]], "dst": ids[own]})

    thin, whole = _thinned(edges.select("graph_id", "src", "dst"), links, f"graph_id {kind}, src long, dst long")
    if whole:
        found = thin.select("graph_id", F.col("dst").alias("node_id"), F.col("src").alias("_c"))
        return written(nodes.select("graph_id", "node_id").join(found, ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.coalesce("_c", "node_id").alias("component")), "components")
    return _spread(nodes, thin)


def _spread(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    label = nodes.select("graph_id", "node_id", F.col("node_id").alias("component"))
    both = written(mirrored(edges), "edges")
    while True:
        near = both.join(label.select("graph_id", F.col("node_id").alias("other"), F.col("component").alias("c")), ["graph_id", "other"])
        near = near.groupBy("graph_id", F.col("node").alias("node_id")).agg(F.min("c").alias("c"))
        spread = label.join(near, ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.col("component").alias("old"), F.least("component", "c").alias("component"))
        jump = spread.select("graph_id", F.col("node_id").alias("component"), F.col("component").alias("further"))
        done = written(spread.join(jump, ["graph_id", "component"], "left").select("graph_id", "node_id", "old", F.least("component", "further").alias("component")), "components")
        label = done.select("graph_id", "node_id", "component")
        if done.where("component <> old").isEmpty():
            return label


def largest_component(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of each graph's largest component (tie: the one with the smallest node)."""
    label = components(nodes, edges)
    size = label.groupBy("graph_id", "component").agg(F.count("*").alias("n"))
    best = size.groupBy("graph_id").agg(F.max(F.struct("n", (-F.col("component")).alias("c")))["c"].alias("c")).select("graph_id", (-F.col("c")).alias("component"))
    kept = label.join(best, ["graph_id", "component"]).select("graph_id", "node_id")
    return nodes.join(kept, ["graph_id", "node_id"]), edges.join(kept.withColumnRenamed("node_id", "src"), ["graph_id", "src"])


def strengths(edges: DataFrame) -> DataFrame:
    """(graph_id, node_id, strength, degree): sums and numbers of the edges at each node."""
    return mirrored(edges, "weight").groupBy("graph_id", F.col("node").alias("node_id")).agg(F.sum("weight").alias("strength"), F.count("*").alias("degree"))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x >= 1: its asymptotic series, moved to arguments from 16 on."""
    moved = np.zeros_like(x)
    small = x < 16
    y = x.copy()
    for _ in range(16):
        if not small.any():
            break
        moved[small] += np.log(y[small])
        y[small] += 1
        small = y < 16
    r = 1 / (y * y)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r * (1 / 1188 - r * 691 / 360360))))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - moved


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, all rows at once until they no longer change."""
    tiny = 1e-300
    c, d = np.ones_like(a), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    out, at = h.copy(), np.arange(len(a))  # rows that no longer change leave
    for m in range(1, 10_000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        going = ~(np.abs(d * c - 1) < 1e-14)
        if going.mean() < 0.8:
            out[at] = h
            a, b, x, c, d, h, at = (v[going] for v in (a, b, x, c, d, h, at))
            if not len(at):
                break
    out[at] = h
    return out


def log_tails(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """ln P(X >= k) of binomial counts: 0 for k <= 0 and for p = 1, -inf for p = 0 and k > n, nan for nan. The incomplete beta function, vectorised."""
    out = np.where(np.isnan(k) | np.isnan(n) | np.isnan(p), np.nan, np.where((k <= 0) | ((p >= 1) & (k <= n)), 0.0, -np.inf))
    at = np.flatnonzero((k > 0) & (k <= n) & (p > 0) & (p < 1))
    if len(at):
        a, b, x = k[at], n[at] - k[at] + 1, p[at]
        front = a * np.log(x) + b * np.log1p(-x) - (_log_gamma(a) + _log_gamma(b) - _log_gamma(a + b))
        left = x < (a + 1) / (a + b + 2)
        u, v, y = np.where(left, a, b), np.where(left, b, a), np.where(left, x, 1 - x)
        part = front + np.log(_fraction(u, v, y) / u)
        out[at] = np.where(left, np.minimum(part, 0), np.log1p(-np.exp(np.minimum(part, -1e-300))))
    return out


def log_upper_tail(k: Column, n: Column, p: Column) -> Column:
    """ln P(X >= k) of a binomial X."""

    @F.pandas_udf("double")
    def tail(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series(log_tails(k.to_numpy(float), n.to_numpy(float), p.to_numpy(float)))

    return tail(k, n, p)


def check_edges(edges: DataFrame) -> None:
    """Refuses loops, edges without a weight and edges that are there twice."""
    bad = edges.where("src = dst or weight is null or isnan(weight)").limit(1)
    twice = edges.groupBy("graph_id", F.least("src", "dst"), F.greatest("src", "dst")).count().where("count > 1").limit(1)
    if not bad.isEmpty() or not twice.isEmpty():
        raise ValueError("simple edges with a weight and without loops are needed")


def significances(edges: DataFrame, as_percent: bool = True, directed: bool = False) -> DataFrame:
    """*edges* with significance = -ln of the chance that two nodes of these strengths share so much weight, cut at MOST.

    Weights count in percent, rounded half to even. Edges whose counts are no binomial input take their graph's largest
    significance, 0 if it has none. Loops, double edges and edges without a weight are refused. *directed* takes the
    chance of an edge from src to dst, twice that of one in any direction.
    """
    check_edges(edges)
    factor = 100 if as_percent else 1
    s = strengths(edges).select("graph_id", "node_id", (F.col("strength") * factor).alias("s"))
    total = s.groupBy("graph_id").agg((F.sum("s") / 2).alias("q"))
    rows = edges.join(s.toDF("graph_id", "src", "su"), ["graph_id", "src"]).join(s.toDF("graph_id", "dst", "sv"), ["graph_id", "dst"]).join(total, "graph_id")
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("su") * F.col("sv") / ((1 if directed else 2) * F.col("q") * F.col("q"))))
    rows = rows.withColumn("_k", F.rint(F.col("weight") * factor)).withColumn("_n", F.rint("q")).withColumn("_p", p)
    chance = F.when((F.col("_k") >= 0) & (F.col("_n") >= F.col("_k")), log_upper_tail(F.col("_k"), F.col("_n"), F.col("_p")))
    rows = rows.withColumn("_t", chance).withColumn("_s", F.least(F.lit(MOST), F.abs("_t")))
    top = rows.groupBy("graph_id").agg(F.max("_s").alias("_top"))
    return rows.join(top, "graph_id").withColumn("significance", F.coalesce("_s", "_top", F.lit(0.0))).select(*edges.columns, "significance")


def simplified(nodes: DataFrame, edges: DataFrame, gamma: float = 0.5, by: str = "weight") -> tuple[DataFrame, DataFrame]:
    """The largest component without its floor(E * gamma) lowest edges (ties by src, dst), joined up again by the heaviest of those removed.

    *gamma* outside (0, 1), or a cut that takes nothing or everything, leaves the component as it is. Rejoining is a
    spanning forest over the parts that remain: of the removed edges those of a maximum forest come back.
    """
    nodes, edges = largest_component(nodes, edges)
    edges = written(edges, "component")
    if not 0 < gamma < 1:
        return nodes, edges
    numbers = numbered(edges, ["graph_id", by, "src", "dst"], "_r")  # by ranges: no task sorts a whole graph
    size = numbers.groupBy("graph_id").agg(F.count("*").alias("_n"), F.min("_r").alias("_first"))
    ranked = numbers.join(size, "graph_id").withColumn("_cut", F.floor(F.col("_n") * gamma))
    gone = (F.col("_r") - F.col("_first") < F.col("_cut")) & (F.col("_cut") > 0) & (F.col("_cut") < F.col("_n"))
    ranked = written(ranked.withColumn("_gone", gone), "ranked").drop("_n", "_r", "_cut", "_first")
    kept, removed = ranked.where("not _gone").drop("_gone"), ranked.where("_gone").drop("_gone")
    part = components(nodes, kept)
    a, b = part.toDF("graph_id", "src", "_a"), part.toDF("graph_id", "dst", "_b")
    bridges = removed.join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"]).where("_a <> _b")
    parts = part.select("graph_id", F.col("component").alias("node_id")).distinct()
    links = bridges.select("graph_id", F.least("_a", "_b").alias("src"), F.greatest("_a", "_b").alias("dst"), F.col(by).alias("weight"), F.col("src").alias("_s"), F.col("dst").alias("_d"))
    back = spanning_forest(parts, links).select("graph_id", F.col("_s").alias("src"), F.col("_d").alias("dst"))
    return nodes, kept.unionByName(removed.join(back, ["graph_id", "src", "dst"], "left_semi"))


def spanning_forest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges of a maximum spanning forest of each graph, other columns kept; equal weights go by (src, dst, all columns).

    Parts of a graph's edges are thinned to their forests. Graphs that do not fit a part in the end go on in rounds of
    the heaviest edge out of each tree; the order is total, so no round makes a cycle and it ends.
    """
    extra = [c for c in edges.columns if c not in ("graph_id", "src", "dst", "weight")]

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "src", "dst", *extra], ascending=[False, True, True, *[True] * len(extra)])
        return pdf[cols][_forest(pdf["src"].to_numpy(), pdf["dst"].to_numpy())[2]]

    cols = list(edges.columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in edges.schema)
    edges, whole = _thinned(edges.where("src <> dst"), forest, schema)
    return edges if whole else _by_heaviest(nodes, edges, extra)


def _by_heaviest(nodes: DataFrame, edges: DataFrame, extra: list[str]) -> DataFrame:
    rank = F.struct(F.col("weight").alias("w"), (-F.col("src")).alias("s"), (-F.col("dst")).alias("d"), *[(-F.col(c)).alias(c) for c in extra])
    edges = written(edges.where("src <> dst").withColumn("_rank", rank), "forest")
    taken = edges.limit(0)
    part = nodes.select("graph_id", "node_id", F.col("node_id").alias("component"))
    while True:
        a, b = part.toDF("graph_id", "src", "_a"), part.toDF("graph_id", "dst", "_b")
        out = edges.join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"]).where("_a <> _b")
        ends = F.explode(F.array(F.struct(F.col("_a").alias("c"), F.col("_b").alias("o")), F.struct(F.col("_b").alias("c"), F.col("_a").alias("o")))).alias("e")
        best = out.select("graph_id", "_rank", ends).groupBy("graph_id", F.col("e.c").alias("component")).agg(F.max(F.struct("_rank", F.col("e.o").alias("o"))).alias("m"))
        best = written(best.select("graph_id", "component", F.col("m._rank").alias("_rank"), F.col("m.o").alias("parent")), "chosen")
        if best.isEmpty():
            return taken.drop("_rank")
        chosen = best.select("graph_id", "_rank").distinct()
        taken = written(taken.unionByName(edges.join(chosen, ["graph_id", "_rank"]).select(*edges.columns)), "taken")
        # the choices point from part to part and meet in pairs that chose one another: the smaller is the root
        back = best.select("graph_id", F.col("component").alias("parent"), F.col("parent").alias("_back"))
        up = best.join(back, ["graph_id", "parent"], "left")
        up = up.select("graph_id", "component", F.when((F.col("_back") == F.col("component")) & (F.col("component") < F.col("parent")), F.col("component")).otherwise(F.col("parent")).alias("parent"))
        while True:
            further = up.select("graph_id", F.col("component").alias("parent"), F.col("parent").alias("_next"))
            moves = F.coalesce(F.col("_next") != F.col("parent"), F.lit(False)).alias("_moved")
            up = written(up.join(further, ["graph_id", "parent"], "left").select("graph_id", "component", F.coalesce("_next", "parent").alias("parent"), moves), "roots")
            moved = not up.where("_moved").isEmpty()
            up = up.drop("_moved")
            if not moved:
                break
        joined = part.join(up, ["graph_id", "component"], "left")
        part = written(joined.select("graph_id", "node_id", F.coalesce("parent", "component").alias("component")), "parts")


def degree_ranks(edges: DataFrame) -> DataFrame:
    """(graph_id, node_id, rank): the number of edges at each node."""
    return mirrored(edges).groupBy("graph_id", F.col("node").alias("node_id")).agg(F.count("*").cast("double").alias("rank"))


def page_rank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 30, tolerance: float | None = None) -> DataFrame:
    """(graph_id, node_id, rank): weighted PageRank of each graph, ranks summing to 1; the rank of nodes without edges goes to all.

    A fixed number of rounds or, with *tolerance*, as many as it takes until a graph's ranks change by less than that in
    sum. A round shrinks the change by *damping* at least, so this ends, and the ranks are then within
    tolerance * damping / (1 - damping) of the limit. Edges of weight 0 carry nothing. Graphs of up to PART_EDGES edges
    and nodes are ranked in a task each, larger ones in rounds of joins, by the same steps.
    """
    edges = edges.select("graph_id", "src", "dst", "weight")
    sizes = nodes.select("graph_id").unionByName(edges.select("graph_id")).groupBy("graph_id").agg(F.count("*").alias("n"))
    large = written(sizes.where(F.col("n") > PART_EDGES).select("graph_id"), "large")
    if large.isEmpty():
        return _ranked_whole(nodes, edges, damping, rounds, tolerance)
    small = _ranked_whole(nodes.join(large, "graph_id", "left_anti"), edges.join(large, "graph_id", "left_anti"), damping, rounds, tolerance)
    return small.unionByName(_ranked_by_joins(nodes.join(large, "graph_id", "left_semi"), edges.join(large, "graph_id", "left_semi"), damping, rounds, tolerance))


def _ranked_whole(nodes: DataFrame, edges: DataFrame, damping: float, rounds: int, tolerance: float | None) -> DataFrame:
    kind = nodes.schema["graph_id"].dataType.simpleString()
    rows = nodes.select("graph_id", F.col("node_id").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(0.0).alias("weight")).unionByName(edges.where("weight <> 0").select("graph_id", F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").cast("double").alias("weight")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        is_node = pdf["b"].isna().to_numpy()
        ids = np.unique(pdf["a"].to_numpy()[is_node])
        own = pdf[~is_node]
        i, j = np.searchsorted(ids, own["a"].to_numpy()), np.searchsorted(ids, own["b"].to_numpy(np.int64))
        i, j, w, n = np.concatenate([i, j]), np.concatenate([j, i]), np.tile(own["weight"].to_numpy(float), 2), len(ids)
        out = np.bincount(i, weights=w, minlength=n)
        share, loose = w / out[i], out == 0
        rank = np.full(n, 1 / n)
        for r in itertools.count() if tolerance is not None else range(rounds):
            after = (1 - damping) / n + damping * (np.bincount(j, weights=rank[i] * share, minlength=n) + rank[loose].sum() / n)
            change, rank = np.abs(after - rank).sum(), after
            if tolerance is not None and change < tolerance:
                break
        return pd.DataFrame({"graph_id": pdf["graph_id"].iloc[0], "node_id": ids, "rank": rank})

    return rows.groupBy("graph_id").applyInPandas(run, f"graph_id {kind}, node_id long, rank double")


def _ranked_by_joins(nodes: DataFrame, edges: DataFrame, damping: float, rounds: int, tolerance: float | None) -> DataFrame:
    """As _ranked_whole; every fifth round is tested and written to the shared folder, which keeps the lineage short."""
    flow = mirrored(edges.where("weight <> 0"), "weight")
    out = flow.groupBy("graph_id", "node").agg(F.sum("weight").alias("_out"))
    flow = written(flow.join(out, ["graph_id", "node"]).select("graph_id", "node", "other", (F.col("weight") / F.col("_out")).alias("_share")), "flow")
    linked = out.select("graph_id", F.col("node").alias("node_id"), F.lit(True).alias("_linked"))
    base = written(nodes.select("graph_id", "node_id").join(linked, ["graph_id", "node_id"], "left"), "linked")
    size = base.groupBy("graph_id").agg(F.count("*").alias("_n"), F.sum(F.when(F.col("_linked").isNull(), 1).otherwise(0)).alias("_m"))
    base = written(base.join(size, "graph_id").select("graph_id", "node_id", "_n", "_m"), "nodes")
    rank = base.select("graph_id", "node_id", (1.0 / F.col("_n")).alias("rank"))
    # nodes without edges receive the same each round, so their rank in round r is known: no second branch of the plan
    rest = (1 - damping) / (F.col("_n") - damping * F.col("_m"))
    for r in itertools.count() if tolerance is not None else range(rounds):
        sent = flow.join(rank.select("graph_id", F.col("node_id").alias("node"), "rank"), ["graph_id", "node"])
        got = sent.groupBy("graph_id", F.col("other").alias("node_id")).agg(F.sum(F.col("rank") * F.col("_share")).alias("_in"))
        free = F.col("_m") * (rest + (1.0 / F.col("_n") - rest) * F.pow(damping * F.col("_m") / F.col("_n"), F.lit(r)))
        inflow = F.coalesce("_in", F.lit(0.0)) + free / F.col("_n")
        after = base.join(got, ["graph_id", "node_id"], "left").select("graph_id", "node_id", ((1 - damping) / F.col("_n") + damping * inflow).alias("rank"))
        if tolerance is None:
            rank = written(after, "rank") if r % 5 == 4 or r == rounds - 1 else after
        elif r % 5 == 3:
            rank = written(after, "rank")
        elif r % 5 == 4:
            tested = written(after.join(rank.withColumnRenamed("rank", "_old"), ["graph_id", "node_id"]), "rank")
            rank = tested.drop("_old")
            change = tested.groupBy("graph_id").agg(F.sum(F.abs(F.col("rank") - F.col("_old"))).alias("c"))
            if change.where(~(F.col("c") < tolerance)).isEmpty():
                return rank
        else:
            rank = after
    return rank


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, n_nodes, n_edges) of every graph with a node or an edge."""
    n, e = nodes.groupBy("graph_id").agg(F.count("*").alias("n_nodes")), edges.groupBy("graph_id").agg(F.count("*").alias("n_edges"))
    return n.join(e, "graph_id", "full_outer").select("graph_id", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def adjacency(nodes: DataFrame, edges: DataFrame, *attributes: str) -> DataFrame:
    """(graph_id, node_id, label, attributes..., neighbours): each node's neighbours with weight and significance (null where the edges have none), in order; an empty list for isolated nodes."""
    more = F.col("significance") if "significance" in edges.columns else F.lit(None).cast("double")
    near = mirrored(edges.withColumn("significance", more), "weight", "significance").groupBy("graph_id", F.col("node").alias("node_id"))
    near = near.agg(F.sort_array(F.collect_list(F.struct("other", "weight", "significance"))).alias("neighbours"))
    out = nodes.join(near, ["graph_id", "node_id"], "left")
    return out.select("graph_id", "node_id", "label", *attributes, F.coalesce("neighbours", F.array().cast(near.schema["neighbours"].dataType)).alias("neighbours"))


def one_graph(nodes: DataFrame, edges: DataFrame, graph_id) -> DataFrame:
    """The adjacency of one graph; a graph that is not there is an error."""
    own = nodes.where(F.col("graph_id") == graph_id)
    if own.isEmpty():
        raise IndexError(f"no graph {graph_id}")
    return adjacency(own, edges.where(F.col("graph_id") == graph_id))


def edge_style(weight: Column) -> Column:
    """The drawing class of an edge by its weight."""
    return F.when(weight >= 0.9, "strong").when(weight >= 0.8, "firm").when(weight >= 0.65, "medium").when(weight >= 0.5, "weak").otherwise("faint")


def document_scores(edges: DataFrame, holders: DataFrame) -> DataFrame:
    """(document, graph_id, score): for each edge, its weight for every document of either end, counted once.

    *holders* has graph_id, node_id, document.
    """
    ends = edges.select("graph_id", "src", "dst", "weight", F.explode(F.array("src", "dst")).alias("node_id"))
    docs = ends.join(holders, ["graph_id", "node_id"]).select("graph_id", "src", "dst", "weight", "document").distinct()
    return docs.groupBy("document", "graph_id").agg(F.sum("weight").alias("score"))


def path_scores(edges: DataFrame, holders: DataFrame, damping: float = 0.5, reward: float = 1.75) -> DataFrame:
    """(document, graph_id, score): for each pair of nodes up to two edges apart, every path between them, its weights damped by their place and divided by its length, for every document of either end.

    The first edge of a path counts whole, the second by 1 / (1 + damping). Edges marked sub_cluster weigh *reward*
    times as much, and the graph's mean weight where they have none. A path is walked from its smaller end; a pair one
    edge apart counts only its edge.
    """
    if "sub_cluster" in edges.columns:
        mean = edges.groupBy("graph_id").agg(F.avg(F.coalesce("weight", F.lit(0.0))).alias("_mean"))
        marked = F.coalesce("sub_cluster", F.lit(False))
        own = F.when(marked, F.coalesce("weight", "_mean") * reward).otherwise(F.coalesce("weight", F.lit(0.0)))
        edges = edges.join(mean, "graph_id").select("graph_id", "src", "dst", own.alias("weight"))
    both = mirrored(edges, "weight")
    second = both.select("graph_id", F.col("node").alias("other"), F.col("other").alias("_end"), F.col("weight").alias("_w"))
    one = both.where("node < other").select("graph_id", "node", F.col("other").alias("_end"), F.col("weight").alias("s"))
    two = both.join(second, ["graph_id", "other"]).where("node < _end").join(one.select("graph_id", "node", "_end"), ["graph_id", "node", "_end"], "left_anti")
    two = two.groupBy("graph_id", "node", "_end").agg(F.sum((F.col("weight") + F.col("_w") / (1 + damping)) / 2).alias("s"))
    pairs = one.unionByName(two)
    ends = pairs.select("graph_id", "node", "_end", "s", F.explode(F.array("node", "_end")).alias("node_id"))
    docs = ends.join(holders, ["graph_id", "node_id"]).select("graph_id", "node", "_end", "s", "document").distinct()
    return docs.groupBy("document", "graph_id").agg(F.sum("s").alias("score"))


def community_scores(nodes: DataFrame, edges: DataFrame, holders: DataFrame, cutoff: float = 0.5) -> DataFrame:
    """(document, graph_id, score): for each node, the weights along the shortest path over e to the number of its edges, summed over the nodes of its community at most *cutoff* away (an edge is 1 - weight long), for every document of a node that near.

    Communities come from moving nodes as long as modularity grows, levels of ever larger nodes, in order of the node
    ids; a graph is worked on in one task, so graphs must be as small as one concept's.
    """
    sent = edges.select("graph_id", F.lit(0).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "weight")
    sent = sent.unionByName(nodes.select("graph_id", F.lit(1).alias("kind"), F.col("node_id").alias("a"), F.col("node_id").alias("b"), F.lit(0.0).alias("weight")))
    kind = nodes.schema["graph_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(pdf.loc[pdf["kind"] == 1, "a"].unique())
        own = pdf[pdf["kind"] == 0]
        i, j, w = np.searchsorted(ids, own["a"]), np.searchsorted(ids, own["b"]), own["weight"].to_numpy(float)
        m = np.zeros((len(ids), len(ids)))
        m[i, j] = m[j, i] = w
        a, b, worth = neighbourhoods(m, cutoff)
        return pd.DataFrame({"graph_id": pdf["graph_id"].iloc[0], "a": ids[a], "b": ids[b], "s": worth})

    pairs = sent.groupBy("graph_id").applyInPandas(run, f"graph_id {kind}, a long, b long, s double")
    total = pairs.groupBy("graph_id", "a").agg(F.sum("s").alias("s"))  # what a node's neighbourhood is worth
    near = pairs.select("graph_id", "a", F.col("b").alias("node_id")).join(holders, ["graph_id", "node_id"]).select("graph_id", "a", "document").distinct()
    return near.join(total, ["graph_id", "a"]).groupBy("document", "graph_id").agg(F.sum("s").alias("score"))


def neighbourhoods(m: np.ndarray, cutoff: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, what b is worth to a) of the nodes at most *cutoff* apart in a symmetric weight matrix: the weights along the shortest path over e to the number of its edges, 0 in another community."""
    part = communities(m)
    length = np.where(m > 0, np.maximum(1 - m, 0), np.inf)
    length[length > cutoff] = np.nextafter(cutoff, np.inf)  # on a path within the cutoff every part is; others are just beyond it
    np.fill_diagonal(length, 0)
    hops, weight = (length <= cutoff).astype(np.int16), m.copy()
    np.fill_diagonal(hops, 0)
    for k in range(len(m)):  # shortest paths through ever more nodes, with their edges and weights
        near = np.flatnonzero(length[k] <= cutoff)
        near = near[np.argsort(length[k, near], kind="stable")]
        own = length[k, near]
        # of nodes in order of their way to k each meets those before it that are near enough together
        met = np.minimum(np.searchsorted(own, cutoff + 1e-9 - own, side="right"), np.arange(len(own)))
        ends, lo = np.cumsum(met), 0
        while lo < len(near):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - met[lo] + NEAR_AT_ONCE, side="right")))
            some = met[lo:hi]
            x = np.repeat(np.arange(lo, hi), some)
            y = np.arange(len(x)) - np.repeat(np.cumsum(some) - some, some)
            through, x, y, lo = own[x] + own[y], near[x], near[y], hi
            before = length[x, y]
            good = (through <= cutoff) & ((before > cutoff) | (through < before - 1e-12))
            if good.any():
                x, y = x[good], y[good]
                length[x, y] = length[y, x] = through[good]
                hops[x, y] = hops[y, x] = hops[x, k] + hops[k, y]
                weight[x, y] = weight[y, x] = weight[x, k] + weight[k, y]
    a, b = np.nonzero((length <= cutoff) & (length > 0))
    return a, b, np.where(part[a] == part[b], weight[a, b] / np.exp(hops[a, b].astype(float)), 0.0)


def communities(m: np.ndarray, rounds: int = 20) -> np.ndarray:
    """A community number for each node of a symmetric weight matrix: nodes move to the neighbour community that raises modularity most, then communities are nodes themselves, until nothing moves."""
    label = np.arange(len(m))
    level, of = m.copy(), np.arange(len(m))
    while True:
        total, degree = level.sum(), level.sum(1)
        part = np.arange(len(level))
        if total <= 0:
            return label
        changed, held = False, None
        others = level.copy()
        np.fill_diagonal(others, 0)
        for _ in range(rounds):
            moved = False
            for v in range(len(level)):
                if held is None:  # a node has moved
                    held = np.bincount(part, weights=degree, minlength=len(level))
                sums = held.copy()
                sums[part[v]] -= degree[v]
                sums *= degree[v]
                sums /= total
                gain = np.bincount(part, weights=others[v], minlength=len(level))
                gain -= sums
                best = int(gain.argmax())
                if gain[best] > gain[part[v]] + 1e-12:
                    part[v], moved, changed, held = best, True, True, None
            if not moved:
                break
        _, part = np.unique(part, return_inverse=True)
        of = part[of]
        if not changed:
            return of
        fold = np.zeros((len(level), part.max() + 1))
        fold[np.arange(len(level)), part] = 1
        level = fold.T @ level @ fold


def unrolled(nodes: DataFrame, edges: DataFrame, reference: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Each graph as a tree: isolated nodes fall out, the edges of a maximum spanning forest stay, and its parts are joined by the heaviest edges of the *reference* graph between them.

    Always ends: both forests follow a total order. What the reference does not connect stays apart.
    """
    linked = mirrored(edges).select("graph_id", F.col("node").alias("node_id")).distinct()
    own = written(nodes.join(linked, ["graph_id", "node_id"], "left_semi"), "linked")
    cols = ["graph_id", "src", "dst", "weight"]
    tree = spanning_forest(own, edges.select(*cols))
    if reference is not None:
        part = components(own, tree)
        a, b = part.toDF("graph_id", "src", "_a"), part.toDF("graph_id", "dst", "_b")
        bridges = reference.select(*cols).join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"]).where("_a <> _b")
        links = bridges.select("graph_id", F.least("_a", "_b").alias("src"), F.greatest("_a", "_b").alias("dst"), "weight", F.col("src").alias("_s"), F.col("dst").alias("_d"))
        roots = part.select("graph_id", F.col("component").alias("node_id")).distinct()
        back = spanning_forest(roots, links).select("graph_id", F.col("_s").alias("src"), F.col("_d").alias("dst"), "weight")
        tree = tree.unionByName(back)
    more = [c for c in edges.columns if c not in cols]
    return own, tree.join(edges.select("graph_id", "src", "dst", *more), ["graph_id", "src", "dst"], "left") if more else tree


def component_ranks(nodes: DataFrame, edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """(graph_id, component, mean_rank, n_nodes) of each component, from ranks (graph_id, node_id, rank)."""
    by = components(nodes, edges).join(ranks, ["graph_id", "node_id"], "left")
    return by.groupBy("graph_id", "component").agg(F.avg(F.coalesce("rank", F.lit(0.0))).alias("mean_rank"), F.count("*").alias("n_nodes"))


def edge_means(edges: DataFrame) -> DataFrame:
    """(graph_id, mean_weight, mean_significance); a null significance counts as 0, as does a missing column."""
    s = F.col("significance") if "significance" in edges.columns else F.lit(0.0)
    return edges.groupBy("graph_id").agg(F.avg(F.coalesce("weight", F.lit(0.0))).alias("mean_weight"), F.avg(F.coalesce(s, F.lit(0.0))).alias("mean_significance"))


def exemplars(similar: np.ndarray, damping: float, rounds: int) -> np.ndarray | None:
    """The exemplar of each row by affinity propagation; None if the messages did not settle on any.

    A row's own preference is the median similarity. Messages are passed until the exemplars stay the same for 15 rounds.
    """
    n = len(similar)
    if n == 1:
        return np.zeros(1, int)
    s = similar.astype(float).copy()
    np.fill_diagonal(s, np.median(similar[~np.eye(n, dtype=bool)]))
    s += np.arange(n * n).reshape(n, n) % 7919 * 1e-12  # equal similarities are told apart, the same way every time
    r, a = np.zeros((n, n)), np.zeros((n, n))
    step = max(1, CACHED // n)  # a pass over a few rows at a time: what they need stays in the processor's cache
    both, gain = np.empty((step, n)), np.empty((step + 1, n))
    total, before, steady = None, None, 0
    for _ in range(rounds):
        sums = np.zeros(n)
        for lo in range(0, n, step):
            i = np.arange(lo, min(n, lo + step))
            k, rs, as_, ss, new, g = i - lo, r[lo : lo + step], a[lo : lo + step], s[lo : lo + step], both[: len(i)], gain[1 : len(i) + 1]
            if total is not None:  # the second half of the round before
                np.maximum(rs, 0, out=g)
                g[k, i] = rs[k, i]
                np.subtract(total, g, out=new)
                own = new[k, i]
                np.minimum(new, 0, out=new)
                new[k, i] = own
                new *= 1 - damping
                as_ *= damping
                as_ += new
            np.add(as_, ss, out=new)
            first = new.argmax(1)
            top = new[k, first]
            new[k, first] = -np.inf
            second = new.max(1)
            np.subtract(ss, top[:, None], out=new)
            new[k, first] = ss[k, first] - second
            new *= 1 - damping
            rs *= damping
            rs += new
            np.maximum(rs, 0, out=g)
            g[k, i] = rs[k, i]
            gain[0] = sums
            sums = gain[: len(i) + 1].sum(0)
        total, own = sums, r.diagonal()
        chosen = own + (damping * a.diagonal() + (1 - damping) * (total - own)) > 0
        steady = steady + 1 if before is not None and (chosen == before).all() else 0
        before = chosen
        if steady >= 15 and chosen.any():
            break
    if not before.any() or steady < 15:
        return None
    centres = np.flatnonzero(before)
    owner = centres[s[:, centres].argmax(1)]
    owner[centres] = centres
    return owner


#: Damping and rounds of the tries of sub_clusters.
TRIES = ((0.55, 300), (0.65, 600), (0.75, 900), (0.85, 1200), (0.95, 1500))


def owners(similar: np.ndarray, tries: int) -> np.ndarray | None:
    """The exemplar of each row, with more damping for each of up to five *tries*; None if none settles."""
    for damping, rounds in TRIES[: max(1, min(tries, len(TRIES)))]:
        owner = exemplars(similar, damping, rounds) if len(similar) else None
        if owner is not None:
            return owner
    return None


def sub_clusters(nodes: DataFrame, edges: DataFrame, reference: DataFrame, gamma: float = 0.01, tries: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes with root and edges with sub_cluster: affinity propagation over label similarity times the weight in the *reference* graph (*gamma* where it has no edge).

    An exemplar's members get an edge to it: an existing one is marked, others take the reference's weight, else the
    graph's mean. Up to five *tries* with more damping; a graph without exemplars stays as it is. A graph is worked on
    in one task, so graphs must be as small as one concept's.
    """
    from phrasewerk.operators.pairs import ratios  # which imports this module

    means = edge_means(edges)
    kind = nodes.schema["graph_id"].dataType.simpleString()
    sent = nodes.select("graph_id", F.lit(1).alias("kind"), F.col("node_id").alias("a"), F.col("node_id").alias("b"), F.lit(0.0).alias("weight"), "label")
    sent = sent.unionByName(reference.select("graph_id", F.lit(0).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "weight", F.lit(None).cast("string").alias("label")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["kind"] == 1].sort_values("a").drop_duplicates("a")
        ids, labels = own["a"].to_numpy(), own["label"].fillna("").tolist()
        near = pdf[(pdf["kind"] == 0) & pdf["a"].isin(ids) & pdf["b"].isin(ids)]
        s = np.full((len(ids), len(ids)), gamma)
        i, j = np.searchsorted(ids, near["a"]), np.searchsorted(ids, near["b"])
        s[i, j] = s[j, i] = near["weight"]
        owner = owners(s * ratios(labels), tries)
        if owner is not None:
            return pd.DataFrame({"graph_id": pdf["graph_id"].iloc[0], "node_id": ids, "exemplar": ids[owner]})
        return pd.DataFrame({"graph_id": [], "node_id": [], "exemplar": []})

    found = written(sent.groupBy("graph_id").applyInPandas(run, f"graph_id {kind}, node_id long, exemplar long"), "exemplars")
    roots = found.select("graph_id", F.col("exemplar").alias("node_id"), F.lit(True).alias("root")).distinct()
    out_nodes = nodes.join(roots, ["graph_id", "node_id"], "left").withColumn("root", F.coalesce("root", F.lit(False)))
    links = found.where("node_id <> exemplar").select("graph_id", F.least("node_id", "exemplar").alias("src"), F.greatest("node_id", "exemplar").alias("dst"), F.lit(True).alias("_sub"))
    known = reference.select("graph_id", "src", "dst", F.col("weight").alias("_w"))
    both = edges.join(links, ["graph_id", "src", "dst"], "full_outer").join(known, ["graph_id", "src", "dst"], "left").join(means, "graph_id", "left")
    more = [F.coalesce("significance", F.when(F.col("_sub"), F.col("mean_significance"))).alias("significance")] if "significance" in edges.columns else []
    weight = F.coalesce("weight", "_w", "mean_weight").alias("weight")
    return out_nodes, both.select("graph_id", "src", "dst", weight, *more, F.coalesce("_sub", F.lit(False)).alias("sub_cluster"))


def page_rank_scores(nodes: DataFrame, edges: DataFrame, links: DataFrame, rounds: int = 30, tolerance: float | None = None, normalise: bool = False) -> DataFrame:
    """(document, graph_id, score): documents join their graphs as nodes, linked to their phrases by *links* (graph_id, node_id, document, weight); their PageRank is the score, over the graph's largest if *normalise*."""
    docs = links.select("graph_id", "document").distinct().withColumn("node_id", -F.col("document") - 1)  # ids of their own
    more = links.select("graph_id", (-F.col("document") - 1).alias("src"), F.col("node_id").alias("dst"), "weight")
    all_nodes = nodes.select("graph_id", "node_id").unionByName(docs.select("graph_id", "node_id"))
    rank = page_rank(all_nodes, edges.select("graph_id", "src", "dst", "weight").unionByName(more), rounds=rounds, tolerance=tolerance)
    out = rank.join(docs, ["graph_id", "node_id"]).select("document", "graph_id", F.col("rank").alias("score"))
    if not normalise:
        return out
    top = out.groupBy("graph_id").agg(F.max("score").alias("_top"))
    return out.join(top, "graph_id").select("document", "graph_id", (F.col("score") / F.col("_top")).alias("score"))


def edge_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, src, dst, label_a, label_b, weight, style): what a drawing of the graphs needs; edges of sub-clusters are hidden."""
    names = nodes.select("graph_id", "node_id", "label")
    shown = edges.where(~F.coalesce("sub_cluster", F.lit(False))) if "sub_cluster" in edges.columns else edges
    rows = shown.join(names.toDF("graph_id", "src", "label_a"), ["graph_id", "src"]).join(names.toDF("graph_id", "dst", "label_b"), ["graph_id", "dst"])
    return rows.select("graph_id", "src", "dst", "label_a", "label_b", "weight", edge_style(F.col("weight")).alias("style"))


def drawn(nodes: DataFrame, edges: DataFrame, graph_id, height: int = 800) -> str:
    """One graph as an HTML page with an SVG drawing, nodes on a circle; for graphs that a reader can look at."""
    own = nodes.where(F.col("graph_id") == graph_id).select("node_id", "label").orderBy("node_id").collect()
    lines = edge_lines(nodes.where(F.col("graph_id") == graph_id), edges.where(F.col("graph_id") == graph_id)).orderBy("src", "dst").collect()
    r = height / 2
    place = {n.node_id: (r + 0.8 * r * np.cos(2 * np.pi * i / len(own)), r + 0.8 * r * np.sin(2 * np.pi * i / len(own))) for i, n in enumerate(own)}
    width = {"strong": 4, "firm": 3, "medium": 2, "weak": 1, "faint": 0.5}
    drawn_edges = [f'<line class="{e.style}" x1="{place[e.src][0]:.0f}" y1="{place[e.src][1]:.0f}" x2="{place[e.dst][0]:.0f}" y2="{place[e.dst][1]:.0f}" stroke="grey" stroke-width="{width[e.style]}"/>' for e in lines]
    names = [f'<text x="{place[n.node_id][0]:.0f}" y="{place[n.node_id][1]:.0f}">{html.escape(n.label or "")}</text>' for n in own]
    return f'<html><body><svg width="{height}" height="{height}">' + "".join(drawn_edges + names) + "</svg></body></html>"
