"""Graphs that are weighed and worked on in one task: their edges are neither shuffled nor stored.

Members are rows (graph_id, node_id, label, embedding, documents), a key of a graph once; edges are those of
pairs.weighted_pairs with a cut-off above 0. Graphs of more than WHOLE nodes go by the operators on tables of edges.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasewerk.functions import text as T
from phrasewerk.operators import graph as G
from phrasewerk.operators import pairs as R

#: Nodes of a graph that is worked on in one task: its weights are 128 MB.
WHOLE = 4_000
#: Nodes of a graph whose edges all leave its task.
SPREAD = 2_000
#: Rows of a block of pairs in a task.
AT_ONCE = 1_000


def weights(own: pd.DataFrame, wc: float, cut_off: float, added: float) -> np.ndarray:
    """The symmetric matrix of weights of the nodes *own* (id, s, v), 0 where no edge is; nodes without a label have none."""
    m = np.zeros((len(own), len(own)))
    own = pd.DataFrame({"id": np.arange(len(own)), "s": own["s"].to_numpy(), "v": own["v"].to_numpy()})
    own = own[own["s"].notna()]
    starts = range(0, len(own), AT_ONCE)
    for i in starts:
        for j in starts[i // AT_ONCE :]:
            both = [own[i : i + AT_ONCE]] if i == j else [own[i : i + AT_ONCE], own[j : j + AT_ONCE]]
            block = pd.concat([b.assign(_i=0, _j=len(both) - 1, _mine=k) for k, b in enumerate(both)])
            for part, p, q, _, weight in R._weighed(block, wc, cut_off, added):
                at = part["id"].to_numpy()
                m[at[p], at[q]] = m[at[q], at[p]] = weight
    return m


def worked(members: DataFrame, run: Callable[..., pd.DataFrame], schema: str, wc: float = 0.5, cut_off: float = 0.5, links: DataFrame | None = None, added: float = 0.05) -> DataFrame:
    """What *run* makes of each graph: it gets the nodes (id, label, docs) in order of the id, the matrix of their weights and the graph's *links*, if there are any; graph_id is put before its columns."""
    if cut_off <= 0:
        raise ValueError("edges need a weight above 0")
    rows = members.where(F.exists("embedding", lambda x: x != 0) & F.col("node_id").isNotNull() & F.col("graph_id").isNotNull())
    rows = rows.select("graph_id", F.col("node_id").cast("long").alias("id"), "label", T.sorted_words(F.col("label")).alias("s"), F.transform("embedding", lambda x: x.cast("float")).alias("v"), R.document_ids("documents").alias("docs"))
    kind = rows.schema["graph_id"].dataType.simpleString()

    def whole(pdf: pd.DataFrame, more: pd.DataFrame | None = None) -> pd.DataFrame:
        own = R._once(pdf).sort_values("id", ignore_index=True)
        found = run(own, weights(own, wc, cut_off, added), *([] if more is None else [more]))
        found.insert(0, "graph_id", pdf["graph_id"].iloc[0] if len(pdf) else None)
        return found.astype({c: object for c, kind in found.dtypes.items() if not pd.api.types.is_numeric_dtype(kind)})  # strings as one array

    schema = f"graph_id {kind}, {schema}"
    if links is None:
        return rows.groupBy("graph_id").applyInPandas(lambda pdf: whole(pdf), schema)
    links = links.withColumnRenamed("graph_id", "_of")  # may come from the members
    return rows.groupBy("graph_id").cogroup(links.groupBy("_of")).applyInPandas(lambda pdf, more: whole(pdf, more), schema)


def path_scores(members: DataFrame, wc: float = 0.5, cut_off: float = 0.5, damping: float = 0.5) -> DataFrame:
    """(document, graph_id, score) as graph.path_scores of the members' edges: paths of two edges are a product of matrices."""

    def run(own: pd.DataFrame, m: np.ndarray) -> pd.DataFrame:
        n, pairs = len(m), np.zeros_like(m)
        strength, degree = np.zeros(n), np.zeros(n)
        for i in range(0, n, AT_ONCE):
            for j in range(i, n, AT_ONCE):
                a, b = slice(i, i + AT_ONCE), slice(j, j + AT_ONCE)
                two = (m[a] @ (m[:, b] > 0) + (m[a] > 0) @ m[:, b] / (1 + damping)) / 2
                block = np.where(m[a, b] > 0, m[a, b], two)
                pairs[a, b] = block = np.triu(block, 1) if i == j else block  # from the smaller end
                some = block > 0
                strength[a] += block.sum(1)
                strength[b] += block.sum(0)
                degree[a] += some.sum(1)
                degree[b] += some.sum(0)
        names, score = R.document_sums(own["docs"].to_numpy(), strength, degree, pairs)
        return pd.DataFrame({"document": names, "score": score})

    return worked(members, run, "document string, score double", wc, cut_off).select("document", "graph_id", "score")


def page_rank(members: DataFrame, wc: float = 0.5, cut_off: float = 0.5, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """(graph_id, node_id, rank) as graph.page_rank of the members and their edges."""

    def run(own: pd.DataFrame, m: np.ndarray) -> pd.DataFrame:
        none = np.zeros(0, int)
        return pd.DataFrame({"node_id": own["id"], "rank": _ranks(m, none, none, np.zeros(0), 0, damping, tolerance)})

    return worked(members, run, "node_id long, rank double", wc, cut_off)


def page_rank_scores(members: DataFrame, links: DataFrame, wc: float = 0.5, cut_off: float = 0.5, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """(document, graph_id, score) as graph.page_rank_scores of the members, their edges and *links* (graph_id, node_id, document, weight); those to nodes that are not there fall out."""

    def run(own: pd.DataFrame, m: np.ndarray, links: pd.DataFrame) -> pd.DataFrame:
        links = links[links["node_id"].isin(own["id"])]
        docs, d = np.unique(links["document"].to_numpy(), return_inverse=True)
        p = np.searchsorted(own["id"].to_numpy(), links["node_id"].to_numpy())
        rank = _ranks(m, p, d, links["weight"].to_numpy(float), len(docs), damping, tolerance)
        return pd.DataFrame({"document": docs, "score": rank[len(m) :]})

    return worked(members, run, f"document {links.schema['document'].dataType.simpleString()}, score double", wc, cut_off, links=links).select("document", "graph_id", "score")


def community_scores(members: DataFrame, wc: float = 0.5, cut_off: float = 0.5, cutoff: float = 0.5) -> DataFrame:
    """(document, graph_id, score) as graph.community_scores of the members and their edges; a document has what the nodes near one of its own are worth, each once."""

    def run(own: pd.DataFrame, m: np.ndarray) -> pd.DataFrame:
        a, b, worth = G.neighbourhoods(m, cutoff)
        total, docs = np.bincount(a, worth, len(m)), own["docs"].to_numpy()
        node = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        if not len(node):
            return pd.DataFrame({"document": np.array([], object), "score": np.zeros(0)})
        of, names = pd.factorize(np.concatenate(docs))
        near = np.zeros((len(m), len(m)), bool)
        near[b, a] = True
        order = np.argsort(of, kind="stable")
        of, node = of[order], node[order]
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        ends, score, some = np.r_[starts[1:], len(of)], np.zeros(len(names)), np.zeros(len(names), bool)
        for lo, hi in zip(starts, ends):
            hit = near[node[lo]] if hi - lo == 1 else near[node[lo:hi]].any(0)
            score[of[lo]], some[of[lo]] = total[hit].sum(), hit.any()
        return pd.DataFrame({"document": names[some], "score": score[some]})

    return worked(members, run, "document string, score double", wc, cut_off).select("document", "graph_id", "score")


def sub_cluster_sizes(members: DataFrame, wc: float = 0.5, cut_off: float = 0.5, gamma: float = 0.01, tries: int = 1) -> DataFrame:
    """(graph_id, node_id, n_members) of the exemplars that graph.sub_clusters finds in the members' edges: the number of other nodes whose exemplar they are."""

    def run(own: pd.DataFrame, m: np.ndarray) -> pd.DataFrame:
        owner = G.owners(np.where(m > 0, m, gamma) * R.ratios(own["label"].fillna("").tolist()), tries)
        held = np.zeros(len(m), int) if owner is None else np.bincount(owner, minlength=len(m))
        return pd.DataFrame({"node_id": own["id"], "n_members": held - 1})[held > 0]

    return worked(members, run, "node_id long, n_members long", wc, cut_off)


def _significant(m: np.ndarray, directed: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(p, q, significance) of the edges p < q of a matrix of weights, in order."""
    p, q = np.nonzero(np.triu(m, 1))
    x = m.sum(1) * 100
    return p, q, R.significances(x, x.sum() / 2, p, q, m[p, q], directed)


def significances(members: DataFrame, wc: float = 0.5, cut_off: float = 0.5, directed: bool = False) -> DataFrame:
    """(graph_id, src, dst, significance) as pairs.pair_significances of the members, whose pairs are weighed once; for graphs of up to SPREAD nodes."""

    def run(own: pd.DataFrame, m: np.ndarray) -> pd.DataFrame:
        ids, (p, q, found) = own["id"].to_numpy(), _significant(m, directed)
        return pd.DataFrame({"src": ids[p], "dst": ids[q], "significance": found})

    return worked(members, run, "src long, dst long, significance double", wc, cut_off)


def trees(members: DataFrame, wc: float = 0.5, cut_off: float = 0.5, gamma: float = 0.5, by: str = "weight") -> DataFrame:
    """(graph_id, src, dst, weight, cosine), and significance if *by* is that: the members' edges as graph.simplified (for *gamma* in (0, 1)) and then graph.unrolled leave them.

    What simplified leaves is connected, so a tree of it needs no edges of the whole graph.
    """
    significant = by == "significance"

    def run(own: pd.DataFrame, m: np.ndarray) -> pd.DataFrame:
        n, ids = len(m), own["id"].to_numpy()
        p, q, value = _significant(m) if significant else (*(at := np.nonzero(np.triu(m, 1))), m[at])
        if 0 < gamma < 1:
            kept = _simplified(m, p, q, value, gamma)
            p, q, value = p[kept], q[kept], value[kept]
        w = np.zeros_like(m)
        w[p, q] = w[q, p] = m[p, q]
        code = _heaviest(w)
        a, b = code // max(n, 1), code % max(n, 1)
        x = [v / np.sqrt(v @ v) for v in (np.asarray(v, float) for v in own["v"])]
        out = pd.DataFrame({"src": ids[a], "dst": ids[b], "weight": m[a, b], "cosine": np.array([x[i] @ x[j] for i, j in zip(a, b)], float)})
        return out.assign(significance=value[np.searchsorted(p * n + q, code)]) if significant else out

    return worked(members, run, "src long, dst long, weight double, cosine double" + ", significance double" * significant, wc, cut_off)


def _parts(link: np.ndarray) -> np.ndarray:
    """The smallest node that each one reaches."""
    part = np.full(len(link), -1)
    for v in range(len(link)):
        if part[v] < 0:
            new = np.zeros(len(link), bool)
            new[v] = True
            while new.any():
                part[new] = v
                new = link[new].any(0) & (part < 0)
    return part


def _simplified(m: np.ndarray, p: np.ndarray, q: np.ndarray, value: np.ndarray, gamma: float) -> np.ndarray:
    """Which of the edges p < q (in order) stay, as graph.simplified by *value*."""
    n, part = len(m), _parts(m > 0)
    own = np.flatnonzero(part[p] == np.bincount(part, minlength=1).argmax())
    cut, kept = int(np.floor(len(own) * gamma)), np.zeros(len(p), bool)
    kept[own] = True
    if not 0 < cut < len(own):
        return kept
    gone = own[np.argsort(value[own], kind="stable")[:cut]]
    kept[gone] = False
    link = np.zeros((n, n), bool)
    link[p[kept], q[kept]] = link[q[kept], p[kept]] = True
    part = _parts(link)
    out = gone[part[p[gone]] != part[q[gone]]]
    a, b = np.minimum(part[p[out]], part[q[out]]), np.maximum(part[p[out]], part[q[out]])
    order = np.lexsort((q[out], p[out], b, a, -value[out]))
    _, first = np.unique((a * n + b)[order], return_index=True)  # of two parts the first edge
    order = order[np.sort(first)]
    kept[out[order[G._forest(a[order], b[order])[2]]]] = True
    return kept


def _heaviest(w: np.ndarray) -> np.ndarray:
    """The edges of a maximum spanning forest, as src * n + dst; equal weights go by (src, dst)."""
    n, out, start = len(w), [], 0
    best, code, free, to = np.zeros(n), np.full(n, n * n), np.ones(n, bool), np.arange(n)
    for _ in range(n):
        top = best.max()
        if top > 0:
            at = np.flatnonzero(best == top)
            v = at[code[at].argmin()]
            out.append(code[v])
        else:  # a tree is done
            v = start = start + int(free[start:].argmax())
        free[v], best[v] = False, 0
        row, own = w[v], np.minimum(to, v) * n + np.maximum(to, v)
        better = free & (row > 0) & ((row > best) | ((row == best) & (own < code)))
        best[better], code[better] = row[better], own[better]
    return np.array(out, int)


def _ranks(m: np.ndarray, p: np.ndarray, d: np.ndarray, w: np.ndarray, documents: int, damping: float, tolerance: float) -> np.ndarray:
    """The ranks of the nodes of *m* and of so many documents, linked by weights *w* from nodes *p* to documents *d*."""
    n, k = len(m), documents
    out = np.concatenate([m.sum(1) + np.bincount(p, w, n), np.bincount(d, w, k)])
    loose, per = out == 0, 1 / np.where(out == 0, 1, out)
    rank = np.full(n + k, 1 / max(1, n + k))
    while True:
        sent = rank * per
        got = np.concatenate([m @ sent[:n] + np.bincount(p, w * sent[n + d], n), np.bincount(d, w * sent[p], k)])
        after = (1 - damping) / (n + k) + damping * (got + rank[loose].sum() / (n + k))
        change, rank = np.abs(after - rank).sum(), after
        if change < tolerance:
            return rank
