"""Pairs within clusters, in bounded blocks, and the weights of a phrase graph's edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasewerk.functions import text as T
from phrasewerk.operators.graph import MOST, log_tails
from phrasewerk.sources.store import written

#: Rows of a block; two blocks meet in one task.
BLOCK = 1_500


def _blocked(rows: DataFrame, cluster: str, key: str) -> DataFrame:
    """Each row once for every pair of its block with a block of its cluster: (..., _i, _j, _mine), _i <= _j, _mine the row's own block."""
    sizes = rows.groupBy(cluster).agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("_blocks"))
    rows = rows.join(sizes, cluster).withColumn("_mine", F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return rows.withColumn("_i", F.least("_mine", "_o")).withColumn("_j", F.greatest("_mine", "_o")).drop("_o", "_blocks")


def _once(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row for each id: of several the least by vector, then by label."""
    if pdf["id"].is_unique:
        return pdf
    order = [(tuple(v), x) for v, x in zip(pdf["v"] if "v" in pdf else [()] * len(pdf), pdf["s"] if "s" in pdf else [""] * len(pdf))]
    return pdf.iloc[sorted(range(len(pdf)), key=lambda i: (pdf["id"].iloc[i], order[i]))].drop_duplicates("id")


def similar_pairs(rows: DataFrame, least: float, key: str = "id", cluster: str = "cluster_id", vector: str = "embedding") -> DataFrame:
    """(cluster, src, dst, cosine): pairs src < dst of a cluster with at least cosine *least*.

    A cluster is cut into blocks by the hash of the key, so no task holds more than two blocks and only pairs beyond
    the threshold leave it. Vectors that are null, empty or all zero, null keys and null clusters take no part; a key
    repeated within a cluster counts once.
    """
    good = rows.where(F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False)) & F.col(key).isNotNull() & F.col(cluster).isNotNull())
    good = good.select(F.col(cluster).alias("c"), F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("float")).alias("v"))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        c, i, j = pdf["c"].iloc[0], pdf["_i"].iloc[0], pdf["_j"].iloc[0]
        pdf = _once(pdf)
        out = []
        width = pdf["v"].map(len)
        for w in width.unique():
            part = pdf[width == w]
            x = np.stack(part["v"].to_numpy()).astype(np.float64)
            x /= np.sqrt((x * x).sum(1))[:, None]
            ids, mine = part["id"].to_numpy(), part["_mine"].to_numpy()
            a, b = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
            s = x[a] @ x[b].T
            p, q = np.nonzero((s >= least) & ((ids[a][:, None] < ids[b][None, :]) if i == j else True))
            left, right = ids[a[p]], ids[b[q]]
            out.append(pd.DataFrame({"cluster": c, "src": np.minimum(left, right), "dst": np.maximum(left, right), "cosine": s[p, q]}))
        return pd.concat(out)

    kind = good.schema["c"].dataType.simpleString()
    found = _blocked(good, "c", "id").groupBy("c", "_i", "_j").applyInPandas(meet, f"cluster {kind}, src long, dst long, cosine double")
    return found.withColumnRenamed("cluster", cluster)


#: Edges whose significance is found at once.
TAILS = 20_000
#: Label pairs whose common subsequences are found at once.
AT_ONCE = 65_536
#: The share of two blocks' pairs from which common subsequences are found for all of them.
MANY = 0.3
_LETTERS = " 0123456789abcdefghijklmnopqrstuvwxyz"


class _Labels:
    """Labels as sorted words, or as they are if *raw*, coded for common subsequences of many pairs at once (bit-parallel, 64 letters in a word)."""

    def __init__(self, labels: list[str], raw: bool = False):
        self.labels, n = labels, len(labels)
        self.size = np.array([len(x) for x in labels], dtype=np.int64)
        width = int(self.size.max(initial=1))
        if raw:
            found, codes = np.unique(np.frombuffer("".join(labels).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), return_inverse=True)
            letters = len(found)
            self.codes = np.zeros((n, width), dtype=np.int32)
            self.codes[np.arange(width) < self.size[:, None]] = codes + 1
        else:
            letters = len(_LETTERS)
            lut = np.zeros(256, dtype=np.uint8)
            lut[[ord(c) for c in _LETTERS]] = np.arange(1, letters + 1)
            self.codes = lut[np.frombuffer("".join(x.ljust(width, "\0") for x in labels).encode("ascii"), dtype=np.uint8).reshape(n, width)]
        self.masks = np.zeros((n, letters + 1), dtype=np.uint64)
        for t in range(min(width, 64)):
            self.masks[np.arange(n), self.codes[:, t]] |= np.uint64(1 << t)
        self.masks[:, 0] = 0  # behind the end

    def counts(self) -> np.ndarray:
        """One row of zeros and ones for each label: the dot product of two is the number of letters they share, at least their common length."""
        held = np.stack([(self.codes == c).sum(1) for c in range(1, len(_LETTERS) + 1)], axis=1)
        return np.concatenate([held > k for k in range(int(held.max(initial=0)))] or [np.zeros((len(held), 1), bool)], axis=1).astype(np.float32)

    def common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Common lengths of the pairs (p[i], q[i])."""
        short = self.size[p] <= self.size[q]
        p, q = np.where(short, p, q), np.where(short, q, p)
        out, flat, codes = np.zeros(len(p), dtype=np.int64), self.masks.ravel(), np.ascontiguousarray(self.codes.T)
        for at in range(0, len(p), AT_ONCE):
            a, b = p[at : at + AT_ONCE], q[at : at + AT_ONCE]
            row, base = np.full(len(a), ~np.uint64(0)), a * self.masks.shape[1]
            for t in range(int(self.size[b].max())):
                hit = row & flat[base + codes[t][b]]
                row = (row + hit) | (row - hit)
            n = np.minimum(self.size[a], 64).astype(np.uint64)
            whole = np.where(n == 64, ~np.uint64(0), (np.uint64(1) << (n % np.uint64(64))) - np.uint64(1))
            out[at : at + AT_ONCE] = self.size[a] - np.bitwise_count(row & whole)
        for i in np.flatnonzero(self.size[p] > 64):
            out[i] = T._common(self.labels[p[i]], self.labels[q[i]])
        return out

    def among(self, a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Common lengths of the pairs (a[p[i]], b[q[i]]), found for all of a with all of b; for pairs of one block, a and b the same, for one half."""
        same = a is b
        by = np.argsort(self.size[b], kind="stable")  # those met at once are about as long
        masks = np.ascontiguousarray(self.masks[a[by] if same else a].T)
        codes, size = np.ascontiguousarray(self.codes[b[by]].T).astype(np.intp), self.size[b[by]]
        own = np.minimum(self.size[a[by] if same else a], 64)
        whole = np.where(own == 64, ~np.uint64(0), (np.uint64(1) << (own.astype(np.uint64) % np.uint64(64))) - np.uint64(1))
        out, lo = np.zeros((len(b), len(a)), dtype=np.int16), 0
        while lo < len(b):
            hi = min(len(b), lo + max(1, AT_ONCE // len(a)))
            n = hi if same else len(a)
            row, held = np.full((hi - lo, n), ~np.uint64(0)), np.ascontiguousarray(masks[:, :n])
            hit, more = np.empty_like(row), np.empty_like(row)
            for t in range(int(size[hi - 1])):
                np.take(held, codes[t, lo:hi], axis=0, out=hit, mode="clip")
                hit &= row
                np.add(row, hit, out=more)
                row -= hit
                row |= more
            out[lo:hi, :n] = own[:n] - np.bitwise_count(row & whole[:n])
            lo = hi
        at = np.empty(len(b), dtype=np.int64)
        at[by] = np.arange(len(b))
        found = (out[np.maximum(at[p], at[q]), np.minimum(at[p], at[q])] if same else out[at[q], p]).astype(np.int64)
        long = np.flatnonzero((self.size[a[p]] > 64) | (self.size[b[q]] > 64))
        found[long] = self.common(a[p[long]], b[q[long]])
        return found

    def similarity(self, p: np.ndarray, q: np.ndarray, added: float, common: np.ndarray | None = None) -> np.ndarray:
        """T.label_similarity of the pairs; with *common* in place of the common lengths."""
        both = (self.size[p] > 0) & (self.size[q] > 0)
        common = self.common(p, q) if common is None else common
        return np.where(both, np.rint(200.0 * common / np.maximum(self.size[p] + self.size[q], 1)), 0.0) / 100 + added


def ratios(labels: list[str]) -> np.ndarray:
    """T.sequence_ratio_of of all pairs, a symmetric matrix."""
    held, n = _Labels(labels, raw=True), len(labels)
    out = np.ones((n, n))
    for lo in range(0, n, BLOCK):
        a = np.arange(lo, min(n, lo + BLOCK))
        for to in range(lo, n, BLOCK):
            b = a if to == lo else np.arange(to, min(n, to + BLOCK))
            p, q = np.triu_indices(len(a), 1) if to == lo else (x.ravel() for x in np.indices((len(a), len(b))))
            whole = held.size[a[p]] + held.size[b[q]]
            both = np.where(whole > 0, 2.0 * held.among(a, b, p, q) / np.maximum(whole, 1), 1.0)
            out[a[p], b[q]] = out[b[q], a[p]] = both
    return out


def _labelled(rows: DataFrame, key: str, cluster: str, label: str, *more: Column) -> DataFrame:
    good = rows.where(F.col(key).isNotNull() & F.col(cluster).isNotNull() & F.col(label).isNotNull())
    return good.select(F.col(cluster).alias("c"), F.col(key).cast("long").alias("id"), T.sorted_words(F.col(label)).alias("s"), *more)


def _sides(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """The ids, the places of the two blocks that meet, and whether they are one block."""
    i, j, mine = pdf["_i"].iloc[0], pdf["_j"].iloc[0], pdf["_mine"].to_numpy()
    return pdf["id"].to_numpy(), np.flatnonzero(mine == i), np.flatnonzero(mine == j), i == j


def _weighable(rows: DataFrame, key: str, cluster: str, vector: str, label: str, *more: Column) -> DataFrame:
    usable = rows.where(F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False)))
    return _labelled(usable, key, cluster, label, F.transform(vector, lambda x: x.cast("float")).alias("v"), *more)


def _weighed(pdf: pd.DataFrame, wc: float, cut_off: float, added: float) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, p, q, cosine, weight) for each width of the vectors of two blocks that meet: the edges between the places p and q of the rows, each once."""
    pdf = _once(pdf)
    width = pdf["v"].map(len)
    for w in width.unique():
        part = pdf[width == w]
        x = np.stack(part["v"].to_numpy()).astype(np.float64)
        x /= np.sqrt((x * x).sum(1))[:, None]
        ids, a, b, same = _sides(part)
        held = _Labels(part["s"].tolist())
        s = x[a] @ x[b].T
        p, q = np.nonzero(((1 - wc) * (1 + added) + wc * s >= cut_off - 1e-9) & ((ids[a][:, None] < ids[b][None, :]) if same else True))
        cosine = s[p, q]
        can = (1 - wc) * held.similarity(a[p], b[q], added, np.minimum(held.size[a[p]], held.size[b[q]])) + wc * cosine >= cut_off
        cosine, p, q = cosine[can], p[can], q[can]
        many = len(p) > MANY * len(a) * len(b) * (0.5 if same else 1)
        common = held.among(a, a if same else b, p, q) if many else None
        p, q = a[p], b[q]
        weight = (1 - wc) * held.similarity(p, q, added, common) + wc * cosine
        good = weight >= cut_off
        yield part, p[good], q[good], cosine[good], weight[good]


def weighted_pairs(rows: DataFrame, weight_on_cosine: float = 0.5, cut_off: float = 0.5, key: str = "id", cluster: str = "cluster_id", vector: str = "embedding", label: str = "label", added: float = 0.05) -> DataFrame:
    """(cluster, src, dst, cosine, weight): every pair src < dst of a cluster with weight = (1 - wc) * label similarity + wc * cosine of at least *cut_off*.

    Blocks as in similar_pairs. A label similarity is at most what the lengths allow (and 1 + *added*), so the common
    subsequence is found only for pairs that can still reach the cut-off; none that reaches it is left out. *rows* holds
    a key of a cluster once; null labels and vectors without direction take no part.
    """
    good, wc = _weighable(rows, key, cluster, vector, label), weight_on_cosine

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        c, out = pdf["c"].iloc[0], [pd.DataFrame({"cluster": [], "src": [], "dst": [], "cosine": [], "weight": []})]
        for part, p, q, cosine, weight in _weighed(pdf, wc, cut_off, added):
            left, right = part["id"].to_numpy()[p], part["id"].to_numpy()[q]
            out.append(pd.DataFrame({"cluster": c, "src": np.minimum(left, right), "dst": np.maximum(left, right), "cosine": cosine, "weight": weight}))
        return pd.concat(out[1:] or out)

    kind = good.schema["c"].dataType.simpleString()
    found = _blocked(good, "c", "id").groupBy("c", "_i", "_j").applyInPandas(meet, f"cluster {kind}, src long, dst long, cosine double, weight double")
    return found.withColumnRenamed("cluster", cluster)


def significances(x: np.ndarray, total: float, p: np.ndarray, q: np.ndarray, weight: np.ndarray, directed: bool = False) -> np.ndarray:
    """graph.significances of edges of a *weight* above 0 between the places p and q, from the nodes' strengths *x* and their graph's weight, both in percent."""
    chance = np.clip(x[p] * x[q] / ((1 if directed else 2) * total * total), 0, 1)
    found = np.empty(len(p))
    k, n = np.rint(weight * 100), np.rint(total)
    for a in range(0, len(p), TAILS):
        at = slice(a, a + TAILS)
        found[at] = np.minimum(MOST, np.abs(log_tails(np.minimum(k[at], n), np.full(len(k[at]), n), chance[at])))
    return found


def pair_significances(rows: DataFrame, weight_on_cosine: float = 0.5, cut_off: float = 0.5, key: str = "id", cluster: str = "cluster_id", vector: str = "embedding", label: str = "label", directed: bool = False, added: float = 0.05) -> DataFrame:
    """(cluster, src, dst, significance): graph.significances of the edges of weighted_pairs, *cut_off* above 0, without a table of edges.

    Blocks meet twice: first only sums of weights at each node leave them, then the edges with their significance.
    """
    if cut_off <= 0:
        raise ValueError("edges need a weight above 0")
    good, wc = written(_weighable(rows, key, cluster, vector, label), "members"), weight_on_cosine
    kind = good.schema["c"].dataType.simpleString()
    # a key repeated within a cluster counts once, as in _once
    once = good.groupBy("c", "id").agg(F.min(F.struct("v", "s")).alias("_r")).select("c", "id", "_r.v", "_r.s") if not good.groupBy("c", "id").count().where("count > 1").isEmpty() else good

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"c": [], "id": [], "x": []})]
        for part, p, q, _, weight in _weighed(pdf, wc, cut_off, added):
            x = np.bincount(p, weight, len(part)) + np.bincount(q, weight, len(part))
            some = np.flatnonzero(x)
            out.append(pd.DataFrame({"c": part["c"].to_numpy()[some], "id": part["id"].to_numpy()[some], "x": x[some]}))
        return pd.concat(out[1:] or out).astype({"c": object})

    strength = _blocked(once, "c", "id").groupBy("c", "_i", "_j").applyInPandas(sums, f"c {kind}, id long, x double")
    strength = written(strength.groupBy("c", "id").agg((F.sum("x") * 100).alias("x")), "strengths")
    total = strength.groupBy("c").agg((F.sum("x") / 2).alias("q"))
    known = once.join(strength, ["c", "id"]).join(total, "c")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        c, out = pdf["c"].iloc[0], [pd.DataFrame({"cluster": [], "src": [], "dst": [], "significance": []})]
        for part, p, q, _, weight in _weighed(pdf, wc, cut_off, added):
            ids, x = part["id"].to_numpy(), part["x"].to_numpy()
            found = significances(x, pdf["q"].iloc[0], p, q, weight, directed)
            left, right = ids[p], ids[q]
            out.append(pd.DataFrame({"cluster": c, "src": np.minimum(left, right), "dst": np.maximum(left, right), "significance": found}))
        return pd.concat(out[1:] or out).astype({"cluster": object})

    found = _blocked(known, "c", "id").groupBy("c", "_i", "_j").applyInPandas(meet, f"cluster {kind}, src long, dst long, significance double")
    return found.withColumnRenamed("cluster", cluster)


def document_ids(documents: str) -> Column:
    """The ids of a list of documents, each once."""
    return F.array_distinct(F.filter(F.coalesce(F.col(documents)["id"], F.array().cast("array<string>")), lambda x: x.isNotNull()))


#: Pairs of nodes of a document that are looked up at once.
LOOKED_UP = 2_000_000


def document_sums(docs: np.ndarray, strength: np.ndarray, degree: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of nodes with lists of documents: what the pairs at a document's nodes weigh, those with both ends in it once; documents without a pair fall out.

    *strength* and *degree* are sums and numbers of the pairs at each node; *m* has the weight of each pair in one of its two places.
    """
    node = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    if not len(node):
        return np.array([], object), np.array([])
    of, names = pd.factorize(np.concatenate(docs))
    order = np.argsort(of, kind="stable")
    of, node = of[order], node[order]
    touched = np.bincount(of, degree[node], len(names)) > 0
    score = np.bincount(of, strength[node], len(names))
    held = np.bincount(of, minlength=len(names))
    first, others = np.cumsum(held) - held, held[of]
    ends, lo = np.cumsum(others), 0
    while lo < len(of):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - others[lo] + LOOKED_UP, side="right")))
        k = others[lo:hi]
        x = np.repeat(np.arange(lo, hi), k)
        y = np.arange(len(x)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(first[of[lo:hi]], k)
        score -= np.bincount(of[x], m[node[x], node[y]], len(names))
        lo = hi
    return names[touched], score[touched]


def document_scores(rows: DataFrame, weight_on_cosine: float = 0.5, cut_off: float = 0.5, key: str = "id", cluster: str = "cluster_id", vector: str = "embedding", label: str = "label", documents: str = "documents", added: float = 0.05) -> DataFrame:
    """(document, cluster, score): for each edge of weighted_pairs its weight for every document (*documents*.id) of either end, counted once.

    The edges of two blocks are added up in the task in which these meet, so none leaves it: a document has what the
    edges at its nodes weigh, less the edges that have both ends in it.
    """
    ids = document_ids(documents)
    good, wc = _weighable(rows, key, cluster, vector, label, ids.alias("docs")), weight_on_cosine

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        c, out = pdf["c"].iloc[0], [pd.DataFrame({"cluster": [], "document": [], "score": []})]
        for part, p, q, _, weight in _weighed(pdf, wc, cut_off, added):
            n, docs = len(part), part["docs"].to_numpy()
            if not len(p):
                continue
            m = np.zeros((n, n))
            m[p, q] = weight
            names, score = document_sums(docs, np.bincount(p, weight, n) + np.bincount(q, weight, n), np.bincount(p, minlength=n) + np.bincount(q, minlength=n), m)
            out.append(pd.DataFrame({"cluster": c, "document": names, "score": score}))
        return pd.concat(out[1:] or out).astype({"cluster": object, "document": object})  # strings of several frames as one array

    kind = good.schema["c"].dataType.simpleString()
    found = _blocked(good, "c", "id").groupBy("c", "_i", "_j").applyInPandas(meet, f"cluster {kind}, document string, score double")
    return found.groupBy("document", F.col("cluster").alias(cluster)).agg(F.sum("score").alias("score"))


def close_labels(rows: DataFrame, least: float = 0.95, key: str = "id", cluster: str = "cluster_id", label: str = "label", added: float = 0.05) -> DataFrame:
    """(cluster, src, dst, similarity): every pair src < dst of a cluster with label similarity of at least *least*, whatever else differs.

    Blocks as in similar_pairs. Two labels have no longer subsequence in common than they share letters, so it is found
    only for pairs whose letters allow *least*. *rows* holds a key of a cluster once; null labels take no part.
    """
    good = _labelled(rows, key, cluster, label)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        c, pdf = pdf["c"].iloc[0], _once(pdf).reset_index(drop=True)
        ids, a, b, same = _sides(pdf)
        held = _Labels(pdf["s"].tolist())
        letters = held.counts()
        shared = (letters[a] @ letters[b].T).astype(np.int64)
        size = held.size[a][:, None] + held.size[b][None, :]
        most = np.where(shared > 0, np.rint(200.0 * shared / np.maximum(size, 1)), 0.0) / 100 + added
        p, q = np.nonzero((most >= least) & ((ids[a][:, None] < ids[b][None, :]) if same else True))
        p, q = a[p], b[q]
        similarity = held.similarity(p, q, added)
        left, right = ids[p], ids[q]
        return pd.DataFrame({"cluster": c, "src": np.minimum(left, right), "dst": np.maximum(left, right), "similarity": similarity})[similarity >= least]

    kind = good.schema["c"].dataType.simpleString()
    found = _blocked(good, "c", "id").groupBy("c", "_i", "_j").applyInPandas(meet, f"cluster {kind}, src long, dst long, similarity double")
    return found.withColumnRenamed("cluster", cluster)


def edge_weights(edges: DataFrame, labels: DataFrame, weight_on_cosine: float = 0.5, cut_off: float = 0.5, added: float = 0.05) -> DataFrame:
    """*edges* (graph_id, src, dst, cosine) with weight = (1 - wc) * label similarity + wc * cosine, those under *cut_off* left out (negative ones too)."""
    a = labels.select("graph_id", F.col("node_id").alias("src"), F.col("label").alias("_a"))
    b = labels.select("graph_id", F.col("node_id").alias("dst"), F.col("label").alias("_b"))
    both = edges.join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"])
    similarity = T.label_similarity(F.col("_a"), F.col("_b"), added)
    weighted = both.withColumn("weight", (1 - weight_on_cosine) * similarity + weight_on_cosine * F.col("cosine"))
    return weighted.where(F.col("weight") >= cut_off).select("graph_id", "src", "dst", "cosine", "weight")


def merged_phrases(similar: DataFrame, nodes: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(graph_id, removed, kept) of near-duplicate labels: of each pair the phrase with fewer documents goes (tie: the larger id).

    *similar* has graph_id, src, dst, similarity; *nodes* graph_id, node_id, n_documents. The best of a phrase's winners
    is its partner; winners that go themselves are replaced by theirs until all kept phrases stay.
    """
    rank = nodes.select("graph_id", F.col("node_id").alias("n"), F.struct(F.col("n_documents").alias("d"), (-F.col("node_id")).alias("i")).alias("r"))
    pairs = similar.where(F.col("similarity") >= threshold).select("graph_id", "src", "dst")
    pairs = pairs.join(rank.toDF("graph_id", "src", "rs"), ["graph_id", "src"]).join(rank.toDF("graph_id", "dst", "rd"), ["graph_id", "dst"])
    loses = F.col("rs") < F.col("rd")
    lost = pairs.select("graph_id", F.when(loses, F.col("src")).otherwise(F.col("dst")).alias("removed"), F.greatest("rs", "rd").alias("w"))
    step = lost.groupBy("graph_id", "removed").agg((-F.max("w")["i"]).alias("kept"))
    while True:
        following = step.select("graph_id", F.col("removed").alias("kept"), F.col("kept").alias("further"))
        longer = step.join(following, ["graph_id", "kept"], "left").select("graph_id", "removed", F.coalesce("further", "kept").alias("kept"), F.col("further").isNotNull().alias("moved"))
        longer = written(longer, "merged")
        step = longer.drop("moved")
        if longer.where("moved").isEmpty():
            return step
