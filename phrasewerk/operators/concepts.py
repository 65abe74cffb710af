"""Concepts: centres of clusters, the phrases near them, and models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from phrasewerk.functions import vectors as VF
from phrasewerk.operators.graph import exemplars
from phrasewerk.operators.metrics import harmonic
from phrasewerk.operators.numbering import numbered

#: Centres up to this number are sent to every task (at 64 values: 16 MB); beyond it they come in blocks.
CENTRES = 32_768


def centres(rows: DataFrame, cluster: str, vector: str) -> DataFrame:
    """(cluster, center): the mean vector of each cluster; element by element, so partial sums are added up before the shuffle."""
    each = rows.where(VF.usable(F.col(vector)) & F.col(cluster).isNotNull()).select(cluster, F.posexplode(vector).alias("i", "x"))
    mean = each.groupBy(cluster, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return mean.groupBy(cluster).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("center"))


def near_own_centre(rows: DataFrame, centre: DataFrame, cluster: str, vector: str, distance: float) -> DataFrame:
    """Rows with cosine to the centre of their own cluster, those of at least *distance*."""
    return rows.join(centre, cluster).withColumn("cosine", VF.cosine(F.col(vector), F.col("center"))).where(F.col("cosine") >= distance).drop("center")


def near_centres(rows: DataFrame, centre: DataFrame, cluster: str, key: str, vector: str, distance: float, block: int = CENTRES) -> DataFrame:
    """(cluster, key, cosine): every row with each centre of at least cosine *distance*; a block of centres at a time is sent to the tasks."""
    kind = centre.schema[cluster].dataType.simpleString()
    good = rows.where(VF.usable(F.col(vector))).select(F.col(key).cast("long").alias(key), F.col(vector).alias("_v"))
    out = None
    for names, c in _blocks(centre, cluster, block):
        sent = rows.sparkSession.sparkContext.broadcast((names, c))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            names, c = sent.value
            for pdf in batches:
                pdf = pdf[pdf["_v"].map(len) == c.shape[1]]
                if not len(pdf):
                    continue
                x = np.stack(pdf["_v"].to_numpy()).astype(float)
                s = (x / np.sqrt((x * x).sum(1))[:, None]) @ c.T
                i, j = np.nonzero(s >= distance)
                yield pd.DataFrame({cluster: [names[k] for k in j], key: pdf[key].to_numpy()[i], "cosine": s[i, j]})

        got = good.mapInPandas(run, f"{cluster} {kind}, {key} long, cosine double")
        out = got if out is None else out.unionByName(got)
    return out


def nearest_centre(rows: DataFrame, centre: DataFrame, cluster: str, key: str, vector: str, digits: int = 9, block: int = CENTRES) -> DataFrame:
    """(key, cluster, cosine): each row's closest centre, cosines equal to *digits* going to the smaller cluster. The best is taken where the row lies; blocks of centres meet in one more step."""
    kind = centre.schema[cluster].dataType.simpleString()
    good = rows.where(VF.usable(F.col(vector))).select(F.col(key).cast("long").alias(key), F.col(vector).alias("_v"))
    out = None
    for names, c in _blocks(centre, cluster, block):
        sent = rows.sparkSession.sparkContext.broadcast((names, c))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            names, c = sent.value
            for pdf in batches:
                pdf = pdf[pdf["_v"].map(len) == c.shape[1]]
                if len(pdf) and len(names):
                    x = np.stack(pdf["_v"].to_numpy()).astype(float)
                    s = np.round((x / np.sqrt((x * x).sum(1))[:, None]) @ c.T, digits)
                    best = s.argmax(1)  # the first of equal ones: names are in order
                    yield pd.DataFrame({key: pdf[key].to_numpy(), cluster: [names[j] for j in best], "cosine": s[np.arange(len(s)), best]})

        got = good.mapInPandas(run, f"{key} long, {cluster} {kind}, cosine double")
        out = got if out is None else out.unionByName(got)
    if centre.limit(block + 1).count() <= block:
        return out
    order = Window.partitionBy(key).orderBy(F.desc("cosine"), cluster)
    return out.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def nearest(rows: DataFrame, asks: DataFrame, key: str, vector: str, group: str, k: int = 10, block: int = CENTRES) -> DataFrame:
    """(key, other, cosine, rank): the *k* rows of its group most similar to each asking row, itself left out, ties by the smaller key.

    Exact: all rows are scanned for the stated asking rows, a block of those at a time; each batch keeps its k best
    before anything is shuffled. Rows without a direction take no part; rows repeated under one key count once.
    """
    kind = rows.schema[group].dataType.simpleString()
    usable = lambda df: df.where(VF.usable(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), F.col(group).alias("_g"), F.col(vector).alias("_v"))
    asked = usable(asks).groupBy(key).agg(F.min(F.struct("_g", "_v")).alias("m")).select(key, "m._g", "m._v")
    n = asked.count()
    out = None
    for b in range(max(1, -(-n // block))):
        part = asked.where(F.pmod(F.xxhash64(key), F.lit(max(1, -(-n // block)))) == b).toPandas()
        sent = rows.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            asked = {g: own for g, own in sent.value.groupby(["_g", sent.value["_v"].map(len)])} if len(sent.value) else {}
            for pdf in batches:
                for g, own in pdf.groupby(["_g", pdf["_v"].map(len)]):
                    if g not in asked:
                        continue
                    unit = lambda v: (m := np.stack(v.to_numpy()).astype(float)) / np.sqrt((m * m).sum(1))[:, None]
                    s = unit(asked[g]["_v"]) @ unit(own["_v"]).T
                    q, ids = asked[g][key].to_numpy(), own[key].to_numpy()
                    s[q[:, None] == ids[None, :]] = -2
                    if s.shape[1] > 2 * k:  # all that may be among the k best, ties too; deliveries repeat a row
                        i, j = np.nonzero((s >= np.partition(s, -2 * k, axis=1)[:, -2 * k][:, None]) & (s > -2))
                    else:
                        i, j = np.nonzero(s > -2)
                    yield pd.DataFrame({key: q[i], "other": ids[j], "cosine": s[i, j]})

        got = usable(rows).mapInPandas(run, f"{key} long, other long, cosine double")
        out = got if out is None else out.unionByName(got)
    once = out.groupBy(key, "other").agg(F.max(F.round("cosine", 12)).alias("cosine"))
    order = Window.partitionBy(key).orderBy(F.desc("cosine"), "other")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(centre: DataFrame, cluster: str, block: int) -> Iterator[tuple[list, np.ndarray]]:
    """The centres in order, *block* at a time, with their directions."""
    n = centre.count()
    numbers = numbered(centre, [cluster], "_nr") if n > block else centre.withColumn("_nr", F.lit(0))
    for b in range(max(1, -(-n // block))):
        part = numbers.where(F.floor(F.col("_nr") / block) == b).select(cluster, "center").orderBy(cluster).toPandas()
        c = np.stack([np.asarray(x, float) for x in part["center"]]) if len(part) else np.zeros((0, 1))
        yield part[cluster].tolist(), c / np.maximum(np.sqrt((c * c).sum(1)), 1e-300)[:, None]


def representatives(near: DataFrame, cluster: str, key: str, top: int) -> DataFrame:
    """The *top* rows of each concept by cosine, ties by key, with rank."""
    order = Window.partitionBy(cluster).orderBy(F.desc("cosine"), key)
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def selected_clusters(near: DataFrame, cluster: str, min_size: int = 1, excluded: list | None = None) -> DataFrame:
    """*near* without excluded and small clusters, with graph_id from 0 on in order of the cluster."""
    kept = near.where(~F.col(cluster).isin(excluded)) if excluded else near
    sizes = kept.groupBy(cluster).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_size)
    ids = numbered(sizes.drop("_n"), [cluster], "graph_id")
    return kept.join(ids, cluster)


def _features(rows: DataFrame, vector: str, *keep: str) -> DataFrame:
    return rows.where(VF.usable(F.col(vector))).select(*keep, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"))


def k_means(rows: DataFrame, key: str, vector: str, k: int = 50, seed: int = 1) -> DataFrame:
    """(key, cluster_id) by k-means on the usable vectors."""
    good = _features(rows, vector, key)
    if good.isEmpty():
        return good.select(key, F.lit(0).alias("cluster_id"))
    return KMeans(k=k, seed=seed, maxIter=15).fit(good).transform(good).select(key, F.col("prediction").alias("cluster_id"))


def mini_batch_k_means(rows: DataFrame, key: str, vector: str, k: int = 50, batch: int = 4_096, steps: int = 20, seed: int = 1) -> DataFrame:
    """(key, cluster_id) by k-means on small batches: centres are fitted to *steps* batches chosen by the hash of the key, then every row goes to its closest centre."""
    good = rows.where(VF.usable(F.col(vector)) & F.col(key).isNotNull())
    n = good.count()
    share = min(1.0, batch * steps / max(1, n))
    sample = good.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * share)).select(key, vector).limit(2 * batch * steps).toPandas().sort_values(key)
    if not len(sample):
        return good.select(key, F.lit(0).alias("cluster_id"))
    x, rng = np.stack(sample[vector].to_numpy()).astype(float), np.random.RandomState(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    seen = np.zeros(len(c))
    for _ in range(steps):
        some = x[rng.choice(len(x), min(batch, len(x)), replace=False)]
        at = ((c * c).sum(1)[None, :] - 2 * some @ c.T).argmin(1)
        sums = np.stack([np.bincount(at, weights=some[:, d], minlength=len(c)) for d in range(x.shape[1])], axis=1)
        m = np.bincount(at, minlength=len(c))
        seen += m
        c = np.where((m > 0)[:, None], c + (sums - m[:, None] * c) / np.maximum(seen, 1)[:, None], c)
    sent = rows.sparkSession.sparkContext.broadcast(c)

    @F.pandas_udf("int")
    def closest(vs: pd.Series) -> pd.Series:
        own, y = sent.value, np.stack(vs.to_numpy()).astype(float)
        return pd.Series(((own * own).sum(1)[None, :] - 2 * y @ own.T).argmin(1).astype(np.int32))

    return good.select(key, closest(F.col(vector)).alias("cluster_id"))


def affinity_clusters(rows: DataFrame, group: str, key: str, vector: str, damping: float = 0.5, rounds: int = 200) -> DataFrame:
    """(group, key, exemplar) by affinity propagation over minus the squared distance; each group in one task, so for groups of a few thousand rows. Where the messages do not settle every row is its own."""
    kind = rows.schema[group].dataType.simpleString()
    good = rows.where(VF.usable(F.col(vector))).select(F.col(group).alias("g"), F.col(key).cast("long").alias("k"), F.col(vector).alias("v"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k").drop_duplicates("k")
        x, ids = np.stack(pdf["v"].to_numpy()).astype(float), pdf["k"].to_numpy()
        square = (x * x).sum(1)
        owner = exemplars(-np.maximum(square[:, None] + square[None, :] - 2 * x @ x.T, 0), damping, rounds)
        return pd.DataFrame({"g": pdf["g"].iloc[0], "k": ids, "e": ids if owner is None else ids[owner]})

    return good.groupBy("g").applyInPandas(run, f"g {kind}, k long, e long").toDF(group, key, "exemplar")


#: Clusterings by name; an unknown one is k-means.
CLUSTERINGS = {"kmeans": k_means, "kmeans-mb": mini_batch_k_means}


def clustered(rows: DataFrame, key: str, vector: str, algorithm: str = "kmeans", k: int | None = None, seed: int = 1) -> DataFrame:
    """(key, cluster_id) by the named algorithm on the vectors as they are; 50 clusters where none are asked for."""
    if algorithm == "affinity-prop":
        return affinity_clusters(rows.withColumn("_all", F.lit(0)), "_all", key, vector).select(key, F.col("exemplar").alias("cluster_id"))
    return CLUSTERINGS.get(algorithm, k_means)(rows, key, vector, 50 if k is None else k, seed=seed)


def reduced(rows: DataFrame, key: str, vector: str, dims: int = 2) -> DataFrame:
    """(key, reduced): the usable vectors on their *dims* first principal components; used to choose a number of clusters, not to cluster."""
    good = _features(rows, vector, key)
    if good.isEmpty():
        return good.select(key, F.array().cast("array<double>").alias("reduced"))
    return PCA(k=dims, inputCol="features", outputCol="pc").fit(good).transform(good).select(key, vector_to_array("pc").alias("reduced"))


def chosen_k(rows: DataFrame, vector: str, k_min: int = 2, k_max: int = 100, samples: int = 15, sample_fraction: float = 25, degree: int = 5, seed: int = 1, most: int = 20_000) -> int:
    """The number of clusters whose fitted silhouette is best: every k in [k_min, k_max) scored on each of *samples* random subsets, a polynomial through the scores of each, the mean of their best k.

    A subset has a *sample_fraction*-th of the rows, at most *most* of them (a documented bound of the fit), and at
    least as many as two for each cluster. Subsets are scored in parallel, one in a task.
    """
    good = rows.where(VF.usable(F.col(vector))).select(F.col(vector).alias("v"))
    n = good.count()
    if n < 3:
        return max(1, n)
    size = int(min(most, n, max(n / sample_fraction, 2 * k_max)))
    share = min(1.0, 1.2 * size / n)
    parts = None
    for s in range(samples):
        part = good.sample(share, seed + s).select(F.lit(s).alias("s"), "v").limit(size)
        parts = part if parts is None else parts.unionByName(part)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["v"].to_numpy()).astype(float)
        ks = list(range(k_min, min(k_max, len(x) - 1)))
        if not ks:
            return pd.DataFrame({"s": pdf["s"].iloc[:1], "k": [min(k_min, len(x))]})
        scores = [silhouette(x, lloyd(x, k, seed)) for k in ks]
        return pd.DataFrame({"s": pdf["s"].iloc[:1], "k": [best_of_fit(ks, scores, degree)]})

    best = parts.groupBy("s").applyInPandas(run, "s int, k int").toPandas()
    return int(round(best["k"].mean()))


def best_of_fit(ks: list[int], scores: list[float], degree: int) -> int:
    """The k at which a polynomial through the scores is largest."""
    fit = np.polyval(np.polyfit(np.array(ks, float) - ks[0], scores, min(degree, len(ks) - 1)), np.array(ks, float) - ks[0])
    return ks[int(fit.argmax())]


def lloyd(x: np.ndarray, k: int, seed: int = 1, rounds: int = 15) -> np.ndarray:
    """The cluster of each row by k-means: spread-out first centres, then means in turn."""
    rng = np.random.RandomState(seed + k)
    c = x[[rng.randint(len(x))]]
    far = ((x - c[0]) ** 2).sum(1)
    for _ in range(1, k):
        total = far.sum()
        i = rng.choice(len(x), p=far / total) if total > 0 else rng.randint(len(x))
        c = np.vstack([c, x[i]])
        far = np.minimum(far, ((x - x[i]) ** 2).sum(1))
    at = np.zeros(len(x), int)
    for _ in range(rounds):
        new = ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)
        if (new == at).all() and _:
            break
        at = new
        sums, m = np.zeros_like(c), np.bincount(at, minlength=k)
        np.add.at(sums, at, x)
        c = np.where((m > 0)[:, None], sums / np.maximum(m, 1)[:, None], c)
    return at


def silhouette(x: np.ndarray, at: np.ndarray) -> float:
    """The mean silhouette by squared distances, from sums over clusters; 0 for one cluster."""
    present, at = np.unique(at, return_inverse=True)
    if len(present) < 2:
        return 0.0
    m, square = np.bincount(at), (x * x).sum(1)
    sums = np.zeros((len(present), x.shape[1]))
    np.add.at(sums, at, x)
    mean = square[:, None] + (np.bincount(at, weights=square) / m)[None, :] - 2 * x @ (sums / m[:, None]).T
    rows = np.arange(len(x))
    own = np.where(m[at] > 1, mean[rows, at] * m[at] / np.maximum(m[at] - 1, 1), 0)
    mean[rows, at] = np.inf
    other = mean.min(1)
    return float(np.where(m[at] > 1, (other - own) / np.maximum(np.maximum(own, other), 1e-300), 0).mean())


def distortion(x: np.ndarray, at: np.ndarray) -> float:
    """Minus the sum of squared distances to the means: larger is better, as for the other scores."""
    return -float(sum(((x[at == k] - x[at == k].mean(0)) ** 2).sum() for k in np.unique(at)))


def calinski_harabasz(x: np.ndarray, at: np.ndarray) -> float:
    """Spread between clusters over spread within them, each over its degrees of freedom; 0 for one cluster."""
    ks = np.unique(at)
    if len(ks) < 2 or len(ks) >= len(x):
        return 0.0
    between = sum((at == k).sum() * ((x[at == k].mean(0) - x.mean(0)) ** 2).sum() for k in ks)
    return float(between / max(-distortion(x, at), 1e-300) * (len(x) - len(ks)) / (len(ks) - 1))


def top_cosine(rows: DataFrame, one: list[float], key: str, vector: str, top: int | None = None, distance: float = 0.7) -> DataFrame:
    """(key, cosine) to the vector *one*: the *top* best whatever their cosine, or all of at least *distance*; best first, ties by key."""
    scored = rows.where(VF.usable(F.col(vector))).select(key, VF.cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in one]).cast("array<double>")).alias("cosine"))
    if top is None:
        return scored.where(F.col("cosine") >= distance).orderBy(F.desc("cosine"), key)
    return scored.where("cosine is not null").orderBy(F.desc("cosine"), key).limit(top)


def predicted_graphs(near: DataFrame, entries: DataFrame, ask: str, other: str, share: float = 0.5) -> DataFrame:
    """(ask, graph, fused): the graphs of each row's neighbours whose score is at least *share* of the best, by fused score."""
    labels = entries.select(F.col("entry_id").alias(other), F.explode("graph_cluster").alias("graph")).where("graph is not null").distinct()
    near = near.select(ask, other, "cosine")
    top = near.groupBy(ask).agg(F.max("cosine").alias("_top"))
    kept = near.join(top, ask).where(F.col("cosine") >= share * F.col("_top"))
    return harmonic(kept.join(labels, other), [ask, "graph"], "cosine").select(ask, "graph", "fused")


def best_graph(predicted: DataFrame, ask: str) -> DataFrame:
    """(ask, graph, fused): the best graph of each row, ties by the graph's name."""
    top = predicted.groupBy(ask).agg(F.max("fused").alias("fused"))
    return predicted.join(top, [ask, "fused"]).groupBy(ask, "fused").agg(F.min("graph").alias("graph")).select(ask, "graph", "fused")


def concept_phrases(ranked: DataFrame, names: DataFrame, cluster: str, key: str, text: str) -> DataFrame:
    """(cluster, phrases): the representatives of each concept as one list in order of rank; as long as the rank was cut."""
    rows = ranked.join(names.select(key, text), key)
    by = rows.groupBy(cluster).agg(F.sort_array(F.collect_list(F.struct("rank", text))).alias("p"))
    return by.select(cluster, F.col("p")[text].alias("phrases"))
