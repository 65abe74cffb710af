"""Queries on vectors, concepts and cluster quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from phrasewerk.functions import vectors as VF
from phrasewerk.operators import concepts as C
from phrasewerk.operators import metrics as M
from phrasewerk.plans.registry import query
from phrasewerk.tables import table

_CENTRES = """
v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(v[i]) AS m FROM (SELECT label, v, unnest(range(1, len(v) + 1)) AS i FROM v) GROUP BY 1, 2) GROUP BY 1)"""


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def _centres(spark, sf_dir):
    return C.centres(_vectors(spark, sf_dir), "label", "embedding")


@query("prj16_embedding_statistics", "SELECT count(*) AS n, max(len(embedding)) AS dim FROM embeddings")
def prj16_embedding_statistics(spark, sf_dir):
    return _vectors(spark, sf_dir).agg(F.count("*").alias("n"), F.max(F.size("embedding")).cast("long").alias("dim"))


@query("sc01_cosine_to_own_centre", "WITH" + _CENTRES + " SELECT vec_id, label, round(list_cosine_similarity(v, c), 6) AS cosine FROM v JOIN c USING (label)")
def sc01_cosine_to_own_centre(spark, sf_dir):
    rows = _vectors(spark, sf_dir).join(_centres(spark, sf_dir), "label")
    return rows.select("vec_id", "label", F.round(VF.cosine(F.col("embedding"), F.col("center")), 6).alias("cosine"))


@query("jn05_near_own_centre", "WITH" + _CENTRES + " SELECT vec_id, label, round(list_cosine_similarity(v, c), 6) AS cosine FROM v JOIN c USING (label) WHERE list_cosine_similarity(v, c) >= 0.3")
def jn05_near_own_centre(spark, sf_dir):
    near = C.near_own_centre(_vectors(spark, sf_dir), _centres(spark, sf_dir), "label", "embedding", 0.3)
    return near.select("vec_id", "label", F.round("cosine", 6).alias("cosine"))


@query("jn04_near_centres", "WITH" + _CENTRES + " SELECT c.label, vec_id, round(list_cosine_similarity(v, c), 6) AS cosine FROM v CROSS JOIN c WHERE list_cosine_similarity(v, c) >= 0.2")
def jn04_near_centres(spark, sf_dir):
    near = C.near_centres(_vectors(spark, sf_dir), _centres(spark, sf_dir), "label", "vec_id", "embedding", 0.2)
    return near.withColumn("cosine", F.round("cosine", 6))


@query("tk02_representatives", "WITH" + _CENTRES + """, n AS (SELECT c.label, vec_id, list_cosine_similarity(v, c) AS cosine FROM v CROSS JOIN c WHERE list_cosine_similarity(v, c) >= 0.1)
SELECT label, vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY cosine DESC, vec_id) AS rank FROM n) WHERE rank <= 15""")
def tk02_representatives(spark, sf_dir):
    near = C.near_centres(_vectors(spark, sf_dir), _centres(spark, sf_dir), "label", "vec_id", "embedding", 0.1)
    return C.representatives(near, "label", "vec_id", 15).select("label", "vec_id", "rank")


@query("gr04_selected_clusters", "WITH" + _CENTRES + """, n AS (SELECT c.label, vec_id FROM v CROSS JOIN c WHERE list_cosine_similarity(v, c) >= 0.2 AND c.label NOT IN (0, 3)),
s AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS graph_id FROM (SELECT label FROM n GROUP BY 1 HAVING count(*) >= 5))
SELECT graph_id, label, vec_id FROM n JOIN s USING (label)""")
def gr04_selected_clusters(spark, sf_dir):
    near = C.near_centres(_vectors(spark, sf_dir), _centres(spark, sf_dir), "label", "vec_id", "embedding", 0.2)
    return C.selected_clusters(near, "label", 5, [0, 3]).select("graph_id", "label", "vec_id")


_ASSIGNED = """, a AS (SELECT vec_id, v.label, arg_max(c.label, struct_pack(s := round(list_cosine_similarity(v, c), 9), l := -c.label)) AS cluster FROM v CROSS JOIN c GROUP BY 1, 2),
m AS (SELECT cluster, label, count(*) AS n FROM a GROUP BY 1, 2)"""


def _assigned(spark, sf_dir):
    best = C.nearest_centre(_vectors(spark, sf_dir), _centres(spark, sf_dir), "label", "vec_id", "embedding").withColumnRenamed("label", "cluster")
    return best.join(_vectors(spark, sf_dir).select("vec_id", "label"), "vec_id")


@query("ag10_purity", "WITH" + _CENTRES + _ASSIGNED + " SELECT round(sum(top) / sum(n), 6) AS purity FROM (SELECT cluster, max(n) AS top, sum(n) AS n FROM m GROUP BY 1)")
def ag10_purity(spark, sf_dir):
    return M.purity(_assigned(spark, sf_dir), "cluster", "label").select(F.round("purity", 6).alias("purity"))


@query("ag11_adjusted_rand", "WITH" + _CENTRES + _ASSIGNED + """, x AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM m) AS b, (SELECT sum(t * (t - 1) / 2) FROM (SELECT sum(n) AS t FROM m GROUP BY cluster)) AS r,
(SELECT sum(t * (t - 1) / 2) FROM (SELECT sum(n) AS t FROM m GROUP BY label)) AS c, (SELECT sum(n) FROM m) AS n)
SELECT round((b - r * c / (n * (n - 1) / 2)) / ((r + c) / 2 - r * c / (n * (n - 1) / 2)), 6) AS ari FROM x""")
def ag11_adjusted_rand(spark, sf_dir):
    return M.adjusted_rand(_assigned(spark, sf_dir), "cluster", "label").select(F.round("ari", 6).alias("ari"))


@query("ag09_fused_scores", "SELECT event_type, user_id, round(2 * avg(value) * count(*) / nullif(avg(value) + count(*), 0), 5) AS fused FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def ag09_fused_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("value is not null")
    return M.harmonic(rows, ["event_type", "user_id"], "value").select("event_type", "user_id", F.round("fused", 5).alias("fused"))


@query("tk01_top_cosine", "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: x <> 0)) > 0), o AS (SELECT v AS o FROM v WHERE vec_id = (SELECT min(vec_id) FROM v)) SELECT vec_id, round(list_cosine_similarity(v, o), 6) AS cosine FROM v, o ORDER BY list_cosine_similarity(v, o) DESC, vec_id LIMIT 20")
def tk01_top_cosine(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    first = rows.where(VF.usable(F.col("embedding"))).orderBy("vec_id").first()
    return C.top_cosine(rows, first.embedding if first else [], "vec_id", "embedding", top=20).withColumn("cosine", F.round("cosine", 6))


@query("ml04_k_means")
def ml04_k_means(spark, sf_dir):
    return C.k_means(_vectors(spark, sf_dir), "vec_id", "embedding", 10)


@query("ml04_mini_batch")
def ml04_mini_batch(spark, sf_dir):
    return C.clustered(_vectors(spark, sf_dir), "vec_id", "embedding", "kmeans-mb", 10)


@query("ml04_affinity")
def ml04_affinity(spark, sf_dir):
    """Exemplars within each label."""
    return C.affinity_clusters(_vectors(spark, sf_dir).where("label is not null"), "label", "vec_id", "embedding")


@query("ml03_reduced")
def ml03_reduced(spark, sf_dir):
    """The vectors on their first two principal components."""
    return C.reduced(_vectors(spark, sf_dir), "vec_id", "embedding", 2)


@query("ml06_chosen_k")
def ml06_chosen_k(spark, sf_dir):
    """Every number of clusters from 2 to 99 on 15 samples."""
    return spark.createDataFrame([(C.chosen_k(_vectors(spark, sf_dir), "embedding"),)], "k int")


@query("ag13_concept_phrases", "WITH" + _CENTRES + """, n AS (SELECT c.label, vec_id, list_cosine_similarity(v, c) AS cosine FROM v CROSS JOIN c WHERE list_cosine_similarity(v, c) >= 0.1),
r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY cosine DESC, vec_id) AS rank FROM n)
SELECT label, string_agg('v' || vec_id, ' ' ORDER BY rank) AS phrases FROM r WHERE rank <= 15 GROUP BY 1""")
def ag13_concept_phrases(spark, sf_dir):
    near = C.near_centres(_vectors(spark, sf_dir), _centres(spark, sf_dir), "label", "vec_id", "embedding", 0.1)
    names = _vectors(spark, sf_dir).select("vec_id", F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("text"))
    return C.concept_phrases(C.representatives(near, "label", "vec_id", 15), names, "label", "vec_id", "text").withColumn("phrases", F.array_join("phrases", " "))
