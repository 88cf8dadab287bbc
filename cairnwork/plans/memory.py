"""Queries on memory-like records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import memory as ops
from .registry import query

_COS = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))".replace("{", "<").replace("}", ">")
_cos = lambda a, b: _COS.replace("<a>", a).replace("<b>", b)


def _query_vector(t):
    return t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q"))


@query(f"SELECT vec_id, ROUND({_cos('embedding', 'q')}, 6) AS score FROM {{embeddings}}, (SELECT embedding AS q FROM {{embeddings}} WHERE vec_id = 0) ORDER BY 2 DESC, 1 LIMIT 10")
def vector_search_topk(t):
    return ops.vector_search(t.embeddings, _query_vector(t), 10, "vec_id")


@query(f"SELECT label, vec_id, score FROM (SELECT label, vec_id, score, ROW_NUMBER() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS n FROM (SELECT label, vec_id, ROUND({_cos('embedding', 'q')}, 6) AS score FROM {{embeddings}}, (SELECT embedding AS q FROM {{embeddings}} WHERE vec_id = 0))) WHERE n <= 5")
def vector_search_by_type(t):
    from pyspark.sql import Window as W

    scored = t.embeddings.crossJoin(F.broadcast(_query_vector(t).limit(1))).select("label", "vec_id", F.round(scalars.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))
    return scored.withColumn("n", F.row_number().over(W.partitionBy("label").orderBy(F.col("score").desc(), "vec_id"))).where("n <= 5").drop("n")


@query(
    """SELECT vec_id, ROUND(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS dot_product, ROUND(list_distance(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS euclidean,
    ROUND(list_sum(list_transform(range(1, 1 + len(q)), lambda i: abs(CAST(embedding[i] AS DOUBLE) - CAST(q[i] AS DOUBLE)))), 6) AS manhattan FROM {embeddings}, (SELECT embedding AS q FROM {embeddings} WHERE vec_id = 0)"""
)
def vector_metrics(t):
    both = t.embeddings.crossJoin(F.broadcast(_query_vector(t).limit(1)))
    a, b = F.col("embedding"), F.col("q")
    return both.select("vec_id", *[F.round(f(a, b), 6).alias(n) for n, f in (("dot_product", scalars.dot), ("euclidean", scalars.euclidean), ("manhattan", scalars.manhattan))])


@query("SELECT id, ROUND(importance, 6) AS importance FROM {memory} WHERE lifecycle <> 'Forgotten' AND (lower(key) LIKE '%src1%' OR lower(value) LIKE '%src1%' OR lower(lang) LIKE '%src1%')")
def memory_text_search(t):
    """The most important first."""
    return ops.text_search(t.memory, "SRC1").select("id", F.round("importance", 6).alias("importance")).orderBy(F.col("importance").desc(), "id")


@query("SELECT memory_type, lifecycle, COUNT(*) AS entries, ROUND(AVG(importance), 6) AS mean_importance FROM {memory} GROUP BY 1, 2")
def memory_counts(t):
    return t.memory.groupBy("memory_type", "lifecycle").agg(F.count("*").alias("entries"), F.round(F.avg("importance"), 6).alias("mean_importance"))


@query("SELECT id, ROUND(importance, 6) AS importance, access_count FROM {memory} WHERE memory_type = 2 AND lifecycle <> 'Forgotten'")
def memory_by_type(t):
    return t.memory.where("memory_type = 2 AND lifecycle <> 'Forgotten'").select("id", F.round("importance", 6).alias("importance"), "access_count")


@query("SELECT id, memory_type, CAST(FLOOR(importance * 1000 + 1e-9) AS INT) AS importance_scaled, access_count, 2 AS tags, sha256(key || value) AS hash FROM {memory}")
def memory_index_records(t):
    return t.memory.select("id", "memory_type", F.floor(F.col("importance") * 1000 + F.lit(1e-9)).cast("int").alias("importance_scaled"), "access_count", F.lit(2).alias("tags"), scalars.content_hash(F.concat("key", "value")).alias("hash"))


@query(
    """SELECT m.id, m.access_count + COALESCE(x.times, 0) AS access_count, ROUND(LEAST(1e0, m.importance + 5e-2 * COALESCE(x.times, 0)), 6) AS importance, CASE WHEN COALESCE(x.times, 0) > 0 AND m.lifecycle IN ('Created', 'Archived') THEN 'Active' ELSE m.lifecycle END AS lifecycle
    FROM {memory} m LEFT JOIN (SELECT cell AS id, COUNT(*) AS times FROM {access_log} GROUP BY 1) x ON x.id = m.id"""
)
def memory_touch_fold(t):
    folded = ops.touch_all(t.memory, t.access_log.select(F.col("cell").alias("id")))
    return folded.select("id", "access_count", F.round("importance", 6).alias("importance"), "lifecycle")


_DECAYED = "SELECT id, i AS importance, CASE WHEN i < 1e-2 AND CASE WHEN i < 1e-1 AND lifecycle = 'Active' THEN 'Archived' ELSE lifecycle END = 'Archived' THEN 'Forgotten' WHEN i < 1e-1 AND lifecycle = 'Active' THEN 'Archived' ELSE lifecycle END AS lifecycle FROM (SELECT id, lifecycle, GREATEST(importance * EXP(-1e-2 * age_hours), 0e0) AS i FROM {memory}) x"


@query(f"SELECT id, ROUND(importance, 6) AS importance, lifecycle FROM ({_DECAYED}) y")
def memory_decay(t):
    return ops.decay(t.memory, 0.01).select("id", F.round("importance", 6).alias("importance"), "lifecycle")


@query(f"SELECT lifecycle, COUNT(*) AS entries FROM ({_DECAYED}) y GROUP BY 1")
def memory_forgotten_gc(t):
    return ops.decay(t.memory, 0.01).groupBy("lifecycle").agg(F.count("*").alias("entries"))


@query("SELECT cell, event_type, last_use, place FROM (SELECT cell, event_type, last_use, CAST(ROW_NUMBER() OVER (PARTITION BY cell ORDER BY last_use DESC, event_type) AS INT) AS place FROM (SELECT cell, event_type, MAX(seq) AS last_use FROM {access_log} GROUP BY 1, 2)) WHERE place <= 3")
def working_set(t):
    return ops.working_set(t.access_log, 3, ["cell"], "event_type", "seq").select("cell", "event_type", "last_use", "place")


_SCORE = f"{_cos('embedding', 'q')} * importance * (1 + 2e-1 * EXP(-age_hours / 24)) * (1 + 1e-1 * LN(1 + access_count)) * CASE WHEN memory_type = 1 THEN 12e-1 ELSE 1e0 END"


@query(f"SELECT id, ROUND({_SCORE}, 6) AS score FROM {{memory}}, (SELECT embedding AS q FROM {{embeddings}} WHERE vec_id = 0) z WHERE memory.embedding IS NOT NULL ORDER BY 2 DESC, 1 LIMIT 20")
def memory_retrieve_scored(t):
    scored = t.memory.where("embedding is not null").crossJoin(F.broadcast(_query_vector(t).limit(1)))
    score = scalars.retrieval_score(scalars.cosine(F.col("embedding"), F.col("q")), F.col("importance"), F.col("age_hours"), F.col("access_count"), F.col("memory_type") == 1)
    return scored.select("id", F.round(score, 6).alias("score")).orderBy(F.col("score").desc(), "id").limit(20)


@query("SELECT id, ROUND(importance * EXP(-(age_hours / 24) * 1e-1) * LN(1 + access_count) / LN(1 + (SELECT MAX(access_count) FROM {memory})) * CASE WHEN memory_type = 5 THEN 2 ELSE 1 END, 6) AS retention FROM {memory}")
def memory_retention(t):
    most = t.memory.agg(F.max("access_count").alias("most"))
    score = scalars.retention_score(F.col("importance"), F.col("age_hours"), F.col("access_count"), F.col("most"), F.col("memory_type") == 5, 0.1)
    return t.memory.crossJoin(F.broadcast(most)).select("id", F.round(score, 6).alias("retention"))


@query("SELECT id FROM {memory} WHERE memory_type NOT IN (2, 5) AND importance * EXP(-(age_hours / 24) * 1e-1) * LN(1 + access_count) / LN(1 + (SELECT MAX(access_count) FROM {memory})) < 5e-2")
def memory_forgetting(t):
    """Consolidated and semantic records are protected."""
    most = t.memory.agg(F.max("access_count").alias("most"))
    score = scalars.retention_score(F.col("importance"), F.col("age_hours"), F.col("access_count"), F.col("most"), F.lit(False), 0.1)
    return t.memory.where(~F.col("memory_type").isin(2, 5)).crossJoin(F.broadcast(most)).where(score < 0.05).select("id")


@query("SELECT id, CASE WHEN access_count > 100 THEN 'Access' WHEN age_hours > 168 AND access_count > 10 THEN 'Time' ELSE 'Importance' END AS reason FROM {memory} WHERE access_count > 100 OR (age_hours > 168 AND access_count > 10) OR importance > 8e-1")
def memory_consolidation_candidates(t):
    access, old = F.col("access_count") > 100, (F.col("age_hours") > 168) & (F.col("access_count") > 10)
    return t.memory.where(access | old | (F.col("importance") > 0.8)).select("id", F.when(access, "Access").when(old, "Time").otherwise("Importance").alias("reason"))


@query("SELECT memory_type AS grp, CAST(pos AS INT) AS pos, ROUND(SUM(importance * CAST(embedding[pos + 1] AS DOUBLE)) / SUM(importance), 6) AS mean FROM (SELECT memory_type, importance, embedding, UNNEST(range(0, len(embedding))) AS pos FROM {memory} WHERE embedding IS NOT NULL) x GROUP BY 1, 2")
def memory_consolidated_vector(t):
    return ops.consolidated_vectors(t.memory, F.col("memory_type")).select("grp", "pos", F.round("mean", 6).alias("mean"))


@query("SELECT key, id, CAST(running AS BIGINT) AS running FROM (SELECT key, id, SUM(access_count) OVER (PARTITION BY key ORDER BY importance DESC, id ROWS UNBOUNDED PRECEDING) AS running FROM {memory}) x WHERE running <= 500")
def memory_budget_admit(t):
    return ops.admit_within(t.memory, 500, ["key"], [F.col("importance").desc(), F.col("id")], "access_count").select("key", "id", "running")


@query("SELECT vec_id, ROUND(SQRT(list_sum(list_transform(mixed, lambda x: x * x))), 6) AS length FROM (SELECT vec_id, list_transform(range(1, 1 + len(q)), lambda i: 7e-1 * CAST(embedding[i] AS DOUBLE) + 3e-1 * CAST(q[i] AS DOUBLE)) AS mixed FROM {embeddings}, (SELECT embedding AS q FROM {embeddings} WHERE vec_id = 0)) x")
def query_blend(t):
    mixed = scalars.blend(F.col("embedding"), F.col("q"), 0.7)
    return t.embeddings.crossJoin(F.broadcast(_query_vector(t).limit(1))).select("vec_id", F.round(scalars.norm(mixed), 6).alias("length"))
