"""Queries on the type system: codes, widening, names, versions, errors, budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import catalogs, scalars
from .registry import query

_WIDENING = catalogs.values_sql([(a, b) for a, bs in catalogs.WIDENING.items() for b in bs.split()], "source", "target")
_DTYPES = catalogs.values_sql([(i + 1, n, b) for i, (n, b) in enumerate(catalogs.DTYPES)], "code", "name", "bytes")
_CATEGORY = "CASE " + " ".join(f"WHEN type_code BETWEEN {a} AND {b} THEN '{n}'" for a, b, n in catalogs.CATEGORIES) + " ELSE 'Reserved' END"
_NAMES = catalogs.values_sql([(first + k, n) for first, ns in catalogs.CELL_TYPES.items() for k, n in enumerate(ns.split())], "code", "name")
_PROBES = ["model.embed_tokens.weight", "layers.<n>.self_attn.q_proj", "blk.<n>.attn_q.weight", "model.layers.<n>.mlp.gate_proj.weight", "h.<n>.ln_1.weight", "model.layers.<n>.post_attention_layernorm.weight", "blk.<n>.ffn_up.3.weight", "model.norm.bias", "experts.<n>.gate_w", "../<n>", "a/<n>", "lm_head.weight"]
_TENSORS = "(SELECT p_partkey, REPLACE(CASE p_partkey % 12 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PROBES)) + " END, '<n>', CAST(p_partkey AS STRING)) AS name FROM {part})"
_has = lambda *ps: "(" + " OR ".join(f"low LIKE '%{p.replace('_', chr(92) + '_')}%' ESCAPE '{chr(92)}'" for p in ps) + ")"


def _tensors(t):
    probe = F.element_at(F.array(*map(F.lit, _PROBES)), (F.col("p_partkey") % 12 + 1).cast("int"))
    return t.part.select("p_partkey", F.replace(probe, F.lit("<n>"), F.col("p_partkey").cast("string")).alias("name"))


@query(f"SELECT {_CATEGORY} AS category, COUNT(*) AS cells FROM {{cells}} GROUP BY 1")
def cell_category_counts(t):
    return t.cells.groupBy(scalars.category_of(F.col("type_code")).alias("category")).agg(F.count("*").alias("cells"))


@query(f"SELECT c.cell_id, n.name AS type_name, n.name IS NULL AS rejected FROM {{cells}} c LEFT JOIN {_NAMES} n ON n.code = c.type_code")
def cell_type_names(t):
    names = catalogs.cell_types(t.spark).select(F.col("code").alias("type_code"), F.col("name").alias("type_name"))
    return t.cells.join(F.broadcast(names), "type_code", "left").select("cell_id", "type_name", F.col("type_name").isNull().alias("rejected"))


@query(f"SELECT c.cell_id, d.name AS dtype, CAST(c.dim * c.dim * d.bytes AS BIGINT) AS bytes, CAST(c.dim * c.dim AS BIGINT) AS elements FROM {{cells}} c JOIN {_DTYPES} d ON d.code = c.dtype_code")
def dtype_size_catalog(t):
    kinds = catalogs.dtypes(t.spark).select(F.col("code").alias("dtype_code"), F.col("name").alias("dtype"), F.col("bytes").alias("each"))
    elements = F.aggregate(F.array("dim", "dim"), F.lit(1).cast("long"), lambda s, x: s * x)
    return t.cells.join(F.broadcast(kinds), "dtype_code").select("cell_id", "dtype", (elements * F.col("each")).alias("bytes"), elements.alias("elements"))


@query(f"SELECT source, target FROM {_WIDENING}")
def dtype_widening_pairs(t):
    return catalogs.widening(t.spark)


@query(f"SELECT a.name AS left_type, b.name AS right_type, a.name = b.name OR w.source IS NOT NULL AS compatible FROM {_DTYPES} a CROSS JOIN {_DTYPES} b LEFT JOIN {_WIDENING} w ON w.source = a.name AND w.target = b.name")
def schema_compatibility(t):
    """All pairs of the 13 types: the catalogue is fixed, so the product is too."""
    kinds = catalogs.dtypes(t.spark).select("name")
    pairs = kinds.select(F.col("name").alias("left_type")).crossJoin(kinds.select(F.col("name").alias("right_type")))
    wide = catalogs.widening(t.spark).select(F.col("source").alias("left_type"), F.col("target").alias("right_type"), F.lit(True).alias("wide"))
    return pairs.join(F.broadcast(wide), ["left_type", "right_type"], "left").select("left_type", "right_type", ((F.col("left_type") == F.col("right_type")) | F.col("wide").isNotNull()).alias("compatible"))


@query(
    f"""SELECT p_partkey, CASE WHEN {_has('embed')} THEN 'EMBEDDING' WHEN {_has('q_proj', 'query')} THEN 'ATTENTION_Q_PROJ' WHEN {_has('k_proj', 'key')} THEN 'ATTENTION_K_PROJ' WHEN {_has('v_proj', 'value')} THEN 'ATTENTION_V_PROJ'
    WHEN {_has('o_proj')} OR {_has('output')} AND {_has('attn')} THEN 'ATTENTION_OUT' WHEN {_has('gate_proj')} OR {_has('gate')} AND {_has('mlp')} THEN 'MLP_GATE' WHEN {_has('up_proj')} OR {_has('up')} AND {_has('mlp')} THEN 'MLP_UP'
    WHEN {_has('down_proj')} OR {_has('down')} AND {_has('mlp')} THEN 'MLP_DOWN' WHEN {_has('head')} THEN 'LM_HEAD' WHEN {_has('layernorm', 'ln')} AND {_has('weight', 'scale', 'gamma')} THEN 'LAYERNORM_WEIGHT' WHEN {_has('layernorm', 'ln')} THEN 'LAYERNORM_BIAS'
    WHEN {_has('norm')} AND {_has('bias')} THEN 'NORM_BIAS' WHEN {_has('norm')} THEN 'NORM_SCALE' WHEN {_has('pos')} THEN 'POSITIONAL' WHEN {_has('conv', 'wq')} THEN 'CONV_WEIGHT' WHEN {_has('expert')} AND {_has('gate')} THEN 'EXPERT_GATE'
    WHEN {_has('expert')} AND {_has('route')} THEN 'EXPERT_ROUTE' WHEN {_has('expert')} THEN 'EXPERT_WEIGHT' WHEN {_has('res')} THEN 'RESIDUAL_GATE' ELSE 'NORM_SCALE' END AS inferred FROM (SELECT p_partkey, LOWER(name) AS low FROM {_TENSORS} a) b"""
)
def name_type_inference(t):
    return _tensors(t).select("p_partkey", scalars.inferred_type(F.col("name")).alias("inferred"))


@query(f"SELECT p_partkey, name FROM {_TENSORS} a WHERE name LIKE '%/%' OR name LIKE '%..%' OR name LIKE '%\\%'")
def unsafe_name_filter(t):
    return _tensors(t).where(scalars.unsafe_name(F.col("name")))


@query(
    f"""SELECT p_partkey, CASE WHEN name = 'model.embed_tokens.weight' THEN 'model.embedding.token_embedding' WHEN name LIKE 'blk.%.attn\\_q.weight' ESCAPE '\\' THEN 'model.layer.' || p_partkey || '.self_attn.q_proj'
    WHEN name LIKE 'model.layers.%.mlp.gate\\_proj.weight' ESCAPE '\\' THEN 'model.layer.' || p_partkey || '.mlp.gate' WHEN name LIKE '%post\\_attention\\_layernorm.weight' ESCAPE '\\' THEN 'model.layer.' || p_partkey || '.post_attn_norm'
    WHEN name LIKE 'blk.%.ffn\\_up.3.weight' ESCAPE '\\' THEN 'model.layer.' || p_partkey || '.moe.expert.3.up' WHEN name = 'lm_head.weight' THEN 'model.lm_head' END AS canonical FROM {_TENSORS} a"""
)
def canonical_names(t):
    return _tensors(t).select("p_partkey", scalars.canonical_name(F.col("name")).alias("canonical"))


@query("SELECT cell_id, CASE WHEN size = 0 THEN 0e0 ELSE ROUND(stored_size / (size * 1e0), 6) END AS ratio FROM {cells}")
def compression_ratio(t):
    return t.cells.select("cell_id", F.when(F.col("size") == 0, 0.0).otherwise(F.round(F.col("stored_size") / F.col("size"), 6)).alias("ratio"))


@query("SELECT lifecycle, COUNT(*) AS cells, CAST(SUM(dim * dim) AS BIGINT) AS elements FROM {cells} GROUP BY lifecycle")
def lifecycle_counts(t):
    return t.cells.groupBy("lifecycle").agg(F.count("*").alias("cells"), F.sum(F.col("dim") * F.col("dim")).alias("elements"))


@query("SELECT cell_id, CASE WHEN major > 1 THEN 'ForwardIncompatible' WHEN major < 1 THEN 'RequiresMigration' WHEN minor > 2 THEN 'PartialCompatible' ELSE 'Compatible' END AS verdict FROM {cells}")
def version_compat(t):
    major, minor = F.col("major"), F.col("minor")
    return t.cells.select("cell_id", F.when(major > 1, "ForwardIncompatible").when(major < 1, "RequiresMigration").when(minor > 2, "PartialCompatible").otherwise("Compatible").alias("verdict"))


@query(
    f"""SELECT d.source, d.target, CASE WHEN ca <> cb THEN 'INCOMPATIBLE_TYPE' WHEN NOT (da = db OR EXISTS (SELECT 1 FROM {_WIDENING} w WHERE w.source = da AND w.target = db)) THEN 'INCOMPATIBLE_SCHEMA' WHEN ma <> mb THEN 'INCOMPATIBLE_VERSION' WHEN d.kind = 4 THEN 'INCOMPATIBLE_DEPENDENCY' ELSE 'COMPATIBLE' END AS verdict
    FROM (SELECT e.source, e.target, e.kind, a.type_code >= 64 AS ca, b.type_code >= 64 AS cb, x.name AS da, y.name AS db, a.major AS ma, b.major AS mb FROM {{deps}} e JOIN {{cells}} a ON a.cell_id = e.source JOIN {{cells}} b ON b.cell_id = e.target JOIN {_DTYPES} x ON x.code = a.dtype_code JOIN {_DTYPES} y ON y.code = b.dtype_code) d"""
)
def cell_compat(t):
    kinds = F.broadcast(catalogs.dtypes(t.spark).select(F.col("code").alias("dtype_code"), F.col("name").alias("dtype")))
    cells = t.cells.join(kinds, "dtype_code").select("cell_id", (F.col("type_code") >= 64).alias("big"), "dtype", "major")
    a, b = (cells.select(*[F.col(c).alias(f"{c}_{side}") for c in cells.columns]) for side in "ab")
    wide = F.broadcast(catalogs.widening(t.spark).select(F.col("source").alias("dtype_a"), F.col("target").alias("dtype_b"), F.lit(True).alias("wide")))
    joined = t.deps.join(a, F.col("source") == F.col("cell_id_a")).join(b, F.col("target") == F.col("cell_id_b")).join(wide, ["dtype_a", "dtype_b"], "left")
    same = (F.col("dtype_a") == F.col("dtype_b")) | F.col("wide").isNotNull()
    verdict = F.when(F.col("big_a") != F.col("big_b"), "INCOMPATIBLE_TYPE").when(~same, "INCOMPATIBLE_SCHEMA").when(F.col("major_a") != F.col("major_b"), "INCOMPATIBLE_VERSION").when(F.col("kind") == 4, "INCOMPATIBLE_DEPENDENCY").otherwise("COMPATIBLE")
    return joined.select("source", "target", verdict.alias("verdict"))


@query("SELECT * FROM " + catalogs.values_sql([(k, c, k in catalogs.FATAL, k in catalogs.RECOVERABLE, k in catalogs.TRANSIENT) for k, c in catalogs.ERRORS.items()], "kind", "code", "fatal", "recoverable", "transient"))
def error_classes(t):
    return catalogs.errors(t.spark)


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 'Confidence' WHEN o_totalprice < 5000 THEN 'BudgetExhausted' WHEN o_orderstatus = 'P' THEN 'NoCells' WHEN o_orderkey % 30 >= 25 THEN 'MaxDepth' WHEN o_custkey % 50 = 0 THEN 'Timeout' ELSE 'Continue' END AS reason FROM {orders}")
def halt_reason(t):
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    reason = F.when(price >= 300000, "Confidence").when(price < 5000, "BudgetExhausted").when(F.col("o_orderstatus") == "P", "NoCells").when(key % 30 >= 25, "MaxDepth").when(F.col("o_custkey") % 50 == 0, "Timeout").otherwise("Continue")
    return t.orders.select("o_orderkey", reason.alias("reason"))


@query("SELECT o_orderkey, ROUND(o_totalprice / 400000e0, 9) AS utilization, CASE o_orderkey % 3 WHEN 0 THEN 2e-1 WHEN 1 THEN 1e0 ELSE 5e0 END AS multiplier, CAST(CASE o_orderkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 13 ELSE 20 END AS BIGINT) AS depth FROM {orders}")
def budget_utilization(t):
    hard = F.element_at(F.array(*map(F.lit, ("Easy", "Medium", "Hard"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return t.orders.select("o_orderkey", F.round(F.col("o_totalprice") / 400000.0, 9).alias("utilization"), scalars.budget_multiplier(hard).alias("multiplier"), scalars.target_depth(hard, F.lit(2), F.lit(25)).cast("long").alias("depth"))


@query(
    f"""SELECT cell_id, best FROM (SELECT c.cell_id, r.ordinal AS best, ROW_NUMBER() OVER (PARTITION BY c.cell_id ORDER BY r.size, r.ordinal) AS n FROM {{cells}} c JOIN {_DTYPES} d ON d.code = c.dtype_code
    JOIN (SELECT cell_id, o AS ordinal, 1 + (cell_id * 3 + o * 5) % 13 AS code, (cell_id * 31 + o * 17) % 1000 AS size FROM {{cells}} CROSS JOIN (VALUES (0), (1), (2), (3)) v(o)) r ON r.cell_id = c.cell_id JOIN {_DTYPES} e ON e.code = r.code
    WHERE d.name = e.name OR EXISTS (SELECT 1 FROM {_WIDENING} w WHERE (w.source = d.name AND w.target = e.name) OR (w.source = e.name AND w.target = d.name))) x WHERE n = 1"""
)
def representation_select(t):
    """The smallest representation whose type is the cell's or widens to or from it; the first of equal size."""
    kinds = catalogs.dtypes(t.spark)
    wide = catalogs.widening(t.spark)
    pairs = wide.union(wide.select("target", "source")).union(kinds.select("name", "name")).toDF("dtype", "other")
    name = lambda code, to: F.broadcast(kinds.select(F.col("code").alias(code), F.col("name").alias(to)))
    reps = t.cells.select("cell_id", "dtype_code", F.explode(F.array(*map(F.lit, range(4)))).alias("ordinal"))
    reps = reps.withColumn("code", (1 + (F.col("cell_id") * 3 + F.col("ordinal") * 5) % 13).cast("int")).withColumn("size", (F.col("cell_id") * 31 + F.col("ordinal") * 17) % 1000)
    fit = reps.join(name("dtype_code", "dtype"), "dtype_code").join(name("code", "other"), "code").join(F.broadcast(pairs), ["dtype", "other"], "left_semi")
    return fit.groupBy("cell_id").agg(F.min(F.struct("size", "ordinal"))["ordinal"].alias("best"))
