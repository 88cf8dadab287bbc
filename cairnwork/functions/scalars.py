"""Scalar functions as Columns: all run in the JVM, none in Python."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(data: Column) -> Column:
    """Identity of a payload: SHA-256 in lower-case hex."""
    return F.sha2(data.cast("binary"), 256)


def is_hash(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-fA-F]{64}$"), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ, a vector is empty or a norm is 0; null vectors count as empty."""
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(usable, dot(a, b) / (norm(a) * norm(b))).otherwise(F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def normalised(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") / norm(a))


def blend(a: Column, b: Column, alpha: float = 0.7) -> Column:
    return F.zip_with(a, b, lambda x, y: alpha * x.cast("double") + (1 - alpha) * y.cast("double"))


def parse_vector(text: Column) -> Column:
    """Comma-separated numbers as array<float>, or null if any is none."""
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("float"))
    return F.when(F.exists(parts, lambda x: x.isNull()), None).otherwise(parts)


def hash_vector(hash_hex: Column, dims: Column) -> Column:
    """The bytes of a hash over 255, as many as there are of the first min(dims, 32)."""
    return F.transform(F.sequence(F.lit(0), F.least(dims, F.lit(32)) - 1), lambda i: F.conv(F.substring(hash_hex, 2 * i + 1, F.lit(2)), 16, 10).cast("double") / 255)


def combined_score(similarity: Column, confidence: Column, recency: Column, weights: Sequence[float] = (0.5, 0.3, 0.2)) -> Column:
    return weights[0] * similarity + weights[1] * confidence + weights[2] * recency


def confidence(selections: Column, successes: Column) -> Column:
    return F.when(selections == 0, F.lit(0.5)).otherwise(successes / selections)


def recency(age_hours: Column) -> Column:
    """1 / (1 + age); 0 for what was never used (null)."""
    return F.when(age_hours.isNull(), F.lit(0.0)).otherwise(1 / (1 + age_hours))


def size_similarity(size: Column) -> Column:
    return 1 / (1 + size / F.lit(1e6))


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def touched_importance(importance: Column, times: Column) -> Column:
    return F.least(F.lit(1.0), importance + 0.05 * times)


def decayed(importance: Column, age_hours: Column, rate: float) -> Column:
    return F.greatest(importance * F.exp(-rate * age_hours), F.lit(0.0))


def lifecycle_after_decay(importance: Column, lifecycle: Column) -> Column:
    """Both steps can happen in one call: Active falls to Archived, Archived to Forgotten."""
    archived = F.when((importance < 0.1) & (lifecycle == "Active"), "Archived").otherwise(lifecycle)
    return F.when((importance < 0.01) & (archived == "Archived"), "Forgotten").otherwise(archived)


def retrieval_score(similarity: Column, importance: Column, age_hours: Column, access_count: Column, type_matches: Column) -> Column:
    return similarity * importance * (1 + 0.2 * F.exp(-age_hours / 24)) * (1 + 0.1 * F.log1p(access_count)) * F.when(type_matches, 1.2).otherwise(1.0)


def retention_score(importance: Column, age_hours: Column, access_count: Column, max_access: Column, consolidated: Column, rate: float) -> Column:
    access = F.when(max_access == 0, 0.0).otherwise(F.log1p(access_count) / F.log1p(max_access))
    return importance * F.exp(-(age_hours / 24) * rate) * access * F.when(consolidated, 2.0).otherwise(1.0)


def selection_score(similarity: Column, confidence_: Column, age_steps: Column, cost: Column, remaining: Column) -> Column:
    budget = F.when(cost <= remaining, 1.0).when(cost <= 2 * remaining, 0.5).otherwise(0.0)
    return similarity * confidence_ * (1 + 0.1 * F.exp(-age_steps / 10)) * budget


def budget_multiplier(difficulty: Column) -> Column:
    return F.when(difficulty == "Easy", 0.2).when(difficulty == "Medium", 1.0).when(difficulty == "Hard", 5.0)


def target_depth(difficulty: Column, least: Column, most: Column) -> Column:
    return F.when(difficulty == "Easy", least + 2).when(difficulty == "Medium", F.floor((least + most) / 2)).when(difficulty == "Hard", most - 5)


def cache_tier(frequency: Column) -> Column:
    return F.when(frequency > 10, 0).when(frequency > 5, 1).otherwise(2)


def version_text(major: Column, minor: Column, patch: Column) -> Column:
    return F.concat_ws(".", major.cast("string"), minor.cast("string"), patch.cast("string"))


def category_of(code: Column) -> Column:
    from .catalogs import CATEGORIES

    out = F.lit("Reserved")
    for first, last, name in reversed(CATEGORIES):
        out = F.when(code.between(first, last), name).otherwise(out)
    return out


def inferred_type(name: Column) -> Column:
    """Cell type from a tensor's name: the first rule that its lower-case text meets."""
    low = F.lower(name)
    has = lambda *parts: F.greatest(*[low.contains(p) for p in parts], F.lit(False))
    ln_weight, bias = has("weight", "scale", "gamma"), has("bias")
    rules = [
        (has("embed"), "EMBEDDING"), (has("q_proj", "query"), "ATTENTION_Q_PROJ"), (has("k_proj", "key"), "ATTENTION_K_PROJ"), (has("v_proj", "value"), "ATTENTION_V_PROJ"),
        (has("o_proj") | has("output") & has("attn"), "ATTENTION_OUT"), (has("gate_proj") | has("gate") & has("mlp"), "MLP_GATE"), (has("up_proj") | has("up") & has("mlp"), "MLP_UP"),
        (has("down_proj") | has("down") & has("mlp"), "MLP_DOWN"), (has("lm_head", "head"), "LM_HEAD"), (has("layernorm", "ln") & ln_weight, "LAYERNORM_WEIGHT"), (has("layernorm", "ln"), "LAYERNORM_BIAS"),
        (has("norm") & bias, "NORM_BIAS"), (has("norm"), "NORM_SCALE"), (has("position", "pos"), "POSITIONAL"), (has("conv", "wq"), "CONV_WEIGHT"), (has("expert") & has("gate"), "EXPERT_GATE"),
        (has("expert") & has("route"), "EXPERT_ROUTE"), (has("expert"), "EXPERT_WEIGHT"), (has("residual", "res"), "RESIDUAL_GATE"),
    ]
    out = F.lit("NORM_SCALE")
    for met, kind in reversed(rules):
        out = F.when(met, kind).otherwise(out)
    return out


def unsafe_name(name: Column) -> Column:
    return name.rlike(r"[\x00-\x1f\x7f-\x9f/\\]|\.\.")


# Layer parts in the two source namings, and the canonical name of each.
LAYER_PARTS = [
    (r"self_attn\.q_proj", "attn_q", "self_attn.q_proj"), (r"self_attn\.k_proj", "attn_k", "self_attn.k_proj"), (r"self_attn\.v_proj", "attn_v", "self_attn.v_proj"), (r"self_attn\.o_proj", "attn_output", "self_attn.out"),
    (r"mlp\.gate_proj", "ffn_gate", "mlp.gate"), (r"mlp\.up_proj", "ffn_up", "mlp.up"), (r"mlp\.down_proj", "ffn_down", "mlp.down"), ("input_layernorm", "attn_norm", "input_norm"),
    ("post_attention_layernorm", "ffn_norm", "post_attn_norm"), (r"block_sparse_moe\.gate", "ffn_gate_inp", "moe.router"),
]
EXPERT_PARTS = [("w1", "ffn_gate", "gate"), ("w2", "ffn_down", "down"), ("w3", "ffn_up", "up")]
TOP_PARTS = [(r"model\.embed_tokens|token_embd", "model.embedding.token_embedding"), (r"model\.norm|output_norm", "model.final_norm"), ("lm_head|output", "model.lm_head")]


def canonical_name(name: Column) -> Column:
    """A source tensor's canonical name, or null where no rule knows it."""
    rules = [(rf"^(?:{top})\.weight$", new) for top, new in TOP_PARTS]
    rules += [(rf"^(?:model\.layers\.(\d+)\.{long}|blk\.(\d+)\.{short})\.weight$", f"model.layer.$1$2.{new}") for long, short, new in LAYER_PARTS]
    rules += [(rf"^(?:model\.layers\.(\d+)\.block_sparse_moe\.experts\.(\d+)\.{long}|blk\.(\d+)\.{short}\.(\d+))\.weight$", f"model.layer.$1$3.moe.expert.$2$4.{new}") for long, short, new in EXPERT_PARTS]
    return F.coalesce(*[F.when(name.rlike(p), F.regexp_replace(name, p, to)) for p, to in rules])


def normalized_latency(measured: Column, reference_score: Column, actual_score: Column) -> Column:
    """Latency as hardware of the reference score would have it."""
    return measured * (reference_score / actual_score)
