"""Fixed code tables of the data model, as small DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Names of cell types from each range's first code on.
CELL_TYPES = {
    0x01: "EMBEDDING ATTENTION_Q_PROJ ATTENTION_K_PROJ ATTENTION_V_PROJ ATTENTION_OUT MLP_GATE MLP_UP MLP_DOWN EXPERT_GATE EXPERT_ROUTE EXPERT_WEIGHT LAYERNORM_WEIGHT LAYERNORM_BIAS LM_HEAD VISION_ENCODER CONV_WEIGHT NORM_SCALE NORM_BIAS POSITIONAL RESIDUAL_GATE",
    0x20: "MEMORY_EPISODIC MEMORY_SEMANTIC MEMORY_PROCEDURAL MEMORY_WORKING MEMORY_CONSOLIDATED MEMORY_ASSOCIATION",
    0x30: "ROUTING_POLICY ROUTING_STATISTICS ROUTING_INDEX ROUTING_ASSOCIATION ROUTING_THRESHOLD",
    0x40: "COMPOSITION_PATTERN COMPOSITION_TEMPLATE COMPOSITION_MACRO COMPOSITION_SEQUENCE COMPOSITION_PARALLEL COMPOSITION_CONDITIONAL COMPOSITION_ITERATIVE",
    0x50: "TRANSFORM_MODULE ENCODE_MODULE DECODE_MODULE NORMALIZE_MODULE ACTIVATION_MODULE POOLING_MODULE ATTENTION_MODULE CONVOLUTION_MODULE RECURRENT_MODULE",
    0x60: "HALT_CONDITION BUDGET_POLICY BRANCH_CONDITION LOOP_CONTROL ERROR_HANDLER",
    0x70: "PROVENANCE CONFIGURATION STATISTICS ANNOTATION VALIDATION",
    0xFF: "CUSTOM",
}
# Last code of each category.
CATEGORIES = [(0x01, 0x1F, "Weight"), (0x20, 0x2F, "Memory"), (0x30, 0x3F, "Routing"), (0x40, 0x4F, "Composition"), (0x50, 0x5F, "Computation"), (0x60, 0x6F, "Control"), (0x70, 0x7F, "Meta"), (0xFF, 0xFF, "Custom")]
# Data types by code from 1, with their bytes.
DTYPES = [("F32", 4), ("F16", 2), ("BF16", 2), ("F8", 1), ("I8", 1), ("I16", 2), ("I32", 4), ("I64", 8), ("U8", 1), ("U16", 2), ("U32", 4), ("U64", 8), ("Bool", 1)]
# Which type widens to which.
WIDENING = {"F16": "F32", "BF16": "F32", "F8": "F32 F16", "I8": "I16 I32 I64", "I16": "I32 I64", "I32": "I64", "U8": "U16 U32 U64", "U16": "U32 U64", "U32": "U64"}
# Conversions with a rule: from, to, whether allowed, whether lossy.
CONVERSIONS = [("F32", "F16", True, True), ("F32", "BF16", True, True), ("F16", "F32", True, False), ("BF16", "F32", True, False), ("F64", "F32", True, True), ("I8", "I16", True, False), ("I8", "I32", True, False), ("I8", "I64", True, False), ("I32", "I8", False, True), ("F32", "I32", False, True)]
# Error kinds with code, and which are fatal, recoverable, transient.
ERRORS = {
    "StoreNotFound": "E-STORE", "CorruptStore": "E-CORRUPT", "TileNotFound": "E-TILE", "CellNotFound": "E-CELL", "MemoryNotFound": "E-MEMORY", "RevisionNotFound": "E-REVISION", "StoreFull": "E-STORE-FULL",
    "Io": "E-IO", "Serialization": "E-SERIAL", "Deserialization": "E-DESERIAL", "Compression": "E-COMPRESS", "UnsupportedCompression": "E-COMPRESS", "IntegrityFailed": "E-INTEGRITY", "QuarantineFull": "E-QUARANTINE",
    "InvalidRevision": "E-REVISION", "RevisionCycle": "E-REVISION-CYCLE", "WalError": "E-WAL", "InvalidWalRecord": "E-WAL", "RecoveryFailed": "E-RECOVERY", "UnsupportedFormat": "E-FORMAT", "ConversionError": "E-CONVERSION",
    "InvalidModelFile": "E-MODEL", "CellExecutionFailed": "E-EXECUTION", "BudgetExceeded": "E-BUDGET", "InvalidQuery": "E-QUERY", "DependencyCycle": "E-CYCLE", "MemoryFull": "E-MEMORY-FULL", "InvalidMemoryType": "E-MEMORY",
    "RoutingFailed": "E-ROUTING", "NoRouteFound": "E-ROUTE", "CacheMiss": "E-CACHE", "CacheFull": "E-CACHE", "InvalidInput": "E-INPUT", "NotImplemented": "E-NOTIMPL", "PermissionDenied": "E-PERM", "Timeout": "E-TIMEOUT",
    "Internal": "E-INTERNAL", "Unknown": "E-UNKNOWN",
}
FATAL = ("CorruptStore", "RevisionCycle", "DependencyCycle", "Internal")
RECOVERABLE = ("Io", "Timeout", "CacheMiss", "RoutingFailed")
TRANSIENT = ("Io", "Timeout", "StoreFull", "CacheFull", "MemoryFull")
# Dependency kinds by code from 0; the first three are hard.
DEPENDENCIES = ("Data", "Control", "ExecutionOrder", "PrefetchHint", "Semantic")


def cell_types(spark: SparkSession) -> DataFrame:
    rows = [(first + k, name) for first, names in CELL_TYPES.items() for k, name in enumerate(names.split())]
    return spark.createDataFrame(rows, "code int, name string")


def dtypes(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, n, b, n in ("F32", "F16", "BF16", "F8"), n[0] in "IU") for i, (n, b) in enumerate(DTYPES)]
    return spark.createDataFrame(rows, "code int, name string, bytes int, is_float boolean, is_integer boolean")


def widening(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, bs in WIDENING.items() for b in bs.split()], "source string, target string")


def conversions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONVERSIONS, "source string, target string, allowed boolean, lossy boolean")


def errors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, c, k in FATAL, k in RECOVERABLE, k in TRANSIENT) for k, c in ERRORS.items()], "kind string, code string, fatal boolean, recoverable boolean, transient boolean")


def values_sql(rows: list[tuple], *columns: str) -> str:
    """A VALUES table for the oracles."""
    show = lambda v: "'" + v + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) AS v({', '.join(columns)}))"
