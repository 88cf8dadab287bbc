"""Tensor files as rows: format detection as Columns, safetensors and GGUF parsed from Spark's binaryFile source.

Files are read by Spark (any store that it reads), one file a row; a file is parsed where it was read, and with
data=False only headers leave the task. Quantised GGUF blocks stay opaque. Pickles are never loaded: their bytes are
one opaque tensor, as those of ONNX files are.
"""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions of each format.
EXTENSIONS = {"safetensors": ("safetensors", "sft"), "gguf": ("gguf", "ggml"), "pytorch": ("pt", "pth", "bin"), "onnx": ("onnx",)}
# Safetensors type names, with ours and their bytes.
SAFETENSORS = {"F64": ("F64", 8), "F32": ("F32", 4), "F16": ("F16", 2), "BF16": ("BF16", 2), "F8_E4M3": ("F8", 1), "I64": ("I64", 8), "I32": ("I32", 4), "I16": ("I16", 2), "I8": ("I8", 1), "U8": ("U8", 1), "BOOL": ("Bool", 1)}
# GGUF tensor types by code: name, elements of a block, bytes of a block.
GGUF = {0: ("F32", 1, 4), 1: ("F16", 1, 2), 2: ("Q4_0", 32, 18), 3: ("Q4_1", 32, 20), 6: ("Q5_0", 32, 22), 7: ("Q5_1", 32, 24), 8: ("Q8_0", 32, 34), 24: ("I8", 1, 1), 25: ("I16", 1, 2), 26: ("I32", 1, 4), 27: ("I64", 1, 8), 28: ("F64", 1, 8), 30: ("BF16", 1, 2)}
# Struct codes of GGUF metadata values by type (8 is text, 9 an array).
GGUF_VALUES = {0: "B", 1: "b", 2: "H", 3: "h", 4: "I", 5: "i", 6: "f", 7: "?", 10: "Q", 11: "q", 12: "d"}

SCHEMA = "path string, name string, dtype string, shape array<long>, size long, data binary"


def detected(path: Column, content: Column, length: Column) -> Column:
    """(format, confidence): the extension decides (0.9), else the first bytes (0.95), else Unknown (0.3; 0 under 8 bytes)."""
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    head = F.hex(F.substring(content, 1, 16))
    header = F.conv(F.concat(*[F.substring(head, 2 * i + 1, 2) for i in reversed(range(7))]), 16, 10).cast("long")
    by_name = F.lit(None).cast("string")
    for kind, names in EXTENSIONS.items():
        by_name = F.when(extension.isin(*names), kind).otherwise(by_name)
    pickle = head.rlike("^80(02|03|04|05)")
    fits = (F.substring(head, 15, 2) == "00") & (header > 0) & (header < length)
    by_bytes = F.when(head.startswith("47475546"), "gguf").when(pickle, "pytorch").when(fits, "safetensors").when(head.startswith("0A"), "onnx")
    by_bytes = F.when(length >= 8, by_bytes)
    sure = F.when(by_name.isNotNull(), 0.9).when(length < 8, 0.0).when(by_bytes.isNotNull(), 0.95).otherwise(0.3)
    return F.struct(F.coalesce(by_name, by_bytes, F.lit("Unknown")).alias("format"), sure.alias("confidence"))


def read_safetensors(raw: bytes) -> Iterator[tuple[str, str, list[int], int, int]]:
    """(name, dtype, shape, first byte, size) of each tensor, in the order of names; unknown types are an error."""
    (n,) = struct.unpack_from("<Q", raw)
    header = json.loads(raw[8 : 8 + n])
    for name in sorted(header):
        if name != "__metadata__":
            entry = header[name]
            dtype, _ = SAFETENSORS[entry["dtype"]]
            a, b = entry["data_offsets"]
            yield name, dtype, entry["shape"], 8 + n + a, b - a


def read_gguf(raw: bytes) -> Iterator[tuple[str, str, list[int], int, int]]:
    """Tensors of a GGUF file of version 2 or 3, in the order of the file."""
    magic, version, tensors, pairs = struct.unpack_from("<4sIQQ", raw)
    if magic != b"GGUF" or version not in (2, 3):
        raise ValueError("no GGUF file of version 2 or 3")
    at, alignment = 24, 32

    def text() -> str:
        nonlocal at
        (n,) = struct.unpack_from("<Q", raw, at)
        at += 8 + n
        return raw[at - n : at].decode("utf-8", "replace")

    def value(kind: int) -> object:
        nonlocal at
        if kind == 8:
            return text()
        if kind == 9:
            inner, n = struct.unpack_from("<IQ", raw, at)
            at += 12
            return [value(inner) for _ in range(n)]
        (x,) = struct.unpack_from(f"<{GGUF_VALUES[kind]}", raw, at)
        at += struct.calcsize(f"<{GGUF_VALUES[kind]}")
        return x

    for _ in range(pairs):
        key = text()
        (kind,) = struct.unpack_from("<I", raw, at)
        at += 4
        found = value(kind)
        if key == "general.alignment":
            alignment = int(found)
    infos = []
    for _ in range(tensors):
        name = text()
        (dims,) = struct.unpack_from("<I", raw, at)
        shape = list(struct.unpack_from(f"<{dims}Q", raw, at + 4))
        kind, offset = struct.unpack_from("<IQ", raw, at + 4 + 8 * dims)
        at += 16 + 8 * dims
        infos.append((name, kind, shape, offset))
    base = -(-at // alignment) * alignment
    for name, kind, shape, offset in infos:
        dtype, block, size = GGUF[kind]
        yield name, dtype, shape, base + offset, math.prod(shape) // block * size


def tensors(spark: SparkSession, path: str, data: bool = True, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """The tensors of all files under path, by detected format; names by regular expression. data is null if not wanted."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.select("path", "content", detected(F.col("path"), F.col("content"), F.col("length"))["format"].alias("format"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, raw, kind in zip(*(batch.column(c).to_pylist() for c in ("path", "content", "format")), strict=True):
                readers = {"safetensors": read_safetensors, "gguf": read_gguf}
                found = readers[kind](raw) if kind in readers else [(where.rpartition("/")[2], "U8", [len(raw)], 0, len(raw))] if kind in ("pytorch", "onnx") else []
                rows = [{"path": where, "name": n, "dtype": d, "shape": s, "size": size, "data": raw[a : a + size] if data else None} for n, d, s, a, size in found]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("name", pa.string()), ("dtype", pa.string()), ("shape", pa.list_(pa.int64())), ("size", pa.int64()), ("data", pa.binary())]))

    out = files.mapInArrow(run, SCHEMA)
    out = out.where(F.col("name").rlike(include)) if include else out
    return out.where(~F.col("name").rlike(exclude)) if exclude else out


def written_safetensors(rows: list[tuple[str, str, list[int], bytes]]) -> bytes:
    """A safetensors file of (name, dtype, shape, data)."""
    header, at = {}, 0
    for name, dtype, shape, data in rows:
        header[name] = {"dtype": dtype, "shape": shape, "data_offsets": [at, at + len(data)]}
        at += len(data)
    text = json.dumps(header).encode()
    return struct.pack("<Q", len(text)) + text + b"".join(r[3] for r in rows)
