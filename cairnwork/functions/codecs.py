"""Fixed-width little-endian records, canonical JSON and compressed payloads."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fields of a store's first block and of a segment's header with their bytes; x is left as it is, the rest are whole numbers.
SUPERBLOCK = (("magic", 8, "x"), ("version", 4, "u"), ("created_at", 8, "u"), ("modified_at", 8, "u"), ("segment_count", 4, "u"), ("tile_count", 8, "u"), ("total_size", 8, "u"), ("cell_count", 8, "u"), ("head_revision", 32, "x"), ("manifest_hash", 32, "x"), ("total_logical_bytes", 8, "u"), ("total_stored_bytes", 8, "u"), ("flags", 4, "u"))
SEGMENT = (("magic", 8, "x"), ("version_major", 4, "u"), ("version_minor", 4, "u"), ("index", 4, "u"), ("segment_type", 4, "u"), ("created_at_ns", 8, "u"), ("tile_count", 4, "u"), ("payload_offset", 8, "u"), ("payload_size", 8, "u"), ("index_offset", 8, "u"), ("index_size", 8, "u"), ("compression_flags", 4, "u"), ("checksum", 32, "x"), ("flags", 4, "u"))
# Fixed value: bytes of a first block and of a segment's header, zeros after the last field.
BLOCK = 4096
#: Bytes of recoded values that a task holds before it hands them on.
HELD = 1 << 21

Layout = Sequence[tuple[str, int, str]]


def _turned(hexed: Column, size: int) -> Column:
    return F.concat(*[F.substring(hexed, 2 * i + 1, 2) for i in reversed(range(size))])


def little_endian(number: Column, size: int) -> Column:
    """A whole number as so many bytes, the lowest first."""
    return F.unhex(_turned(F.lpad(F.hex(number.cast("long")), 2 * max(size, 8), "0").substr(2 * (max(size, 8) - size) + 1, 2 * size), size))


def encoded(layout: Layout, fields: dict[str, Column], size: int | None = None) -> Column:
    """A record of the layout: absent numbers are 0, absent bytes zeros; bytes are cut or filled to their width."""
    filled = lambda c, n: F.unhex(F.rpad(F.hex(c.cast("binary")), 2 * n, "0"))
    zeros = lambda n: F.unhex(F.lit("00" * n))
    parts = [zeros(n) if name not in fields else filled(fields[name], n) if kind == "x" else little_endian(fields[name], n) for name, n, kind in layout]
    width = sum(n for _, n, _ in layout)
    return F.concat(*parts, zeros(size - width)) if size and size > width else F.concat(*parts)


def decoded(layout: Layout, record: Column) -> Column:
    """The fields of a record as a struct; null where the record is too short. Numbers above the signed range turn negative."""
    out, at = [], 1
    for name, n, kind in layout:
        part = F.substring(record, at, n)
        out.append((part if kind == "x" else F.conv(_turned(F.hex(part), n), 16, -10).cast("long")).alias(name))
        at += n
    return F.when(F.octet_length(record) >= at - 1, F.struct(*out))


def checked(layout: Layout, record: Column, magic: bytes) -> Column:
    """decoded(), or an error where the record does not begin with its magic."""
    found = decoded(layout, record)
    return F.when(F.substring(record, 1, len(magic)) == F.lit(magic), found).otherwise(F.raise_error(F.lit("not a record of this kind")).cast(_type(layout)))


def _type(layout: Layout) -> T.StructType:
    return T.StructType([T.StructField(name, T.BinaryType() if kind == "x" else T.LongType()) for name, _, kind in layout])


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """JSON with sorted keys and no spaces; null where the text is none."""

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return text.map(one)


def hash_text(hash_hex: Column, prefix: str = "b3:") -> Column:
    """The prefixed text form of a hash, null unless it has 64 hex digits."""
    return F.when(hash_hex.rlike("^[0-9a-fA-F]{64}$"), F.concat(F.lit(prefix), F.lower(hash_hex)))


def parse_hash(text: Column, prefix: str = "b3:") -> Column:
    """The bytes of a hash in text form, with or without its prefix; null unless there are 32."""
    bare = F.regexp_replace(text, f"^{prefix}", "")
    return F.when(bare.rlike("^[0-9a-fA-F]{64}$"), F.unhex(bare))


def _recoded(tiles: DataFrame, column: str, work) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            start, values, held = 0, [], 0
            for i, x in enumerate(batch.column(at)):
                y = None if not x.is_valid else work(x.as_py())
                values.append(y)
                held += len(y or b"")
                if held >= HELD or i == batch.num_rows - 1:
                    yield batch.slice(start, len(values)).set_column(at, pa.field(column, pa.binary()), pa.array(values, pa.binary()))
                    start, values, held = i + 1, [], 0

    return tiles.mapInArrow(run, tiles.schema)


def compressed(tiles: DataFrame, column: str, codec: str = "zstd", level: int = 3) -> DataFrame:
    """tiles with a binary column compressed value by value; codec is none or zstd."""
    if codec == "none":
        return tiles
    if codec != "zstd":
        raise ValueError(f"no codec {codec}")

    def work(x: bytes) -> bytes:
        import zstandard

        return zstandard.ZstdCompressor(level=level).compress(x)

    return _recoded(tiles, column, work)


def decompressed(tiles: DataFrame, column: str, codec: str = "zstd") -> DataFrame:
    if codec == "none":
        return tiles
    if codec != "zstd":
        raise ValueError(f"no codec {codec}")

    def work(x: bytes) -> bytes:
        import zstandard

        return zstandard.ZstdDecompressor().decompress(x)

    return _recoded(tiles, column, work)
