from __future__ import annotations

import pytest

import struct

from pyspark.sql import functions as F

from cairnwork.sources import formats


def gguf() -> bytes:
    text = lambda s: struct.pack("<Q", len(s)) + s.encode()
    head = struct.pack("<4sIQQ", b"GGUF", 3, 1, 2) + text("general.name") + struct.pack("<I", 8) + text("t") + text("list") + struct.pack("<IIQ", 9, 4, 2) + struct.pack("<II", 1, 2)
    head += text("weight") + struct.pack("<IQIQ", 1, 4, 0, 0)
    return head + b"\0" * (-len(head) % 32) + struct.pack("<4f", 1, 2, 3, 4)


def test_tensors(spark, tmp_path):
    (tmp_path / "a.safetensors").write_bytes(formats.written_safetensors([("b", "F32", [2], b"12345678"), ("a", "I8", [3], b"xyz")]))
    (tmp_path / "m.gguf").write_bytes(gguf())
    (tmp_path / "p.pt").write_bytes(b"\x80\x02pickle")
    rows = {r.name: r for r in formats.tensors(spark, str(tmp_path)).collect()}
    assert bytes(rows["b"].data) == b"12345678" and rows["a"].shape == [3] and rows["a"].dtype == "I8"
    assert rows["weight"].shape == [4] and struct.unpack("<4f", rows["weight"].data) == (1, 2, 3, 4)
    assert rows["p.pt"].size == 8
    listed = formats.tensors(spark, str(tmp_path), data=False, include="^[ab]$", exclude="^b$").collect()
    assert [(r.name, r.data) for r in listed] == [("a", None)]


def test_detection(spark):
    rows = [("x.SFT", b"", 0), ("x", gguf(), 100), ("x.bin", b"GGUF", 4), ("x", b"\x80\x02abcdefgh", 10), ("x", b"\x0aabcdefgh", 9), ("x", b"tiny", 4), ("x", struct.pack("<Q", 5) + b"{}", 50), ("x", b"\xff" * 16, 16)]
    frame = spark.createDataFrame(rows, "path string, content binary, length int")
    got = [tuple(r.d) for r in frame.select(formats.detected(F.col("path"), F.col("content"), F.col("length")).alias("d")).collect()]
    assert got == [("safetensors", 0.9), ("gguf", 0.95), ("pytorch", 0.9), ("pytorch", 0.95), ("onnx", 0.95), ("Unknown", 0.0), ("safetensors", 0.95), ("Unknown", 0.3)]


def test_records_come_back(spark):
    from pyspark.sql import functions as F

    from cairnwork.functions import codecs

    wide = spark.createDataFrame([(0, 0), (1, 255), (2**31, 2**40 + 7), (4294967295, 2**62)], "a long, b long")
    record = codecs.encoded(codecs.SEGMENT, {"magic": F.lit(b"ABCDEFGH"), "index": F.col("a"), "payload_size": F.col("b")}, codecs.BLOCK)
    back = wide.select("a", "b", F.octet_length(record).alias("n"), codecs.checked(codecs.SEGMENT, record, b"ABCDEFGH").alias("r")).collect()
    assert all((x.r["index"], x.r.payload_size, x.n, bytes(x.r.magic)) == (x.a, x.b, 4096, b"ABCDEFGH") for x in back)
    one = codecs.encoded(codecs.SUPERBLOCK, {"version": F.lit(3), "tile_count": F.lit(258)})
    assert bytes(spark.range(1).select(one.alias("x")).first().x)[8:40] == (3).to_bytes(4, "little") + bytes(20) + (258).to_bytes(8, "little")
    with pytest.raises(Exception, match="not a record"):
        spark.range(1).select(codecs.checked(codecs.SUPERBLOCK, one, b"OTHER").alias("r")).collect()


def test_json_and_hashes_in_their_form(spark):
    from pyspark.sql import functions as F

    from cairnwork.functions import codecs

    rows = spark.createDataFrame([('{"zebra":1, "apple": {"b": 2, "a": [1, 2]}}',), ("no",), (None,)], "t string").select(codecs.canonical_json("t").alias("j")).collect()
    assert [r.j for r in rows] == ['{"apple":{"a":[1,2],"b":2},"zebra":1}', None, None]
    text = spark.createDataFrame([("AB" * 32,), ("xy",)], "h string").select(codecs.hash_text(F.col("h")).alias("t"), codecs.parse_hash(F.col("h")).alias("b")).collect()
    assert text[0].t == "b3:" + "ab" * 32 and bytes(text[0].b) == b"\xab" * 32 and text[1].t is None and text[1].b is None
