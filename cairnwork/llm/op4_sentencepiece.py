"""SentencePiece encoding and decoding by vectorised merge rounds.

The words of a chunk of documents become one flat array of symbols. Each round takes, word by word, the pair
of the best rank, merges it at its leftmost places in all words at once and closes the gaps, until no pair is left.

Rows: one for each input row, all other columns kept. A null text counts as empty; an empty text has only the
begin and end ids and decodes to an empty text. Repeated rows give equal results. Columns named ``ids`` or
``decoded`` in the input are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks

_SPACE_MARK = "▁"
_SEGMENT = re.compile(" +[^ ]*")
#: Bytes of text whose words are merged together; more bytes share more words.
CHUNK = 6 << 20
_NO_PAIR = np.int32(2**31 - 1)
#: Texts on which a model with another normaliser, prefix or white-space rule differs from what is merged here.
_PROBES = ["a", " a", "a ", "  a   b  ", "\ta\nb\r", "\ufb01 \u2163 \u00c5 e\u0301 \uff21", "\u3000a\u00a0b\u200b", "\x00a\x00", "\ufeffa", "\u2581a\u2581", "<s> </s> <unk> <0x41>"]


class MergeTable:
    """What merging needs of a byte-pair model: symbols, the pairs that join and the order in which they do.

    A symbol is a piece's id, or the number of pieces plus the code point for a character that is no piece.
    """

    def __init__(self, model_path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        m, n = self.model, self.model.vocab_size()
        if not any(m.is_byte(i) for i in range(n)):
            raise ValueError("a model with byte fallback is needed")
        pieces = {m.id_to_piece(i): i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}
        if any(_SPACE_MARK in p.lstrip(_SPACE_MARK) for p in pieces):
            raise ValueError("a piece reaches across words")
        self.size = n
        self.byte_ids = np.array([m.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.chars = np.arange(n, n + 0x110000, dtype=np.int32)
        for p, i in pieces.items():
            if len(p) == 1:
                self.chars[ord(p)] = i
        ranks = {s: r for r, s in enumerate(sorted({m.get_score(i) for i in pieces.values()}, reverse=True))}
        rank = {p: ranks[m.get_score(i)] for p, i in pieces.items()}
        symbol = lambda p: pieces.get(p, n + ord(p) if len(p) == 1 else None)
        pairs, risky, shared = [], set(), pd.Series(list(rank.values())).duplicated(keep=False)
        for (p, i), twin in zip(pieces.items(), shared, strict=True):
            if twin:
                risky.add(i)
            for k in range(1, len(p)):
                left, right = symbol(p[:k]), symbol(p[k:])
                if left is not None and right is not None:
                    pairs.append((left * (n + 0x110000) + right, rank[p], i))
                for half in (p[:k], p[k:]):
                    if half in pieces and rank[half] >= rank[p]:
                        risky.add(pieces[half])
        pairs.sort()
        self.keys, self.ranks, self.merged = (np.array(x, t) for x, t in zip(zip(*pairs, strict=True), (np.int64, np.int32, np.int32), strict=True))
        #: After such a merge a better pair may turn up beside it, so that its other places must wait.
        self.risky = np.zeros(n, bool)
        self.risky[list(risky)] = True
        self.longest = max(map(len, pieces))
        if [x.tolist() for x in self.encode(_PROBES)] != m.encode(_PROBES, add_bos=True, add_eos=True):
            raise ValueError("the model normalises or splits text in another way")

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) * (self.size + 0x110000) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], _NO_PAIR), np.where(hit, self.merged[at], 0)

    def merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words end to end, and each word's number of them."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        symbols, lengths = self.chars[points], np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), lengths)
        rank = np.full(len(symbols), _NO_PAIR)
        joined = np.zeros(len(symbols), np.int32)
        same = np.flatnonzero(word[1:] == word[:-1])
        rank[same], joined[same] = self.look_up(symbols[same], symbols[same + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(word)])
            best = np.minimum.reduceat(rank, starts)
            live = best != _NO_PAIR
            if not live.all():
                keep = np.repeat(live, sizes)
                done.append((word[~keep], symbols[~keep]))
                word, symbols, rank, joined = word[keep], symbols[keep], rank[keep], joined[keep]
                best, sizes = best[live], sizes[live]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(best, sizes))
            first = np.r_[True, word[at[1:]] != word[at[:-1]]]
            gap = np.diff(at, prepend=-self.longest - 3)
            run = np.maximum.accumulate(np.where((gap > 1) | first, np.arange(len(at)), 0))
            take = np.where(self.risky[joined[at]], first | (gap > self.longest + 1), (np.arange(len(at)) - run) % 2 == 0)
            at = at[take]
            symbols[at] = joined[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))
            word, symbols, rank, joined = word[keep], symbols[keep], rank[keep], joined[keep]
            near = np.r_[at, np.maximum(at - 1, 0)]
            inner = near[(near + 1 < len(word)) & (word[np.minimum(near + 1, len(word) - 1)] == word[near])]
            rank[near] = _NO_PAIR
            rank[inner], joined[inner] = self.look_up(symbols[inner], symbols[inner + 1])
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        word, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return symbols[order], np.bincount(word, minlength=len(words))

    def to_ids(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols, the UTF-8 bytes of a character that is no piece as one id each."""
        odd = np.flatnonzero(symbols >= self.size)
        if not len(odd):
            return symbols, lengths
        texts = [chr(x).encode() for x in symbols[odd] - self.size]
        width = np.ones(len(symbols), np.int64)
        width[odd] = np.fromiter(map(len, texts), np.int64, len(texts))
        ids = np.repeat(symbols, width)
        ids[np.repeat(symbols >= self.size, width)] = self.byte_ids[np.frombuffer(b"".join(texts), np.uint8)]
        owner = np.repeat(np.arange(len(lengths)), lengths)
        return ids, np.bincount(owner, weights=width, minlength=len(lengths)).astype(np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, begin and end included."""
        split = [_SEGMENT.findall(" " + t.replace(_SPACE_MARK, " ")) if t else [] for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        # Arrow numbers words by their whole bytes, U+0000 included.
        numbered = pa.array([w for ws in split for w in ws], pa.string()).dictionary_encode()
        codes = numbered.indices.to_numpy()
        words = [w.replace(" ", _SPACE_MARK) for w in numbered.dictionary.to_pylist()]
        ids, lengths = self.to_ids(*self.merge_words(words))
        ids = np.r_[ids, np.int32(self.model.bos_id()), np.int32(self.model.eos_id())].astype("<u4")
        lengths = np.r_[lengths, 1, 1]
        starts = np.cumsum(lengths) - lengths
        ends = np.cumsum(counts + 2)
        spread = np.full(int(ends[-1]) if len(ends) else 0, len(words))
        spread[ends - 1] = len(words) + 1
        inner = np.ones(len(spread), bool)
        inner[ends - 1] = inner[ends - counts - 2] = False
        spread[inner] = codes
        width = lengths[spread]
        total = np.cumsum(width)
        flat = ids[np.repeat(starts[spread] - total + width, width) + np.arange(int(total[-1]) if len(total) else 0)]
        return np.split(flat, total[ends - 1][:-1]) if len(texts) else []


@lru_cache(maxsize=2)
def merge_table(model_path: str) -> MergeTable:
    return MergeTable(model_path)


def encode_decode(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """docs with ``ids`` (binary, little-endian unsigned 32-bit, begin and end ids included) and ``decoded`` (string)."""
    docs = docs.drop("ids", "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = merge_table(model_path)
        for batch in batches:
            for part, data, offsets in chunks(batch, text, CHUNK):
                raw = data.tobytes()
                ids = table.encode([raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
                decoded = table.model.decode([x.tolist() for x in ids], num_threads=1)
                columns = [pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, "ids", "decoded"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]))


def default_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(encode_decode(docs, model_path or default_model_path()))


def digest(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_sentencepiece": op4_sentencepiece}
ORACLES: dict[str, str] = {}
