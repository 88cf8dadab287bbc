"""N-gram Jaccard join by MinHash banding.

Texts with the same words are one class and are joined once. Each class gets MinHash bands; classes that share a band
are tied to the least of the band, never pair by pair, and connected pieces of these ties are the candidate groups.
Within a group every pair is verified on full n-gram sets by counting shared n-grams in blocks; a large group is cut
into tiles that meet in separate tasks. Links join classes into components.

Words are runs of anything but the six ASCII white spaces, unchanged; an n-gram is five words in a row, and a text of
one to four words has one n-gram, all its words. Rows: one for each input row. Null and empty texts have no n-grams,
link to nothing and are each a class of their own. Repeated rows count as copies. A null doc_id is as good as another
value, except that a class is named by its least doc_id (null if it has no other). Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SpanHasher, chunks, cut, mix, null_safe_text, numbered, owners, word_spans
from .components import components
from .tiles import least_in_component, meetings, shared_counts

N_GRAM = 5
THRESHOLD = (4, 5)  # a fraction: similarity is compared in whole numbers
TARGET_RECALL = 0.9995
MAX_HASHES = 192
#: Classes in a tile of a candidate group.
TILE = 1024


def choose_bands(similarity: float, recall: float = TARGET_RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band can have so that pairs of this similarity meet with this recall."""
    best = (1, 1)
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)) if similarity < 1 else 1
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def n_grams(data: np.ndarray, offsets: np.ndarray, n: int = N_GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams, each text's first n-gram, and hashes of whole word sequences (two columns)."""
    starts, ends, firsts = word_spans(data, offsets)
    words = SpanHasher.of_bytes(data)(starts, ends)
    run = SpanHasher(words)
    count = np.diff(firsts)
    grams = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    gram_firsts = np.r_[0, np.cumsum(grams)]
    begin = np.arange(gram_firsts[-1]) - np.repeat(gram_firsts[:-1] - firsts[:-1], grams)
    hashes = run(begin, begin + np.repeat(np.minimum(count, n), grams))
    # The second hash of a sequence adds up words mixed with their places, so that no sequence fools both.
    place = (np.arange(len(words)) - firsts[owners(firsts)]).astype(np.uint64)
    placed = np.r_[np.uint64(0), np.cumsum(mix(SpanHasher.of_bytes(data, 2)(starts, ends) + mix(place + np.uint64(1))), dtype=np.uint64)]
    whole = np.stack([run(firsts[:-1], firsts[1:]), placed[firsts[1:]] - placed[firsts[:-1]]], axis=1)
    return hashes, gram_firsts, whole


def band_hashes(grams: np.ndarray, firsts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A row of band hashes for each text that has n-grams, all of which must."""
    random = np.random.default_rng(11)
    mask, factor = (random.integers(0, 2**32, bands * rows, dtype=np.uint32) for _ in range(2))
    low = (grams >> np.uint64(32)).astype(np.uint32)
    least = np.empty((len(firsts) - 1, bands * rows), np.uint64)
    for k in range(bands * rows):
        mixed = (low ^ mask[k]) * (factor[k] | np.uint32(1))
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        least[:, k] = np.minimum.reduceat(mixed, firsts[:-1])
    out = np.empty((len(least), bands), np.uint64)
    for b in range(bands):
        part = SpanHasher(np.r_[least[:, b * rows : (b + 1) * rows].ravel(), np.uint64(0)])
        at = np.arange(len(least)) * rows
        out[:, b] = part(at, at + rows) ^ np.uint64((b * 0x9E3779B97F4A7C15) & (2**64 - 1))
    return out.view(np.int64)


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, k1, k2 (what texts of the same words share; null without words) and the bands of each row."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, k1 long, k2 long, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch):
                grams, firsts, whole = n_grams(data, offsets)
                some = np.diff(firsts) > 0
                lists = np.zeros(len(some) + 1, np.int32)
                np.cumsum(some * bands, out=lists[1:])
                values = band_hashes(grams, np.r_[firsts[:-1][some], firsts[-1]], bands, rows).ravel() if some.any() else np.zeros(0, np.int64)
                keys = [pa.array(whole[:, i].astype(np.uint64).view(np.int64), mask=~some) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *keys, pa.ListArray.from_arrays(lists, values)], names=["doc_id", "k1", "k2", "bands"])

    return docs.select("doc_id", null_safe_text().alias("text")).mapInArrow(run, schema)


def verify(ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one group: ids, the least id that links reach, and the weight of all linked rows. left and right say on which side a class stands."""
    grams, firsts, _ = n_grams(data, offsets)
    doc = owners(firsts)
    order = np.lexsort((grams, doc))
    new = np.ones(len(order), bool)
    new[1:] = (grams[order][1:] != grams[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    doc, grams = doc[order][new], grams[order][new]
    sizes = np.bincount(doc, minlength=len(ids))
    common = shared_counts(len(ids), doc, grams)
    up, down = threshold
    both = sizes[:, None] + sizes[None, :]
    linked = (common * (up + down) >= up * both) & ((left[:, None] & right[None, :]) | (right[:, None] & left[None, :]))
    np.fill_diagonal(linked, False)
    return ids[least_in_component(linked)], linked @ weights, linked.any(axis=1)


def link_classes(classes: DataFrame, docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(rep, class_rep, links) for the classes (rep, n, bands) that link to others; links counts rows of other classes."""
    each = classes.select("rep", F.explode("bands").alias("band"))
    least = each.groupBy("band").agg(F.min("rep").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    ties = each.join(least, "band").where("rep != least").select(F.col("rep").alias("a"), F.col("least").alias("b")).distinct()
    groups = cut(components(cut(ties)).withColumnRenamed("node", "rep").withColumnRenamed("label", "piece"))
    side = meetings(groups, tile)
    texts = docs.select(F.col("row_id").alias("rep"), "text").join(classes.select("rep", "n").join(groups.select("rep"), "rep", "left_semi"), "rep")
    rows = side.join(texts, "rep")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in frame.groupby("piece", sort=False):
            g = g.sort_values("rep", ignore_index=True)
            raw = [t.encode() for t in g.text]
            offsets = np.r_[0, np.cumsum([len(r) for r in raw])]
            to, links, some = verify(g.rep.to_numpy(), np.frombuffer(b"".join(raw), np.uint8), offsets, g.n.to_numpy(), g.left.to_numpy(), g.right.to_numpy(), threshold)
            out.append(pd.DataFrame({"rep": g.rep.to_numpy()[some], "to": to[some], "links": links[some]}))
        return pd.concat(out) if out else pd.DataFrame({"rep": [], "to": [], "links": []})

    found = cut(rows.groupBy("task").applyInPandas(run, "rep long, to long, links long"))
    label = components(found.where("rep != to").select(F.col("rep").alias("a"), F.col("to").alias("b")).distinct())
    return found.groupBy("rep").agg(F.sum("links").alias("links")).join(label.select(F.col("node").alias("rep"), F.col("label").alias("class_rep")), "rep")


def near_duplicates(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, recall: float = TARGET_RECALL, tile: int = TILE) -> DataFrame:
    """(row_id, class_rep, n_links) for docs (row_id long unique, text): links are rows of the same words or of similarity at the threshold."""
    bands, rows = choose_bands(threshold[0] / threshold[1], recall)
    signed = cut(signatures(docs.select(F.col("row_id").alias("doc_id"), "text"), bands, rows).withColumnRenamed("doc_id", "row_id"))
    classes = signed.where("k1 is not null").groupBy("k1", "k2").agg(F.min("row_id").alias("rep"), F.count("*").alias("n"), F.first("bands").alias("bands"))
    classes = cut(classes)
    linked = link_classes(classes, docs, threshold, tile)
    by_class = classes.select("k1", "k2", "rep", "n").join(linked, "rep", "left").select("k1", "k2", F.coalesce("class_rep", "rep").alias("class_rep"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return signed.select("row_id", "k1", "k2").join(by_class, ["k1", "k2"], "left").select("row_id", F.coalesce("class_rep", "row_id").alias("class_rep"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs without those that link to a row before them in their component; a null text becomes empty."""
    # Other columns travel as one value, so that their names cannot clash.
    rows, back = numbered(docs.select("doc_id", "text", F.struct("*").alias("document")), "document")
    later = near_duplicates(rows.select("row_id", "text")).where("row_id != class_rep").select("row_id")
    stay = rows.join(later, "row_id", "left_anti")
    return stay.select(*[(F.col("text") if c == "text" else F.col("document")[c]).alias(c) for c in docs.columns])


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, back = numbered(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return back(near_duplicates(docs), {"class_rep": "class_id"}).select("doc_id", "class_id", "n_links")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op8_jaccard": op8_jaccard}
ORACLES: dict[str, str] = {
    "op8_jaccard": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] ELSE list_transform(range(0, greatest(len(ws) - 4, 1)), lambda i: array_to_string(ws[i + 1:i + 5], ' ')) END) AS gram FROM w),
n AS (SELECT doc_id, count(*) AS size FROM g GROUP BY doc_id),
links AS (SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS common FROM g p JOIN g q ON q.gram = p.gram AND q.doc_id <> p.doc_id GROUP BY 1, 2) x JOIN n m ON m.doc_id = x.a JOIN n o ON o.doc_id = x.b WHERE 9 * common >= 4 * (m.size + o.size)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a)
SELECT c.doc_id, c.class_id, (SELECT count(*) FROM links l WHERE l.a = c.doc_id) AS n_links FROM c
"""
}
