"""Mixing sources to target weights along a time-varying curriculum.

A source's weight is a line over training time; its integral, scaled to the source's target, says how many of its
words are wanted by any time. Documents stand in a fixed pseudo-random order within their source, again for each
epoch; a document's place in that order, put through the inverse of the integral, is its training position.

Rows: one for each input row; a null source is a source of its own (last in order), a null text has size 0, and
rows of size 0 are taken 0 times. Equal rows differ in place only. An empty table gives no rows. Of a document
only ``doc_id``, ``text`` and ``source`` are read. Sources are counted in one task: one row for each source.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, null_safe_text, word_count

#: Weights of the sources in order, repeating, and how far each weight leans to the end (+) or start (-) of training.
WEIGHTS = (5.0, 2.0, 1.0)
LEANS = (-0.5, 0.0, 0.5)
#: A source's target is at most this many times its size.
MAX_EPOCHS = 3
#: A source's order is cut into ranges that are summed apart, so many at least and more for more rows: no source is in one task.
RANGES, ROWS_EACH = 1024, 50_000


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, leans: Sequence[float] = LEANS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) with ``target`` and ``lean``.

    Sharing again and again what stands above a limit ends where every source below its limit has the same words
    for a unit of weight. Sources reach their limit in the order of limit / weight, so running sums find that level.
    """
    everything = W.orderBy(F.col("source").asc_nulls_last())
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("nth") % len(values) + 1).cast("int"))
    ranked = (
        sizes.withColumn("nth", F.row_number().over(everything) - 1)
        .withColumn("weight", pick([float(w) for w in weights]))
        .withColumn("lean", pick([float(x) for x in leans]))
        .withColumn("cap", F.col("source_size").cast("double") * max_epochs)
    )
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "nth").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy(F.lit(1))
    levels = ranked.withColumns(
        {
            "total": F.sum("source_size").over(whole).cast("double"),
            "capped": F.sum("cap").over(by_ratio) - F.col("cap"),
            "open_weight": F.sum("weight").over(whole) - F.sum("weight").over(by_ratio) + F.col("weight"),
        }
    ).withColumn("level", (F.col("total") - F.col("capped")) / F.col("open_weight"))
    free = levels.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("nth"), F.col("level")))).over(whole)["level"])
    return free.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))).select("source", "source_size", "target", "lean")


def position_of(share: Column, lean: Column) -> Column:
    """Training time in 0..1 by which this share of a source's demand has come, its rate being 1 + lean (2t - 1)."""
    a, b = lean, 1 - lean
    return F.when(F.abs(a) < 1e-9, share).otherwise((F.sqrt(F.greatest(b * b + 4 * a * share, F.lit(0.0))) - b) / (2 * a))


def turn() -> Column:
    """What sets the order within a source: a hash of doc_id, text and source."""
    return F.md5(F.concat_ws("\x1f", F.col("doc_id").cast("string"), F.md5(null_safe_text()), F.col("source")))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, leans: Sequence[float] = LEANS, max_epochs: int = MAX_EPOCHS, ranges: int | None = None) -> DataFrame:
    """One row for each document: doc_id, size, source, source_size, target, copies, taken, position (of its first copy)."""
    sized = docs.select("doc_id", "source", word_count(null_safe_text()).alias("size"), turn().alias("turn"))
    sized = cut(sized)
    ranges = ranges or max(RANGES, sized.count() // ROWS_EACH)
    # Ranges follow the turn, so that their number changes nothing in the order.
    sized = sized.withColumn("part", F.floor(F.conv(F.substring("turn", 1, 8), 16, 10).cast("double") / 2**32 * ranges).cast("int"))
    parts = sized.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    before = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)
    parts = parts.withColumn("before", F.sum("part_size").over(before) - F.col("part_size"))
    targets = source_targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, leans, max_epochs)
    parts = parts.alias("p").join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))).select("p.source", "part", "before", "source_size", "target", "lean")
    in_part = W.partitionBy("source", "part").orderBy("turn", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = (
        sized.withColumn("start", F.sum("size").over(in_part) - F.col("size"))
        .alias("d")
        .join(parts.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.part") == F.col("p.part")))
        .select("doc_id", "d.source", "size", "turn", (F.col("start") + F.col("before")).alias("start"), "source_size", "target", "lean")
    )
    # A copy is taken if the demand reaches its middle.
    epochs = F.floor((F.col("target") - F.col("start") - F.col("size") / 2) / F.col("source_size")) + 1
    placed = placed.withColumn("copies", F.when(F.col("size") > 0, F.least(F.greatest(epochs, F.lit(0)), F.lit(max_epochs))).otherwise(0).cast("long"))
    placed = cut(placed)
    # One document of each source then makes up for what the last copy is too long or too short.
    gaps = placed.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
    placed = placed.alias("d").join(gaps.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source"))).select("d.*", "gap")
    could = (F.col("size") > 0) & F.when(F.col("gap") > 0, F.col("copies") < max_epochs).otherwise(F.col("copies") > 0) & (F.col("size") < 2 * F.abs("gap"))
    choice = F.struct(F.abs(F.col("size") - F.abs("gap")).alias("off"), "turn", "doc_id", "start")
    fixes = placed.where(could).groupBy("source").agg(F.min(choice).alias("fix"))
    placed = placed.alias("d").join(fixes.alias("f"), F.col("d.source").eqNullSafe(F.col("f.source")), "left").select("d.*", "fix")
    chosen = F.coalesce((F.col("start") == F.col("fix.start")) & (F.col("turn") == F.col("fix.turn")) & (F.col("size") > 0), F.lit(False))
    copies = (F.col("copies") + F.when(chosen, F.signum("gap")).otherwise(0)).cast("long")
    share = F.least(F.col("start") / F.col("target"), F.lit(1.0))
    return placed.withColumn("copies", copies).select(
        "doc_id", "turn", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "start", "lean",
        F.when(F.col("copies") > 0, position_of(share, F.col("lean"))).alias("position"),
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, range-sorted by training position."""
    mixed = cut(mix(docs))
    keyed = docs.withColumn("mix_turn", turn())
    if not mixed.groupBy("turn").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        # Rows that agree in doc_id, text and source: the first by all columns stands for them, so reruns agree.
        row = F.struct(*docs.columns)
        keyed = keyed.groupBy("mix_turn").agg(F.min_by(row, F.to_json(row)).alias("mix_row")).select("mix_turn", "mix_row.*")
    epoch = F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))).alias("mix_epoch")
    share = F.least((F.col("start") + F.col("mix_epoch") * F.col("source_size")) / F.col("target"), F.lit(1.0))
    copies = mixed.where("copies > 0").select(F.col("turn").alias("mix_turn"), "start", "source_size", "target", "lean", epoch)
    copies = copies.select("mix_turn", "mix_epoch", position_of(share, F.col("lean")).alias("mix_position"))
    ordered = keyed.join(copies, "mix_turn").repartitionByRange("mix_position", "mix_turn", "mix_epoch")
    return ordered.sortWithinPartitions("mix_position", "mix_turn", "mix_epoch").select(*docs.columns)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    out = mixed.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position"))
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op3_mixing": op3_mixing}
ORACLES: dict[str, str] = {
    "op3_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(concat_ws(chr(31), CAST(doc_id AS VARCHAR), md5(coalesce(text, '')), source)) AS turn FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM d GROUP BY source),
r AS (SELECT *, [5e0, 2e0, 1e0][nth % 3 + 1] AS weight, [-5e-1, 0e0, 5e-1][nth % 3 + 1] AS lean, source_size * 3e0 AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - (sum(cap) OVER o - cap)) / (sum(weight) OVER () - sum(weight) OVER o + weight) AS level FROM r WINDOW o AS (ORDER BY cap / weight, nth ROWS UNBOUNDED PRECEDING)),
t AS (SELECT source, source_size, lean, least(cap, coalesce((SELECT level FROM l WHERE level * weight <= cap ORDER BY cap / weight, nth LIMIT 1) * weight, cap)) AS target FROM l),
p AS (SELECT d.doc_id, d.source, d.size, d.turn, t.source_size, t.target, t.lean, CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.turn, d.doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS start FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source),
c AS (SELECT *, CASE WHEN size > 0 THEN CAST(least(greatest(floor((target - start - size / 2e0) / source_size) + 1, 0), 3) AS BIGINT) ELSE 0 END AS copies FROM p),
e AS (SELECT *, target - sum(copies * size) OVER (PARTITION BY source) AS gap FROM c),
f AS (SELECT *, CASE WHEN size > 0 AND CASE WHEN gap > 0 THEN copies < 3 ELSE copies > 0 END AND size < 2 * abs(gap) THEN row_number() OVER (PARTITION BY source, size > 0 AND CASE WHEN gap > 0 THEN copies < 3 ELSE copies > 0 END AND size < 2 * abs(gap) ORDER BY abs(size - abs(gap)), turn, doc_id, start) END AS nth FROM e),
m AS (SELECT *, copies + CASE WHEN nth = 1 THEN CAST(sign(gap) AS BIGINT) ELSE 0 END AS final FROM f)
SELECT doc_id, size, source_size, target, CAST(final * size AS BIGINT) AS taken, CASE WHEN final > 0 THEN round(CASE WHEN lean = 0 THEN least(start / target, 1e0) ELSE (sqrt(greatest((1 - lean) * (1 - lean) + 4 * lean * least(start / target, 1e0), 0e0)) - (1 - lean)) / (2 * lean) END, 9) + 0e0 END AS position FROM m
"""
}
