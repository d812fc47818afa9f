"""Operator 6, mixing sources to target weights by a low-discrepancy schedule; DataFrame operations only.

1. Targets: sources share all words by weight; no target exceeds `MOST` times
   its source, and what is over is shared again by weight (the water level in
   closed form, from window sums over sources in the order of their caps).
2. Schedule: slot t takes the point frac(t * golden ratio), in integers, and
   the source in whose stretch of the cumulative targets the point falls.
3. Slots are numbered within their source, in two levels (chunks of slots, then
   within a chunk), so that no source's slots meet in one task.
4. A source's documents, in the order of a hash of their ids, form a stream cut
   into blocks of equal tokens; slot number k takes block k modulo the number of
   blocks, MOST times each at most. Where a document's stretch begins comes from
   two-level sums too.
5. A document is taken as often as the blocks that cover its words.
6. Slots are coarse beside a small source, so each source is settled to the word:
   from where its last slot ends its stream is taken further, or given back,
   until the target is reached. That touches the documents of a few blocks.

Null texts have no words; a null source is a source of its own, the last one;
repeated rows are documents of their own; an empty table gives no rows, and
without any words all targets are 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, stored, tidy

WEIGHTS, MOST = (1, 2, 3), 3
#: Points lie on 0 .. 2**31 - 1; the step is the golden ratio's, to the nearest odd number.
POINTS, STEP = 1 << 31, 1_327_217_885
CELLS = 1024
CHUNK = 4096
WORD = r"[^\x20\x09-\x0D]+"


def block_tokens(total: int) -> int:
    """Words in a block: about 64 * sqrt(total) slots, so that a source's error falls as the corpus grows and slots stay far fewer than words."""
    return max(1, math.floor(math.sqrt(total) / 64))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """From rows with source and _size: source, its number _s, source_size and target."""
    every = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*(F.lit(w) for w in WEIGHTS)), ((F.col("_s") % len(WEIGHTS)) + 1).cast("int"))
    own = sizes.groupBy("source").agg(F.sum("_size").alias("source_size"))
    own = own.withColumn("_s", (F.row_number().over(every) - 1).cast("long")).withColumn("_w", pick.cast("double"))
    by_cap = Window.orderBy(F.col("source_size") / F.col("_w"), "_s")
    up_to, from_here = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - MOST * F.coalesce(F.sum("source_size").over(up_to), F.lit(0))) / F.sum("_w").over(from_here)
    own = own.withColumn("_level", level).withColumn("_free", MOST * F.col("source_size") > F.col("_level") * F.col("_w"))
    # sources whose cap binds come first in this order, so the level of the first free one holds for all free ones
    own = own.withColumn("_level", F.max(F.when(F.col("_free"), F.struct(-F.col("source_size") / F.col("_w"), -F.col("_s"), F.col("_level")))).over(whole)["_level"])
    target = F.when(F.col("_free"), F.col("_level") * F.col("_w")).otherwise((MOST * F.col("source_size")).cast("double"))
    return own.select("source", "_s", "source_size", target.alias("target"))


def schedule(wanted: DataFrame, total: int) -> DataFrame:
    """_slot, _s, _rank: the source of each slot and the slot's number within it."""
    spark = wanted.sparkSession
    before = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    low = F.coalesce(F.sum("target").over(before), F.lit(0.0))
    edges = wanted.withColumn("_low", F.floor(low / total * POINTS)).withColumn("_high", F.floor((low + F.col("target")) / total * POINTS))
    last = Window.orderBy(F.desc("_s"))
    edges = edges.withColumn("_high", F.when(F.row_number().over(last) == 1, F.lit(POINTS)).otherwise(F.col("_high"))).filter("_low < _high")
    width = POINTS // CELLS
    edges = edges.select("_s", "_low", "_high", F.explode(F.sequence(F.floor(F.col("_low") / width), F.floor((F.col("_high") - 1) / width))).alias("_cell"))
    slots = spark.range(-(-total // block_tokens(total))).withColumnRenamed("id", "_slot")
    slots = slots.withColumn("_point", (F.col("_slot") % POINTS * STEP) % POINTS).withColumn("_cell", F.floor(F.col("_point") / width))
    slots = slots.join(edges, "_cell").filter("_point >= _low and _point < _high").select("_slot", "_s", F.floor(F.col("_slot") / CHUNK).alias("_chunk"))
    slots = stored(slots, "slots")
    so_far = Window.partitionBy("_s").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = slots.groupBy("_s", "_chunk").count().select("_s", "_chunk", F.coalesce(F.sum("count").over(so_far), F.lit(0)).alias("_base"))
    ranked = slots.withColumn("_rank", F.row_number().over(Window.partitionBy("_s", "_chunk").orderBy("_slot")) - 1)
    return ranked.join(base, ["_s", "_chunk"]).select("_slot", "_s", (F.col("_rank") + F.col("_base")).alias("_rank"))


def _without_words(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    named = wanted.select(F.col("source").alias("_source"), "source_size")
    return rows.join(named, F.col("source").eqNullSafe(F.col("_source"))).select(*rows.columns, "source_size", F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"))


def _stream(rows: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """The n rows with the columns of wanted and _start, where a document's words begin in its source's stream."""
    digits = max(2, math.ceil(math.log(max(1, n / 5_000), 16)))
    named = wanted.withColumnRenamed("source", "_source")
    own = rows.select("_row", "doc_id", "source", "_size").join(named, F.col("source").eqNullSafe(F.col("_source")))
    own = own.withColumn("_hash", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("_shard", F.substring("_hash", 1, digits))
    so_far = Window.partitionBy("_s").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    base = own.groupBy("_s", "_shard").agg(F.sum("_size").alias("_n")).select("_s", "_shard", F.coalesce(F.sum("_n").over(so_far), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_s", "_shard").orderBy("_hash", "doc_id", "_size", "_row").rowsBetween(Window.unboundedPreceding, -1)
    return own.withColumn("_inside", F.coalesce(F.sum("_size").over(inside), F.lit(0))).join(base, ["_s", "_shard"]).withColumn("_start", F.col("_inside") + F.col("_base"))


def _of_first(words: Column) -> Column:
    """How many of a document's words are among the first so many of its source's stream, taken round after round."""
    size = F.greatest("source_size", F.lit(1))
    return F.floor(words / size) * F.col("_size") + F.greatest(F.lit(0), F.least(F.col("_size"), words % size - F.col("_start")))


def _totals(rows: DataFrame):
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("_size"), F.lit(0)).alias("total")).collect()[0]  # one row


def mix(rows: DataFrame) -> DataFrame:
    """Adds source_size, target and taken to rows with doc_id, source, _size and a unique _row, which must be a written table."""
    stats = _totals(rows)
    wanted = targets(rows)
    if not stats["total"]:
        return _without_words(rows, wanted)
    per = block_tokens(stats["total"])
    wanted = stored(wanted, "targets")
    n_blocks = F.ceil(F.col("source_size") / per)
    slots = schedule(wanted, stats["total"]).join(wanted, "_s").filter(F.col("_rank") < MOST * n_blocks)
    times = stored(slots.groupBy("_s", (F.col("_rank") % n_blocks).alias("_block")).agg(F.count("*").alias("_times")), "times")
    wanted = wanted.join(times.groupBy("_s").agg(F.sum("_times").alias("_slots")), "_s", "left")
    # the words of a source's slots, whose last block may be short, and the words that it should have
    slots, size = F.coalesce("_slots", F.lit(0)), F.col("source_size")
    reached = F.floor(slots / n_blocks) * size + F.least(slots % n_blocks * per, size)
    wanted = wanted.withColumn("_reached", F.when(size > 0, reached).otherwise(F.lit(0)).cast("long")).withColumn("_words", F.least(F.round("target").cast("long"), MOST * size))
    own = _stream(rows, stored(wanted.drop("_slots"), "reached"), stats["n"])

    end = F.col("_start") + F.col("_size")
    spread = own.filter("_size > 0").select("_row", "_s", "_start", end.alias("_end"), F.explode(F.sequence(F.floor(F.col("_start") / per), F.floor((end - 1) / per))).alias("_block"))
    overlap = F.least("_end", (F.col("_block") + 1) * per) - F.greatest("_start", F.col("_block") * per)
    counted = spread.join(times, ["_s", "_block"]).groupBy("_row").agg(F.sum(overlap * F.col("_times")).alias("_blocks"))
    settled = (_of_first(F.col("_words")) - _of_first(F.col("_reached"))).alias("_settled")
    placed = own.select("_row", "source_size", "target", settled).join(counted, "_row", "left")
    taken = (F.coalesce("_blocks", F.lit(0)) + F.col("_settled")).cast("long").alias("taken")
    return rows.join(placed, "_row").select(*rows.columns, "source_size", "target", taken)


@tidy
def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents, with the columns of docs: a row for each time that a document is taken whole, and one with its first words for the rest."""
    from .common import BROADCAST_ROWS

    held = docs.select(F.struct("*").alias("_doc"), n_words(F.col("text")).alias("_size"), F.monotonically_increasing_id().alias("_row"))
    held = stored(held, "mixed")
    taken = mix(held.select("_row", F.col("_doc.doc_id").cast("long").alias("doc_id"), F.col("_doc.source").cast("string").alias("source"), "_size"))
    taken = stored(taken.filter("taken > 0").select("_row", "taken"), "taken")
    taken = F.broadcast(taken) if taken.count() <= BROADCAST_ROWS else taken
    rest = F.col("taken") % F.col("_size")
    times = F.floor(F.col("taken") / F.col("_size")) + F.when(rest > 0, 1).otherwise(0)
    copies = held.join(taken, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), times.cast("long"))))
    first = F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), rest.cast("string"), F.lit("}+"))
    part = (F.col("_copy") == times) & (rest > 0)
    text = F.when(part, F.call_function("regexp_extract", F.col("_doc.text"), first, F.lit(0))).otherwise(F.col("_doc.text"))
    copies = copies.withColumn("_new", text)
    new = {"text": F.col("_new"), "n_chars": F.char_length("_new")}
    return copies.select(*((new[f.name].cast(f.dataType) if f.name in new else F.col("_doc")[f.name]).alias(f.name) for f in docs.schema))


@tidy
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("_size"))
    rows = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "sizes")
    return mix(rows).select("doc_id", F.col("_size").alias("size"), "source_size", "target", "taken")


#: The same by closed form: a source's slots and what settles it are together the first words of its stream.
ORACLE_SQL = rf"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size from documents
), s as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as s from d group by source
), w as (
  select *, ((s % 3) + 1)::double as w from s
), l as (
  select *, ((sum(source_size) over ())::double - 3 * coalesce(sum(source_size) over (order by source_size / w, s rows between unbounded preceding and 1 preceding), 0)::double)
    / sum(w) over (order by source_size / w, s rows between current row and unbounded following) as own_level from w
), f as (
  select *, 3 * source_size > own_level * w as free from l
), t as (
  select source, s, source_size, case when free then (select own_level from f where free order by source_size / w, s limit 1) * w else (3 * source_size)::double end as target from f
), o as (
  select d.doc_id, d.size, t.source_size, t.target, least(round(t.target)::bigint, 3 * t.source_size) as words, greatest(t.source_size, 1) as n,
    coalesce(sum(d.size) over (partition by t.s order by md5(d.doc_id::varchar), d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0)::bigint as first
  from d join t on d.source is not distinct from t.source
)
select doc_id, size, source_size, target, (words // n * size + greatest(0, least(size, words % n - first)))::bigint as taken from o
"""
