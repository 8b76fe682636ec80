"""Mixing sources to target weights with a low-discrepancy schedule.

Points of the golden-ratio sequence, mapped through the sources' cumulative shares,
say which source fills each slot; the slots of a source are ranked; rank r takes the
r-th block of ``block_tokens`` words from the source's shuffled documents, laid end
to end and repeated when they run out.  Every prefix of the schedule holds the
sources in their proportions to within a few slots.  A source's last slot is cut at
its target, and a source that the sequence leaves a slot short gets it at the end,
so the whole mix meets its targets to one word.

Defined results: sources sort by code point, null last and as a source of its own;
an empty-string source is an ordinary one; documents without words are never taken;
repeated rows count as documents of their own; with no words at all every target is
0; an empty table gives no rows; further columns are ignored.  The shuffle is a hash
of the id, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_GAP, Workspace, global_rank, lasting, running_total, tasks

WEIGHTS = (5, 2, 1)
BLOCK_TOKENS = 1024
_CELLS = 1024
_GOLDEN = (math.sqrt(5) - 1) / 2
_LOW_BITS = 20


def n_words(col):
    """Words between the contract's six white-space characters; null has none."""
    s = F.coalesce(col, F.lit(""))
    return F.size(F.filter(F.split(s, WORD_GAP), lambda w: w != "")).cast("bigint")


def source_targets(ws: Workspace, sizes: DataFrame, share: float, cap: float, weights: tuple = WEIGHTS) -> tuple[DataFrame, int]:
    """(source, idx, source_size, target), and the number of sources.

    ``share`` of all words by weight, none above ``cap`` times its words: the sources that the
    common level fills up leave what they cannot take to the others, whose level
    rises, until it fills none up.  Every step is one sum over the sources, however many.
    """
    per = ws.stash(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "per_source")
    ranked, n = global_rank(ws, per, [F.col("source").asc_nulls_last()], "_r")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("_r"), F.lit(len(weights))) + 1).cast("int"))
    per = ws.stash(ranked.select("source", F.col("_r").cast("int").alias("idx"), "source_size", w.alias("weight"), (F.col("source_size") * F.lit(cap)).alias("cap")), "weighted")
    total = (per.agg(F.sum("source_size")).first()[0] or 0) * share
    level, full = 0.0, None
    while True:
        over = F.col("cap") <= F.lit(level) * F.col("weight")
        capped, free, filled = per.agg(F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight"))), F.count_if(over)).first()
        if not free or filled == full:
            break
        level, full = max(0.0, (total - (capped or 0.0)) / free), filled
    target = F.least("cap", F.lit(level) * F.col("weight")) if free else F.col("cap")
    return per.select("source", "idx", "source_size", target.alias("target")), n


def _golden(n):
    """Fractional part of n * golden ratio, exact to 1e-10 for any slot number."""
    high = F.shiftright(n, _LOW_BITS)
    low = n.bitwiseAND((1 << _LOW_BITS) - 1)
    step = math.fmod(_GOLDEN * (1 << _LOW_BITS), 1.0)
    a = high * F.lit(step)
    a = a - F.floor(a)
    x = a + low * F.lit(_GOLDEN)
    return x - F.floor(x)


def schedule(ws: Workspace, targets: DataFrame, total: float, block_tokens: int, n_sources: int = 1) -> DataFrame:
    """(slot, idx, rank, tokens): which source's which block fills each slot, and how much of it."""
    cells_in_all = max(_CELLS, 4 * n_sources)
    spark = ws.spark
    n_slots = max(1, math.ceil(total / block_tokens)) if total > 0 else 0
    quota = targets.withColumn("_quota", F.floor("target").cast("bigint")).where("_quota > 0")
    quota = quota.withColumn("_slots", F.ceil(F.col("_quota") / F.lit(float(block_tokens))).cast("bigint"))
    whole = quota.agg(F.sum("_quota")).first()[0] or 1
    cum = running_total(ws, quota.withColumn("_run", F.expr("idx div 4096")), [], "_run", ["idx"], "_quota", "_lo")
    share = cum.select("idx", "_quota", "_slots", (F.col("_lo") / F.lit(whole)).alias("_a"), ((F.col("_lo") + F.col("_quota")) / F.lit(whole)).alias("_b"))
    share = ws.stash(share, "shares")
    # Equal cells turn the range look-up into a hash join of a few rows a cell.
    cells = share.withColumn(
        "_cell", F.explode(F.sequence(F.floor(F.col("_a") * cells_in_all).cast("int"), F.least(F.floor(F.col("_b") * cells_in_all), F.lit(cells_in_all - 1)).cast("int")))
    )
    slots = (
        spark.range(0, n_slots, 1, tasks(spark, n_slots)).withColumnRenamed("id", "slot")
        .withColumn("_x", _golden(F.col("slot") + 1)).withColumn("_cell", F.floor(F.col("_x") * cells_in_all).cast("int"))
    )
    placed = slots.join(cells, "_cell").where("_x >= _a and _x < _b").select(
        "slot", "idx", F.expr("slot div 65536").alias("_span"), F.lit(1).alias("_one")
    )
    placed = ws.stash(placed, "placed")
    ranked = running_total(ws, placed, ["idx"], "_span", ["slot"], "_one", "rank").select("slot", "idx", "rank")
    had = placed.groupBy("idx").agg(F.count("*").alias("_had"))
    short = (
        share.join(had, "idx", "left").withColumn("_had", F.coalesce("_had", F.lit(0)))
        .where("_had < _slots")
        .select("idx", F.explode(F.sequence("_had", F.col("_slots") - 1)).alias("rank"))
        .select(F.lit(n_slots).cast("bigint").alias("slot"), "idx", "rank")
    )
    both = ranked.union(short).join(share.select("idx", "_quota"), "idx")
    left = F.col("_quota") - F.col("rank") * block_tokens
    return both.withColumn("tokens", F.least(F.lit(block_tokens).cast("bigint"), left)).where("tokens > 0").drop("_quota")


def mix_sources(docs: DataFrame, ws: Workspace, share: float = 1.5, cap: float = 2.0, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(per document, spans).

    Documents: doc_id, size, source, source_size, target, taken, the hash of id and text, and a row number ``row``.
    Spans: slot, row, doc_id, pass, start, words -- what the mix reads, in its order.
    """
    spark = docs.sparkSession
    sizes = ws.stash(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("_h")), "sizes")
    stats = sizes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    targets, n_sources = source_targets(ws, sizes, share, cap)
    targets = ws.stash(targets, "targets")
    # small buckets as long as there are few, so that one source is spread over many tasks
    n_buckets = max(1, min(4096, stats[0] // 1_000), -(-stats[0] // 20_000))
    tape = sizes.withColumnRenamed("source", "_s").join(targets, F.col("_s").eqNullSafe(F.col("source"))).drop("_s")
    tape = tape.withColumn("_bucket", F.pmod(F.col("_h"), F.lit(n_buckets)).cast("int"))
    full = running_total(ws, tape, ["idx"], "_bucket", ["_h", F.col("doc_id").asc_nulls_first()], "size", "offset")
    full = ws.stash(full.withColumn("row", F.monotonically_increasing_id()).withColumnRenamed("_h", "hash").drop("_bucket"), "tape")

    B = block_tokens
    pieces = (
        full.where("size > 0")
        .select("row", "doc_id", "idx", "offset", "size", "source_size", F.explode(F.expr(f"sequence(offset div {B}, (offset + size - 1) div {B})")).alias("block"))
    )
    slots = schedule(ws, targets, share * stats[1], B, n_sources)
    # A source's tape is a ring: slot r covers [r * B, r * B + tokens) of the endless tape.
    # Its blocks need not line up after the first pass, so a slot looks up each ring block it touches.
    ring = slots.join(targets.select("idx", F.col("source_size").alias("_ring")), "idx")
    ring = ring.withColumn("_from", F.col("rank") * B)
    ring = ring.withColumn(
        "_cut", F.explode(F.expr("sequence(_from div _ring, (_from + tokens - 1) div _ring)"))
    ).select(
        "slot", "idx", F.col("_cut").alias("pass"),
        (F.greatest("_from", F.col("_cut") * F.col("_ring")) - F.col("_cut") * F.col("_ring")).alias("_a"),
        (F.least(F.col("_from") + F.col("tokens"), (F.col("_cut") + 1) * F.col("_ring")) - F.col("_cut") * F.col("_ring")).alias("_b"),
    )
    ring = ring.withColumn("block", F.explode(F.expr(f"sequence(_a div {B}, (_b - 1) div {B})")))
    ring = ring.withColumn("_a", F.greatest("_a", F.col("block") * B)).withColumn("_b", F.least("_b", (F.col("block") + 1) * B))
    hit = pieces.join(ring, ["idx", "block"])
    start = F.greatest("_a", "offset", F.col("block") * B)
    stop = F.least(F.col("_b"), F.col("offset") + F.col("size"), (F.col("block") + 1) * B)
    spans = hit.select(
        "slot", "row", "doc_id", "pass", (start - F.col("offset")).alias("start"), (stop - start).alias("words")
    ).where("words > 0")
    taken = spans.groupBy("row").agg(F.sum("words").alias("_t"))
    out = full.join(taken, "row", "left").withColumn("taken", F.coalesce("_t", F.lit(0)).cast("bigint")).drop("_t", "offset", "idx")
    return out, spans


def op1_golden_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out, _ = mix_sources(docs, lasting(spark, "op1"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source")
