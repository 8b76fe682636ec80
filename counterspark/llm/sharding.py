"""Sharding by a Hilbert curve over document metadata.

Language, source and length are quantised to ``bits`` bits each; a Hilbert index
of the three orders the corpus so that neighbours agree in all dimensions, and the
order is cut into runs of equal row counts.  Each shard then covers a small box of
metadata, and min/max statistics prune files on any of the dimensions.

A language or a source is quantised by at most ``2**bits`` cut points, taken evenly from
its distinct values in order; a length by the share of rows that are shorter, to a 64th of an
octave.  The cut points are all that reaches the tasks, so
coding a row is a look-up and no join, and the rows themselves, with whatever columns they
keep, are shuffled once, into the curve's order.

Defined results: null language or source sorts before every value; a null text has
length 0; equal texts with equal metadata stay side by side (tie-break: text hash,
then doc_id), so exact copies meet unless a cut falls inside their run; repeated
rows are separate rows; an empty table gives no rows; columns that are kept may have any
name, also those of the result's own columns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, field, global_rank, lasting, utf8_bytes

BITS = 10


def hilbert_index(coords: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of each column of ``coords`` (dims x rows, ints below 2**bits)."""
    x = [c.astype(np.int64).copy() for c in coords]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo excess rotations, from the high bit down
        low = q - 1
        for i in range(n):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(hit, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):  # Gray encode
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x = [c ^ flip for c in x]
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            index = (index << 1) | ((c >> b) & 1)
    return index


def cut_points(ws: Workspace, df: DataFrame, col: str, bits: int) -> list[tuple[str, int]]:
    """(least value, code) of each code in 0 .. 2**bits - 1 that the distinct values of ``col`` take, spread evenly, in order.

    2**bits rows at most come to the driver; the null value's code is 0 and no row.
    """
    values = df.groupBy(col).agg(F.count("*").alias("_n")).select(F.col(col).cast("string").alias("_v"))
    ranked, n = global_rank(ws, values, [F.col("_v").asc_nulls_first()], "_r")
    top = (1 << bits) - 1
    code = F.floor(F.col("_r") * F.lit(float(top)) / F.lit(float(max(1, n - 1)))).cast("int")
    cuts = ranked.where("_v is not null").groupBy(code.alias("_code")).agg(F.min("_v").alias("_v")).orderBy("_code").collect()
    return [(r["_v"], r["_code"]) for r in cuts]


def code_of(values, cuts: list[tuple[str, int]]) -> np.ndarray:
    """The code of each value; null has 0, as a value below every cut has."""
    at = np.searchsorted(np.array([v for v, _ in cuts], dtype=object), np.array(["" if v is None else v for v in values], dtype=object), side="right")
    codes = np.array([0, *(c for _, c in cuts)], dtype=np.int64)[at]
    codes[[v is None for v in values]] = 0
    return codes


def length_step(size):
    """A column of sizes (1 or more) on a log scale of 64 steps an octave."""
    return F.floor(F.log2(size.cast("double")) * 64).cast("int")


def length_codes(steps: dict[int, int], bits: int) -> np.ndarray:
    """The code of each step by the rows below it (``steps``: rows by step), so lengths spread as rows do."""
    out, below, n = np.zeros(max(steps, default=0) + 1, dtype=np.int64), 0, sum(steps.values())
    for s in sorted(steps):
        out[s] = (below << bits) // n
        below += steps[s]
    return out


def _curve(langs: list, sources: list, lengths: np.ndarray, bits: int):
    @F.pandas_udf("bigint")
    def curve(lang: pd.Series, source: pd.Series, step: pd.Series) -> pd.Series:
        coords = np.stack([code_of(lang.to_list(), langs), code_of(source.to_list(), sources), lengths[np.minimum(step.to_numpy(), len(lengths) - 1)]])
        return pd.Series(hilbert_index(coords, bits))

    return curve


def shard_by_curve(docs: DataFrame, n_shards: int, ws: Workspace, keep: list[str] | None = None, bits: int = BITS) -> DataFrame:
    """The columns ``keep`` (doc_id if not given) and size, text_crc32, curve, shard, slot, one row per input row.

    A kept column with the name of one of these stands; the result's own then has underscores before it.
    """
    keep = ["doc_id"] if keep is None else keep
    raw = utf8_bytes(F.col("text"))
    size = F.length(raw).cast("bigint") + 1
    cuts = [cut_points(ws, docs, c, bits) for c in ("lang", "source")]
    steps = {r[0]: r[1] for r in docs.groupBy(length_step(size)).count().collect()}  # 64 rows an octave at most
    meta = docs.select(
        *[F.col(k).alias(f"k{i}") for i, k in enumerate(keep)], F.col("doc_id").alias("id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        size.alias("size"), F.crc32(raw).alias("crc"), F.xxhash64("text").alias("h"),
    )
    coded = meta.withColumn("curve", _curve(*cuts, length_codes(steps, bits), bits)("lang", "source", length_step(F.col("size")))).drop("lang", "source")
    ranked, n = global_rank(ws, coded, ["curve", "crc", "h", F.col("id").asc_nulls_first()], "rank", sum(steps.values()))
    n = max(n, 1)
    own = {c: field(c, keep) for c in ("size", "text_crc32", "curve", "shard", "slot")}
    first = F.expr(f"(shard * {n} + {n_shards - 1}) div {n_shards}")
    return ranked.withColumn("shard", F.expr(f"rank * {n_shards} div {n}").cast("int")).select(
        *[F.col(f"k{i}").alias(k) for i, k in enumerate(keep)], F.col("size").alias(own["size"]), F.col("crc").alias(own["text_crc32"]),
        F.col("curve").alias(own["curve"]), F.col("shard").alias(own["shard"]), (F.col("rank") - first).alias(own["slot"]),
    )


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_by_curve(docs, 8, lasting(spark, "op3")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


def write_shards(sharded: DataFrame, path: str, rows_per_file: int = 1_000_000, shard: str = "shard", slot: str = "slot") -> None:
    """One folder per shard, files of runs of the curve: their min/max statistics prune on every dimension."""
    (
        sharded.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot)
        .write.partitionBy(shard).option("maxRecordsPerFile", rows_per_file).parquet(path)
    )
