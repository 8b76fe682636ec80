"""Helpers shared by the training-data operators.

* ``Workspace``: intermediate tables in the folder that the cluster names in
  ``spark.checkpoint.dir`` (written with Spark's committer, so a lost executor
  costs a retry and never a result).
* ``global_rank`` / ``running_total``: total order and prefix sums over tables of
  any size without a one-task window.
* ``connected_components``: large-star / small-star over an edge table.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of most contracts: what stands between these six white-space characters.
WORD_GAP = r"[\x20\x09-\x0D]+"

_LOCAL_DIRS: dict[str, str] = {}
_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` where it is set; a temporary folder only for an
    in-process (``local``) session, where driver and executors are one process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL_DIRS[app] = "file://" + folder
    return _LOCAL_DIRS[app]


class Workspace:
    """Named Parquet tables of one operator run under the shared folder.

    Results may read these tables lazily, so an operator drops only what no plan reads any
    more.  Whoever has written the result calls ``close`` (or uses the workspace as a
    context); what is still there when the driver's program ends is deleted then.
    """

    _open: weakref.WeakSet[Workspace] = weakref.WeakSet()

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        Workspace._open.add(self)

    def stash(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: cuts lineage, fixes the rows for every later use."""
        path = self.folder(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._workspace_path, out._workspace = path, self  # the table keeps its folder's owner
        return out

    def folder(self, name: str) -> str:
        self._n += 1
        return f"{self.path}/{name}-{self._n}"

    def drop(self, *tables: DataFrame | str) -> None:
        """Delete stashed tables that no pending plan reads any more."""
        for t in tables:
            path = t if isinstance(t, str) else getattr(t, "_workspace_path", None)
            if path:
                jvm = self.spark.sparkContext._jvm
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def close(self) -> None:
        """Delete all of it, once the result is written."""
        Workspace._open.discard(self)
        self.drop(self.path)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        self.close()


#: Workspaces whose results are read lazily: kept to the end of the program.
_lasting: list[Workspace] = []


def lasting(spark: SparkSession, label: str) -> Workspace:
    """A workspace for a result that is returned unread; it goes when the program ends."""
    if not _lasting:
        atexit.register(_sweep)
    _lasting.append(Workspace(spark, label))
    return _lasting[-1]


def _sweep() -> None:
    for ws in [*_lasting, *Workspace._open]:
        with contextlib.suppress(Exception):  # the session may be gone; its owner then clears the folder
            ws.close()


def tasks(spark: SparkSession, rows: int, per_task: int = 200_000) -> int:
    """Partitions for ``rows`` small rows; grows with the data, never below the session's setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def global_rank(ws: Workspace, df: DataFrame, order: list, rank: str, n_rows: int | None = None) -> tuple[DataFrame, int]:
    """``df`` with a gapless 0-based ``rank`` in the total order ``order``; and the row count.

    Range-partitions, sorts each partition, and adds each partition's offset: rows
    with equal leading keys are split by the later ones, so give a tie-breaker.
    Rows equal in every key are interchangeable.
    """
    parts = tasks(ws.spark, n_rows or 0)
    raw = ws.stash(
        df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()),
        "ranked",
    )
    pid = F.shiftright("_id", _ROW_BITS)
    local = F.col("_id").bitwiseAND((1 << _ROW_BITS) - 1)
    counts = raw.groupBy(pid.alias("_pid")).agg(F.count("*").alias("_n"))
    # At most ``parts`` rows, so one task and a broadcast are both bounded by the plan itself.
    offsets = counts.select(
        "_pid", "_n", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off")
    )
    offsets = ws.stash(offsets.coalesce(1), "offsets")
    total = offsets.agg(F.sum("_n")).first()[0] or 0
    ranked = (
        raw.withColumn("_pid", pid)
        .join(F.broadcast(offsets.select("_pid", "_off")), "_pid")
        .withColumn(rank, F.col("_off") + local)
        .drop("_pid", "_off", "_id")
    )
    return ranked, total


def running_total(ws: Workspace, df: DataFrame, by: list[str], bucket: str, order: list, value: str, out: str) -> DataFrame:
    """Exclusive prefix sum of ``value`` within ``by``, in the order (``bucket``, ``order``).

    ``bucket`` splits a hot ``by`` group over many tasks: sums run inside
    (by, bucket), and bucket totals give each bucket its offset.
    """
    inner = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("_local", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    totals = df.groupBy(*by, bucket).agg(F.sum(value).alias("_v"))
    upto = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*by, bucket, F.coalesce(F.sum("_v").over(upto), F.lit(0)).alias("_base"))
    return local.join(base, [*by, bucket]).withColumn(out, F.col("_base") + F.col("_local")).drop("_base", "_local")


def connected_components(ws: Workspace, edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component_id) for every id in ``edges``: the smallest id reachable.

    Large-star / small-star: each round moves only (id, id) pairs, minima combine
    before the shuffle, and a hub's rows are split by the adaptive skew join.
    """
    now = ws.stash(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges"
    )
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low2.select("u", F.col("m").alias("v")))
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
        )
        then = ws.stash(small, "edges")
        ws.drop(now)
        # done when all edges are stars: each end above has one edge, and no end below is one above
        ends = then.groupBy("u").agg(F.count("*").alias("up")).withColumn("down", F.lit(0)).union(then.select("v", F.lit(0), F.lit(1)).distinct())
        if not ends.groupBy("u").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 or up > 0 and down > 0").take(1):
            break
        now = then
    roots = then.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component_id"))
    return roots.union(then.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())


def field(name: str, rest: list[str]) -> str:
    """A column name like ``name`` that none of ``rest`` has (case-insensitively)."""
    low = {r.lower() for r in rest}
    while name.lower() in low:
        name = "_" + name
    return name


def utf8_bytes(col):
    """The UTF-8 bytes of a text column, null as empty."""
    return F.encode(F.coalesce(col, F.lit("")), "UTF-8")


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 512, mb: int = 32) -> Iterator[None]:
    """Bounds what one Arrow batch brings to a Python worker, for the actions inside; then the session is as it was.

    So that some hundred small jobs leave no long texts of their plans with the driver, these are cut too.
    """
    wanted = {
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": f"{mb}m",
        "spark.sql.maxPlanStringLength": "4096",
    }
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def slices(batch: pa.RecordBatch, text: int | str, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows with about ``most`` bytes of text, or one longer text alone."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = np.cumsum(size)
    at = 0
    while at < len(size):
        stop = max(at + 1, int(np.searchsorted(run, (run[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


# ---- words as hashes

_CHUNK = 1 << 18  # bytes whose hashes are worked out at a time
_M64 = (1 << 64) - 1
_R = 0x9E3779B97F4A7C15
_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = []

#: ASCII lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def hashed_words(raw: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, 64-bit hashes) of the runs of bytes for which ``is_word`` holds.

    Works in chunks, so besides the result it holds a bounded amount whatever the length;
    a word cut by a chunk's end is put together again.
    """
    if not _powers:
        for r in (_R, pow(_R, -1, 1 << 64)):
            p = np.full(_CHUNK + 1, r, dtype=np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    up, down = _powers
    place = np.int32 if len(raw) < 1 << 31 else np.int64
    out: list[list[np.ndarray]] = [[], [], []]
    open_end = False  # the last chunk ended inside a word
    for at in range(0, len(raw), _CHUNK):
        part = raw[at:at + _CHUNK]
        inside = np.zeros(len(part) + 2, dtype=np.int8)
        inside[1:-1] = is_word[part]
        edge = np.diff(inside)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_VALUE[part] * up[:len(part)], out=total[1:])
        h = (total[ends] - total[starts]) * down[starts]
        starts, ends = (starts + at).astype(place), (ends + at).astype(place)
        if open_end and len(starts) and starts[0] == at:
            before = int(at - out[0][-1][-1])
            out[2][-1][-1] = (int(out[2][-1][-1]) + pow(_R, before, 1 << 64) * int(h[0])) & _M64
            out[1][-1][-1] = ends[0]
            starts, ends, h = starts[1:], ends[1:], h[1:]
        open_end = bool(inside[-2])
        for o, x in zip(out, (starts, ends, h)):
            if len(x):
                o.append(x)
    kinds = (place, place, np.uint64)
    return tuple(np.concatenate(o) if o else np.empty(0, dtype=k) for o, k in zip(out, kinds))


def joined(texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(lower-cased bytes of all texts with a line end between them, where each begins and the end)."""
    parts = list(texts)
    raw = LOWER[np.frombuffer(b"\n".join(parts), dtype=np.uint8)]
    return raw, np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])]).astype(np.int64)


# ---- a bitmap that stops most rows before a shuffle

BITMAP_BITS = 1 << 23
_BLOCK_BITS = 32768  # of Spark's bitmap functions, whose positions count from 1


def bitmap_cell(col: Column) -> Column:
    """A column's cell, from 1, in a bitmap of BITMAP_BITS."""
    return F.pmod(F.xxhash64(col), F.lit(BITMAP_BITS)) + 1


def may_contain(values: DataFrame, col: str):
    """A test for columns of cells, false where ``values`` surely has no such ``col``; and its broadcast, to be destroyed after use.

    The bitmap has BITMAP_BITS / 8 bytes whatever it holds, so it can be broadcast; what
    it lets through must still be joined.  It saves the shuffle of what it stops.
    """
    spark = values.sparkSession
    cells = values.select(bitmap_cell(F.col(col)).alias("p"))
    blocks = cells.groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect()
    flat = np.zeros(BITMAP_BITS // 8, dtype=np.uint8)
    for r in blocks:
        at = (r["k"] - 1) * _BLOCK_BITS // 8
        flat[at:at + len(r["m"])] = np.frombuffer(bytes(r["m"]), dtype=np.uint8)
    bitmap = spark.sparkContext.broadcast(flat)

    @F.pandas_udf("boolean")
    def hit(p: pd.Series) -> pd.Series:
        v = p.to_numpy() - 1
        return pd.Series((bitmap.value[v >> 3] >> (v & 7).astype(np.uint8) & 1).astype(bool))

    return hit, bitmap
