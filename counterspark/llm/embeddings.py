"""Near-duplicate embeddings: random hyperplanes, exact cosines, components.

Vectors of one label get, in each of several tables, the signs of their products
with random hyperplanes; vectors with equal signs in a table are candidates.  The
number of signs grows with the logarithm of the rows, so buckets stay small, and the
number of tables follows from it so that a pair right at the threshold is missed with
probability ``MISS`` at most.  Equal vectors are one candidate with a multiplicity.
Buckets are compared in blocks of ``BLOCK`` x ``BLOCK`` in double precision, a hot
bucket by many tasks.  A pair counts in the first table only where its signs agree, so no
pair leaves a block: a block gives each vector's number of links and a spanning
forest, which are at most two numbers a member.

Defined results: a vector that is null, empty, zero or has a null or non-finite
component, or whose label is null, links with nothing and is its own component;
vectors of different lengths never link; a null vec_id has null component_id, keeps
``kept`` false and links with nothing; repeated rows of one vec_id are vectors of
their own in n_links; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, connected_components, lasting

THRESHOLD = 0.93
MISS = 0.001
BLOCK = 512
SEED = 11


def plan_tables(n: int, threshold: float, miss: float) -> tuple[int, int]:
    """(signs a table, tables) for ``n`` vectors."""
    agree = 1 - math.acos(threshold) / math.pi
    k = max(6, min(40, math.ceil(math.log2(max(2, n))) - 2))
    return k, max(1, math.ceil(math.log(miss) / math.log(1 - agree**k)))


def _planes(dim: int, k: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, k * tables))


def _signer(k: int, tables: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector's signs in all tables, one number a table."""
        planes: dict[int, np.ndarray] = {}
        power = (1 << np.arange(k, dtype=np.int64))
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column("v").to_pylist()
            keys = np.empty((len(vectors), tables), dtype=np.int64)
            for dim in {len(v) for v in vectors}:
                at = [i for i, v in enumerate(vectors) if len(v) == dim]
                if dim not in planes:
                    planes[dim] = _planes(dim, k, tables)
                bits = (np.array([vectors[i] for i in at], dtype=np.float64) @ planes[dim]) >= 0
                keys[at] = bits.reshape(len(at), tables, k) @ power
            own = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), tables).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("rep", "label", "v", "copies")] + [own], ["rep", "label", "v", "copies", "keys"])

    return sign


def spanning_forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest of the numbers 0 .. n - 1 that each reaches over the links (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)  # the roots take the smaller root
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(threshold: float):
    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        """Within each bucket of the group, or between the two sides of a hot bucket's block pair:
        per vector with links their number (with multiplicity) and the smallest vector that they join it to."""
        pdf = pdf.sort_values(["bucket", "side", "rep"], kind="stable")
        ids, side, bucket, copies, table = (pdf[c].to_numpy() for c in ("rep", "side", "bucket", "copies", "tab"))
        raw = np.stack(pdf["v"].to_list()).astype(np.float64)
        keys = np.stack(pdf["keys"].to_list())
        norm = (raw * raw).sum(axis=1)
        x = raw / np.sqrt(norm)[:, None]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(ids)]])
        out = []
        for s, e in zip(cuts[:-1], cuts[1:]):
            m = s + int(np.searchsorted(side[s:e], 1))  # where the second side begins
            if m == e:  # a bucket, or a block, with itself
                i, j = np.nonzero(np.triu(x[s:e] @ x[s:e].T >= threshold - 1e-9, 1))
                i, j = i + s, j + s
            else:
                i, j = np.nonzero(x[s:m] @ x[m:e].T >= threshold - 1e-9)
                i, j = i + s, j + m
            if not len(i):
                continue
            t = int(table[s])
            new = np.ones(len(i), dtype=bool)
            for earlier in range(t):  # in an earlier table the pair was counted there
                new &= keys[i, earlier] != keys[j, earlier]
            i, j = i[new], j[new]
            # the definition itself decides: dot product over the root of the squared norms' product
            keep = np.concatenate([np.einsum("ij,ij->i", raw[i[p:p + 4096]], raw[j[p:p + 4096]]) / np.sqrt(norm[i[p:p + 4096]] * norm[j[p:p + 4096]]) >= threshold for p in range(0, len(i), 4096)] or [np.empty(0, dtype=bool)])
            i, j = i[keep] - s, j[keep] - s
            if len(i):
                near = np.bincount(i, copies[s:e][j], e - s) + np.bincount(j, copies[s:e][i], e - s)
                root = spanning_forest(i, j, e - s)
                has = np.flatnonzero(near)
                out.append(pd.DataFrame({"a": ids[s:e][has], "near": near[has].astype(np.int64), "b": ids[s:e][root[has]]}))
        return pd.concat(out) if out else pd.DataFrame({c: np.empty(0, np.int64) for c in ("a", "near", "b")})

    return links


def near_duplicates(vectors: DataFrame, ws: Workspace, threshold: float = THRESHOLD, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label)."""
    v = F.col("embedding")
    finite = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    usable = F.coalesce(
        finite & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.exists(v, lambda x: x != 0), F.lit(False)
    )
    rows = ws.stash(
        vectors.select("vec_id", "label", usable.alias("ok"), v.alias("v"), F.sha1(F.to_json(F.struct(v.cast("array<double>").alias("v")))).alias("h")),
        "vectors",
    )
    # Equal vectors of a label act as one, with a multiplicity.
    reps = ws.stash(rows.where("ok").groupBy("label", "h").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "reps")
    n = reps.count()
    k, tables = plan_tables(n, threshold, miss)
    # by id and digest: an id may repeat with another vector
    one = rows.where("ok").join(reps.select(F.col("rep").alias("vec_id"), "label", "h", "copies"), ["vec_id", "label", "h"]).dropDuplicates(["vec_id", "label", "h"])
    one = one.select(F.xxhash64("label", "h").alias("rep"), "label", "v", "copies")
    kinds = dict(rows.dtypes)
    one = ws.stash(one.mapInArrow(_signer(k, tables), f"rep bigint, label {kinds['label']}, v {kinds['v']}, copies bigint, keys array<bigint>"), "signed")
    signed = one.select("rep", "label", F.size("v").alias("dim"), F.posexplode("keys").alias("tab", "bits"))
    key = ["label", "dim", "tab", "bits"]
    crowd = signed.groupBy(*key).agg(F.count("*").alias("m")).where("m > 1")
    members = signed.join(crowd, key).select("rep", "dim", "tab", F.xxhash64(*key).alias("bucket"), F.ceil(F.col("m") / block).cast("int").alias("cuts"))
    # Block pairs (i, j), i <= j: a bucket of up to BLOCK vectors is one block; a hot one is spread over many tasks.
    members = members.withColumn("cut", F.pmod(F.col("rep"), F.col("cuts")).cast("int"))
    placed = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).select(
        "rep", "dim", "tab", "bucket", "cuts", F.least("cut", "other").alias("i"), F.greatest("cut", "other").alias("j"), (F.col("cut") > F.col("other")).cast("int").alias("side")
    )
    # Small buckets share a call; a hot bucket has one for each pair of its blocks.
    groups = max(1, n * tables // 4096)
    placed = placed.withColumn("g", F.when(F.col("cuts") == 1, F.pmod(F.col("bucket"), F.lit(groups))).otherwise(F.col("bucket")))
    blocks = placed.drop("cuts").join(one.select("rep", "v", "keys", "copies"), "rep")
    found = ws.stash(blocks.groupBy("g", "i", "j", "dim").applyInPandas(_compare(threshold), "a bigint, near bigint, b bigint"), "links")

    who = reps.withColumn("key", F.xxhash64("label", "h"))
    degree = found.groupBy(F.col("a").alias("key")).agg(F.sum("near").alias("near"))
    ids = who.select("key", F.col("rep").alias("id"))
    forest = found.where("a <> b").select("a", "b").distinct()
    edges = forest.join(ids.withColumnRenamed("key", "a").withColumnRenamed("id", "x"), "a").join(ids.withColumnRenamed("key", "b").withColumnRenamed("id", "y"), "b")
    comp = connected_components(ws, edges.select("x", "y"), "x", "y")
    per = (
        who.join(degree, "key", "left").join(comp.withColumnRenamed("id", "rep"), "rep", "left")
        .select("label", "h", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    )
    good = rows.where("ok").select("vec_id", "label", "h").join(per, ["label", "h"]).select("vec_id", "n_links", "component_id")
    bad = rows.where("not ok").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(bad).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lasting(spark, "op4"))
