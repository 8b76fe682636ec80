"""A corpus pipeline: language, near copies, benchmark leaks, mix, shards.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns the columns of documents, whatever they are called; the last adds each document's
place (``shard`` and ``slot``, with an underscore before it if documents have such a column).

Defined results, for every stage: an empty table gives no rows; rows that repeat are rows of
their own until the second stage, which leaves one; a null doc_id is a document's like any
other, and such documents are in no group of copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterspark.llm.common import Workspace, field, lasting
from counterspark.llm.decontamination import find_contamination
from counterspark.llm.jaccard_join import JaccardJoin
from counterspark.llm.langid import UND, held_out, identify, train
from counterspark.llm.mixing import mix_sources
from counterspark.llm.sharding import shard_by_curve

#: A language must have the majority of the probability.
LEAST_SCORE = 0.5
#: Near copies share 80 per cent of their five-word shingles.
COPY_WORDS = 5
COPY_PERCENT = 80
N_SHARDS = 8

#: No SQL form: a trained model, a component search and a schedule are among the stages.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; those without text or letters, or of no clear language, go.

    A null lang teaches nothing and its document is judged like any other.
    """
    lang, score = (field(c, docs.columns) for c in ("lang_pred", "lang_score"))
    found = identify(docs, train(docs.where(~held_out(4, 2))), docs.columns, lang, score)
    return found.where((F.col(lang) != UND) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: the one with the smallest id (then text hash).

    A document without an id is in no group and stays; of repeated rows one stays; an id
    that repeats with another text is a document of its own.
    """
    h = field("text_hash", docs.columns)
    groups = JaccardJoin(docs, lasting(spark, "stage-join"), words=COPY_WORDS, percent=COPY_PERCENT).components(with_hash=True)
    firsts = groups.where((F.col("doc_id") == F.col("first.doc_id")) & (F.col("h") == F.col("first.h")))
    firsts = firsts.select("doc_id", F.col("h").alias(h)).distinct()
    one = docs.withColumn(h, F.xxhash64("text")).join(firsts, ["doc_id", h]).dropDuplicates(["doc_id", h])
    return one.select(*docs.columns).union(docs.where("doc_id is null"))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage; a null text has none."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    spans = field("spans", docs.columns)
    return find_contamination(docs, benchmark, docs.columns).where(F.size(spans) == 0).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, to the nearest whole time (half a time is rounded up); never taken, they go.

    Repeated rows that the mix takes differently all get the larger number; a document
    without words is never taken.
    """
    taken, _ = mix_sources(docs, lasting(spark, "stage-mix"))
    d, h, times, copy = (field(c, docs.columns) for c in ("mix_id", "mix_hash", "mix_times", "mix_copy"))
    often = taken.where("size > 0").select(
        F.col("doc_id").alias(d), F.col("hash").alias(h), F.round(F.col("taken") / F.col("size")).cast("int").alias(times)
    ).groupBy(d, h).agg(F.max(times).alias(times)).where(F.col(times) > 0)
    match = F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64("doc_id", "text") == F.col(h))
    return docs.join(often, match).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard and its slot there, in Hilbert order."""
    placed = shard_by_curve(docs, N_SHARDS, lasting(spark, "stage-shard"), docs.columns)
    return placed.select(*docs.columns, field("shard", docs.columns), field("slot", docs.columns))


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", leaks),
    ("mixing sources to target weights", mix),
    ("sharding", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws: Workspace = lasting(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = ws.stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            ws.drop(before)
        before = docs
    return docs
