"""Token counts with a digest cache.

A count depends on two things only: the content and the tokenizer's version.  The
cache is a table (tokenizer_digest, content_digest, n_bytes, n_tokens).  A run

1. digests every text in the JVM (no text leaves the scan),
2. anti-joins the distinct digests with the cache,
3. sends exactly one document per missing digest to the tokenizer, whole,
4. appends those counts to the cache, and
5. joins every document to its count by digest.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows and
equal texts share one encoding and keep one output row each; an empty table gives
no rows; further columns, also ones named like the output's, are ignored.  Very
long texts are encoded whole, alone in their batch.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .common import Workspace, bitmap_cell, lasting, may_contain, slices, utf8_bytes

CACHE_SCHEMA = "tokenizer_digest binary, content_digest binary, n_bytes bigint, n_tokens bigint"
_BATCH_BYTES = 1 << 21
_MEMO = 1 << 18  # pre-tokens whose counts a worker remembers


def tokenizer_digest(name: str) -> bytes:
    with open(public_tokenizers.path(name), "rb") as f:
        return hashlib.sha256(f.read()).digest()


def _counter(name: str):
    """texts -> token counts, as the file's own library gives them."""
    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        return _by_pretoken(tok)
    if name.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    raise ValueError(f"no library for {name}")


#: What byte-level tokenizers split before their merges, as their library does.
_PRETOKEN = regex.compile(public_tokenizers.PATTERN)
#: Characters outside this set, whose classes may differ between Unicode versions or libraries.
_UNUSUAL = regex.compile(r"[^\t\n\r\x20-\x7e\xa0-\u024f\u2010-\u2027\u20ac]")


def _by_pretoken(tok):
    """Counts by pre-token: the library encodes each distinct pre-token once, a worker remembers its count.

    The model never looks across pre-tokens.  Texts with a string of an added token or
    an unusual character, and tokenizers of another make, get the library's whole encoding.
    """
    setup = json.loads(tok.to_str())
    split = setup.get("pre_tokenizer") or {}
    plain = setup.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    added, memo = [t["content"] for t in setup.get("added_tokens", [])], {}
    whole = lambda text: len(tok.encode(text, add_special_tokens=False))

    def one(text: str) -> int:
        if not plain or any(a in text for a in added) or _UNUSUAL.search(text):
            return whole(text)
        n = 0
        for piece in _PRETOKEN.findall(text):
            c = memo.get(piece)
            if c is None:
                c = whole(piece)
                if len(memo) < _MEMO and len(piece) <= 64:
                    memo[piece] = c
            n += c
        return n

    return lambda texts: [one(t) for t in texts]


def _encoder(name: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(name)
        for whole in batches:
            for batch in slices(whole, "text", _BATCH_BYTES):
                n = count([x or "" for x in batch.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("content_digest"), batch.column("n_bytes"), pa.array(n, pa.int64())],
                    ["content_digest", "n_bytes", "n_tokens"],
                )

    return encode


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException:  # no run has written it yet
        return spark.createDataFrame([], CACHE_SCHEMA)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, ws: Workspace, over: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row; misses are appended to ``cache``."""
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer)
    raw = utf8_bytes(F.col("text"))
    digest = F.unhex(F.sha2(raw, 256))
    keys = ws.stash(
        docs.select("doc_id", digest.alias("content_digest"), F.length(raw).cast("bigint").alias("n_bytes")), "keys"
    )
    known = read_cache(spark, cache).where(F.col("tokenizer_digest") == F.lit(bytearray(version)))
    misses = (
        keys.groupBy("content_digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("_c"))
        .join(known.select("content_digest"), "content_digest", "left_anti")
    )
    # Most texts occur once and are new: they are encoded where they are read.  A bitmap of
    # fixed size has every digest that is repeated or known; what it hits (a few new ones too)
    # is decided by an exact join, and only those texts are shuffled.
    hit, bitmap = may_contain(misses.where("_c > 1").select("content_digest").union(known.select("content_digest")), "content_digest")
    texts = docs.select("doc_id", "text", digest.alias("content_digest"), F.length(raw).cast("bigint").alias("n_bytes"))
    texts = texts.withColumn("_p", bitmap_cell(F.col("content_digest"))).withColumn("_hit", hit("_p"))
    alone = texts.where("not _hit").select("content_digest", "n_bytes", "text")
    one = misses.select(F.col("doc_id").alias("_d"), F.col("content_digest").alias("_g"))
    # One document of each digest: ids may be null, or repeat with the same or another text.
    rest = texts.where("_hit").join(one, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("content_digest") == F.col("_g")))
    todo = alone.union(rest.select("content_digest", "n_bytes", "text").dropDuplicates(["content_digest"]))
    new = todo.mapInArrow(_encoder(tokenizer), "content_digest binary, n_bytes bigint, n_tokens bigint")
    (
        new.select(F.lit(bytearray(version)).alias("tokenizer_digest"), "content_digest", "n_bytes", "n_tokens")
        .write.mode("append").parquet(cache)
    )
    bitmap.destroy()
    # Two runs that miss the same digest at the same time both append it; their counts are equal.
    counts = (
        read_cache(spark, cache).where(F.col("tokenizer_digest") == F.lit(bytearray(version)))
        .groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    )
    return keys.join(counts, "content_digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > over).alias("over_limit")
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = lasting(spark, "op8")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, "byte_bpe_50k.json", ws.folder("cache"), ws)
