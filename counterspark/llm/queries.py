"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontamination import op9_decontamination
from .embeddings import op4_embedding_dedup
from .jaccard_join import op5_jaccard_join
from .langid import op2_language_id
from .mixing import op1_golden_mix
from .quality import op10_quality_qda
from .sharding import op3_hilbert_shards
from .token_counts import op8_token_counts
from .tool_calls import OP6_SQL, op6_tool_calls
from .warc import op7_arc_to_warc


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_golden_mix": op1_golden_mix,
    "op2_language_id": op2_language_id,
    "op3_hilbert_shards": op3_hilbert_shards,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_tool_calls": op6_tool_calls,
    "op7_arc_to_warc": op7_arc_to_warc,
    "op8_token_counts": op8_token_counts,
    "op9_decontamination": op9_decontamination,
    "op10_quality_qda": op10_quality_qda,
    "pipeline": _pipeline,
}

SQL: dict[str, str] = {"op6_tool_calls": OP6_SQL}
