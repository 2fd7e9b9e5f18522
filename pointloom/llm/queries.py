"""Queries of the training-data operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from .common import table
from .compression import quality
from .iso_media import media_columns
from .mixing import mix
from .packing import pack
from .perplexity import quality_rules
from .personal_data import personal_data
from .simhash import near_duplicates
from .suffix_dedup import SQL as SUFFIX_SQL
from .suffix_dedup import dedup
from .token_counts import token_counts
from .toxicity import toxicity

QUERIES = {
    "op1_perplexity": lambda spark, d: quality_rules(table(spark, d, "documents")),
    "op2_personal_data": lambda spark, d: personal_data(table(spark, d, "documents")),
    "op3_iso_media": lambda spark, d: media_columns(table(spark, d, "documents")),
    "op4_compression_quality": lambda spark, d: quality(table(spark, d, "documents"), table(spark, d, "labels")),
    "op5_token_counts": lambda spark, d: token_counts(table(spark, d, "documents")),
    "op6_simhash": lambda spark, d: near_duplicates(table(spark, d, "documents")),
    "op7_mixing": lambda spark, d: mix(table(spark, d, "documents")),
    "op8_suffix_dedup": lambda spark, d: dedup(table(spark, d, "documents")),
    "op9_packing": lambda spark, d: pack(table(spark, d, "documents")),
    "op10_toxicity": lambda spark, d: toxicity(table(spark, d, "documents"), table(spark, d, "labels")),
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {"op8_suffix_dedup": SUFFIX_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
