"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from . import attribution, chat, images, jaccard, langid, licenses, mixing, packing, quality, suffix_lm
from .scratch import bound_batches


def _bounded(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    name: _bounded(query)
    for name, query in {
        "op1_license_scan": licenses.op1_license_scan,
        "op2_lm_score": suffix_lm.op2_lm_score,
        "op3_image_copies": images.op3_image_copies,
        "op4_language_id": langid.op4_language_id,
        "op5_mix_sources": mixing.op5_mix_sources,
        "op6_chat_format": chat.op6_chat_format,
        "op7_pack": packing.op7_pack,
        "op8_token_attribution": attribution.op8_token_attribution,
        "op9_ngram_jaccard": jaccard.op9_ngram_jaccard,
        "op10_quality_hosts": quality.op10_quality_hosts,
    }.items()
}
ORACLES = {
    "op1_license_scan": licenses.ORACLE,
    "op6_chat_format": chat.ORACLE,
    "op10_quality_hosts": quality.ORACLE,
}
