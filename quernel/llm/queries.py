"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe_codec import op8_byte_bpe
from .exact_dedup import OP2_SQL, op2_exact_dedup
from .language_id import op10_language_id
from .license_scan import op5_license_scan
from .minhash_dedup import OP3_SQL, op3_minhash_dedup
from .mixing import OP6_SQL, op6_mix_sources
from .quality_rules import op4_quality_rules
from .suffix_dedup import op9_suffix_dedup
from .token_counts import op1_token_counts
from .warc import OP7_SQL, op7_warc

_ALL = (op1_token_counts, op2_exact_dedup, op3_minhash_dedup, op4_quality_rules, op5_license_scan, op6_mix_sources, op7_warc, op8_byte_bpe, op9_suffix_dedup, op10_language_id)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {f.__name__: f for f in _ALL} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op3_minhash_dedup": OP3_SQL, "op6_mix_sources": OP6_SQL, "op7_warc": OP7_SQL}
