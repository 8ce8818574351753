"""The ``opN_<name>`` queries of this folder and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobmix.llm.decontamination import op3_decontamination
from jobmix.llm.licenses import op1_license_scan
from jobmix.llm.line_dedup import OP7_SQL, op7_line_dedup
from jobmix.llm.merkle import OP13_SQL, op13_merkle_manifest
from jobmix.llm.ngram_join import op4_ngram_join
from jobmix.llm.quality import op10_quality_rules
from jobmix.llm.sentencepieces import op8_sentencepiece
from jobmix.llm.substring_dedup import op12_substring_dedup
from jobmix.llm.surrogates import op5_surrogates
from jobmix.llm.token_counts import op9_token_counts
from jobmix.llm.toxicity import op6_toxicity
from jobmix.llm.warc import OP2_SQL, op2_warc
from jobmix.llm.whitening import op11_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_license_scan,
        op2_warc,
        op3_decontamination,
        op4_ngram_join,
        op5_surrogates,
        op6_toxicity,
        op7_line_dedup,
        op8_sentencepiece,
        op9_token_counts,
        op10_quality_rules,
        op11_whitening,
        op12_substring_dedup,
        op13_merkle_manifest,
    )
}

SQL: dict[str, str] = {
    "op2_warc": OP2_SQL,
    "op7_line_dedup": OP7_SQL,
    "op13_merkle_manifest": OP13_SQL,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
