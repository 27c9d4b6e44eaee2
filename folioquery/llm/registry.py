"""The queries of this subpackage and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioquery.llm import bitpack, bpe, chat, compress_quality, dsir, jaccard_join, langid, licenses, merkle, mixing, outliers, secrets, topk

_MODULES = (licenses, mixing, outliers, topk, compress_quality, secrets, jaccard_join, bpe, bitpack, langid, dsir, merkle, chat)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {m.QUERY: m.query for m in _MODULES}


def oracle_sql() -> dict[str, str]:
    return {m.QUERY: m.ORACLE_SQL for m in _MODULES if m.ORACLE_SQL is not None}
