"""Shared pieces of the corpus operators: tables, batches of texts, folds of ids."""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.scratch import BATCH_BYTES, Workspace, free_names, join_checked, map_batches, materialize, new_path, running_sums  # noqa: F401

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(batches, column: str = "text", most: int = 1 << 20):
    """The rows of Arrow batches in batches of about most bytes of text, so that Python objects are
    made of a little at a time; a longer text stands alone."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size)
        start = 0
        while start < len(size):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def id_fold(doc_id: Column | str, folds: int) -> Column:
    """crc32(doc_id as text) mod folds; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % F.lit(folds)
