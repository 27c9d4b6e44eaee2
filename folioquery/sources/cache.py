"""Indexes kept by content signature: Parquet tables partitioned by signature.

An entry is complete once its row in the meta table is written, which happens last; one that is written
again loses that row first, so a write that fails leaves no entry that looks complete. A reader that
finds no meta row rebuilds. The key also holds the chunking parameters and the embedder's name, so
another way of indexing is another entry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.scratch import exists, remove

TABLES = ("chunks", "vectors", "tokens")


class IndexCache:
    def __init__(self, spark: SparkSession, root: str, parameters: str = "default"):
        self.spark, self.root, self.parameters = spark, root.rstrip("/"), parameters

    def _path(self, name: str) -> str:
        return f"{self.root}/{self.parameters}/{name}"

    def _read(self, name: str, signature: str) -> DataFrame:
        return self.spark.read.parquet(self._path(name)).filter(F.col("signature") == signature).drop("signature")

    def meta(self, signature: str) -> tuple[int, int] | None:
        """(page_count, chunk_count) of a complete entry, or None."""
        if not exists(self.spark, self._path("meta")):  # nothing was ever written
            return None
        row = self._read("meta", signature).first()
        return None if row is None else (row["page_count"], row["chunk_count"])

    def write(self, signature: str, page_count: int, chunk_count: int, **tables: DataFrame) -> None:
        """Replace an entry; other entries stay."""
        remove(self.spark, f"{self._path('meta')}/signature={signature}")
        meta = self.spark.createDataFrame([(page_count, chunk_count)], "page_count long, chunk_count long")
        for name, df in [*tables.items(), ("meta", meta)]:
            (
                df.withColumn("signature", F.lit(signature)).write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic").partitionBy("signature").parquet(self._path(name))
            )

    def read(self, signature: str, source: str | None = None) -> dict[str, DataFrame]:
        """The tables of an entry. source: the name under which the file comes now, if another."""
        found = {name: self._read(name, signature) for name in TABLES}
        if source is not None:
            found["chunks"] = found["chunks"].withColumn("source", F.lit(source))
        return found
