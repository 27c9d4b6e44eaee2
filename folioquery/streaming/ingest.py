"""Files that arrive to chunks that are appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioquery.functions import text as T
from folioquery.functions.providers import PageParser
from folioquery.operators.chunking import chunk_pages
from folioquery.sources.files import extract_pages


def chunk_stream(spark: SparkSession, folder: str, parser: PageParser, suffix: str = ".pdf") -> DataFrame:
    """A stream of (source, page, chunk_seq, text) of the files that appear in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    arriving = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", f"*{suffix}").load(folder)
    named = arriving.select(T.base_name("path").alias("source"), "content", T.signature("content").alias("signature"))
    return chunk_pages(extract_pages(named, parser))


def write_chunks(chunks: DataFrame, path: str, checkpoint: str):
    """Append a chunk stream to Parquet, all that is there in one go; the file sink's log makes a
    restarted run neither lose nor repeat a batch."""
    return chunks.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
