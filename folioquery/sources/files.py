"""Files to pages (source, page, text)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.functions import text as T
from folioquery.functions.providers import PageParser
from folioquery.scratch import Workspace, running_sums, small_batches
from folioquery.sources import pdf
from folioquery.sources.folder import BATCH_CHARS


def scan_folder(spark: SparkSession, folder: str, suffix: str = ".pdf") -> DataFrame:
    """(source, content, signature) of the files directly in a folder whose names end with suffix,
    case mattering; source is the file's name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
    return files.select(T.base_name("path").alias("source"), "content", T.signature("content").alias("signature"))


def upload(spark: SparkSession, name: str, content: bytes) -> DataFrame:
    """One file's bytes as scan_folder() gives them."""
    one = spark.createDataFrame([(name, bytearray(content))], "source string, content binary")
    return one.select("source", "content", T.signature("content").alias("signature"))


def number_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files of words as a word list (ordinal, word), line after line and file after file;
    blank lines count but are left out."""
    work = Workspace(spark, "lines")  # the result reads it, so it stays until the driver ends
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start").withColumn("row", F.monotonically_increasing_id())
    placed = running_sums(lines.withColumn("one", F.lit(1).cast("long")), ["file_path", "file_block_start", "row"], {"one": "ordinal"}, work)
    return placed.select("ordinal", F.col("value").alias("word")).filter(~T.is_blank("word"))


def usable_pages(pages: DataFrame) -> DataFrame:
    """Pages with text, stripped at the ends; page numbers keep their gaps."""
    return pages.filter(~T.is_blank("text")).withColumn("text", T.strip("text"))


def extract_pages(files: DataFrame, parser: PageParser) -> DataFrame:
    """(signature, source, page, text) of the usable pages of (source, content, signature)."""

    names = ["signature", "source", "page", "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows, held = [], 0
            for g, s, c in zip(p.signature, p.source, p.content):
                for n, t in parser(bytes(c)):
                    rows.append((g, s, int(n), t))
                    held += len(t)
                    if held >= BATCH_CHARS:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)

    small_batches(files.sparkSession)
    read = files.select("signature", "source", "content").mapInPandas(run, "signature string, source string, page int, text string")
    return usable_pages(read)


def pdf_pages(content: bytes) -> Iterator[tuple[int, str]]:
    """Pages of a PDF; an encrypted or broken file ends the task with its error."""
    return pdf.read_pages(content)


def mupdf_pages(content: bytes) -> Iterator[tuple[int, str]]:
    """Pages of a PDF by PyMuPDF, where that is installed."""
    import fitz

    with fitz.open(stream=content, filetype="pdf") as doc:
        for n, page in enumerate(doc, start=1):
            yield n, page.get_text()


def pdf_files(texts: DataFrame) -> DataFrame:
    """(source, content, signature) of a PDF for each row (source, pages: texts)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame({"source": p.source, "content": [pdf.write_pdf([t or "" for t in pages]) for pages in p.pages]})

    small_batches(texts.sparkSession)
    made = texts.select("source", "pages").mapInPandas(run, "source string, content binary")
    return made.withColumn("signature", T.signature("content"))


def table_pages(documents: DataFrame, source: str = "source", page: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of a table as pages."""
    return usable_pages(documents.select(F.col(source).alias("source"), F.col(page).alias("page"), F.col(text).alias("text")))
