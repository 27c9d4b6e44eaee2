"""Pages to overlapping chunks of whole sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquery.functions import text as T
from folioquery.scratch import Workspace, join_checked, running_sums

# Defaults of chunking.
CHUNK_SIZE = 700
OVERLAP = 120
MIN_CHUNK = 80

#: Pieces that are folded between two times that the chunks so far are copied.
FOLD_BLOCK = 512


def chunk_texts(text: Column | str, size: int = CHUNK_SIZE, overlap: int = OVERLAP, least: int = MIN_CHUNK) -> Column:
    """The chunks of one page, as an array.

    A fold over the page's pieces: a piece joins the current text while the sum of lengths, each
    with one blank, stays within size; else the current text is put out and the next begins with
    its last overlap characters. Texts shorter than least are not put out. A long page is folded block
    by block: what is put out is copied once a block, not once a chunk.
    """

    def put(done: Column, cur: Column) -> Column:
        return F.when(F.length(cur) >= least, F.array_append(done, cur)).otherwise(done)

    def joined(left: Column, piece: Column) -> Column:
        return F.when(left == "", piece).otherwise(F.concat(left, F.lit(" "), piece))

    def step(state: Column, piece: Column) -> Column:
        cur = state["cur"]
        held = F.when(cur == "", F.lit(0)).otherwise(F.length(cur) + 1)
        tail = F.btrim(F.right(cur, F.lit(overlap))) if overlap > 0 else F.lit("")
        fits = held + F.length(piece) + 1 <= size
        return F.struct(
            F.when(fits, state["done"]).otherwise(put(state["done"], cur)).alias("done"),
            F.when(fits, joined(cur, piece)).otherwise(joined(tail, piece)).alias("cur"),
        )

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))
    # a page without pieces has no current text to put out, whatever the least length
    end = lambda s: F.when(s["cur"] == "", s["done"]).otherwise(put(s["done"], s["cur"]))

    def block(state: Column, pieces: Column) -> Column:
        folded = F.aggregate(pieces, F.struct(start["done"].alias("done"), state["cur"].alias("cur")), step)
        return T.let(folded, lambda f: F.struct(F.concat(state["done"], f["done"]).alias("done"), f["cur"].alias("cur")))

    def blocks(pieces: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / FOLD_BLOCK).cast("int"))
        return F.transform(starts, lambda i: F.slice(pieces, i * FOLD_BLOCK + 1, F.lit(FOLD_BLOCK)))

    def whole(pieces: Column) -> Column:
        short = F.aggregate(pieces, start, step, end)
        return F.when(F.size(pieces) <= FOLD_BLOCK, short).otherwise(F.aggregate(blocks(pieces), start, block, end))

    return T.let(T.pieces(text), whole)


def window_texts(text: Column | str, size: int = 500, overlap: int = 100, least: int = 50) -> Column:
    """Plain windows of size characters over the cleaned text, as an array; without those whose
    stripped text is shorter than least."""
    # one pass: a match takes the characters up to the next window, its group looks ahead to the window's end
    cut = F.regexp_extract_all(T.clean_text(text), F.lit(f"(?s)(?=(.{{1,{size}}})).{{1,{size - overlap}}}"), F.lit(1))
    kept = F.filter(cut, lambda s: F.length(F.btrim(s)) >= least)
    return F.coalesce(kept, F.array().cast("array<string>"))


def chunk_pages(pages: DataFrame, chunks: Column | None = None) -> DataFrame:
    """(source, page, chunk_seq, text) of the pages (source, page, text); chunk_seq from 1 in each
    page. chunks: another strategy's array of texts."""
    arrays = pages.select("source", "page", (chunk_texts("text") if chunks is None else chunks).alias("_chunks"))
    return arrays.select("source", "page", F.posexplode("_chunks").alias("_pos", "text")).select(
        "source", "page", (F.col("_pos") + 1).cast("int").alias("chunk_seq"), "text"
    )


def numbered_chunks(pages: DataFrame, chunks: Column | None = None) -> DataFrame:
    """chunk_pages() with chunk_id, from 1 in the order of source, page and chunk_seq, without gaps.

    Pages are read and folded once, into a table of one row a page. Only their counts are ordered, by
    ranges, so neither many sources nor one with most of the pages meets in one task. Rows that agree
    in source and page are numbered one after the other."""
    work = Workspace(pages.sparkSession, "chunks")  # the result reads it, so it stays until the driver ends
    texts = (chunk_texts("text") if chunks is None else chunks).alias("texts")
    folded = work.table(pages.select("source", "page", texts).withColumn("row", F.monotonically_increasing_id()), "pages")
    sizes = folded.select("source", "page", "row", F.size("texts").cast("long").alias("n"))
    before = running_sums(sizes, ["source", "page", "row"], {"n": "before"}, work).select("row", "before")
    placed = join_checked(folded, work.table(before, "before"), "row")
    return placed.select("source", "page", "before", F.posexplode("texts").alias("at", "text")).select(
        (F.col("before") + F.col("at") + 1).cast("long").alias("chunk_id"), "source", "page", (F.col("at") + 1).cast("int").alias("chunk_seq"), "text"
    )


def corpus_stats(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: page_count, chunk_count and the least, largest and mean chunk length."""
    counted = [
        F.count("*").alias("chunk_count"),
        F.min(F.length("text")).cast("long").alias("min_chars"),
        F.max(F.length("text")).cast("long").alias("max_chars"),
        F.round(F.avg(F.length("text")), 6).alias("mean_chars"),
    ]
    rows = pages.agg(F.count("*").alias("page_count")).unionByName(chunks.agg(*counted), allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in ("page_count", "chunk_count", "min_chars", "max_chars", "mean_chars")])
