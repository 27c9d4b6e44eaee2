"""The document assistant: index files, answer batches of questions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.functions import text as T
from folioquery.functions.providers import hashed_embedding, lexical_boost, plain_text_pages
from folioquery.functions.vectors import normalized
from folioquery.operators import answering, chunking, conversation, retrieval
from folioquery.operators.postings import Postings, build_postings, open_postings
from folioquery.scratch import materialize, remove, small_batches
from folioquery.sources import files
from folioquery.sources.cache import IndexCache


@dataclass
class Index:
    """Handles of an index's tables; counts where they are known."""

    chunks: DataFrame
    vectors: DataFrame
    tokens: DataFrame
    page_count: int | None = None
    chunk_count: int | None = None
    stored: Postings | None = None

    @property
    def postings(self) -> Postings:
        """The stored postings; made when they are first asked for, if the index came without."""
        if self.stored is None:
            self.stored = build_postings(self.tokens, self.chunks)
        return self.stored

    def persist(self) -> "Index":
        for df in (self.chunks, self.vectors, self.tokens):
            df.persist()
        return self

    def write(self, path: str) -> "Index":
        """The index as Parquet tables below path, read back; for corpora that are asked often."""
        spark = self.chunks.sparkSession
        for name in ("chunks", "vectors", "tokens"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        remove(spark, f"{path}/postings")
        kept = [spark.read.parquet(f"{path}/{name}") for name in ("chunks", "vectors", "tokens")]
        return Index(*kept, self.page_count, self.chunk_count, build_postings(kept[2], kept[0], f"{path}/postings"))

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> "Index":
        """An index that write() left below path."""
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("chunks", "vectors", "tokens")), stored=open_postings(spark, f"{path}/postings"))


def build_index(pages: DataFrame, embed=hashed_embedding, chunks: Column | None = None) -> Index:
    """Chunks, normalised vectors and the inverted index of pages (source, page, text). Every part is
    made from the table of chunks, which lasts as long as the driver; Index.write() keeps them for
    good."""
    numbered = chunking.numbered_chunks(pages, chunks)
    small_batches(pages.sparkSession)
    vectors = numbered.select("chunk_id", normalized(embed("text")).alias("vector"))
    return Index(numbered, vectors, retrieval.row_tokens(numbered, "chunk_id", "text"))


def index_folder(spark: SparkSession, folder: str, suffix: str = ".pdf", parser=files.pdf_pages, **how) -> Index:
    """One index over all files of a folder."""
    return build_index(files.extract_pages(files.scan_folder(spark, folder, suffix), parser), **how)


def index_upload(spark: SparkSession, name: str, content: bytes, cache: IndexCache, parser=plain_text_pages, **how) -> Index:
    """The index of one file, from the cache if its bytes were indexed before."""
    file = files.upload(spark, name, content)
    signature = file.first()["signature"]
    known = cache.meta(signature)
    if known is None:
        pages = files.extract_pages(file, parser)
        built = build_index(pages, **how)
        cache.write(signature, pages.count(), built.chunks.count(), chunks=built.chunks, vectors=built.vectors, tokens=built.tokens)
        known = cache.meta(signature)
    return Index(**cache.read(signature, name), page_count=known[0], chunk_count=known[1])


def ask(messages: DataFrame, index: Index, embed=hashed_embedding, scorer=lexical_boost, load_generator=None, top_k: int = retrieval.TOP_K, most_tokens: int = answering.MOST_TOKENS, store=None) -> DataFrame:
    """Answers to every user turn of messages (conv_id, turn, role, text).

    (conv_id, turn, question, rewritten, answer, confidence, sources): the rewritten question is
    searched for and answered; sources are given for refusals as well. A conversation ends at a user
    turn that says exit or quit; nothing after it is answered. store: answers of prompts that were asked
    before."""
    turns = conversation.rewritten(conversation.until_exit(messages)).select("conv_id", "turn", F.col("text").alias("asked"), "rewritten")
    # an identity of its own for each row: messages may repeat a conversation and turn
    questions = materialize(turns.withColumn("qid", F.monotonically_increasing_id()).withColumnRenamed("rewritten", "question"), "questions")
    vectors = questions.select("qid", normalized(embed(F.lower(T.strip("question")))).alias("vector"))
    results = materialize(retrieval.hybrid_search(questions, index.chunks, index.postings, vectors, index.vectors, top_k, scorer), "results")
    answers = answering.answer(questions, results, load_generator, most_tokens, store)
    cards = answering.source_cards(results).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "label", "page", "preview"))).alias("sources"))
    return (
        questions.join(answers, "qid").join(cards, "qid", "left")
        .select("conv_id", "turn", F.col("asked").alias("question"), F.col("question").alias("rewritten"), "answer", "confidence", "sources")
    )
