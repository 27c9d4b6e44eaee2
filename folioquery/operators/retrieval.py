"""Dense, keyword and hybrid retrieval for batches of questions.

Questions carry qid, chunks carry chunk_id. Shapes:

    questions  (qid, question)                chunks          (chunk_id, source, page, text)
    query vectors (qid, vector)               chunk vectors   (chunk_id, vector)
    results    (qid, rank, chunk_id, source, page, text, score, dense_score, sparse_score[, rerank_score])

Equal scores are ordered by chunk_id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioquery.functions import text as T
from folioquery.functions.providers import lexical_boost
from folioquery.operators.postings import Postings, best_hits, build_postings, scan_hits
from folioquery.scratch import BROADCAST_BYTES, join_checked, map_batches, materialize, measured_bytes

# Weights and sizes of the hybrid search.
DENSE_WEIGHT, SPARSE_WEIGHT = 0.75, 0.25
TOP_K = 7
DENSE_FACTOR, DENSE_LEAST = 4, 20
POOL = 20
PREFIX_CHARS = 120
LEGACY_TOP_K = 3

#: Questions whose vectors are sent to the executors at a time; more are handled in blocks.
QUESTION_BLOCK = 4096
SHARD_VECTORS = 65_536
#: Measured bytes of the questions' tokens up to which questions that are asked once are answered by a scan.
SCAN_BYTES = 4 << 20


def dense_k(top_k: int = TOP_K) -> int:
    """Candidates of the dense search; there are never more than chunks."""
    return max(DENSE_FACTOR * top_k, DENSE_LEAST)


def _best(p: pd.DataFrame, k: int) -> pd.DataFrame:
    return p.sort_values(["dense_score", "chunk_id"], ascending=[False, True], kind="stable").groupby("qid", sort=False).head(k)


def dense_search(chunk_vectors: DataFrame, query_vectors: DataFrame, k: int) -> DataFrame:
    """(qid, chunk_id, dense_score, rank): the k largest inner products of each question, exactly.

    The question set is scanned against all vectors in blocks: a task multiplies a shard of vectors
    with a block of question vectors and keeps k rows of each question, so k rows a question and
    shard are shuffled. One block of questions goes to the vectors as they lie; of more, each meets
    every shard of SHARD_VECTORS, in one pass. Null vectors take no part; vectors of different lengths
    are compared over none.
    """
    queries = query_vectors.filter(F.col("vector").isNotNull()).select("qid", "vector")
    usable = chunk_vectors.filter(F.col("vector").isNotNull()).select("chunk_id", "vector")
    out = "qid long, chunk_id long, dense_score double"
    few = queries.limit(QUESTION_BLOCK + 1).collect()
    if len(few) <= QUESTION_BLOCK:
        block = _by_length([r["qid"] for r in few], [r["vector"] for r in few])

        def against_one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = None
            for p in batches:
                best = _closest(p, block, k, best)
            if best is not None:
                yield best

        found = usable.mapInPandas(against_one, out)
    else:
        blocks, shards = -(-queries.count() // QUESTION_BLOCK), max(1, -(-usable.count() // SHARD_VECTORS))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        asked = queries.select(F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("block"), every(shards).alias("shard"), F.lit(True).alias("asks"), F.col("qid").alias("id"), "vector")
        held = usable.select(every(blocks).alias("block"), F.pmod(F.xxhash64("chunk_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), F.col("chunk_id").alias("id"), "vector")
        cells = asked.unionByName(held.withColumn("vector", F.col("vector").cast(asked.schema["vector"].dataType))).repartition("block", "shard").sortWithinPartitions("block", "shard", F.desc("asks"))

        def in_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at, ids, vectors, block, best = None, [], [], None, None
            for p in batches:
                for cell, rows in p.groupby(["block", "shard"], sort=False):
                    if cell != at:
                        if best is not None:
                            yield best
                        at, ids, vectors, block, best = cell, [], [], None, None
                    own = rows[rows.asks]
                    ids += own.id.tolist()
                    vectors += own.vector.tolist()
                    rest = rows[~rows.asks]
                    if len(rest):
                        block = block or _by_length(ids, vectors)
                        best = _closest(rest.rename(columns={"id": "chunk_id"}), block, k, best)
            if best is not None:
                yield best

        found = cells.mapInPandas(in_cells, out)
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("dense_score"), "chunk_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _by_length(qids: list, vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    return {
        n: (np.array([q for q, v in zip(qids, vectors) if len(v) == n]), np.array([v for v in vectors if len(v) == n], np.float64))
        for n in {len(v) for v in vectors}
    }


def _closest(p: pd.DataFrame, block: dict[int, tuple[np.ndarray, np.ndarray]], k: int, best: pd.DataFrame | None) -> pd.DataFrame | None:
    """The k best of each question among the rows of p (chunk_id, vector) and those in best."""
    for n, own in p.groupby(p.vector.map(len)):
        if n not in block:
            continue
        ids, q = block[n]
        rows = own.chunk_id.to_numpy()
        x = np.stack(own.vector.to_numpy()).astype(np.float64).reshape(len(rows), n)
        # question by question in slices, so that a score matrix stays small
        some = [] if best is None else [best]
        for at in range(0, len(ids), 256):
            scores = np.round(x @ q[at : at + 256].T, 9).T
            top = np.argpartition(-scores, min(k, len(rows)) - 1, axis=1)[:, :k] if len(rows) > k else np.tile(np.arange(len(rows)), (len(scores), 1))
            edge = np.take_along_axis(scores, top, 1).min(axis=1)
            i, j = np.nonzero(scores >= edge[:, None])  # with all that tie at the edge
            some.append(pd.DataFrame({"qid": ids[at : at + 256][i], "chunk_id": rows[j], "dense_score": scores[i, j]}))
        best = _best(pd.concat(some), k)
    return best


def legacy_search(chunk_vectors: DataFrame, query_vectors: DataFrame, k: int = LEGACY_TOP_K) -> DataFrame:
    """(qid, chunk_id, rank): nearest chunks to vectors as they come, without scores."""
    return dense_search(chunk_vectors, query_vectors, k).select("qid", "chunk_id", "rank")


def token_table(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, token, tf): the inverted index of a table's texts."""
    words = rows.select(F.col(id_col), F.explode(T.tokens(text_col)).alias("token"))
    return words.groupBy(id_col, "token").agg(F.count("*").cast("int").alias("tf"))


def row_tokens(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """token_table() where each id is one row's: counted row by row, so nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("t")
            words = lists.flatten().dictionary_encode()
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            many = max(1, len(words.dictionary))
            pairs, tfs = np.unique(np.repeat(np.arange(len(sizes)), sizes) * many + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
            columns = [b.column(id_col).take(pa.array(pairs // many)), words.dictionary.take(pa.array(pairs % many)), pa.array(tfs, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "token", "tf"])

    kind = rows.schema[id_col].dataType.simpleString()
    return map_batches(rows.select(id_col, T.tokens(text_col).alias("t")), run, f"{id_col} {kind}, token string, tf int")


def _asked(questions: DataFrame) -> DataFrame:
    """(qid, n_tokens, token, q_tf) of the questions' tokens."""
    asked = questions.select("qid", T.tokens("question").alias("t")).withColumn("n_tokens", F.size("t"))
    return asked.select("qid", "n_tokens", F.explode("t").alias("token")).groupBy("qid", "n_tokens", "token").agg(F.count("*").cast("int").alias("q_tf"))


def only_asked(chunk_tokens: DataFrame, questions: DataFrame) -> DataFrame:
    """The rows of chunk_tokens whose token some question has, which is all that a search for these questions
    reads; where the tokens are broadcast, others are left out before anything is counted or shuffled."""
    tokens = materialize(_asked(questions).select("token").distinct(), "asked-tokens")
    return join_checked(chunk_tokens, tokens, "token", "left_semi").select(*chunk_tokens.columns)


def keyword_search(questions: DataFrame, chunk_tokens: DataFrame) -> DataFrame:
    """(qid, chunk_id, sparse_score) of all pairs that share a token: the size of the multiset
    intersection by the number of the question's tokens.

    Chunks' rows of tokens that no question has are left out first, and the others of a chunk are brought to
    one task, so that pairs are summed where they arise and none is shuffled while the question tokens'
    measured bytes let them be broadcast. The k best alone come from stored postings.
    """
    own = only_asked(chunk_tokens, questions).repartition("chunk_id")
    shared = join_checked(own, materialize(_asked(questions), "asked"), "token").groupBy("qid", "chunk_id", "n_tokens").agg(F.sum(F.least("tf", "q_tf")).alias("shared"))
    return shared.select("qid", "chunk_id", (F.col("shared") / F.col("n_tokens")).alias("sparse_score"))


def fuse(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """(qid, chunk_id, score, dense_score, sparse_score) of chunks found by either side; the side
    that did not find a chunk counts 0."""
    both = dense.select("qid", "chunk_id", "dense_score").join(sparse, ["qid", "chunk_id"], "full_outer")
    d, s = F.coalesce("dense_score", F.lit(0.0)), F.coalesce("sparse_score", F.lit(0.0))
    return both.select("qid", "chunk_id", (DENSE_WEIGHT * d + SPARSE_WEIGHT * s).alias("score"), d.alias("dense_score"), s.alias("sparse_score"))


def keep_first(scored: DataFrame, chunks: DataFrame) -> DataFrame:
    """scored with source and page, and of the chunks of a question that agree in source, page and
    first characters only the best."""
    named = scored.join(chunks.select("chunk_id", "source", "page", F.left("text", F.lit(PREFIX_CHARS)).alias("_prefix")), "chunk_id")
    by = W.partitionBy("qid", "source", "page", "_prefix").orderBy(F.desc(F.round("score", 9)), "chunk_id")
    return named.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n", "_prefix")


def best_pool(scored: DataFrame, chunks: DataFrame, pool: int = POOL) -> DataFrame:
    """The pool best chunks of each question after keep_first, with their texts and pool_rank.

    scored and the pool are kept, so that by their measured bytes they are broadcast to the chunks, whose
    texts are then not shuffled."""
    scored = materialize(scored, "scored")
    by = W.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "chunk_id")
    first = keep_first(F.broadcast(scored) if measured_bytes(scored) <= BROADCAST_BYTES else scored, chunks)
    ranked = materialize(first.withColumn("pool_rank", F.row_number().over(by)).filter(F.col("pool_rank") <= pool), "pool")
    return join_checked(chunks.select("chunk_id", "text"), ranked, "chunk_id").select(*ranked.columns, "text")


def rerank(pool: DataFrame, questions: DataFrame, scorer: Callable[..., Column] = lexical_boost, top_k: int = TOP_K) -> DataFrame:
    """The top_k rows of each question's pool by scorer(question, text, score). Only pool rows are
    scored; equal scores keep the pool's order."""
    scored = pool.join(questions.select("qid", "question"), "qid").withColumn("rerank_score", scorer("question", "text", "score"))
    by = W.partitionBy("qid").orderBy(F.desc(F.round("rerank_score", 9)), "pool_rank")
    return (
        scored.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top_k)
        .select("qid", "rank", "chunk_id", "source", "page", "text", "score", "dense_score", "sparse_score", "rerank_score")
    )


def hybrid_pool(questions: DataFrame, chunks: DataFrame, postings: Postings | None, query_vectors: DataFrame, chunk_vectors: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """The pool that rerank() takes: dense candidates and keyword hits, fused.

    One search of the stored postings gives the keyword scores of the dense candidates and, of all
    other hits, those that can enter the pool. Without postings, for questions that are asked once, one scan
    of the chunks gives the same; where the questions are too many to send to every task, the postings of
    their tokens are built on the way."""
    dense = materialize(dense_search(chunk_vectors, query_vectors, dense_k(top_k)), "dense")
    asked = materialize(_asked(questions), "asked")
    near = dense.select("qid", "chunk_id")
    if postings is None and measured_bytes(asked) <= SCAN_BYTES and measured_bytes(near) <= BROADCAST_BYTES:
        shared = scan_hits(chunks, asked, near, POOL)
    else:
        postings = postings or build_postings(only_asked(token_table(chunks, "chunk_id", "text"), questions), chunks)
        shared = best_hits(postings, asked, near, POOL)
    sizes = asked.select("qid", "n_tokens").distinct()
    sparse = shared.join(sizes, "qid").select("qid", "chunk_id", (F.col("shared") / F.col("n_tokens")).alias("sparse_score"))
    return best_pool(fuse(dense, sparse), chunks)


def hybrid_search(questions, chunks, postings, query_vectors, chunk_vectors, top_k: int = TOP_K, scorer=lexical_boost) -> DataFrame:
    """The whole search: pool, rerank, top_k."""
    return rerank(hybrid_pool(questions, chunks, postings, query_vectors, chunk_vectors, top_k), questions, scorer, top_k)
