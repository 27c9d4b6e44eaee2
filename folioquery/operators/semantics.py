"""An embedder that is learned from the corpus: a truncated SVD of its TF-IDF matrix.

    model = fit(texts)                  texts: a DataFrame with a column text
    embed = learned_embedding(model)    a column function like hashed_embedding, for build_index() and ask()

Words that keep the same company come to lie close, so a question can reach a text that shares none of its
words. Tokens are hashed into ``BUCKETS`` columns. The SVD is randomised: a few products of the matrix and
its transpose with a block of rank + ``OVERSAMPLE`` columns, each summed over tasks, narrow the block to the
leading directions, and the Gram matrix of the projected rows, again a sum over tasks, gives the singular
values. What the driver and a task hold is bounded by the buckets times the block, whatever the corpus; rows
stay where they are. Fitting looks at ``SAMPLE_ROWS`` texts at most, by a hash of the text; embedding at all.

Defined cases: null and tokenless texts take no part in fitting and embed to zeros, as do texts of unseen
buckets alone; with fewer texts or directions than the rank the other dimensions are zero; without texts
every vector is zero; fitting the same texts again gives the same vectors, up to the order of sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquery.functions import text as T
from folioquery.scratch import Workspace

RANK = 64
BUCKETS = 1 << 16
OVERSAMPLE = 10
#: Times that the block is multiplied with the matrix and its transpose.
PASSES = 3
SAMPLE_ROWS = 1_000_000
#: Buckets of a block of sums, and entries of the matrix that are multiplied at a time.
SUM_BUCKETS = 1024
ENTRIES = 20_000


@dataclass
class Semantics:
    """idf by bucket, the leading directions (buckets by rank) and their singular values."""

    idf: np.ndarray
    directions: np.ndarray
    singular: np.ndarray

    def embed(self, features: list[np.ndarray | None]) -> np.ndarray:
        """Unit vectors of texts given as their tokens' buckets; zeros where nothing is known."""
        out = np.zeros((len(features), self.directions.shape[1]))
        for at, rows, columns, values in entries(features, self.idf):
            np.add.at(out, rows + at, values[:, None] * self.directions[columns])
        size = np.sqrt((out**2).sum(axis=1, keepdims=True))
        return np.divide(out, size, out=np.zeros_like(out), where=size > 1e-9)


def features(text: Column | str, buckets: int = BUCKETS) -> Column:
    """The bucket of each token of a text."""
    return F.transform(T.tokens(text), lambda t: (F.crc32(t.cast("binary")) % buckets).cast("int"))


def entries(texts, idf: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """The matrix's rows of some texts: (first row, rows from there, columns, values), some at a time.
    A value is (1 + log tf) * idf, each row of length 1."""
    first, rows, columns, values, held = 0, [], [], [], 0
    for at, buckets in enumerate(texts):
        if buckets is not None and len(buckets):
            ids, tf = np.unique(np.asarray(buckets), return_counts=True)
            weight = (1 + np.log(tf)) * idf[ids]
            size = np.sqrt((weight**2).sum())
            if size > 0:
                rows.append(np.full(len(ids), at - first))
                columns.append(ids)
                values.append(weight / size)
                held += len(ids)
        if held >= ENTRIES:
            yield first, np.concatenate(rows), np.concatenate(columns), np.concatenate(values)
            first, rows, columns, values, held = at + 1, [], [], [], 0
    if held:
        yield first, np.concatenate(rows), np.concatenate(columns), np.concatenate(values)


def _projected(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The product of some rows of the matrix with a block; entries come in order of rows."""
    starts = np.flatnonzero(np.diff(rows, prepend=-1))
    out = np.zeros((int(rows[-1]) + 1, block.shape[1]))
    out[rows[starts]] = np.add.reduceat(values[:, None] * block[columns], starts)
    return out


def _transposed_product(found: DataFrame, idf: np.ndarray, block: np.ndarray) -> np.ndarray:
    """A'A times a block (buckets by columns), summed over tasks."""
    buckets, width = block.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((buckets, width))
        for b in batches:
            for _, rows, columns, values in entries(_lists(b.column("found")), idf):
                own = values[:, None] * _projected(rows, columns, values, block)[rows]
                order = np.argsort(columns, kind="stable")
                starts = np.flatnonzero(np.diff(columns[order], prepend=-1))
                total[columns[order][starts]] += np.add.reduceat(own[order], starts)
        for part in range(0, buckets, SUM_BUCKETS):
            piece = total[part : part + SUM_BUCKETS]
            if piece.any():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([piece.tobytes()], pa.binary())], ["part", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, raw in zip(b.column("part").to_pylist(), b.column("sums")):
                piece = np.frombuffer(raw.as_buffer(), np.float64)
                sums[part] = sums[part] + piece if part in sums else piece.copy()
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["part", "sums"])

    schema = "part int, sums binary"
    out = np.zeros((buckets, width))
    for r in found.mapInArrow(run, schema).repartition("part").mapInArrow(added, schema).collect():  # buckets by width in all
        out[r["part"] : r["part"] + SUM_BUCKETS] = np.frombuffer(bytes(r["sums"]), np.float64).reshape(-1, width)
    return out


def _gram(found: DataFrame, idf: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The inner products of the columns of A times a block, summed over tasks."""
    width = block.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            for _, rows, columns, values in entries(_lists(b.column("found")), idf):
                y = _projected(rows, columns, values, block)
                total += y.T @ y
        flat = pa.array(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width, dtype=np.int32)), flat], ["at", "value"])

    sums = found.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()  # width by width
    out = np.zeros(width * width)
    for r in sums:
        out[r["at"]] = r["value"]
    return out.reshape(width, width)


def _lists(column: pa.Array) -> list[np.ndarray]:
    values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def fit(texts: DataFrame, rank: int = RANK, buckets: int = BUCKETS, passes: int = PASSES, sample: int = SAMPLE_ROWS, seed: int = 5) -> Semantics:
    """Learn from texts (text)."""
    with Workspace(texts.sparkSession, "semantics") as work:
        found = work.table(texts.filter(F.col("text").isNotNull()).select(F.xxhash64("text").alias("h"), features("text", buckets).alias("found")).filter(F.size("found") > 0), "features")
        count = found.count()
        if count > sample:  # about as many, the same ones each time
            found = found.filter(F.pmod("h", F.lit(1 << 20)) < int((1 << 20) * sample / count))
            count = found.count()
        found = found.select("found")
        seen = found.select(F.explode(F.array_distinct("found")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")).collect()  # a row a bucket
        idf = np.zeros(buckets)
        for r in seen:
            idf[r["bucket"]] = np.log((1 + count) / (1 + r["n"])) + 1
        width = min(rank + OVERSAMPLE, max(1, len(seen)))
        if not seen:
            return Semantics(idf, np.zeros((buckets, rank), np.float32), np.zeros(rank))
        block = np.random.default_rng(seed).normal(size=(buckets, width)) * (idf > 0)[:, None]
        for _ in range(passes):
            block, _ = np.linalg.qr(_transposed_product(found, idf, block))
        values, turn = np.linalg.eigh(_gram(found, idf, block))
        order = np.argsort(-values)[:rank]
        kept = np.sqrt(np.maximum(values[order], 0))
        directions = block @ turn[:, order]
        directions[:, kept < 1e-6 * max(kept[0], 1e-12)] = 0  # no directions of the corpus
        out, singular = np.zeros((buckets, rank), np.float32), np.zeros(rank)
        out[:, : len(order)], singular[: len(order)] = directions, kept
        return Semantics(idf, out, singular)


def learned_embedding(model: Semantics):
    """A column function text -> unit vector. The model, buckets times rank, is broadcast once."""
    from pyspark.sql import SparkSession

    shared = SparkSession.active().sparkContext.broadcast(model)
    buckets = len(model.idf)

    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for found in batches:
            yield pd.Series(list(shared.value.embed(list(found))))

    return lambda text: vectors(features(text, buckets))
