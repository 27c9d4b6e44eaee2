"""Quality classifier by compression with two dictionaries.

One zstandard dictionary is trained on good and one on bad labelled texts. A text is cut into
blocks of ``BLOCK`` bytes (all of them), each block is compressed with either dictionary, and the
difference of the summed sizes, divided by the text's bytes, says which sort of text it resembles.
A logistic curve over that difference and a term for shortness, fitted on labelled texts that the
dictionaries have not seen and weighted to the labels' true shares, turns it into a probability.

Labels are counted over all rows; texts are taken from a bounded sample: the ``PER_CLASS`` labelled
documents of each class whose ids hash lowest (longer than ``MAX_TRAIN_CHARS`` are left out), of
which every third goes to the dictionaries. Lines that several sampled texts share are dropped from
the dictionaries, as they tell of copying and not of quality.

Defined cases: a null or empty text has difference 0 and the score of an empty text; with labels of
one class only, every score is 1 or 0 by that class, without any 0.5; a document labelled both ways
is left out; repeated rows score alike; an empty table gives no rows; a null id counts as held out.
Nothing but the text enters a score.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.llm.common import id_fold, map_batches, table, text_slices

QUERY = "op5_quality_classifier"
ORACLE_SQL = None

PER_CLASS = 1500
MAX_TRAIN_CHARS = 20_000
DICTIONARY_BYTES = 32_768
BLOCK = 1024
LEVEL = 3
PREDICT_FROM = 0.3


@dataclass
class QualityModel:
    good: bytes = b""
    bad: bytes = b""
    curve: tuple[float, ...] = ()
    constant: float = 0.5


class Differ:
    """Compressed-size differences; made where it is used, as dictionaries hold native memory."""

    def __init__(self, good: bytes, bad: bytes):
        how = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)

        def compressor(raw: bytes):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(compression_params=how)
            return zstandard.ZstdCompressor(dict_data=d, compression_params=how)

        self.good, self.bad = compressor(good), compressor(bad)

    def __call__(self, text: str | None) -> tuple[float, int]:
        """(bad size - good size) / bytes, and the bytes."""
        raw = memoryview((text or "").encode("utf-8", "replace"))
        total = 0
        for at in range(0, len(raw), BLOCK):
            block = raw[at : at + BLOCK]
            total += len(self.bad.compress(block)) - len(self.good.compress(block))
        return (total / len(raw) if len(raw) else 0.0), len(raw)


def _features(values: list[tuple[float, int]]) -> np.ndarray:
    x = np.array(values, float).reshape(-1, 2)
    return np.column_stack((x[:, 0] * 50, 1 / (1 + x[:, 1] / 60), np.ones(len(x))))


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton's method, slightly ridged."""
    ridge = np.diag([1e-3, 1e-2, 1e-6])
    beta = np.zeros(x.shape[1])
    for _ in range(40):
        p = _logistic(x @ beta)
        gradient = x.T @ (weight * (y - p)) - ridge @ beta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(hessian, gradient)
        beta += step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _without_shared_lines(texts: dict[int, list[str]]) -> dict[int, list[bytes]]:
    seen = Counter(line for own in texts.values() for t in own for line in set(t.split("\n")))

    def left(t: str) -> bytes:
        return "\n".join(line for line in t.split("\n") if seen[line] == 1).encode("utf-8", "replace")

    return {q: [x for x in map(left, own) if x] for q, own in texts.items()}


def _dictionary(samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their own bytes serve
        return b" ".join(samples)[-DICTIONARY_BYTES:] or b" " * 8


def train(rows: list[tuple[str, int]], shares: dict[int, int]) -> QualityModel:
    """rows: (text, quality) in a stable order; shares: labelled documents by quality."""
    of = {q: [t for t, k in rows if k == q] for q in (0, 1)}
    if not of[0] or not of[1]:
        return QualityModel(constant=1.0 if of[1] else 0.0 if of[0] else 0.5)
    # a class of one text serves both purposes
    own = {q: of[q][::3] for q in of}
    rest = {q: [t for i, t in enumerate(of[q]) if i % 3] or of[q] for q in of}
    sides = _without_shared_lines(own)
    model = QualityModel(good=_dictionary(sides[1]), bad=_dictionary(sides[0]))
    differ = Differ(model.good, model.bad)
    x = _features([differ(t) for q in (0, 1) for t in rest[q]])
    y = np.array([q for q in (0, 1) for _ in rest[q]], float)
    total = sum(shares.values())
    weight = np.array([shares[q] / total * len(y) / len(rest[q]) for q in (0, 1) for _ in rest[q]])
    model.curve = tuple(_fit_curve(x, y, weight).tolist())
    return model


def fit(docs: DataFrame, labels: DataFrame, may_learn=None) -> QualityModel:
    """Learn from the labels (doc_id, quality) where may_learn holds."""
    may_learn = F.lit(True) if may_learn is None else may_learn
    usable = labels.filter(may_learn & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    one = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).filter("quality = other").select("doc_id", "quality")
    shares = {r["quality"]: r["n"] for r in one.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    drawn = one.withColumn("drawn", F.xxhash64(F.col("doc_id"), F.lit("quality sample")))
    sample = [r for q in (0, 1) for r in drawn.filter(F.col("quality") == q).orderBy("drawn", "doc_id").limit(PER_CLASS).collect()]
    if not sample:
        return QualityModel()
    ids = docs.sparkSession.createDataFrame([(r["doc_id"], r["quality"], r["drawn"]) for r in sample], "doc_id long, quality int, drawn long")
    texts = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .filter(F.col("text").isNotNull() & (F.length("text") <= MAX_TRAIN_CHARS))
        .join(F.broadcast(ids), "doc_id")  # at most 2 * PER_CLASS rows
        .groupBy("doc_id", "quality", "drawn").agg(F.min("text").alias("text"))
    )
    rows = sorted((r["drawn"], r["doc_id"], r["text"], r["quality"]) for r in texts.collect())
    return train([(t, q) for _, _, t, q in rows], shares)


def score_texts(texts: list[str | None], model: QualityModel, differ: Differ | None) -> np.ndarray:
    if not model.curve:
        return np.full(len(texts), model.constant)
    return _logistic(_features([differ(t) for t in texts]) @ np.array(model.curve))


def score(docs: DataFrame, model: QualityModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, score and predicted for each row of docs."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    names = list(keep)

    def run(batches):
        differ = Differ(model.good, model.bad) if model.curve else None
        for b in text_slices(batches, "_text"):
            found = score_texts(b.column("_text").to_pylist(), model, differ)
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in names] + [pa.array(found), pa.array((found >= PREDICT_FROM).astype(np.int32))],
                names + ["score", "predicted"],
            )

    rows = docs.select(*keep, F.col("text").alias("_text"))
    return map_batches(rows, run, f"{schema}, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; learns from labels whose id's crc32 mod 5 is not 0."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.coalesce(id_fold("doc_id", 5) == 0, F.lit(True))
    model = fit(docs, labels, ~held)
    return score(docs.select("doc_id", "text", held.alias("held_out")), model, ("doc_id", "held_out"))
