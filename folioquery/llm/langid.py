"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is lower-cased and encoded as UTF-8; ASCII bytes other than letters become spaces. Its
subwords are the 3- and 4-byte windows without an inner space, hashed into ``BUCKETS`` rows of an
embedding matrix. The mean embedding goes through a linear layer and a softmax. Embeddings and
layer are trained together by stochastic gradient descent in numpy, on the driver.

The training sample is bounded: of each language the ``PER_LANG`` documents whose hash of id and text
is least, fewer where there are so many languages that ``MOST_ROWS`` would be passed, and never more
than ``MOST_ROWS`` (of more languages than that, those whose documents hash lowest are learned). Its
texts together have at most ``MOST_BYTES``: beyond that every language has fewer documents.
Rows that agree in id and text count once, so frequent ids do not fill or empty a sample. Documents
of more than ``MAX_TRAIN_CHARS`` characters are only left out of training; prediction always reads
whole texts.

A quarter of the sample is held back to calibrate: it fits a softmax temperature, and the confidence
below which a prediction is rejected. That is set against documents in no learned language, the
held-back ones with their letters dealt anew: the least confidence that turns away ``JUNK_SHARE`` of
those, unless it turned away more than ``REJECT_SHARE`` of the documents that are predicted right.

Because everything up to the softmax is linear, prediction folds embedding and layer into one
table of class scores by bucket where that is the narrower one, so a document costs one gather and
one sum per subword.

Defined cases: a null text or one without a letter gives ``und`` with score 0 and is rejected; a
text with letters but no subword gets the scores of the bias alone; with nothing to learn from,
every document is ``und``; with one language every text with a letter is of it; ties go to the
language that sorts first; repeated rows are predicted alike; an empty table gives no rows. A null id
counts as held out.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioquery.llm.common import Workspace, id_fold, join_checked, map_batches, table, text_slices

QUERY = "op10_language_id"
ORACLE_SQL = None

BUCKETS = 1 << 16
DIM = 16
PER_LANG = 600
MOST_ROWS = 20_000
MAX_TRAIN_CHARS = 20_000
MOST_BYTES = 16 << 20
EPOCHS = 4
RATE = 0.5
#: Share of documents in no learned language that are to be rejected, and of right ones that may be.
JUNK_SHARE = 0.99
REJECT_SHARE = 0.001
#: Class scores (documents times languages) that calibration looks at.
CHECK_VALUES = 4_000_000
UNKNOWN = "und"

_SPACED = bytes(b if chr(b).isalpha() or b >= 128 else 32 for b in range(256))
_LETTER = regex.compile(r"\p{L}")
#: Windows scored at a time; bounds the memory of a batch or of one very long text.
_SLICE = 1 << 19


@dataclass
class LangModel:
    labels: list[str] = field(default_factory=list)
    rows: np.ndarray | None = None  # [BUCKETS + 1, labels or DIM]; the last row is zero
    layer: np.ndarray | None = None  # [DIM, labels] where rows are embeddings
    bias: np.ndarray | None = None
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, texts: list[str]) -> np.ndarray:
        out = []
        for at in range(0, len(texts), 256):
            mean = mean_rows([spaced_bytes(t) for t in texts[at : at + 256]], self.rows)
            out.append((mean if self.layer is None else mean @ self.layer) + self.bias)
        return np.concatenate(out)


def spaced_bytes(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "replace").translate(_SPACED) + b" "


def window_buckets(b: np.ndarray) -> list[np.ndarray]:
    """Bucket of the 3- and the 4-byte window at each of the first len(b) - 3 places; BUCKETS
    where a window has an inner space."""
    x = b.astype(np.uint32)
    n = len(x) - 3
    inner1 = b[1 : n + 1] == 32
    inner2 = b[2 : n + 2] == 32
    three = x[:n] | x[1 : n + 1] << 8 | x[2 : n + 2] << 16
    four = three | x[3 : n + 3] << 24
    out = []
    for key, salt, masked in ((three, 0x9E3779B1, inner1), (four, 0x85EBCA77, inner1 | inner2)):
        h = key * np.uint32(salt)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        bucket = (h >> np.uint32(16)).astype(np.int32)
        bucket[masked] = BUCKETS
        out.append(bucket)
    return out


def _padded(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(parts) + b"   ", np.uint8)


def mean_rows(parts: list[bytes], table_rows: np.ndarray) -> np.ndarray:
    """The mean of the rows of each document's subwords (0 without any)."""
    buf = _padded(parts)
    ends = np.cumsum([len(p) for p in parts])
    starts = np.concatenate(([0], ends[:-1]))
    total = np.zeros((len(parts), table_rows.shape[1] + 1))
    rows = np.concatenate((table_rows, np.ones((len(table_rows), 1), np.float32)), axis=1)
    rows[BUCKETS] = 0
    for at in range(0, int(ends[-1]), _SLICE):
        to = min(at + _SLICE, int(ends[-1]))
        first, last = np.searchsorted(ends, at, "right"), np.searchsorted(starts, to, "left")
        cuts = np.maximum(starts[first:last], at) - at
        for bucket in window_buckets(buf[at : to + 3]):
            total[first:last] += np.add.reduceat(rows[bucket], cuts, axis=0)
    return total[:, :-1] / np.maximum(total[:, -1:], 1)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], langs: list[str], seed: int = 7) -> LangModel:
    """Fit on the texts given. Every fourth is held back for calibration."""
    labels = sorted(set(langs))
    if not labels:
        return LangModel()
    number = {x: i for i, x in enumerate(labels)}
    y = np.array([number[x] for x in langs])
    bags = []
    for t in texts:
        w = np.concatenate(window_buckets(_padded([spaced_bytes(t)])))
        ids, n = np.unique(w[w < BUCKETS], return_counts=True)
        bags.append((ids, (n / max(1, n.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    k = len(labels)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer = rng.uniform(-0.5, 0.5, (DIM, k)).astype(np.float32)
    bias = np.zeros(k, np.float32)
    held = np.arange(len(texts)) % 4 == 3
    own = np.flatnonzero(~held & np.array([len(i) > 0 for i, _ in bags], bool))
    steps = max(1, EPOCHS * len(own))
    done = 0
    for _ in range(EPOCHS):
        for d in rng.permutation(own):
            ids, w = bags[d]
            rate = RATE * (1 - done / steps)
            done += 1
            h = w @ emb[ids]
            g = _softmax((h @ layer + bias)[None])[0]
            g[y[d]] -= 1
            back = layer @ g
            layer -= rate * np.outer(h, g)
            bias -= rate * g
            # the mean spreads a step over thousands of rows: scaled up to the step of a single row
            emb[ids] -= rate * np.float32(np.sqrt(len(ids))) * w[:, None] * back
    zero = np.zeros((1, DIM), np.float32)
    emb = np.concatenate((emb, zero))
    # the same function either way: class scores by bucket, or embeddings where classes are many
    model = LangModel(labels, emb @ layer, None, bias) if k <= DIM else LangModel(labels, emb, layer, bias)
    check = np.flatnonzero(held)
    check = check[: max(64, CHECK_VALUES // k)]
    if len(check) and k > 1:
        _calibrate(model, [texts[d] for d in check], y[check], rng)
    return model


def _dealt_anew(text: str, rng: np.random.Generator) -> str:
    """text with its letters in another order: words of the same lengths in no language."""
    chars = np.array(list(text.lower()))
    at = np.flatnonzero([c.isalpha() for c in chars])
    chars[at] = chars[rng.permutation(at)]
    return "".join(chars.tolist())


def _calibrate(model: LangModel, texts: list[str], y: np.ndarray, rng: np.random.Generator) -> None:
    z = model.logits(texts)
    at = np.arange(len(texts))
    grid = np.geomspace(0.05, 5, 60)
    loss = [-np.log(np.maximum(_softmax(z / t)[at, y], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = _softmax(z / model.temperature)
    sure = np.sort(p.max(axis=1)[p.argmax(axis=1) == y])
    junk = np.sort(_softmax(model.logits([_dealt_anew(t, rng) for t in texts]) / model.temperature).max(axis=1))
    if len(sure):
        model.reject_below = float(min(sure[int(REJECT_SHARE * len(sure))], junk[min(len(junk) - 1, int(JUNK_SHARE * len(junk)))]))


def sample_rows(docs: DataFrame, may_learn, work: Workspace, per_lang: int = PER_LANG, most: int = MOST_ROWS) -> DataFrame:
    """lang, drawn and text of the sample; at most `most` rows."""
    drawn = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit("language sample")), 1)
    rows = docs.filter(may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= MAX_TRAIN_CHARS))
    rows = rows.select("lang", "text", drawn.alias("drawn"))
    counts = work.table(rows.groupBy("lang").agg(F.approx_count_distinct("drawn").alias("n")), "langs")
    each = max(1, min(per_lang, most // max(1, counts.count())))
    # so many more than are wanted that fewer of a language are as good as impossible
    limits = counts.select("lang", (F.least(F.lit(1.0), F.lit(4.0 * each + 20) / F.col("n")) * float((1 << 63) - 1024)).cast("long").alias("limit"))
    few = join_checked(rows, work.table(limits, "limits"), "lang").filter("drawn <= limit")
    few = work.table(few.groupBy("lang", "drawn").agg(F.min("text").alias("text")), "few")
    place = F.row_number().over(W.partitionBy("lang").orderBy("drawn"))
    some = few.withColumn("place", place).filter(F.col("place") <= each).orderBy("drawn", "lang").limit(most)
    size = F.sum(F.octet_length("text")).over(W.orderBy("place", "drawn", "lang"))  # of at most `most` rows
    return some.withColumn("size", size).filter(F.col("size") <= MOST_BYTES).select("lang", "drawn", "text")


def fit(docs: DataFrame, may_learn=None, per_lang: int = PER_LANG) -> LangModel:
    """Learn from the rows of (doc_id, text, lang) where may_learn holds."""
    may_learn = F.col("doc_id").isNotNull() if may_learn is None else may_learn
    with Workspace(docs.sparkSession, "langs") as work:
        rows = sample_rows(docs.select("doc_id", "text", "lang"), may_learn, work, per_lang).collect()
    rows = sorted((r["drawn"], r["lang"], r["text"]) for r in rows)
    return train([r[2] for r in rows], [r[1] for r in rows])


def predict_texts(texts: list[str | None], model: LangModel) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Label, calibrated score and rejection of each text."""
    label, score, reject = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    known = [i for i, t in enumerate(texts) if t is not None and _LETTER.search(t)] if model.labels else []
    if known:
        p = _softmax(model.logits([texts[i] for i in known]) / model.temperature)
        best = p.argmax(axis=1)
        score[known] = p.max(axis=1)
        reject[known] = score[known] < model.reject_below
        for i, b in zip(known, best):
            label[i] = model.labels[b]
    return label, score, reject


def predict(docs: DataFrame, model: LangModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, lang_pred, score and rejected for each row of docs."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    names = list(keep)

    def run(batches):
        for b in text_slices(batches, "_text"):
            label, score, reject = predict_texts(b.column("_text").to_pylist(), model)
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in names] + [pa.array(label, pa.string()), pa.array(score), pa.array(reject)],
                names + ["lang_pred", "score", "rejected"],
            )

    rows = docs.select(*keep, F.col("text").alias("_text"))
    return map_batches(rows, run, f"{schema}, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: LangModel) -> DataFrame:
    """The rows of docs that the model does not reject, unchanged."""

    def run(batches):
        for b in text_slices(batches):
            reject = predict_texts(b.column("text").to_pylist(), model)[2]
            yield b.filter(pa.array(~reject))

    return map_batches(docs, run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learns from those whose id's crc32 mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(id_fold("doc_id", 4) == 2, F.lit(True))
    model = fit(docs, ~held)
    rows = docs.select("doc_id", "text", held.alias("held_out"))
    return predict(rows, model, ("doc_id", "held_out"))
