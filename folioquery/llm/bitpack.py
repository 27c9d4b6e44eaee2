"""Token ids in a fixed-width bit-packed file format.

Every id takes the least number of bits that holds the largest id of the vocabulary. A segment is
self-contained bytes, little-endian throughout:

    magic "FQBP", version u16, bits u16, block u32, documents u64, ids u64
    document ids i64[documents], null marks u8[documents], padded to 8 bytes
    id offsets u64[documents + 1]        ids before each document of the segment
    block offsets u64[blocks + 1]        bytes before each block of packed ids
    blocks of ``BLOCK`` ids (the last may be shorter), packed from the lowest bit up

``BLOCK`` is a multiple of 64, so a block begins on a byte, rows of 64 ids fill whole 64-bit words,
and numpy packs and unpacks all rows of a lane at once. unpack() reads any range of ids by the
blocks it touches.

A dataset is a Parquet table of segments (shard, segment, n_docs, n_ids, payload) that Spark's
writer commits, so it lies on any store and a retried task leaves no halves. Shards are ranges of
doc_id cut at approximate quantiles, and a segment closes after ``SEGMENT_IDS`` ids. An id so frequent
that it fills several ranges is spread over them by ranges of a hash of the text, and null ids over
as many shards as their share of the rows asks for. document_ids() reads single documents by their ids
from the blocks that hold them, after the segments' own doc_id bounds have passed over the others.

Encoding uses the tokenizers library, without special tokens being added. A text of characters
whose classes all libraries share is split by the tokenizer's own pattern and the library encodes
each distinct match once; ids do not depend on what surrounds a match. Any other text, and any that
holds an added token's string, goes through the library's whole pipeline, in portions cut before a
blank that follows a non-blank, where no match or token can lie across.

Defined cases: a null text is empty; every document gets the end id; null ids come first; rows of
one id are ordered by a hash of their text and then by the ids' bytes; rows that agree in both lie in one
shard; an empty table gives an empty dataset; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioquery.llm.common import join_checked, map_batches, materialize, new_path, table, text_slices
from folioquery.llm.pieces import LONG, SinglePieceCache, by_volume, is_plain, split_portions

QUERY = "op9_token_bitpack"
ORACLE_SQL = None

END_ID = 0
BLOCK = 4096
SEGMENT_IDS = 1 << 20
CACHE_PIECES = 200_000
_HEAD = struct.Struct("<4sHHIQQ")
_CUT = re.compile(r"(?<=\S)(?=\s)")

# Byte-level alphabet: printable Latin-1 characters stand for their own byte, the others for the
# remaining bytes in order from U+0100 on.
_OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = [b for b in range(256) if b not in _OWN]
_ALPHABET = [chr(256 + _OTHERS.index(b)) if b in _OTHERS else chr(b) for b in range(256)]
_BLANK = _ALPHABET[32]


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def _shuffled(vocabulary: int) -> str:
    """The narrowest type between encoder and writer."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids as a bit stream, filled up to whole bytes."""
    n = len(ids)
    rows = -(-n // 64)
    lanes = np.zeros(rows * 64, np.uint64)
    lanes[:n] = ids
    lanes = lanes.reshape(rows, 64)
    words = np.zeros((rows, bits), np.uint64)
    for lane in range(64):
        at, shift = divmod(lane * bits, 64)
        words[:, at] |= lanes[:, lane] << np.uint64(shift)
        if shift + bits > 64:
            words[:, at + 1] |= lanes[:, lane] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()[: -(-n * bits // 8)]


def unpack_stream(raw: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    """The first n ids of a bit stream."""
    rows = -(-n // 64)
    words = np.zeros(rows * bits, "<u8")
    words.view(np.uint8)[: len(raw)] = np.frombuffer(raw, np.uint8)
    words = words.reshape(rows, bits)
    lanes = np.empty((rows, 64), np.uint64)
    mask = np.uint64((1 << bits) - 1)
    for lane in range(64):
        at, shift = divmod(lane * bits, 64)
        lane_ids = words[:, at] >> np.uint64(shift)
        if shift + bits > 64:
            lane_ids |= words[:, at + 1] << np.uint64(64 - shift)
        lanes[:, lane] = lane_ids & mask
    return lanes.reshape(-1)[:n].astype("<u4")


def write_segment(doc_ids: list[int | None], ids: list[np.ndarray], bits: int) -> bytes:
    """The bytes of a segment of documents in the order given."""
    every = np.concatenate(ids) if ids else np.zeros(0, "<u4")
    counts = np.array([len(i) for i in ids], np.uint64)
    offsets = np.concatenate(([0], np.cumsum(counts))).astype("<u8")
    blocks = -(-len(every) // BLOCK)
    places = np.minimum(np.arange(blocks + 1) * BLOCK, len(every))
    block_offsets = (-(-places * bits // 8)).astype("<u8")
    marks = np.array([d is None for d in doc_ids], np.uint8).tobytes()
    return b"".join(
        (
            _HEAD.pack(b"FQBP", 1, bits, BLOCK, len(ids), len(every)),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            marks + b"\0" * (-len(marks) % 8),
            offsets.tobytes(),
            block_offsets.tobytes(),
            pack(every, bits),
        )
    )


class Segment:
    """A segment's bytes, read in place."""

    def __init__(self, payload: bytes):
        magic, version, self.bits, self.block, self.n_docs, self.n_ids = _HEAD.unpack_from(payload)
        if magic != b"FQBP" or version != 1:
            raise ValueError("not a segment of packed ids")
        at = _HEAD.size
        raw = np.frombuffer(payload, "<i8", self.n_docs, at).tolist()
        at += 8 * self.n_docs
        marks = payload[at : at + self.n_docs]
        self.doc_ids = [None if m else d for d, m in zip(raw, marks)]
        at += self.n_docs + -self.n_docs % 8
        self.offsets = np.frombuffer(payload, "<u8", self.n_docs + 1, at).astype(np.int64)
        at += 8 * (self.n_docs + 1)
        blocks = -(-self.n_ids // self.block)
        self.block_offsets = np.frombuffer(payload, "<u8", blocks + 1, at).astype(np.int64)
        self.body = memoryview(payload)[at + 8 * (blocks + 1) :]

    def unpack(self, start: int, stop: int) -> np.ndarray:
        """The ids of places start to stop, from the blocks that hold them."""
        if start >= stop:
            return np.zeros(0, "<u4")
        first, last = start // self.block, -(-stop // self.block)
        raw = self.body[self.block_offsets[first] : self.block_offsets[last]]
        n = min(last * self.block, self.n_ids) - first * self.block
        return unpack_stream(raw, n, self.bits)[start - first * self.block : stop - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.unpack(int(self.offsets[k]), int(self.offsets[k + 1]))


class LibraryEncoder:
    """ids of texts by the tokenizers library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: type and bytes of ids, as narrow as the vocabulary allows
        self.kind = _shuffled(self.size)
        self.bytes_of = [int(i).to_bytes(np.dtype(self.kind).itemsize, "little") for i in range(self.size)]
        self.tokenize = self.tokenizer.model.tokenize
        self.cache = SinglePieceCache(self._piece, CACHE_PIECES)

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in found]

    def _whole(self, text: str) -> bytes:
        out, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, at + LONG) if at + LONG < len(text) else None
            to = cut.start() if cut else len(text)
            out += self._library([text[at:to]])
            at = to
        return b"".join(out)

    def _piece(self, piece: str) -> bytes:
        """Ids of a match by the library's model alone: a match needs no splitting, only its bytes in
        the model's alphabet, where of printable ASCII only the blank is another."""
        if piece.isascii() and piece.isprintable():
            found = self.tokenize(piece.replace(" ", _BLANK))
        else:
            found = self.tokenize("".join([_ALPHABET[b] for b in piece.encode()]))
        ids = self.bytes_of
        return ids[found[0].id] if len(found) == 1 else b"".join([ids[t.id] for t in found])

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        return [np.frombuffer(x, self.kind).astype("<u4").tobytes() for x in self.encode_narrow(texts)]

    def encode_narrow(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as self.kind."""
        out = [b""] * len(texts)
        by_piece = []
        for i, t in enumerate(texts):
            if is_plain(t) and not any(a in t for a in self.added):
                by_piece.append(i)
            else:
                out[i] = self._whole(t)
        for group in by_volume([texts[i] for i in by_piece]):
            where = [by_piece[k] for k in group]
            if len(where) == 1:
                out[where[0]] = b"".join(self.cache.ids_of([p])[0] for p in split_portions(texts[where[0]], True))
            else:
                for i, ids in zip(where, self.cache.ids_of([list(chain.from_iterable(split_portions(texts[i], True))) for i in where])):
                    out[i] = ids
        return out


@lru_cache(maxsize=2)
def load(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def write_packed(docs: DataFrame, out: str, path: str | None = None, end_id: int = END_ID) -> None:
    """Encode the rows of docs and write the dataset of segments to out."""
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, nulls = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    null_shards = max(1, round(shards * nulls / max(1, rows)))
    # approximate quantiles of the id column alone; a frequent id is a cut more than once
    cuts = docs.filter("doc_id is not null").approxQuantile("doc_id", [k / shards for k in range(1, shards)], 0.1 / shards)
    cuts = np.array(sorted(cuts))

    def shard_of(doc_id: int | None, spread: int) -> int:
        first, last = (0, null_shards - 1) if doc_id is None else (null_shards + int(np.searchsorted(cuts, doc_id, side)) for side in ("left", "right"))
        return first + (spread * (last - first + 1) >> 63)

    def encode(batches):
        encoder = load(path or public_tokenizers.path("byte_bpe_50k.json"))
        end = encoder.bytes_of[end_id]
        for b in text_slices(batches):
            doc_ids = b.column("doc_id").to_pylist()
            ids = [x + end for x in encoder.encode_narrow([t or "" for t in b.column("text").to_pylist()])]
            spread = b.column("spread").to_pylist()
            shard = [shard_of(d, x) for d, x in zip(doc_ids, spread)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), b.column("spread"), pa.array(shard, pa.int32()), pa.array([len(i) // len(end) for i in ids], pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "spread", "shard", "n", "ids"],
            )

    def write(batches):
        encoder = load(path or public_tokenizers.path("byte_bpe_50k.json"))
        bits, kind = bits_for(encoder.size), encoder.kind
        held: list = [[], []]
        at, number, total = None, 0, 0

        def close():
            payload = write_segment(held[0], held[1], bits)
            own = [d for d in held[0] if d is not None]
            bounds = {"first_id": [min(own, default=None)], "last_id": [max(own, default=None)]}
            row = {"shard": [at], "segment": [number], "n_docs": [len(held[0])], "n_ids": [total], **bounds, "payload": [payload]}
            return pa.RecordBatch.from_pydict(row, schema=schema)

        schema = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("payload", pa.binary())])
        for b in batches:
            for doc_id, shard, n, ids in zip(*(b.column(c).to_pylist() for c in ("doc_id", "shard", "n", "ids"))):
                if held[0] and (shard != at or total >= SEGMENT_IDS):
                    yield close()
                    held, total, number = [[], []], 0, number + 1 if shard == at else 0
                at = shard
                held[0].append(doc_id)
                held[1].append(np.frombuffer(ids, kind))
                total += n
        if held[0]:
            yield close()

    spread = F.shiftrightunsigned(F.xxhash64("text"), 1)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), spread.alias("spread"), "text")
    encoded = map_batches(given, encode, "doc_id long, spread long, shard int, n long, ids binary")
    ordered = encoded.repartition(shards, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "spread", "n", "ids")
    out_schema = "shard int, segment int, n_docs long, n_ids long, first_id long, last_id long, payload binary"
    map_batches(ordered, write, out_schema).write.option("parquet.block.size", 16 << 20).parquet(out)


def starts(segments: DataFrame) -> DataFrame:
    """shard, segment and the ids of all segments before (start), materialised."""
    sizes = materialize(segments.select("shard", "segment", "n_ids"), "pack-sizes")
    shard = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = shard.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("before"))
    within = F.sum("n_ids").over(W.partitionBy("shard").orderBy("segment")) - F.col("n_ids")
    found = sizes.withColumn("within", within).join(before, "shard")
    return materialize(found.select("shard", "segment", (F.col("before") + F.col("within")).alias("start")), "pack-starts")


def read_packed(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if wanted, ids of each document of a dataset."""
    segments = spark.read.parquet(path)
    rows = join_checked(segments.select("shard", "segment", "payload"), starts(segments), ["shard", "segment"])

    def run(batches):
        for b in batches:
            for payload, start in zip(b.column("payload"), b.column("start").to_pylist()):
                s = Segment(payload.as_py())
                every = s.unpack(0, s.n_ids)
                for low in range(0, s.n_docs, 4096):
                    own = range(low, min(low + 4096, s.n_docs))
                    ids = [every[s.offsets[k] : s.offsets[k + 1]].tobytes() for k in own]
                    columns = {
                        "doc_id": pa.array([s.doc_ids[k] for k in own], pa.int64()),
                        "start": pa.array([start + int(s.offsets[k]) for k in own], pa.int64()),
                        "n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(i) for i in ids], pa.int64()),
                    }
                    if with_ids:
                        columns["ids"] = pa.array(ids, pa.binary())
                    yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return map_batches(rows.select("payload", "start"), run, schema)


def document_ids(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids of the documents with the ids given. Only segments whose bounds hold one of them
    are read, and of those only the blocks of the documents."""
    wanted = sorted(set(doc_ids))
    has = F.exists(F.array(*[F.lit(d).cast("long") for d in wanted]), lambda d: (F.col("first_id") <= d) & (F.col("last_id") >= d)) if wanted else F.lit(False)
    bounded = (F.col("last_id") >= wanted[0]) & (F.col("first_id") <= wanted[-1]) if wanted else F.lit(False)
    some = spark.read.parquet(path).filter(bounded & has).select("payload")

    def run(batches):
        for b in batches:
            for payload in b.column("payload"):
                s = Segment(payload.as_py())
                at = [k for k, d in enumerate(s.doc_ids) if d in frozen]
                yield pa.RecordBatch.from_arrays([pa.array([s.doc_ids[k] for k in at], pa.int64()), pa.array([s.document(k).tobytes() for k in at], pa.binary())], ["doc_id", "ids"])

    frozen = frozenset(wanted)
    return map_batches(some, run, "doc_id long, ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, written as packed segments and read back."""
    out = new_path(spark, "packed")
    write_packed(table(spark, sf_dir, "documents"), out)
    return read_packed(spark, out)
