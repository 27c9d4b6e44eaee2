"""A stored inverted index: postings by token and shard, with a bound for each block of chunks.

A shard is a range of chunk ids, a block a smaller range within it. One row holds all postings of a token
in a shard (places of chunks and term frequencies, arrays in order of place) and, for each block that has
any, the largest frequency and where its postings end. Rows lie in folders by a hash of the token and
are sorted by token within their files. Beside them, one row a shard holds the key of each chunk by
which hits of the same source, page and first characters are told apart.

    build_postings(chunk_tokens, chunks, path)      write an index
    open_postings(spark, path)                      read it
    best_hits(postings, asked, near, pool)          the pool best chunks of each question
    scan_hits(chunks, asked, near, pool)            the same without an index, for questions asked once

A search reads only the buckets of its questions' tokens and of those only the rows of such tokens. What
it reads is brought together by shard, with the questions in blocks, so neither chunks' texts nor pairs of
questions and chunks are moved, and no question is sent to the driver. Within a shard a question's blocks
are bounded by the frequencies they could share with it; the blocks of the highest bounds are counted
first, and of the others only those that could still bring a hit among the pool best.

A scan reads every chunk where it lies: a task makes the postings of some thousand chunks, of the asked
tokens alone, in memory, searches them as a shard and gives out their hits, so that neither tokens nor
postings are shuffled or written. The questions' tokens are sent to the tasks, so they have to be few.

Defined cases: texts and questions that are null, blank or without a token have no postings and no hits;
stop words are tokens like any other; equal counts go by chunk id; a chunk id stands for one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioquery.functions import text as T
from folioquery.scratch import BROADCAST_BYTES, map_batches, measured_bytes, new_path

#: Chunk ids of a shard and of a block, and folders of an index.
SHARD = 1 << 16
BLOCK = 128
BUCKETS = 64
#: Questions that meet a shard together.
QUESTION_BLOCK = 4096
#: Blocks of a shard that are counted before the others are held against the pool.
FIRST_BLOCKS = 4
#: Chunks and their pairs with asked tokens that a scan searches together; a batch of rows goes beyond.
SCAN_ROWS = 1 << 16
SCAN_PAIRS = 1 << 21

_ROWS = "bucket int, token string, shard long, blocks array<int>, most array<int>, ends array<int>, places array<int>, tfs array<int>"
_KEYS = "shard long, places array<int>, keys array<long>"


class Postings(NamedTuple):
    """rows: (bucket, token, shard, blocks, most, ends, places, tfs); keys: (shard, places, keys)."""

    rows: DataFrame
    keys: DataFrame
    shard: int
    block: int
    buckets: int


def _bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def _places(rows: DataFrame, shard: int) -> DataFrame:
    """rows with the shard of chunk_id and its place there."""
    at = F.floor(F.col("chunk_id") / F.lit(shard)) if shard & (shard - 1) else F.shiftright("chunk_id", shard.bit_length() - 1)
    rows = rows.withColumn("shard", at.cast("long"))
    return rows.withColumn("place", (F.col("chunk_id") - F.col("shard") * shard).cast("int"))


def _bounds(places: np.ndarray, tfs: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of postings in order of place: the blocks that have any, their largest frequencies, where they end."""
    of, first = np.unique(places // block, return_index=True)
    return of, np.maximum.reduceat(tfs, first), np.append(first[1:], len(places))


def _with_bounds(block: int):
    """Postings as arrays of (place, tf) -> arrays of their own, with the blocks' maxima and ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("found")
            values, offsets = lists.values, lists.offsets.to_numpy()
            places, tfs = (values.field(i).to_numpy() for i in (0, 1))
            blocks, most, ends = [], [], []
            for start, stop in zip(offsets[:-1], offsets[1:]):
                for column, own in zip((blocks, most, ends), _bounds(places[start:stop], tfs[start:stop], block)):
                    column.append(own.astype(np.int32))
            made = [pa.array(x, pa.list_(pa.int32())) for x in (blocks, most, ends)]
            own = [pa.ListArray.from_arrays(lists.offsets, values.field(i)) for i in (0, 1)]
            columns = [b.column("bucket"), b.column("token"), b.column("shard"), *made, *own]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "token", "shard", "blocks", "most", "ends", "places", "tfs"])

    return run


def hit_key(source: Column | str = "source", page: Column | str = "page", text: Column | str = "text", prefix: int = 120) -> Column:
    """Hits of equal keys are the same to a reader: hash of source, page and first characters."""
    return F.xxhash64(F.col(source).cast("string"), F.col(page).cast("string"), F.left(text, F.lit(prefix)))


def build_postings(chunk_tokens: DataFrame, chunks: DataFrame, path: str | None = None, shard: int = SHARD, block: int = BLOCK, buckets: int = BUCKETS) -> Postings:
    """Write the index of chunk_tokens (chunk_id, token, tf) over chunks (chunk_id, source, page, text);
    without a path it lasts as long as the driver."""
    spark = chunks.sparkSession
    path = path or new_path(spark, "postings")
    found = F.array_sort(F.collect_list(F.struct("place", "tf")))
    # dealt by bucket and some neighbouring shards, so that a frequent token is many tasks' and a file holds a few shards
    near = F.floor(F.col("shard") / buckets).alias("near")
    placed = _places(chunk_tokens.withColumn("tf", F.col("tf").cast("int")), shard).select(_bucket(F.col("token"), buckets).alias("bucket"), near, "token", "shard", "place", "tf")
    gathered = placed.repartition("bucket", "near").groupBy("bucket", "near", "token", "shard").agg(found.alias("found"))
    rows = gathered.select("bucket", "token", "shard", "found").mapInArrow(_with_bounds(block), _ROWS)
    rows.sortWithinPartitions("bucket", "token", "shard").write.partitionBy("bucket").parquet(f"{path}/rows")
    named = _places(chunks.select("chunk_id", hit_key().alias("key")), shard)
    keys = named.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("place", "key"))).alias("k"))
    keys.select("shard", F.col("k.place").alias("places"), F.col("k.key").alias("keys")).write.parquet(f"{path}/keys")
    spark.createDataFrame([(shard, block, buckets)], "shard int, block int, buckets int").coalesce(1).write.parquet(f"{path}/form")
    return open_postings(spark, path)


def open_postings(spark: SparkSession, path: str) -> Postings:
    schema = StructType.fromDDL(_ROWS)
    rows = spark.read.schema(schema).parquet(f"{path}/rows")
    return Postings(rows, spark.read.schema(_KEYS).parquet(f"{path}/keys"), *spark.read.parquet(f"{path}/form").first())


def rows_of(postings: Postings, tokens: DataFrame) -> DataFrame:
    """The rows of postings in the buckets of tokens (token, ..): the others' folders are not opened."""
    buckets = [r[0] for r in tokens.select(_bucket(F.col("token"), postings.buckets)).distinct().collect()]  # at most postings.buckets
    return postings.rows.filter(F.col("bucket").isin(buckets)) if buckets else postings.rows.limit(0)


def _cells(postings: Postings, asked: DataFrame, near: DataFrame) -> DataFrame:
    """One stream of rows for each block of questions and shard: kind 0, questions' near places (n);
    1, the keys of the shard; 2, postings with the questions that ask for the token (n times)."""
    count = max(1, -(-asked.select("qid").distinct().count() // QUESTION_BLOCK))
    qblock = F.pmod(F.xxhash64("qid"), F.lit(count)).cast("int").alias("qblock")
    none = F.lit(None)
    tokens = asked.select(qblock, "token", "qid", F.col("q_tf").cast("int").alias("n"))
    askers = tokens.groupBy("qblock", "token").agg(F.collect_list(F.struct("qid", "n")).alias("askers"))
    small = measured_bytes(tokens) <= BROADCAST_BYTES
    found = rows_of(postings, tokens).join(F.broadcast(askers) if small else askers.hint("merge"), "token")
    found = found.select("qblock", "shard", F.lit(2).alias("kind"), "blocks", "most", "ends", "places", "tfs", none.cast("array<long>").alias("keys"), "askers")
    empty = [none.cast("array<int>").alias(c) for c in ("blocks", "most", "ends", "places", "tfs")]
    apart = _places(near.select("qid", "chunk_id"), postings.shard).groupBy(qblock, "shard").agg(F.collect_list(F.struct("qid", F.col("place").alias("n"))).alias("askers"))
    apart = apart.select("qblock", "shard", F.lit(0).alias("kind"), *empty, none.cast("array<long>").alias("keys"), "askers")
    keys = postings.keys.select(F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("qblock"), "shard", F.lit(1).alias("kind"), *empty[:3], "places", empty[4], "keys", none.cast("array<struct<qid:bigint,n:int>>").alias("askers"))
    return found.unionByName(apart).unionByName(keys).repartition("qblock", "shard").sortWithinPartitions("qblock", "shard", "kind")


class _Cell:
    """The rows of one block of questions and shard."""

    def __init__(self, block: int, blocks: int, pool: int):
        self.block, self.blocks, self.pool = block, blocks, pool
        self.near: dict[int, list[int]] = {}
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.of: dict[int, list[tuple[int, int]]] = {}  # of each question its rows and how often it asks
        self.places = self.keys = np.zeros(0, np.int64)

    def take(self, kind: int, row: dict, askers: list[tuple[int, int]] | None) -> None:
        if kind == 1:
            self.places, self.keys = row["places"], row["keys"]
            return
        for qid, n in askers:
            if kind == 0:
                self.near.setdefault(qid, []).append(n)
            else:
                self.of.setdefault(qid, []).append((len(self.rows), n))
        if kind == 2:
            counts = np.diff(row["ends"], prepend=0)
            self.rows.append((row["blocks"], row["most"], counts, row["places"], row["tfs"]))

    def _count(self, own, wanted: np.ndarray, shared: np.ndarray) -> None:
        """Add what the question shares with the chunks of the wanted blocks."""
        every = wanted.all()
        for r, n in own:
            blocks, _, counts, places, tfs = self.rows[r]
            if not every:
                kept = wanted[blocks]
                if not kept.any():
                    continue
                if not kept.all():
                    kept = np.repeat(kept, counts)
                    places, tfs = places[kept], tfs[kept]
            shared[places] += np.minimum(tfs, n)  # a place stands once in a row

    def _best(self, shared: np.ndarray, near: np.ndarray) -> list[int]:
        """The pool best places, by count and then place, that differ in key and are not near."""
        shared = shared.copy()
        shared[near] = 0
        at = np.flatnonzero(shared)
        order = at[np.lexsort((at, -shared[at]))]
        for most in (8 * self.pool, len(order)):
            head = order[:most]
            keys = self.keys[np.searchsorted(self.places, head)]
            _, first = np.unique(keys, return_index=True)
            if len(first) >= self.pool or len(head) == len(order):
                break
        return head[np.sort(first)[: self.pool]].tolist()

    def hits(self) -> Iterator[tuple[int, int, int]]:
        """(qid, place, shared): a question's near places and its pool best others."""
        shared = np.zeros(self.blocks * self.block, np.int64)
        for qid, own in self.of.items():
            near = np.array(self.near.get(qid, ()), np.int64)
            bound = np.zeros(self.blocks, np.int64)
            for r, n in own:
                bound[self.rows[r][0]] += np.minimum(self.rows[r][1], n)
            first = np.zeros(self.blocks, bool)
            first[np.argsort(-bound, kind="stable")[:FIRST_BLOCKS]] = True
            first[near // self.block] = True
            shared[:] = 0
            self._count(own, first, shared)
            best = self._best(shared, near)
            if len(best) < self.pool:
                rest = bound > 0
            else:  # of equal counts only an earlier place gets in
                least, last = shared[best[-1]], best[-1]
                rest = (bound > least) | ((bound == least) & (np.arange(self.blocks) * self.block < last))
            rest &= ~first
            if rest.any():
                self._count(own, rest, shared)
                best = self._best(shared, near)
            for place in {*near.tolist(), *best}:
                if shared[place]:
                    yield qid, place, int(shared[place])


def _searcher(postings: Postings, pool: int):
    size, blocks, block = postings.shard, -(-postings.shard // postings.block), postings.block
    arrays = ("blocks", "most", "ends", "places", "tfs", "keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cell = None, None

        def close():
            found = list(cell.hits())
            if found:
                qid, place, shared = (np.array(x, np.int64) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(qid), pa.array(place + at[1] * size), pa.array(shared)], ["qid", "chunk_id", "shared"])

        for b in batches:
            qblocks, shards, kinds = (b.column(c).to_pylist() for c in ("qblock", "shard", "kind"))
            for i, (qblock, shard, kind) in enumerate(zip(qblocks, shards, kinds)):
                if (qblock, shard) != at:
                    if cell is not None:
                        yield from close()
                    at, cell = (qblock, shard), _Cell(block, blocks, pool)
                # copies, as the batch goes
                row = {c: v.values.to_numpy(zero_copy_only=False).copy() for c in arrays if (v := b.column(c)[i]).is_valid}
                askers = b.column("askers")[i]
                pairs = None
                if askers.is_valid:
                    pairs = list(zip(askers.values.field(0).to_pylist(), askers.values.field(1).to_pylist()))
                cell.take(kind, row, pairs)
        if cell is not None:
            yield from close()

    return run


def best_hits(postings: Postings, asked: DataFrame, near: DataFrame, pool: int) -> DataFrame:
    """(qid, chunk_id, shared): what each question of asked (qid, token, q_tf) shares, counted with
    repeats, with its near chunks (qid, chunk_id) and, of each shard, with the pool best others that
    differ in source, page and first characters. asked has to be materialised."""
    return _cells(postings, asked, near).mapInArrow(_searcher(postings, pool), "qid long, chunk_id long, shared long")


_LETTERS = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789_", np.uint8))


def word_runs(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The row and the run of every run of letters, digits and _ in the texts (T.word_bytes), in order."""
    texts = pc.fill_null(texts, b"").cast(pa.binary())
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    word = _LETTERS[data]
    begins, closes = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    closes[:-1] &= ~word[1:]
    cuts = ends[1:-1]  # a run ends with its row, whatever comes next
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts], closes[cuts - 1] = word[cuts], word[cuts - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    offsets = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int32)
    runs = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[word]))
    return np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, ends))), runs.dictionary_encode()


def _scanner(asked: list, pool: int, block: int = BLOCK):
    wanted = sorted({token for _, token, _ in asked})
    number = {token: i for i, token in enumerate(wanted)}

    def search(rows: list, pairs: list, near: list) -> Iterator[pa.RecordBatch]:
        """The hits of rows [(ids, keys)], pairs [(row, token, tf)] and near [(row, qid)]."""
        ids, keys = (np.concatenate(x) for x in zip(*rows))
        row, token, tf = (np.concatenate(x) for x in zip(*pairs))
        order = np.argsort(ids, kind="stable")  # places are in order of id, as equal counts go by it
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        ids, keys = ids[order], keys[order]
        by = np.argsort(token * len(ids) + place[row], kind="stable")
        token, places, tfs = token[by], place[row[by]], tf[by]
        cell = _Cell(block, -(-len(ids) // block), pool)
        cell.places, cell.keys = np.arange(len(ids)), keys
        found, first = np.unique(token, return_index=True)
        for start, stop in zip(first, [*first[1:], len(token)]):
            of, most, ends = _bounds(places[start:stop], tfs[start:stop], block)
            cell.rows.append((of, most, np.diff(ends, prepend=0), places[start:stop], tfs[start:stop]))
        at = {int(t): i for i, t in enumerate(found)}
        for qid, word, n in asked:
            if (i := at.get(number[word])) is not None:
                cell.of.setdefault(qid, []).append((i, n))
        for r, qid in near:
            cell.near.setdefault(qid, []).append(int(place[r]))
        hits = list(cell.hits())
        if hits:
            qids, at, shared = (np.array(x, np.int64) for x in zip(*hits))
            is_near = [p in cell.near.get(q, ()) for q, p, _ in hits]
            yield pa.RecordBatch.from_arrays([pa.array(qids), pa.array(ids[at]), pa.array(shared), pa.array(keys[at]), pa.array(is_near, pa.bool_())], ["qid", "chunk_id", "shared", "key", "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, pairs, near, n_rows, n_pairs = [], [], [], 0, 0
        known_words = pa.array(wanted, pa.string())
        for b in batches:
            if not b.num_rows:
                continue
            owner, words = word_runs(b.column("words"))
            known = pc.fill_null(pc.index_in(words.dictionary, value_set=known_words), -1).to_numpy(zero_copy_only=False)
            token = known[words.indices.to_numpy(zero_copy_only=False)].astype(np.int64)
            kept = token >= 0
            own, tfs = np.unique(owner[kept] * len(wanted) + token[kept], return_counts=True)
            lists = b.column("near")
            near += zip((pc.list_parent_indices(lists).to_numpy(zero_copy_only=False) + n_rows).tolist(), lists.flatten().to_pylist())
            rows.append([b.column(c).to_numpy(zero_copy_only=False) for c in ("chunk_id", "key")])
            pairs.append((own // max(1, len(wanted)) + n_rows, own % max(1, len(wanted)), tfs))
            n_rows, n_pairs = n_rows + b.num_rows, n_pairs + len(own)
            if n_rows >= SCAN_ROWS or n_pairs >= SCAN_PAIRS:
                yield from search(rows, pairs, near)
                rows, pairs, near, n_rows, n_pairs = [], [], [], 0, 0
        if n_rows:
            yield from search(rows, pairs, near)

    return run


def scan_hits(chunks: DataFrame, asked: DataFrame, near: DataFrame, pool: int) -> DataFrame:
    """best_hits() of chunks (chunk_id, source, page, text) without an index, brought down to the pool best
    of all chunks. near is broadcast and asked sent to the tasks: both have to be materialised and small."""
    words = [(r["qid"], r["token"], r["q_tf"]) for r in asked.filter("qid IS NOT NULL").select("qid", "token", "q_tf").collect()]
    at = near.groupBy("chunk_id").agg(F.collect_list(F.col("qid").cast("long")).alias("near"))
    named = chunks.filter("chunk_id IS NOT NULL").select(F.col("chunk_id").cast("long"), hit_key().alias("key"), T.word_bytes("text").alias("words"))
    read = named.join(F.broadcast(at), "chunk_id", "left").select("chunk_id", "key", "words", "near")
    found = map_batches(read, _scanner(words, pool), "qid long, chunk_id long, shared long, key long, near boolean")
    # near hits all stay, of the others the pool best that differ in key
    first = F.row_number().over(W.partitionBy("qid", "near", "key").orderBy(F.desc("shared"), "chunk_id"))
    best = F.row_number().over(W.partitionBy("qid", "near").orderBy(F.desc("shared"), "chunk_id"))
    named = found.repartition("qid").withColumn("n", first).filter("near OR n = 1").withColumn("n", best)
    return named.filter(F.col("near") | (F.col("n") <= pool)).select("qid", "chunk_id", "shared")
