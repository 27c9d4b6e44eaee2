"""N-gram Jaccard self-join of documents with Bayesian pruning of candidates.

Documents are sets of 64-bit hashes of five consecutive words (of all words, if fewer); two are
linked from a Jaccard similarity of ``THRESHOLD`` on. Documents of equal sets are one set with a
count, so copies never pair.

Candidates: sets that agree on a band of ``BAND_ROWS`` MinHash values out of ``BANDS`` bands share a
bucket; at the threshold itself a pair misses every bucket with a chance of about 3e-6, above it
less. Within a bucket, pairs compare their MinHash values ``STEP`` at a time and are dropped as soon
as, with a uniform prior, the posterior probability of a similarity of at least the threshold falls
below ``TOLERANCE``. A bucket does not emit its surviving pairs but a spanning forest of them, so
what it writes grows with its members and not with their square; forests of all buckets join into
groups. A large bucket is dealt into blocks, and members first meet inside their block alone. Only
where its members are still apart after that, in all buckets, do its blocks meet each other.

Verification: the pairs of a group that the same pruning leaves are verified exactly from the whole
sets of hashes, in blocks: a group is dealt into blocks bounded by members and by shingles, each pair
of blocks is one cell, and a cell returns for each member the number of linked documents and a
spanning forest of the exact links. Classes are the components of the exact links. No link between
different sets of a group is lost, no pair is written, and no group, however large, meets in one task.
Counting links takes every cell, so what is shuffled for a group of n sets in b blocks is n * b sets;
keep_one() needs no counts and lets blocks meet only where a group is still apart.

Words: A-Z lower-cased, then runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F].

Defined cases: a document without words (or with null text) is a class of its own without links; a
class is named by its smallest doc_id, null ids counting last; links count documents, so of n copies
each has n - 1; repeated rows are copies; an empty table gives no rows; keep_one() leaves other
columns as they are, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.llm.common import Workspace, free_names, join_checked, map_batches, materialize, table, text_slices
from folioquery.llm.components import connected_components
from folioquery.llm.licenses import words_of

QUERY = "op7_ngram_jaccard_join"
ORACLE_SQL = None

NGRAM = 5
#: The threshold as a fraction, so that exact verification is exact.
THRESHOLD = (4, 5)
HASHES = 128
BANDS = 24
BAND_ROWS = 4
STEP = 16
TOLERANCE = 1e-9
#: Members of a bucket, and of a group, that are compared with each other at a time.
BUCKET_BLOCK = 1024
GROUP_BLOCK = 512
#: Shingles of a block of a group.
BLOCK_SHINGLES = 1 << 19

#: Characters from which a text's words are held a portion at a time.
LONG = 1 << 20
_BETWEEN = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")

_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * _P[1]
    return h ^ (h >> np.uint64(32))


def _word_hashes(words: list[list[str]]) -> np.ndarray:
    digest = {w: xxhash.xxh3_64_intdigest(w) for w in set(chain.from_iterable(words))}
    return np.fromiter(map(digest.__getitem__, chain.from_iterable(words)), np.uint64, sum(map(len, words)))


def _rolled(every: np.ndarray, n: int) -> np.ndarray:
    """The hash of each window of n words."""
    most = max(0, len(every) - n + 1)
    rolled = np.zeros(most, np.uint64)
    for k in range(n):
        rolled = (rolled + every[k : k + most]) * _P[0]
        rolled ^= rolled >> np.uint64(31)
    return _mixed(rolled)


def _short(every: np.ndarray) -> np.ndarray:
    """The one hash of a text of fewer words than a window."""
    h = np.uint64(len(every))
    for x in every:
        h = (h + x) * _P[2]
    return _mixed(np.array([h]))


def _portions(text: str, most: int):
    """text in parts of about most characters, cut between words."""
    at = 0
    while len(text) - at > most:
        end = m.start() if (m := _BETWEEN.search(text, at + most)) else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def _long_set(text: str, n: int, most: int) -> np.ndarray:
    """shingle_sets() of one text, whose words are held a portion at a time."""
    found, carried = [], np.zeros(0, np.uint64)
    for portion in _portions(text, most):
        every = np.concatenate((carried, _word_hashes([words_of(portion)])))
        found.append(np.unique(_rolled(every, n)))
        carried = every[max(0, len(every) - n + 1) :]
    found = np.unique(np.concatenate(found))
    return found if len(found) or not len(carried) else _short(carried)


def shingle_sets(texts: list[str | None], n: int = NGRAM, most: int = LONG) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; of a text of over most characters the words are
    held a portion at a time."""
    words = [words_of(t) if t is None or len(t) <= most else [] for t in texts]
    out, at = [], 0
    with np.errstate(over="ignore"):
        every = _word_hashes(words)
        # windows over all texts at once; those that cross into the next text are left out below
        rolled = _rolled(every, n)
        for t, w in zip(texts, words):
            if t is not None and len(t) > most:
                out.append(_long_set(t, n, most))
            elif len(w) >= n:
                out.append(np.unique(rolled[at : at + len(w) - n + 1]))
            elif w:
                out.append(_short(every[at : at + len(w)]))
            else:
                out.append(np.zeros(0, np.uint64))
            at += len(w)
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES MinHash values of 16 bits."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 1024):
            h = shingles[at : at + 1024, None] * _A[None] + _B[None]
            h >>= np.uint64(24)
            np.minimum(least, h.min(axis=0), out=least)
        return (_mixed(least) >> np.uint64(48)).astype("<u2")


def set_key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def least_matches(tolerance: float = TOLERANCE, threshold: float = THRESHOLD[0] / THRESHOLD[1]) -> dict[int, int]:
    """For each number of values compared, the fewest matches that keep a pair: with a uniform
    prior, P(similarity >= t | m of n match) = P(Binomial(n + 1, t) <= m)."""
    found = {}
    for n in range(STEP, HASHES + 1, STEP):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        found[n] = m
    return found


_LEAST = least_matches()


class Forest:
    """Union-find over 0 .. n - 1; a root is the smallest of its tree."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.trees = n

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.trees -= 1

    def edges(self) -> Iterator[tuple[int, int]]:
        return ((x, r) for x in range(len(self.up)) if (r := self.find(x)) != x)


def surviving(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a and b that are not pruned, comparing STEP values at a time."""
    matches = np.zeros((len(a), len(b)), np.int16)
    for k in range(STEP):
        matches += a[:, k, None] == b[None, :, k]
    i, j = np.nonzero(matches >= _LEAST[STEP])
    m = matches[i, j].astype(np.int32)
    for n in range(2 * STEP, HASHES + 1, STEP):
        if not len(i):
            break
        m = m + (a[i, n - STEP : n] == b[j, n - STEP : n]).sum(axis=1)
        good = m >= _LEAST[n]
        i, j, m = i[good], j[good], m[good]
    return i, j


def _blocks_of(rows: list[tuple]) -> tuple[list[int], list[int] | None]:
    """Places of the first and, in a cell of two blocks, the second block's rows."""
    first = [k for k, r in enumerate(rows) if r[0] == rows[0][0]]
    second = [k for k, r in enumerate(rows) if r[0] != rows[0][0]]
    return first, second or None


def bucket_forest(sigs: np.ndarray, first: list[int], second: list[int] | None, forest: Forest | None = None) -> Forest:
    """A spanning forest of the surviving pairs of one cell of a bucket, on top of the one given."""
    forest = forest or Forest(len(sigs))
    right = np.array(first if second is None else second)
    for at in range(0, len(first), 64):
        if forest.trees == 1:
            break
        left = np.array(first[at : at + 64])
        i, j = surviving(sigs[left], sigs[right])
        for x, y in zip(left[i].tolist(), right[j].tolist()):
            forest.join(x, y)
    return forest


def survivors(sigs: np.ndarray) -> np.ndarray:
    """Matrix of the pairs that are not pruned; False on the diagonal."""
    out = np.zeros((len(sigs), len(sigs)), bool)
    for at in range(0, len(sigs), 64):
        i, j = surviving(sigs[at : at + 64], sigs)
        out[at + i, j] = True
    np.fill_diagonal(out, False)
    return out


def exact_links(sets: list[np.ndarray], candidates: np.ndarray | None = None, threshold: tuple[int, int] = THRESHOLD) -> np.ndarray:
    """Matrix of the pairs, of the candidates if given, whose Jaccard similarity reaches the
    threshold; False on the diagonal."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    shared = np.zeros((n, n), np.int64)
    some = np.arange(n) if candidates is None else np.flatnonzero(candidates.any(axis=0) | candidates.any(axis=1))
    if len(some) == 2:
        a, b = some
        shared[a, b] = shared[b, a] = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
    elif len(some):
        owner = np.repeat(np.arange(len(some)), size[some])
        _, inverse, times = np.unique(np.concatenate([sets[k] for k in some]), return_inverse=True, return_counts=True)
        often = times[inverse] > 1  # what one set alone has is shared with none
        column = np.cumsum(times > 1)[inverse[often]] - 1
        owner = owner[often]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        inner = np.zeros((len(some), len(some)), np.int64)
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
            a, b = np.searchsorted(column, (low, low + 2048))
            dense = np.zeros((len(some), 2048), np.float32)
            dense[owner[a:b], column[a:b] - low] = 1
            inner += np.rint(dense @ dense.T).astype(np.int64)
        shared[np.ix_(some, some)] = inner
    p, q = threshold
    linked = (p + q) * shared >= p * (size[:, None] + size[None, :])
    linked &= shared > 0
    if candidates is not None:
        linked &= candidates
    np.fill_diagonal(linked, False)
    return linked


def _cells(batches, names: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """(cell, rows) of sorted batches; the first three columns name the cell."""
    at, held = None, []
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in names)):
            if row[:3] != at:
                if held:
                    yield at, held
                at, held = row[:3], []
            held.append(row[3:])
    if held:
        yield at, held


def _in_cells(rows: DataFrame, group: str, meet: str) -> DataFrame:
    """rows with n_blocks and block, each once for every cell (i <= j) that its block is in: cells of
    one block (meet: "within"), of two ("across") or "all"."""
    if meet == "within":
        dealt = rows.withColumn("i", F.col("block")).withColumn("j", F.col("block"))
    else:
        dealt = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        if meet == "across":
            dealt = dealt.filter("_other <> block")
        dealt = dealt.withColumn("i", F.least("block", "_other")).withColumn("j", F.greatest("block", "_other")).drop("_other")
    return dealt.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j", "block", "key")


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, key, n and sig of each row, materialised; key is null without words."""

    def run(batches):
        for b in text_slices(batches):
            sets = shingle_sets(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), b.column("text_hash"),
                    pa.array([set_key(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                ["doc_id", "text_hash", "key", "n", "sig"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return materialize(map_batches(rows, run, "doc_id long, text_hash long, key binary, n long, sig binary"), "join-rows")


def _bands(sets: DataFrame, with_sig: bool) -> DataFrame:
    """(bucket, key[, sig]) for each band of each set."""

    def run(batches):
        salts = np.arange(1, BANDS + 1, dtype=np.uint64) * _P[2]
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), "<u2").reshape(-1, HASHES)
                with np.errstate(over="ignore"):
                    packed = np.ascontiguousarray(sig[:, : BANDS * BAND_ROWS]).view("<u8").reshape(-1, BANDS)
                    bucket = _mixed((packed + salts[None]) * _P[0]).view(np.int64)
                where = pa.array(np.repeat(np.arange(part.num_rows), BANDS))
                columns = [pa.array(bucket.ravel()), part.column("key").take(where)]
                if with_sig:
                    columns.append(part.column("sig").take(where))
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "key", "sig"][: len(columns)])

    return map_batches(sets.select("key", "sig"), run, "bucket long, key binary" + (", sig binary" if with_sig else ""))


def _bucket_edges(members: DataFrame, meet: str) -> DataFrame:
    """Spanning forests (a, b) of the pairs that survive in cells of (bucket, key, sig, n_blocks,
    block, tree), members of one tree (null: none) being joined already."""

    def run(batches):
        a, b = [], []
        for cell, rows in _cells(batches, ["bucket", "i", "j", "block", "key", "sig", "tree"]):
            if len(rows) > 1 and not (cell[1] != cell[2] and rows[0][0] == rows[-1][0]):
                sigs = np.frombuffer(b"".join(r[2] for r in rows), "<u2").reshape(-1, HASHES)
                forest, of_tree = Forest(len(rows)), {}
                for k, r in enumerate(rows):
                    if r[3] is not None:
                        forest.join(k, of_tree.setdefault(r[3], k))
                for x, root in bucket_forest(sigs, *_blocks_of(rows), forest).edges():
                    a.append(rows[x][1])
                    b.append(rows[root][1])
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return map_batches(_in_cells(members, "bucket", meet), run, "a binary, b binary").distinct()


def candidate_groups(sets: DataFrame, work: Workspace) -> DataFrame:
    """(node, root): the groups that the surviving pairs of the buckets join."""
    bands = _bands(sets, False)
    full = work.table(bands.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "buckets")
    keys = work.table(join_checked(bands, full.select("bucket"), "bucket").select("key").distinct(), "keys")
    some = join_checked(sets.select("key", "sig"), keys, "key")

    def members(of: DataFrame) -> DataFrame:
        rows = join_checked(_bands(some, True), of, "bucket")
        n_blocks = F.ceil(F.col("size") / BUCKET_BLOCK).cast("int")
        return rows.select("bucket", "key", "sig", n_blocks.alias("n_blocks"), F.pmod(F.xxhash64("key"), n_blocks).cast("int").alias("block"))

    edges = work.table(_bucket_edges(members(full).withColumn("tree", F.lit(None).cast("binary")), "within"), "forests")
    groups = connected_components(edges, work)
    large = work.table(full.filter(F.col("size") > BUCKET_BLOCK), "large")
    if large.isEmpty():
        return groups
    trees = groups.select(F.col("node").alias("key"), F.col("root").alias("tree"))
    placed = join_checked(_bands(some, False), large, "bucket").join(trees, "key", "left").withColumn("tree", F.coalesce("tree", "key"))
    apart = placed.groupBy("bucket").agg(F.min("tree").alias("least"), F.max("tree").alias("most"), F.max("size").alias("size"))
    apart = work.table(apart.filter("least <> most").select("bucket", "size"), "apart")
    if apart.isEmpty():
        return groups
    more = _bucket_edges(members(apart).join(trees, "key", "left"), "across")
    return connected_components(edges.unionByName(more), work)


def _links(docs: DataFrame, wanted: DataFrame, meet: str, work: Workspace) -> DataFrame:
    """Rows (key, other, links): of a member of a group and a cell the number of linked documents
    (other null), and spanning forests of the links (links null)."""
    id_ = F.col("doc_id").cast("long")
    texts = docs.select(id_.isNull().alias("no_id"), F.coalesce(id_, F.lit(0)).alias("id"), F.xxhash64("text").alias("text_hash"), "text")
    found = join_checked(texts, wanted, ["no_id", "id", "text_hash"])
    names = ["root", "key", "copies", "n_blocks", "block", "sig"]

    def read(batches):
        for b in text_slices(batches):
            sets_ = shingle_sets(b.column("text").to_pylist())
            # another text of the same id and hash is told apart by its key
            good = pa.array([set_key(s) == k for s, k in zip(sets_, b.column("key").to_pylist())], pa.bool_())
            shingles = pa.array([s.tobytes() for s in sets_], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), shingles], [*names, "shingles"]).filter(good)

    members = map_batches(found, read, "root binary, key binary, copies long, n_blocks int, block int, sig binary, shingles binary")

    def run(batches):
        kind = pa.schema([("key", pa.binary()), ("other", pa.binary()), ("links", pa.int64())])
        out: list[tuple] = []
        for cell, rows in _cells(batches, ["root", "i", "j", "block", "key", "copies", "shingles", "sig"]):
            rows = [r for k, r in enumerate(rows) if not k or r[1] != rows[k - 1][1]]  # repeated rows
            if len(rows) < 2 or (cell[1] != cell[2] and rows[0][0] == rows[-1][0]):
                continue
            candidates = survivors(np.frombuffer(b"".join(r[4] for r in rows), "<u2").reshape(-1, HASHES))
            if cell[1] != cell[2]:
                block = np.array([r[0] for r in rows])
                candidates &= block[:, None] != block[None, :]
            linked = exact_links([np.frombuffer(r[3], np.uint64) for r in rows], candidates)
            links = linked @ np.array([r[2] for r in rows], np.int64)
            forest = Forest(len(rows))
            for x, y in zip(*map(np.ndarray.tolist, np.nonzero(np.triu(linked)))):
                if forest.trees == 1:
                    break
                forest.join(x, y)
            out += [(r[1], None, int(n)) for r, n in zip(rows, links) if n]
            out += [(rows[x][1], rows[root][1], None) for x, root in forest.edges()]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), kind)], schema=kind)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), kind)], schema=kind)

    return work.table(map_batches(_in_cells(members, "root", meet), run, "key binary, other binary, links long"), "links")


def verified(docs: DataFrame, sets: DataFrame, groups: DataFrame, count_links: bool, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(node, root) of the components of the exact links, and (key, links): of each member the
    number of documents it is linked with (of sets other than its own) or, if that is not wanted, 1."""
    group = work.table(groups.join(sets.select(F.col("key").alias("node"), "first", "copies", "n", "sig"), "node"), "groups")
    sizes = group.groupBy("root").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    n_blocks = F.greatest(F.ceil(F.col("members") / GROUP_BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    wanted = work.table(
        group.join(sizes.select("root", n_blocks.alias("n_blocks")), "root").select(
            F.col("first.is_null").alias("no_id"), F.coalesce("first.doc_id", F.lit(0).cast("long")).alias("id"), "first.text_hash",
            F.col("node").alias("key"), "root", "copies", "n_blocks", "sig", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int").alias("block"),
        ),
        "wanted",
    )

    def components(links: DataFrame) -> DataFrame:
        return connected_components(links.filter(F.col("other").isNotNull()).select(F.col("key").alias("a"), F.col("other").alias("b")), work)

    links = _links(docs, wanted, "all" if count_links else "within", work)
    roots = components(links)
    if not count_links:
        trees = roots.select(F.col("node").alias("key"), F.col("root").alias("tree"))
        large = wanted.filter("n_blocks > 1")
        placed = large.select("key", "root").join(trees, "key", "left").withColumn("tree", F.coalesce("tree", "key"))
        apart = placed.groupBy("root").agg(F.min("tree").alias("least"), F.max("tree").alias("most")).filter("least <> most").select("root")
        apart = work.table(apart, "apart")
        if not apart.isEmpty():
            more = _links(docs, work.table(join_checked(large, apart, "root"), "open"), "across", work)
            roots = components(links.unionByName(more))
        return roots, roots.select(F.col("node").alias("key"), F.lit(1).cast("long").alias("links"))
    return roots, links.filter(F.col("links").isNotNull()).groupBy("key").agg(F.sum("links").alias("links"))


def classes(docs: DataFrame, rows: DataFrame, count_links: bool = True) -> DataFrame:
    """Of every set that has copies or links: key, first (of the class: is_null, doc_id, text_hash)
    and, if links are counted, n_links. Materialised. rows: describe(docs)."""
    with Workspace(docs.sparkSession, "join") as work:
        first = F.struct(F.col("doc_id").isNull().alias("is_null"), "doc_id", "text_hash")
        sets = work.table(
            rows.filter(F.col("key").isNotNull()).groupBy("key")
            .agg(F.min(first).alias("first"), F.count("*").alias("copies"), F.max("n").alias("n"), F.max("sig").alias("sig")),
            "sets",
        )
        roots, counts = verified(docs, sets, candidate_groups(sets, work), count_links, work)
        linked = roots.withColumnRenamed("node", "key").join(counts, "key").join(sets.select("key", "first", "copies"), "key")
        linked = work.table(linked, "linked")
        of_class = linked.groupBy("root").agg(F.min("first").alias("first"))
        out = linked.drop("first").join(of_class, "root").select("key", "first", (F.col("links") + F.col("copies") - 1).alias("n_links"))
        copied = sets.filter("copies > 1").join(linked.select("key"), "key", "left_anti")
        every = out.unionByName(copied.select("key", "first", (F.col("copies") - 1).alias("n_links")))
        return materialize(every if count_links else every.drop("n_links"), "join-classes")


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and n_links of each row of docs."""
    rows = describe(docs)
    out = join_checked(rows.select("doc_id", "key"), classes(docs, rows), "key", "left")
    class_id = F.when(F.col("n_links").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row left of each class: that of the smallest id (null last, then by a hash of
    the text). Rows that equal it in id and text go as well."""
    rows = describe(docs)
    joined = join_checked(rows.select("doc_id", "text_hash", "key"), classes(docs, rows, count_links=False), "key")
    names = free_names(docs, "join_no_id", "join_id", "join_hash")
    tags = lambda: (F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    marked = joined.groupBy(*[c.alias(n) for c, n in zip(tags(), names)], F.col("text_hash").alias(names[2])).agg(F.max(stays).alias("stays"), F.count("*").alias("n_rows"))
    marked = materialize(marked.filter(~F.col("stays") | (F.col("n_rows") > 1)), "join-marked")
    tagged = docs.withColumns(dict(zip(names, (*tags(), F.xxhash64("text")))))
    own = [F.col(f"`{c}`") for c in docs.columns]
    rest = join_checked(tagged, marked.select(*names), names, "left_anti").select(*own)
    repeated = join_checked(tagged, materialize(marked.filter("stays").select(*names), "join-repeated"), names)
    return rest.unionByName(repeated.dropDuplicates(names).select(*own))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and links of every document."""
    return jaccard_join(table(spark, sf_dir, "documents"))
