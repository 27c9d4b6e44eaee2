"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

Each match of the tokenizer's pattern is encoded on its own. Over the byte positions of a match
stands a segment tree whose nodes hold the leftmost minimum of the ranks of live neighbouring
pairs. The root names the next merge; the merge joins a node with its right neighbour and updates
the three leaves that change (the merged place, its left neighbour, the place that went away),
each in logarithmically many steps. Equal ranks merge leftmost first. A match that is a token as
a whole is that token.

The trees of many distinct matches of like length are kept as rows of one numpy array, so one step
does a merge in each of them. A few long matches, for which such steps would each do little, get a
tree of their own over plain arrays. A worker keeps the ids of up to ``CACHE_PIECES`` distinct matches
(none longer than ``CACHE_BYTES``) in each of two generations between batches, because words repeat;
matches of a very long text are taken in portions. So memory does not grow with a text but with its
longest match, by some 50 bytes a byte, and time with the match's length times its logarithm.

Defined cases: a null text encodes as the empty text (no ids, the digests of no bytes); repeated
rows give repeated results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from folioquery.llm.common import map_batches, table, text_slices
from folioquery.llm.pieces import PieceCache, by_volume, split_portions

QUERY = "op8_byte_bpe"
ORACLE_SQL = None

CACHE_PIECES = 60_000
CACHE_BYTES = 1024
_NONE = np.int64(1) << 62
#: Leaves of the trees that are worked on together.
_LEAVES = 1 << 19
#: Rows below which matches of more than _ALONE_BYTES are merged one by one.
_ALONE_ROWS = 16
_ALONE_BYTES = 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class ByteBPE:
    """Encoder and decoder for a table of ranks in which every single byte has one."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.cache = PieceCache(self.encode_pieces, CACHE_PIECES, CACHE_BYTES)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; -1 where they do not merge."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def merge_rows(self, rows: list[bytes], width: int) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of byte strings of 2 to width bytes; width: a power of two."""
        n, shift = len(rows), width.bit_length() - 1
        length = np.array([len(r) for r in rows])
        raw = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(n, width)
        ids = self.of_byte[raw]
        place = np.arange(width)
        after = np.where(place[None] + 1 < length[:, None], place[None] + 1, width)
        before = np.broadcast_to(place - 1, (n, width)).copy()
        rank = np.full((n, width), -1, np.int64)
        rank[:, :-1] = self.rank_of(ids[:, :-1], ids[:, 1:])
        rank[after == width] = -1
        alive = place[None] < length[:, None]
        tree = np.full((n, 2 * width), _NONE, np.int64)
        tree[:, width:] = np.where(rank >= 0, rank << shift | place, _NONE)
        node = width >> 1
        while node:
            np.minimum(tree[:, 2 * node : 4 * node : 2], tree[:, 2 * node + 1 : 4 * node : 2], out=tree[:, node : 2 * node])
            node >>= 1
        flat, flat_ids, flat_after, flat_before, flat_alive = (x.ravel() for x in (tree, ids, after, before, alive))
        live = np.arange(n)
        while True:
            top = flat[live * (2 * width) + 1]
            going = top < _NONE
            live, top = live[going], top[going]
            if not len(live):
                break
            base, root = live * width, live * (2 * width)
            at = top & (width - 1)
            right = flat_after[base + at]
            beyond = flat_after[base + right]
            joined = top >> shift
            flat_ids[base + at] = joined
            flat_alive[base + right] = False
            flat_after[base + at] = beyond
            more = beyond < width
            flat_before[(base + beyond)[more]] = at[more]
            left = flat_before[base + at]
            has = left >= 0
            # the three leaves that change
            key = np.full(len(live), -1, np.int64)
            key[more] = self.rank_of(joined[more], flat_ids[(base + beyond)[more]])
            flat[root + width + at] = np.where(key >= 0, key << shift | at, _NONE)
            flat[root + width + right] = _NONE
            left_at, left_root = left[has], root[has]
            key = self.rank_of(flat_ids[base[has] + left_at], joined[has])
            flat[left_root + width + left_at] = np.where(key >= 0, key << shift | left_at, _NONE)
            # and the nodes above them, level by level
            roots = np.concatenate((root, root, left_root))
            nodes = np.concatenate((at, right, left_at)) + width
            for _ in range(shift):
                nodes >>= 1
                children = roots + 2 * nodes
                flat[roots + nodes] = np.minimum(flat[children], flat[children + 1])
        out = ids.astype("<u4")
        return [out[i][alive[i]].tobytes() for i in range(n)]

    def merge_one(self, raw: bytes) -> bytes:
        """Ids of a byte string of at least 2 bytes, by a tree of its own."""
        n = len(raw)
        width = 1 << (n - 1).bit_length()
        shift, none = width.bit_length() - 1, int(_NONE)
        ranks, tokens, last = self.ranks, self.tokens, width - 1
        ids = array("i", self.of_byte[np.frombuffer(raw, np.uint8)].astype(np.int32).tobytes())
        after = array("i", np.arange(1, n + 1, dtype=np.int32).tobytes())
        before = array("i", np.arange(-1, n - 1, dtype=np.int32).tobytes())
        leaves = np.full(2 * width, _NONE, np.int64)
        first = np.array(ids, np.int64)
        rank = self.rank_of(first[:-1], first[1:])
        leaves[width : width + n - 1] = np.where(rank >= 0, rank << shift | np.arange(n - 1), _NONE)
        node = width >> 1
        while node:
            np.minimum(leaves[2 * node : 4 * node : 2], leaves[2 * node + 1 : 4 * node : 2], out=leaves[node : 2 * node])
            node >>= 1
        tree = array("q", leaves.tobytes())
        del leaves, first, rank

        def put(at: int, key: int) -> None:
            at += width
            tree[at] = key
            while at > 1:
                other = tree[at ^ 1]
                if other < key:
                    key = other
                at >>= 1
                if tree[at] == key:
                    break
                tree[at] = key

        while (top := tree[1]) < none:
            at, joined = top & last, top >> shift
            gone = after[at]
            beyond = after[gone]
            ids[at], ids[gone], after[at] = joined, -1, beyond
            key = none
            if beyond < n:
                before[beyond] = at
                r = ranks.get(tokens[joined] + tokens[ids[beyond]])
                if r is not None:
                    key = r << shift | at
            put(at, key)
            put(gone, none)
            left = before[at]
            if left >= 0:
                r = ranks.get(tokens[ids[left]] + tokens[joined])
                put(left, none if r is None else r << shift | left)
        out = np.array(ids, np.int32)
        return out[out >= 0].astype("<u4").tobytes()

    def encode_pieces(self, pieces: list[str]):
        """Each of the distinct matches with its ids."""
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            b = p.encode("utf-8", "replace")
            whole = self.ranks.get(b)
            if whole is not None:
                yield p, whole.to_bytes(4, "little")
            else:
                by_width.setdefault(1 << (len(b) - 1).bit_length(), []).append((p, b))
        for width, found in by_width.items():
            if width > _ALONE_BYTES and len(found) < _ALONE_ROWS:
                yield from ((p, self.merge_one(b)) for p, b in found)
                continue
            step = max(1, _LEAVES // width)
            for i in range(0, len(found), step):
                part = found[i : i + step]
                yield from zip((p for p, _ in part), self.merge_rows([b for _, b in part], width))

    def encode_many(self, texts: list[str]):
        """For each text, the portions of its ids, as (index, bytes), in order."""
        for group in by_volume(texts):
            if len(group) == 1:
                for portion in split_portions(texts[group[0]]):
                    yield group[0], self.cache.ids_of([portion])[0]
            else:
                portions = [list(chain.from_iterable(split_portions(texts[i]))) for i in group]
                yield from zip(group, self.cache.ids_of(portions))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(ids for _, ids in self.encode_many([text])), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    """The encoder of a rank file, once in each worker."""
    return ByteBPE(read_ranks(path))


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if wanted, ids (binary, little-endian
    unsigned 32-bit) for each row of docs. path: a rank file that every worker can open; the
    installed public one unless given."""

    def run(batches):
        bpe = load(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
        for b in text_slices(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            n = [0] * len(texts)
            of_ids = [hashlib.sha256() for _ in texts]
            of_bytes = [hashlib.sha256() for _ in texts]
            kept: list[list[bytes]] = [[] for _ in texts]
            for i, ids in bpe.encode_many(texts):
                n[i] += len(ids) // 4
                of_ids[i].update(ids)
                of_bytes[i].update(bpe.decode(np.frombuffer(ids, "<u4")))
                if with_ids:
                    kept[i].append(ids)
            columns = {
                "doc_id": b.column("doc_id"),
                "n_tokens": pa.array(n, pa.int64()),
                "ids_sha256": pa.array([h.hexdigest() for h in of_ids]),
                "decoded_sha256": pa.array([h.hexdigest() for h in of_bytes]),
            }
            if with_ids:
                columns["ids"] = pa.array([b"".join(k) for k in kept], pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_batches(docs.select("doc_id", "text"), run, schema + (", ids binary" if with_ids else ""))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes of every document."""
    return encode_documents(table(spark, sf_dir, "documents"), with_ids=False)
