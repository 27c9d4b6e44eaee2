"""Chat formatting with a loss mask that is aligned to tokens by character offsets.

A template renders a conversation's turns between control strings that the tokenizer takes as single
special tokens. Control strings inside texts are escaped by a backslash behind their first character
(one more where some are there already), so that no text can open or close a turn, and taken back when
the text is read. Of a rendered conversation the spans of the assistant's texts are known; it is encoded
once with offsets, and of each span the first and last token are found by binary search among the sorted
offsets. Control strings stand alone in the encoding, so no token reaches over the edge of a span.

Conversations are gathered by id and rendered where they lie. One whose texts exceed ``PART_BYTES`` is
dealt by ranges of its turns instead and comes in parts, cut between turns, which read one after the
other give the same tokens; a text that is too long to be encoded in one go is cut before a blank behind
a non-blank, where no match of the tokenizer's pattern reaches over. So neither a conversation that holds
most messages nor a very long text is held whole by a task. digests() of such a conversation take its
parts in order through one task, as a hash of all of it must; it holds one part at a time.

Defined cases: a null text is empty; a null id is a conversation of its own, whose id stays null; null
turns come first; equal turns are ordered by role, null first, then by a hash of the text; repeated rows
are turns of their own; a null role is read back as the empty one; an unknown role is written out; a
conversation without assistant texts has an empty mask; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from folioquery.llm.bitpack import _ALPHABET
from folioquery.llm.common import join_checked, map_batches, materialize, table
from folioquery.llm.pieces import is_plain, split_portions

QUERY = "op13_chat_format"

#: Control strings by role: what opens a turn and what closes it; other roles are named between.
TURNS = {"user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("[TURN]", "[ROLE]", "[/TURN]")
#: The vocabulary's own special token, which a text may not name either.
RESERVED = ("<|endoftext|>",)
CONTROLS = (*dict.fromkeys(c for pair in TURNS.values() for c in pair), *OTHER)
LEARNED = "assistant"

#: Bytes of texts from which a conversation is cut into parts, and characters encoded in one go.
PART_BYTES = 4 << 20
ENCODE_CHARS = 1 << 18
#: Distinct matches whose tokens a worker keeps, and their most characters.
CACHE_PIECES = 200_000
LONGEST_PIECE = 1024

_RESTS: dict[str, list[str]] = {}
for _c in sorted((*CONTROLS, *RESERVED), key=len, reverse=True):
    _RESTS.setdefault(_c[0], []).append(re.escape(_c[1:]))
#: A control string with any number of backslashes behind its first character.
_SLASHED = re.compile("|".join(rf"{re.escape(first)}\\*(?:{'|'.join(rests)})" for first, rests in _RESTS.items()))
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))))
_CUT = re.compile(r"(?<=\S)(?=[ \t\r\n])")  # blanks to every library
_OPENS = {pair[0]: role for role, pair in TURNS.items()}


def escape(text: str) -> str:
    """text without control strings; the same where it has none."""
    return _SLASHED.sub(lambda m: m.group()[0] + "\\" + m.group()[1:], text)


def unescape(text: str) -> str:
    return _SLASHED.sub(lambda m: m.group()[0] + m.group()[1:].removeprefix("\\"), text)


class Rendered(NamedTuple):
    text: str
    starts: list[int]  # of the learned texts
    ends: list[int]


def render(turns) -> Rendered:
    """(role, text) of each turn as one string, and where the learned texts lie in it."""
    out, at, starts, ends = [], 0, [], []
    for role, text in turns:
        said = escape(text or "")
        if role in TURNS:
            opened, closed = TURNS[role]
        else:
            opened, closed = f"{OTHER[0]}{escape(role or '')}{OTHER[1]}", OTHER[2]
        out += (opened, said, closed)
        if role == LEARNED:
            starts.append(at + len(opened))
            ends.append(at + len(opened) + len(said))
        at += len(opened) + len(said) + len(closed)
    return Rendered("".join(out), starts, ends)


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a rendered string."""
    turns, at, opened, role = [], 0, None, ""
    for m in _CONTROL.finditer(text):
        mark, inside = m.group(), text[at : m.start()]
        at = m.end()
        if opened is None:
            if inside or (mark not in _OPENS and mark != OTHER[0]):
                raise ValueError(f"no turn begins at {m.start()}")
            opened, role = mark, _OPENS.get(mark, "")
        elif mark == OTHER[1] and opened == OTHER[0]:
            role, opened = unescape(inside), OTHER[1]
        elif mark == (OTHER[2] if opened == OTHER[1] else TURNS[role][1] if opened != OTHER[0] else None):
            turns.append((role, unescape(inside)))
            opened = None
        else:
            raise ValueError(f"{mark} at {m.start()} closes no turn")
    if opened is not None or at != len(text):
        raise ValueError("the last turn is open")
    return turns


class Coder:
    """A tokenizer with the template's control strings as special tokens.

    A text of characters whose classes all libraries share is split by the tokenizer's own pattern, and
    each distinct match is encoded once; what a match gives does not depend on what surrounds it. Any
    other text goes through the library whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Tokenizer.from_file(path)
        self.library.pre_tokenizer = ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=True)
        known = self.library.get_vocab(with_added_tokens=False)
        self.library.add_special_tokens([AddedToken(c, normalized=False, special=True) for c in CONTROLS])
        byte_of = {c: bytes([b]) for b, c in enumerate(_ALPHABET)}
        self.bytes_of = {i: b"".join(map(byte_of.__getitem__, t)) for t, i in known.items() if t not in RESERVED}
        self.bytes_of |= {self.library.token_to_id(c): c.encode() for c in CONTROLS}
        self.pieces: dict[str, tuple[bytes, bytes, bytes, int]] = {}

    def _piece(self, piece: str) -> tuple[bytes, bytes, bytes, int]:
        """Ids, first and last characters of a match's tokens, and how many there are."""
        found = self.library.encode(piece, add_special_tokens=False)
        spans = np.array(found.offsets, np.uint32).reshape(-1, 2)
        return np.array(found.ids, np.uint32).tobytes(), spans[:, 0].tobytes(), spans[:, 1].tobytes(), len(found.ids)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token ids of a text and their first and last (exclusive) characters."""
        if not is_plain(text):
            found = self.library.encode(text, add_special_tokens=False)
            spans = np.array(found.offsets, np.int64).reshape(-1, 2)
            return np.array(found.ids, np.uint32), spans[:, 0], spans[:, 1]
        pieces, at = [], 0
        for m in _CONTROL.finditer(text):
            for portion in split_portions(text[at : m.start()], True):
                pieces += portion
            pieces.append(m.group())
            at = m.end()
        for portion in split_portions(text[at:], True):
            pieces += portion
        if len(self.pieces) > CACHE_PIECES:
            self.pieces = {}
        known = self.pieces
        known.update((p, self._piece(p)) for p in set(pieces).difference(known))
        found = list(map(known.__getitem__, pieces))
        for p in [p for p in pieces if len(p) > LONGEST_PIECE]:
            known.pop(p, None)
        ids, firsts, lasts = (np.frombuffer(b"".join([f[k] for f in found]), np.uint32) for k in range(3))
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        starts = np.repeat(starts, np.fromiter((f[3] for f in found), np.int64, len(found)))
        return ids, firsts + starts, lasts + starts

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode()


@lru_cache(maxsize=2)
def _coder(path: str) -> Coder:
    return Coder(path)


def _cuts(text: str) -> list[int]:
    """Places that cut text into portions of about ENCODE_CHARS, none within a match of the pattern."""
    cuts, at = [0], 0
    while len(text) - at > ENCODE_CHARS:
        m = _CUT.search(text, at + ENCODE_CHARS)
        # a control string stands alone in any case, and one that is found earlier serves as well
        c = _CONTROL.search(text, at + ENCODE_CHARS, m.start() if m else len(text))
        if c is None and m is None:
            break
        at = c.start() if c else m.start()
        cuts.append(at)
    return [*cuts, len(text)]


def encode(coder: Coder, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token ids of text, portion by portion, and their first and last (exclusive) characters."""
    cuts = _cuts(text)
    found = [(a, coder.encode(text[a:b])) for a, b in zip(cuts, cuts[1:])]
    ids = np.concatenate([f[0] for _, f in found]).astype(np.int32)
    return ids, *(np.concatenate([f[k] + a for a, f in found]).astype(np.int64) for k in (1, 2))


def token_spans(firsts: np.ndarray, lasts: np.ndarray, starts, ends) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) token of each span of characters, by binary search: the tokens that
    end behind the span's start and begin before its end; an empty span has none."""
    starts, ends = np.asarray(starts, np.int64), np.asarray(ends, np.int64)
    some = ends > starts
    first = np.searchsorted(lasts, starts, "right")
    last = np.searchsorted(firsts, ends, "left")
    return np.where(some, first, 0), np.where(some, np.maximum(first, last), 0)


_SPAN = pa.struct([("first", pa.int32()), ("last", pa.int32())])


def _arranged(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages with part, dealt out and sorted: those of conversations that stay whole, and others."""
    said = F.coalesce("text", F.lit(""))
    rows = messages.select("conv_id", "turn", "role", said.alias("text"), F.col("conv_id").isNull().alias("lost"), F.coalesce("conv_id", F.lit(0)).alias("conv"))
    volume = rows.groupBy("conv", "lost").agg(F.sum(F.octet_length("text") + F.lit(32)).alias("bytes"))
    long = materialize(volume.filter(F.col("bytes") > PART_BYTES).select("conv", "lost"), "chat-long")
    order = ["conv", "lost", F.asc_nulls_first("turn"), F.asc_nulls_first("role"), "tie"]
    if long.isEmpty():
        whole, cut = rows, rows.limit(0)
    else:
        whole, cut = join_checked(rows, long, ["conv", "lost"], "left_anti"), join_checked(rows, long, ["conv", "lost"], "left_semi")
    tied = lambda some: some.withColumn("tie", F.md5(F.col("text").cast("binary")))
    whole = tied(whole).repartition("conv", "lost").sortWithinPartitions(*order).withColumn("range", F.lit(0))
    cut = tied(cut).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())
    columns = ["conv_id", "range", "role", "text", "lost"]
    return whole.select(*columns), cut.select(*columns)


def _runs(batches, most: int):
    """(conv_id, lost, range, part, turns) of consecutive rows of a conversation, cut at about most bytes."""
    at, part, turns, size = None, 0, [], 0
    for b in batches:
        columns = [b.column(c).to_pylist() for c in ("conv_id", "lost", "range", "role", "text")]
        for conv_id, lost, place, role, text in zip(*columns):
            key = (conv_id, lost, place)
            if key != at or size > most:
                if turns:
                    yield *at, part, turns
                part = part + 1 if key == at else 0
                at, turns, size = key, [], 0
            turns.append((role, text))
            size += len(text)
    if turns:
        yield *at, part, turns


_OUT = "part long, n_turns long, formatted string, input_ids array<int>, loss array<struct<first:int,last:int>>"
_BATCH_CHARS = 1 << 20


def _formatter(path: str, kind: pa.DataType, most: int):
    def run(batches):
        coder = _coder(path)
        rows, held = [], 0

        def batch():
            ids, loss, keys, parts, counts, texts = [], [], [], [], [], []
            for key, part, n, rendered in rows:
                found, firsts, lasts = encode(coder, rendered.text)
                first, last = token_spans(firsts, lasts, rendered.starts, rendered.ends)
                ids.append(found)
                loss.append([{"first": a, "last": b} for a, b in zip(first.tolist(), last.tolist()) if b > a])
                keys.append(key)
                parts.append(part)
                counts.append(n)
                texts.append(rendered.text)
            arrays = [pa.array(keys, kind), pa.array(parts, pa.int64()), pa.array(counts, pa.int64()), pa.array(texts, pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array(loss, pa.list_(_SPAN))]
            return pa.RecordBatch.from_arrays(arrays, ["conv_id", "part", "n_turns", "formatted", "input_ids", "loss"])

        for conv_id, _, place, part, turns in _runs(batches, most):
            rendered = render(turns)
            rows.append((conv_id, place << 32 | part, len(turns), rendered))
            held += len(rendered.text)
            if held > _BATCH_CHARS:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()

    return run


def _formatted(messages: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    kind = messages.schema["conv_id"].dataType
    schema = f"conv_id {kind.simpleString()}, {_OUT}"
    whole, cut = _arranged(messages)
    # a conversation that stays whole is never cut
    return map_batches(whole, _formatter(path, to_arrow_type(kind), 1 << 62), schema), map_batches(cut, _formatter(path, to_arrow_type(kind), PART_BYTES), schema)


def format_conversations(messages: DataFrame, path: str | None = None) -> DataFrame:
    """conv_id, part, n_turns, formatted, input_ids and loss (ranges of tokens, the last exclusive) of
    messages (conv_id, turn, role, text); parts of a long conversation in order of part."""
    whole, cut = _formatted(messages, path or public_tokenizers.path("byte_bpe_50k.json"))
    return whole.unionByName(cut)


def read_back(coder: Coder, ids: np.ndarray, loss) -> tuple[list[tuple[str, str]], list[str]]:
    """The turns that the ids hold, and the texts under the mask."""
    turns = parse(coder.decode(ids))
    return turns, [unescape(coder.decode(ids[s["first"] : s["last"]])) for s in loss]


def _reader(path: str):
    """Of each formatted row the turns and learned texts as strings, decoded from its ids."""

    def run(batches):
        coder = _coder(path)
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                ids = row.column("input_ids").values.slice(row.column("input_ids").offsets[0].as_py(), len(row.column("input_ids")[0])).to_numpy()
                turns, learned = read_back(coder, ids, row.column("loss")[0].as_py())
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                values = [[len(turns)], [said], ["".join(learned)], [len(row.column("formatted")[0].as_py())]]
                yield pa.RecordBatch.from_arrays([row.column("conv_id"), row.column("part"), *map(pa.array, values)], ["conv_id", "part", "n_turns", "said", "learned", "chars"])

    return run


def _hasher(kind: pa.DataType):
    """Digests of rows that come in order of conversation and part."""

    def run(batches):
        at, n, chars, shown, said, learned = None, 0, 0, 0, None, None
        out = []

        def close():
            out.append((at[0], n, said.hexdigest(), chars, learned.hexdigest(), shown))

        def batch():
            columns = list(zip(*out))
            types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in b.schema.names}
                if at != (row["conv_id"],):
                    if at is not None:
                        close()
                    at, n, chars, shown, said, learned = (row["conv_id"],), 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                n += row["n_turns"]
                chars += len(row["learned"])
                shown += row["chars"]
                said.update(row["said"].encode())
                learned.update(row["learned"].encode())
            if len(out) >= 4096:
                yield batch()
                out.clear()
        if at is not None:
            close()
        if out:
            yield batch()

    return run


def digests(messages: DataFrame, path: str | None = None) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of each conversation,
    all read back from its token ids and mask."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    kind = messages.schema["conv_id"].dataType
    name = kind.simpleString()
    read = f"conv_id {name}, part long, n_turns long, said string, learned string, chars long"
    hashed = f"conv_id {name}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    whole, cut = (map_batches(some, _reader(path), read) for some in _formatted(messages, path))
    parts = cut.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    hasher = _hasher(to_arrow_type(kind))
    return map_batches(whole, hasher, hashed).unionByName(map_batches(parts, hasher, hashed))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold the template's own control strings."""
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(messages.unionByName(own))


def _marks_sql() -> str:
    """Characters of a turn's control strings and of a role that is written out."""
    known = " ".join(f"WHEN '{role}' THEN {len(opened) + len(closed)}" for role, (opened, closed) in TURNS.items())
    return f"CASE role {known} ELSE {sum(map(len, OTHER))} + {_escaped_sql('role')} END"


def _escaped_sql(column: str) -> str:
    """Characters of a text when each control string in it has one backslash more."""
    return f"length({column}) + len(regexp_extract_all({column}, '{_SLASHED.pattern}'))"


#: What the output must read back to, from the messages alone.
ORACLE_SQL = f"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, md5(coalesce(text, '')) AS tie FROM conversations
  UNION ALL SELECT -1, n, ['user', 'assistant'][n + 1], '</s>[INST] ok [/INST]', '' FROM range(2) r(n))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, tie)) AS turns_sha256,
  sum(CASE WHEN role = '{LEARNED}' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = '{LEARNED}' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, tie)) AS loss_sha256,
  sum({_marks_sql()} + {_escaped_sql('text')})::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""
