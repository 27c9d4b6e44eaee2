"""Secret scan: fixed patterns and assignment-aware lexing.

Three fixed kinds of match (``assign``, ``access``, ``hex``) are the base. Beyond them, source and
configuration syntax is lexed into name-literal pairs: an operator (``=``, ``:``, ``:=``, ``=>``)
between a name (bare, quoted, a key in brackets, an option, an array, or declared with a type behind
a colon) and a literal (quoted, several quoted ones joined by ``+``, or bare). Names bound to quoted
literals, or to bare ones with digits, are constants; where a pair binds a sensitive name to a
constant, the constant's literal is what is scored: the last one before the pair, or else the first
one after it. A literal's score
is the weight of the most telling word of its target's name times its strength (length, variety of
characters, entropy; placeholders have none); from ``REPORT_FROM`` on it is reported as ``literal``.

Lexing starts from the operators alone. The name is read backwards from its operator, over the blanks
and the whole name that stand before it, and a declared type forward from its colon up to the next
one, so that no character is read for more than a few operators: it is linear in the text, and neither
a name's length nor the blanks around it matter. A bare literal is read up to the operator of the next
pair, so that `key=value&key=value` and its like are read once too. Whole texts are scanned.

Defined cases: a null text is scanned as the empty text; spans of one kind never overlap, spans of
different kinds may; equal starts are ordered by kind as listed, then by end; a span found twice is
reported once; repeated rows are scanned alike; an empty table gives no rows; redact() leaves other
columns as they are.
"""

from __future__ import annotations

import hashlib
import math
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from folioquery.llm.common import map_batches, table, text_slices

QUERY = "op6_secret_scan"
ORACLE_SQL = None

KINDS = ("assign", "access", "hex", "literal")
MASK = "[SECRET]"
REPORT_FROM = 0.5


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = re.compile(rf"""(?:{_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

_OPERATOR = re.compile(r"(?<![=!<>:])(?::=|=>|=(?![=~])|:(?![:/]))")
#: A name before an operator, of the text turned around: blanks, a place in brackets or a closing
#: bracket and quote, and the name, which begins behind up to two dashes.
_NAME = re.compile(r"""[ \t]*+(?:\][0-9]*+\[|(?:\][ \t]*+)?["'`]?)([A-Za-z0-9_.$-]*[A-Za-z_$])-{0,2}(?![A-Za-z0-9_.$-])""")
#: The same before the colon of a type, where a mark may stand between.
_DECLARED = re.compile(r"""[ \t]*+(?:[?!][ \t]*+)?["'`]?([A-Za-z0-9_.$-]*[A-Za-z_$])(?![A-Za-z0-9_.$-])""")
#: A type behind a colon, up to a single =. Its brackets hold no single colon.
_TYPE = re.compile(
    r"""[ \t]*+[&*]?(?:'[a-z]+[ \t]+)?[A-Za-z_][A-Za-z0-9_.]*+(?:\[(?:[^=\n:]|::)*\]|<(?:[^=\n:]|::)*>)?"""
    r"""(?:[ \t]*+\|[ \t]*+[A-Za-z_][A-Za-z0-9_.]*+)*+\??[ \t]*+(?==(?![=~>]))"""
)
_TYPES = frozenset("any bool boolean byte bytes char double final float int integer long none null object str string text undefined unicode".split())
_QUOTED = re.compile(r"""[ \t]*(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)')""")
_JOIN = re.compile(r"[ \t]*\+")
_BARE = re.compile(r"""[ \t]*([^\s"'`,;(){}\[\]<>]+)""")
#: What parts a bare literal from another pair that follows at once.
_PARTS = "&|#;?"
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_IDENTIFIER = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*(?:\.[A-Za-z_$][A-Za-z0-9_$]*)*\Z")

#: Weight of a word in a target's name.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "secrets": 1.0,
    "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "private": 0.7, "auth": 0.7,
    "authorization": 0.7, "bearer": 0.8, "signature": 0.6, "salt": 0.6, "cookie": 0.6, "session": 0.5,
}
#: Pairs of neighbouring words that weigh more together.
SENSITIVE_PAIRS = {("api", "key"): 1.0, ("access", "key"): 1.0, ("secret", "key"): 1.0, ("private", "key"): 1.0, ("encryption", "key"): 0.9, ("signing", "key"): 0.9, ("client", "key"): 0.8, ("connection", "string"): 0.7}
_PLACEHOLDER = re.compile(r"(?i)^(?:<.*>|\$\{.*|\{\{.*|%\(.*|.*\*{3,}.*|x{4,}|(?:your|my|the|some|test|dummy|example|sample|change|insert|todo|none|null|true|false|undefined|placeholder|redacted|password|secret|token)[\w-]*)$")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    value_start: int
    value_end: int
    score: float


def name_weight(name: str) -> float:
    words = [w.lower() for w in _WORDS.findall(name)]
    weight = max((SENSITIVE.get(w, 0.0) for w in words), default=0.0)
    return max([weight, *(SENSITIVE_PAIRS.get(p, 0.0) for p in zip(words, words[1:]))])


def strength(literal: str) -> float:
    """0 to 1: how much a literal looks like key material."""
    n = len(literal)
    if n < 6 or _PLACEHOLDER.match(literal) or any(c.isspace() for c in literal):
        return 0.0
    counts: dict[str, int] = {}
    for c in literal:
        counts[c] = counts.get(c, 0) + 1
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    classes = sum(any(f(c) for c in counts) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return min(1.0, 0.35 * min(1.0, n / 16) + 0.35 * min(1.0, entropy / 3.5) + 0.15 * (classes - 1))


def base_spans(text: str) -> list[Span]:
    found = []
    if ":" in text or "=" in text:
        for m in _ASSIGN.finditer(text):
            if m.end(1) - m.start(1) >= 6:
                found.append(Span("assign", m.start(), m.end(), m.start(1), m.end(1), 1.0))
    for kind, pattern in (("access", _ACCESS), ("hex", _HEX)):
        found += [Span(kind, m.start(), m.end(), m.start(), m.end(), 1.0) for m in pattern.finditer(text)]
    return found


def _named_operators(text: str) -> list[tuple[int, int, int, list[str], re.Match | None]]:
    """(start, end, start of the name, names, declared type) of every operator with a name. names: the
    word before it and, of a typed declaration, first the name that is declared (a plain type is none)."""
    found, back, n = [], text[::-1], len(text)
    declared: tuple[int, str] | None = None  # where the operator of a typed declaration stands, and its name
    for op in _OPERATOR.finditer(text):
        at = op.start()
        names, begins = [], at
        if m := _NAME.match(back, n - at):
            names, begins = [m.group(1)[::-1]], n - m.end(1)
        has_type = None
        if op.group() == ":" and (m := _DECLARED.match(back, n - at)) and (has_type := _TYPE.match(text, op.end())):
            declared = has_type.end(), m.group(1)[::-1]
        elif op.group() == "=" and declared and declared[0] == at:
            names = [declared[1]] + [x for x in names if x.lower() not in _TYPES]
        if names:
            found.append((at, op.end(), begins, names, has_type))
    return found


def pairs(text: str):
    """(names, literal, start, end, is_quoted) of each pair, in order. A bare literal ends where another
    pair begins in the same run of characters: before the mark that parts them, or else at the next
    pair's operator."""
    operators, n = _named_operators(text), len(text)
    limit, next_name = n, n  # of the first operator behind with a literal at once, and of its name
    limits = []
    for at, end, begins, *_ in reversed(operators):
        limits.append((limit, next_name))
        if end < n and not text[end].isspace():
            limit, next_name = at, begins
    for (_, end, _, names, has_type), (limit, next_name) in zip(operators, reversed(limits)):
        quoted = _QUOTED.match(text, end)
        if quoted:
            group = 1 if quoted.group(1) is not None else 2
            start, stop, parts, pos = quoted.start(group), quoted.end(group), [quoted.group(group)], quoted.end()
            while (plus := _JOIN.match(text, pos)) and (more := _QUOTED.match(text, plus.end())):
                group = 1 if more.group(1) is not None else 2
                parts.append(more.group(group))
                stop, pos = more.end(group), more.end()
            yield names, "".join(parts), start, stop, True
        elif bare := _BARE.match(text, end, limit):
            start, stop = bare.span(1)
            if stop == limit < n and start < next_name and text[next_name - 1] in _PARTS:
                stop = next_name - 1
            value = text[start:stop].rstrip(".:!?")
            if has_type and value.lower() in _TYPES:
                continue
            if value:
                yield names, value, start, start + len(value), False


def lexed_spans(text: str) -> list[Span]:
    if ":" not in text and "=" not in text:
        return []
    every = list(pairs(text))
    bound = {name for names, *_ in every for name in names}
    #: of each pair its literal, once that is known; of each name the last literal so far and the first at all
    literals: list[tuple[str, int, int] | None] = [None] * len(every)
    last: dict[str, tuple[str, int, int]] = {}
    first: dict[str, tuple[str, int, int]] = {}
    waiting: dict[str, list[int]] = {}
    for k, (names, value, start, end, is_quoted) in enumerate(every):
        if is_quoted:
            literals[k] = (value, start, end)
        elif value in last:
            literals[k] = last[value]
        elif _IDENTIFIER.match(value) and (value in bound or not any(c.isdigit() for c in value)):
            waiting.setdefault(value, []).append(k)  # defined later, unknown, or a word of prose
            continue
        else:
            literals[k] = (value, start, end)
        if is_quoted or literals[k][1] != start or any(c.isdigit() for c in value):
            for name in names:
                last[name] = literals[k]
                first.setdefault(name, literals[k])

    def settle(ready: list[str]) -> None:
        """Pass the literals of names on to the pairs that wait for them, and so on."""
        while ready:
            name = ready.pop()
            for k in waiting.pop(name, ()):
                literals[k] = first[name]
                for other in every[k][0]:
                    if other not in first:
                        first[other] = first[name]
                        ready.append(other)

    settle([name for name in first if name in waiting])
    # what looks like a name and a literal, and is no name of a literal, is a literal
    for value, k in sorted(((v, k) for v, ks in waiting.items() if any(c.isdigit() for c in v) for k in ks), key=lambda x: x[1]):
        if literals[k] is None:
            literals[k] = every[k][1:4]
            new = [name for name in every[k][0] if name not in first]
            first.update((name, literals[k]) for name in new)
            settle([name for name in new if name != value])
    found: dict[tuple[int, int], Span] = {}
    for (names, *_), literal in zip(every, literals):
        if literal is None:
            continue
        value, start, end = literal
        weight = max(map(name_weight, names))
        score = round(weight * strength(value), 6) if weight else 0.0
        if score >= REPORT_FROM and ((start, end) not in found or score > found[start, end].score):
            found[start, end] = Span("literal", start, end, start, end, score)
    return list(found.values())


def scan(text: str | None) -> list[Span]:
    """All spans of a text by start, then kind as listed, then end."""
    text = text or ""
    spans = {s[:3]: s for s in base_spans(text) + lexed_spans(text)}
    return sorted(spans.values(), key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def mask(text: str, spans: list[Span]) -> str:
    """text with the value of every span replaced; overlapping values as one."""
    out, at = [], 0
    merged: list[list[int]] = []
    for s, e in sorted((s.value_start, s.value_end) for s in spans):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in merged:
        out += [text[at:s], MASK]
        at = e
    return "".join(out) + text[at:]


def _text_of(spans) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of kind, start, end, value_start, value_end, score) of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value_start", pa.int64()), ("value_end", pa.int64()), ("score", pa.float64())]

    def run(batches):
        for b in text_slices(batches):
            found = [[s._asdict() for s in scan(t)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.list_(pa.struct(fields)))], ["doc_id", "spans"])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long,value_start:long,value_end:long,score:double>>")


def redact(docs: DataFrame) -> DataFrame:
    """docs with the secrets in text masked, and n_chars, where it is given, counted anew."""
    counted = "n_chars" in docs.columns

    def run(batches):
        for b in text_slices(batches):
            texts = b.column("text").to_pylist()
            masked = [t if not (found := scan(t)) else mask(t, found) for t in texts]
            b = b.set_column(b.schema.get_field_index("text"), "text", pa.array(masked, b.schema.field("text").type))
            if counted:
                at = b.schema.get_field_index("n_chars")
                n = [k if k is None or t is u else len(u) for k, t, u in zip(b.column(at).to_pylist(), texts, masked)]
                b = b.set_column(at, "n_chars", pa.array(n, b.schema.field(at).type))
            yield b

    return map_batches(docs, run, docs.schema)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, their digest and all spans as text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in text_slices(batches):
            rows = [scan(t) for t in b.column("text").to_pylist()]
            base = [[s for s in r if s.kind != "literal"] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id")]
                + [pa.array([sum(s.kind == k for s in r) for r in base], pa.int64()) for k in KINDS[:3]]
                + [pa.array([hashlib.sha256(_text_of(r).encode()).hexdigest() for r in base]), pa.array([_text_of(r) for r in rows])],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    return digests(table(spark, sf_dir, "documents"))
