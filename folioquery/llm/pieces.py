"""Splitting texts by the tokenizer's pattern, in bounded portions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain, islice

import public_tokenizers
import regex

_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Characters whose classes are the same in every Unicode version and library.
_ODD = re.compile(rf"[^\x00-\x1b\x20-\x7f{_LETTERS}]")
#: The public pattern written out for texts of those characters alone (about 3 times as fast).
_PLAIN = re.compile(
    rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\t-\r {_LETTERS}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)
_FULL = regex.compile(public_tokenizers.PATTERN)

#: Characters up to which a text is split in one go.
LONG = 1 << 20
#: Pieces of a longer text that are held at a time.
PORTION = 1 << 18


def is_plain(text: str) -> bool:
    return _ODD.search(text) is None


def split_portions(text: str, plain: bool | None = None) -> Iterator[list[str]]:
    """The matches of the pattern in order, in lists of bounded length. plain: is_plain(text)."""
    pattern = _PLAIN if (is_plain(text) if plain is None else plain) else _FULL
    if len(text) <= LONG:
        yield pattern.findall(text)
        return
    found = pattern.finditer(text)
    while portion := [m.group() for m in islice(found, PORTION)]:
        yield portion


def by_volume(texts: list[str], most: int = LONG) -> Iterator[range]:
    """Consecutive ranges of texts of about most characters; a longer text stands alone."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > most:
            yield range(start, i)
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield range(start, len(texts))


class PieceCache:
    """Ids of distinct matches of at most longest characters, kept while they are in use: of two
    generations the older one goes when the younger is full, and what is met again moves to the
    younger."""

    def __init__(self, encode: Callable[[list[str]], Iterator[tuple[str, bytes]]], most: int, longest: int = 1024):
        self.encode, self.most, self.longest = encode, most, longest
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids_of(self, portions: list[list[str]]) -> list[bytes]:
        """Ids of each list of matches, one after the other."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        new = set(chain.from_iterable(portions)).difference(young)
        known = new.intersection(old)
        young.update((p, old[p]) for p in known)
        if len(new) > len(known):
            young.update(self.encode(list(new - known)))
        get = young.__getitem__
        out = [b"".join(map(get, p)) for p in portions]
        for p in new:
            if len(p) > self.longest:
                del young[p]
        return out


class _Known(dict):
    """Ids by match; a match that is new is looked for among the old ones and else encoded."""

    def __init__(self, old: dict[str, bytes], encode: Callable[[str], bytes], longest: int):
        self.old, self.encode, self.longest = old, encode, longest

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            found = self.encode(piece)
        if len(piece) <= self.longest:
            self[piece] = found
        return found


class SinglePieceCache:
    """PieceCache for an encoder that takes matches one by one."""

    def __init__(self, encode: Callable[[str], bytes], most: int, longest: int = 1024):
        self.encode, self.most, self.longest = encode, most, longest
        self.young = _Known({}, encode, longest)

    def ids_of(self, portions: list[list[str]]) -> list[bytes]:
        out = []
        for p in portions:
            if len(self.young) > self.most:
                self.young.old = {}
                self.young = _Known(self.young, self.encode, self.longest)
            out.append(b"".join(map(self.young.__getitem__, p)))
        return out
