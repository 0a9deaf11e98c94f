"""Cutting texts into chunks whose tokens do not depend on their neighbours.

The byte-level vocabulary splits a text by a pattern before it merges. Right before a
single space that follows or precedes a visible character there is always such a split,
so ``text.split(" ")`` gives chunks that can be encoded once and looked up afterwards.
Texts with other runs of white space, or with a special token in them, are split by the
pattern itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import WHITE, distinct_words, gather

#: The pattern of the byte-level vocabulary. Fixed value.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256

_BEFORE_SPACE = tuple(c + " " for c in WHITE)
_BLURRED = re.compile(f"[{WHITE}] (?:[{WHITE}]|\\Z)")

#: Most entries in one generation of a worker's cache, and the longest key that is kept.
CACHE_ENTRIES = 250_000
CACHE_CHARS = 48


def splits_at_spaces(text: str) -> bool:
    if SPECIAL in text:
        return False
    near = _BEFORE_SPACE[:8] if text.isascii() else _BEFORE_SPACE
    return not any(s in text for s in near) or _BLURRED.search(text) is None


def pretokens(text: str) -> list[str | None]:
    """The pattern's matches in order; None stands for the special token."""
    out: list[str | None] = []
    for i, part in enumerate(text.split(SPECIAL)):
        if i:
            out.append(None)
        out += PATTERN.findall(part)
    return out


def spaced_pretokens(chunk: str) -> list[str]:
    """The pattern's matches in a space and ``chunk``; plain words, also before a sign, need no pattern."""
    if chunk.isalpha():
        return [" " + chunk]
    if chunk[:-1].isalpha() and chunk[-1] in ",.;:!?":
        return [" " + chunk[:-1], chunk[-1]]
    return PATTERN.findall(" " + chunk)


class Recent:
    """A bounded map: what was used since the last turn survives the next one."""

    def __init__(self, make: Callable[[list[str]], list[bytes]], entries: int = CACHE_ENTRIES):
        self._make, self._entries = make, entries
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def look_up(self, keys: list[str]) -> list[bytes]:
        found = list(map(self._young.get, keys))
        gaps = [i for i, v in enumerate(found) if v is None]
        if gaps:
            missing = [keys[i] for i in gaps]
            values = list(map(self._old.get, missing))
            unknown = [k for k, v in zip(missing, values) if v is None]
            made = iter(self._make(unknown))
            values = [next(made) if v is None else v for v in values]
            for i, v in zip(gaps, values):
                found[i] = v
            self._young.update(zip(missing, values))
            for k in [k for k in missing if len(k) > CACHE_CHARS]:
                self._young.pop(k, None)
            if len(self._young) > self._entries:
                self._old, self._young = self._young, {}
        return found


class ChunkCache:
    """Texts to ids (little-endian unsigned 32-bit) through bounded caches of chunks and pre-tokens.

    ``encode`` takes a list of pre-tokens and returns the bytes of the ids of each.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], entries: int = CACHE_ENTRIES):
        self._pretokens = Recent(encode, entries)
        self._spaced = Recent(self._chunks, entries)  # by the chunk without its leading space

    def _known(self, pretokens: list[str]) -> dict[str, bytes]:
        own = list(set(pretokens))
        return dict(zip(own, self._pretokens.look_up(own)))

    def _chunks(self, keys: list[str]) -> list[bytes]:
        parts = [spaced_pretokens(k) for k in keys]
        known = self._known([p for ps in parts for p in ps])
        return [known[ps[0]] if len(ps) == 1 else b"".join([known[p] for p in ps]) for ps in parts]

    def ids(self, text: str) -> bytes:
        return self.ids_of([text])[0]

    def _ids_by_pattern(self, text: str) -> bytes:
        special = SPECIAL_ID.to_bytes(4, "little")
        parts = pretokens(text)
        known = self._known([p for p in parts if p is not None])
        return b"".join([special if p is None else known[p] for p in parts])

    def ids_of(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Chunks of all texts are told apart at once; each distinct one is looked up once."""
        plain = [splits_at_spaces(t) for t in texts]
        parted = [t.partition(" ") if simple else ("", "", "") for t, simple in zip(texts, plain)]
        lists = pc.split_pattern(pa.array([rest if space else None for _, space, rest in parted], pa.string()), " ")
        code, words = distinct_words(lists)
        known = self._spaced.look_up(words.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, known), np.int32, len(known)) >> 2
        start = np.cumsum(size, dtype=np.int32) - size
        sizes = size[code]
        tail = np.frombuffer(b"".join(known), np.uint32)[gather(start[code], sizes)].tobytes()
        words_to = np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
        ends = (4 * np.r_[0, np.cumsum(sizes, dtype=np.int64)][words_to]).tolist()
        heads = [PATTERN.findall(head) for head, _, _ in parted]
        first = self._known([p for ps in heads for p in ps])
        out, at = [], 0
        for t, simple, head, end in zip(texts, plain, heads, ends):
            out.append(b"".join([*[first[p] for p in head], tail[at:end]]) if simple else self._ids_by_pattern(t))
            at = end
        return out
