"""Byte-level BPE by dynamic programming over prefixes, and its inverse.

For every prefix of a pre-token exactly one token can be the last one of its encoding.
It is the token among those that end there (found by an automaton over the vocabulary)
that is compatible with the last token of the prefix before it. Two tokens are compatible
when no merge ever reaches over the border between them. Following the stored tokens
backwards gives the exact ids in time linear in the text, however long a pre-token is.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import ChunkCache
from .common import once_per_worker, per_slice, whole_text

SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"
#: No merge has this rank.
NEVER = 1 << 40
#: Longer pre-tokens are solved prefix by prefix, without recursion.
DEEP = 200


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes, and these bytes.

    Printable bytes stand for themselves, the others for the letters from U+0100 on.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in shown}
    for i, b in enumerate(b for b in range(256) if b not in set(shown)):
        letters[chr(0x100 + i)] = b
    return letters


class PrefixBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.bytes_of: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        for t in spec["added_tokens"]:
            self.bytes_of[t["id"]] = t["content"].encode()
        special = {t["id"] for t in spec["added_tokens"]}
        self._merge: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int, int]] = {}  # token: its halves and its rank
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            left, right = vocab[a], vocab[b]
            self._merge[left, right] = rank
            parts.setdefault(vocab[a + b], (left, right, rank))
        self._right, self._left = {}, {}
        for t in vocab.values():
            self._right[t], self._left[t] = self._edge(parts, t, 1), self._edge(parts, t, 0)
        self._find = ahocorasick.Automaton()
        for t, b in self.bytes_of.items():
            if t not in special:
                self._find.add_word(b.decode("latin-1"), (t, len(b)))
        self._find.make_automaton()
        self.compatible = lru_cache(200_000)(self._compatible)

    @staticmethod
    def _edge(parts, token: int, side: int) -> list[tuple[int, int, int]]:
        """The token and what lies at its edge as its merges are undone: (token, own rank, rank of the merge that ends it)."""
        out, ends = [], NEVER
        while True:
            half = parts.get(token)
            rank = half[2] if half else -1
            out.append((token, rank, ends))
            if not half:
                return out
            token, ends = half[side], rank

    def _compatible(self, a: int, b: int) -> bool:
        """Does the border between ``a`` and ``b`` hold through all merges?

        Goes back in time over the pairs that face each other at the border. Of equal pairs
        the leftmost merges first, so a tie counts against the right side only.
        """
        right, left, i, j = self._right[a], self._left[b], 0, 0
        while True:
            (u, made_u, ends_u), (v, made_v, ends_v) = right[i], left[j]
            rank = self._merge.get((u, v), NEVER)
            if rank < ends_u and rank <= ends_v and rank < NEVER:
                return False
            if made_u < 0 and made_v < 0:
                return True
            # of equal merges the right one came later
            if made_u > made_v:
                i += 1
            else:
                j += 1

    def _last(self, ending: list[list[tuple[int, int]]], last: list, end: int) -> tuple[int, int]:
        """The last token of the prefix up to ``end`` and where it starts; prefixes are solved when they are asked for."""
        for t, start in ending[end]:
            if start == 0 or self.compatible((last[start] or self._last(ending, last, start))[0], t):
                last[end] = found = (t, start)
                return found
        raise ValueError("a byte is missing in the vocabulary")

    def encode_pretoken(self, text: str) -> list[int]:
        line = text.encode().decode("latin-1")
        n = len(line)
        ending: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]  # by end: the tokens there, longest first
        for end, (t, length) in self._find.iter(line):
            ending[end + 1].append((t, end + 1 - length))
        last: list[tuple[int, int] | None] = [None] * (n + 1)
        if n > DEEP:  # from the left, so that the call depth stays small
            for end in range(1, n + 1):
                self._last(ending, last, end)
        else:
            self._last(ending, last, n)
        out, at = [], n
        while at:
            t, at = last[at]
            out.append(t)
        return out[::-1]

    def encode_all(self, pretokens: list[str]) -> list[bytes]:
        return [array("I", self.encode_pretoken(p)).tobytes() for p in pretokens]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


def worker_bpe(path: str) -> tuple[PrefixBPE, ChunkCache]:
    bpe = PrefixBPE(path)
    return bpe, ChunkCache(bpe.encode_all)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode each text and decode the ids again: (doc_id, n_tokens, ids, decoded).

    ``ids`` are little-endian unsigned 32-bit integers. A null text is empty and has no ids;
    a null doc_id stays null; repeated rows give repeated results; other columns are not
    read. An empty table gives no rows. The work is one narrow pass with a bounded cache.
    """

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        bpe, cache = once_per_worker(f"bpe {path}", lambda: worker_bpe(path))
        ids = cache.ids_of(part.column(1).to_pylist())
        return pa.record_batch(
            [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.string())],
            names=["doc_id", "n_tokens", "ids", "decoded"],
        )

    flat = docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text().alias("text"))
    return flat.mapInArrow(per_slice(run, "text"), SCHEMA)
