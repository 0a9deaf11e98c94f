"""Token counts by merging ragged arrays in step.

Pre-tokens that a worker has not met are held together as one flat array of symbols with
the bounds of each sequence. In every step each sequence finds its lowest-ranked pair and
merges all places of it, all sequences at the same time, until no pair is left. What
survives is counted.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from .bpe import byte_letters
from .chunks import Recent
from .common import distinct_words, once_per_worker, per_slice, whole_text

LIMIT = 2048
SCHEMA = "doc_id long, n_bytes long, n_tokens long"
#: Splits normalised text. Fixed value.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
FREE = np.iinfo(np.int64).max


class StepMerger:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self._wide = len(vocab)
        self._inner, self._final = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for c, b in byte_letters().items():
            self._inner[b], self._final[b] = vocab[c], vocab[c + end]
        pairs = np.array([vocab[a] * self._wide + vocab[b] for a, b in spec["model"]["merges"]], np.int64)
        order = np.argsort(pairs, kind="stable")
        self._pairs, self._ranks = pairs[order], order
        # a merge's second half names the end of the word, so the joined string is the new symbol
        made = np.array([vocab[a + b] for a, b in spec["model"]["merges"]], np.int64)
        self._made = made  # by rank

    def count(self, pretokens: list[str]) -> np.ndarray:
        """Symbols that are left of each pre-token (none is empty)."""
        raw = [p.encode() for p in pretokens]
        sizes = np.array([len(r) for r in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self._inner[flat]
        ends = np.cumsum(sizes)
        symbols[ends - 1] = self._final[flat[ends - 1]]
        owner = np.repeat(np.arange(len(raw)), sizes)
        out = np.zeros(len(raw), np.int64)
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            keys = symbols[:-1] * self._wide + symbols[1:]
            at = np.minimum(np.searchsorted(self._pairs, keys), len(self._pairs) - 1)
            known = (self._pairs[at] == keys) & (owner[1:] == owner[:-1])
            rank = np.full(len(symbols), FREE)
            rank[:-1][known] = self._ranks[at[known]]
            lowest = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.r_[starts, len(symbols)])
            done = lowest == FREE
            out[owner[starts[done]]] = lengths[done]
            hit = (rank == np.repeat(lowest, lengths)) & (rank != FREE)
            # in a run of equal symbols the places overlap: every other one counts, from the left
            places = np.flatnonzero(hit)
            if len(places):
                run_start = np.r_[True, (np.diff(places) != 1)]
                first = np.maximum.accumulate(np.where(run_start, places, 0))
                places = places[(places - first) % 2 == 0]
            symbols[places] = self._made[rank[places]]
            keep = ~np.repeat(done, lengths)
            keep[places + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return out


def normalise(text: str) -> str:
    """NFC and lower case, letter by letter (a final sigma is not special)."""
    text = unicodedata.normalize("NFC", text)
    return text.lower() if text.isascii() else "".join(map(str.lower, text))


class Counter:
    """Tokens of whole texts. White space never reaches a token, so chunks between spaces add up."""

    def __init__(self, path: str):
        self._merger = StepMerger(path)
        self._special = regex.compile("|".join(map(regex.escape, self._merger.special)))
        self._pretokens = Recent(lambda keys: self._merger.count(keys).tolist() if keys else [])
        self._chunks = Recent(self._count)

    def _count(self, chunks: list[str]) -> list[int]:
        parts, extra = [], []
        for c in chunks:
            pieces = self._special.split(c) if "<|" in c else [c]
            extra.append(len(pieces) - 1)
            parts.append([p for piece in pieces for p in PATTERN.findall(normalise(piece))])
        own = list({p for ps in parts for p in ps})
        known = dict(zip(own, self._pretokens.look_up(own)))
        return [sum([known[p] for p in ps]) + more for ps, more in zip(parts, extra)]

    def counts(self, texts: pa.Array) -> np.ndarray:
        lists = pc.split_pattern(texts, " ")
        code, words = distinct_words(lists)
        known = np.array(self._chunks.look_up(words.to_pylist()), np.int64)
        sums = np.r_[0, np.cumsum(known[code])]
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        return np.diff(np.r_[0, sums[ends]])


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Size and tokens of each text: (doc_id, n_bytes, n_tokens, over_limit).

    A null text is empty (no tokens); a null doc_id stays null; repeated rows give repeated
    results; other columns are not read; an empty table gives no rows. Special strings inside
    a text count as one token each. One narrow pass with bounded caches.
    """

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = part.column(1)
        n_bytes = pc.binary_length(texts).cast(pa.int64())
        counts = once_per_worker(f"counts {path}", lambda: Counter(path)).counts(texts)
        return pa.record_batch([part.column(0), n_bytes, pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    flat = docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text().alias("text"))
    return flat.mapInArrow(per_slice(run, "text"), SCHEMA).withColumn("over_limit", F.col("n_tokens") > limit)
