"""Packing documents into sequences by cutting stock with column generation.

Every document gets the id 0 at its end and is cut into pieces of ``capacity`` tokens and a
rest, and the rest into a multiple of ``GRAIN`` and a short piece (see lengths). How many
pieces there are of each length is a histogram of about 100 numbers, whatever the number of
documents, so a plan for it is found in seconds. A linear program over patterns (multisets of
lengths that fit into one sequence) covers the histogram with the fewest sequences; its
columns are priced by a knapsack dynamic program. The rounded patterns take ranges of
ranks of each length, so a piece finds its sequence from its own rank, by arithmetic.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F
from tokenizers import Tokenizer

from ..session import cut
from .bpe import byte_letters
from .chunks import PATTERN, ChunkCache
from .common import gather, once_per_worker, per_slice, whole_text

CAPACITY = 1024
#: The program ends when no plan can need fewer sequences than this share below the present one.
GAP = 1e-4
#: Rests are cut at multiples of this, which leaves few lengths and many small pieces to fill gaps.
GRAIN = 32
#: Pre-tokens that take their steps together, bytes beyond which one is encoded alone, and the rank of a pair that no merge has.
STEP_ROWS, STEP_BYTES, NO_MERGE = 10_000, 48, np.iinfo(np.int32).max
#: Most chunks in one generation of a worker's cache.
KEPT_WORDS = 60_000
#: Slots of the table of pairs, by the leading bits of a hash.
PAIR_BITS = 18
#: Signs that make one pre-token when they follow each other (an apostrophe may begin one of its own).
SIGNS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
#: Largest lookup that is broadcast, in bytes; a larger one is joined by shuffle.
BROADCAST_BYTES = 32 << 20

PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary, run int, local_rank long"
SLOTS = "length long, first long, beyond long, per_copy long, sequence long, slot long"


# ---- the plan, from the histogram alone


def price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern worth most (unbounded knapsack): its worth and how many of each size it takes."""
    best = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if k := fits[room]:
            worth = best[room - sizes[:k]] + values[:k]
            i = int(worth.argmax())
            if worth[i] > best[room] + 1e-12:
                best[room], taken[room] = worth[i], i
    pattern, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if taken[room] < 0:
            room -= 1
        else:
            pattern[taken[room]] += 1
            room -= int(sizes[taken[room]])
    return float(best[capacity]), pattern


def generate_columns(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Fewest sequences as a linear program: the basis (one pattern in each column) and how often each is used."""
    m = len(sizes)
    basis = np.diag(capacity // sizes).astype(np.int64)
    inverse = np.diag(1.0 / (capacity // sizes))
    used = inverse @ demand
    for step in range(1, 20 * m + 100):
        duals = inverse.sum(axis=0)
        worth, pattern = price(np.maximum(duals, 0), sizes, capacity)
        # used.sum() / worth bounds every plan from below
        if worth <= 1 + gap:
            break
        way = inverse @ pattern
        rows = np.flatnonzero(way > 1e-9)
        out = rows[np.argmin(used[rows] / way[rows])]
        pivot = inverse[out] / way[out]
        inverse -= np.outer(way, pivot)
        inverse[out] = pivot
        basis[:, out] = pattern
        used = inverse @ demand if step % 50 == 0 else _step(used, way, out)
        if step % 200 == 0:
            inverse = np.linalg.inv(basis.astype(float))
            used = inverse @ demand
    return basis, np.maximum(used, 0)


def _step(used: np.ndarray, way: np.ndarray, out: int) -> np.ndarray:
    length = used[out] / way[out]
    used = used - length * way
    used[out] = length
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Which sequence takes which ranks: (length, first, beyond, per_copy, sequence, slot).

    The pieces of ``length`` ranked ``first`` to ``beyond`` lie ``per_copy`` to a sequence,
    from ``sequence`` on, side by side from offset ``slot``. Sequences are numbered from 0.
    """
    out: list[tuple[int, int, int, int, int, int]] = []
    taken = dict.fromkeys(histogram, 0)
    sequence = 0

    def lay(counts: list[tuple[int, int]], copies: int) -> None:
        nonlocal sequence
        slot = 0
        for length, n in counts:
            out.append((length, taken[length], taken[length] + n * copies, n, sequence, slot))
            taken[length] += n * copies
            slot += n * length
        sequence += copies

    if histogram.get(capacity):
        lay([(capacity, 1)], histogram[capacity])
    sizes = np.array(sorted(k for k, n in histogram.items() if n and k < capacity), np.int64)
    if not len(sizes):
        return out
    demand = np.array([histogram[int(k)] for k in sizes], np.int64)
    basis, used = generate_columns(sizes, demand.astype(float), capacity)
    copies = np.floor(used + 1e-6).astype(np.int64)
    left = demand.copy()
    for j in np.argsort(-copies):
        pattern = basis[:, j]
        held = pattern > 0
        n = min(int(copies[j]), int((left[held] // pattern[held]).min())) if held.any() else 0
        if n > 0:
            lay([(int(sizes[i]), int(pattern[i])) for i in np.flatnonzero(held)], n)
            left -= n * pattern
    # what rounding leaves is at most one pattern for each length: filled greedily, the longest first
    while left.any():
        room, counts = capacity, []
        for i in np.flatnonzero(left)[::-1]:
            if n := min(int(left[i]), room // int(sizes[i])):
                counts.append((int(sizes[i]), n))
                left[i] -= n
                room -= n * int(sizes[i])
        lay(counts, 1)
    return out


# ---- the documents


def lengths(total: int, capacity: int = CAPACITY, grain: int = GRAIN) -> list[int]:
    """The pieces of a document of ``total`` tokens: full ones, then a multiple of ``grain``, then 1 to 2 * grain - 1 tokens."""
    out, rest = [capacity] * (total // capacity), total % capacity
    short = rest % grain
    if short and rest >= 2 * grain:
        out.append(rest - short - grain)
        rest = short + grain
        if not out[-1]:
            out.pop()
    return [*out, rest] if rest else out


class StepEncoder:
    """Ids of many pre-tokens at once: in every step each one merges all places of its lowest-ranked pair.

    A pair that holds a new token was learned after that token, so the pairs a step makes never come before the
    one it merged. Only pairs next to a merge are looked up again, and a pre-token leaves when nothing merges.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self._byte = np.zeros(256, np.int32)
        for c, b in byte_letters().items():
            self._byte[b] = vocab[c]
        self._wide = max(vocab.values()) + 1
        pairs = np.array([vocab[a] * self._wide + vocab[b] for a, b in spec["model"]["merges"]], np.int64)
        self._made = np.array([vocab[a + b] for a, b in spec["model"]["merges"]], np.int32)  # by rank
        slot = self._slot(pairs)
        order = np.argsort(slot, kind="stable")
        self._pairs, self._ranks = pairs[order], order.astype(np.int32)
        self._first = np.searchsorted(slot[order], np.arange((1 << PAIR_BITS) + 1)).astype(np.int32)
        self._of_bytes = self._rank(np.repeat(self._byte, 256), np.tile(self._byte, 256))
        # long pre-tokens would take a step for nearly every byte
        self._model, self._letter = Tokenizer.from_file(path).model, {b: c for c, b in byte_letters().items()}

    @staticmethod
    def _slot(pairs: np.ndarray) -> np.ndarray:
        return (pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).view(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pairs = left.astype(np.int64) * self._wide + right
        slot = self._slot(pairs)
        at, end = self._first[slot], self._first[slot + 1]
        out = np.full(len(pairs), NO_MERGE, np.int32)
        open_ = np.flatnonzero(at < end)  # few slots hold more than one pair
        while len(open_):
            here = at[open_]
            hit = self._pairs[here] == pairs[open_]
            out[open_[hit]] = self._ranks[here[hit]]
            at[open_] += 1
            open_ = open_[~hit & (here + 1 < end[open_])]
        return out

    def _long(self, raw: bytes) -> np.ndarray:
        return np.array([t.id for t in self._model.tokenize(raw.decode("latin-1").translate(self._letter))], np.int32)

    def encode(self, pretokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens (none empty), one after the other, and how many each has."""
        column = pa.array(pretokens, pa.large_string())
        ends = np.frombuffer(column.buffers()[1], np.int64)[: len(pretokens) + 1]
        raw = np.frombuffer(column.buffers()[2], np.uint8)
        lots = []
        for i in range(0, len(pretokens), STEP_ROWS):
            part = ends[i : i + STEP_ROWS + 1]
            lots.append(self._encode(raw[part[0] : part[-1]], np.diff(part).astype(np.int32)))
        return np.concatenate([ids for ids, _ in lots]), np.concatenate([n for _, n in lots])

    def _encode(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        deep = np.flatnonzero(sizes > STEP_BYTES)
        who = np.flatnonzero(sizes <= STEP_BYTES)
        found = []
        if len(deep):
            ends = np.cumsum(sizes)
            for i in deep.tolist():
                own = self._long(flat[ends[i] - sizes[i] : ends[i]].tobytes())
                found.append((np.array([i]), own, np.array([len(own)], np.int32)))
            flat = flat[np.repeat(sizes <= STEP_BYTES, sizes)]
        lengths = sizes[who]
        symbols = self._byte[flat]
        last = np.zeros(len(flat), bool)
        last[np.cumsum(lengths) - 1] = True
        rank = np.full(len(flat), NO_MERGE, np.int32)
        rank[:-1] = self._of_bytes[flat[:-1].astype(np.int32) * 256 + flat[1:]]
        rank[last] = NO_MERGE
        while len(who):
            starts = np.cumsum(lengths) - lengths
            lowest = np.minimum.reduceat(rank, starts)
            done = lowest == NO_MERGE
            if done.any():
                gone = np.repeat(done, lengths)
                found.append((who[done], symbols[gone], lengths[done]))
                stay = ~gone
                symbols, rank, last = symbols[stay], rank[stay], last[stay]
                who, lengths, lowest = who[~done], lengths[~done], lowest[~done]
                if not len(who):
                    break
                starts = np.cumsum(lengths) - lengths
            places = np.flatnonzero(rank == np.repeat(lowest, lengths))
            # in a run of equal symbols the places overlap: every other one counts, from the left
            first = np.maximum.accumulate(np.where(np.diff(places, prepend=-2) != 1, places, 0))
            places = places[(places - first) % 2 == 0]
            symbols[places] = self._made[rank[places]]
            last[places] = last[places + 1]
            keep = np.ones(len(symbols), bool)
            keep[places + 1] = False
            lengths = np.add.reduceat(keep, starts, dtype=np.int32)
            symbols, rank, last = symbols[keep], rank[keep], last[keep]
            places -= np.arange(len(places))
            before = places[places > 0] - 1
            near = np.concatenate([places, before])
            near = near[~last[near]]
            rank[places] = NO_MERGE
            rank[near] = self._rank(symbols[near], symbols[near + 1])
        counts = np.zeros(len(sizes), np.int32)
        for own, _, n in found:
            counts[own] = n
        starts = np.cumsum(counts, dtype=np.int32) - counts
        out = np.zeros(int(counts.sum()), np.uint32)
        for own, ids, n in found:
            out[gather(starts[own], n)] = ids
        return out, counts


class WordCache(ChunkCache):
    """New chunks are encoded together, and only they are kept.

    Nearly all are a plain word, with or without a sign after it, so keeping their pre-tokens a second time costs more than it saves.
    """

    def __init__(self, path: str):
        self._steps = StepEncoder(path)
        super().__init__(lambda pretokens: self._encoded(pretokens, [1] * len(pretokens)), KEPT_WORDS)

    def _encoded(self, pretokens: list[str], parts: list[int]) -> list[bytes]:
        """The ids of lists of pre-tokens that lie one after the other and have so many ``parts`` each."""
        if not parts:
            return []
        ids, counts = self._steps.encode(pretokens)
        ends = (4 * np.cumsum(counts, dtype=np.int64)[np.cumsum(parts) - 1]).tolist()
        buffer = ids.tobytes()
        return [buffer[a:b] for a, b in zip([0, *ends], ends)]

    def _chunks(self, keys: list[str]) -> list[bytes]:
        pretokens, parts = [], []
        for k in keys:
            if k.isalpha():
                pretokens.append(" " + k)
                parts.append(1)
            elif (word := k.rstrip(SIGNS)).isalpha():
                pretokens += " " + word, k[len(word) :]
                parts.append(2)
            else:
                found = PATTERN.findall(" " + k)
                pretokens += found
                parts.append(len(found))
        return self._encoded(pretokens, parts)


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise and cut: PIECES. ``local_rank`` counts the pieces of a length within a partition, named by ``run``."""

    def run(batches):
        seen = np.zeros(capacity + 1, np.int64).tolist()
        partition = TaskContext.get().partitionId()
        cache = once_per_worker(f"words {path}", lambda: WordCache(path))

        def part(batch: pa.RecordBatch) -> pa.RecordBatch:
            cols: list[list] = [[] for _ in range(6)]
            for doc, ids in zip(batch.column(0).to_pylist(), cache.ids_of(batch.column(1).to_pylist())):
                ids += b"\0\0\0\0"
                total = len(ids) // 4
                start = 0
                for length in lengths(total, capacity):
                    for col, value in zip(cols, (doc, start, length, total, ids[4 * start : 4 * (start + length)], seen[length])):
                        col.append(value)
                    seen[length] += 1
                    start += length
            long = pa.int64()
            doc, start, length, total, ids, rank = cols
            return pa.record_batch(
                [pa.array(doc, long), pa.array(start, long), pa.array(length, long), pa.array(total, long), pa.array(ids, pa.binary()), pa.array([partition] * len(doc), pa.int32()), pa.array(rank, long)],
                names=["doc_id", "start", "length", "doc_tokens", "ids", "run", "local_rank"],
            )

        yield from per_slice(part, "text")(batches)

    flat = docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text().alias("text"))
    return flat.mapInArrow(run, PIECES)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their places: (doc_id, start, length, doc_tokens, ids, sequence_id, offset).

    ``ids`` are little-endian unsigned 32-bit integers. A null text is empty: one piece that
    holds the end id alone. A null doc_id stays null; repeated rows are packed once each;
    other columns are not read; an empty table gives no rows. A sequence shorter than
    ``capacity`` is to be padded by the reader.

    The pieces are written once to the shared folder, which fixes their ranks. Ranks over
    the whole table are the local rank plus the counts of earlier partitions, so no length,
    however common, is ranked in one task.
    """
    spark = docs.sparkSession
    pieces = cut(cut_pieces(docs, path, capacity))
    counts = cut(pieces.groupBy("run", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.createDataFrame(plan(histogram, capacity), SLOTS)  # at most a row for each length and pattern
    earlier = W.partitionBy("length").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select("run", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    if counts.count() * 32 <= BROADCAST_BYTES:
        base = F.broadcast(base)
    ranked = pieces.join(base, ["run", "length"]).withColumn("rank", F.col("base") + F.col("local_rank")).drop("base", "local_rank")
    s = F.broadcast(slots).alias("s")
    p = ranked.alias("p")
    placed = p.join(s, (F.col("p.length") == F.col("s.length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("beyond")))
    nth = F.col("rank") - F.col("first")
    return placed.select(
        "doc_id", "start", "p.length", "doc_tokens", "ids",
        (F.col("sequence") + F.expr("(rank - first) div per_copy")).alias("sequence_id"),
        (F.col("slot") + (nth % F.col("per_copy")) * F.col("p.length")).alias("offset"),
    )
