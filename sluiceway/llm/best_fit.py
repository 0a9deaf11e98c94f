"""Best-fit packing planned on the length histogram.

Documents get the id 2 at their end; only those longer than ``capacity`` are cut. Best fit
with falling lengths is run on counts: sequences with the same room form a range of
numbers, and all pieces of a length enter the fullest ranges that still take them. A step
touches a range once, whatever the number of pieces, so the plan depends on the histogram
alone. The pieces of a length then take their planned slots by rank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import cut
from .common import once_per_worker, per_slice, whole_text
from .packing import BROADCAST_BYTES, CAPACITY, SLOTS, WordCache

END = 2

PIECES = "doc_id long, piece int, start long, length int, ids binary, run int, local_rank long"


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Which pieces lie where: (length, first, beyond, per_copy, sequence, slot).

    Pieces of ``length`` ranked ``first`` to ``beyond`` lie ``per_copy`` to a sequence, from
    ``sequence`` on, side by side from offset ``slot``. Same places as best fit piece by piece,
    the longest first. Sequences are numbered from 0 without gaps.
    """
    out: list[tuple[int, int, int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = {}  # room: ranges (first sequence, sequences)
    rooms: list[int] = []
    opened = 0

    def give(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in free:
                free[room] = []
                rooms.append(room)
            free[room].append((first, n))

    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        left, ranked = histogram[length], 0

        def lay(room: int, first: int, n: int, each: int) -> None:
            """``each`` pieces in each of ``n`` sequences that have this room."""
            nonlocal left, ranked
            if n and each:
                out.append((length, ranked, ranked + n * each, each, first, capacity - room))
                ranked += n * each
                left -= n * each

        def enter(room: int, first: int, n: int) -> None:
            """Best fit fills a sequence with this length until it takes no more, then takes the next."""
            each = room // length
            whole = min(n, left // each)
            lay(room, first, whole, each)
            give(room - each * length, first, whole)
            if whole < n:
                rest = left
                lay(room, first + whole, min(rest, 1), rest)
                give(room - rest * length, first + whole, min(rest, 1))
                touched = whole + min(rest, 1)
                give(room, first + touched, n - touched)

        usable = sorted(r for r in rooms if r >= length)
        rooms = [r for r in rooms if r < length]
        for room in usable:
            ranges = free.pop(room)
            if not left:
                rooms.append(room)
                free[room] = ranges
                continue
            for first, n in ranges:
                if left:
                    enter(room, first, n)
                else:
                    give(room, first, n)
        if left:
            each = capacity // length
            n = -(-left // each)
            enter(capacity, opened, n)
            opened += n
    return out


def lengths(total: int, capacity: int = CAPACITY) -> list[int]:
    """The pieces of a document of ``total`` tokens: only the first may be shorter than ``capacity``."""
    return [*([total % capacity] if total % capacity else []), *[capacity] * (total // capacity)]


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise and cut: PIECES. ``local_rank`` counts the pieces of a length within a partition, named by ``run``."""
    end = np.uint32(END).tobytes()

    def run(batches):
        seen = [0] * (capacity + 1)
        partition = TaskContext.get().partitionId()
        cache = once_per_worker(f"words {path}", lambda: WordCache(path))

        def part(batch: pa.RecordBatch) -> pa.RecordBatch:
            cols: list[list] = [[] for _ in range(6)]
            for doc, ids in zip(batch.column(0).to_pylist(), cache.ids_of(batch.column(1).to_pylist())):
                ids += end
                start = 0
                for piece, length in enumerate(lengths(len(ids) // 4, capacity)):
                    for col, value in zip(cols, (doc, piece, start, length, ids[4 * start : 4 * (start + length)], seen[length])):
                        col.append(value)
                    seen[length] += 1
                    start += length
            doc, piece, start, length, ids, rank = cols
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64())
            rows = (doc, piece, start, length, ids, [partition] * len(doc), rank)
            return pa.record_batch([pa.array(c, t) for c, t in zip(rows, types)], names=["doc_id", "piece", "start", "length", "ids", "run", "local_rank"])

        yield from per_slice(part, "text")(batches)

    flat = docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text().alias("text"))
    return flat.mapInArrow(run, PIECES)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their places: (doc_id, piece, start, length, ids, sequence_id, offset).

    ``ids`` are little-endian unsigned 32-bit integers. A null text is empty: one piece that
    holds the end id alone. A null doc_id stays null; repeated rows are packed once each;
    other columns are not read; an empty table gives no rows. Which of several pieces of a
    length takes which of its slots follows their order in the table; the slots are equal.

    The pieces are written once to the shared folder, which fixes their ranks. Ranks over
    the whole table are the local rank plus the counts of earlier partitions, so no length,
    however common, is ranked in one task.
    """
    spark = docs.sparkSession
    pieces = cut(cut_pieces(docs, path, capacity))
    counts = cut(pieces.groupBy("run", "length").agg(F.count(F.lit(1)).alias("n")))
    # at most ``capacity`` numbers, and a plan of at most a few ranges for each of them
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = plan(histogram, capacity)
    earlier = W.partitionBy("length").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select("run", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    if counts.count() * 32 <= BROADCAST_BYTES:
        base = F.broadcast(base)
    s = spark.createDataFrame(slots, SLOTS).withColumnRenamed("length", "of")
    if len(slots) * 48 <= BROADCAST_BYTES:
        s = F.broadcast(s)
    ranked = pieces.join(base, ["run", "length"]).withColumn("rank", F.col("base") + F.col("local_rank"))
    placed = ranked.join(s, (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("beyond")))
    nth = F.col("rank") - F.col("first")
    return placed.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids",
        (F.col("sequence") + F.expr("(rank - first) div per_copy")).alias("sequence_id"),
        (F.col("slot") + (nth % F.col("per_copy")) * F.col("length")).alias("offset"),
    )
