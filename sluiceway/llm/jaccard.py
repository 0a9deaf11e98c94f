"""Join of documents on the Jaccard similarity of their word n-grams.

The incidence matrix of documents and n-grams is multiplied with its transpose block by
block, and pairs that cannot reach the threshold are discarded by bounds from their sizes:

1. A count sketch of fixed size tells frequent n-grams from rare ones. All sets are ordered
   by (frequency class, hash), and two sets that reach the threshold must share one of their
   first n - ceil(t n) + 1 n-grams. Equal sets count as one row of the matrix.
2. These leading n-grams are dealt out to blocks by their hash. A block keeps the n-grams
   that at least two different sets have. An n-gram that several sets of one task share
   sends one row to its block, so a passage that everybody has does not fill a block.
3. Each row of what is left is first compared with the row it shares most columns with as
   the first of a column; that joins most near copies at once.
4. Only between different components the product is formed. Each set carries a parity map of
   fixed size; where two maps differ, one of the sets has an n-gram that the other lacks, so
   sizes and maps bound the intersection, and pairs beyond the bound make no row. Overlap
   counts of the others are accumulated, and a pair goes on only if count and sizes can
   still reach the threshold. Survivors are decided on their whole sets.

Nothing is capped: a pair that is not formed is joined already or provably too far apart.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut
from .common import batch_rows, once_per_worker, slices, whole_text
from .components import components

WORDS = 5
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Counters of the sketch, by the leading bits of a hash, and rows that carry them.
SKETCH_BITS = 20
SKETCH_ROWS = 16
#: Partitions whose counts one task adds up.
FAN_IN = 64
#: Ids that may be broadcast (8 bytes each); more are joined by shuffle.
BROADCAST_IDS = 2_000_000
#: Blocks of the product for each partition of the input.
BLOCKS = 4
PACK_ROWS = 50_000
#: Bytes of text and rows handled at once in a worker.
SLICE, TEXT_ROWS = 2 << 20, 1000
#: Pairs with their sets handed to Python at once.
PAIR_ROWS = 500
#: 64-bit words of the parity map of a set.
MAP_WORDS = 16
MAPS = [f"map{k}" for k in range(MAP_WORDS)]

_RNG = np.random.default_rng(20)
_FACTORS = _RNG.integers(1, 1 << 62, WORDS).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The n-grams of each text as sorted 64-bit hashes; empty without words.

    Only A-Z are lowered and only ASCII white space separates words, which is what
    bytes.lower() and bytes.split() do. A text of fewer words is one n-gram of its own kind.
    """
    once_per_worker("n-grams", lambda: None)  # lets go of what the operator before kept
    words = [t.lower().split() for t in texts]
    # hashing a word again costs less than looking up what it gave before
    flat = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, chain.from_iterable(words))), ">u8").astype(np.uint64)
    sums = np.zeros(max(0, len(flat) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        sums += flat[k : k + len(sums)] * _FACTORS[k]
    sums = _mix(sums)
    out, at = [], 0
    for ws in words:
        n = len(ws)
        if n >= WORDS:
            own = np.sort(sums[at : at + n - WORDS + 1])
            out.append(own[np.r_[True, own[1:] != own[:-1]]])
        elif n:
            short = (flat[at : at + n] * _FACTORS[:n]).sum(dtype=np.uint64) + np.uint64(n)
            out.append(_mix(_mix(np.array([short], np.uint64))))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def parity_map(h: np.ndarray) -> np.ndarray:
    """For each residue of the hashes whether an odd number of them has it, as MAP_WORDS 64-bit words."""
    odd = np.bincount((h % np.uint64(64 * MAP_WORDS)).astype(np.int64), minlength=64 * MAP_WORDS).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text().cast("binary").alias("text"))


# ---- 1. how frequent n-grams are


def sketch(docs: DataFrame, partitions: int) -> bytes:
    """Frequency class of each counter: about twice the binary logarithm of its count, one byte each."""
    width = (1 << SKETCH_BITS) // SKETCH_ROWS

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                sets = shingle_sets(part.column(1).to_pylist())
                if sets:
                    total += np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
        if total.any():
            rows = total.reshape(SKETCH_ROWS, width)
            yield pa.record_batch([pa.array(range(SKETCH_ROWS), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["part", "counts"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
                sums[part] = sums.get(part, 0) + np.frombuffer(counts, np.int64)
        if sums:
            yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["part", "counts"])

    schema = "part int, counts binary"
    rows = texts_of(docs).mapInArrow(count, schema)
    lots = -(-partitions // FAN_IN)
    while lots > 1:  # no task adds up the counts of more than FAN_IN others
        rows = rows.repartitionById(SKETCH_ROWS * lots, F.col("part") * lots + F.spark_partition_id() % lots).mapInArrow(add, schema)
        lots = lots // FAN_IN
    rows = rows.repartitionById(SKETCH_ROWS, F.col("part")).mapInArrow(add, schema)
    classes = np.zeros((SKETCH_ROWS, width), np.uint8)
    with batch_rows(docs.sparkSession, TEXT_ROWS):
        found = rows.collect()  # SKETCH_ROWS rows, of a size that does not depend on the data
    for r in found:
        classes[r["part"]] = (2 * np.log2(1 + np.frombuffer(r["counts"], np.int64))).astype(np.uint8)
    return classes.tobytes()


# ---- 2. leading n-grams and their blocks


def needed(n):
    """The least intersection of a set of size n with any set it links to."""
    return -(-PERCENT * n // 100)


LEADING = "kind int, block int, doc_id long, n int, s long, g binary, ss binary, ns binary, places binary, shared binary, maps binary"

LEADING_NAMES = [c.split()[0] for c in LEADING.split(", ")]


def _packed(kind: int, block: list[int], g, s, n, place, shared) -> pa.RecordBatch:
    m = len(block)
    none = pa.nulls(m, pa.int64())
    lists = [pa.array([x.tobytes() for x in col], pa.binary()) for col in (g, s, n, place, shared)]
    return pa.record_batch([pa.array([kind] * m, pa.int32()), pa.array(block, pa.int32()), none, pa.nulls(m, pa.int32()), none, *lists, pa.nulls(m, pa.binary())], names=LEADING_NAMES)


def leading(docs: DataFrame, classes: bytes, blocks: int) -> DataFrame:
    """LEADING rows. Kind 0: a document with the size and identity of its set. Kind 1: leading n-grams of a
    block, one row of each n-gram. Kind 2: n-grams that several sets of this task share, all their rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = np.frombuffer(classes, np.uint8)
        gs, ss, ns, ps = [], [], [], []
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids = part.column(0)
                sets = shingle_sets(part.column(1).to_pylist())
                own = np.array([xxhash.xxh3_64_intdigest(h.tobytes()) for h in sets], np.uint64).view(np.int64)
                sizes = np.array([len(h) for h in sets], np.int32)
                m = len(sets)
                empty = pa.nulls(m, pa.binary())
                spread = (own.view(np.uint64) % np.uint64(blocks)).astype(np.int32)
                maps = pa.array([parity_map(h).tobytes() for h in sets], pa.binary())
                yield pa.record_batch([pa.array(np.zeros(m, np.int32)), pa.array(spread), ids, pa.array(sizes), pa.array(own), *[empty] * 5, maps], names=LEADING_NAMES)
                for h, s, n in zip(sets, own.tolist(), sizes.tolist()):
                    if n and (s, n) not in seen:
                        seen.add((s, n))
                        rare_first = np.argsort(frequent[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
                        lead = n - needed(n) + 1
                        gs.append(h[rare_first[:lead]])
                        ss.append(np.full(lead, s, np.int64))
                        ns.append(np.full(lead, n, np.int32))
                        ps.append(np.arange(lead, dtype=np.int32))
        if not gs:
            return
        g, s, n, place = np.concatenate(gs), np.concatenate(ss), np.concatenate(ns), np.concatenate(ps)
        del gs, ss, ns, ps
        order = np.argsort(g, kind="stable")
        g, s, n, place = g[order], s[order], n[order], place[order]
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        count = np.diff(np.r_[first, len(g)])
        many = np.repeat(count > 1, count)  # the sets of a task are different ones
        partition = TaskContext.get().partitionId()
        for i, at in enumerate(range(0, int(many.sum()), PACK_ROWS)):
            rows = np.flatnonzero(many)[at : at + PACK_ROWS]
            yield _packed(2, [(partition + i) % blocks], [g[rows]], [s[rows]], [n[rows]], [place[rows]], [np.ones(len(rows), np.uint8)])
        g, s, n, place, shared = g[first], s[first], n[first], place[first], (count > 1).astype(np.uint8)
        block = ((g & np.uint64(0xFFFFFFFF)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(block, kind="stable")
        bounds = np.searchsorted(block[order], np.arange(blocks + 1))
        full = [b for b in range(blocks) if bounds[b] < bounds[b + 1]]
        for lot in range(0, len(full), 64):
            some = full[lot : lot + 64]
            cut_ = [order[bounds[b] : bounds[b + 1]] for b in some]
            yield _packed(1, some, [g[c] for c in cut_], [s[c] for c in cut_], [n[c] for c in cut_], [place[c] for c in cut_], [shared[c] for c in cut_])

    return texts_of(docs).mapInArrow(run, LEADING)


SHARED = "kind int, doc_id long, n int, s long, g long, place int, map binary"


def _shared(kind: int, doc, n, s, g, place, maps=None) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(n), kind, np.int32)), doc, pa.array(n, pa.int32()), pa.array(s, pa.int64()), g, place]
    return pa.record_batch([*columns, pa.nulls(len(n), pa.binary()) if maps is None else maps], names=["kind", "doc_id", "n", "s", "g", "place", "map"])


def map_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parity maps, in the last column, as 64-bit columns."""
    for batch in batches:
        words = np.frombuffer(b"".join(batch.columns[-1].to_pylist()), np.int64).reshape(-1, MAP_WORDS)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(np.ascontiguousarray(w)) for w in words.T]], names=[*batch.schema.names[:-1], *MAPS])


def keep_shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In a block: documents as they are (kind 0), and rows of n-grams that different sets have (kind 1)."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        docs = np.flatnonzero(kinds == 0)
        if len(docs):
            d = batch.take(pa.array(docs))
            yield _shared(0, d.column("doc_id"), d.column("n").to_numpy(), d.column("s").to_numpy(), pa.nulls(len(docs), pa.int64()), pa.nulls(len(docs), pa.int32()), d.column("maps"))
        for i in np.flatnonzero(kinds > 0).tolist():
            packed = (("g", np.int64), ("ss", np.int64), ("ns", np.int32), ("places", np.int32), ("shared", np.uint8))
            g, s, n, place, shared = (np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in packed)
            if kinds[i] == 2:
                yield _shared(1, pa.nulls(len(g), pa.int64()), n, s, pa.array(g), pa.array(place))
            else:
                held.append((g, s, n, place, shared))
    if held:
        g, s, n, place, shared = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((s, g))
        g, s, n, place, shared = g[order], s[order], n[order], place[order], shared[order]
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        size = np.diff(np.r_[first, len(g)])
        differ = np.add.reduceat(np.r_[False, (s[1:] != s[:-1]) & (g[1:] == g[:-1])].astype(np.int64), first) > 0
        flagged = np.maximum.reduceat(shared, first) > 0  # its task has sent all rows of a flagged one
        rows = np.flatnonzero(np.repeat(differ | flagged, size) & (shared == 0))
        yield _shared(1, pa.nulls(len(rows), pa.int64()), n[rows], s[rows], pa.array(g[rows]), pa.array(place[rows]))


# ---- 3. and 4. pairs


def decide(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets. ``nodes`` names one document of each set."""
    spark = docs.sparkSession
    pairs = cut(pairs)
    wanted = pairs.select(F.col("a").alias("s")).union(pairs.select("b")).distinct().join(nodes, "s").select("doc_id", "s")
    wanted = cut(wanted)
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                yield pa.record_batch([part.column(1), pa.array([h.tobytes() for h in shingle_sets(part.column(0).to_pylist())], pa.binary())], names=["s", "h"])

    # a repeated document gives a set twice, hence the distinct
    with batch_rows(spark, TEXT_ROWS):
        sets = cut(texts_of(docs).join(wanted, "doc_id").select("text", "s").mapInArrow(build, "s long, h binary").dropDuplicates(["s"]))

    def overlaps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                if 100 * both >= PERCENT * (len(x) + len(y) - both):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    left = sets.select(F.col("s").alias("a"), F.col("h").alias("ha"))
    right = sets.select(F.col("s").alias("b"), F.col("h").alias("hb"))
    with batch_rows(spark, PAIR_ROWS):  # rows hold two whole sets
        return cut(pairs.join(left, "a").join(right, "b").select("a", "b", "ha", "hb").mapInArrow(overlaps, "a long, b long"))


def reachable(small, large, count):
    """Can a pair of these sizes with this many shared leading n-grams still link? (SQL text)

    The set whose leading part ends first shares nothing of it beyond ``count``, and
    ceil(t n) - 1 of its n-grams are not leading; the intersection must be ceil(t / (1 + t) (n + m)).
    """
    p, q = PERCENT, 100 + PERCENT
    rest = f"greatest(({p} * {small} + 99) div 100, ({p} * {large} + 99) div 100) - 1"
    return f"100 * {small} >= {p} * {large} and {count} + {rest} >= ({p} * ({small} + {large}) + {q - 1}) div {q}"


def within(x: str, y: str) -> str:
    """Can two sets, rows ``x`` and ``y`` with size and map, link by sizes and maps alone? (SQL text)

    Each place where the maps differ stands for at least one n-gram that only one of the sets has,
    so the union has at least (n + m + differences) / 2 n-grams and the intersection at most (n + m - differences) / 2.
    """
    p, q = PERCENT, 100 + PERCENT
    apart = " + ".join(f"bit_count({x}.{m} ^ {y}.{m})" for m in MAPS)
    sizes = f"100 * least({x}.n, {y}.n) >= {p} * greatest({x}.n, {y}.n)"
    return f"{sizes} and {q} * ({x}.n + {y}.n - ({apart})) >= {2 * p} * ({x}.n + {y}.n)"


def early(n: str, place: str) -> str:
    """Can an n-gram at this place be the first that a set shares with one of its size or larger? (SQL text)

    The intersection of the two has at least ceil(2 t / (1 + t) n) n-grams, none of them before it.
    A pair that links has such a row for its smaller set, so a set none of whose n-grams is that for any set links to nothing more.
    """
    p, q = PERCENT, 100 + PERCENT
    return f"{n} - {place} >= ({2 * p} * {n} + {q - 1}) div {q}"


def linked_groups(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: (doc_id, n_shingles, component_id).

    Documents link when 100 * intersection >= 80 * union of their 5-word n-gram sets;
    component_id is the smallest doc_id reachable. Null, empty or white texts have no set and
    stand alone. Equal sets link. A set that only rows without id have takes part in no link
    to others, and its component_id is null. Repeated rows give repeated results; other columns
    are not read; an empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    partitions = max(1, texts_of(docs).rdd.getNumPartitions())
    blocks = BLOCKS * partitions
    classes = sketch(docs, partitions)
    with batch_rows(spark, TEXT_ROWS):
        found = cut(leading(docs, classes, blocks).repartitionById(blocks, F.col("block")).mapInArrow(keep_shared, SHARED))
    members = found.where("kind = 0").select("doc_id", "n", "s")
    # equal sets have equal maps
    nodes = found.where("kind = 0 and n > 0 and doc_id is not null").groupBy("s", "n").agg(F.min("doc_id").alias("doc_id"), F.first("map").alias("map"))
    nodes = cut(nodes.mapInArrow(map_words, ", ".join(["s long, n int, doc_id long", *[f"{m} long" for m in MAPS]])))
    maps = nodes.drop("doc_id")
    rows = cut(found.where("kind = 1").select("g", "s", "n", "place").distinct().join(nodes.select("s", "n"), ["s", "n"], "left_semi"))

    # each set with the one it shares most columns with as the first of a column
    firsts = rows.groupBy("g").agg(F.min("s").alias("b"))
    stars = rows.join(firsts, "g").where("s <> b").groupBy("s", "b").agg(F.count(F.lit(1)).alias("c"))
    stars = stars.groupBy("s").agg(F.max(F.struct("c", "b")).alias("m")).select("s", F.col("m.b").alias("b"))
    near = stars.join(maps, "s").alias("x").join(maps.withColumnRenamed("s", "b").alias("y"), "b").where(within("x", "y"))
    links = decide(docs, nodes, near.select(F.col("s").alias("a"), "b"))

    # the product between different components
    root = cut(components(links))
    placed = rows.join(root.withColumnRenamed("node", "s"), "s", "left").withColumn("root", F.coalesce("root", "s"))
    mixed = placed.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max(F.expr(early("n", "place"))).alias("early")).where("lo <> hi").select("g", "early")
    placed = placed.join(mixed, "g")
    able = placed.where("early").select("s").distinct()  # with all their rows, so that counts stay whole
    placed = cut(placed.drop("early", "place").join(able, "s", "left_semi").join(maps, ["s", "n"]))
    x, y = placed.alias("x"), placed.alias("y")
    meet = (F.col("x.g") == F.col("y.g")) & (F.col("x.s") < F.col("y.s")) & (F.col("x.root") != F.col("y.root"))
    product = (
        x.join(y, meet & F.expr(within("x", "y")))
        .groupBy(F.col("x.s").alias("a"), F.col("y.s").alias("b"), F.least("x.n", "y.n").alias("small"), F.greatest("x.n", "y.n").alias("large"))
        .agg(F.count(F.lit(1)).alias("c"))
        .where(reachable("small", "large", "c"))
    )
    links = links.union(decide(docs, nodes, product.select("a", "b")))
    root = components(links)
    named = nodes.join(root.withColumnRenamed("node", "s"), "s", "left").withColumn("root", F.coalesce("root", "s"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "root").select("s", "n", "component_id")
    return members.join(named, ["s", "n"], "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of linked documents, the one with the smallest id; all columns.

    Of a row repeated with its id and text, one stays. Rows without id cannot be named as
    copies and stay.
    """
    groups = linked_groups(docs)
    kept = cut(groups.where("doc_id = component_id").select(F.col("doc_id").alias("__id")).distinct())
    named = docs.join(kept, docs["doc_id"] == kept["__id"], "left_semi").withColumn("__text", F.md5(whole_text()))
    return named.dropDuplicates(["doc_id", "__text"]).drop("__text").unionByName(docs.where("doc_id is null"))
