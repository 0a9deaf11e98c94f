"""Vector codes, best-fit packing and source divergence against brute force on awkward tables."""

import hashlib
import math
import random
import re
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sluiceway.llm import best_fit, divergence, vector_codes

BYTE = P.path("byte_bpe_50k.json")
VECTORS = "vec_id long, embedding array<float>, label int, code int, error string, v int, dims int, __label int"


# ---- vector codes


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label_error) of every kept row, and the codebooks."""
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    width = len(kept[0][1]) // parts if kept else 0
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v, p: min((far(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        held = [defaultdict(list) for _ in range(parts)]
        for _, v, _ in kept:
            for p in range(parts):
                held[p][nearest(v, p)[1]].append(cut(v, p))
        books = [[[sum(c) // len(held[p][k]) for c in zip(*held[p][k])] if k in held[p] else e for k, e in enumerate(books[p])] for p in range(parts)]
    out = [(i, label, [nearest(v, p) for p in range(parts)]) for i, v, label in kept]
    by = Counter()
    for _, label, found in out:
        by[label] += sum(d for d, _ in found)
    return sorted(((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), by[label]) for i, label, found in out), key=str), books


def codes_of(spark, rows, parts=8):
    df = spark.createDataFrame([(i, v, label, 1, "x", 1, 1, 1) for i, v, label in rows], VECTORS).repartition(3)
    out = vector_codes.compress(df, parts)
    got = vector_codes.label_errors(out.codes).select("vec_id", vector_codes.hex_code().alias("code"), "error", "label_error").collect()
    return sorted((tuple(r) for r in got), key=str), out.codebooks


def test_codes_equal_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 0.3) for _ in range(16)], rnd.choice([None, 1, 1, 1, 2])) for i in range(300)]
    rows += [(5, rows[5][1], 1), (5, rows[6][1], None), (None, rows[7][1], 3), (None, [0.0] * 16, 3)]
    rows += [(-1, None, 1), (-2, [0.1] * 15 + [None], 1), (-3, [float("nan")] * 16, 1), (-4, [float("inf")] + [0.0] * 15, None), (-5, [float("-inf")] * 16, None)]
    rows += [(1000 + i, rows[9][1], 9) for i in range(200)]  # one very common vector
    assert codes_of(spark, rows) == plain_codes(rows)


def test_codes_with_ties_and_unused_entries(spark):
    # two equal first vectors: the second entry is never the nearest and stays
    rows = [(i, [float(i // 2) * s for s in (1, -1, 1, -1)], None) for i in range(10)]
    got, books = codes_of(spark, rows, parts=2)
    assert (got, books) == plain_codes(rows, parts=2)
    assert all(len(b) == 10 for b in books) and books[0][1] == [0, 0]


def test_codes_of_few_or_no_vectors(spark):
    one = [(7, [0.25, -0.25], 1)]
    got, books = codes_of(spark, one, parts=2)
    assert got == [(7, "0000", 0, 0)] and books == [[[1024]], [[-1024]]]
    assert codes_of(spark, [(1, None, 1)]) == ([], [])
    assert codes_of(spark, []) == ([], [])
    assert codes_of(spark, [(1, [], 1), (2, [], None)])[0] == [(1, "00" * 8, 0, 0), (2, "00" * 8, 0, 0)]
    assert vector_codes.codebooks_sha256([]) == hashlib.sha256(b"").hexdigest()


def test_vectors_that_have_no_codes_are_refused(spark):
    for rows, why in (
        ([(1, [0.1] * 8, 1), (2, [0.1] * 16, 1)], "different lengths"),
        ([(1, [0.1] * 9, 1)], "equal parts"),
        ([(1, [1e30] * 8, 1)], "64 bits"),
    ):
        with pytest.raises(Exception, match=why):
            codes_of(spark, rows)


def test_floors_go_down_and_decoding_is_near():
    assert vector_codes.whole(np.array([[-0.00001, 0.00001, -1.0, 1 / 4096]])).tolist() == [[-1, 0, -4096, 1]]
    assert vector_codes.decode(bytes([1, 0]), [[[0], [4096]], [[-4096]]]) == [1 + 0.5 / 4096, -1 + 0.5 / 4096]


# ---- best-fit packing


def laid_out(slots):
    sequences = defaultdict(list)
    for length, first, beyond, each, sequence, slot in slots:
        for rank in range(first, beyond):
            sequences[sequence + (rank - first) // each].append((slot + (rank - first) % each * length, length, rank))
    return sequences


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(3, 90))
    lengths = rng.integers(1, capacity + 1, int(rng.integers(0, 400))).tolist()
    sequences = laid_out(best_fit.plan(dict(Counter(lengths)), capacity))
    count = 0
    rooms: list[int] = []
    for length in sorted(lengths, reverse=True):
        at = bisect_left(rooms, length)
        if at == len(rooms):
            count += 1
            room = capacity
        else:
            room = rooms.pop(at)
        if room > length:
            insort(rooms, room - length)
    assert sorted(sequences) == list(range(count))
    assert sorted((n, rank) for held in sequences.values() for _, n, rank in held) == sorted((n, rank) for n, many in Counter(lengths).items() for rank in range(many))
    for held in sequences.values():
        at = 0
        for offset, length, _ in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity


def test_plan_does_not_grow_with_the_pieces():
    rng = np.random.default_rng(1)
    histogram = {n: int(c) for n, c in enumerate(rng.integers(0, 50, 1025)) if n and c}
    small, large = best_fit.plan(histogram), best_fit.plan({n: c * 1_000_000 for n, c in histogram.items()})
    assert len(large) <= 2 * len(small) < 20_000


def test_best_fit_table(spark):
    texts = [None, "", " ", "a", "a", "word " * 300, "é 漢字 😀 " * 40, "<|endoftext|> x", "x" * 4000, *(f"{i} " * (i % 37) for i in range(120))]
    rows = [*enumerate(texts), (None, "no id"), (3, "a"), (3, "a")]
    df = spark.createDataFrame([(i, t, 1, 2, 3, b"x", 4) for i, t in rows], "doc_id long, text string, length int, rank int, run int, ids binary, sequence long").repartition(4)
    out = best_fit.pack(df, BYTE, 64).collect()
    library = Tokenizer.from_file(BYTE)
    want = Counter()
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 64 or 64
        starts = [0, *range(first, len(ids), 64)]
        want.update((i, k, s, ids[s : e].tobytes()) for k, (s, e) in enumerate(zip(starts, [*starts[1:], len(ids)])))
    assert Counter((r.doc_id, r.piece, r.start, bytes(r.ids)) for r in out) == want
    sequences = defaultdict(list)
    for r in out:
        assert r.length * 4 == len(r.ids)
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    plan = best_fit.plan(dict(Counter(r.length for r in out)), 64)
    assert len(sequences) == len(laid_out(plan))
    assert best_fit.pack(df.limit(0), BYTE).collect() == []


# ---- source divergence


def plain_audit(rows, min_docs=3, top=200):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found, docs, used = defaultdict(set), Counter(), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower)))
        found[lang].add(source)
        docs.update((lang, t) for t in terms)
        used[lang, source].update(terms)
    out = []
    for lang, sources in found.items():
        kept = [t for (of, t), n in docs.items() if of == lang and n >= min_docs]

        def parts(counts):
            total = sum(counts[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // total for t in kept}

        whole = parts(sum((used[lang, s] for s in sources), Counter()))
        p = {s: parts(used[lang, s]) for s in sources}
        f = lambda x, q: (x - q) ** 2 // q
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], whole[t])) for t in kept if used[lang, s][t] and p[s][t] > whole[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, t, v, k) for k, (t, v) in enumerate(ranked, 1) if part == "pair" or k <= top]
    return sorted(out)


def audit_rows(spark, rows, **how):
    df = spark.createDataFrame([(t, a, b, 1, "x", 2, 3, 4) for t, a, b in rows], "text string, lang string, source string, n long, term string, p int, tile int, rank int")
    return sorted(tuple(r) for r in divergence.audit(df.repartition(3), **how).collect())


ODD_TEXTS = [None, "", " 123 ", "Don't STOP don't", "É é ÉCOLE école İ ſ", "a\x00b\x7fc`d[e", "漢字 😀😀 ñ", "the the the The", "x" * 3000 + " the " * 500, "a  a\ta\n\n"]


def test_audit_equals_brute_force(spark):
    rnd = random.Random(11)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["é", "ß", "漢"]
    rows = [(" ".join(rnd.choices(words, weights=[1000 // (i + 1) + 1 for i in range(len(words))], k=rnd.randint(0, 60))), rnd.choice(["en", "en", "fr", None, ""]), rnd.choice(["hot"] * 5 + ["a", "b", "c", None, "d "])) for _ in range(400)]
    rows += [(t, lang, s) for t in ODD_TEXTS for lang, s in (("en", "a"), ("xx", "odd"), (None, None))]
    rows += [rows[0]] * 5 + [("onlyhere", "lone", "s"), (None, "lone", "t")]
    want = plain_audit(rows)
    assert audit_rows(spark, rows) == want
    assert audit_rows(spark, rows, chunk=64, tile=2) == want
    assert audit_rows(spark, rows, top=3) == plain_audit(rows, top=3)


def test_audit_of_many_sources(spark):
    rnd = random.Random(12)
    rows = [(" ".join(rnd.choices(["aa", "bb", "cc", "dd", "ee", "ff"], k=8)), "en", f"s{rnd.randint(0, 89)}") for _ in range(500)]
    assert audit_rows(spark, rows, tile=16) == plain_audit(rows)


def test_audit_without_terms(spark):
    rows = [("", "en", "a"), (None, "en", "b"), ("1 2", "en", None), ("rare", "fr", "z")]
    assert audit_rows(spark, rows) == plain_audit(rows)
    assert audit_rows(spark, []) == []


def test_probability_beyond_64_bits(spark):
    big = 3 * 10**12
    row = spark.range(1).select(F.lit(big).alias("n"), F.lit(2 * big).alias("total")).select(divergence.probability("n", "total").alias("p")).first()
    assert row["p"] == 1 + 10**9 * (big + 1) // (2 * big)
