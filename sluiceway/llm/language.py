"""Language of texts that may mix languages.

The script of a word's letters leaves the languages that use this script. Each word gets a
score for each of them from its letter n-grams. A Viterbi pass over the words, in which
every change of language costs a penalty, cuts a text into spans of one language each. The
language with the most letters is that of the text.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .chunks import Recent
from .common import fold, labelled_sample, once_per_worker, per_slice

#: The training sample: texts of each language and characters of each text.
SAMPLE_TEXTS = 400
SAMPLE_CHARS = 6000
#: n-grams of up to this many bytes, hashed to this many buckets.
ORDERS = 4
BUCKETS = 1 << 16
#: What a change of language costs, in nats, and the most one word may say for or against a language.
PENALTY = 14.0
CLIP = 6.0
#: A language uses a script if this share of its letters is written in it.
SCRIPT_SHARE = 0.02
SLICE = 2 << 20
#: Most entries in one generation of a worker's cache of words and their scores.
KEPT_WORDS = 60_000
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")

#: First code points of runs of letters and the script of each run. Fixed values.
SCRIPTS = [
    (0x0000, "Latin"), (0x0250, "Other"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Other"), (0x0900, "Devanagari"), (0x0980, "Indic"), (0x0E00, "Thai"), (0x0E80, "Other"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"),
    (0x3040, "Kana"), (0x3100, "Han"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"), (0x20000, "Han"),
]
_FROM = [f for f, _ in SCRIPTS]
NAMES = sorted({s for _, s in SCRIPTS})


def script(letter: str) -> str:
    return SCRIPTS[bisect_right(_FROM, ord(letter)) - 1][1]


def letters_of(chunk: str) -> str:
    """The letters of a chunk in lower case; digits of any kind, signs and marks are none."""
    word = "".join(LETTERS.findall(chunk)).lower()
    return word if word.isalpha() or not word else "".join(filter(str.isalpha, word))


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the words with their ends marked: bucket and index of the word."""
    raw = [b"^" + w.encode() + b"$" for w in words]
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    out, who, code = [], [], np.zeros(len(flat), np.uint64)
    for n in range(1, ORDERS + 1):
        code = code[: len(flat) - n + 1] * np.uint64(257) + flat[n - 1 :] + np.uint64(n)
        inside = owner[: len(code)] == owner[n - 1 :]
        mixed = (code + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        out.append((mixed >> np.uint64(48))[inside].astype(np.int64) % BUCKETS)
        who.append(owner[: len(code)][inside])
    return np.concatenate(out), np.concatenate(who)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # bucket x language, log-probabilities
    scripts: dict[str, list[bool]]  # script: which languages use it

    def scores(self, words: list[str]) -> np.ndarray:
        """Word x language. Words are letters only; one without letters says nothing."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        some = [i for i, w in enumerate(words) if w]
        if not some:
            return out
        bucket, who = gram_buckets([words[i] for i in some])
        sums = np.zeros((len(some), len(self.languages)))
        for k in range(len(self.languages)):
            sums[:, k] = np.bincount(who, self.weights[bucket, k], len(some))
        sums /= ORDERS  # n-grams of all orders say the same thing again
        sums = np.maximum(sums - sums.max(axis=1, keepdims=True), -CLIP)
        uses = np.array([self.scripts[script(words[i][0])] for i in some])
        narrowed = uses.any(axis=1)
        sums[narrowed] = np.where(uses[narrowed], sums[narrowed], -4 * CLIP)
        out[some] = sums
        return out


def train(sample: list[tuple[str, object]]) -> Model:
    """Counts of the n-grams of each language, smoothed. Without any sample there is no language."""
    languages = sorted({str(lang) for _, lang in sample})
    weights = np.zeros((BUCKETS, len(languages)), np.float32)
    uses = {s: [False] * len(languages) for s in NAMES}
    for k, lang in enumerate(languages):
        words = [w for text, own in sample if str(own) == lang for c in text.split() if (w := letters_of(c))]
        counts = np.bincount(gram_buckets(words)[0], minlength=BUCKETS) if words else np.zeros(BUCKETS)
        weights[:, k] = np.log((counts + 0.5) / (counts.sum() + 0.5 * BUCKETS))
        seen = {s: 0 for s in NAMES}
        for w in words:
            seen[script(w[0])] += len(w)
        for s in NAMES:
            uses[s][k] = seen[s] > SCRIPT_SHARE * max(1, sum(seen.values()))
    return Model(languages, weights, uses)


def best_paths(scores: np.ndarray, lengths: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best language of each word. Texts lie one after the other in ``scores``; all take each step together."""
    order = np.argsort(-lengths, kind="stable")
    sizes, starts = lengths[order], (np.cumsum(lengths) - lengths)[order]
    steps = int(sizes[0]) if len(sizes) else 0
    running = np.searchsorted(-sizes, -np.arange(1, steps + 1), side="right")  # texts that reach step t
    stays = np.zeros(scores.shape, bool)
    best_before = np.zeros(len(scores), np.int8)
    state = np.zeros((len(lengths), scores.shape[1]), np.float32)
    for t in range(steps):
        n = running[t]
        at, now = starts[:n] + t, state[:n]
        if t:
            top = now.argmax(axis=1)
            other = now[np.arange(n), top] - penalty
            best_before[at] = top
            stays[at] = now >= other[:, None]
            now = np.maximum(now, other[:, None])
            now -= now.max(axis=1, keepdims=True)  # only differences count
        state[:n] = now + scores[at]
    path = np.zeros(len(scores), np.int8)
    lang = state.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        n = running[t]
        at = starts[:n] + t
        path[at] = lang[:n]
        if t:
            lang[:n] = np.where(stays[at, lang[:n]], lang[:n], best_before[at])
    return path


class Labeller:
    def __init__(self, model: Model):
        self.model = model
        width = len(model.languages)

        def look(chunks: list[str]) -> list[bytes]:
            words = [letters_of(c) for c in chunks]
            rows = np.zeros((len(words), width + 1), np.float32)
            rows[:, :width] = model.scores(words)
            rows[:, width] = [len(w) for w in words]
            return [r.tobytes() for r in rows]

        self._chunks = Recent(look, KEPT_WORDS)

    def label(self, texts: list[str], with_spans: bool = True) -> list[tuple[str, float, list[tuple[str, int, int, int]]]]:
        """Per text: language, its share of the letters, and, if asked for, spans (language, first word, words, letters)."""
        names, width = self.model.languages, len(self.model.languages)
        chunks = [t.split() for t in texts]
        lengths = np.array([len(c) for c in chunks], np.int64)
        if not width or not lengths.sum():
            return [(UNKNOWN, 0.0, [])] * len(texts)
        rows = np.frombuffer(b"".join(self._chunks.look_up([c for cs in chunks for c in cs])), np.float32).reshape(-1, width + 1)
        letters = rows[:, width]
        path = best_paths(rows[:, :width], lengths)
        text_of = np.repeat(np.arange(len(texts)), lengths)
        totals = np.bincount(text_of * width + path, letters, len(texts) * width).reshape(-1, width)
        cuts = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (text_of[1:] != text_of[:-1])]) if with_spans else np.zeros(0, np.int64)
        held, sizes = np.add.reduceat(letters, cuts) if with_spans else cuts, np.diff(np.r_[cuts, len(path)])
        starts = np.cumsum(lengths) - lengths
        spans: list[list] = [[] for _ in texts]
        for c, n, h in zip(cuts.tolist(), sizes.tolist(), held.tolist()):
            i = int(text_of[c])
            spans[i].append((names[path[c]], c - int(starts[i]), n, int(h)))
        out = []
        for i, own in enumerate(totals):
            whole = own.sum()
            top = int(own.argmax())
            out.append((names[top], float(own[top] / whole), spans[i]) if whole else (UNKNOWN, 0.0, []))
        return out


SPANS = "array<struct<lang string, first_word int, words int, letters int>>"
_SPAN_TYPE = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("words", pa.int32()), ("letters", pa.int32())]))


def learn(documents: DataFrame, per_language: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS) -> Model:
    """Learn from the text and language of a bounded sample outside the held-out fold."""
    return train(labelled_sample(documents.select("doc_id", "lang"), documents, "lang", per_language, chars))


def identify(docs: DataFrame, model: Model, with_spans: bool = True) -> DataFrame:
    """All columns of ``docs`` with ``__lang_pred``, ``__score`` and, if asked for, ``__spans`` added.

    Null or empty texts and texts without a letter are ``und`` with score 0 and no span, as is
    every text when no language was learned. Ties go to the first language in order of name.
    Repeated rows give repeated results; an empty table gives no rows. One narrow pass, to
    which each text is sent once.
    """
    columns, key, at = docs.columns, uuid.uuid4().hex, docs.columns.index("text")
    added = ["__lang_pred string", "__score double", *([f"__spans {SPANS}"] if with_spans else [])]

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        own = once_per_worker(key, lambda: Labeller(model))
        found = own.label([t or "" for t in part.column(at).to_pylist()], with_spans)
        new = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
        if with_spans:
            new.append(pa.array([[dict(zip(("lang", "first_word", "words", "letters"), s)) for s in spans] for _, _, spans in found], _SPAN_TYPE))
        return pa.RecordBatch.from_arrays([*part.columns, *new], names=[*columns, *[a.split(" ")[0] for a in added]])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], *added])
    return docs.mapInArrow(per_slice(run, "text", SLICE), schema)


def predict(docs: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, spans) of ``docs`` by what ``documents`` teach."""
    out = identify(docs.select("doc_id", "text"), learn(documents))
    return out.select("doc_id", (fold(out) == 0).alias("held_out"), F.col("__lang_pred").alias("lang_pred"), F.col("__score").alias("score"), F.col("__spans").alias("spans"))
