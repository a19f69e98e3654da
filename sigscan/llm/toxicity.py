"""Operator 10, toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of
its words and word stems; the scores of all its sentences are combined by
noisy-or (a document is toxic unless every sentence is harmless), and the weights
are trained from document labels alone. No weight is negative, and the bias is at
most ``BIAS``: a sentence without a weighted word has a chance so small that
millions of them leave a document harmless. The trained model then scores each
sentence, which locates the offending ones.

Training reads a bounded sample of labelled rows, ``MAX_ROWS`` by hash. Their
texts, of any length, stay on the executors: features are counted there, and
the driver gets the features that a weight may be given to and, for each
document, the different sets of them that its sentences have, with how many
sentences have each. Scoring reads every whole text.

Nulls, ties and odd texts: a null or wordless text has the score of an empty
bag, 0; a null doc_id or text is never learned from; labels that are null are not
learned from, contradicting ones each count; rows that repeat a doc_id, its text
and its label are learned once and score alike; texts of any length are read
whole, in pieces cut at white space (a piece ends a sentence); without labels of
both kinds every score is 0; an empty table gives no rows. Columns besides
doc_id and text are not read, but :func:`drop_toxic` keeps them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigscan.llm.common import crc_mod, pieces, tidied
from sigscan.session import discard, materialize, ship

#: Training rows at most; toxic documents that a feature must be in to get a weight.
MAX_ROWS, LEAST_DOCS = 12_000, 3
#: Words that a worker remembers having a weight or none.
KNOWN = 200_000
#: Bytes of a longer word's start that count as its stems.
STEMS = (4, 6)
THRESHOLD = 0.5
#: The bias at most: the chance of a sentence that holds no weighted word is below 1.2e-7.
BIAS = -16.0
#: Ends of sentences become line feeds, other non-word bytes blanks, A-Z a-z.
_FOLD = bytes(10 if b in b".!?\n\r" else b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
SENTENCE = re.compile(r"[^.!?\n\r]+")


def sentences(text: bytes) -> Iterator[list[bytes]]:
    """Words of each sentence that has words."""
    for piece in pieces(text):
        for line in piece.translate(_FOLD).split(b"\n"):
            if words := line.split():
                yield words


def _features(words: list[bytes]) -> set[bytes]:
    return set(words) | {b"^" + w[:k] for w in words for k in STEMS if len(w) > k}


def _log_harmless(z: float) -> float:
    """log(1 - sigmoid(z))."""
    return -math.log1p(math.exp(z)) if z < 0 else -z - math.log1p(math.exp(-z))


class Model:
    """Word and stem weights, and the bias of a sentence."""

    def __init__(self, weights: dict[bytes, float], bias: float):
        self.weights, self.bias = weights, bias
        self.stems = {k[1:] for k in weights if k[:1] == b"^"}
        self._known: dict[bytes, float] = {}

    def _z(self, words: list[bytes]) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in sorted(_features(words)))

    def sentence(self, words: list[bytes]) -> float:
        """The chance that a sentence is toxic."""
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self._z(words))))) if self.weights else 0.0

    def _of_word(self, w: bytes) -> bool:
        return w in self.weights or any(len(w) > k and w[:k] in self.stems for k in STEMS)

    def document(self, text: bytes | None) -> float:
        """Noisy-or of all sentences; those without a weighted word have the same chance and are only counted."""
        if not text or not self.weights:
            return 0.0
        safe, plain, known = 0.0, 0, self._known
        for words in sentences(text):
            for w in words:
                hit = known.get(w)
                if hit is None:
                    if len(known) > KNOWN:
                        known.clear()
                    hit = known[w] = self._of_word(w)
                if hit:
                    safe += _log_harmless(self._z(words))
                    break
            else:
                plain += 1
        return -math.expm1(safe + plain * _log_harmless(self.bias))

    def offending(self, text: str | None, least: float = THRESHOLD) -> list[dict]:
        """Sentences with at least that score: their places in the text and scores."""
        out = []
        for m in SENTENCE.finditer(text or ""):
            words = m[0].encode().translate(_FOLD).split()
            if words and (p := self.sentence(words)) >= least:
                out.append({"start": m.start(), "end": m.end(), "score": p})
        return out


def _document_features(text: bytes) -> set[bytes]:
    return set().union(*map(_features, sentences(text)))


def _candidates(counts: dict[bytes, tuple[int, int]], pos: float, neg: float) -> dict[bytes, float]:
    """Log-odds of the features that are clearly commoner in toxic documents; counts: documents of each feature, (toxic, clean)."""
    odds = {f: math.log((a + 0.5) / (pos + 1)) - math.log((b + 0.5) / (neg + 1)) for f, (a, b) in counts.items() if a >= LEAST_DOCS}
    return {f: odds[f] for f in sorted(odds) if odds[f] > 1}


def _hits(text: bytes, index: dict[bytes, int]) -> list[tuple[tuple[int, ...], int]]:
    """The different sets of candidates that the sentences have, the empty set too, each with its number of sentences."""
    return sorted(Counter(tuple(sorted(index[f] for f in _features(words) if f in index)) for words in sentences(text)).items())


def _fit(start: dict[bytes, float], bags: list[list[tuple[tuple[int, ...], int]]], labels: np.ndarray, rounds: int = 200, ridge: float = 0.02, rate: float = 0.15) -> Model:
    """Noisy-or likelihood over bags of sentences, both labels weighing alike, by projected Adam from log-odds starts."""
    if not start:
        return Model({}, 0.0)
    names, n = list(start), len(bags)
    doc = np.repeat(np.arange(n), [len(b) for b in bags])
    times = np.array([k for b in bags for _, k in b], float)
    row, s = np.repeat(np.arange(len(times)), np.array([len(h) for b in bags for h, _ in b], int)), len(times)
    col = np.array([c for b in bags for h, _ in b for c in h], int)
    y = labels.astype(float)
    weight = np.where(y > 0, (n - y.sum()) / y.sum(), 1.0)
    w, b = np.array([-BIAS / 8 * start[f] for f in names]), BIAS
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, rounds + 1):
        z = np.clip(b + np.bincount(row, w[col], minlength=s), -60, 60)
        q = np.clip(-np.expm1(-np.bincount(doc, times * np.logaddexp(0, z), minlength=n)), 1e-12, 1 - 1e-9)
        # d log-likelihood / d z of a sentence: p * (y / q - 1)
        g = times / (1 + np.exp(-z)) * (weight * (y / q - 1))[doc]
        grad = np.append(np.bincount(col, g[row], minlength=len(w)) - ridge * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = np.maximum(w + step[:-1], 0.0), min(b + step[-1], BIAS)
    return Model({f: float(x) for f, x in zip(names, w, strict=True) if x > 0}, float(b))


def fit(texts: list[bytes], labels: np.ndarray) -> Model:
    """Fit on texts at hand."""
    toxic, clean = Counter(), Counter()
    for text, y in zip(texts, labels, strict=True):
        (toxic if y else clean).update(_document_features(text))
    pos = float(labels.sum())
    start = _candidates({f: (n, clean[f]) for f, n in toxic.items()}, pos, len(texts) - pos) if 0 < pos < len(texts) else {}
    index = {f: k for k, f in enumerate(start)}
    return _fit(start, [_hits(t, index) for t in texts], labels)


def sample(docs: DataFrame, labels: DataFrame, column: str, usable: Column, rows: int) -> DataFrame:
    """(key, text, label) of at most ``rows`` labelled documents, those with the least hash; equal rows once."""
    at = F.xxhash64(F.col("doc_id").cast("long"), F.lit(7))
    picked = labels.where(usable & F.col(column).isNotNull()).select(F.col("doc_id").cast("long").alias("__id"), (F.col(column) > 0).cast("int").alias("label"), at.alias("__at")).orderBy("__at", "__id", "label").limit(rows)
    # the sample has a fixed bound, so it may be sent to every executor
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = texts.join(F.broadcast(picked), F.col("doc_id") == F.col("__id")).select(F.xxhash64("__at", "text", "label").alias("key"), "text", "label")
    # many rows may share an id: keys alone, which bound the sample again, decide which texts move
    keys = found.select(F.col("key").alias("__key")).distinct().orderBy("__key").limit(rows)
    return found.join(F.broadcast(keys), F.col("key") == F.col("__key")).groupBy("key").agg(F.first("text").alias("text"), F.first("label").alias("label"))


def train(docs: DataFrame, labels: DataFrame, rows: int = MAX_ROWS, usable: Column | None = None) -> Model:
    """Fit on a bounded sample; ``usable`` says which rows may be learned from (by default crc32(doc_id) mod 5 is not 0)."""
    spark = docs.sparkSession
    ship(spark)
    usable = crc_mod(F.col("doc_id"), 5) != 0 if usable is None else usable
    found = materialize(sample(docs, labels, "toxic", usable, rows), "toxicity-sample")
    pos, n = found.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    if pos in (0, n):
        return Model({}, 0.0)

    @tidied
    def count(batches):
        for b in batches:
            toxic, clean = Counter(), Counter()
            for text, y in zip(b.column(0).cast(pa.binary()), b.column(1).to_pylist(), strict=True):
                (toxic if y else clean).update(_document_features(text.as_py()))
            names = list(toxic.keys() | clean.keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([toxic[f] for f in names], pa.int64()), pa.array([clean[f] for f in names], pa.int64())], ["feature", "toxic", "clean"])

    counted = found.select("text", "label").mapInArrow(count, "feature binary, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # only features that are commoner in toxic documents come to the driver
    odds = F.log((F.col("toxic") + 0.5) / F.lit(float(pos + 1))) - F.log((F.col("clean") + 0.5) / F.lit(float(n - pos + 1)))
    counts = {bytes(r.feature): (r.toxic, r.clean) for r in counted.where((F.col("toxic") >= LEAST_DOCS) & (odds > 0.99)).collect()}
    start = _candidates(counts, float(pos), float(n - pos))
    sent = spark.sparkContext.broadcast({f: k for k, f in enumerate(start)})

    @tidied
    def hits(batches):
        for b in batches:
            found = [_hits(t.as_py(), sent.value) for t in b.column(1).cast(pa.binary())]
            sets = pa.array([[h for h, _ in x] for x in found], pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), sets, pa.array([[k for _, k in x] for x in found], pa.list_(pa.int64()))], ["key", "label", "hits", "times"])

    got = sorted(found.select("key", "text", "label").mapInArrow(hits, "key long, label int, hits array<array<int>>, times array<long>").collect())
    discard(found)
    return _fit(start, [list(zip(r.hits, r.times, strict=True)) for r in got], np.array([r.label for r in got], int))


def score(docs: DataFrame, model: Model, offending: bool = False) -> DataFrame:
    """(doc_id, score, predicted) for every row and, if asked for, the offending sentences of those predicted toxic: places in the text and scores."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    held: list[Model] = []
    kind = [("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())] + [("offending", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))] * offending

    @tidied
    def run(batches):
        if not held:
            held.append(Model(*sent.value))
        for b in batches:
            for i in range(0, b.num_rows, 512):
                s = b.slice(i, 512)
                texts = s.column(1).cast(pa.binary()).to_pylist()
                scores = [held[0].document(t) for t in texts]
                cols = [s.column(0), pa.array(scores), pa.array([int(x >= THRESHOLD) for x in scores], pa.int32())]
                if offending:
                    cols.append(pa.array([held[0].offending(t.decode("utf-8", "replace")) if x >= THRESHOLD else [] for t, x in zip(texts, scores, strict=True)], kind[3][1]))
                yield pa.RecordBatch.from_arrays(cols, [k for k, _ in kind])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int" + ", offending array<struct<start:int,end:int,score:double>>" * offending)


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns, without a shuffle."""
    ship(docs.sparkSession)
    sent, at = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias)), docs.columns.index("text")
    held: list[Model] = []

    @tidied
    def run(batches):
        if not held:
            held.append(Model(*sent.value))
        for b in batches:
            keep: list[bool] = []
            for i in range(0, b.num_rows, 512):
                keep += [held[0].document(t) < THRESHOLD for t in b.column(at).slice(i, 512).cast(pa.binary()).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
