"""Operator 9, language identification by error-correcting output codes.

Each language has a codeword; a logistic classifier over hashed byte n-grams
(1 to 3, inside words) predicts each bit. A text gets the language whose
codeword has the least logistic loss against the classifiers' margins, each bit
weighted by how well its classifier did in training; a second codeword nearly as
close marks the text as ambiguous.

Training reads a sample: about ``MAX_ROWS`` documents, taken by hash in equal
shares for each language, and at least one of each, so that every value of lang
that may be learned from is; of each text it takes the n-gram counts of its
whole. What the driver gets grows with the number of languages (8 KB each beyond
``MAX_ROWS``), not of documents. Scoring reads every whole text.

Nulls, ties and odd texts: a null text, and one without a letter, is ``und``
with score 0; a null lang or doc_id is not learned from; rows that repeat a
doc_id, its text and lang are learned once and predicted alike; equal distances go to the first language by code point; texts
of any length are read whole, in pieces; without a learnable language all
texts are ``und``; an empty table gives no rows. Columns besides doc_id, text
and lang are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigscan.llm.common import crc_mod, pieces, tidied
from sigscan.session import materialize, ship

#: Training documents (more only if there are more languages), and hashed features.
MAX_ROWS, FEATURES = 4000, 4096
#: The least lead of the best codeword, in score, for a text to be unambiguous.
LEAD = 0.2
UND = "und"
#: ASCII that is no letter becomes a blank; letters are lower case before.
_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_LETTER = re.compile(r"[^\W\d_]")
_MIX = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def counts(text: bytes) -> np.ndarray:
    """Counts of hashed 1-, 2- and 3-grams of bytes, over the whole text."""
    out = np.zeros(FEATURES, np.int64)
    shift = np.uint32(32 - FEATURES.bit_length() + 1)
    for piece in pieces(text):
        data = piece.decode("utf-8", "replace").lower().encode().translate(_FOLD)
        b = np.frombuffer(b" " + b" ".join(data.split()) + b" ", np.uint8).astype(np.uint32)
        h = b * _MIX[0]
        out += np.bincount(h >> shift, minlength=FEATURES)
        for k in (1, 2):
            if len(b) > k:
                h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * _MIX[k] + b[k:] * _MIX[0]
                out += np.bincount(h >> shift, minlength=FEATURES)
    return out


def has_letter(text: str | None) -> bool:
    """A letter: a word character that is no digit, underscore or other number."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text or ""))


def unit(x: np.ndarray) -> np.ndarray:
    """Square roots of shares: rows of unit length."""
    return np.sqrt(x / np.maximum(x.sum(-1, keepdims=True), 1)).astype(np.float32)


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n codewords of -1 and 1: all splits of few languages, else random balanced bits with far-apart rows."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 5:
        bits = [[1 if k >> i & 1 else -1 for i in range(n)] for k in range(1, 2 ** (n - 1))]
        return np.array(bits, float).T
    rng, b, best, far = np.random.default_rng(seed), int(np.ceil(12 * np.log2(n))), None, -1
    for _ in range(50 if n <= 512 else 1):  # of many codewords the first set is far enough apart; its search would grow with n * n
        code = np.stack([rng.permutation(np.where(np.arange(n) % 2, 1, -1)) for _ in range(b)], 1).astype(float)
        gap = int(((b - code @ code.T) / 2 + np.eye(n) * b).min()) if n <= 512 else 0
        if gap > far:
            best, far = code, gap
    return best


class Model:
    """Languages, their codewords, and a classifier and weight for each bit."""

    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.languages, self.code, self.weights, self.bias, self.trust = languages, code, weights, bias, trust

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Weighted logistic loss of each codeword (columns) for rows of features."""
        margin = x @ self.weights + self.bias
        plus, minus = np.logaddexp(0, -margin), np.logaddexp(0, margin)
        return (plus * self.trust) @ (self.code > 0).T + (minus * self.trust) @ (self.code < 0).T

    def predict(self, x: np.ndarray) -> list[tuple[str, float, bool]]:
        """(language, score, ambiguous) of rows of features."""
        if not self.languages:
            return [(UND, 0.0, True)] * len(x)
        e = self.losses(x)
        e = np.exp(-(e - e.min(1, keepdims=True)))
        p = e / e.sum(1, keepdims=True)
        best = p.argmax(1)
        top = p[np.arange(len(p)), best]
        second = np.where(np.arange(p.shape[1])[None, :] == best[:, None], 0, p).max(1)
        return [(self.languages[k], float(s), bool(s - t < LEAD)) for k, s, t in zip(best, top, second, strict=True)]


def fit(x: np.ndarray, langs: list[str], rounds: int = 120, ridge: float = 1e-4) -> Model:
    """A logistic classifier for each bit, all bits at once, by accelerated gradient descent on whole data."""
    languages = sorted(set(langs))
    code = codewords(len(languages))
    if not languages:
        return Model([], code, np.zeros((FEATURES, 1)), np.zeros(1), np.ones(1))
    place = {v: k for k, v in enumerate(languages)}
    own = np.array([place[v] for v in langs])
    share = (1 / np.bincount(own, minlength=len(languages)))[own]
    share = (share / share.sum()).astype(np.float32)[:, None]
    y = code[own].astype(np.float32)
    center = x.mean(0)
    z = x - center
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    rate = 4.0 / max(float((share * z**2).sum(1).sum()), 1e-3)
    vw, vb, t = w, b, 1.0
    for _ in range(rounds):
        g = -y * share / (1 + np.exp(np.clip(y * (z @ vw + vb), -30, 30)))
        nw, nb = vw - rate * (z.T @ g + ridge * vw), vb - min(rate, 4.0) * g.sum(0)
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        vw, vb = nw + (t - 1) / s * (nw - w), nb + (t - 1) / s * (nb - b)
        w, b, t = nw, nb, s
    right = (((z @ w + b) * y > 0) * share).sum(0)
    trust = np.clip(np.log(np.maximum(right, 0.501) / np.maximum(1 - right, 1e-3)), 0.05, 7) / 7
    return Model(languages, code, w.astype(np.float64), (b - center @ w).astype(np.float64), trust)


def train(docs: DataFrame, rows: int = MAX_ROWS, usable: Column | None = None) -> Model:
    """Fit on a bounded sample; ``usable`` says which rows may be learned from (by default crc32(doc_id) mod 3 is not 1)."""
    ship(docs.sparkSession)
    usable = crc_mod(F.col("doc_id"), 3) != 1 if usable is None else usable
    known = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string"), F.lit(9)).alias("key"))
    sizes = materialize(known.groupBy("lang").agg(F.count("*").alias("n"), F.min("key").alias("least")), "languages")
    languages = sizes.count()
    if not languages:
        return fit(np.zeros((0, FEATURES), np.float32), [])
    # keys alone decide which texts are read; those picked are about MAX_ROWS and the languages
    at = F.pmod(F.xxhash64("key"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    picked = known.select("lang", "key").join(sizes, "lang").where((F.col("key") == F.col("least")) | (at * F.col("n") < max(1.0, rows / languages))).select(F.col("key").alias("__key")).distinct()
    found = known.join(F.broadcast(picked), F.col("key") == F.col("__key")).select("key", "lang", "text")

    @tidied
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                s = b.slice(i, 256)
                x = [unit(counts(t.as_py())).astype(np.float16).tobytes() for t in s.column(2).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array(x, pa.binary())], ["key", "lang", "x"])

    # rows that repeat another are dropped before the driver gets any
    once = found.mapInArrow(run, "key long, lang string, x binary").groupBy("key", "lang").agg(F.first("x").alias("x"))
    got = sorted(once.collect(), key=lambda r: (r.key, r.lang))
    x = np.stack([np.frombuffer(r.x, np.float16) for r in got]).astype(np.float32)
    return fit(x, [r.lang for r in got])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) for every row."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.code, model.weights, model.bias, model.trust))
    held: list[Model] = []

    @tidied
    def run(batches):
        if not held:
            held.append(Model(*sent.value))
        for b in batches:
            for i in range(0, b.num_rows, 256):
                s = b.slice(i, 256)
                texts = s.column(1).cast(pa.binary()).to_pylist()
                out: list[tuple] = [(UND, 0.0, True)] * len(texts)
                at = [k for k, t in enumerate(texts) if t and has_letter(t.decode("utf-8", "replace"))]
                if at:
                    for k, p in zip(at, held[0].predict(unit(np.stack([counts(texts[k]) for k in at]))), strict=True):
                        out[k] = p
                lang, score, ambiguous = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ambiguous, pa.bool_())], ["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")
