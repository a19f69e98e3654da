"""Operator 3, quality classifier: a sparse rule ensemble over text statistics.

Statistics of the whole text are Spark expressions. Small trees grown on random
halves of the training rows give conjunctive rules, one for each path from the
root to a node; an l1-penalised logistic regression keeps few of them (Friedman
and Popescu, 2008); the kept rules are compiled into one Spark expression, so
scoring runs in the JVM without Python.

Training reads the statistics of a bounded sample of labelled rows,
``MAX_ROWS`` by hash of doc_id. Scoring reads every whole text.

Nulls, ties and odd texts: a null text is scored as an empty one; a null doc_id
or text is never learned from; null labels are not learned from, contradicting
ones each count; rows that repeat a doc_id, its text and its label are learned
once and score alike; a text of any length is read whole; without labels every
score is 0.5, with labels of one kind it is their rate, smoothed; an empty table
gives no rows. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigscan.llm.common import crc_mod
from sigscan.llm.toxicity import sample

MAX_ROWS, THRESHOLD = 20_000, 0.7
#: Trees, their depth, cut points tried for a statistic, and the strength of the l1 penalty.
TREES, DEPTH, CUTS, PENALTY = 40, 3, 24, 0.002


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    words = F.split(t, r"[ \t\n\r]+")
    lines = F.split(t, "\n")
    # most of a text is small letters and blanks; what is left is counted by kind
    rest = F.regexp_replace(t, r"[a-z \n\u00C0-\u024F]+", "")
    share = lambda pattern: F.regexp_count(rest, F.lit(pattern)) / n
    count = F.size(words).cast("double")
    return {
        "log_length": F.log1p(F.length(t)).cast("double"),
        "word_length": n / count,
        "distinct_words": F.size(F.array_distinct(words)) / count,
        "line_length": F.log1p(n / F.size(lines)),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines).cast("double"),
        "capitals": share("[A-Z]"),
        "digits": share("[0-9]"),
        "symbols": share(r"[#$%&*+=<>^~@\\/{}\[\]_]"),
        "bars": share("[|]"),
        "shouts": share("[!?]"),
        "stops": share("[.,;:]"),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, greater, bound): statistic > bound, or <= bound."""

    parts: tuple[tuple[str, bool, float], ...]

    def test(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([(x[s] > v) if up else (x[s] <= v) for s, up, v in self.parts])

    def column(self) -> Column:
        out = None
        for s, up, v in self.parts:
            c = F.col(s) > F.lit(float(v)) if up else F.col(s) <= F.lit(float(v))
            out = c if out is None else out & c
        return out


@dataclass
class Model:
    rules: list[tuple[Rule, float]]
    bias: float

    def probability(self, x: dict[str, np.ndarray], n: int) -> np.ndarray:
        z = np.full(n, self.bias)
        for r, w in self.rules:
            z += w * r.test(x)
        return 1 / (1 + np.exp(-z))

    def column(self) -> Column:
        """The score over columns named as the statistics."""
        z = F.lit(float(self.bias))
        for r, w in self.rules:
            z = z + F.when(r.column(), F.lit(float(w))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _grow(names: list[str], x: np.ndarray, y: np.ndarray, rows: np.ndarray, use: np.ndarray, path: tuple, rules: set[Rule], depth: int) -> None:
    """Split by the greatest fall of the Gini impurity; every path becomes a rule."""
    if path:
        rules.add(Rule(path))
    v = y[rows]
    if depth == 0 or len(rows) < 20 or v.min() == v.max():
        return
    best, total, ones = None, len(rows), v.sum()
    for k in use:
        c = x[rows, k]
        cuts = np.unique(np.quantile(c, np.linspace(0, 1, CUTS + 2)[1:-1]))
        if not len(cuts):
            continue
        order = np.argsort(c, kind="stable")
        at = np.searchsorted(c[order], cuts, "right")
        sums = np.concatenate([[0.0], v[order].cumsum()])
        left, a = at.astype(float), sums[at]
        right, b = total - left, ones - a
        ok = (left >= 5) & (right >= 5)
        if not ok.any():
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            cost = np.where(ok, a * (1 - a / left) + b * (1 - b / right), np.inf)
        i = int(cost.argmin())
        if best is None or cost[i] < best[0]:
            # between two values of the sample, so that rounding of a statistic can't cross it
            above = c[c > cuts[i]]
            bound = float((cuts[i] + above.min()) / 2) if len(above) else float(cuts[i])
            best = (float(cost[i]), int(k), bound)
    if best is None or best[0] >= ones * (1 - ones / total) - 1e-9:
        return
    _, k, bound = best
    for up in (False, True):
        side = rows[(x[rows, k] > bound) == up]
        if len(side):
            _grow(names, x, y, side, use, (*path, (names[k], up, bound)), rules, depth - 1)


def fit(x: dict[str, np.ndarray], y: np.ndarray, seed: int = 3) -> Model:
    """Rules from trees on random halves, then lasso logistic weights by accelerated proximal gradient."""
    n = len(y)
    if not n or y.min() == y.max():
        return Model([], float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))) if n else 0.0)
    names, rng, rules = list(x), np.random.default_rng(seed), set()
    m = np.stack([x[s] for s in names], 1)
    for _ in range(TREES):
        rows = rng.permutation(n)[: max(min(n, 20), min(n // 2, 5000))]
        use = rng.permutation(len(names))[: max(3, len(names) // 2)]
        _grow(names, m, y, rows, use, (), rules, DEPTH)
    rules = sorted(rules, key=lambda r: r.parts)
    if not rules:
        return Model([], float(np.log(y.mean() / (1 - y.mean()))))
    z = np.stack([r.test(x) for r in rules], 1).astype(np.float32)
    _, first = np.unique(z, axis=1, return_index=True)  # rules that hold for the same rows count once
    first = np.sort(first)
    z, rules = z[:, first], [rules[k] for k in first]
    spread = z.std(0)
    live = spread > 0
    z, rules, spread = z[:, live], [r for r, k in zip(rules, live, strict=True) if k], spread[live]
    center = z.mean(0)
    u = np.ascontiguousarray((z - center) / spread, np.float32)
    w, b = np.zeros(u.shape[1]), float(np.log(y.mean() / (1 - y.mean())))
    vw, vb, t = w, b, 1.0
    top = np.ones(u.shape[1], np.float32)
    for _ in range(20):  # the largest eigenvalue, for the step
        top = u.T @ (u @ top)
        top /= np.linalg.norm(top)
    rate = 4 / max(float(np.linalg.norm(u @ top) ** 2) / n, 1.0)
    for _ in range(400):  # the products in single precision, as u is
        g = 1 / (1 + np.exp(-((u @ vw.astype(np.float32)).astype(float) + vb))) - y
        step = vw - rate * (u.T @ g.astype(np.float32)).astype(float) / n
        nw = np.sign(step) * np.maximum(np.abs(step) - rate * PENALTY, 0)
        nb = vb - rate * float(g.mean())
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        vw, vb = nw + (t - 1) / s * (nw - w), nb + (t - 1) / s * (nb - b)
        w, b, t = nw, nb, s
    keep = np.flatnonzero(w)
    return Model([(rules[k], float(w[k] / spread[k])) for k in keep], float(b - (w * center / spread)[keep].sum()))


def train(docs: DataFrame, labels: DataFrame, rows: int = MAX_ROWS, usable: Column | None = None) -> Model:
    """Fit on a bounded sample; ``usable`` says which rows may be learned from (by default crc32(doc_id) mod 4 is not 2)."""
    usable = crc_mod(F.col("doc_id"), 4) != 2 if usable is None else usable
    found = sample(docs, labels, "quality", usable, rows)
    got = found.select("label", *[c.alias(s) for s, c in statistics(F.col("text")).items()], "key").orderBy("key").collect()
    names = list(statistics(F.lit("")))
    return fit({s: np.array([r[s] for r in got], float) for s in names}, np.array([int(r["label"] > 0) for r in got], float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) for every row, in the JVM alone."""
    with_stats = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(s) for s, c in statistics(F.col("text")).items()])
    scored = with_stats.select("doc_id", model.column().alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
