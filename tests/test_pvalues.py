"""The p-value extractor: hand-traced cases, an independent evaluator on random text, and its plan."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from sigscan.functions.bins import bin_index, bin_label, histogram_bin
from sigscan.functions.pvalues import extract_pvalues

CASES = [
    (" (p < 0.05)", [(0.05, "<")]), (" P-value=0.03", [(0.03, "=")]), (" p values ≤ .01 ", [(0.01, "<")]), (" p<.05,", []), (" p<.05.", []),
    (" p<0.05,", [(0.05, "<")]), (" p=0,05", [(0.05, "=")]), (" p=0•05", [(0.05, "=")]), (" p=5%", [(0.05, "=")]), (" p = 0.1 %", [(0.001, "=")]),
    (" p=5e-4", [(5e-4, "=")]), (" p=5 E -4", [(5e-4, "=")]), (" p=5×10-4", [(5e-4, "=")]), (" p=5 x 10(-4)", [(5e-4, "=")]), (" p=0.04 × 10−4", [(0.4, "=")]),
    (" p=10-4", []), (" p=10^-4", []), (" p=0.05 23 patients", [(0.05, "=")]), (" p < 0.05 - 12", [(0.05, "<")]), (" p=1.0", []), (" p=0", []), (" p=0.000", []),
    (" p less than 0.05", [(0.05, "<")]), (" p value of < 0.05", [(0.05, "<")]), (" p of 0.03", []), (" p < = 0.05", []), ("[p<0.05", []), (";p<0.05", []), (" P = NS", []),
    (" p<0.05 p<0.01", [(0.05, "<")]), (" p<0.05; p<0.01", [(0.05, "<"), (0.01, "<")]), (" (p<0.05)(p<0.01)", [(0.05, "<"), (0.01, "<")]), (" p<>0.05", [(0.05, "ambiguous")]),
    (" p=0.05 xenografts", [(0.5, "=")]), (" p=0.01-0.05", [(0.01, "=")]), (" p=0.02E5", [(0.02, "=")]), (" p < 0.05", [(0.05, "<")]), (None, []), ("", []),
]


def extract(spark, lines):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(lines)], "k int, line string")
    got = {r.k: [(v.p, v.op) for v in r.pv] for r in df.select("k", extract_pvalues(F.col("line")).alias("pv")).collect()}
    return [got[k] for k in range(len(lines))]


def test_traced_cases(spark):
    got = extract(spark, [t if t is None else "PMC1" + t for t, _ in CASES])
    for (text, want), have in zip(CASES, got, strict=True):
        assert [o for _, o in have] == [o for _, o in want], text
        assert [p for p, _ in have] == pytest.approx([p for p, _ in want], rel=1e-12), text


def test_bare_text_gets_a_lead(spark):
    df = spark.createDataFrame([("P<0.05",)], "t string")
    assert len(df.select(extract_pvalues(F.col("t"), bare=True).alias("v")).first().v) == 1


class Evaluator:
    """The grammar read by hand-written descent with backtracking over choices, without regular expressions."""

    WS = set("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0     　") | {chr(c) for c in range(0x2000, 0x200B)}

    def __init__(self, text):
        self.t = text

    def ws(self, i):
        j = i
        while j < len(self.t) and self.t[j] in self.WS:
            j += 1
        return range(j, i - 1, -1)

    def digits(self, i):
        j = i
        while j < len(self.t) and self.t[j] in "0123456789":
            j += 1
        return range(j, i - 1, -1)

    def lit(self, i, s):
        return [i + len(s)] if self.t.startswith(s, i) else []

    def operator(self, i):
        """Ends of one or more operators, most first."""
        one = [i + 1] if i < len(self.t) and self.t[i] in "=<>≤≥" else []
        for word, tail in (("less", "than"), ("of", "<")):
            for j in self.lit(i, word):
                for k in self.ws(j):
                    if k > j:
                        one += self.lit(k, tail)
        for j in one:
            yield from self.operator(j)
            yield j

    def number(self, i):
        """(end, digits, suffix) in order of preference."""
        t = self.t
        starts = ([i + 1] if i < len(t) and t[i] in "0123456789" else []) + ([i + 2] if i + 1 < len(t) and t[i] in ",.•" and t[i + 1] in "0123456789" else [])
        for a in starts:
            for b in self.digits(a):
                for c in ([b + 1] if b < len(t) and t[b] in ",.•" else []) + [b]:
                    for d in self.digits(c):
                        for e in self.ws(d):
                            yield from ((end, t[i:d], s) for end, s in self.suffix(e))

    def suffix(self, i):
        t = self.t
        if i < len(t) and t[i] == "%":
            yield i + 1, ("%", "", "", "")
        for x, a in ([(t[i], i + 1)] if i < len(t) and t[i] in "x×" else []) + [("", i)]:
            for b in self.ws(a):
                for c in self.digits(b):
                    for d in self.ws(c):
                        for m, e in [(m, d + len(m)) for m in ("exp", "Exp", "E", "e") if t.startswith(m, d)] + [("", d)]:
                            for f in self.ws(e):
                                for g in self.exponent(f):
                                    yield g, (x, t[b:c], m, t[f:g])
                        yield d, (x, t[b:c], "", "")

    def exponent(self, i):
        t = self.t
        if i < len(t) and t[i] == "(":
            for a in self.ws(i + 1):
                for b in self.lit(a, "-"):
                    for c in self.ws(b):
                        for d in self.digits(c):
                            for e in self.ws(d) if d > c else []:
                                yield from self.lit(e, ")")
        for a in self.ws(i):
            for b in self.lit(a, "-"):
                for c in self.ws(b):
                    yield from (d for d in self.digits(c) if d > c)

    def match(self, i):
        t = self.t
        if not (t[i] in self.WS or t[i] == "(") or i + 1 >= len(t) or t[i + 1] not in "Pp":
            return None
        j = k = i + 2
        while k < len(t) and (t[k] in self.WS or t[k] == "-"):
            k += 1
        for a in range(k, j - 1, -1):
            for b in self.lit(a, "values") + self.lit(a, "value") + [a]:
                for c in self.ws(b):
                    for d in self.operator(c):
                        for e in self.ws(d):
                            for end, digits, suffix in self.number(e):
                                return end, t[c:d], digits, suffix
        return None

    def run(self):
        out, i = [], 0
        while i < len(self.t):
            m = self.match(i)
            if m is None:
                i += 1
                continue
            i, op, digits, (x, base, mark, power) = m
            d = digits.replace(",", ".").replace("•", ".")
            if d.count(".") > 1:
                continue
            p = float(d)
            if x == "%":
                p *= 0.01
            elif x or mark:
                b = float(base) if base and float(base) else 10
                p *= b ** (float(re.sub(r"[\s()]", "", power)) if power else 1)
            less, more = "<" in op or "≤" in op or "less" in op, ">" in op or "≥" in op
            if 0 < p < 1:
                out.append((p, "ambiguous" if less and more else "<" if less else ">" if more else "="))
        return out


def test_random_text_equals_evaluator(spark):
    rng = random.Random(11)
    bits = [" p", "(P", "p", " ", "-", "value", "values", "<", "=", "≤", ">", "less than", "of <", "0", ".", ",", "05", "5", "%", "x", "×", "10", "e", "E", "exp", "-4", "(-3)", "- 2", " ", "\n", "n", ";", ")"]
    lines = ["PMC1" + "".join(rng.choice(bits) for _ in range(rng.randint(3, 14))) for _ in range(3000)]
    lines += ["PMC2 p" + "".join(rng.choice(bits[4:]) for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    for line, have in zip(lines, extract(spark, lines), strict=True):
        want = Evaluator(line).run()
        assert [o for _, o in have] == [o for _, o in want], repr(line)
        assert [p for p, _ in have] == pytest.approx([p for p, _ in want], rel=1e-12), repr(line)


def test_bins(spark):
    df = spark.createDataFrame([(0.001,), (0.0010001,), (0.05,), (0.0500001,), (1e-15,), (0.049,)], "p double")
    got = [(r.b, r.l) for r in df.select(bin_index(F.col("p")).alias("b"), bin_label(bin_index(F.col("p"))).alias("l")).collect()]
    assert got == [(1, "0.001"), (2, "0.002"), (50, "0.050"), (51, "0.051"), (1, "0.001"), (49, "0.049")]
    got = [r.h for r in df.select(histogram_bin(F.col("p")).alias("h")).collect()]
    assert got == [0, 1, 49, None, None, 48]


def test_extraction_is_planned_once(spark, sf):
    """Neither the fan-out to categories nor the filter on exploded values repeats the pattern."""
    from sigscan.plans import catalogue

    for name in ("trend_by_category_year", "pvalue_bins_by_operator", "pvalue_totals"):
        plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") == 1, name


@pytest.mark.parametrize(
    ("run", "tail", "want"),
    [("-", "< 0.05", [(0.05, "<")]), (" ", "= 0.01", [(0.01, "=")]), ("=", "0.02", [(0.02, "=")]), ("less than", "0.03", [(0.03, "<")]), ("<\xa0", "x", []), ("> ", " 0.04", []), ("p ", "p<0.02", [(0.02, "<")]), ("p=0.5 ", "", None), ("p value of ", "", []), ("p=0.05" + " " * 1000, "", None), ("0", "", [])],
)
def test_long_runs_are_read_in_linear_time(spark, run, tail, want):
    """A megabyte between P and its number, of each kind that the grammar repeats; no stack is used up and no place is tried again."""
    n = (1 << 20) // len(run)
    df = spark.createDataFrame([("PMC1 (p" + run * n + tail, f"PMC1 (p{run * 200}{tail}")], "t string, short string")
    began = time.perf_counter()
    got = [(v.p, v.op) for v in df.select(extract_pvalues(F.col("t")).alias("v")).first().v]
    assert time.perf_counter() - began < 20
    assert want is None or [(round(p, 9), o) for p, o in got] == want
    short = [(v.p, v.op) for v in df.select(extract_pvalues(F.col("short")).alias("v")).first().v]
    if len(run) < 20:
        assert [o for _, o in short] == [o for _, o in Evaluator(f"PMC1 (p{run * 200}{tail}").run()]
