"""Operator 12 against brute force: all words at one edit, by trying all edits."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sigscan.llm import queries, spelling
from sigscan.session import table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                counts[w] += 1
    counts = {w: n for w, n in counts.items() if n >= 2}
    alphabet, near = set("".join(counts)), {}
    for w in counts:
        edits = {w[:k] + w[k + 1 :] for k in range(len(w))} | {w[:k] + a + w[k + more :] for k in range(len(w) + 1) for a in alphabet for more in (0, 1)}
        near[w] = [x for x in edits - {w} if x in counts and abs(len(x) - len(w)) <= 1]
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 10 * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), counts.get(form[w]))
    return out


def rows_of(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, size):
    folder = f"/root/testdata/{size}"
    got = rows_of(queries.op12_spelling(spark, folder))
    assert got == brute_force([(r.doc_id, r.text) for r in table(spark, folder, "documents").select("doc_id", "text").collect()])
    assert any(v[0] for v in got.values())


def odd():
    rng = random.Random(4)
    made = ["".join(rng.choice("abÀé") for _ in range(rng.randint(6, 9))) for _ in range(3000)]
    rows = [(rng.choice([None, *range(50)]), " ".join(rng.choice(made) for _ in range(200))) for _ in range(200)]
    chain = ["abcdefgh", "abcdefgi", "abcdefji"]  # each 12 times as frequent as the one before
    rows += [(k, " ".join(w for w, n in zip(chain, (2, 24, 288), strict=True) for _ in range(n))) for k in (100, 100)]
    return [*rows, (1, None), (2, ""), (3, "ABCDÉFG abcdÉfg abcdéfg abcdéfg abcdéfg"), (None, "aaaaaaa aaaaaaa aaaaaaaa aaaaaaaa"), (None, None)]


def test_odd_rows(spark):
    rows = odd()
    df = spark.createDataFrame([(*r, "w", 1, 2) for r in rows], "doc_id long, text string, word string, n int, id int").repartition(7)
    got = rows_of(spelling.group_spellings(df))
    assert got == brute_force(rows)
    assert rows_of(spelling.group_spellings(df.where("false"))) == {}


def test_very_long_words(spark):
    x = "x" * 50_000
    df = spark.createDataFrame([(k, f"{x} {x[1:]} {x[1:]}y") for k in range(40)], "doc_id long, text string")
    got = {len(w): v for w, v in rows_of(spelling.group_spellings(df)).items() if v[2] > 20 and w[-1] == "x"}
    assert got[50_000][3] >= 2 and got[49_999][3] >= 2


def test_deletion_keys_equal_plain_hashes():
    rng = np.random.default_rng(2)
    codes = rng.integers(97, 100, (50, 9))
    plain = lambda letters: sum(int(spelling._mixed(np.array([c], np.uint64))[0]) * pow(spelling._BASE, k, 1 << 64) for k, c in enumerate(letters)) % (1 << 64)
    whole, without = spelling.deletion_keys(codes)
    for row, h, each in zip(codes, whole, without, strict=True):
        assert int(h) == plain(row)
        assert [int(x) for x in each] == [plain([*row[:k], *row[k + 1 :]]) for k in range(9)]


def test_colliding_keys_link_nothing(spark, monkeypatch):
    """All keys fall on one of 64 values; the strings decide."""
    mixed = spelling.word_keys
    monkeypatch.setattr(spelling, "word_keys", lambda w: (lambda at, key, place: (at, key & np.uint64(63), place))(*mixed(w)))
    at, key, _ = spelling.word_keys(["abcdefg", "hijklmn"])
    assert len(set(key)) < len(at)
    batch = __import__("pyarrow").RecordBatch.from_pydict({"id": list(range(40)), "word": [f"word{chr(97 + k // 26)}{chr(97 + k % 26)}abc" for k in range(40)]})
    rows = [(r["id"], r["key"], r["place"]) for b in spelling._keys([batch]) for r in b.to_pylist()]
    words = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    shared = spark.createDataFrame([(words[i], 2, p) for i, _, p in rows], "word string, n long, place int").select("word", "place", spelling._context().alias("context"))
    pairs = shared.alias("a").join(shared.alias("b"), "context").where("a.word < b.word and a.place = b.place").select("a.word", "b.word").distinct().collect()
    assert pairs and all(sum(x != y for x, y in zip(a, b, strict=True)) == 1 for a, b in pairs)
