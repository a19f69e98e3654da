"""Data structures and models of the training-data operators, without Spark."""

import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sigscan.llm import common, dac, decontam, fmindex, langid, quality, simhash, tokencount, toxicity, warc
from sigscan.llm.common import forest, pieces, union_edges


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.integers(1, 32))
def test_dac_round_trip_and_access(values, bits):
    x = np.array(values, np.uint32) & np.uint32((1 << bits) - 1)
    d = dac.Dac(dac.Dac.encode(x))
    assert (d.all() == x).all() and len(d.all()) == len(x)
    if len(x):
        at = np.random.default_rng(0).integers(0, len(x), 50)
        assert (d.get(at) == x[at]).all()
    with pytest.raises(IndexError):
        d.get(np.array([len(x)]))


def test_dac_file_random_access():
    rng = np.random.default_rng(1)
    docs = [(k if k % 7 else None, rng.integers(0, 49408, rng.integers(0, 900)).astype(np.uint32)) for k in range(200)]
    out = io.BytesIO()
    w = dac.Writer(out, segment_ids=5000)
    for key, ids in docs:
        w.add(key, ids)
    w.close()
    r = dac.Reader(io.BytesIO(out.getvalue()))
    at = 0
    for (key, ids), (k, start, got) in zip(docs, r.documents(), strict=True):
        assert (key, at) == (k, start) and (ids == got).all()
        at += len(ids)
    flat = np.concatenate([i for _, i in docs])
    for p in rng.integers(0, len(flat), 100):
        assert r.token(int(p)) == flat[p]
    with pytest.raises(ValueError):
        dac.Reader(io.BytesIO(out.getvalue()[:-3]))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=25), min_size=1, max_size=12), st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=5), min_size=1, max_size=10))
def test_fm_index_finds_every_occurrence(runs, patterns):
    text = np.array([s for r in runs for s in [*r, 0]], np.int64)
    sa = fmindex.suffix_array(text)
    assert sorted(sa) == list(range(len(text)))
    index = fmindex.FMIndex(text, 5)
    m = np.zeros((len(patterns), 5), np.int64)
    for k, p in enumerate(patterns):
        m[k, : len(p)] = p
    low, high = index.search(m, np.array([len(p) for p in patterns]))
    got = {(int(a), int(b)) for w, at in index.locate(low, high) for a, b in zip(w, at, strict=True)}
    want = {(k, i) for k, p in enumerate(patterns) for i in range(len(text)) if text[i : i + len(p)].tolist() == p}
    assert got == want


def test_judge_equals_brute_force():
    rng = random.Random(4)
    vocab = ["alpha", "Beta", "gamma", "délta", "e1", "zeta"]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 14, 20])))) for k in range(25)] + [(None, "gamma gamma e1 zeta"), (3, None), (3, "Beta! beta, alpha")]
    docs = [" ".join(rng.choice(vocab + ["other", "words"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    docs += [f"x {items[k][1]} y {items[k][1]}" for k in range(10)] + [None, "", "--- !!!"]
    block = decontam.Block([(i, (t or "").encode()) for i, t in items], 13)
    for shard in (1, 100, 10_000):
        judge, got = decontam.Judge(lambda: [block], shard), []
        for d in docs:
            judge.add(d.encode() if d else None)
            if judge.full:
                got += judge.verdicts()
        got += judge.verdicts()
        for d, v in zip(docs, got, strict=True):
            n, hit, count, _, bad = decontam.brute_force(d, items)
            assert (v["n_words"], v["n_hit"], len(v["items"]), v["contaminated"]) == (n, hit, count, bad), d
            assert sum(b - a for a, b in v["word_spans"]) == hit


def test_simhash_equals_definition():
    from xxhash import xxh64_intdigest

    def plain(text):
        w = (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\x0b", " ").replace("\x0c", " ").split(" ")
        w = [x for p in w for x in p.replace("\t", "\n").replace("\r", "\n").split("\n") if x]
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = [xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    for t in [None, "", "  ", "One", "one TWO", "a b c d a b c", "É x y z\tq", "w " * 5000]:
        assert simhash.fingerprint(t.encode() if t is not None else None) % (1 << 64) == plain(t), t


def test_long_texts_are_read_whole(monkeypatch):
    rng = random.Random(2)
    text = " ".join(rng.choice(["ab", "cde", "fgh", "i"]) for _ in range(4000)).encode()
    whole = simhash.fingerprint(text)
    assert b"".join(common.pieces(text, 100)) == text
    monkeypatch.setattr(simhash, "pieces", lambda data: pieces(data, 64))
    assert simhash.fingerprint(text) == whole


def test_word_parts_hold_all_words():
    rng = random.Random(3)
    texts = [None, "", "  a ", "\x0bx\x0c", "é\x1cz y"] + [" ".join(rng.choice(["ab", "cde", "fgh", "i"]) for _ in range(rng.randint(0, 90))) for _ in range(60)] + ["lorem ipsum " * 300]
    for limit in (1, 64, 1000, 1 << 20):
        got = [[] for _ in texts]
        for row, lens, code, distinct in common.word_parts(pa.array(texts), limit):
            words = [distinct[c] for c in code.tolist()]
            for k, n in enumerate(lens.tolist()):
                got[row + k] += words[:n]
                words = words[n:]
        assert [[w for w in g if w] for g in got] == [(t or "").encode().split() for t in texts]


def test_forest_keeps_components():
    rng = np.random.default_rng(3)
    u, v = rng.integers(0, 500, 400), rng.integers(0, 500, 400)
    a = union_edges(np.arange(500), u, v)
    x, y = forest(u, v)
    assert len(x) < 500
    assert (union_edges(np.arange(500), x, y) == a).all()


def test_token_counts_equal_plain_dynamic_programming():
    rng = random.Random(6)
    v = tokencount.Vocabulary(["".join(rng.choice("abc▁") for _ in range(rng.randint(1, 5))) for _ in range(60)])

    def plain(w):
        best = [(0.0, 0)]
        for e in range(1, len(w) + 1):
            found = (-1e18, -1, 0)
            for s in range(e):
                node = v.root
                for c in w[s:e]:
                    node = node.get(c) if node else None
                if node and "" in node:
                    found = max(found, (best[s][0] + v.scores[node[""]], s, best[s][1] + 1), key=lambda o: o[:2])
            n = len(w[e - 1].encode())
            alone = (best[e - 1][0] + v.unknown * n, best[e - 1][1] + n)
            best.append(alone if alone[0] > found[0] else (found[0], found[2]))
        return best[-1][1]

    words = {"".join(rng.choice("abcdé") for _ in range(rng.randint(1, 12))) for _ in range(500)}
    c = tokencount.Counter(v, kept=200)
    text, n = " ".join(sorted(words)), sum(plain("▁" + w) for w in words)
    long = " " + "ab" * 200 + "\n" + "ab" * 200
    a, b = c.shard(pa.array([text, None, " ", text, long]))
    assert (a.tolist(), b.tolist()) == ([len(words), 0, 0, len(words), 2], [n, 0, 0, n, 2 * plain("▁" + "ab" * 200)])
    f = tokencount.Forward(v)
    for w in sorted(words):
        f.tokens(w)
    assert f.steps < sum(map(len, words))  # shared prefixes are scored once


def test_warc_records():
    data = warc.record(5, "http://x/ a\r\nb", "ü<p>".encode(), __import__("hashlib").sha256("ü<p>".encode()).hexdigest())
    row = warc.parse(data)
    assert (row["page_id"], row["payload"], row["record_type"], row["refers_to"]) == (5, "ü<p>".encode(), "response", None)
    archive = warc.member(data) + warc.member(warc.revisit(6, None, 200, "0" * 64, 5))
    assert len(list(warc.members(io.BytesIO(archive)))) == 2
    again = warc.parse(list(warc.members(io.BytesIO(archive)))[1])
    assert (again["record_type"], again["refers_to"], again["payload_bytes"], again["payload"]) == ("revisit", 5, 200, b"")
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(archive[:-5])))
    with pytest.raises(zlib.error):
        list(warc.members(io.BytesIO(archive[:40] + b"\x00\x01" + archive[42:])))
    with pytest.raises(ValueError):
        warc.parse(data.replace(b"<p>", b"<q>"))
    with pytest.raises(ValueError):
        warc.parse(data[:-3])


def test_language_codes():
    for n in (1, 2, 3, 5, 9, 40):
        code = langid.codewords(n)
        assert code.shape[0] == n and len({tuple(r) for r in code}) == n
    assert langid.fit(np.zeros((0, langid.FEATURES), np.float32), []).predict(np.zeros((2, langid.FEATURES)))[0][0] == "und"
    assert not langid.has_letter("12 ½ -_!") and langid.has_letter("1 é")


def test_quality_rules_find_a_conjunction():
    rng = np.random.default_rng(8)
    x = {k: rng.random(3000) for k in "abcd"}
    y = ((x["a"] > 0.4) & (x["b"] <= 0.7)).astype(float)
    m = quality.fit(x, y)
    p = m.probability(x, 3000)
    assert ((p >= 0.5) == (y > 0)).mean() > 0.97
    assert quality.fit({k: v[:0] for k, v in x.items()}, y[:0]).rules == []
    assert quality.fit(x, np.ones(3000)).rules == []


def test_toxicity_locates_sentences():
    rng = random.Random(5)
    fill = [f"w{k}" for k in range(200)]
    texts, labels = [], []
    for k in range(600):
        s = [" ".join(rng.choices(fill, k=8)) for _ in range(5)]
        if k % 4 == 0:
            s[rng.randrange(5)] += rng.choice([" vileword", " nastyword"])
        texts.append(". ".join(s).encode())
        labels.append(int(k % 4 == 0))
    m = toxicity.fit(texts, np.array(labels))
    assert m.document(b"w1 w2. w3 NASTYWORD w4. w5") > 0.5 > m.document(b"w1 w2. w3 w4. w5")
    spans = m.offending("w1 w2. w3 nastyword w4. w5")
    assert [("w1 w2. w3 nastyword w4. w5")[s["start"] : s["end"]] for s in spans] == [" w3 nastyword w4"]
    assert toxicity.fit([], np.array([])).document(b"x") == 0.0 and m.document(None) == 0.0
    # all sentences count: noisy-or over every one of them, the plain ones too, which a million of leave harmless
    for text in (b"w1 w2. w3 NASTYWORD w4. w5", b"w1. w2 nastyw. vileword w3", b"w1. " * 1000):
        harmless = [1 - m.sentence(words) for words in toxicity.sentences(text)]
        assert m.document(text) == pytest.approx(1 - np.prod(harmless), abs=1e-9) and m.document(text) > 0
    assert m.document(b"w1. " * 1_000_000) < 0.2
