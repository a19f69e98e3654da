"""The training-data operators on Spark: against SQL, brute force and round trips, with nulls, ties, empty tables and odd columns."""

import random
import re
import zlib
from collections import Counter
from math import inf

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import compare
from sigscan.llm import decontam, embeddings, langid, mixing, quality, queries, simhash, tokencount, tokens, toxicity, warc
from sigscan.llm.common import components
from sigscan.session import table

VOCABULARY = "word_bpe_49k.json"
LONG = "lorem ipsum dolor sit amet " * 60_000


def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns with clashing names."""
    rows = [(1, "a b c d e", "en", "s1"), (1, "a b c d e", "en", "s1"), (2, None, None, None), (3, "", "en", None), (None, "a b c d e", "de", "s2"), (4, "A B C D E", None, "s1"), (5, LONG, "en", "s2"), (6, " \t\n", "", ""), (7, "12 ½ …", "en", "s2")]
    return spark.createDataFrame([(*r, 9, "x", 1.0) for r in rows], "doc_id long, text string, lang string, source string, size int, fp string, score double")


def empty(spark):
    return odd(spark).where("false")


def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf, name):
    compare(spark, sf, queries.QUERIES[name], queries.ORACLES[name])


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1300)] + [(2000, k) for k in range(2001, 2100)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "u long, v long").repartition(7)
    got = {r.node: r.root for r in components(df).collect()}
    nodes = {x for u, v in edges if u != v for x in (u, v)}
    assert got == {x: find(x) for x in nodes}


# ---- 1


def test_decontamination_blocks_and_odd_rows(spark):
    bench = spark.createDataFrame([(1, "a b c", 0), (1, "d e", 0), (None, "lorem ipsum", 0), (2, None, 0), (3, "", 0), (4, " ".join(f"w{k}" for k in range(20)), 0)], "item_id long, text string, doc_id int")
    items = [(r.item_id, r.text) for r in bench.collect()]
    one = decontam.digest_rows(decontam.decontaminate(odd(spark), bench))
    many = decontam.digest_rows(decontam.decontaminate(odd(spark), bench, block_bytes=20, shard_words=3))
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert key(one) == key(many)
    want = sorted([(r.doc_id, *decontam.brute_force(r.text, items)) for r in odd(spark).where("doc_id is null or doc_id <> 5").collect()], key=str)
    assert sorted([tuple(r) for r in one.where("doc_id is null or doc_id <> 5").collect()], key=str) == want
    assert one.where("doc_id = 5").first().n_hit == 120_000
    spans = decontam.decontaminate(odd(spark), bench).where("doc_id = 4").first().spans
    assert [(s.start, s.end) for s in spans] == [(0, 9)]
    kept = decontam.drop_contaminated(odd(spark), bench)
    assert kept.columns == odd(spark).columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 6, 7]
    assert decontam.decontaminate(empty(spark), bench).count() == 0
    assert decontam.decontaminate(odd(spark), bench.where("false")).where("n_hit > 0 or contaminated").count() == 0


# ---- 2


def test_mixing_properties(spark, sf):
    got = mixing.mix(table(spark, sf, "documents"), block_words=100).collect()
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault(r.source, [r.source_size, r.target, 0])[2] += r.taken
    for size, target, taken in by.values():
        assert target <= 2 * size and abs(taken - target) <= 0.5
    assert sum(t for _, t, _ in by.values()) == pytest.approx(1.5 * sum(s for s, _, _ in by.values()))
    again = mixing.mix(table(spark, sf, "documents").repartition(5), block_words=100).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_schedule_is_low_discrepancy(spark):
    goals = spark.createDataFrame([("a", 50_000, 60_000.0), (None, 10_000, 15_000.0), ("b", 40, 77.0), ("z", 0, 0.0)], "source string, source_size long, target double")
    slots = mixing.schedule(goals, 100).orderBy("slot").collect()
    words, seen = {}, {}
    for r in slots:
        words[r.source] = words.get(r.source, 0) + r.words
        assert r.rank == seen.get(r.source, 0) and 0 < r.words <= 100
        seen[r.source] = r.rank + 1
    assert words == {"a": 60_000, None: 15_000, "b": 77}
    # in the first half of the slots each large source has its share
    half = [r.source for r in slots if r.slot < 376]
    assert abs(half.count("a") - 300) <= 4 and abs(half.count(None) - 75) <= 4


def test_step_changes_the_order_and_never_the_totals(spark, sf):
    docs = table(spark, sf, "documents")
    a, b = (mixing._mix(docs, block_words=100, step=s).drop("bucket", "place").collect() for s in (mixing.STEP, mixing.STEP - 12_345_678))
    totals = lambda rows: sorted((r.doc_id, r.size, r.target, r.taken) for r in rows)
    assert totals(a) == totals(b) and {r.doc_id: r.slots for r in a} != {r.doc_id: r.slots for r in b}
    with pytest.raises(ValueError, match="poor"):
        mixing.mix(docs, block_words=100, step=1).collect()


def test_points_of_large_slots(spark):
    slots = [0, 1, (1 << 20) - 1, 1 << 20, (1 << 32) + 7, (1 << 39) + 12_345]
    got = spark.createDataFrame([(s,) for s in slots], "s long").select("s", mixing.point(F.col("s")).alias("p")).collect()
    assert {r.s: r.p for r in got} == {s: s * mixing.STEP % mixing.TURN for s in slots}
    # three points for each slot leave no share of one slot without a point, wherever it lies
    for n in (10, 1000, 30_000):
        p = np.sort([s * mixing.STEP % mixing.TURN for s in range(n)])
        assert np.diff([*p, p[0] + mixing.TURN]).max() < 2 * mixing.TURN / n


def test_mixed_documents_come_in_the_order_of_the_schedule(spark, sf):
    docs = table(spark, sf, "documents").withColumn("__slot", F.lit("mine"))
    rows = mixing._mix(table(spark, sf, "documents"), block_words=50)
    want = sorted((s, r.h, r.doc_id) for r in rows.collect() for s in (r.slots or [])[: int(r.taken / max(r.size, 1) + 0.5)])
    got = mixing.mixed_documents(docs, block_words=50)
    assert got.columns == docs.columns and [r.doc_id for r in got.collect()] == [i for _, _, i in want]
    # sources alternate: the first half of the mix has about half of each source's rows
    order = [r.source for r in got.collect()]
    for s in set(order):
        assert order.count(s) < 20 or abs(order[: len(order) // 2].count(s) / order.count(s) - 0.5) < 0.25


def test_two_texts_of_one_id_are_taken_apart(spark):
    rows = [(1, "w " * 50, "a"), (1, "v " * 10, "a"), (2, "u " * 40, "b")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id int, text string, source string, h int")
    takes = {r.h: (r.taken, r.size) for r in mixing._mix(df, block_words=7).collect()}
    texts = [r.text for r in mixing.mixed_documents(df, block_words=7).collect()]
    for r in df.select("text", mixing.row_hash(F.col("doc_id"), F.col("text")).alias("h")).collect():
        taken, size = takes[r.h]
        assert texts.count(r.text) == int(taken / size + 0.5)


def test_text_that_looks_like_an_id_and_a_text(spark):
    df = spark.createDataFrame([(None, "5|x y z", "a"), (5, "x y z", "a"), (6, "w", "b")], "doc_id long, text string, source string")
    taken = {(r.doc_id, r["size"]): r.taken for r in mixing.mix(df, block_words=2).collect()}
    got = Counter((r.doc_id, r.text) for r in mixing.mixed_documents(df, block_words=2).collect())
    assert got[None, "5|x y z"] == int(taken[None, 3] / 3 + 0.5) and got[5, "x y z"] == int(taken[5, 3] / 3 + 0.5)


def test_mixing_odd_rows(spark):
    rows = mixing.mix(odd(spark), block_words=3)
    got = {(r.doc_id, r.source): r for r in rows.collect()}
    assert rows.count() == 9 and got[(2, None)].size == 0 and got[(2, None)].taken == 0 and got[(5, "s2")].size == 300_000
    mixed = mixing.mixed_documents(odd(spark), block_words=3)
    assert mixed.columns == odd(spark).columns and mixed.where("doc_id = 2").count() == 0
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed_documents(empty(spark)).count() == 0


# ---- 3, 9, 10


@pytest.fixture(scope="module")
def medium():
    return "/root/testdata/sf0.01"


def crc(i):
    return zlib.crc32(str(i).encode())


def test_quality_held_out(spark, medium):
    got = {r.doc_id: r for r in queries.op3_quality(spark, medium).collect()}
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (crc(r.doc_id) % 4 == 2) for r in got.values())
    held = [(r.quality, got[r.doc_id].predicted) for r in table(spark, medium, "labels").collect() if crc(r.doc_id) % 4 == 2]
    assert np.mean([a == b for a, b in held]) > 0.93


def test_quality_column_equals_model_and_is_jvm_only(spark, medium):
    docs, labels = table(spark, medium, "documents"), table(spark, medium, "labels")
    model = quality.train(docs, labels)
    assert 0 < len(model.rules) < 120
    df = docs.select(*[c.alias(s) for s, c in quality.statistics(F.col("text")).items()], "doc_id").toPandas()
    p = dict(zip(df["doc_id"], model.probability({s: df[s].to_numpy() for s in df.columns}, len(df)), strict=True))
    scored = quality.score(docs, model)
    assert all(abs(r.score - p[r.doc_id]) < 1e-9 for r in scored.collect())
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_language_held_out(spark, medium):
    rows = {r.doc_id: r for r in queries.op9_language(spark, medium).collect()}
    true = {r.doc_id: r.lang for r in table(spark, medium, "documents").select("doc_id", "lang").collect()}
    held = [i for i in true if crc(i) % 3 == 1]
    assert all(rows[i].held_out == (crc(i) % 3 == 1) for i in true)
    assert np.mean([rows[i].lang_pred == true[i] for i in held]) > 0.97


def test_toxicity_held_out(spark, medium):
    rows = {r.doc_id: r for r in queries.op10_toxicity(spark, medium).collect()}
    held = [(r.toxic, rows[r.doc_id].predicted) for r in table(spark, medium, "labels").collect() if crc(r.doc_id) % 5 == 0]
    assert np.mean([a == b for a, b in held]) > 0.93
    assert all(r.predicted == int(r.score >= 0.5) and r.held_out == (crc(r.doc_id) % 5 == 0) for r in rows.values())


def test_toxicity_learns_from_long_texts(spark):
    text = F.concat(F.repeat(F.lit("plain words here. "), 80_000), F.when(F.col("doc_id") % 2 == 1, "you vile grub ").otherwise("you kind friend "), F.col("doc_id").cast("string"))
    docs = spark.range(8).select(F.col("id").alias("doc_id")).withColumn("text", text)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    model = toxicity.train(docs, labels, usable=F.lit(True))
    assert {b"vile", b"grub"} <= set(model.weights)
    rows = {r.doc_id: r for r in toxicity.score(docs, model, offending=True).collect()}
    assert {i for i, r in rows.items() if r.predicted} == {1, 3, 5, 7}
    assert [(s.start, s.end) for s in rows[1].offending] == [(18 * 80_000 - 1, 18 * 80_000 + 15)] and rows[2].offending == []


def plain_toxicity(texts, labels):
    """The model from its definition: dense matrices, a loop over documents, the same steps."""
    import math

    def parts(text):
        lines = re.split(rb"[.!?\n\r]", text.encode())
        bags = []
        for line in lines:
            words = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in line).split()
            if words:
                bags.append({w for w in words} | {b"^" + w[:k] for w in words for k in (4, 6) if len(w) > k})
        return bags

    bags, pos, neg = [parts(t) for t in texts], sum(labels), len(labels) - sum(labels)
    has = lambda f, y: sum(any(f in b for b in bag) for bag, v in zip(bags, labels) if v == y)
    seen = {f for bag, v in zip(bags, labels) if v for b in bag for f in b}
    odds = {f: math.log((has(f, 1) + 0.5) / (pos + 1)) - math.log((has(f, 0) + 0.5) / (neg + 1)) for f in sorted(seen) if has(f, 1) >= 3}
    names = [f for f in sorted(odds) if odds[f] > 1]
    w, b, m, v = np.array([2 * odds[f] for f in names]), -16.0, np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    x = [[np.array([float(f in s) for f in names]) for s in bag] for bag in bags]
    for t in range(1, 201):
        grad = np.zeros(len(names) + 1)
        for sentences, y in zip(x, labels):
            p = [1 / (1 + math.exp(-max(-60, min(60, b + s @ w)))) for s in sentences]
            q = min(max(-math.expm1(sum(math.log1p(-min(k, 1 - 1e-16)) for k in p)), 1e-12), 1 - 1e-9)
            for s, k in zip(sentences, p):
                grad += np.append(s, 1.0) * k * (neg / pos * (1 / q - 1) if y else -1)
        grad[:-1] -= 0.02 * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = np.maximum(w + step[:-1], 0), min(b + step[-1], -16.0)
    weights = dict(zip(names, w))

    def score(text):
        safe = 1.0
        for s in parts(text):
            safe *= 1 - 1 / (1 + math.exp(-(b + sum(weights.get(f, 0) for f in s))))
        return 1 - safe

    return score


def test_toxicity_equals_brute_force(spark):
    rng = random.Random(11)
    fill = ["the", "Water", "stone", "garden", "evening", "river", "letter", "window"]
    rows = []
    for k in range(60):
        said = [" ".join(rng.choices(fill, k=6)) for _ in range(3)]
        if k % 3 == 0:
            said[rng.randrange(3)] += " " + rng.choice(["vilest", "vileness grub", "Grub", "gnarls"])
        rows.append((k, "! ".join(said), int(k % 3 == 0)))
    docs, labels = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    learned = [(i, t, y) for i, t, y in rows if crc(i) % 5]
    plain = plain_toxicity([t for _, t, _ in learned], [y for *_, y in learned])
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert all(got[i] == pytest.approx(plain(t), abs=1e-6) for i, t, _ in rows)


def test_quality_score_equals_brute_force(spark, medium):
    """Statistics by plain Python, rules by plain Python: the compiled expression agrees on every text."""
    docs = table(spark, medium, "documents")
    model = quality.train(docs, table(spark, medium, "labels"))

    def stats(t):
        t, n = t or "", max(len(t or ""), 1)
        words, lines = re.split("[ \t\n\r]+", t), t.split("\n")
        share = lambda p: len(re.findall(p, t)) / n
        return {
            "log_length": np.log1p(len(t)), "word_length": n / len(words), "distinct_words": len(set(words)) / len(words), "line_length": np.log1p(n / len(lines)), "distinct_lines": len(set(lines)) / len(lines),
            "capitals": share("[A-Z]"), "digits": share("[0-9]"), "symbols": share(r"[#$%&*+=<>^~@\\/{}\[\]_]"), "bars": share("[|]"), "shouts": share("[!?]"), "stops": share("[.,;:]"),
        }

    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    for r in docs.collect():
        x, z = stats(r.text), model.bias
        for rule, w in model.rules:
            z += w * all((x[s] > v) if up else (x[s] <= v) for s, up, v in rule.parts)
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9), r.doc_id


def plain_language(text, model):
    """The decoding from its definition: n-gram shares by a loop, every codeword's weighted loss."""
    import math

    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    data = b" " + b" ".join(bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in text.lower().encode()).split()) + b" "
    m32, seen = (1 << 32) - 1, {}
    for n in (1, 2, 3):
        for i in range(len(data) - n + 1):
            h = data[i] * 2654435761 & m32
            for k in range(1, n):
                h = ((h ^ h >> 15) * (2246822519, 3266489917)[k - 1] + data[i + k] * 2654435761) & m32
            seen[h >> 20] = seen.get(h >> 20, 0) + 1
    total, x = sum(seen.values()), np.zeros(4096)
    for h, c in seen.items():
        x[h] = np.float32(math.sqrt(c / total))
    margins = [float(x @ model.weights[:, j] + model.bias[j]) for j in range(model.code.shape[1])]
    losses = [sum(t * math.log1p(math.exp(-m * bit)) for t, m, bit in zip(model.trust, margins, row)) for row in model.code]
    e = [math.exp(-v) for v in losses]
    best = max(range(len(e)), key=lambda k: (e[k], -k))
    return model.languages[best], e[best] / sum(e)


def test_language_equals_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    model = langid.train(docs)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    for r in docs.collect():
        lang, score = plain_language(r.text, model)
        assert got[r.doc_id].lang_pred == lang and got[r.doc_id].score == pytest.approx(score, abs=1e-5)


def test_every_language_is_learned(spark):
    """More languages than the sample has rows, one of them a third of all rows under one id."""
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    rows = [(k, " ".join(alphabet[(k + j) % 26] * 3 + alphabet[(k * 7 + j) % 26] for j in range(30)), f"l{k % 40:02d}") for k in range(400)]
    rows += [(1000, "hot text of one id", "hot")] * 200
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, rows=20, usable=F.lit(True))
    assert model.languages == sorted({r[2] for r in rows})


def test_held_out_languages_are_not_learned(spark, sf):
    docs = table(spark, sf, "documents")
    flipped = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, "xx").otherwise(F.col("lang")))
    a, b = langid.train(docs), langid.train(flipped)
    assert a.languages == b.languages and (a.weights == b.weights).all()


def test_contradicting_labels_each_count(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (1, None), (2, 1), (None, 1)], "doc_id long, toxic int")
    got = sorted((r.text, r.label) for r in toxicity.sample(docs, labels, "toxic", F.lit(True), 100).collect())
    assert got == [("a b", 0), ("a b", 1), ("c", 0), ("c", 1)]
    assert toxicity.sample(docs, labels, "toxic", F.lit(True), 100).count() == 4


def test_classifiers_on_odd_rows(spark, medium):
    docs, labels = table(spark, medium, "documents"), table(spark, medium, "labels")
    q, t, g = quality.train(docs, labels), toxicity.train(docs, labels), langid.train(docs)
    assert quality.score(odd(spark), q).where("score is null or score < 0 or score > 1").count() == 0
    assert quality.score(odd(spark), q).count() == 9
    tox = toxicity.score(odd(spark), t, offending=True).collect()
    assert len(tox) == 9 and all(r.score == 0 and r.offending == [] for r in tox if r.doc_id in (2, 3, 6))
    lang = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(odd(spark), g).collect()}
    assert [lang[k] for k in (2, 3, 6, 7)] == [("und", 0.0)] * 4 and lang[5][0] in ("en", "de", "fr", "es")
    for f, m in ((quality.score, q), (toxicity.score, t), (langid.identify, g)):
        assert f(empty(spark), m).count() == 0
    kept = toxicity.drop_toxic(odd(spark), t)
    assert kept.columns == odd(spark).columns and kept.count() == 9
    # nothing to learn from
    assert quality.score(odd(spark), quality.train(docs, no_labels(spark))).first().score == 0.5
    assert toxicity.score(odd(spark), toxicity.train(docs, no_labels(spark))).agg(F.max("score")).first()[0] == 0
    assert {r.lang_pred for r in langid.identify(odd(spark), langid.train(empty(spark))).collect()} == {"und"}


def test_held_out_labels_are_not_learned(spark, medium):
    docs, labels = table(spark, medium, "documents"), table(spark, medium, "labels")
    flip = lambda n, r, c: labels.withColumn(c, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % n == r, 1 - F.col(c)).otherwise(F.col(c)))
    assert quality.train(docs, flip(4, 2, "quality")) == quality.train(docs, labels)
    a, b = toxicity.train(docs, flip(5, 0, "toxic")), toxicity.train(docs, labels)
    assert (a.weights, a.bias) == (b.weights, b.bias)


# ---- 4


def brute_vectors(rows, least=0.98):
    ok = [(k, i, np.array(e, float), l) for k, (i, e, l) in enumerate(rows) if i is not None and l is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    links = {k: set() for k, *_ in ok}
    for a in ok:
        for b in ok:
            if a[0] != b[0] and a[3] == b[3] and len(a[2]) == len(b[2]) and a[2] @ b[2] / np.sqrt((a[2] @ a[2]) * (b[2] @ b[2])) >= least:
                links[a[0]].add(b[0])
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for y in links.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        c = min((rows[x][0] for x in seen if rows[x][0] is not None), default=None)
        out.append((i, len(links.get(k, ())), c if i is not None else None, i is not None and c == i))
    return out


@pytest.mark.parametrize("cell", [5, 16, 4096])
def test_near_vectors_equal_brute_force(spark, cell):
    rng = np.random.default_rng(7)
    centers, rows = rng.normal(size=(14, 12)), []
    for k in range(220):
        v = centers[rng.integers(14)] + rng.normal(size=12) * rng.choice([0.0, 0.02, 0.1, 0.2])
        rows.append((k * 3 % 223, [float(np.float32(x)) for x in v * rng.choice([1, 2, 0.5])], int(rng.choice([0, 0, 0, 1, 2]))))
    rows += [(900, None, 0), (901, [0.0] * 12, 0), (902, [1.0, None], 0), (903, [float("nan")] * 12, 0), (904, [float("inf")] * 12, 0), (905, [1.0] * 3, 0), (906, rows[0][1], None), (None, rows[0][1], 0), (907, [], 0), (908, [2.0] * 3, 0), (909, [-0.0, 1.0, 0.0], 0), (910, [0.0, 1.0, 0.0], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, key string").repartition(5)
    got = sorted([tuple(r) for r in embeddings.near_vectors(df, cell=cell).collect()], key=str)
    assert got == sorted(brute_vectors(rows), key=str)
    assert embeddings.near_vectors(df.where("false")).count() == 0


def test_cell_that_holds_only_its_pivot(spark):
    """Uneven noise around one direction a label: outliers prefer a central pivot, so that an outlying pivot, the first one too, is alone in its cell."""
    rng, rows = np.random.default_rng(4), []
    for k in range(600):
        c, noise = np.random.default_rng(k // 100).normal(size=32), rng.normal(size=32)
        rows.append((k, (c / np.linalg.norm(c) + noise / np.linalg.norm(noise) * rng.choice([0.001, 0.15])).tolist(), k // 100))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted([tuple(r) for r in embeddings.near_vectors(df, cell=30).collect()], key=str)
    assert got == sorted(brute_vectors(rows), key=str)


@pytest.mark.parametrize("seeds", [range(0, 7), range(7, 14), range(14, 20)])
def test_planted_links_of_many_seeds(spark, seeds):
    """Small cells and tiles; a label for each seed: clusters of several widths, a pair at the very threshold, copies, a lone outlier."""
    rows = []
    for seed in seeds:
        rng = np.random.default_rng(seed)
        centers = rng.normal(size=(4, 8))
        for k in range(76):
            v = centers[k % 4] + rng.normal(size=8) * rng.choice([0.0, 0.01, 0.1, 0.3])
            rows.append((seed * 1000 + k, v.tolist(), seed))
        edge = np.zeros(8)
        edge[0], edge[1] = 0.98, np.sqrt(1 - 0.98**2)
        rows += [(seed * 1000 + 90, [1.0] + [0.0] * 7, seed), (seed * 1000 + 91, (edge * 3).tolist(), seed), (seed * 1000 + 92, [-1.0] + [0.0] * 7, seed)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    want = sorted(brute_vectors(rows), key=str)
    for cell, tile in ((2, 8 * 8 * 5), (9, 8 * 8 * 1000)):
        assert sorted([tuple(r) for r in embeddings.near_vectors(df, cell=cell, tile_bytes=tile).collect()], key=str) == want


def test_query_deals_by_pivots_and_finds_planted_links(spark, tmp_path):
    """The registered query with its own parameters on labels large enough for several cells."""
    rng, rows = np.random.default_rng(1), []
    for k in range(900):
        v = rng.normal(size=16) if k % 3 or k < 9 else np.array(rows[k - 9][1]) + rng.normal(size=16) * 0.05
        rows.append((k, [float(np.float32(x)) for x in v], k % 2))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    _, found = embeddings.nodes(df)
    assert found.schema["vector"].dataType.elementType.typeName() == "float"
    assert embeddings.cells(found, 0.2).select("cell").distinct().count() == 4
    got = sorted([tuple(r) for r in queries.op4_near_vectors(spark, str(tmp_path)).collect()], key=str)
    assert got == sorted(brute_vectors(rows), key=str) and sum(r[1] > 0 for r in got) > 200


def test_pivots_replicate_less_than_all_pairs(spark):
    """Tight clusters: the triangle inequality keeps a vector out of most cells."""
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(40, 16))
    rows = [(k, (centers[k % 40] + rng.normal(size=16) * 0.01).tolist(), 0) for k in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    _, found = embeddings.nodes(df)
    dealt = embeddings.cells(found, 0.2, cell=30)
    assert dealt.where("home").count() == 1200 and dealt.count() < 8 * 1200


# ---- 5


def test_warc_round_trip(spark):
    big = "<html>" + "x" * 200
    rows = [(3, "u", big), (1, "u1", big), (1, "u1", big), (7, None, None), (8, "u", "short"), (9, "u", "short"), (None, "u", big), (4, "é \r\n", "ä" * 60), (2, "u", "ä" * 60)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    for threshold in ("10m", "-1"):  # by broadcast and by shuffle
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        archives = warc.write_warc(df, warc.shared_path(spark, "w"))
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        got = sorted([(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_warc(archives).collect()], key=str)
        assert got == sorted([(3, 206, "revisit", 1), (1, 206, "response", None), (1, 206, "response", None), (7, 0, "response", None), (8, 5, "response", None), (9, 5, "response", None), (None, 206, "revisit", 1), (4, 120, "revisit", 2), (2, 120, "response", None)], key=str)
        assert {bytes(r.payload) for r in warc.read_warc(archives, payload=True).where("page_id = 1").collect()} == {big.encode()}
    assert warc.warc_round_trip(df.where("false")).count() == 0


# ---- 6


def brute_simhash(rows, radius=2):
    fps = [simhash.fingerprint(t.encode() if t is not None else None) % (1 << 64) for _, t in rows]
    label = list(range(len(rows)))
    moved = True
    while moved:
        moved = False
        for a in range(len(rows)):
            for b in range(a):
                if rows[a][0] is not None and rows[b][0] is not None and label[a] != label[b] and (fps[a] ^ fps[b]).bit_count() <= radius:
                    label[a] = label[b] = min(label[a], label[b])
                    moved = True
    least = {}
    for (i, _), c in zip(rows, label, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return sorted([(i, f"{fps[k]:016x}", least[label[k]] if i is not None else None) for k, (i, _) in enumerate(rows)], key=str)


@pytest.mark.parametrize(("lanes", "tile"), [(1, 4), (2, 32768), (4, 2), (8, 64)])
def test_simhash_equals_brute_force(spark, lanes, tile):
    rng = random.Random(3)
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(150)) for _ in range(12)]
    rows = [(k, base[k % 12] if k % 3 else base[k % 12] + f" end{k % 5}") for k in range(70)] + [(100, None), (101, ""), (102, "a b"), (102, "a b"), (None, "a b"), (103, base[0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int").repartition(3)
    got = simhash.simhash_components(df, lanes=lanes, tile=tile).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute_simhash(rows)


def test_links_within_two_bits_are_all_found(spark):
    rng = np.random.default_rng(9)
    seeds = rng.integers(-(2**62), 2**62, 40)
    fps = {int(s) for s in seeds}
    for s in seeds:
        for _ in range(6):
            x = int(s) % (1 << 64)
            for b in rng.choice(64, rng.integers(1, 4), replace=False):
                x ^= 1 << int(b)
            fps.add(x - (1 << 64) if x >= 1 << 63 else x)
    fps = sorted(fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for lanes in (1, 2, 4, 8):
        got = {r.node: r.root for r in components(simhash.links(df, lanes=lanes, tile=8)).collect()}
        for a in fps:
            for b in fps:
                if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 2:
                    assert got[a] == got[b]


def test_simhash_dedup_keeps_one_of_each_group(spark):
    kept = simhash.simhash_dedup(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted([1, 2, 5, 7, None], key=str)
    assert simhash.simhash_dedup(empty(spark)).count() == 0


def test_simhash_dedup_by_row_where_ids_repeat(spark):
    """A text goes with its own copies, not with another text under the same doc_id."""
    a, b, c, d = (" ".join(random.Random(k).choices("one two three four five six".split(), k=80)) for k in range(4))
    rows = [(1, a), (2, a), (2, b), (3, b), (5, c), (5, d), (6, d), (7, c), (7, c), (None, a)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id int, text string, fp string").repartition(3)
    kept = simhash.simhash_dedup(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, a), (2, b), (5, c), (5, d), (None, a)], key=str)


# ---- 7, 8


def test_token_output_round_trip(spark):
    path = queries.vocabulary(VOCABULARY)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    texts = {r.doc_id: r.text for r in odd(spark).where("doc_id is null or doc_id <> 5").collect()}
    got = sorted(tokens.token_output(odd(spark), path).collect(), key=lambda r: r.start)
    assert len(got) == 9 and [r.doc_id for r in got] == [None, 1, 1, 2, 3, 4, 5, 6, 7]
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
        ids = [*t.encode((LONG if r.doc_id == 5 else texts[r.doc_id]) or "", add_special_tokens=False).ids, 1]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert tokens.token_output(empty(spark), path).count() == 0


def test_encoder_equals_library(sf):
    import pyarrow.parquet as pq

    e = tokens.Encoder(queries.vocabulary(VOCABULARY), cache_chunks=500)
    assert e.direct
    texts = ["It's a TEST's don't 'S", "a\x1cb !\x1c! ", "é́ é İstanbul ẞ ΑΣ <|endoftext|>x y<|startoftext|>", "a b\u0085c d", "½²3٣", "naïve,, x. y., ...", "", "ab" * 200, "x!! y*** z's, 'tis l'été, don't!"]
    rng = random.Random(8)
    texts += ["".join(rng.choice("abÀéß'.,!? \n-_#1２ſ́’xyzẞ<|>") for _ in range(60)) for _ in range(400)]
    texts += pq.read_table(f"{sf}/documents.parquet").column("text").to_pylist()
    for x in texts:
        assert e.encode(x.encode()).tolist() == e.whole(x), x[:80]


def test_token_counts_on_odd_rows(spark):
    path = queries.vocabulary("piece_bpe_32k.model")
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in tokencount.count_tokens(odd(spark), path).collect()}
    assert got[2] == got[3] == got[6] == (0, 0) and got[1] == (5, 5) and got[5][0] == 300_000
    assert tokencount.count_tokens(empty(spark), path).count() == 0
    fitted = tokencount.fit(odd(spark), path)
    assert np.isfinite(fitted).all() and abs(np.exp(fitted).sum() - 1) < 1e-9
    assert len(set(tokencount.fit(empty(spark), path))) == 1


def test_every_round_of_token_counts_reads_all_pretokens(spark, monkeypatch):
    """More distinct pre-tokens than a sample would hold, and one longer than those that are kept."""
    docs = spark.range(150).select(F.concat_ws(" ", F.lit("z" * (tokencount.LONG + 1)), F.transform(F.sequence(F.col("id") * 1000, F.col("id") * 1000 + 999), lambda k: F.concat(F.lit("w"), k.cast("string")))).alias("text"))
    read = []
    monkeypatch.setattr(tokencount, "step", lambda words, vocabulary, scores: read.append(tuple(words.agg(F.count("*"), F.sum("n")).first())) or scores)
    tokencount.fit(docs, queries.vocabulary("piece_bpe_32k.model"))
    assert read == [(150_001, 150_150)] * (tokencount.ROUNDS + 1)


def test_token_counts_equal_plain_training_and_counting(spark, sf, monkeypatch):
    """The whole query against pieces in a dictionary, each pre-token segmented alone."""
    import pyarrow.parquet as pq
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))
    rank = {}
    for k in range(len(p)):
        if not (p.is_control(k) or p.is_unknown(k) or p.is_byte(k) or p.is_unused(k)):
            rank.setdefault(p.id_to_piece(k), len(rank))
    longest = max(map(len, rank))
    docs = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    words = Counter(w for d in docs for w in re.split("[ \t-\r]+", d["text"] or "") if w)

    def segment(word, scores, unknown):
        word = "▁" + word
        best = [(0.0, [])]
        for end in range(1, len(word) + 1):
            found = (-inf, 0, None)
            for begin in range(max(0, end - longest), end):
                piece = rank.get(word[begin:end])
                if piece is not None:
                    found = max(found, (best[begin][0] + scores[piece], begin, piece))
            alone = best[end - 1][0] + unknown * (n := len(word[end - 1].encode()))
            best.append((alone, best[end - 1][1] + [-1] * n) if alone > found[0] else (found[0], best[found[1]][1] + [found[2]]))
        return best[-1][1]

    scores, likelihood = -np.log(np.arange(len(rank)) + 2.0), []
    for _ in range(tokencount.ROUNDS + 1):
        used, unknown = Counter(), scores.min() - 10
        for w, n in words.items():
            for piece in segment(w, scores, unknown):
                used[piece] += n
        likelihood.append(sum(n * (scores[k] if k >= 0 else unknown) for k, n in used.items()))
        n = np.array([used[k] for k in range(len(rank))]) + tokencount.SMOOTH
        scores = np.log(n / n.sum())
    assert likelihood[1:] == sorted(likelihood[1:])  # the scores before training are no probabilities
    monkeypatch.setattr(tokencount, "ROUND_BYTES", 20_000)
    assert tokencount.fit(spark.read.parquet(f"{sf}/documents.parquet"), queries.vocabulary("piece_bpe_32k.model")).tolist() == scores.tolist()
    n = {w: len(segment(w, scores, scores.min() - 10)) for w in words}
    want = [[w for w in re.split("[ \t-\r]+", d["text"] or "") if w] for d in docs]
    got = sorted(tuple(r) for r in queries.QUERIES["op8_token_counts"](spark, sf).collect())
    assert got == sorted((d["doc_id"], len(ws), sum(n[w] for w in ws)) for d, ws in zip(docs, want, strict=True))


# ---- pipeline


def brute_times(rows):
    """How often each document is taken, from the contract alone: water filling, then running sums along the hash line."""
    import hashlib

    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    sources = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[r.doc_id] for r in rows if r.source == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    target, open_, left = {}, set(sources), 1.5 * sum(total.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * total[s]}
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: 2.0 * total[s] for s in full}
        left -= sum(2 * total[s] for s in full)
        open_ -= full
        if not open_:
            break
    out = {}
    for s in sources:
        at, goal = 0, round(target[s])
        for _, i in sorted((hashlib.md5(f"{r.doc_id}|{r.text}".encode()).hexdigest(), r.doc_id) for r in rows if r.source == s):
            n = size[i]
            taken = sum(max(0, min(n, goal - turn * total[s] - at)) for turn in (0, 1))
            out[i] = int(taken / max(n, 1) + 0.5)
            at += n
    return out


def test_pipeline_equals_brute_force(spark, sf):
    import corpus_pipeline as cp

    docs = {r.doc_id: r for r in table(spark, sf, "documents").collect()}
    model = toxicity.train(table(spark, sf, "documents"), table(spark, sf, "labels"))
    left = {i: r for i, r in docs.items() if model.document(r.text.encode()) < 0.5}
    classes = {i: c for i, _, c in brute_simhash([(i, r.text) for i, r in left.items()])}
    left = {i: r for i, r in left.items() if classes[i] == i}
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    left = {i: r for i, r in left.items() if not decontam.brute_force(r.text, items)[-1]}
    rows = spark.createDataFrame([tuple(left[i]) for i in left], table(spark, sf, "documents").schema)
    times = brute_times(list(left.values()))
    from tokenizers import Tokenizer

    t, want, at = Tokenizer.from_file(queries.vocabulary(VOCABULARY)), [], 0
    for i in sorted(left):
        ids = [*t.encode(left[i].text, add_special_tokens=False).ids, 1]
        for _ in range(times[i]):
            want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
    got = sorted(tuple(r) for r in cp.run(spark, sf).collect())
    assert len(left) < len(docs) and got == sorted(want)


def test_stages_on_odd_and_empty_tables(spark, sf):
    import corpus_pipeline as cp

    want = {  # doc_ids that stay, by the stages' docstrings
        "toxicity": [1, 1, 2, 3, 4, 5, 6, 7, None],
        "simhash_near_dedup": [1, 2, 5, 7, None],
        "decontamination": [1, 1, 2, 3, 4, 5, 6, 7, None],
    }
    clash = odd(spark).withColumn("__key", F.lit(1)).withColumn("__slot", F.lit(2)).withColumn("__hash", F.lit("h"))
    for name, stage in cp.STAGES:
        for docs in (odd(spark), clash):
            got = stage(spark, docs, sf)
            ids = sorted((r.doc_id for r in got.collect()), key=lambda x: (x is None, x or 0))
            if name == "token_output":
                assert len(ids) == 9
                continue
            assert got.columns == docs.columns
            if name in want:
                assert ids == want[name], name
            else:
                assert 2 not in ids and 3 not in ids and 6 not in ids and 5 in ids
        assert stage(spark, empty(spark), sf).count() == 0


def test_simhash_by_default_lanes_at_every_size(spark, monkeypatch):
    """The number of lanes follows the number of fingerprints; every choice links the same at the level of the query."""
    rng = random.Random(5)
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(60)) for _ in range(10)]
    df = spark.createDataFrame([(k, base[k % 10] + f" end{k % 3}") for k in range(40)], "doc_id long, text string")
    got = []
    for n in (10, 100_000, 10_000_000, 1 << 31):
        lanes = simhash.lanes_for(n)
        monkeypatch.setattr(simhash, "lanes_for", lambda _, lanes=lanes: lanes)
        got.append(sorted(map(tuple, simhash.simhash_components(df).collect())))
        monkeypatch.undo()
    assert got[0] == got[1] == got[2] == got[3] and [simhash.lanes_for(n) for n in (10, 100_000, 10_000_000, 1 << 31)] == [1, 2, 4, 8]


def test_stages_keep_columns(spark, sf):
    import corpus_pipeline as cp

    docs = table(spark, sf, "documents")
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
