"""Operator 12, spelling variants grouped by rolling-hash deletions.

Two words are near if one inserted, deleted or replaced code point makes one the
other, so they agree on a word without one code point: at the same place for a
replacement, one of them being whole for an insertion. Prefix and suffix sums of
a polynomial over all words of a length give the hashes of all deletions of all
words as one NumPy expression. Keys are dealt by their leading bits and sorted;
only keys that several words share go on, and there the strings themselves are
compared, so a collision of hashes links nothing.

What is counted of a group of words that agree is its size and its two best
words; no pairs are written. A group holds at most one word for each letter of
the alphabet (replacements), or those that one inserted letter makes of a word.

Nulls and empty texts have no words; repeated rows count each; a null doc_id is
written as nothing before the colon. Texts of any length are read whole; a word's
own length alone must fit a task. Ties of counts go to the least word in
code-point order. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigscan.llm.common import tidied
from sigscan.session import discard, materialize, ship

#: Of words, in code points; least occurrences; how many times as frequent a word's form is; what a typing error's hash is divided by.
LEAST_LENGTH, LEAST_COUNT, RATIO, ERROR = 7, 2, 10, 31
#: Keys of a partition that is sorted at once.
KEYS = 1 << 20
#: Cells (words x letters) of the arrays that are hashed at once.
CELLS = 1 << 18

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def words(docs: DataFrame) -> DataFrame:
    """(word, n): the words of all texts after typing errors, and how often they occur."""
    runs = F.regexp_extract_all(F.col("text"), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{LEAST_LENGTH},}}"), F.lit(0))
    run = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    # lower() is fast and right where there are ASCII letters alone
    low = F.when(F.octet_length("run") == F.length("run"), F.lower("run")).otherwise(F.translate("run", _UPPER, _LOWER))
    run = run.select("id", low.alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    run = run.select("run", F.when(h % ERROR == 0, (h % F.length("run")).cast("int")).alias("at"))
    cut = F.concat(F.substring("run", F.lit(1), F.col("at")), F.substring(F.col("run"), F.col("at") + 2, F.length("run")))
    word = F.when(F.col("at").isNull(), F.col("run")).otherwise(cut)
    counted = run.select(word.alias("word")).where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread over all places (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def deletion_keys(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of words of one length, a row each of code points: (hashes of the whole words, hashes of each without each letter)."""
    n = codes.shape[1]
    powers = np.ones(n, np.uint64)
    powers[1:] = _BASE
    powers = np.multiply.accumulate(powers)
    terms = _mixed(codes.astype(np.uint64)) * powers
    prefix = np.cumsum(terms, axis=1, dtype=np.uint64)
    whole = prefix[:, -1]
    # letters behind the deleted one move a place forward
    return whole, (prefix - terms) + (whole[:, None] - prefix) * np.uint64(_INVERSE)


def word_keys(words_: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the word, key, place) of all keys of words: one for each letter left out at its place, one for each word that leaving one out gives, one for the word; places as in :func:`_keys`."""
    lens = np.fromiter(map(len, words_), np.int64, len(words_))
    order = np.argsort(lens, kind="stable")
    out, start = [], 0
    while start < len(order):
        n = int(lens[order[start]])
        stop = min(int(np.searchsorted(lens[order], n, "right")), start + max(1, CELLS // max(n, 1)))
        chosen = order[start:stop]
        start = stop
        if not n:
            continue
        codes = np.frombuffer("".join(words_[k] for k in chosen).encode("utf-32-le"), np.uint32).reshape(len(chosen), n)
        whole, without = deletion_keys(codes)
        place = np.arange(n)
        first = np.ones(codes.shape, bool)  # of a run of one letter any one leaves the same word
        first[:, 1:] = codes[:, 1:] != codes[:, :-1]
        at = np.repeat(chosen, n).reshape(codes.shape)
        salt = lambda tag, size: np.uint64((tag * 0xD1B54A32D192ED03 + size * 0x8CB92BA72F3D8DD7) % (1 << 64))
        placed = without + salt(1, n) + place.astype(np.uint64) * np.uint64(0xABC98388FB8FAC03)
        out.append((at.ravel(), _mixed(placed).ravel(), np.tile(place, len(chosen))))
        out.append((at[first], _mixed(without + salt(2, n - 1))[first], np.tile(-place - 2, len(chosen)).reshape(codes.shape)[first]))
        out.append((chosen, _mixed(whole + salt(2, n)), np.full(len(chosen), -1)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _keys(batches):
    """(id, key, place) of words (id, word): place p is the word without letter p at its place, -1 the whole word, -2 - p the word that leaving out letter p gives."""
    for b in batches:
        ids = b.column(0)
        for start in range(0, b.num_rows, 4096):
            at, key, place = word_keys(b.column(1).slice(start, 4096).to_pylist())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at + start)), pa.array(key.view(np.int64)), pa.array(place.astype(np.int32))], ["id", "key", "place"])


def _shared(batches):
    """The rows whose key another row of the partition has too. Equal keys lie in one partition, which is sorted at once."""
    held = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]]
    for b in batches:
        for k in range(3):
            held[k].append(b.column(k).to_numpy())
    ids, key, place = map(np.concatenate, held)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    kept = np.zeros(len(order), bool)
    kept[1:] |= same
    kept[:-1] |= same
    chosen = order[kept]
    for start in range(0, len(chosen), 1 << 16):
        part = chosen[start : start + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array(place[part])], ["id", "place"])


def _context() -> Column:
    """The string that a key stands for; a star marks the place of a letter that another may replace."""
    at = F.when(F.col("place") >= 0, F.col("place")).otherwise(-2 - F.col("place"))
    left, right = F.substring("word", F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word"))
    return F.when(F.col("place") >= 0, F.concat(left, F.lit("*"), right)).when(F.col("place") == -1, F.col("word")).otherwise(F.concat(left, right))


def near_words(found: DataFrame) -> DataFrame:
    """(word, n_near, best): of words (id, word, n) that have near words, their number and the best of them, a struct (minus, word) with its count negated."""
    keys = found.agg(F.sum(2 * F.length("word") + 1)).first()[0] or 0
    bits = max(3, (keys // KEYS).bit_length())
    dealt = found.select("id", "word").mapInArrow(tidied(_keys), "id long, key long, place int")
    dealt = dealt.repartitionById(1 << bits, F.shiftrightunsigned("key", 64 - bits).cast("int"))
    shared = dealt.mapInArrow(tidied(_shared), "id long, place int")
    # far more rows than Spark expects of a table this small, so the join is kept from broadcasting them
    shared = shared.hint("merge").join(found, "id").select("word", "n", "place", _context().alias("context"))
    group = Window.partitionBy("context")
    ranked = group.orderBy(F.desc("n"), "word")
    letter = shared.where("place >= 0").withColumn("size", F.count("*").over(group)).where("size > 1")
    best, second = (F.nth_value(F.struct((-F.col("n")).alias("minus"), "word"), k).over(ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for k in (1, 2))
    replaced = letter.select("word", (F.col("size") - 1).alias("add"), F.when(best["word"] == F.col("word"), second).otherwise(best).alias("best"))
    whole = shared.where("place = -1").select("context", F.col("word").alias("whole"), F.col("n").alias("whole_n"))
    longer = shared.where("place < -1").join(whole, "context")
    inserted = longer.select("word", F.lit(1).alias("add"), F.struct((-F.col("whole_n")).alias("minus"), F.col("whole").alias("word")).alias("best"))
    deleted = longer.select(F.col("whole").alias("word"), F.lit(1).alias("add"), F.struct((-F.col("n")).alias("minus"), "word").alias("best"))
    each = replaced.unionByName(inserted).unionByName(deleted)
    return each.groupBy("word").agg(F.sum("add").cast("long").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where following forms (word, form) ends. A form is ten times as frequent as its word, so a way has at most 19 steps, which five doublings cover."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = materialize(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = after.select("word", "root")
        if not after.where("moved").head(1):
            return now


def group_spellings(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words."""
    ship(docs.sparkSession)
    counted = materialize(words(docs), "words")
    # the ids are those of written rows, so a task that is repeated gives the same
    found = materialize(counted.withColumn("id", F.monotonically_increasing_id()), "words")
    discard(counted)
    near = near_words(found)
    form = F.when(-F.col("best.minus") >= RATIO * F.col("n"), F.col("best"))
    named = materialize(found.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form")), "forms")
    named = named.select("word", "n", "n_near", F.col("form.word").alias("form"), (-F.col("form.minus")).alias("form_n"))
    ends = roots(named.where("form is not null").select("word", "form"))
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
