"""Operator 1, benchmark decontamination by an FM-index for each shard of documents.

A shard is a run of whole documents of about ``SHARD_WORDS`` words inside a
task. Its words are mapped to the vocabulary of the benchmark; a word that no
window has ends a run, and runs shorter than the shortest window cannot hold
one, so the index is built over what is left. All windows are searched together
backwards through wavelet ranks, located by sampled suffix positions, and the
occurrences merged into spans. Documents are never shuffled.

The benchmark's windows are dealt into blocks of about ``BLOCK_BYTES`` of text,
which tasks build and write to the shared folder and other tasks read one at a
time: memory is bounded for any benchmark, and the driver sees no item. Of a
benchmark of several blocks a shard's index is built for each, since its symbols
are the words of the block.

Nulls, ties and odd texts: a null or wordless text has no words, no hits and is
clean; items that are null or have no words have no windows; an item without
item_id hits words but is not counted or listed; items of one item_id count
once; repeated rows are each judged; texts of any length are read whole; an
empty table or benchmark gives no rows or no hits. Columns besides doc_id and
text (item_id and text) are not read by :func:`decontaminate`.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import uuid
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigscan.llm.common import WORD_FOLD, open_fs, pieces, tidied
from sigscan.llm.fmindex import FMIndex
from sigscan.session import shared_path, ship

#: Words of a window; words of a shard; bytes of benchmark text in a block.
WINDOW, SHARD_WORDS, BLOCK_BYTES = 13, 1 << 20, 8 << 20
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


class Block:
    """The windows of some benchmark items, as rows of word symbols."""

    def __init__(self, items: list[tuple[object, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        rows: dict[tuple[int, ...], set[int]] = {}
        names: dict[str | None, int] = {}
        for item_id, text in items:
            words = (text or b"").translate(WORD_FOLD).split()
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            name = names.setdefault(None if item_id is None else str(item_id), len(names))
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                rows.setdefault(tuple(ids[k : k + window]), set()).add(name)
        self.names = list(names)
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.patterns = np.zeros((len(rows), window), np.int32)
        for k, r in enumerate(rows):
            self.patterns[k, : len(r)] = r
        self.items = [np.array(sorted(s)) for s in rows.values()]
        self.least = int(self.lengths.min()) if len(rows) else 0

    def hits(self, words: list[list[bytes]], owner: np.ndarray, covered: np.ndarray, found: dict[int, set[str]]) -> None:
        """Mark the shard's words inside occurrences in ``covered``; add the item names of each document to ``found``.

        ``words``: pieces of the shard in order, with an empty word after each document; ``owner``: document of each word.
        """
        if not self.least:
            return
        get = self.vocabulary.get
        ids = np.concatenate([np.fromiter(map(get, p, repeat(0)), np.int32, len(p)) for p in words])
        known = np.concatenate([[False], ids > 0, [False]])
        edge = np.flatnonzero(known[1:] != known[:-1])
        starts, ends = edge[::2], edge[1::2]
        keep = ends - starts >= self.least
        starts, sizes = starts[keep], (ends - starts)[keep] + 1
        if not len(starts):
            return
        at = np.repeat(starts - (sizes.cumsum() - sizes), sizes) + np.arange(sizes.sum())  # run words, then the place of its stop
        symbols = ids[at]  # what follows a run is a 0: a foreign word or the end of a document
        index = FMIndex(symbols, len(self.vocabulary))
        low, high = index.search(self.patterns, self.lengths)
        change = np.zeros(len(symbols) + 1, np.int64)
        seen: set[int] = set()
        for which, position in index.locate(low, high):
            change += np.bincount(position, minlength=len(change))
            change -= np.bincount(position + self.lengths[which], minlength=len(change))
            seen.update(np.unique(owner[at[position]].astype(np.int64) * len(self.patterns) + which).tolist())
        inside = np.flatnonzero(change.cumsum()[:-1] > 0)
        covered[at[inside]] = True
        for pair in seen:
            doc, which = divmod(pair, len(self.patterns))
            found.setdefault(doc, set()).update(self.names[k] for k in self.items[which])


class Judge:
    """Collects documents into shards and yields their verdicts in order."""

    def __init__(self, blocks, shard_words: int = SHARD_WORDS):
        self.blocks, self.limit = blocks, shard_words
        self._clear()

    def _clear(self) -> None:
        self.words: list[list[bytes]] = []
        self.counts: list[int] = []
        self.size = 0

    def add(self, text: bytes | None) -> None:
        n = 0
        for p in pieces((text or b"").translate(WORD_FOLD)):
            got = p.split()
            n += len(got)
            self.words.append(got)
        self.words.append([b""])
        self.counts.append(n)
        self.size += n + 1

    @property
    def full(self) -> bool:
        return self.size >= self.limit

    def verdicts(self) -> list[dict]:
        if not self.counts:
            return []
        counts = np.array(self.counts, np.int64)
        owner = np.repeat(np.arange(len(counts), dtype=np.int32), counts + 1)
        covered, found = np.zeros(len(owner), bool), {}
        for block in self.blocks():
            block.hits(self.words, owner, covered, found)
        hit = np.bincount(owner[covered], minlength=len(counts)) if len(counts) else []
        first, out = np.concatenate([[0], (counts + 1).cumsum()]), []
        for k, n in enumerate(self.counts):
            items = sorted(x for x in found.get(k, ()) if x is not None)
            spans = []
            if hit[k]:
                flag = np.concatenate([[0], covered[first[k] : first[k] + n].astype(np.int8), [0]])
                edge = np.flatnonzero(np.diff(flag))
                spans = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
            out.append({"n_words": n, "n_hit": int(hit[k]), "items": items, "word_spans": spans, "contaminated": bool(hit[k] and 20 * int(hit[k]) >= n)})
        self._clear()
        return out


def _character_spans(text: str, spans: list[tuple[int, int]]) -> list[dict]:
    """Word spans as character spans [start, end) of the text."""
    out, want = [], iter(spans)
    span, begin = next(want, None), 0
    for k, m in enumerate(WORD.finditer(text.translate(_LOWER))):
        if span is None:
            break
        if k == span[0]:
            begin = m.start()
        if k == span[1] - 1:
            out.append({"start": begin, "end": m.end()})
            span = next(want, None)
    return out


def _blocks(benchmark: DataFrame, window: int, block_bytes: int):
    """A function that yields the blocks of windows on an executor."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    folder = shared_path(spark, "benchmark")

    @tidied
    def write(batches):
        from pyspark import TaskContext

        rows = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True)]
        if not rows:
            return
        part = TaskContext.get().partitionId()
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        temp = f"{base}/.{part}-{uuid.uuid4().hex}"
        with fs.open_output_stream(temp, compression=None) as out:
            out.write(pickle.dumps(Block(rows, window)))
        fs.move(temp, f"{base}/block-{part}")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32())})

    parts = sorted(r.part for r in items.repartition(-(-size // block_bytes) or 1, F.xxhash64("item_id", "text")).mapInArrow(write, "part int").collect())
    last: dict[int, Block] = {}  # the block read last; of a benchmark of one block a task reads it once

    def blocks():
        fs, base = open_fs(folder)
        for part in parts:
            if part not in last:
                last.clear()
                with fs.open_input_stream(f"{base}/block-{part}", compression=None) as f:
                    last[part] = pickle.loads(f.read())
            yield last[part]

    return blocks


_SPANS = "array<struct<start:int,end:int>>"


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """For each row: doc_id, n_words, n_hit, n_items, items, spans to remove (characters), contaminated."""
    ship(docs.sparkSession)
    blocks = _blocks(benchmark, window, block_bytes)

    @tidied
    def run(batches):
        judge, held = Judge(blocks, shard_words), []

        def flush():
            rows = []
            for (doc_id, text), v in zip(held, judge.verdicts(), strict=True):
                spans = _character_spans(text.decode("utf-8", "replace"), v["word_spans"]) if v["word_spans"] else []
                rows.append({"doc_id": doc_id, "n_words": v["n_words"], "n_hit": v["n_hit"], "n_items": len(v["items"]), "items": v["items"], "spans": spans, "contaminated": v["contaminated"]})
            held.clear()
            schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("contaminated", pa.bool_())])
            return pa.RecordBatch.from_pylist(rows, schema)

        for b in batches:
            for i in range(0, b.num_rows, 256):
                s = b.slice(i, 256)
                for doc_id, text in zip(s.column(0).to_pylist(), s.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    judge.add(text)
                    held.append((doc_id, text))
                    if judge.full:
                        yield flush()
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, n_words long, n_hit long, n_items long, items array<string>, spans {_SPANS}, contaminated boolean")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns, without a shuffle or join."""
    ship(docs.sparkSession)
    blocks, at = _blocks(benchmark, window, BLOCK_BYTES), docs.columns.index("text")

    @tidied
    def run(batches):
        judge, held = Judge(blocks), []

        def flush():
            keep, row = [not v["contaminated"] for v in judge.verdicts()], 0
            for b in held:
                yield b.filter(pa.array(keep[row : row + b.num_rows], pa.bool_()))
                row += b.num_rows
            held.clear()

        for b in batches:
            for text in b.column(at).cast(pa.binary()):
                judge.add(text.as_py())
            held.append(b)
            if judge.full:
                yield from flush()
        yield from flush()

    return docs.mapInArrow(run, docs.schema)


def digest_rows(found: DataFrame) -> DataFrame:
    """The digest columns of the query: the items as one hash."""
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated")


def brute_force(doc: str | None, items: list[tuple[object, str | None]], window: int = WINDOW) -> tuple:
    """The contract's columns for one document, by comparing every position with every window."""
    fold = lambda t: WORD.findall((t or "").translate(_LOWER))
    words, hit, names = fold(doc), set(), set()
    for item_id, text in items:
        own = fold(text)
        for k in range(max(1, len(own) - window + 1) if own else 0):
            w = own[k : k + window]
            for i in range(len(words) - len(w) + 1):
                if words[i : i + len(w)] == w:
                    hit.update(range(i, i + len(w)))
                    if item_id is not None:
                        names.add(str(item_id))
    digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return len(words), len(hit), len(names), digest, bool(hit and 20 * len(hit) >= len(words))
