"""Operator 7, token-ID / binary output: tokenize whole texts and write ids as directly addressable codes.

Texts are range-partitioned by doc_id, each partition is encoded with the
tokenizers library and written as one file of :mod:`sigscan.llm.dac` in the
shared folder, and the files are read back. A task writes to a name of its own
and renames when complete, so repeated tasks leave the same file.

Nulls, ties and odd texts: a null text is empty (only the end id); a null
doc_id sorts first; rows that tie in doc_id are ordered by a hash of the text,
so equal rows are interchangeable; a text of any length is encoded whole, in
pieces cut at white space (a chunk without any is encoded in one); an empty table gives no files and no rows. Columns
besides doc_id and text are not read.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import repeat
from string import punctuation as _PUNCTUATION

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigscan.llm import dac
from sigscan.llm.common import open_fs, tidied, word_parts
from sigscan.session import materialize, partitions_for, shared_path, ship

#: Distinct white-space-free chunks that a worker keeps the ids of (about 150 bytes each), and the longest that it keeps.
CACHE_CHUNKS, CACHE_BYTES = 400_000, 64


def _byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: printable Latin-1 stands for itself, the rest follows from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    odd = [b for b in range(256) if b not in plain]
    return {b: chr(b) if b in plain else chr(256 + odd.index(b)) for b in range(256)}


class Encoder:
    """Ids of whole texts, equal to the library's own encode() of each text.

    The pre-tokenizer of the supported vocabularies never joins characters
    across ASCII white space, so a text's ids are those of its chunks between
    white space. Arrow splits many texts at once and finds their distinct chunks;
    each distinct chunk is encoded once and kept: words of Latin-1 letters by the
    library's model alone (their normal form is their lower case), marks that
    follow such a word and any other chunk by the library's whole chain.
    """

    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_alphabet()
        self.limit = cache_chunks
        self.reset()
        self.direct = self._direct_ok()

    def reset(self) -> None:
        """Forget all chunks. An entry of ``cache`` is a place in ``ends``: the ids of chunk k are flat[ends[k] : ends[k + 1]]."""
        self.cache: dict[bytes, int] = {}
        self.marks: dict[str, list[int]] = {}
        self.flat, self.ends = array("I"), array("q", [0])

    def _direct_ok(self) -> bool:
        """Whether letter words may go to the model directly; checked on words of every Latin-1 letter."""
        alphabet = "".join(chr(c) for c in range(65, 256) if chr(c).isalpha())
        words = [alphabet[i : i + 6] + alphabet[i % 50 : i % 50 + 3] for i in range(len(alphabet))]
        return all(self._word(w.lower()) == self.whole(w) for w in words) and all(self._word(w.lower()) + self.whole(p) == self.whole(w + p) for w in words for p in (",", "!!", "***", "%%%.", "'", "<|>"))

    def _word(self, w: str) -> list[int]:
        return [t.id for t in self.model.tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(self.letters))]

    def whole(self, s: str) -> list[int]:
        """The library's own ids."""
        return self.tokenizer.encode(s, add_special_tokens=False).ids

    def _mark(self, s: str) -> list[int]:
        ids = self.marks.get(s)
        if ids is None:
            ids = self.marks[s] = self.whole(s)
        return ids

    def _keep(self, chunk: bytes, ids: list[int]) -> int:
        self.flat.extend(ids)
        self.ends.append(len(self.flat))
        k = len(self.ends) - 2
        if len(chunk) <= CACHE_BYTES:
            self.cache[chunk] = k
        return k

    def _add(self, chunk: bytes) -> int:
        s = chunk.decode("utf-8", "replace")
        if self.direct:
            if chunk.isalpha() and chunk.islower():  # small ASCII letters, the commonest kind
                return self._keep(chunk, self._word(s))
            w = s.rstrip(_PUNCTUATION)
            if w.isalpha() and (w.isascii() or max(w) < "Ā"):
                low = w.lower()
                key = low.encode()
                k = self.cache.get(key)
                if k is None:
                    k = self._keep(key, self._word(low))
                if key == chunk:
                    return k
                if len(w) == len(s):  # the same ids under another case
                    self.cache[chunk] = k
                    return k
                return self._keep(chunk, [*self.flat[self.ends[k] : self.ends[k + 1]], *self._mark(s[len(w) :])])
        return self._keep(chunk, self.whole(s))

    def parts(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids of each row, ids) of parts of the texts; a long row comes alone, in several parts."""
        for row, words, code, distinct in word_parts(texts):
            if len(self.ends) > self.limit:
                self.reset()
            get = self.cache.get
            at = np.fromiter(map(get, distinct, repeat(-1)), np.int64, len(distinct))
            for i in np.flatnonzero(at < 0).tolist():
                at[i] = k if (k := get(c := distinct[i])) is not None else self._add(c)
            bounds, flat = np.frombuffer(self.ends, np.int64), np.frombuffer(self.flat, np.uint32) if self.flat else np.empty(0, np.uint32)
            first, size = bounds[at], bounds[at + 1] - bounds[at]
            lens = size[code]
            ends = lens.cumsum()
            ids = flat[np.repeat(first[code] - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)]
            totals = np.concatenate([[0], ends])[np.concatenate([[0], words.cumsum()])]
            del bounds, flat  # the arrays must be free to grow
            yield row, np.diff(totals), ids

    def encode(self, text: bytes) -> np.ndarray:
        """Ids of one text."""
        return np.concatenate([np.empty(0, np.uint32), *(ids for _, _, ids in self.parts(pa.array([text], pa.binary()).view(pa.string())))])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; it lives across tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _whole_rows(parts: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Join the parts of a row that came in several."""
    at, held = -1, []
    for row, lens, ids in parts:
        if held and row != at:
            yield at, np.array([sum(map(len, held))]), np.concatenate(held)
            held = []
        if len(lens) == 1:
            at = row
            held.append(ids)
        else:
            yield row, lens, ids
    if held:
        yield at, np.array([sum(map(len, held))]), np.concatenate(held)


def write_tokens(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 1, partition_bytes: int = 16 << 20) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) to files in ``folder``; one row (part, path, n_docs, n_ids) a file."""
    ship(docs.sparkSession)
    n = partitions_for(docs, partition_bytes)  # of all columns: estimates of some count texts as 20 bytes

    @tidied
    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc = encoder(vocabulary)
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        temp, final = f"{base}/.{part:06d}-{uuid.uuid4().hex}", f"{base}/part-{part:06d}.dac"
        with fs.open_output_stream(temp, compression=None) as out:
            w = dac.Writer(out)
            for b in batches:
                keys = b.column(0).to_pylist()
                for row, lens, ids in _whole_rows(enc.parts(b.column(1))):
                    ends = (lens + 1).cumsum()
                    out_ids = np.full(ends[-1], end_id, np.uint32)
                    inside = np.ones(len(out_ids), bool)
                    inside[ends - 1] = False
                    out_ids[inside] = ids
                    w.add_many(keys[row : row + len(lens)], lens + 1, out_ids)
            w.close()
        if not w.docs:
            fs.delete_file(temp)
            return
        fs.move(temp, final)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [f"{folder}/part-{part:06d}.dac"], "n_docs": pa.array([w.docs], pa.int64()), "n_ids": pa.array([w.ids], pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("__tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(n, "doc_id", "__tie").sortWithinPartitions("doc_id", "__tie").select("doc_id", "text")
    return materialize(dealt.mapInArrow(run, "part int, path string, n_docs long, n_ids long"), "token-files")


def read_tokens(files: DataFrame) -> DataFrame:
    """Read files that :func:`write_tokens` lists: (doc_id, start, n_tokens, ids_crc32), start counted over all files."""
    ship(files.sparkSession)
    # one row a file: the running sum is over the list of files, not over documents
    placed = files.withColumn("base", F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids"))
    n = max(files.count(), 1)

    @tidied
    def run(batches):
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, at = open_fs(path)
                rows: list[tuple] = []
                with fs.open_input_file(at) as f:
                    for key, start, ids in dac.Reader(f).documents(check=True):
                        rows.append((key, base + start, len(ids), zlib.crc32(ids.astype("<u4", copy=False).data)))
                        if len(rows) >= 8192:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    return placed.select("path", "base", "part").repartition(n, "part").select("path", "base").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_output(docs: DataFrame, vocabulary: str, folder: str | None = None) -> DataFrame:
    """Tokenize, write and read back. ``folder``: where the files go, a fresh shared folder by default."""
    folder = folder or shared_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, vocabulary, folder))
