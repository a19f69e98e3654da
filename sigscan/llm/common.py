"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigscan.session import discard, materialize

#: A-Z to a-z; ASCII letters, digits and all bytes of non-ASCII characters stay; the rest becomes a blank.
WORD_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: A-Z to a-z, nothing else.
LOWER_AZ = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Pieces of a long text that are split into words at once.
PIECE = 1 << 20


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def pieces(data: bytes, limit: int = PIECE) -> Iterator[bytes]:
    """Cut at ASCII white space into pieces of about ``limit`` bytes, so that lists of words stay small."""
    if len(data) <= limit:
        yield data
        return
    start, n = 0, len(data)
    while start < n:
        end = min(n, start + limit)
        while end < n and data[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield data[start:end]
        start = end


def give_back() -> None:
    """Return freed memory to the system; a few milliseconds."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def word_parts(texts: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[bytes]]]:
    """Words (between ASCII white space) of rows of text, in parts of about ``limit`` bytes that Arrow splits at once.

    Yields (first row, words of each row, for each word its place among the
    distinct ones, distinct words). An empty word stands for white space at an
    end. A row longer than the limit comes alone, in several parts. What a part
    needed is given back before the next one.
    """
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, row = sizes.cumsum(), 0
    while row < len(sizes):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] - sizes[row] + limit, "right")))
        if sizes[row] > limit:
            stop = row + 1
            for piece in pieces(texts[row].as_buffer().to_pybytes(), limit):
                yield row, *_words(pa.array([piece], pa.binary()).view(pa.string()))
                give_back()
        else:
            yield row, *_words(texts.slice(row, stop - row))
            give_back()
        row = stop


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    split = pc.ascii_split_whitespace(texts)
    found = split.flatten().dictionary_encode()
    lens = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False)
    return lens, found.indices.to_numpy(), found.dictionary.cast(pa.binary()).to_pylist()


def tidied(run: Callable) -> Callable:
    """A partition function that gives freed memory back to the system at its end: workers live on, and other stages' tasks share their executor."""

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI, for Python code on executors."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else uri)


def union_edges(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Merge the classes of ``label`` (index of each class's least member) along edges i-j."""
    while len(i):
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            break
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each class of the graph with edges u-v: the same connections in at most one edge per node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    label = union_edges(np.arange(len(nodes)), at[: len(u)], at[len(u) :])
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


_EDGE = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])


def _contract(batches):
    """Replace the edges of a partition by a forest; memory holds one edge per node of the partition."""
    u = v = np.empty(0, np.int64)
    for b in batches:
        u = np.concatenate([u, b.column("u").to_numpy(zero_copy_only=False)])
        v = np.concatenate([v, b.column("v").to_numpy(zero_copy_only=False)])
        if len(u) > 1 << 20:
            u, v = forest(u, v)
    u, v = forest(u, v)
    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def components(edges: DataFrame, forests: bool = False) -> DataFrame:
    """Connected components of undirected edges (u, v): one row (node, root) for each node that has an edge.

    ``forests``: each partition of ``edges`` is a forest already, so no further Python stage contracts it.

    ``root`` is the least node of the component. Rounds of large-star and
    small-star (Kiveris et al., 2014); each round's edges are written to the
    shared folder, so a lost executor repeats one round at most. No node's
    neighbours are gathered: a star needs only the minimum (with map-side
    combine) and a join that adaptive execution can split.
    """
    edges = edges.where("u <> v").select(F.col("u").cast("long"), F.col("v").cast("long"))
    now = materialize((edges if forests else edges.mapInArrow(tidied(_contract), _EDGE)).distinct(), "edges")
    mark = None
    while True:
        # large star: neighbours above u move to the least neighbour of u
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = materialize(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        discard(now)
        discard(least)
        # small star: neighbours below u move to the least of them
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = materialize(down.groupBy("u").agg(F.min("v").alias("m")), "least")
        moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(large)
        discard(least)
        last, mark = mark, now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if last == mark:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
