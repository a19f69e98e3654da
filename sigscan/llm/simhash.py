"""Operator 6, SimHash near-dedup by tiled exact comparison.

Distinct fingerprints are dealt into tiles by the population counts of their
lanes (equal slices of the 64 bits). Fingerprints within ``radius`` bits have
lane counts that differ by at most ``radius`` in sum, so only those pairs of
tiles are compared, with numpy's exclusive-or and bit counts; all others are
skipped and no link is lost. A tile holds a bounded number of fingerprints; a
crowded cell has several. Each task keeps a forest of the links that it finds,
and :func:`components` joins the forests.

Nulls, ties and odd texts: a null or blank text has fingerprint zero and links
like any other; a row without doc_id has no identity, links with nothing and
has a null component; repeated rows share a fingerprint and so a component; a
text of any length is read whole, in pieces; an empty table gives no rows.
Columns besides doc_id and text are not read.
"""

from __future__ import annotations

from itertools import product, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sigscan.llm.common import LOWER_AZ, components, forest, free_name, pieces, tidied
from sigscan.session import materialize, ship

#: Fingerprints in a tile, and entries of a comparison at once.
TILE, BLOCK = 32_768, 1 << 22
#: Most cells (16 bytes each) whose counts are sent to every executor: those of up to four lanes.
MAX_CELLS = 100_000


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles, as a signed integer."""
    from xxhash import xxh64_intdigest

    votes, total, carry = np.zeros(64, np.int64), 0, []
    for piece in pieces((text or b"").translate(LOWER_AZ)):
        got = carry + piece.split()
        if len(got) >= words:
            spans = map(b" ".join, zip(*(got[k:] for k in range(words)), strict=False))
            n = len(got) - words + 1
            h = np.fromiter(map(xxh64_intdigest, spans, repeat(seed)), np.uint64, n)
            for i in range(0, n, 1 << 16):
                part = h[i : i + (1 << 16)]
                votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            total += n
        carry = got[-(words - 1) :] if words > 1 else []
    if not total:
        value = xxh64_intdigest(b" ".join(carry), seed) if carry else 0
    else:
        value = int(np.packbits(2 * votes > total, bitorder="little").view(np.uint64)[0])
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) for every row of ``docs``."""
    ship(docs.sparkSession)

    @tidied
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 512):
                s = b.slice(i, 512)
                fps = [fingerprint(t, words, seed) for t in s.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def lanes_for(n: int) -> int:
    """Lanes of the tile key: more, finer cells for more fingerprints. Every choice is exact."""
    return 1 if n < 20_000 else 2 if n < 400_000 else 4 if n < 1 << 30 else 8


def _steps(lanes: int, radius: int) -> list[tuple[int, ...]]:
    """Differences of lane counts within the radius, one of each opposite pair."""
    return [d for d in product(range(-radius, radius + 1), repeat=lanes) if sum(map(abs, d)) <= radius and d >= (0,) * lanes]


def _compare(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[list, list]:
    """Linked pairs between two tiles, or inside one (b is None)."""
    us, vs, other = [], [], a if b is None else b
    step = max(1, BLOCK // max(1, len(other)))
    for i in range(0, len(a), step):
        rows = a[i : i + step]
        cols = other[i + 1 :] if b is None else other
        near = np.bitwise_count(rows[:, None] ^ cols[None, :]) <= radius
        r, c = np.nonzero(near)
        if b is None:
            keep = c + 1 > r  # col index is relative to i + 1, row index to i
            r, c = r[keep], c[keep]
        if len(r):
            u, v = forest(rows[r].view(np.int64), cols[c].view(np.int64))
            us.append(u)
            vs.append(v)
    return us, vs


def links(fps: DataFrame, radius: int = 2, lanes: int | None = None, tile: int = TILE) -> DataFrame:
    """A forest (u, v) in each partition of the links among distinct fingerprints ``fps`` (fp)."""
    spark = fps.sparkSession
    ship(spark)
    lanes = lanes or lanes_for(fps.count())
    width = 64 // lanes
    base = width + 1 + 2 * radius  # room for neighbours below zero and above the width

    # the lane counts as one number; bit_count and shifts stay in the JVM
    code = F.lit(0).cast("long")
    for k in range(lanes):
        lane = F.shiftrightunsigned("fp", k * width) if k else F.col("fp")
        if lanes > 1:
            lane = lane.bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        code = code * base + F.bit_count(lane).cast("long") + radius
    placed = fps.select("fp", code.alias("cell"))
    tiles_of = placed.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(float(tile))).cast("int").alias("tiles"))
    if (width + 1) ** lanes <= MAX_CELLS:  # there can be no more cells than combinations of lane counts
        tiles_of = F.broadcast(tiles_of)
    dealt = placed.join(tiles_of, "cell").select("cell", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int").alias("tile"), "fp")
    # a crowded cell is dealt by tile; collect_list gathers a tile only: about `tile` numbers, by the hash above
    tiles = materialize(dealt.repartition("cell", "tile").groupBy("cell", "tile").agg(F.collect_list("fp").alias("fps")), "tiles")

    moves = [sum(x * base ** (lanes - 1 - k) for k, x in enumerate(d)) for d in _steps(lanes, radius)]
    left = tiles.select(F.explode(F.array(*[F.lit(m).cast("long") for m in moves])).alias("move"), F.col("cell").alias("c"), F.col("tile").alias("t"), F.col("fps").alias("a")).withColumn("cell", F.col("c") + F.col("move")).drop("c")
    pairs = left.join(tiles, "cell").where("move <> 0 or tile >= t").select((F.expr("move = 0 and tile = t")).alias("same"), "a", F.expr("if(move = 0 and tile = t, array(), fps)").alias("b"))

    @tidied
    def run(batches):
        us, vs, held = [], [], 0
        for batch in batches:
            same = batch.column(0).to_pylist()
            a, b = batch.column(1), batch.column(2)
            av, ao = a.values.to_numpy(zero_copy_only=False).view(np.uint64), a.offsets.to_numpy()
            bv, bo = b.values.to_numpy(zero_copy_only=False).view(np.uint64), b.offsets.to_numpy()
            for k, one in enumerate(same):
                x = av[ao[k] : ao[k + 1]]
                u, v = _compare(x, None if one else bv[bo[k] : bo[k + 1]], radius)
                us += u
                vs += v
                held += sum(map(len, u))
                if held > 1 << 20:
                    u, v = forest(np.concatenate(us), np.concatenate(vs))
                    us, vs, held = [u], [v], 0
        if us:
            u, v = forest(np.concatenate(us), np.concatenate(vs))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return pairs.mapInArrow(run, "u long, v long")


def _rooted(docs: DataFrame, radius: int = 2, words: int = 3, seed: int = 42, lanes: int | None = None, tile: int = TILE) -> DataFrame:
    """(doc_id, fp, component_id, root) for every row; a root is a component's own, a component_id may be several's where a doc_id has several texts."""
    prints = materialize(fingerprints(docs, words, seed), "fingerprints")
    distinct = materialize(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp"), radius, lanes, tile), forests=True)
    placed = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = materialize(placed.join(least, "root").select(F.col("fp").alias("key"), "component_id", "root"), "classes")
    return prints.join(classes, prints.fp == classes.key, "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), "root")


def simhash_components(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, fp, component_id) for every row: documents whose fingerprints a chain of links joins share the least doc_id."""
    return _rooted(docs, **options).drop("root")


def _with_fingerprints(docs: DataFrame, name: str, words: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` and their fingerprints in a column ``name``."""
    ship(docs.sparkSession)
    at = docs.columns.index("text")

    @tidied
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 512):
                s = b.slice(i, 512)
                fps = [fingerprint(t, words, seed) for t in s.column(at).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*s.columns, pa.array(fps, pa.int64())], [*s.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def simhash_dedup(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, with its least doc_id; rows without doc_id stay.

    Rows are told apart by doc_id and fingerprint: of a doc_id with several texts
    each text stays or goes with its own component. Of several fingerprints that a
    component has under its least doc_id the least stays; of rows with equal doc_id
    and fingerprint any one.
    """
    key_name, print_name = free_name(docs, "__key"), free_name(docs, "__print")
    found = materialize(_rooted(docs, **options), "components")
    named, key = found.where("doc_id is not null"), docs["doc_id"].cast("long")
    twice = named.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(key_name))
    twice = materialize(twice, "repeated-ids")
    # a doc_id alone says what to do with its row unless it is repeated; only rows that repeat one are read for fingerprints again
    other = named.where("doc_id <> component_id").select(F.col("doc_id").alias(key_name)).union(twice).distinct()
    once = docs.join(other, key == other[key_name], "left_anti")
    stay = named.where("doc_id = component_id").groupBy("root").agg(F.min(F.struct("doc_id", "fp")).alias("s")).select(F.col("s.doc_id").alias(key_name), F.col("s.fp").alias("stays"))
    again = _with_fingerprints(docs.join(twice, key == twice[key_name], "left_semi"), print_name, **{k: v for k, v in options.items() if k in ("words", "seed")})
    again = again.join(stay, (again["doc_id"].cast("long") == stay[key_name]) & (again[print_name] == stay["stays"]), "left_semi")
    return once.unionByName(again.dropDuplicates(["doc_id", print_name]).drop(print_name))
