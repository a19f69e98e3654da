"""Operator 4, exact range join of embeddings by cosine similarity.

Equal vectors of a label become one node. Unit vectors are points of a metric
space where a cosine of at least ``least`` is a distance of at most r =
sqrt(2 - 2 * least). Each label is partitioned by pivots of its own: of a sample
taken by hash those that lie farthest from each other, one for every ``cell``
nodes, two at least. A node lives in the cell of its nearest pivot and is
replicated to each cell whose pivot is at most 2 r farther and within that
cell's radius plus r, which the triangle inequality shows to be all that can
hold a partner. Cells join independently, in tiles of bounded size, where nodes
are ordered by their distance to one of them, and only those that differ in it
by r at most are compared. A tile reports its nodes' numbers of links and a
forest of them.

Nulls, ties and odd rows: a vector that is null, empty, zero, or holds null or
non-finite components, or whose label is null, links with nothing; so do
vectors of different lengths; a row without vec_id has no identity, links with
nothing, has a null component and is not kept; rows that repeat a vector link
with each other; an empty table gives no rows. Columns besides vec_id,
embedding and label are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigscan.llm.common import components, tidied, union_edges
from sigscan.session import materialize, ship

LEAST, CELL = 0.98, 16_384
#: Nodes of a label that is divided at least in two.
FEW = 16
#: Most pivots of all labels together, and of vectors that they are taken from: what the driver and the executors get is bounded by them.
MAX_PIVOTS, MAX_SAMPLE = 2048, 8192
#: Bytes (of doubles) of the home nodes of a tile; of other nodes it has twice as many.
TILE_BYTES = 8 << 20
#: For rounding, which near a distance of 0 is the root of a double's; a replica too many costs time, never a link.
EPS = 1e-6


def _unit(rows: np.ndarray) -> np.ndarray:
    x = rows / np.abs(rows).max(axis=1, keepdims=True)  # no overflow in the norm
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


def nodes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows (vec_id, key), key null where nothing can link; and the distinct vectors (nid, space, vector, copies, first)."""
    # single precision is kept as it is: half the bytes to move, and exact when it is widened to compute
    kind = "float" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "double"
    e = F.transform(F.col("embedding"), lambda x: x.cast(kind) + F.lit(0.0).cast(kind))  # -0.0 becomes 0.0
    fine = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
        & F.exists("embedding", lambda x: x != F.lit(0))
    )
    space = F.concat_ws("|", F.col("label").cast("string"), F.size("embedding").cast("string"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(fine, space).alias("space"), F.when(fine, e).alias("vector"))
    rows = rows.withColumn("key", F.when(F.col("space").isNotNull(), F.sha2(F.concat_ws("|", "space", F.concat_ws(",", F.transform("vector", lambda x: x.cast("string")))), 256)))
    merged = rows.where("key is not null").groupBy("key").agg(F.first("space").alias("space"), F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    return rows.select("vec_id", "key"), materialize(merged.withColumn("nid", F.monotonically_increasing_id()), "nodes")


def _farthest(x: np.ndarray, n: int) -> np.ndarray:
    """n of the rows, each the farthest from those before it, the first row first."""
    out, near = [0], _distance(x, x[:1])[:, 0]
    while len(out) < min(n, len(x)):
        out.append(int(near.argmax()))
        near = np.minimum(near, _distance(x, x[out[-1:]])[:, 0])
    return x[out]


def _pivots(found: DataFrame, cell: int) -> dict[str, np.ndarray]:
    """Unit pivots of each space that needs more than one cell, MAX_PIVOTS in all at most."""
    wanted = F.greatest(F.ceil(F.col("n") / F.lit(float(cell))), F.lit(2))
    sizes = materialize(found.groupBy("space").agg(F.count("*").alias("n")).where(F.col("n") > min(FEW, cell)).withColumn("pivots", wanted), "spaces")
    total = sizes.agg(F.sum("pivots")).first()[0] or 0
    if not total:
        return {}
    few = max(1.0, total / MAX_PIVOTS)
    at = F.pmod(F.xxhash64("key"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chance = F.greatest(F.col("pivots") / few * 4, F.lit(8.0)) / F.col("n")
    picked = found.join(sizes, "space").where(at < chance).orderBy(F.xxhash64("key")).limit(MAX_SAMPLE).select("space", "vector", "pivots").collect()
    out: dict[str, list] = {}
    for r in picked:
        out.setdefault(r.space, ([], int(np.ceil(r.pivots / few))))[0].append(r.vector)
    return {s: _farthest(_unit(np.array(v, float)), n) for s, (v, n) in out.items()}


def cells(found: DataFrame, radius: float, cell: int = CELL) -> DataFrame:
    """(cell, home, nid, vector, copies): every node at home once, and wherever it may meet a partner."""
    spark = found.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(_pivots(found, cell))

    @tidied
    def near(frames):
        for pdf in frames:
            for space, at in pdf.groupby("space").indices.items():
                p = sent.value.get(space)  # a space without pivots is one cell and needs no radius
                for i in range(0, len(at) if p is not None else 0, 4096):
                    d = _distance(_unit(np.stack(pdf["vector"].to_numpy()[at[i : i + 4096]]).astype(float)), p)
                    # every pivot that rounding may make the nearest; a gap of 0 is a radius too
                    far = np.where(d <= d.min(1)[:, None] + EPS, d, -1.0).max(0)
                    q = np.flatnonzero(far >= 0)
                    yield pd.DataFrame({"cell": [f"{space}|{k}" for k in q], "gap": far[q]})

    wide = {r.cell: r.far for r in found.select("space", "vector").mapInPandas(near, "cell string, gap double").groupBy("cell").agg(F.max("gap").alias("far")).collect()}
    radii = spark.sparkContext.broadcast(wide)

    @tidied
    def deal(frames):
        for pdf in frames:
            for space, at in pdf.groupby("space").indices.items():
                p = sent.value.get(space)
                part = pdf.iloc[at]
                if p is None:
                    yield pd.DataFrame({"cell": space + "|0", "home": True, "nid": part["nid"], "vector": part["vector"], "copies": part["copies"]})
                    continue
                for i in range(0, len(part), 4096):
                    rows = part.iloc[i : i + 4096]
                    d = _distance(_unit(np.stack(rows["vector"].to_numpy()).astype(float)), p)
                    own = d.argmin(1)
                    far = np.array([radii.value.get(f"{space}|{q}", 0.0) for q in range(len(p))])
                    go = (d <= d.min(1)[:, None] + 2 * radius + EPS) & (d <= far[None, :] + radius + EPS)
                    go[np.arange(len(rows)), own] = True
                    r, q = np.nonzero(go)
                    yield pd.DataFrame({"cell": [f"{space}|{k}" for k in q], "home": q == own[r], "nid": rows["nid"].to_numpy()[r], "vector": rows["vector"].to_numpy()[r], "copies": rows["copies"].to_numpy()[r]})

    return found.select("space", "nid", "vector", "copies").mapInPandas(deal, f"cell string, home boolean, nid long, vector {found.schema['vector'].dataType.simpleString()}, copies long")


def links(found: DataFrame, least: float = LEAST, cell: int = CELL, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """Rows (nid, n, null, null) with a node's links found in a tile, and (null, null, u, v) of a forest of the links."""
    radius = float(np.sqrt(2 - 2 * least))
    dealt = materialize(cells(found, radius, cell), "cells")
    wide = F.max(F.size("vector")) * F.lit(8.0 / tile_bytes)  # of a tile, that one vector takes
    sizes = dealt.groupBy("cell").agg(F.ceil(F.sum(F.col("home").cast("long")) * wide).alias("rows"), F.ceil(F.count("*") * wide / 2).alias("cols")).where("rows > 0")
    # tile (i, j) of a cell: home nodes with hash i against all of the cell's nodes with hash j
    placed = dealt.join(sizes, "cell").withColumn("h", F.xxhash64("nid"))
    zero = F.lit(0).cast("long")
    rows = placed.where("home").select("cell", F.pmod("h", "rows").alias("i"), F.explode(F.sequence(zero, F.col("cols") - 1)).alias("j"), F.lit(True).alias("row"), "nid", "vector", "copies")
    cols = placed.select("cell", F.explode(F.sequence(zero, F.col("rows") - 1)).alias("i"), F.pmod("h", "cols").alias("j"), F.lit(False).alias("row"), "nid", "vector", "copies")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["row"]], pdf[~pdf["row"]]
        if not len(a) or not len(b):
            return pd.DataFrame({"nid": [], "n": [], "u": [], "v": []})
        x, y = (_unit(np.stack(p["vector"].to_numpy()).astype(float)) for p in (a, b))
        # in the order of the distance to one of them
        dx, dy = _distance(x, y[:1])[:, 0], _distance(y, y[:1])[:, 0]
        ox, oy = dx.argsort(kind="stable"), dy.argsort(kind="stable")
        a, x, dx, b, y, dy = a.iloc[ox], x[ox], dx[ox], b.iloc[oy], y[oy], dy[oy]
        ids, at = np.unique(np.concatenate([a["nid"], b["nid"]]), return_inverse=True)
        ia, ib, copies = at[: len(a)], at[len(a) :], b["copies"].to_numpy()
        counts, label = np.zeros(len(a), np.int64), np.arange(len(ids))  # of nodes, least of their class
        for k in range(0, len(a), 256):
            low, high = np.searchsorted(dy, (dx[k] - radius - EPS, dx[min(k + 256, len(dx)) - 1] + radius + EPS))
            hit = x[k : k + 256] @ y[low:high].T >= least
            hit &= ia[k : k + 256, None] != ib[None, low:high]
            counts[k : k + 256] = hit @ copies[low:high]
            r, c = np.nonzero(hit)
            label = union_edges(label, ia[k + r], ib[low + c])
        tree = np.flatnonzero(label != np.arange(len(ids)))
        n = np.flatnonzero(counts)
        blank = lambda k: pd.array([None] * k, "Int64")
        return pd.DataFrame({"nid": pd.concat([pd.Series(a["nid"].to_numpy()[n], dtype="Int64"), pd.Series(blank(len(tree)))]), "n": pd.concat([pd.Series(counts[n], dtype="Int64"), pd.Series(blank(len(tree)))]), "u": pd.concat([pd.Series(blank(len(n))), pd.Series(ids[tree], dtype="Int64")]), "v": pd.concat([pd.Series(blank(len(n))), pd.Series(ids[label[tree]], dtype="Int64")])})

    return rows.union(cols).groupBy("cell", "i", "j").applyInPandas(join, "nid long, n long, u long, v long")


def near_vectors(vectors: DataFrame, least: float = LEAST, cell: int = CELL, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept."""
    rows, found = nodes(vectors)
    out = materialize(links(found, least, cell, tile_bytes), "links")
    counts = out.where("nid is not null").groupBy("nid").agg(F.sum("n").alias("n"))
    roots = components(out.where("u is not null").select("u", "v"))
    placed = found.select("nid", "key", "copies", "first").join(counts, "nid", "left").join(roots, F.col("nid") == roots.node, "left").select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "first", F.coalesce("root", "nid").alias("root"))
    least_id = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    known = materialize(placed.join(least_id, "root").select(F.col("key").alias("k"), "n_links", "component_id"), "vector-classes")
    joined = rows.join(known, rows.key == known.k, "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
