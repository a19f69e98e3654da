"""Operator 2, mixing sources to target weights by a low-discrepancy schedule.

1. Targets: source weights 5, 2, 1, repeating in code-point order, share
   ``multiple`` times all words; a source stops at ``cap`` times its own words and
   the excess is shared again by weight (water filling, in closed form).
2. Blocks: a source's documents, shuffled by a hash, lie on a line that is cut
   into blocks of ``block_words``. Positions come from two prefix sums, over
   hash buckets and inside a bucket, so a source of any size is spread out.
3. Schedule: golden-ratio points are mapped through the cumulative shares of
   the sources' slots; the r-th slot of a source takes its block r modulo its
   blocks. The last slot is cut so that the source's words meet its target. That
   every source got the slots that it needs is checked, not assumed.
4. Taken: documents are joined with the scheduled blocks that they overlap; a
   document's slots say where in the mix it comes.

All hashes and points are integers, so reruns agree. Nulls, ties and odd rows:
a null source is a source of its own, ordered last; a null or blank text has
size 0, takes nothing and has no slot; repeated rows each have a place of their
own on the line; sources without words have target 0; a text of any length is
counted whole; an empty table gives no rows. Columns besides doc_id, text and
source are not read by :func:`mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigscan.llm.common import free_name
from sigscan.session import materialize, partitions_for

WEIGHTS, MULTIPLE, CAP = (5, 2, 1), 1.5, 2
#: Words of a block; hexadecimal digits of the hash that make a bucket; slots whose ranks are counted together.
BLOCK_WORDS, DIGITS, CHUNK = 8192, 3, 1024


def _golden(least: int = 1 << 39) -> tuple[int, int]:
    """Two Fibonacci numbers that follow each other, the greater at least ``least``: their quotient is the golden ratio's best approximation of that size."""
    a, b = 1, 1
    while b < least:
        a, b = b, a + b
    return a, b


#: Slot i lies at i * STEP modulo TURN. Being coprime, they give every slot of a turn (some 10^12) a point of its own.
STEP, TURN = _golden()


def size_of(text: Column) -> Column:
    """Words of a text: runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, multiple: float = MULTIPLE, cap: int = CAP) -> DataFrame:
    """(source, source_size) to (source, source_size, weight, target). One row a source: its windows are over sources only."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    whole = Window.partitionBy(F.lit(1))
    full = Window.partitionBy(F.lit(1)).orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    known = sizes.select("source", "source_size", pick.alias("weight"), (F.lit(float(cap)) * F.col("source_size")).alias("limit"))
    # with the sources in order of limit / weight, all before the first that stays below its limit are at theirs
    stepped = (
        known.withColumn("total", F.lit(multiple) * F.sum("source_size").over(whole))
        .withColumn("used", F.coalesce(F.sum("limit").over(full), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(full), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("used")) / F.col("left"))
        .withColumn("free", F.col("weight") * F.col("level") <= F.col("limit"))
    )
    level = F.min(F.when(F.col("free"), F.struct(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(whole)["level"]
    return stepped.withColumn("at", level).select("source", "source_size", "weight", F.when(F.col("at").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("weight") * F.col("at"))).alias("target"))


def point(slot: Column, step: int = STEP) -> Column:
    """slot * step modulo TURN; the slot is cut in two, so that no product passes 64 bits."""
    low, high = F.shiftrightunsigned(slot, 0).bitwiseAND(F.lit((1 << 20) - 1)), F.shiftrightunsigned(slot, 20)
    return F.pmod(high * F.lit((step << 20) % TURN) + low * F.lit(step), F.lit(TURN))


def schedule(goals: DataFrame, block_words: int = BLOCK_WORDS, step: int = STEP) -> DataFrame:
    """(source, slot, rank, block, words): which block of which source each slot of the mix takes.

    Raises ValueError if the points of ``step`` are so uneven that a source lacks slots.
    """
    spark = goals.sparkSession
    t = F.round("target").cast("long")
    blocks = F.ceil(F.col("source_size") / F.lit(float(block_words))).cast("long")
    wanted = F.when(t <= F.col("source_size"), F.ceil(t / F.lit(float(block_words)))).otherwise(blocks + F.ceil((t - F.col("source_size")) / F.lit(float(block_words)))).cast("long")
    plan = goals.select("source", "source_size", t.alias("t"), blocks.alias("blocks"), wanted.alias("slots")).where("slots > 0")
    total = plan.agg(F.sum("slots")).first()[0] or 0
    if 3 * total > TURN:
        raise ValueError("more slots than points: take larger blocks")
    # each source's share of the turn; its slots are the points that fall there
    before = F.coalesce(F.sum("slots").over(Window.orderBy(F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = lambda n: F.floor(n / F.lit(float(max(total, 1))) * F.lit(float(TURN))).cast("long")
    plan = materialize(plan.withColumn("from", edge(before)).withColumn("to", edge(before + F.col("slots"))), "slot-shares")
    # golden-ratio points leave no gap of 2 / n among n, so 3 * total points give every source its slots
    points = spark.range(3 * total).select(F.col("id").alias("slot"), point(F.col("id"), step).alias("point"))
    # equal cells of the turn make the range join an equality join; a share is listed in the cells that it meets
    cell = TURN // 4096
    spans = plan.select("*", F.explode(F.sequence(F.floor(F.col("from") / cell), F.floor((F.greatest("to", F.col("from") + 1) - 1) / cell))).alias("cell"))
    placed = points.withColumn("cell", F.floor(F.col("point") / cell)).join(spans, "cell").where("point >= from and point < to")
    placed = placed.select("slot", "source", "source_size", "t", "blocks", "slots", F.floor(F.col("slot") / CHUNK).cast("long").alias("chunk"))
    # the rank of a slot in its source: slots in earlier chunks, then inside the chunk
    counts = placed.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    earlier = counts.select(F.col("source").alias("s"), F.col("chunk").alias("c"), (F.sum("n").over(Window.partitionBy("source").orderBy("chunk")) - F.col("n")).alias("base"))
    ranked = placed.join(earlier, placed.source.eqNullSafe(earlier.s) & (placed.chunk == earlier.c)).withColumn("rank", F.col("base") + F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1)
    start = F.pmod("rank", "blocks") * block_words
    turn = F.floor(F.col("rank") / F.col("blocks")).cast("long")
    words = F.least(F.lit(block_words).cast("long"), F.col("source_size") - start, F.col("t") - turn * F.col("source_size") - start)
    out = materialize(ranked.where("rank < slots").select("source", "slot", "rank", F.pmod("rank", "blocks").alias("block"), words.alias("words")), "schedule")
    got = out.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("n"))
    short = plan.join(got, plan.source.eqNullSafe(got.s), "left").where("coalesce(n, 0) <> slots")
    if not short.isEmpty():
        raise ValueError("the points leave a source without some of its slots: the step is a poor one")
    return out


def row_hash(doc_id: Column, text: Column) -> Column:
    """What shuffles a source's documents; rows that share it have the same doc_id and text."""
    return F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("long").cast("string"), F.lit("")), text).cast("binary"))


def _mix(docs: DataFrame, weights=WEIGHTS, multiple: float = MULTIPLE, cap: int = CAP, block_words: int = BLOCK_WORDS, digits: int = DIGITS, step: int = STEP) -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, h, size, source_size, target, taken, slots (of its first words, ascending)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"), row_hash(F.col("doc_id"), F.col("text")).alias("h"))
    rows = materialize(rows.withColumn("bucket", F.substring("h", 1, digits)), "sizes")
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    by_source = sums.groupBy("source").agg(F.sum("n").alias("source_size"))
    goals = materialize(targets(by_source, weights, multiple, cap), "targets")
    at = (F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")).alias("base")
    base = sums.select("source", "bucket", at)
    g = goals.select(F.col("source").alias("gs"), "source_size", "target")
    # both sides of this join have a row for each bucket of a source at most
    placed = base.join(g, base.source.eqNullSafe(g.gs)).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "base", "source_size", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lined = rows.withColumn("end", F.sum("size").over(inside)).withColumn("place", F.row_number().over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id")))
    lined = lined.join(placed, lined.source.eqNullSafe(placed.s) & (lined.bucket == placed.b)).select("doc_id", "source", "bucket", "place", "h", "size", "source_size", "target", (F.col("base") + F.col("end") - F.col("size")).alias("start"))

    # at most `cap` + 1 slots take a block
    used = schedule(goals, block_words, step).groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("slot", "words"))).alias("cuts"))
    used = used.select(F.col("source").alias("us"), F.col("block").alias("ub"), "cuts")
    block_of = lambda c: F.floor(c / F.lit(block_words)).cast("long")
    last = F.greatest(F.col("start"), F.col("start") + F.col("size") - 1)
    parts = lined.select("*", F.explode(F.sequence(block_of(F.col("start")), block_of(last))).alias("block"))
    low = F.greatest(F.col("start") - F.col("block") * block_words, F.lit(0))
    high = F.least(F.col("start") + F.col("size") - F.col("block") * block_words, F.lit(block_words))
    overlap = F.aggregate("cuts", F.lit(0).cast("long"), lambda a, c: a + F.greatest(F.least(c["words"], high) - low, F.lit(0)))
    joined = parts.join(used, parts.source.eqNullSafe(used.us) & (parts.block == used.ub), "left").withColumn("got", F.coalesce(overlap, F.lit(0).cast("long")))
    first = F.when((F.col("block") == block_of(F.col("start"))) & (F.col("size") > 0), F.transform(F.filter("cuts", lambda c: c["words"] > low), lambda c: c["slot"]))
    keys = ["source", "bucket", "place", "doc_id", "h", "size", "source_size", "target"]
    return joined.withColumn("first", first).groupBy(*keys).agg(F.sum("got").alias("taken"), F.max("first").alias("slots"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, size, source_size, target, taken, first_slot (null if its first word is not taken)."""
    return _mix(docs, **options).select("doc_id", "source", "size", "source_size", "target", "taken", F.try_element_at("slots", F.lit(1)).alias("first_slot"))


def mixed_documents(docs: DataFrame, partition_bytes: int = 32 << 20, **options) -> DataFrame:
    """The documents of the mix in the order of its schedule: a row for each time that a document is taken, rounded to whole documents.

    Rows that agree in doc_id, source and text are taken alike. The rows are
    dealt to partitions by equal ranges of slots and sorted in them, so that files
    written from them, read one after the other, are the mix.
    """
    id_, source, h, slot = (free_name(docs, n) for n in ("__id", "__source", "__hash", "__slot"))
    takes = _mix(docs, **options).groupBy("doc_id", "source", "h").agg(F.sum("taken").alias("taken"), F.sum("size").alias("n"), F.max("slots").alias("slots"))
    times = F.floor(F.col("taken") / F.greatest("n", F.lit(1)) + F.lit(0.5)).cast("int")
    # the k-th copy comes where the k-th slot takes the document's first words
    places = F.transform(F.sequence(F.lit(1), F.greatest(times, F.lit(1))), lambda k: F.coalesce(F.try_element_at("slots", k), F.try_element_at("slots", F.lit(-1))))
    taken = materialize(takes.where(times > 0).select(F.col("doc_id").alias(id_), F.col("source").alias(source), F.col("h").alias(h), places.alias(slot)), "takes")
    slots = (taken.agg(F.max(F.try_element_at(slot, F.lit(-1)))).first()[0] or 0) + 1
    key = row_hash(docs["doc_id"], docs["text"])
    same = (key == taken[h]) & docs["source"].cast("string").eqNullSafe(taken[source])
    rows = docs.join(taken, same).select(*[docs[f"`{c}`"] for c in docs.columns], taken[h], F.explode(taken[slot]).alias(slot))
    # slots are of equal size, so equal ranges of them need no sampling of the texts
    n = partitions_for(docs, partition_bytes)
    return rows.repartitionById(n, F.floor(F.col(slot) * F.lit(n) / F.lit(float(slots))).cast("int")).sortWithinPartitions(slot, h).drop(slot, h)
