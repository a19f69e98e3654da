"""Operator 11, conversation structure repair by a time-major tensor programme (:mod:`sigscan.llm.convdp`).

Rows are judged by digests, so that texts move only where they are returned: rows
get their places in their conversations, a row whose role and text stand at an
earlier place is a duplicate, and blocks of ``BLOCK`` rows of a conversation, a
byte a row, go to the programme. A conversation may have any number of rows: its
blocks are bucketed and updated like those of different conversations. A task
holds a byte or two of each row of a conversation, as the audit that it returns does.

Rows of a conversation are in the order of turn (nulls first), of one turn by role, then by a digest of their text.
A null role or text is one blank; a null conv_id is a conversation of its own; a
role that begins with neither s, u nor a, or is empty, cannot be kept. Repeated rows are duplicates. Texts of
any length are read whole. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigscan.llm import convdp
from sigscan.llm.common import tidied
from sigscan.operators.ordering import positions
from sigscan.session import materialize, partitions_for, ship, spread

#: Rows of a block, and rows of conversations that a task repairs at once.
BLOCK, AT_ONCE = 4096, 1 << 18
#: Faults in the code of a row, 4 * role + fault, and what each means to the programme.
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
_FAULTS = np.array([convdp.NONE, convdp.GONE, convdp.GONE, convdp.TRUNCATED], np.uint8)
_SPACE = " \t\n\x0b\x0c\r"
_ROLES = {"u": "user", "a": "assistant"}


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) after the damage that the crc32 of ``conv_id:turn`` chooses; nulls read as one blank."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), known("role").alias("role"), known("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _said() -> F.Column:
    """A digest of conversation, role and text."""
    role = F.col("role")
    return F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.length(role).cast("string"), role, "text"), 256))


def place(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, said, code, pos): rows at their places; code has the role's initial and the faults that a row has by itself."""
    tail = F.rtrim(F.col("text"), F.lit(_SPACE))
    fault = F.when(tail == "", BLANK).when(F.right(tail, F.lit(1)).isin(".", "!", "?"), 0).otherwise(TRUNCATED)
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "u", convdp.USER).when(initial == "a", convdp.ASSISTANT).when(initial == "s", convdp.SYSTEM).otherwise(convdp.OTHER)
    compact = rows.select("conv_id", "turn", "role", _said().alias("said"), (role * 4 + fault).cast("int").alias("code"))
    return positions(compact, ["conv_id"], ["turn", "role", "said"])


_SOLVED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, end int, plans array<binary>"


class _Conversation:
    """Blocks of one conversation, and what is counted of its rows."""

    def __init__(self, conv_id):
        self.conv_id, self.blocks, self.faults, self.turns, self.least, self.last = conv_id, [], np.zeros(4, np.int64), 0, None, None

    def add(self, codes: np.ndarray, turns: np.ndarray) -> None:
        """Codes and turns that are not null of the next block; turns are in order."""
        self.faults += np.bincount(codes & 3, minlength=4)
        self.blocks.append((codes >> 2) * 3 + _FAULTS[codes & 3])
        if len(turns):
            self.turns += int((turns[1:] != turns[:-1]).sum()) + (self.last is None or int(turns[0]) != self.last)
            self.least, self.last = int(turns[0]) if self.least is None else self.least, int(turns[-1])

    def row(self, solved: tuple) -> dict:
        cost, plan, end = solved
        gaps = 0 if self.least is None else self.last - self.least + 1 - self.turns
        return {
            "conv_id": self.conv_id, "gaps": gaps, "blank": self.faults[BLANK], "duplicate": self.faults[DUPLICATE], "truncated": self.faults[TRUNCATED],
            "illegal": convdp.illegal(self.blocks), "cost": cost, "audit": convdp.audit(plan, end).decode(), "end": end, "plans": [p.tobytes() for p in plan],
        }


_SCHEMA = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(t, pa.list_(pa.binary()))) for n, t in (x.split(" ") for x in _SOLVED.split(", "))])


def _solve(batches):
    held, rows = [], 0

    def done(conversations):
        found = convdp.repair([c.blocks for c in conversations])
        return pa.RecordBatch.from_pylist([c.row(x) for c, x in zip(conversations, found, strict=True)], _SCHEMA)

    for b in batches:
        lists = b.column(1)
        flat, ends = lists.flatten(), np.cumsum(lists.value_lengths().to_numpy())
        codes, turns = flat.field("code").to_numpy().astype(np.uint8), flat.field("turn")
        for k, conv_id in enumerate(b.column(0).to_pylist()):
            if not held or held[-1].conv_id != conv_id:
                if rows > AT_ONCE:
                    yield done(held)
                    held, rows = [], 0
                held.append(_Conversation(conv_id))
            start, stop = ends[k - 1] if k else 0, ends[k]
            held[-1].add(codes[start:stop], turns.slice(start, stop - start).drop_null().to_numpy())
            rows += stop - start
    if held:
        yield done(held)


def solve(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each conversation that has rows: what is wrong, the cheapest repair's cost and audit, and its plan by blocks."""
    first = placed.groupBy("said").agg(F.min("pos").alias("first"))
    fault = F.when((F.col("code") % 4 != BLANK) & (F.col("pos") > F.col("first")), F.col("code") - F.col("code") % 4 + DUPLICATE).otherwise(F.col("code"))
    coded = placed.join(first, "said").select("conv_id", "pos", "turn", fault.alias("code"))
    blocks = coded.groupBy("conv_id", F.floor(F.col("pos") / block).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "code", "turn"))).alias("rows"))
    return blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block").select("conv_id", "rows").mapInArrow(tidied(_solve), _SOLVED)


def _unpack(batches):
    for b in batches:
        conv, base, plans, end = b.column(0), b.column(1).to_numpy(), b.column(2).to_pylist(), b.column(3)
        lens = np.fromiter(map(len, plans), np.int64, len(plans))
        block, start = np.repeat(np.arange(len(plans)), lens), lens.cumsum() - lens
        row, places, edits, roles = convdp.steps(np.frombuffer(b"".join(plans), np.uint8))
        owner = block[row]
        kinds = [(owner, base[owner] + row - start[owner], places, edits, roles)]
        # behind the last block of a conversation: insertions after its rows
        after = np.where(end.is_null(), 0, convdp.END[pc.fill_null(end, 0).to_numpy()] // convdp.INSERT)
        for k in (0, 1):
            has = np.flatnonzero(after > k)
            kinds.append((has, base[has] + lens[has], np.full(len(has), k), np.full(len(has), ord("I")), np.where(after[has] - k == 2, ord("u"), ord("a"))))
        owner, pos, places, edits, roles = (np.concatenate(x) for x in zip(*kinds, strict=True))
        kept = edits != ord("D")
        text = lambda x: pa.array(x[kept].astype(np.uint8).view("S1").astype("U1") if kept.any() else [], pa.string())  # noqa: B023, E731
        yield pa.RecordBatch.from_arrays([conv.take(pa.array(owner[kept])), pa.array(pos[kept], pa.int64()), pa.array(places[kept], pa.int32()), text(edits), text(roles)], ["conv_id", "pos", "place", "edit", "role"])


def repaired(rows: DataFrame, placed: DataFrame, solved: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, pos, place, edit, turn, role, text): the rows of the repaired conversations; inserted ones stand before the row at pos, with an empty text."""
    plans = solved.select("conv_id", F.posexplode("plans").alias("block", "plan"), F.size("plans").alias("n"), "end")
    plans = plans.select("conv_id", F.col("block") * F.lit(block).cast("long"), "plan", F.when(F.col("block") == F.col("n") - 1, F.col("end")).alias("end"))
    # what a plan of a few bytes unpacks to is far more than Spark's estimate of it, so both joins are kept from broadcasting
    edits = spread(plans).mapInArrow(tidied(_unpack), "conv_id long, pos long, place int, edit string, role string")
    renamed = F.when(F.col("e.role") == "u", "user").when(F.col("e.role") == "a", "assistant")
    kept = edits.alias("e").where("edit <> 'I'").hint("merge").join(placed.alias("p"), F.col("e.conv_id").eqNullSafe(F.col("p.conv_id")) & (F.col("e.pos") == F.col("p.pos")))
    kept = kept.select("e.conv_id", "e.pos", "e.place", "e.edit", "p.turn", "p.said", renamed.alias("as"))
    # of rows with one digest the first alone may be kept, so a digest has one text
    texts = rows.select(_said().alias("said"), "role", "text").dropDuplicates(["said"])
    kept = kept.hint("merge").join(texts, "said").select("conv_id", "pos", "place", "edit", "turn", F.coalesce("as", "role").alias("role"), "text")
    return kept.unionByName(edits.alias("e").where("edit = 'I'").select("conv_id", "pos", "place", "edit", F.lit(None).cast("long").alias("turn"), renamed.alias("role"), F.lit("").alias("text")))


def _hash(batches):
    """Digests of conversations whose rows come in order: a row's text is not held longer than its batch."""
    schema = pa.schema([("conv_id", pa.int64()), ("digest", pa.string())])
    now, h = None, None
    for b in batches:
        out = []
        for conv_id, role, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            if h is None or conv_id != now:
                if h is not None:
                    out.append({"conv_id": now, "digest": h.hexdigest()})
                now, h, sep = conv_id, hashlib.sha256(), ""
            h.update(f"{sep}{role}:{text}".encode())
            sep = "\n"
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    if h is not None:
        yield pa.RecordBatch.from_pylist([{"conv_id": now, "digest": h.hexdigest()}], schema)


def digests(rows: DataFrame, partitions: int) -> DataFrame:
    """(conv_id, digest): SHA-256 of the newline-joined ``role:text`` of each conversation, read in order; a hash is sequential, so one task streams a conversation."""
    dealt = rows.repartition(partitions, "conv_id").sortWithinPartitions("conv_id", "pos", "place").select("conv_id", "role", "text")
    return dealt.mapInArrow(tidied(_hash), "conv_id long, digest string")


def repair(rows: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Of rows (conv_id, turn, role, text): what was wrong with each conversation and its repair, and the repaired rows."""
    ship(rows.sparkSession)
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    placed = place(rows)
    solved = materialize(solve(placed, block), "repairs")
    return solved, repaired(rows, placed, solved, block)


def repair_damaged(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """Damage, repair and digest: a row for every conv_id of the table, those without rows after the damage with zeros and empty strings."""
    solved, fixed = repair(damage(conversations), block)
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    counts = [F.coalesce(F.col(f"s.{c}"), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    out = ids.alias("i").join(solved.alias("s"), F.col("i.conv_id").eqNullSafe(F.col("s.conv_id")), "left").join(digests(fixed, partitions_for(conversations, 16 << 20)).alias("d"), F.col("i.conv_id").eqNullSafe(F.col("d.conv_id")), "left")
    return out.select("i.conv_id", *counts, F.coalesce("s.audit", F.lit("")).alias("audit"), F.coalesce("d.digest", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
