"""Operator 13, chat formatting: conversations rendered by a compiled template (:mod:`sigscan.llm.template`), with the spans that a model learns, and read back.

Rows of a conversation are in the order of turn (nulls first), role, text. A
task renders its conversations from the stream of its sorted rows and writes
them in pieces of about ``PIECE`` characters, so a conversation of any number of
turns passes through bounded memory; only a single text must fit. Files are read back by a task each, which streams their pieces.

A null text or role is an empty one; a null conv_id is a conversation of its
own; rows that repeat are turns of their own; any text may hold the template's control strings. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigscan.llm.common import open_fs, tidied
from sigscan.llm.template import BEGIN, END, Controls, Template
from sigscan.session import materialize, partitions_for, ship

PIECE = 1 << 18
#: The marks around a turn of each role, and around the role and text of any other.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("[SYS]", "[/SYS]")}
OTHER = ("[ROLE]", "[TEXT]", "[/ROLE]")
CONTROLS = [*(c for pair in MARKS.values() for c in pair), *OTHER]
#: One line end behind each turn, whatever its role.
TEMPLATE = """
{%- set turn_end = '\\n' -%}
{%- for m in messages -%}
  {%- if m.role == 'assistant' -%} {{ '<' ~ 's>' }}{% generation %}{{ m.text | escape }}{% endgeneration %}</s>
  {%- elif m.role == 'user' -%} [INST]{{ m.text | escape }}[/INST]
  {%- elif m.role == 'system' -%} [SYS]{{ m.text | escape }}[/SYS]
  {%- else -%} [ROLE]{{ m.role | escape }}[TEXT]{{ m.text | escape }}[/ROLE]
  {%- endif -%} {{ turn_end }}
{%- endfor -%}
"""
FORMATTED = "conv_id long, piece int, text string, spans array<struct<start:int,end:int>>"


def pieces(output: Iterable, limit: int = PIECE) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Rendered output in pieces: (text, spans of generations in it). A generation that a piece's end cuts is continued in the next one."""
    parts, spans, n, start = [], [], 0, None
    for x in output:
        if x is BEGIN:
            start = n
        elif x is END:
            spans.append((start, n))
            start = None
        else:
            parts.append(x)
            n += len(x)
            if n >= limit:
                if start is not None and start < n:
                    spans.append((start, n))
                yield "".join(parts), spans
                parts, spans, n, start = [], [], 0, None if start is None else 0
    if parts or spans:
        yield "".join(parts), spans


def turns(texts: Iterable[str], controls: Controls) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns of a formatted conversation that comes in pieces; raises ValueError where the format is broken."""
    rest, need = "", 0
    for piece in texts:
        rest += piece
        if len(rest) >= need:
            found, rest = _complete(rest, controls)
            yield from found
            need = 2 * len(rest)  # a turn over many pieces is looked through again when it has doubled
    found, rest = _complete(rest, controls)
    yield from found
    if rest:
        raise ValueError(f"a turn is cut off at {rest[-20:]!r}")


_BY_OPEN = {a: (role, b) for role, (a, b) in MARKS.items()}


def _complete(text: str, controls: Controls) -> tuple[list[tuple[str, str]], str]:
    """The whole turns that ``text`` begins with, and the rest."""
    found, at = [], 0
    while at < len(text):
        m = controls.split.match(text, at)
        if not m or (m[0] not in _BY_OPEN and m[0] != OTHER[0]):
            raise ValueError(f"a turn should begin at {text[at : at + 20]!r}")
        role, close = _BY_OPEN.get(m[0], (None, OTHER[2]))
        end = text.find(close + "\n", m.end())
        if end < 0:
            break
        inside = text[m.end() : end]
        if role is None:
            role, _, inside = inside.partition(OTHER[1])
            role = controls.unescape(role)
        found.append((role, controls.unescape(inside)))
        at = end + len(close) + 1
    return found, text[at:]


def _rows(batches) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(k).to_pylist() for k in range(b.num_columns)), strict=True)


_SCHEMA = pa.schema([("conv_id", pa.int64()), ("piece", pa.int32()), ("text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


def format_conversations(conversations: DataFrame, source: str = TEMPLATE, controls: Iterable[str] = tuple(CONTROLS), piece: int = PIECE) -> DataFrame:
    """(conv_id, piece, text, spans): formatted conversations in pieces, written to the shared folder; spans are those of generations, in characters of the piece."""
    ship(conversations.sparkSession)
    controls = list(controls)
    Template(source, controls)  # refuse it here rather than in tasks

    @tidied
    def run(batches):
        template, out, size = Template(source, controls), [], 0
        for conv_id, rows in groupby(_rows(batches), itemgetter(0)):
            messages = ({"role": role, "text": text} for _, role, text in rows)
            for k, (text, spans) in enumerate(pieces(template.render(messages=messages), piece)):
                out.append({"conv_id": conv_id, "piece": k, "text": text, "spans": [{"start": a, "end": b} for a, b in spans]})
                size += len(text) + 100
                if size > 1 << 21:
                    yield pa.RecordBatch.from_pylist(out, _SCHEMA)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, _SCHEMA)

    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), known("role"), known("text"))
    dealt = rows.repartition(partitions_for(conversations, 16 << 20), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return materialize(dealt.mapInArrow(run, FORMATTED), "formatted")


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame, controls: Iterable[str] = tuple(CONTROLS)) -> DataFrame:
    """What the files of :func:`format_conversations` hold of each conversation: its turns and the text that is learned, both unescaped, by number and digest."""
    spark = formatted.sparkSession
    by_task: dict[str, list[str]] = {}
    for path in sorted(formatted.inputFiles()):
        by_task.setdefault(re.search(r"([^/]*part-\d+|[^/]+)[^/]*$", path)[1], []).append(path)
    files = spark.createDataFrame([(v,) for v in by_task.values()], "paths array<string>")
    controls = list(controls)

    def stream(paths):
        for path in paths:
            fs, at = open_fs(path)
            with fs.open_input_file(at) as f:
                for b in pq.ParquetFile(f).iter_batches(batch_size=64, columns=["conv_id", "text", "spans"]):
                    yield b

    @tidied
    def run(batches):
        marks = Template("", controls).controls
        for b in batches:
            out = []
            for paths in b.column(0).to_pylist():
                for conv_id, rows in groupby(_rows(stream(paths)), itemgetter(0)):
                    all_turns, loss = hashlib.sha256(), hashlib.sha256()
                    n = {"turns": 0, "loss": 0, "chars": 0}

                    def texts(rows=rows, loss=loss, n=n):
                        for _, text, spans in rows:
                            n["chars"] += len(text)
                            for s in spans:
                                learned = marks.unescape(text[s["start"] : s["end"]])
                                n["loss"] += len(learned)
                                loss.update(learned.encode())
                            yield text

                    for role, text in turns(texts(), marks):
                        all_turns.update(f"{role}\n{text}\n".encode())
                        n["turns"] += 1
                    out.append((conv_id, n["turns"], all_turns.hexdigest(), n["loss"], loss.hexdigest(), n["chars"]))
                    if len(out) >= 8192:
                        yield _batch(out)
                        out = []
            if out:
                yield _batch(out)

    return files.repartition(max(len(by_task), 1)).mapInArrow(run, READ) if by_task else spark.createDataFrame([], READ)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split(" ")[0] for x in READ.split(", ")])


def chat_round_trip(conversations: DataFrame) -> DataFrame:
    """Format all conversations and one that says control strings (-7), and read them back."""
    spark = conversations.sparkSession
    trap = spark.createDataFrame([(-7, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(conversations.select("conv_id", "turn", "role", "text").unionByName(trap)))
