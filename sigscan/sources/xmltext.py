"""Text of article XML. Mixed content and tolerance of malformed input are beyond the JVM's XML functions, so this is Arrow-batched Python.

A document is read as events in one pass: only the texts that are asked for are
held, never a tree, and a document may come in pieces.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from sigscan.session import ship

_ABSTRACT, _BODY = ("abstract", "Abstract", "ABSTRACT"), ("body", "Body", "BODY")


class _Events:
    """A parser's target that keeps texts of some elements, in the order in which they begin.

    ``whole`` elements keep all text inside them, ``own`` elements the text
    before their first child; with ``nodes`` each whole element also keeps the own
    texts of everything inside it.
    """

    def __init__(self, whole: Iterable[str] = (), own: Iterable[str] = (), nodes: bool = False):
        self.whole, self.own, self.nodes = frozenset(whole), frozenset(own), nodes
        self.found: list[tuple[str, list[str], list[list[str]]]] = []
        self.open: list[tuple[str, list[str], list[list[str]]]] = []  # whole elements around
        self.texts: list[list[str] | None] = []  # own text of each element around, None once it had a child

    def start(self, tag: str, attributes: dict) -> None:
        if self.texts:
            self.texts[-1] = None
        if tag in self.whole:
            self.open.append((tag, [], []))
            self.found.append(self.open[-1])
        own: list[str] | None = None
        if tag in self.own:
            own = []
            self.found.append((tag, own, []))
        elif self.nodes and self.open:
            own = []
        if self.nodes and own is not None:
            for e in self.open:
                e[2].append(own)
        self.texts.append(own)

    def data(self, text: str) -> None:
        for e in self.open:
            e[1].append(text)
        if self.texts and self.texts[-1] is not None:
            self.texts[-1].append(text)

    def end(self, tag: str) -> None:
        self.texts.pop()
        if tag in self.whole:
            self.open.pop()

    def close(self) -> _Events:
        return self


def _read(data: str | bytes | Iterable[bytes] | None, **wanted) -> _Events | None:
    """What a document holds of the wanted elements; None for no document or a malformed one."""
    if data is None:
        return None
    parser = ET.XMLParser(target=_Events(**wanted))
    try:
        for piece in (data,) if isinstance(data, (str, bytes)) else data:
            parser.feed(piece)
        return parser.close()
    except (ET.ParseError, ValueError, LookupError):
        return None


def section_texts(data: str | bytes | Iterable[bytes] | None) -> tuple[str | None, str | None]:
    """(abstract, body): the stripped texts of matching elements in document order, joined by line feeds; (None, None) if malformed. A document may be given in pieces."""
    read = _read(data, whole=_ABSTRACT + _BODY)
    if read is None:
        return None, None
    join = lambda tags: "\n".join(t for tag, text, _ in read.found if tag in tags and (t := "".join(text).strip())) or None
    return join(_ABSTRACT), join(_BODY)


@pandas_udf(T.StructType([T.StructField("abstract", T.StringType()), T.StructField("body", T.StringType())]))
def _article_sections(content: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in content:
        yield pd.DataFrame([section_texts(x) for x in s], columns=["abstract", "body"], dtype=object)


def node_texts(data: str | bytes | None) -> str | None:
    """Own texts of abstract elements and of everything inside them, stripped and blank-joined."""
    read = _read(data, whole=_ABSTRACT, nodes=True)
    return None if read is None else " ".join(t for _, _, nodes in read.found for own in nodes if (t := "".join(own).strip()))


@pandas_udf(T.StringType())
def _abstract_nodes(content: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in content:
        yield s.map(node_texts)


def own_texts(data: str | bytes | None, *tags: str) -> dict[str, list[str]] | None:
    """The texts before the first child of elements, by tag; empty ones are left out."""
    read = _read(data, own=tags)
    return None if read is None else {tag: [t for found, text, _ in read.found if found == tag and (t := "".join(text))] for tag in tags}


def types_of(xml: str | bytes | None) -> str | None:
    texts = own_texts(xml, "PublicationType")
    return None if texts is None else " ; ".join(texts["PublicationType"])


def line_of(xml: str | bytes | None) -> str | None:
    texts = own_texts(xml, "PMID", "AbstractText")
    return "\t".join([texts["PMID"][0], *texts["AbstractText"]]) if texts and texts["PMID"] else None


@pandas_udf(T.StringType())
def _publication_types(xml: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in xml:
        yield s.map(types_of)


@pandas_udf(T.StringType())
def _record_line(xml: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in xml:
        yield s.map(line_of)


def _shipped(udf, content) -> Column:
    """The column of a function of this module, which executors can then import."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship(spark)
    return udf(content)


def article_sections(content: Column | str) -> Column:
    """Struct (abstract, body) of article XML, text or bytes."""
    return _shipped(_article_sections, content)


def abstract_nodes(content: Column | str) -> Column:
    """Texts of all descendants of abstract elements, blank-joined: pieces of text in order, null if malformed."""
    return _shipped(_abstract_nodes, content)


def publication_types(xml: Column | str) -> Column:
    """The PublicationType texts of a record, joined by " ; "; null if malformed."""
    return _shipped(_publication_types, xml)


def record_line(xml: Column | str) -> Column:
    """PMID and its AbstractText elements as one tab-separated line; null without a PMID or if malformed."""
    return _shipped(_record_line, xml)
