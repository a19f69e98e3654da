"""A paged literature service as a Spark source. The service itself is a parameter, so everything runs without a network.

A service has ``count(db, query) -> int``, ``ids(db, query, start, size) ->
list[str]`` and ``fetch(db, ids) -> {id: xml}``; it is pickled to executors.
"""

from __future__ import annotations

from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigscan.session import ship
from sigscan.sources.xmltext import abstract_nodes, publication_types, record_line

PAGE, ABSTRACT_BATCH, ARTICLE_BATCH = 100_000, 1000, 200


class Service(Protocol):
    def count(self, db: str, query: str) -> int: ...
    def ids(self, db: str, query: str, start: int, size: int) -> list[str]: ...
    def fetch(self, db: str, ids: list[str]) -> dict[str, str]: ...


def count_ids(service: Service, query: str, db: str = "pubmed") -> int:
    return service.count(db, query)


def search_pages(spark: SparkSession, service: Service, query: str, db: str = "pubmed", page: int = PAGE) -> DataFrame:
    """(page, article_id, error) of a search: a task for each page. The count must succeed; a page that fails is one row with its error."""
    ship(spark)
    pages = max(1, -(-service.count(db, query) // page))

    def run(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                try:
                    got, error = service.ids(db, query, k * page, page), None
                except OSError as e:
                    got, error = [None], str(e) or type(e).__name__
                yield pa.RecordBatch.from_pydict({"page": pa.array([k] * len(got), pa.int64()), "article_id": pa.array(got, pa.string()), "error": pa.array([error] * len(got), pa.string())})

    return spark.range(0, pages, 1, pages).mapInArrow(run, "page long, article_id string, error string")


def all_ids(spark: SparkSession, service: Service, query: str, db: str = "pubmed", page: int = PAGE) -> DataFrame:
    """(article_id) of a search; pages that fail are absent, :func:`search_pages` tells which."""
    return search_pages(spark, service, query, db, page).where("error is null").select("article_id")


def fetch_records(ids: DataFrame, service: Service, db: str = "pubmed", batch: int = ABSTRACT_BATCH) -> DataFrame:
    """(article_id, xml, error) of ids, requested in batches; the ids of a batch that fails come with its error, to be asked for again."""
    ship(ids.sparkSession)

    def run(batches):
        held: list[str] = []

        def ask(part):
            try:
                got, error = service.fetch(db, part), None
            except OSError as e:
                got, error = dict.fromkeys(part), str(e) or type(e).__name__
            return pa.RecordBatch.from_pydict({"article_id": pa.array(list(got), pa.string()), "xml": pa.array(list(got.values()), pa.string()), "error": pa.array([error] * len(got), pa.string())})

        for b in batches:
            held += b.column(0).to_pylist()
            while len(held) >= batch:
                part, held = held[:batch], held[batch:]
                yield ask(part)
        if held:
            yield ask(held)

    return ids.select(F.col(ids.columns[0]).cast("string")).mapInArrow(run, "article_id string, xml string, error string")


def fetch_xml(ids: DataFrame, service: Service, db: str = "pubmed", batch: int = ABSTRACT_BATCH) -> DataFrame:
    """(article_id, xml) of ids; a batch that fails gives no rows, :func:`fetch_records` tells which."""
    return fetch_records(ids, service, db, batch).where("error is null").select("article_id", "xml")


def abstract_lines(spark: SparkSession, service: Service, query: str, batch: int = ABSTRACT_BATCH) -> DataFrame:
    """(article_id, line): a search's records as tab-separated lines."""
    return fetch_xml(all_ids(spark, service, query), service, batch=batch).select("article_id", record_line(F.col("xml")).alias("line")).where("line is not null")


def abstracts(ids: DataFrame, service: Service, cap: int | None = 1000, batch: int = ARTICLE_BATCH) -> DataFrame:
    """(article_id, text): abstract texts of full articles; ``cap`` keeps the first ids in string order, None keeps all."""
    first = ids if cap is None else ids.orderBy(ids.columns[0]).limit(cap)
    return fetch_xml(first, service, "pmc", batch).select("article_id", abstract_nodes(F.col("xml")).alias("text"))


def journal_ids(spark: SparkSession, service: Service, journals: list[str], first: int | None = 10, page: int = PAGE) -> DataFrame:
    """(journal, article_id) of open-access articles of journals, the first ten by default; a search that fails gives none. A task counts each journal, another reads each page."""
    ship(spark)
    names = sorted(set(journals))[:first]
    if not names:
        return spark.createDataFrame([], "journal string, article_id string")
    search = lambda j: f'"{j}"[Journal] AND open access[filter]'

    def pages(batches):
        for b in batches:
            for j in b.column(0).to_pylist():
                try:
                    n = -(-service.count("pmc", search(j)) // page)
                except OSError:
                    n = 0
                yield pa.RecordBatch.from_pydict({"journal": pa.array([j] * n, pa.string()), "page": pa.array(range(n), pa.int64())})

    def ids(batches):
        for b in batches:
            for j, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    got = service.ids("pmc", search(j), k * page, page)
                except OSError:
                    continue
                yield pa.RecordBatch.from_pydict({"journal": pa.array([j] * len(got), pa.string()), "article_id": pa.array(got, pa.string())})

    asked = spark.createDataFrame([(j,) for j in names], "journal string").repartition(len(names)).mapInArrow(pages, "journal string, page long")
    return asked.repartition(max(len(names), spark.sparkContext.defaultParallelism)).mapInArrow(ids, "journal string, article_id string")


def journal_blocks(spark: SparkSession, service: Service, journals: list[str], first: int | None = 10) -> DataFrame:
    """(journal, article_id, block) of the abstracts of journals' articles, in order: a block is a text and the blank line that parts it from the next."""
    ids = journal_ids(spark, service, journals, first)
    texts = abstracts(ids.select("article_id").distinct(), service, cap=None)
    return ids.join(texts, "article_id").where("text is not null").select("journal", "article_id", F.concat("text", F.lit("\n\n")).alias("block")).orderBy("journal", "article_id")


def type_fetcher(service: Service):
    """A fetcher for :func:`sigscan.operators.metadata.enrich_types`."""
    return lambda ids, n: fetch_xml(ids, service, batch=n).select(F.col("article_id").alias("PMID"), publication_types(F.col("xml")).alias("fetched"))
