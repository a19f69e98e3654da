"""Searches, counts, capped abstracts and journal blocks against a made-up literature service. They need a service, so they are not among the queries on given tables."""

import re
import sys

from pyspark import cloudpickle

from sigscan.functions.categories import query_text
from sigscan.sources import literature

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors can't import tests
JOURNALS = ["Acta Test", "Ward Notes"]
_MADE_TYPES = {"Randomized Controlled Trial": 5, "Clinical Trial": 3, "Meta-analysis": 7, "Review": 4, "Systematic Review": 11, "Observational Study": 13}


class SearchService:
    """A literature service that evaluates the search text against made-up records: record k has the types whose number divides it, and a year, journal and flags by arithmetic. The years' 17 shares no factor with the other numbers, so that every search finds some."""

    def __init__(self, n: int):
        self.n = n

    @staticmethod
    def _matches(k: int, term: str) -> bool:
        word, field = re.fullmatch(r'"?([^"\[]*)"?(?:\[([A-Za-z]+)\])?', term.strip()).groups()
        if field == "PT":
            return k % {t.lower(): d for t, d in _MADE_TYPES.items()}[word.lower()] == 0
        if field == "PDAT":
            return 1996 + k % 17 == int(word)
        if field == "Journal":
            return k % 8 == ["Acta Test", "Annals of Tests", "J Sample Res", "Ward Notes"].index(word)
        return {"hasabstract": k % 3 != 1, "medline": k % 13 != 5, "open access": k % 2 == 0}[word]

    def _all(self, query: str) -> list[str]:
        parts = [(neg == "NOT", [t for t in re.split(r" OR ", p.strip("()"))]) for neg, p in re.findall(r"(?:^| AND | (NOT) )(\([^)]*\)|(?:(?! AND | NOT ).)+)", query)]
        return [str(k) for k in range(self.n) if all(any(self._matches(k, t) for t in terms) != neg for neg, terms in parts)]

    def count(self, db: str, query: str) -> int:
        return len(self._all(query))

    def ids(self, db: str, query: str, start: int, size: int) -> list[str]:
        return self._all(query)[start : start + size]

    def fetch(self, db: str, ids: list[str]) -> dict[str, str]:
        return {i: f"<article><front><Abstract><p> t{i} </p><p>u</p></Abstract></front></article>" for i in ids}


KINDS = {
    "all": lambda k: True, "rct": lambda k: k % 5 == 0, "ct": lambda k: k % 3 == 0 and k % 5 != 0, "meta": lambda k: k % 7 == 0, "review": lambda k: k % 4 == 0 and k % 7 != 0,
    "cuj": lambda k: k % 8 in (0, 3), "Systematic_Review": lambda k: k % 11 == 0, "Observational_Study": lambda k: k % 13 == 0,
}


def test_every_search_finds_some(spark):
    """The searches of a year against plain arithmetic on 1,000 records; no category may be empty, or the test would show nothing."""
    service = SearchService(1000)
    for field, test in KINDS.items():
        want = {str(k) for k in range(1000) if 1996 + k % 17 == 2000 and k % 3 != 1 and k % 13 != 5 and test(k)}
        got = [r.article_id for r in literature.all_ids(spark, service, query_text(field, 2000, JOURNALS), page=7).collect()]
        assert want and set(got) == want and len(got) == len(want)
        assert literature.count_ids(service, query_text(field, 2000, JOURNALS)) == len(want)


def test_abstracts_and_journals(spark):
    service = SearchService(200)
    ids = literature.all_ids(spark, service, "open access[filter]", "pmc", page=30)
    capped = sorted((r.article_id, r.text) for r in literature.abstracts(ids, service, cap=20, batch=6).collect())
    assert capped == [(k, f"t{k} u") for k in sorted(str(k) for k in range(0, 200, 2))[:20]]
    names = ["Ward Notes", "J Sample Res", "Annals of Tests", "Acta Test", "Acta Test"]
    found = sorted((r.journal, int(r.article_id)) for r in literature.journal_ids(spark, service, names, first=2, page=9).collect())
    assert found == sorted(("Acta Test" if k % 8 == 0 else "Annals of Tests", k) for k in range(200) if k % 8 in (0, 1) and k % 2 == 0)
    blocks = {(r.journal, r.article_id, r.block) for r in literature.journal_blocks(spark, service, ["Acta Test"]).collect()}
    assert blocks == {("Acta Test", str(k), f"t{k} u\n\n") for k in range(0, 200, 8)}


class Records(SearchService):
    def fetch(self, db, ids):
        return {i: f"<r><PubmedArticle><PMID>{i}</PMID><AbstractText>a{i}</AbstractText><AbstractText>b</AbstractText></PubmedArticle></r>" for i in ids}


def test_lines_of_records(spark):
    lines = sorted((r.article_id, r.line) for r in literature.abstract_lines(spark, Records(100), query_text("all", 2000), batch=7).collect())
    want = [str(k) for k in range(100) if 1996 + k % 17 == 2000 and k % 3 != 1 and k % 13 != 5]
    assert lines == sorted((k, f"{k}\ta{k}\tb") for k in want)
