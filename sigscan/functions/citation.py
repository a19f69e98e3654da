"""Journal and year of a citation such as ``J Test. 2010 Jan 5; 1(2):3-4``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigscan.functions.text import W, trim_ws

# fixed values: the words that a date may hold
SEASONS = ["Spring", "spring", "Summer", "summer", "Fall", "fall", "Autumn", "autumn", "Winter", "winter"]
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]

# fixed values: the grammar of a citation's start; another order of its parts would accept other citations
_S, _M = "|".join(SEASONS), "|".join(MONTHS)
_DATE = (
    rf"((?:16|17|18|19|20)[0-9]{{2}})(?:{W}[A-Za-z]{{3}}(?:{W}[0-9]{{1,2}})?)?"
    rf"(?:{W}[0-9]{{1,2}})?(?:-[0-9]{{1,2}})?(?:{W}[A-Za-z]{{3}}(?:-{W}?[A-Za-z]{{3}})?)?"
    rf"(?:{W}(?:{_S}))?(?:(?:-|{W})?(?:{_S}))?(?:{W}(?:{_M}))?(?:(?:-|{W})?(?:{_M}))?"
)
#: Groups: 1 journal (up to the last dot that still fits), 2 year. Both may be missing; the semicolon may not.
PATTERN = rf"^(?:([^\n]+)\.)?{W}*(?:{_DATE})?;"


def is_valid(citation: Column) -> Column:
    """Whether the citation fits the grammar; null does not."""
    return F.coalesce(trim_ws(citation).rlike(PATTERN), F.lit(False))


def _group(citation: Column, k: int) -> Column:
    return F.nullif(trim_ws(F.regexp_extract(trim_ws(citation), PATTERN, k)), F.lit(""))


def journal(citation: Column) -> Column:
    return _group(citation, 1)


def year(citation: Column) -> Column:
    """The year as text."""
    return _group(citation, 2)
