"""Text functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str methods see it; regular-expression engines differ on ``\s``, so it is spelled out.
WS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
W = f"[{WS}]"
#: The same characters one by one.
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def trim_ws(c: Column) -> Column:
    """Strip white space of any kind at both ends."""
    return F.btrim(c, F.lit(SPACES))  # linear, where a pattern tries every run inside the text


def not_blank(c: Column) -> Column:
    """True for text with something other than white space."""
    return F.coalesce(F.ltrim(c, F.lit(SPACES)) != "", F.lit(False))  # one end is enough, and it costs no look at the rest


def clean_text(c: Column) -> Column:
    """One line: runs of line ends, tabs and blanks become one blank; ends stripped; null becomes empty."""
    return trim_ws(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n\t ]+", " "))


def homogenize_number(c: Column) -> Column:
    """A number's spelling made uniform: decimal marks to dots, multiplication and exponent marks to e, white space and parentheses removed."""
    return F.regexp_replace(F.translate(c, ",•x×E()", "..eee"), f"{W}+", "")


def first_token(c: Column) -> Column:
    """Text before the first white space of the stripped line; null for a blank line."""
    t = F.regexp_extract(trim_ws(c), f"^[^{WS}]+", 0)
    return F.when(t != "", t)


def line_count(c: Column) -> Column:
    """Lines of a text that are not blank."""
    return F.size(F.filter(F.split(c, r"\r\n|\r|\n"), not_blank))


def file_stem(path: Column) -> Column:
    """File name without folder and last extension; letter case is kept."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def decode_text(content: Column) -> Column:
    """Bytes as UTF-8 if valid, else as Latin-1 (which decodes anything)."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def _to_last(t: Column, mark: str) -> tuple[Column, Column]:
    """A text up to its last ``mark``, and the rest."""
    head = F.regexp_extract(t, f"(?s)^.*{mark}", 0)
    return head, F.substring(t, F.length(head) + 1, F.length(t))


def page_text(html: Column) -> Column:
    """The readable text of a web page, tags of any kind tolerated: its body (the whole page if it has none) without comments, scripts, styles and tags, on one line.

    A comment, script or style that is not closed reaches the page's end. Time is
    linear: an opener always finds its end, and tags are looked for only before the last ">".
    """
    end = lambda name: rf"(?:</{name}[ \t\r\n]*>|\z)"
    t = F.regexp_replace(F.coalesce(html, F.lit("")), rf"(?is)<!--.*?(?:-->|\z)|<script[ \t\r\n>].*?{end('script')}|<style[ \t\r\n>].*?{end('style')}", " ")
    head, tail = _to_last(t, ">")
    t = F.concat(F.regexp_replace(head, r"(?is)^.*?<body(?:[ \t\r\n][^>]*)?>", ""), tail)
    t = F.regexp_replace(t, r"(?is)</body[ \t\r\n]*>.*$", "")
    head, tail = _to_last(t, ">")
    return clean_text(F.concat(F.regexp_replace(head, "<[^>]*>", " "), tail))
