"""P-values and their comparison operators in free text, as one column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigscan.functions.text import WS, W, homogenize_number

# fixed values: the grammar of a p-value; what it accepts must be the same wherever it is read
# (possessive repetitions take the same: nothing behind them can begin inside what they took, and they are loops where the
# others are recursions, which long runs would overflow)
_OPERATOR = f"(?:[=<>≤≥]|less{W}++than|of{W}++<)++"
_DIGITS = r"(?:[0-9]|[,.•][0-9])[0-9]*[,.•]?[0-9]*"
_EXPONENT = rf"\({W}*-{W}*[0-9]+{W}*\)|{W}*-{W}*[0-9]+"
_AFTER_P = (
    rf"[{WS}-]*+(?:values?)?{W}*+({_OPERATOR}){W}*+"
    rf"({_DIGITS}){W}*(?:(%)|([x×]?){W}*([0-9]*){W}*(?:(exp|Exp|E|e)?{W}*({_EXPONENT}))?)"
)
#: Groups: 1 operator, 2 digits, 3 percent sign, 4 multiplication mark, 5 base, 6 exponent mark, 7 exponent.
PATTERN = rf"(?:{W}|\()[Pp]{_AFTER_P}"
#: The same matches without the character before P. It is looked at only where there is a P, which makes the search
#: of a text several times as fast; \G keeps it from being one that the match before has taken.
_SCAN = rf"(?!\G)[Pp](?<=[{WS}(].){_AFTER_P}"
_MARK = "\x01"
TYPE = "array<struct<p:double,op:string>>"


def _parts(m: Column) -> Column:
    """The groups of a match as an array, from one match of the pattern."""
    return F.split(F.regexp_replace(m, f"^[Pp]{_AFTER_P}$", _MARK.join(f"${k}" for k in range(1, 8))), _MARK)


def _value(g: Column) -> Column:
    part = lambda k: g[k - 1]
    digits = homogenize_number(part(2))
    number = F.when(F.length(digits) - F.length(F.replace(digits, F.lit("."), F.lit(""))) <= 1, digits.try_cast("double"))
    base = F.coalesce(F.nullif(part(5), F.lit("")).try_cast("double"), F.lit(0.0))
    power = F.coalesce(F.nullif(homogenize_number(part(7)), F.lit("")), F.lit("1"))
    # a literal power of ten is exact where pow() is off in the last bit
    ten = F.concat(F.lit("1e"), power).try_cast("double")
    factor = F.when((base == 0) | (base == 10), ten).otherwise(F.pow(base, power.try_cast("double")))
    scaled = (part(4) != "") | (part(6) != "")
    return F.when(part(3) != "", number * F.lit(0.01)).when(scaled, number * factor).otherwise(number)


def _operator(g: Column) -> Column:
    o = g[0]
    less, more = o.rlike("[<≤]|less"), o.rlike("[>≥]")
    return F.when(less & more, "ambiguous").when(less, "<").when(more, ">").otherwise("=")


def extract_pvalues(line: Column, bare: bool = False) -> Column:
    """All p-values in (0, 1) of a line, in order, as array<struct<p, op>>; null gives an empty array.

    A match needs white space or "(" before its P, so a line is expected to
    begin with an identifier; ``bare`` puts a blank before text without one.
    ``op`` is "<", "=", ">" or "ambiguous". A value whose digits hold two decimal
    marks is dropped, which includes ".05," with its comma.
    """
    text = F.concat(F.lit(" "), line) if bare else line
    groups = F.transform(F.regexp_extract_all(text, F.lit(_SCAN), F.lit(0)), _parts)
    pairs = F.transform(groups, lambda g: F.struct(_value(g).alias("p"), _operator(g).alias("op")))
    kept = F.filter(pairs, lambda v: (v["p"] > 0.0) & (v["p"] < 1.0))
    return F.coalesce(kept, F.array().cast(TYPE)).cast(TYPE)
