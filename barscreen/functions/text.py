"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters counted as white space when a code is stripped.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(col: Column) -> Column:
    """Remove leading and trailing white space, line ends and Unicode spaces included."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def clean_code(col: Column) -> Column:
    """A stripped code; blank becomes null."""
    stripped = strip(col.cast("string"))
    return F.when(stripped != "", stripped)


def before_colon(title: Column) -> Column:
    """Text before the first colon, unstripped; empty when there is no colon."""
    return F.when(title.contains(":"), F.split_part(title, F.lit(":"), F.lit(1))).otherwise("")


def contains_any(text: Column, words: list[str]) -> Column:
    """True when any of the words occurs as a substring."""
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


def _number_sql(x: str) -> str:
    """SQL text of `number_text`."""

    def plain(scale: int) -> str:
        digits = f"rtrim('0', cast(cast({x} as decimal(38,{scale})) as string))"
        return f"regexp_replace({digits}, '[.]$', '.0')"

    exponent = f"try_cast(split_part(cast({x} as string), 'E', 2) as int)"
    mantissa = f"regexp_replace(split_part(cast({x} as string), 'E', 1), '[.]0$', '')"
    return f"""case
        when isnan({x}) then 'nan'
        when abs({x}) = double('Infinity') then if({x} > 0, 'inf', '-inf')
        when {x} = 0 or abs({x}) >= 1e-3 and abs({x}) < 1e7 then cast({x} as string)
        when abs({x}) >= 1e7 and abs({x}) < 1e16 then {plain(12)}
        when abs({x}) >= 1e-4 and abs({x}) < 1e-3 then {plain(24)}
        else concat({mantissa}, if({exponent} < 0, 'e-', 'e+'),
                    lpad(abs({exponent}), greatest(2, length(abs({exponent}))), '0')) end"""


def _zone_sql(zone: str) -> str:
    low, high = (f"coalesce({_number_sql(f'{zone}.{end}')}, 'nan')" for end in ("low", "high"))
    return f"concat('(', {low}, ', ', {high}, ')')"


def number_text(column: str) -> Column:
    """A double as Python prints it: plain digits from 1e-4 up to 1e16, else `1.5e-05`."""
    return F.expr(_number_sql(column))


def zone_text(column: str) -> Column:
    """`(low, high)` of a zone struct column."""
    return F.expr(_zone_sql(column))


def zones_text(column: str) -> Column:
    """`[(low, high), ...]` of a zone list column."""
    return F.expr(f"concat('[', array_join(transform({column}, z -> {_zone_sql('z')}), ', '), ']')")
