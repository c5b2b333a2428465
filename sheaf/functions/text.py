"""Character classes and line rules shared by every text expression.

Java's ``\\s``, ``\\R`` and ``(?m)^`` each differ from the line and whitespace rules the bundle
formats were defined with, so the sets are written out once here and reused in all patterns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace characters a strip removes, as literal text.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# The same set, and its parts, as the inside of a Java character class. Single Latin-1 characters
# share one lookup table there, ranges do not, so the parts that meet every character of a text
# are spelled out.
WS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_END = r"\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028-\u2029"
INLINE_WS = r"\t\x1f\x20\xa0\u1680\u2000-\u200a\u202f\u205f\u3000"
WS_NOT_LF = r"\t\x0b-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = r"\p{L}\p{N}_"

# Zero-width start of a line, and the end of one (terminator included, or end of text).
LINE_START = rf"(?:\A|(?<=[{LINE_END}]))(?!(?<=\r)\n)"
EOL = rf"(?:\r\n|[{LINE_END}])"
EOL_OR_END = rf"(?:\r\n|[{LINE_END}]|\z)"
ANY_LINE = rf"[^{LINE_END}]*+"

META_FIELD = rf"([{WORD}]+)[{WS}]*=[{WS}]*([^;]+)"


def strip(col: Column) -> Column:
    """Both ends trimmed of every whitespace character, in one linear pass."""
    return F.btrim(col, F.lit(SPACES))


def is_blank(col: Column) -> Column:
    return ~F.rlike(col, F.lit(f"[^{WS}]"))


def universal_newlines(col: Column) -> Column:
    """CRLF and CR become LF."""
    return F.regexp_replace(col, r"\r\n?", "\n")


def split_lines(text: Column) -> Column:
    """Lines without their terminators; a final terminator does not open another line."""
    body = F.regexp_replace(text, rf"{EOL}\z", "")
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(
        F.split(body, EOL, -1)
    )


def last_field(keys: Column, values: Column, key: str) -> Column:
    """Value of the last occurrence of ``key``; both arrays are in reverse order of appearance."""
    at = F.array_position(keys, key)
    return strip(F.try_element_at(values, F.when(at > 0, at.cast("int"))))


def meta_fields(meta: Column, lower_keys: bool = False) -> tuple[Column, Column]:
    """``key=value; key=value`` as two arrays, last field first."""
    source = F.lower(meta) if lower_keys else meta
    keys = F.reverse(F.regexp_extract_all(source, F.lit(META_FIELD), F.lit(1)))
    values = F.reverse(F.regexp_extract_all(meta, F.lit(META_FIELD), F.lit(2)))
    return keys, values


def fixed(value: Column, digits: int) -> Column:
    """Number with so many decimals; a tie goes to the even digit, as in C and Python."""
    return F.format_string(f"%.{digits}f", F.bround(value, digits))


def human_size(size: Column) -> Column:
    mib = 1024 * 1024
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < mib, F.concat(fixed(size / F.lit(1024.0), 1), F.lit(" KB")))
        .otherwise(F.concat(fixed(size / F.lit(float(mib)), 1), F.lit(" MB")))
    )
