"""Content expressions: classification, line ends, transfer encodings, checksums, sizes."""

from __future__ import annotations

import binascii
import codecs

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructType

from sheaf.functions.paths import base_name, to_posix
from sheaf.functions.text import fixed

# Fixed values.
EOL_STYLES = ("LF", "CRLF", "CR", "MIXED", "n/a")
TEXT_EOL_STYLES = EOL_STYLES[:4]
MIB = 1024 * 1024
SNIFF_BYTES = 1024
BOM_NAMES = ("utf-8-bom", "utf8-bom", "utf-8_sig", "utf-8-sig", "utf_8_sig")
UTF8_NAMES = ("utf-8", "utf8", "utf_8", "auto", "")
# First two bytes, in hex, of a three and of a four byte character.
_OPEN_3 = "E0[AB].|E[1-9A-CEF][89AB].|ED[89]."
_OPEN_4 = "F0[9AB].|F[1-3][89AB].|F48."
HEADER_RULE = "# " + "=" * 76


def is_binary(content: Column, strict_sniff: bool = False) -> Column:
    """NUL in the first kilobyte, or bytes there that are not UTF-8.

    A multi-byte character that the kilobyte boundary cuts is not held against the file, unless
    ``strict_sniff`` asks for the plain cut.
    """
    head = F.substring(content, 1, SNIFF_BYTES)
    probe = head
    if not strict_sniff:
        tail = F.hex(F.substring(content, SNIFF_BYTES - 2, 3))
        cut = (
            F.when(F.length(content) <= SNIFF_BYTES, 0)
            .when(F.rlike(tail, F.lit("^....(?:C[2-9A-F]|D.|E.|F[0-4])$")), 1)
            .when(F.rlike(tail, F.lit(f"^..(?:{_OPEN_3}|{_OPEN_4})$")), 2)
            .when(F.rlike(tail, F.lit(f"^(?:{_OPEN_4})[89AB].$")), 3)
            .otherwise(0)
        )
        probe = F.substring(content, F.lit(1), F.lit(SNIFF_BYTES) - cut)
    return F.contains(head, F.lit(bytearray(b"\x00"))) | ~F.is_valid_utf8(probe.cast("string"))


def decode_replace(content: Column) -> Column:
    """UTF-8 text; undecodable bytes become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


@F.pandas_udf(StringType())
def _decode_dropping(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))


def decode_ignore(content: Column) -> Column:
    """UTF-8 text; undecodable bytes are dropped. Only rows that hold such bytes reach Python."""
    text = content.cast("string")
    valid = F.is_valid_utf8(text)
    return F.coalesce(F.when(valid, text), _decode_dropping(F.when(~valid, content)))


def eol_style(text: Column) -> Column:
    crlf = F.contains(text, F.lit("\r\n"))
    lf = F.rlike(text, F.lit(r"(?<!\r)\n"))
    cr = F.rlike(text, F.lit(r"\r(?!\n)"))
    kinds = crlf.cast("int") + lf.cast("int") + cr.cast("int")
    return (
        F.when(kinds > 1, F.lit("MIXED"))
        .when(crlf, F.lit("CRLF"))
        .when(cr, F.lit("CR"))
        .when(text.isNotNull(), F.lit("LF"))
    )


def to_base64(content: Column) -> Column:
    """One unbroken line; Spark's own output may wrap at 76 characters."""
    return F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))


@F.pandas_udf(BinaryType())
def _lenient_base64(text: pd.Series) -> pd.Series:
    def one(value):
        try:
            return None if value is None else binascii.a2b_base64(value)
        except ValueError:
            return None

    return text.map(one)


def from_base64(text: Column) -> Column:
    """Bytes, or null when the text is not base64.

    Characters outside the alphabet are skipped, and so is padding before the third place of a
    quad. A completed pad ends the data, whatever follows; an incomplete quad is an error. Decoding
    in one pass over the bytes costs less than patterns that meet every character of a text.
    """
    return _lenient_base64(text.cast("binary"))


@F.pandas_udf(StructType().add("payload", BinaryType()).add("error", StringType()))
def _encode_charset(text: pd.Series, charset: pd.Series) -> pd.DataFrame:
    def one(value, name):
        if value is None or name is None:
            return None, None
        try:
            return value.encode(name, "replace"), None
        except Exception as e:  # noqa: BLE001 - a charset may raise anything, and is one row's error
            return None, str(e)

    return pd.DataFrame([one(t, c) for t, c in zip(text, charset)], columns=["payload", "error"])


def encoded_text(text: Column, encoding: Column) -> Column:
    """``payload`` bytes in the named charset, or an ``error`` that says why there are none.

    UTF-8, with or without byte order mark, stays in the JVM.
    """
    name = F.lower(F.coalesce(encoding, F.lit("")))
    utf8, bom = name.isin(*UTF8_NAMES), name.isin(*BOM_NAMES)
    other = ~utf8 & ~bom
    none = F.lit(None).cast("string").alias("error")
    return (
        F.when(utf8, F.struct(text.cast("binary").alias("payload"), none))
        .when(bom, F.struct(F.concat(F.lit(bytearray(codecs.BOM_UTF8)), text.cast("binary")).alias("payload"), none))
        .otherwise(_encode_charset(F.when(other, text), F.when(other, name)))
    )


def encode_text(text: Column, encoding: Column) -> Column:
    """The payload of ``encoded_text``; null when the charset is unknown or fails."""
    return encoded_text(text, encoding)["payload"]


def header_block(path: Column, project: str = "", team: str = "", version: str = "",
                 lifecycle: str = "Proposed") -> Column:
    """Comment banner put before extracted text files."""
    rule = F.lit(HEADER_RULE)
    lines = [
        rule,
        F.concat(F.lit("# SOURCEFILE: "), base_name(to_posix(path))),
        F.concat(F.lit("# RELPATH: "), to_posix(path)),
        F.lit(f"# PROJECT: {project}"),
        F.lit(f"# TEAM: {team}"),
        F.lit(f"# VERSION: {version}"),
        F.lit(f"# LIFECYCLE: {lifecycle}"),
        F.lit("# DESCRIPTION:\n#   (Content extracted from bundle)"),
        F.lit("# FIXES:\n#   (If applicable, list fixes related to this file)"),
        rule,
        F.lit(""),
    ]
    return F.concat_ws("\n", *lines)


def text_checksum(text: Column) -> Column:
    """SHA-256 of the content string, which for a binary entry is its base64 text."""
    return F.sha2(text, 256)


def file_checksum(content: Column) -> Column:
    """SHA-256 of the raw bytes."""
    return F.sha2(content, 256)


def verify_checksum(text: Column, expected: Column) -> Column:
    """True where nothing is expected."""
    return F.coalesce(text_checksum(text) == F.lower(expected), F.lit(True))


def size_mb(length: Column) -> Column:
    return length / F.lit(float(MIB))


def over_limit_mb(length: Column, max_mb: float) -> Column:
    """Limit compared in fractional megabytes."""
    if max_mb <= 0:
        raise ValueError("the size limit must be a positive number")
    return size_mb(length) > F.lit(float(max_mb))


def over_limit_bytes(length: Column, max_mb: float) -> Column:
    """Limit cut to whole bytes first."""
    return length > F.lit(int(max_mb * MIB))


def size_message(path: Column, length: Column, max_mb: float) -> Column:
    return F.concat(
        F.lit("File '"), path, F.lit("' size ("),
        fixed(size_mb(length), 2), F.lit(f" MB) exceeds limit ({max_mb:.2f} MB)"),
    )
