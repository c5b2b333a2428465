"""Marker format: a ruled ``# FILE:`` / ``# META:`` header before every body, no escaping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.content import TEXT_EOL_STYLES
from sheaf.functions.text import (
    ANY_LINE,
    EOL,
    EOL_OR_END,
    INLINE_WS,
    LINE_END,
    LINE_START,
    is_blank,
    meta_fields,
    strip,
)
from sheaf.profiles.base import Profile

# Fixed values.
RULE = "# " + "=" * 67
UNUSABLE_PATHS = ("", ".", "./", ".\\", "/")

_S = f"[{INLINE_WS}]*"
_FILE = rf"{_S}#{_S}(?iu:FILE){_S}:"
_META = rf"{_S}#{_S}(?iu:META){_S}:"
_RULE_LINE = rf"{_S}#{_S}={{10,}}{_S}{EOL_OR_END}"
# The character after the colon may be the line's own terminator, unless that is a line feed.
_SPLIT = rf"{LINE_START}(?={_FILE}[^\n])"
_META_LINE = rf"{LINE_START}{_META}(?=[^\n])({ANY_LINE}){EOL_OR_END}"
_NOT_BODY = rf"{LINE_START}(?:{_META}(?=[^\n]){ANY_LINE}{EOL_OR_END}|{_RULE_LINE})"


class PlainProfile(Profile):
    name = "plain_marker"
    display_name = "Plain Marker (Legacy-Compatible)"
    capabilities = {"supports_binary": True, "supports_checksums": False, "supports_metadata": True}
    parsed_metadata = {"format_version": "2.1.10", "parser": "PlainMarkerProfile"}
    duplicate_paths = "last"

    def detect(self, text: Column) -> Column:
        """A file marker in the first 20 lines."""
        return F.rlike(text, F.lit(rf"\A(?:{ANY_LINE}{EOL}){{0,19}}?{_FILE}[^{LINE_END}]"))

    def split(self, text: Column) -> Column:
        pieces = F.split(text, _SPLIT, -1)
        starts = F.rlike(text, F.lit(rf"\A{_FILE}[^\n]"))
        return F.when(starts, pieces).otherwise(F.slice(pieces, F.lit(2), F.size(pieces) - 1))

    def pieces(self, text: Column) -> Column:
        pieces = F.split(text, _SPLIT, -1)
        return F.when(F.rlike(text, F.lit(rf"\A{_FILE}[^\n]")), F.concat(F.array(F.lit("")), pieces)).otherwise(pieces)

    def later_body(self, piece: Column, inside: Column) -> Column:
        return F.regexp_replace(piece, _NOT_BODY, "")

    def later_meta(self, piece: Column) -> Column:
        return self.meta(piece)

    def path(self, block: Column) -> Column:
        return strip(F.regexp_extract(block, rf"\A{_FILE}([^{LINE_END}]*)", 1))

    def meta(self, block: Column) -> Column:
        return F.array_join(F.regexp_extract_all(block, F.lit(_META_LINE), F.lit(1)), ";")

    def body(self, block: Column) -> Column:
        first_line = F.regexp_replace(block, rf"\A{ANY_LINE}{EOL_OR_END}", "")
        return F.regexp_replace(first_line, _NOT_BODY, "")

    def fields(self, meta: Column) -> tuple[Column, Column]:
        return meta_fields(meta, lower_keys=True)

    def usable(self, path: Column) -> Column:
        return ~path.isin(*UNUSABLE_PATHS)

    def finish(self, path: Column, body: Column, get) -> dict[str, Column]:
        def given(key):
            return F.nullif(get(key), F.lit(""))

        binary_mode = F.coalesce(F.lower(given("mode")) == "binary", F.lit(False))
        encoding = F.lower(
            F.coalesce(given("encoding"), F.when(binary_mode, F.lit("base64")).otherwise("utf-8"))
        )
        binary = binary_mode | (encoding == "base64")
        keep_last = F.coalesce(F.lower(given("trailing")) != "false", F.lit(True))
        drop = (
            F.when(F.endswith(body, F.lit("\n\n")), F.when(keep_last, 1).otherwise(2))
            .when(F.endswith(body, F.lit("\n")), F.when(keep_last, 0).otherwise(1))
            .otherwise(0)
        )
        return {
            "path": F.translate(path, "\\", "/"),
            "content": F.when(is_blank(body), F.lit("")).otherwise(
                F.substring(body, F.lit(1), F.length(body) - drop)
            ),
            "encoding": encoding,
            "is_binary": binary,
            "eol_style": F.coalesce(given("eol"), F.when(binary, F.lit("n/a")).otherwise("LF")),
        }

    def prepare(self, entry: dict[str, Column]) -> dict[str, Column]:
        binary = entry["is_binary"]
        return entry | {
            "encoding": F.coalesce(
                F.nullif(entry["encoding"], F.lit("")),
                F.when(binary, F.lit("base64")).otherwise("utf-8"),
            ),
            "eol_style": F.when(binary, F.lit("n/a"))
            .when(entry["eol_style"].isin(*TEXT_EOL_STYLES), entry["eol_style"])
            .otherwise("LF"),
        }

    def block(self, entry: dict[str, Column]) -> Column:
        mode = F.when(entry["is_binary"], F.lit("binary")).otherwise("text")
        payload = F.when(entry["is_binary"], strip(entry["content"])).otherwise(entry["content"])
        # The header itself ends in a newline, so an empty payload needs no other.
        closing = F.when((payload == "") | F.endswith(payload, F.lit("\n")), F.lit("")).otherwise("\n")
        return F.concat(
            F.lit(f"{RULE}\n# FILE: "), entry["path"],
            F.lit("\n# META: encoding="), entry["encoding"],
            F.lit("; eol="), entry["eol_style"],
            F.lit("; mode="), mode,
            F.lit(f"\n{RULE}\n"), payload, closing,
        )

    def lossy(self, content: Column) -> Column:
        return F.rlike(content, F.lit(rf"{LINE_START}(?:{_FILE}[^\n]|{_META}[^\n]|{_RULE_LINE})"))
