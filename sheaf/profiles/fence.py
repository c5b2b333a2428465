"""Markdown format: an HTML comment with the metadata, then the content in a code fence."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.content import EOL_STYLES
from sheaf.functions.text import (
    ANY_LINE,
    EOL,
    EOL_OR_END,
    INLINE_WS,
    LINE_END,
    LINE_START,
    WORD,
    WS_NOT_LF,
    meta_fields,
    strip,
)
from sheaf.profiles.base import Profile

# Fence language by file extension.
LANGUAGES = {
    "py": "python", "js": "javascript", "ts": "typescript", "java": "java", "cpp": "cpp",
    "c": "c", "cs": "csharp", "rb": "ruby", "go": "go", "rs": "rust", "php": "php",
    "html": "html", "css": "css", "json": "json", "xml": "xml", "yaml": "yaml", "sql": "sql",
    "sh": "shell",
}

_S = f"[{INLINE_WS}]*"
_HEADER = rf"{_S}<!--{_S}(?iu:FILE:)([^;{LINE_END}]+);([^{LINE_END}]+)-->{_S}{EOL_OR_END}"
_SPLIT = rf"{LINE_START}(?={_HEADER})"
_BARE = rf"{_S}```{_S}{EOL_OR_END}"
# Whole lines up to a bare fence. Possessive, so that long contents need no stack.
_INSIDE = rf"((?:(?!{_BARE}){ANY_LINE}{EOL})*+(?:(?!{_BARE})[^{LINE_END}]++)?)"
_FENCE_LINE = rf"{LINE_START}{_S}(```[{WORD}]*){_S}{EOL_OR_END}"
_FENCED = rf"{LINE_START}{_S}```[{WORD}]*{_S}{EOL_OR_END}{_INSIDE}(?:{_BARE})?"

# Detection splits at line feeds only, so other terminators count as blanks there.
_B = f"[{WS_NOT_LF}]*"
_WITHIN_30 = r"\A(?:[^\n]*+\n){0,29}?"


class FenceProfile(Profile):
    name = "md_fence"
    display_name = "Markdown Fence (AI-Friendly)"
    capabilities = {"supports_binary": True, "supports_checksums": False, "supports_metadata": True}
    parsed_metadata = {"format_version": "2.1", "parser": "MarkdownFenceProfile"}
    separator = "\n\n"

    def detect(self, text: Column) -> Column:
        """A header comment and a fence, both in the first 30 lines."""
        header = rf"{_WITHIN_30}{_B}<!--{_B}(?iu:FILE:)[^;\n]+;[^\n]+-->{_B}(?:\n|\z)"
        fence = rf"{_WITHIN_30}{_B}```[{WORD}]*{_B}(?:\n|\z)"
        return F.rlike(text, F.lit(header)) & F.rlike(text, F.lit(fence))

    def split(self, text: Column) -> Column:
        pieces = F.split(text, _SPLIT, -1)
        starts = F.rlike(text, F.lit(rf"\A{_HEADER}"))
        return F.when(starts, pieces).otherwise(F.slice(pieces, F.lit(2), F.size(pieces) - 1))

    def pieces(self, text: Column) -> Column:
        pieces = F.split(text, _SPLIT, -1)
        return F.when(F.rlike(text, F.lit(rf"\A{_HEADER}")), F.concat(F.array(F.lit("")), pieces)).otherwise(pieces)

    def moves(self, piece: Column) -> Column:
        """A bare fence opens and closes, one with a language only opens."""
        fences = F.regexp_extract_all(piece, F.lit(_FENCE_LINE), F.lit(1))
        start = F.struct(F.lit(0).alias("outside"), F.lit(1).alias("inside"))
        return F.aggregate(fences, start, lambda at, fence: F.struct(
            F.when(fence == "```", 1 - at["outside"]).otherwise(1).alias("outside"),
            F.when(fence == "```", 1 - at["inside"]).otherwise(1).alias("inside"),
        ))

    def later_body(self, piece: Column, inside: Column) -> Column:
        opened = F.when(inside, F.concat(F.lit("```\n"), piece)).otherwise(piece)
        return F.array_join(F.regexp_extract_all(opened, F.lit(_FENCED), F.lit(1)), "")

    def path(self, block: Column) -> Column:
        return strip(F.regexp_extract(block, rf"\A{_HEADER}", 1))

    def meta(self, block: Column) -> Column:
        return strip(F.regexp_extract(block, rf"\A{_HEADER}", 2))

    def body(self, block: Column) -> Column:
        inner = F.regexp_replace(block, rf"\A{ANY_LINE}{EOL_OR_END}", "")
        return F.array_join(F.regexp_extract_all(inner, F.lit(_FENCED), F.lit(1)), "")

    def fields(self, meta: Column) -> tuple[Column, Column]:
        return meta_fields(meta)

    def finish(self, path: Column, body: Column, get) -> dict[str, Column]:
        binary = F.coalesce(get("mode") == "binary", F.lit(False))
        missing_eol = F.when(binary, F.lit("n/a")).otherwise("LF")
        return {
            "path": F.translate(path, "\\", "/"),
            "content": F.when(
                F.endswith(body, F.lit("\n")),
                F.substring(body, F.lit(1), F.length(body) - 1),
            ).otherwise(body),
            "encoding": F.coalesce(get("encoding"), F.lit("utf-8")),
            "is_binary": binary,
            "eol_style": F.coalesce(
                F.when(get("eol") == "", missing_eol), get("eol"), F.lit("LF")
            ),
        }

    def prepare(self, entry: dict[str, Column]) -> dict[str, Column]:
        fallback = F.when(entry["is_binary"], F.lit("n/a")).otherwise("LF")
        eol = entry["eol_style"]
        return entry | {"eol_style": F.when(eol.isin(*EOL_STYLES), eol).otherwise(fallback)}

    def problem(self, entry: dict[str, Column]) -> Column:
        missing = F.coalesce(entry["encoding"], F.lit("")) == ""
        return F.when(
            missing,
            F.concat(F.lit("File '"), entry["path"], F.lit("' missing encoding specification")),
        )

    def block(self, entry: dict[str, Column]) -> Column:
        mode = F.when(entry["is_binary"], F.lit("binary")).otherwise("text")
        hint = F.when(entry["is_binary"], F.lit("")).otherwise(
            F.coalesce(language_hint(entry["path"]), F.lit(""))
        )
        return F.concat(
            F.lit("<!-- FILE: "), entry["path"],
            F.lit("; encoding="), entry["encoding"],
            F.lit("; eol="), entry["eol_style"],
            F.lit("; mode="), mode,
            F.lit(" -->\n```"), hint,
            F.lit("\n"), entry["content"],
            F.lit("\n```"),
        )

    def lossy(self, content: Column) -> Column:
        return F.rlike(content, F.lit(rf"{LINE_START}(?:{_BARE}|{_HEADER})"))


def language_hint(path: Column) -> Column:
    """Fence language from what follows the last dot of the whole path, null if unknown."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(LANGUAGES.items())])
    ext = F.when(F.contains(path, F.lit(".")), F.lower(F.substring_index(path, ".", -1)))
    return F.try_element_at(table, ext)
