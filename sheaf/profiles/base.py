"""What a bundle format has to say, all of it as column expressions.

A format never sees a row. It gives Catalyst the expressions for one text or one block, so that a
bundle table with several formats is still parsed in a single scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.content import EOL_STYLES


class ProfileNotFound(KeyError):
    def __init__(self, name: str, known: list[str]):
        self.message = f"Profile '{name}' not found. Available profiles: {', '.join(known)}"
        super().__init__(self.message)

    def __str__(self) -> str:
        return self.message


class Profile:
    """Base of every format. ``name`` identifies it in tables."""

    name = ""
    display_name = ""
    capabilities: dict[str, bool] = {
        "supports_binary": False,
        "supports_checksums": False,
        "supports_metadata": False,
    }
    # Manifest metadata written by the parser of this format.
    parsed_metadata: dict[str, str] = {}
    # "last": the last of several blocks with one path wins; "error": they fail the bundle.
    duplicate_paths = "error"
    # Text between two blocks of a bundle.
    separator = ""

    def supports(self, feature: object) -> bool:
        return self.capabilities.get(feature, False) if isinstance(feature, str) else False

    def title(self) -> str:
        return self.display_name or self.name.replace("_", " ").title()

    # -- reading: expressions over the whole text, then over one block of it
    def detect(self, text: Column) -> Column:
        raise NotImplementedError

    def split(self, text: Column) -> Column:
        """Blocks of the text; whatever comes before the first is dropped."""
        raise NotImplementedError

    # -- reading a bundle in slices that are cut at any line
    def pieces(self, text: Column) -> Column:
        """What continues the block of an earlier slice, often nothing, and then the slice's own blocks."""
        raise NotImplementedError

    def moves(self, piece: Column) -> Column:
        """``outside, inside``: whether a body's end is inside (1) or outside (0) of a fence after the
        piece, if it was outside or inside before it. A format without fences leaves all as it is."""
        return F.struct(F.lit(0).alias("outside"), F.lit(1).alias("inside"))

    def later_body(self, piece: Column, inside: Column) -> Column:
        """Body in what continues a block, ``inside`` of a fence or not."""
        raise NotImplementedError

    def later_meta(self, piece: Column) -> Column:
        """Metadata in what continues a block."""
        return F.lit("")

    def path(self, block: Column) -> Column:
        raise NotImplementedError

    def meta(self, block: Column) -> Column:
        raise NotImplementedError

    def body(self, block: Column) -> Column:
        raise NotImplementedError

    def fields(self, meta: Column) -> tuple[Column, Column]:
        raise NotImplementedError

    def finish(self, path: Column, body: Column, get) -> dict[str, Column]:
        """``path, content, encoding, is_binary, eol_style``; ``get(key)`` reads the metadata."""
        raise NotImplementedError

    def usable(self, path: Column) -> Column:
        """False for blocks that are left out together with their bodies."""
        return F.lit(True)

    # -- writing
    def prepare(self, entry: dict[str, Column]) -> dict[str, Column]:
        """Defaults filled in before formatting."""
        raise NotImplementedError

    def problem(self, entry: dict[str, Column]) -> Column:
        """Why an entry cannot be written in this format, null when it can."""
        if self.supports("supports_binary"):
            return F.lit(None).cast("string")
        return F.when(entry["is_binary"], F.lit("Profile does not support binary files"))

    def block(self, entry: dict[str, Column]) -> Column:
        raise NotImplementedError

    def lossy(self, content: Column) -> Column:
        """True when the content holds lines that this format reads as its own markers."""
        return F.lit(False)


def entry_problem(path: Column, eol: Column) -> Column:
    """Why a parsed block is no valid entry, null when it is."""
    styles = ", ".join(f"'{s}'" for s in EOL_STYLES)
    return F.when(path == "", F.lit("BundleEntry path cannot be empty")).when(
        ~eol.isin(*EOL_STYLES),
        F.concat(F.lit("Invalid eol_style: "), eol, F.lit(f". Must be one of {{{styles}}}")),
    )


class ProfileRegistry:
    """Formats by name; detection asks them in the order they were registered."""

    def __init__(self, profiles: list[Profile] | None = None):
        self._profiles: dict[str, Profile] = {}
        for p in profiles or []:
            self.register(p)

    def register(self, profile: Profile) -> None:
        if not isinstance(profile, Profile):
            raise TypeError(f"{type(profile).__name__} is not a Profile")
        self._profiles[profile.name] = profile

    def get(self, name: str) -> Profile:
        if name not in self._profiles:
            raise ProfileNotFound(name, list(self._profiles))
        return self._profiles[name]

    def list_profiles(self) -> list[str]:
        return sorted(self._profiles)

    def all(self) -> list[Profile]:
        return list(self._profiles.values())

    def detect(self, text: Column) -> Column:
        """Name of the first format whose heuristic hits the start of the text, else null."""
        snippet = F.substring(text, 1, DETECT_CHARS)
        return F.coalesce(*[F.when(p.detect(snippet), F.lit(p.name)) for p in self.all()])

    def detection_error(self) -> str:
        return f"Could not auto-detect bundle format. Attempted: {', '.join(self._profiles)}"


# Fixed value: how much of a text detection looks at.
DETECT_CHARS = 2048


def default_registry() -> ProfileRegistry:
    from sheaf.profiles.fence import FenceProfile
    from sheaf.profiles.plain import PlainProfile

    return ProfileRegistry([PlainProfile(), FenceProfile()])
