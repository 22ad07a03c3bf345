"""Scalar expressions over text, tags and sizes; all but accent folding stay in the JVM."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = " \t\n\r\x0b\f"


def strip(c: Column | str) -> Column:
    return F.btrim(c, F.lit(BLANK))


def slug(c: Column | str) -> Column:
    """Letters, digits, slashes and hyphens in lower case, words joined by single hyphens, all other signs dropped."""
    plain = F.regexp_replace(F.lower(c), r"(?U)[^\p{L}\p{N}\s/-]", "")
    return F.btrim(F.regexp_replace(plain, r"(?U)\s+", "-"), F.lit("-"))


def slug_text(s: str) -> str:
    """slug() for a driver-side address, in one pass."""
    out: list[str] = []
    gap = False
    for c in s.lower():
        if c.isspace():
            gap = True
        elif c.isalnum() or c in "/-":
            out.append("-" + c if gap else c)
            gap = False
    return "".join(out).strip("-")


def glob_regex(pattern: str) -> str:
    """A regular expression for a workspace glob; ``*`` crosses ``/`` and ``**/`` may match nothing."""
    if pattern.endswith("/**"):
        return "^" + _glob(pattern[:-3]) + "/.*$"
    if pattern.startswith("**/"):
        return "^(.*/)?" + _glob(pattern[3:]) + "$"
    return "^" + _glob(pattern) + "$"


def _glob(pattern: str) -> str:
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return out


def kind(path: Column | str) -> Column:
    """md, db or other, by extension."""
    path = F.lower(path)
    return F.when(path.rlike(r"\.(md|markdown)$"), "md").when(path.rlike(r"\.(db|duckdb)$"), "db").otherwise("other")


def under(path: Column | str, folder: str) -> Column:
    path = F.col(path) if isinstance(path, str) else path
    folder = folder.rstrip("/")
    return (path == folder) | path.startswith(folder + "/")


def lines(text: Column | str, first: int = 1, last: int | None = None) -> Column:
    """Lines first..last of a text, counted from 1, as an array."""
    if first < 1 or (last is not None and last < first):
        raise ValueError("a line range needs 1 <= first <= last")
    all_lines = F.split(text, "\n")
    return F.slice(all_lines, first, F.lit(last - first + 1) if last else F.greatest(F.size(all_lines), F.lit(1)))


def excerpt(text: Column | str, width: int = 100) -> Column:
    """The first two lines that are not blank, joined by a space and cut with an ellipsis."""
    kept = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    joined = F.array_join(F.slice(kept, 1, 2), " ")
    return F.when(F.length(joined) <= width, joined).otherwise(F.concat(F.rtrim(F.substring(joined, 1, width - 1)), F.lit("…")))


def human_size(n: Column | str) -> Column:
    n = F.col(n) if isinstance(n, str) else n
    return F.when(n < 1024, F.format_string("%db", n)).when(
        n < 1024 * 1024, F.format_string("%.1fk", F.bround(n / 1024, 1))
    ).otherwise(F.format_string("%.1fM", F.bround(n / (1024 * 1024), 1)))


def age(then: Column | str, now: Column) -> Column:
    """The largest of years (365 d), months (30 d), days, hours, minutes between two timestamps."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp(then)
    out = F.format_string("%dm", F.floor(seconds / 60))
    for unit, size in (("h", 3600), ("d", 86400), ("mo", 30 * 86400), ("y", 365 * 86400)):
        out = F.when(seconds >= size, F.format_string(f"%d{unit}", F.floor(seconds / size))).otherwise(out)
    return out


def has_tags(tags: Column | str, want: list[str]) -> Column:
    """All of the wanted tags are there."""
    return F.size(F.array_except(F.array(*map(F.lit, want)).cast("array<string>"), tags)) == 0


def edit_tags(tags: Column | str, add: list[str], drop: list[str]) -> Column:
    tags = F.array_union(tags, F.array(*map(F.lit, add)).cast("array<string>"))
    return F.array_except(tags, F.array(*map(F.lit, drop)).cast("array<string>"))


def _folding() -> tuple[str, str]:
    """Latin letters with marks, by their decomposition, and the letters without."""
    pairs = [(chr(i), unicodedata.normalize("NFD", chr(i))[0]) for i in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded(text: Column | str) -> Column:
    """Lower case, Latin marks folded; ASCII texts have none."""
    low = F.lower(text)
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(F.translate(low, *_folding()))


def terms(text: Column | str) -> Column:
    """Search terms in order: lower case, Latin marks folded, cut at all but letters and digits."""
    return F.filter(F.split(folded(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def path_parts(path: Column | str, depth: int) -> Column:
    """The first ``depth`` folders of a path's parent, with a slash; ``./`` for the root."""
    parent = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(parent == "", "./").otherwise(F.concat(F.array_join(F.slice(F.split(parent, "/"), 1, depth), "/"), F.lit("/")))
