"""Text functions on columns."""

from __future__ import annotations

import re
from pathlib import PurePosixPath

from pyspark.sql import Column, functions as F


def filled(c: Column | str) -> Column:
    """c, or null where it is empty."""
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def first_filled(*columns: Column | str) -> Column:
    """The first value that is neither null nor empty, else the last one as it is."""
    return F.coalesce(*(filled(c) for c in columns), F.col(columns[-1]) if isinstance(columns[-1], str) else columns[-1])


def last_part(c: Column | str, separator: str) -> Column:
    return F.element_at(F.split(c, re.escape(separator)), -1)


def slashed(c: Column | str) -> Column:
    return F.replace(F.col(c) if isinstance(c, str) else c, F.lit("\\"), F.lit("/"))


def glob_regex(pattern: str, loose: bool = True) -> str:
    """A shell pattern as an anchored Java regex; * crosses slashes.  A keyword without * is looked
    for anywhere when loose."""
    if loose and "*" not in pattern:
        pattern = f"*{pattern}*"
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        end = pattern.find("]", i + 2) if ch == "[" else -1
        if end > 0:
            inner = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]")
            i = end
        else:
            out.append(".*" if ch == "*" else "." if ch == "?" else re.escape(ch))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def glob_match(c: Column | str, pattern: str, loose: bool = True) -> Column:
    return (F.col(c) if isinstance(c, str) else c).rlike(glob_regex(pattern, loose))


def content_hash(c: Column | str) -> Column:
    """MD5 of the UTF-8 bytes."""
    return F.md5((F.col(c) if isinstance(c, str) else c).cast("binary"))


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of the character at a 0-based offset."""
    before = F.substring(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def round_half_even(c: Column, digits: int = 1) -> Column:
    return F.bround(c, digits)


#: First match wins; the tool's own folder first.
LAYERS = (("Meta-Tooling", ("graphloom",)), ("UI", ("pages", "app.py")), ("Application", ("backend.py",)), ("Infrastructure", ("config.py", "utils.py")))


def layer(c: Column | str, layers: tuple[tuple[str, tuple[str, ...]], ...] = LAYERS) -> Column:
    """Name of the first layer one of whose keywords is in the path, else Unknown."""
    path = slashed(c)
    out = F.lit("Unknown")
    for name, keys in reversed(layers):
        hit = F.lit(False)
        for k in keys:
            hit = hit | path.contains(k)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def relative_module(base: str, level: int, module: str | None) -> str | None:
    """Path (without suffix) that a relative import of ``level`` dots in file ``base`` means."""
    folder = PurePosixPath(base).parts[:-1]
    up = level - 1
    if up > len(folder):
        return None
    parts = [*folder[: len(folder) - up], *([module.replace(".", "/")] if module else [])]
    return "/".join(parts)


def relative_module_column(base: Column, level: Column, module: Column) -> Column:
    """relative_module() as a column."""
    folder = F.slice(F.split(base, "/"), F.lit(1), F.greatest(F.size(F.split(base, "/")) - level, F.lit(0)))
    named = F.when(filled(module).isNull(), F.array().cast("array<string>")).otherwise(F.array(F.replace(module, F.lit("."), F.lit("/"))))
    return F.when(level - 1 <= F.size(F.split(base, "/")) - 1, F.concat_ws("/", F.concat(folder, named)))
