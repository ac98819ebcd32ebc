"""Path expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TEST = r"(?i)(^|/)(tests?|__tests__|spec|specs|e2e|fixtures|testdata)(/|$)|(^|/)test_[^/]*\.py$|_test\.(go|py|rs|cc|cpp)$|\.(test|spec)\.[cm]?[jt]sx?$|(^|/)conftest\.py$"


def is_test_path(path: Column) -> Column:
    return path.rlike(TEST)


def normalize(path: Column) -> Column:
    """Forward slashes, no leading ``./``, no doubled slash."""
    return F.regexp_replace(F.regexp_replace(F.translate(path, "\\", "/"), r"^(\./)+", ""), "/{2,}", "/")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def join(base: Column, relative: Column) -> Column:
    """``relative`` from directory ``base``, with ``.`` and ``..`` resolved."""
    parts = F.filter(F.split(F.concat_ws("/", base, relative), "/"), lambda p: ~p.isin("", "."))
    empty = F.array().cast("array<string>")
    step = lambda acc, p: F.when((p == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, empty, step), "/")


def glob_regex(glob: str) -> str:
    """``*`` stays within a segment, ``**`` crosses them."""
    out, i = "^", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return out + "$"


def excluded(path: Column, tokens: list[str]) -> Column:
    """A dotted token is part of the file's name, another one a whole segment; case doesn't count."""
    low = F.lower(path)
    hit = F.lit(False)
    for t in (t.lower() for t in tokens):
        hit = hit | (basename(low).contains(t) if "." in t else F.array_contains(F.split(low, "/"), t))
    return hit


def looks_like_path(value: Column) -> Column:
    return (F.length(value) <= 256) & value.rlike(r"^[\w@.~/-]*/?[\w@.-]+\.[A-Za-z0-9]{1,4}$") & value.contains("/")
