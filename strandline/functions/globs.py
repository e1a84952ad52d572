"""Path patterns as regular expressions, made where the plan is made."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_regex(pattern: str) -> str:
    """A shell pattern (* and ? cross folders, [...] classes) as an anchored Java expression."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c in "*?":
            out.append(".*" if c == "*" else ".")
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            inner = re.sub(r"([\\\[&])", r"\\\1", pattern[i + 1 : end])
            out.append("[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]")
            i = end
        else:
            out.append(re.sub(r"([.\\+^$|(){}\[\]])", r"\\\1", c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def matches(path: Column, pattern: str) -> Column:
    """Whether a path fits; one that ends in /* or /** also fits its folder and all below."""
    pattern = pattern.replace("\\", "/").lstrip("/")
    clean = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+", "")
    fits = clean.rlike(to_regex(pattern))
    if pattern.endswith(("/*", "/**")):
        base = pattern.rstrip("/*")
        fits = fits | (clean == base) | clean.startswith(base + "/")
    return fits
