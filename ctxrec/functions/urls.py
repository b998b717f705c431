"""Url predicates.

``url_blacklisted``: a url is blacklisted when its scheme is not http(s), or
when a glob ``*pattern*`` matches anywhere in the whole url (case-sensitive).
Patterns without glob characters become ``contains`` (no regex at all); the
others are translated once, on the driver, into one foldable ``rlike``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default blacklist patterns and allowed schemes.
DEFAULT_BLACKLIST = ["facebook", "google", "gmail", "amazon", "twitter", "delicious"]
ALLOWED_SCHEMES = ["http", "https"]

# Scheme as a url parser reads it: leading scheme characters before ':'.
SCHEME_REGEX = r"^([A-Za-z0-9+.\-]+):"


def glob_to_regex(pattern: str) -> str:
    """Translate a glob into an unanchored Java regex body."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            j = pattern.find("]", i + 2 if i + 1 < len(pattern) and pattern[i + 1] == "!" else i + 1)
            if j < 0:
                out.append(re.escape(c))
            else:
                body = pattern[i + 1:j]
                if body.startswith("!"):
                    body = "^" + body[1:]
                out.append("[" + body.replace("\\", "\\\\") + "]")
                i = j
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def url_scheme(url: Column) -> Column:
    """Lower-cased scheme, '' when the url has none."""
    return F.lower(F.regexp_extract(url, SCHEME_REGEX, 1))


def url_blacklisted(url: Column, patterns: Sequence[str] | None = None) -> Column:
    patterns = DEFAULT_BLACKLIST if patterns is None else list(patterns)
    bad_scheme = ~url_scheme(url).isin(*ALLOWED_SCHEMES)
    literal = [p for p in patterns if not any(ch in p for ch in "*?[")]
    globbed = [p for p in patterns if p not in literal]
    hit = F.lit(False)
    for p in literal:
        hit = hit | url.contains(p)
    if globbed:
        rx = "(?s)(" + "|".join(glob_to_regex(p) for p in globbed) + ")"
        hit = hit | url.rlike(rx)
    return F.coalesce(bad_scheme | hit, F.lit(True))
