"""Text helpers: number rendering, glob patterns and search tokens."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that search ignores.
STOPWORDS = (
    "the a an and or but of to in on for is are was "
    "were it this that with as at by be from we you they"
).split()


def number_text(c: Column, exact: float = 1e17) -> Column:
    """Integral values without a fraction, others in their shortest form, infinities as inf and -inf."""
    whole = (c == F.floor(c)) & (F.abs(c) < exact)
    return F.when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def glob_to_regex(pattern: str) -> str:
    r"""An anchored regular expression for ``* ? [a-z] [^x] \`` patterns."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "\\" and i < len(pattern):
            out.append(re.escape(pattern[i]))
            i += 1
        elif c == "[" and (end := pattern.find("]", i + 1)) > 0:
            body = pattern[i:end]
            negated = body[:1] in "^!" and len(body) > 1
            body = body[1:] if negated else body
            out.append(f"[{'^' if negated else ''}{re.sub(r'([\\\]\[&^])', r'\\\1', body)}]")
            i = end + 1
        else:
            out.append(re.escape(c))
    return f"(?s)^{''.join(out)}$"


def glob_match(c: Column, pattern: str) -> Column:
    """Match by pattern; its literal beginning also goes to the scan as a prefix filter."""
    prefix = re.match(r"[^*?\[\\]*", pattern)[0]
    match = c.rlike(glob_to_regex(pattern))
    return c.startswith(prefix) & match if prefix else match


def keys_match(c: Column, pattern: str) -> Column:
    """A pattern without wildcards selects by prefix."""
    return glob_match(c, pattern) if re.search(r"[*?\[\\]", pattern) else c.startswith(pattern)


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits of three bytes or more that are no stopwords; duplicates stay."""
    parts = F.split(F.lower(c), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda x: (F.octet_length(x) >= 3) & ~x.isin(STOPWORDS))
