"""Column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OMITTED = "[CONTENT OMITTED]"
#: White space as Python's str.strip and re see it, as a Java character class.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Text without white space (Unicode) at either end."""
    return F.trim(col(c), F.lit(SPACES))


def rstrip(c: Column | str) -> Column:
    return F.rtrim(col(c), F.lit(SPACES))


def filled(c: Column | str) -> Column:
    """Stripped text, null if nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def first_filled(*cs: Column | str) -> Column:
    return F.coalesce(*[filled(c) for c in cs])


def clip(c: Column | str, limit: int) -> Column:
    """Cut at ``limit`` characters, right-stripped, then "..."; shorter text is unchanged."""
    c = col(c)
    return F.when(F.char_length(c) > limit, F.concat(rstrip(F.substring(c, 1, limit)), F.lit("..."))).otherwise(c)


def clip_within(c: Column | str, limit: int) -> Column:
    """Like ``clip``, but the dots count towards the limit."""
    c = col(c)
    return F.when(F.char_length(c) > limit, F.concat(rstrip(F.substring(c, 1, limit - 3)), F.lit("..."))).otherwise(c)


def clip_marked(c: Column | str, limit: int, marker: str = OMITTED) -> Column:
    """Cut so that text and an omission marker fit into ``limit`` characters."""
    c = col(c)
    if limit <= len(marker):
        cut = F.lit(marker[:limit])
    else:
        cut = F.concat(rstrip(F.substring(c, 1, limit - len(marker))), F.lit(marker))
    return F.when(F.char_length(c) > limit, cut).otherwise(c)


def clip_plain(c: Column | str, limit: int) -> Column:
    """Cut at ``limit`` characters and add "..." without stripping."""
    c = col(c)
    return F.when(F.char_length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)


def slugify(c: Column | str, empty: str = "topic") -> Column:
    """Lower case, runs of other characters than a-z and 0-9 become one underscore, none at the ends."""
    s = F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "_")
    s = F.regexp_replace(s, "^_+|_+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(empty))


def strip_fences(c: Column | str) -> Column:
    """Text without the lines of a code fence around it."""
    c = strip(c)
    inner = F.regexp_replace(c, r"\A```[^\n]*\n?", "")
    inner = F.regexp_replace(inner, r"\n?```[^\n]*\z", "")
    return F.when(c.startswith("```"), strip(inner)).otherwise(c)


def json_candidates(c: Column | str, opening: str, closing: str) -> tuple[Column, Column]:
    """Texts that may hold JSON: without fences; from the first opening to the last closing bracket."""
    whole = strip_fences(c)
    inner = F.regexp_extract(whole, rf"(?s)\{opening}.*\{closing}", 0)
    return whole, F.nullif(inner, F.lit(""))


def seeded_uniform(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) that depends on the keys and the seed alone, not on partitions."""
    h = F.xxhash64(F.lit(seed), *[col(k) for k in keys])
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def seeded_order(seed: int, *keys: Column | str) -> Column:
    return F.xxhash64(F.lit(seed), *[col(k) for k in keys])


def int_text(c: Column | str) -> Column:
    """A whole number written as text, as a long; null otherwise."""
    return F.when(strip(c).rlike(r"^[-+]?[0-9]+$"), strip(c)).try_cast("long")


def round2(c: Column | str) -> Column:
    """A number at two places, rounded as its binary value times 100: 1.005 gives 1.0, 4.975 gives 4.97."""
    return F.round(col(c) * 100, 0) / 100
