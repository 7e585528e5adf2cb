"""Text expressions, of Spark's own functions but for rare character entities."""

from __future__ import annotations

import html
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space of all scripts; Java's own class is ASCII only.
_SPACE = "(?U)\\s+"
_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#x27;": "'", "&#39;": "'", "&nbsp;": "\u00a0", "&middot;": "\u00b7", "&copy;": "\u00a9", "&amp;": "&"}


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda t: t != "")


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


@F.pandas_udf(StringType())  # a type, not its name, which needs a session
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def unescape(text: Column) -> Column:
    """All character entities as characters: the common ones by replacement, the ampersand last; only texts that hold others
    (any name of HTML 5, any number) go to Python, in batches."""
    common = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), _ENTITIES.items(), text)
    rest = "|".join(e[1:] for e in _ENTITIES)
    return F.coalesce(_unescaped(F.when(text.rlike(f"&(?!{rest})[#A-Za-z]"), text)), common)


def normalize(text: Column) -> Column:
    """Entities decoded, tags blanked, white space squeezed and trimmed, lower case."""
    bare = F.regexp_replace(unescape(F.coalesce(text, F.lit(""))), "<[^>]+>", " ")
    return F.lower(F.trim(F.regexp_replace(bare, _SPACE, " ")))


def compose(fields: Sequence[tuple[str, Column]]) -> Column:
    """``label: value`` lines of the values that are neither null nor empty."""
    return F.concat_ws("\n", *[F.when(value != "", F.concat(F.lit(f"{label}: "), value)) for label, value in fields])


def matches(text: Column, terms: Sequence[str]) -> Column:
    """Those of the terms that occur in the text, in the order given."""
    return F.filter(F.array(*map(F.lit, terms)).cast("array<string>"), lambda t: F.contains(text, t))


def preview(text: Column, n: int) -> Column:
    """The first n characters, null if there are none."""
    return F.nullif(F.substring(text, 1, n), F.lit(""))


def file_priority(name: Column) -> Column:
    """1 for hwpx, 2 for pdf, 3 for hwp, else 99, by the last dotted part of the name."""
    end = F.element_at(F.split(F.lower(name), "[.]"), -1)
    return F.when(end == "hwpx", 1).when(end == "pdf", 2).when(end == "hwp", 3).otherwise(99)


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(name, '[\\\\/:*?"<>|]', "_")


def parse_long(text: Column) -> Column:
    """A whole number, or null where the text is empty or none."""
    return F.nullif(text, F.lit("")).try_cast("bigint")


def parse_time(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


def bullets(text: Column, patterns: Sequence[str]) -> Column:
    """The first bullet of each pattern that opens a line, distinct, in the order of the patterns."""
    found = [F.regexp_extract(text, f"(?dm)^(?U:\\s*)(?:#+(?U:\\s*))?({p})(?U:\\s+)", 1) for p in patterns]
    return F.array_distinct(F.filter(F.array(*found), lambda b: b != ""))
