"""Names and search: expressions only, but for full NFKC, which is an Arrow function."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_HALF = "".join(chr(c) for c in range(0x21, 0x7F))
_MACRON, _BARE = "āēīōūĀĒĪŌŪ", "aeiouAEIOU"


def trigrams(text: Column) -> Column:
    """Distinct three-character pieces of the lower-cased words, each padded by two blanks and one."""
    words = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")

    def grams(w: Column) -> Column:
        padded = F.concat(F.lit("  "), w, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words, grams)))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams of all; 0 where nothing is known."""
    x, y = trigrams(a), trigrams(b)
    shared = F.size(F.array_intersect(x, y))
    return F.coalesce(F.when(F.size(F.array_union(x, y)) > 0, shared / F.size(F.array_union(x, y))), F.lit(0.0))


def best_similarity(query: Column, columns: Sequence[Column], arrays: Sequence[Column] = ()) -> Column:
    every = [similarity(query, c) for c in columns] + [F.coalesce(F.array_max(F.transform(a, lambda x: similarity(query, x))), F.lit(0.0)) for a in arrays]
    return F.greatest(*every) if len(every) > 1 else every[0]


def matches(query: Column, columns: Sequence[Column], arrays: Sequence[Column] = ()) -> Column:
    """Whether any text holds the query, whatever the case."""
    q = F.lower(query)
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(c), q), F.lit(False))
    for a in arrays:
        found = found | F.coalesce(F.exists(a, lambda x: F.contains(F.lower(x), q)), F.lit(False))
    return found


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(half_width(text)), "[^\\p{L}\\p{N}]+", "-"), "^-+|-+$", "")


def half_width(text: Column) -> Column:
    """Full-width ASCII and blanks as plain ones."""
    return F.translate(text, _FULL + "　", _HALF + " ")


def nfkc(text: Column) -> Column:
    """Full compatibility normalisation; nothing built in does it."""
    import unicodedata

    import pandas as pd

    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))

    return normal(text)


def ward_key(text: Column) -> Column:
    return F.regexp_replace(F.translate(half_width(text), "ヶ", "ケ"), "\\s+", "")


def station_key(text: Column) -> Column:
    bare = F.regexp_replace(F.lower(half_width(text)), "\\s+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "駅$", ""), "\\s*station$", ""))


def without_chome(text: Column) -> Column:
    return F.regexp_replace(half_width(text), "[0-9一二三四五六七八九十]+丁目$", "")


def title(text: Column) -> Column:
    return F.initcap(F.lower(text))


def without_macrons(text: Column) -> Column:
    return F.translate(text, _MACRON, _BARE)


def stable_id(prefix: Column, name: Column) -> Column:
    return F.concat(prefix, F.lit(":"), F.substring(F.sha2(name, 256), 1, 16))


def first_of(tags: Column, keys: Sequence[str]) -> Column:
    """First of the keys with a text that is not empty."""
    return F.coalesce(*[F.nullif(F.trim(F.try_element_at(tags, F.lit(k))), F.lit("")) for k in keys])


def number(cell: Column) -> Column:
    """A numeric cell with thousands commas; empty or wrong is null."""
    return F.regexp_replace(F.trim(cell), ",", "").try_cast("double")


def has_japanese(text: Column) -> Column:
    return text.rlike("[\\u3040-\\u30ff\\u3400-\\u4dbf\\u4e00-\\u9fff]")
