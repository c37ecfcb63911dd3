"""Normal forms of titles and values, hashes and tokens."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Widths to which model output is cut.
WIDTHS = {"event_title": 512, "location": 256, "organizer": 256, "target_audience": 256, "description": 2048, "language": 8, "link": 512, "meeting_code": 128}


def nfkc_casefold(text: Column) -> Column:
    """Compatibility composition and case folding, for which Spark has no function (an Arrow function)."""

    @F.pandas_udf("string")
    def fold(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).casefold())

    return fold(text)


#: Texts of these characters alone are their own compatibility composition, and fold as they lower-case:
#: ASCII, Cyrillic letters without combining marks, typographic dashes, quotes and apostrophes.
PLAIN = r"^[\x00-\x7F\u0400-\u045F\u0490\u0491\u2013\u2014\u2018\u2019\u201C\u201D\u00AB\u00BB\u02BC]*$"


def folded(text: Column) -> Column:
    """NFKC and case folding; plain texts stay in the JVM, only others go to the Arrow function."""
    plain = text.rlike(PLAIN)
    return F.when(plain, F.lower(text)).otherwise(nfkc_casefold(F.when(~plain, text)))


#: White space beyond the blank, and the separators that count as such.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(value: Column) -> Column:
    return F.btrim(value, F.lit(" " + WHITE))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def normalize_title(title: Column) -> Column:
    """Folded, without punctuation, single spaces."""
    return squeezed(F.regexp_replace(folded(title), r"(?U)[^\p{L}\p{N}_\s]", " "))


def content_hash(title: Column, date: Column) -> Column:
    """SHA-256 of the normal title and the date: what makes two posts one event."""
    return F.sha2(F.concat_ws("|", normalize_title(title), F.coalesce(date.cast("string"), F.lit(""))), 256)


def fit(field: str, value: Column) -> Column:
    return F.substring(value, 1, WIDTHS[field]) if field in WIDTHS else value


def norm(text: Column) -> Column:
    """Folded, one apostrophe and dash, ordinals as numbers, no number sign, single spaces.

    Folding makes the number sign the letters ``no`` before it could be left out.
    """
    text = F.translate(folded(text), "’ʼ`´–—‑−", "''''----")
    text = F.regexp_replace(text, "№", "")
    text = F.regexp_replace(text, r"(?U)(\d)-(?:го|й|ого|му)\b", "$1")
    return squeezed(F.regexp_replace(text, r"(?U)\s*-\s*(?=\d)", "-"))


def flat(text: Column) -> Column:
    return F.regexp_replace(norm(text), r"(?U)\s+", "")


def is_empty(value: Column) -> Column:
    return F.coalesce(stripped(value), F.lit("")) == ""


def keys_ok(keys: Column, value: Column) -> Column:
    """Each group of keys has an alternative that the value contains; both in normal form."""
    return F.forall(keys, lambda group: F.exists(group, lambda alt: F.contains(value, alt)))


def joined_groups(groups: Column) -> Column:
    """Groups of alternatives as one text, by control characters that no normal form touches."""
    return F.array_join(F.transform(groups, lambda g: F.array_join(g, "\x01")), "\x02")


def split_groups(groups: Column, normal: Column) -> Column:
    """``groups`` with the alternatives of ``normal``, the normal form of their ``joined_groups``."""
    alternatives = F.transform(F.split(normal, "\x02"), lambda g: F.transform(F.split(g, "\x01"), lambda x: F.trim(x)))
    return F.zip_with(groups, alternatives, lambda g, n: F.when(F.size(g) > 0, n).otherwise(F.array().cast("array<string>")))


def each_normal(groups: Column, form) -> Column:
    """Groups of alternatives, each in the normal form ``form``. Nested arrays can't be sent to an Arrow function
    element by element: they are made normal as one text."""
    return split_groups(groups, form(joined_groups(groups)))


def joined_values(values: list[Column]) -> Column:
    """Several values as one text, for ``joint_forms``; a null value's is empty."""
    return F.array_join(F.array(*(F.coalesce(v, F.lit("")) for v in values)), "\x03")


def joined_lists(lists: list[Column]) -> Column:
    """Lists of ``joined_values`` as one text."""
    return F.array_join(F.array(*(F.array_join(x, "\x04") for x in lists)), "\x05")


def joint_forms(joined: Column) -> Column:
    """For each list of ``joined_lists`` the normal forms of every element's values, worked out in one go."""
    values = lambda text: F.transform(F.split(text, "\x03"), lambda x: F.trim(x))
    return F.transform(F.split(norm(joined), "\x05"), lambda x: F.transform(F.split(x, "\x04"), values))


def parse_edit_lines(text: Column, aliases: dict[str, str], cleared: tuple[str, ...] = ("-", "—", "null")) -> Column:
    """map(field, value) of ``key: value`` lines; unknown keys are left out, cleared ones are null."""
    names = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    lines = F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(names[F.lower(F.trim(F.substring_index(x, ":", 1)))].alias("k"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("v")))
    known = F.filter(pairs, lambda p: p["k"].isNotNull())
    return F.map_from_entries(F.transform(known, lambda p: F.struct(p["k"], F.when(~F.lower(p["v"]).isin(*cleared), p["v"]))))
