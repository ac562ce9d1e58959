"""Scalar rules of the lineage model as Column -> Column functions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Identifiers that a rule depends on, the header of a view that declares its columns, and a declared column.
TABLE_TOKEN = r"(?i)\b(?:STG|DWH|SRC)_[A-Z0-9_]{3,}\b"
VIEW_HEADER = r'(?si)VIEW\s+("(?:[^"]+)"|\S+)\s*\((.*?)\)\s*AS\s'
QUOTED = r'"([^"]+)"'


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without white space, of any alphabet, at either end."""
    x = _c(x).cast("string")
    seen = lambda c: F.ascii(c).between(33, 126)  # noqa: E731  no white space; most names need no pattern
    return F.when(seen(x) & seen(F.substring(x, -1, 1)), x).otherwise(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))


def normalize(x: Column | str) -> Column:
    return F.upper(strip(x))


def is_field(column: Column | str) -> Column:
    """Whether a column name makes a key at all."""
    return F.coalesce(normalize(column) != "", F.lit(False))


def stated(x: Column | str) -> Column:
    """Neither null nor the empty string; blanks do count."""
    return F.coalesce(_c(x) != "", F.lit(False))


def key_of(table: Column | str, column: Column | str) -> Column:
    """One string for a field key, in which a null table is not a blank one."""
    t, c = normalize(table), normalize(column)
    none = F.lit("-")
    return F.concat(F.coalesce(c, F.lit("")), F.coalesce(t, F.lit("")), F.lit("|"), F.coalesce(F.length(t).cast("string"), none), F.when(c.isNull(), none).otherwise(F.lit("")))


def format_key(table: Column | str, column: Column | str) -> Column:
    return F.concat_ws(".", F.nullif(_c(table), F.lit("")), _c(column))


def role(x: Column | str) -> Column:
    return F.coalesce(F.nullif(_c(x), F.lit("")), F.lit("value"))


def short_path(x: Column | str) -> Column:
    x = _c(x)
    at = F.instr(x, "/Archive/")
    return F.when(at > 0, F.concat(F.lit("Archive/"), F.substring(x, at + 9, F.length(x)))).otherwise(F.nullif(x, F.lit("")))


def basename(x: Column | str) -> Column:
    return F.substring_index(_c(x), "/", -1)


def squash(x: Column | str) -> Column:
    """Lower case, one blank for white space, none around brackets and commas."""
    one = F.lower(F.regexp_replace(strip(x), r"(?U)\s+", " "))
    return F.regexp_replace(one, r"\s*([(),])\s*", "$1")


def dependency_tokens(logic: Column | str, own: Column | str) -> Column:
    found = F.transform(F.regexp_extract_all(F.coalesce(_c(logic), F.lit("")), F.lit(TABLE_TOKEN), F.lit(0)), F.upper)
    return F.array_join(F.array_sort(F.array_except(F.array_distinct(found), F.array(F.coalesce(F.upper(_c(own)), F.lit(""))))), ", ")


def view_name(text: Column | str) -> Column:
    return F.regexp_replace(F.nullif(F.regexp_extract(_c(text), VIEW_HEADER, 1), F.lit("")), '^"+|"+$', "")


def view_columns(text: Column | str) -> Column:
    return F.regexp_extract_all(F.regexp_extract(_c(text), VIEW_HEADER, 2), F.lit(QUOTED), F.lit(1))


def content_key(kind: Column | str, content: Column | str, sheet: Column | str) -> Column:
    return digest_key(kind, F.sha2(_c(content), 256), sheet)


def digest_key(kind: Column | str, digest: Column | str, sheet: Column | str) -> Column:
    """The same from a SHA-256 in hexadecimal digits."""
    return F.concat_ws("|", _c(kind), F.substring(_c(digest), 1, 16), F.coalesce(_c(sheet), F.lit("None")))


def ratio(n: Column, total: Column, digits: int = 0) -> Column:
    """'n/total (p%)', p rounded half to even after dividing."""
    p = F.bround(n.cast("double") / total * 100.0, digits)
    text = p.cast("long").cast("string") if digits == 0 else F.format_number(p, digits)
    return F.concat(n.cast("string"), F.lit("/"), total.cast("string"), F.lit(" ("), text, F.lit("%)"))


def strip_prefix(table: Column | str, prefix: str) -> Column:
    """The raw name without the prefix, null where it hasn't got it."""
    t = _c(table)
    return F.when(F.startswith(normalize(t), F.lit(prefix.upper())), F.substring(t, len(prefix) + 1, 1_000_000))


def header_row(cells: Column | str, anchors: list[list[str]]) -> Column:
    """Whether a row of cells is the header: four cells or more, and each anchor group claims a cell of its own.

    Groups claim greedily, in order, the first cell that they match and that isn't taken.
    """
    cells = F.transform(F.filter(_c(cells), lambda c: c.isNotNull()), lambda c: F.lower(strip(c)))
    claimed = F.array().cast("array<int>")
    ok = F.size(cells) >= 4
    for group in anchors:
        hits = F.filter(F.sequence(F.lit(0), F.greatest(F.size(cells) - 1, F.lit(0))), _matches(cells, group))
        free = F.array_min(F.array_except(hits.cast("array<int>"), claimed))
        ok = ok & free.isNotNull()
        claimed = F.concat(claimed, F.array(F.coalesce(free, F.lit(-1))))
    return F.coalesce(ok, F.lit(False))


def clean(x: Column | str) -> Column:
    """A cell for comparison: composed characters, no white space around them, '' for null.

    Only text outside ASCII goes through the Arrow function; ASCII is composed as it is.
    """
    x = _c(x).cast("string")
    return F.coalesce(strip(F.when(F.regexp_like(x, F.lit(r"^\p{ASCII}*$")), x).otherwise(_composed()(x))), F.lit(""))


@lru_cache(1)
def _composed():
    """Made at first use: the return type needs a running Spark."""

    @F.pandas_udf("string")
    def composed(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))

    return composed


def excerpt(x: Column | str, n: int = 60) -> Column:
    return F.substring(_c(x), 1, n)


def _matches(cells: Column, group: list[str]):
    return lambda i: _any(F.get(cells, i), group)


def _any(cell: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(cell, F.lit(w))
    return F.coalesce(out, F.lit(False))
