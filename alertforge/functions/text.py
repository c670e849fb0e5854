"""Text column expressions (native; no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def py_title(c: Column) -> Column:
    """Python ``str.title()``: every letter after a non-letter is upper-cased,
    all other letters lower-cased (unlike ``initcap``, which only restarts
    after spaces)."""
    pieces = F.split(F.lower(c), r"(?<=[^\p{L}])")
    return F.array_join(
        F.transform(pieces, lambda p: F.concat(F.upper(p.substr(F.lit(1), F.lit(1))),
                                               p.substr(F.lit(2), F.length(p)))), "")


def py_str(c: Column, dtype: str) -> Column:
    """``str(value)`` as pandas would print it, for the types in play.

    Timestamps are UTC-aware in the source frames, so they print with
    ``+00:00``; fractional seconds only when non-zero.
    """
    if dtype.startswith("timestamp"):
        micros = F.pmod(F.unix_micros(c.cast("timestamp")), F.lit(1_000_000))
        frac = F.when(micros == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0")))
        return F.concat(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), frac, F.lit("+00:00"))
    if dtype == "boolean":
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    return c.cast("string")


def label_line(label: str, value: Column, dtype: str, titlecase_underscored: bool = True) -> Column:
    """``Label: value`` or null when the value is null, blank or 'nan'."""
    text = F.regexp_replace(py_str(value, dtype), r"(?U)^\s+|\s+$", "")
    if titlecase_underscored:
        text = F.when(F.contains(text, F.lit("_")), py_title(F.regexp_replace(text, "_", " "))).otherwise(text)
    keep = text.isNotNull() & (F.length(text) > 0) & (F.lower(text) != "nan")
    return F.when(keep, F.concat(F.lit(f"{label}: "), text))


def na_line(label: str, value: Column | None, dtype: str = "string") -> Column:
    """``Label: value`` with ``N/A`` for a missing field (summary documents)."""
    if value is None:
        return F.lit(f"{label}: N/A")
    return F.concat(F.lit(f"{label}: "), F.coalesce(py_str(value, dtype), F.lit("None")))
