"""Small column expressions used across operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: [2015-01-01, 2026-01-01) UTC in seconds, the span in which a stored time is believed.
TIME_FROM, TIME_TO = 1420070400, 1767225600


def tokens(text: Column) -> Column:
    """Offline token count: 0 for empty or null, else the larger of 1 and characters div 4."""
    n = F.coalesce(F.char_length(text), F.lit(0)).cast("long")
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), F.expr("0") + F.floor(n / 4))).cast("long")


def stored_seconds(v: Column) -> Column:
    """Seconds of a stored time kept in seconds, milliseconds or microseconds; null if no unit fits.

    NaN and infinities fit no unit.
    """
    v = v.cast("double")
    fits = lambda x: (x >= TIME_FROM) & (x < TIME_TO)
    return F.when(fits(v), v).when(fits(v / 1e3), v / 1e3).when(fits(v / 1e6), v / 1e6)


def plain(s: Column) -> Column:
    """Trimmed of white space and lower-cased; null as empty."""
    return F.lower(F.regexp_replace(F.coalesce(s, F.lit("")), r"^\s+|\s+$", ""))


def clean_name(s: Column) -> Column:
    """Lower-cased, with only letters, digits, '.', '_' and '-' kept; null as empty."""
    return F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), r"[^\p{L}\p{N}._-]", "")


def source_name(s: Column) -> Column:
    """Plain source without trailing slash, with blanks and underscores as hyphens."""
    return F.regexp_replace(F.regexp_replace(plain(s), r"/+$", ""), r"[ _]", "-")
