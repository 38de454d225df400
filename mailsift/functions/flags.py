"""Flag functions (F20-F22). Flags live as ARRAY<STRING>, upper-cased, system flags first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# System flag names, in the order they are written.
SYSTEM_FLAGS = ("ANSWERED", "DELETED", "DRAFT", "FLAGGED", "RECENT", "SEEN")


def flag_name(flag: str) -> str:
    """system flag -> ``\\NAME`` (SEEN is ``\\SEEN``); user flags keep their own name.

    Names are upper-cased because flag search ignores case.
    """
    f = (flag or "").strip()
    bare = f.lstrip("\\").upper()
    if bare in SYSTEM_FLAGS:
        return "\\" + bare
    return f.upper()


def flag_name_col(col: Column | str) -> Column:
    """F21 as a column expression."""
    c = col if isinstance(col, Column) else F.col(col)
    bare = F.upper(F.regexp_replace(F.trim(c), r"^\\+", ""))
    return F.when(bare.isin(*SYSTEM_FLAGS), F.concat(F.lit("\\"), bare)).otherwise(F.upper(F.trim(c)))


def normalize_flags(col: Column | str) -> Column:
    """Upper-case and de-duplicate a flag array; NULL becomes the empty array."""
    c = col if isinstance(col, Column) else F.col(col)
    return F.coalesce(F.array_distinct(F.transform(c, flag_name_col)), F.array().cast("array<string>"))


def booleans_to_flags(answered=None, deleted=None, draft=None, flagged=None, recent=None,
                      seen=None, user_flags: Column | None = None) -> Column:
    """six boolean columns (+ optional user flags) -> flag array in system order."""
    parts = []
    for name, col in zip(SYSTEM_FLAGS, (answered, deleted, draft, flagged, recent, seen)):
        if col is not None:
            parts.append(F.when(col, F.lit("\\" + name)))
    arr = F.array_compact(F.array(*parts)) if parts else F.array().cast("array<string>")
    if user_flags is not None:
        arr = F.concat(arr, F.transform(user_flags, F.upper))
    return arr


def flags_to_string(col: Column | str) -> Column:
    """flags joined without separator (the joined form the substring test runs on)."""
    c = col if isinstance(col, Column) else F.col(col)
    return F.array_join(F.coalesce(c, F.array().cast("array<string>")), "")
