"""Result ordering (T7-T16): ``key asc|desc, uid asc``; missing keys first ascending.

Across several mailboxes ``mailbox_id`` breaks the remaining ties, so a top-k is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["mailbox_id", "uid"]


def sort_key(name: str) -> Column:
    """Sort key over message_state columns."""
    keys = {
        "uid": lambda: F.col("uid"),
        "sent_date": lambda: F.coalesce(F.col("header_date"), F.col("internal_date")),  # Date header first (T8)
        "base_subject": lambda: F.col("base_subject"),
        "mailbox_from": lambda: F.col("first_from"),
        "mailbox_cc": lambda: F.col("first_cc"),
        "mailbox_to": lambda: F.col("first_to"),
        "display_to": lambda: F.col("display_to"),
        "display_from": lambda: F.col("display_from"),
        "arrival": lambda: F.col("internal_date"),
        "size": lambda: F.col("size"),
    }
    if name not in keys:
        raise ValueError(f"unsupported sort {name!r}")
    return keys[name]()


def sort_results(result: DataFrame, state: DataFrame, name: str, reverse: bool = False,
                 limit: int | None = None) -> DataFrame:
    """Attach the sort key from message_state and order by it (uid breaks ties).

    With ``limit`` Spark plans a top-k (TakeOrderedAndProject) instead of a full sort.
    """
    joined = result.select(*KEYS).join(state, KEYS)
    out = joined.select(*KEYS, sort_key(name).alias("sort_key")).orderBy(*_reorder(name, reverse))
    return out.limit(limit) if limit else out


def _reorder(name: str, reverse: bool) -> list[Column]:
    k = F.col("sort_key")
    first = k.desc_nulls_last() if reverse else k.asc_nulls_first()
    return [first, F.col("uid").asc(), F.col("mailbox_id").asc()]
