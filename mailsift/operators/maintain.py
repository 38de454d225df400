"""Index maintenance from a change log.

A change log row is (seq, ts, op, mailbox_id, uid, flags, + message columns for 'add').
The fold is a mergeable aggregate per (mailbox_id, uid):

    flags      = max_by(flags, seq)        latest flag value of any event
    flags_seq  = max(seq)
    last_add   = max(seq) of adds
    last_delete= max(seq) of deletes

Two folds merge with the same aggregate, so a late event loses against newer ones across
batches too; the folded rows double as tombstones. A key is live when
``last_add > coalesce(last_delete, -1)``: a delete is final until a later add (Q16 fixed).

Applying the folds to an index is `delta.LogIndex`. Every fold is a `groupBy(mailbox_id, uid)`: the shuffle key holds the uid, so a mailbox with a
third of all messages still spreads over all tasks; partial aggregation runs map-side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["mailbox_id", "uid"]
FOLD_COLS = ["mailbox_id", "uid", "flags", "flags_seq", "last_add", "last_delete"]


def fold_changes(changes: DataFrame, order: str = "seq") -> DataFrame:
    """W3 + W4: one folded row per key (live or tombstone). ``order`` is the sequence column."""
    seq = F.col(order)
    op = F.col("op")
    return changes.groupBy(*KEYS).agg(
        F.max_by("flags", seq).alias("flags"),
        F.max(seq).alias("flags_seq"),
        F.max(F.when(op == "add", seq)).alias("last_add"),
        F.max(F.when(op == "delete", seq)).alias("last_delete"),
    )


def merge_folds(*folds: DataFrame, extra: dict | None = None) -> DataFrame:
    """Merge folds of several batches, in any order: the same aggregate over their union.
    ``extra`` names further aggregates over other columns of the folds."""
    both = reduce(lambda a, b: a.unionByName(b),
                  [f if extra else f.select(*FOLD_COLS) for f in folds])
    return both.groupBy(*KEYS).agg(
        F.max_by("flags", "flags_seq").alias("flags"),
        F.max("flags_seq").alias("flags_seq"),
        F.max("last_add").alias("last_add"),
        F.max("last_delete").alias("last_delete"),
        *[column.alias(name) for name, column in (extra or {}).items()],
    )


def is_live() -> F.Column:
    return F.col("last_add") > F.coalesce(F.col("last_delete"), F.lit(-1))


def live_flags(fold: DataFrame) -> DataFrame:
    """Current flags of every live message."""
    return fold.where(is_live()).select(*KEYS, "flags")


def deleted_keys(fold: DataFrame) -> DataFrame:
    """Keys whose latest add (if any) is followed by a delete."""
    return fold.where(F.col("last_delete").isNotNull() & ~F.coalesce(is_live(), F.lit(False))) \
        .select(*KEYS)


CHUNK = 4096   # events per prefix-scan chunk of one key


def rejected_updates(changes: DataFrame, order: str = "seq", chunk: int = CHUNK) -> DataFrame:
    """Q17: flag updates of a key that was not live at that moment (no add yet, or deleted).

    A running "last add / last delete before this event" per key, computed as a two-level
    prefix scan so that one key holding a third of the log never sits in one task:
    1. events are cut into chunks of ``chunk`` consecutive sequence numbers; each
       (key, chunk) aggregates its last add / delete (partial aggregation, spread by chunk);
    2. a window over a key's *chunk summaries* (events / chunk rows) gives the state before
       each chunk;
    3. a window over (key, chunk) (at most ``chunk`` rows) gives the state inside the chunk.
    """
    seq, op = F.col(order), F.col("op")
    ev = changes.select(*KEYS, seq.alias("seq"), "op", F.floor(seq / chunk).alias("chunk"))
    add_s = F.when(op == "add", F.col("seq"))
    del_s = F.when(op == "delete", F.col("seq"))
    summary = ev.groupBy(*KEYS, "chunk").agg(F.max(add_s).alias("c_add"), F.max(del_s).alias("c_del"))
    before = Window.partitionBy(*KEYS).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    prefix = summary.select(*KEYS, "chunk", F.max("c_add").over(before).alias("p_add"),
                            F.max("c_del").over(before).alias("p_del"))
    inside = Window.partitionBy(*KEYS, "chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    local = ev.select(*KEYS, "chunk", "seq", "op", F.max(add_s).over(inside).alias("l_add"),
                      F.max(del_s).over(inside).alias("l_del"))
    hist = local.join(prefix, [*KEYS, "chunk"])
    prev_add = F.greatest("l_add", "p_add")          # greatest skips NULLs
    prev_del = F.greatest("l_del", "p_del")
    alive = prev_add > F.coalesce(prev_del, F.lit(-1))
    return hist.where((F.col("op") == "flags") & ~F.coalesce(alive, F.lit(False))) \
        .select(*KEYS, "seq")


# ------------------------------------------------------------------ uid ranges

# Equal parts that a mailbox's uid span is cut into, and copies of its span to meet its messages.
RANGE_BUCKETS = 1024
SPAN_COPIES = 16


def _pieces(state: DataFrame, ranges: DataFrame, carry: tuple, buckets: int) -> tuple[DataFrame, DataFrame]:
    """(keys with their bucket, ranges cut into one piece for each bucket they meet).

    A mailbox's span from its least to its largest uid is cut into ``buckets`` equal parts and
    ranges are clipped to it, so a range gives ``buckets`` pieces at most, whatever its width. A
    NULL end is open.
    """
    salt = F.pmod(F.xxhash64("uid"), F.lit(SPAN_COPIES)).cast("int")
    span = state.groupBy("mailbox_id").agg(F.min("uid").alias("first"), F.max("uid").alias("last"))
    span = span.withColumn("width", F.expr(f"(last - first) div {buckets} + 1"))
    copies = span.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPAN_COPIES - 1))))
    keys = state.select(*KEYS, salt.alias("salt")).join(copies, ["mailbox_id", "salt"]) \
        .select(*KEYS, F.expr("(uid - first) div width").alias("bucket"))
    clipped = ranges.select("mailbox_id", F.col("lo").cast("bigint").alias("lo"),
                            F.col("hi").cast("bigint").alias("hi"), *carry) \
        .where((F.col("lo") <= F.col("hi")) | F.col("lo").isNull() | F.col("hi").isNull()) \
        .join(span, "mailbox_id") \
        .withColumns({"lo": F.greatest("lo", "first"), "hi": F.least("hi", "last")}) \
        .where(F.col("lo") <= F.col("hi"))
    pieces = clipped.withColumn("bucket", F.explode(F.sequence(F.expr("(lo - first) div width"),
                                                               F.expr("(hi - first) div width")))) \
        .withColumn("start", F.expr("first + bucket * width")) \
        .select("mailbox_id", "bucket", F.greatest("lo", "start").alias("lo"),
                F.least(F.col("hi"), F.col("start") + F.col("width") - 1).alias("hi"), *carry)
    return keys, pieces


def range_hits(state: DataFrame, ranges: DataFrame, carry: tuple, buckets: int = RANGE_BUCKETS) -> DataFrame:
    """Each key of ``state`` with the ``carry`` columns of each range that holds it."""
    keys, pieces = _pieces(state, ranges, carry, buckets)
    return keys.join(pieces, ["mailbox_id", "bucket"]) \
        .where(F.col("uid").between(F.col("lo"), F.col("hi"))).select(*KEYS, *carry)


def expand_uid_ranges(state: DataFrame, ranges: DataFrame, buckets: int = RANGE_BUCKETS) -> DataFrame:
    """Keys of ``state`` inside any (mailbox_id, lo, hi) range, without enumerating uids.

    An equi-join on (mailbox_id, bucket). Pieces of one bucket that overlap or touch are merged
    first, so a key meets one piece at most and wide ranges that cover a whole bucket count once.
    """
    keys, pieces = _pieces(state, ranges, (), buckets)
    by_start = Window.partitionBy("mailbox_id", "bucket").orderBy("lo", "hi")
    reach = F.max("hi").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    opened = pieces.distinct().withColumn("reach", reach) \
        .withColumn("opens", F.when(F.col("lo") <= F.col("reach") + 1, 0).otherwise(1))
    merged = opened.withColumn("run", F.sum("opens").over(by_start)) \
        .groupBy("mailbox_id", "bucket", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return keys.join(merged, ["mailbox_id", "bucket"]) \
        .where(F.col("uid").between(F.col("lo"), F.col("hi"))).select(*KEYS).distinct()
