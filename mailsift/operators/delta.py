"""A searchable index kept as batches of a change log.

Every batch of the log adds tables of its own under one root and touches nothing older:

    postings/v=<batch>/field=<F>   postings of the batch's adds, each with ``add_seq``
    state/v=<batch>                one folded row per key of the batch (see maintain.py),
                                   with the message columns of its newest add
    dictionary/, grams/v=<batch>   terms of the batch's postings with their document frequency, and
                                   the trigrams of these terms
    base/<table>/v=<batch>         the same tables after `compact`, up to that batch
    batches/<batch>, bases/<batch> an empty file for each batch and base that is written whole

Writing a batch reads the batch alone: postings are exploded without a shuffle and bodies never
leave their task. The change of a key is decided at read time. A posting is dead when its key
has a later add or delete, so the folded rows of the batches are the tombstones:

    dead  <=>  add_seq < greatest(last_add, last_delete)

A folded row also keeps the first add of its key, so a key that was added once and not deleted later is no
tombstone. What is left is written before it meets the postings, so Spark knows its size.

`LogIndex.index` gives the live tables. Search filters are pushed below the anti join with the
tombstones, so only matching postings meet it, and Spark broadcasts the tombstones where they
stay below its own byte threshold. `compact` folds everything into a new base without
tombstones; how often is the caller's choice. Order is by ``seq`` alone: batches may arrive late
or in any order.

Dictionaries add up: a term's frequency is the sum over the batches, less its postings that tombstones have
killed. The live dictionary counts these in a semi join with the tombstones; ``index(exact=False)`` leaves them in,
so that frequencies are upper bounds and a term may have no live posting, which no search result depends on.

A batch number names its folders and a repeated batch overwrites its own, so a replayed
micro-batch changes nothing. Readers see a batch once its file under ``batches`` is there, which is
written last; one listing finds all of them. ``seq`` must be
unique within a key. Compacting must not run beside a writer of a batch it covers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.functions.flags import normalize_flags
from mailsift.operators.batch import gram_index, gram_statistics
from mailsift.operators.ingest import Index, blooms, build_postings, build_state, term_dictionary
from mailsift.operators.maintain import FOLD_COLS, KEYS, fold_changes, is_live, merge_folds, range_hits
from mailsift.session import materialize

STATE_COLS = ["internal_date", "header_date", "size", "first_from", "first_to", "first_cc",
              "display_from", "display_to", "base_subject"]


def as_adds(messages: DataFrame, seq: Column | int) -> DataFrame:
    """Messages as 'add' rows of a change log."""
    return messages.select(F.lit(seq).cast("bigint").alias("seq") if isinstance(seq, int) else seq.alias("seq"),
                           F.col("internal_date").alias("ts"), F.lit("add").alias("op"),
                           *KEYS, "flags", "headers", "body", "size")


def batch_postings(changes: DataFrame) -> DataFrame:
    """Postings of every add of a batch, with the add's ``seq``. Narrow: no shuffle."""
    return build_postings(changes.where(F.col("op") == "add").withColumn("add_seq", F.col("seq")),
                          keep=("add_seq",))


def batch_state(changes: DataFrame) -> DataFrame:
    """One folded row per key; message columns are read before the shuffle, bodies stay behind."""
    events = changes.withColumn("flags", normalize_flags("flags"))
    adds = build_state(events.where(F.col("op") == "add").withColumn("internal_date", F.col("ts")),
                       keep=("seq",))
    latest = adds.groupBy(*KEYS).agg(F.max_by(F.struct(*STATE_COLS), "seq").alias("message"), F.min("seq").alias("first_add"))
    fold = fold_changes(events)
    same = [fold[k].eqNullSafe(latest[k]) for k in KEYS]
    return fold.join(latest, same[0] & same[1], "left").select(*[fold[c] for c in FOLD_COLS], "message", "first_add")


def merge_states(parts: DataFrame) -> DataFrame:
    """The folds of several batches as one row per key: the aggregate of `merge_folds`, and the
    message columns of the newest add."""
    return merge_folds(parts, extra={"message": F.max_by("message", "last_add"), "first_add": F.min(_first_add())})


def _first_add() -> Column:
    """Folded rows written before they kept it: the least number, so that no tombstone is missed."""
    return F.coalesce("first_add", F.when(F.col("last_add").isNotNull(), F.lit(-1 << 63)))


def tombstones(parts: DataFrame, own: bool = False) -> DataFrame:
    """(mailbox_id, uid, dead_below): postings of the key with a smaller ``add_seq`` are dead. ``own``:
    only those that some add of ``parts`` is below, all that postings of these parts can meet."""
    dead = parts.groupBy(*KEYS).agg(F.max(F.greatest("last_add", "last_delete")).alias("dead_below"), F.min(_first_add()).alias("first_add"))
    return dead.where("first_add < dead_below" if own else "dead_below is not null").drop("first_add")


def without_dead(postings: DataFrame, dead: DataFrame, how: str = "left_anti") -> DataFrame:
    """Postings that no later add or delete of their key has replaced (``left_semi``: the others)."""
    dead = dead.select(*[F.col(k).alias("dead_" + k) for k in KEYS], "dead_below")
    same = [F.col(k).eqNullSafe(F.col("dead_" + k)) for k in KEYS]
    return postings.join(dead, same[0] & same[1] & (F.col("add_seq") < F.col("dead_below")), how)


class LogIndex:
    """The index under ``root``: append batches of changes, read the live tables, compact."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ------------------------------------------------------------------ folders

    def _place(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _marked(self, kind: str) -> list[int]:
        """Numbers of the whole batches or bases: one listing."""
        fs, path = self._place(kind)
        if not fs.exists(path):
            return []
        return [int(status.getPath().getName()) for status in fs.listStatus(path)]

    def _mark(self, kind: str, number: int, whole: bool) -> None:
        fs, path = self._place(f"{kind}/{number}")
        if whole:
            fs.create(path, True).close()
        else:
            fs.delete(path, False)

    def _parts(self) -> tuple[int, list[int]]:
        """(newest base or -1, whole batches after it)."""
        base = max(self._marked("bases"), default=-1)
        return base, sorted(v for v in self._marked("batches") if v > base)

    def _read(self, table: str, base: int, batches: list[int]) -> DataFrame | None:
        places = []
        if base >= 0:
            places.append((f"{self.root}/base/{table}", [base]))
        if batches:
            places.append((f"{self.root}/{table}", batches))
        parts = [self.spark.read.schema(SCHEMAS[table]).option("basePath", place)
                 .parquet(*[f"{place}/v={v}" for v in versions]).drop("v") for place, versions in places]
        return reduce(lambda a, b: a.unionByName(b), parts) if parts else None

    # ------------------------------------------------------------------ writing

    def append(self, changes: DataFrame, batch: int | None = None) -> int:
        """Write one batch (``schema.CHANGES`` rows); returns its number."""
        if batch is None:
            base, batches = self._parts()
            batch = max([base, *batches]) + 1
        self._mark("batches", batch, False)
        batch_postings(changes).sortWithinPartitions("field", "mailbox_id", "term") \
            .write.mode("overwrite").options(**blooms("term", "uid")).partitionBy("field").parquet(f"{self.root}/postings/v={batch}")
        batch_state(changes).write.mode("overwrite").parquet(f"{self.root}/state/v={batch}")
        self._write_dictionary("", batch)
        self._mark("batches", batch, True)
        return batch

    def _write_dictionary(self, place: str, number: int) -> None:
        """Dictionary and trigrams of the postings just written under ``place``."""
        read = lambda table: self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.root}/{place}{table}/v={number}")
        term_dictionary(read("postings")).write.mode("overwrite").parquet(f"{self.root}/{place}dictionary/v={number}")
        gram_index(read("dictionary")).select("field", "term", "gram").sortWithinPartitions("field", "gram") \
            .write.mode("overwrite").options(**blooms("gram")).parquet(f"{self.root}/{place}grams/v={number}")

    def update_flags(self, ranges: DataFrame) -> int:
        """Replace the flags of all live messages in (mailbox_id, lo, hi, seq, flags) ranges."""
        return self.append(range_events(self.state(ranges.select("mailbox_id")), ranges, "flags"))

    def delete(self, ranges: DataFrame) -> int:
        """Delete all live messages in (mailbox_id, lo, hi, seq) ranges."""
        return self.append(range_events(self.state(ranges.select("mailbox_id")), ranges, "delete"))

    def compact(self) -> None:
        """Fold the base and all batches into a new base; folded rows of dead keys are kept, so
        that a late add of a deleted message stays dead. Postings and folded rows are written in
        ranges of (mailbox_id, uid), so a message lies in one file of a field."""
        base, batches = self._parts()
        if not batches:
            return
        postings, state = self.postings(with_seq=True), self.folded()
        self._mark("bases", batches[-1], False)
        postings.repartitionByRange("mailbox_id", "uid").sortWithinPartitions("field", "mailbox_id", "term") \
            .write.mode("overwrite").options(**blooms("term", "uid")).partitionBy("field") \
            .parquet(f"{self.root}/base/postings/v={batches[-1]}")
        state.repartitionByRange(*KEYS).sortWithinPartitions(*KEYS).write.mode("overwrite").parquet(f"{self.root}/base/state/v={batches[-1]}")
        self._write_dictionary("base/", batches[-1])
        self._mark("bases", batches[-1], True)

    # ------------------------------------------------------------------ reading

    def folded(self, mailboxes: DataFrame | None = None) -> DataFrame:
        """One folded row per key ever seen, live or dead; of some ``mailboxes`` only, if given."""
        parts = self._read("state", *self._parts())
        parts = self._empty("state") if parts is None else parts
        if mailboxes is not None:  # before the fold, so other mailboxes are not shuffled
            parts = parts.join(mailboxes.select("mailbox_id").distinct(), "mailbox_id", "left_semi")
        return merge_states(parts)

    def postings(self, with_seq: bool = False) -> DataFrame:
        """Postings of live messages."""
        base, batches = self._parts()
        found = self._read("postings", base, batches)
        if found is None:
            found = self._empty("postings")
        elif batches:
            found = self._live(base, batches)
        return found if with_seq else found.drop("add_seq")

    def _live(self, base: int, batches: list[int], how: str = "left_anti") -> DataFrame:
        """The base meets the rows written after it alone; later postings, late ones among them,
        meet the folded rows of the base too."""
        recent, newer = self._read("state", -1, batches), self._read("postings", -1, batches)
        dead = materialize(tombstones(self._read("state", base, batches), own=True), "tombstones")
        newer = without_dead(newer, dead, how)
        if base < 0:
            return newer
        older = without_dead(self._read("postings", base, []), materialize(tombstones(recent), "tombstones"), how)
        return older.unionByName(newer)

    def state(self, mailboxes: DataFrame | None = None) -> DataFrame:
        """``message_state`` of the live messages."""
        return self.folded(mailboxes).where(is_live()) \
            .select(*KEYS, "flags", *[F.col("message")[c].alias(c) for c in STATE_COLS])

    def dictionary(self, exact: bool = True) -> DataFrame:
        """(field, term, df) of the live postings; not ``exact``: with the dead ones counted."""
        base, batches = self._parts()
        found = self._read("dictionary", base, batches)
        if found is None:
            return self._empty("dictionary")
        if not batches:
            return found
        if exact:
            dead = term_dictionary(self._live(base, batches, "left_semi")).withColumn("df", -F.col("df"))
            found = found.unionByName(dead)
        return found.groupBy("field", "term").agg(F.sum("df").alias("df")).where("df > 0")

    def grams(self, dictionary: DataFrame) -> DataFrame:
        """(field, term, gram, df): the trigrams of a dictionary of this index. A filter on the gram reaches the files."""
        found = self._read("grams", *self._parts())
        found = self._empty("grams") if found is None else found.distinct()
        return found.join(dictionary, ["field", "term"])

    def index(self, exact: bool = True) -> Index:
        """The live tables, to search in, with dictionary and trigrams (see `dictionary`)."""
        dictionary = self.dictionary(exact)
        grams = self.grams(dictionary)
        return Index(self.postings(), self.state(), dictionary, grams, gram_statistics(grams))

    def _empty(self, table: str) -> DataFrame:
        return self.spark.createDataFrame([], SCHEMAS[table])


#: Columns of the two tables as they are written.
SCHEMAS = {
    "dictionary": "field string, term string, df bigint",
    "grams": "field string, term string, gram string",
    "postings": "mailbox_id string, term string, uid bigint, add_seq bigint, field string",
    "state": "mailbox_id string, uid bigint, flags array<string>, flags_seq bigint, last_add bigint, "
             "last_delete bigint, message struct<internal_date:timestamp_ntz, header_date:timestamp_ntz, "
             "size:bigint, first_from:string, first_to:string, first_cc:string, display_from:string, "
             "display_to:string, base_subject:string>, first_add bigint",
}


def range_events(state: DataFrame, ranges: DataFrame, op: str) -> DataFrame:
    """W3/W4 by uid range: one change row per (live message, range) pair."""
    carry = ("seq", "flags") if op == "flags" else ("seq",)
    hits = range_hits(state, ranges, carry)
    flags = F.col("flags") if op == "flags" else F.array().cast("array<string>")
    return hits.select("seq", F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(op).alias("op"), *KEYS,
                       flags.alias("flags"),
                       F.lit(None).cast("array<struct<name:string,value:string>>").alias("headers"),
                       F.lit(None).cast("string").alias("body"), F.lit(None).cast("bigint").alias("size"))
