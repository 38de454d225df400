"""Structured Streaming forms of indexing and maintenance.

R1 `stream_changes` the change log (adds, flag updates, deletes) into a `delta.LogIndex`: each
                    micro-batch writes its postings and folded state under its batch id, so a
                    replayed one overwrites its own and every batch can be searched at once.
                    No streaming state: the fold happens at read. `stream_index` is the
                    append-only form for messages that never change.
R2 `stream_state`   stateful streaming aggregation (the fold of maintain.py) in update mode;
                    each micro-batch writes the keys it changed as ``delta/v=<batch_id>``
                    (a replayed batch rewrites only its own delta: exactly-once); readers
                    merge base + deltas, `compact_state` folds deltas into a new base.
R3 `stream_dedup`   stateful `dropDuplicates` on (mailbox_id, uid): adding a message twice
                    has the effect of adding it once. `stream_dedup_sessions` forgets a key
                    when it has been quiet for a stated time.

Checkpoints live under the session's shared scratch folder (``spark.checkpoint.dir``), so a
restarted query resumes where it stopped after executor or driver loss.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.operators.delta import LogIndex
from mailsift.operators.ingest import build_postings
from mailsift.operators.maintain import fold_changes, merge_folds
from mailsift.session import new_scratch_path

# Files of one micro-batch at most; the rest comes with the next one.
MAX_FILES = 1000


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def latest_version(spark: SparkSession, root: str, below: int | None = None) -> str | None:
    """Newest complete ``v=<n>`` folder under ``root`` (n < below), via the Hadoop FS API."""
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return None
    best = None
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if not name.startswith("v="):
            continue
        n = int(name[2:])
        if below is not None and n >= below:
            continue
        if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            continue
        if best is None or n > best[0]:
            best = (n, st.getPath().toString())
    return best[1] if best else None


def stage_files(df: DataFrame, path: str) -> str:
    """Write a table as parquet files, one for each of its partitions, to drive a file stream."""
    df.write.mode("errorifexists").parquet(path)
    return path


def stream_index(spark: SparkSession, source: str, schema, sink: str, checkpoint: str | None = None,
                 max_files: int = MAX_FILES) -> str:
    """Index messages as they arrive; postings are appended to ``sink``."""
    checkpoint = checkpoint or new_scratch_path(spark, "ckpt-index")
    msgs = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    q = (build_postings(msgs).writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint).option("path", sink)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return sink


def stream_changes(spark: SparkSession, source: str, schema, root: str, checkpoint: str | None = None,
                   max_files: int = MAX_FILES) -> LogIndex:
    """R1 + R2: apply a change-log stream to the index under ``root``, which belongs to one
    checkpoint: batch ids name its folders. Search the returned index; `LogIndex.compact` when
    the stream is not running."""
    checkpoint = checkpoint or new_scratch_path(spark, "ckpt-changes")
    index = LogIndex(spark, root)

    def apply(batch: DataFrame, batch_id: int) -> None:
        LogIndex(batch.sparkSession, root).append(batch, batch_id)

    changes = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    q = (changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return index


def stream_state(spark: SparkSession, source: str, schema, state_root: str,
                 checkpoint: str | None = None, max_files: int = MAX_FILES) -> str:
    """R2: fold a change-log stream with a stateful streaming aggregation.

    The fold of `maintain.fold_changes` is a declarative aggregate, so Structured Streaming
    keeps it per key in its state store (incremental, checkpointed). In ``update`` mode each
    micro-batch emits only the keys it touched, with their complete folded row; they are
    written as ``delta/v=<batch_id>`` (overwrite: a replayed batch rewrites only its own delta).
    Late events lose against newer ones inside the aggregate. One state root belongs to one
    checkpoint (batch ids name the deltas). Returns ``state_root``; read it with `read_state`,
    fold old deltas into a base with `compact_state`.
    """
    checkpoint = checkpoint or new_scratch_path(spark, "ckpt-state")

    def write_delta(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state_root}/delta/v={batch_id:010d}")

    changes = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    q = (fold_changes(changes).writeStream.outputMode("update").foreachBatch(write_delta)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return state_root


def read_state(spark: SparkSession, state_root: str) -> DataFrame:
    """Current folded state: the newest compacted base merged with the deltas after it."""
    base = latest_version(spark, f"{state_root}/base")
    deltas = spark.read.parquet(f"{state_root}/delta")
    if base is None:
        return merge_folds(deltas.limit(0), deltas)
    since = int(base.rstrip("/").rsplit("v=", 1)[1])
    return merge_folds(spark.read.parquet(base), deltas.where(F.col("v") > since))


def compact_state(spark: SparkSession, state_root: str) -> str:
    """Fold base + deltas into ``base/v=<last batch>``; later reads skip the older deltas."""
    deltas = latest_version(spark, f"{state_root}/delta")
    last = int(deltas.rstrip("/").rsplit("v=", 1)[1])
    path = f"{state_root}/base/v={last:010d}"
    read_state(spark, state_root).write.mode("overwrite").parquet(path)
    return path


def stream_dedup(spark: SparkSession, source: str, schema, sink: str, checkpoint: str | None = None,
                 max_files: int = MAX_FILES, keys=("mailbox_id", "uid"), event_time: str | None = None,
                 delay: str | None = None) -> str:
    """Drop repeated adds of the same key (keyed state store).

    Without ``delay`` every key is remembered (exact over the whole stream). With
    ``event_time`` + ``delay`` (e.g. ``"ts"``, ``"1 day"``) repeats are dropped while they
    arrive within the watermark delay and the state is purged behind the watermark.
    """
    checkpoint = checkpoint or new_scratch_path(spark, "ckpt-dedup")
    adds = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    if delay:
        # watermarks need TIMESTAMP; the test tables carry UTC wall clock as TIMESTAMP_NTZ
        deduped = adds.withColumn("_event_time", F.col(event_time).cast("timestamp")) \
            .withWatermark("_event_time", delay).dropDuplicatesWithinWatermark(list(keys)) \
            .drop("_event_time")
    else:
        deduped = adds.dropDuplicates(list(keys))
    q = (deduped.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint).option("path", sink)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return sink


def dedup_sessions(adds: DataFrame, event_time: str, gap: str, delay: str, keys=("mailbox_id", "uid"), order: str = "seq") -> DataFrame:
    """R3 with bounded state: adds of a key that follow each other by less than ``gap`` are one,
    whatever order they arrive in; the first by (event time, ``order``) is kept whole, with the
    number it stands for in ``n_adds``.

    On a stream a key's state goes when the watermark (``delay`` behind the newest event) passes
    its last add by ``gap``; its row comes out then. Adds that arrive behind the watermark and
    join no open session are dropped and counted in the query's progress. So the state holds the
    keys of the last ``gap + delay``, not all keys ever seen. Adds without event time are in no
    session. The aggregate is built-in, so a task merges its own adds of a key before the shuffle.
    On a table it gives every session.
    """
    # watermarks need TIMESTAMP; the test tables carry UTC wall clock as TIMESTAMP_NTZ
    timed = adds.withColumn("_event_time", F.col(event_time).cast("timestamp")).withWatermark("_event_time", delay)
    first = F.min_by(F.struct(*[c for c in adds.columns]), F.struct("_event_time", order))
    return timed.groupBy(*keys, F.session_window("_event_time", gap)) \
        .agg(first.alias("first"), F.count(F.lit(1)).alias("n_adds")).select("first.*", "n_adds")


def stream_dedup_sessions(spark: SparkSession, source: str, schema, sink: str, event_time: str, gap: str, delay: str,
                          checkpoint: str | None = None, max_files: int = MAX_FILES) -> str:
    """`dedup_sessions` over the adds of a change-log stream; closed sessions are appended to ``sink``."""
    checkpoint = checkpoint or new_scratch_path(spark, "ckpt-sessions")
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    q = (dedup_sessions(log.where(F.col("op") == "add"), event_time, gap, delay).writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint).option("path", sink)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return sink


# Fixed value: the schema of Spark's binaryFile source.
BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def stream_eml_index(spark: SparkSession, source: str, sink: str, mailbox_id: str | None = None,
                     checkpoint: str | None = None, max_files: int = MAX_FILES) -> str:
    """R1 + S1 for raw mail: ``.eml`` files arriving in ``source`` are parsed (MIME, per task,
    `mapInArrow`) and indexed; postings are appended to ``sink``. mailbox_id defaults to the
    parent folder name and uid to the numeric file name, as in `sources.mime.read_eml`."""
    from mailsift.sources.mime import eml_columns, parse_mime
    checkpoint = checkpoint or new_scratch_path(spark, "ckpt-eml")
    files = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
             .option("pathGlobFilter", "*.eml")
             .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(source))
    msgs = parse_mime(eml_columns(files, mailbox_id)) \
        .withColumn("internal_date", F.lit(None).cast("timestamp_ntz"))
    q = (build_postings(msgs).writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint).option("path", sink)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return sink
