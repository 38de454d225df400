"""Index build: messages -> postings + message_state.

Design for scale:
- Tokenizing, routing and exploding are narrow (one `select` + two `explode`s): no shuffle.
- De-duplication (P3) is done inside each message with `array_distinct`, so a message's
  postings are unique without a shuffle. That is exact whenever `(mailbox_id, uid)` is unique
  in the input, which the change-log fold guarantees. `dedup="global"` adds a distinct on the
  posting key for inputs that may repeat a message (partial aggregation happens map-side).
- message_state is a projection of messages: one row per message, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.functions import headers as H
from mailsift.functions.flags import normalize_flags
from mailsift.functions.text import tokenize
from mailsift.schema import ADDRESS_FIELDS

POSTING_KEY = ["mailbox_id", "field", "term", "uid"]


def _header_tokens(headers: Column, text_of) -> Column:
    return F.flatten(F.transform(headers, lambda h: tokenize(text_of(h))))


def _name_is(name: str):
    # a one-argument lambda: F.filter passes (element, index) to two-argument ones
    return lambda h: F.upper(h["name"]) == name


def field_terms(msg_headers: Column, body: Column) -> Column:
    """ARRAY<STRUCT<field, terms>>: every indexed field of one message with its terms.

    BODY          tokens of the body text
    HEADERS       tokens of each whole header line (name included)
    PREFIX_HEADER tokens of every header value (unknown names are routed here too)
    TO/CC/FROM/BCC tokens of the header value + each group member as one untokenized term
    BASE_SUBJECT  tokens of the Subject value
    Address tokens of the re-encoded ``display <address>`` form are a subset of the value's
    tokens, so the value's tokens cover them.
    """
    hs = F.coalesce(msg_headers, F.array().cast("array<struct<name:string,value:string>>"))
    items = [
        F.struct(F.lit("BODY").alias("field"), tokenize(F.coalesce(body, F.lit(""))).alias("terms")),
        F.struct(F.lit("HEADERS").alias("field"),
                 _header_tokens(hs, lambda h: F.concat(h["name"], F.lit(": "), h["value"])).alias("terms")),
        F.struct(F.lit("PREFIX_HEADER").alias("field"), _header_tokens(hs, lambda h: h["value"]).alias("terms")),
    ]
    for field in ADDRESS_FIELDS:
        named = F.filter(hs, _name_is(field))
        terms = F.concat(_header_tokens(named, lambda h: h["value"]),
                         F.flatten(F.transform(named, lambda h: H.group_members(h["value"]))))
        items.append(F.struct(F.lit(field).alias("field"), terms.alias("terms")))
    subj = F.filter(hs, lambda h: F.upper(h["name"]) == "SUBJECT")
    items.append(F.struct(F.lit("BASE_SUBJECT").alias("field"),
                          _header_tokens(subj, lambda h: h["value"]).alias("terms")))
    return F.array(*items)


def build_postings(messages: DataFrame, dedup: str = "message", keep: tuple = ()) -> DataFrame:
    """P2 + P3: one row per distinct (mailbox_id, field, term, uid), and the columns to ``keep``.

    One task per input split: `spark.sql.files.maxPartitionBytes` sets the parallelism.
    """
    per_field = messages.select(
        "mailbox_id", "uid", *keep, F.explode(field_terms(F.col("headers"), F.col("body"))).alias("ft"))
    exploded = per_field.select(
        "mailbox_id", F.col("ft.field").alias("field"),
        F.explode(F.array_distinct(F.col("ft.terms"))).alias("term"), "uid", *keep)
    postings = exploded
    if dedup == "global":
        postings = postings.dropDuplicates(POSTING_KEY)
    elif dedup != "message":
        raise ValueError("dedup must be 'message' or 'global'")
    return postings


def explode_postings(messages: DataFrame) -> DataFrame:
    """P2 alone: every (field, term) occurrence, repeats kept (input of B4)."""
    per_field = messages.select(
        "mailbox_id", "uid", F.explode(field_terms(F.col("headers"), F.col("body"))).alias("ft"))
    return per_field.select("mailbox_id", F.col("ft.field").alias("field"),
                            F.explode("ft.terms").alias("term"), "uid")


def term_frequency(messages: DataFrame) -> DataFrame:
    """Occurrences per (mailbox_id, field, term, uid).

    The shuffle key holds uid and term, so neither a hot mailbox nor a hot term lands in one
    task; repeats of a term inside one message are merged map-side before the shuffle.
    """
    return explode_postings(messages).groupBy("mailbox_id", "field", "term", "uid") \
        .agg(F.count(F.lit(1)).alias("tf"))


def build_state(messages: DataFrame, keep: tuple = ()) -> DataFrame:
    """message_state: typed per-message columns (flags, dates, size, sort keys), and ``keep``.

    Each address header is parsed once into a column; the first-address and display keys
    are read from it (Catalyst keeps a non-cheap expression used twice in its own projection).
    """
    hs = F.coalesce(F.col("headers"), F.array().cast("array<struct<name:string,value:string>>"))
    parsed = messages.select(
        "mailbox_id", "uid", *keep,
        F.col("internal_date").cast("timestamp_ntz").alias("internal_date"),
        H.header_date(hs).alias("header_date"),
        F.col("size").cast("bigint").alias("size"),
        normalize_flags("flags").alias("flags"),
        H.first_entry(hs, "From").alias("a_from"),
        H.first_entry(hs, "To").alias("a_to"),
        H.first_entry(hs, "Cc").alias("a_cc"),
        H.base_subject(H.first_header_value(hs, "Subject")).alias("base_subject"),
    )
    return parsed.select(
        "mailbox_id", "uid", "internal_date", "header_date", "size", "flags",
        H.local_part(F.col("a_from")).alias("first_from"),
        H.local_part(F.col("a_to")).alias("first_to"),
        H.local_part(F.col("a_cc")).alias("first_cc"),
        H.display_or_local(F.col("a_from")).alias("display_from"),
        H.display_or_local(F.col("a_to")).alias("display_to"),
        "base_subject", *keep,
    )


def blooms(*columns: str) -> dict[str, str]:
    """Write options for Parquet Bloom filters on ``columns``, each as large as its row group's
    distinct values ask for. An equality on one of them then skips row groups whose min and max
    enclose the value (a term in files sorted by mailbox, a uid in files sorted by term)."""
    return {**{f"parquet.bloom.filter.enabled#{c}": "true" for c in columns}, "parquet.bloom.filter.adaptive.enabled": "true"}


def write_postings(postings: DataFrame, path: str, cluster_partitions: int | None = None) -> str:
    """Write postings partitioned by field, sorted by (mailbox_id, term) inside files.

    Sorting gives Parquet row groups tight min/max on mailbox_id and term, and Bloom filters on
    term and uid skip the row groups that hold neither, so one message's or one term's postings
    are read from the files that have them. ``cluster_partitions`` range-partitions by
    (mailbox_id, uid) first, so one mailbox lands in few files; uid in the key splits a hot
    mailbox over several tasks. Writes a new folder; never overwrites what it reads.
    """
    df = postings
    if cluster_partitions:
        df = df.repartitionByRange(cluster_partitions, "mailbox_id", "uid")
    (df.sortWithinPartitions("field", "mailbox_id", "term")
       .write.mode("errorifexists").options(**blooms("term", "uid")).partitionBy("field").parquet(path))
    return path


def write_state(state: DataFrame, path: str, cluster_partitions: int | None = None) -> str:
    """message_state sorted by key inside files (optionally range-clustered by key first)."""
    df = state.repartitionByRange(cluster_partitions, "mailbox_id", "uid") if cluster_partitions else state
    df.sortWithinPartitions("mailbox_id", "uid").write.mode("errorifexists").parquet(path)
    return path


@dataclass
class Index:
    """The tables of one index. Dictionary and gram tables are optional accelerators."""
    postings: DataFrame
    state: DataFrame
    dictionary: DataFrame | None = None
    grams: DataFrame | None = None
    gram_stats: DataFrame | None = None

    def search(self, mailbox, criteria, match: str = "any", use_dictionary: bool = False) -> DataFrame:
        """`operators.search.search` over this index; ``use_dictionary`` takes the B2 path."""
        from mailsift.operators.search import search
        extra = dict(dictionary=self.dictionary, grams=self.grams, gram_stats=self.gram_stats) \
            if use_dictionary else {}
        return search(self.postings, self.state, mailbox, criteria, match, **extra)


def rebuild_index(messages: DataFrame, path: str, dedup: str = "message",
                  cluster_partitions: int | None = None) -> str:
    """Full index from a messages table, one write job per table.

    postings/   P2 + P3, partitioned by field (W1)
    state/      message_state
    dictionary/ distinct (field, term, df) from the written postings (B2)
    grams/      (field, term, gram, df) trigram index of the dictionary (substring search)
    gram_stats/ (field, gram, n, docs) gram frequencies (terms, summed document frequency)
    Later tables read the earlier written ones, so no step re-tokenizes and lineage is cut.
    ``cluster_partitions`` range-partitions postings and state by (mailbox_id, uid) before
    writing, so a mailbox search opens few files (worth it when one index is searched often).
    """
    from mailsift.operators.batch import gram_index, gram_statistics
    spark = messages.sparkSession
    write_postings(build_postings(messages, dedup), f"{path}/postings", cluster_partitions)
    write_state(build_state(messages), f"{path}/state", cluster_partitions)
    term_dictionary(spark.read.parquet(f"{path}/postings")).write.mode("errorifexists") \
        .options(**blooms("term")).parquet(f"{path}/dictionary")
    gram_index(spark.read.parquet(f"{path}/dictionary")).sortWithinPartitions("field", "gram") \
        .write.mode("errorifexists").options(**blooms("gram")).partitionBy("field").parquet(f"{path}/grams")
    gram_statistics(spark.read.parquet(f"{path}/grams")).write.mode("errorifexists") \
        .parquet(f"{path}/gram_stats")
    return path


def load_index(spark, path: str) -> Index:
    r = spark.read
    return Index(r.parquet(f"{path}/postings"), r.parquet(f"{path}/state"), r.parquet(f"{path}/dictionary"),
                 r.parquet(f"{path}/grams"), r.parquet(f"{path}/gram_stats"))


def term_dictionary(postings: DataFrame) -> DataFrame:
    """B2: distinct terms per field with their document frequency.

    The aggregation is partial per task before the shuffle on (field, term), so a very common
    term is pre-counted map-side and a hot term cannot pile all its postings into one task.
    """
    return postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
