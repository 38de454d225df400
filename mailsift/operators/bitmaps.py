"""Posting lists as bitmaps (W1, P4, C16, T4-T6): one row for each term and bucket of uids.

A block is (mailbox_id, field, term, bucket, words): the uids of ``2 ** BUCKET`` neighbours that
hold the term, as those 64-bit words (word number in the bucket, bits) that aren't zero. A block
has at most 512 words, so neither a hot term nor a hot mailbox makes a long row, and a
term is tested once a block instead of once a posting.

A search keeps to words until the end: every leaf of the tree becomes a column of bits, summed by
``bit_or`` over (mailbox_id, bucket, word) with map-side combine, and the tree is bit arithmetic on
these columns. State criteria and the set of all messages (for NOT) are words of
``message_state`` in the same aggregate, so a tree of any depth costs one shuffle and no
join. Only the words of the result are turned into uids; ``count_matches`` doesn't even do that.

Uids are any 64-bit integers, negative ones too; rows with a null uid are in no block. Repeated
postings are one bit. Empty tables give no blocks and no matches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.operators import criteria as C
from mailsift.operators.search import _FALSE, _TRUE, KEYS, _mailbox_filter, _where, build_tree, scan_mailbox

BUCKET = 15
_WORD = ["mailbox_id", "bucket", "word"]


def _place(df: DataFrame, *columns) -> DataFrame:
    """``columns`` with the bucket and word of each uid and its bit."""
    return df.where("uid is not null").select(
        "mailbox_id", *columns, F.shiftright("uid", BUCKET).alias("bucket"),
        F.expr(f"cast(shiftright(uid, 6) & {(1 << BUCKET - 6) - 1} as int)").alias("word"), F.expr("shiftleft(1L, cast(uid & 63 as int))").alias("bits"))


def build_blocks(postings: DataFrame) -> DataFrame:
    """W1 in bitmap form. One exchange on (mailbox, field, term, bucket): a key has 32,768
    different postings at most, and both aggregates run behind it. The term leads the key: the lists
    are collected in sorted order, and Spark compares rows by the first eight bytes of the first
    column, which few terms but most mailboxes and all fields share."""
    key = ["term", "mailbox_id", "field", "bucket"]
    words = _place(postings, "field", "term").repartition(*key).groupBy(*key, "word").agg(F.bit_or("bits").alias("bits"))
    blocks = words.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))
    return blocks.select("mailbox_id", "field", "term", "bucket", "words")


def write_blocks(postings: DataFrame, path: str) -> str:
    """Blocks by field, sorted by (mailbox_id, term, bucket) inside files. Writes a new folder."""
    build_blocks(postings).sortWithinPartitions("field", "mailbox_id", "term", "bucket") \
        .write.mode("errorifexists").partitionBy("field").parquet(path)
    return path


def block_postings(blocks: DataFrame) -> DataFrame:
    """The postings of the blocks, one row each."""
    words = blocks.select("mailbox_id", "field", "term", "bucket", F.explode("words").alias("w"))
    return _uids(words.select("mailbox_id", "field", "term", "bucket", "w.word", "w.bits"), "field", "term")


def _uids(words: DataFrame, *columns) -> DataFrame:
    """A row for each bit of the words."""
    set_ = words.where("bits <> 0").select("mailbox_id", *columns, "bucket", "word", F.explode(
        F.expr("filter(sequence(0, 63), i -> (shiftright(bits, i) & 1L) = 1L)")).alias("i"))
    return set_.select("mailbox_id", *columns, (F.shiftleft("bucket", BUCKET) + F.col("word") * 64 + F.col("i")).alias("uid"))


def _leaves(node: C.Criterion) -> list[C.Criterion]:
    if isinstance(node, (C.And, C.Or)):
        return [leaf for k in node.children for leaf in _leaves(k)]
    return _leaves(node.child) if isinstance(node, C.Not) else [node]


def _has_not(node: C.Criterion) -> bool:
    return isinstance(node, C.Not) or isinstance(node, (C.And, C.Or)) and any(map(_has_not, node.children))


def _bits(node: C.Criterion, of_leaf: dict[int, Column]) -> Column:
    """The tree as bit arithmetic; a message is a bit of ``of_leaf[0]``."""
    if isinstance(node, C.And):
        return reduce(Column.bitwiseAND, [_bits(k, of_leaf) for k in node.children])
    if isinstance(node, C.Or):
        return reduce(Column.bitwiseOR, [_bits(k, of_leaf) for k in node.children])
    if isinstance(node, C.Not):
        return F.bitwise_not(_bits(node.child, of_leaf)).bitwiseAND(of_leaf[0])
    return of_leaf[id(node)]


def match_words(blocks: DataFrame, state: DataFrame, mailbox, tree: C.Criterion) -> DataFrame:
    """(mailbox_id, bucket, word, bits) of the messages that ``tree`` (of ``build_tree``) selects."""
    leaves = _leaves(tree)
    terms = [x for x in leaves if isinstance(x, C.PostingCriterion)]
    tests = [x for x in leaves if isinstance(x, C.StateCriterion)]
    if len(terms) + len(tests) < len(leaves):
        raise ValueError(f"unsupported search criterion in {tree!r}")
    names = {id(x): f"m{i}" for i, x in enumerate(terms + tests)}
    mb, parts = _mailbox_filter(mailbox), []

    def columns(mine: list[C.Criterion], every: Column) -> list[Column]:
        """The bits of this side's leaves; those of the other side are null."""
        own = {id(x) for x in mine}
        return [every.alias("every"), *[(F.when(F.col(n), F.col("bits")) if k in own else F.lit(None).cast("long")).alias(n) for k, n in names.items()]]

    if terms:
        hit = reduce(lambda a, b: a | b, [x.predicate() for x in terms])
        rows = _where(blocks, mb, hit).select("mailbox_id", "bucket", *[x.predicate().alias(names[id(x)]) for x in terms], F.explode("words").alias("w"))
        rows = rows.select("mailbox_id", "bucket", "w.word", "w.bits", *[names[id(x)] for x in terms])
        parts.append(rows.select(*_WORD, *columns(terms, F.lit(None).cast("long"))))
    whole = bool(tests) or _has_not(tree)
    if whole:
        rows = _place(_where(state, mb).select("mailbox_id", "uid", *[x.predicate().alias(names[id(x)]) for x in tests]), *[names[id(x)] for x in tests])
        parts.append(rows.select(*_WORD, *columns(tests, F.col("bits"))))
    words = reduce(DataFrame.unionByName, parts).groupBy(*_WORD).agg(*[F.bit_or(c).alias(c) for c in ["every", *names.values()]])
    none = F.lit(0).cast("long")
    of_leaf = {k: F.coalesce(F.col(n), none) for k, n in names.items()} | {0: F.coalesce("every", none)}
    return words.select(*_WORD, _bits(tree, of_leaf).alias("bits")).where("bits <> 0")


def search_blocks(blocks: DataFrame, state: DataFrame, mailbox, criteria, match: str = "any") -> DataFrame:
    """``search.search`` on blocks: the same (mailbox_id, uid)."""
    tree = build_tree(criteria, match)
    if tree is _TRUE or tree is _FALSE:
        found = scan_mailbox(state, mailbox)
        return found if tree is _TRUE else found.limit(0)
    return _uids(match_words(blocks, state, mailbox, tree)).select(*KEYS)


def count_matches(blocks: DataFrame, state: DataFrame, mailbox, criteria, match: str = "any") -> DataFrame:
    """(mailbox_id, n): messages that ``search_blocks`` would find, counted in words."""
    tree = build_tree(criteria, match)
    if tree is _TRUE or tree is _FALSE:
        return search_blocks(blocks, state, mailbox, criteria, match).groupBy("mailbox_id").agg(F.count("*").alias("n"))
    return match_words(blocks, state, mailbox, tree).groupBy("mailbox_id").agg(F.sum(F.bit_count("bits")).alias("n"))


def union_words(*parts: DataFrame) -> DataFrame:
    """P4 on bitmaps: union of (mailbox_id, uid) sets. What is shuffled is words."""
    words = reduce(DataFrame.unionByName, [_place(p.select(*KEYS)) for p in parts])
    return _uids(words.groupBy(*_WORD).agg(F.bit_or("bits").alias("bits"))).select(*KEYS)
