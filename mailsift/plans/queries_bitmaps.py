"""Registered queries: posting lists as bitmaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift.operators import bitmaps as M
from mailsift.operators import criteria as C
from mailsift.plans import oracle as O
from mailsift.plans.registry import conv_index, docs_index, register
from mailsift.session import new_scratch_path


def _blocks(spark, postings):
    return spark.read.parquet(M.write_blocks(postings, new_scratch_path(spark, "blocks")))


@register("W1b_bitmap_blocks", O.with_(O.DOC_POSTINGS) + """
SELECT mailbox_id, field, term, uid >> 15 AS bucket, count(DISTINCT uid >> 6) AS n_words, count(*) AS n_uids, min(uid) AS first_uid
FROM doc_postings GROUP BY mailbox_id, field, term, uid >> 15""")
def w1b(spark, sf):
    """W1 as bitmaps: words, uids and first uid of every block written."""
    p, _ = docs_index(spark, sf)
    blocks = _blocks(spark, p)
    n_uids = F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w["bits"]))
    # the bits below the lowest one set: ~x & (x - 1), which is the long's largest value where x is its least
    low = F.expr("bit_count(~words[0].bits & coalesce(try_subtract(words[0].bits, 1L), 9223372036854775807L))")
    return blocks.select("mailbox_id", "field", "term", "bucket", F.size("words").cast("long").alias("n_words"), n_uids.alias("n_uids"),
                         (F.shiftleft("bucket", M.BUCKET) + F.expr("words[0].word") * 64 + low).alias("first_uid"))


@register("P4b_union_bitmaps", O.with_(O.CONV_POSTINGS) + """
SELECT mailbox_id, uid FROM conv_postings WHERE field = 'CC'
UNION
SELECT mailbox_id, uid FROM conv_postings WHERE field = 'FROM' AND contains(term, 'SYSTEM')""")
def p4b(spark, sf):
    """P4 as bitmaps: union of two uid sets in words."""
    p, _ = conv_index(spark, sf)
    return M.union_words(p.where(F.col("field") == "CC"), p.where((F.col("field") == "FROM") & F.col("term").contains("SYSTEM")))


@register("C16b_any_bitmaps", O.with_(O.DOC_POSTINGS, O.DOC_STATE) + r"""
SELECT mailbox_id, count(*) AS n FROM (
  SELECT mailbox_id, uid FROM doc_postings WHERE field = 'BODY' AND contains(term, 'MAISON')
  UNION
  SELECT mailbox_id, uid FROM doc_state WHERE list_contains(string_split(flags, ' '), '\DELETED')) GROUP BY mailbox_id""")
def c16b(spark, sf):
    """C16 as bitmaps: messages of each mailbox with body 'maison' or DELETED, counted in words."""
    p, s = docs_index(spark, sf)
    return M.count_matches(_blocks(spark, p), s, None, [C.body_contains("maison"), C.flag_set("DELETED")])


@register("T5b_tree_bitmaps", O.with_(O.DOC_POSTINGS, O.DOC_STATE) + r"""
SELECT mailbox_id, uid FROM doc_state WHERE size > 300 AND (mailbox_id, uid) IN (
  SELECT (mailbox_id, uid) FROM doc_postings WHERE field = 'BODY' AND contains(term, 'QUE'))
AND NOT ((mailbox_id, uid) IN (SELECT (mailbox_id, uid) FROM doc_postings WHERE field = 'BODY' AND contains(term, 'DER'))
         OR list_contains(string_split(flags, ' '), '\DELETED'))""")
def t5b(spark, sf):
    """T4-T6 as bitmaps: body 'que', size > 300, and neither body 'der' nor DELETED: bit arithmetic on words."""
    p, s = docs_index(spark, sf)
    return M.search_blocks(_blocks(spark, p), s, None, [
        C.body_contains("que"), C.size_gt(300), C.not_(C.or_(C.body_contains("der"), C.flag_set("DELETED")))], "all")
