"""Registered queries: scans, projections, maintenance, sorts and batch operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift.functions.headers import header_lines, render_raw, split_raw
from mailsift.functions.text import tokenize
from mailsift.operators import batch as B
from mailsift.operators import maintain as M
from mailsift.operators import search as S
from mailsift.operators import trees as T
from mailsift.operators.delta import LogIndex, as_adds
from mailsift.operators.ingest import (explode_postings, load_index, rebuild_index, term_dictionary,
                                       term_frequency, write_postings)
from mailsift.operators.intervals import range_hits
from mailsift.operators.sort import sort_results
from mailsift.plans import oracle as O
from mailsift.plans.registry import conv_index, conv_to_index, docs_index, flags_str, orders_index, register
from mailsift.session import materialize, new_scratch_path
from mailsift.sources.adapters import mail_changes, mail_conv, mail_docs, read_table

P_COLS = ["mailbox_id", "field", "term", "uid"]


def _postings_sql(ctes, table, where="true"):
    return O.with_(*ctes) + f"SELECT mailbox_id, field, term, uid FROM {table} WHERE {where}"


# ------------------------------------------------------------------ S: scans

@register("S1_scan_messages", O.with_(O.CONV_H) + """
SELECT mailbox_id, uid, CAST(CASE WHEN h_cc IS NULL THEN 2 ELSE 3 END AS BIGINT) AS n_headers,
       'From=' || h_from || '|Subject=' || h_subject || coalesce('|Cc=' || h_cc, '') AS headers,
       CAST(length(coalesce(text, '')) AS BIGINT) AS body_chars
FROM conv_h""")
def s1(spark, sf):
    """Messages rendered as raw mail, read back as header block + body."""
    msgs = mail_conv(spark, sf)
    raw = msgs.select("mailbox_id", "uid", render_raw("headers", "body").alias("raw"))
    head, body = split_raw("raw")
    parsed = raw.select("mailbox_id", "uid", header_lines(head).alias("h"), body.alias("body"))
    return parsed.select(
        "mailbox_id", "uid", F.size("h").cast("bigint").alias("n_headers"),
        F.array_join(F.transform("h", lambda x: F.concat(x["name"], F.lit("="), x["value"])), "|").alias("headers"),
        F.length("body").cast("bigint").alias("body_chars"))


@register("S2_scan_mailbox", O.with_(O.DOC_STATE) + "SELECT mailbox_id, uid FROM doc_state WHERE mailbox_id = 'src1'")
def s2(spark, sf):
    """Every uid of mailbox src1."""
    _, s = docs_index(spark, sf)
    return S.scan_mailbox(s, "src1")


@register("S3_scan_message_postings", _postings_sql([O.CONV_POSTINGS], "conv_postings",
                                                    "mailbox_id = '3' AND uid = 1"))
def s3(spark, sf):
    """S3: every posting of message uid 1 in mailbox 3."""
    p, _ = conv_index(spark, sf)
    return S.scan_message_postings(p, "3", 1).select(*P_COLS)


@register("S4_lookup_flags", O.with_(O.DOC_STATE) + """
SELECT mailbox_id, uid, flags FROM doc_state WHERE uid IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def s4(spark, sf):
    """Flags of a batch of keys (documents labelled toxic), by mailbox and uid."""
    _, s = docs_index(spark, sf)
    toxic = read_table(spark, sf, "labels").where(F.col("toxic") == 1).select(F.col("doc_id").alias("uid"))
    keys = mail_docs(spark, sf, with_flags=False).select("mailbox_id", "uid").join(toxic, "uid", "left_semi")
    return S.lookup_flags(s, keys=keys).select("mailbox_id", "uid", flags_str())


@register("S5_scan_index_family", _postings_sql([O.CONV_POSTINGS], "conv_postings",
                                                "contains(term, 'EXAMPLE')"))
def s5(spark, sf):
    """Scan of a written postings table with a row filter (pushed to Parquet)."""
    p, _ = conv_index(spark, sf)
    path = write_postings(p, new_scratch_path(spark, "postings"))
    return spark.read.parquet(path).where(F.col("term").contains("EXAMPLE")).select(*P_COLS)


# ------------------------------------------------------------------ P: projections

@register("P1_project_uids", O.with_(O.CONV_POSTINGS) + "SELECT DISTINCT mailbox_id, uid FROM conv_postings WHERE field = 'CC'")
def p1(spark, sf):
    """(mailbox_id, uid) set of the CC postings."""
    p, _ = conv_index(spark, sf)
    return S.project_uids(p.where(F.col("field") == "CC"))


@register("P2_explode_postings", O.with_(O.CONV_H, O.CONV_TEXTS) + f"""
SELECT mailbox_id, field, term, uid FROM (
  SELECT mailbox_id, uid, field, unnest({O.tok('t')}) AS term FROM conv_texts)""")
def p2(spark, sf):
    """One row per (field, term) occurrence, repeats kept."""
    return explode_postings(mail_conv(spark, sf)).select(*P_COLS)


@register("P3_dedup_postings", _postings_sql([O.CONV_POSTINGS], "conv_postings"))
def p3(spark, sf):
    """Distinct postings (de-duplicated inside each message, no shuffle)."""
    p, _ = conv_index(spark, sf)
    return p.select(*P_COLS)


@register("P4_union_uids", O.with_(O.CONV_POSTINGS) + """
SELECT mailbox_id, uid FROM conv_postings WHERE field = 'CC'
UNION
SELECT mailbox_id, uid FROM conv_postings WHERE field = 'FROM' AND contains(term, 'SYSTEM')""")
def p4(spark, sf):
    """Union of two uid sets (Cc holders, From system), duplicates removed."""
    p, _ = conv_index(spark, sf)
    return S.union_uids(p.where(F.col("field") == "CC"),
                        p.where((F.col("field") == "FROM") & F.col("term").contains("SYSTEM")))


# ------------------------------------------------------------------ W: maintenance

@register("W1_write_postings", _postings_sql([O.DOC_POSTINGS], "doc_postings"))
def w1(spark, sf):
    """Postings written partitioned by field, sorted inside files, read back."""
    p, _ = docs_index(spark, sf)
    path = write_postings(p, new_scratch_path(spark, "postings"))
    return spark.read.parquet(path).select(*P_COLS)


@register("W2_add_message", _postings_sql([O.DOC_POSTINGS], "doc_postings"))
def w2(spark, sf):
    """Index the labelled documents, then add the others as a second batch: = full index."""
    docs = mail_docs(spark, sf, with_flags=False)
    labelled = read_table(spark, sf, "labels").select(F.col("doc_id").alias("uid"))
    first = docs.join(labelled, "uid", "left_semi")
    later = docs.join(labelled, "uid", "left_anti")
    ix = LogIndex(spark, new_scratch_path(spark, "log-index"))
    for part in (first, later):
        ix.append(as_adds(part, F.col("uid")))
    return ix.index().postings.select(*P_COLS)


@register("W3_update_flags", O.with_(O.CHANGES) + f"SELECT mailbox_id, uid, flags FROM fold WHERE {O.LIVE}")
def w3(spark, sf):
    """Replay the change log; latest flags of each live message."""
    fold = M.fold_changes(mail_changes(spark, sf))
    return M.live_flags(fold).select("mailbox_id", "uid", flags_str())


@register("W3b_rejected_updates", O.with_(O.CHANGES) + """
SELECT mailbox_id, uid, seq FROM (
  SELECT mailbox_id, uid, seq, op,
         max(CASE WHEN op = 'add' THEN seq END) OVER w AS prev_add,
         max(CASE WHEN op = 'delete' THEN seq END) OVER w AS prev_delete
  FROM chg
  WINDOW w AS (PARTITION BY mailbox_id, uid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
WHERE op = 'flags' AND NOT coalesce(prev_add > coalesce(prev_delete, -1), false)""")
def w3b(spark, sf):
    """Q17: flag updates of messages that were not live at that moment."""
    return M.rejected_updates(mail_changes(spark, sf))


@register("W4_delete_messages", _postings_sql(
    [O.DOC_POSTINGS], "doc_postings", "uid NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"))
def w4(spark, sf):
    """Delete the documents labelled toxic: a batch of tombstones over the indexed adds."""
    ix = LogIndex(spark, new_scratch_path(spark, "log-index"))
    docs = mail_docs(spark, sf, with_flags=False)
    ix.append(as_adds(docs, 0))
    gone = read_table(spark, sf, "labels").where(F.col("toxic") == 1).select(F.col("doc_id").alias("uid"))
    ix.append(as_adds(docs, 1).withColumn("op", F.lit("delete")).join(gone, "uid", "left_semi"))
    return ix.index().postings.select(*P_COLS)


@register("W4c_delete_uid_range", _postings_sql(
    [O.DOC_POSTINGS], "doc_postings", "NOT (uid BETWEEN 10 AND 40 OR uid BETWEEN 30 AND 55 OR uid >= 1000)"))
def w4c(spark, sf):
    """W4 by uid range: overlapping ranges and an open one, in every mailbox."""
    ix = LogIndex(spark, new_scratch_path(spark, "log-index"))
    docs = mail_docs(spark, sf, with_flags=False)
    ix.append(as_adds(docs, 0))
    spans = spark.createDataFrame([(10, 40), (30, 55), (1000, None)], "lo long, hi long")
    ix.delete(docs.select("mailbox_id").distinct().join(F.broadcast(spans)).withColumn("seq", F.lit(1).cast("bigint")))
    return ix.index().postings.select(*P_COLS)


@register("W3c_update_uid_range", O.with_(O.DOC_STATE) + r"""
SELECT mailbox_id, uid, CASE WHEN uid BETWEEN 20 AND 400 THEN '\DRAFT' WHEN uid <= 30 THEN '\SEEN' ELSE flags END AS flags
FROM doc_state""")
def w3c(spark, sf):
    """W3 by uid range: the later of two overlapping ranges sets the flags."""
    ix = LogIndex(spark, new_scratch_path(spark, "log-index"))
    docs = mail_docs(spark, sf)
    ix.append(as_adds(docs, 0))
    spans = spark.createDataFrame([(None, 30, 1, ["seen"]), (20, 400, 2, ["draft"])],
                                  "lo long, hi long, seq long, flags array<string>")
    ix.update_flags(docs.select("mailbox_id").distinct().join(F.broadcast(spans)))
    return ix.index().state.select("mailbox_id", "uid", flags_str())


@register("W4b_deleted_keys", O.with_(O.CHANGES) + f"""
SELECT mailbox_id, uid FROM fold WHERE last_delete IS NOT NULL AND NOT coalesce({O.LIVE}, false)""")
def w4b(spark, sf):
    """Keys whose latest add is followed by a delete (tombstones of the replay)."""
    return M.deleted_keys(M.fold_changes(mail_changes(spark, sf)))


@register("W5_expand_uid_range", O.with_(O.CHANGES) + f"""
, live AS (SELECT mailbox_id, uid FROM fold WHERE {O.LIVE}),
ranges AS (SELECT mailbox_id, uid AS lo, uid + 2 AS hi FROM chg WHERE op = 'delete')
SELECT DISTINCT l.mailbox_id, l.uid FROM live l JOIN ranges r
  ON l.mailbox_id = r.mailbox_id AND l.uid BETWEEN r.lo AND r.hi""")
def w5(spark, sf):
    """Live messages inside any range [k, k+2] of a delete event (bucketed range join)."""
    ch = mail_changes(spark, sf)
    live = M.fold_changes(ch).where(M.is_live()).select("mailbox_id", "uid")
    ranges = ch.where(F.col("op") == "delete").select("mailbox_id", F.col("uid").alias("lo"),
                                                     (F.col("uid") + 2).alias("hi"))
    return M.expand_uid_ranges(live, ranges)


# ------------------------------------------------------------------ T7-T16: sorts (all messages)

def _top(table_sql, key_sql, desc):
    order = "DESC NULLS LAST" if desc else "ASC NULLS FIRST"
    return f"SELECT mailbox_id, uid, {key_sql} AS sort_key FROM {table_sql} ORDER BY sort_key {order}, uid, mailbox_id"


def _sorted(index_fn, key, desc):
    def q(spark, sf):
        _, s = index_fn(spark, sf)
        return sort_results(s.select("mailbox_id", "uid"), s, key, reverse=desc)
    q.__doc__ = f"All messages by {key} {'descending' if desc else 'ascending'}, then uid, mailbox_id."
    return q


SORTS = [
    ("T7_sort_uid", orders_index, "uid", True, [O.ORD_STATE], "ord_state", "uid"),
    ("T8_sort_sent_date", orders_index, "sent_date", False, [O.ORD_STATE], "ord_state", "internal_date"),
    ("T9_sort_base_subject", conv_index, "base_subject", True, [O.CONV_H], "conv_h",
     "'CONVERSATION ' || CAST(conv_id AS VARCHAR)"),
    ("T10_sort_mailbox_from", conv_index, "mailbox_from", False, [O.CONV_H], "conv_h", "role"),
    ("T11_sort_mailbox_cc", conv_index, "mailbox_cc", True, [O.CONV_H], "conv_h",
     "CASE WHEN h_cc IS NOT NULL THEN 'desk' END"),
    ("T12_sort_mailbox_to", conv_to_index, "mailbox_to", False, [O.CONV_H], "conv_h", "CASE WHEN uid % 3 <> 2 THEN 'team' || CAST(conv_id % 7 AS VARCHAR) END"),
    ("T13_sort_display_to", conv_to_index, "display_to", True, [O.CONV_H], "conv_h", "CASE WHEN uid % 3 <> 2 THEN 'Team ' || CAST(conv_id % 7 AS VARCHAR) END"),
    ("T14_sort_display_from", conv_index, "display_from", True, [O.CONV_H], "conv_h", "role"),
    ("T15_sort_arrival", orders_index, "arrival", True, [O.ORD_STATE], "ord_state", "internal_date"),
    ("T16_sort_size", docs_index, "size", True, [O.DOC_STATE], "doc_state", "size"),
]
for _name, _idx, _key, _desc, _ctes, _table, _key_sql in SORTS:
    register(_name, O.with_(*_ctes) + _top(_table, _key_sql, _desc))(_sorted(_idx, _key, _desc))


# ------------------------------------------------------------------ B: batch and index build

def benchmark_criteria(spark, sf, per_token: bool):
    """Criteria derived from `benchmark`: query = item. ``per_token``: one body clause per
    distinct token (contamination check with match='all'); else the whole text as one clause."""
    bench = read_table(spark, sf, "benchmark")
    base = [F.col("item_id").alias("query_id"), F.lit(None).cast("string").alias("mailbox_id")]
    if per_token:
        crit = bench.select(*base, F.posexplode(F.array_distinct(tokenize("text"))).alias("clause_id", "value"))
        crit = crit.withColumn("clause_id", F.col("clause_id").cast("bigint"))
    else:
        crit = bench.select(*base, F.lit(0).cast("bigint").alias("clause_id"), F.col("text").alias("value"))
    return crit.select("query_id", "mailbox_id", "clause_id", F.lit("body").alias("kind"),
                       F.lit(None).cast("string").alias("name"), "value",
                       F.lit(None).cast("bigint").alias("lo"), F.lit(None).cast("bigint").alias("hi"))


BENCH_TERMS = f"""bt AS (
  SELECT DISTINCT item_id AS query_id, t AS qterm FROM (
    SELECT item_id, unnest({O.tok('text')}) AS t FROM benchmark)),
dict AS (SELECT DISTINCT term FROM doc_postings),
tm AS (SELECT b.query_id, b.qterm, d.term FROM dict d JOIN bt b ON contains(d.term, b.qterm))"""


@register("B1_search_batch", O.with_(O.DOC_POSTINGS, BENCH_TERMS) + """
, need AS (SELECT query_id, count(*) AS need FROM bt GROUP BY query_id),
got AS (SELECT tm.query_id, p.mailbox_id, p.uid, count(DISTINCT tm.qterm) AS got
        FROM doc_postings p JOIN tm ON p.term = tm.term GROUP BY tm.query_id, p.mailbox_id, p.uid)
SELECT g.query_id, g.mailbox_id, g.uid FROM got g JOIN need n ON g.query_id = n.query_id WHERE g.got = n.need""")
def b1(spark, sf):
    """B1: one query per benchmark item, every distinct token a clause, match='all':
    documents that contain all words of a benchmark passage (as substrings of terms)."""
    ix = load_index(spark, rebuild_index(mail_docs(spark, sf), new_scratch_path(spark, "index")))
    return B.search_batch(ix.postings, ix.state, benchmark_criteria(spark, sf, per_token=True), match="all",
                          dictionary=ix.dictionary, grams=ix.grams, gram_stats=ix.gram_stats)


@register("B1b_search_batch_any", O.with_(O.DOC_POSTINGS, BENCH_TERMS) + """
SELECT DISTINCT tm.query_id, p.mailbox_id, p.uid FROM doc_postings p JOIN tm ON p.term = tm.term""")
def b1b(spark, sf):
    """B1 with the reference's default: the item text is one body clause, any token matches."""
    ix = load_index(spark, rebuild_index(mail_docs(spark, sf), new_scratch_path(spark, "index")))
    return B.search_batch(ix.postings, ix.state, benchmark_criteria(spark, sf, per_token=False), match="any",
                          dictionary=ix.dictionary, grams=ix.grams, gram_stats=ix.gram_stats)


TREE = [0, 1, T.AND, 4, 3, T.AND, T.OR, 2, T.NOT, T.AND]


@register("B1c_search_trees", O.with_(O.DOC_POSTINGS, O.DOC_STATE, f"""bt AS (
  SELECT item_id AS query_id, tk[1] AS t0, tk[-1] AS t1
  FROM (SELECT item_id, {O.tok('text')} AS tk FROM benchmark) WHERE len(tk) > 0),
dict AS (SELECT DISTINCT term FROM doc_postings),
tm AS (SELECT query_id, term, contains(term, t0) AS c0, contains(term, t1) AS c1
       FROM dict JOIN bt ON contains(term, t0) OR contains(term, t1)),
hit AS (SELECT query_id, mailbox_id, uid, bool_or(c0) AS c0, bool_or(c1) AS c1
        FROM doc_postings JOIN tm USING (term) GROUP BY query_id, mailbox_id, uid)""") + r"""
SELECT b.query_id, s.mailbox_id, s.uid
FROM doc_state s CROSS JOIN bt b LEFT JOIN hit h ON h.query_id = b.query_id AND h.mailbox_id = s.mailbox_id AND h.uid = s.uid
WHERE ((coalesce(h.c0, false) AND coalesce(h.c1, false)) OR (s.uid BETWEEN b.query_id * 7 AND b.query_id * 7 + 400 AND s.size > 4000))
  AND NOT contains(s.flags, '\DELETED')""")
def b1c(spark, sf):
    """B1 x T4-T6: one boolean tree per benchmark item over its first and last word, a uid range, a
    size and a flag: ((first and last) or (range and larger)) and not deleted."""
    ix = load_index(spark, rebuild_index(mail_docs(spark, sf), new_scratch_path(spark, "index")))
    item = read_table(spark, sf, "benchmark").withColumn("tk", tokenize("text")).where(F.size("tk") > 0) \
        .withColumn("item_id", F.col("item_id").cast("bigint"))
    clause = lambda k, kind, value=None, lo=None, hi=None: F.struct(
        F.lit(k).cast("bigint").alias("clause_id"), F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("name"),
        F.lit(value).cast("string").alias("value"), F.lit(lo).cast("bigint").alias("lo"), F.lit(hi).cast("bigint").alias("hi"))
    at = F.col("item_id") * 7
    clauses = F.array(clause(0, "body", F.get("tk", F.lit(0))), clause(1, "body", F.element_at("tk", -1)), clause(2, "flag_set", "DELETED"),
                      clause(3, "size_gt", lo=4000), clause(4, "uid", lo=at, hi=at + 400))
    base = [F.col("item_id").alias("query_id"), F.lit(None).cast("string").alias("mailbox_id")]
    criteria = item.select(*base, F.explode(clauses).alias("c")).select("query_id", "mailbox_id", "c.*")
    programs = item.select(*base, F.array(*map(F.lit, TREE)).alias("program"))
    return T.search_trees(ix.postings, ix.state, criteria, programs, ix.dictionary, ix.grams, ix.gram_stats)


@register("B1d_range_clauses", """
WITH q AS (SELECT c_custkey AS k, CAST(TIMESTAMP '1995-01-01' + to_days(CAST(c_custkey * 5 % 2000 AS INTEGER)) AS TIMESTAMP) AS d FROM customer)
SELECT q.k AS query_id, CAST(o.o_custkey AS VARCHAR) AS mailbox_id, o.o_orderkey AS uid
FROM q JOIN orders o ON (q.k % 3 = 0 AND o.o_orderkey BETWEEN q.k * 9 AND q.k * 9 + 60)
  OR (q.k % 3 = 1 AND o.o_orderdate BETWEEN q.d AND q.d + INTERVAL 10 DAY)
  OR (q.k % 3 = 2 AND o.o_custkey = q.k AND o.o_orderdate BETWEEN q.d AND q.d + INTERVAL 900 DAY)""")
def b1d(spark, sf):
    """C13b, C10-C12 in bulk: a range clause per customer over all orders, on uid, on the date, or on the date in
    the customer's own mailbox, through the interval index."""
    _, state = orders_index(spark, sf)
    k, day = F.col("c_custkey").cast("bigint"), 86_400_000_000
    start = F.unix_micros(F.lit("1995-01-01").cast("timestamp")) + k * 5 % 2000 * day
    kind = F.when(k % 3 == 0, "uid").otherwise("date_between")
    lo = F.when(k % 3 == 0, k * 9).otherwise(start)
    hi = F.when(k % 3 == 0, lo + 60).when(k % 3 == 1, lo + 10 * day).otherwise(lo + 900 * day)
    criteria = read_table(spark, sf, "customer").select(
        k.alias("query_id"), F.when(k % 3 == 2, k.cast("string")).alias("mailbox_id"), F.lit(0).cast("bigint").alias("clause_id"),
        kind.alias("kind"), lo.alias("lo"), hi.alias("hi"))
    return range_hits(state, criteria).select("query_id", "mailbox_id", "uid")


@register("B2_term_dictionary", O.with_(O.DOC_POSTINGS) + """
SELECT field, term, count(*) AS df FROM doc_postings GROUP BY field, term""")
def b2(spark, sf):
    """B2: distinct terms per field with document frequency."""
    p, _ = docs_index(spark, sf)
    return term_dictionary(p)


@register("B2c_maintained_dictionary", O.with_(O.DOC_POSTINGS) + """
SELECT field, term, count(*) AS df FROM doc_postings WHERE NOT uid BETWEEN 20 AND 150 GROUP BY field, term""")
def b2c(spark, sf):
    """B2 under W2, W4: the dictionary of an index kept as batches, after a late add, a repeated add and a range delete."""
    ix = LogIndex(spark, new_scratch_path(spark, "log-index"))
    docs = mail_docs(spark, sf, with_flags=False)
    ix.append(as_adds(docs.where(F.col("uid") % 3 > 0), 1))
    ix.append(as_adds(docs.where(F.col("uid") % 3 < 2), 0))
    ix.delete(docs.select("mailbox_id").distinct().withColumns({"lo": F.lit(20), "hi": F.lit(150), "seq": F.lit(2).cast("bigint")}))
    return ix.dictionary()


@register("B2b_dictionary_search", O.with_(O.DOC_POSTINGS) + """
SELECT DISTINCT mailbox_id, uid FROM doc_postings WHERE field = 'BODY' AND contains(term, 'TION')""")
def b2b(spark, sf):
    """B2: one-term search through the dictionary: match terms, then equi-join to postings."""
    p, _ = docs_index(spark, sf)
    qterms = spark.range(1).select(F.lit("BODY").alias("field"), F.lit("TION").alias("qterm"))
    # the matching terms written: Spark sees how few they are before it would shuffle the postings
    tm = materialize(B.match_terms(term_dictionary(p), qterms), "terms")
    return p.join(tm.select("field", "term"), ["field", "term"]).select("mailbox_id", "uid").distinct()


@register("B3_rebuild_index", _postings_sql([O.CONV_POSTINGS], "conv_postings"))
def b3(spark, sf):
    """Full index build of the conversations written to the scratch folder, read back."""
    root = rebuild_index(mail_conv(spark, sf), new_scratch_path(spark, "index"))
    return spark.read.parquet(f"{root}/postings").select(*P_COLS)


@register("B4_term_frequency", O.with_(O.CONV_H, O.CONV_TEXTS) + f"""
SELECT mailbox_id, field, term, uid, count(*) AS tf FROM (
  SELECT mailbox_id, uid, field, unnest({O.tok('t')}) AS term FROM conv_texts) GROUP BY mailbox_id, field, term, uid""")
def b4(spark, sf):
    """Term frequency per (mailbox, field, term, uid)."""
    return term_frequency(mail_conv(spark, sf))


@register("W2b_apply_changes", O.with_(O.CHANGES) + f"""
, live AS (SELECT mailbox_id, uid, last_add FROM fold WHERE {O.LIVE}),
body AS (SELECT l.mailbox_id, l.uid, 'signup ' || e.props AS t
         FROM live l JOIN events e ON e.event_id = l.last_add)
SELECT DISTINCT mailbox_id, 'BODY' AS field, term, uid FROM (
  SELECT mailbox_id, uid, unnest({O.tok('t')}) AS term FROM body)""")
def w2b(spark, sf):
    """W2-W4 together: the events log applied to an empty index in two batches (from
    2024-01-15 first, then the older events, which arrive late); each add carries a body made from its event. = index of live messages."""
    ev = read_table(spark, sf, "events").select(F.col("event_id").alias("seq"), "props")
    ch = mail_changes(spark, sf).drop("body").join(ev, "seq") \
        .withColumn("body", F.when(F.col("op") == "add", F.concat(F.lit("signup "), F.col("props")))).drop("props")
    ix = LogIndex(spark, new_scratch_path(spark, "log-index"))
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    ix.append(ch.where(F.col("ts") >= cut))
    ix.append(ch.where(F.col("ts") < cut))
    return ix.index().postings.select(*P_COLS)
