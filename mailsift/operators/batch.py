"""Batch search (B1) over a term dictionary (B2).

Input: a criteria table, one row per clause:
    query_id, mailbox_id (NULL = every mailbox), clause_id, kind, name, value, lo, hi
kinds:  body | text | header | exists | address          (posting clauses)
        flag_set | flag_unset | uid | size_eq | size_lt | size_gt | date_between  (state clauses)
        all                                                (neutral)

Plan (no step evaluates a substring test per posting):
1. posting clauses are tokenized in Spark -> (field, qterm) rows; distinct qterms are matched
   against the *term dictionary* (distinct terms per field), not against postings:
   - qterms of 3+ characters through a trigram index of the dictionary: the rarest trigram of
     each qterm is an equi-join key, candidates are then verified with `contains` (exact);
   - shorter qterms by an equi-join with the 1- and 2-character pieces of the terms.
2. matching terms are equi-joined back to postings on (field, term);
3. ``match='any'``: a term carries the set of its queries as bits, a message unites the sets of its terms;
4. ``match='all'``: hits are tagged with (query_id, clause_id) by an equi-join on (field, qterm); count of distinct
   matched clauses per (query_id, mailbox_id, uid) equals the query's clause count.
State clauses: ranges meet the messages in an interval index (intervals.py), set flags in an equi-join on the
flag. Several rows of one clause (tokens, uid ranges) are alternatives; a uid row ``*``
(lo = hi = 2^63 - 1) makes its clause neutral. Trees of clauses are in trees.py.
Spark broadcasts by its own byte threshold; otherwise it shuffles on the equi-keys and AQE
splits skewed partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailsift.functions.flags import flag_name_col
from mailsift.functions.headers import header_field
from mailsift.functions.text import tokenize
from mailsift.operators.criteria import UID_STAR
from mailsift.operators.ingest import term_dictionary
from mailsift.operators.intervals import range_hits
from mailsift.session import materialize

POSTING_KINDS = ("body", "text", "header", "exists", "address")
STATE_KINDS = ("flag_set", "flag_unset", "uid", "size_eq", "size_lt", "size_gt", "date_between")
GRAM = 3


def expand_criteria(raw: DataFrame) -> DataFrame:
    """Criteria rows -> one row per (clause, field, qterm) for posting clauses; state and
    neutral clauses pass through with ``field``/``qterm`` NULL. A text clause without any
    token produces no row, so it adds nothing (Q3)."""
    kind = F.col("kind")
    fields = (F.when(kind == "body", F.array(F.lit("BODY")))
              .when(kind == "text", F.array(F.lit("BODY"), F.lit("HEADERS")))
              .when(kind.isin("header", "exists", "address"), F.array(header_field(F.col("name")))))
    terms = (F.when(kind.isin("body", "text", "address"), F.array_distinct(tokenize(F.col("value"))))
             .when(kind == "header", F.array(F.upper(F.col("value"))))
             .when(kind == "exists", F.array(F.lit(""))))
    # A uid clause with `*` constrains nothing, whatever ranges stand beside it
    star = (kind == "uid") & (F.col("lo") == UID_STAR) & (F.col("hi") == UID_STAR)
    starred = raw.where(star).select(F.col("query_id").alias("s_query"), F.col("clause_id").alias("s_clause"), F.lit(True).alias("star")).distinct()
    raw = raw.join(starred, F.col("query_id").eqNullSafe(F.col("s_query")) & F.col("clause_id").eqNullSafe(F.col("s_clause")), "left") \
        .withColumn("kind", F.when((kind == "uid") & F.col("star"), "all").otherwise(kind)).drop("s_query", "s_clause", "star")
    base = ["query_id", "mailbox_id", "clause_id", "kind", "lo", "hi"]
    posting = raw.where(kind.isin(*POSTING_KINDS)).select(
        *base, F.explode(fields).alias("field"), terms.alias("terms")) \
        .select(*base, "field", F.explode("terms").alias("qterm"))
    other = raw.where(~kind.isin(*POSTING_KINDS)).select(
        *base, F.lit(None).cast("string").alias("field"),
        F.when(kind.isin("flag_set", "flag_unset"), flag_name_col(F.col("value"))).alias("qterm"))
    return posting.unionByName(other)


def _grams(term_col: str) -> F.Column:
    t = F.col(term_col)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - (GRAM - 1)),
                                        lambda i: F.substring(t, i, GRAM)))


def gram_index(dictionary: DataFrame) -> DataFrame:
    """(field, term, gram, df) for every dictionary term of 3+ characters (built once per index)."""
    df = F.col("df") if "df" in dictionary.columns else F.lit(1).cast("bigint")
    return dictionary.where(F.length("term") >= GRAM).select(
        "field", "term", F.explode(_grams("term")).alias("gram"), df.alias("df"))


def gram_statistics(grams: DataFrame) -> DataFrame:
    """(field, gram, n, docs): terms holding the gram, and the sum of their document
    frequencies (an upper bound of the messages whose terms contain the gram)."""
    return grams.groupBy("field", "gram").agg(F.count(F.lit(1)).alias("n"), F.sum("df").alias("docs"))


def rarest_grams(qterms: DataFrame, gram_stats: DataFrame) -> DataFrame:
    """(field, qterm, gram, n, docs) for query terms of 3+ characters: the trigram of the
    qterm held by the fewest messages' terms (``docs``, an upper bound of the messages that can
    match the qterm). n = 0 (a trigram no term has) means no term can match."""
    long_q = qterms.where(F.length("qterm") >= GRAM)
    q_grams = long_q.select("field", "qterm", F.explode(_grams("qterm")).alias("gram"))
    n = F.coalesce(F.col("n"), F.lit(0))
    docs = F.coalesce(F.col("docs"), F.lit(0))
    return q_grams.join(gram_stats, ["field", "gram"], "left") \
        .groupBy("field", "qterm") \
        .agg(F.min_by("gram", F.struct(docs, n, F.col("gram"))).alias("gram"),
             F.min(n).alias("n"), F.min(docs).alias("docs"))


def match_terms(dictionary: DataFrame, qterms: DataFrame, grams: DataFrame | None = None,
                gram_stats: DataFrame | None = None, pick: DataFrame | None = None) -> DataFrame:
    """(field, term, qterm) for every dictionary term containing a query term (exact).
    ``qterms`` holds distinct (field, qterm) rows; the output then has no duplicates.

    Query terms of 3+ characters: the rarest trigram of the qterm is an equi-join key into the
    gram index, candidates are verified with `contains`. Shorter ones: an equi-join with the terms'
    1- and 2-character pieces. The query terms are written first: Spark then knows how small they are and
    broadcasts them where they stay below its byte threshold. Of the dictionary it would know the compressed
    files alone, a hundredth of its exploded pieces, so the distinct short query terms (no more than the
    pairs of characters in use) are always the side that is sent.
    """
    d = dictionary.select("field", "term")
    qterms = materialize(qterms.select("field", "qterm"), "query-terms")
    if grams is None:
        d = materialize(d, "dictionary")    # read by each of the joins below
    grams = grams if grams is not None else gram_index(d)
    if gram_stats is None:
        gram_stats = gram_statistics(grams)
    if pick is None:
        pick = rarest_grams(qterms, gram_stats)
        pick = materialize(pick, "picked-grams")
    pick = pick.where(F.col("n") > 0).select("field", "gram", "qterm")
    long_hits = grams.join(pick, ["field", "gram"]) \
        .where(F.col("term").contains(F.col("qterm"))).select("field", "term", "qterm")

    # shorter ones: an equi-join with the 1- and 2-character pieces of the terms; the empty one is in every term
    short = qterms.where(F.length("qterm").between(1, GRAM - 1)).select("field", "qterm")
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), F.length("term")), lambda i: F.array(*[F.substring(F.col("term"), i, n) for n in range(1, GRAM)])))
    short_hits = d.where("term != ''").select("field", "term", F.explode(F.array_distinct(pieces)).alias("qterm")).join(F.broadcast(short), ["field", "qterm"]) \
        .select("field", "term", "qterm")
    short_hits = short_hits.unionByName(d.join(F.broadcast(qterms.where("qterm = ''").select("field", "qterm")), "field").select("field", "term", "qterm"))
    # (field, term, qterm) is already unique: a term has one row per distinct trigram and each
    # long qterm picks one trigram; short hits pair unique dictionary terms with unique qterms
    return long_hits.unionByName(short_hits)


def _state_condition() -> F.Column:
    k = F.col("kind")
    return ((k == "flag_set") & F.array_contains(F.col("flags"), F.col("qterm"))) \
        | ((k == "flag_unset") & ~F.array_contains(F.col("flags"), F.col("qterm"))) \
        | ((k == "uid") & F.col("uid").between(F.col("lo"), F.col("hi"))) \
        | ((k == "size_eq") & (F.col("size") == F.col("lo"))) \
        | ((k == "size_lt") & (F.col("size") < F.col("lo"))) \
        | ((k == "size_gt") & (F.col("size") > F.col("lo"))) \
        | ((k == "date_between") & F.col("internal_date").between(
            F.timestamp_micros(F.col("lo")).cast("timestamp_ntz"),
            F.timestamp_micros(F.col("hi")).cast("timestamp_ntz")))


def _mailbox_ok() -> F.Column:
    return F.col("q_mailbox").isNull() | (F.col("q_mailbox") == F.col("mailbox_id"))


def _state_hits(st: DataFrame, s_crit: DataFrame) -> DataFrame:
    """(query_id, clause_id, mailbox_id, uid) of state clauses over message_state."""
    out = ["query_id", "clause_id", "mailbox_id", "uid"]
    parts = [range_hits(st, s_crit)]
    flags = s_crit.where(F.col("kind").isin("flag_set", "flag_unset")) \
        .select("query_id", "clause_id", F.col("mailbox_id").alias("q_mailbox"), "kind", "qterm").distinct()
    if flags.take(1):
        held = st.select("mailbox_id", "uid", F.explode(F.array_distinct("flags")).alias("flag"))
        wanted = flags.where("kind = 'flag_set'")
        parts.append(held.join(wanted, held["flag"] == wanted["qterm"]).where(_mailbox_ok()).select(*out))
        # messages without a flag: most of a mailbox, as the result is; without a mailbox, of all messages
        unset = flags.where("kind = 'flag_unset'")
        parts.append(st.join(unset.where("q_mailbox is not null"), F.col("mailbox_id") == F.col("q_mailbox"))
                     .where(~F.array_contains("flags", F.col("qterm"))).select(*out))
        free = unset.where("q_mailbox is null")
        if free.take(1):
            parts.append(st.join(free, ~F.array_contains("flags", F.col("qterm"))).select(*out))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _any_hits(post: DataFrame, tm: DataFrame, pc: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, mailbox_id, uid) of messages with a term that holds any token of the query.

    ``queries`` numbers the (query_id, q_mailbox) pairs, and a set of queries is those 64-bit words (word
    number, bits) that aren't zero. Each term gets the set of the queries it answers; the terms of a language
    share few different sets, so a posting carries its set's number to its message, where the
    sets are united. No hit is fanned out to the queries that share a token before that.
    """
    def same(a, b, *columns):
        return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in columns])

    numbered = pc.join(queries, same(pc, queries, "query_id", "q_mailbox")) \
        .select("field", "qterm", F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("bits"))
    words = materialize(numbered.groupBy("field", "qterm", "word").agg(F.bit_or("bits").alias("bits")), "query-words")
    answered = tm.join(words, ["field", "qterm"]).groupBy("field", "term", "word").agg(F.bit_or("bits").alias("bits"))
    of_term = materialize(answered.groupBy("field", "term")
                          .agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("queries")), "term-queries")
    sets = materialize(of_term.select("queries").distinct().withColumn("n", F.monotonically_increasing_id()), "query-sets")
    of_term = materialize(of_term.join(sets, "queries").select("field", "term", "n"), "terms")
    held = post.join(of_term, ["field", "term"]).select("mailbox_id", "uid", "n") \
        .repartition("mailbox_id", "uid").distinct()
    united = held.join(sets, "n").select("mailbox_id", "uid", F.explode("queries").alias("q")) \
        .groupBy("mailbox_id", "uid", F.col("q.word").alias("word")).agg(F.bit_or("q.bits").alias("bits"))
    bit = F.expr("shiftright(bits, cast(bit & 63 as int)) & 1L") == 1
    return united.join(queries.withColumn("word", F.shiftright("bit", 6)), "word").where(bit & _mailbox_ok()) \
        .select("query_id", "mailbox_id", "uid")


SEPARATOR = "\0"


def held_tokens(post: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of ``asked`` (mailbox_id, uid, field, qterm ...) whose message has a term of the field that holds the token.

    The terms of a message and field become one text, searched once a token instead of once a term.
    """
    key = ["mailbox_id", "uid", "field"]
    terms = post.select(*key, "term").repartition(*key).groupBy(*key) \
        .agg(F.array_join(F.collect_list("term"), SEPARATOR).alias("terms"))
    plain = ~F.col("qterm").contains(SEPARATOR)
    found = asked.where(plain).join(terms, key).where(F.col("terms").contains(F.col("qterm"))).select(*asked.columns)
    odd = asked.where(~plain)    # these may reach over the end of a term
    if not odd.select("qterm").distinct().take(1):
        return found
    return found.unionByName(odd.join(post, key).where(F.col("term").contains(F.col("qterm"))).select(*asked.columns).distinct())


SHORT_WEIGHT = 1e18       # clause weight of a 1-2 character token: never preferred as driver
DRIVER_CLAUSES = 3        # lightest clauses whose intersection gives the candidates


def search_batch(postings: DataFrame, state: DataFrame, criteria: DataFrame, match: str = "any",
                 dictionary: DataFrame | None = None, grams: DataFrame | None = None,
                 gram_stats: DataFrame | None = None) -> DataFrame:
    """B1: (query_id, mailbox_id, uid) for every query of the criteria table.

    ``match='any'``: a message matches when any clause matches (the reference's default).
    ``match='all'``: conjunctive plan. Each clause gets a weight from the gram statistics
    alone (per token: messages whose terms hold its rarest trigram); the messages matching all
    of the query's ``DRIVER_CLAUSES`` lightest clauses are the candidates, and only candidates
    are checked against the query's other clauses, on their own postings. No hit is fanned
    out to every query sharing a term, and common short tokens are never expanded over the
    whole index. Spark picks broadcasts by its own byte threshold.
    """
    if match not in ("any", "all"):
        raise ValueError("match must be 'any' or 'all'")
    crit = materialize(expand_criteria(criteria), "criteria")
    p_crit = crit.where(F.col("field").isNotNull())
    s_crit = crit.where(F.col("kind").isin(*STATE_KINDS))
    st = state.select("mailbox_id", "uid", "flags", "size", "internal_date")
    has_p, has_s = bool(p_crit.take(1)), bool(s_crit.take(1))
    pc = p_crit.select("query_id", "clause_id", F.col("mailbox_id").alias("q_mailbox"), "field", "qterm")
    post = postings.select("mailbox_id", "uid", "field", "term")
    whole = _whole_mailbox_queries(criteria, crit, st)
    if has_p and dictionary is None:
        dictionary = term_dictionary(postings)

    if not (has_p or has_s):
        return whole
    if match == "any":
        parts = [whole]
        if has_p:
            tm = match_terms(dictionary, p_crit.select("field", "qterm").distinct(), grams, gram_stats)
            queries = materialize(pc.select("query_id", "q_mailbox").distinct()
                                  .withColumn("bit", F.monotonically_increasing_id()), "queries")
            parts.append(_any_hits(post, tm, pc, queries))
            again = F.col("query_id").isNull() | (F.col("count") > 1)
            if not has_s and not queries.groupBy("query_id").count().where(again).take(1):
                # a row for each bit, and `whole` holds other queries: nothing to remove
                return whole.distinct().unionByName(parts[1])
        if has_s:
            parts.append(_state_hits(st, s_crit).select("query_id", "mailbox_id", "uid"))
        out = parts[0]
        for extra in parts[1:]:
            out = out.unionByName(extra)
        return out.distinct()

    need = crit.where(F.col("kind") != "all").groupBy("query_id") \
        .agg(F.countDistinct("clause_id").alias("need"))
    results = []
    if has_p:
        if grams is None:
            grams = gram_index(dictionary.select("field", "term"))
        if gram_stats is None:
            gram_stats = gram_statistics(grams)
        # token weight: messages whose terms hold its rarest trigram (short tokens: never first)
        pick = materialize(rarest_grams(p_crit.select("field", "qterm").distinct(), gram_stats), "picked-grams")
        w_tok = F.when(F.length("qterm") < GRAM, F.lit(SHORT_WEIGHT)) \
            .when(F.col("n") > 0, F.col("docs").cast("double")).otherwise(F.lit(0.0))
        weight = pc.join(pick.select("field", "qterm", "n", "docs"), ["field", "qterm"], "left") \
            .groupBy("query_id", "clause_id").agg(F.sum(w_tok).alias("w"))
        # the DRIVER_CLAUSES lightest clauses of each query (window over one query's clauses)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("w", "clause_id"))
        drivers = weight.withColumn("rank", rank).where(F.col("rank") <= DRIVER_CLAUSES) \
            .select("query_id", "clause_id")
        drivers = materialize(drivers, "drivers")
        n_drv = drivers.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_drv"))
        d_tok = pc.join(drivers, ["query_id", "clause_id"])
        d_q = d_tok.select("field", "qterm").distinct()
        d_terms = match_terms(dictionary, d_q, grams, gram_stats,
                              pick=pick.join(d_q, ["field", "qterm"], "left_semi"))
        d_match = d_terms.join(d_tok, ["field", "qterm"]) \
            .select("query_id", "clause_id", "q_mailbox", "field", "term")
        # candidates: messages matching every driver clause of the query
        cand = post.join(d_match, ["field", "term"]).where(_mailbox_ok()) \
            .select("query_id", "clause_id", "mailbox_id", "uid").distinct() \
            .groupBy("query_id", "mailbox_id", "uid").agg(F.count(F.lit(1)).alias("c")) \
            .join(n_drv, "query_id").where(F.col("c") == F.col("n_drv")) \
            .select("query_id", "mailbox_id", "uid")
        cand = materialize(cand, "candidates")
        # verify: each candidate against every posting clause of its query, on its own postings
        cand_tok = cand.join(pc, "query_id").where(_mailbox_ok()) \
            .select("query_id", "clause_id", "mailbox_id", "uid", "field", "qterm")
        got = post.join(cand_tok, ["mailbox_id", "uid", "field"]) \
            .where(F.col("term").contains(F.col("qterm"))) \
            .select("query_id", "clause_id", "mailbox_id", "uid")
        if has_s:
            sc = s_crit.select("query_id", "clause_id", F.col("mailbox_id").alias("q_mailbox"),
                               "kind", "qterm", "lo", "hi")
            s_ok = cand.join(st, ["mailbox_id", "uid"]).join(sc, "query_id") \
                .where(_mailbox_ok() & _state_condition()) \
                .select("query_id", "clause_id", "mailbox_id", "uid")
            got = got.unionByName(s_ok)
        results.append(got)
    if has_s:
        # queries made of state clauses only
        p_queries = pc.select("query_id").distinct()
        only_s = s_crit.join(p_queries, "query_id", "left_anti")
        results.append(_state_hits(st, only_s))
    hits = results[0] if len(results) == 1 else results[0].unionByName(results[1])
    counted = hits.groupBy("query_id", "mailbox_id", "uid").agg(F.countDistinct("clause_id").alias("got"))
    return counted.join(need, "query_id").where(F.col("got") == F.col("need")) \
        .select("query_id", "mailbox_id", "uid").unionByName(whole)


def _whole_mailbox_queries(raw: DataFrame, crit: DataFrame, st: DataFrame) -> DataFrame:
    """Queries without any effective clause (only `all` or token-less text, Q2/Q3) select
    their whole mailbox: an equi-join of message_state with those queries on mailbox_id. One
    without a mailbox selects every message, as its result is."""
    effective = crit.where(F.col("kind") != "all").select("query_id").distinct()
    neutral = raw.select("query_id", "mailbox_id").distinct().join(effective, "query_id", "left_anti")
    bound = st.join(neutral.where("mailbox_id is not null"), "mailbox_id").select("query_id", "mailbox_id", "uid")
    free = neutral.where("mailbox_id is null").select("query_id")
    if not free.take(1):
        return bound
    return bound.unionByName(st.select("mailbox_id", "uid").join(free).select("query_id", "mailbox_id", "uid"))
