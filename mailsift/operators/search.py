"""Search: criteria -> (mailbox_id, uid).

Plans:
- *dictionary rewrite* (B2, optional): posting criteria are first resolved on the term
  dictionary (trigram index for substrings), postings are then read by an equi-join on
  (field, term) with the matched terms (broadcast after a size check);
- *union plan* (``match='any'`` with no NOT/AND): one scan of postings with the OR of all
  posting predicates in a single `where`, one scan of message_state with the OR of all state
  predicates, `unionByName` + `distinct`. The distinct is a partial + final hash aggregate on
  (mailbox_id, uid): the only exchange, keyed by uid too, so a hot mailbox spreads out.
- *boolean plan* (AND / NOT): one postings scan flags every posting clause with
  `bool_or(predicate_i)` per (mailbox_id, uid). Conjuncts on message_state alone are pushed to
  its scan. Where the rest holds postings without NOT, the hits decide alone (and meet the state
  in a semi join only if it was filtered); else message_state, the set of all messages, is
  left-joined to them and the tree is one boolean filter. No chain of joins per clause.

Mailbox filters are equalities on `mailbox_id`, pushed to the Parquet scan; field filters
prune the `field=` partitions of a written index.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.operators import criteria as C

KEYS = ["mailbox_id", "uid"]


def _mailbox_filter(mailbox) -> Column | None:
    if mailbox is None:
        return None
    if isinstance(mailbox, (list, tuple, set, frozenset)):
        return F.col("mailbox_id").isin(*sorted(mailbox))
    return F.col("mailbox_id") == mailbox


def _where(df: DataFrame, *conds) -> DataFrame:
    conds = [c for c in conds if c is not None]
    return df.where(reduce(lambda a, b: a & b, conds)) if conds else df


# --------------------------------------------------------------------- simple scans

def scan_mailbox(state: DataFrame, mailbox) -> DataFrame:
    """Every uid of a mailbox ("list all")."""
    return _where(state, _mailbox_filter(mailbox)).select(*KEYS)


def scan_message_postings(postings: DataFrame, mailbox: str, uid: int) -> DataFrame:
    """S3: every posting of one message."""
    return postings.where((F.col("mailbox_id") == mailbox) & (F.col("uid") == uid))


def lookup_flags(state: DataFrame, mailbox: str | None = None, uid: int | None = None, keys: DataFrame | None = None) -> DataFrame:
    """Point read of one message's flags, or of all messages of ``keys`` (mailbox_id, uid)."""
    found = state if keys is None else state.join(keys.select(*KEYS), KEYS, "left_semi")
    return _where(found, *([] if mailbox is None else [F.col("mailbox_id") == mailbox]), *([] if uid is None else [F.col("uid") == uid])) \
        .select(*KEYS, "flags")


def project_uids(df: DataFrame) -> DataFrame:
    """(mailbox_id, uid) set of any posting/state rows."""
    return df.select(*KEYS).distinct()


def union_uids(*parts: DataFrame) -> DataFrame:
    """Union of partial uid sets, duplicates removed (partial + final aggregate)."""
    return reduce(lambda a, b: a.unionByName(b), [p.select(*KEYS) for p in parts]).distinct()


# --------------------------------------------------------------------- tree handling

_TRUE = C.Neutral("true")
_FALSE = C.Neutral("false")


def _simplify(node: C.Criterion) -> C.Criterion:
    """Fold neutral leaves logically: they are TRUE inside AND / OR / NOT."""
    node = C.check(node)
    if isinstance(node, C.Neutral):
        return _FALSE if node.label == "false" else _TRUE
    if isinstance(node, C.Not):
        child = _simplify(node.child)
        if child is _TRUE:
            return _FALSE
        if child is _FALSE:
            return _TRUE
        return C.Not(child)
    if isinstance(node, (C.And, C.Or)):
        kids = [_simplify(k) for k in node.children]
        if isinstance(node, C.And):
            if any(k is _FALSE for k in kids):
                return _FALSE
            kids = [k for k in kids if k is not _TRUE]
            if not kids:
                return _TRUE
        else:
            if any(k is _TRUE for k in kids):
                return _TRUE
            kids = [k for k in kids if k is not _FALSE]
            if not kids:
                return _FALSE
        return kids[0] if len(kids) == 1 else type(node)(tuple(kids))
    return node


def build_tree(criteria, match: str = "any") -> C.Criterion:
    """The reference's top level: criteria are ORed and neutral ones add nothing (Q1-Q3).

    With ``match='any'`` neutral criteria are dropped when any other criterion remains; alone
    they select the whole mailbox. With ``match='all'`` they are TRUE in the conjunction.
    """
    crits = [C.check(c) for c in (criteria if isinstance(criteria, (list, tuple)) else [criteria])]
    if match == "any":
        effective = [c for c in crits if not isinstance(c, C.Neutral)]
        if not effective:
            return _TRUE
        return _simplify(C.Or(tuple(effective)))
    if match == "all":
        return _simplify(C.And(tuple(crits)) if crits else _TRUE)
    raise ValueError("match must be 'any' or 'all'")


def _leaves(node, out):
    if isinstance(node, (C.And, C.Or)):
        for k in node.children:
            _leaves(k, out)
    elif isinstance(node, C.Not):
        _leaves(node.child, out)
    elif isinstance(node, C.PostingCriterion):
        if node not in out:
            out.append(node)
    return out


def _only_postings(node) -> bool:
    """A tree of posting criteria without NOT: it is false where no leaf matches."""
    if isinstance(node, (C.And, C.Or)):
        return all(_only_postings(k) for k in node.children)
    return isinstance(node, C.PostingCriterion)


def _is_flat_or(node) -> bool:
    if isinstance(node, C.Or):
        return all(isinstance(k, (C.PostingCriterion, C.StateCriterion)) for k in node.children)
    return isinstance(node, (C.PostingCriterion, C.StateCriterion))


def _tree_expr(node, posting_cols) -> Column:
    if node is _TRUE:
        return F.lit(True)
    if node is _FALSE:
        return F.lit(False)
    if isinstance(node, C.And):
        return reduce(lambda a, b: a & b, [_tree_expr(k, posting_cols) for k in node.children])
    if isinstance(node, C.Or):
        return reduce(lambda a, b: a | b, [_tree_expr(k, posting_cols) for k in node.children])
    if isinstance(node, C.Not):
        return ~_tree_expr(node.child, posting_cols)
    if isinstance(node, C.PostingCriterion):
        return F.coalesce(F.col(posting_cols[node]), F.lit(False))
    if isinstance(node, C.StateCriterion):
        return F.coalesce(node.predicate(), F.lit(False))
    raise ValueError(f"unsupported search criterion: {node!r}")


# --------------------------------------------------------------------- search

def _leaf_terms(spark, leaves, dictionary, grams, gram_stats) -> DataFrame:
    """(field, term, leaf) for every dictionary term a posting leaf matches (B2 rewrite):
    substring tests run on the vocabulary, not on every posting."""
    from mailsift.operators.batch import match_terms
    from mailsift.operators.patterns import matching_terms
    plain, regex, exists = [], [], []
    for i, leaf in enumerate(leaves):
        for f in leaf.fields:
            if not leaf.terms:
                exists.append((f, i))
            for t in leaf.terms:
                (regex if leaf.regex else plain).append((f, t, i))
    d = dictionary.select("field", "term")
    parts = []
    if plain:
        q = spark.createDataFrame(plain, "field string, qterm string, leaf int")
        tm = match_terms(dictionary, q.select("field", "qterm").distinct(), grams, gram_stats)
        parts.append(tm.join(F.broadcast(q), ["field", "qterm"]).select("field", "term", "leaf"))
    for f, t, i in regex:
        parts.append(matching_terms(d, grams, f, t).select("field", "term", F.lit(i).alias("leaf")))
    for f, i in exists:
        parts.append(d.where(F.col("field") == f).select("field", "term", F.lit(i).alias("leaf")))
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def search(postings: DataFrame, state: DataFrame, mailbox, criteria, match: str = "any",
           dictionary: DataFrame | None = None, grams: DataFrame | None = None,
           gram_stats: DataFrame | None = None) -> DataFrame:
    """Uids of ``mailbox`` (a name, a list of names, or None for all) matching the criteria.

    Returns DataFrame(mailbox_id, uid), unordered (Q20). With ``dictionary`` (and optionally the
    gram tables of the index) posting criteria are resolved on the term dictionary first and
    postings are then read by an equi-join on (field, term): the substring test touches each
    distinct term once instead of every posting.
    """
    tree = build_tree(criteria, match)
    mb = _mailbox_filter(mailbox)
    if tree is _TRUE:
        return scan_mailbox(state, mailbox)
    if tree is _FALSE:
        return scan_mailbox(state, mailbox).limit(0)
    leaves = _leaves(tree, [])
    tagged = None
    # "header exists" matches every term of its field: the dictionary would not narrow anything
    if dictionary is not None and leaves and all(leaf.terms for leaf in leaves):
        terms = _leaf_terms(postings.sparkSession, leaves, dictionary, grams, gram_stats)
        tagged = _where(postings, mb).join(terms, ["field", "term"])

    if _is_flat_or(tree):
        kids = tree.children if isinstance(tree, C.Or) else (tree,)
        p_kids = [k for k in kids if isinstance(k, C.PostingCriterion)]
        s_kids = [k for k in kids if isinstance(k, C.StateCriterion)]
        parts = []
        if p_kids and tagged is not None:
            parts.append(tagged.select(*KEYS))
        elif p_kids:
            pred = reduce(lambda a, b: a | b, [k.predicate() for k in p_kids])
            parts.append(_where(postings, mb, pred).select(*KEYS))
        if s_kids:
            pred = reduce(lambda a, b: a | b, [k.predicate() for k in s_kids])
            parts.append(_where(state, mb, pred).select(*KEYS))
        return union_uids(*parts)

    # A conjunction's tests on the state alone become plain filters of its scan.
    conjuncts = tree.children if isinstance(tree, C.And) else (tree,)
    on_state = [k for k in conjuncts if not _leaves(k, [])]
    rest = [k for k in conjuncts if _leaves(k, [])]
    universe = _where(state, mb, *[k.predicate() if isinstance(k, C.StateCriterion) else _tree_expr(k, {})
                                   for k in on_state])
    if not rest:
        return universe.select(*KEYS)
    cols = {leaf: f"c{i}" for i, leaf in enumerate(leaves)}
    if tagged is not None:
        hits = tagged.groupBy(*KEYS).agg(
            *[F.bool_or(F.col("leaf") == i).alias(cols[leaf]) for i, leaf in enumerate(leaves)])
    else:
        any_leaf = reduce(lambda a, b: a | b, [leaf.predicate() for leaf in leaves])
        hits = _where(postings, mb, any_leaf).groupBy(*KEYS).agg(
            *[F.bool_or(leaf.predicate()).alias(cols[leaf]) for leaf in leaves])
    test = reduce(lambda a, b: a & b, [_tree_expr(k, cols) for k in rest])
    if all(_only_postings(k) for k in rest):
        # Messages without a hit can't match: the hits alone decide.
        hits = hits.where(test).select(*KEYS)
        return universe.join(hits, KEYS, "left_semi").select(*KEYS) if on_state else hits
    return universe.join(hits, KEYS, "left").where(test).select(*KEYS)


def header_contains_exact(messages: DataFrame, mailbox, name: str, value: str) -> DataFrame:
    """Q12 with ``exact_name=True``: messages whose header called ``name`` (ignoring case)
    holds the whole upper-cased ``value`` inside one of its tokens.

    The index routes unknown names to PREFIX_HEADER and keeps no header names there, so this
    runs on the `messages` table itself: one filtered scan (mailbox pushed down), no shuffle.
    """
    from mailsift.functions.text import tokenize
    target, needle = name.upper(), value.upper()
    hit = F.exists(F.col("headers"), lambda h: (F.upper(h["name"]) == target) &
                   F.exists(tokenize(h["value"]), lambda t: t.contains(needle)))
    return _where(messages, _mailbox_filter(mailbox), hit).select(*KEYS)
