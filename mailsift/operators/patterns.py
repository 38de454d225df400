"""Regex terms on the dictionary (C14 with ``regex=True``): the trigrams that every match must hold.

A pattern is read into an and / or tree of trigrams: a run of letters needs all its trigrams, alternatives need
one side's, a repeat of at least one needs its body's, anything else needs nothing. Dictionary terms that
satisfy the tree come from the trigram index in one pass (a filter on the grams, one group a term) and only they
are tested by ``rlike``. A pattern that Python's parser does not read, or that needs no trigram, is
tested on the whole dictionary of its field.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

try:
    from re import _constants as _K
    from re import _parser as _P
except ImportError:  # before Python 3.11
    import sre_constants as _K
    import sre_parse as _P

GRAM = 3
Tree = tuple | str | None  # ("and" | "or", tree, ...), a trigram, or no requirement


def _join(op: str, kids: list[Tree]) -> Tree:
    if op == "or" and any(k is None for k in kids):
        return None
    kids = list(dict.fromkeys(k for k in kids if k is not None))
    return None if not kids else kids[0] if len(kids) == 1 else (op, *kids)


def _run(letters: str) -> list[Tree]:
    return [letters[i:i + GRAM] for i in range(len(letters) - GRAM + 1)]


def _sequence(items) -> Tree:
    needs: list[Tree] = []
    letters = ""
    for op, arg in items:
        if op is _K.LITERAL:
            c = chr(arg)
            letters += c.upper() if c.isascii() else c  # terms are upper-cased; (?i) folds ASCII letters only
            continue
        needs += _run(letters)
        letters = ""
        if op is _K.SUBPATTERN:
            needs.append(_sequence(arg[-1]))
        elif op is _K.BRANCH:
            needs.append(_join("or", [_sequence(x) for x in arg[1]]))
        elif op in (_K.MAX_REPEAT, _K.MIN_REPEAT, getattr(_K, "POSSESSIVE_REPEAT", None)):
            if arg[0] > 0:
                needs.append(_sequence(arg[2]))
        elif op is getattr(_K, "ATOMIC_GROUP", None):
            needs.append(_sequence(arg))
    return _join("and", needs + _run(letters))


def required_grams(pattern: str) -> Tree:
    """The tree of trigrams that every upper-cased term matched by ``pattern`` holds; None: none known."""
    try:
        parsed = _P.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return None
    if parsed.state.flags & ~(re.IGNORECASE | re.UNICODE):  # free spacing and the like
        return None
    return _sequence(parsed)


def grams_of(tree: Tree) -> set[str]:
    return {tree} if isinstance(tree, str) else set().union(*map(grams_of, tree[1:]))


def _holds(tree: Tree, held: Column) -> Column:
    if isinstance(tree, str):
        return F.array_contains(held, tree)
    both = (lambda a, b: a & b) if tree[0] == "and" else (lambda a, b: a | b)
    return reduce(both, [_holds(k, held) for k in tree[1:]])


def candidate_terms(dictionary: DataFrame, grams: DataFrame | None, field: str, pattern: str) -> DataFrame:
    """(field, term) rows that alone can match ``pattern``."""
    tree = required_grams(pattern) if grams is not None else None
    if tree is None:
        return dictionary.where(F.col("field") == field).select("field", "term")
    wanted = (F.col("field") == field) & F.col("gram").isin(*sorted(grams_of(tree)))
    return grams.where(wanted).groupBy("field", "term").agg(F.collect_set("gram").alias("held")) \
        .where(_holds(tree, F.col("held"))).select("field", "term")


def matching_terms(dictionary: DataFrame, grams: DataFrame | None, field: str, pattern: str) -> DataFrame:
    """(field, term) rows of dictionary terms that ``pattern`` matches somewhere."""
    return candidate_terms(dictionary, grams, field, pattern).where(F.col("term").rlike(pattern))
