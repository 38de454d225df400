"""Search criteria (C1-C17, T1-T6) compiled to Spark `Column` predicates.

A criterion is one of three kinds:
- *posting* criteria test the `postings` table (text, header, address): a message matches
  when it has at least one posting in the field(s) whose term matches one of the tokens;
- *state* criteria test `message_state` columns (flags, internal date, uid, size);
- *neutral* criteria add no constraint (all, text without any token, uid `*`, no ranges).

`and_`, `or_` and `not_` combine criteria. What is not listed here raises `ValueError`.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailsift.functions.dates import truncate_py, ts_literal, upper_bound_py
from mailsift.functions.flags import flag_name
from mailsift.functions.headers import header_field_py
from mailsift.functions.text import tokenize_py

UID_STAR = 2**63 - 1   # Long.MAX_VALUE stands for `*` in a uid range


class Criterion:
    kind = "neutral"


@dataclass(frozen=True)
class PostingCriterion(Criterion):
    """Any posting with ``field in fields`` whose term contains (or, with regex, matches) a token."""
    fields: tuple
    terms: tuple          # empty tuple: any term of the field (header exists)
    regex: bool = False
    kind: str = "posting"

    def predicate(self) -> Column:
        f = F.col("field")
        on_field = (f == self.fields[0]) if len(self.fields) == 1 else f.isin(*self.fields)
        if not self.terms:
            return on_field
        term = F.col("term")
        if self.regex:
            tests = [term.rlike(t) for t in self.terms]
        else:
            # C14: "starts with" is covered by "contains"
            tests = [term.contains(t) for t in self.terms]
        return on_field & reduce(lambda a, b: a | b, tests)


@dataclass(frozen=True)
class StateCriterion(Criterion):
    """A boolean expression over message_state columns."""
    expr_fn: object = field(compare=False)
    label: str = ""
    kind: str = "state"

    def predicate(self) -> Column:
        return self.expr_fn()


@dataclass(frozen=True)
class Neutral(Criterion):
    label: str = "all"
    kind: str = "neutral"


@dataclass(frozen=True)
class And(Criterion):
    children: tuple
    kind: str = "and"


@dataclass(frozen=True)
class Or(Criterion):
    children: tuple
    kind: str = "or"


@dataclass(frozen=True)
class Not(Criterion):
    child: Criterion
    kind: str = "not"


# ------------------------------------------------------------------ text / header criteria

def _regex(pattern: str) -> str:
    """Q9 ``regex=True``: the caller's pattern, unchanged, matched ignoring case (terms are
    stored upper-cased; upper-casing the pattern would turn ``\\d`` into ``\\D``)."""
    return "(?i)" + pattern


def body_contains(text: str, regex: bool = False) -> Criterion:
    """Any token of ``text`` is inside a BODY term. No token -> neutral (Q3)."""
    toks = tuple(dict.fromkeys(tokenize_py(text))) if not regex else (_regex(text),)
    return PostingCriterion(("BODY",), toks, regex) if toks else Neutral("empty text")


def text_contains(text: str, regex: bool = False) -> Criterion:
    """The same over BODY and HEADERS (full text)."""
    toks = tuple(dict.fromkeys(tokenize_py(text))) if not regex else (_regex(text),)
    return PostingCriterion(("BODY", "HEADERS"), toks, regex) if toks else Neutral("empty text")


mail_contains = text_contains


def header_contains(name: str, value: str, regex: bool = False) -> Criterion:
    """The whole upper-cased value (not tokenized) inside one term of the routed field."""
    if value is None:
        raise ValueError("header_contains needs a value")
    return PostingCriterion((header_field_py(name),), (_regex(value) if regex else value.upper(),), regex)


def header_exists(name: str) -> Criterion:
    """C4: the routed field has any term."""
    return PostingCriterion((header_field_py(name),), ())


def address_contains(name: str, address: str) -> Criterion:
    """Any token of the address inside a term of the routed field."""
    toks = tuple(dict.fromkeys(tokenize_py(address)))
    return PostingCriterion((header_field_py(name),), toks) if toks else Neutral("empty address")


# ------------------------------------------------------------------ state criteria

def flag_set(flag: str, substring: bool = False) -> Criterion:
    """The flag is set (case-insensitive). ``substring=True`` tests the joined flag string."""
    name = flag_name(flag)
    if substring:
        return StateCriterion(lambda: F.array_join(F.col("flags"), "").contains(name), f"flag~{name}")
    return StateCriterion(lambda: F.array_contains(F.col("flags"), name), f"flag={name}")


def flag_unset(flag: str) -> Criterion:
    """The flag is not set (Q4 fixed: the reference returned every message)."""
    name = flag_name(flag)
    return StateCriterion(lambda: ~F.array_contains(F.col("flags"), name), f"flag!={name}")


def custom_flag(flag: str, is_set: bool = True) -> Criterion:
    """A user flag, set or unset."""
    return flag_set(flag) if is_set else flag_unset(flag)


def _date() -> Column:
    return F.col("internal_date")


def _date_bounds(ts, resolution):
    return truncate_py(ts, resolution), upper_bound_py(ts, resolution)


def date_on(ts: _dt.datetime, resolution: str = "day", bounds: str = "closed") -> Criterion:
    """Internal date within the resolution unit of ``ts``; closed [lo, hi] by default (Q6)."""
    lo, hi = _date_bounds(ts, resolution)
    if bounds == "closed":
        return StateCriterion(lambda: _date().between(ts_literal(lo), ts_literal(hi)), f"on {lo}")
    if bounds == "half_open":
        return StateCriterion(lambda: (_date() >= ts_literal(lo)) & (_date() < ts_literal(hi)), f"on {lo}")
    raise ValueError("bounds must be 'closed' or 'half_open'")


def date_before(ts: _dt.datetime, resolution: str = "day", bounds: str = "closed") -> Criterion:
    """C11: internal date <= start of the unit (``<`` when half open). Pre-1970 works (Q7)."""
    lo, _ = _date_bounds(ts, resolution)
    if bounds == "closed":
        return StateCriterion(lambda: _date() <= ts_literal(lo), f"before {lo}")
    return StateCriterion(lambda: _date() < ts_literal(lo), f"before {lo}")


def date_after(ts: _dt.datetime, resolution: str = "day", bounds: str = "closed") -> Criterion:
    """Internal date >= end of the unit."""
    _, hi = _date_bounds(ts, resolution)
    return StateCriterion(lambda: _date() >= ts_literal(hi), f"after {hi}")


def uid_eq(n: int) -> Criterion:
    """C13a."""
    if n == UID_STAR:
        return Neutral("uid *")
    return StateCriterion(lambda: F.col("uid") == F.lit(n).cast("bigint"), f"uid={n}")


def uid_ranges(ranges) -> Criterion:
    """Uid in any closed range; a ``(*, *)`` range or no range -> neutral."""
    ranges = [(int(lo), int(hi)) for lo, hi in ranges]
    if not ranges or any(lo == hi == UID_STAR for lo, hi in ranges):
        return Neutral("uid *")

    def expr():
        u = F.col("uid")
        parts = [(u == lo) if lo == hi else u.between(lo, hi) for lo, hi in ranges]
        return reduce(lambda a, b: a | b, parts)
    return StateCriterion(expr, f"uid in {ranges}")


def size_eq(n: int) -> Criterion:
    """T1."""
    return StateCriterion(lambda: F.col("size") == n, f"size={n}")


def size_lt(n: int) -> Criterion:
    """T2."""
    return StateCriterion(lambda: F.col("size") < n, f"size<{n}")


def size_gt(n: int) -> Criterion:
    """T3."""
    return StateCriterion(lambda: F.col("size") > n, f"size>{n}")


def all_() -> Criterion:
    """Every message of the mailbox."""
    return Neutral("all")


# ------------------------------------------------------------------ combinators

def and_(*criteria: Criterion) -> Criterion:
    """T5."""
    return And(tuple(criteria))


def or_(*criteria: Criterion) -> Criterion:
    """T6."""
    return Or(tuple(criteria))


def not_(criterion: Criterion) -> Criterion:
    """T4."""
    return Not(criterion)


def check(criterion) -> Criterion:
    if not isinstance(criterion, Criterion):
        raise ValueError(f"unsupported search criterion: {criterion!r}")
    return criterion
