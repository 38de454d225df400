"""Tokenizer and case folding.

The tokenizer is one regular expression evaluated by the JVM (`regexp_extract_all`), so the
index build stays inside Spark's own expression engine. Text is upper-cased first and the
pattern is written for upper-case input; tokens are words (letters, marks, digits and `_`,
joined by `.`, apostrophes, `:` or `·`), e-mail addresses and http(s) URLs. Han and Hiragana
letters are a token each and a run of Katakana is one, wherever they stand: such texts get spaces
around them first. A URL ends before closing punctuation. The same patterns
compile under RE2, so the SQL oracle can run them unchanged.

The query side tokenizes short criteria strings in Python with the same pattern
(``tokenize_py``), since those are query parameters, not data.
"""

from __future__ import annotations

import regex as _re
from pyspark.sql import Column
from pyspark.sql import functions as F

# Token grammar (for upper-cased text).
EMAIL_PATTERN = r"[A-Z0-9._%+'-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
URL_PATTERN = r'''HTTPS?://[^ \t\r\n<>"]*[^ \t\r\n<>".,;:!?'()\[\]{}]'''
WORD_PATTERN = r"[\p{L}\p{M}\p{N}_]+(?:[.'’:·][\p{L}\p{M}\p{N}_]+)*"
SINGLE_PATTERN = r"[\p{Han}\p{Hiragana}]\p{M}*"
RUN_PATTERN = r"[\p{Katakana}ー][\p{Katakana}ー\p{M}]*"
SCRIPT_PATTERN = f"({SINGLE_PATTERN}|{RUN_PATTERN})"
TOKEN_PATTERN = f"{EMAIL_PATTERN}|{URL_PATTERN}|{WORD_PATTERN}"
# The same words for the JVM: a possessive group is a loop there, where a plain repeated group
# is a recursion and a chain of some thousand parts overflows the stack.
_JVM_WORD = WORD_PATTERN.replace(")*", ")*+")
_JVM_TOKEN = f"{EMAIL_PATTERN}|{URL_PATTERN}|{_JVM_WORD}"

# Scripts have other names in Java's patterns.
_JVM_SCRIPT = SCRIPT_PATTERN.replace(r"\p{Han}", r"\p{IsHan}").replace(r"\p{Hiragana}", r"\p{IsHiragana}").replace(r"\p{Katakana}", r"\p{IsKatakana}")

_TOKEN_RE = _re.compile(TOKEN_PATTERN)
_SCRIPT_RE = _re.compile(SCRIPT_PATTERN)


def upper_en(col: Column | str) -> Column:
    """English upper case (``ß`` becomes ``SS``)."""
    return F.upper(col if isinstance(col, Column) else F.col(col))


# A text without "@" cannot hold an e-mail token, so it is scanned without that alternative
# (same tokens, one pass less over every word).
NO_EMAIL_PATTERN = f"{URL_PATTERN}|{_JVM_WORD}"


def tokenize(col: Column | str) -> Column:
    """array of upper-cased tokens of a string column (repeats kept, order of text)."""
    c = col if isinstance(col, Column) else F.col(col)
    u = F.upper(c)
    # a text of single bytes holds none of these scripts
    u = F.when(F.octet_length(u) > F.length(u), F.regexp_replace(u, _JVM_SCRIPT, " $1 ")).otherwise(u)
    return F.when(F.instr(c, "@") > 0, F.regexp_extract_all(u, F.lit(_JVM_TOKEN), 0)) \
        .otherwise(F.regexp_extract_all(u, F.lit(NO_EMAIL_PATTERN), 0))


def tokenize_py(text: str | None) -> list[str]:
    """Query-side tokenizer: same grammar, for criteria strings given by the caller."""
    if not text:
        return []
    return _TOKEN_RE.findall(_SCRIPT_RE.sub(r" \1 ", text.upper()))


def octets(col: Column | str) -> Column:
    """length in bytes of the UTF-8 text."""
    return F.octet_length(col if isinstance(col, Column) else F.col(col))


def duckdb_token_sql(expr: str) -> str:
    """The tokenizer as DuckDB SQL (for the oracle): list of upper-cased tokens of ``expr``."""
    pattern = TOKEN_PATTERN.replace("'", "''")
    return f"regexp_extract_all(regexp_replace(replace(upper({expr}), 'ẞ', 'SS'), '{SCRIPT_PATTERN}', ' \\1 ', 'g'), '{pattern}', 0)"
