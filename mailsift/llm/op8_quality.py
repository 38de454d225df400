"""Operator 8: quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a test on a few derived columns. In one job over a sample the cascade counts each rule's rejections
and estimates its cost: the work of its derived columns (``WORK``, rough nanoseconds for each character, word and line, set
by hand) times the sample's characters, words and lines. Timing the rules anew in each run would give another order each time. It then applies the rules to all rows by
rejections per cost, best first, ties by name; a rule that rejects nothing comes last. The sample is about ``SAMPLE`` rows by hash
from all over the table, texts of any length among them, written once to the shared folder. A rule's columns are computed only for
rows that no earlier rule has rejected. The order changes the work, never the verdict: a row is
kept if no rule rejects it.

Null or empty text: no words, rejected by ``few_words``. Repeated rows and ids: judged row by
row. An empty table gives no rows; the rules are then in order of their names. All columns of a
row travel in one, so none of their names can clash with a derived column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.llm.common import staged, table

SAMPLE = 1000
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
P = "_q_"


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def removed(text: Column, characters: str) -> Column:
    """Number of characters of the text that are among the given ones."""
    return F.char_length(text) - F.char_length(F.translate(text, characters, ""))


def windows(w: Column, n: Column) -> Column:
    """Hashes of the 5-word windows (64 bits: within one text two windows are as good as never alike)."""
    hashed = F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)]))
    return F.when(n >= 5, hashed).otherwise(F.array().cast("array<long>"))


def by_hash(h: Column) -> Column:
    """(hash, place) of all windows, by hash; null if no window occurs twice."""
    return F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i")))))


def repeated(s: Column) -> Column:
    """Places, in order, of the windows that are equal to a neighbour in hash order."""
    same = lambda a, b: F.get(s, a)["x"] == F.get(s, b)["x"]
    at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)))
    return F.when(s.isNotNull(), F.sort_array(F.transform(at, lambda k: F.get(s, k)["i"])))


def covered(p: Column) -> Column:
    """Words inside windows that begin at the given places."""
    steps = F.when(F.size(p) > 1, F.sequence(F.lit(1), F.size(p) - 1)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(steps, F.lit(5), lambda acc, k: acc + F.least(F.lit(5), F.get(p, k) - F.get(p, k - 1)))
    return F.when(p.isNotNull() & (F.size(p) > 0), total).otherwise(0).cast("long")


def stutter(w: Column, n: Column) -> Column:
    """Words that are equal to the word before them."""
    at = F.filter(F.sequence(F.lit(1), n - 1), lambda i: F.get(w, i) == F.get(w, i - 1))
    return F.when(n > 1, F.size(at)).otherwise(0).cast("long")


def _c(name: str) -> Column:
    return F.col(P + name)


#: Derived columns in an order in which each needs only earlier ones.
FEATURES: dict[str, tuple[tuple[str, ...], callable]] = {
    "words": ((), lambda: words(_c("text"))),
    "n_words": (("words",), lambda: F.size(_c("words")).cast("long")),
    "word_chars": ((), lambda: F.char_length(F.translate(_c("text"), SPACE, "")).cast("long")),
    "n_symbols": ((), lambda: removed(_c("text"), SYMBOLS).cast("long")),
    "n_upper": ((), lambda: removed(_c("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long")),
    "lines": ((), lambda: F.filter(F.split(_c("text"), "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")),
    "n_lines": (("lines",), lambda: F.size(_c("lines")).cast("long")),
    "n_dup_lines": (("lines",), lambda: (F.size(_c("lines")) - F.size(F.array_distinct(_c("lines")))).cast("long")),
    "n_stutter": (("words", "n_words"), lambda: stutter(_c("words"), _c("n_words").cast("int"))),
    "windows": (("words", "n_words"), lambda: windows(_c("words"), _c("n_words").cast("int"))),
    "by_hash": (("windows",), lambda: by_hash(_c("windows"))),
    "repeated": (("by_hash",), lambda: repeated(_c("by_hash"))),
    "n_repeat_words": (("repeated",), lambda: covered(_c("repeated"))),
}


#: Nanoseconds for each character, word and line of a text to derive a column from those that it needs: rough figures set by hand.
WORK: dict[str, tuple[int, int, int]] = {
    "words": (10, 20, 0), "n_words": (0, 0, 0), "word_chars": (6, 0, 0), "n_symbols": (6, 0, 0), "n_upper": (6, 0, 0), "lines": (4, 0, 60), "n_lines": (0, 0, 0),
    "n_dup_lines": (0, 0, 80), "n_stutter": (0, 60, 0), "windows": (0, 160, 0), "by_hash": (0, 250, 0), "repeated": (0, 10, 0), "n_repeat_words": (0, 5, 0),
}


def all_needs(names: tuple[str, ...]) -> set[str]:
    """The derived columns and what they need, all the way down."""
    return set(names).union(*[all_needs(FEATURES[x][0]) for x in names])


@dataclass(frozen=True)
class Rule:
    """Rejects a row if ``test`` (SQL over the derived columns it needs) is true."""

    name: str
    needs: tuple[str, ...]
    test: str


BASE = (
    Rule("few_words", ("n_words",), "_q_n_words < 10"),
    Rule("repeats", ("n_words", "n_repeat_words"), "100 * _q_n_repeat_words > 20 * _q_n_words"),
)
RULES = BASE + (
    Rule("symbols", ("n_words", "n_symbols"), "10 * _q_n_symbols > 3 * _q_n_words"),
    Rule("shouting", ("word_chars", "n_upper"), "2 * _q_n_upper > _q_word_chars"),
    Rule("word_length", ("n_words", "word_chars"), "_q_word_chars < 2 * _q_n_words or _q_word_chars > 20 * _q_n_words"),
    Rule("stutter", ("n_words", "n_stutter"), "10 * _q_n_stutter > 3 * _q_n_words"),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), "_q_n_lines >= 6 and 2 * _q_n_dup_lines > _q_n_lines"),
)


def derive(df: DataFrame, needs: tuple[str, ...], guard: Column | None = None) -> DataFrame:
    """``df`` with the named derived columns and those that they need, where ``guard`` holds."""
    for name in needs:
        if P + name not in df.columns:
            before, expr = FEATURES[name]
            df = derive(df, before, guard)
            df = df.withColumn(P + name, expr() if guard is None else F.when(guard, expr()))
    return df


def with_text(docs: DataFrame, text_col: str) -> DataFrame:
    """All columns in one, out of the way of the derived ones, and the text."""
    return docs.select(F.struct("*").alias(P + "kept"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(P + "text"))


def _kept(columns: list[str]) -> list[Column]:
    return [_c("kept")[c].alias(c) for c in columns]


def order_rules(docs: DataFrame, rules: tuple[Rule, ...], text_col: str = "text", sample: int = SAMPLE) -> list[Rule]:
    """The rules by rejections per cost, measured on about ``sample`` rows."""
    share = max(1, docs.count() // sample)
    some = staged(docs.where(F.pmod(F.xxhash64(*docs.columns), F.lit(share)) == 0).select(F.col(text_col).cast("string").alias("text")), "sample")
    if some.isEmpty():
        return sorted(rules, key=lambda r: r.name)
    some = with_text(some, "text")
    for name in ("n_words", "n_lines"):
        some = derive(some, (name,))
    for r in rules:
        some = derive(some, r.needs)
    found = some.agg(*[F.sum(F.expr(r.test).cast("int")) for r in rules], F.sum(F.char_length(_c("text"))), F.sum(_c("n_words")), F.sum(_c("n_lines"))).first()
    sizes = [n or 0 for n in found[len(rules):]]
    cost = {r.name: 1 + sum(w * n for x in all_needs(r.needs) for w, n in zip(WORK[x], sizes)) for r in rules}
    gain = {r.name: (found[i] or 0) / cost[r.name] for i, r in enumerate(rules)}
    return sorted(rules, key=lambda r: (-gain[r.name], r.name))


def cascade(docs: DataFrame, rules: list[Rule], text_col: str = "text", out: str = "rejected_by") -> DataFrame:
    """``_q_kept`` (all columns of the row) and the name of the first rule that rejects it, null if
    none does.

    Columns are derived once for the rows that some rule still needs them for.
    """
    df = with_text(docs, text_col).withColumn(P + "verdict", F.lit(None).cast("string"))
    for k, rule in enumerate(rules):
        # what an earlier rule has derived is null for rows that were rejected before it
        df = derive(df, rule.needs, _c("verdict").isNull() if k else None)
        df = df.withColumn(P + "verdict", F.when(_c("verdict").isNotNull(), _c("verdict")).when(F.expr(rule.test), rule.name))
    return df.select(P + "kept", _c("verdict").alias(out))


def filter_quality(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects.

    The row number keeps the optimizer from pushing the test below the cascade: there it would
    put every derived column in place of its name, again and again, and compute each many times.
    """
    judged = cascade(docs, order_rules(docs, rules, text_col), text_col, P + "out").withColumn(P + "row", F.monotonically_increasing_id())
    return judged.where(F.col(P + "out").isNull() & (F.col(P + "row") >= 0)).select(*_kept(docs.columns))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All base columns of every document are asked for here, so the cascade is over the other rules."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    base = derive(with_text(docs, "text"), ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    failed = F.expr(" or ".join(f"({r.test})" for r in BASE))
    df = base.withColumn(P + "base_failed", failed).withColumn(P + "verdict", F.when(_c("base_failed"), "base"))
    for rule in order_rules(docs, RULES[len(BASE):]):
        df = derive(df, rule.needs, _c("verdict").isNull())
        df = df.withColumn(P + "verdict", F.when(_c("verdict").isNotNull(), _c("verdict")).when(F.expr(rule.test), rule.name))
    return df.select(*_kept(["doc_id"]), *[_c(c).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")],
                     _c("verdict").isNull().alias("kept"))
