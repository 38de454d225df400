"""Operator 1: secret scan with multipart credential linking, in DataFrame functions only.

Strong kinds (``assign``, ``access``, ``hex``) are found by their patterns and always reported.
Weak kinds are parts of a credential: an identifier (``user``), a secret (``pass``) or an
endpoint (``url``, ``host``); ``url_user`` and ``url_pass`` are the parts inside a URL, so one that
holds all three is reported on its own. The values of ``user`` and ``pass`` run to a quote or white
space. They are reported only where complementary parts co-occur: the parts are
intervals of the text, joined with the other parts of the same document that lie within
``SCOPE`` code points. A weak secret needs an identifier or an endpoint there, an identifier
needs a secret, an endpoint needs both. Strong kinds count as parts too.

The interval join is a merge: per document, in order of position, the nearest part of each role
before and after. Parts are sorted by a row number of the scan, so a task never holds more than
its share of parts and no pair of parts is ever emitted. Only lengths of matches and gaps are
shuffled, no text (``redact`` sends a text along once).

Null text: as empty, no spans. Null and repeated ids, repeated rows: a row each. An empty table
gives no rows. ``find_secrets`` returns the asked columns beside its own ``_s_spans``; ``redact``
carries all columns of a row in one, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailsift.llm.common import table

SCOPE = 200
REDACTED = "[REDACTED]"


def _either(words: str) -> str:
    """Letters in either case, spelled out (alike in every regex dialect)."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


# The patterns of the strong and the weak kinds.
_SIGN = r"""["']?\x20*[:=]\x20*["']?"""
_VALUE = r"""([^\x20\x09-\x0D"']+)"""
PATTERNS = {
    "assign": "(" + "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key"))) + ")" + _SIGN + "([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]{12,}",
    "hex": "[0-9a-f]{32,}",
    "user": "(" + "|".join(map(_either, ("username", "user", "login", "account", "client_?id"))) + ")" + _SIGN + _VALUE,
    "pass": "(" + "|".join(map(_either, ("pwd", "passphrase", "credential", "private_?key", "access_?key"))) + ")" + _SIGN + _VALUE,
    "url": r"""(?:https?|s?ftps?|ssh|ldaps?|jdbc|postgres(?:ql)?|mysql|mariadb|sqlserver|mongodb(?:[+]srv)?|rediss?|amqps?|s3)://[A-Za-z0-9:%_][^\x20\x09-\x0D"'<>]*""",
    "host": "(" + "|".join(map(_either, ("hostname", "host", "server", "endpoint"))) + ")" + _SIGN + "([A-Za-z0-9][A-Za-z0-9._:/-]*)",
    "url_user": r"""(://)([^\x20\x09-\x0D"'<>:@/]+):[^\x20\x09-\x0D"'<>@/]+@""",
    "url_pass": r"""(://[^\x20\x09-\x0D"'<>:@/]*:)([^\x20\x09-\x0D"'<>@/]+)@""",
}
STRONG = ("assign", "access", "hex")
#: Least length of the second group, where there is one.
LEAST = {"assign": 8, "user": 3, "pass": 4, "host": 3, "url_user": 1, "url_pass": 1}
ROLES = {"assign": "secret", "hex": "secret", "pass": "secret", "access": "identifier", "user": "identifier", "url": "endpoint",
         "host": "endpoint", "url_user": "identifier", "url_pass": "secret"}


def matches(text: Column, number: int, kind: str) -> Column:
    """Struct (kind, i, gap, length, good) of every match: the gap to the last match, in code points."""
    pattern = PATTERNS[kind]
    value = F.regexp_extract_all(text, F.lit(pattern), 2 if kind in LEAST else 0)
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("all"), value.alias("value"))
    rows = F.transform(zipped, lambda x, i: F.struct(
        F.lit(number).alias("kind"), i.alias("i"), F.char_length(x["gap"]).cast("long").alias("gap"),
        F.char_length(x["all"]).cast("long").alias("length"), (F.char_length(x["value"]) >= LEAST.get(kind, 1)).alias("good")))
    found = F.filter(rows, lambda x: x["length"].isNotNull())  # the text after the last match
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:bigint,length:bigint,good:boolean>>"))


def _near(role: str, in_order: Window) -> Column:
    """Whether a part of the role lies within the scope of the row's part, before or after it."""
    before = F.max(F.when(F.col("_s_role") == role, F.col("_s_end"))).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(F.col("_s_role") == role, F.col("_s_start"))).over(in_order.rowsBetween(1, Window.unboundedFollowing))
    return F.coalesce(F.col("_s_start") - before <= SCOPE, F.lit(False)) | F.coalesce(after - F.col("_s_end") <= SCOPE, F.lit(False))


def find_secrets(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of every row, and ``_s_spans``: array of (start, kind number, end)
    in order, kinds numbered as in ``PATTERNS``."""
    kinds = list(PATTERNS)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("_s_row"), F.struct(*keep).alias("_s_kept"), text.alias("_s_text"))
    rows = rows.select("_s_row", "_s_kept", F.concat(*[matches(F.col("_s_text"), n, k) for n, k in enumerate(kinds)]).alias("_s_found"))
    parts = rows.select("_s_row", "_s_kept", F.posexplode_outer("_s_found").alias("_s_at", "_s_part"))
    # the kept columns travel once, with the first part
    parts = parts.select("_s_row", F.when(F.coalesce("_s_at", F.lit(0)) == 0, F.col("_s_kept")).alias("_s_kept"), "_s_part.*").repartition("_s_row")
    of_kind = Window.partitionBy("_s_row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = parts.withColumn("_s_end", F.sum(F.col("gap") + F.col("length")).over(of_kind))
    role = F.element_at(F.create_map(*[F.lit(x) for n, k in enumerate(kinds) for x in (n, ROLES[k])]), F.col("kind"))
    placed = placed.withColumn("_s_start", F.col("_s_end") - F.col("length")).withColumn("_s_role", F.when(F.col("good"), role))
    in_order = Window.partitionBy("_s_row").orderBy("_s_start", "kind")
    near = {r: _near(r, in_order) for r in ("identifier", "secret", "endpoint")}
    linked = placed.select("*", *[c.alias(f"_s_{r}") for r, c in near.items()])
    strong = F.col("kind") < len(STRONG)
    needs = F.when(F.col("_s_role") == "secret", F.col("_s_identifier") | F.col("_s_endpoint")) \
        .when(F.col("_s_role") == "identifier", F.col("_s_secret")).otherwise(F.col("_s_identifier") & F.col("_s_secret"))
    span = F.when(F.col("good") & (strong | needs), F.struct(F.col("_s_start").alias("start"), F.col("kind").alias("kind"), F.col("_s_end").alias("end")))
    return linked.groupBy("_s_row").agg(F.first("_s_kept", ignorenulls=True).alias("_s_kept"), F.sort_array(F.collect_list(span)).alias("_s_spans")) \
        .select(*[F.col("_s_kept")[c].alias(c) for c in keep], "_s_spans")


def digest(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, PATTERNS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every reported span of the text replaced by ``REDACTED``; overlapping spans
    are one. Texts without spans stay as they are, null too."""
    found = find_secrets(docs.select(F.struct("*").alias("_s_doc")), ["_s_doc"], f"_s_doc.`{text_col}`")
    spans = F.col("_s_spans")
    text = F.col("_s_doc")[text_col]
    # reach: where the spans before each one end; a span inside them adds nothing
    reach = F.aggregate(spans, F.array(F.lit(0).cast("long")), lambda acc, s: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), s["end"]))))
    found = found.withColumn("_s_reach", reach)
    pieces = F.transform(spans, lambda s, i: F.when(s["start"] >= F.get(F.col("_s_reach"), i), F.concat(
        text.substr((F.get(F.col("_s_reach"), i) + 1).cast("int"), (s["start"] - F.get(F.col("_s_reach"), i)).cast("int")), F.lit(REDACTED))).otherwise(""))
    rest = text.substr((F.element_at("_s_reach", -1) + 1).cast("int"), F.char_length(text))
    clean = F.when(F.size(spans) > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(text)
    return found.select(*[(clean if c == text_col else F.col("_s_doc")[c]).alias(c) for c in docs.columns])


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"), ["doc_id"])
    base = F.filter("_s_spans", lambda s: s["kind"] < len(STRONG))
    count = lambda n: F.size(F.filter("_s_spans", lambda s: s["kind"] == n)).cast("long")
    return found.select("doc_id", *[count(n).alias(f"n_{k}") for n, k in enumerate(STRONG)],
                        F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("_s_spans")).alias("spans"))
