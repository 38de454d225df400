"""Header, address and raw-mail column functions.

All are built-in Spark expressions (regex, split, higher-order array functions), so they run
in the JVM next to the data; none needs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailsift.schema import ADDRESS_FIELDS


def _c(col: Column | str) -> Column:
    return col if isinstance(col, Column) else F.col(col)


# ---------------------------------------------------------------- raw mail <-> header array

def split_raw(raw: Column | str) -> tuple[Column, Column]:
    """Header block and body of a raw message (separated by the first blank line)."""
    r = _c(raw)
    has_split = r.rlike(r"\r?\n\r?\n")
    head = F.when(has_split, F.regexp_extract(r, r"(?s)^(.*?)\r?\n\r?\n", 1)).otherwise(r)
    body = F.when(has_split, F.regexp_extract(r, r"(?s)^.*?\r?\n\r?\n(.*)$", 1)).otherwise(F.lit(""))
    return head, body


def unfold(head: Column | str) -> Column:
    """join folded header lines (a line break followed by blank or tab continues a line)."""
    return F.regexp_replace(_c(head), r"\r?\n([ \t])", "$1")


def header_lines(head: Column | str) -> Column:
    """header block -> ARRAY<STRUCT<name, value>> in order, repeats kept."""
    lines = F.filter(F.split(unfold(head), r"\r?\n"), lambda ln: F.instr(ln, ":") > 0)
    return F.transform(lines, lambda ln: F.struct(
        F.trim(F.substring_index(ln, ":", 1)).alias("name"),
        F.regexp_extract(ln, r"(?s)^[^:]*:[ \t]*(.*)$", 1).alias("value"),
    ))


def render_raw(headers: Column | str, body: Column | str) -> Column:
    """``name: value`` lines joined by CRLF, a blank line, then the body."""
    lines = F.transform(_c(headers), lambda h: F.concat(h["name"], F.lit(": "), h["value"]))
    return F.concat(F.array_join(lines, "\r\n"), F.lit("\r\n\r\n"), F.coalesce(_c(body), F.lit("")))


# ---------------------------------------------------------------- routing

def header_field(name: Column | str) -> Column:
    """Header name -> index field, ignoring case; unknown names -> PREFIX_HEADER."""
    n = F.upper(_c(name))
    expr = F.when(n == "SUBJECT", F.lit("BASE_SUBJECT"))
    for field in ADDRESS_FIELDS:
        expr = expr.when(n == field, F.lit(field))
    return expr.otherwise(F.lit("PREFIX_HEADER"))


def header_field_py(name: str) -> str:
    """C6 on the query side (a header name given by the caller)."""
    n = (name or "").upper()
    if n in ADDRESS_FIELDS:
        return n
    if n == "SUBJECT":
        return "BASE_SUBJECT"
    return "PREFIX_HEADER"


def header_values(headers: Column | str, name: str) -> Column:
    """Values of every header called ``name`` (case-insensitive), in order."""
    target = name.upper()
    return F.transform(F.filter(_c(headers), lambda h: F.upper(h["name"]) == target),
                       lambda h: h["value"])


def first_header_value(headers: Column | str, name: str) -> Column:
    return F.get(header_values(headers, name), 0)


# ---------------------------------------------------------------- addresses

# A group opener is ``display-name:`` (no quote, bracket, comma, ``@`` or ``;``).
_GROUP_OPEN = r'(^|,)[ \t]*[^:;,<>"@]+:'
_GROUP = r'(?<![^:;,<>"@])[^:;,<>"@]++:([^;]*);'
_ENTRY = r'(?:"[^"]*+"|<[^>]*+>|[^,"<>]++)++'


# Characters that change the state of the comment scan, escapes, and runs between them.
_LEX = r'''\\.|["()<>\\]|[^"()<>\\]++'''


def _comment(depth: int) -> str:
    """A comment with comments inside, so many levels deep."""
    inner = r"\\.|[^()\\]++" + (f"|{_comment(depth - 1)}" if depth else "")
    return rf"\((?:{inner})*+\)"


# A quoted string or an angle address (kept), or a comment of a few levels (dropped).
_KEEP_OR_COMMENT = r'''("(?:\\.|[^"\\])*+"|<[^<>]*+>)|''' + _comment(3)


def strip_comments(value: Column) -> Column:
    """An address header without its comments, which may nest and hold commas, colons or quotes; parentheses in
    quotes and in angle brackets are no comments. A value whose comment never ends is left as it is.

    One pattern drops the comments of a few levels in linear time. Where parentheses are left, a fold over the lexical
    parts goes on, with the states quoted, in angle brackets and depth of comment."""
    start = F.struct(F.lit(False).alias("quoted"), F.lit(False).alias("angle"), F.lit(0).alias("depth"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        quoted, angle, depth = acc["quoted"], acc["angle"], acc["depth"]
        plain = ~quoted & ~angle & (depth == 0)
        inside = depth > 0
        deeper = F.when(inside & (t == "("), depth + 1).when(inside & (t == ")"), depth - 1).when(plain & (t == "("), 1).otherwise(depth)
        return F.struct(
            F.when(inside, False).when(t == '"', ~quoted & ~angle).otherwise(quoted).alias("quoted"),
            F.when(inside | quoted, angle).when(t == "<", True).when(t == ">", False).otherwise(angle).alias("angle"),
            deeper.alias("depth"),
            F.when(inside | (plain & (t == "(")), acc["out"]).otherwise(F.concat(acc["out"], F.array(t))).alias("out"))

    plain = F.regexp_replace(value, _KEEP_OR_COMMENT, "$1")
    end = lambda acc: F.when(acc["depth"] == 0, F.array_join(acc["out"], ""))
    return F.when(F.instr(value, "(") == 0, value).when(F.instr(plain, "(") == 0, plain) \
        .otherwise(F.coalesce(F.aggregate(F.regexp_extract_all(plain, F.lit(_LEX), 0), start, step, end), value))


def _parse_entry(entry: Column) -> Column:
    has_angle = F.instr(entry, "<") > 0
    address = F.when(has_angle, F.regexp_extract(entry, r"<([^>]*)>", 1)).otherwise(F.trim(entry))
    display = F.when(has_angle, F.trim(F.regexp_replace(
        F.regexp_extract(entry, r"^([^<]*)<", 1), r'"', ""))).otherwise(F.lit(""))
    return F.struct(F.trim(display).alias("display"), F.trim(address).alias("address"))


def parse_addresses(value: Column | str) -> Column:
    """F8: lenient address list -> ARRAY<STRUCT<display, address>>.

    Group syntax ``name: a, b;`` is flattened in place (its members become entries), so the
    first entry is the first mailbox whether or not it sits in a group.
    """
    v = strip_comments(F.coalesce(_c(value), F.lit("")))
    flat = F.regexp_replace(F.regexp_replace(v, _GROUP_OPEN, "$1"), ";", ",")
    entries = F.filter(F.transform(F.regexp_extract_all(flat, F.lit(_ENTRY), 0), F.trim),
                       lambda e: e != "")
    return F.filter(F.transform(entries, _parse_entry), lambda a: a["address"] != "")


def encode_address(addr: Column) -> Column:
    """``display <address>``, or the bare address when there is no display name."""
    return F.when(addr["display"] != "", F.concat(addr["display"], F.lit(" <"), addr["address"], F.lit(">"))) \
        .otherwise(addr["address"])


def group_members(value: Column | str) -> Column:
    """encoded members of every group in an address header, upper-cased, one term each."""
    v = strip_comments(F.coalesce(_c(value), F.lit("")))
    lists = F.regexp_extract_all(v, F.lit(_GROUP), 1)
    members = F.flatten(F.transform(lists, lambda lst: F.regexp_extract_all(lst, F.lit(_ENTRY), 0)))
    parsed = F.transform(F.filter(F.transform(members, F.trim), lambda m: m != ""), _parse_entry)
    return F.transform(F.filter(parsed, lambda a: a["address"] != ""), lambda a: F.upper(encode_address(a)))


def first_entry(headers: Column | str, name: str) -> Column:
    """First parsed address (STRUCT<display, address>) of the first ``name`` header."""
    return F.get(parse_addresses(first_header_value(headers, name)), 0)


def local_part(addr: Column) -> Column:
    """F10 on a parsed address: the part before ``@``."""
    return F.substring_index(addr["address"], "@", 1)


def display_or_local(addr: Column) -> Column:
    """F11 on a parsed address: its display name, or its local part when there is none."""
    return F.when(addr["display"] != "", addr["display"]).otherwise(local_part(addr))


def first_address(headers: Column | str, name: str) -> Column:
    """local part of the first address of the first ``name`` header."""
    return local_part(first_entry(headers, name))


def first_display(headers: Column | str, name: str) -> Column:
    """display name of the first address (its local part when there is none)."""
    return display_or_local(first_entry(headers, name))


# ---------------------------------------------------------------- subject and date

# RFC 5256 base-subject rules (reply/forward leaders, "(fwd)" trailer, [fwd: ...]).
_SUBJ_TRAILER = r"(?i)(?:[ \t]|\(fwd\))++$"
# A blob goes only if something stays after it. The possessive group takes any number of leaders.
_SUBJ_LEADER = (r"(?i)^(?:[ \t]*(?:re|fwd?)[ \t]*(?:\[[^\]]*+\])?[ \t]*:[ \t]*|[ \t]*\[fwd:[ \t]*"
                r"|[ \t]*\[(?!fwd:)[^\]]*+\][ \t]*(?=[^ \t\]]))++")
_SUBJ_FWD_OPEN = r"(?i)\[fwd:"
_SUBJ_END = r"(?i)(?:[ \t]|\(fwd\)|\])++$"


def base_subject(subject: Column | str) -> Column:
    """subject without reply/forward marks, white space collapsed, upper-cased."""
    s = F.regexp_replace(F.regexp_replace(_c(subject), r"[\r\n]+", ""), r"[ \t]+", " ")
    s = F.regexp_replace(s, _SUBJ_TRAILER, "")
    lead = F.regexp_extract(s, _SUBJ_LEADER, 0)
    rest = F.substring(s, F.length(lead) + 1, F.length(s))
    # each [fwd: that was opened takes one closing bracket with it, nested however deep
    opened = F.size(F.regexp_extract_all(lead, F.lit(_SUBJ_FWD_OPEN), 0))
    end = F.regexp_extract(rest, _SUBJ_END, 0)
    closing = F.length(end) - F.length(F.translate(end, "]", ""))
    inner = F.concat(F.regexp_replace(rest, _SUBJ_END, ""), F.repeat(F.lit("]"), F.greatest(closing - opened, F.lit(0))))
    return F.upper(F.trim(F.regexp_replace(F.when(opened > 0, inner).otherwise(rest), _SUBJ_TRAILER, "")))


# Minutes east of UTC of the zone names of RFC 5322; other names count as UTC.
_ZONES = {"EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420}
_DATE = r"(\d{1,2})[ \t]++([A-Za-z]{3})[ \t]++(\d{4}|\d{2})[ \t]++(\d{1,2}):(\d{2})(?::(\d{2}))?(?:[ \t]++([+-]\d{4}|[A-Za-z]{1,5}))?"


def header_date(headers: Column | str) -> Column:
    """Date header as UTC wall clock; NULL when absent or invalid.

    Weekday and comments are ignored; seconds and zone may be missing (0, UTC); a two-digit year
    is 1950-2049. The session's time zone plays no part: the wall clock is read without a zone
    and moved by the header's own offset.
    """
    v = first_header_value(headers, "Date")
    part = [F.regexp_extract(v, _DATE, k) for k in range(8)]
    year = F.when(F.length(part[3]) == 4, part[3]).when(part[3] < "50", F.concat(F.lit("20"), part[3])).otherwise(F.concat(F.lit("19"), part[3]))
    seconds = F.when(part[6] == "", F.lit("00")).otherwise(part[6])
    month = F.initcap(part[2])
    wall = F.concat(part[1], F.lit(" "), month, F.lit(" "), year, F.lit(" "), part[4], F.lit(":"), part[5], F.lit(":"), seconds)
    clock = F.try_to_timestamp(F.when(part[0] != "", wall), F.lit("d MMM yyyy H:mm:ss")).cast("timestamp_ntz")
    number = F.substring(part[7], 2, 2).try_cast("int") * 60 + F.substring(part[7], 4, 2).try_cast("int")
    east = F.when(part[7].startswith("+"), number).when(part[7].startswith("-"), -number)
    for name, minutes in _ZONES.items():
        east = east.when(F.upper(part[7]) == name, F.lit(minutes))
    return clock - F.make_dt_interval(F.lit(0), F.lit(0), east.otherwise(F.lit(0)))
