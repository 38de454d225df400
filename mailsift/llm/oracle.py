"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from mailsift.llm.op1_secrets import LEAST, PATTERNS, ROLES, SCOPE, STRONG


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def secrets_sql() -> str:
    parts = []
    for n, (kind, pattern) in enumerate(PATTERNS.items()):
        value = f"regexp_extract_all(t, {_q(pattern)}, {2 if kind in LEAST else 0})"
        parts.append(f"""
            SELECT rid, {n} AS kind, '{kind}' AS name, '{ROLES[kind]}' AS role, i,
                   length(gaps[i]) + length(alls[i]) AS step, length(alls[i]) AS len, length(vals[i]) >= {LEAST.get(kind, 1)} AS good
            FROM (SELECT rid, string_split_regex(t, {_q(pattern)}) AS gaps, regexp_extract_all(t, {_q(pattern)}, 0) AS alls, {value} AS vals
                  FROM docs), unnest(range(1, len(alls) + 1)) AS u(i)""")
    near = []
    for role in ("identifier", "secret", "endpoint"):
        near.append(f"""
            (coalesce(s - max(CASE WHEN good AND role = '{role}' THEN e END) OVER (PARTITION BY rid ORDER BY s, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {SCOPE}, false)
             OR coalesce(min(CASE WHEN good AND role = '{role}' THEN s END) OVER (PARTITION BY rid ORDER BY s, kind ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - e <= {SCOPE}, false)) AS near_{role}""")
    digest = "coalesce(string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER ({}), '')"
    strong = f"kind < {len(STRONG)}"
    counts = ", ".join(f"count(*) FILTER (name = '{k}') AS n_{k}" for k in STRONG)
    return f"""
        WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
        parts AS ({" UNION ALL ".join(parts)}),
        placed AS (SELECT rid, kind, name, role, good, e - len AS s, e FROM
            (SELECT *, sum(step) OVER (PARTITION BY rid, kind ORDER BY i) AS e FROM parts)),
        linked AS (SELECT *, {", ".join(near)} FROM placed),
        spans AS (SELECT * FROM linked WHERE good AND ({strong} OR CASE role WHEN 'secret' THEN near_identifier OR near_endpoint
            WHEN 'identifier' THEN near_secret ELSE near_identifier AND near_secret END)),
        of_doc AS (SELECT rid, {counts}, sha256({digest.format(strong)}) AS base_sha256, {digest.format("true")} AS spans FROM spans GROUP BY rid)
        SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in STRONG)}, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans
        FROM docs LEFT JOIN of_doc USING (rid)"""


QUALITY_SQL = r"""
    WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    split AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs),
    grams AS (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS g FROM split, unnest(range(1, len(w) - 3)) AS u(i)),
    twice AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1),
    covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, unnest(range(0, 5)) AS u(k) GROUP BY rid),
    base AS (SELECT doc_id, t, len(w)::BIGINT AS n_words, list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
        len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutter, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
        FROM split LEFT JOIN covered USING (rid)),
    judged AS (SELECT *, coalesce(chars, 0) AS word_chars, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 2 * n_upper > word_chars OR word_chars < 2 * n_words
             OR word_chars > 20 * n_words OR 10 * n_stutter > 3 * n_words OR (n_lines >= 6 AND 2 * n_dup_lines > n_lines)) AS kept
    FROM judged"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
DECONTAMINATION_SQL = rf"""
    WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    items AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    windows AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
        FROM items, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS u(i) WHERE len(w) > 0),
    sizes AS (SELECT DISTINCT n FROM windows),
    places AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM docs, sizes, unnest(range(1, len(w) - n + 2)) AS u(i)),
    hits AS (SELECT rid, n, i, item_id FROM places JOIN windows USING (n, win)),
    words AS (SELECT rid, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT rid, n, i FROM hits), unnest(range(0, n)) AS u(k) GROUP BY rid),
    found AS (SELECT rid, count(id) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
        FROM (SELECT DISTINCT rid, item_id::VARCHAR AS id FROM hits) GROUP BY rid)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
        sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM docs LEFT JOIN words USING (rid) LEFT JOIN found USING (rid)"""

ORACLE = {
    "op1_secrets": secrets_sql(),
    "op8_quality": QUALITY_SQL,
    "op9_decontamination": DECONTAMINATION_SQL,
}
