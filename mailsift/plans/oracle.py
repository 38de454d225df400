"""DuckDB SQL building blocks for the oracle twins of the registered queries.

They restate the adapter views and the index build in plain SQL over the driver's tables, so
every oracle query is self-contained (only the pre-registered table views are assumed).
"""

from __future__ import annotations

from mailsift.functions.text import duckdb_token_sql


def tok(expr: str) -> str:
    return duckdb_token_sql(expr)


DOC_POSTINGS = f"""doc_postings AS (
  SELECT DISTINCT mailbox_id, 'BODY' AS field, term, uid FROM (
    SELECT source AS mailbox_id, doc_id AS uid, unnest({tok('text')}) AS term FROM documents))"""

DOC_STATE = r"""doc_state AS (
  SELECT d.source AS mailbox_id, d.doc_id AS uid, d.n_chars AS size,
         concat_ws(' ', CASE WHEN l.toxic = 1 THEN '\DELETED' END,
                        CASE WHEN l.quality = 1 THEN '\FLAGGED' END) AS flags
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

CONV_H = """conv_h AS (
  SELECT CAST(conv_id AS VARCHAR) AS mailbox_id, turn AS uid, text, role, conv_id,
         role || ' <' || role || '@example.org>' AS h_from,
         'Re: Conversation ' || CAST(conv_id AS VARCHAR) AS h_subject,
         CASE WHEN turn % 2 = 1 THEN 'desk <desk@example.org>, audit <audit@example.org>' END AS h_cc
  FROM conversations)"""

CONV_TEXTS = """conv_texts AS (
  SELECT mailbox_id, uid, 'BODY' AS field, text AS t FROM conv_h
  UNION ALL SELECT mailbox_id, uid, 'HEADERS', 'From: ' || h_from FROM conv_h
  UNION ALL SELECT mailbox_id, uid, 'HEADERS', 'Subject: ' || h_subject FROM conv_h
  UNION ALL SELECT mailbox_id, uid, 'HEADERS', 'Cc: ' || h_cc FROM conv_h WHERE h_cc IS NOT NULL
  UNION ALL SELECT mailbox_id, uid, 'PREFIX_HEADER', h_from FROM conv_h
  UNION ALL SELECT mailbox_id, uid, 'PREFIX_HEADER', h_subject FROM conv_h
  UNION ALL SELECT mailbox_id, uid, 'PREFIX_HEADER', h_cc FROM conv_h WHERE h_cc IS NOT NULL
  UNION ALL SELECT mailbox_id, uid, 'FROM', h_from FROM conv_h
  UNION ALL SELECT mailbox_id, uid, 'BASE_SUBJECT', h_subject FROM conv_h
  UNION ALL SELECT mailbox_id, uid, 'CC', h_cc FROM conv_h WHERE h_cc IS NOT NULL)"""

CONV_POSTINGS = f"""{CONV_H},
{CONV_TEXTS},
conv_postings AS (
  SELECT DISTINCT mailbox_id, field, term, uid FROM (
    SELECT mailbox_id, uid, field, unnest({tok('t')}) AS term FROM conv_texts))"""

ORD_STATE = r"""ord_state AS (
  SELECT CAST(o_custkey AS VARCHAR) AS mailbox_id, o_orderkey AS uid, o_orderdate AS internal_date,
         concat_ws(' ', CASE WHEN o_orderstatus = 'O' THEN '\FLAGGED' END,
                        CASE WHEN o_orderstatus = 'F' THEN '\SEEN' END,
                        upper(split_part(o_orderpriority, '-', 2))) AS flags,
         o_orderpriority
  FROM orders)"""

CHANGES = r"""chg AS (
  SELECT event_id AS seq, ts, CAST(user_id AS VARCHAR) AS mailbox_id,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS uid,
         CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'delete' ELSE 'flags' END AS op,
         CASE event_type WHEN 'click' THEN '\SEEN' WHEN 'view' THEN '\ANSWERED'
                         WHEN 'purchase' THEN '\FLAGGED' ELSE '' END AS flags
  FROM events),
fold AS (
  SELECT mailbox_id, uid, max_by(flags, seq) AS flags, max(seq) AS flags_seq,
         max(CASE WHEN op = 'add' THEN seq END) AS last_add,
         max(CASE WHEN op = 'delete' THEN seq END) AS last_delete
  FROM chg GROUP BY mailbox_id, uid)"""

LIVE = "last_add > coalesce(last_delete, -1)"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
