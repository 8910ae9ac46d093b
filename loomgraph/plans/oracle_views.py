"""DuckDB statements of the input views, written apart from the Spark ones.

``oracle(sql)`` puts the views a query mentions in front of it as common table expressions.
"""

from __future__ import annotations

import re

NOW = "TIMESTAMP '2024-06-01 00:00:00'"


def hashed(expr: str) -> str:
    return f"CAST('0x' || substr(md5(CAST({expr} AS VARCHAR)), 1, 8) AS BIGINT)"


VIEWS: dict[str, str] = {}

VIEWS["v_doc"] = """
SELECT doc_id, source AS space,
  (CASE WHEN doc_id % 97 = 0 THEN '20261345 '
        WHEN doc_id % 3 = 0 THEN '202401' || lpad(CAST(1 + doc_id % 31 AS VARCHAR), 2, '0') || ' '
        ELSE '' END) || 'doc-' || doc_id AS title,
  doc_id % 25 AS owner_id,
  CASE doc_id % 5 WHEN 0 THEN 'DRAFT' WHEN 1 THEN 'STALE' WHEN 2 THEN 'ARCHIVED' ELSE 'ACTIVE' END AS status,
  TIMESTAMP '2023-10-01 00:00:00' + to_days(CAST(doc_id % 180 AS INTEGER)) AS created_at,
  CASE WHEN doc_id % 4 = 0 THEN NULL
       ELSE TIMESTAMP '2023-10-01 00:00:00' + to_days(CAST(doc_id % 180 + doc_id % 90 AS INTEGER)) END AS verified_at,
  90 AS ttl_days, lang, text
FROM documents"""

VIEWS["v_owner"] = """
SELECT CAST(n_nationkey AS BIGINT) AS owner_id, n_name AS owner_name,
  CASE WHEN n_nationkey % 4 = 0 THEN ' ' ELSE 'U' || n_nationkey END AS chat_id
FROM nation"""

VIEWS["v_block"] = """
SELECT doc_id, position,
  CASE WHEN position % 9 = 0 AND doc_id % 2 = 0 THEN 'HEADING1'
       WHEN position % 9 IN (0, 3) THEN 'HEADING2'
       WHEN position % 9 = 6 THEN 'HEADING3' ELSE 'PARAGRAPH' END AS type,
  line
FROM (SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS position, unnest(l) AS line
      FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""

# slots as ordered scans: last level-1 heading, else first level-2 heading; last level-2 after it
VIEWS["v_section_row"] = """
SELECT *, count(CASE WHEN type LIKE 'HEADING%' THEN 1 END) OVER w AS section,
  max(CASE WHEN type = 'HEADING1' THEN position END) OVER w AS p1,
  max(CASE WHEN type = 'HEADING2' THEN position END) OVER w AS p2,
  min(CASE WHEN type = 'HEADING2' THEN position END) OVER w AS f2
FROM v_block WINDOW w AS (PARTITION BY doc_id ORDER BY position ROWS UNBOUNDED PRECEDING)"""

VIEWS["v_section"] = """
SELECT s.doc_id, s.section,
  d.title || coalesce(' > ' || a.line, '') || coalesce(' > ' || b.line, '') AS heading_path, s.text
FROM (SELECT doc_id, section, coalesce(any_value(p1), any_value(f2)) AS s1, any_value(p2) AS p2,
        string_agg(line, chr(10) ORDER BY position) AS text
      FROM v_section_row WHERE type NOT LIKE 'HEADING%' AND trim(line) <> '' GROUP BY ALL) s
JOIN v_doc d ON d.doc_id = s.doc_id
LEFT JOIN v_block a ON a.doc_id = s.doc_id AND a.position = s.s1
LEFT JOIN v_block b ON b.doc_id = s.doc_id AND b.position = s.p2 AND s.p2 > s.s1"""

VIEWS["v_chunk"] = """
SELECT c.*, doc_id || '/' || ordinal AS chunk_id, CASE WHEN ordinal = 1 THEN e.embedding END AS embedding
FROM (SELECT doc_id, section, heading_path, substr(text, CAST(start AS BIGINT), 1500) AS text,
        row_number() OVER (PARTITION BY doc_id ORDER BY section, start) AS ordinal
      FROM (SELECT *, unnest(range(1, length(text) + 1, 1500)) AS start FROM v_section)) c
LEFT JOIN embeddings e ON e.vec_id = c.doc_id"""

VIEWS["v_chunk_old"] = """
SELECT doc_id, ordinal,
  CASE WHEN doc_id % 6 = 1 THEN 'old > ' || heading_path ELSE heading_path END AS heading_path,
  CASE WHEN doc_id % 6 = 2 AND ordinal = 1 THEN text || '!' ELSE text END AS text,
  NOT (doc_id % 6 = 3 AND ordinal = 1) AS has_embedding
FROM v_chunk"""

VIEWS["v_query"] = r"""
SELECT item_id AS qid, array_to_string(list_slice(string_split_regex(text, '\s+'), 5, 10), ' ') AS q
FROM benchmark"""

VIEWS["v_qvec"] = """
SELECT item_id AS qid, embedding AS qvec FROM benchmark JOIN embeddings ON vec_id = item_id"""

VIEWS["v_gold"] = r"""
SELECT DISTINCT qid, doc_id FROM v_query,
  (SELECT doc_id, ' ' || regexp_replace(text, '\s+', ' ', 'g') || ' ' AS t FROM documents) d
WHERE contains(d.t, ' ' || q || ' ') AND len(string_split(q, ' ')) = 6"""

VIEWS["v_msg"] = """
SELECT 'C' || conv_id % 5 AS channel_id,
  lpad(CAST(1704067200 + conv_id * 3600 + turn * 60 AS VARCHAR), 12, '0') || '.' || lpad(CAST(turn AS VARCHAR), 6, '0') AS ts,
  CASE WHEN turn > 0 THEN lpad(CAST(1704067200 + conv_id * 3600 AS VARCHAR), 12, '0') || '.000000' END AS thread_ts,
  role AS user_id,
  CASE WHEN (conv_id * 8 + turn) % 37 = 0 THEN '  ' ELSE text END AS text,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(conv_id AS INTEGER)) + to_minutes(CAST(turn AS INTEGER)) AS created_at,
  conv_id, turn, CAST(delivery AS BIGINT) AS delivery
FROM conversations, (SELECT unnest([1, 2]) AS delivery)
WHERE delivery = 1 OR (conv_id + turn) % 10 = 0"""

VIEWS["v_channel"] = """
SELECT DISTINCT channel_id, 'chan-' || channel_id AS name, channel_id <> 'C3' AS archive_enabled FROM v_msg"""

VIEWS["v_archive"] = """
SELECT channel_id, ts, coalesce(thread_ts, ts) AS thread_ts, user_id, text, created_at
FROM v_msg WHERE trim(text) <> '' AND channel_id <> 'C3' AND delivery = 1"""

VIEWS["v_thread_log"] = """
SELECT 'C' || conv_id % 5 AS channel_id,
  lpad(CAST(1704067200 + conv_id * 3600 AS VARCHAR), 12, '0') || '.000000' AS thread_ts,
  CASE WHEN conv_id % 10 = 0 THEN lpad(CAST(1704067200 + conv_id * 3600 AS VARCHAR), 12, '0') || '.000000'
       ELSE lpad(CAST(1704067200 + conv_id * 3600 + max(turn) * 60 AS VARCHAR), 12, '0') || '.' || lpad(CAST(max(turn) AS VARCHAR), 6, '0')
  END AS last_ts,
  CASE WHEN conv_id % 4 = 0 THEN conv_id END AS document_id
FROM conversations WHERE conv_id % 2 = 0 AND (conv_id * 8 + turn) % 37 <> 0 GROUP BY conv_id"""

VIEWS["v_ledger"] = """
SELECT CASE doc_id % 9 WHEN 0 THEN 'drive' WHEN 3 THEN 'tiro' ELSE 'meetily' END AS source,
  'ref-' || doc_id AS ref, doc_id AS document_id
FROM documents WHERE doc_id % 3 = 0"""

VIEWS["v_rev"] = """
SELECT user_id AS document_id, event_id, ts AS created_at, event_id % 2 AS editor_id,
  CASE WHEN event_type IN ('view', 'click') THEN 'MANUAL' WHEN event_type = 'purchase' THEN 'SNAPSHOT_COMMIT'
       ELSE 'IMPORT' END AS cause, value AS snapshot
FROM events"""

VIEWS["v_status_event"] = """
SELECT user_id AS document_id, event_id, ts,
  CASE event_type WHEN 'signup' THEN 'create' WHEN 'click' THEN 'replace' WHEN 'purchase' THEN 'verify'
    WHEN 'view' THEN 'stale' ELSE 'archive' END AS action, event_id % 3 <> 0 AS human
FROM events"""

VIEWS["v_triple"] = """
SELECT 'o' || o_orderkey || '-0' AS triple_id, o_orderkey AS document_id, 'decision' AS kind,
  'order ' || o_orderkey || ' placed by ' || c_name AS statement, 'Order ' || o_orderkey AS subject,
  'placed_by' AS predicate, c_name AS object, o_orderdate AS event_at
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
UNION ALL
SELECT 'o' || o_orderkey || '-1', o_orderkey, 'policy', c_name || ' is in ' || n_name, c_name, 'located_in', n_name, o_orderdate
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
UNION ALL
SELECT 'o' || o_orderkey || '-2', o_orderkey, 'constraint', n_name || ' is in ' || r_name, n_name, 'part_of', r_name, o_orderdate
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT 'l' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey, o_orderkey,
  CASE l_linenumber % 3 WHEN 0 THEN 'workaround' WHEN 1 THEN 'gotcha' ELSE 'risk' END, p_name,
  'Order ' || o_orderkey, 'contains', p_name || ' ' || p_partkey, o_orderdate
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey"""

VIEWS["v_decision_triple"] = """
SELECT o_orderkey || '-' || ord AS triple_id, o_custkey AS document_id, 'decision' AS kind,
  'decision ' || o_orderkey || ' — because ' || o_orderpriority AS statement,
  'decision:topic ' || o_orderkey % 500 AS subject,
  CASE ord WHEN 0 THEN 'topic' WHEN 1 THEN 'value' WHEN 2 THEN 'owner' ELSE 'rationale' END AS predicate,
  CASE ord WHEN 0 THEN 'topic ' || o_orderkey % 500 WHEN 1 THEN o_orderstatus WHEN 2 THEN c_name
    ELSE o_orderpriority END AS object,
  o_orderdate AS event_at, o_orderkey * 10 + ord AS ordinal
FROM orders JOIN customer ON o_custkey = c_custkey, (SELECT unnest(range(4)) AS ord)"""

VIEWS["v_judgment"] = f"""
SELECT document_id, subject,
  ['confirmed', 'conditional', 'intended', 'proposed', 'needed', 'none'][h % 6 + 1] AS commitment,
  ['core', 'supporting', 'peripheral'][(h // 6) % 3 + 1] AS salience,
  (h // 18) % 4 = 0 AS conditional
FROM (SELECT *, {hashed("document_id || '|' || subject")} AS h
      FROM (SELECT DISTINCT document_id, subject FROM v_decision_triple))
WHERE h % 10 <> 0"""

VIEWS["v_case"] = """
SELECT conv_id * 2 + shift AS case_id, conv_id, question,
  CASE (conv_id + shift) % 4 WHEN 0 THEN 'answerable' WHEN 1 THEN 'answerable_paired'
    WHEN 2 THEN 'unanswerable' ELSE 'unanswerable_hard' END AS label
FROM (SELECT conv_id, arg_min(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id),
  (SELECT unnest([0, 1]) AS shift)
WHERE shift = 0 OR conv_id % 5 = 0"""

VIEWS["v_answer"] = """
SELECT conv_id, arg_min(text, turn) AS answer FROM conversations WHERE role = 'assistant' GROUP BY conv_id"""

VIEWS["v_verdict"] = f"""
SELECT doc_id, 'run' || doc_id % 3 AS run,
  CASE WHEN toxic = 1 OR h % 5 = 0 THEN 'unanswerable' ELSE 'answerable' END AS label,
  CASE h % 3 WHEN 0 THEN 'answer' WHEN 1 THEN 'partial' ELSE 'refusal' END AS response,
  quality = 0 AS fabricated, (h // 3) % 2 = 1 AS grade_reflected
FROM (SELECT *, {hashed("doc_id")} AS h FROM labels)"""

VIEWS["v_human"] = """
SELECT doc_id, 'sys' || doc_id % 2 AS system, n_chars > 2000 AS proxy,
  CASE WHEN doc_id % 11 = 0 THEN 'unclear' WHEN quality = 1 THEN 'correct' ELSE 'wrong' END AS verdict
FROM labels JOIN documents USING (doc_id)"""

VIEWS["v_sentence"] = r"""
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS ordinal, s AS sentence
FROM (SELECT doc_id, generate_subscripts(l, 1) AS i, trim(unnest(l), chr(10) || chr(9) || chr(13) || ' ') AS s
      FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?。])\s+', '\1' || chr(10), 'g'), chr(10)) AS l
            FROM documents))
WHERE length(s) > 10"""

VIEWS["v_claim"] = r"""
SELECT doc_id, ordinal AS claim_id, 'sys' || ordinal % 2 AS system,
  (SELECT string_agg(w, ' ' ORDER BY i) FROM (SELECT unnest(l) AS w, generate_subscripts(l, 1) AS i) WHERE i % 2 = 1) AS claim
FROM (SELECT doc_id, ordinal, string_split_regex(sentence, '\s+') AS l FROM v_sentence)"""

VIEWS["v_extract_raw"] = r"""
SELECT conv_id AS document_id,
  CASE conv_id % 8 WHEN 1 THEN 'Here:' || chr(10) || '```json' || chr(10) || j || chr(10) || '```'
    WHEN 3 THEN 'nothing to record' WHEN 4 THEN substr(j, 1, 60) || '}' ELSE j END AS response
FROM (
  SELECT conv_id, '{"worthRecording":' || CASE WHEN conv_id % 8 = 2 THEN 'false' ELSE 'true' END || ',"title":"' ||
    CASE WHEN conv_id % 8 = 5 THEN ' ' ELSE 'Talk ' || conv_id END || '","summary":["Sum ' || first(b ORDER BY turn NULLS LAST, b) FILTER (WHERE b IS NOT NULL) ||
    '"],"decisionPoints":[' || coalesce(string_agg(dec, ',' ORDER BY turn NULLS LAST, dec), '') || '],"tacitKnowledge":[' ||
    coalesce(string_agg(tac, ',' ORDER BY turn NULLS LAST, tac), '') || ']}' AS j
  FROM (
    SELECT conv_id, turn, b,
      CASE WHEN role <> 'user' THEN '{"topic":"' || a || '","decision":"Decide ' || b || '","outcome":"' || c || '","owner":"' ||
        CASE WHEN turn % 2 = 1 THEN role || ', lead' ELSE '' END || '","rationale":"' ||
        CASE WHEN turn % 3 = 0 THEN b ELSE '' END || '","condition":"","alternatives":[' ||
        CASE WHEN turn % 4 = 1 THEN '"Alt ' || c || '"' ELSE '' END || ']}' END AS dec,
      CASE WHEN role = 'user' THEN '{"kind":"policy","statement":"Rule ' || b || '","triples":[' || t ||
        CASE WHEN conv_id % 8 = 7 THEN ',' || t WHEN conv_id % 8 = 6 THEN ',{"subject":"","predicate":"uses","object":"x"}' ELSE '' END
        || ']}' END AS tac
    FROM (SELECT *, '{"subject":"Team ' || a || '","predicate":"uses","object":"Tool ' || c || '"}' AS t
      FROM (SELECT conv_id, turn, role, array_to_string(w[1:2], ' ') AS a, array_to_string(list_slice(w, 3, greatest(len(w) - 2, 2)), ' ') AS b,
              array_to_string(list_slice(w, greatest(len(w) - 1, 3), len(w)), ' ') AS c
        FROM (SELECT *, string_split(trim(regexp_replace(regexp_replace(text, '[^a-zA-Z \n]', '', 'g'), '[ \n]+', ' ', 'g')), ' ') AS w
              FROM conversations))))
  GROUP BY conv_id)"""

VIEWS["v_kg_vec"] = "SELECT vec_id AS entity, label AS relation, embedding AS vec FROM embeddings"

VIEWS["v_loss"] = """
SELECT l_returnflag AS file, l_discount AS loss, CASE WHEN l_linenumber = 7 THEN 0 ELSE l_quantity END AS tokens
FROM lineitem"""


def oracle(sql: str, extra: dict[str, str] | None = None) -> str:
    """``sql`` preceded by the views it uses, in dependency order."""
    known = {**VIEWS, **(extra or {})}
    order: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\bv_[a-z0-9_]+\b", text):
            if name in known and name not in order:
                need(known[name])
                if name not in order:
                    order.append(name)

    need(sql)
    if not order:
        return sql
    head = ",\n".join(f"{n} AS MATERIALIZED ({known[n]})" for n in order)
    if re.match(r"\s*WITH\s+RECURSIVE\b", sql):
        return f"WITH RECURSIVE {head},\n" + re.sub(r"^\s*WITH\s+RECURSIVE\b", "", sql, count=1)
    if re.match(r"\s*WITH\b", sql):
        return f"WITH {head},\n" + re.sub(r"^\s*WITH\b", "", sql, count=1)
    return f"WITH {head}\n{sql}"
