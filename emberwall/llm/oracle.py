"""SQL for DuckDB of the corpus queries that SQL can express."""

from __future__ import annotations

from .chat import END, TURN
from .decontamination import WINDOW

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"


#: Sets of 4-word shingles, pairs that share one, their similarity, and components by recursion over links.
NEAR_DEDUP = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_lower("text")}, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 3), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS k FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), linked AS (
  SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)
), both_ways AS (
  SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b
), component AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN component c ON c.doc_id = d.doc_id
"""

#: Windows of the items joined to all windows of the documents of the same length.
DECONTAMINATION = f"""
WITH doc_words AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_lower("text")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents
), item_words AS (
  SELECT item_id, list_filter(regexp_split_to_array({_lower("text")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(list_slice(w, k, k + {WINDOW - 1}), ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS k FROM item_words WHERE len(w) > 0)
), doc_windows AS (
  SELECT doc_id, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM doc_words, (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n)
), found AS (
  SELECT d.doc_id, d.k, d.n, i.item_id FROM doc_windows d JOIN item_windows i ON i.s = d.s AND i.n = d.n
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit h ON h.doc_id = d.doc_id LEFT JOIN items i ON i.doc_id = d.doc_id
"""


def _escaped_length(text: str) -> str:
    """Each of the three escaped characters takes one more."""
    return f"(2 * length({text}) - length(translate({text}, '\\<>', '')) )"


def chat_format(hostile: str) -> str:
    quoted = hostile.replace("'", "''")
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT CAST(-7 AS BIGINT), CAST(0 AS BIGINT), 'user', '{quoted}' UNION ALL SELECT CAST(-7 AS BIGINT), CAST(1 AS BIGINT), 'assistant', '{quoted}'
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(concat(role, chr(10), t, chr(10)), '' ORDER BY turn, role, t)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(t) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN t END, '' ORDER BY turn, role, t), '')) AS loss_sha256,
  CAST(sum({_escaped_length("role")} + {_escaped_length("t")} + {len(TURN) + 1 + len(END)}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
