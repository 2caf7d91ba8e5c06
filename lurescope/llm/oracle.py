"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

#: One leaf, node or proof digest is the lowercase hex SHA-256 of the joined text.
_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(c: str, value: str | None = None) -> str:
    text = f"CAST({value or c} AS VARCHAR)"
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({text}) || ':' || {text} END"


def _leaf(**other: str) -> str:
    return "sha256(" + " || ".join(_field(c, other.get(c)) for c in _FIELDS) + ")"


_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
    list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT) FOR i IN range(8)]),
        lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS BIGINT)) ELSE x // 2 END)),
    CAST(4294967295 AS BIGINT))"""

MERKLE = f"""
WITH RECURSIVE leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
         count(*) OVER (PARTITION BY source) AS m
  FROM (SELECT doc_id, source, {_leaf()} AS leaf,
               CASE WHEN {_CRC} % 2 = 0 THEN {_leaf(text="replace(text, chr(10), '')")}
                    ELSE {_leaf()} END AS claimed
        FROM documents)),
nodes(lvl, source, idx, digest, m) AS (
  SELECT 0, source, idx, leaf, m FROM leaves
  UNION ALL
  SELECT lvl + 1, source, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (m + 2) // 3
  FROM nodes WHERE m > 1 GROUP BY lvl, source, idx // 3, m),
subroots AS (
  SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx,
         count(*) OVER () AS m FROM nodes WHERE m = 1),
tops(lvl, idx, digest, m) AS (
  SELECT 0, idx, digest, m FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (m + 2) // 3
  FROM tops WHERE m > 1 GROUP BY lvl, idx // 3, m),
low AS (
  SELECT l.source, l.idx, n.lvl,
         coalesce(string_agg(n.digest, '' ORDER BY n.idx) FILTER (n.idx < l.idx // CAST(pow(3, n.lvl) AS BIGINT)), '') AS before,
         coalesce(string_agg(n.digest, '' ORDER BY n.idx) FILTER (n.idx > l.idx // CAST(pow(3, n.lvl) AS BIGINT)), '') AS after
  FROM leaves l JOIN nodes n ON l.source IS NOT DISTINCT FROM n.source AND n.m > 1
       AND n.idx // 3 = l.idx // CAST(pow(3, n.lvl + 1) AS BIGINT)
  GROUP BY ALL),
high AS (
  SELECT s.source, t.lvl,
         coalesce(string_agg(t.digest, '' ORDER BY t.idx) FILTER (t.idx < s.idx // CAST(pow(3, t.lvl) AS BIGINT)), '') AS before,
         coalesce(string_agg(t.digest, '' ORDER BY t.idx) FILTER (t.idx > s.idx // CAST(pow(3, t.lvl) AS BIGINT)), '') AS after
  FROM subroots s JOIN tops t ON t.m > 1 AND t.idx // 3 = s.idx // CAST(pow(3, t.lvl + 1) AS BIGINT)
  GROUP BY ALL),
steps AS (
  SELECT source, idx, lvl, before, after FROM low
  UNION ALL
  SELECT l.source, l.idx, 1000 + h.lvl, h.before, h.after
  FROM leaves l JOIN high h ON l.source IS NOT DISTINCT FROM h.source),
paths AS (
  SELECT source, idx, list({{'b': before, 'a': after}} ORDER BY lvl) AS path,
         string_agg(before || after, '' ORDER BY lvl) AS proof
  FROM steps GROUP BY source, idx),
folded AS (
  SELECT l.doc_id, l.leaf, s.digest AS subroot, (SELECT digest FROM tops WHERE m = 1) AS root,
         sha256(coalesce(p.proof, '')) AS proof_sha256,
         list_reduce(list_prepend({{'b': l.claimed, 'a': ''}}, coalesce(p.path, [])),
                     lambda x, y: {{'b': sha256(y.b || x.b || y.a), 'a': ''}}).b AS folded_root
  FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source
  LEFT JOIN paths p ON l.source IS NOT DISTINCT FROM p.source AND l.idx = p.idx)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM folded
"""


def _escaped(c: str) -> str:
    rest = r"s>|/s>|INST\]|/INST\]|SYS\]|/SYS\]|BOT\]|TURN\]|ROLE\]|SAY\]|/ROLE\]"
    return rf"regexp_replace({c}, '([<\[])(\\*(?:{rest}))', '\1\\\2', 'g')"


CHAT = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, lag(role) OVER w IS NOT DISTINCT FROM role AND row_number() OVER w > 1 AS merged
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
sized AS (
  SELECT *, length({_escaped("text")}) + CASE WHEN merged THEN length('[TURN]')
    WHEN role = 'system' THEN length('[SYS][/SYS]') WHEN role = 'user' THEN length('[INST][/INST]')
    WHEN role = 'assistant' THEN length('[BOT]</s>')
    ELSE length('[ROLE][SAY][/ROLE]') + length({_escaped("role")}) END AS chars
  FROM marked)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(length('<s>') + sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

ORACLE = {"op11_merkle": MERKLE, "op13_chat": CHAT}
