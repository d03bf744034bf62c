"""SQL for DuckDB that says what the queries of this subpackage return, written level by level where it takes a tree."""
from __future__ import annotations

#: ``crc32(v)`` of a text of ASCII characters: the table of the bytes by its rule, then a fold.
_CRC_TABLE = """crc_table AS (
  SELECT list(v ORDER BY n) AS t FROM (
    SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
      lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM range(256) r(n)))"""
_CRC = """xor(list_reduce(list_concat([4294967295], list_transform(string_split({0}, ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, b: xor(t[CAST(xor(c, b) & 255 AS INTEGER) + 1], c >> 8)), 4294967295)"""


def _levels(name: str, start: str, key: str, count: int) -> list[str]:
    """CTEs ``name_0`` to ``name_count``: nodes d numbered i of n by key, and what stands left and right of each in its run."""
    sides = f"""COALESCE(string_agg(d, '') OVER (PARTITION BY {key}, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
      COALESCE(string_agg(d, '') OVER (PARTITION BY {key}, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r"""
    out = [f"{name}_0 AS (SELECT {key}, i, n, d, {sides} FROM {start})"]
    for k in range(1, count + 1):
        out.append(f"""{name}_{k} AS (SELECT {key}, i, n, d, {sides} FROM (
      SELECT {key}, i // 8 AS i, (n + 7) // 8 AS n, sha256(string_agg(d, '' ORDER BY i)) AS d FROM {name}_{k - 1} WHERE n > 1 GROUP BY {key}, i // 8, n))""")
    return out


def _climb(name: str, levels: str, key: str, source: str, index: str, count: int) -> list[str]:
    """CTEs ``name_1`` to ``name_count``: rows with the digest x folded level by level and the siblings s that it took."""
    out = []
    for k in range(count):
        out.append(f"""{name}_{k + 1} AS (SELECT a.* EXCLUDE (x, s), a.s || COALESCE(b.l || b.r, '') AS s,
      CASE WHEN b.i IS NULL THEN a.x ELSE sha256(b.l || a.x || b.r) END AS x
      FROM {source if k == 0 else f'{name}_{k}'} a LEFT JOIN {levels}_{k} b
        ON b.{key} IS NOT DISTINCT FROM a.{key} AND b.i = a.{index} // {8 ** k} AND b.n > 1)""")
    return out


def manifest_sql(levels: int = 12, top: int = 6) -> str:
    """The manifest of ``documents`` for up to 8 ** levels documents of a language and 8 ** top languages."""
    def digest(text: str) -> str:
        values = ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)
        return "sha256(" + " || ".join(
            f"COALESCE(CAST(octet_length(encode({v})) AS VARCHAR) || ':' || {v}, '-')" for v in values) + ")"

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = _CRC.format("CAST(doc_id AS VARCHAR)")
    parts = [
        _CRC_TABLE,
        f"""leaves AS (SELECT doc_id, lang, {digest('text')} AS leaf, {digest(lowered)} AS lowered,
      COALESCE({crc} % 3 = 0, FALSE) AS tampered FROM documents, crc_table)""",
        """numbered AS (SELECT *, leaf AS d, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
      count(*) OVER (PARTITION BY lang) AS n FROM leaves)""",
        *_levels("v", "numbered", "lang", levels),
        "subroots AS (" + " UNION ALL ".join(f"SELECT lang, d FROM v_{k} WHERE n = 1" for k in range(levels + 1)) + ")",
        """tops AS (SELECT 0 AS one, lang, d, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM subroots)""",
        *_levels("w", "tops", "one", top),
        "whole AS (" + " UNION ALL ".join(f"SELECT d FROM w_{k} WHERE n = 1" for k in range(top + 1)) + ")",
        """climbers AS (SELECT a.doc_id, a.lang, a.leaf, a.i, b.d AS subroot, b.i AS j, 0 AS one, '' AS s,
      CASE WHEN tampered THEN lowered ELSE leaf END AS x
      FROM numbered a JOIN tops b ON a.lang IS NOT DISTINCT FROM b.lang)""",
        *_climb("c", "v", "lang", "climbers", "i", levels),
        *_climb("e", "w", "one", f"c_{levels}", "j", top)]
    return ("WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, (SELECT d FROM whole) AS root, sha256(s) AS proof_sha256, x AS folded_root,
       x = (SELECT d FROM whole) AS verified
FROM e_{top}""")


def conversations_sql(control: str) -> str:
    """What the formatted ``conversations`` hold. A text with a control string gets one sign more for each."""
    held = "'" + control + "'"
    return f"""
WITH turns AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
marked AS (
  SELECT *, CASE role WHEN 'user' THEN length('[INST]  [/INST]') WHEN 'assistant' THEN length('  </s>')
      WHEN 'system' THEN length('<<SYS>><</SYS>>') + 4 ELSE length('[ROLE ]  [/ROLE]') + length(url_encode(role)) END
    + length(text) + len(regexp_extract_all(text, {held})) AS chars
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       COALESCE(sum(length(text)) FILTER (role = 'assistant'), 0) AS loss_chars,
       sha256(COALESCE(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       length('<s>') + sum(chars) AS formatted_chars
FROM marked GROUP BY conv_id"""
