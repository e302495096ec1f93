"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from tidemark.llm.sharding import SLICES, Node, grown, topology

WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
UPPER, LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
SQL: dict[str, str] = {}

SQL["op1_line_dedup"] = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
k AS (SELECT doc_id, lines, list_transform(lines, lambda x: translate(trim(x, {WHITE}), {UPPER}, {LOWER})) AS keys FROM d),
often AS (SELECT key FROM (SELECT unnest(list_distinct(keys)) AS key FROM k) WHERE key <> '' GROUP BY key HAVING count(*) >= 10),
bad AS (SELECT coalesce(list(key), []) AS keys FROM often),
r AS (SELECT doc_id, lines, list_filter(lines, lambda x: NOT list_contains(bad.keys, translate(trim(x, {WHITE}), {UPPER}, {LOWER}))) AS kept FROM k, bad)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped, sha256(array_to_string(kept, chr(10))) AS kept_sha256 FROM r
"""

SQL["op2_suffix_dedup"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
o AS (SELECT doc_id, o, length(h) // 2 - 199 AS n, substr(h, 2 * o + 1, 2 * 711) AS part FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199, 512)) AS o FROM d WHERE length(h) >= 400)),
w AS (SELECT doc_id, o + i AS i, md5(substr(part, 2 * i + 1, 400)) AS s FROM (SELECT doc_id, o, part, unnest(range(0, least(512, n - o))) AS i FROM o)),
s AS (SELECT doc_id, i FROM w SEMI JOIN (SELECT s FROM w GROUP BY s HAVING count(*) > 1) r ON w.s = r.s),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM s),
n AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM n GROUP BY doc_id, run),
p AS (SELECT r.doc_id, a, b, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY r.doc_id ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY r.doc_id ORDER BY a), 0))) AS part FROM runs r JOIN d ON d.doc_id = r.doc_id),
cut AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, string_agg(part, '' ORDER BY a) AS head, max(b) AS last FROM p GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(CASE WHEN removed IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut ON cut.doc_id = d.doc_id
"""


def _uniform(name: str) -> str:
    return f"((CAST('0x' || substr(md5(k || '/{name}'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)"


def _descend(node: Node) -> str:
    if not node.children:
        return str(node.shard)
    if len(node.children) == 1:
        return _descend(node.children[0])
    draws = ", ".join(f"-ln({_uniform(c.name)}) / {c.weight}" for c in node.children)
    cases = " ".join(f"WHEN {i} THEN {_descend(c)}" for i, c in enumerate(node.children, 1))
    return f"CASE list_position([{draws}], list_min([{draws}])) {cases} END"


_TREE = topology(8)
SQL["op9_sharding"] = f"""
WITH crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
b AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '~') AS k, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM documents),
c AS (SELECT doc_id, k, CAST(len(bytes) + 1 AS BIGINT) AS size, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM b, crc),
s AS (SELECT *, CAST({_descend(_TREE)} AS INTEGER) AS shard, CAST({_descend(grown(_TREE))} AS INTEGER) AS grown_shard, (CAST('0x' || substr(md5(k), 1, 8) AS BIGINT) + text_crc32) % {SLICES} AS slice FROM c)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY slice, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard FROM s
"""
