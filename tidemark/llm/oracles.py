"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

#: crc32 as SQL: a table of 256 steps, folded over the bytes of an ASCII text.
_CRC = """crc_step AS (SELECT i, list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v FROM range(256) r(i)),
crc_table AS (SELECT list(v ORDER BY i) AS tab FROM crc_step)"""


def _crc(text: str) -> str:
    start = "4294967295::UBIGINT"
    bytes_of = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::UBIGINT)"
    return f"xor(list_reduce(list_prepend({start}, {bytes_of}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255)::BIGINT + 1])), {start})"


_WHITE = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"

TURNS = f"""WITH RECURSIVE {_CRC},
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
hit AS (SELECT n.*, {_crc("name")} % 20 AS kind FROM named n, crc_table),
damaged AS (SELECT coalesce(conv_id, -9223372036854775808) AS c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hit, (VALUES (0), (1)) copies(n) WHERE kind <> 0 AND (n = 0 OR kind = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, {_WHITE}) AS core, left(role, 1) AS initial FROM damaged),
faulty AS (SELECT *, CASE WHEN core = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY c ORDER BY i) AS prev FROM placed),
counts AS (SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (prev || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY c),
put(st, letters, new, lines) AS (VALUES (0, '', 0, ''), (0, 'I', 2, 'user:|'), (0, 'II', 3, 'user:|assistant:|'), (1, '', 1, ''), (1, 'I', 2, 'user:|'), (1, 'II', 3, 'user:|assistant:|'),
  (2, '', 2, ''), (2, 'I', 3, 'assistant:|'), (2, 'II', 2, 'assistant:|user:|'), (3, '', 3, ''), (3, 'I', 2, 'user:|'), (3, 'II', 3, 'user:|assistant:|')),
act(st, letter, need, new, says, cost) AS (VALUES (0, 'K', 's', 1, NULL, 0), (0, 'K', 'u', 2, NULL, 0), (1, 'K', 'u', 2, NULL, 0), (2, 'K', 'a', 3, NULL, 0), (3, 'K', 'u', 2, NULL, 0),
  (0, 'R', NULL, 2, 'user', 2), (1, 'R', NULL, 2, 'user', 2), (2, 'R', NULL, 3, 'assistant', 2), (3, 'R', NULL, 2, 'user', 2),
  (0, 'D', NULL, 0, NULL, 3), (1, 'D', NULL, 1, NULL, 3), (2, 'D', NULL, 2, NULL, 3), (3, 'D', NULL, 3, NULL, 3)),
run(c, st, i, best) USING KEY (c, st) AS (
  SELECT c, 0, 0::BIGINT, {{'cost': 0::BIGINT, 'audit': '', 'made': ''}} FROM counts
  UNION
  SELECT r.c, a.new, f.i, min({{'cost': r.best.cost + 2 * length(p.letters) + a.cost + CASE WHEN f.fault = 'truncated' AND a.letter <> 'D' THEN 1 ELSE 0 END,
      'audit': r.best.audit || p.letters || a.letter, 'made': r.best.made || replace(p.lines, '|', chr(10)) || CASE WHEN a.letter = 'D' THEN '' ELSE coalesce(a.says, f.role) || ':' || f.text || chr(10) END}})
  FROM run r JOIN faulty f ON f.c = r.c AND f.i = r.i + 1 JOIN put p ON p.st = r.st JOIN act a ON a.st = p.new AND (a.need IS NULL OR a.need = f.initial)
  WHERE f.fault NOT IN ('blank', 'duplicate') OR a.letter = 'D' GROUP BY ALL),
ended AS (SELECT r.c, min({{'cost': r.best.cost + 2 * length(p.letters), 'audit': r.best.audit || p.letters, 'made': r.best.made || replace(p.lines, '|', chr(10))}}) AS best
  FROM run r JOIN counts n ON n.c = r.c AND n.n = r.i JOIN put p ON p.st = r.st AND p.new IN (0, 3) GROUP BY r.c)
SELECT o.conv_id, coalesce(n.gaps, 0) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate, coalesce(n.truncated, 0) AS truncated, coalesce(n.illegal, 0) AS illegal,
  coalesce(e.best.cost, 0) AS cost, coalesce(e.best.audit, '') AS audit, sha256(coalesce(left(e.best.made, greatest(length(e.best.made) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id, -9223372036854775808) AS c FROM conversations) o LEFT JOIN counts n ON n.c = o.c LEFT JOIN ended e ON e.c = o.c"""


def _components(links: str, nodes: str) -> str:
    """Smallest node reachable, for ``nodes`` (v) over ``links`` (a, b, both ways): labels travel until none falls."""
    return f"""reach(v, c) USING KEY (v) AS (
  SELECT v, v FROM {nodes}
  UNION
  SELECT l.a, min(n.c) FROM reach n JOIN {links} l ON l.b = n.v JOIN recurring.reach o ON o.v = l.a WHERE n.c < o.c GROUP BY l.a)"""


#: All pairs by an inverted index of five-word shingles.
NGRAM_JOIN = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
g AS (SELECT doc_id, w, list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM w WHERE len(w) > 0),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS s FROM g),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, max(x.n) AS na, max(y.n) AS nb, count(*) AS c FROM e x JOIN e y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) WHERE c >= 0.8 * (na + nb - c)),
nodes AS (SELECT doc_id AS v FROM g),
{_components("links", "nodes")},
n AS (SELECT a, count(*) AS n FROM links GROUP BY 1),
same AS (SELECT doc_id, count(*) OVER (PARTITION BY w) AS copies FROM g)
SELECT w.doc_id, coalesce(c, w.doc_id) AS class_id, coalesce(n.n, 0) AS n_links, coalesce(copies, 1) AS copies, coalesce(c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN reach ON v = w.doc_id LEFT JOIN n ON n.a = w.doc_id LEFT JOIN same ON same.doc_id = w.doc_id"""

#: All pairs of usable vectors by cosine.
VECTOR_DEDUP = f"""WITH RECURSIVE u AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.v, y.v) >= 0.9),
nodes AS (SELECT vec_id AS v FROM u),
{_components("links", "nodes")},
n AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c, e.vec_id) AS component_id, coalesce(c, e.vec_id) = e.vec_id AS kept FROM embeddings e LEFT JOIN reach ON v = e.vec_id LEFT JOIN n ON n.a = e.vec_id"""

_BITS = "list_transform(string_split(sha, ''), lambda h: lpad(bin(('0x' || h)::BIGINT), 4, '0'))"
_BASE32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
#: SHA-1 in base32 from its hexadecimal form, five bits a character.
WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS sha FROM pages),
b AS (SELECT *, array_to_string({_BITS}, '') AS bits, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr({_BASE32}, list_sum(list_transform(range(0, 5), lambda j: CASE WHEN substr(bits, i * 5 + j + 1, 1) = '1' THEN 1 << (4 - j) ELSE 0 END))::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b"""

ORACLES: dict[str, str] = {"op1_ngram_join": NGRAM_JOIN, "op6_warc": WARC, "op7_vector_dedup": VECTOR_DEDUP, "op12_turns": TURNS}
