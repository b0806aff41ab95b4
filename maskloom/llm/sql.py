"""The registered queries of this subpackage that DuckDB SQL can express."""

from __future__ import annotations

MIX = """
WITH RECURSIVE sizes AS (
  SELECT coalesce('=' || source, '') AS key, count(*) AS n, sqrt(count(*)) AS w FROM documents GROUP BY 1
), shares AS (
  SELECT key, n, row_number() OVER (ORDER BY key) AS turn,
         greatest(1, CAST(round(1000 * w / (SELECT sum(w) FROM sizes)) AS BIGINT)) AS share FROM sizes
), plan AS (
  SELECT list(share ORDER BY turn) AS p, list(n ORDER BY turn) AS n, CAST(sum(share) AS BIGINT) AS slots,
         count(*) AS sources FROM shares
), edf(t, had, turn) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(p, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT) FROM plan
  UNION ALL
  SELECT t + 1,
         list_transform(range(sources), lambda i: had[i + 1] + CASE WHEN i + 1 = turn THEN 1 ELSE 0 END),
         1 + list_min(list_transform(range(sources), lambda i: CASE
           WHEN ((had[i + 1] + CASE WHEN i + 1 = turn THEN 1 ELSE 0 END) * slots) // p[i + 1] <= t + 1
           THEN ((had[i + 1] + CASE WHEN i + 1 = turn THEN 1 ELSE 0 END + 1) * slots + p[i + 1] - 1) // p[i + 1] * sources + i
           END)) % sources
  FROM edf, plan WHERE t + 1 < slots
), slot AS (SELECT t, had, turn, had[turn] AS nth FROM edf WHERE t >= 0),
numbered AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS key,
         row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS r
  FROM documents
)
SELECT d.doc_id, d.source, d.r // 8 AS block, d.r // 8 * slots // share AS release,
       ((d.r // 8 + 1) * slots + share - 1) // share AS deadline,
       d.r // 8 // share * slots + slot.t AS slot,
       CAST(list_sum(list_transform(range(sources), lambda i: least(plan.n[i + 1],
         8 * (p[i + 1] * (d.r // 8 // share) + slot.had[i + 1])))) + d.r % 8 AS BIGINT) AS position
FROM numbered d JOIN shares USING (key) CROSS JOIN plan
JOIN slot ON slot.turn = shares.turn AND slot.nth = (d.r // 8) % share
"""

SQL = {"op8_mix_sources": MIX}

#: All pairs of usable vectors, and everything that each reaches by links.
SQL["op2_embedding_near_dedup"] = """
WITH RECURSIVE good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id < b.vec_id
  WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.95 ELSE false END
), links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a),
lowest AS (SELECT a, min(b) AS low FROM reached GROUP BY a)
SELECT v.vec_id, coalesce(c.n, 0) AS n_links, least(v.vec_id, coalesce(m.low, v.vec_id)) AS component_id,
       v.vec_id <= coalesce(m.low, v.vec_id) AS kept
FROM embeddings v LEFT JOIN counts c ON c.a = v.vec_id LEFT JOIN lowest m ON m.a = v.vec_id"""

_HIDDEN = "|".join(f"<{x}\\b[^>]*>.*?</{x}[ \\t\\r\\n]*>" for x in ("script", "style", "noscript", "template"))
_PLAIN = f"regexp_replace(html, '(?is)<!--.*?-->|{_HIDDEN}', '', 'g')"
_PLAIN = f"""regexp_replace({_PLAIN}, '(?i)</?(address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|td|th|title|tr|ul)\\b[^>]*>', chr(10), 'g')"""
_PLAIN = f"regexp_replace({_PLAIN}, '</?[a-zA-Z!][^>]*>', '', 'g')"


def _entities(text: str) -> str:
    pairs = ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&copy;", "©"), ("&reg;", "®")
    more = ("&middot;", "·"), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&euro;", "€"), ("&amp;", "&")
    for entity, char in pairs + more:
        text = f"replace({text}, '{entity}', '{char}')"
    return text


def _uuid(parts: str) -> str:
    h = f"md5({parts})"
    return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"


WARC = f"""
WITH page AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
r AS (
  SELECT page_id, url, html, {_uuid("'response' || chr(10) || coalesce(CAST(page_id AS VARCHAR), '') || chr(10) || url || chr(10) || md5(html)")} AS rid,
         trim(regexp_replace(regexp_replace({_entities(_PLAIN)}, '[ \\t\\r\\f]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10)) AS plain,
         trim(regexp_replace({_entities("regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title', 1)")}, '[ \\t\\r\\n\\f]+', ' ', 'g')) AS title,
         list_transform(regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref="([^"]*)"', 1), lambda x: {_entities("x")}) AS links,
         'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) AS header
  FROM page
), ids AS (
  SELECT *, {_uuid("'metadata' || chr(10) || rid")} AS mid, {_uuid("'conversion' || chr(10) || rid")} AS cid,
         CAST(to_json(struct_pack(title := title, links := links, http_header := header)) AS VARCHAR) AS json FROM r
), two AS (
  SELECT *, 'metadata' AS warc_type, mid AS record_id, cid AS concurrent_to, 'application/json' AS content_type, json AS block FROM ids
  UNION ALL
  SELECT *, 'conversion', cid, mid, 'text/plain', plain FROM ids
)
SELECT page_id, rid AS refers_to, url AS target_uri, '2024-01-01T00:00:00Z' AS warc_date, 'sha256:' || sha256(html) AS source_digest,
       warc_type, record_id, concurrent_to, content_type, block, strlen(block) AS content_length, 'sha256:' || sha256(block) AS block_digest
FROM two
"""

SQL["op9_warc_derivatives"] = WARC


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of ASCII text."""
    bits = "list_reduce(range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, byte))"
    codes = f"list_transform(range(1, length({text}) + 1), lambda k: CAST(unicode(substr({text}, k, 1)) AS BIGINT))"
    return f"xor(list_reduce({codes}, lambda crc, byte: {bits}, CAST(4294967295 AS BIGINT)), 4294967295)"


def _edit(label: str, price: str, letter: str) -> str:
    """A label is a cost in nine digits and an audit, so the least label is the cheapest, then the least audit."""
    return f"lpad(CAST(CAST(left({label}, 9) AS BIGINT) + {price} AS VARCHAR), 9, '0') || '{letter}' || substr({label}, 10)"


def _after_row(state: int, kept: dict[int, int], next_part: int, next_state: int) -> str:
    """The least label before a row of part ``p`` and fault ``f``, whose deletion, keeping and change lead to known labels."""
    more = "CASE f WHEN 3 THEN 5 ELSE 0 END"
    ways = [_edit(f"f{state}", "2", "D")]
    ways += [f"CASE WHEN f IN (0, 3) AND p = {part} THEN {_edit(f'f{to}', more, 'K')} END" for part, to in kept.items()]
    ways.append(f"CASE WHEN f IN (0, 3) AND p <> {next_part} THEN {_edit(f'f{next_state}', '1 + ' + more, 'R')} END")
    return f"least({', '.join(ways)}) AS b{state}"


_INSERTED = f"""least(b0, {_edit('c2', '5', 'I')}) AS f0, least(b1, {_edit('c2', '5', 'I')}) AS f1, c2 AS f2, least(b3, {_edit('b2', '5', 'I')}) AS f3
    FROM (SELECT *, least(b2, {_edit('b3', '5', 'I')}) AS c2"""

# Parts: 1 system, 2 user, 3 assistant. States: 0 start, 1 after a system turn, 2 a user's, 3 an assistant's.
REPAIR = f"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), hit AS (SELECT *, {_crc32('key')} % 20 AS damage FROM given),
damaged AS (
  SELECT conv_id, turn, CASE damage WHEN 4 THEN 'user' ELSE role END AS role,
         CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hit CROSS JOIN range(2) copies(copy) WHERE damage <> 0 AND (copy = 0 OR damage = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS place,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
         CASE left(role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END AS part
  FROM damaged
), faulty AS (
  SELECT *, CASE WHEN body = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 2 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) || left(role, 1) NOT IN ('su', 'ua', 'au') AS broken
  FROM placed
), ids AS (SELECT DISTINCT conv_id FROM conversations),
counted AS (
  SELECT ids.conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
         count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (broken) AS illegal,
         coalesce(list(part ORDER BY place) FILTER (place IS NOT NULL), []) AS parts,
         coalesce(list(fault ORDER BY place) FILTER (place IS NOT NULL), []) AS faults
  FROM ids LEFT JOIN faulty ON faulty.conv_id IS NOT DISTINCT FROM ids.conv_id GROUP BY ids.conv_id
), lattice(conv_id, i, parts, faults, f0, f1, f2, f3) AS (
  SELECT conv_id, i, parts, faults, {_INSERTED} FROM (
    SELECT conv_id, len(parts) AS i, parts, faults, '000000000' AS b0, CAST(NULL AS VARCHAR) AS b1, CAST(NULL AS VARCHAR) AS b2, '000000000' AS b3 FROM counted))
  UNION ALL
  SELECT conv_id, i, parts, faults, {_INSERTED} FROM (
    SELECT conv_id, i - 1 AS i, parts, faults, {_after_row(0, {1: 1, 2: 2}, 2, 2)}, {_after_row(1, {2: 2}, 2, 2)},
           {_after_row(2, {3: 3}, 3, 3)}, {_after_row(3, {2: 2}, 2, 2)}
    FROM (SELECT *, parts[i] AS p, faults[i] AS f FROM lattice WHERE i > 0)))
), cheapest AS (
  SELECT conv_id, CAST(left(f0, 9) AS BIGINT) AS cost, substr(f0, 10) AS audit FROM lattice WHERE i = 0
), letters AS (
  SELECT conv_id, k, substr(audit, k, 1) AS letter, length(replace(left(audit, k), 'I', '')) AS place
  FROM cheapest CROSS JOIN LATERAL (SELECT unnest(range(1, length(audit) + 1)) AS k)
), stays AS (
  SELECT l.conv_id, l.letter, r.role, r.text, r.part, row_number() OVER (PARTITION BY l.conv_id ORDER BY k) AS j
  FROM letters l LEFT JOIN faulty r ON l.letter <> 'I' AND r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.place = l.place WHERE l.letter <> 'D'
), headed AS (
  SELECT *, first_value(CASE WHEN letter = 'K' AND part = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY j) AS system FROM stays
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (j - system) % 2 = 1 THEN 'user' ELSE 'assistant' END
         || ':' || CASE letter WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS turns FROM headed GROUP BY conv_id
)
SELECT c.conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, sha256(coalesce(turns, '')) AS repaired_sha256
FROM counted c JOIN cheapest a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
"""

TRIE = f"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), placed AS (
  SELECT conv_id, md5(length(role) || ':' || role || text) AS digest, length(text) AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest) AS place FROM given
), conv AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc32('key')} % 6 AS h FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS key FROM given)
), taken AS (
  SELECT conv.conv_id, 0 AS part, place, digest, chars FROM conv JOIN placed ON placed.conv_id = base AND place <= h
  UNION ALL
  SELECT conv.conv_id, 1, place, digest, chars FROM conv JOIN placed ON placed.conv_id = conv.conv_id AND place > h
), paths AS (
  SELECT conv_id, row_number() OVER o AS depth, chars, string_agg(digest, '') OVER o AS path FROM taken
  WINDOW o AS (PARTITION BY conv_id ORDER BY part, place ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, 0, '' FROM conv
), ended AS (
  SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
  FROM (SELECT conv_id, arg_max(path, depth) AS path FROM paths GROUP BY conv_id) GROUP BY path
), node AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, left(path, 32 * (depth - 1)) AS above
  FROM paths GROUP BY path, depth
), kids AS (SELECT above, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY above),
below AS (
  SELECT left(node.path, 32 * up) AS path, CAST(count(*) FILTER (kids.above IS NULL) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * chars) AS BIGINT) AS saved_tokens
  FROM node LEFT JOIN kids ON kids.above = node.path CROSS JOIN LATERAL (SELECT unnest(range(node.depth + 1)) AS up) GROUP BY 1
)
SELECT node.conv_id, node.depth, p.conv_id AS parent_conv_id, node.n_convs, coalesce(kids.n_children, 0) AS n_children, n_leaves, saved_tokens,
       sha256(coalesce(ids, '')) AS ends_sha256
FROM node JOIN below USING (path) LEFT JOIN kids ON kids.above = node.path LEFT JOIN ended ON ended.path = node.path
LEFT JOIN node p ON node.depth > 0 AND p.path = node.above AND p.depth = node.depth - 1
"""

SQL |= {"op12_conversation_repair": REPAIR, "op13_conversation_trie": TRIE}

# The contract's own words: a window goes where its words also start earlier.
REPEATS = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), places AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS start FROM doc
), win AS (
  SELECT doc_id, start, row_number() OVER (PARTITION BY md5(array_to_string(words[start:start + 19], ' ')) ORDER BY doc_id, start) AS nth FROM places
), gone AS (
  SELECT doc_id, list(DISTINCT place) AS places
  FROM (SELECT doc_id, unnest(range(start, start + 20)) AS place FROM win WHERE nth > 1) GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS text, count(*) AS n
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM doc)
  ANTI JOIN (SELECT doc_id, unnest(places) AS place FROM gone) USING (doc_id, place) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)
"""

SQL["op5_suffix_automata"] = REPEATS
