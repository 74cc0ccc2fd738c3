"""The same results stated in SQL, straight from the given tables.

Nothing here goes through JSON or a search index: the statements compute the expected
rows from ``conversations`` and ``documents`` by their definition.
"""

from __future__ import annotations

from colloquy.operators.render import ATTACHMENT_NOTICE, PRIVACY_NOTICE
from colloquy.plans.archive_queries import SEARCHES

OPEN, CLOSE, SEP = "\ue200", "\ue201", "\ue202"


def _key(domain: str, *parts: str) -> str:
    return f"left(sha256(concat_ws(chr(31), '{domain}', {', '.join(parts)})), 32)"


NODE_KEY = _key("node-v1", "conversation_key", "'n' || t")
BASE = f"""
h0 AS (SELECT conv_id AS c, max(turn) AS mt, count(*) AS n FROM conversations GROUP BY 1),
hd AS (
  SELECT c, mt, n, printf('conversations-%03d.json', c % 10) AS shard_name, c // 10 AS shard_ordinal,
    {_key("conversation-v1", "printf('conversations-%03d.json', c % 10)", "CAST(c // 10 AS VARCHAR)", "'c' || c")} AS conversation_key,
    c > 0 AND c % 11 = 0 AS dangling,
    c > 0 AND c % 17 = 0 AND c % 11 <> 0 AND mt >= 1 AS cyclic
  FROM h0 WHERE c % 37 NOT IN (5, 6, 7)),
nd AS (
  SELECT hd.c, k.turn AS t, hd.mt, hd.n, hd.conversation_key, hd.cyclic, hd.dangling,
    k.turn = 0 AND hd.c % 12 = 3 AS bare,
    CASE WHEN k.turn = 0 THEN CASE WHEN hd.cyclic THEN 1 END
         WHEN k.turn = 1 AND hd.dangling THEN NULL
         WHEN k.turn % 3 = 0 THEN k.turn - 2 ELSE k.turn - 1 END AS pt,
    k.role AS raw_role,
    k.text || CASE (hd.c + 2 * k.turn) % 7 WHEN 3 THEN ' ' WHEN 4 THEN ' {OPEN}other{SEP}x{CLOSE}' ELSE '' END AS base
  FROM conversations k JOIN hd ON hd.c = k.conv_id),
nodes AS (
  SELECT c, t, mt, n, pt, conversation_key, cyclic, dangling,
    {NODE_KEY} AS node_id,
    CASE WHEN pt IS NOT NULL THEN {_key("node-v1", "conversation_key", "'n' || pt")} END AS parent_node_id,
    CASE WHEN NOT bare THEN {_key("message-v1", "conversation_key", "'m' || t")} END AS message_id,
    CASE WHEN bare OR (t % 4 <> 1 AND c % 15 = 4 AND t = 2) THEN 'other' ELSE raw_role END AS role,
    CASE WHEN NOT bare AND (c + t) % 10 <> 9 THEN c * 1000e0 + t END AS created_at,
    CASE WHEN NOT bare AND (c + t) % 4 = 2 THEN 'multimodal_text' ELSE 'text' END AS content_type,
    CASE WHEN bare THEN '' WHEN (c + t) % 4 = 2 THEN base || chr(10) || 'part two' ELSE base END AS message_text,
    bare
  FROM nd),
refs AS (
  SELECT n.c, n.t, n.conversation_key, n.node_id, d.doc_id AS d,
    row_number() OVER (PARTITION BY n.c ORDER BY d.doc_id) - 1 AS ordinal,
    CASE WHEN d.doc_id % 2 = 0 THEN 'file-' || d.doc_id ELSE 'file-service://file-' || d.doc_id END AS reference,
    CASE d.doc_id % 4 WHEN 0 THEN 'report ' || d.doc_id || '.pdf' WHEN 1 THEN 'download'
      WHEN 2 THEN 'a_b_' || d.doc_id || '.png' ELSE 'Attachment' END AS display_name,
    CASE d.doc_id % 5 WHEN 0 THEN 'image/png' WHEN 1 THEN 'application/pdfq1' END AS claimed_mime
  FROM nodes n JOIN documents d ON d.doc_id // 10 = n.c
  WHERE n.t = 0 AND NOT n.bare
  UNION ALL
  SELECT c, t, conversation_key, node_id, NULL, 0, 'sediment://file_' || c, 'Attachment', 'imageassetpointer'
  FROM nodes WHERE t = 1 AND (c + t) % 4 = 2),
refk AS (SELECT *, {_key("attachment-v1", "conversation_key", "node_id", "CAST(ordinal AS VARCHAR)")} AS attachment_key FROM refs),
kids AS (SELECT c, pt AS t, count(*) AS n_children FROM nodes WHERE pt IS NOT NULL GROUP BY ALL),
nx AS (
  SELECT nodes.*, coalesce(k.n_children, 0) AS n_children, r.n_files IS NOT NULL AS has_attachments,
    trim(message_text) <> '' OR r.n_files IS NOT NULL OR (message_id IS NOT NULL AND coalesce(k.n_children, 0) > 1) AS renderable
  FROM nodes LEFT JOIN kids k USING (c, t)
    LEFT JOIN (SELECT c, t, count(*) AS n_files FROM refs GROUP BY ALL) r USING (c, t)),
fall AS (
  SELECT c, arg_max(t, (CASE WHEN created_at IS NULL THEN -1 ELSE created_at END, node_id)) AS leaf
  FROM nx WHERE n_children = 0 GROUP BY 1),
cur AS (
  SELECT hd.*, CASE WHEN c % 4 <> 0 AND c % 13 <> 0 THEN mt ELSE fall.leaf END AS cur_t,
    c % 4 = 0 OR c % 13 = 0 AS fell_back
  FROM hd LEFT JOIN fall USING (c)),
walk AS (
  SELECT c, cur_t AS t, 0 AS dist FROM cur WHERE cur_t IS NOT NULL
  UNION ALL
  SELECT w.c, n.pt, w.dist + 1 FROM walk w JOIN nodes n USING (c, t) WHERE n.pt IS NOT NULL AND w.dist < n.n),
stat AS (SELECT c, max(dist) AS last, count(DISTINCT t) AS seen FROM walk GROUP BY 1),
path AS (
  SELECT w.c, w.t, s.last - w.dist AS position FROM walk w JOIN stat s USING (c) JOIN hd USING (c) WHERE s.last < hd.n),
down AS (
  SELECT c, t AS root, t FROM nodes
  UNION
  SELECT d.c, d.root, n.t FROM down d JOIN nodes n ON n.c = d.c AND n.pt = d.t),
best AS (
  SELECT d.c, d.root AS t, arg_max(x.node_id, (coalesce(x.created_at, 0), x.node_id)) AS terminal_leaf
  FROM down d JOIN nx x ON x.c = d.c AND x.t = d.t WHERE x.n_children = 0 GROUP BY 1, 2),
headers AS (
  SELECT cur.c, conversation_key, shard_name, shard_ordinal,
    CASE WHEN c % 9 = 0 OR c % 10 = 7 THEN 'Untitled conversation' ELSE k.text END AS title,
    c * 1000e0 AS created_at, CASE WHEN c % 6 <> 0 THEN c * 1000e0 + mt END AS updated_at,
    CASE WHEN c % 5 <> 1 THEN c % 5 = 0 END AS archived,
    CASE WHEN c % 7 <> 1 THEN c % 7 = 0 END AS starred,
    CASE WHEN cur_t IS NOT NULL THEN {_key("node-v1", "conversation_key", "'n' || cur_t")} END AS current_node,
    x.message_count, x.has_attachments
  FROM cur JOIN (SELECT conv_id, text FROM conversations WHERE turn = 0) k ON k.conv_id = c
    JOIN (SELECT c, CAST(count(*) FILTER (renderable) AS BIGINT) AS message_count, bool_or(has_attachments) AS has_attachments
          FROM nx GROUP BY 1) x USING (c)),
diag AS (
  SELECT conversation_key, 'INVALID_NODE' AS code, 1 AS n FROM hd WHERE c > 0 AND c % 29 = 0
  UNION ALL SELECT conversation_key, 'MISSING_PARENT', 1 FROM hd WHERE dangling AND mt >= 1
  UNION ALL SELECT conversation_key, 'INVALID_CHILD_REFERENCE', 1 FROM hd WHERE c > 0 AND c % 23 = 0
  UNION ALL SELECT conversation_key, 'MISSING_CHILD', 1 FROM hd WHERE c > 0 AND c % 19 = 0
  UNION ALL SELECT conversation_key, 'MISSING_CURRENT_NODE', 1 FROM hd WHERE c % 4 <> 0 AND c % 13 = 0
  UNION ALL SELECT conversation_key, 'FALLBACK_ACTIVE_LEAF', 1 FROM cur WHERE fell_back AND cur_t IS NOT NULL
  UNION ALL SELECT conversation_key, 'ACTIVE_PATH_CYCLE', 1 FROM stat JOIN hd USING (c) WHERE stat.last >= hd.n),
bodies AS (
  SELECT conversation_key, title, coalesce(b.body, '') AS body FROM headers
  LEFT JOIN (SELECT c, string_agg(message_text, chr(10) ORDER BY 'n' || t) AS body FROM nodes
             WHERE trim(message_text) <> '' GROUP BY 1) b USING (c)),
bad AS (
  SELECT c, printf('conversations-%03d.json', c % 10) AS shard_name, c // 10 AS shard_ordinal,
    CASE c % 37 WHEN 7 THEN 'MALFORMED_RECORD' ELSE 'UNSUPPORTED_RECORD' END AS reason
  FROM h0 WHERE c % 37 IN (5, 6, 7)),
files AS (
  SELECT d, name, k, text, ml + strlen(text) AS byte_size,
    CASE k WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'audio/x-wav' WHEN 3 THEN 'application/pdf'
      WHEN 4 THEN CASE WHEN ok_text THEN 'text/plain' END END AS detected_mime,
    CASE k WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' WHEN 2 THEN 'wav' WHEN 3 THEN 'pdf'
      WHEN 4 THEN CASE WHEN ok_text THEN 'txt' END END AS detected_extension,
    CASE WHEN k IN (0, 1) THEN CASE WHEN (d * 37) % 9000 BETWEEN 1 AND 8192 AND (d * 11) % 5000 BETWEEN 1 AND 8192
             AND ((d * 37) % 9000) * ((d * 11) % 5000) <= 16777216 THEN 'image' ELSE 'unsupported' END
      WHEN k = 2 THEN 'audio' WHEN k = 3 THEN 'pdf' WHEN k = 4 AND ok_text THEN 'text' ELSE 'unsupported' END AS preview_kind,
    CASE WHEN k IN (0, 1) THEN (d * 37) % 9000 END AS width, CASE WHEN k IN (0, 1) THEN (d * 11) % 5000 END AS height,
    ok_text
  FROM (
    SELECT doc_id AS d, text, (doc_id // 3) % 6 AS k,
      CASE (doc_id // 3) % 6 WHEN 0 THEN 24 WHEN 1 THEN 39 WHEN 2 THEN 12 WHEN 3 THEN 9 WHEN 4 THEN 0 ELSE 4 END AS ml,
      strlen(text) <= 65536 OR try(decode(encode(text)[1:65536])) IS NOT NULL AS ok_text,
      unnest(CASE WHEN doc_id % 5 = 0 THEN ['file-spare-' || doc_id || '.dat'] WHEN doc_id % 7 = 1 AND doc_id % 2 = 0 THEN ['FILE-' || doc_id || '.DAT', 'File-' || doc_id || '.dat']
        WHEN doc_id % 7 = 1 THEN ['FILE-' || doc_id || '.DAT'] ELSE ['file-' || doc_id || '.dat'] END) AS name
    FROM documents)),
unique_files AS (SELECT lower(name) AS folded, min(name) AS name FROM files GROUP BY 1 HAVING count(*) = 1),
matched AS (SELECT r.*, u.name AS source_name FROM refk r LEFT JOIN unique_files u ON u.folded = 'file-' || r.d || '.dat'),
att AS (
  SELECT m.c, m.t, m.attachment_key, m.conversation_key, m.node_id, CAST(m.ordinal AS BIGINT) AS ordinal, m.source_name,
    CASE
      WHEN m.display_name LIKE 'report %' THEN 'report ' || m.d
      WHEN m.display_name LIKE 'a!_b%' ESCAPE '!' THEN 'a_b_' || m.d
      ELSE CASE WHEN m.source_name IS NULL THEN 'Missing' WHEN f.detected_mime LIKE 'image/%' THEN 'Image'
             WHEN f.detected_mime LIKE 'audio/%' THEN 'Audio' WHEN f.detected_mime LIKE 'text/%' THEN 'Text'
             WHEN f.detected_mime = 'application/pdf' THEN 'PDF' ELSE 'File' END || ' attachment ' || (m.ordinal + 1)
    END || '.' || coalesce(f.detected_extension, 'bin') AS display_name,
    m.claimed_mime, f.detected_mime, f.byte_size,
    CASE WHEN m.source_name IS NULL THEN 'missing' ELSE 'available' END AS status,
    CASE WHEN m.source_name IS NULL THEN 'missing' ELSE f.preview_kind END AS preview_kind
  FROM matched m LEFT JOIN files f ON f.name = m.source_name),
branches AS (
  SELECT r.* FROM (
    SELECT ch.c, p.t AS pt, p.position, ch.t, ch.node_id, ch.role, ch.message_text, pn.node_id AS parent_node_id,
      row_number() OVER (PARTITION BY ch.c, ch.pt ORDER BY coalesce(ch.created_at, 0), ch.node_id) AS branch_rank
    FROM path p JOIN nodes ch ON ch.c = p.c AND ch.pt = p.t JOIN nodes pn ON pn.c = p.c AND pn.t = p.t) r
  WHERE branch_rank <= 100 AND NOT EXISTS (
    SELECT 1 FROM path q WHERE q.c = r.c AND q.t = r.t AND q.position = r.position + 1)),
shown AS (
  SELECT p.c, p.t, p.position, x.conversation_key, x.node_id, x.role, x.created_at, x.message_text,
    coalesce(a.n_files, 0) AS n_files, coalesce(a.files, '') AS files, coalesce(b.n_branches, 0) AS n_branches,
    row_number() OVER (PARTITION BY p.c ORDER BY p.position) AS number
  FROM path p JOIN nx x USING (c, t)
    LEFT JOIN (SELECT c, t, count(*) AS n_files, string_agg(display_name, '|' ORDER BY ordinal) AS files FROM att GROUP BY ALL) a USING (c, t)
    LEFT JOIN (SELECT c, pt AS t, count(*) AS n_branches FROM branches GROUP BY ALL) b USING (c, t)
  WHERE trim(x.message_text) <> '' OR a.n_files IS NOT NULL OR (x.message_id IS NOT NULL AND b.n_branches > 0)),
opened AS (
  SELECT h.*, m.n_messages, m.n_files FROM headers h JOIN hd USING (c) LEFT JOIN stat s USING (c)
    LEFT JOIN (SELECT c, count(*) AS n_messages, sum(n_files) AS n_files FROM shown GROUP BY 1) m USING (c)
  WHERE s.last IS NULL OR s.last < hd.n)
"""

_VALUES = ", ".join(f"('{i}', '{s}')" for i, s in SEARCHES)
SEARCH = f"""
asked AS (SELECT * FROM (VALUES {_VALUES}) v(query_id, search)),
terms AS (
  SELECT query_id, i - 1 AS term_no, parts[i] AS term, regexp_extract_all(strip_accents(lower(parts[i])), '[\\p{{L}}\\p{{N}}]+') AS w
  FROM (SELECT query_id, string_split_regex(trim(search), '\\s+') AS parts, unnest(generate_series(1, len(parts))) AS i
        FROM asked WHERE trim(search) <> '')),
cols AS (
  SELECT conversation_key, 'title' AS "column", regexp_extract_all(strip_accents(lower(title)), '[\\p{{L}}\\p{{N}}]+') AS toks FROM bodies
  UNION ALL
  SELECT conversation_key, 'body', regexp_extract_all(strip_accents(lower(body)), '[\\p{{L}}\\p{{N}}]+') FROM bodies),
words AS (SELECT conversation_key, "column", unnest(toks) AS token, generate_subscripts(toks, 1) - 1 AS position FROM cols),
thits AS (
  SELECT t.query_id, t.term_no, c.conversation_key, c."column", p.position AS start
  FROM terms t JOIN words p ON len(t.w) > 0 AND CASE WHEN len(t.w) = 1 THEN starts_with(p.token, t.w[1]) ELSE p.token = t.w[1] END
    JOIN cols c ON c.conversation_key = p.conversation_key AND c."column" = p."column"
  WHERE len(t.w) = 1 OR (c.toks[p.position + 1 : p.position + len(t.w) - 1] = t.w[1 : len(t.w) - 1]
    AND starts_with(coalesce(c.toks[p.position + len(t.w)], ''), t.w[len(t.w)]))),
found AS (
  SELECT h.query_id, h.conversation_key FROM thits h JOIN (SELECT query_id, count(*) AS n FROM terms GROUP BY 1) USING (query_id)
  GROUP BY h.query_id, h.conversation_key, n HAVING count(DISTINCT h.term_no) = n),
wins AS (
  SELECT f.query_id, f.conversation_key, h.start, h.term_no,
    least(h.start, greatest(len(c.toks) - 18, 0)) AS pos
  FROM found f JOIN cols c ON c.conversation_key = f.conversation_key AND c."column" = 'body'
    JOIN thits h ON h.query_id = f.query_id AND h.conversation_key = f.conversation_key AND h."column" = 'body'),
scored AS (
  SELECT a.query_id, a.conversation_key, a.pos, count(DISTINCT b.term_no) AS score
  FROM (SELECT DISTINCT query_id, conversation_key, pos FROM wins) a
    JOIN wins b ON b.query_id = a.query_id AND b.conversation_key = a.conversation_key AND b.start BETWEEN a.pos AND a.pos + 17
  GROUP BY ALL),
bestwin AS (SELECT query_id, conversation_key, arg_max(pos, (score, -pos)) AS pos FROM scored GROUP BY ALL),
snips AS (
  SELECT query_id, conversation_key,
    CASE WHEN pos > 0 THEN '… ' ELSE '' END
    || regexp_replace(array_to_string(pieces[pos + 1 : pos + 18], ''), '[^\\p{{L}}\\p{{N}}]+$', '')
    || CASE WHEN pos + 18 < len(pieces) THEN ' …' ELSE '' END AS match_preview
  FROM (SELECT f.query_id, f.conversation_key, coalesce(w.pos, 0) AS pos,
          regexp_extract_all(b.body, '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}\\p{{M}}]*[^\\p{{L}}\\p{{N}}]*') AS pieces
        FROM found f JOIN bodies b USING (conversation_key) LEFT JOIN bestwin w USING (query_id, conversation_key)))
"""

LIST = "conversation_key, title, created_at, updated_at, archived, starred, has_attachments, message_count"
EFFECTIVE = "coalesce(updated_at, created_at, 0)"
KINDS = {
    "image": "detected_mime ILIKE 'image/%'", "audio": "detected_mime ILIKE 'audio/%'",
    "video": "detected_mime ILIKE 'video/%'", "pdf": "detected_mime = 'application/pdf'",
    "text": "detected_mime ILIKE 'text/%'", "missing": "status = 'missing'",
    "other": "status <> 'missing' AND (detected_mime IS NULL OR NOT regexp_matches(detected_mime, '^(image/|audio/|video/|text/|application/pdf$)'))",
}


def _base(sql: str) -> str:
    return f"WITH RECURSIVE {BASE} {sql}"


def _search(sql: str) -> str:
    return f"WITH RECURSIVE {BASE}, {SEARCH} {sql}"


_FILTERED = f"""page AS (
  SELECT {LIST} FROM headers WHERE {EFFECTIVE} BETWEEN 5000 AND 90000000 AND NOT coalesce(starred, false)
    AND conversation_key IN (SELECT conversation_key FROM att WHERE {KINDS['pdf']}))"""
_FOUND = f"""page AS (
  SELECT {LIST} FROM headers h WHERE NOT coalesce(archived, false)
    AND conversation_key IN (SELECT conversation_key FROM nodes WHERE role = 'assistant')
    AND (SELECT count(DISTINCT term_no) FROM thits WHERE query_id = 'p' AND thits.conversation_key = h.conversation_key) = 2)"""
_PAGE_SEARCH = SEARCH.replace(_VALUES, "('p', 'the th')")


def _summary(offset: int, size: int) -> str:
    return f"""SELECT total, CAST(greatest(ceil(total / {size}), 1) AS BIGINT) AS total_pages,
      CAST(least(greatest(total - {offset}, 0), {size}) AS BIGINT) AS items,
      {offset} + least(greatest(total - {offset}, 0), {size}) < total AS has_more FROM (SELECT count(*) AS total FROM page)"""


def cut(expr: str, n: int) -> str:
    """Longest prefix of n bytes that is whole characters."""
    tries = ", ".join(f"try(decode(encode({expr})[1:{n - i}]))" for i in range(4))
    return f"CASE WHEN strlen({expr}) <= {n} THEN {expr} ELSE coalesce({tries}) END"


def _document(fmt: str) -> str:
    escape = r"regexp_replace(x, '([\\`*_{}\[\]<>#|!])', '\\\1', 'g')"
    title = "trim(regexp_replace(title, '\\s+', ' ', 'g'))"
    stem = """regexp_replace(regexp_replace(title, '[^\\p{L}\\p{N}]+', '-', 'g'), '^-|-$', '', 'g')"""
    name = f"regexp_replace({cut(stem, 96)}, '-$', '')"
    notice = """CASE coalesce(n_files, 0) WHEN 0 THEN '' WHEN 1 THEN ' (1 attachment omitted.)'
      ELSE ' (' || n_files || ' attachments omitted.)' END"""
    role = "upper(left(role, 1)) || substr(role, 2)"
    role = f"CASE role WHEN 'other' THEN 'other' ELSE {role} END"
    body = "message_text || chr(10)"
    nl = "chr(10)"
    privacy, attach = PRIVACY_NOTICE.replace("'", "''"), ATTACHMENT_NOTICE
    if fmt == "md":
        head = (
            f"'# ' || {escape.replace('x,', title + ',', 1)} || {nl} || {nl} || '> {privacy}' || {nl} || '>' || {nl} "
            f"|| '> {attach}' || {notice} || {nl}"
        )
        block = (
            f"{nl} || '## ' || number || '. ' || {role} || {nl} || coalesce({nl} || 'Timestamp (Unix seconds): `' "
            f"|| CAST(CAST(created_at AS BIGINT) AS VARCHAR) || '`' || {nl}, '') || {nl} "
            f"|| CASE WHEN trim(message_text) = '' THEN '_No text content._' || {nl} ELSE {body} END"
        )
    else:
        head = (
            f"{title} || {nl} || repeat('=', least(greatest(length({title}), 3), 72)) || {nl} || {nl} || '{privacy}' || {nl} "
            f"|| '{attach}' || {notice} || {nl}"
        )
        block = (
            f"{nl} || '[' || number || '] ' || {role} || {nl} || repeat('-', 40) || {nl} || coalesce('Timestamp (Unix seconds): ' "
            f"|| CAST(CAST(created_at AS BIGINT) AS VARCHAR) || {nl} || {nl}, '') "
            f"|| CASE WHEN trim(message_text) = '' THEN '(No text content.)' || {nl} ELSE {body} END"
        )
    return f"""docs AS (
      SELECT o.conversation_key, '{fmt}' AS format, {name} || '.{fmt}' AS file_name,
        CAST(coalesce(o.n_messages, 0) AS BIGINT) AS message_count, CAST(coalesce(o.n_files, 0) AS BIGINT) AS attachment_count,
        {head} || coalesce(b.blocks, '') AS document
      FROM opened o LEFT JOIN (SELECT c, string_agg({block}, '' ORDER BY number) AS blocks FROM shown GROUP BY 1) b USING (c))"""


# Structure counters of each record before any rejection.
_PROFILE = """
pr AS (
  SELECT c, mt, printf('conversations-%03d.json', c % 10) AS shard_name, c // 10 AS shard_ordinal, c % 37 AS k,
    c > 0 AND c % 17 = 0 AND c % 11 <> 0 AND mt >= 1 AS cyclic
  FROM h0),
pc AS (
  SELECT *, k = 7 AS malformed, k <> 7 AS is_object, k IN (5, 6) AS short, k = 6 AS bad_map,
    CASE WHEN k IN (5, 6, 7) THEN 0 ELSE mt + 1 + CASE WHEN c > 0 AND c % 29 = 0 THEN 1 ELSE 0 END END AS nodes,
    CASE WHEN k IN (5, 6, 7) THEN 0 ELSE (c > 0 AND c % 11 = 0 AND mt >= 1)::INT + (c > 0 AND c % 19 = 0)::INT
      + (c % 4 <> 0 AND c % 13 = 0)::INT END AS missing,
    CASE WHEN k IN (5, 6, 7) OR NOT cyclic THEN 0 ELSE 1 END AS cycles,
    CASE WHEN k IN (5, 6, 7) THEN 0 ELSE (c % 3 = 1)::INT + u.n END AS unknown
  FROM pr JOIN (
    SELECT conv_id AS c, sum((conv_id % 5 = 2 AND turn % 2 = 1)::INT
      + CASE WHEN turn = 0 AND conv_id % 12 = 3 THEN 0 ELSE (conv_id % 5 = 3)::INT + (conv_id % 5 = 4)::INT
          + ((conv_id + turn) % 4 = 3)::INT END) AS n FROM conversations GROUP BY 1) u USING (c)),
firstbad AS (SELECT shard_name, min(shard_ordinal) AS b FROM pc WHERE malformed GROUP BY 1),
seen AS (SELECT pc.* FROM pc LEFT JOIN firstbad f USING (shard_name) WHERE f.b IS NULL OR shard_ordinal <= f.b)
"""
_FULL = "is_object AND NOT short"
_PRESENT = {
    "id": "is_object AND (short OR c % 8 <> 3)", "conversationId": f"{_FULL} AND c % 8 = 3",
    "title": f"{_FULL} AND c % 9 <> 0", "createTime": _FULL, "updateTime": f"{_FULL} AND c % 6 <> 0",
    "mapping": f"({_FULL}) OR bad_map", "currentNode": f"{_FULL} AND c % 4 <> 0",
    "isArchived": f"{_FULL} AND c % 5 <> 1 AND c % 4 <> 2", "archived": f"{_FULL} AND c % 5 <> 1 AND c % 4 = 2",
    "isStarred": f"{_FULL} AND c % 7 <> 1", "starred": "false",
}
_HAS = ", ".join(f'count(*) FILTER ({test}) AS "has_{name}"' for name, test in _PRESENT.items())
_REPORT = f"""
  count(DISTINCT shard_name) AS "shardCount",
  count(DISTINCT shard_name) - count(DISTINCT CASE WHEN malformed THEN shard_name END) AS "parsedShardCount",
  count(DISTINCT CASE WHEN malformed THEN shard_name END) AS "malformedShardCount",
  count(*) AS "conversationRecordCount", count(*) FILTER (is_object) AS "objectRecordCount",
  0::BIGINT AS "nonObjectRecordCount", sum(nodes)::BIGINT AS "mappingNodeCount", sum(missing)::BIGINT AS "missingReferenceCount",
  sum(cycles)::BIGINT AS "cycleCount", 0::BIGINT AS "oversizedRecordCount", sum(unknown)::BIGINT AS "unknownKeyCount",
  true AS "sourceUnchanged" """


def oracle_sql() -> dict[str, str]:
    out = {
        "p1_conversations": _base("SELECT * EXCLUDE (c) FROM headers"),
        "p2_quarantine": _base("SELECT shard_name, shard_ordinal, reason FROM bad"),
        "p3_nodes": _base(
            "SELECT conversation_key, node_id, parent_node_id, message_id, role, created_at, content_type, message_text, has_attachments FROM nx"
        ),
        "p10_content_types": _base(
            "SELECT role, content_type, count(*) AS nodes, count(*) FILTER (renderable) AS renderable FROM nx GROUP BY ALL"
        ),
        "p11_attachment_references": _base(
            "SELECT attachment_key, conversation_key, node_id, CAST(ordinal AS BIGINT) AS ordinal, reference, display_name, claimed_mime FROM refk"
        ),
        "p17_search_documents": _base("SELECT * FROM bodies"),
        "a3_diagnostics": _base("SELECT conversation_key, code, CAST(n AS BIGINT) AS occurrence_count FROM diag"),
        "a4_shard_stats": _base(
            """SELECT shard_name, CAST(sum(ok) AS BIGINT) AS conversations_indexed, CAST(sum(skip) AS BIGINT) AS conversations_skipped,
              CAST(sum(d) AS BIGINT) AS diagnostics FROM (
                SELECT shard_name, 1 AS ok, 0 AS skip, (SELECT count(*) FROM diag WHERE diag.conversation_key = hd.conversation_key) AS d FROM hd
                UNION ALL SELECT shard_name, 0, 1, 1 FROM bad) GROUP BY 1"""
        ),
        "a11_progress": _base(
            """SELECT shard_name, CAST(done AS BIGINT) AS records_done, CAST(least(100, floor(done * 100 / total + 0.5)) AS BIGINT) AS percent
              FROM (SELECT shard_name, sum(n) OVER (ORDER BY shard_name) AS done, sum(n) OVER () AS total
                    FROM (SELECT printf('conversations-%03d.json', c % 10) AS shard_name, count(*) AS n FROM h0 GROUP BY 1))"""
        ),
        "a13_rejections": _base("SELECT shard_name, reason, count(*) AS records FROM bad GROUP BY ALL"),
        "g1_active_path": _base(
            "SELECT x.conversation_key, x.node_id, x.role, x.created_at, x.content_type, x.message_text, CAST(p.position AS BIGINT) AS position FROM path p JOIN nx x USING (c, t)"
        ),
        "g2_path_status": _base(
            """SELECT conversation_key, CASE WHEN cur_t IS NULL THEN 'EMPTY' WHEN s.last >= n THEN 'CYCLE' ELSE 'OK' END AS status,
              CAST(coalesce(s.seen, 0) AS BIGINT) AS path_nodes FROM cur LEFT JOIN stat s USING (c)"""
        ),
        "g3_descendants": _base(
            """, up AS (SELECT c, t AS node, t, 0 AS dist, [struct_pack(at := coalesce(created_at, 0), id := node_id)] AS way FROM nodes
                 UNION ALL SELECT u.c, u.node, p.t, u.dist + 1, list_prepend(struct_pack(at := coalesce(p.created_at, 0), id := p.node_id), u.way)
                 FROM up u JOIN nodes n ON n.c = u.c AND n.t = u.t JOIN nodes p ON p.c = u.c AND p.t = n.pt WHERE u.dist < n.n),
              whole AS (SELECT c, node, max(dist) AS last, max_by(way, dist) AS way FROM up GROUP BY ALL),
              below AS (SELECT u.c, u.t, count(*) AS n FROM up u JOIN whole w USING (c, node) JOIN nodes a ON a.c = u.c AND a.t = u.t WHERE w.last < a.n GROUP BY ALL)
              SELECT a.conversation_key, a.node_id,
                row_number() OVER (PARTITION BY a.c ORDER BY w.way) - 1 AS pre,
                row_number() OVER (PARTITION BY a.c ORDER BY w.way) - 2 + b.n AS last_pre, b.n - 1 AS n_descendants
              FROM whole w JOIN nodes a ON a.c = w.c AND a.t = w.node JOIN below b ON b.c = w.c AND b.t = w.node
              WHERE w.last < a.n"""
        ),
        "g4_terminal_leaves": _base(
            "SELECT n.conversation_key, n.node_id, b.terminal_leaf FROM nodes n LEFT JOIN best b USING (c, t)"
        ),
        "g5_branches": _base(
            """SELECT h.conversation_key, b.parent_node_id, b.branch_rank, best.terminal_leaf AS leaf_node_id, b.role, left(b.message_text, 180) AS preview
              FROM branches b JOIN hd h USING (c) LEFT JOIN best ON best.c = b.c AND best.t = b.t"""
        ),
        "g6_conversation_detail": _base(
            """SELECT o.conversation_key, o.title, s.number, CAST(s.position AS BIGINT) AS position, s.node_id, s.role, s.files, s.n_branches
              FROM opened o JOIN shown s USING (c)"""
        ),
        "g7_all_paths": _base(
            """, lv AS (SELECT c, t AS leaf, t, 0 AS dist FROM nx WHERE n_children = 0
                 UNION ALL SELECT l.c, l.leaf, n.pt, l.dist + 1 FROM lv l JOIN nodes n ON n.c = l.c AND n.t = l.t WHERE n.pt IS NOT NULL AND l.dist < n.n),
              top AS (SELECT c, leaf, max(dist) AS last FROM lv GROUP BY ALL)
              SELECT a.conversation_key, b.node_id AS leaf_node_id, CAST(top.last - lv.dist AS BIGINT) AS position, a.node_id
              FROM lv JOIN top USING (c, leaf) JOIN nodes a ON a.c = lv.c AND a.t = lv.t JOIN nodes b ON b.c = lv.c AND b.t = lv.leaf
              WHERE top.last < a.n"""
        ),
        "g8_fallback_leaf": _base(
            "SELECT h.conversation_key, h.current_node FROM headers h JOIN cur USING (c) WHERE cur.fell_back AND cur.cur_t IS NOT NULL"
        ),
        "g9_cycles_and_missing_references": _base(
            f", {_PROFILE} SELECT shard_name, sum(cycles)::BIGINT AS cycles, sum(missing)::BIGINT AS missing, sum(unknown)::BIGINT AS unknown, sum(nodes)::BIGINT AS nodes FROM pc GROUP BY 1"
        ),
        "j9_leaf_nodes": _base("SELECT conversation_key, node_id FROM nx WHERE n_children = 0"),
        "f1_date_range": _base(f"SELECT {LIST} FROM headers WHERE {EFFECTIVE} BETWEEN 5000 AND 70001"),
        "f3_not_archived": _base(f"SELECT {LIST} FROM headers WHERE coalesce(archived, false) = false"),
        "f3_archived": _base(f"SELECT {LIST} FROM headers WHERE archived"),
        "f4_starred": _base(f"SELECT {LIST} FROM headers WHERE starred"),
        "f5_has_attachments": _base(f"SELECT {LIST} FROM headers WHERE has_attachments"),
        "f7_opaque_keys": _base(
            """SELECT count(*) AS rows, count(*) AS conversation_key, count(*) AS node_id, count(parent_node_id) AS parent_node_id,
              0::BIGINT AS raw_id FROM nodes"""
        ),
        "f9_all_filters": _base(
            f"""SELECT {LIST} FROM headers WHERE {EFFECTIVE} <= 1e9 AND NOT coalesce(archived, false)
              AND NOT coalesce(starred, false) AND has_attachments"""
        ),
        "j7_attachment_kinds": _base(
            " UNION ALL ".join(f"SELECT DISTINCT '{k}' AS kind, conversation_key FROM att WHERE {test}" for k, test in KINDS.items())
        ),
        "j8_roles": _base("SELECT DISTINCT role, conversation_key FROM nodes"),
        "o2_filtered_page": _base(
            f", {_FILTERED} SELECT *, NULL::VARCHAR AS match_preview FROM page ORDER BY {EFFECTIVE} DESC, conversation_key LIMIT 7 OFFSET 7"
        ),
        "o2_all_pages": _base(
            f"""SELECT conversation_key, rank, rank // 7 AS page FROM (
              SELECT conversation_key, row_number() OVER (ORDER BY {EFFECTIVE} DESC, conversation_key) - 1 AS rank FROM headers)"""
        ),
        "o3_page_summary": _base(f", {_FILTERED} {_summary(7, 7)}"),
        "t1_vocabulary": _search(
            'SELECT token, "column", count(DISTINCT conversation_key) AS conversations, count(*) AS occurrences FROM words GROUP BY ALL'
        ),
        "t2_postings": _search(
            """SELECT token, "column", conversation_key, string_agg(CAST(position AS VARCHAR), ',' ORDER BY position) AS positions FROM words GROUP BY ALL"""
        ),
        "t3_search_terms": _search(
            """SELECT t.query_id, t.term_no, t.term, len(t.w) AS n_words, count(h.start) AS hits, count(DISTINCT h.conversation_key) AS conversations
              FROM terms t LEFT JOIN thits h USING (query_id, term_no) GROUP BY ALL"""
        ),
        "t5_search_matches": _search("SELECT * FROM found"),
        "t6_phrase_hits": _search('SELECT query_id, term_no, conversation_key, "column", CAST(start AS BIGINT) AS start FROM thits'),
        "t7_snippets": _search("SELECT * FROM snips"),
        "t8_search_page": f"""WITH RECURSIVE {BASE}, {_PAGE_SEARCH}, {_FOUND}
            SELECT page.*, s.match_preview FROM page LEFT JOIN snips s USING (conversation_key)
            ORDER BY {EFFECTIVE} DESC, conversation_key LIMIT 10""",
        "t8_search_summary": f"WITH RECURSIVE {BASE}, {_PAGE_SEARCH}, {_FOUND} {_summary(0, 10)}",
        "c1_classified_files": _base(
            "SELECT name, byte_size, detected_mime, detected_extension, preview_kind, width, height FROM files"
        ),
        "c5_resolved_attachments": _base("SELECT * EXCLUDE (c, t) FROM att"),
        "c5_rejected_attachments": _base(
            """SELECT attachment_key, conversation_key, node_id, ordinal, claimed_mime,
                 CASE WHEN large THEN NULL ELSE source_name END AS source_name,
                 CASE WHEN NOT large THEN display_name
                   WHEN display_name LIKE 'report %' OR display_name LIKE 'a!_b%' ESCAPE '!' THEN regexp_replace(display_name, '[.][^.]*$', '.bin')
                   ELSE 'File attachment ' || (ordinal + 1) || '.bin' END AS display_name,
                 CASE WHEN large THEN NULL ELSE detected_mime END AS detected_mime,
                 CASE WHEN large THEN byte_size + 17179869185 ELSE byte_size END AS byte_size,
                 CASE WHEN large THEN 'rejected' ELSE status END AS status,
                 CASE WHEN large THEN 'unsupported' ELSE preview_kind END AS preview_kind
               FROM (SELECT *, coalesce(CAST(regexp_extract(source_name, '[0-9]+') AS BIGINT) % 11 = 3, false) AS large
                     FROM att)"""
        ),
        "c6_categories": _base(
            """SELECT status, CASE WHEN detected_mime LIKE 'image/%' THEN 'Image' WHEN detected_mime LIKE 'audio/%' THEN 'Audio'
              WHEN detected_mime LIKE 'text/%' THEN 'Text' WHEN detected_mime = 'application/pdf' THEN 'PDF'
              WHEN status = 'missing' THEN 'Missing' ELSE 'File' END AS category, count(*) AS files, sum(byte_size)::BIGINT AS bytes
              FROM att GROUP BY ALL"""
        ),
        "c8_type_mismatches": _base(
            "SELECT attachment_key, display_name, claimed_mime, detected_mime FROM att WHERE claimed_mime <> detected_mime"
        ),
        "c9_preview_eligible": _base(
            """SELECT attachment_key, preview_kind, detected_mime, byte_size FROM att
              WHERE preview_kind IN ('image', 'audio', 'video', 'pdf', 'text')"""
        ),
        "c10_changed_files": _base(
            """SELECT attachment_key, source_name, byte_size, CASE WHEN d % 11 <> 0 THEN byte_size + 1 END AS now_size, preview_kind,
                CASE WHEN d % 11 <> 0 THEN preview_kind END AS now_kind
              FROM (SELECT *, CAST(regexp_extract(source_name, '[0-9]+') AS BIGINT) AS d FROM att WHERE status = 'available')
              WHERE d % 11 = 0 OR d % 13 = 0"""
        ),
        "j4_attachment_matches": _base("SELECT attachment_key, source_name FROM matched WHERE source_name IS NOT NULL"),
        "j13_attachment_records": _base(
            "SELECT attachment_key, display_name, source_name, detected_mime, byte_size, preview_kind FROM att WHERE status = 'available'"
        ),
        "a12_unique_casefold": _base("SELECT * FROM unique_files"),
        "s10_text_files": _base(
            """SELECT name, CASE k WHEN 3 THEN '%PDF-1.4' || chr(10) ELSE '' END || text AS text FROM files WHERE k IN (3, 4)"""
        ),
        "a6_structure_report": _base(
            f""", {_PROFILE} SELECT {_REPORT}, {_HAS},
              CASE WHEN count(*) FILTER (malformed) > 0 THEN 'partial' ELSE 'complete' END AS completion FROM seen"""
        ),
        "a9_export_estimate": _base(
            f""", {_document('md').replace('docs AS', 'md AS', 1)}, {_document('txt').replace('docs AS', 'txt AS', 1)}
              SELECT format, count(*) AS conversation_count, CAST(sum(message_count) AS BIGINT) AS message_count,
                CAST(sum(attachment_count) AS BIGINT) AS attachment_count, CAST(sum(strlen(document)) AS BIGINT) AS byte_size
              FROM (SELECT * FROM md UNION ALL SELECT * FROM txt) GROUP BY 1"""
        ),
    }
    presence = " || ',' || ".join(f"""'"{f}":' || "has_{f}" """ for f in _PRESENT)
    first = " || ',' || ".join(
        f"""'"{f}":' || "{f}" """
        for f in ("shardCount", "parsedShardCount", "malformedShardCount", "conversationRecordCount", "objectRecordCount", "nonObjectRecordCount")
    )
    rest = " || ',' || ".join(
        f"""'"{f}":' || "{f}" """
        for f in ("mappingNodeCount", "missingReferenceCount", "cycleCount", "oversizedRecordCount", "unknownKeyCount", "sourceUnchanged")
    )
    out["i10_structure_report_json"] = _base(
        f""", {_PROFILE} SELECT '{{' || {first} || ',"knownFieldPresence":{{' || {presence} || '}},' || {rest} || '}}' AS report
          FROM (SELECT {_REPORT}, {_HAS} FROM seen)"""
    )
    for fmt, name in (("md", "e1_markdown_documents"), ("txt", "e2_plain_documents")):
        out[name] = _base(f", {_document(fmt)} SELECT *, strlen(document) AS byte_size FROM docs")
    return out
