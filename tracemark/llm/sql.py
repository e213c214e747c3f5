"""SQL counterparts of the queries that SQL can say."""

from __future__ import annotations

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}, '-')"
_LEAF = " || ".join(_FIELD.format(f) for f in ("doc_id", "source", "lang", "n_chars", "{text}"))

MERKLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, sha256({_LEAF.format(text="text")}) AS leaf, sha256({_LEAF.format(text=_LOWER)}) AS lowered,
    xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: unicode(x)::UBIGINT),
        lambda crc, byte: list_reduce([xor(crc, byte)] || [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0], lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295::UBIGINT) AS crc FROM documents),
p AS (SELECT *, coalesce('=' || lang, '') AS key, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
nodes AS (SELECT key, 0 AS level, pos AS idx, leaf AS h, count(*) OVER (PARTITION BY key) AS size FROM p
    UNION ALL SELECT key, level + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (any_value(size) + 7) // 8 FROM nodes WHERE size > 1 GROUP BY key, level, idx // 8),
subroots AS (SELECT key, h AS subroot, row_number() OVER (ORDER BY key) - 1 AS rank FROM nodes WHERE size = 1),
above AS (SELECT 0 AS level, rank AS idx, subroot AS h, count(*) OVER () AS size FROM subroots
    UNION ALL SELECT level + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (any_value(size) + 7) // 8 FROM above WHERE size > 1 GROUP BY level, idx // 8),
all_nodes AS (SELECT key, level, idx, h, size FROM nodes UNION ALL SELECT NULL, level, idx, h, size FROM above),
runs AS (SELECT key, level, idx // 8 AS run, list(h ORDER BY idx) AS hs FROM all_nodes WHERE size > 1 GROUP BY ALL),
path AS (SELECT doc_id, p.key AS tree, p.key AS key, 0 AS level, pos AS at, CASE WHEN crc % 3 = 0 THEN lowered ELSE leaf END AS folded, '' AS proof, leaf, pos FROM p
    UNION ALL SELECT doc_id, tree, CASE WHEN r.hs IS NULL THEN NULL ELSE x.key END, CASE WHEN r.hs IS NULL THEN 0 ELSE x.level + 1 END, CASE WHEN r.hs IS NULL THEN s.rank ELSE x.at // 8 END,
        CASE WHEN r.hs IS NULL THEN folded ELSE sha256(array_to_string(r.hs[1:x.at % 8], '') || folded || array_to_string(r.hs[x.at % 8 + 2:], '')) END,
        CASE WHEN r.hs IS NULL THEN proof ELSE proof || array_to_string(r.hs[1:x.at % 8], '') || array_to_string(r.hs[x.at % 8 + 2:], '') END, leaf, pos
    FROM path x LEFT JOIN runs r ON r.key IS NOT DISTINCT FROM x.key AND r.level = x.level AND r.run = x.at // 8 JOIN subroots s ON s.key = x.tree WHERE r.hs IS NOT NULL OR x.key IS NOT NULL),
ends AS (SELECT tree, pos, max(level) AS top FROM path WHERE key IS NULL GROUP BY ALL)
SELECT x.doc_id, x.leaf, s.subroot, r.h AS root, sha256(x.proof) AS proof_sha256, x.folded AS folded_root, x.folded = r.h AS verified
FROM path x JOIN ends e ON x.tree = e.tree AND x.pos = e.pos AND x.key IS NULL AND x.level = e.top JOIN subroots s ON s.key = x.tree CROSS JOIN (SELECT h FROM above WHERE size = 1) r"""

NGRAM_JOIN = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [ws] ELSE list_transform(range(1, len(ws) - 3), lambda i: ws[i:i + 4]) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
    WHERE 100 * least(na.n, nb.n) >= 80 * greatest(na.n, nb.n) GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (any_value(na.n) + any_value(nb.n) - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT a AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(b) AS component_id FROM reach LEFT JOIN n ON n.doc_id = a GROUP BY a"""

FILL_IN_MIDDLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS us, list_transform(range(4), lambda i: ('0x' || h[8 * i + 1:8 * i + 8])::UBIGINT) AS hs FROM d),
c AS (SELECT *, least(hs[1] % (len(us) + 1), hs[2] % (len(us) + 1)) AS a, greatest(hs[1] % (len(us) + 1), hs[2] % (len(us) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN hs[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
x AS (SELECT doc_id, t, form, len(us) AS n, coalesce(array_to_string(us[1:a], ''), '') AS prefix, coalesce(array_to_string(us[a + 1:b], ''), '') AS middle, coalesce(array_to_string(us[b + 1:], ''), '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(t) AS restored_sha256 FROM x"""
