"""The derived tables of `tracemark.sources.views` as SQL common table expressions for the checks."""

from __future__ import annotations

from tracemark.functions.text import STOP_WORDS

_WORDS = "list_filter(regexp_split_to_array(lower({t}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_SENT = (
    "list_filter(list_transform(regexp_extract_all({t}, '[^.!?\\n]+[.!?]*'), "
    "lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), "
    "lambda s: len(regexp_split_to_array(s, '\\s+')) >= 5)"
)


def words_sql(t: str) -> str:
    return _WORDS.format(t=t)


def sentences_sql(t: str) -> str:
    return _SENT.format(t=t)


def _shingles(offsets: tuple[int, ...]) -> str:
    top = max(offsets)
    gram = " || ' ' || ".join(f"w[i + {o}]" for o in offsets)
    return (
        f"CASE WHEN len(w) > {top} THEN list_transform(range(1, len(w) - {top} + 1), lambda i: {gram}) "
        "ELSE [array_to_string(w, ' ')] END"
    )


def _digests(offsets: tuple[int, ...]) -> str:
    return f"list_sort(list_distinct(list_transform({_shingles(offsets)}, lambda x: md5(x))))"


def _digits(col: str) -> str:
    return (
        "array_to_string(list_transform(range(16), lambda b: coalesce("
        f"right(list_filter({col}, lambda d: d[1] = ('0123456789abcdef')[b + 1])[1], 1), "
        f"substr({col}[1], 17 + b, 1))), '')"
    )


NAME_SQL = r"\p{Lu}[\p{L}''-]+(?: \p{Lu}[\p{L}''-]+)*"
STOP_LIST = ", ".join(f"'{w}'" for w in STOP_WORDS)

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "media_files": ((), """
        SELECT doc_id AS file_id,
               '/media/' || source || '/' || doc_id || '.' ||
                   (['jpg','png','mp4','gif','mp3','xyz'])[CAST(doc_id % 6 AS INT) + 1] AS file_path,
               n_chars AS file_size, sha256(text) AS checksum,
               TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id AS INT)) AS created_at,
               '{"lang":"' || lang || '","source":"' || source || '"}' AS metadata,
               CASE WHEN doc_id % 17 = 0 THEN 'deleted' ELSE 'active' END AS status
        FROM documents"""),
    "doc_digests": ((), f"""
        SELECT file_id, {_digests((0, 1, 2))} AS d, {_digests((0,))} AS a, {_digests((0, 1))} AS p, {_digests((0, 2))} AS s
        FROM (SELECT doc_id AS file_id, {words_sql('text')} AS w FROM documents)"""),
    "media_hashes_wide": (("doc_digests",), f"""
        SELECT file_id, {_digits('d')} AS dhash, {_digits('a')} AS ahash, {_digits('p')} AS phash, {_digits('s')} AS whash
        FROM doc_digests"""),
    "media_hashes": (("media_hashes_wide",), """
        SELECT doc_id AS file_id, 'sha256' AS hash_type, sha256(text) AS hash_value FROM documents
        UNION ALL SELECT doc_id, 'md5', md5(text) FROM documents
        UNION ALL SELECT file_id, 'dhash', dhash FROM media_hashes_wide
        UNION ALL SELECT file_id, 'ahash', ahash FROM media_hashes_wide
        UNION ALL SELECT file_id, 'phash', phash FROM media_hashes_wide
        UNION ALL SELECT file_id, 'whash', whash FROM media_hashes_wide"""),
    "frames": ((), """
        SELECT vec_id // 10 AS video_id, CAST(vec_id % 10 AS INT) AS frame_idx, 25.0::DOUBLE AS fps, 8 AS height, 8 AS width,
               list_transform(embedding, lambda e:
                   least(255, greatest(0, CAST(round(128 + 400 * CAST(e AS DOUBLE)) AS INT)))) AS pixels
        FROM embeddings"""),
    "videos": (("frames",), "SELECT video_id, count(*) AS n_frames, max(fps) AS fps FROM frames GROUP BY 1"),
    "faces": (("frames",), """
        SELECT video_id, frame_idx, fps, face_idx, crop, crop[1] % 8 AS x1, crop[2] % 8 AS y1,
               crop[1] % 8 + 20 + crop[3] % 30 AS x2, crop[2] % 8 + 20 + crop[4] % 30 AS y2,
               list_sum(crop) / 32.0::DOUBLE / 255 AS xception, list_max(crop) / 255.0::DOUBLE AS meso
        FROM (SELECT video_id, frame_idx, fps, 0 AS face_idx, pixels[1:32] AS crop FROM frames WHERE video_id % 7 <> 3
              UNION ALL
              SELECT video_id, frame_idx, fps, 1, pixels[33:64] FROM frames WHERE video_id % 7 <> 3)"""),
    "ev": ((), "SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events"),
    "detection_results": ((), """
        SELECT event_id AS result_id, user_id AS file_id, event_type AS detection_type, value / 500 AS confidence_score,
               props AS result_data, value / 10 AS processing_time, ts AS created_at FROM events"""),
    "cache_entries": ((), """
        SELECT md5(event_type || '|' || user_id) AS cache_key, event_type AS cache_type, access_count, created_at,
               created_at + INTERVAL 24 HOUR AS expires_at
        FROM (SELECT event_type, user_id, count(*) AS access_count, max(ts) AS created_at FROM events GROUP BY 1, 2)"""),
    "result_envelope": (("ev",), """
        SELECT event_id AS item_id, user_id AS job_id, event_type AS detection_mode, ts, k / 100.0::DOUBLE AS confidence,
               CASE WHEN event_type IN ('click', 'view') THEN value / 500 END AS detection_confidence,
               k > 60 AS is_fake, event_type = 'signup' AND k > 80 AS is_synthetic, event_id % 7 = 0 AS is_duplicate,
               CAST(event_id % 5 AS INT) AS duplicate_count, event_type = 'purchase' AND k > 50 AS deepfake_detected,
               k % 4 AS suspicious_indicators, (k * 7 % 100) / 100.0::DOUBLE AS compression_artifacts,
               k % 11 = 0 AS metadata_inconsistent, k < 10 AS low_resolution, value / 10 AS processing_time,
               CASE WHEN event_type = 'error' AND k % 3 = 0
                    THEN (['MemoryError','ValueError','OSError','TimeoutError','RuntimeError'])[k % 5 + 1] END AS error,
               k % 9 = 0 AS has_warnings,
               CASE WHEN k % 2 = 0 THEN '2024:01:01 10:00:00' END AS m_datetime,
               CASE WHEN k % 3 <> 0 THEN CASE WHEN k % 5 = 0 THEN 'NIKON CORP' ELSE 'Acme' END END AS m_make,
               CASE WHEN k % 3 = 1 THEN 'X100' END AS m_model,
               CASE WHEN k % 4 = 0 THEN 'GIMP 2.10' WHEN k % 4 = 1 THEN 'Midjourney v5' END AS m_software,
               CASE WHEN k % 5 = 0 THEN '1,2' END AS m_gps,
               CASE WHEN k % 7 < 3 THEN '400' END AS m_iso,
               CASE WHEN k % 7 < 2 THEN '2.8' END AS m_fnumber,
               k / 100.0::DOUBLE AS xc_conf, value / 500 AS xc_anom,
               least(1.0::DOUBLE, value / 100) AS me_conf, (k % 50) / 50.0::DOUBLE AS me_anom
        FROM ev"""),
    "facts": ((), f"""
        SELECT claim,
               CASE item_id % 4 WHEN 1 THEN 'CheckDesk' WHEN 2 THEN 'System' WHEN 3 THEN 'FactWire' END AS source,
               CASE item_id % 3 WHEN 0 THEN 'False' WHEN 1 THEN 'True' ELSE 'Mostly False' END AS verdict,
               'https://facts.example/' || item_id AS url
        FROM (SELECT claim, min(item_id) AS item_id
              FROM (SELECT item_id, unnest({sentences_sql('text')}) AS claim FROM benchmark) GROUP BY 1)"""),
    "corpus": ((), """
        SELECT 1 AS tier, page_id AS item_id,
               regexp_replace(regexp_replace(html, '<(script|style)[^>]*>[^<]*</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g') AS body,
               url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages
        UNION ALL SELECT 2, doc_id, text, 'doc:' || doc_id, regexp_extract(text, '^([^\n]*)', 1) FROM documents"""),
    "model_scores": ((), """
        SELECT d.doc_id, CASE WHEN toxic = 1 OR n_chars % 5 = 0 THEN 'Misleading' ELSE 'Genuine' END AS bert_label,
               0.5::DOUBLE + (n_chars % 50) / 100.0::DOUBLE AS bert_conf,
               CASE WHEN quality = 0 THEN 'Misleading' WHEN quality = 1 THEN 'Genuine' END AS xgb_label,
               CASE WHEN quality IS NOT NULL THEN 0.5::DOUBLE + (n_chars % 40) / 80.0::DOUBLE END AS xgb_prob
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""),
    "claims": ((), f"""
        SELECT doc_id, claim_no, claim FROM (
            WITH base AS (SELECT doc_id, text, {sentences_sql('text')} AS s FROM documents
                          WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''),
            sent AS (SELECT doc_id, len(s) AS n, unnest(range(len(s))) AS pos, unnest(s) AS sentence FROM base WHERE len(s) > 3),
            tok AS (SELECT doc_id, pos, unnest(regexp_extract_all(lower(sentence), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM sent),
            tf AS (SELECT doc_id, pos, term, count(*) AS tf FROM tok WHERE term NOT IN ({STOP_LIST}) GROUP BY ALL),
            dfq AS (SELECT doc_id, term, count(*) AS df FROM tf GROUP BY ALL),
            w AS (SELECT tf.doc_id, tf.pos, tf * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1.0::DOUBLE) AS w
                  FROM tf JOIN dfq USING (doc_id, term) JOIN (SELECT doc_id, len(s) AS n FROM base) USING (doc_id)),
            sc AS (SELECT doc_id, pos, round(sum(w) / sqrt(sum(w * w)), 9) AS score FROM w GROUP BY ALL),
            rk AS (SELECT sent.doc_id, sentence, row_number() OVER (PARTITION BY sent.doc_id ORDER BY coalesce(score, 0) DESC, sent.pos) AS r
                   FROM sent LEFT JOIN sc ON sc.doc_id = sent.doc_id AND sc.pos = sent.pos)
            SELECT doc_id, CAST(r - 1 AS INT) AS claim_no, sentence AS claim FROM rk WHERE r <= 3
            UNION ALL SELECT doc_id, CAST(unnest(range(len(s))) AS INT), unnest(s) FROM base WHERE len(s) BETWEEN 1 AND 3
            UNION ALL SELECT doc_id, 0, text[1:500] FROM base WHERE len(s) = 0)"""),
    "evidence": (("claims", "corpus"), f"""
        SELECT doc_id, claim_no, tier, item_id, df, rank FROM (
            WITH cp AS (SELECT DISTINCT doc_id, claim_no, unnest({_shingles((0, 1, 2))}) AS phrase
                        FROM (SELECT doc_id, claim_no, {words_sql('claim')} AS w FROM claims)),
            ip AS (SELECT DISTINCT tier, item_id, unnest({_shingles((0, 1, 2))}) AS phrase
                   FROM (SELECT tier, item_id, {words_sql('body')} AS w FROM corpus)),
            dfq AS (SELECT tier, phrase, count(*) AS df FROM ip GROUP BY ALL),
            met AS (SELECT cp.doc_id, cp.claim_no, ip.tier, ip.item_id, min(df) AS df
                    FROM cp JOIN ip ON cp.phrase = ip.phrase JOIN dfq ON dfq.tier = ip.tier AND dfq.phrase = ip.phrase
                    WHERE NOT (ip.tier = 2 AND ip.item_id = cp.doc_id) GROUP BY ALL),
            t AS (SELECT *, min(tier) OVER (PARTITION BY doc_id, claim_no) AS best FROM met)
            SELECT doc_id, claim_no, tier, item_id, df,
                   CAST(row_number() OVER (PARTITION BY doc_id, claim_no ORDER BY df, item_id) AS INT) AS rank
            FROM t WHERE tier = best) WHERE rank <= 5"""),
    "gazetteer": ((), f"""
        SELECT DISTINCT unnest(regexp_extract_all(text, '{NAME_SQL}')) AS name FROM benchmark"""),
    "claim_entities": (("claims", "gazetteer"), f"""
        SELECT doc_id, claim_no, claim, list_filter(regexp_extract_all(claim, '{NAME_SQL}'),
               lambda e: list_contains(g, e)) AS ents FROM claims, (SELECT list(name) AS g FROM gazetteer)"""),
    "item_entities": (("corpus", "evidence", "gazetteer"), f"""
        SELECT tier, item_id, list_filter(regexp_extract_all(content, '{NAME_SQL}'),
               lambda e: list_contains(g, e)) AS ents
        FROM (SELECT tier, item_id, body AS content FROM corpus UNION ALL SELECT tier, item_id, title FROM corpus)
        SEMI JOIN (SELECT DISTINCT tier, item_id FROM evidence) e USING (tier, item_id), (SELECT list(name) AS g FROM gazetteer)"""),
    "entity_pairs": (("claim_entities", "item_entities", "evidence"), """
        SELECT doc_id, claim_no, ce, ie, list_filter(ce, lambda e: list_contains(ie, e)) AS common
        FROM (SELECT c.doc_id, c.claim_no, c.ents AS ce, coalesce(i.ents, []) AS ie FROM claim_entities c
              LEFT JOIN evidence v ON v.doc_id = c.doc_id AND v.claim_no = c.claim_no
              LEFT JOIN item_entities i ON i.tier = v.tier AND i.item_id = v.item_id)"""),
    "entity_checks": (("entity_pairs",), """
        SELECT doc_id, claim_no, bool_or(len(ce) >= 2 AND len(common) >= 2) AS checked,
               bool_or(len(ce) >= 2 AND len(common) >= 2 AND list_filter(ce, lambda e: list_contains(common, e))[1:2]
                       <> list_filter(ie, lambda e: list_contains(common, e))[1:2]) AS order_mismatch,
               max(len(ce)) AS n_entities
        FROM entity_pairs GROUP BY ALL"""),
    "training": ((), """
        SELECT d.doc_id AS id, text, 1 - quality AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""),
}


def with_views(body: str, names: tuple[str, ...]) -> str:
    """Prefix `body` with the named views and those they are built from."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in VIEWS[name][0]:
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for n in names:
        visit(n)
    body = body.strip()
    ctes = ", ".join(f"{n} AS ({VIEWS[n][1]})" for n in ordered)
    if not ctes:
        return body if body.startswith(("SELECT", "WITH")) else f"WITH {body}"
    return f"WITH {ctes} {body}" if body.startswith("SELECT") else f"WITH {ctes}, {body}"
