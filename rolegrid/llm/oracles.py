"""The registered queries in DuckDB SQL, where SQL can say them."""

from __future__ import annotations

SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _mixing(sweeps: int, damping: float) -> str:
    """Raking unrolled: scales of sources (a), languages (b) and topics (c), one step after the other; then the rate."""
    steps, b, c = [], "b0", "c0"
    for k in range(1, sweeps + 2):
        steps.append(f"a{k} AS MATERIALIZED (SELECT source, s.share * (SELECT w FROM whole) / sum(tokens * b * c) AS a FROM cells JOIN {b} USING (lang) JOIN {c} USING (topic) JOIN (SELECT source, share FROM shares_source) s USING (source) GROUP BY source, s.share)")
        if k <= sweeps:
            steps.append(f"b{k} AS MATERIALIZED (SELECT lang, b * s.share * (SELECT w FROM whole) / sum(a * tokens * b * c) AS b FROM cells JOIN a{k} USING (source) JOIN {b} USING (lang) JOIN {c} USING (topic) JOIN shares_lang s USING (lang) GROUP BY lang, b, s.share)")
            steps.append(f"c{k} AS MATERIALIZED (SELECT topic, c * s.share * (SELECT w FROM whole) / sum(a * tokens * b * c) AS c FROM cells JOIN a{k} USING (source) JOIN b{k} USING (lang) JOIN {c} USING (topic) JOIN shares_topic s USING (topic) GROUP BY topic, c, s.share)")
            b, c = f"b{k}", f"c{k}"
    rates = [f"r{k} AS MATERIALIZED (SELECT CASE WHEN rest > 0 THEN (0.5 * (SELECT w FROM whole) - whole_cells) / rest ELSE r END AS r FROM (SELECT r, coalesce(sum(CASE WHEN weight * r >= 1 THEN tokens END), 0) AS whole_cells, coalesce(sum(CASE WHEN weight * r < 1 THEN tokens * weight END), 0) AS rest FROM weights, r{k - 1} GROUP BY r))" for k in range(1, 9)]
    shares = [f"shares_{m} AS MATERIALIZED (SELECT {m}, p / sum(p) OVER () AS share FROM (SELECT {m}, pow(sum(tokens)::DOUBLE, {damping}) AS p FROM cells GROUP BY {m}))" for m in ("source", "lang", "topic")]
    return f"""
        WITH d AS MATERIALIZED (
            SELECT doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens,
                   CASE WHEN contains(text, 'Licensed under') OR contains(text, 'All rights reserved') THEN 'legal' WHEN contains(text, 'token = ') OR contains(text, 'password') THEN 'config'
                        WHEN contains(text, '@mail') THEN 'contact' WHEN contains(text, ' | ') THEN 'table' WHEN coalesce(text, '') = '' THEN 'empty' ELSE 'prose' END AS topic,
                   ('0x' || substr(md5(doc_id::VARCHAR), 1, 13))::BIGINT / pow(2, 52) AS u
            FROM documents
        ), cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM d WHERE tokens > 0 GROUP BY ALL),
        whole AS (SELECT sum(tokens) AS w FROM cells), {", ".join(shares)},
        b0 AS (SELECT DISTINCT lang, 1.0::DOUBLE AS b FROM cells), c0 AS (SELECT DISTINCT topic, 1.0::DOUBLE AS c FROM cells), {", ".join(steps)},
        weights AS MATERIALIZED (SELECT source, lang, topic, tokens, a * b * c AS weight FROM cells JOIN a{sweeps + 1} USING (source) JOIN {b} USING (lang) JOIN {c} USING (topic)),
        r0 AS (SELECT 0.5::DOUBLE AS r), {", ".join(rates)}
        SELECT doc_id, tokens, topic, round(w, 6) AS weight, round(p, 6) AS probability, u < p AS sampled
        FROM (SELECT d.*, CASE WHEN d.tokens > 0 THEN weight ELSE 0 END AS w, least(1.0::DOUBLE, (SELECT r FROM r8) * CASE WHEN d.tokens > 0 THEN weight ELSE 0 END) AS p
              FROM d LEFT JOIN weights USING (source, lang, topic))"""


def _merkle() -> str:
    """Levels of all trees by recursion, then the siblings left and right of each leaf's path, folded step by step; CRC-32 by its table."""
    part = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: f"sha256({' || '.join(map(part, ('doc_id', 'source', 'lang', 'n_chars', text)))})"
    return f"""
        WITH RECURSIVE bits AS MATERIALIZED (
            SELECT v, (SELECT 1) AS one FROM range(256) t(v)
        ), crc(v, k, c) AS (
            SELECT v, 0, v::BIGINT FROM bits UNION ALL SELECT v, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM crc WHERE k < 8
        ), tab AS MATERIALIZED (SELECT list(c ORDER BY v) AS t FROM crc WHERE k = 8),
        d AS MATERIALIZED (
            SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
            FROM (SELECT doc_id, source, text, {leaf('text')} AS leaf, {leaf('harmed')} AS again
                  FROM (SELECT *, CASE WHEN xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
                            lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS harmed FROM documents, tab))
        ), lv(l, source, i, digest, c) AS (
            SELECT 0, source, i, leaf, count(*) OVER (PARTITION BY source) FROM d
            UNION ALL SELECT l + 1, source, i // 3, sha256(string_agg(digest, '' ORDER BY i)), (any_value(c) + 2) // 3 FROM lv WHERE c > 1 GROUP BY l, source, i // 3
        ), subs AS MATERIALIZED (SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM lv WHERE c = 1),
        top(l, i, digest, c) AS (
            SELECT 0, g, digest, count(*) OVER () FROM subs
            UNION ALL SELECT l + 1, i // 3, sha256(string_agg(digest, '' ORDER BY i)), (any_value(c) + 2) // 3 FROM top WHERE c > 1 GROUP BY l, i // 3
        ), near AS MATERIALIZED (
            SELECT d.r, v.l, v.i, v.digest, d.i // (3 ** v.l)::BIGINT AS me FROM d JOIN lv v ON d.source IS NOT DISTINCT FROM v.source AND v.i // 3 = d.i // (3 ** (v.l + 1))::BIGINT WHERE v.c > 1
            UNION ALL SELECT d.r, 1000 + v.l, v.i, v.digest, s.g // (3 ** v.l)::BIGINT FROM d JOIN subs s ON d.source IS NOT DISTINCT FROM s.source JOIN top v ON v.i // 3 = s.g // (3 ** (v.l + 1))::BIGINT WHERE v.c > 1
        ), steps AS MATERIALIZED (
            SELECT r, row_number() OVER (PARTITION BY r ORDER BY l) AS k, coalesce(string_agg(digest, '' ORDER BY i) FILTER (i < me), '') AS low, coalesce(string_agg(digest, '' ORDER BY i) FILTER (i > me), '') AS high
            FROM near GROUP BY r, l
        ), proofs AS (SELECT r, sha256(string_agg(low || high, '' ORDER BY k)) AS p FROM steps GROUP BY r),
        folded(r, k, digest) AS (
            SELECT r, 0, again FROM d UNION ALL SELECT f.r, s.k, sha256(s.low || f.digest || s.high) FROM folded f JOIN steps s ON s.r = f.r AND s.k = f.k + 1
        ), last AS (SELECT r, arg_max(digest, k) AS digest FROM folded GROUP BY r), root AS (SELECT digest FROM top WHERE c = 1)
        SELECT doc_id, leaf, s.digest AS subroot, root.digest AS root, coalesce(p, sha256('')) AS proof_sha256, last.digest AS folded_root, last.digest = root.digest AS verified
        FROM d JOIN subs s ON d.source IS NOT DISTINCT FROM s.source JOIN last USING (r) LEFT JOIN proofs USING (r), root"""


ORACLES = {
    "op13_lattice": """
        WITH RECURSIVE v AS MATERIALIZED (
            SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
        reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
        least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings e LEFT JOIN least ON least.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id""",
    "op11_merkle": _merkle(),
    "op8_mixing": _mixing(12, 0.7),
    "op3_decontaminate": """
        WITH words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
        ), items AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
        ), windows AS (
            SELECT DISTINCT item_id, least(10, len(w)) AS size, w[i:i + least(10, len(w)) - 1] AS words
            FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)
        ), sizes AS (SELECT DISTINCT size FROM windows), tried AS (
            SELECT doc_id, i, size, w[i:i + size - 1] AS words
            FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, sizes WHERE len(w) >= size)
        ), met AS (SELECT doc_id, i, t.size, item_id FROM tried t JOIN windows v ON t.size = v.size AND t.words = v.words),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM met) GROUP BY 1),
        named AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM met WHERE item_id IS NOT NULL) GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op4_chat": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) r(i)
        ), e AS (
            SELECT *, replace(replace(replace(replace(role, '\', '\\'), '###', '#\#\#'), '</turn>', '<\/turn>'), ':', '\:') AS er,
                   replace(replace(replace(text, '\', '\\'), '###', '#\#\#'), '</turn>', '<\/turn>') AS et FROM t
        )
        SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(length(er) + length(et) + 15)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""".replace("\\", "\\"),
    "op5_html": r"""
        WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS h FROM pages),
        t AS (SELECT page_id, url, regexp_replace(regexp_replace(h, '</?(p|h1|br)>', ' ', 'g'), '</?b>', '', 'g') AS h FROM a),
        r AS (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM t)
        SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM r""",
    "op7_neighbours": """
        WITH v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 20 = 0
        )
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20""",
    "op9_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, i, l, translate(regexp_replace(regexp_replace(l, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
            FROM (SELECT doc_id, unnest(w) AS l, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents))
        ), repeated AS (SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*)::BIGINT AS n_lines, count(r.k)::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (r.k IS NULL), '')) AS kept_sha256
        FROM lines LEFT JOIN repeated r ON lines.k = r.k GROUP BY doc_id""",
}
