"""The queries in SQL, where SQL can express them."""

OP1 = r"""
WITH RECURSIVE msgs AS (
    SELECT conv_id, turn::BIGINT AS turn, role, string_split(coalesce(text, ''), chr(10)) AS parts
    FROM conversations
), lines AS (
    SELECT conv_id, turn, msg, pos, CASE WHEN norm = '' THEN -1 ELSE level END AS level, norm
    FROM (
        SELECT conv_id, turn, msg, pos,
               length(regexp_replace(regexp_extract(line, '^[ \t]*(?:>[ \t]?)+'), '[^>]', '', 'g')) AS level,
               lower(trim(regexp_replace(regexp_replace(line, '^[ \t]*(?:>[ \t]?)+', ''),
                                         '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm
        FROM (SELECT conv_id, turn, msg, unnest(parts) AS line, unnest(range(len(parts))) AS pos
              FROM (SELECT *, row_number() OVER () AS msg FROM msgs)
              WHERE conv_id IS NOT NULL AND turn IS NOT NULL)
    )
), runs AS (
    SELECT *, sum(seam) OVER (PARTITION BY msg ORDER BY pos) AS run
    FROM (SELECT *, (level IS DISTINCT FROM lag(level) OVER (PARTITION BY msg ORDER BY pos))::INT AS seam FROM lines)
), passages AS (
    SELECT conv_id, turn, level, list(norm ORDER BY pos) AS parts FROM runs WHERE level >= 0
    GROUP BY conv_id, turn, msg, run, level
), pieces AS (
    SELECT DISTINCT conv_id, turn, level, piece
    FROM (SELECT conv_id, turn, level, unnest(list_concat(parts, [whole], string_split(
              regexp_replace(whole, '([.!?]) ', '\1' || chr(10), 'g'), chr(10)))) AS piece
          FROM (SELECT *, array_to_string(parts, ' ') AS whole FROM passages))
    WHERE piece <> ''
), linked AS (
    SELECT q.conv_id, q.turn, q.level, q.piece, max(o.turn) AS origin
    FROM pieces q JOIN pieces o ON q.conv_id = o.conv_id AND q.piece = o.piece AND o.level = 0 AND o.turn < q.turn
    WHERE q.level > 0 GROUP BY ALL
), per_origin AS (
    SELECT conv_id, turn, level, origin, count(*) AS n, sum(length(piece)) AS letters FROM linked GROUP BY ALL
), links AS (
    SELECT *, sum(n) OVER (PARTITION BY conv_id, turn)::BIGINT AS n_linked FROM per_origin
    QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, letters DESC, origin DESC) = 1
), chain AS (
    SELECT conv_id, turn, origin AS root, 1::BIGINT AS depth FROM links
    UNION ALL
    SELECT c.conv_id, c.turn, l.origin, c.depth + 1
    FROM chain c JOIN links l ON l.conv_id = c.conv_id AND l.turn = c.root
), roots AS (
    SELECT conv_id, turn, arg_max(root, depth) AS root, max(depth) AS depth FROM chain GROUP BY ALL
)
SELECT m.conv_id, m.turn, m.role, coalesce(r.root, m.turn) AS thread_root, l.origin AS reply_to,
       coalesce(r.depth, 0)::BIGINT AS depth,
       len(list_filter(m.parts, lambda x: regexp_matches(x, '^[ \t]*(?:>[ \t]?)+'))) AS n_quoted,
       coalesce(l.n_linked, 0)::BIGINT AS n_linked,
       array_to_string(list_filter(m.parts, lambda x: NOT regexp_matches(x, '^[ \t]*(?:>[ \t]?)+')),
                       chr(10)) AS body,
       '<|' || coalesce(m.role, 'unknown') || '|>' || chr(10) || body AS chat
FROM msgs m LEFT JOIN links l ON m.conv_id = l.conv_id AND m.turn = l.turn
LEFT JOIN roots r ON m.conv_id = r.conv_id AND m.turn = r.turn
"""

OP4 = r"""
WITH lines AS (
    SELECT doc_id, u.pos, u.line,
           translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d,
         LATERAL (SELECT unnest(d.parts) AS line, unnest(range(len(d.parts))) AS pos) u
), first AS (
    SELECT key, min(doc_id) AS first_id FROM lines WHERE length(key) >= 10 GROUP BY key
), marked AS (
    SELECT l.doc_id, l.pos, l.line, coalesce(f.first_id < l.doc_id, false) AS gone
    FROM lines l LEFT JOIN first f ON l.key = f.key AND length(l.key) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP7 = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
    SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pairs
)
SELECT query_id, r::INTEGER AS rank, vec_id, score FROM ranked WHERE r <= 5
"""

OP9 = r"""
WITH norm AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM norm WINDOW same AS (PARTITION BY t)
"""

OP12 = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                               'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), lists AS (
    SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), totals AS (
    SELECT lang, sum(len(w))::BIGINT AS n FROM lists GROUP BY lang
), grams AS (
    SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i
          FROM lists, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)
), f AS (
    SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100
), cuts AS (
    SELECT f.lang, f.k, f.phrase, f.a, c AS cut, string_split(f.phrase, ' ') AS w
    FROM f, LATERAL (SELECT unnest(range(1, f.k)) AS c) WHERE f.k > 1
), scored AS (
    SELECT c.lang, c.k, c.phrase, c.a, x.a AS l, y.a AS r, t.n,
           ((1000::HUGEINT * c.a * t.n) // (x.a::HUGEINT * y.a))::BIGINT AS score, cut
    FROM cuts c JOIN totals t USING (lang)
    JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : c.cut], ' ')
    JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1 :], ' ')
    QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, cut) = 1
), parts AS (
    SELECT f.lang, f.a, array_to_string(string_split(f.phrase, ' ')[i : i + m - 1], ' ') AS phrase
    FROM f, LATERAL (SELECT unnest(range(2, f.k)) AS m), LATERAL (SELECT unnest(range(1, f.k - m + 2)) AS i)
    WHERE f.k > 2
), inside AS (
    SELECT lang, phrase, max(a) AS longer FROM parts GROUP BY ALL
), ranked AS (
    SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, s.a DESC, s.phrase) AS rank
    FROM scored s LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase
    WHERE i.longer IS NULL OR 100 * i.longer < 100 * s.a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""

# Bytes are compared as hexadecimal text; windows are taken from chunks, as substr walks a long text from its start.
OP8 = r"""
WITH docs AS (
    SELECT doc_id, row_number() OVER () AS num, coalesce(doc_id, 9223372036854775807) AS ord,
           hex(encode(coalesce(text, ''))) AS t
    FROM documents
), chunks AS (
    SELECT num, ord, c, substr(t, 512 * c + 1, 610) AS part
    FROM (SELECT num, ord, t, unnest(range(0, (length(t) // 2 - 50) // 256 + 1)) AS c FROM docs WHERE length(t) >= 100)
), windows AS (
    SELECT num, ord, 256 * c + i AS i, substr(part, 2 * i + 1, 100) AS w
    FROM (SELECT *, unnest(range(0, length(part) // 2 - 49)) AS i FROM chunks)
), firsts AS (
    SELECT w, min(ord) AS first FROM windows GROUP BY w
), hits AS (
    SELECT num, i, coalesce((i > 50 + lag(i) OVER (PARTITION BY num ORDER BY i))::INT, 1) AS seam
    FROM windows JOIN firsts USING (w) WHERE first < ord
), spans AS (
    SELECT num, min(i) AS a, max(i) + 50 AS b
    FROM (SELECT num, i, sum(seam) OVER (PARTITION BY num ORDER BY i) AS run FROM hits) GROUP BY num, run
), left_over AS (
    SELECT num, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS tail,
           string_agg(substr(t, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept
    FROM (SELECT num, a, b, coalesce(lag(b) OVER (PARTITION BY num ORDER BY a), 0) AS before FROM spans)
    JOIN docs USING (num) GROUP BY num
)
SELECT doc_id, (length(t) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(t, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM docs LEFT JOIN left_over USING (num)
"""

ORACLE = {
    "op1_quote_links": OP1,
    "op4_line_dedup": OP4,
    "op7_topk_search": OP7,
    "op8_suffix_dedup": OP8,
    "op9_exact_dedup": OP9,
    "op12_collocations": OP12,
}
