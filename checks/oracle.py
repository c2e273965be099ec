"""The same queries in SQL for another engine, written from the definitions rather than the plans.

Frames, words and tokens are relational here (one row each, with window functions), so the array
expressions of the package are checked against a different formulation.
"""

from __future__ import annotations

# --- common table expressions; each string is one or more named queries ----------------------

UTT = """
utt AS (
  SELECT doc_id AS utt_id, source, lang AS language_tag, text,
         CAST(n_chars AS INTEGER) AS encoded_len, doc_id % (SELECT count(*) FROM embeddings) AS vec
  FROM documents)"""

SPK = UTT + """,
spk AS (
  SELECT utt.*, e.embedding AS speaker_emb
  FROM utt LEFT JOIN embeddings e ON e.vec_id = utt.vec)"""

FRAMES = """
chars AS (
  SELECT doc_id AS utt_id, n_chars, generate_subscripts(cs, 1) - 1 AS i, unicode(unnest(cs)) AS u
  FROM (SELECT doc_id, n_chars, string_split(text, '') AS cs FROM documents)),
fr AS (
  SELECT utt_id, n_chars, i, u % 4032 AS a, (u * 7) % 4032 AS b, (i // 3) % 4032 AS c,
         (u // 2) % 4032 AS d
  FROM chars)"""

KEPT = FRAMES + """,
kept AS (
  SELECT utt_id, n_chars, i, a, b, c, d
  FROM (SELECT *, lag(a) OVER w AS pa, lag(b) OVER w AS pb, lag(c) OVER w AS pc, lag(d) OVER w AS pd
        FROM fr WINDOW w AS (PARTITION BY utt_id ORDER BY i))
  WHERE pa IS NULL OR a <> pa OR b <> pb OR c <> pc OR d <> pd),
codes AS (
  SELECT utt_id,
         string_agg(concat_ws(',', a + 64410, b + 68442, c + 72474, d + 76506), ',' ORDER BY i) AS cs,
         CAST(4 * count(*) AS INTEGER) AS nc
  FROM kept GROUP BY utt_id)"""

WORD = "'[^ \\t\\r\\n\\f]+'"

# The bytes of a word, each plus 10.
BYTE_IDS = """array_to_string(list_transform(regexp_extract_all(hex(encode(word)), '..'),
    lambda x: 16 * strpos('0123456789ABCDEF', x[1]) + strpos('0123456789ABCDEF', x[2]) - 7), ',')"""

VOCAB = UTT + f""",
vocab AS (
  SELECT word, 266 + row_number() OVER (ORDER BY n DESC, md5('vocab:' || word), word) - 1 AS token_id
  FROM (SELECT word, count(*) AS n
        FROM (SELECT unnest(regexp_extract_all(text, {WORD})) AS word FROM utt) GROUP BY word)
  QUALIFY token_id < 64400),
prompts AS (
  SELECT utt_id, CASE WHEN language_tag IS NULL THEN text
                      ELSE lower(language_tag) || ': ' || text END AS prompt
  FROM utt),
words AS (
  SELECT utt_id, generate_subscripts(ws, 1) - 1 AS word_pos, unnest(ws) AS word
  FROM (SELECT utt_id, regexp_extract_all(prompt, {WORD}) AS ws FROM prompts)),
coded AS (
  SELECT word, CASE WHEN token_id IS NULL THEN '42,' || {BYTE_IDS} ELSE CAST(token_id AS VARCHAR) END AS ids,
         CASE WHEN token_id IS NULL THEN 1 + octet_length(encode(word)) ELSE 1 END AS n
  FROM (SELECT DISTINCT word FROM words) LEFT JOIN vocab USING (word)),
found AS (SELECT utt_id, word_pos, ids, n FROM words JOIN coded USING (word)),
toks AS (
  SELECT utt_id, '1,' || coalesce(string_agg(ids, ',' ORDER BY word_pos) || ',', '') || '2' AS ts,
         CAST(2 + coalesce(sum(n), 0) AS INTEGER) AS nt
  FROM prompts LEFT JOIN found USING (utt_id) GROUP BY utt_id)"""

IDS = VOCAB + "," + KEPT + """,
ids AS (
  SELECT utt_id, nt, nc, nt + nc + 6 AS n,
         '64403,' || ts || ',64404,64405,64401,' || cs || ',64402,64406' AS s
  FROM toks JOIN codes USING (utt_id))"""

TOKENS = IDS + """,
tok AS (
  SELECT utt_id, generate_subscripts(l, 1) AS i, CAST(unnest(l) AS BIGINT) AS t
  FROM (SELECT utt_id, string_split(s, ',') AS l FROM ids))"""

HALVES = TOKENS + """,
halves AS (
  SELECT utt_id, i, 2 * (i - 1 - na) + na // 4 AS p2
  FROM (SELECT utt_id, i, coalesce(sum(CASE WHEN t >= 64410 THEN 1 ELSE 0 END) OVER
               (PARTITION BY utt_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
               AS na FROM tok))"""


def rank(seed: str, key: str = "utt_id") -> str:
    return f"row_number() OVER (ORDER BY md5('{seed}:' || {key}), {key}) - 1"


BATCHED = IDS + f""",
placed AS (
  SELECT ids.*, ({rank('7:0')}) // 8 AS batch_id,
         utt_id % 23 <> 0 AND e.embedding IS NOT NULL AS spoken,
         utt_id % 29 <> 0 AS has_mask, utt_id % 31 <> 0 AS has_labels,
         '-100' || substr(s, 6) AS own
  FROM ids LEFT JOIN embeddings e ON e.vec_id = utt_id % (SELECT count(*) FROM embeddings)),
batch AS (
  SELECT *, bool_and(has_labels) OVER w AS keep_labels, bool_and(spoken) OVER w AS has_speaker,
         max(n) OVER w AS longest
  FROM placed WINDOW w AS (PARTITION BY batch_id)),
filled AS (SELECT *, CASE WHEN keep_labels THEN own ELSE s END AS labels FROM batch)"""

DAMAGE = UTT + """,
damage AS (
  SELECT utt_id, source, encoded_len,
         CASE WHEN utt_id % 41 = 0 THEN 'null_len'
              WHEN utt_id % 53 = 0 THEN 'empty_codes'
              WHEN utt_id % 43 = 0 THEN 'null_layer'
              WHEN utt_id % 47 = 0 THEN 'ragged_layers'
              WHEN utt_id % 59 = 0 THEN 'null_code' END AS reason
  FROM utt)"""

PRED = """
pred AS (
  SELECT vec_id // 20 AS seq_id, vec_id % 20 AS pos, embedding AS logits,
         CASE WHEN vec_id % 11 = 0 THEN -100 ELSE (vec_id * 7 + 3) % 64 END AS label,
         vec_id % 13 <> 0 AS mask
  FROM embeddings)"""

TARGETS = PRED + """,
shifted AS (
  SELECT seq_id, pos, next_label AS label, next_mask AS mask
  FROM (SELECT seq_id, pos, lead(label) OVER w AS next_label, lead(mask) OVER w AS next_mask
        FROM pred WINDOW w AS (PARTITION BY seq_id ORDER BY pos))
  WHERE next_label IS NOT NULL),
targets AS (
  SELECT seq_id, pos, label,
         CASE WHEN label >= 16 AND label < 64 THEN CAST((label - 16) // 12 AS INTEGER) END AS layer,
         label < 6 AS is_text
  FROM shifted WHERE label <> -100 AND mask)"""

SCORED = TARGETS + """,
nll AS (
  SELECT t.seq_id, t.pos, t.label, t.layer, t.is_text,
         list_max(l) + ln(list_sum(list_transform(l, lambda x: exp(x - list_max(l)))))
         - l[t.label + 1] AS nll
  FROM targets t JOIN (SELECT seq_id, pos, CAST(logits AS DOUBLE[]) AS l FROM pred) p
    ON p.seq_id = t.seq_id AND p.pos = t.pos),
ranked AS (
  SELECT seq_id, pos, id, row_number() OVER (PARTITION BY seq_id, pos ORDER BY v DESC, id) AS r
  FROM (SELECT seq_id, pos, generate_subscripts(logits, 1) - 1 AS id, unnest(logits) AS v FROM pred)),
top5 AS (
  SELECT seq_id, pos, id, CASE WHEN id >= 16 THEN (id - 16) // 12 END AS pred_layer
  FROM ranked WHERE r <= 5)"""

PPL = SCORED + """,
layers AS (SELECT CAST(unnest(range(4)) AS INTEGER) AS layer),
ppl AS (
  SELECT layers.layer, exp(avg(nll)) AS ppl
  FROM layers LEFT JOIN nll ON nll.layer = layers.layer GROUP BY layers.layer),
psum AS (
  SELECT avg(ppl) AS avg_audio_ppl, var_pop(ppl) / (avg(ppl) * avg(ppl)) AS ppl_variance,
         stddev_pop(ppl) AS ppl_std, max(ppl) - min(ppl) AS ppl_max_diff
  FROM ppl)"""

CONF = PPL + """,
hits AS (
  SELECT t.layer AS true_layer, k.pred_layer, count(DISTINCT (t.seq_id, t.pos)) AS n
  FROM targets t JOIN top5 k ON k.seq_id = t.seq_id AND k.pos = t.pos
  WHERE t.layer IS NOT NULL AND k.pred_layer IS NOT NULL GROUP BY 1, 2),
conf AS (
  SELECT a.layer AS true_layer, b.layer AS pred_layer, coalesce(h.n, 0) AS n
  FROM layers a, layers b LEFT JOIN hits h ON h.true_layer = a.layer AND h.pred_layer = b.layer),
norm AS (
  SELECT true_layer, pred_layer,
         coalesce(n / nullif(sum(n) OVER (PARTITION BY true_layer), 0), 0) AS share
  FROM conf),
csum AS (
  SELECT avg(share) FILTER (true_layer = pred_layer) AS avg_diagonal,
         min(share) FILTER (true_layer = pred_layer) AS min_diagonal,
         avg(share) FILTER (true_layer <> pred_layer) AS avg_off_diagonal,
         max(share) FILTER (true_layer <> pred_layer) AS max_off_diagonal
  FROM norm)"""

HIDDEN = """
hidden AS (
  SELECT label AS model_layer, vec_id // 20 AS seq_id, vec_id % 20 AS pos,
         CAST(embedding AS DOUBLE[]) AS vec
  FROM embeddings),
outvar AS (
  SELECT avg(v) AS avg_output_variance, min(v) AS min_output_variance, max(v) AS max_output_variance
  FROM (SELECT avg(list_aggregate(vec, 'var_samp')) AS v FROM hidden GROUP BY model_layer))"""

WIDE = CONF + "," + HIDDEN + """,
wide AS (
  SELECT * FROM (SELECT exp(avg(nll) FILTER (is_text)) AS text_ppl FROM nll), psum, csum, outvar)"""

INFLUENCE = TARGETS + """,
chosen AS (
  SELECT seq_id, pos, layer FROM targets WHERE layer IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY layer
    ORDER BY md5('42:' || seq_id || ':' || pos), seq_id, pos) <= 32),
infl AS (
  SELECT c.seq_id, c.pos, c.layer, s.pos AS src_pos,
         sqrt(list_sum(list_transform(s.logits, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))
         / (1 + c.pos - s.pos) AS influence,
         CASE WHEN s.label >= 16 AND s.label < 64 THEN (s.label - 16) // 12 END AS src_layer
  FROM chosen c JOIN pred s ON s.seq_id = c.seq_id AND s.pos <= c.pos),
share AS (
  SELECT layer, coalesce(sum(influence) FILTER (src_layer IS NULL), 0) / sum(influence)
           AS text_influence,
         coalesce(sum(influence) FILTER (src_layer = layer), 0) / sum(influence)
           AS same_layer_influence,
         coalesce(sum(influence) FILTER (src_layer <> layer), 0) / sum(influence)
           AS cross_layer_influence
  FROM infl GROUP BY layer HAVING sum(influence) > 0)"""

LOG = """
log AS (
  SELECT event_id AS step, user_id % 10 AS batch_id, 'metrics/' || event_type AS metric,
         CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN CAST('nan' AS DOUBLE)
              ELSE value END AS value
  FROM events)"""

PARAMS = """
params AS (
  SELECT event_id // 16 AS step,
         'model.learnable_rope_layers.' || (event_id % 16) || '.alpha_weight' AS param_name,
         CAST(event_id % 16 AS INTEGER) AS layer, (value - 50.0) / 50.0 AS weight,
         0.1::DOUBLE + 1.9::DOUBLE / (1 + exp(-((value - 50.0) / 50.0))) AS alpha
  FROM events)"""

HALF = PARAMS + """,
split AS (
  SELECT step, alpha, row_number() OVER (PARTITION BY step ORDER BY layer) - 1
           < count(*) OVER (PARTITION BY step) // 2 AS early
  FROM params),
halved AS (
  SELECT step, avg(alpha) FILTER (early) AS early_alpha, avg(alpha) FILTER (NOT early) AS late_alpha
  FROM split GROUP BY step HAVING count(*) FILTER (early) > 0)"""

LENGTHS = ", ".join(
    f"round({expr} / {div}, 6) AS {unit}_{name}"
    for name, expr in (
        ("mean", "avg(encoded_len)"),
        ("std", "stddev_pop(encoded_len)"),
        ("min", "min(encoded_len)"),
        ("max", "max(encoded_len)"),
        ("median", "quantile_cont(encoded_len, 0.5)"),
        ("q25", "quantile_cont(encoded_len, 0.25)"),
        ("q50", "quantile_cont(encoded_len, 0.5)"),
        ("q75", "quantile_cont(encoded_len, 0.75)"),
    )
    for unit, div in (("frames", "1.0::DOUBLE"), ("sec", "12.5::DOUBLE"))
)

# The prepared corpus: every row, then a seeded sample of 150 rows without a language tag.
PREPARED = IDS + f""",
bare AS (
  SELECT utt_id, '1,' || coalesce(string_agg(ids, ',' ORDER BY word_pos) || ',', '') || '2' AS ts,
         2 + coalesce(sum(n), 0) AS nt
  FROM utt LEFT JOIN (
    SELECT utt_id, word_pos, ids, n
    FROM (SELECT utt_id, generate_subscripts(ws, 1) AS word_pos, unnest(ws) AS word
          FROM (SELECT utt_id, regexp_extract_all(text, {WORD}) AS ws FROM utt))
    JOIN coded USING (word)) USING (utt_id) GROUP BY utt_id),
sampled AS (
  SELECT CAST(utt_id AS VARCHAR) AS utt_id FROM utt
  QUALIFY {rank('42', 'CAST(utt_id AS VARCHAR)')} < 150),
prepared AS (
  SELECT 0 AS source_ord, CAST(ids.utt_id AS VARCHAR) AS utt_id, CAST(n AS INTEGER) AS n_ids, s,
         encoded_len
  FROM ids JOIN utt USING (utt_id)
  UNION ALL
  SELECT 1, CAST(utt_id AS VARCHAR), CAST(bare.nt + nc + 6 AS INTEGER),
         '64403,' || bare.ts || ',64404,64405,64401,' || cs || ',64402,64406', encoded_len
  FROM bare JOIN codes USING (utt_id) JOIN utt USING (utt_id)
  WHERE CAST(utt_id AS VARCHAR) IN (SELECT utt_id FROM sampled))"""

# Same rows as `prepared` without building the sequences.
PREPARED_KEYS = UTT + f""",
sampled AS (
  SELECT 1 AS source_ord, CAST(utt_id AS VARCHAR) AS utt_id, encoded_len FROM utt
  QUALIFY {rank('42', 'CAST(utt_id AS VARCHAR)')} < 150),
prepared AS (
  SELECT 0 AS source_ord, CAST(utt_id AS VARCHAR) AS utt_id, encoded_len FROM utt
  UNION ALL SELECT * FROM sampled)"""


def stats_rows(section: str, div: str) -> str:
    stats = (
        ("mean", "avg(encoded_len)"),
        ("std", "stddev_pop(encoded_len)"),
        ("min", "min(encoded_len)"),
        ("max", "max(encoded_len)"),
        ("median", "quantile_cont(encoded_len, 0.5)"),
        ("q25", "quantile_cont(encoded_len, 0.25)"),
        ("q50", "quantile_cont(encoded_len, 0.5)"),
        ("q75", "quantile_cont(encoded_len, 0.75)"),
    )
    return " UNION ALL ".join(
        f"SELECT count(*) AS total_samples, '{section}' AS section, '{name}' AS statistic, "
        f"round({expr} / {div}::DOUBLE, 6) AS value FROM prepared"
        for name, expr in stats
    )


def q(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body.strip()}"


def frame_md5(a: str = "a", b: str = "b", c: str = "c", d: str = "d") -> str:
    return f"md5(string_agg(concat_ws(',', {a}, {b}, {c}, {d}), ';' ORDER BY i))"


def verdict(subject: str, metric: str, value: str, word: str, passed: str, source: str) -> str:
    return (
        f"SELECT {subject} AS subject, '{metric}' AS metric, round({value}, 6) AS value, "
        f"CASE WHEN {value} IS NULL THEN 'No data' ELSE {word} END AS verdict, "
        f"{passed} AS passed FROM {source}"
    )


PPL_WORD = (
    "CASE WHEN ppl < 50 THEN 'Excellent' WHEN ppl < 100 THEN 'Good' "
    "WHEN ppl < 200 THEN 'Acceptable' ELSE 'Poor' END"
)

SUMMARY = (
    "text_ppl",
    "avg_audio_ppl",
    "ppl_variance",
    "ppl_std",
    "ppl_max_diff",
    "avg_diagonal",
    "min_diagonal",
    "avg_off_diagonal",
    "max_off_diagonal",
    "avg_output_variance",
    "min_output_variance",
    "max_output_variance",
)

PPL_VERDICTS = (
    verdict("'layer_' || layer", "ppl", "ppl", PPL_WORD, "ppl < 200", "ppl")
    + " UNION ALL "
    + verdict(
        "'all_layers'",
        "ppl_variance",
        "ppl_variance",
        "CASE WHEN ppl_variance < 0.1 THEN 'Good layer isolation' ELSE 'High variance' END",
        "ppl_variance < 0.1",
        "psum WHERE ppl_variance IS NOT NULL",
    )
)
VARIANCE_VERDICT = verdict(
    "'outputs'",
    "avg_output_variance",
    "avg_output_variance",
    "CASE WHEN avg_output_variance > 2.0 THEN 'Excellent' WHEN avg_output_variance > 1.5 "
    "THEN 'Good' WHEN avg_output_variance > 1.0 THEN 'Acceptable' ELSE 'Poor' END",
    "avg_output_variance > 1.0",
    "outvar",
)
CONFUSION_VERDICT = verdict(
    "'diagonal'",
    "min_diagonal",
    "min_diagonal",
    "CASE WHEN min_diagonal > 0.8 THEN 'Excellent' WHEN min_diagonal > 0.6 THEN 'Good' "
    "ELSE 'Poor' END",
    "min_diagonal > 0.6",
    "csum",
)
OVERALL = " UNION ALL ".join(
    verdict(
        "'overall'",
        m,
        m,
        f"CASE WHEN {m} {op} THEN '{yes}' ELSE '{no}' END",
        f"{m} {op}",
        f"wide WHERE {m} IS NOT NULL",
    )
    for m, op, yes, no in (
        ("ppl_variance", "< 0.1", "consistent", "too high"),
        ("avg_output_variance", "> 1.5", "focused", "too diffuse"),
        ("min_diagonal", "> 0.8", "excellent", "poor"),
    )
)

ORACLE: dict[str, str] = {
    # --- sources and sinks
    "source_load": q(
        SPK,
        """
SELECT CAST(o AS INTEGER) AS source_ord, CASE o WHEN 0 THEN 'main' ELSE 'second' END AS source,
       CASE o WHEN 0 THEN 'EN' END AS language_tag, count(*) AS n_rows,
       count(DISTINCT utt_id) AS n_ids, CAST(sum(encoded_len) AS BIGINT) AS frames,
       CAST(sum(encoded_len) AS BIGINT) AS codes,
       CAST(sum(len(speaker_emb)) AS BIGINT) AS speaker_values
FROM spk, (SELECT unnest([0, 1]) AS o) GROUP BY o""",
    ),
    "source_split": q(
        UTT,
        """
SELECT CAST(o AS INTEGER) AS source_ord, name AS source, count(*) AS n_rows,
       CAST(sum(encoded_len) AS BIGINT) AS frames, CAST(sum(length(text)) AS BIGINT) AS codes
FROM utt, (SELECT unnest([0, 1, 2]) AS o, unnest(['train', 'validation', 'all']) AS name)
WHERE o = 2 OR (utt_id % 5 = 0) = (o = 1) GROUP BY o, name""",
    ),
    "training_load": q(
        PREPARED_KEYS,
        """
SELECT source_ord, utt_id,
       row_number() OVER (ORDER BY md5('7:0:' || source_ord || ':' || utt_id), source_ord, utt_id) - 1
         AS shuffle_rank
FROM prepared""",
    ),
    "training_save": q(
        # The first source carries the constant tag EN instead of the row's own language.
        PREPARED.replace("lower(language_tag)", "'en'"),
        """
SELECT source_ord, utt_id, n_ids, md5(s) AS ids_md5, true AS labels_are_ids, encoded_len
FROM prepared""",
    ),
    "stats_save": q(
        PREPARED_KEYS,
        stats_rows("duration_seconds", "12.5") + " UNION ALL " + stats_rows("encoded_length", "1.0"),
    ),
    "metric_log": q(
        LOG,
        """
SELECT p || substr(metric, 9) AS metric, count(*) AS n_rows,
       count(*) FILTER (value IS NOT NULL AND NOT isnan(value)) AS n_values, max(step) AS last_step,
       round(avg(value) FILTER (NOT isnan(value)), 6) AS mean_value
FROM log, (SELECT unnest(['metrics/', 'eval_metrics/']) AS p) GROUP BY 1""",
    ),
    "metric_log_rewritten": q(
        LOG,
        """
SELECT 'run-' || (step % 3) AS run_id, metric, batch_id, count(*) AS n_rows,
       count(*) FILTER (value IS NOT NULL AND NOT isnan(value)) AS n_values, max(step) AS last_step,
       round(avg(value) FILTER (NOT isnan(value)), 6) AS mean_value
FROM log GROUP BY ALL""",
    ),
    "rope_params": q(PARAMS, "SELECT step, param_name, layer, round(weight, 6) AS weight FROM params"),
    # --- projections
    "canonical_rename": q(
        SPK + "," + FRAMES + """,
arrays AS (
  SELECT utt_id, md5(string_agg(a, ',' ORDER BY i)) AS nano_layer_1,
         md5(string_agg(b, ',' ORDER BY i)) AS nano_layer_2,
         md5(string_agg(c, ',' ORDER BY i)) AS nano_layer_3,
         md5(string_agg(d, ',' ORDER BY i)) AS nano_layer_4
  FROM fr GROUP BY utt_id)""",
        """
SELECT utt_id, text, 'EN' AS language_tag, CAST(encoded_len AS BIGINT) AS encoded_len, nano_layer_1, nano_layer_2, nano_layer_3,
       nano_layer_4, CAST(len(speaker_emb) AS INTEGER) AS speaker_dim
FROM spk JOIN arrays USING (utt_id)""",
    ),
    "lang_prompt": q(
        UTT,
        """
SELECT utt_id, CASE WHEN language_tag = 'de' THEN text ELSE language_tag || ': ' || text END AS prompt
FROM utt""",
    ),
    "text_tokens": q(VOCAB, "SELECT utt_id, nt AS n, md5(ts) AS tokens_md5 FROM toks"),
    "text_tokens_join": q(VOCAB, "SELECT utt_id, nt AS n, md5(ts) AS tokens_md5 FROM toks"),
    "tokenizer_plugin": q(
        VOCAB,
        """
SELECT utt_id, CAST(len(w) AS INTEGER) AS n, md5(array_to_string(list_transform(w, lambda x: strlen(x)), ',')) AS ids_md5
FROM (SELECT utt_id, list_filter(string_split(prompt, ' '), lambda x: x <> '') AS w FROM prompts)""",
    ),
    "input_ids": q(IDS, "SELECT utt_id, n, md5(s) AS ids_md5 FROM ids"),
    "labels_mask": q(
        IDS,
        """
SELECT utt_id, n AS n_labels, md5(s) AS labels_md5, n AS n_mask, CAST(n AS BIGINT) AS mask_sum
FROM ids""",
    ),
    "training_columns": q(
        SPK + "," + IDS.replace(UTT, "\nunused AS (SELECT 1)"),
        """
SELECT ids.utt_id, n, encoded_len, CAST(len(speaker_emb) AS INTEGER) AS speaker_dim,
       'utt_id,input_ids,labels,attention_mask,encoded_len,speaker_emb' AS columns
FROM ids JOIN spk USING (utt_id)""",
    ),
    "vocab_extension": q(
        TOKENS,
        """
SELECT '<custom_token_' || x.i || '>' AS token, 64400 + x.i AS token_id, coalesce(u.n, 0) AS n_used
FROM (SELECT unnest(range(16138)) AS i) x
LEFT JOIN (SELECT t, count(*) AS n FROM tok GROUP BY t) u ON u.t = 64400 + x.i""",
    ),
    "token_layer": q(
        TOKENS,
        """
SELECT t AS token_id,
       CASE WHEN t >= 64410 AND t < 80538 THEN CAST((t - 64410) // 4032 AS INTEGER) END AS layer,
       t < 64400 AS is_text, count(*) AS n
FROM tok GROUP BY t""",
    ),
    "layer_range_join": q(
        TOKENS + """,
ranges AS (
  SELECT CAST(k AS INTEGER) AS layer, 64410 + 4032 * k AS lo, 64410 + 4032 * (k + 1) AS hi
  FROM (SELECT unnest(range(4)) AS k))""",
        """
SELECT t AS token_id, layer, n
FROM (SELECT t, count(*) AS n FROM tok GROUP BY t) c
LEFT JOIN ranges r ON c.t >= r.lo AND c.t < r.hi""",
    ),
    # --- filters
    "duration_filter": q(
        UTT, "SELECT utt_id, encoded_len FROM utt WHERE encoded_len / 12.5::DOUBLE <= 120"
    ),
    "nonempty_codes": q(
        UTT,
        """
SELECT utt_id, encoded_len AS n FROM utt
WHERE utt_id % 53 <> 0 AND utt_id % 43 <> 0""",
    ),
    "valid_labels": q(
        PRED, "SELECT seq_id, pos, label, label <> -100 AND mask AS scored FROM pred"
    ),
    "layer_mask": q(TARGETS, "SELECT seq_id, pos, label, layer, is_text FROM targets"),
    "step_cadence": q(
        LOG,
        """
SELECT step, metric, step % 1000 = 0 AS influence_due, step % 1000 = 0 AS report_due
FROM log WHERE step % 100 = 0""",
    ),
    "row_validation": q(
        DAMAGE, "SELECT utt_id, reason AS reject_reason FROM damage WHERE reason IS NOT NULL"
    ),
    "reject_summary": q(
        DAMAGE,
        "SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n_rows FROM damage GROUP BY 1",
    ),
    "corpus_counts": q(
        UTT,
        """
SELECT CASE o WHEN 0 THEN 'main' ELSE 'second' END AS source, count(*) AS n_read,
       count(*) AS n_in_duration, CAST(0 AS BIGINT) AS n_rejected, count(*) AS n_prepared,
       CASE o WHEN 1 THEN 150::BIGINT END AS cap,
       CASE o WHEN 0 THEN count(*) ELSE least(count(*), 150) END AS n_kept,
       o = 1 AND count(*) < 150 AS short_of_cap, CAST(o AS INTEGER) AS source_ord
FROM utt, (SELECT unnest([0, 1]) AS o) GROUP BY o""",
    ),
    "preparation_counts": q(
        DAMAGE,
        """
, seen AS (
  SELECT *, encoded_len IS NULL OR reason = 'null_len' OR encoded_len <= 1500 AS passes FROM damage),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY passes AND reason IS NULL
                               ORDER BY md5('42:' || utt_id), CAST(utt_id AS VARCHAR)) AS r FROM seen),
counted AS (
  SELECT o, count(*) AS n_read, count(*) FILTER (passes) AS n_in_duration,
         count(*) FILTER (passes AND reason IS NOT NULL) AS n_rejected,
         count(*) FILTER (passes AND reason IS NULL) AS n_prepared,
         count(DISTINCT reason) FILTER (passes) AS reasons,
         CAST(sum(encoded_len) FILTER (passes AND reason IS NULL AND (o = 0 OR r <= 40)) AS BIGINT) AS frames
  FROM ranked, (SELECT unnest([0, 1]) AS o) GROUP BY o)
SELECT CAST(o AS INTEGER) AS source_ord, CASE o WHEN 0 THEN 'damaged' ELSE 'capped' END AS source, n_read,
       n_in_duration, n_rejected, n_prepared, CASE o WHEN 1 THEN 40::BIGINT END AS cap,
       CASE o WHEN 0 THEN n_prepared ELSE least(n_prepared, 40) END AS n_kept,
       o = 1 AND n_prepared < 40 AS short_of_cap, n_rejected AS rejects_found, reasons,
       CASE o WHEN 0 THEN n_prepared ELSE least(n_prepared, 40) END AS rows_found, frames
FROM counted""",
    ),
    "corpus_rejects": q(
        DAMAGE,
        """
SELECT CAST(o AS INTEGER) AS source_ord, CAST(utt_id AS VARCHAR) AS utt_id, 'damaged' AS source,
       reason AS reject_reason
FROM damage, (SELECT unnest([0, 1]) AS o)
WHERE reason IS NOT NULL AND (reason = 'null_len' OR encoded_len <= 1500)""",
    ),
    "collation_checks": q(
        BATCHED,
        """
SELECT utt_id, batch_id, has_speaker, CASE WHEN has_speaker THEN 64 END AS speaker_dim,
       CASE WHEN has_speaker THEN 'ok' ELSE 'no_speaker' END AS "check"
FROM batch""",
    ),
    # --- frames, sequences, positions
    "frame_zip": q(
        FRAMES,
        f"""
SELECT utt_id, CAST(count(*) AS INTEGER) AS n, {frame_md5()} AS frames_md5 FROM fr GROUP BY utt_id""",
    ),
    "layer_offset": q(
        FRAMES,
        f"""
SELECT utt_id, {frame_md5("a", "b + 4032", "c + 8064", "d + 12096")} AS frames_md5
FROM fr GROUP BY utt_id""",
    ),
    "frame_dedup": q(
        KEPT,
        f"""
SELECT utt_id, CAST(any_value(n_chars) AS INTEGER) AS encoded_len,
       CAST(count(*) AS INTEGER) AS n_frames_kept, {frame_md5()} AS frames_md5
FROM kept GROUP BY utt_id""",
    ),
    "flatten_codes": q(KEPT, "SELECT utt_id, nc AS n, md5(cs) AS codes_md5 FROM codes"),
    "frame_positions": q(
        HALVES,
        """
SELECT utt_id, CAST(count(*) AS INTEGER) AS n, md5(string_agg(p2, ',' ORDER BY i)) AS positions_md5
FROM halves GROUP BY utt_id""",
    ),
    "frame_positions_sequences": q(
        HALVES,
        """
SELECT utt_id, CAST(count(*) AS INTEGER) AS n, md5(string_agg(p2, ',' ORDER BY i)) AS positions_md5
FROM halves GROUP BY utt_id""",
    ),
    "frame_positions_tokens": q(
        PRED,
        """
SELECT seq_id, pos, (pos - na) + (na // 4) * 0.5::DOUBLE AS position
FROM (SELECT a.seq_id, a.pos, count(b.pos) AS na
      FROM pred a LEFT JOIN pred b ON b.seq_id = a.seq_id AND b.pos < a.pos AND b.label >= 16
      GROUP BY a.seq_id, a.pos)""",
    ),
    "speaker_positions": q(
        HALVES,
        """
SELECT utt_id, CAST(count(*) + 1 AS INTEGER) AS n,
       md5('0,2,' || string_agg(p2 + 2, ',' ORDER BY i) FILTER (i > 1)) AS positions_md5
FROM halves GROUP BY utt_id""",
    ),
    "mask_insert": q(
        BATCHED,
        """
SELECT utt_id, CAST(longest + CASE WHEN has_speaker THEN 1 ELSE 0 END AS INTEGER) AS n,
       md5('1' || repeat(',1', n - 1 + CASE WHEN has_speaker THEN 1 ELSE 0 END)
               || repeat(',0', longest - n)) AS mask_md5
FROM batch""",
    ),
    "label_insert": q(
        BATCHED,
        """
SELECT utt_id, has_speaker, CAST(n + CASE WHEN has_speaker THEN 1 ELSE 0 END AS INTEGER) AS n,
       md5(CASE WHEN has_speaker
                THEN split_part(labels, ',', 1) || ',-100' || substr(labels, strpos(labels, ','))
                ELSE labels END) AS labels_md5
FROM filled""",
    ),
    "pad_batch": q(
        BATCHED,
        """
SELECT utt_id, batch_id, longest AS n_input_ids, longest AS n_labels, longest AS n_attention_mask,
       md5(s || repeat(',64407', longest - n)) AS input_ids_md5,
       md5(labels || repeat(',-100', longest - n)) AS labels_md5,
       md5('1' || repeat(',1', n - 1) || repeat(',0', longest - n)) AS attention_mask_md5
FROM filled""",
    ),
    "batch_defaults": q(
        BATCHED,
        """
SELECT utt_id, batch_id, CAST(split_part(labels, ',', 1) AS BIGINT) AS first_label,
       md5(labels) AS labels_md5, n AS n_mask
FROM filled""",
    ),
    "training_batches": q(
        HALVES.replace(IDS, IDS + f""",
placed AS (
  SELECT ids.*, e.embedding IS NOT NULL AS spoken, {rank('7:0')} AS r
  FROM ids LEFT JOIN embeddings e ON e.vec_id = utt_id % (SELECT count(*) FROM embeddings)),
batch AS (
  SELECT *, r // 8 AS batch_id, CAST(r % 8 AS INTEGER) AS batch_pos, max(n) OVER w AS longest,
         bool_and(spoken) OVER w AS has_speaker
  FROM placed WINDOW w AS (PARTITION BY r // 8))"""),
        """
SELECT b.utt_id, b.batch_id, b.batch_pos, longest AS n_ids,
       CAST(longest + has_speaker::INTEGER AS INTEGER) AS n_labels,
       CAST(longest + has_speaker::INTEGER AS INTEGER) AS n_mask, md5(head || tail) AS positions_md5
FROM (
  SELECT b.utt_id, any_value(
           CASE WHEN has_speaker THEN '0,2,' ELSE '0,' END) || string_agg(
           p2 + 2 * has_speaker::INTEGER, ',' ORDER BY i) FILTER (i > 1) AS head,
         coalesce(any_value((SELECT string_agg(',' || (last2 + 2 * k), '' ORDER BY k)
            FROM (SELECT unnest(range(1, longest - n + 1)) AS k))), '') AS tail
  FROM (SELECT h.utt_id, h.i, h.p2, b.has_speaker, b.longest, b.n,
               max(h.p2) OVER (PARTITION BY h.utt_id) + 2 * has_speaker::INTEGER AS last2
        FROM halves h JOIN batch b USING (utt_id)) b
  GROUP BY b.utt_id) p JOIN batch b USING (utt_id)""",
    ),
    # --- scoring
    "causal_shift": q(TARGETS, "SELECT seq_id, pos, label, mask FROM shifted"),
    "token_nll": q(SCORED, "SELECT seq_id, pos, label, round(nll, 6) AS nll FROM nll"),
    "token_nll_wide": q(
        SCORED,
        """
SELECT n.seq_id, n.pos, round(any_value(nll), 6) AS nll, string_agg(id, ',' ORDER BY r) AS topk
FROM nll n JOIN ranked k ON k.seq_id = n.seq_id AND k.pos = n.pos AND r <= 5
GROUP BY n.seq_id, n.pos""",
    ),
    "topk_tokens": q(
        SCORED,
        """
SELECT seq_id, pos, string_agg(id, ',' ORDER BY r) AS topk FROM ranked WHERE r <= 5
GROUP BY seq_id, pos""",
    ),
    "vector_variance": q(
        HIDDEN,
        "SELECT seq_id, pos, round(list_aggregate(vec, 'var_samp'), 6) AS variance FROM hidden",
    ),
    "vector_norm": q(
        HIDDEN,
        """
SELECT seq_id, pos, round(sqrt(list_sum(list_transform(vec, lambda x: x * x))), 6) AS norm
FROM hidden""",
    ),
    "token_lookup": q(VOCAB, "SELECT utt_id, CAST(word_pos AS INTEGER) AS word_pos, ids AS token_ids FROM found"),
    "past_token_pairs": q(
        INFLUENCE, "SELECT seq_id, pos, layer, src_pos, round(influence, 6) AS influence FROM infl"
    ),
    # --- aggregations
    "length_stats": q(
        UTT,
        f"""
SELECT language_tag, count(*) AS total_samples, {LENGTHS}
FROM utt WHERE encoded_len <= 1500 GROUP BY language_tag""",
    ),
    "corpus_preparation": q(
        IDS,
        """
SELECT language_tag, count(*) AS n_rows, CAST(sum(encoded_len) AS BIGINT) AS frames,
       CAST(sum(nc) AS BIGINT) AS codes, CAST(sum(nt) AS BIGINT) AS text_tokens,
       CAST(sum(n) AS BIGINT) AS tokens, CAST(max(n) AS INTEGER) AS longest
FROM ids JOIN utt USING (utt_id) WHERE encoded_len <= 1500 GROUP BY language_tag""",
    ),
    "stage_counts": q(
        DAMAGE,
        """
SELECT source, count(*) AS n_read,
       count(*) FILTER (reason = 'null_len' OR encoded_len <= 1500) AS n_in_duration,
       count(*) FILTER (reason = 'null_len' OR (encoded_len <= 1500 AND reason IS NOT NULL))
         AS n_rejected,
       count(*) FILTER (encoded_len <= 1500 AND reason IS NULL) AS n_prepared
FROM (SELECT source, reason, CASE WHEN reason <> 'null_len' OR reason IS NULL THEN encoded_len END
        AS encoded_len FROM damage) GROUP BY source""",
    ),
    "layer_ppl": q(PPL, "SELECT layer, round(ppl, 6) AS ppl FROM ppl"),
    "text_ppl": q(SCORED, "SELECT round(exp(avg(nll) FILTER (is_text)), 6) AS text_ppl FROM nll"),
    "ppl_summary": q(
        PPL,
        """
SELECT round(avg_audio_ppl, 6) AS avg_audio_ppl, round(ppl_variance, 6) AS ppl_variance,
       round(ppl_std, 6) AS ppl_std, round(ppl_max_diff, 6) AS ppl_max_diff FROM psum""",
    ),
    "layer_confusion": q(CONF, "SELECT true_layer, pred_layer, n FROM conf"),
    "confusion_normalized": q(
        CONF, "SELECT true_layer, pred_layer, round(share, 6) AS share FROM norm"
    ),
    "confusion_summary": q(
        CONF,
        """
SELECT round(avg_diagonal, 6) AS avg_diagonal, round(min_diagonal, 6) AS min_diagonal,
       round(avg_off_diagonal, 6) AS avg_off_diagonal, round(max_off_diagonal, 6) AS max_off_diagonal
FROM csum""",
    ),
    "output_variance": q(
        HIDDEN,
        """
SELECT round(avg_output_variance, 6) AS avg_output_variance,
       round(min_output_variance, 6) AS min_output_variance,
       round(max_output_variance, 6) AS max_output_variance FROM outvar""",
    ),
    "influence_share": q(
        INFLUENCE,
        """
SELECT layer, round(text_influence, 6) AS text_influence,
       round(same_layer_influence, 6) AS same_layer_influence,
       round(cross_layer_influence, 6) AS cross_layer_influence FROM share""",
    ),
    "eval_mean": q(
        LOG,
        """
SELECT metric, round(avg(value), 6) AS value FROM log
WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY metric""",
    ),
    "batch_evaluation": q(
        SCORED,
        """
SELECT step, metric, round(avg(value), 6) AS value
FROM (SELECT seq_id // 5 AS step, seq_id, 'metrics/loss' AS metric, avg(nll) AS value FROM nll GROUP BY seq_id
      UNION ALL SELECT seq_id // 5, seq_id, 'metrics/text_ppl', exp(avg(nll)) FROM nll WHERE is_text GROUP BY seq_id
      UNION ALL SELECT seq_id // 5, seq_id, 'metrics/layer_' || layer || '_ppl', exp(avg(nll)) FROM nll
                WHERE layer IS NOT NULL GROUP BY seq_id, layer)
WHERE seq_id % 5 < 3 GROUP BY step, metric""",
    ),
    "whole_evaluation": q(
        PPL + "," + HIDDEN,
        """
, hits AS (
  SELECT t.seq_id, t.layer AS true_layer, k.pred_layer, count(DISTINCT t.pos) AS n
  FROM targets t JOIN top5 k ON k.seq_id = t.seq_id AND k.pos = t.pos
  WHERE t.layer IS NOT NULL AND k.pred_layer IS NOT NULL GROUP BY ALL),
cell AS (
  SELECT s.seq_id, a.layer AS i, b.layer AS j,
         coalesce(coalesce(h.n, 0) / nullif(sum(coalesce(h.n, 0)) OVER (PARTITION BY s.seq_id, a.layer), 0), 0) AS share
  FROM (SELECT DISTINCT seq_id FROM targets) s, layers a, layers b
  LEFT JOIN hits h ON h.seq_id = s.seq_id AND h.true_layer = a.layer AND h.pred_layer = b.layer),
lp AS (
  SELECT seq_id, layer, exp(avg(nll)) AS ppl FROM nll WHERE layer IS NOT NULL GROUP BY ALL),
ov AS (
  SELECT seq_id, model_layer, avg(list_aggregate(vec, 'var_samp')) AS v FROM hidden GROUP BY ALL),
pairs AS (
  SELECT c.seq_id, c.layer,
         sqrt(list_sum(list_transform(s.logits, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))
         / (1 + c.pos - s.pos) AS influence,
         CASE WHEN s.label >= 16 AND s.label < 64 THEN (s.label - 16) // 12 END AS src
  FROM targets c JOIN pred s ON s.seq_id = c.seq_id AND s.pos <= c.pos
  WHERE c.layer IS NOT NULL AND c.seq_id % 5 = 0),
every AS (
  SELECT seq_id, 'loss' AS m, avg(nll) AS v FROM nll GROUP BY seq_id
  UNION ALL SELECT seq_id, 'text_ppl', exp(avg(nll)) FROM nll WHERE is_text GROUP BY seq_id
  UNION ALL SELECT seq_id, 'layer_' || layer || '_ppl', ppl FROM lp
  UNION ALL SELECT seq_id, 'avg_audio_ppl', avg(ppl) FROM lp GROUP BY seq_id
  UNION ALL SELECT seq_id, 'ppl_variance', var_pop(ppl) / (avg(ppl) * avg(ppl)) FROM lp GROUP BY seq_id
  UNION ALL SELECT seq_id, 'ppl_std', stddev_pop(ppl) FROM lp GROUP BY seq_id
  UNION ALL SELECT seq_id, 'ppl_max_diff', max(ppl) - min(ppl) FROM lp GROUP BY seq_id
  UNION ALL SELECT seq_id, 'confusion_' || i || '_' || j, share FROM cell
  UNION ALL SELECT seq_id, 'avg_diagonal', avg(share) FROM cell WHERE i = j GROUP BY seq_id
  UNION ALL SELECT seq_id, 'min_diagonal', min(share) FROM cell WHERE i = j GROUP BY seq_id
  UNION ALL SELECT seq_id, 'avg_off_diagonal', avg(share) FROM cell WHERE i <> j GROUP BY seq_id
  UNION ALL SELECT seq_id, 'max_off_diagonal', max(share) FROM cell WHERE i <> j GROUP BY seq_id
  UNION ALL SELECT seq_id, 'avg_output_variance', avg(v) FROM ov GROUP BY seq_id
  UNION ALL SELECT seq_id, 'min_output_variance', min(v) FROM ov GROUP BY seq_id
  UNION ALL SELECT seq_id, 'max_output_variance', max(v) FROM ov GROUP BY seq_id
  UNION ALL SELECT seq_id, 'layer_' || layer || '_text_influence',
                   coalesce(sum(influence) FILTER (src IS NULL), 0) / sum(influence) FROM pairs GROUP BY seq_id, layer
  UNION ALL SELECT seq_id, 'layer_' || layer || '_same_layer_influence',
                   coalesce(sum(influence) FILTER (src = layer), 0) / sum(influence) FROM pairs GROUP BY seq_id, layer
  UNION ALL SELECT seq_id, 'layer_' || layer || '_cross_layer_influence',
                   coalesce(sum(influence) FILTER (src <> layer), 0) / sum(influence) FROM pairs GROUP BY seq_id, layer)
SELECT seq_id // 5 AS step, 'metrics/' || m AS metric, round(avg(v), 6) AS value
FROM every WHERE seq_id % 5 < 3 AND v IS NOT NULL GROUP BY 1, 2""",
    ),
    "variance_reports": q(
        HIDDEN,
        """
, recorded AS (
  SELECT 10 * seq_id AS step, model_layer, avg(list_aggregate(vec, 'var_samp')) AS v FROM hidden GROUP BY ALL),
reports AS (
  SELECT DISTINCT 10 * seq_id + 5 AS step FROM hidden WHERE seq_id % 4 = 3
  UNION SELECT 10 * seq_id + 7 FROM hidden WHERE seq_id % 8 = 7
  UNION SELECT 10 * seq_id FROM hidden WHERE seq_id % 6 = 0),
met AS (
  SELECT r.step, v.v FROM recorded v ASOF JOIN reports r ON v.step <= r.step)
SELECT r.step, count(m.v) AS n_values, round(avg(m.v), 6) AS avg_output_variance,
       round(min(m.v), 6) AS min_output_variance, round(max(m.v), 6) AS max_output_variance
FROM reports r LEFT JOIN met m ON m.step = r.step GROUP BY r.step""",
    ),
    "length_sketches": q(
        UTT,
        """
SELECT language_tag, count(*) AS total_samples, round(avg(encoded_len), 6) AS mean,
       round(stddev_pop(encoded_len), 6) AS std, min(encoded_len)::BIGINT AS shortest,
       max(encoded_len)::BIGINT AS longest, true AS q25_near, true AS q50_near, true AS q75_near
FROM utt WHERE encoded_len > 0 GROUP BY language_tag""",
    ),
    "alpha_stats": q(
        PARAMS,
        """
SELECT step, round(avg(alpha), 6) AS alpha_mean, round(min(alpha), 6) AS alpha_min,
       round(max(alpha), 6) AS alpha_max, round(stddev_samp(alpha), 6) AS std_samp
FROM params GROUP BY step""",
    ),
    "alpha_metrics": q(
        PARAMS,
        """
SELECT step, 'rope_alpha/layer_' || layer || '/value' AS metric, round(alpha, 6) AS value FROM params
UNION ALL
SELECT step, 'rope_alpha/layer_' || layer || '/raw_weight', round(weight, 6) FROM params
UNION ALL
SELECT step, 'rope_alpha/mean', round(avg(alpha), 6) FROM params GROUP BY step
UNION ALL
SELECT step, 'rope_alpha/min', round(min(alpha), 6) FROM params GROUP BY step
UNION ALL
SELECT step, 'rope_alpha/max', round(max(alpha), 6) FROM params GROUP BY step
UNION ALL
SELECT step, 'rope_alpha/std', round(stddev_samp(alpha), 6) FROM params GROUP BY step
HAVING count(*) > 1""",
    ),
    "alpha_report": q(
        PARAMS,
        """
SELECT step, count(*) AS n_layers, round(min(alpha), 6) AS alpha_min,
       round(max(alpha), 6) AS alpha_max, round(avg(alpha), 6) AS alpha_mean,
       round(stddev_pop(alpha), 6) AS std_pop, round(min(weight), 6) AS weight_min,
       round(max(weight), 6) AS weight_max, round(avg(weight), 8) AS weight_mean
FROM params GROUP BY step""",
    ),
    "alpha_early_late": q(
        HALF,
        """
SELECT step, round(early_alpha, 6) AS early_alpha, round(late_alpha, 6) AS late_alpha FROM halved""",
    ),
    "lm_loss": q(
        SCORED, "SELECT round(avg(nll), 6) AS loss, count(nll) AS n_positions FROM nll"
    ),
    "metric_table": q(
        WIDE,
        " UNION ALL ".join(
            [f"SELECT 'metrics/{m}' AS metric, round({m}, 6) AS value FROM wide" for m in SUMMARY]
            + ["SELECT 'metrics/layer_' || layer || '_ppl', round(ppl, 6) FROM ppl"]
            + ["SELECT 'metrics/confusion_' || true_layer || '_' || pred_layer, round(share, 6) FROM norm"]
        ),
    ),
    # --- order, sampling, unions
    "ordered_union": q(
        UTT,
        """
SELECT utt_id, language_tag, encoded_len, CAST(o AS INTEGER) AS source_ord
FROM utt JOIN (SELECT unnest(['en', 'fr', 'de', 'rest', 'en']) AS l, unnest(range(5)) AS o) s
  ON s.l = CASE WHEN language_tag IN ('en', 'fr', 'de') THEN language_tag ELSE 'rest' END""",
    ),
    "in_source_order": q(
        UTT,
        """
SELECT CAST(o AS INTEGER) AS source_ord, utt_id AS doc_id, row_number() OVER (PARTITION BY o ORDER BY utt_id) - 1 AS row_no
FROM utt, (SELECT unnest([0, 1]) AS o)""",
    ),
    "shard_order": q(
        UTT,
        """
, numbered AS (
  SELECT CAST(o AS INTEGER) AS source_ord, utt_id AS doc_id,
         row_number() OVER (PARTITION BY o ORDER BY utt_id) - 1 AS row_no, count(*) OVER (PARTITION BY o) AS total
  FROM utt, (SELECT unnest([0, 1]) AS o))
SELECT source_ord, doc_id, row_no, CAST(n AS INTEGER) AS n,
       CAST(CASE WHEN row_no < (total % n) * (total // n + 1) THEN row_no // (total // n + 1)
                 ELSE (total % n) + (row_no - (total % n) * (total // n + 1)) // (total // n) END AS INTEGER) AS shard
FROM numbered, (SELECT unnest([1, 3, 8]) AS n)""",
    ),
    "source_cap": q(
        UTT,
        """
SELECT utt_id, language_tag, encoded_len, CAST(o AS INTEGER) AS source_ord
FROM utt JOIN (SELECT unnest(['en', 'fr', 'de', 'rest', 'en']) AS l, unnest(range(5)) AS o,
                      unnest([50, 60, NULL, 100000, 0]) AS cap) s ON s.l = CASE WHEN language_tag IN ('en', 'fr', 'de') THEN language_tag ELSE 'rest' END
QUALIFY cap IS NULL OR row_number() OVER (PARTITION BY o ORDER BY md5('42:' || utt_id), utt_id) <= cap
""",
    ),
    "training_shuffle": q(UTT, f"SELECT utt_id, {rank('7:1')} AS shuffle_rank FROM utt"),
    "influence_sample": q(INFLUENCE, "SELECT seq_id, pos, layer FROM chosen"),
    "batch_assign": q(
        UTT,
        """
SELECT utt_id, r // 8 AS batch_id, CAST(r % 8 AS INTEGER) AS batch_pos
FROM (SELECT utt_id, """ + rank("7:0") + " AS r FROM utt)",
    ),
    "eval_batch_limit": q(
        LOG,
        """
SELECT step, batch_id, metric, coalesce(isnan(value), false) AS is_nan,
       CASE WHEN NOT isnan(value) THEN round(value, 6) END AS value
FROM log WHERE batch_id < 5""",
    ),
    "layer_sort": q(
        PARAMS,
        """
SELECT step, layer,
       CAST(row_number() OVER (PARTITION BY step ORDER BY layer) - 1 AS INTEGER) AS number_place,
       CAST(row_number() OVER (PARTITION BY step ORDER BY param_name) - 1 AS INTEGER) AS name_place
FROM params""",
    ),
    # --- scalars
    "duration_sec": q(
        UTT, "SELECT utt_id, round(encoded_len / 12.5::DOUBLE, 6) AS seconds FROM utt"
    ),
    "alpha_from_weight": q(PARAMS, "SELECT step, param_name, round(alpha, 6) AS alpha FROM params"),
    "metric_names": q(
        LOG,
        """
SELECT replace(metric, 'metrics/', '') AS plain, 'eval_' || metric AS evaluated, count(*) AS n
FROM log GROUP BY metric""",
    ),
    # --- verdicts
    "ppl_verdict": q(PPL, PPL_VERDICTS),
    "variance_verdict": q(HIDDEN, VARIANCE_VERDICT),
    "influence_verdict": q(
        INFLUENCE,
        verdict(
            "'layer_' || layer",
            "same_layer_influence",
            "same_layer_influence",
            "CASE WHEN same_layer_influence > 0.6 THEN 'Good' ELSE 'Low' END",
            "same_layer_influence > 0.6",
            "share",
        )
        + " UNION ALL "
        + verdict(
            "'layer_' || layer",
            "cross_layer_influence",
            "cross_layer_influence",
            "CASE WHEN cross_layer_influence < 0.2 THEN 'Good isolation' "
            "ELSE 'High cross-layer leak' END",
            "cross_layer_influence < 0.2",
            "share",
        ),
    ),
    "confusion_verdict": q(CONF, CONFUSION_VERDICT),
    "overall_assessment": q(WIDE, OVERALL),
    "verdict_report": q(
        WIDE, " UNION ALL ".join((PPL_VERDICTS, VARIANCE_VERDICT, CONFUSION_VERDICT, OVERALL))
    ),
    "influence_metrics": q(
        INFLUENCE,
        " UNION ALL ".join(
            f"SELECT 'metrics/layer_' || layer || '_{kind}' AS metric, round({kind}, 6) AS value FROM share"
            for kind in ("text_influence", "same_layer_influence", "cross_layer_influence")
        ),
    ),
    "unmatched_positions": q(TARGETS, "SELECT seq_id, pos, label FROM targets WHERE pos = 0"),
    "alpha_change": q(
        PARAMS,
        """
SELECT step, layer, round(alpha, 6) AS alpha, round(alpha - 1.05::DOUBLE, 6) AS change,
       CASE WHEN abs(alpha - 1.05::DOUBLE) < 0.01 THEN 'no change'
            WHEN alpha - 1.05::DOUBLE > 0 THEN 'up' ELSE 'down' END AS verdict
FROM params""",
    ),
    "alpha_pattern": q(
        HALF,
        """
SELECT step, round(early_alpha, 6) AS early_alpha, round(late_alpha, 6) AS late_alpha,
       CASE WHEN early_alpha > late_alpha + 0.05::DOUBLE THEN 'early-stronger'
            WHEN late_alpha > early_alpha + 0.05::DOUBLE THEN 'late-stronger'
            ELSE 'similar' END AS pattern
FROM halved""",
    ),
}
