"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each entry is an independent ANSI-ish SQL statement over the driver's views.
The text rules are restated with RE2-compatible patterns: no look-around and
no ``\\b`` (ASCII-only in RE2), explicit Unicode whitespace classes.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Fixed values, stated here again: the twins take none from the engine
# ---------------------------------------------------------------------------
SPELLING_FIXES = (("rythmn", "rhythm"), ("whch", "which"), ("gonna", "going to"))
# Unicode white space, and the information separators U+001C..U+001F
WS = r"\t\n\x0B\x0C\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
FILE_SUFFIXES = (".txt", "_presentation.txt", "_q_and_a.txt", ".mp3")
MODELS = ("m1", "m2", "m3")
CHARS_PER_SECOND = 15.0


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def wsplit(e: str) -> str:
    return (f"(CASE WHEN length({strip(e)}) = 0 THEN []::VARCHAR[] "
            f"ELSE regexp_split_to_array({strip(e)}, '[{WS}]+') END)")


def is_blank(e: str) -> str:
    return f"({e} IS NULL OR length({strip(e)}) = 0)"


def norm_text(e: str) -> str:
    t = f"lower({e})"
    for a, b in (*SPELLING_FIXES, ("-", " ")):
        t = f"replace({t}, {q(a)}, {q(b)})"
    t = f"regexp_replace({t}, '[^\\p{{L}}\\p{{N}}_{WS}'']', '', 'g')"
    t = f"(' ' || regexp_replace({t}, '[{WS}]+', ' ', 'g') || ' ')"
    # glue "p m" / "a m" between non-word neighbours; two passes because a
    # match consumes the neighbour the next one needs
    for x in ("p", "a"):
        for _ in range(2):
            t = f"regexp_replace({t}, '([ '']){x} ?m([ ''])', '\\1{x}m\\2', 'g')"
    return f"trim({t})"


def norm_words(e: str) -> str:
    return f"list_filter(string_split({norm_text(e)}, ' '), lambda w: w <> '')"


def sentences(e: str) -> str:
    marked = f"replace(regexp_replace({e}, '([.!?])[{WS}]+', '\\1' || chr(57345), 'g'), chr(10), chr(57345))"
    return (f"list_filter(list_transform(string_split({marked}, chr(57345)), lambda s: {strip('s')}), "
            f"lambda s: length(s) > 0)")


def suffix_expr(id_col: str = "doc_id") -> str:
    arr = "[" + ", ".join(q(s) for s in FILE_SUFFIXES) + "]"
    return f"{arr}[({id_col} % 4) + 1]"


DOC_FILES = f"""doc_files AS (
  SELECT doc_id, source || '_' || CAST(doc_id AS VARCHAR) || {suffix_expr()} AS name, text, lang
  FROM documents)"""

MODEL_LIST = "[" + ", ".join(q(m) for m in MODELS) + "]"

HYPS = f"""hyps AS (
  SELECT conv_id, turn, {MODEL_LIST}[m] AS model,
    array_to_string(list_filter(list_transform({wsplit('text')}, lambda w, i:
       CASE WHEN (i*7 + conv_id + m) % (10 + 5*m) = 0 THEN NULL
            WHEN (i*11 + turn) % 17 = 0 THEN reverse(w) ELSE w END), lambda x: x IS NOT NULL), ' ') AS hyp_text
  FROM conversations, (SELECT unnest(range(1, {len(MODELS) + 1})) AS m))"""

# word-level Levenshtein by anti-diagonals: diagonal d depends on d-1 and d-2
# only, so one list_transform per step; USING KEY keeps the last row per pair.
SCORED = f"""pairs AS (
  SELECT c.conv_id, c.turn, h.model, c.text AS ref_text, h.hyp_text,
         {norm_words('c.text')} AS a, {norm_words('h.hyp_text')} AS b
  FROM conversations c JOIN hyps h ON c.conv_id = h.conv_id AND c.turn = h.turn),
dp(conv_id, turn, model, d, a, b, p2, p1) USING KEY (conv_id, turn, model) AS (
  SELECT conv_id, turn, model, 0, a, b,
         list_transform(range(0, len(a)+1), lambda i: NULL::INTEGER),
         list_transform(range(0, len(a)+1), lambda i: CASE WHEN i = 0 THEN 0 END)
  FROM pairs
  UNION ALL
  SELECT conv_id, turn, model, d + 1, a, b, p1,
     list_transform(range(0, len(a)+1), lambda i:
       CASE WHEN d + 1 - i < 0 OR d + 1 - i > len(b) THEN NULL
            WHEN i = 0 THEN d + 1
            WHEN d + 1 - i = 0 THEN i
            ELSE least(p1[i] + 1, p1[i+1] + 1, p2[i] + CASE WHEN a[i] = b[d + 1 - i] THEN 0 ELSE 1 END) END)
  FROM dp WHERE d < len(a) + len(b)),
scored AS (
  SELECT conv_id, turn, model,
         CAST(len(a) AS BIGINT) AS ref_words, CAST(len(b) AS BIGINT) AS hyp_words,
         CAST(p1[len(a)+1] AS BIGINT) AS errors,
         CASE WHEN len(a) = 0 THEN (CASE WHEN len(b) > 0 THEN 1.0 ELSE 0.0 END)
              ELSE p1[len(a)+1] / len(a) END::DOUBLE AS wer
  FROM dp),
scored2 AS (
  SELECT *, greatest(0.0, 1.0 - wer) AS accuracy,
         'c' || CAST(conv_id AS VARCHAR) || '_t' || CAST(turn AS VARCHAR) AS case_name
  FROM scored),
macro AS (
  SELECT model, avg(wer) AS avg_wer, count(*) AS n_cases, greatest(0.0, 1.0 - avg(wer)) AS avg_accuracy
  FROM scored2 GROUP BY model)"""


def _wer_with(body: str) -> str:
    return f"WITH RECURSIVE {HYPS},\n{SCORED}\n{body}"


def _pivot(col: str) -> str:
    return ", ".join(f"max(CASE WHEN model = {q(m)} THEN round({col}, 6) END) AS {m}" for m in MODELS)


ORACLES: dict[str, str] = {}

ORACLES["normalised_words"] = f"""
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, array_to_string(w, ' ') AS words
FROM (SELECT doc_id, {norm_words('text')} AS w FROM documents)"""

ORACLES["word_errors"] = _wer_with(
    "SELECT conv_id, turn, model, ref_words, hyp_words, errors FROM scored2")

ORACLES["wer_by_pair"] = _wer_with(
    "SELECT conv_id, turn, model, round(wer, 6) AS wer, round(accuracy, 6) AS accuracy FROM scored2")

ORACLES["wer_macro"] = _wer_with(
    "SELECT model, round(avg_wer, 6) AS avg_wer, round(avg_accuracy, 6) AS avg_accuracy, n_cases FROM macro")

ORACLES["leaderboard"] = _wer_with(f"""
SELECT case_name, {_pivot('accuracy')} FROM scored2 GROUP BY case_name
UNION ALL SELECT 'Average Accuracy', {_pivot('avg_accuracy')} FROM macro
UNION ALL SELECT 'Average WER', {_pivot('avg_wer')} FROM macro""")

ORACLES["best_model"] = _wer_with("""
SELECT case_name, arg_min(model, (-accuracy, model)) AS best_model, round(max(accuracy), 6) AS accuracy
FROM scored2 GROUP BY case_name
UNION ALL
SELECT '__overall__', arg_min(model, (-avg_accuracy, model)), round(max(avg_accuracy), 6) FROM macro""")


# ---------------------------------------------------------------- Q&A blocks
LABELLED = """labelled AS (
  SELECT conv_id, turn, role,
         CASE WHEN role = 'system' THEN NULL WHEN turn % 4 = 3 THEN 'Follow-up'
              WHEN role = 'user' THEN 'Question' ELSE 'Answer' END AS tag,
         CASE WHEN (conv_id + turn) % 11 = 0 THEN '' ELSE text END AS content
  FROM conversations)"""

QA_RAW = f"""{LABELLED},
qa_raw AS (
  SELECT conv_id, string_agg('[' || tag || ']: ' || content, chr(10) ORDER BY turn) AS qa_raw
  FROM labelled WHERE tag IS NOT NULL GROUP BY conv_id),
parsed AS (
  SELECT conv_id, qa_raw, list_transform(regexp_extract_all(qa_raw, '\\[(Question|Answer|Follow-up)\\]:', 1),
           lambda t, i: {{'pos': i, 'tag': t,
                          'text': {strip("regexp_split_to_array(qa_raw, '\\[(?:Question|Answer|Follow-up)\\]:')[i + 1]")}}}) AS blocks
  FROM qa_raw),
ne AS (
  SELECT conv_id, list_filter(list_transform(blocks, lambda b: {{'tag': CASE WHEN b.tag = 'Follow-up' THEN 'Question' ELSE b.tag END,
                                                               'text': b.text}}), lambda b: length(b.text) > 0) AS ne
  FROM parsed),
st AS (
  SELECT conv_id, ne, list_filter(range(1, len(ne) + 1), lambda i: i = 1 OR ne[i].tag <> ne[i - 1].tag) AS starts
  FROM ne),
runs AS (
  SELECT conv_id, list_transform(starts, lambda s, k: {{'tag': ne[s].tag,
           'text': array_to_string(list_transform(ne[s:coalesce(starts[k + 1], len(ne) + 1) - 1], lambda b: b.text), ' ')}}) AS runs
  FROM st)"""

ORACLES["qa_blocks"] = f"""WITH {QA_RAW}
SELECT conv_id, CAST(b.pos AS BIGINT) AS pos, b.tag AS tag, b.text AS text
FROM (SELECT conv_id, unnest(blocks) AS b FROM parsed)"""

ORACLES["qa_render"] = f"""WITH {QA_RAW}
SELECT conv_id, array_to_string(list_transform(runs, lambda r: '[' || r.tag || ']: ' || r.text), chr(10)) AS qa_text
FROM runs"""

ORACLES["answers_only"] = f"""WITH {QA_RAW}
SELECT conv_id, CAST(len(a) AS BIGINT) AS n_answers, array_to_string(list_transform(a, lambda r: r.text), chr(10)) AS answer_text
FROM (SELECT conv_id, list_filter(runs, lambda r: r.tag = 'Answer') AS a FROM runs)"""

ORACLES["qa_runs"] = f"""WITH {LABELLED},
t AS (SELECT conv_id, turn, CASE WHEN tag = 'Follow-up' THEN 'Question' ELSE tag END AS tag, {strip('content')} AS text
      FROM labelled WHERE tag IS NOT NULL),
f AS (SELECT *, CASE WHEN lag(tag) OVER (PARTITION BY conv_id ORDER BY turn) IS DISTINCT FROM tag THEN 1 ELSE 0 END AS st
      FROM t WHERE length(text) > 0),
g AS (SELECT *, max(CASE WHEN st = 1 THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_pos FROM f)
SELECT conv_id, run_pos, first(tag) AS tag, string_agg(text, ' ' ORDER BY turn) AS text, count(*) AS n_blocks
FROM g GROUP BY conv_id, run_pos"""

ORACLES["turn_labels"] = f"""WITH {LABELLED}
SELECT conv_id, turn, role, tag, CASE WHEN tag = 'Follow-up' THEN 'Question' ELSE tag END AS canonical_tag
FROM labelled"""

# ---------------------------------------------------------------- transcripts
SEGS = f"""segs AS (SELECT conv_id, turn, {strip('text')} AS text FROM conversations)"""

ORACLES["assemble_transcript"] = f"""WITH {SEGS}
SELECT conv_id, count(*) AS n_segments, string_agg(text, ' ' ORDER BY turn) AS raw_text,
       round(sum(length(text)) / {CHARS_PER_SECOND}, 6) AS duration_s
FROM segs GROUP BY conv_id"""

ORACLES["segment_progress"] = f"""WITH {SEGS},
t AS (SELECT conv_id, turn,
        (sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) - length(text)) / {CHARS_PER_SECOND} AS start_time,
        sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) / {CHARS_PER_SECOND} AS end_time
      FROM segs),
d AS (SELECT *, max(end_time) OVER (PARTITION BY conv_id) AS duration FROM t)
SELECT conv_id, turn, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time,
       round(least(100.0, 100.0 * end_time / nullif(duration, 0.0)), 6) AS progress
FROM d"""

ORACLES["summary_input"] = f"""WITH {QA_RAW},
rendered AS (SELECT conv_id, array_to_string(list_transform(runs, lambda r: '[' || r.tag || ']: ' || r.text), chr(10)) AS qa_text FROM runs),
{SEGS},
raw AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS raw_text FROM segs GROUP BY conv_id),
j AS (SELECT raw.conv_id, qa_text, raw_text, coalesce(nullif(qa_text, ''), raw_text) AS inp
      FROM raw LEFT JOIN rendered ON raw.conv_id = rendered.conv_id)
SELECT conv_id, CASE WHEN length(coalesce(qa_text, '')) > 0 THEN 'qa' ELSE 'raw' END AS source,
       CASE WHEN {is_blank('inp')} THEN 'error' ELSE 'ok' END AS status,
       CAST(length(inp) AS BIGINT) AS input_chars
FROM j"""


# ---------------------------------------------------------------- incremental
def stem_sql(e: str) -> str:
    return f"regexp_replace({e}, '^(.+)\\.[^.]+$', '\\1')"


FILES = f"""{DOC_FILES},
files AS (SELECT *, {stem_sql('name')} AS stem FROM doc_files)"""

OUTS = """outs AS (
  SELECT doc_id, kind FROM (
    SELECT doc_id, unnest(list_filter([CASE WHEN quality = 1 THEN 'transcript' END,
                                       CASE WHEN quality = 1 THEN 'presentation' END,
                                       CASE WHEN toxic = 0 THEN 'q_and_a' END,
                                       CASE WHEN quality = 1 THEN 'summary_txt' END,
                                       CASE WHEN toxic = 0 THEN 'summary_json' END], lambda k: k IS NOT NULL)) AS kind
    FROM labels))"""


def stage_input_sql(residue: int) -> str:
    if residue == 0:
        return "SELECT * FROM files WHERE name LIKE '%.txt' AND NOT (stem LIKE '%\\_presentation' ESCAPE '\\' OR stem LIKE '%\\_q\\_and\\_a' ESCAPE '\\')"
    if residue == 2:
        return "SELECT * FROM files WHERE name LIKE '%\\_q\\_and\\_a.txt' ESCAPE '\\'"
    return "SELECT * FROM files WHERE name LIKE '%.mp3'"


def done_sql(required) -> str:
    kinds = ", ".join(q(k) for k in required)
    return (f"SELECT doc_id FROM outs WHERE kind IN ({kinds}) GROUP BY doc_id "
            f"HAVING count(DISTINCT kind) = {len(required)}")


ORACLES["transcript_scan_filter"] = f"""WITH {FILES}
SELECT doc_id, name, stem, CAST(length(text) AS BIGINT) AS n_chars FROM ({stage_input_sql(0)})"""

ORACLES["target_filter"] = f"""WITH {DOC_FILES}
SELECT doc_id, name FROM doc_files
WHERE contains(lower(name), 'src1_') OR contains(lower(name), '_presentation')"""

ORACLES["skip_done"] = f"""WITH {FILES}, {OUTS}
SELECT doc_id, name FROM ({stage_input_sql(0)}) i
WHERE doc_id NOT IN ({done_sql(('presentation', 'q_and_a'))})"""

ORACLES["force_targets"] = f"""WITH {FILES}
SELECT doc_id, name FROM ({stage_input_sql(0)}) WHERE contains(lower(name), 'src4_1')"""


def _report(stage: str, residue: int, required) -> str:
    return f"""SELECT '{stage}' AS stage, s.status, s.n FROM (
  SELECT unnest([{{'status': 'found', 'n': found}}, {{'status': 'skipped', 'n': found - todo}},
                 {{'status': 'processed', 'n': todo - failed}}, {{'status': 'failed', 'n': failed}}]) AS s
  FROM (SELECT (SELECT count(*) FROM ({stage_input_sql(residue)})) AS found,
               (SELECT count(*) FROM ({stage_input_sql(residue)}) WHERE doc_id NOT IN ({done_sql(required)})) AS todo,
               (SELECT count(*) FROM ({stage_input_sql(residue)})
                 WHERE doc_id NOT IN ({done_sql(required)}) AND {is_blank('text')}) AS failed))"""


ORACLES["run_report"] = f"""WITH {FILES}, {OUTS}
{_report('transcribe', 3, ('transcript',))}
UNION ALL {_report('structure', 0, ('presentation', 'q_and_a'))}
UNION ALL {_report('summarize', 2, ('summary_txt', 'summary_json'))}"""

ORACLES["require_text_split"] = f"""WITH {LABELLED}
SELECT conv_id, turn, CASE WHEN {is_blank('content')} THEN 'error' ELSE 'ok' END AS status,
       CASE WHEN {is_blank('content')} THEN 'EmptyText' END AS error_class
FROM labelled"""

ORACLES["session_init"] = f"""WITH {DOC_FILES}
SELECT doc_id, sha256(lang || '/' || name || '|' || CAST((1704067200 + doc_id) * 1000000 AS VARCHAR)) AS session_id, 1704067200 + doc_id AS created_s,
       coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN '' ELSE upper(lang) END, ''),
                {stem_sql('name')}) AS title
FROM doc_files"""


# ---------------------------------------------------------------- structuring
def cue_re2(cues, anchored: bool = False) -> str:
    alts = "|".join(cues)
    lead = "^" if anchored else "(^|[^\\p{L}\\p{N}_])"
    return f"{lead}({alts})([^\\p{{L}}\\p{{N}}_]|$)".replace("\\p{L}\\p{N}_])(", "\\p{L}\\p{N}_])(")


QA_CUES_SQL = cue_re2(("this", "que", "und", "qui"))
QUESTION_CUES_SQL = cue_re2(("that", "la", "die", "los"), anchored=True)

SPLIT = f"""sp AS (
  SELECT doc_id, sents, coalesce(list_position(list_transform(sents, lambda s: regexp_matches(lower(s), '{QA_CUES_SQL}')), true), 0) AS k
  FROM (SELECT doc_id, {sentences('text')} AS sents FROM documents)),
sp2 AS (
  SELECT doc_id, k,
         CASE WHEN k = 0 THEN array_to_string(sents, ' ') ELSE array_to_string(sents[1:k-1], ' ') END AS presentation,
         CASE WHEN k = 0 THEN '' ELSE array_to_string(sents[k:], ' ') END AS q_and_a
  FROM sp)"""

ORACLES["presentation_split"] = f"""WITH {SPLIT}
SELECT doc_id, CAST(nullif(k, 0) AS BIGINT) AS cue_sentence, CAST(length(presentation) AS BIGINT) AS presentation_chars,
       CAST(length(q_and_a) AS BIGINT) AS qa_chars FROM sp2"""

ORACLES["sentence_labels"] = f"""WITH {SPLIT},
lab AS (
  SELECT doc_id, presentation, list_transform({sentences('q_and_a')}, lambda s:
           {{'tag': CASE WHEN s LIKE '%?' OR regexp_matches(lower(s), '{QUESTION_CUES_SQL}') THEN 'Question' ELSE 'Answer' END,
            'text': s}}) AS ne
  FROM sp2),
st AS (SELECT doc_id, presentation, ne,
              list_filter(range(1, len(ne) + 1), lambda i: i = 1 OR ne[i].tag <> ne[i - 1].tag) AS starts FROM lab),
runs AS (
  SELECT doc_id, presentation, list_transform(starts, lambda s, k: {{'tag': ne[s].tag,
           'text': array_to_string(list_transform(ne[s:coalesce(starts[k + 1], len(ne) + 1) - 1], lambda b: b.text), ' ')}}) AS runs
  FROM st)
SELECT doc_id, CAST(length(presentation) AS BIGINT) AS presentation_chars,
       array_to_string(list_transform(runs, lambda r: '[' || r.tag || ']: ' || r.text), chr(10)) AS structured_qa_text
FROM runs"""

ORACLES["verbatim"] = f"""WITH {QA_RAW},
{SEGS},
raw AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS raw_text FROM segs GROUP BY conv_id),
firstqa AS (SELECT conv_id, min(turn) AS fq FROM conversations WHERE role <> 'system' GROUP BY conv_id),
pres AS (SELECT s.conv_id, string_agg(s.text, ' ' ORDER BY s.turn) AS presentation
         FROM segs s LEFT JOIN firstqa f ON s.conv_id = f.conv_id
         WHERE f.fq IS NULL OR s.turn < f.fq GROUP BY s.conv_id),
w AS (SELECT raw.conv_id, {wsplit('raw_text')} AS a,
             list_concat({wsplit("coalesce(presentation, '')")},
                         {wsplit("regexp_replace(coalesce(qa_raw.qa_raw, ''), '\\[(?:Question|Answer|Follow-up)\\]:', ' ', 'g')")}) AS b
      FROM raw LEFT JOIN pres ON raw.conv_id = pres.conv_id LEFT JOIN qa_raw ON raw.conv_id = qa_raw.conv_id),
d AS (SELECT conv_id, a, b, coalesce(list_position(list_transform(range(1, greatest(len(a), len(b)) + 1),
             lambda i: a[i] IS NOT DISTINCT FROM b[i]), false), 0) AS fd FROM w)
SELECT conv_id, fd = 0 AS ok, CAST(nullif(fd, 0) AS BIGINT) AS first_diff, CAST(len(a) AS BIGINT) AS n_raw,
       CAST(len(b) AS BIGINT) AS n_out
FROM d"""


# ---------------------------------------------------------------- summaries
ACTION_CUES_SQL = cue_re2(("with", "pour", "und", "los"))

SUMM = f"""{QA_RAW},
ans AS (SELECT conv_id, r.pos AS pos, r.text AS text
        FROM (SELECT conv_id, unnest(list_transform(list_filter(list_transform(runs, lambda r, i: {{'pos': i, 'tag': r.tag, 'text': r.text}}),
                                                                lambda r: r.tag = 'Answer'), lambda r: r)) AS r FROM runs)),
sents AS (SELECT conv_id, CAST(pos AS BIGINT) * 4294967296 + (i - 1) AS spos, s[i] AS sentence
          FROM (SELECT conv_id, pos, {sentences('text')} AS s FROM
                (SELECT conv_id, pos, text FROM ans
                 UNION ALL
                 SELECT conv_id, turn AS pos, text FROM conversations
                 WHERE conv_id NOT IN (SELECT conv_id FROM runs WHERE len(runs) > 0))), LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i)),
words AS (SELECT conv_id, spos, unnest({norm_words('sentence')}) AS term FROM sents),
tf AS (SELECT conv_id, term, count(*) AS tf FROM words GROUP BY conv_id, term),
dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
nsess AS (SELECT count(DISTINCT conv_id) AS n FROM tf),
scores AS (SELECT w.conv_id, w.spos, sum(tf.tf) AS score
           FROM (SELECT DISTINCT conv_id, spos, term FROM words) w JOIN tf ON w.conv_id = tf.conv_id AND w.term = tf.term
           GROUP BY w.conv_id, w.spos),
scored AS (SELECT s.conv_id, s.spos, s.sentence, CAST(coalesce(sc.score, 0) AS BIGINT) AS score
           FROM sents s LEFT JOIN scores sc ON s.conv_id = sc.conv_id AND s.spos = sc.spos),
points AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, spos) AS rank FROM scored)
           WHERE rank <= 5),
topics AS (SELECT * FROM (SELECT conv_id, term, weight, row_number() OVER (PARTITION BY conv_id ORDER BY weight DESC, term) AS rank
                          FROM (SELECT tf.conv_id, tf.term, CAST(floor(tf.tf * (SELECT n FROM nsess) / dfq.df) AS BIGINT) AS weight
                                FROM tf JOIN dfq ON tf.term = dfq.term))
           WHERE rank <= 6),
actions AS (SELECT * FROM sents WHERE regexp_matches(lower(sentence), '{ACTION_CUES_SQL}')),
tbl AS (
  SELECT k.conv_id, coalesce(p.key_points, []) AS key_points, coalesce(c.content, '') AS content, coalesce(t.topics, []) AS topics,
         coalesce(a.action_items, []) AS action_items
  FROM (SELECT DISTINCT conv_id FROM conversations) k
  LEFT JOIN (SELECT conv_id, list(sentence ORDER BY spos) AS key_points FROM points GROUP BY conv_id) p ON k.conv_id = p.conv_id
  LEFT JOIN (SELECT conv_id, string_agg(sentence, ' ' ORDER BY spos) AS content FROM points WHERE rank <= 3 GROUP BY conv_id) c
    ON k.conv_id = c.conv_id
  LEFT JOIN (SELECT conv_id, list(term ORDER BY rank) AS topics FROM topics GROUP BY conv_id) t ON k.conv_id = t.conv_id
  LEFT JOIN (SELECT conv_id, list(sentence ORDER BY spos) AS action_items FROM actions GROUP BY conv_id) a
    ON k.conv_id = a.conv_id)"""

ORACLES["summary_key_points"] = f"""WITH {SUMM}
SELECT conv_id, array_to_string(key_points, chr(10)) AS key_points, content FROM tbl"""

ORACLES["summary_topics"] = f"""WITH {SUMM}
SELECT conv_id, CAST(rank AS BIGINT) AS rank, term, weight FROM topics"""

ORACLES["summary_actions"] = f"""WITH {SUMM}
SELECT conv_id, CAST(len(action_items) AS BIGINT) AS n_actions, array_to_string(action_items, chr(10)) AS action_items FROM tbl"""

ORACLES["summary_report"] = f"""WITH {SUMM}
SELECT conv_id,
  'SUMMARY:' || chr(10) || content || chr(10) || chr(10) || 'KEY POINTS:' || chr(10)
  || array_to_string(list_transform(key_points, lambda x: '- ' || x), chr(10)) || chr(10)
  || chr(10) || 'ACTION ITEMS:' || chr(10)
  || array_to_string(list_transform(action_items, lambda x: '- ' || x), chr(10)) || chr(10)
  || chr(10) || 'TOPICS:' || chr(10) || array_to_string(topics, ', ') AS report
FROM tbl"""


# ---------------------------------------------------------------- responses
PRES = f"""{SEGS},
firstqa AS (SELECT conv_id, min(turn) AS fq FROM conversations WHERE role <> 'system' GROUP BY conv_id),
pres AS (SELECT s.conv_id, string_agg(s.text, ' ' ORDER BY s.turn) AS presentation
         FROM segs s LEFT JOIN firstqa f ON s.conv_id = f.conv_id
         WHERE f.fq IS NULL OR s.turn < f.fq GROUP BY s.conv_id)"""

ORACLES["parse_response"] = f"""WITH {LABELLED},
qr AS (SELECT conv_id, string_agg('[' || tag || ']: ' || content, chr(10) ORDER BY turn) AS qa_raw
       FROM labelled WHERE tag IS NOT NULL GROUP BY conv_id),
{PRES},
ids AS (SELECT DISTINCT conv_id FROM conversations),
src AS (SELECT ids.conv_id, coalesce(pres.presentation, '') AS p, coalesce(qr.qa_raw, '') AS qv
        FROM ids LEFT JOIN pres ON ids.conv_id = pres.conv_id LEFT JOIN qr ON ids.conv_id = qr.conv_id),
resp AS (SELECT conv_id, CASE conv_id % 5
            WHEN 0 THEN json_object('presentation', p, 'q_and_a', qv)::VARCHAR
            WHEN 1 THEN json_object('presentation', p)::VARCHAR
            WHEN 2 THEN json_object('presentation', NULL, 'q_and_a', qv)::VARCHAR
            WHEN 3 THEN left(json_object('presentation', p, 'q_and_a', qv)::VARCHAR, 1)
            ELSE '' END AS response FROM src),
parsed AS (
  SELECT conv_id, response,
    CASE WHEN {is_blank('response')} THEN 'empty response'
         WHEN NOT json_valid(response) OR json_type(response) <> 'OBJECT' THEN 'invalid json'
         WHEN (list_contains(json_keys(response), 'presentation') AND json_type(response, '$.presentation') = 'NULL')
           OR (list_contains(json_keys(response), 'q_and_a') AND json_type(response, '$.q_and_a') = 'NULL') THEN 'null field'
    END AS error
  FROM resp),
vals AS (
  SELECT conv_id, error,
    CASE WHEN error IS NULL THEN {strip("CASE WHEN list_contains(json_keys(response), 'presentation') THEN json_extract_string(response, '$.presentation') ELSE '' END")} END AS presentation,
    CASE WHEN error IS NULL THEN {strip("CASE WHEN list_contains(json_keys(response), 'q_and_a') THEN json_extract_string(response, '$.q_and_a') ELSE '' END")} END AS qa_raw
  FROM parsed),
parsed2 AS (
  SELECT conv_id, error, presentation, list_transform(regexp_extract_all(coalesce(qa_raw, ''), '\\[(Question|Answer|Follow-up)\\]:', 1),
           lambda t, i: {{'tag': t, 'text': {strip("regexp_split_to_array(coalesce(qa_raw, ''), '\\[(?:Question|Answer|Follow-up)\\]:')[i + 1]")}}}) AS blocks
  FROM vals),
ne AS (SELECT conv_id, error, presentation, list_filter(list_transform(blocks, lambda b: {{'tag': CASE WHEN b.tag = 'Follow-up' THEN 'Question' ELSE b.tag END, 'text': b.text}}),
                                       lambda b: length(b.text) > 0) AS ne FROM parsed2),
st AS (SELECT *, list_filter(range(1, len(ne) + 1), lambda i: i = 1 OR ne[i].tag <> ne[i - 1].tag) AS starts FROM ne),
runs AS (SELECT conv_id, error, presentation, list_transform(starts, lambda s, k: {{'tag': ne[s].tag,
           'text': array_to_string(list_transform(ne[s:coalesce(starts[k + 1], len(ne) + 1) - 1], lambda b: b.text), ' ')}}) AS runs FROM st)
SELECT conv_id, CASE WHEN error IS NULL THEN 'ok' ELSE 'error' END AS status, error,
       CASE WHEN error IS NULL THEN CAST(length(presentation) AS BIGINT) END AS presentation_chars,
       CASE WHEN error IS NULL THEN array_to_string(list_transform(runs, lambda r: '[' || r.tag || ']: ' || r.text), chr(10)) END AS qa_text
FROM runs"""

ORACLES["parse_summary_response"] = f"""WITH resp AS (
  SELECT event_id, CASE event_id % 4
      WHEN 0 THEN props
      WHEN 1 THEN json_object('content', event_type, 'key_points', [event_type, CAST(user_id AS VARCHAR)],
                              'action_items', []::VARCHAR[], 'topics', [event_type])::VARCHAR
      WHEN 2 THEN ''
      ELSE 'not json ' || props END AS r
  FROM events),
p AS (SELECT event_id, r,
        CASE WHEN {is_blank('r')} THEN 'empty response'
             WHEN NOT json_valid(r) OR json_type(r) <> 'OBJECT' THEN 'invalid json' END AS error
      FROM resp)
SELECT event_id, CASE WHEN error IS NULL THEN 'ok' ELSE 'error' END AS status,
  CASE WHEN error IS NULL THEN (CASE WHEN list_contains(json_keys(r), 'content') THEN json_extract_string(r, '$.content') ELSE '' END) END AS content,
  CASE WHEN error IS NULL THEN CAST(coalesce(json_array_length(r, '$.key_points'), 0) AS BIGINT) END AS n_key_points,
  CASE WHEN error IS NULL THEN CAST(coalesce(json_array_length(r, '$.action_items'), 0) AS BIGINT) END AS n_action_items,
  CASE WHEN error IS NULL THEN coalesce(array_to_string(CAST(json_extract(r, '$.topics') AS VARCHAR[]), ','), '') END AS topics
FROM p"""

ORACLES["step_timing"] = """
SELECT event_type AS step, count(*) AS n_runs, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS n_failed,
       round(avg(value), 6) AS avg_s, round(max(value), 6) AS max_s, round(sum(value), 6) AS total_s
FROM events GROUP BY event_type"""


def _grams_sql(w: str) -> str:
    """All word 1-, 2- and 3-grams."""
    return (f"list_concat({w}, list_concat(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]), "
            f"list_transform(range(1, len({w}) - 1), lambda i: {w}[i] || ' ' || {w}[i + 1] || ' ' || {w}[i + 2])))")


ORACLES["vocabulary_hits"] = f"""WITH bw AS (SELECT {norm_words('text')} AS w FROM benchmark),
terms AS (SELECT DISTINCT term FROM (SELECT unnest({_grams_sql('w')}) AS term FROM bw)),
dw AS (SELECT doc_id, {norm_words('text')} AS w FROM documents),
g AS (SELECT doc_id, unnest({_grams_sql('w')}) AS term FROM dw),
h AS (SELECT doc_id, term, count(*) AS hits FROM g SEMI JOIN terms USING (term) GROUP BY doc_id, term)
SELECT term, count(*) AS n_docs, sum(hits) AS hits FROM h GROUP BY term"""

ORACLES["vocabulary_missed"] = f"""WITH RECURSIVE {HYPS},
bw AS (SELECT {norm_words('text')} AS w FROM benchmark),
terms AS (SELECT DISTINCT term FROM (SELECT unnest({_grams_sql('w')}) AS term FROM bw)),
p AS (SELECT c.conv_id, c.turn, h.model, {norm_words('c.text')} AS rw, {norm_words('h.hyp_text')} AS hw
      FROM conversations c JOIN hyps h ON c.conv_id = h.conv_id AND c.turn = h.turn),
r AS (SELECT DISTINCT conv_id, turn, model, unnest({_grams_sql('rw')}) AS term FROM p),
h2 AS (SELECT DISTINCT conv_id, turn, model, unnest({_grams_sql('hw')}) AS term FROM p),
m AS (SELECT * FROM r ANTI JOIN h2 USING (conv_id, turn, model, term))
SELECT model, term, count(*) AS n_cases FROM m SEMI JOIN terms USING (term) GROUP BY model, term"""


# ---------------------------------------------------------------- session archive
ORACLES["session_roundtrip"] = f"""WITH {SUMM},
segs2 AS (SELECT conv_id, turn, {strip('text')} AS text FROM conversations)
SELECT sha256(CAST(s.conv_id AS VARCHAR)) AS session_id, true AS roundtrip_ok, 'session ' || CAST(s.conv_id AS VARCHAR) AS title,
       count(*) AS n_segments, CAST(length(string_agg(s.text, ' ' ORDER BY s.turn)) AS BIGINT) AS raw_chars,
       CAST(any_value(len(tbl.topics)) AS BIGINT) AS n_topics, count(*) AS turns
FROM segs2 s JOIN tbl ON s.conv_id = tbl.conv_id GROUP BY s.conv_id"""

VERSIONS = """ids AS (SELECT DISTINCT conv_id FROM conversations),
m AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 2 ELSE 1 END AS version,
             'session ' || CAST(conv_id AS VARCHAR) || CASE WHEN conv_id % 3 = 0 THEN ' (v2)' ELSE '' END AS title FROM ids)"""

ORACLES["session_upsert"] = f"""WITH {QA_RAW}, {PRES}, {VERSIONS},
qt AS (SELECT conv_id, array_to_string(list_transform(runs, lambda r: '[' || r.tag || ']: ' || r.text), chr(10)) AS qa_text FROM runs)
SELECT sha256(CAST(m.conv_id AS VARCHAR)) AS session_id, CAST(version AS BIGINT) AS version, title,
       CAST(length(presentation) AS BIGINT) AS presentation_chars, CAST(length(qa_text) AS BIGINT) AS qa_chars
FROM m LEFT JOIN pres ON m.conv_id = pres.conv_id LEFT JOIN qt ON m.conv_id = qt.conv_id"""

ORACLES["session_lookup"] = f"""WITH {VERSIONS},
req AS (SELECT conv_id, sha256(CAST(conv_id AS VARCHAR)) AS session_id FROM ids
        UNION ALL SELECT NULL, sha256(CAST(conv_id + 1000000 AS VARCHAR)) FROM ids WHERE conv_id % 5 = 0)
SELECT req.session_id,
       CASE WHEN m.conv_id IS NULL THEN 'not_found' WHEN m.conv_id % 7 = 0 THEN 'corrupt' ELSE 'found' END AS status,
       CASE WHEN m.conv_id IS NOT NULL AND m.conv_id % 7 <> 0 THEN m.title END AS title
FROM req LEFT JOIN m ON req.conv_id = m.conv_id"""

ORACLES["session_load"] = f"""WITH {SEGS},
raw AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS raw_text, count(*) AS n FROM segs GROUP BY conv_id),
e AS (SELECT *, conv_id % 8 AS shape, CASE conv_id % 8 WHEN 3 THEN 'missing metadata.created_at'
             WHEN 5 THEN 'missing transcript.raw_text' WHEN 6 THEN 'not a JSON object' END AS error FROM raw),
f AS (SELECT *, error IS NULL AS ok, error IS NULL AND shape <> 4 AS has FROM e)
SELECT conv_id, CASE WHEN ok THEN 'found' ELSE 'corrupt' END AS status, error,
       CASE WHEN ok THEN CAST(epoch(TIMESTAMP '2024-03-05 06:07:08') AS BIGINT) END AS created_s, has AS has_transcript,
       CASE WHEN has THEN CAST(0 AS BIGINT) END AS n_segments, CASE WHEN has THEN CAST(length(raw_text) AS BIGINT) END AS raw_chars,
       true AS no_summary, CASE WHEN ok THEN n END AS n
FROM f"""

ORACLES["sink_rerun"] = """SELECT source || '_' || CAST(doc_id AS VARCHAR) AS stem,
       CAST(length(text) + CASE WHEN doc_id % 3 = 0 THEN 6 ELSE 0 END AS BIGINT) AS raw_chars, CAST(1 AS BIGINT) AS n_segments, lang AS language,
       CAST(length(text) AS BIGINT) AS presentation_chars, CASE WHEN doc_id % 3 = 0 THEN '[Answer]: yes' ELSE '' END AS structured_qa_text,
       '{"content":' || CASE WHEN doc_id % 3 = 0 THEN 'null' ELSE '"' || lang || '"' END || ',"key_points":[],"action_items":[],"topics":["' || lang || '"]}' AS summary_json,
       'SUMMARY:' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'None' ELSE lang END || chr(10) || chr(10) || 'KEY POINTS:' || chr(10) || chr(10) || chr(10)
       || 'ACTION ITEMS:' || chr(10) || chr(10) || chr(10) || 'TOPICS:' || chr(10) || lang AS summary_txt
FROM documents"""


# ---------------------------------------------------------------- transcription, run status
ORACLES["transcribe_batch"] = ORACLES["assemble_transcript"]

ORACLES["session_status"] = f"""WITH {SEGS},
ids AS (SELECT conv_id, length({strip("string_agg(text, ' ' ORDER BY turn)")}) = 0 AS silent FROM segs GROUP BY conv_id),
s AS (SELECT CASE WHEN conv_id % 11 = 3 THEN 0 WHEN conv_id % 13 = 0 AND conv_id % 7 <> 2 THEN 1
                  WHEN conv_id % 7 = 2 OR silent THEN 2 ELSE 9 END AS hit FROM ids),
x AS (SELECT step, CASE WHEN i < hit THEN 'ok' WHEN i = hit THEN 'failed' ELSE 'skipped' END AS status
      FROM s, (VALUES (0, 'validation'), (1, 'transcription'), (2, 'structuring'), (3, 'summarization'), (4, 'archiving')) AS t(i, step))
SELECT step, status, count(*) AS n FROM x GROUP BY step, status"""

ORACLES["provider_replies"] = f"""WITH pr AS ({ORACLES["parse_response"]})
SELECT conv_id, CASE WHEN error IS NOT NULL THEN 'StructuringError' END AS error_class, presentation_chars, qa_text AS structured_qa_text,
       CASE WHEN conv_id % 5 IN (3, 4) THEN 'SummarizationError' END AS summary_error,
       CASE conv_id % 5 WHEN 0 THEN CAST(conv_id AS VARCHAR) WHEN 1 THEN '' WHEN 2 THEN '' END AS content,
       CAST(CASE conv_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 0 END AS BIGINT) AS n_key_points
FROM pr"""

ORACLES["stage_rerun"] = f"""WITH {FILES}, {OUTS},
todo AS (SELECT doc_id FROM ({stage_input_sql(0)}) WHERE doc_id NOT IN ({done_sql(('presentation', 'q_and_a'))})),
c AS (SELECT (SELECT count(*) FROM ({stage_input_sql(0)})) AS found, (SELECT count(*) FROM todo) AS todo,
             (SELECT count(*) FROM todo WHERE doc_id % 5 = 0) AS failed),
r AS (SELECT unnest([{{'run': 'run1', 'found': found, 'todo': todo}}, {{'run': 'run2', 'found': found, 'todo': todo}},
                     {{'run': 'run3', 'found': found, 'todo': failed}}]) AS r, failed FROM c),
s AS (SELECT r.run AS run, unnest([{{'status': 'found', 'n': r.found}}, {{'status': 'skipped', 'n': r.found - r.todo}},
                                   {{'status': 'processed', 'n': r.todo - failed}}, {{'status': 'failed', 'n': failed}}]) AS s FROM r)
SELECT run, s.status, s.n FROM s
UNION ALL SELECT 'stored', CASE WHEN doc_id % 5 = 0 THEN 'failed' ELSE 'ok' END, count(*) FROM todo GROUP BY ALL"""

ORACLES["stream_transcribe"] = f"""WITH {SEGS}
SELECT conv_id, CASE WHEN conv_id % 13 = 0 THEN 'TranscriptionError' END AS error_class,
       CASE WHEN conv_id % 13 <> 0 THEN count(*) END AS n_segments,
       CASE WHEN conv_id % 13 <> 0 THEN CAST(length(string_agg(text, ' ' ORDER BY turn)) AS BIGINT) END AS raw_chars
FROM segs GROUP BY conv_id"""

ORACLES["stream_chain"] = ORACLES["stream_split"] = ORACLES["stream_replay"] = ORACLES["qa_render"]

ORACLES["stream_summaries"] = ORACLES["summary_report"]

# ---------------------------------------------------------------- reports, sources, parts of sessions
ORACLES["evaluation_summary"] = _wer_with("""
SELECT model, n_cases, printf('%.2f%%', round(100 * avg_wer, 2)) AS wer, printf('%.2f%%', round(100 * avg_accuracy, 2)) AS accuracy FROM macro""")

ORACLES["eval_pairs"] = """SELECT 'c' || conv_id || '_t' || turn AS case_name, CAST(length(text) AS BIGINT) AS ref_chars, true AS same
FROM conversations WHERE turn % 3 <> 0 AND turn % 4 <> 1"""

ORACLES["transcribe_plain"] = f"""SELECT doc_id, CAST(1 AS BIGINT) AS n_segments, CAST(0 AS DOUBLE) AS end_time,
       CAST(length({strip('text')}) AS BIGINT) AS raw_chars, 'en' AS language FROM documents"""

ORACLES["source_validation"] = """WITH ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT 'conv_' || (conv_id + 3) || '.wav' AS path, CASE WHEN conv_id + 3 IN (SELECT conv_id FROM ids) THEN 'ok' ELSE 'missing' END AS status,
       CASE WHEN conv_id + 3 NOT IN (SELECT conv_id FROM ids) THEN 'TranscriptionError' END AS error_class
FROM ids"""

ORACLES["session_parts"] = f"""WITH {QA_RAW},
qt AS (SELECT conv_id, array_to_string(list_transform(runs, lambda r: '[' || r.tag || ']: ' || r.text), chr(10)) AS qa_text FROM runs),
c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT c.conv_id, 'xx' AS language, n AS n_segments, 'new' AS presentation_text, CAST(length(qa_text) AS BIGINT) AS qa_chars,
       true AS no_summary, 'SESSION ' || c.conv_id AS title
FROM c LEFT JOIN qt ON c.conv_id = qt.conv_id"""

ORACLES["archive_compact"] = """WITH s AS (SELECT conv_id, sha256(conv_id::VARCHAR) AS session_id, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT state, session_id, CAST(v AS BIGINT) AS version, 'r' || v AS run, '{"session_id":"' || session_id || '","n":' || n || '}' AS document
FROM (SELECT *, CASE WHEN conv_id % 3 = 0 THEN 9 ELSE conv_id % 10 END AS v FROM s), (VALUES ('before'), ('after'), ('purged')) AS t(state)"""

ORACLES["pipeline_log"] = f"""WITH {SEGS},
s AS (SELECT DISTINCT conv_id, conv_id % 11 = 3 AS missing, conv_id % 13 = 0 AS bad FROM conversations),
c AS (SELECT count(*) AS a, count(*) FILTER (missing) AS m, count(*) FILTER (NOT missing AND bad) AS b FROM s)
SELECT unnest(['validation', 'transcription', 'structuring', 'summarization', 'archiving']) AS step, unnest([a, a - m, a - m - b, a - m - b, a - m - b]) AS n,
       unnest([m, b, 0, 0, 0]) AS failed, CAST(1 AS BIGINT) AS n_runs, true AS timed FROM c"""

ORACLES["pipeline_modes"] = f"""WITH {SEGS},
raw AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS raw FROM segs GROUP BY conv_id),
m AS (SELECT *, length(raw) % 3 = 0 AS refused FROM raw)
SELECT 'raw' AS mode, conv_id, NULL::VARCHAR AS failed_step, NULL::VARCHAR AS error, NULL::VARCHAR AS language, true AS no_qa, NULL::VARCHAR AS content, true AS has_content FROM m
UNION ALL SELECT 'model', conv_id, CASE WHEN refused THEN 'summarization' END, CASE WHEN refused THEN 'SummarizationError' END, CASE WHEN NOT refused THEN 'xx' END,
       true, CASE WHEN NOT refused THEN left(raw, 40) || '!' END, CASE WHEN NOT refused THEN true END FROM m"""

ORACLES["exported_files"] = f"""WITH {QA_RAW}, {SEGS},
t AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS raw FROM segs GROUP BY conv_id),
x AS (SELECT t.conv_id, raw, ['_', '.', 'c'][conv_id % 3 + 1] || t.conv_id AS stem,
             coalesce(array_to_string(list_transform(runs, lambda r: '[' || r.tag || ']: ' || r.text), chr(10)), '') AS qa_text FROM t LEFT JOIN runs USING (conv_id))
SELECT 'audio' AS kind, stem, length(raw)::BIGINT AS chars FROM x WHERE conv_id % 2 = 0
UNION ALL SELECT 'transcript', stem, length(raw) FROM x
UNION ALL SELECT 'qa', stem || '_q_and_a', length(qa_text) FROM x WHERE conv_id % 4 > 0
UNION ALL SELECT CASE WHEN conv_id % 5 > 0 THEN 'found' ELSE 'corrupt' END, stem, 0 FROM x"""

ORACLES["session_now"] = """SELECT count(*) AS n, count(*) AS n_ids, CAST(1 AS BIGINT) AS n_times, true AS is_now FROM documents"""

ORACLES["verbatim_distance"] = f"""WITH RECURSIVE {QA_RAW},
{SEGS},
raw AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS raw_text FROM segs GROUP BY conv_id),
firstqa AS (SELECT conv_id, min(turn) AS fq FROM conversations WHERE role <> 'system' GROUP BY conv_id),
pres AS (SELECT s.conv_id, string_agg(s.text, ' ' ORDER BY s.turn) AS presentation
         FROM segs s LEFT JOIN firstqa f ON s.conv_id = f.conv_id WHERE f.fq IS NULL OR s.turn < f.fq GROUP BY s.conv_id),
w AS (SELECT raw.conv_id, {wsplit('raw_text')} AS a,
             list_concat({wsplit("coalesce(presentation, '')")},
                         {wsplit("regexp_replace(coalesce(qa_raw.qa_raw, ''), '\\[(?:Question|Answer|Follow-up)\\]:', ' ', 'g')")}) AS b
      FROM raw LEFT JOIN pres ON raw.conv_id = pres.conv_id LEFT JOIN qa_raw ON raw.conv_id = qa_raw.conv_id),
dp(conv_id, d, a, b, p2, p1) USING KEY (conv_id) AS (
  SELECT conv_id, 0, a, b, list_transform(range(0, len(a) + 1), lambda i: NULL::INTEGER), list_transform(range(0, len(a) + 1), lambda i: CASE WHEN i = 0 THEN 0 END) FROM w
  UNION ALL
  SELECT conv_id, d + 1, a, b, p1, list_transform(range(0, len(a) + 1), lambda i:
       CASE WHEN d + 1 - i < 0 OR d + 1 - i > len(b) THEN NULL WHEN i = 0 THEN d + 1 WHEN d + 1 - i = 0 THEN i
            ELSE least(p1[i] + 1, p1[i + 1] + 1, p2[i] + CASE WHEN a[i] = b[d + 1 - i] THEN 0 ELSE 1 END) END)
  FROM dp WHERE d < len(a) + len(b))
SELECT conv_id, a = b AS ok, CAST(p1[len(a) + 1] AS BIGINT) AS distance FROM dp"""

ORACLES["target_index"] = f"""WITH {DOC_FILES},
t AS (SELECT 'C' || doc_id % 20 || '_' || doc_id AS target FROM labels WHERE doc_id % 7 = 0)
SELECT doc_id, name FROM doc_files WHERE EXISTS (SELECT 1 FROM t WHERE contains(lower(name), lower(target)))"""

ORACLES["sql_qa_runs"] = ORACLES["qa_runs"]

ORACLES["sql_blocks"] = f"""WITH {QA_RAW}
SELECT conv_id, CAST(len(blocks) AS BIGINT) AS n_blocks, array_to_string(list_transform(runs, lambda r: '[' || r.tag || ']: ' || r.text), chr(10)) AS qa_text,
       CAST(len(list_filter(runs, lambda r: r.tag = 'Answer')) AS BIGINT) AS n_answers
FROM parsed JOIN runs USING (conv_id)"""

ORACLES["sql_wer"] = f"""WITH RECURSIVE said AS (
  SELECT conv_id, turn, text, left(text, 60) || ' so ' || left(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), 40) AS said FROM conversations),
pairs AS (SELECT conv_id, turn, {norm_words('said')} AS a, {norm_words('text')} AS b FROM said WHERE said IS NOT NULL),
dp(conv_id, turn, d, a, b, p2, p1) USING KEY (conv_id, turn) AS (
  SELECT conv_id, turn, 0, a, b, list_transform(range(0, len(a) + 1), lambda i: NULL::INTEGER), list_transform(range(0, len(a) + 1), lambda i: CASE WHEN i = 0 THEN 0 END) FROM pairs
  UNION ALL
  SELECT conv_id, turn, d + 1, a, b, p1, list_transform(range(0, len(a) + 1), lambda i:
       CASE WHEN d + 1 - i < 0 OR d + 1 - i > len(b) THEN NULL WHEN i = 0 THEN d + 1 WHEN d + 1 - i = 0 THEN i
            ELSE least(p1[i] + 1, p1[i + 1] + 1, p2[i] + CASE WHEN a[i] = b[d + 1 - i] THEN 0 ELSE 1 END) END)
  FROM dp WHERE d < len(a) + len(b)),
s AS (SELECT conv_id, turn, CAST(p1[len(a) + 1] AS BIGINT) AS errors,
             CASE WHEN len(a) = 0 THEN CASE WHEN len(b) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE p1[len(a) + 1]::DOUBLE / len(a) END AS wer FROM dp)
SELECT conv_id, turn, errors, round(wer, 6) AS wer, round(greatest(0.0::DOUBLE, 1.0::DOUBLE - wer), 6) AS accuracy FROM s"""
