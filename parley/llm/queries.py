"""Registered queries of the operators of this subpackage, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import audit, bpe, conversations, decontaminate, fingerprint, langid, licenses, mixing, neardup, quality, rules, toxicity, urls
from parley.llm.common import fold
from parley.spark import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def quality_forest(docs: DataFrame, labels: DataFrame) -> quality.Forest:
    return quality.fit(docs, labels, fold(F.col("doc_id"), 4) != 2)


@query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality_forest(docs, read_table(spark, sf_dir, "labels")))


@query
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(read_table(spark, sf_dir, "documents"))


@query
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), ids=False)


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge_documents(read_table(spark, sf_dir, "documents"))


@query
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.join_documents(read_table(spark, sf_dir, "documents")).drop("text_hash")


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


#: Fixed by the contract: host, path, verdict.
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


@query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read_table(spark, sf_dir, "pages"), URL_RULES)


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    return toxicity.score_documents(docs, model, counts=model.counts)


@query
def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edited(read_table(spark, sf_dir, "documents"))


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs, fold(F.col("doc_id"), 5) != 0))


@query
def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damage(turns), turns)


ORACLES["op5_url_filter"] = """WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest, url FROM pages),
u AS (SELECT row_number() OVER () AS row, page_id,
             translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM p),
fits AS (SELECT u.row, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.v, length(r.h || r.p)) AS verdict
         FROM u JOIN (VALUES %s) AS r(h, p, v)
           ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p) GROUP BY u.row)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN len(list_intersect(string_split_regex(host, '[.-]'), [%s])) > 0
       THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN fits USING (row)""" % (", ".join(map(str, URL_RULES)), ", ".join(f"'{w}'" for w in urls.BLOCKED_WORDS))

ORACLES["op6_quality_rules"] = r"""WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, lang, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT row, i, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT row, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
twice AS (SELECT row, i FROM g QUALIFY count(*) OVER (PARTITION BY row, gram) > 1),
covered AS (SELECT row, count(DISTINCT pos) AS n FROM (SELECT row, unnest(range(i, i + 5)) AS pos FROM twice) GROUP BY row),
m AS (SELECT d.row, doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, len(lines) AS n_lines
      FROM d LEFT JOIN covered ON d.row = covered.row),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, 1000.0::DOUBLE * n_symbols / nullif(n_words, 0) AS symbols,
             1000.0::DOUBLE * n_dup_lines / nullif(n_lines, 0) AS dups, 1000.0::DOUBLE * word_chars / nullif(n_words, 0) AS chars,
             1000.0::DOUBLE * sqrt(n_symbols) / nullif(n_words, 0) AS es, 1000.0::DOUBLE * sqrt(n_dup_lines) / nullif(n_lines, 0) AS ed,
             (1000.0::DOUBLE * word_chars / nullif(n_words, 0)) / (2.0::DOUBLE * sqrt(n_words)) AS ec FROM m),
e AS (SELECT lang, source, unnest(['s', 'd', 'c']) AS k, unnest([floor(symbols)::BIGINT, floor(dups)::BIGINT, floor(chars)::BIGINT]) AS v FROM b WHERE NOT base_failed),
sk AS (SELECT lang, source, k, greatest(length(bin(v)) - 6, 0) * 64 + (v >> greatest(length(bin(v)) - 6, 0)::BIGINT) AS bucket, count(*) AS n
       FROM e GROUP BY ALL),
gl AS (SELECT DISTINCT lang, source, k FROM sk),
sl AS (SELECT *, (sum(n) OVER (PARTITION BY lang, k))::BIGINT AS total FROM (SELECT lang, k, bucket, sum(n)::BIGINT AS n FROM sk GROUP BY ALL)),
sa AS (SELECT *, (sum(n) OVER (PARTITION BY k))::BIGINT AS total FROM (SELECT k, bucket, sum(n)::BIGINT AS n FROM sk GROUP BY ALL)),
merged AS (SELECT lang, source, k, bucket, n * 1048576 AS parts FROM sk
           UNION ALL SELECT gl.lang, source, gl.k, bucket, n * least(total, 100) * 1048576 // total FROM gl JOIN sl ON gl.lang IS NOT DISTINCT FROM sl.lang AND gl.k = sl.k
           UNION ALL SELECT lang, source, gl.k, bucket, n * least(total, 100) * 1048576 // total FROM gl JOIN sa ON gl.k = sa.k),
once AS (SELECT lang, source, k, bucket, sum(parts)::BIGINT AS parts FROM merged GROUP BY ALL),
cum AS (SELECT *, sum(parts) OVER (PARTITION BY lang, source, k) AS total, sum(parts) OVER (PARTITION BY lang, source, k ORDER BY bucket) AS upto FROM once),
q AS (SELECT lang, source, k, min(bucket) FILTER (4 * upto >= total) AS b25, min(bucket) FILTER (4 * upto >= 3 * total) AS b75 FROM cum GROUP BY ALL),
t AS (SELECT lang, source, k, ((b25 % 64 + 1) << (b25 // 64)) - 1 AS q25, ((b75 % 64 + 1) << (b75 // 64)) - 1 AS q75 FROM q),
f AS (SELECT lang, source, max(q75 + 3 * (q75 - q25)) FILTER (k = 's') AS hs, max(q75 + 3 * (q75 - q25)) FILTER (k = 'd') AS hd,
             max(q75 + 3 * (q75 - q25)) FILTER (k = 'c') AS hc, max(q25 - 3 * (q75 - q25)) FILTER (k = 'c') AS lc FROM t GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       coalesce(NOT base_failed AND NOT symbols - 3 * es > hs AND NOT dups - 3 * ed > hd AND NOT (chars - 3 * ec > hc OR chars + 3 * ec < lc), false) AS kept
FROM b LEFT JOIN f ON b.lang IS NOT DISTINCT FROM f.lang AND b.source IS NOT DISTINCT FROM f.source"""

ORACLES["op9_ngram_jaccard_join"] = r"""WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
near AS (SELECT a, b FROM c JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 5 * c >= 4 * (na.n + nb.n - c)),
reach AS (SELECT a, b FROM near UNION SELECT r.a, near.b FROM reach r JOIN near ON r.b = near.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
links AS (SELECT a, count(*) AS n FROM near GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(low.b, doc_id)) AS class_id, coalesce(links.n, 0) AS n_links
FROM documents LEFT JOIN low ON doc_id = low.a LEFT JOIN links ON doc_id = links.a"""


ORACLES["op11_decontaminate"] = r"""WITH low AS (SELECT row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT row, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
      FROM (SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT row, i, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
      FROM (SELECT row, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM q))),
h AS (SELECT row, i, g.size, item_id FROM g JOIN q ON g.phrase = q.phrase AND g.size = q.size),
words AS (SELECT row, count(DISTINCT pos) AS n_hit FROM (SELECT row, unnest(range(i, i + size)) AS pos FROM h) GROUP BY row),
items AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item_id::VARCHAR AS item FROM h WHERE item_id IS NOT NULL) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.row = words.row LEFT JOIN items ON d.row = items.row"""

ORACLES["op12_filter_audit"] = r"""WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
              regexp_matches(t, '[#$%&*|]'), coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)] AS fails
      FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
o AS (SELECT a || b || c || d || e AS filter_order FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v1(a), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v2(b),
             (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v3(c), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v4(d), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v5(e)
      WHERE len(list_distinct([a, b, c, d, e])) = 5),
s AS (SELECT filter_order, step, list_transform(string_split(filter_order, ''), lambda x: ascii(x) - 64) AS places FROM o, range(1, 6) r(step)),
x AS (SELECT part, filter_order, step, n, good, toxic, fails[places[step]] AS failing, len(list_filter(fails, lambda y: y)) AS n_fails,
             coalesce(list_bool_or(list_transform(places[1:step - 1], lambda p: fails[p])), false) AS gone FROM g, s),
c AS (SELECT part, filter_order, step::INT AS step, coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND failing), 0)::BIGINT AS removed,
             coalesce(sum(n) FILTER (gone AND failing), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (failing AND n_fails = 1), 0)::BIGINT AS unique_fails,
             coalesce(sum(good) FILTER (NOT gone AND failing), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND failing), 0)::BIGINT AS toxic_lost FROM x GROUP BY ALL)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley FROM c"""


ORACLES["op13_conversation_repair"] = r"""WITH k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
c AS (SELECT *, xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(range(1, len(key) + 1), lambda i: [ascii(key[i])::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
                    lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384)), 4294967295) % 20 AS d FROM k),
r AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
             CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE d WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE d <> 0),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM r),
f AS (SELECT *, role[1] AS x, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again FROM s),
g AS (SELECT *, blank OR again AS bad, NOT blank AND NOT again AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut, lag(x) OVER (PARTITION BY conv_id ORDER BY pos) AS prev FROM f),
v AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate,
             count(*) FILTER (cut) AS truncated, count(*) FILTER (prev || x NOT IN ('su', 'ua', 'au')) AS illegal,
             list({'role': role, 'text': text} ORDER BY pos) AS said, list({'x': x, 'bad': bad, 'cut': cut, 's': NULL::VARCHAR[]} ORDER BY pos) AS turns FROM g GROUP BY conv_id),
p AS (SELECT * EXCLUDE (turns), list_reduce([{'x': '', 'bad': false, 'cut': false, 's': ['00000000', '90000000', '00000002I', '00000004II']}] || turns,
  lambda a, t: {'x': '', 'bad': false, 'cut': false, 's': list_transform(list_transform([[(lpad((left(a.s[1], 8)::INT + 3)::VARCHAR, 8, '0') || substr(a.s[1], 9) || 'D'), least((lpad((left(a.s[2], 8)::INT + 3)::VARCHAR, 8, '0') || substr(a.s[2], 9) || 'D'), CASE WHEN t.x = 's' THEN (lpad((left(a.s[1], 8)::INT + (t.cut::INT + CASE WHEN t.bad THEN 40000000 ELSE 0 END))::VARCHAR, 8, '0') || substr(a.s[1], 9) || 'K') ELSE '90000000' END), least((lpad((left(a.s[3], 8)::INT + 3)::VARCHAR, 8, '0') || substr(a.s[3], 9) || 'D'), CASE WHEN t.x = 'u' THEN (lpad((left(least(a.s[1], a.s[2], a.s[4]), 8)::INT + (t.cut::INT + CASE WHEN t.bad THEN 40000000 ELSE 0 END))::VARCHAR, 8, '0') || substr(least(a.s[1], a.s[2], a.s[4]), 9) || 'K') ELSE (lpad((left(least(a.s[1], a.s[2], a.s[4]), 8)::INT + 2 + (t.cut::INT + CASE WHEN t.bad THEN 40000000 ELSE 0 END))::VARCHAR, 8, '0') || substr(least(a.s[1], a.s[2], a.s[4]), 9) || 'R') END), least((lpad((left(a.s[4], 8)::INT + 3)::VARCHAR, 8, '0') || substr(a.s[4], 9) || 'D'), CASE WHEN t.x = 'a' THEN (lpad((left(a.s[3], 8)::INT + (t.cut::INT + CASE WHEN t.bad THEN 40000000 ELSE 0 END))::VARCHAR, 8, '0') || substr(a.s[3], 9) || 'K') ELSE (lpad((left(a.s[3], 8)::INT + 2 + (t.cut::INT + CASE WHEN t.bad THEN 40000000 ELSE 0 END))::VARCHAR, 8, '0') || substr(a.s[3], 9) || 'R') END)]], lambda y: [y[1], y[2], least(y[3], (lpad((left(least(y[1], y[2], y[4]), 8)::INT + 2)::VARCHAR, 8, '0') || substr(least(y[1], y[2], y[4]), 9) || 'I')), y[4]]), lambda y: [y[1], y[2], y[3], least(y[4], (lpad((left(y[3], 8)::INT + 2)::VARCHAR, 8, '0') || substr(y[3], 9) || 'I'))])[1]}).s AS s FROM v),
e AS (SELECT *, left(least(s[1], s[4]), 8)::BIGINT AS cost, substr(least(s[1], s[4]), 9) AS audit FROM p),
o AS (SELECT *, length(replace(audit, 'D', '')) % 2 AS odd FROM e),
t AS (SELECT *, list_filter(list_transform(range(1, length(audit) + 1), lambda i: CASE audit[i] WHEN 'D' THEN NULL WHEN 'K' THEN
        said[length(replace(audit[1:i], 'I', ''))].role || ':' || said[length(replace(audit[1:i], 'I', ''))].text
        ELSE CASE WHEN (length(replace(audit[1:i - 1], 'D', '')) - odd) % 2 = 0 THEN 'user:' ELSE 'assistant:' END || CASE audit[i] WHEN 'R' THEN said[length(replace(audit[1:i], 'I', ''))].text ELSE '' END END),
        lambda y: y IS NOT NULL) AS lines FROM o)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN t ON ids.conv_id IS NOT DISTINCT FROM t.conv_id"""
