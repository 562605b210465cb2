"""The text and Q&A operators as SQL functions (U2, T1-T7): ``register(spark)``, then plain SQL.

They are SQL functions, so Spark inlines them into the query's plan and they run where built-in functions do; none
starts a Python worker. As Spark has it, they take columns and not the variables of a lambda.

======================================== =============================================================
``parley_strip(text)``                   text without white space at either end
``parley_words(text)``                   T1: normalised words
``parley_word_errors(ref, hyp)``         T2: word edit distance of two texts
``parley_wer(ref, hyp)``                 T3: word error rate of two texts
``parley_accuracy(wer)``                 T4
``parley_tag(tag)``                      T6: the tag that counts (Follow-up is a Question)
``parley_blocks(text)``                  T5: array of (pos, tag, text) blocks
``parley_qa(text)``                      T5-T7: the cleaned Q&A text
``parley_answers(text)``                 T11: answers of the cleaned Q&A text
``parley_block_rows(text)``              T5 as a table function: rows (pos, tag, text)
======================================== =============================================================
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from parley.functions import qa
from parley.functions import text as tx


def _q(pattern: str) -> str:
    """A raw SQL string literal; none of the patterns has both kinds of quotes."""
    return f'r"{pattern}"'


def _normalised(t: str) -> str:
    e = f"lower({t})"
    for old, new in (*tx.SPELLING_FIXES, ("-", " ")):
        e = f"replace({e}, '{old}', '{new}')"
    e = f"regexp_replace({e}, {_q(tx._PUNCT_RE)}, '')"
    for first, second, glued in tx.TIME_TOKENS:
        e = f"regexp_replace({e}, {_q(f'(?<![{tx.WORD_CLASS}]){first}[{tx.WS_CLASS}]*{second}(?![{tx.WORD_CLASS}])')}, '{glued}')"
    return f"trim(regexp_replace({e}, {_q(tx._WS_RUN_RE)}, ' '))"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _code(words: str, shared: str, missing: int) -> str:
    """Words as a string of one code point each; shared words by their place among the shared ones."""
    point = f"coalesce(map_from_arrays({shared}, sequence(1, size({shared})))[w] + {tx.FIRST_SHARED - 1}, {missing})"
    point = f"if(size({shared}) = 0, {missing}, {point})"
    shift = tx._AFTER - tx._SURROGATES
    return f"decode(unhex(array_join(transform({words}, w -> {_let(point, 'k', f'lpad(hex(if(k < {tx._SURROGATES}, k, k + {shift})), 8, \"0\")')}), '')), 'UTF-32')"


def _strip(t: str) -> str:
    return f"regexp_replace({t}, {_q(tx._STRIP_RE)}, '')"


def _tag(tag: str) -> str:
    return f"if({tag} = '{qa.FOLLOW_UP}', '{qa.QUESTION}', {tag})"


def functions() -> dict[str, str]:
    """Name and signature -> body."""
    parts = f"split(t, {_q(qa.TAG_SPLIT_RE)})"
    blocks = (f"transform(zip_with(regexp_extract_all(t, {_q(qa.TAG_RE)}, 1), slice({parts}, 2, greatest(size({parts}) - 1, 0)), "
              f"(g, x) -> named_struct('tag', g, 'text', {_strip('x')})), (b, i) -> named_struct('pos', i + 1, 'tag', b.tag, 'text', b.text))")
    kept = f"filter(transform(parley_blocks(t), b -> named_struct('tag', {_tag('b.tag')}, 'text', b.text)), b -> length(b.text) > 0)"
    # a run's first block is one whose predecessor has another tag; its text is the blocks up to the next run's first
    starts = "filter(sequence(1, size(kept)), i -> i = 1 OR kept[i - 1].tag <> kept[greatest(i - 2, 0)].tag)"
    run = "named_struct('tag', kept[s - 1].tag, 'text', array_join(transform(slice(kept, s, coalesce(get(starts, k + 1), size(kept) + 1) - s), b -> b.text), ' '))"
    runs = _let(kept, "kept", f"if(size(kept) = 0, CAST(array() AS ARRAY<STRUCT<tag STRING, text STRING>>), {_let(starts, 'starts', f'transform(starts, (s, k) -> {run})')})")
    shared = _let("array_sort(array_intersect(a, b))", "v", f"levenshtein({_code('a', 'v', tx.ONLY_REF)}, {_code('b', 'v', tx.ONLY_HYP)})")
    return {
        "parley_strip(t STRING) RETURNS STRING": _strip("t"),
        "parley_words(t STRING) RETURNS ARRAY<STRING>": f"filter(split({_normalised('t')}, ' '), w -> w <> '')",
        "parley_distance(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS INT": shared,
        "parley_word_errors(ref STRING, hyp STRING) RETURNS INT": "parley_distance(parley_words(ref), parley_words(hyp))",
        "parley_rate(errors INT, ref_words INT, hyp_words INT) RETURNS DOUBLE":
            "CASE WHEN ref_words = 0 THEN if(hyp_words > 0, 1.0D, 0.0D) ELSE CAST(errors AS DOUBLE) / ref_words END",
        "parley_wer(ref STRING, hyp STRING) RETURNS DOUBLE": "parley_rate(parley_word_errors(ref, hyp), size(parley_words(ref)), size(parley_words(hyp)))",
        "parley_accuracy(wer DOUBLE) RETURNS DOUBLE": "greatest(0.0D, 1.0D - wer)",
        "parley_tag(tag STRING) RETURNS STRING": _tag("tag"),
        "parley_blocks(t STRING) RETURNS ARRAY<STRUCT<pos INT, tag STRING, text STRING>>": blocks,
        "parley_runs(t STRING) RETURNS ARRAY<STRUCT<tag STRING, text STRING>>": runs,
        "parley_qa(t STRING) RETURNS STRING": "array_join(transform(parley_runs(t), b -> concat('[', b.tag, ']: ', b.text)), '\n')",
        "parley_answers(t STRING) RETURNS ARRAY<STRING>": f"transform(filter(parley_runs(t), b -> b.tag = '{qa.ANSWER}'), b -> b.text)",
        "parley_block_rows(t STRING) RETURNS TABLE (pos INT, tag STRING, text STRING)": f"SELECT b.pos, b.tag, b.text FROM (SELECT explode({blocks}) AS b)",
    }


def register(spark: SparkSession) -> None:
    """Make the functions known to the session."""
    for signature, body in functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
