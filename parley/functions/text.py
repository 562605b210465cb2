"""Text column functions (T1-T4): normalisation, word edit distance, WER.

All functions return ``Column`` expressions built from Spark built-ins, so they
run inside the JVM (no Python worker) and compose with any DataFrame plan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for identical results)
# ---------------------------------------------------------------------------
# Spelling substitutions applied (as plain substrings, in this order) after
# lower-casing and before punctuation removal.
SPELLING_FIXES = (
    ("rythmn", "rhythm"),
    ("whch", "which"),
    ("gonna", "going to"),
)
# The two time-of-day spellings that are glued together ("p m" -> "pm").
TIME_TOKENS = (("p", "m", "pm"), ("a", "m", "am"))

# ---------------------------------------------------------------------------
# Character classes. Written out explicitly (rather than \s / \w) so that the
# JVM regex engine and other engines agree on Unicode text.
# ---------------------------------------------------------------------------
# Unicode White_Space plus the four information separators U+001C..U+001F.
WS_CLASS = (
    r"\t\n\x0B\x0C\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
WORD_CLASS = r"\p{L}\p{N}_"

_PUNCT_RE = f"[^{WORD_CLASS}{WS_CLASS}']"
_WS_RUN_RE = f"[{WS_CLASS}]+"
_STRIP_RE = f"^[{WS_CLASS}]+|[{WS_CLASS}]+$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Remove leading/trailing Unicode whitespace (``str.strip()`` semantics)."""
    return F.regexp_replace(_col(c), _STRIP_RE, "")


def is_blank(c) -> Column:
    """True for NULL, empty or whitespace-only text."""
    c = _col(c)
    return c.isNull() | (F.length(strip(c)) == 0)


def split_whitespace(c) -> Column:
    """``str.split()`` with no argument: runs of whitespace, no empty items."""
    t = strip(c)
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.split(t, _WS_RUN_RE))


def normalise_text(c, substitutions=SPELLING_FIXES) -> Column:
    """T1 before splitting: the normalised text with single spaces."""
    t = F.lower(_col(c))
    for old, new in substitutions:
        t = F.replace(t, F.lit(old), F.lit(new))
    t = F.replace(t, F.lit("-"), F.lit(" "))
    t = F.regexp_replace(t, _PUNCT_RE, "")
    for first, second, glued in TIME_TOKENS:
        # the letter first, then what stands before it: the matcher looks back at that letter only, not at every one
        pattern = f"{first}(?<![{WORD_CLASS}]{first})[{WS_CLASS}]*{second}(?![{WORD_CLASS}])"
        t = F.regexp_replace(t, pattern, glued)
    t = F.regexp_replace(t, _WS_RUN_RE, " ")
    return F.trim(t)


def normalise_words(c, substitutions=SPELLING_FIXES) -> Column:
    """Lower-case, fix spellings, drop punctuation, glue a.m./p.m., split."""
    return F.array_remove(F.split(normalise_text(c, substitutions), " "), "")


# Words are encoded as code points: all but zero and the surrogates. Two of them stand for words that only one
# of the texts has, which can never match.
_SURROGATES, _AFTER = 0xD800, 0xE000
ONLY_REF, ONLY_HYP, FIRST_SHARED = 1, 2, 3
MAX_SHARED_WORDS = _SURROGATES + (0x110000 - _AFTER) - FIRST_SHARED
#: First width of the band in which a distance is looked for; it doubles twice at a time.
FIRST_BAND = 16


def shared_words(ref_words, hyp_words) -> Column:
    """Sorted distinct words that both texts have; stage it as a column before encoding."""
    return F.array_sort(F.array_intersect(_col(ref_words), _col(hyp_words)))


def _binary_search(words: Column, vocab: Column, missing: int) -> Column:
    """Code of each word: its index in the sorted vocabulary, after the reserved codes, or ``missing``. O(n log V) per
    text, a fixed number of halving steps carried in a struct accumulator."""
    n = F.size(vocab)
    steps = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(n + 1)).cast("int"), F.lit(1)))

    def search(w):
        init = F.struct(F.lit(0).alias("lo"), n.alias("hi"))

        def step(acc, _):
            mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
            return F.when(acc["lo"] >= acc["hi"], acc).otherwise(
                F.when(F.get(vocab, mid) < w, F.struct((mid + 1).alias("lo"), acc["hi"].alias("hi")))
                .otherwise(F.struct(acc["lo"].alias("lo"), mid.alias("hi"))))

        return F.aggregate(steps, init, step, lambda acc: F.when(F.get(vocab, acc["lo"]) == w, acc["lo"] + FIRST_SHARED).otherwise(F.lit(missing)))

    return F.transform(words, search)


def _as_code_points(numbers: Column) -> Column:
    """A string of one code point per number (from 1, below the number of code points)."""
    point = lambda k: F.when(k < _SURROGATES, k).otherwise(k + (_AFTER - _SURROGATES))
    return F.decode(F.unhex(F.array_join(F.transform(numbers, lambda k: F.lpad(F.hex(point(k)), 8, "0")), "")), "UTF-32")


def encode_words(words, vocab, missing: int) -> Column:
    """One code point per word as a string."""
    return _as_code_points(_binary_search(_col(words), _col(vocab), missing))


def _hash_codes(words: Column) -> Column:
    return F.transform(words, lambda w: (F.pmod(F.xxhash64(w), F.lit(MAX_SHARED_WORDS)) + FIRST_SHARED).cast("int"))


def tells_apart(words: Column) -> Column:
    """Whether the hash codes of distinct words are distinct too."""
    return F.size(F.array_distinct(_hash_codes(words))) == F.size(words)


def banded_levenshtein(a: Column, b: Column) -> Column:
    """Distance of two strings (staged columns), looked for in bands around the diagonal that grow until the distance
    lies within: the work goes with the distance, not with the square of the length."""
    longest = F.greatest(F.length(a), F.length(b))
    rounds = F.sequence(F.lit(0), F.ceil(F.greatest(F.log2(longest / FIRST_BAND + 1), F.lit(0.0)) / 2 + 1).cast("int"))
    none = F.lit(-1)

    def look(found: Column, k: Column) -> Column:
        band = (F.lit(FIRST_BAND) * F.pow(F.lit(4), k)).cast("int")
        return F.when(found >= 0, found).otherwise(F.call_function("levenshtein", a, b, band))

    return F.aggregate(rounds, none, look)


def with_word_edit_distance(df, ref_col: str, hyp_col: str, out: str = "errors"):
    """Add ``out`` = unit-cost Levenshtein distance of two array<string> columns.

    Each word becomes one code point, so the built-in character ``levenshtein`` computes the word distance. The code is
    the word's hash where the hashes tell all words of the pair apart (most pairs of up to a thousand different words);
    for other pairs it is the word's number among those that both texts have. Vocabulary and codes are staged: an
    inline expression would be evaluated again for every word. A pair of the second kind that shares more distinct words
    than there are code points (1,112,061) has no distance (NULL: an error row, not a failed job)."""
    ref, hyp, vocab = _col(ref_col), _col(hyp_col), F.col("_vocab")
    df = df.withColumn("_hashed", tells_apart(F.array_union(ref, hyp)))
    df = df.withColumn("_vocab", F.when(~F.col("_hashed"), shared_words(ref, hyp)))
    code = lambda words, missing: F.when(F.col("_hashed"), _as_code_points(_hash_codes(words))).otherwise(encode_words(words, vocab, missing))
    df = df.withColumns({"_a": code(ref, ONLY_REF), "_b": code(hyp, ONLY_HYP)})
    dist = F.when(F.col("_hashed") | (F.size(vocab) <= MAX_SHARED_WORDS), banded_levenshtein(F.col("_a"), F.col("_b")))
    return df.withColumn(out, dist).drop("_hashed", "_vocab", "_a", "_b")


def wer_from_counts(errors, ref_count, hyp_count) -> Column:
    """T3 from integer counts: empty reference gives 1.0 if anything was heard."""
    errors, ref_count, hyp_count = _col(errors), _col(ref_count), _col(hyp_count)
    return (F.when(ref_count == 0, F.when(hyp_count > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
            .otherwise(errors.cast("double") / ref_count))


def accuracy(wer_col) -> Column:
    """T4: ``max(0, 1 - wer)``."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - _col(wer_col))


def sentences(c) -> Column:
    """Split text after ``.``, ``!`` or ``?`` followed by whitespace, or at a
    newline; items are stripped and empty ones dropped."""
    parts = F.split(_col(c), f"(?<=[.!?])[{WS_CLASS}]+|\\n")
    return F.filter(F.transform(parts, strip), lambda s: F.length(s) > 0)


def explode_items(c) -> Column:
    """``explode`` for computed arrays: pair with ``.where(col.isNotNull())``.

    A plain ``explode`` makes Catalyst infer ``size(array) > 0`` and push it
    below the projection, re-evaluating the (costly) array expression there;
    ``explode_outer`` is exempt from that rule. Arrays must hold no NULLs."""
    return F.explode_outer(_col(c))


def posexplode_items(c) -> Column:
    """``posexplode`` counterpart of :func:`explode_items`."""
    return F.posexplode_outer(_col(c))
