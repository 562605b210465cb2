"""Transcript-quality evaluation (E3): pairing, WER scoring, macro averages,
leaderboard pivot, best model and vocabulary coverage (J2, T1-T4, A2-A5, T16).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.text import accuracy, explode_items, normalise_words, wer_from_counts, with_word_edit_distance

AVERAGE_ACCURACY = "Average Accuracy"
AVERAGE_WER = "Average WER"


def scoring_partitions(spark) -> int:
    """Partition count for CPU-heavy text stages: the cluster's shuffle width,
    at least one task per core. Explicit counts are not coalesced by AQE, which
    would otherwise merge a few MB of text (hours of CPU at scale) into one task."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    # several tasks per core: text lengths vary, small tasks even out the load
    return max(n, 4 * spark.sparkContext.defaultParallelism)


def pair_cases(refs: DataFrame, hyps: DataFrame, keys: Sequence[str], prepartitioned: bool = False) -> DataFrame:
    """Inner match of references and hypotheses on the case key.

    A case missing on either side is dropped; one reference may meet many
    hypotheses (one per model). Both sides are hash-partitioned on the case key
    with the same explicit width, so the join adds no exchange of its own and
    the costly scoring that follows runs at full parallelism.
    """
    keys = list(keys)
    if prepartitioned:  # both sides already hash-partitioned on the keys: plain join
        return refs.join(hyps, on=keys, how="inner")
    n = scoring_partitions(refs.sparkSession)
    return refs.repartition(n, *keys).join(hyps.repartition(n, *keys), on=keys, how="inner")


def score_pairs(pairs: DataFrame, ref_col: str = "ref_text", hyp_col: str = "hyp_text") -> DataFrame:
    """T1-T4 per pair: adds ref_words, hyp_words, errors, wer, accuracy."""
    ref_w, hyp_w = normalise_words(F.col(ref_col)), normalise_words(F.col(hyp_col))
    scored = (pairs
              .withColumn("_ref", ref_w)
              .withColumn("_hyp", hyp_w)
              .withColumn("ref_words", F.size("_ref").cast("long"))
              .withColumn("hyp_words", F.size("_hyp").cast("long")))
    scored = with_word_edit_distance(scored, "_ref", "_hyp", "errors")
    return (scored
            .withColumn("errors", F.col("errors").cast("long"))
            .withColumn("wer", wer_from_counts("errors", "ref_words", "hyp_words"))
            .withColumn("accuracy", accuracy(F.col("wer")))
            .withColumn("error_class", F.when(F.col("errors").isNull(), F.lit("TooManyDistinctWords")))
            .drop("_ref", "_hyp"))


def macro_wer(scored: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """A2 + A5: macro-average WER per model over valid cases.

    Average accuracy is ``max(0, 1 - avg(wer))`` (not the mean of clamped
    accuracies). A model with no valid case produces no row.
    """
    # No filter on ``wer``: Catalyst would push it below the projection and
    # evaluate the edit distance twice. avg/count already skip NULL (invalid) cases.
    return (scored.groupBy(*by)
            .agg(F.avg("wer").alias("avg_wer"), F.count("wer").alias("n_cases"))
            .where(F.col("n_cases") > 0)
            .withColumn("avg_accuracy", accuracy(F.col("avg_wer"))))


def leaderboard(scored: DataFrame, case_col: str, models: Sequence[str], digits: int = 6) -> DataFrame:
    """A3: case x model accuracy matrix plus the two macro-average rows.

    One pivot (explicit values: no distinct-values job) carries each case's WER;
    accuracies are computed above it, and the macro rows aggregate it. All three
    parts need the same columns of the same pivot, so its exchange is reused and
    every pair is scored once.
    """
    models = list(models)
    cells = scored.groupBy(case_col).pivot("model", models).agg(F.first("wer"))
    grid = cells.select(case_col, *[F.round(accuracy(F.col(m)), digits).alias(m) for m in models])
    macro = cells.agg(*[F.avg(m).alias(m) for m in models])
    labels = F.explode(F.array(F.lit(AVERAGE_ACCURACY), F.lit(AVERAGE_WER))).alias(case_col)
    value = lambda m: F.when(F.col(case_col) == AVERAGE_WER, F.col(m)).otherwise(accuracy(F.col(m)))
    averages = macro.select(labels, *models).select(case_col, *[F.round(value(m), digits).alias(m) for m in models])
    return grid.unionByName(averages)


def best_model(scored: DataFrame, case_col: str, overall_label: str = "__overall__", digits: int = 6) -> DataFrame:
    """A4: most accurate model per case (ties -> smallest model name), plus the
    overall recommendation (highest macro accuracy).

    Grouping sets average the WER per (case, model) and per model over one scored
    input; invalid pairs (no WER) compete nowhere.
    """
    averaged = (scored.groupingSets([[case_col, "model"], ["model"]], case_col, "model")
                .agg(F.avg("wer").alias("wer"), F.grouping(case_col).alias("overall")))
    ranked = averaged.select(F.when(F.col("overall") == 1, F.lit(overall_label)).otherwise(F.col(case_col)).alias(case_col),
                             "model", accuracy(F.col("wer")).alias("accuracy"), F.col("wer").isNotNull().alias("valid"))
    rank_key = F.when(F.col("valid"), F.struct((-F.col("accuracy")).alias("neg_acc"), F.col("model")))
    return (ranked.groupBy(case_col)
            .agg(F.min_by("model", rank_key).alias("best_model"), F.max(F.when(F.col("valid"), F.col("accuracy"))).alias("accuracy"))
            .withColumn("accuracy", F.round("accuracy", digits)))


def ngrams(words, n: int):
    """Contiguous word n-grams of an array *column reference*, joined by one
    space (the lambda indexes ``words``, so it must be cheap to evaluate)."""
    if n == 1:
        return words
    if n == 2:  # pair each word with its successor: no per-gram slice
        return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
                          F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
                          lambda a, b: F.concat(a, F.lit(" "), b))
    # sequence(1, 0) would count down: no n-grams for texts shorter than n
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(
        F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def with_grams(df: DataFrame, text_col: str, max_n: int, out: str, distinct: bool = False) -> DataFrame:
    """Stage the normalised words, then add all 1..max_n-grams as ``out``."""
    df = df.withColumn("_w", normalise_words(F.col(text_col)))
    w = F.col("_w")
    grams = F.flatten(F.array(*[ngrams(w, n) for n in range(1, max_n + 1)]))
    return df.withColumn(out, F.array_distinct(grams) if distinct else grams).drop("_w")


def vocabulary_terms(source: DataFrame, text_col: str = "text", max_n: int = 3) -> DataFrame:
    """Term table for T16: distinct normalised n-grams (n <= max_n) taken from a
    vocabulary source table, short ones included."""
    g = with_grams(source, text_col, max_n, "_g")
    return g.select(explode_items("_g").alias("term")).where(F.col("term").isNotNull()).distinct()


def percent(ratio: Column, digits: int = 2) -> Column:
    """A ratio as text, like ``93.75%``."""
    return F.format_string(f"%.{digits}f%%", F.round(100 * ratio, digits))


def longest_term(terms: DataFrame) -> int:
    """Number of words of the longest term: n-grams up to it can match."""
    return terms.agg(F.coalesce(F.max(F.size(F.split("term", " "))), F.lit(1))).first()[0]


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def gram_hashes(hashes: Column, n: int) -> Column:
    """Hashes of all n-grams, from a staged array of word hashes."""
    if n == 1:
        return F.transform(hashes, lambda x: F.xxhash64(x))
    starts = F.slice(hashes, 1, F.greatest(F.size(hashes) - (n - 1), F.lit(0)))
    if n == 2:
        return F.zip_with(starts, F.slice(hashes, 2, F.greatest(F.size(hashes) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    return F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get(hashes, i + k) for k in range(1, n)]))


def vocabulary_coverage(texts: DataFrame, terms: DataFrame, id_col: str, text_col: str = "text",
                        max_n: int | None = None) -> DataFrame:
    """Hits per (text, term) for whole-word term matches on normalised text.

    N-grams are never built: each is a 64-bit hash of its words' hashes, and hashes meet those of the terms
    in an equi-join whose strategy is Spark's (a measured-small term table is broadcast, without a shuffle of the
    n-grams). Two different n-grams of one hash are not told apart; among 10^12 n-grams and 10^5 terms that is to be
    expected once in two hundred runs. The count per (text, term) is partially aggregated before its shuffle.
    """
    max_n = max_n or longest_term(terms)
    words = terms.select("term", word_hashes(F.split("term", " ")).alias("_w"))
    known = words.select("term", F.coalesce(*[F.when(F.size("_w") == n, F.get(gram_hashes(F.col("_w"), n), F.lit(0))) for n in range(1, max_n + 1)]).alias("_h"))
    hashed = texts.select(id_col, word_hashes(normalise_words(F.col(text_col))).alias("_w"))
    grams = F.flatten(F.array(*[gram_hashes(F.col("_w"), n) for n in range(1, max_n + 1)]))
    exploded = hashed.select(id_col, explode_items(grams).alias("_h")).where(F.col("_h").isNotNull())
    return exploded.join(known.where(F.col("_h").isNotNull()), "_h").groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("hits"))


def missed_terms(pairs: DataFrame, terms: DataFrame, keys: Sequence[str], max_n: int | None = None) -> DataFrame:
    """T16 second half: terms in the reference text that the hypothesis lacks."""
    max_n = max_n or longest_term(terms)
    base = with_grams(pairs.select(*keys, "ref_text", "hyp_text"), "ref_text", max_n, "_rg", distinct=True)
    base = with_grams(base, "hyp_text", max_n, "_hg", distinct=True)
    missing = (base.select(*keys, explode_items(F.array_except("_rg", "_hg")).alias("term"))
               .where(F.col("term").isNotNull()))
    return missing.join(terms.select("term"), "term", "left_semi")
