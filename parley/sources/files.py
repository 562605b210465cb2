"""File sources: recordings (S1), transcripts (S2), Q&A files (S3),
evaluation pairs (S6), source validation (S7).

A folder is listed whole, names that begin with ``_`` or ``.`` included
(:mod:`parley.sources.named_files`). ``listing="spark"`` reads by Spark's own file sources
instead, which reach every store that Spark knows but skip such names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators.incremental import AUDIO_GLOB, QA_SUFFIX, is_derived, stem
from parley.sources.named_files import read_files


def _name(path_col: str = "path"):
    return F.regexp_extract(F.col(path_col), r"([^/]+)$", 1)


def _glob_patterns(glob: str) -> list[str]:
    """``*.{a,b}`` as separate patterns."""
    if "{" not in glob:
        return [glob]
    head, _, rest = glob.partition("{")
    inside, _, tail = rest.partition("}")
    return [head + x + tail for x in inside.split(",")]


def scan_audio(spark: SparkSession, folder: str, listing: str = "all") -> DataFrame:
    """(path, name, stem, modificationTime, length, content) of *.mp3,
    *.wav, *.m4a files (case-sensitive, not recursive)."""
    if listing == "all":
        df = read_files(spark, folder, *_glob_patterns(AUDIO_GLOB))
    else:
        df = spark.read.format("binaryFile").option("pathGlobFilter", AUDIO_GLOB).load(folder).withColumn("name", _name())
    return df.select("path", "modificationTime", "length", "content", "name", stem("name").alias("stem"))


def scan_text(spark: SparkSession, folder: str, glob: str = "*.txt", listing: str = "all") -> DataFrame:
    """Whole-file UTF-8 text: (path, text, name, stem)."""
    if listing == "all":
        df = read_files(spark, folder, glob).select("path", F.decode("content", "UTF-8").alias("text"), "name")
    else:
        df = (spark.read.option("pathGlobFilter", glob).text(folder, wholetext=True)
              .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).withColumn("name", _name()))
    return df.withColumn("stem", stem("name"))


def scan_transcripts(spark: SparkSession, folder: str, listing: str = "all") -> DataFrame:
    """Transcripts, without the structuring stage's derived files."""
    return scan_text(spark, folder, listing=listing).where(~is_derived(F.col("stem")))


def scan_qa(spark: SparkSession, folder: str, listing: str = "all") -> DataFrame:
    """S3: labelled Q&A files."""
    return scan_text(spark, folder, f"*{QA_SUFFIX}.txt", listing)


def scan_eval_pairs(refs: DataFrame, hyps: DataFrame, case_col: str = "stem") -> DataFrame:
    """Reference and hypothesis text paired by case name; a case missing
    on either side is skipped."""
    return (refs.select(F.col(case_col).alias("case_name"), F.col("text").alias("ref_text"))
            .join(hyps.select(F.col(case_col).alias("case_name"), F.col("text").alias("hyp_text")), "case_name"))


def validate_sources(requested: DataFrame, listing: DataFrame, path_col: str = "path") -> DataFrame:
    """Requested paths with status ``ok`` / ``missing`` (left join against
    the listing); ``content`` is NULL for missing files, which the
    transcription stage reports as an error row (R5)."""
    lst = listing.select(F.col(path_col).alias("_p"), "content")
    j = requested.join(lst, requested[path_col] == lst["_p"], "left")
    return j.select(requested[path_col], F.when(F.col("_p").isNull(), F.lit("missing")).otherwise(F.lit("ok")).alias("status"),
                    "content")
