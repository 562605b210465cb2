"""Schemas of the session data model (nested session document)."""

from pyspark.sql import types as T

SEGMENT = T.StructType([
    T.StructField("start_time", T.DoubleType(), False),
    T.StructField("end_time", T.DoubleType(), False),
    T.StructField("text", T.StringType(), False),
    T.StructField("speaker", T.StringType(), True),
])
TRANSCRIPT = T.StructType([
    T.StructField("raw_text", T.StringType(), False),
    T.StructField("segments", T.ArrayType(SEGMENT, False), True),
    T.StructField("language", T.StringType(), True),
])
SUMMARY = T.StructType([
    T.StructField("content", T.StringType(), True),
    T.StructField("key_points", T.ArrayType(T.StringType()), True),
    T.StructField("action_items", T.ArrayType(T.StringType()), True),
    T.StructField("topics", T.ArrayType(T.StringType()), True),
])
# extra_info holds free-form values
METADATA = T.StructType([
    T.StructField("session_id", T.StringType(), False),
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("title", T.StringType(), True),
    T.StructField("duration_seconds", T.DoubleType(), True),
    T.StructField("extra_info", T.VariantType(), True),
])
SESSION = T.StructType([
    T.StructField("session_id", T.StringType(), False),
    T.StructField("metadata", METADATA, False),
    T.StructField("transcript", TRANSCRIPT, True),
    T.StructField("presentation_text", T.StringType(), True),
    T.StructField("structured_qa_text", T.StringType(), True),
    T.StructField("summary", SUMMARY, True),
])
SESSION_FIELDS = [f.name for f in SESSION.fields]
