"""Provider responses and session documents as JSON.

The reference distinguishes a *missing* key (replaced by a default) from an
explicit JSON null (kept, or an error where the value is stripped). Key
presence is therefore read with ``json_object_keys``, values with
``get_json_object`` / ``from_json``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions.text import _col, is_blank, strip

SUMMARY_LISTS = ("key_points", "action_items", "topics")


def has_key(doc: Column, key: str) -> Column:
    return F.array_contains(F.json_object_keys(doc), key)


def is_object(doc: Column) -> Column:
    """A JSON object and nothing after it: as the only item of an array it is valid."""
    alone = F.json_array_length(F.concat(F.lit("["), doc, F.lit("]"))) == 1
    return F.json_object_keys(doc).isNotNull() & F.coalesce(alone, F.lit(False))


def parse_structure_response(resp) -> Column:
    """struct(error, presentation, raw_qa).

    Empty or invalid JSON is an error; a missing key reads as ''; an explicit
    null cannot be stripped and is an error; both values are stripped. The
    labelled Q&A still needs T5-T7 (see ``with_clean_qa``)."""
    r = _col(resp)

    whole = F.try_parse_json(r)

    def field(name):
        v = F.get_json_object(r, f"$.{name}")
        return F.when(has_key(r, name), v).otherwise(F.lit(""))

    def not_text(name):
        return has_key(r, name) & ~F.schema_of_variant(F.try_variant_get(whole, f"$.{name}", "variant")).isin("STRING", "VOID")

    pres, qa_ = field("presentation"), field("q_and_a")
    err = (F.when(is_blank(r), F.lit("empty response"))
           .when(~is_object(r) | whole.isNull(), F.lit("invalid json"))
           .when(not_text("presentation") | not_text("q_and_a"), F.lit("field is not text"))
           .when(pres.isNull() | qa_.isNull(), F.lit("null field")))
    return F.struct(err.alias("error"), strip(pres).alias("presentation"), strip(qa_).alias("raw_qa"))


SUMMARY_SCHEMA = "struct<content:string,key_points:array<string>,action_items:array<string>,topics:array<string>>"


def parse_summary_response(resp) -> Column:
    """struct(error, content, key_points, action_items, topics).

    Missing ``content`` reads as '', missing lists as []; explicit nulls are
    kept; empty or invalid JSON is an error."""
    r = _col(resp)
    parsed = F.from_json(r, SUMMARY_SCHEMA)
    content = F.when(has_key(r, "content"), parsed["content"]).otherwise(F.lit(""))
    lists = [F.when(has_key(r, k), parsed[k]).otherwise(F.array().cast("array<string>")).alias(k)
             for k in SUMMARY_LISTS]
    err = F.when(is_blank(r), F.lit("empty response")).when(~is_object(r), F.lit("invalid json"))
    return F.struct(err.alias("error"), content.alias("content"), *lists)


def to_document(c) -> Column:
    """JSON text of a struct, explicit nulls kept, non-ASCII unescaped,
    ISO-8601 timestamps."""
    return F.to_json(_col(c), {"ignoreNullFields": "false",
                               "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})


def from_document(c, schema) -> Column:
    return F.from_json(_col(c), schema, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})


#: What a stored session may hold; the time is read as text, as its form varies.
STORED_SESSION = (
    "struct<session_id:string,metadata:struct<session_id:string,created_at:string,title:string,duration_seconds:double,extra_info:variant>,"
    "transcript:struct<raw_text:string,segments:array<struct<start_time:double,end_time:double,text:string,speaker:string>>,language:string>,"
    "presentation_text:string,structured_qa_text:string,"
    "summary:struct<content:string,key_points:array<string>,action_items:array<string>,topics:array<string>>>"
)
#: JSON texts of a part that count as absent.
FALSY = ("{}", "[]", '""', "", "0", "false", "null")


def decode_session(doc) -> Column:
    """struct(error, session) of a stored document.

    Missing lists are empty, an absent or falsy transcript or summary is null,
    any ISO time is read (no zone means UTC). A document that is no JSON object,
    or lacks a required field, has an error and no session."""
    d = _col(doc)
    p = F.from_json(d, STORED_SESSION)
    none = F.array().cast("array<string>")
    whole = lambda part: ~F.coalesce(F.get_json_object(d, f"$.{part}"), F.lit("null")).isin(*FALSY)
    m, t, s = p["metadata"], p["transcript"], p["summary"]
    created = F.try_to_timestamp(m["created_at"])
    segments = F.coalesce(t["segments"], F.array().cast("array<struct<start_time:double,end_time:double,text:string,speaker:string>>"))
    meta = F.struct(m["session_id"].alias("session_id"), created.alias("created_at"), m["title"].alias("title"),
                    m["duration_seconds"].alias("duration_seconds"),
                    F.coalesce(m["extra_info"], F.parse_json(F.lit("{}"))).alias("extra_info"))
    transcript = F.struct(t["raw_text"].alias("raw_text"), segments.alias("segments"), t["language"].alias("language"))
    summary = F.struct(s["content"].alias("content"), *[F.coalesce(s[k], none).alias(k) for k in SUMMARY_LISTS])
    session = F.struct(p["session_id"].alias("session_id"), meta.alias("metadata"), F.when(whole("transcript"), transcript).alias("transcript"),
                       p["presentation_text"].alias("presentation_text"), p["structured_qa_text"].alias("structured_qa_text"),
                       F.when(whole("summary"), summary).alias("summary"))
    bad_segment = F.exists(segments, lambda x: x["start_time"].isNull() | x["end_time"].isNull() | x["text"].isNull())
    missing = F.array_compact(F.array(
        F.when(p["session_id"].isNull(), F.lit("session_id")), F.when(m["session_id"].isNull(), F.lit("metadata.session_id")),
        F.when(created.isNull(), F.lit("metadata.created_at")),
        F.when(whole("transcript") & t["raw_text"].isNull(), F.lit("transcript.raw_text")),
        F.when(whole("transcript") & bad_segment, F.lit("segments")),
        F.when(whole("summary") & s["content"].isNull(), F.lit("summary.content"))))
    error = F.when(~F.coalesce(is_object(d), F.lit(False)), F.lit("not a JSON object")).when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", ")))
    return F.struct(error.alias("error"), F.when(error.isNull(), session).alias("session"))
