"""Model-backed stages: providers (U1, U2), transcription, structuring and
summarising (M1-M3, P6, P10, P11), pacing of calls (R4).

A provider is a value: which stage it serves, its name, the options it takes and
a factory. The factory is called once per Python worker (models load once, not per
row) and returns a function from one input to one reply. Calls run in
``mapInPandas``; a failing call is an error row of its stage's class, the other
rows go on (R5). Replies of structuring and summarising providers are JSON texts,
which T13 and T14 read.
"""

from __future__ import annotations

import json
import sys
import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import qa
from parley.functions.json import parse_structure_response, parse_summary_response
from parley.functions.text import strip


# Ship this module's worker functions by value: Python workers then need no
# installed copy of the package (it is still needed on the driver only).
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle: ship with --py-files
    pass


class UnknownProvider(LookupError):
    """No provider of that name serves the stage."""


class Refused(RuntimeError):
    """A provider's call that came too soon (its quota is used up): it is made again later."""


class UnknownOption(TypeError):
    """The provider does not take that option."""


#: Stage -> class of its error rows.
STAGE_ERRORS = {"transcribe": "TranscriptionError", "structurize": "StructuringError", "summarize": "SummarizationError"}


@dataclass(frozen=True)
class Provider:
    """``factory(**options)`` gives a function from one input to one reply."""

    stage: str
    name: str
    factory: Callable[..., Callable[[Any], Any]]
    options: Mapping[str, Any] = field(default_factory=dict)  # option -> default

    def bind(self, given: Mapping[str, Any]) -> dict[str, Any]:
        extra = sorted(set(given) - set(self.options))
        if extra:
            raise UnknownOption(f"{self.stage}/{self.name} takes {sorted(self.options) or 'no options'}, not {extra}")
        return {**self.options, **given}


#: (stage, name) -> provider. Add to it to plug in a model.
PROVIDERS: dict[tuple[str, str], Provider] = {}


def add(*providers: Provider) -> None:
    """Make providers available; a name can be taken once per stage."""
    for p in providers:
        if PROVIDERS.setdefault((p.stage, p.name), p) is not p:
            raise ValueError(f"two providers of stage {p.stage} are named {p.name}")


def find(stage: str, provider: str | Provider) -> Provider:
    if isinstance(provider, Provider):
        return provider
    wanted = (stage, provider.strip().lower())
    if wanted not in PROVIDERS:
        served = ", ".join(n for s, n in sorted(PROVIDERS) if s == stage)
        raise UnknownProvider(f"stage {stage} is served by: {served}; there is no {provider!r}")
    return PROVIDERS[wanted]


def read_timed_text(language: str | None = None) -> Callable[[bytes], tuple[list[dict], str | None]]:
    """Timed-text payloads: one JSON object per line with ``start``, ``end`` and
    ``text``; a line with only ``language`` names the language."""
    def read(payload: bytes):
        heard, lang = [], language
        for line in filter(str.strip, payload.decode("utf-8").splitlines()):
            rec = json.loads(line)
            if "text" in rec:
                heard.append({"start_time": float(rec["start"]), "end_time": float(rec["end"]), "text": rec["text"], "speaker": None})
            else:
                lang = lang or rec["language"]
        return heard, lang

    return read


def read_plain_text(language: str | None = None) -> Callable[[bytes], tuple[list[dict], str | None]]:
    """P10: no timings, so one segment (0.0, 0.0, whole text)."""
    return lambda payload: ([{"start_time": 0.0, "end_time": 0.0, "text": payload.decode("utf-8"), "speaker": None}], language)


def text_as_reply() -> Callable[[str], str]:
    """Takes the input text for the reply: for replies recorded earlier, and for tests."""
    return lambda text: text


add(Provider("transcribe", "timed_text", read_timed_text, {"language": None}),
    Provider("transcribe", "plain_text", read_plain_text, {"language": None}),
    Provider("structurize", "recorded", text_as_reply),
    Provider("summarize", "recorded", text_as_reply))


#: Times that a call is made in all while the provider refuses it.
ATTEMPTS = 5


def call(df: DataFrame, key: str, value: str, provider: Provider, options: Mapping[str, Any], reply: str,
         unpack: Callable[[Any], tuple] = lambda r: (r,), per_minute: float | None = None, callers: int = 1) -> DataFrame:
    """(key, reply columns, error_class, error_msg): one call per row of ``df``.

    ``reply`` is the schema of what ``unpack`` makes of a reply. ``per_minute`` bounds the rate of calls (R4): the
    calls are a stage of their own of ``callers`` tasks, to which the rows are dealt (what comes before keeps its own
    tasks), and each task makes its calls at its part of the rate. A call that the provider refuses
    (:class:`Refused`) goes to the end of the task's queue; it counts like any other, and is an error row after
    ``ATTEMPTS`` times. A null value is a missing input.
    """
    kind, factory, error = key_type(df, key), provider.factory, STAGE_ERRORS[provider.stage]
    names = [c.split(" ")[0] for c in reply.split(";")]
    pause = 60.0 * callers / per_minute if per_minute else 0.0
    refused = Refused

    def run(batches: Iterator) -> Iterator:
        from collections import deque

        import pandas as pd

        ask, due = factory(**options), 0.0

        def one(k, v, tries):
            nonlocal due
            time.sleep(max(0.0, due - time.monotonic()))
            due = time.monotonic() + pause
            try:
                if v is None:
                    raise FileNotFoundError(f"nothing to read for {k}")
                return (k, *unpack(ask(v)), None, None)
            except refused as exc:
                if tries < ATTEMPTS:
                    return None
                failure = exc
            except Exception as exc:  # one bad input is reported, the rest continue
                failure = exc
            return (k, *[None] * len(names), error, f"{type(failure).__name__}: {failure}")

        for pdf in batches:
            queue, rows = deque((k, v, 1) for k, v in zip(pdf[key], pdf[value])), []
            while queue:
                k, v, tries = queue.popleft()
                row = one(k, v, tries)
                if row is None:
                    queue.append((k, v, tries + 1))
                else:
                    rows.append(row)
            yield pd.DataFrame(rows, columns=[key, *names, "error_class", "error_msg"])

    paced = df.select(key, value).repartition(callers) if per_minute else df.select(key, value)
    return paced.mapInPandas(run, f"{key} {kind}, {reply.replace(';', ', ')}, error_class string, error_msg string")


def key_type(df: DataFrame, key: str) -> str:
    return df.schema[key].dataType.simpleString()


SEGMENTS = "segments array<struct<start_time:double,end_time:double,text:string,speaker:string>>;language string"


def normalise_segments(segments: Column) -> Column:
    """Trimmed text, no speaker, timings kept."""
    return F.transform(segments, lambda s: F.struct(s["start_time"].alias("start_time"), s["end_time"].alias("end_time"),
                                                    strip(s["text"]).alias("text"),
                                                    F.lit(None).cast("string").alias("speaker")))


def transcribe(files: DataFrame, provider: str | Provider = "timed_text", language: str | None = None, key: str = "path",
               per_minute: float | None = None, callers: int = 1, **options) -> DataFrame:
    """M1: (key, content) rows -> (key, transcript, error_class, error_msg).

    A fixed language is handed to providers that take one, and recorded (P11).
    ``content`` NULL means a missing file."""
    p = find("transcribe", provider)
    if language is not None and "language" in p.options:
        options["language"] = language
    out = call(files, key, "content", p, p.bind(options), SEGMENTS, lambda r: r, per_minute, callers)
    segs = normalise_segments(F.col("segments"))
    transcript = F.struct(F.array_join(F.transform(segs, lambda s: s["text"]), " ").alias("raw_text"),
                          segs.alias("segments"),
                          F.coalesce(F.lit(language).cast("string"), F.col("language")).alias("language"))
    return out.select(key, F.when(F.col("error_class").isNull(), transcript).alias("transcript"), "error_class", "error_msg")


def _read_reply(out: DataFrame, parsed: Column, stage: str) -> DataFrame:
    """Adds ``_p``, and the parser's error where the call itself succeeded."""
    out = out.withColumn("_p", parsed)
    return (out.withColumn("error_msg", F.coalesce("error_msg", "_p.error"))
            .withColumn("error_class", F.when(F.col("error_msg").isNotNull(), F.lit(STAGE_ERRORS[stage]))))


def structurize(texts: DataFrame, provider: str | Provider, key: str, text: str, per_minute: float | None = None,
                callers: int = 1, **options) -> DataFrame:
    """M2 by a provider: (key, presentation_text, structured_qa_text, error_class, error_msg)."""
    p = find("structurize", provider)
    out = call(texts, key, text, p, p.bind(options), "reply string", per_minute=per_minute, callers=callers)
    out = _read_reply(out, parse_structure_response("reply"), "structurize").withColumn("_raw", F.col("_p.raw_qa"))
    out = qa.with_clean_qa(out, "_raw", "_qa")
    ok = F.col("error_class").isNull()
    return out.select(key, F.when(ok, F.col("_p.presentation")).alias("presentation_text"),
                      F.when(ok, F.col("_qa")).alias("structured_qa_text"), "error_class", "error_msg")


def summarize(texts: DataFrame, provider: str | Provider, key: str, text: str, per_minute: float | None = None,
              callers: int = 1, **options) -> DataFrame:
    """M3 by a provider: (key, summary, error_class, error_msg)."""
    p = find("summarize", provider)
    out = call(texts, key, text, p, p.bind(options), "reply string", per_minute=per_minute, callers=callers)
    out = _read_reply(out, parse_summary_response("reply"), "summarize")
    summary = F.struct(*[F.col(f"_p.{c}").alias(c) for c in ("content", "key_points", "action_items", "topics")])
    return out.select(key, F.when(F.col("error_class").isNull(), summary).alias("summary"), "error_class", "error_msg")
