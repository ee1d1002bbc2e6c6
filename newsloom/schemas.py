"""Typed shapes of the archive: messages, daily reports, events, issues."""

from __future__ import annotations

from pyspark.sql import types as T

# The category keys of the daily report format, in display order.
CATEGORIES = ("bayanat", "sirens", "enemy", "iran", "videos", "allies")
REPORT_ARRAYS = CATEGORIES + ("summaries",)
# The short counter keys of older daily reports.
SHORT_COUNTERS = {"bayanat": "b", "sirens": "s", "enemy": "e", "iran": "ir", "videos": "v", "allies": "al"}


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


S, I, L, D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()

MESSAGE = _struct(
    ("id", L), ("date", T.DateType()), ("time", S), ("ts", T.TimestampType()), ("sender", S),
    ("reply_to", L), ("views", L), ("forwards", L), ("reactions", L), ("text", S),
)

STRIKE = _struct(("opTime", S), ("target", S), ("weapon", S))
STATEMENT = _struct(
    ("num", I), ("postTime", S), ("opTime", S), ("target", S), ("weapon", S), ("badge", S),
    ("tags", T.ArrayType(S)), ("bayan_type", S), ("fullText", S), ("strikes", T.ArrayType(STRIKE)),
)
ALERT = _struct(("time", S), ("location", S), ("fullText", S))
ALERT_POINT = _struct(("lat", D), ("lng", D), ("loc", S), ("times", T.ArrayType(S)), ("count", I))
MEDIA = _struct(("time", S), ("summary", S), ("fullText", S))
SOURCED = _struct(("time", S), ("source", S), ("summary", S), ("fullText", S))
VIDEO = _struct(("time", S), ("description", S), ("fullText", S))
ALLY = _struct(("flag", S), ("time", S), ("summary", S), ("fullText", S))
DIGEST = _struct(("time", S), ("kind", S), ("summary", S), ("fullText", S))
COUNTERS = _struct(*[(c, I) for c in REPORT_ARRAYS], *[(s, I) for s in SHORT_COUNTERS.values()])

REPORT = _struct(
    ("date", S), ("dayAr", S), ("dateAr", S), ("hijri", S), ("stats", COUNTERS),
    ("bayanat", T.ArrayType(STATEMENT)), ("sirens", T.ArrayType(ALERT)),
    ("sirenPoints", T.ArrayType(ALERT_POINT)), ("enemy", T.ArrayType(MEDIA)),
    ("iran", T.ArrayType(SOURCED)), ("videos", T.ArrayType(VIDEO)),
    ("allies", T.ArrayType(ALLY)), ("summaries", T.ArrayType(DIGEST)),
)
# A day with very many items is split into several documents: their number, and
# the position of their first item in the day. Both are absent in ordinary ones.
PARTS = _struct(("part", I), ("first_position", L))

EVENT = _struct(
    ("id", L), ("date", T.DateType()), ("category", S), ("time", S), ("op_time", S), ("title", S),
    ("subtitle", S), ("badge", S), ("tags", T.ArrayType(S)), ("lat", D), ("lng", D),
    ("location", S), ("full_text", S),
)

ISSUE = _struct(("date", S), ("category", S), ("severity", S), ("message", S))
GAZETTEER = _struct(("name", S), ("lat", D), ("lng", D), ("priority", I))
RULE = _struct(("rule_set", S), ("priority", I), ("label", S), ("kind", S), ("pattern", S))
ALIAS = _struct(("alias", S), ("canonical", S))
