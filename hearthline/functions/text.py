"""Predicates on ids, topics and free text.  They return null for null input
unless stated otherwise; callers decide what null means."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted formats.  ``\z`` is the true end of the text,
# where ``$`` would also match before a final line break.
DEVICE_ID = r"^[0-9a-fA-F-]{36}\z"
CLAIM_CODE = r"^[0-9]{3}-[0-9]{3}\z"
COMMANDS_TOPIC = r"^devices/[^/]+/commands/*\z"
BLANK = r"^[\s\x1c-\x1f\u1680\u2000-\u2006\u2008-\u200a\u2028\u2029\u205f\u3000]*\z"


def is_blank(text: Column) -> Column:
    """True for null, empty and whitespace-only text."""
    return text.isNull() | text.rlike(BLANK)


def has_nul(text: Column) -> Column:
    return F.contains(text, F.expr("chr(0)"))


def strip_nul(text: Column) -> Column:
    return F.replace(text, F.expr("chr(0)"), F.lit(""))


def device_id_ok(text: Column) -> Column:
    """36 hex digits or dashes; null is not ok."""
    return F.coalesce(text.rlike(DEVICE_ID), F.lit(False))


def claim_code_ok(text: Column) -> Column:
    return F.coalesce(text.rlike(CLAIM_CODE), F.lit(False))


def commands_topic_ok(topic: Column) -> Column:
    return F.coalesce(topic.rlike(COMMANDS_TOPIC), F.lit(False))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return F.length(F.regexp_replace(text, r"[\x{10000}-\x{10FFFF}]", "xx"))
