"""Column helpers, all built from Catalyst expressions."""

from .numbers import parse_double, round_cents
from .text import (
    claim_code_ok,
    commands_topic_ok,
    device_id_ok,
    has_nul,
    is_blank,
    strip_nul,
    utf16_length,
)
from .times import clock, interval, iso_instant, parse_instant, truncate_millis

__all__ = [
    "claim_code_ok",
    "clock",
    "commands_topic_ok",
    "device_id_ok",
    "has_nul",
    "interval",
    "is_blank",
    "iso_instant",
    "parse_double",
    "parse_instant",
    "round_cents",
    "strip_nul",
    "truncate_millis",
    "utf16_length",
]
