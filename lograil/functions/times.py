"""The four readings of a time value, and relative ranges. `now_ms` is a parameter, so a replay agrees."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = r"(?i)(Z|[+-]\d{2}:?\d{2})$"


def _scaled(number: Column) -> Column:
    return F.when(number > 1e12, number).otherwise(number * 1000).cast("long")


def iso_ms(text: Column) -> Column:
    """Epoch milliseconds of ISO text, without a zone as UTC; null if it is none."""
    zoned = F.when(text.rlike(ZONE), text).otherwise(F.concat(text, F.lit("Z")))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.unix_millis(F.try_to_timestamp(zoned)))


def log_time(text: Column, is_number: Column, now_ms: Column) -> Column:
    """A: numbers above 1e12 are ms, others seconds; number texts as they are; ISO text; null is now; else null (invalid)."""
    digits = text.rlike(r"^\d+$")
    return F.when(text.isNull(), now_ms).when(is_number, _scaled(text.try_cast("double"))).when(digits, text.try_cast("long")).otherwise(iso_ms(text))


def epoch_millis(text: Column, is_number: Column, now_ms: Column) -> Column:
    """B: numbers up to 1e12 are seconds; ISO text; anything else is now."""
    return F.coalesce(F.when(is_number, _scaled(text.try_cast("double"))).otherwise(iso_ms(text)), now_ms)


def strict_time(text: Column) -> Column:
    """C: digits are ms; ISO text must carry a zone; else null."""
    return F.when(text.rlike(r"^\d+$"), text.try_cast("long")).when(text.rlike(ZONE), iso_ms(text))


def nullable_time(text: Column) -> Column:
    """D: null, '' and 0 are null; digits scaled at 1e12; ISO text; else null."""
    digits = text.rlike(r"^\d+(\.\d+)?$")
    return F.when(text.isNull() | text.isin("", "0"), F.lit(None).cast("long")).when(digits, _scaled(text.try_cast("double"))).otherwise(iso_ms(text))


def relative_range(text: str, now_ms: int) -> tuple[int, int]:
    """'15m', '1h', '24h', '7d' to (from, to) in ms; 'all' and unknown ones start at 0."""
    found = re.fullmatch(r"(\d+)([mhd])", text or "")
    step = {"m": 60_000, "h": 3_600_000, "d": 86_400_000}
    return (now_ms - int(found[1]) * step[found[2]] if found else 0), now_ms
