"""Time expressions: validation and normalisation of ISO-8601 text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UTC_TEXT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?Z$"
OFFSET_TEXT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})$"


def utc_instant(c: Column) -> Column:
    """The instant of a text ending in Z, or null where it is malformed."""
    return F.when(c.rlike(UTC_TEXT), F.try_to_timestamp(c))


def instant(c: Column) -> Column:
    """The instant of a text with a mandatory offset, or null."""
    return F.when(c.rlike(OFFSET_TEXT), F.try_to_timestamp(c))


def iso_text(t: Column) -> Column:
    """UTC text with microseconds only where there are any."""
    whole = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(t, "SSSSSS")
    return F.concat(whole, F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00"))


def stamp(t: Column) -> Column:
    """Sortable text with six digits and Z, as events carry it."""
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def inverted(valid_from: Column, valid_until: Column) -> Column:
    return valid_from.isNotNull() & valid_until.isNotNull() & (valid_until < valid_from)
