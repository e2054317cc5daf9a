"""Labels and text clean-up."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .clock import clock_text


def remove_first(text: Column, pattern: str) -> Column:
    """Drop the first match of a regular expression."""
    return F.regexp_replace(text, rf"^((?s).*?)(?:{pattern})", "$1")


def joined_label(*parts: Column, sep: str = " - ") -> Column:
    """Parts joined by ``sep``; a null part prints as NA."""
    return F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("NA")) for p in parts])


def peak_label(secs: Column) -> Column:
    return F.format_string("Peak: %s (UTC)", clock_text(secs))


def decimal_comma(value: Column) -> Column:
    return F.replace(value.cast("string"), F.lit("."), F.lit(","))


def log_intensity(n: Column) -> Column:
    """Natural log of a count plus one, the colour scale of the heat maps."""
    return F.log1p(n.cast("double"))
