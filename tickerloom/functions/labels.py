"""Text expressions: labels, joined lists, run identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Provider field labels and the canonical fields they name.
PROVIDER_FIELDS = {
    "open": "open",
    "high": "high",
    "low": "low",
    "close": "close",
    "adj close": "adjusted_close",
    "volume": "volume",
}
REQUIRED_FIELDS = ("open", "high", "low", "close", "volume")


def plain_label(x: Column) -> Column:
    """Trim, lowercase, underscores to blanks, runs of blanks to one."""
    return F.trim(F.regexp_replace(F.lower(F.translate(x, "_", " ")), r"\s+", " "))


def canonical_field(x: Column) -> Column:
    """The canonical field of a provider label, null when it is no price field."""
    label = plain_label(x)
    chosen = F.lit(None).cast("string")
    for provider, field in PROVIDER_FIELDS.items():
        chosen = F.when(label == provider, field).otherwise(chosen)
    return chosen


def issue_codes(*issues: Column) -> Column:
    """Issue codes joined by '|', or 'eligible' when there is none."""
    joined = F.concat_ws("|", *issues)
    return F.when(joined == "", "eligible").otherwise(joined)


def run_id(instant: Column) -> Column:
    return F.date_format(instant, "yyyyMMdd'T'HHmmssSSSSSS'Z'")


def failure_text(code: Column, detail: Column) -> Column:
    """'Code: detail', or the code alone when the detail is blank."""
    return F.when(F.trim(detail) == "", code).otherwise(F.concat_ws(": ", code, F.trim(detail)))
