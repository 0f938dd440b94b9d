"""What a client shows and sends: labels, link parameters, checks before an upload."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.keys import percent_label

# Fixed values.
LANGUAGES = {"en": "English", "ja": "Japanese"}
IMAGE_TYPES = ("image/jpeg", "image/png")
MAX_OFFSET = 1_000_000
MAX_UPLOAD = 15 * 1024 * 1024
#: White space and line ends, as a browser trims them.
BLANK = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]+"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{BLANK}|{BLANK}\z", "")


def or_not_recorded(value: Column, what: str) -> Column:
    return F.coalesce(value, F.lit(f"{what} not recorded"))


def language_label(code: Column) -> Column:
    """The language's name; an unknown code stands for itself."""
    names = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, code), code)


def clamped_offset(raw: Column) -> Column:
    """The whole number that a text begins with, from 0 to MAX_OFFSET; 0 if there is none."""
    digits = F.regexp_extract(F.coalesce(raw, F.lit("")), r"^\s*[+]?(\d+)", 1)
    return F.least(F.coalesce(digits.try_cast("double"), F.lit(0.0)), F.lit(float(MAX_OFFSET))).cast("long")


def language_filter(raw: Column) -> Column:
    """A code of two letters in lower case; anything else is no filter."""
    code = F.lower(trimmed(F.coalesce(raw, F.lit(""))))
    return F.when(code.rlike(r"\A[a-z]{2}\z"), code).otherwise("")


def link_params(offset: Column, **filters: Column) -> Column:
    """name=value of the filters that aren't blank, values encoded as forms are, and the offset off the first page, joined by &."""
    pairs = [F.when(trimmed(v) != "", F.concat(F.lit(f"{k}="), F.url_encode(trimmed(v)))) for k, v in filters.items()]
    last = F.when(offset > 0, F.concat(F.lit("offset="), F.least(offset, F.lit(MAX_OFFSET)).cast("string")))
    return F.array_join(F.array_compact(F.array(*pairs, last)), "&")


def has_filters(*filters: Column) -> Column:
    return F.greatest(*(f != "" for f in filters))


def certainty_label(value: Column) -> Column:
    return F.when(value.isNull() | F.isnan(value), "Not measured").otherwise(percent_label(value))


def upload_rejection(kind: Column, size: Column) -> Column:
    """Why a file isn't sent: its type, then too large, then empty; null if it is."""
    known = F.coalesce(kind.isin(*IMAGE_TYPES), F.lit(False))
    return F.when(~known, "not an image").when(size > MAX_UPLOAD, "too large").when(size == 0, "empty")


def release_date_label(released: Column) -> Column:
    """The date as the set prints it."""
    return or_not_recorded(released.cast("string"), "release date")


def metadata_label(value: Column) -> Column:
    """A metadata value (a variant) as text: strings and numbers plainly, structures as JSON, a dash for nothing."""
    kind = F.schema_of_variant(value)
    plain = F.try_variant_get(value, "$", "string")
    shown = F.when(F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY")), F.to_json(value)).otherwise(plain)
    return F.when(value.isNull() | F.is_variant_null(value), "—").otherwise(shown)


def confidence(value: Column) -> Column:
    """A share from 0 to 1; null for anything else, which must not be shown as one."""
    return F.when(value.isNotNull() & ~F.isnan(value) & value.between(0, 1), value)


def certainty(kind: Column, value: Column) -> Column:
    """(state, label): measured if an identification came with a confidence, else unknown - which isn't none."""
    own = confidence(value)
    measured = (kind == "identified") & own.isNotNull()
    return F.struct(
        F.when(measured, "measured").otherwise("unknown").alias("state"), F.when(measured, percent_label(own)).otherwise("Not measured").alias("label")
    )


def read_retry_after(header: Column) -> Column:
    """The whole seconds that a Retry-After header begins with; null for none, less than none, or a date."""
    digits = F.regexp_extract(trimmed(F.coalesce(header, F.lit(""))), r"\A[+]?(\d+)", 1)
    zero = trimmed(F.coalesce(header, F.lit(""))).rlike(r"\A-0+(\D|\z)")
    return F.when(digits != "", digits.try_cast("double")).when(zero, 0.0)
