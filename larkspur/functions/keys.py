"""String and key functions as column expressions."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Root of the deterministic ids below.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "https://larkspur.invalid/catalog")


def card_number_key(number: Column) -> Column:
    """What a printed number is searched by: the part before a slash without leading zeros."""
    return F.ltrim(F.split_part(number, F.lit("/"), F.lit(1)), F.lit("0"))


def uuid5(name: Column, namespace: uuid.UUID = NAMESPACE) -> Column:
    """The version 5 UUID of a name, by SHA-1 in the JVM."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )


def set_key(game: Column, language: Column, set_code: Column) -> Column:
    return F.concat_ws("/", game, language, set_code)


def card_key(game: Column, language: Column, set_code: Column, number: Column, variant: Column) -> Column:
    """A missing variant leaves an empty last part."""
    return F.concat_ws("/", game, language, set_code, number, F.coalesce(variant, F.lit("")))


def slug(text: Column) -> Column:
    """Lower case, runs of other characters as one hyphen, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def reference_label(game: Column, language: Column, set_code: Column, number: Column, variant: Column) -> Column:
    plain = F.concat(set_key(game, language, set_code), F.lit("-"), number)
    return F.when(variant.isNull(), plain).otherwise(F.concat(plain, F.lit(" ("), variant, F.lit(")")))


def variant_slugs(tokens: Sequence[Column]) -> Column:
    """Slugs of descriptor tokens in order, empty ones left out, joined by hyphens; null without any."""
    own = F.filter(F.array(*(slug(F.coalesce(t, F.lit(""))) for t in tokens)), lambda x: x != "")
    return F.when(F.size(own) > 0, F.array_join(own, "-"))


def safe_filename(name: Column, longest: int = 128) -> Column:
    """Base name, white space as hyphens, other unsafe characters dropped; "unnamed" if only dots and hyphens are left."""
    base = F.substring_index(F.replace(name, F.lit("\\"), F.lit("/")), "/", -1)
    kept = F.regexp_replace(F.regexp_replace(base, r"(?U)\s+", "-"), "[^A-Za-z0-9._-]", "")
    kept = F.substring(kept, 1, longest)
    return F.when(F.btrim(kept, F.lit(".-")) == "", "unnamed").otherwise(kept)


def storage_key(namespace: str, at: Column, content: Column) -> Column:
    """namespace/YYYY/MM/DD/id, the id made of the content's digest so that a repeated task writes the same key."""
    return F.concat_ws("/", F.lit(namespace), F.date_format(at, "yyyy/MM/dd"), uuid5(F.sha2(content, 256)))


def bucket_key(prefix: str, host: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(host, 256), 1, 16))


def percent_label(share: Column) -> Column:
    """Whole percent, halves upwards."""
    return F.concat(F.floor(share * 100 + 0.5).cast("string"), F.lit("%"))


def backoff(base: float, attempt: Column, ceiling: float) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(ceiling))


def retry_after(header: Column, longest: int = 60) -> Column:
    """Seconds of a Retry-After header, null unless a number from 0 to `longest`."""
    seconds = header.try_cast("double")
    return F.when(seconds.between(0, longest), seconds)


def page_range(offset: Column, shown: Column) -> tuple[Column, Column]:
    """First and last place of a page, both 0 when it is empty."""
    return F.when(shown > 0, offset + 1).otherwise(0), F.when(shown > 0, offset + shown).otherwise(0)
