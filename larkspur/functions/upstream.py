"""Upstream card payloads as rows: set codes, printed numbers, one row for each printing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.keys import card_key, set_key, slug, uuid5

# Flags of a payload and the printings they stand for, in this order; the size that isn't named.
FLAGS = (("normal", "normal"), ("holo", "holo"), ("reverse", "reverse"), ("firstEdition", "1st-edition"), ("wPromo", "w-promo"))
STANDARD_SIZE = "standard"


def _truthy(c: Column) -> Column:
    return F.when(c != "", c)


def set_code(official: Column, upstream_id: Column) -> Column:
    """The printed abbreviation where there is one, else the upstream id."""
    return F.coalesce(_truthy(official), upstream_id)


def card_number(local_id: Column, official: Column) -> Column:
    """`4/102`; without the slash where the official count is missing or 0."""
    return F.when(official > 0, F.concat(local_id, F.lit("/"), official.cast("string"))).otherwise(local_id)


def without_nulls(m: Column) -> Column:
    return F.map_filter(m, lambda _, v: v.isNotNull())


def printing_slug(d: Column) -> Column:
    """Stamps, subtype, foil and type of a descriptor, then its size if it isn't the standard one."""
    size = F.when(d["size"] != STANDARD_SIZE, d["size"])
    parts = F.concat(F.coalesce(d["stamp"], F.array().cast("array<string>")), F.array(d["subtype"], d["foil"], d["type"], size))
    return F.array_join(F.transform(F.filter(parts, lambda p: p.isNotNull() & (p != "")), slug), "-")


def printings(detailed: Column, flags: Column) -> Column:
    """The different slugs in their order; else those of the flags that are set; else one null."""
    own = F.array_distinct(F.filter(F.transform(detailed, printing_slug), lambda s: s != ""))
    set_ = F.array_compact(F.array(*(F.when(flags[name], F.lit(label)) for name, label in FLAGS)))
    none = F.array(F.lit(None).cast("string"))
    return F.when(F.size(own) > 0, own).when(F.size(set_) > 0, set_).otherwise(none)


def card_rows(payloads: DataFrame) -> DataFrame:
    """(external_id, set_code, card_number, name, place, variant, variant_id): a row for each printing of each payload.

    All printings of a card share its external id. variant_id is that of the descriptor at the printing's
    place among the different ones, as the source numbers them, which repeated descriptors move.
    """
    rows = payloads.select(
        F.col("id").alias("external_id"),
        set_code(F.col("abbreviation"), F.col("set_id")).alias("set_code"),
        card_number(F.col("localId"), F.col("official")).alias("card_number"),
        "name",
        F.coalesce("variants_detailed", F.array().cast(payloads.schema["variants_detailed"].dataType)).alias("detailed"),
        "variants",
    )
    rows = rows.select("*", F.posexplode(printings(F.col("detailed"), F.col("variants"))).alias("place", "variant"))
    return rows.withColumn("variant_id", F.get("detailed", F.col("place"))["variantId"]).drop("detailed", "variants")


# What a set's and a card's metadata are called in a payload.
SET_METADATA = (("upstream_id", "id"), ("serie", "serie"), ("card_count", "cardCount"))
CARD_METADATA = (
    ("upstream_id", "id"), ("category", "category"), ("illustrator", "illustrator"), ("dex_id", "dexId"), ("regulation_mark", "regulationMark"),
)


def _metadata(payloads: DataFrame, names: tuple[tuple[str, str], ...]) -> Column:
    """A map of what the payload has; structured values as JSON, absent ones left out."""

    def text(name: str) -> Column:
        kind = payloads.schema[name].dataType.typeName()
        return F.to_json(name) if kind in ("struct", "array", "map") else F.col(name).cast("string")

    there = {c.lower() for c in payloads.columns}
    pairs = [x for label, name in names if name.lower() in there for x in (F.lit(label), text(name))]
    return without_nulls(F.create_map(*pairs))


def set_records(payloads: DataFrame, game: str) -> DataFrame:
    """(id, game, language, set_code, name, release_date, metadata) of sets (id, language, abbreviation, name, releaseDate, serie, cardCount).

    The code is the printed abbreviation where there is one; an empty or absent date is none.
    """
    code = set_code(F.col("abbreviation"), F.col("id"))
    rows = payloads.select(
        F.lit(game).alias("game"), "language", code.alias("set_code"), "name",
        _truthy(F.col("releaseDate")).try_cast("date").alias("release_date"), _metadata(payloads, SET_METADATA).alias("metadata"),
    )
    return rows.select(uuid5(set_key(F.col("game"), F.col("language"), F.col("set_code"))).alias("id"), "*")


def card_records(payloads: DataFrame, game: str, provider: str) -> tuple[DataFrame, DataFrame]:
    """(cards, external ids) of payloads that name their language: whole records, one for each printing.

    Cards are (id, set_id, game, language, set_code, card_number, name, rarity, variant, metadata), external ids (card_id,
    provider, external_id, metadata). All printings of a payload share its external id, whose metadata tell which was meant.
    """
    keep = payloads.withColumn("metadata", _metadata(payloads, CARD_METADATA))
    printed = card_rows(keep).join(
        keep.select(F.col("id").alias("external_id"), "language", "rarity", "metadata"), "external_id"
    ).withColumn("game", F.lit(game))
    names = [F.col(c) for c in ("game", "language", "set_code")]
    own = printed.withColumns({"set_id": uuid5(set_key(*names)), "card_id": uuid5(card_key(*names, F.col("card_number"), F.col("variant")))})
    cards = own.select(
        F.col("card_id").alias("id"), "set_id", "game", "language", "set_code", "card_number", "name", "rarity", "variant", "metadata"
    )
    meant = without_nulls(F.create_map(F.lit("variant_id"), F.col("variant_id")))
    return cards, own.select("card_id", F.lit(provider).alias("provider"), "external_id", meant.alias("metadata"))


def colliding_codes(sets: DataFrame) -> DataFrame:
    """(game, language, set_code, ids) of codes that several upstream sets come to."""
    found = sets.groupBy("game", "language", "set_code").agg(F.array_sort(F.collect_set("upstream_id")).alias("ids"))
    return found.where(F.size("ids") > 1)


def not_found(requested: DataFrame, sets: DataFrame) -> DataFrame:
    """Requested upstream ids that no language has."""
    return requested.distinct().join(sets.select("upstream_id"), "upstream_id", "left_anti")
