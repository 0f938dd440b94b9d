"""Catalog reads and keyed merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.keys import card_number_key

#: Sets that may be broadcast in the card join.
SETS_ROWS = 200_000
MAX_LIMIT, DEFAULT_LIMIT, MAX_OFFSET = 100, 20, 1_000_000


def with_sets(cards: DataFrame, sets: DataFrame) -> DataFrame:
    """Cards with their set's columns; the sets are broadcast if there are few, else shuffled."""
    named = sets.select("set_code", "game", "language", F.col("name").alias("set_name"))
    small = named.limit(SETS_ROWS + 1).count() <= SETS_ROWS
    return cards.join(F.broadcast(named) if small else named, "set_code")


def conditions(
    name: str | None = None,
    number: str | None = None,
    game: str | None = None,
    language: str | None = None,
    set_code: str | None = None,
    variant: str | None = None,
) -> Column:
    """All filters that are given: literal case-blind part of the name, prefix of the number's key, equality.

    A number whose key is empty, such as all zeros, matches nothing.
    """
    found: list[Column] = []
    if name is not None:
        found.append(F.contains(F.lower("name"), F.lit(name.lower())))
    if number is not None:
        key = number.split("/", 1)[0].lstrip("0")
        found.append(F.startswith(card_number_key(F.col("card_number")), F.lit(key)) if key else F.lit(False))
    for column, value in (("game", game), ("language", language), ("set_code", set_code), ("variant", variant)):
        if value is not None:
            found.append(F.col(column) == value)
    return reduce(lambda a, b: a & b, found, F.lit(True))


def total_order() -> tuple[Column, ...]:
    return F.col("set_code").asc(), F.col("card_number").asc(), F.col("variant").asc_nulls_last(), F.col("id").asc()


def search(rows: DataFrame, limit: int = DEFAULT_LIMIT, offset: int = 0, **filters: str | None) -> DataFrame:
    """A page in total order, each row with the number of all matches; past the end one row of nulls beside it.

    The count is one aggregated row beside a top-k, not a window over a single partition. Bounds are
    checked before anything is planned.
    """
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be from 1 to {MAX_LIMIT}")
    if not 0 <= offset <= MAX_OFFSET:
        raise ValueError(f"offset must be from 0 to {MAX_OFFSET}")
    matches = rows.where(conditions(**filters))
    total = matches.agg(F.count("*").alias("total"))  # one row
    page = matches.orderBy(*total_order()).offset(offset).limit(limit)  # MAX_LIMIT rows at most
    beside = total.join(F.broadcast(page), F.lit(True), "left")
    return beside.select(*rows.columns, "total").orderBy(*total_order())


def detail(cards: DataFrame, external_ids: DataFrame) -> DataFrame:
    """Each card with its external ids in order, an empty array without any."""
    own = external_ids.groupBy("card_id").agg(
        F.array_sort(F.collect_list(F.struct("provider", "external_id"))).alias("external_ids")
    )
    empty = F.array().cast("array<struct<provider:string,external_id:string>>")
    return cards.join(own, cards["id"] == own["card_id"], "left").select(
        *cards.columns, F.coalesce("external_ids", empty).alias("external_ids")
    )


def with_set_details(cards: DataFrame, sets: DataFrame) -> DataFrame:
    """Cards with all of their set, under names that don't clash with their own: set_id, set_name, release_date, set_metadata.

    cards have set_id, sets (id, game, language, set_code, name, release_date, metadata). One shuffle or a checked broadcast.
    """
    named = sets.select(
        F.col("id").alias("set_id"), "game", "language", "set_code", F.col("name").alias("set_name"), "release_date", F.col("metadata").alias("set_metadata")
    )
    small = named.limit(SETS_ROWS + 1).count() <= SETS_ROWS
    own = cards.drop("game", "language", "set_code")
    return own.join(F.broadcast(named) if small else named, "set_id")


def card_detail(cards: DataFrame, sets: DataFrame, external_ids: DataFrame) -> DataFrame:
    """Each card with its set and its external ids in order; an empty array without any.

    External ids are dealt by card once: repeated ones go in the grouping that lists them.
    """
    own = external_ids.groupBy("card_id").agg(F.array_sort(F.collect_set(F.struct("provider", "external_id"))).alias("external_ids"))
    empty = F.array().cast("array<struct<provider:string,external_id:string>>")
    whole = with_set_details(cards, sets)
    return whole.join(own, whole["id"] == own["card_id"], "left").select(*whole.columns, F.coalesce("external_ids", empty).alias("external_ids"))


def merge(target: DataFrame, source: DataFrame, keys: list[str], updates: list[str]) -> DataFrame:
    """Rows of both by key; where both have one, only `updates` are taken from the source, nulls included."""
    t, s = target.withColumn("_t", F.lit(True)).alias("t"), source.withColumn("_s", F.lit(True)).alias("s")
    on = reduce(lambda a, b: a & b, [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys])
    new, old = F.col("_s").isNotNull(), F.col("_t").isNotNull()
    pick = {
        c: F.when(new & (~old | F.lit(c in updates)), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c)
        for c in target.columns
    }
    action = F.when(new & old, "updated").when(new, "inserted").otherwise("kept").alias("action")
    return t.join(s, on, "full_outer").select(*pick.values(), action)


def insert_absent(target: DataFrame, source: DataFrame, key: str, ordinal: str) -> DataFrame:
    """target and the source rows of new keys, numbered on from its largest ordinal."""
    new = source.join(target.select(key), key, "left_anti")
    top = target.agg(F.coalesce(F.max(ordinal), F.lit(0)).alias("_top"))
    numbered = new.crossJoin(F.broadcast(top)).withColumn(
        ordinal, F.col("_top") + F.row_number().over(Window.orderBy(key))
    )  # new versions of a catalogue: a handful of rows
    return target.unionByName(numbered.select(*target.columns))


def write_once_violations(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """For each key, the columns that had a value and would get another one (or none)."""
    o, n = old.alias("o"), new.alias("n")
    broken = F.array_compact(
        F.array(
            *(
                F.when(F.col(f"o.{c}").isNotNull() & ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), F.lit(c))
                for c in columns
            )
        )
    )
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}")).select(F.col(f"o.{key}").alias(key), broken.alias("violations"))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; nulls count as equal."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
