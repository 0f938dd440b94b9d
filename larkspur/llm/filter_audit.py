"""Filter interaction audit: a histogram of failure masks by part, and every order of the filters told from its cells."""

from __future__ import annotations

import itertools
import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import table

#: Rows without an id are spread over so many keys of the join with the labels, which they can't meet.
NULL_SALTS = 4096

BLANKS = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions by letter: few words, repeated words, capitals, symbols."""
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    capitals = F.char_length(text) - F.char_length(F.translate(text, CAPITALS, ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * capitals > 5 * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def failure_cells(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], copies: str, part: str) -> DataFrame:
    """(part, mask, n, good, toxic): how many documents fail which filters, at most 2 ** len(filters) masks a part.

    `filters` are conditions on the columns of docs, `copies` names a further one that a text fails if a
    smaller doc_id of the table has the same. Bit i of the mask is that of the i-th name in order.

    Texts are read once and leave their scan as a mask and a digest. Rows are counted before each of three
    shuffles, so of a text with any number of copies a task hands on one row for each part, mask and label.
    Smallest ids need no join of copies with their originals: who carries the smallest is taken off the count.
    """
    names = sorted([*filters, copies])
    bits = {name: 1 << i for i, name in enumerate(names)}
    mask = sum((F.when(F.coalesce(fails, F.lit(False)), bits[n]).otherwise(0) for n, fails in filters.items()), F.lit(0))
    rows = docs.select(
        "doc_id",
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        mask.alias("mask"),
        F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"),
    )
    counted = rows.groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("label_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest", "part"), F.lit(NULL_SALTS))).otherwise(F.lit(0))
    labelled = counted.withColumn("salt", salt).join(
        told.withColumn("label_salt", F.lit(0).cast("long")),
        (F.col("doc_id") == F.col("label_id")) & (F.col("salt") == F.col("label_salt")),
        "left",
    )
    labelled = labelled.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    known = F.col("doc_id").isNotNull()
    texts = labelled.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("unknown"),
        F.min(F.when(known, F.struct("doc_id", "n"))).alias("first"),
    )
    # By now a text has a row for each part, mask and label; its smallest id is that of one of them.
    least = texts.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    joined = texts.join(least, "digest")
    original = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0) + F.col("unknown")
    split = F.array(
        F.struct(F.col("mask").alias("mask"), original.alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(bits[copies])).alias("mask"), (F.col("n") - original).alias("n")),
    )
    cells = joined.select("part", "good", "toxic", F.inline(split))
    return cells.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )


def every_order(cells: DataFrame, names: list[str]) -> DataFrame:
    """A row for each part, order of the filters and step, told from the part's cells alone.

    A part's cells are one array of at most 2 ** len(names) entries, so the orders multiply parts, not documents.
    """
    bits = {name: 1 << i for i, name in enumerate(sorted(names))}
    steps = [
        {"filter_order": "".join(order), "step": k + 1, "bit": bits[name], "before": sum(bits[b] for b in order[:k])}
        for order in itertools.permutations(sorted(names))
        for k, name in enumerate(order)
    ]
    kind = "array<struct<filter_order:string,step:int,bit:int,before:int>>"
    arrays = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    rows = arrays.select("part", "cells", F.inline(F.from_json(F.lit(json.dumps(steps)), kind)))
    bit, before = F.col("bit"), F.col("before")

    def total(condition, value) -> Column:
        return F.aggregate(F.filter("cells", condition), F.lit(0).cast("long"), lambda acc, c: acc + value(c))

    def fails(c: Column, which: Column) -> Column:
        return c["mask"].bitwiseAND(which) != 0

    def here(c: Column) -> Column:
        return fails(c, bit) & ~fails(c, before)

    n = lambda c: c["n"]
    #: Of the orders, each failing filter of a mask is the first to meet it in an equal share.
    share = lambda c: c["n"] * (F.lit(math.factorial(len(bits))) / F.bit_count(c["mask"])).cast("long")
    return rows.select(
        "part",
        "filter_order",
        "step",
        total(lambda c: ~fails(c, before.bitwiseOR(bit)), n).alias("kept"),
        total(here, n).alias("removed"),
        total(lambda c: fails(c, bit) & fails(c, before), n).alias("redundant"),
        total(lambda c: c["mask"] == bit, n).alias("unique_fails"),
        total(here, lambda c: c["good"]).alias("good_lost"),
        total(here, lambda c: c["toxic"]).alias("toxic_lost"),
        total(lambda c: fails(c, bit), share).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], copies: str = "E", part: str = "source") -> DataFrame:
    """What each filter removes, at each step of each order of all of them, by part.

    Returns (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).
    A null text is empty, a null part the empty string and the same as an empty one. Rows with equal ids
    each count; of those with the smallest id of a text none is a copy. A row without an id is no copy and
    makes none, as no id is smaller. An id labelled twice is good or toxic if one of its labels says so.
    A condition that is null doesn't fail. Further columns are ignored; no documents give no rows.
    """
    return every_order(failure_cells(docs, labels, filters, copies, part), [*filters, copies])


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five filters over `documents`, copies among them, with `labels` telling what is lost."""
    docs = table(spark, sf_dir, "documents")
    return filter_audit(docs, table(spark, sf_dir, "labels"), text_filters(F.coalesce("text", F.lit(""))))


#: Row by row: every document goes through every order, and what meets it first is looked up.
ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
  l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
  d AS (SELECT row_number() OVER () AS r, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(words) < 50 THEN 'A' ELSE '' END ||
    CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END ||
    CASE WHEN 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * len(text) THEN 'C' ELSE '' END ||
    CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END ||
    CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
    FROM t LEFT JOIN l ON l.doc_id = t.doc_id),
  x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
  o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM x a, x b, x c, x d, x e
    WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
  s AS (SELECT filter_order, step, filter_order[step] AS f FROM o, (SELECT unnest(range(1, 6)) AS step)),
  m AS (SELECT part, filter_order, list_min([instr(filter_order, f) FOR f IN ['A', 'B', 'C', 'D', 'E'] IF contains(fails, f)]) AS met,
    fails, good, toxic FROM d, o),
  g AS (SELECT m.part, s.filter_order, s.step, s.f,
    count(*) FILTER (met IS NULL OR met > step) AS kept, count(*) FILTER (met = step) AS removed,
    count(*) FILTER (contains(fails, f) AND met < step) AS redundant, count(*) FILTER (fails = f) AS unique_fails,
    count(*) FILTER (met = step AND good) AS good_lost, count(*) FILTER (met = step AND toxic) AS toxic_lost
    FROM m JOIN s ON s.filter_order = m.filter_order GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM g
"""
