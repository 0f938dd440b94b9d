"""Catalogue snapshots: ordered files of records, versions published by one rename, and a reader that names every fault.

A snapshot's folder has `records/<stage>/sets` and `cards`, files of JSON lines that are never changed once written, and
`manifests/<ordinal>.json`. A version is there as soon as its manifest is, and not before: a writer that dies leaves files
that nothing names. Readers hold on to the manifest they chose, whatever is published after.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions import keys as K
from larkspur.operators import rules
from larkspur.sources import files
from larkspur.sources.shared import Shared

ROWS_PER_FILE = 100_000
DIGEST = "records_digest"


# -- files of lines


def write_lines(lines: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """(key, value) as text, in order of both: equal rows give equal files, however they were dealt to tasks.

    Rows are sorted by ranges, written once, and numbered by their place in a range and the sizes of those before;
    the number, not the range, decides the file.
    """
    spark = lines.sparkSession
    shared = Shared(spark, "lines")
    ordered = lines.select("key", "value").repartitionByRange("key", "value").sortWithinPartitions("key", "value")
    place = F.monotonically_increasing_id()
    kept = shared.keep(
        ordered.select("value", F.shiftright(place, 33).cast("int").alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "ordered"
    )
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = kept.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    ranked = kept.join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + F.col("at"))
    filed = ranked.withColumn("file", F.floor(F.col("rank") / rows_per_file))
    filed.repartition("file").sortWithinPartitions("file", "rank").select("file", "value").write.partitionBy("file").text(path)
    shared.drop()


def records_digest(spark: SparkSession, path: str) -> str:
    """`sha256:` and the digest of the digests of all files of records, in their order: files are read in parallel."""
    digests = []
    for kind in ("sets", "cards"):
        if not files.exists(spark, f"{path}/{kind}"):
            continue
        found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(f"{path}/{kind}")
        number = F.regexp_extract("path", r"/file=(\d+)/", 1).cast("long")
        digests.append(found.select(F.lit(len(digests)).alias("kind"), number.alias("file"), F.sha2("content", 256).alias("digest")))
    if not digests:
        return "sha256:" + _empty_digest(spark)
    every = digests[0] if len(digests) == 1 else digests[0].unionByName(digests[1])
    listed = F.array_sort(F.collect_list(F.struct("kind", "file", "digest")))  # one entry for ROWS_PER_FILE records
    return "sha256:" + every.agg(F.sha2(F.array_join(F.transform(listed, lambda f: f["digest"]), ""), 256)).first()[0]


def _empty_digest(spark: SparkSession) -> str:
    return spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]


def array_digest(spark: SparkSession, directory: str) -> str:
    """`sha256:` and the digest of the bytes of sets.json and then cards.json, as they lie in an exchanged folder."""
    names = ("sets.json", "cards.json")
    both = spark.read.format("binaryFile").load([f"{directory}/{n}" for n in names])
    order = F.when(F.endswith("path", F.lit(names[0])), 0).otherwise(1)
    content = F.array_sort(F.collect_list(F.struct(order.alias("order"), "content")))  # two files
    row = both.agg(F.sha2(F.concat(F.get(content, F.lit(0))["content"], F.get(content, F.lit(1))["content"]), 256)).first()
    return f"sha256:{row[0]}"


# -- records as lines

_IDS = "array<struct<provider:string,external_id:string,metadata:string>>"


def _with(df: DataFrame, **kinds: str) -> DataFrame:
    """df with the columns that it hasn't got, as nulls."""
    return df.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in df.columns})


def set_lines(sets: DataFrame) -> DataFrame:
    """(key, value): a JSON object for each of (game, language, set_code, name, release_date, metadata)."""
    rows = _with(sets, release_date="string", metadata="string")
    record = F.struct(
        "game", "language", "set_code", "name", F.col("release_date").cast("string").alias("release_date"), _object("metadata").alias("metadata")
    )
    key = K.set_key(F.col("game"), F.col("language"), F.col("set_code"))
    return rows.select(key.alias("key"), F.to_json(record, {"ignoreNullFields": "false"}).alias("value"))


def card_lines(cards: DataFrame) -> DataFrame:
    """(key, value): a JSON object for each card, which names its set and holds its external ids in order."""
    rows = _with(cards, rarity="string", variant="string", metadata="string", external_ids=_IDS)
    kind = rows.schema["external_ids"].dataType.elementType
    has = "metadata" in kind.names
    ids = F.transform(
        F.array_sort(F.coalesce("external_ids", F.array().cast(rows.schema["external_ids"].dataType))),
        lambda e: F.struct(
            e["provider"].alias("provider"), e["external_id"].alias("external_id"),
            F.parse_json(F.coalesce(e["metadata"] if has else F.lit(None).cast("string"), F.lit("{}"))).alias("metadata"),
        ),
    )
    key = K.set_key(F.col("game"), F.col("language"), F.col("set_code"))
    record = F.struct(key.alias("set"), "card_number", "name", "rarity", "variant", _object("metadata").alias("metadata"), ids.alias("external_ids"))
    order = K.card_key(F.col("game"), F.col("language"), F.col("set_code"), F.col("card_number"), F.col("variant"))
    return rows.select(order.alias("key"), F.to_json(record, {"ignoreNullFields": "false"}).alias("value"))


def _object(name: str) -> Column:
    return F.parse_json(F.coalesce(name, F.lit("{}")))


# -- versions


def manifests(spark: SparkSession, path: str) -> list[int]:
    """Ordinals of all published versions, in order."""
    return files.ordinals(spark, path)


def _manifest(spark: SparkSession, path: str, ordinal: int) -> dict:
    return json.loads(files.read_text(spark, files.manifest(path, ordinal)))


def write_snapshot(
    path: str, version: str, sets: DataFrame, cards: DataFrame, *, source: str = "larkspur", generated_at: str = "1970-01-01T00:00:00+00:00",
    source_license: str | None = None, source_revision: str | None = None, metadata: dict | None = None, rows_per_file: int = ROWS_PER_FILE,
) -> dict:
    """Publishes a version and returns its manifest: nine fields, the digest of the records among the metadata.

    Records are staged in a folder of their own; the manifest is written beside the others and gets its number by a
    rename that fails if another has taken it, so each version appears whole and two writers can't take one place. A
    version that is there with the same records stays as it is; with other records it is refused.
    """
    spark = sets.sparkSession
    stage = uuid.uuid4().hex
    folder = f"{path}/records/{stage}"
    write_lines(set_lines(sets), f"{folder}/sets", rows_per_file)
    write_lines(card_lines(cards), f"{folder}/cards", rows_per_file)
    ids = F.coalesce(F.sum(F.greatest(F.lit(0), F.size("external_ids"))), F.lit(0)) if "external_ids" in cards.columns else F.lit(0)
    card_count, id_count = cards.agg(F.count("*"), ids).first()
    digest = records_digest(spark, folder)
    manifest = {
        "version": version, "source": source, "source_license": source_license, "source_revision": source_revision, "generated_at": generated_at,
        "set_count": sets.count(), "card_count": card_count, "external_id_count": id_count, "metadata": {**(metadata or {}), DIGEST: digest},
    }
    temporary = f"{path}/manifests/.{stage}"
    files.write_text(spark, temporary, json.dumps({**manifest, "stage": stage}, ensure_ascii=False, indent=2) + "\n")
    while True:
        there = manifests(spark, path)
        for ordinal in there:
            old = _manifest(spark, path, ordinal)
            if old["version"] == version:
                files.delete(spark, temporary)
                files.delete(spark, folder)
                if old["metadata"].get(DIGEST) != digest:
                    raise ValueError(f"{version} is published with other records; publish a new version")
                return {k: v for k, v in old.items() if k != "stage"}
        if files.rename_new(spark, temporary, files.manifest(path, (there or [0])[-1] + 1)):
            return manifest


MANIFEST = "version string, source string, source_license string, source_revision string, generated_at string, set_count long, card_count long, external_id_count long, snapshot_digest string"


def read_snapshot(spark: SparkSession, path: str, version: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets, cards, manifest) of a version, the newest if none is named; an error if the records aren't its manifest's.

    Digest (where the manifest has one), sets, cards and external ids are held against it, and every record is
    checked: a snapshot with a fault isn't read at all.
    """
    chosen = None
    for ordinal in reversed(manifests(spark, path)):
        found = _manifest(spark, path, ordinal)
        if version is None or found["version"] == version:
            chosen = found
            break
    if chosen is None:
        raise ValueError(f"{path} has no manifest" + (f" of {version}" if version else ""))
    folder = f"{path}/records/{chosen['stage']}"
    told = chosen["metadata"].get(DIGEST)
    if told is not None and told != records_digest(spark, folder):
        raise ValueError("the records aren't those of the manifest")
    sets, cards, faults = read_records(spark, f"{folder}/sets", f"{folder}/cards")
    first = faults.orderBy("file", "position", "fault").first()
    if first is not None:
        raise ValueError(f"{first['file']}[{first['position']}]: {first['fault']}")
    counts = sets.count(), *cards.agg(F.count("*"), F.coalesce(F.sum(F.size("external_ids")), F.lit(0))).first()
    if counts != tuple(chosen[c] for c in ("set_count", "card_count", "external_id_count")):
        raise ValueError("the counts aren't those of the manifest")
    row = [chosen.get(c) for c in ("version", "source", "source_license", "source_revision", "generated_at")]
    row += [*(chosen[c] for c in ("set_count", "card_count", "external_id_count")), told]
    return sets, cards, spark.createDataFrame([tuple(row)], MANIFEST)


# -- strict reading


def entries(spark: SparkSession, path: str) -> DataFrame:
    """(file, position, v): each record of files that hold a JSON array or JSON lines; v is null where it isn't JSON.

    A file of an array is parsed in one task, as arrays must be; files of lines are as large as their writer made them.
    """
    if not files.exists(spark, path):
        raise ValueError(f"{path} isn't there")
    whole = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    name = F.col("_metadata.file_path")
    file = F.when(name.rlike(r"/file=\d+/"), F.regexp_extract(name, r"([^/]+/file=\d+)/[^/]*$", 1)).otherwise(F.col("_metadata.file_name"))
    lines = F.transform(F.filter(F.split("value", "\n"), lambda x: F.btrim(x) != ""), lambda x: F.try_parse_json(x))
    array = F.coalesce(F.from_json("value", "array<variant>"), F.array(F.lit(None).cast("variant")))
    is_array = F.startswith(F.ltrim("value"), F.lit("["))
    return whole.select(file.alias("file"), F.posexplode(F.when(is_array, array).otherwise(lines)).alias("position", "v"))


def _kind(v: Column, field: str) -> Column:
    """Null where there is no such field, VOID where it is null."""
    return F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant"))


def _text(v: Column, field: str) -> Column:
    return F.when(_kind(v, field) == "STRING", F.try_variant_get(v, f"$.{field}", "string"))


def _json(v: Column, field: str) -> Column:
    return F.coalesce(F.to_json(F.when(F.startswith(_kind(v, field), F.lit("OBJECT")), F.try_variant_get(v, f"$.{field}", "variant"))), F.lit("{}"))


def _fault(when: Column, text: str) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.lit(text))


def _required(v: Column, field: str, rule=None, what: str = "") -> list[Column]:
    kind = _kind(v, field)
    out = [_fault(kind.isNull(), f"missing required field '{field}'"), _fault(kind != "STRING", f"{field} must be a string")]
    return [*out, _fault(_text(v, field).isNotNull() & ~rule(_text(v, field)), f"{field} must be {what}")] if rule else out


def _optional_text(v: Column, field: str) -> Column:
    return _fault(~_kind(v, field).isin("STRING", "VOID"), f"{field} must be a string")


def _metadata(v: Column) -> Column:
    kind = _kind(v, "metadata")
    return _fault((kind != "VOID") & ~F.startswith(kind, F.lit("OBJECT")), "metadata must be an object")


def _release_date(v: Column) -> list[Column]:
    kind = _kind(v, "release_date")
    return [
        _fault(~kind.isin("STRING", "VOID"), "release_date must be an ISO date string"),
        _fault(_text(v, "release_date").isNotNull() & ~rules.is_date(_text(v, "release_date")), "release_date is not an ISO date"),
    ]


def _checked(rows: DataFrame, faults: list[Column]) -> DataFrame:
    """rows with the faults of each: one if it isn't an object, else all that are found."""
    v = F.col("v")
    found = F.array_compact(F.array(*faults))
    return rows.withColumn(
        "faults",
        F.when(v.isNull(), F.array(F.lit("is not JSON")))
        .when(~F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.array(F.lit("must be a JSON object")))
        .otherwise(found),
    )


def _twice(rows: DataFrame, *key: str) -> DataFrame:
    """rows with `again`: whether an earlier one has the same key."""
    earliest = rows.groupBy(*(F.col(c).alias(f"_{c}") for c in key)).agg(F.min(F.struct("file", "position")).alias("_first"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key))
    joined = rows.join(earliest, same, "left")
    return joined.select(*rows.columns, (F.struct("file", "position") != F.col("_first")).alias("again"))


IDENTIFIER = "printed text without white space at its ends"


def read_records(spark: SparkSession, sets_path: str, cards_path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets, cards, faults): faults have (file, position, fault), records only those without one.

    Paths name files of a JSON array or of JSON lines. A set's identity and a card's come from what is printed; both
    have version 5 UUIDs. A card names its set by `game/language/set_code`, which must be among the sets, and no set
    and no (set, number, variant) may come twice: the later one is at fault. Missing fields are told from null ones.
    """
    v = F.col("v")
    raw_sets = _checked(entries(spark, sets_path), [
        *_required(v, "game", rules.is_slug, "a lowercase slug"), *_required(v, "language", rules.is_language, "an ISO 639-1 code"),
        *_required(v, "set_code", rules.is_identifier, IDENTIFIER), *_required(v, "name", rules.is_identifier, IDENTIFIER),
        *_release_date(v), _metadata(v),
    ])
    key = K.set_key(_text(v, "game"), _text(v, "language"), _text(v, "set_code"))
    complete = _text(v, "game").isNotNull() & _text(v, "language").isNotNull() & _text(v, "set_code").isNotNull()
    typed = raw_sets.select(
        "file", "position", "faults", F.when(complete, key).alias("set"),
        *(_text(v, c).alias(c) for c in ("game", "language", "set_code", "name", "release_date")), _json(v, "metadata").alias("metadata"),
    )
    sets = _twice(typed, "set")
    repeated = F.col("again") & F.col("set").isNotNull()
    sets = sets.withColumn("faults", F.array_compact(F.array_append("faults", F.when(repeated, F.concat("set", F.lit(" is defined twice"))))))
    shared = Shared(spark, "records")
    sets = shared.keep(sets.drop("again"), "sets")

    external = F.coalesce(F.try_variant_get(v, "$.external_ids", "array<variant>"), F.array().cast("array<variant>"))
    ids_kind = _kind(v, "external_ids")

    def id_faults(e: Column, i: Column) -> Column:
        own = [
            *_required(e, "provider", rules.is_slug, "a lowercase slug"), *_required(e, "external_id", rules.is_identifier, IDENTIFIER), _metadata(e),
        ]
        found = F.when(~F.coalesce(F.startswith(F.schema_of_variant(e), F.lit("OBJECT")), F.lit(False)), F.array(F.lit("must be a JSON object")))
        return F.transform(found.otherwise(F.array_compact(F.array(*own))), lambda f: F.concat(F.lit("external_ids["), i.cast("string"), F.lit("]: "), f))

    raw_cards = _checked(entries(spark, cards_path), [
        *_required(v, "set"), *_required(v, "card_number", rules.is_identifier, IDENTIFIER), *_required(v, "name", rules.is_identifier, IDENTIFIER),
        _optional_text(v, "rarity"), _optional_text(v, "variant"), _metadata(v),
        _fault(~F.startswith(ids_kind, F.lit("ARRAY")), "external_ids must be an array"),
    ])
    is_object = F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))
    ids = F.transform(external, lambda e: F.struct(_text(e, "provider").alias("provider"), _text(e, "external_id").alias("external_id"), _json(e, "metadata").alias("metadata")))
    typed = raw_cards.select(
        "file", "position",
        F.concat("faults", F.when(is_object, F.flatten(F.transform(external, id_faults))).otherwise(F.array().cast("array<string>"))).alias("faults"),
        *(_text(v, c).alias(c) for c in ("set", "card_number", "name", "rarity", "variant")), _json(v, "metadata").alias("metadata"), ids.alias("external_ids"),
    )
    cards = _twice(typed, "set", "card_number", "variant")
    known = sets.where("set is not null").groupBy("set").agg(
        F.first("game").alias("game"), F.first("language").alias("language"), F.first("set_code").alias("set_code")
    )
    cards = cards.join(known, "set", "left")
    unknown = F.when(F.col("set").isNotNull() & F.col("game").isNull(), F.concat(F.lit("no set '"), F.col("set"), F.lit("'")))
    again = F.when(
        F.col("again") & F.col("set").isNotNull() & F.col("card_number").isNotNull(),
        F.concat("set", F.lit(" "), "card_number", F.lit(" ("), F.coalesce("variant", F.lit("no variant")), F.lit(") appears twice")),
    )
    cards = shared.keep(cards.withColumn("faults", F.array_compact(F.concat("faults", F.array(unknown, again)))).drop("again"), "cards")
    faults = sets.select("file", "position", F.explode("faults").alias("fault")).unionByName(
        cards.select("file", "position", F.explode("faults").alias("fault"))
    )
    set_id = lambda g: K.uuid5(K.set_key(*(F.col(c) for c in g)))
    names = ("game", "language", "set_code")
    good_sets = sets.where(F.size("faults") == 0).select(set_id(names).alias("id"), *names, "name", "release_date", "metadata")
    good_cards = cards.where(F.size("faults") == 0).select(
        K.uuid5(K.card_key(*(F.col(c) for c in names), F.col("card_number"), F.col("variant"))).alias("id"), set_id(names).alias("set_id"),
        *names, "card_number", "name", "rarity", "variant", "metadata", "external_ids",
    )
    return good_sets, good_cards, faults


def manifest_faults(texts: DataFrame) -> DataFrame:
    """(file, fault) of (file, text): what a manifest's nine fields lack to be those of a version."""
    v = F.col("v")
    rows = texts.select("file", F.lit(0).alias("position"), F.try_parse_json("text").alias("v"))
    stamp = _text(v, "generated_at")
    counts = [
        x
        for c in ("set_count", "card_count", "external_id_count")
        for x in (
            _fault(_kind(v, c).isNull(), f"missing required field '{c}'"),
            _fault((_kind(v, c) != "BIGINT") | (F.try_variant_get(v, f"$.{c}", "long") < 0), f"{c} must be a whole number that isn't negative"),
        )
    ]
    checked = _checked(rows, [
        *_required(v, "version", rules.is_version, "a version such as name-v1.0.0"), *_required(v, "source", rules.is_identifier, IDENTIFIER),
        *_required(v, "generated_at"), _fault(stamp.isNotNull() & stamp.try_cast("timestamp").isNull(), "generated_at is not an ISO timestamp"),
        _fault(stamp.try_cast("timestamp").isNotNull() & ~stamp.rlike(r"(Z|[+-]\d{2}:?\d{2})\z"), "generated_at needs an offset"),
        *counts, _optional_text(v, "source_license"), _optional_text(v, "source_revision"), _metadata(v),
    ])
    return checked.select("file", F.explode("faults").alias("fault"))


def card_external_ids(cards: DataFrame) -> DataFrame:
    """(card_id, provider, external_id): a row for each id that cards carry."""
    return cards.select(F.col("id").alias("card_id"), F.explode("external_ids").alias("e")).select("card_id", "e.provider", "e.external_id")


def append_only_violations(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, violation): rows of old that are missing from new, or other than they were."""
    o, n = old.alias("o"), new.withColumn("_there", F.lit(True)).alias("n")
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in old.columns if c != key]
    kept = F.array_min(F.array(*same)) if same else F.lit(True)
    what = F.when(F.col("n._there").isNull(), "removed").when(~kept, "changed")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "left")
    return joined.select(F.col(f"o.{key}").alias(key), what.alias("violation")).where("violation is not null")
