"""Queries over stored tables, snapshots and runs, and over texts that rules have to get right."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import keys as K
from larkspur.functions import labels as L
from larkspur.operators import catalog, rules, snapshot, stored, workflow
from larkspur.plans.registry import CATALOG, COLS, KEY, ROWS, _catalog, query
from larkspur.sources import views as V
from larkspur.sources.shared import Shared

# -- stored tables


def _stored_cards(spark: SparkSession, sf_dir: str, rows: DataFrame) -> stored.Stored:
    keyed = rows.withColumn("number_key", K.card_number_key(F.col("card_number")))
    return stored.create(f"{Shared(spark, 'cards').root}/cards", keyed, ["number_key", "id"], 5_000)


@query(
    "q_search_stored_key",
    CATALOG,
    f"""SELECT {COLS}, total FROM (SELECT count(*) AS total FROM {ROWS} WHERE starts_with({KEY}, '4')) LEFT JOIN (SELECT * FROM {ROWS} WHERE starts_with({KEY}, '4')
      ORDER BY set_code, card_number, variant NULLS LAST, id LIMIT 50) ON true""",
)
def _(spark, sf_dir):
    """A page of numbers that start with a key which is stored and clustered by, so that it reaches the scan."""
    found = _stored_cards(spark, sf_dir, _catalog(spark, sf_dir)).starting_with("4").drop("number_key")
    return catalog.search(found, 50)


@query(
    "w_stored_cards",
    "cards_v",
    f"""SELECT id, set_code, card_number, CASE WHEN id % 10 < 5 THEN name || ' v2' ELSE name END AS name, CASE WHEN id % 10 < 5 THEN NULL ELSE rarity END AS rarity,
      variant, CASE WHEN id % 10 < 5 THEN 'later' ELSE 'first' END AS updated_at, {KEY} AS number_key FROM cards_v""",
)
def _(spark, sf_dir):
    """Cards merged into a stored table: name and rarity change, identity doesn't, the time is stamped, the key is stored."""
    cards = V.cards(spark, sf_dir)
    key = K.card_number_key(F.col("card_number"))
    first = cards.where("id % 10 <> 0").withColumns({"updated_at": F.lit("first"), "number_key": key})
    table = stored.create(f"{Shared(spark, 'cards').root}/cards", first, ["id"], 5_000)
    change = cards.where("id % 10 < 5").withColumns({"name": F.concat("name", F.lit(" v2")), "rarity": F.lit(None).cast("string")})
    change = change.withColumn("card_number", F.when(F.col("id") % 10 == 0, F.col("card_number")).otherwise("no/such"))
    return stored.merge(table, change, ["id"], ["name", "rarity"], {"updated_at": F.lit("later")}, {"number_key": key}).rows()


@query(
    "w_stored_sets",
    "sets_v",
    """SELECT game, language, set_code, CASE WHEN language = 'en' THEN name || ' (new)' ELSE name END AS name, CASE WHEN language = 'en' THEN '2024-01-02' END AS release_date FROM sets_v""",
)
def _(spark, sf_dir):
    sets = V.sets(spark, sf_dir).withColumn("release_date", F.lit(None).cast("string"))
    table = stored.create(f"{Shared(spark, 'sets').root}/sets", sets, ["set_code"])
    change = sets.where("language = 'en'").withColumns({"name": F.concat("name", F.lit(" (new)")), "release_date": F.lit("2024-01-02")})
    return stored.merge(table, change, ["game", "language", "set_code"], ["set_code", "name", "release_date"]).rows()


@query(
    "w_stored_retakes",
    "images_v",
    f"""SELECT analysis_id, side, CASE WHEN id % 3 = 0 THEN 'retake/' ELSE 'first/' END || id AS original_uri, CASE WHEN id % 3 = 0 THEN 'image/png' ELSE 'image/jpeg' END AS mime_type,
      CASE WHEN id % 3 = 0 THEN sha256(body || '!') ELSE sha256(body) END AS sha256, CASE WHEN id % 3 = 0 THEN 2 ELSE 1 END AS created_at,
      {', '.join(f"CASE WHEN id % 3 <> 0 THEN '{c}' END AS {c}" for c in stored.DERIVED)} FROM images_v""",
)
def _(spark, sf_dir):
    """Retakes of a third of all pictures: four columns anew, all seven that were derived null."""
    images, digest = V.images(spark, sf_dir), lambda t: F.sha2(t.cast("binary"), 256)
    at = lambda prefix: F.concat(F.lit(prefix), F.col("id").cast("string"))
    first = images.select(
        "analysis_id", "side", at("first/").alias("original_uri"), F.lit("image/jpeg").alias("mime_type"), digest(F.col("body")).alias("sha256"),
        F.lit(1).alias("created_at"), *(F.lit(c).alias(c) for c in stored.DERIVED),
    )
    table = stored.create(f"{Shared(spark, 'pictures').root}/pictures", first, ["analysis_id", "side"], 5_000)
    again = images.where("id % 3 = 0").select(
        "analysis_id", "side", at("retake/").alias("original_uri"), F.lit("image/png").alias("mime_type"),
        digest(F.concat("body", F.lit("!"))).alias("sha256"), F.lit(2).alias("created_at"),
    )
    return stored.retake(table, again).rows()


# -- snapshots

_SET_LINE = """'{"game":"' || game || '","language":"' || language || '","set_code":"' || set_code || '","name":"' || name || '","release_date":null,"metadata":{}}'"""
_CARD_LINE = """'{"set":"' || k || '","card_number":"' || card_number || '","name":"' || name || '","rarity":' || coalesce('"' || rarity || '"', 'null') || ',"variant":' ||
  coalesce('"' || variant || '"', 'null') || ',"metadata":{},"external_ids":[' || coalesce(ids, '') || ']}'"""


def _files_sql(rows: str, per_file: int) -> str:
    return f"""(SELECT f, sha256(string_agg(line, chr(10) ORDER BY r) || chr(10)) AS d FROM (SELECT *, (r - 1) // {per_file} AS f FROM (
      SELECT line, row_number() OVER (ORDER BY key, line) AS r FROM {rows})) GROUP BY 1)"""


@query(
    "src_snapshot",
    CATALOG + " external_ids_v",
    f"""SELECT (SELECT count(*) FROM sets_v) AS set_count, (SELECT count(*) FROM cards_v) AS card_count, (SELECT count(*) FROM external_ids_v) AS external_id_count,
      'sha256:' || sha256((SELECT string_agg(d, '' ORDER BY f) FROM {_files_sql(f"(SELECT game || '/' || language || '/' || set_code AS key, {_SET_LINE} AS line FROM sets_v)", 500)})
        || (SELECT string_agg(d, '' ORDER BY f) FROM {_files_sql(f"(SELECT k || '/' || card_number || '/' || coalesce(variant, '') AS key, {_CARD_LINE} AS line FROM (SELECT c.* REPLACE (c.id || '/050' AS card_number), game || '/' || language || '/' || set_code AS k, ids FROM {ROWS} c LEFT JOIN (SELECT card_id, string_agg(chr(123) || '\"provider\":\"' || provider || '\",\"external_id\":\"' || external_id || '\",\"metadata\":' || chr(123) || '}}' || '}}', ',' ORDER BY provider, external_id) AS ids FROM external_ids_v GROUP BY 1) ON card_id = c.id))", 500)})) AS digest""",
)
def _(spark, sf_dir):
    """A published catalogue's counts and the digest of its files, as read back from the manifest."""
    ids = V.external_ids(spark, sf_dir).groupBy("card_id").agg(F.collect_list(F.struct("provider", "external_id")).alias("external_ids"))
    cards = _catalog(spark, sf_dir).withColumn("card_number", F.concat(F.col("id").cast("string"), F.lit("/050")))  # once a set
    cards = cards.join(ids, F.col("id") == F.col("card_id"), "left")
    path = f"{Shared(spark, 'catalogue').root}/snapshot"
    snapshot.write_snapshot(path, "catalogue-v1.0.0", V.sets(spark, sf_dir), cards, rows_per_file=500)
    told = snapshot.read_snapshot(spark, path)[2]
    return told.select("set_count", "card_count", "external_id_count", F.col("snapshot_digest").alias("digest"))


_RAW = """(SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN '7' WHEN 1 THEN '{"card_number":"1","name":"' || p_name || '"}'
    WHEN 2 THEN '{"set":"tpch/none/' || p_brand || '","card_number":"' || p_partkey || '","name":"x"}' WHEN 3 THEN '{"set":"' || s || '","card_number":' || p_size || ',"name":" ' || p_name || '"}'
    WHEN 4 THEN '{"set":"' || s || '","card_number":"' || p_size % 3 || '","name":"x","variant":null}' WHEN 5 THEN '{"set":"' || s || '","card_number":"' || p_partkey || '","name":"x","metadata":[],"external_ids":[1,' || chr(123) || '"provider":"A b","external_id":""}]}'
    WHEN 6 THEN '{"set"' WHEN 7 THEN '{"set":"' || s || '","card_number":"n' || p_partkey || '","name":"' || p_name || '","rarity":3,"external_ids":"none"}'
    ELSE '{"set":"' || s || '","card_number":"n' || p_partkey || '","name":"' || p_name || '","external_ids":[' || chr(123) || '"provider":"feed","external_id":"' || p_size || '"}]}' END AS line
  FROM (SELECT part.*, 'tpch/' || language || '/' || set_code AS s FROM part JOIN sets_v ON set_code = p_brand))"""


def _raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    rows = V.read(spark, sf_dir, "part").join(V.sets(spark, sf_dir), F.col("p_brand") == F.col("set_code"))
    m = F.col("p_partkey") % 9
    s = F.concat(F.lit('{"set":"tpch/'), "language", F.lit("/"), "set_code", F.lit('",'))
    line = F.when(m == 0, "7").when(m == 1, F.concat(F.lit('{"card_number":"1","name":"'), "p_name", F.lit('"}')))
    line = line.when(m == 2, F.concat(F.lit('{"set":"tpch/none/'), "p_brand", F.lit('","card_number":"'), key, F.lit('","name":"x"}')))
    line = line.when(m == 3, F.concat(s, F.lit('"card_number":'), size, F.lit(',"name":" '), "p_name", F.lit('"}')))
    line = line.when(m == 4, F.concat(s, F.lit('"card_number":"'), (F.col("p_size") % 3).cast("string"), F.lit('","name":"x","variant":null}')))
    line = line.when(m == 5, F.concat(s, F.lit('"card_number":"'), key, F.lit('","name":"x","metadata":[],"external_ids":[1,{"provider":"A b","external_id":""}]}')))
    line = line.when(m == 6, '{"set"').when(m == 7, F.concat(s, F.lit('"card_number":"n'), key, F.lit('","name":"'), "p_name", F.lit('","rarity":3,"external_ids":"none"}')))
    line = line.otherwise(F.concat(s, F.lit('"card_number":"n'), key, F.lit('","name":"'), "p_name", F.lit('","external_ids":[{"provider":"feed","external_id":"'), size, F.lit('"}]}')))
    return rows.select(key.alias("key"), line.alias("value"))


_IDENTIFIER_SQL = "regexp_full_match({0}, '[^\\s](.*[^\\s])?', 's')"


@query(
    "src_record_faults",
    "sets_v",
    f""", r AS (SELECT line, row_number() OVER (ORDER BY CAST(p_partkey AS VARCHAR), line) - 1 AS n FROM {_RAW}),
      j AS (SELECT n // 500 AS f, n % 500 AS p, line, json_valid(line) AS ok, CASE WHEN json_valid(line) THEN CAST(line AS JSON) END AS v FROM r),
      t AS (SELECT *, json_type(v) AS kind, json_type(v, '$.set') AS ts, json_type(v, '$.card_number') AS tn, json_type(v, '$.name') AS tm, json_type(v, '$.rarity') AS tr,
        json_type(v, '$.metadata') AS td, json_type(v, '$.external_ids') AS te, v ->> '$.set' AS st, v ->> '$.card_number' AS num, v ->> '$.name' AS nam, v ->> '$.variant' AS va FROM j),
      e AS (SELECT f, p, i - 1 AS i, json_extract(v, '$.external_ids[' || (i - 1) || ']') AS x FROM t, LATERAL (SELECT unnest(range(1, CAST(json_array_length(v, '$.external_ids') AS BIGINT) + 1)) AS i) WHERE te = 'ARRAY'),
      a AS (SELECT f, p, 'is not JSON' AS fault FROM t WHERE NOT ok
        UNION ALL SELECT f, p, 'must be a JSON object' FROM t WHERE ok AND kind <> 'OBJECT'
        UNION ALL SELECT f, p, 'missing required field ''set''' FROM t WHERE kind = 'OBJECT' AND ts IS NULL
        UNION ALL SELECT f, p, 'card_number must be a string' FROM t WHERE tn <> 'VARCHAR'
        UNION ALL SELECT f, p, 'name must be printed text without white space at its ends' FROM t WHERE tm = 'VARCHAR' AND NOT {_IDENTIFIER_SQL.format('nam')}
        UNION ALL SELECT f, p, 'rarity must be a string' FROM t WHERE tr NOT IN ('VARCHAR', 'NULL')
        UNION ALL SELECT f, p, 'metadata must be an object' FROM t WHERE td NOT IN ('OBJECT', 'NULL')
        UNION ALL SELECT f, p, 'external_ids must be an array' FROM t WHERE te <> 'ARRAY'
        UNION ALL SELECT f, p, 'external_ids[' || i || ']: must be a JSON object' FROM e WHERE json_type(x) <> 'OBJECT'
        UNION ALL SELECT f, p, 'external_ids[' || i || ']: provider must be a lowercase slug' FROM e WHERE json_type(x) = 'OBJECT' AND NOT regexp_full_match(x ->> '$.provider', '[a-z0-9]+(-[a-z0-9]+)*')
        UNION ALL SELECT f, p, 'external_ids[' || i || ']: external_id must be printed text without white space at its ends' FROM e WHERE json_type(x) = 'OBJECT' AND NOT {_IDENTIFIER_SQL.format("(x ->> '$.external_id')")}
        UNION ALL SELECT f, p, 'no set ''' || st || '''' FROM t WHERE ts = 'VARCHAR' AND st NOT IN (SELECT game || '/' || language || '/' || set_code FROM sets_v)
        UNION ALL SELECT f, p, st || ' ' || num || ' (' || coalesce(va, 'no variant') || ') appears twice' FROM (
          SELECT *, row_number() OVER (PARTITION BY st, num, va ORDER BY 'cards/file=' || f, p) AS rn FROM t WHERE ts = 'VARCHAR' AND tn = 'VARCHAR') WHERE rn > 1)
      SELECT 'cards/file=' || f AS file, CAST(p AS INTEGER) AS position, fault FROM a""",
)
def _(spark, sf_dir):
    """Card records of which many are broken in some way: each fault with its file and place."""
    folder = Shared(spark, "faults").root
    snapshot.write_lines(snapshot.set_lines(V.sets(spark, sf_dir)), f"{folder}/sets", 500)
    snapshot.write_lines(_raw_lines(spark, sf_dir), f"{folder}/cards", 500)
    return snapshot.read_records(spark, f"{folder}/sets", f"{folder}/cards")[2]


# -- runs

_SEVERITY = "['good', 'acceptable', 'poor', 'unusable']"


@query(
    "s_run",
    "analyses_v images_v versions_v",
    f"""SELECT a.id, CASE WHEN a.status <> 'uploaded' THEN a.status WHEN coalesce(w, 0) = 3 THEN 'failed' ELSE 'awaiting_confirmation' END AS status,
      a.status = 'uploaded' AS claimed, CASE WHEN a.status = 'uploaded' THEN '1.2.0' END AS application_version,
      CASE WHEN a.status = 'uploaded' THEN (SELECT version FROM versions_v ORDER BY ordinal DESC LIMIT 1) END AS card_database_version,
      CASE WHEN a.status = 'uploaded' THEN {_SEVERITY}[1 + coalesce(w, 0)] END AS verdict, CASE WHEN a.status = 'uploaded' AND w = 3 THEN 1704500000 END AS completed_at
      FROM analyses_v a LEFT JOIN (SELECT analysis_id, max(n_chars % 4) AS w FROM images_v GROUP BY 1) i ON i.analysis_id = a.id""",
)
def _(spark, sf_dir):
    status = F.element_at(F.array(*(F.lit(s) for s in ("good", "acceptable", "poor", "unusable"))), (F.col("n_chars") % 4 + 1).cast("int"))
    images = V.images(spark, sf_dir).select("analysis_id", status.alias("status"))
    return workflow.run(V.analyses(spark, sf_dir), images, V.versions(spark, sf_dir), "1.2.0", F.lit(1704500000))


# -- texts that rules have to get right

#: Odd spellings, dealt to the rows of a table.
ODD = (
    "9", "9.0", "9.50", "9.46", "9.04", "10.04", "10", "10.0", "10.5", "9\n", "09.5", "9.5_or_lower", "9.46_or_lower", "-1", "1e1", "9.",
    "name", " name", "name\t", "\x1cname", "name\x1f", "na\x1cme", "　name", "a ", "", " ", "\t", "\x1d",
    "2024-02-29", "2023-02-29", "0000-01-01", "0001-01-01", "2024-1-1", "en", "\ten", "EN ", " ja", "eng", "a&b c", "50% off=é/+?",
)
_ODD_SQL = "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in ODD) + "]"
_TEN = "TRY_CAST(regexp_replace(k, '_or_(lower|higher)$', '') AS DECIMAL(30, 20))"
_PYTHON_BLANK = r"[\x1c-\x1f\x85\t\n\x0b\f\r\x{a0}\x{3000} ]"
_BROWSER_BLANK = r"[\t\n\x0b\f\r\x{a0}\x{3000}\x{feff} ]"


@query(
    "v_odd_texts",
    "",
    rf"""SELECT p_partkey, k, regexp_full_match(k, '[0-9]+(\.[0-9]+)?(_or_(lower|higher))?') AND {_TEN} BETWEEN 0 AND 10 AND ({_TEN} * 2) % 1 = 0 AS grade_ok,
      CASE WHEN regexp_full_match(k, '[0-9]+(\.[0-9]+)?(_or_(lower|higher))?') AND {_TEN} BETWEEN 0 AND 10 AND ({_TEN} * 2) % 1 = 0
        THEN CASE WHEN {_TEN} % 1 = 0 THEN CAST(CAST({_TEN} AS INTEGER) AS VARCHAR) ELSE CAST(CAST({_TEN} AS DECIMAL(4, 1)) AS VARCHAR) END || regexp_extract(k, '_or_(lower|higher)$') END AS grade,
      k <> '' AND NOT regexp_matches(k, '^{_PYTHON_BLANK}') AND NOT regexp_matches(k, '{_PYTHON_BLANK}$') AS identifier_ok,
      regexp_full_match(k, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND k >= '0001' AND TRY_CAST(k AS DATE) IS NOT NULL AS date_ok,
      NOT regexp_full_match(k, '{_PYTHON_BLANK}*') AS reason_ok,
      CASE WHEN regexp_full_match(lower(t), '[a-z]{{2}}') THEN lower(t) ELSE '' END AS lang,
      CASE WHEN t <> '' THEN 'text=' || replace(url_encode(t), '%20', '+') ELSE '' END AS link
      FROM (SELECT *, regexp_replace(regexp_replace(k, '^{_BROWSER_BLANK}+', ''), '{_BROWSER_BLANK}+$', '') AS t FROM (
        SELECT p_partkey, {_ODD_SQL}[1 + p_partkey % {len(ODD)}] AS k FROM part))""",
)
def _(spark, sf_dir):
    odd = F.from_json(F.lit(json.dumps(ODD)), "array<string>")
    rows = V.read(spark, sf_dir, "part").select("p_partkey", F.get(odd, (F.col("p_partkey") % len(ODD)).cast("int")).alias("k"))
    k = F.col("k")
    return rows.select(
        "p_partkey", "k", rules.is_grade_key(k).alias("grade_ok"), rules.canonical_grade(k).alias("grade"), rules.is_identifier(k).alias("identifier_ok"),
        rules.is_date(k).alias("date_ok"), rules.is_finding(F.lit("undetermined"), F.lit(None).cast("string"), k).alias("reason_ok"),
        L.language_filter(k).alias("lang"), L.link_params(F.lit(0), text=k).alias("link"),
    )


@query(
    "v_whole_pixels",
    "",
    """SELECT p_partkey, abs(63 * m - round_even(63 * m, 0)) <= 1e-9 AND abs(88 * m - round_even(88 * m, 0)) <= 1e-9 AND round_even(63 * m, 0) >= 1 AS whole
      FROM (SELECT p_partkey, p_size / 4.0::DOUBLE + CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 5e-12 ELSE 1e-7 END AS m FROM part)""",
)
def _(spark, sf_dir):
    off = F.when(F.col("p_partkey") % 3 == 0, 0.0).when(F.col("p_partkey") % 3 == 1, 5e-12).otherwise(1e-7)
    m = F.col("p_size") / F.lit(4.0) + off
    return V.read(spark, sf_dir, "part").select("p_partkey", rules.is_whole_pixels(m, 63, 88).alias("whole"))
