"""Further queries: upstream payloads, client labels, records of the quality gate, writes, detection and image bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import keys as K
from larkspur.functions import labels as L
from larkspur.functions import upstream as U
from larkspur.operators import catalog, detection, image_bytes, quality, rules, snapshot, workflow
from larkspur.plans.registry import _uuid_sql, query
from larkspur.sources import views as V

SLUG = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-')"


# -- upstream payloads

_DESCRIPTOR = "struct<stamp:array<string>,subtype:string,foil:string,type:string,size:string,variantId:string>"


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, word = F.col("p_partkey"), F.split("p_name", " ")
    none = F.lit(None).cast("string")

    def descriptor(stamp, subtype, size, n):
        return F.struct(
            stamp.alias("stamp"), subtype.alias("subtype"), none.alias("foil"), F.col("p_type").alias("type"), size.alias("size"),
            F.concat(F.lit("v"), F.lit(n), F.lit("-"), key.cast("string")).alias("variantId"),
        ).cast(_DESCRIPTOR)

    one = descriptor(F.array(word[0], F.lit("--")), none, F.lit("standard"), "1")
    two = descriptor(F.lit(None).cast("array<string>"), word[1], F.lit("Jumbo"), "2")
    again = descriptor(F.array(word[0], F.lit("--")), none, F.lit(""), "3")
    detailed = F.when(key % 3 == 1, F.array(one, two)).when(key % 3 == 2, F.array(one, again, two))
    flags = F.struct(
        (key % 2 == 0).alias("normal"), (key % 5 == 0).alias("holo"), F.lit(False).alias("reverse"), (key % 7 == 0).alias("firstEdition"),
        F.lit(None).cast("boolean").alias("wPromo"),
    )
    return V.read(spark, sf_dir, "part").select(
        F.concat(F.lit("u-"), key.cast("string")).alias("id"),
        F.when(key % 4 == 0, "").when(key % 4 == 1, F.lit("ABC")).alias("abbreviation"),
        F.lower("p_brand").alias("set_id"),
        F.lpad(F.col("p_size").cast("string"), 3, "0").alias("localId"),
        F.when(key % 3 == 0, 0).when(key % 3 == 1, 102).alias("official"),
        F.col("p_name").alias("name"),
        detailed.alias("variants_detailed"),
        flags.alias("variants"),
    )


_ONE = f"{SLUG.format('split_part(p_name, chr(32), 1)')} || '--' || {SLUG.format('p_type')}"
_TWO = f"{SLUG.format('split_part(p_name, chr(32), 2)')} || '-' || {SLUG.format('p_type')} || '-jumbo'"
_FLAGS = """list_filter([CASE WHEN p_partkey % 2 = 0 THEN 'normal' END, CASE WHEN p_partkey % 5 = 0 THEN 'holo' END,
  CASE WHEN p_partkey % 7 = 0 THEN '1st-edition' END], lambda x: x IS NOT NULL)"""


@query(
    "f_printings",
    "",
    f"""SELECT external_id, set_code, card_number, name, CAST(place - 1 AS INT) AS place, slugs[place] AS variant,
      CASE WHEN k = 0 THEN NULL WHEN k = 2 AND place = 2 THEN 'v3-' || p_partkey ELSE 'v' || place || '-' || p_partkey END AS variant_id
      FROM (SELECT p_partkey, 'u-' || p_partkey AS external_id, CASE WHEN p_partkey % 4 = 1 THEN 'ABC' ELSE lower(p_brand) END AS set_code,
        lpad(CAST(p_size AS VARCHAR), 3, '0') || CASE WHEN p_partkey % 3 = 1 THEN '/102' ELSE '' END AS card_number, p_name AS name, p_partkey % 3 AS k,
        CASE WHEN p_partkey % 3 <> 0 THEN [{_ONE}, {_TWO}] WHEN len({_FLAGS}) > 0 THEN {_FLAGS} ELSE [NULL] END AS slugs FROM part),
      LATERAL (SELECT unnest(range(1, len(slugs) + 1)) AS place)""",
)
def _(spark, sf_dir):
    return U.card_rows(_payloads(spark, sf_dir))


@query(
    "v_colliding_codes",
    "",
    """SELECT game, language, set_code, string_agg(DISTINCT upstream_id, ',' ORDER BY upstream_id) AS ids FROM (SELECT 'tpch' AS game, 'en' AS language,
      lower(p_brand) AS set_code, CASE WHEN p_size > 45 THEN p_brand || '/' || p_type ELSE p_brand END AS upstream_id FROM part)
      GROUP BY ALL HAVING count(DISTINCT upstream_id) > 1""",
)
def _(spark, sf_dir):
    own = F.when(F.col("p_size") > 45, F.concat("p_brand", F.lit("/"), "p_type")).otherwise(F.col("p_brand"))
    sets = V.read(spark, sf_dir, "part").select(
        F.lit("tpch").alias("game"), F.lit("en").alias("language"), F.lower("p_brand").alias("set_code"), own.alias("upstream_id")
    )
    return U.colliding_codes(sets).withColumn("ids", F.array_join("ids", ","))


@query("v_sets_not_found", "sets_v", "SELECT x AS upstream_id FROM (VALUES ('Brand#1'), ('none'), ('brand#2')) t(x) WHERE x NOT IN (SELECT set_code FROM sets_v)")
def _(spark, sf_dir):
    requested = spark.createDataFrame([("Brand#1",), ("none",), ("brand#2",)], "upstream_id string")
    return U.not_found(requested, V.sets(spark, sf_dir).select(F.col("set_code").alias("upstream_id")))


@query("f_version_ids", "versions_v", f"SELECT version, {_uuid_sql('version')} AS id FROM versions_v")
def _(spark, sf_dir):
    return V.versions(spark, sf_dir).select("version", K.uuid5(F.col("version")).alias("id"))


@query(
    "f_metadata",
    "cards_v",
    "SELECT id, concat_ws(';', 'name=' || name, 'rarity=' || rarity, 'variant=' || variant) AS metadata FROM cards_v",
)
def _(spark, sf_dir):
    names = ("name", "rarity", "variant")
    m = U.without_nulls(F.create_map(*(x for n in names for x in (F.lit(n), F.col(n)))))
    pairs = F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return V.cards(spark, sf_dir).select("id", F.array_join(pairs, ";").alias("metadata"))


# -- names, labels, links

_NAMES = """CASE p_partkey % 6 WHEN 0 THEN 'C:\\photos\\' || p_name || '.jpg' WHEN 1 THEN '.' || p_name WHEN 2 THEN '/tmp/../' || p_name || '!*'
  WHEN 3 THEN '..-.' WHEN 4 THEN p_name || chr(9) || ' é(1).png' ELSE '' END"""


@query(
    "f_filenames",
    "",
    f"""SELECT p_partkey, CASE WHEN trim(kept, '.-') = '' THEN 'unnamed' ELSE kept END AS filename FROM (SELECT p_partkey,
      substr(regexp_replace(regexp_replace(regexp_extract({_NAMES}, '[^/\\\\]*$'), '\\s+', '-', 'g'), '[^A-Za-z0-9._-]', '', 'g'), 1, 128) AS kept FROM part)""",
)
def _(spark, sf_dir):
    k, n = F.col("p_partkey") % 6, F.col("p_name")
    name = F.when(k == 0, F.concat(F.lit("C:\\photos\\"), n, F.lit(".jpg"))).when(k == 1, F.concat(F.lit("."), n))
    name = name.when(k == 2, F.concat(F.lit("/tmp/../"), n, F.lit("!*"))).when(k == 3, "..-.")
    name = name.when(k == 4, F.concat(n, F.lit("\t é(1).png"))).otherwise("")
    return V.read(spark, sf_dir, "part").select("p_partkey", K.safe_filename(name).alias("filename"))


@query(
    "v_storage_keys",
    "",
    """SELECT p_partkey, k, length(k) <= 1024 AND regexp_full_match(k, '[A-Za-z0-9][A-Za-z0-9._-]*(/[A-Za-z0-9][A-Za-z0-9._-]*)*') AS ok FROM (SELECT p_partkey,
      CASE p_partkey % 7 WHEN 0 THEN 'uploads/' || p_size WHEN 1 THEN 'A.b_c' WHEN 2 THEN 'a//b' WHEN 3 THEN 'a/../b' WHEN 4 THEN p_name
      WHEN 5 THEN 'a/b' || chr(10) ELSE repeat('a', 1000 + p_size) END AS k FROM part)""",
)
def _(spark, sf_dir):
    m, size = F.col("p_partkey") % 7, F.col("p_size")
    k = F.when(m == 0, F.concat(F.lit("uploads/"), size.cast("string"))).when(m == 1, "A.b_c").when(m == 2, "a//b").when(m == 3, "a/../b")
    k = k.when(m == 4, F.col("p_name")).when(m == 5, "a/b\n").otherwise(F.repeat(F.lit("a"), 1000 + size))
    rows = V.read(spark, sf_dir, "part").select("p_partkey", k.alias("k"))
    return rows.withColumn("ok", rules.is_storage_key(F.col("k")))


@query(
    "f_storage_paths",
    "",
    f"""SELECT event_id, 'uploads/' || strftime(ts, '%Y/%m/%d') || '/' || {_uuid_sql('sha256(props)')} AS path, 'limit:' || substr(sha256(CAST(user_id AS VARCHAR)), 1, 16) AS bucket FROM events""",
)
def _(spark, sf_dir):
    path = K.storage_key("uploads", F.col("ts"), F.col("props").cast("binary"))
    return V.read(spark, sf_dir, "events").select(
        "event_id", path.alias("path"), K.bucket_key("limit:", F.col("user_id").cast("string")).alias("bucket")
    )


@query(
    "f_client_labels",
    "cards_v sets_v",
    """SELECT id, coalesce(variant, 'variant not recorded') AS variant, coalesce(rarity, 'rarity not recorded') AS rarity,
      CASE language WHEN 'en' THEN 'English' WHEN 'ja' THEN 'Japanese' ELSE language END AS language FROM (SELECT c.*, CASE WHEN c.id % 5 = 0 THEN 'fr' ELSE s.language END AS language
      FROM cards_v c JOIN sets_v s USING (set_code))""",
)
def _(spark, sf_dir):
    rows = catalog.with_sets(V.cards(spark, sf_dir), V.sets(spark, sf_dir))
    code = F.when(F.col("id") % 5 == 0, "fr").otherwise(F.col("language"))
    return rows.select(
        "id",
        L.or_not_recorded(F.col("variant"), "variant").alias("variant"),
        L.or_not_recorded(F.col("rarity"), "rarity").alias("rarity"),
        L.language_label(code).alias("language"),
    )


@query(
    "f_search_links",
    "",
    """SELECT p_partkey, o AS offset_, lang, concat_ws('&', CASE WHEN trim(t) <> '' THEN 'text=' || replace(url_encode(trim(t)), '%20', '+') END, CASE WHEN lang <> '' THEN 'language=' || lang END,
      CASE WHEN o > 0 THEN 'offset=' || o END) AS link, t <> '' OR lang <> '' AS filtered FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN ' ' || p_name || ' ' ELSE '' END AS t,
      CASE p_partkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'ja' ELSE '' END AS lang,
      CAST(CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN least(p_partkey, 1000000) WHEN 2 THEN 1000000 ELSE 0 END AS BIGINT) AS o FROM part)""",
)
def _(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    raw = F.when(size % 4 == 0, F.lit("-5")).when(size % 4 == 1, F.concat(key.cast("string"), F.lit("abc"))).when(size % 4 == 2, "99999999999999999999")
    text = F.when(size % 2 == 0, F.concat(F.lit(" "), "p_name", F.lit(" "))).otherwise("")
    code = F.when(key % 4 == 0, " EN").when(key % 4 == 1, "ja").when(key % 4 == 2, "english")
    rows = V.read(spark, sf_dir, "part").select(
        "p_partkey", L.clamped_offset(raw).alias("offset_"), L.language_filter(code).alias("lang"), text.alias("t")
    )
    return rows.select(
        "p_partkey", "offset_", "lang",
        L.link_params(F.col("offset_"), text=F.col("t"), language=F.col("lang")).alias("link"),
        L.has_filters(F.col("t"), F.col("lang")).alias("filtered"),
    )


@query(
    "f_page_ranges",
    "",
    "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_partkey + 1 ELSE 0 END AS first, CASE WHEN p_size > 25 THEN p_partkey + p_size - 25 ELSE 0 END AS last FROM part",
)
def _(spark, sf_dir):
    first, last = K.page_range(F.col("p_partkey"), F.col("p_size") - 25)
    return V.read(spark, sf_dir, "part").select("p_partkey", first.alias("first"), last.alias("last"))


@query(
    "f_uploads",
    "images_v",
    """SELECT id, CASE WHEN id % 4 = 0 THEN 'not an image' WHEN id % 4 = 1 THEN 'too large' WHEN id % 4 = 2 THEN 'empty' END AS rejection,
      CASE WHEN id % 3 = 0 THEN 'Not measured' ELSE CAST(floor((id % 100) / 100.0::DOUBLE * 100 + 0.5) AS BIGINT) || '%' END AS certainty FROM images_v""",
)
def _(spark, sf_dir):
    m = F.col("id") % 4
    kind = F.when(m == 0, F.lit(None).cast("string")).otherwise("image/png")
    size = F.when(m == 2, 0).when(m == 3, 10).otherwise(99_000_000)
    value = F.when(F.col("id") % 3 != 0, (F.col("id") % 100) / F.lit(100.0))
    return V.images(spark, sf_dir).select("id", L.upload_rejection(kind, size).alias("rejection"), L.certainty_label(value).alias("certainty"))


# -- rules


@query(
    "v_dates_and_counts",
    "",
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN true ELSE false END AS date_ok,
      o_orderkey % 3 = 0 AS count_ok FROM orders""",
)
def _(spark, sf_dir):
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    date = F.when(key % 5 == 0, day).when(key % 5 == 1, "2024-02-30").when(key % 5 == 2, F.concat(day, F.lit(" ")))
    date = date.when(key % 5 == 3, "1999-01-31").otherwise(F.lit("20240101"))
    count = F.when(key % 3 == 0, key.cast("string")).when(key % 3 == 1, F.concat(F.lit("-"), key.cast("string"))).otherwise("1.5")
    return V.read(spark, sf_dir, "orders").select("o_orderkey", rules.is_date(date).alias("date_ok"), rules.is_count(count).alias("count_ok"))


@query(
    "v_money",
    "",
    """SELECT l_orderkey, l_linenumber, l_linenumber % 3 <> 0 AS same, CASE WHEN l_linenumber % 3 <> 0 THEN
      CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) + CAST(l_quantity AS DECIMAL(18, 2)) AS VARCHAR) END AS total FROM lineitem""",
)
def _(spark, sf_dir):
    a, b = F.lit("USD"), F.when(F.col("l_linenumber") % 3 == 0, "EUR").otherwise("USD")
    same = rules.is_same_currency(a, b)
    total = (F.col("l_extendedprice").cast("decimal(18,2)") + F.col("l_quantity").cast("decimal(18,2)")).cast("decimal(18,2)")
    return V.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", same.alias("same"), F.when(same, total.cast("string")).alias("total"))


_FINDING = """(SELECT event_id, user_id, CASE event_id % 3 WHEN 0 THEN 'detected' WHEN 1 THEN 'undetermined' ELSE 'clear' END AS verdict,
  CASE event_id % 4 WHEN 0 THEN 'poor' WHEN 1 THEN 'good' END AS severity, CASE event_id % 5 WHEN 0 THEN ' ' WHEN 1 THEN 'too dark' END AS reason FROM events)"""


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return V.read(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        F.when(e % 3 == 0, "detected").when(e % 3 == 1, "undetermined").otherwise("clear").alias("verdict"),
        F.when(e % 4 == 0, "poor").when(e % 4 == 1, "good").alias("severity"),
        F.when(e % 5 == 0, " ").when(e % 5 == 1, "too dark").alias("reason"),
    )


@query(
    "v_findings",
    "",
    f"""SELECT event_id, CASE WHEN verdict = 'detected' THEN coalesce(severity IN ('poor', 'unusable'), false) ELSE severity IS NULL END
      AND (verdict <> 'undetermined' OR trim(coalesce(reason, '')) <> '') AS ok FROM {_FINDING}""",
)
def _(spark, sf_dir):
    ok = rules.is_finding(F.col("verdict"), F.col("severity"), F.col("reason"))
    return _findings(spark, sf_dir).select("event_id", ok.alias("ok"))


_CONDITIONS = tuple(name for name, *_ in quality.CONDITIONS)
_CONDITION_LIST = "[" + ", ".join(f"'{c}'" for c in _CONDITIONS) + "]"


@query(
    "v_reports",
    "",
    f"""SELECT o_orderkey AS report, list_sort(list_transform(range(0, 11), lambda i: {_CONDITION_LIST}[1 + CASE WHEN o_orderkey % 4 = 0 AND i = 3 THEN 4 ELSE i END]))
      = list_sort({_CONDITION_LIST}) AND o_orderkey % 4 <> 1 AS complete FROM orders""",
)
def _(spark, sf_dir):
    key = F.col("o_orderkey")
    whole = F.array(*map(F.lit, _CONDITIONS))
    twice = F.transform(whole, lambda c: F.when(c == _CONDITIONS[3], _CONDITIONS[4]).otherwise(c))
    own = F.when(key % 4 == 0, twice).when(key % 4 == 1, F.slice(whole, 1, 10)).otherwise(F.reverse(whole))
    return V.read(spark, sf_dir, "orders").select(key.alias("report"), rules.is_complete(own, _CONDITIONS).alias("complete"))


@query(
    "v_thresholds",
    "",
    """SELECT p_partkey, (u < p AND p < i) OR (u > p AND p > i) AS monotone, 0 <= lo AND lo < hi AND hi <= 1 AS band, (ppm * 63) % 1 = 0 AND (ppm * 88) % 1 = 0 AND ppm * 63 >= 1 AS whole
      FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS u, CAST(p_partkey % 50 AS DOUBLE) AS p, 25.0::DOUBLE AS i, (p_size - 10) / 50.0::DOUBLE AS lo, (p_partkey % 60) / 50.0::DOUBLE AS hi,
      p_size / 4.0::DOUBLE AS ppm FROM part)""",
)
def _(spark, sf_dir):
    size, key = F.col("p_size").cast("double"), F.col("p_partkey")
    return V.read(spark, sf_dir, "part").select(
        "p_partkey",
        rules.is_monotone(size, (key % 50).cast("double"), F.lit(25.0)).alias("monotone"),
        rules.is_band((size - 10) / 50, (key % 60) / F.lit(50.0), 0.0, 1.0).alias("band"),
        rules.is_whole_pixels(size / 4, 63, 88).alias("whole"),
    )


# -- grades and confidence

_BOUND = "CASE WHEN k LIKE '%_or_lower' THEN -1 WHEN k LIKE '%_or_higher' THEN 1 ELSE 0 END"


@query(
    "d_grade_order",
    "terms_v",
    f"""SELECT id, string_agg(k, '<' ORDER BY v, b) AS grades, arg_max(k, [p, v, b]) AS likely, max(p) < 0.5 AS uncertain FROM (SELECT *, CAST(split_part(k, '_', 1) AS DOUBLE) AS v,
      CAST({_BOUND} AS DOUBLE) AS b FROM (SELECT id, unnest([grade_key, '7', '7_or_higher']) AS k, unnest([p, 0.25, 0.25]) AS p FROM terms_v WHERE grade_key = '7_or_lower')) GROUP BY id""",
)
def _(spark, sf_dir):
    rows = V.distribution_terms(spark, sf_dir).where("grade_key = '7_or_lower'")
    terms = F.array(F.struct(F.col("grade_key").alias("k"), F.col("p").alias("p")), *(F.struct(F.lit(k).alias("k"), F.lit(0.25).alias("p")) for k in ("7", "7_or_higher")))
    rows = rows.select("id", F.inline(terms))
    listed = F.array_sort(F.collect_list(F.struct(rules.grade_order(F.col("k")).alias("o"), "k")))
    folded = rows.groupBy("id").agg(
        F.array_join(F.transform(listed, lambda x: x["k"]), "<").alias("grades"),
        rules.likely_grade(F.col("k"), F.col("p")).alias("likely"),
        rules.is_uncertain(F.col("p")).alias("uncertain"),
    )
    return folded


# -- images, verdicts and records


@query(
    "q_image_objects",
    "images_v",
    """SELECT id, concat_ws(',', 'o/' || id, CASE WHEN id % 3 = 0 THEN 'n/' || id END) AS objects, concat_ws(',', CASE WHEN id % 2 = 0 THEN 'o/' || id END, CASE WHEN id % 3 = 0 THEN 'n/' || id END) AS superseded FROM images_v""",
)
def _(spark, sf_dir):
    key = F.col("id").cast("string")
    original, normalised = F.concat(F.lit("o/"), key), F.when(F.col("id") % 3 == 0, F.concat(F.lit("n/"), key))
    new = F.when(F.col("id") % 2 != 0, original)
    held = workflow.held_objects(original, normalised)
    gone = workflow.superseded_objects(held, new)
    return V.images(spark, sf_dir).select("id", F.array_join(held, ",").alias("objects"), F.array_join(gone, ",").alias("superseded"))


_STATUS = "['good', 'acceptable', 'poor', 'unusable'][1 + CAST(n_chars % 4 AS INT)]"


@query(
    "s_failures",
    "analyses_v images_v",
    f"""SELECT a.id, a.status, coalesce(i.sides, '') AS sides, coalesce(i.digests, '') AS digests, CASE WHEN a.status = 'failed' THEN CASE WHEN coalesce(i.sides, '') <> '' THEN 'image_quality_failure' ELSE 'analysis_failed' END END AS reason,
      a.status IN ('created', 'uploading', 'uploaded') AS accepts_images, a.status = 'uploaded' AS runnable, a.status = 'awaiting_confirmation' AS confirmable
      FROM analyses_v a LEFT JOIN (SELECT analysis_id, string_agg(side, ',' ORDER BY side) FILTER ({_STATUS} = 'unusable') AS sides,
        string_agg(side || ':' || substr(sha256(body), 1, 8), ',' ORDER BY side) AS digests FROM images_v GROUP BY 1) i ON i.analysis_id = a.id""",
)
def _(spark, sf_dir):
    status = F.element_at(F.array(*map(F.lit, quality.SEVERITIES)), (F.col("n_chars") % 4 + 1).cast("int"))
    digest = F.struct("side", F.substring(F.sha2(F.col("body").cast("binary"), 256), 1, 8).alias("d"))
    sides = V.images(spark, sf_dir).groupBy("analysis_id").agg(
        F.array_sort(F.collect_list(F.when(status == "unusable", F.col("side")))).alias("sides"),
        F.map_from_entries(F.array_sort(F.collect_list(digest))).alias("digests"),
    )
    rows = V.analyses(spark, sf_dir).join(sides, F.col("id") == F.col("analysis_id"), "left")
    bad = F.coalesce("sides", F.array().cast("array<string>"))
    pairs = F.transform(F.map_entries("digests"), lambda e: F.concat_ws(":", e["key"], e["value"]))
    return rows.select(
        "id", "status", F.array_join(bad, ",").alias("sides"), F.coalesce(F.array_join(pairs, ","), F.lit("")).alias("digests"),
        workflow.failure(F.col("status"), bad).alias("reason"), *(c.alias(n) for n, c in workflow.gates(F.col("status")).items()),
    )


@query(
    "s_new_sessions",
    "sessions_v",
    "SELECT id, status, expires_at_s - 604800 AS created_at_s, expires_at_s FROM sessions_v UNION ALL SELECT 10000000 + id, 'active', 1704500000, 1704500000 + 604800 FROM sessions_v WHERE id % 100 = 0",
)
def _(spark, sf_dir):
    rows, now, ttl = V.sessions(spark, sf_dir), 1704500000, 604_800
    old = rows.select("id", "status", (F.col("expires_at_s") - ttl).alias("created_at_s"), "expires_at_s")
    new = rows.where("id % 100 = 0").select(F.col("id") + 10_000_000, F.lit("active"), F.lit(now).cast("long"), F.lit(now + ttl).cast("long"))
    return old.union(new)


@query(
    "w_partial_updates",
    "analyses_v",
    """SELECT id, CASE WHEN id % 3 = 0 THEN 'card-' || id WHEN id % 2 = 0 THEN 'old' END AS confirmed, status FROM analyses_v""",
)
def _(spark, sf_dir):
    rows = V.analyses(spark, sf_dir).select("id", "status", F.when(F.col("id") % 2 == 0, "old").alias("confirmed"))
    given = rows.where("id % 3 = 0").select("id", F.concat(F.lit("card-"), F.col("id").cast("string")).alias("confirmed"), F.lit("ignored").alias("status"))
    return catalog.merge(rows, given, ["id"], ["confirmed"]).select("id", "confirmed", "status")


@query(
    "w_append_only",
    "versions_v",
    """SELECT version, CASE WHEN ordinal % 4 = 0 THEN 'removed' ELSE 'changed' END AS violation FROM versions_v WHERE ordinal % 4 = 0 OR ordinal % 4 = 1""",
)
def _(spark, sf_dir):
    old = V.versions(spark, sf_dir)
    count = F.when(F.col("ordinal") % 4 == 1, F.lit(None).cast("long")).otherwise(F.col("card_count"))
    return snapshot.append_only_violations(old, old.where("ordinal % 4 <> 0").withColumn("card_count", count), "version")


@query(
    "w_checks",
    "images_v",
    """SELECT id, concat_ws(',', CASE WHEN id % 2 = 1 AND id % 5 = 0 THEN 'side' END, CASE WHEN id % 3 = 0 THEN 'dimensions' END, CASE WHEN id % 7 = 0 THEN 'score' END,
      CASE WHEN id % 4 = 0 THEN 'sha256' END, CASE WHEN id % 11 = 0 THEN 'status' END, CASE WHEN id % 13 = 0 THEN 'completed' END) AS violations FROM images_v""",
)
def _(spark, sf_dir):
    i = F.col("id")
    digest = F.sha2(F.col("body").cast("binary"), 256)
    rows = V.images(spark, sf_dir).select(
        "id",
        F.when(i % 2 * 5 + i % 5 == 5, "top").otherwise(F.col("side")).alias("side"),
        F.when(i % 3 == 0, 0).when(i % 3 == 1, 640).alias("width"),
        F.when(i % 7 == 0, 1.5).when(i % 7 == 1, 0.5).alias("score"),
        F.when(i % 4 == 0, F.upper(F.concat(F.lit("a"), F.substring(digest, 2, 63)))).otherwise(digest).alias("sha256"),
        F.when(i % 11 == 0, "fine").when(i % 11 == 1, "good").alias("status"),
        F.when(i % 13 == 0, "analyzing").otherwise("completed").alias("analysis"),
        F.lit(1).alias("completed_at"),
    )
    absent_or = lambda c, ok: c.isNull() | ok
    checks = {
        "side": F.col("side").isin("front", "back"),
        "dimensions": absent_or(F.col("width"), F.col("width") > 0),
        "score": absent_or(F.col("score"), F.col("score").between(0, 1)),
        "sha256": F.col("sha256").rlike(r"\A[0-9a-f]{64}\z"),
        "status": absent_or(F.col("status"), F.col("status").isin(*quality.SEVERITIES)),
        "completed": absent_or(F.col("completed_at"), F.col("analysis").isin(*workflow.TERMINAL)),
    }
    return rules.violations(rows, checks).select("id", F.array_join("violations", ",").alias("violations"))


@query(
    "k_stored_findings",
    "",
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 = 1 THEN 'glare:detected:poor' WHEN event_id % 4 = 2 THEN 'blur:clear:-' ELSE 'blur:undetermined:-' END AS findings FROM events""",
)
def _(spark, sf_dir):
    e = F.col("event_id") % 4
    stored = F.when(e == 0, '{"findings": "none"}').when(
        e == 1, '{"findings": [{"condition": "glare", "verdict": "detected", "severity": "poor", "measurement": 0.5}, {"condition": "rain", "verdict": "detected"}]}'
    )
    stored = stored.when(e == 2, '{"findings": [{"condition": "blur", "verdict": "clear", "severity": "awful"}, 7]}')
    stored = stored.otherwise('{"findings": [{"condition": "blur", "verdict": "undetermined", "reason": "dark"}, {"verdict": "clear"}]}')
    found = quality.stored_findings(stored)
    label = F.transform(found, lambda f: F.concat_ws(":", f["condition"], f["verdict"], F.coalesce(f["severity"], F.lit("-"))))
    return V.read(spark, sf_dir, "events").select("event_id", F.array_join(label, ",").alias("findings"))


@query(
    "k_concerning",
    "images_v",
    f"""SELECT analysis_id, string_agg(id || '=' || s, ',' ORDER BY s = 'unusable' DESC, id) AS concerning FROM (SELECT analysis_id, id, {_STATUS} AS s FROM images_v) WHERE s IN ('poor', 'unusable') GROUP BY 1""",
)
def _(spark, sf_dir):
    status = F.element_at(F.array(*map(F.lit, quality.SEVERITIES)), (F.col("n_chars") % 4 + 1).cast("int"))
    rows = V.images(spark, sf_dir).select("analysis_id", "id", status.alias("s")).where("s in ('poor', 'unusable')")
    listed = F.array_sort(F.collect_list(F.struct((F.col("s") != "unusable").alias("o"), "id", "s")))
    label = F.transform(listed, lambda x: F.concat(x["id"].cast("string"), F.lit("="), x["s"]))
    return rows.groupBy("analysis_id").agg(F.array_join(label, ",").alias("concerning"))


@query(
    "k_records",
    "",
    """SELECT event_id, '{"version":"1",' || CASE WHEN event_id % 2 = 0 THEN '"detector":"d",' ELSE '' END || '"thresholds":{"gate.blur":40.0,"detect.area":0.5},"findings":[{"condition":"blur","verdict":"'
      || verdict || '"' || coalesce(',"severity":"' || severity || '"', '') || coalesce(',"reason":"' || reason || '"', '') || '}]}' AS record FROM """
    + _FINDING,
)
def _(spark, sf_dir):
    finding = F.struct(F.lit("blur").alias("condition"), "verdict", "severity", F.lit(None).cast("double").alias("measurement"), "reason")
    thresholds = quality.threshold_maps(gate={"blur": 40.0}, detect={"area": 0.5})
    record = quality.record(F.lit("1"), F.when(F.col("event_id") % 2 == 0, "d"), thresholds, F.array(finding))
    return _findings(spark, sf_dir).select("event_id", record.alias("record"))


# -- detection


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda i: F.col("embedding")[i].cast("double")
    return V.read(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 6).cast("long").alias("frame"), F.col("vec_id").alias("id"), (20000 + 40000 * e(0)).alias("area"),
        F.round(100 + 60 * e(1), 0).alias("cx"), F.round(100 + 60 * e(2), 0).alias("cy"), F.lit(200.0).alias("short_edge"),
    )


@query("g_candidate_groups")
def _(spark, sf_dir):
    return detection.detect(_candidates(spark, sf_dir))


@query(
    "g_rescaled",
    "quads_v",
    "SELECT vec_id, least(1000.0, greatest(0.0, x1 / 0.25)) AS x, least(1000.0, greatest(0.0, (y1 - 160) / 0.25)) AS y FROM quads_v",
)
def _(spark, sf_dir):
    x = detection.rescaled(F.col("x1"), F.lit(0.25), F.col("frame_width"))
    y = detection.rescaled(F.col("y1") - 160, F.lit(0.25), F.col("frame_height"))
    return V.quads(spark, sf_dir).select("vec_id", x.alias("x"), y.alias("y"))


# -- image bytes


@query("b_images", "", "SELECT vec_id AS id, 'png' AS format, 8 AS width, 8 AS height, CAST(NULL AS VARCHAR) AS problem, true AS kept FROM embeddings")
def _(spark, sf_dir):
    images = image_bytes.encode_png(V.rasters(spark, sf_dir))
    checked = image_bytes.check_images(images).join(images, "id")
    return checked.select("id", "format", "width", "height", "problem", (F.col("clean") == F.col("body")).alias("kept"))
