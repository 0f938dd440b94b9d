"""The catalogue, workflow and image queries, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import geometry as G
from larkspur.functions import keys as K
from larkspur.operators import catalog, quality, raster, rules, workflow
from larkspur.sources import views as V
from larkspur.sources.views import with_views

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, tuple[Query, str | None]] = {}
#: SQL of queries that are registered without it.
LATER_SQL: dict[str, str] = {}

NS = K.NAMESPACE.hex
#: card_number_key in SQL.
KEY = "ltrim(split_part(card_number, '/', 1), '0')"


def _uuid_sql(name: str) -> str:
    """DuckDB has no SHA-1 of a blob made of unhexed bytes and text but through encode; see UUID5."""
    h = f"sha1(unhex('{NS}') || encode({name}))"
    return (
        f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || "
        f"substr('89ab', 1 + (CAST('0x' || substr({h}, 17, 1) AS INTEGER) % 4), 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"
    )


_MEASURE_SQL = """m AS (SELECT vec_id, avg(px) AS brightness, quantile_cont(px, 0.95) - quantile_cont(px, 0.05) AS exposure FROM pixels_v GROUP BY 1),
  lap AS (SELECT c.vec_id, u.px + d.px + l.px + r.px - 4 * c.px AS v FROM pixels_v c
    JOIN pixels_v u ON u.vec_id = c.vec_id AND u.i = (CASE WHEN c.i // 8 = 0 THEN 1 ELSE c.i // 8 - 1 END) * 8 + c.i % 8
    JOIN pixels_v d ON d.vec_id = c.vec_id AND d.i = (CASE WHEN c.i // 8 = 7 THEN 6 ELSE c.i // 8 + 1 END) * 8 + c.i % 8
    JOIN pixels_v l ON l.vec_id = c.vec_id AND l.i = c.i // 8 * 8 + CASE WHEN c.i % 8 = 0 THEN 1 ELSE c.i % 8 - 1 END
    JOIN pixels_v r ON r.vec_id = c.vec_id AND r.i = c.i // 8 * 8 + CASE WHEN c.i % 8 = 7 THEN 6 ELSE c.i % 8 + 1 END),
  b AS (SELECT vec_id, var_pop(v) AS blur FROM lap GROUP BY 1)"""


def query(name: str, views: str = "", sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        full = sql if sql is None or not views else with_views(views, sql)
        if full and "pixels_v" in views:
            at = full.index(" SELECT", full.rindex(f"({V.SQL[views.split()[-1]]})") + len(V.SQL[views.split()[-1]]))
            full = f"{full[:at]}, {_MEASURE_SQL}{full[at:]}"
        _QUERIES[name] = (fn, full)
        return fn

    return add


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.with_sets(V.cards(spark, sf_dir), V.sets(spark, sf_dir))


CATALOG = "sets_v cards_v"
ROWS = "(SELECT c.*, s.game, s.language, s.name AS set_name FROM cards_v c JOIN sets_v s USING (set_code))"
COLS = "set_code, id, card_number, name, rarity, variant, game, language, set_name"


def _search(label: str, where: str, limit: int = 20, offset: int = 0, **filters: str) -> None:
    sql = (
        f"SELECT {COLS}, total FROM (SELECT count(*) AS total FROM {ROWS} WHERE {where}) LEFT JOIN (SELECT * FROM {ROWS} WHERE {where} "
        f"ORDER BY set_code, card_number, variant NULLS LAST, id LIMIT {limit} OFFSET {offset}) ON true"
    )

    @query(label, CATALOG, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return catalog.search(_catalog(spark, sf_dir), limit, offset, **filters)


_search("q_search_name", "contains(lower(name), 'large')", name="LARGE")
_search("q_search_number_prefix", f"starts_with({KEY}, '4')", number="004/050", limit=50)
_search("q_search_zero_number", "false", number="000")
_search("q_search_literal_percent", "contains(lower(name), '%')", name="%")
_search("q_search_filters", "language = 'en' AND variant = 'promo' AND game = 'tpch'", language="en", variant="promo", game="tpch")
_search("q_search_second_page", "language = 'ja'", 100, 100, language="ja")
_search("q_search_past_the_end", "language = 'ja'", 20, 1_000_000, language="ja")


@query("q_point_lookup", CATALOG, f"SELECT {COLS} FROM {ROWS} WHERE id = 7")
def _(spark, sf_dir):
    return _catalog(spark, sf_dir).where(F.col("id") == 7)


@query("q_external_ids", "external_ids_v", "SELECT * FROM external_ids_v WHERE card_id = 7")
def _(spark, sf_dir):
    return V.external_ids(spark, sf_dir).where("card_id = 7").orderBy("provider", "external_id")


@query(
    "q_card_detail",
    "cards_v external_ids_v",
    """SELECT id, name, coalesce((SELECT string_agg(provider || '=' || external_id, ';' ORDER BY provider, external_id)
      FROM external_ids_v e WHERE e.card_id = c.id), '') AS ids FROM cards_v c""",
)
def _(spark, sf_dir):
    rows = catalog.detail(V.cards(spark, sf_dir), V.external_ids(spark, sf_dir))
    label = F.transform("external_ids", lambda e: F.concat(e["provider"], F.lit("="), e["external_id"]))
    return rows.select("id", "name", F.array_join(label, ";").alias("ids"))


@query("q_current_version", "versions_v", "SELECT * FROM versions_v ORDER BY ordinal DESC LIMIT 1")
def _(spark, sf_dir):
    return V.versions(spark, sf_dir).orderBy(F.desc("ordinal")).limit(1)


@query("q_version_by_name", "versions_v", "SELECT * FROM versions_v WHERE version = 'orders-catalog-v0.3.0'")
def _(spark, sf_dir):
    return V.versions(spark, sf_dir).where("version = 'orders-catalog-v0.3.0'")


AS_OF = 1704500000


@query("q_live_sessions", "sessions_v", f"SELECT * FROM sessions_v WHERE status = 'active' AND expires_at_s > {AS_OF}")
def _(spark, sf_dir):
    return V.sessions(spark, sf_dir).where(f"status = 'active' and expires_at_s > {AS_OF}")


@query(
    "q_owned_analyses",
    "sessions_v analyses_v",
    f"""SELECT a.id, a.session_id, a.status FROM analyses_v a WHERE session_id IN
      (SELECT id FROM sessions_v WHERE status = 'active' AND expires_at_s > {AS_OF})""",
)
def _(spark, sf_dir):
    live = V.sessions(spark, sf_dir).where(f"status = 'active' and expires_at_s > {AS_OF}").select(F.col("id").alias("session_id"))
    return V.analyses(spark, sf_dir).join(live, "session_id", "left_semi").select("id", "session_id", "status")


@query(
    "q_expiry_sweep",
    "sessions_v analyses_v",
    f"""SELECT s.id, s.expires_at_s, count(a.id) AS analyses FROM sessions_v s LEFT JOIN analyses_v a ON a.session_id = s.id
      WHERE expires_at_s <= {AS_OF} GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    due = V.sessions(spark, sf_dir).where(f"expires_at_s <= {AS_OF}").select("id", "expires_at_s")
    held = V.analyses(spark, sf_dir).groupBy("session_id").agg(F.count("*").alias("analyses"))
    joined = due.join(held, due["id"] == held["session_id"], "left")
    return joined.select("id", "expires_at_s", F.coalesce("analyses", F.lit(0)).alias("analyses")).orderBy("expires_at_s", "id")


@query(
    "q_image_sides",
    "images_v",
    """SELECT analysis_id, count(*) AS sides, string_agg(side || '=' || sha256(body), ';' ORDER BY side) AS digests
      FROM images_v WHERE side IN ('front', 'back') GROUP BY 1""",
)
def _(spark, sf_dir):
    rows = V.images(spark, sf_dir).where(F.col("side").isin("front", "back"))
    pair = F.struct("side", F.sha2(F.col("body").cast("binary"), 256).alias("digest"))
    grouped = rows.groupBy("analysis_id").agg(F.count("*").alias("sides"), F.array_sort(F.collect_list(pair)).alias("d"))
    digests = F.array_join(F.transform("d", lambda x: F.concat(x["side"], F.lit("="), x["digest"])), ";")
    return grouped.select("analysis_id", "sides", digests.alias("digests"))


@query(
    "w_upsert_cards",
    "cards_v",
    """SELECT t.id, t.set_code, t.card_number, CASE WHEN t.id % 10 < 5 THEN t.name || ' v2' ELSE t.name END AS name,
      CASE WHEN t.id % 10 < 5 THEN 'Promo' ELSE t.rarity END AS rarity, t.variant,
      CASE WHEN t.id % 10 = 0 THEN 'inserted' WHEN t.id % 10 < 5 THEN 'updated' ELSE 'kept' END AS action FROM cards_v t""",
)
def _(spark, sf_dir):
    cards = V.cards(spark, sf_dir)
    source = cards.where("id % 10 < 5").withColumns({"name": F.concat("name", F.lit(" v2")), "rarity": F.lit("Promo")})
    source = source.withColumn("card_number", F.when(F.col("id") % 10 == 0, F.col("card_number")).otherwise("changed"))
    return catalog.merge(cards.where("id % 10 <> 0"), source, ["id"], ["name", "rarity"])


@query(
    "w_upsert_external_ids",
    "external_ids_v",
    """SELECT card_id, provider, external_id, CASE WHEN provider = 'feed' THEN 'new' ELSE 'old' END AS metadata,
      CASE WHEN provider = 'feed' AND card_id % 2 = 0 THEN 'inserted' WHEN provider = 'feed' THEN 'updated' ELSE 'kept' END AS action
      FROM external_ids_v""",
)
def _(spark, sf_dir):
    rows = V.external_ids(spark, sf_dir)
    target = rows.where("provider <> 'feed' or card_id % 2 <> 0").withColumn("metadata", F.lit("old"))
    source = rows.where("provider = 'feed'").withColumn("metadata", F.lit("new"))
    return catalog.merge(target, source, ["card_id", "provider", "external_id"], ["metadata"])


@query(
    "w_insert_absent_versions",
    "versions_v",
    """SELECT version, ordinal, set_count, card_count FROM versions_v WHERE ordinal <= 5 UNION ALL
      SELECT version, 5 + row_number() OVER (ORDER BY version), set_count, card_count FROM versions_v WHERE ordinal > 5 AND ordinal <= 9""",
)
def _(spark, sf_dir):
    rows = V.versions(spark, sf_dir)
    return catalog.insert_absent(rows.where("ordinal <= 5"), rows.where("ordinal between 3 and 9"), "version", "ordinal")


@query(
    "w_retake_images",
    "images_v",
    """SELECT id, CASE WHEN id % 3 = 0 THEN 'retake/' || id ELSE 'first/' || id END AS uri,
      CASE WHEN id % 3 <> 0 THEN 'n/' || id END AS normalized_uri, CASE WHEN id % 3 <> 0 THEN 0.5 END AS quality_score,
      CASE WHEN id % 3 = 0 THEN 'updated' ELSE 'kept' END AS action FROM images_v""",
)
def _(spark, sf_dir):
    ids = V.images(spark, sf_dir).select("id")
    at = lambda prefix: F.concat(F.lit(prefix), F.col("id").cast("string"))
    old = ids.select("id", at("first/").alias("uri"), at("n/").alias("normalized_uri"), F.lit(0.5).alias("quality_score"))
    none = F.lit(None).cast
    new = ids.where("id % 3 = 0").select("id", at("retake/").alias("uri"), none("string").alias("normalized_uri"), none("double").alias("quality_score"))
    return catalog.merge(old, new, ["id"], ["uri", "normalized_uri", "quality_score"])


@query(
    "w_write_once",
    "analyses_v",
    """SELECT id, CASE WHEN id % 4 = 1 THEN 'model' WHEN id % 4 = 3 THEN 'model,rules' ELSE '' END AS violations FROM analyses_v""",
)
def _(spark, sf_dir):
    ids = V.analyses(spark, sf_dir).select("id")
    old = ids.select("id", F.lit("m1").alias("model"), F.when(F.col("id") % 4 == 3, "r1").alias("rules"))
    model = F.when(F.col("id") % 4 == 1, "m2").when(F.col("id") % 4 == 3, F.lit(None)).otherwise("m1")
    new = ids.select("id", model.alias("model"), F.lit("r2").alias("rules"))
    broken = catalog.write_once_violations(old, new, "id", ["model", "rules"])
    return broken.select("id", F.array_join("violations", ",").alias("violations"))


@query(
    "w_duplicate_cards",
    "cards_v",
    "SELECT set_code, card_number, variant, count(*) AS n FROM cards_v GROUP BY ALL HAVING count(*) > 1",
)
def _(spark, sf_dir):
    return catalog.duplicates(V.cards(spark, sf_dir), ["set_code", "card_number", "variant"])


@query(
    "w_generated_key",
    "cards_v",
    f"SELECT id, card_number, {KEY} AS card_number_key FROM cards_v",
)
def _(spark, sf_dir):
    cards = V.cards(spark, sf_dir)
    return cards.select("id", "card_number", K.card_number_key(F.col("card_number")).alias("card_number_key"))


@query("w_orphans", CATALOG, "SELECT set_code, count(*) AS n FROM cards_v WHERE set_code NOT IN (SELECT set_code FROM sets_v WHERE language = 'en') GROUP BY 1")
def _(spark, sf_dir):
    english = V.sets(spark, sf_dir).where("language = 'en'")
    return rules.orphans(V.cards(spark, sf_dir), english, "set_code").groupBy("set_code").agg(F.count("*").alias("n"))


@query(
    "w_cascade_delete",
    "sessions_v analyses_v",
    """SELECT a.status, count(*) AS n FROM analyses_v a JOIN sessions_v s ON s.id = a.session_id WHERE s.status = 'active' GROUP BY 1""",
)
def _(spark, sf_dir):
    gone = V.sessions(spark, sf_dir).where("status <> 'active'").select(F.col("id").alias("session_id"))
    return V.analyses(spark, sf_dir).join(gone, "session_id", "left_anti").groupBy("status").agg(F.count("*").alias("n"))


@query(
    "w_version_drift",
    "versions_v cards_v sets_v",
    """SELECT version, card_count <> (SELECT count(*) FROM cards_v) OR set_count <> (SELECT count(*) FROM sets_v) AS drifted FROM versions_v""",
)
def _(spark, sf_dir):
    counts = V.cards(spark, sf_dir).agg(F.count("*").alias("cards")).crossJoin(V.sets(spark, sf_dir).agg(F.count("*").alias("sets")))
    rows = V.versions(spark, sf_dir).crossJoin(F.broadcast(counts))  # one row of counts
    return rows.select("version", ((F.col("card_count") != F.col("cards")) | (F.col("set_count") != F.col("sets"))).alias("drifted"))


@query(
    "v_catalog_rules",
    CATALOG,
    f"""SELECT id, concat_ws(',', CASE WHEN NOT regexp_matches(coalesce(variant, ''), '^[a-z0-9]+(?:-[a-z0-9]+)*$') THEN 'variant' END,
      CASE WHEN NOT regexp_matches(language, '^[a-z]{{2}}$') THEN 'language' END,
      CASE WHEN trim(name) <> name OR name = '' THEN 'name' END)
      AS violations FROM {ROWS}""",
)
def _(spark, sf_dir):
    checks = {
        "variant": rules.is_slug(F.col("variant")),
        "language": rules.is_language(F.col("language")),
        "name": rules.is_identifier(F.col("name")),
    }
    return rules.violations(_catalog(spark, sf_dir), checks).select("id", F.array_join("violations", ",").alias("violations"))


@query(
    "v_version_rules",
    "versions_v",
    """SELECT version, regexp_matches(version, '^[a-z0-9]+(?:-[a-z0-9]+)*-v[0-9]+\\.[0-9]+\\.[0-9]+$') AND NOT contains(version, 'latest') AS ok
      FROM (SELECT CASE WHEN ordinal % 3 = 0 THEN 'latest-' || version WHEN ordinal % 3 = 1 THEN version ELSE upper(version) END AS version FROM versions_v)""",
)
def _(spark, sf_dir):
    o = F.col("ordinal") % 3
    name = F.when(o == 0, F.concat(F.lit("latest-"), "version")).when(o == 1, F.col("version")).otherwise(F.upper("version"))
    rows = V.versions(spark, sf_dir).select(name.alias("version"))
    return rows.select("version", rules.is_version(F.col("version")).alias("ok"))


@query(
    "v_distributions",
    "terms_v",
    """SELECT id, concat_ws(',', CASE WHEN NOT bool_and(p >= 0 AND p <= 1) THEN 'unit' END,
      CASE WHEN abs(sum(p) - 1) > 1e-6 THEN 'sum' END) AS violations
      FROM (SELECT id, CASE WHEN id % 7 = 0 THEN p * 1.1 ELSE p END AS p FROM terms_v) GROUP BY 1""",
)
def _(spark, sf_dir):
    p = F.when(F.col("id") % 7 == 0, F.col("p") * 1.1).otherwise(F.col("p"))
    folded = V.distribution_terms(spark, sf_dir).select("id", p.alias("p")).groupBy("id").agg(
        F.bool_and(rules.is_unit(F.col("p"))).alias("unit"), F.sum("p").alias("total")
    )
    checked = rules.violations(folded, {"unit": F.col("unit"), "sum": F.abs(F.col("total") - 1) <= 1e-6})
    return checked.select("id", F.array_join("violations", ",").alias("violations"))


@query(
    "v_grade_keys",
    "terms_v",
    """SELECT DISTINCT k, regexp_matches(k, '^(10|[0-9](\\.[05])?)(_or_(lower|higher))?$') AS ok
      FROM (SELECT grade_key AS k FROM terms_v UNION ALL SELECT grade_key || '_or_higher' FROM terms_v UNION ALL SELECT '1' || grade_key FROM terms_v)
      WHERE k NOT LIKE '%lower_or%'""",
)
def _(spark, sf_dir):
    key = F.col("grade_key")
    forms = F.array(key, F.concat(key, F.lit("_or_higher")), F.concat(F.lit("1"), key))
    rows = V.distribution_terms(spark, sf_dir).select(F.explode(forms).alias("k")).where("k not like '%lower_or%'").distinct()
    return rows.select("k", rules.is_grade_key(F.col("k")).alias("ok"))


@query(
    "f_card_ids",
    CATALOG,
    f"SELECT id, {_uuid_sql('label')} AS uuid, label FROM (SELECT id, game || '/' || language || '/' || set_code || '/' || card_number || '/' || coalesce(variant, '') AS label FROM {ROWS})",
)
def _(spark, sf_dir):
    label = K.card_key(*map(F.col, ("game", "language", "set_code", "card_number", "variant")))
    return _catalog(spark, sf_dir).select("id", K.uuid5(label).alias("uuid"), label.alias("label"))


@query(
    "f_slugs",
    "",
    """SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS name_slug,
      trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-') || '-' || trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS variant
      FROM part""",
)
def _(spark, sf_dir):
    part = V.read(spark, sf_dir, "part")
    variant = K.variant_slugs([F.col("p_type"), F.lit(" -- "), F.col("p_brand")])
    return part.select("p_partkey", K.slug(F.col("p_name")).alias("name_slug"), variant.alias("variant"))


@query(
    "f_references",
    CATALOG,
    f"SELECT id, game || '/' || language || '/' || set_code || '-' || card_number || CASE WHEN variant IS NULL THEN '' ELSE ' (' || variant || ')' END AS label FROM {ROWS}",
)
def _(spark, sf_dir):
    label = K.reference_label(*map(F.col, ("game", "language", "set_code", "card_number", "variant")))
    return _catalog(spark, sf_dir).select("id", label.alias("label"))


@query(
    "f_labels",
    "",
    """SELECT o_orderkey, floor(s * 100 + 0.5)::BIGINT || '%' AS percent, least(1.0 * pow(2.0, o_orderkey % 9), 30.0) AS backoff,
      CASE WHEN o_orderkey % 90 BETWEEN 0 AND 60 THEN (o_orderkey % 90)::DOUBLE END AS retry_after
      FROM (SELECT o_orderkey, (o_orderkey % 1000) / 1000.0::DOUBLE AS s FROM orders)""",
)
def _(spark, sf_dir):
    key = F.col("o_orderkey")
    return V.read(spark, sf_dir, "orders").select(
        "o_orderkey",
        K.percent_label((key % 1000) / F.lit(1000.0)).alias("percent"),
        K.backoff(1.0, (key % 9).cast("double"), 30.0).alias("backoff"),
        K.retry_after((key % 90).cast("string")).alias("retry_after"),
    )


@query("f_body_digests", "images_v", "SELECT id, sha256(body) AS sha256, substr(sha256(side || id), 1, 16) AS bucket FROM images_v")
def _(spark, sf_dir):
    digest = F.sha2(F.col("body").cast("binary"), 256)
    bucket = F.substring(F.sha2(F.concat("side", F.col("id").cast("string")), 256), 1, 16)
    return V.images(spark, sf_dir).select("id", digest.alias("sha256"), bucket.alias("bucket"))


GRADE_VALUE = "CAST(split_part(grade_key, '_', 1) AS DECIMAL(3, 1))"


@query(
    "d_most_likely",
    "terms_v",
    f"""SELECT id, arg_max(grade_key, [p, {GRADE_VALUE}::DOUBLE]) AS grade, max(p) AS p,
      coalesce(max(p) FILTER (grade_key = '10'), 0) AS p10,
      string_agg(grade_key, '>' ORDER BY {GRADE_VALUE} DESC) AS grades FROM terms_v GROUP BY 1""",
)
def _(spark, sf_dir):
    value = F.split_part(F.col("grade_key"), F.lit("_"), F.lit(1)).cast("decimal(3,1)")
    rows = V.distribution_terms(spark, sf_dir).withColumn("value", value)
    listed = F.reverse(F.array_sort(F.collect_list(F.struct("value", "grade_key"))))
    folded = rows.groupBy("id").agg(
        F.max_by("grade_key", F.struct("p", "value")).alias("grade"),
        F.max("p").alias("p"),
        F.coalesce(F.max(F.when(F.col("grade_key") == "10", F.col("p"))), F.lit(0.0)).alias("p10"),
        listed.alias("g"),
    )
    return folded.select("id", "grade", "p", "p10", F.array_join(F.transform("g", lambda x: x["grade_key"]), ">").alias("grades"))


@query(
    "d_money",
    "",
    """SELECT l_orderkey, l_linenumber, round(price * rate, 2)::VARCHAR AS fee, (price - round(price * rate, 2))::VARCHAR AS net
      FROM (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(18, 2)) AS price, CAST(l_discount AS DECIMAL(4, 3)) AS rate FROM lineitem)""",
)
def _(spark, sf_dir):
    price, rate = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_discount").cast("decimal(4,3)")
    fee = F.round(price * rate, 2).cast("decimal(18,2)")
    net = (price - fee).cast("decimal(18,2)")
    return V.read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", fee.cast("string").alias("fee"), net.cast("string").alias("net")
    )


def _side(i: int) -> str:
    j = i % 4 + 1
    return f"sqrt((x{j} - x{i}) * (x{j} - x{i}) + (y{j} - y{i}) * (y{j} - y{i}))"


def _cross(i: int) -> str:
    j, k = i % 4 + 1, (i + 1) % 4 + 1
    return f"((x{j} - x{i}) * (y{k} - y{j}) - (y{j} - y{i}) * (x{k} - x{j}))"


AREA = "abs(" + " + ".join(f"(x{i} * y{i % 4 + 1} - x{i % 4 + 1} * y{i})" for i in range(1, 5)) + ") / 2"
RATIO = f"greatest(greatest({_side(1)}, {_side(3)}) / least({_side(1)}, {_side(3)}), greatest({_side(2)}, {_side(4)}) / least({_side(2)}, {_side(4)}))"
NEAR = ", ".join([*(f"x{i}, y{i}, frame_width - x{i}, frame_height - y{i}" for i in range(1, 5))])
MARGIN = f"greatest(0, least({NEAR})) / least(frame_width, frame_height)"


@query(
    "g_shapes",
    "quads_v",
    f"""SELECT vec_id, {' AND '.join(f'{_cross(i)} > 0' for i in range(1, 5))} AS valid, round({AREA}, 6) AS area,
      round({AREA} / (frame_width * frame_height), 9) AS fraction, round({_side(1)}, 6) AS top, round({RATIO}, 9) AS ratio,
      round({MARGIN}, 9) AS margin, round((x1 + x2 + x3 + x4) / 4, 6) AS cx, {_side(1)} + {_side(3)} > {_side(2)} + {_side(4)} AS turn,
      greatest(1, least(4, CAST(round_even(CASE WHEN {_side(1)} + {_side(3)} > {_side(2)} + {_side(4)} THEN greatest({_side(1)}, {_side(3)})
        ELSE greatest({_side(2)}, {_side(4)}) END / 1056.0, 0) AS INT))) AS multiple
      FROM quads_v""",
)
def _(spark, sf_dir):
    return V.quads(spark, sf_dir).select(
        "vec_id",
        G.is_clockwise_convex().alias("valid"),
        F.round(G.area(), 6).alias("area"),
        F.round(G.area_fraction(), 9).alias("fraction"),
        F.round(G.side(0), 6).alias("top"),
        F.round(G.opposite_side_ratio(), 9).alias("ratio"),
        F.round(G.border_margin_fraction(), 9).alias("margin"),
        F.round(G.centre()[0], 6).alias("cx"),
        G.short_edge_first().alias("turn"),
        G.warp_multiple().alias("multiple"),
    )


@query(
    "g_canonical_corners",
    "quads_v",
    """SELECT vec_id, string_agg(round(x, 4) || ':' || round(y, 4), ' ' ORDER BY place) AS corners FROM (
      SELECT *, (rn - first_value(rn) OVER (PARTITION BY vec_id ORDER BY x + y, y, x) + 4) % 4 AS place FROM (
        SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY atan2(y - cy, x - cx), x, y) AS rn FROM (
          SELECT vec_id, (x1 + x2 + x3 + x4) / 4 AS cx, (y1 + y2 + y3 + y4) / 4 AS cy, unnest([x1, x2, x3, x4]) AS x, unnest([y1, y2, y3, y4]) AS y FROM quads_v)))
      GROUP BY 1""",
)
def _(spark, sf_dir):
    label = lambda c: F.concat_ws(":", F.round(c["x"], 4).cast("string"), F.round(c["y"], 4).cast("string"))
    return V.quads(spark, sf_dir).select("vec_id", F.array_join(F.transform(G.canonical_corners(), label), " ").alias("corners"))


def _homography_sql() -> str:
    d = "((x2 - x3) * (y4 - y3) - (x4 - x3) * (y2 - y3))"
    g = f"(((x1 - x2 + x3 - x4) * (y4 - y3) - (x4 - x3) * (y1 - y2 + y3 - y4)) / {d})"
    h = f"(((x2 - x3) * (y1 - y2 + y3 - y4) - (x1 - x2 + x3 - x4) * (y2 - y3)) / {d})"
    return f"""SELECT vec_id, round((x2 - x1 + {g} * x2) / 756, 6) AS h0, round((x4 - x1 + {h} * x4) / 1056, 6) AS h1, round(x1, 6) AS h2,
      round({g} / 756, 9) AS h6, round({h} / 1056, 9) AS h7 FROM quads_v"""


@query("g_homography", "quads_v", _homography_sql())
def _(spark, sf_dir):
    h = G.homography(756.0, 1056.0)
    return V.quads(spark, sf_dir).select("vec_id", *(F.round(h[i], 9 if i > 5 else 6).alias(f"h{i}") for i in (0, 1, 2, 6, 7)))


def _rectangle_sql() -> str:
    """The smallest of the rectangles along each line through two corners."""
    areas = []
    for i in range(1, 5):
        for j in range(i + 1, 5):
            dx, dy = f"(x{j} - x{i})", f"(y{j} - y{i})"
            along = ", ".join(f"x{k} * {dx} + y{k} * {dy}" for k in range(1, 5))
            across = ", ".join(f"y{k} * {dx} - x{k} * {dy}" for k in range(1, 5))
            areas.append(f"(greatest({along}) - least({along})) * (greatest({across}) - least({across})) / ({dx} * {dx} + {dy} * {dy})")
    return "least(" + ", ".join(areas) + ")"


@query(
    "g_detection_confidence",
    "quads_v",
    f"""SELECT vec_id, round(greatest(0, least(1, 0.5 * r + 0.5 * (1 - least(1, abs(a - 63.0::DOUBLE / 88.0) / 0.25)))), 9) AS confidence,
      f BETWEEN 0.02 AND 0.92 AND r >= 0.80 AND a BETWEEN 0.45 AND 0.97 AS candidate FROM (SELECT vec_id, {AREA} / (frame_width * frame_height) AS f,
      {AREA} / ({_rectangle_sql()}) AS r,
      least({_side(1)}, {_side(2)}) / greatest({_side(1)}, {_side(2)}) AS a FROM quads_v)""",
)
def _(spark, sf_dir):
    rows = V.quads(spark, sf_dir).select(
        "vec_id",
        G.area_fraction().alias("f"),
        (G.area() / G.rectangle_area()).alias("r"),
        (F.least(G.side(0), G.side(1)) / F.greatest(G.side(0), G.side(1))).alias("a"),
    )
    fits = F.col("f").between(0.02, 0.92) & (F.col("r") >= 0.80) & F.col("a").between(0.45, 0.97)
    return rows.select("vec_id", F.round(G.detection_confidence(F.col("r"), F.col("a")), 9).alias("confidence"), fits.alias("candidate"))


@query(
    "r_measurements",
    "pixels_v",
    "SELECT vec_id, round(blur, 6) AS blur, round(brightness, 6) AS brightness, round(exposure, 6) AS exposure FROM "
    "(SELECT * FROM m JOIN b USING (vec_id))",
)
def _(spark, sf_dir):
    return raster.measure(V.rasters(spark, sf_dir)).select(
        "vec_id", *(F.round(c, 6).alias(c) for c in ("blur", "brightness", "exposure"))
    )


@query("r_glare")
def _(spark, sf_dir):
    return raster.measure(V.rasters(spark, sf_dir)).select("vec_id", "glare")


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    quads = V.quads(spark, sf_dir).select(
        "vec_id",
        G.opposite_side_ratio().alias("perspective"),
        G.border_margin_fraction().alias("margin"),
        G.area_fraction().alias("area"),
        (1 + F.col("vec_id") % 2).cast("double").alias("candidates"),
        F.lit(1.0).alias("sleeve"),
    ).where("vec_id % 5 <> 0")
    rows = raster.measure(V.rasters(spark, sf_dir)).withColumn("short_edge", (500 + F.col("vec_id") * 37 % 2000).cast("double"))
    return rows.join(quads, "vec_id", "left")


@query(
    "k_quality_gate",
    "pixels_v quads_v",
    None,
)
def _(spark, sf_dir):
    judged = quality.assess(_measured(spark, sf_dir))
    detected = F.filter("findings", lambda f: f["verdict"] == "detected")
    return judged.select(
        "vec_id",
        F.round("score", 9).alias("score"),
        "status",
        F.array_join(F.transform(detected, lambda f: F.concat(f["condition"], F.lit("="), f["severity"])), ",").alias("detected"),
    )


def _triple_sql(column: str, unusable: float, poor: float, ideal: float) -> tuple[str, str]:
    s = -1 if ideal < poor else 1
    v, u, p, i = f"({s} * {column})", s * unusable, s * poor, s * ideal
    sev = f"CASE WHEN {column} IS NULL THEN NULL WHEN {v} <= {u}::DOUBLE THEN 'unusable' WHEN {v} <= {p}::DOUBLE THEN 'poor' ELSE 'good' END"
    mar = (
        f"CASE WHEN {column} IS NULL THEN NULL WHEN {v} <= {u}::DOUBLE THEN 0.0::DOUBLE WHEN {v} <= {p}::DOUBLE THEN ({v} - {u}::DOUBLE) / ({p - u}::DOUBLE) * 0.5 "
        f"WHEN {v} >= {i}::DOUBLE THEN 1.0 ELSE 0.5 + ({v} - {p}::DOUBLE) / ({i - p}::DOUBLE) * 0.5 END"
    )
    return sev, mar


def _gate_sql(conditions: tuple = tuple(c for c in quality.CONDITIONS if c[0] != "glare")) -> str:
    parts = [(n, *_triple_sql(m, u, p, i)) for n, m, u, p, i in conditions]
    columns = ", ".join(f"{sev} AS s_{n}, {mar} AS m_{n}" for n, sev, mar in parts)
    names = [n for n, _, _ in parts]
    rank = "CASE {} WHEN 'unusable' THEN 3 WHEN 'poor' THEN 2 WHEN 'good' THEN 0 ELSE 1 END"
    worst = "greatest(" + ", ".join(rank.format(f"s_{n}") for n in names) + ")"
    detected = ", ".join(f"CASE WHEN s_{n} <> 'good' THEN '{n}=' || s_{n} END" for n in names)
    return f"""SELECT vec_id, round(least({', '.join(f'm_{n}' for n in names)}), 9) AS score,
      ['good', 'acceptable', 'poor', 'unusable'][1 + {worst}] AS status, concat_ws(',', {detected}) AS detected
      FROM (SELECT vec_id, {columns} FROM (SELECT *, CAST(500 + m.vec_id * 37 % 2000 AS DOUBLE) AS short_edge,
        perspective, margin, area, candidates, sleeve FROM m JOIN b USING (vec_id) LEFT JOIN (SELECT vec_id, {RATIO} AS perspective,
        {MARGIN} AS margin, {AREA} / (frame_width * frame_height) AS area, CAST(1 + vec_id % 2 AS DOUBLE) AS candidates, 1.0::DOUBLE AS sleeve
        FROM quads_v WHERE vec_id % 5 <> 0) q USING (vec_id)))"""


@query("k_decided_without_glare", "pixels_v quads_v", _gate_sql())
def _(spark, sf_dir):
    judged = quality.assess(_measured(spark, sf_dir).withColumn("glare", F.lit(0.0)))
    detected = F.filter("findings", lambda f: f["verdict"] == "detected")
    return judged.select(
        "vec_id",
        F.round("score", 9).alias("score"),
        "status",
        F.array_join(F.transform(detected, lambda f: F.concat(f["condition"], F.lit("="), f["severity"])), ",").alias("detected"),
    )


@query(
    "k_analysis_verdict",
    "images_v",
    """SELECT analysis_id, ['good', 'acceptable', 'poor', 'unusable'][1 + max(n_chars % 4)] AS status, max(n_chars % 4) <> 3 AS normalise
      FROM images_v GROUP BY 1""",
)
def _(spark, sf_dir):
    status = F.element_at(F.array(*map(F.lit, quality.SEVERITIES)), (F.col("n_chars") % 4 + 1).cast("int"))
    rows = V.images(spark, sf_dir).groupBy("analysis_id").agg(quality.worst_status(status).alias("status"))
    return rows.select("analysis_id", "status", (F.col("status") != "unusable").alias("normalise"))


_EDGES = " UNION ALL ".join(
    [*(f"SELECT '{a}' AS f, '{b}' AS t" for a, b in workflow.FORWARD.items()), *(f"SELECT '{a}', 'failed'" for a in workflow.FORWARD)]
)


@query(
    "s_transitions", "analyses_v", f"SELECT id, status, t AS to_status FROM analyses_v JOIN ({_EDGES}) ON f = status"
)
def _(spark, sf_dir):
    return V.analyses(spark, sf_dir).select("id", "status", F.explode(workflow.successors(F.col("status"))).alias("to_status"))


@query(
    "s_predecessors",
    "requests_v",
    f"""SELECT event_id, target, coalesce(string_agg(f, ',' ORDER BY f), '') AS predecessors FROM requests_v LEFT JOIN ({_EDGES}) ON t = target GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    return V.requests(spark, sf_dir).select("event_id", "target", F.array_join(workflow.predecessors(F.col("target")), ",").alias("predecessors"))


@query(
    "s_conditional_update",
    "analyses_v requests_v",
    f"""SELECT id, event_id, target AS status, CASE WHEN target IN ('completed', 'failed') THEN ts END AS completed_at FROM (
      SELECT a.id, r.event_id, r.target, r.ts, row_number() OVER (PARTITION BY a.id ORDER BY r.ts, r.event_id) AS rn
      FROM analyses_v a JOIN ({_EDGES}) e ON e.f = a.status JOIN requests_v r ON r.analysis_id = a.id AND r.target = e.t) WHERE rn = 1""",
)
def _(spark, sf_dir):
    return workflow.apply_requests(V.analyses(spark, sf_dir), V.requests(spark, sf_dir))


@query(
    "s_replay",
    "requests_v",
    f"""SELECT analysis_id, s.status AS status, s.applied AS applied, n AS requests FROM (
      SELECT r.analysis_id, n, list_reduce([struct_pack(status := 'created', applied := 0)] || list_transform(seq, lambda t: struct_pack(status := t, applied := 0)),
        lambda acc, x: CASE WHEN list_contains([{', '.join(f"'{a}>{b}'" for a, b in workflow.FORWARD.items())}], acc.status || '>' || x.status)
          THEN struct_pack(status := x.status, applied := acc.applied + 1) ELSE acc END) AS s
      FROM (SELECT analysis_id, count(*) AS n, list(target ORDER BY ts, event_id) AS seq FROM requests_v GROUP BY 1) r)""",
)
def _(spark, sf_dir):
    return workflow.replay(V.requests(spark, sf_dir))


@query(
    "l_fixed_windows",
    "",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS s FROM events),
      w(user_id, opened) AS (
        SELECT user_id, min(s) FROM e GROUP BY user_id
        UNION ALL
        SELECT e.user_id, min(e.s) FROM w JOIN e ON e.user_id = w.user_id AND e.s >= w.opened + 21600 GROUP BY e.user_id),
      o AS (SELECT e.user_id, e.event_id, e.s, w.opened FROM e ASOF JOIN w ON e.user_id = w.user_id AND e.s >= w.opened),
      p AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id, opened ORDER BY s, event_id) AS INTEGER) AS place FROM o)
      SELECT user_id, event_id, place, place <= 2 AS allowed,
        CASE WHEN place > 2 THEN greatest(1, CAST(ceil(opened + 21600 - s) AS BIGINT)) END AS retry_after FROM p""",
)
def _(spark, sf_dir):
    return workflow.rate_windows(V.read(spark, sf_dir, "events"), 2, 6 * 3600)


@query(
    "s_ready_uploads",
    "analyses_v images_v",
    """SELECT a.id, a.status, CASE WHEN a.status = 'created' AND n > 0 THEN 'uploading' WHEN a.status = 'uploading' AND n = 2 THEN 'uploaded' ELSE a.status END AS next
      FROM analyses_v a JOIN (SELECT analysis_id, count(*) AS n FROM images_v GROUP BY 1) i ON i.analysis_id = a.id""",
)
def _(spark, sf_dir):
    sides = V.images(spark, sf_dir).groupBy("analysis_id").agg(F.count("*").alias("n"))
    rows = V.analyses(spark, sf_dir).join(sides, F.col("id") == F.col("analysis_id"))
    step = F.when((F.col("status") == "created") & (F.col("n") > 0), "uploading")
    step = step.when((F.col("status") == "uploading") & (F.col("n") == 2), "uploaded").otherwise(F.col("status"))
    return rows.select("id", "status", step.alias("next"))


def _load() -> None:
    """Registers the queries of the other modules, which need this one first."""
    from larkspur.plans import details, more, pictures, tables  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the card search: joined, filtered, in total order, with the number of all matches."""
    return _QUERIES["q_search_name"][0](spark, sf_dir)


def queries() -> dict[str, Query]:
    _load()
    return {name: fn for name, (fn, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: sql or LATER_SQL[name] for name, (_, sql) in _QUERIES.items() if sql or name in LATER_SQL}
