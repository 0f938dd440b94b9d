"""Queries over whole records, stored checks, distributions, money, findings and what clients show."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import geometry as G
from larkspur.functions import labels as L
from larkspur.functions import upstream as U
from larkspur.operators import catalog, image_bytes, quality, rules, workflow
from larkspur.plans import registry
from larkspur.plans.more import _payloads
from larkspur.plans.registry import CATALOG, _uuid_sql, query
from larkspur.sources import views as V

# -- whole records of an upstream payload


def _upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card payloads with what their records need besides: language, rarity and provenance."""
    more = V.read(spark, sf_dir, "part").select(
        F.concat(F.lit("u-"), F.col("p_partkey").cast("string")).alias("id"),
        F.when(F.col("p_partkey") % 2 == 0, "en").otherwise("ja").alias("language"),
        F.when(F.col("p_size") >= 40, "Rare").alias("rarity"),
        F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).alias("illustrator"),
        F.when(F.col("p_partkey") % 5 == 0, F.array("p_size", "p_partkey")).alias("dexId"),
    )
    return _payloads(spark, sf_dir).join(more, "id")


_SLUGS = """(SELECT id, p_partkey, slugs, language, code, number, p_name, rarity, meta, k FROM (SELECT *, 'u-' || p_partkey AS id, p_partkey % 3 AS k,
    CASE WHEN p_partkey % 2 = 0 THEN 'en' ELSE 'ja' END AS language, CASE WHEN p_partkey % 4 = 1 THEN 'ABC' ELSE lower(p_brand) END AS code,
    lpad(CAST(p_size AS VARCHAR), 3, '0') || CASE WHEN p_partkey % 3 = 1 THEN '/102' ELSE '' END AS number, CASE WHEN p_size >= 40 THEN 'Rare' END AS rarity,
    concat_ws(';', CASE WHEN p_partkey % 5 = 0 THEN 'dex_id=[' || p_size || ',' || p_partkey || ']' END, CASE WHEN p_partkey % 3 = 0 THEN 'illustrator=' || p_type END, 'upstream_id=u-' || p_partkey) AS meta,
    CASE WHEN p_partkey % 3 <> 0 THEN [{one}, {two}] WHEN len({flags}) > 0 THEN {flags} ELSE [NULL] END AS slugs FROM part))"""


def _records_sql(select: str) -> str:
    from larkspur.plans.more import _FLAGS, _ONE, _TWO

    label = "'tpch/' || language || '/' || code || '/' || number || '/' || coalesce(slugs[place], '')"
    return f"""WITH s AS {_SLUGS.format(one=_ONE, two=_TWO, flags=_FLAGS)}, r AS (SELECT *, {label} AS label, {_uuid_sql(label)} AS card_id,
      {_uuid_sql("'tpch/' || language || '/' || code")} AS set_id FROM s, LATERAL (SELECT unnest(range(1, len(slugs) + 1)) AS place)) {select}"""


def _pairs(m):
    return F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")


@query(
    "f_card_records",
    "",
    _records_sql(
        """SELECT card_id AS id, set_id, 'tpch' AS game, language, code AS set_code, number AS card_number, p_name AS name, rarity, slugs[place] AS variant, meta AS metadata FROM r"""
    ),
)
def _(spark, sf_dir):
    cards = U.card_records(_upstream(spark, sf_dir), "tpch", "feed")[0]
    return cards.withColumn("metadata", _pairs(F.col("metadata")))


@query(
    "f_card_record_ids",
    "",
    _records_sql(
        """SELECT card_id, 'feed' AS provider, id AS external_id, CASE WHEN k = 0 THEN '' WHEN k = 2 AND place = 2 THEN 'variant_id=v3-' || p_partkey
          ELSE 'variant_id=v' || place || '-' || p_partkey END AS metadata FROM r"""
    ),
)
def _(spark, sf_dir):
    ids = U.card_records(_upstream(spark, sf_dir), "tpch", "feed")[1]
    return ids.withColumn("metadata", _pairs(F.col("metadata")))


def _set_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.substring("p_brand", 7, 4).cast("int")
    brands = V.read(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("total"), F.max("p_size").alias("official"))
    return brands.select(
        F.lower("p_brand").alias("id"), F.when(number % 2 == 0, "en").otherwise("ja").alias("language"),
        F.when(number % 3 == 0, F.upper("p_brand")).when(number % 3 == 1, "").alias("abbreviation"), F.concat(F.lit("Set "), "p_brand").alias("name"),
        F.when(number % 4 == 0, "").when(number % 4 == 1, "1999-01-09").alias("releaseDate"),
        F.when(number % 5 == 0, F.struct(F.lit("s1").alias("id"))).alias("serie"), F.struct("official", "total").alias("cardCount"),
    )


_SET_ROWS = f"""(SELECT {_uuid_sql("'tpch/' || language || '/' || code")} AS id, 'tpch' AS game, language, code AS set_code, 'Set ' || p_brand AS name,
    CASE WHEN b % 4 = 1 THEN DATE '1999-01-09' END AS release_date, concat_ws(';', 'card_count=' || chr(123) || '"official":' || official || ',"total":' || total || '}}',
    CASE WHEN b % 5 = 0 THEN 'serie=' || chr(123) || '"id":"s1"}}' END, 'upstream_id=' || lower(p_brand)) AS metadata
  FROM (SELECT *, CASE WHEN b % 2 = 0 THEN 'en' ELSE 'ja' END AS language, CASE WHEN b % 3 = 0 THEN upper(p_brand) ELSE lower(p_brand) END AS code
    FROM (SELECT p_brand, CAST(substring(p_brand, 7, 4) AS INT) AS b, count(*) AS total, max(p_size) AS official FROM part GROUP BY 1, 2)))"""


@query("f_set_records", "", f"SELECT * FROM {_SET_ROWS}")
def _(spark, sf_dir):
    return U.set_records(_set_payloads(spark, sf_dir), "tpch").withColumn("metadata", _pairs(F.col("metadata")))


@query(
    "q_card_with_set",
    CATALOG + " external_ids_v",
    f""", s AS {_SET_ROWS}, i AS (SELECT card_id, string_agg(provider || '=' || external_id, ';' ORDER BY provider, external_id) AS ids FROM external_ids_v GROUP BY 1)
      SELECT c.id, c.name, c.card_number, s.game, s.language, s.set_code, s.id AS set_id, s.name AS set_name, s.release_date, s.metadata AS set_metadata, coalesce(ids, '') AS ids
      FROM cards_v c JOIN s ON s.name = 'Set ' || c.set_code LEFT JOIN i ON i.card_id = c.id""",
)
def _(spark, sf_dir):
    sets = U.set_records(_set_payloads(spark, sf_dir), "tpch").withColumn("metadata", _pairs(F.col("metadata")))
    cards = V.cards(spark, sf_dir).join(sets.select(F.col("id").alias("set_id"), F.col("name").alias("of")), F.concat(F.lit("Set "), "set_code") == F.col("of"))
    repeated = V.external_ids(spark, sf_dir)
    found = catalog.card_detail(cards.drop("of"), sets, repeated.unionByName(repeated.where("card_id % 2 = 0")))
    label = F.transform("external_ids", lambda e: F.concat(e["provider"], F.lit("="), e["external_id"]))
    return found.select(
        "id", "name", "card_number", "game", "language", "set_code", "set_id", "set_name", "release_date", "set_metadata", F.array_join(label, ";").alias("ids")
    )


# -- sessions and analyses

_AS_OF = registry.AS_OF


@query(
    "q_session_by_token",
    "sessions_v",
    f"""SELECT p.token, s.id AS session_id FROM (SELECT DISTINCT CASE WHEN o_custkey % 4 = 0 THEN 'none-' || o_custkey ELSE 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS token FROM orders) p
      LEFT JOIN sessions_v s ON s.token = p.token AND status = 'active' AND expires_at_s > {_AS_OF}""",
)
def _(spark, sf_dir):
    key = F.col("o_custkey").cast("string")
    token = F.when(F.col("o_custkey") % 4 == 0, F.concat(F.lit("none-"), key)).otherwise(F.concat(F.lit("Customer#"), F.lpad(key, 9, "0")))
    presented = V.read(spark, sf_dir, "orders").select(token.alias("token")).distinct()
    return workflow.resolve_sessions(V.sessions(spark, sf_dir).withColumnRenamed("expires_at_s", "expires_at"), presented, F.lit(_AS_OF))


@query(
    "s_opened_sessions",
    "",
    f"""SELECT {_uuid_sql(f"'session/' || c_name || '/{_AS_OF}'")} AS id, c_name AS token, 'active' AS status, CAST({_AS_OF} AS BIGINT) AS created_at,
      CAST({_AS_OF + workflow.TTL_SECONDS} AS BIGINT) AS expires_at, '1.2.0' AS application_version FROM customer""",
)
def _(spark, sf_dir):
    return workflow.open_sessions(V.read(spark, sf_dir, "customer").select(F.col("c_name").alias("token")), F.lit(_AS_OF), "1.2.0")


@query(
    "w_opened_analyses",
    "sessions_v",
    f"""SELECT {_uuid_sql(f"'analysis/' || id || '/{_AS_OF}'")} AS id, id AS session_id, 'created' AS status, CAST({_AS_OF} AS BIGINT) AS created_at,
      CAST(NULL AS BIGINT) AS completed_at, CAST(NULL AS VARCHAR) AS card_id FROM sessions_v WHERE status = 'active' AND expires_at_s > {_AS_OF}""",
)
def _(spark, sf_dir):
    live = V.sessions(spark, sf_dir).where(f"status = 'active' and expires_at_s > {_AS_OF}")
    return workflow.open_analyses(live, F.lit(_AS_OF))


@query(
    "q_side_keys",
    "images_v",
    """SELECT analysis_id, max('k/' || id) FILTER (side = 'front') AS front, max('k/' || id) FILTER (side = 'back') AS back, count(*) AS n FROM images_v GROUP BY 1""",
)
def _(spark, sf_dir):
    images = V.images(spark, sf_dir).select("analysis_id", "side", F.concat(F.lit("k/"), F.col("id").cast("string")).alias("key"))
    found = workflow.side_keys(images)
    return found.select("analysis_id", *(F.try_element_at("keys", F.lit(s)).alias(s) for s in ("front", "back")), F.size("keys").cast("long").alias("n"))


_QUALITY = "['good', 'acceptable', 'poor', 'unusable'][1 + n_chars % 4]"


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, quality.SEVERITIES)), (F.col("n_chars") % 4 + 1).cast("int"))
    return V.images(spark, sf_dir).select("analysis_id", "side", status.alias("quality_status"), (F.col("n_chars") % 101 / 100).alias("quality_score"), "body")


@query(
    "q_image_verdicts",
    "images_v",
    f"""SELECT analysis_id, string_agg(side || ':' || {_QUALITY} || ':' || CAST(n_chars % 101 / 100.0::DOUBLE AS VARCHAR), ' ' ORDER BY side) AS verdicts FROM images_v GROUP BY 1""",
)
def _(spark, sf_dir):
    label = F.transform("verdicts", lambda v: F.concat_ws(":", v["side"], v["quality_status"], v["quality_score"].cast("string")))
    return workflow.image_verdicts(_verdicts(spark, sf_dir)).select("analysis_id", F.array_join(label, " ").alias("verdicts"))


@query(
    "s_reproducibility",
    "analyses_v images_v",
    """SELECT a.id, CASE WHEN status <> 'created' THEN '1.2.0' END AS application_version, CASE WHEN status <> 'created' THEN 'cards-v' || a.id % 3 || '.0.0' END AS card_database_version,
      coalesce(string_agg(side || '=' || sha256(body), ';' ORDER BY side), '') AS image_sha256 FROM analyses_v a LEFT JOIN images_v i ON i.analysis_id = a.id GROUP BY a.id, a.status""",
)
def _(spark, sf_dir):
    begun = F.col("status") != "created"
    own = V.analyses(spark, sf_dir).select(
        "id", F.when(begun, "1.2.0").alias("application_version"),
        F.when(begun, F.concat(F.lit("cards-v"), (F.col("id") % 3).cast("string"), F.lit(".0.0"))).alias("card_database_version"),
    )
    images = V.images(spark, sf_dir).select("analysis_id", "side", F.sha2(F.col("body").cast("binary"), 256).alias("sha256"))
    return workflow.reproducibility(own, images).withColumn("image_sha256", _pairs(F.col("image_sha256")))


# -- stored checks


def _names(broken: DataFrame, *columns: str) -> DataFrame:
    return broken.select(*columns, F.array_join("violations", ",").alias("violations"))


@query(
    "w_image_checks",
    "images_v",
    r"""SELECT id, concat_ws(',', CASE WHEN side NOT IN ('front', 'back', 'angled_front', 'angled_back', 'surface_front', 'surface_back') THEN 'side_is_a_known_side' END,
      CASE WHEN q NOT IN ('good', 'acceptable', 'poor', 'unusable') THEN 'quality_status_is_a_known_status' END, CASE WHEN w <= 0 OR h <= 0 THEN 'dimensions_are_positive' END,
      CASE WHEN s < 0 OR s > 1 THEN 'quality_score_is_a_unit_interval' END, CASE WHEN NOT regexp_full_match(d, '[0-9a-f]{64}') THEN 'sha256_is_lowercase_hex' END) AS violations
      FROM (SELECT id, CASE n_chars % 5 WHEN 0 THEN 'top' WHEN 1 THEN 'angled_back' ELSE side END AS side, CASE n_chars % 7 WHEN 0 THEN 'fine' WHEN 1 THEN NULL ELSE 'poor' END AS q,
        CASE WHEN n_chars % 3 = 0 THEN NULL ELSE n_chars % 11 END AS w, n_chars % 13 - 1 AS h, CASE WHEN n_chars % 4 = 0 THEN NULL ELSE n_chars % 103 / 100.0::DOUBLE END AS s,
        CASE n_chars % 6 WHEN 0 THEN upper(sha256(body)) WHEN 1 THEN sha256(body) || chr(10) ELSE sha256(body) END AS d FROM images_v)""",
)
def _(spark, sf_dir):
    n, digest = F.col("n_chars"), F.sha2(F.col("body").cast("binary"), 256)
    none = F.lit(None)
    rows = V.images(spark, sf_dir).select(
        "id", F.when(n % 5 == 0, "top").when(n % 5 == 1, "angled_back").otherwise(F.col("side")).alias("side"),
        F.when(n % 7 == 0, "fine").when(n % 7 == 1, none).otherwise("poor").alias("quality_status"),
        F.when(n % 3 != 0, n % 11).alias("width"), (n % 13 - 1).alias("height"), F.when(n % 4 != 0, n % 103 / 100).alias("quality_score"),
        F.when(n % 6 == 0, F.upper(digest)).when(n % 6 == 1, F.concat(digest, F.lit("\n"))).otherwise(digest).alias("sha256"),
    )
    return _names(rules.violations(rows, rules.image_checks(quality.SEVERITIES)), "id")


@query(
    "w_workflow_checks",
    "sessions_v analyses_v",
    f"""SELECT a.id, CASE WHEN s.expires_at_s <= {_AS_OF} THEN 'expires_after_it_was_created' ELSE '' END AS session, concat_ws(',', CASE WHEN a.status = 'calculating' THEN 'status_is_a_known_analysis_state' END,
      CASE WHEN a.id % 2 = 0 AND a.status NOT IN ('completed', 'failed') THEN 'completed_at_accompanies_a_terminal_status' END) AS analysis FROM analyses_v a JOIN sessions_v s ON s.id = a.session_id""",
)
def _(spark, sf_dir):
    """Sessions as of a time after some of them are over; analyses of which one state isn't known any more."""
    sessions = V.sessions(spark, sf_dir).select("id", "status", F.col("expires_at_s").alias("expires_at"), F.lit(_AS_OF).alias("created_at"))
    own = _names(rules.violations(sessions, rules.session_checks()), "id").select(F.col("id").alias("session_id"), F.col("violations").alias("session"))
    rows = V.analyses(spark, sf_dir).withColumn("completed_at", F.when(F.col("id") % 2 == 0, 1))
    known = tuple(s for s in workflow.STATUSES if s != "calculating")
    broken = _names(rules.violations(rows, rules.analysis_checks(known, workflow.TERMINAL)), "id", "session_id")
    return broken.join(own, "session_id").select("id", "session", F.col("violations").alias("analysis"))


@query(
    "w_version_checks",
    "versions_v",
    """SELECT version, CASE WHEN set_count - 20 < 0 OR card_count - 200 < 0 THEN 'counts_are_not_negative' ELSE '' END AS violations FROM versions_v""",
)
def _(spark, sf_dir):
    rows = V.versions(spark, sf_dir).select("version", (F.col("set_count") - 20).alias("set_count"), (F.col("card_count") - 200).alias("card_count"), F.lit(0).alias("external_id_count"))
    return _names(rules.violations(rows, rules.version_checks()), "version")


@query(
    "v_detection_thresholds",
    "",
    """SELECT p_partkey, concat_ws(',', CASE WHEN p_size - 5 <= 0 THEN 'work_long_edge' END, CASE WHEN r <= 0 OR r > 1 THEN 'min_rectangularity' END, CASE WHEN e <= 0 OR e >= 1 THEN 'approx_epsilon' END,
      CASE WHEN p_size % 8 - 1 <= 0 THEN 'sleeve_min_margin' END, CASE WHEN NOT (lo > 0 AND lo < 0.92) THEN 'area fraction' END, CASE WHEN NOT (0.45 < hi) THEN 'aspect' END, CASE WHEN NOT 1 < s THEN 'sleeve ratio' END) AS violations
      FROM (SELECT *, (p_partkey % 12 - 1) / 10.0::DOUBLE AS r, (p_partkey % 52) / 50.0::DOUBLE AS e, (p_size - 10) / 40.0::DOUBLE AS lo, p_size / 50.0::DOUBLE AS hi, p_size / 25.0::DOUBLE AS s FROM part)""",
)
def _(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    rows = V.read(spark, sf_dir, "part").select(
        "p_partkey", (size - 5).alias("work_long_edge"), ((key % 12 - 1) / 10).alias("min_rectangularity"), (key % 52 / 50).alias("approx_epsilon"),
        (size % 8 - 1).alias("sleeve_min_margin"), ((size - 10) / 40).alias("min_area_fraction"), F.lit(0.92).alias("max_area_fraction"),
        F.lit(0.45).alias("min_aspect"), (size / 50).alias("max_aspect"), (size / 25).alias("sleeve_max_ratio"),
    )
    return _names(rules.violations(rows, rules.detection_threshold_checks()), "p_partkey")


@query(
    "v_frame_geometry",
    "quads_v",
    f"""SELECT vec_id, CASE WHEN vec_id % 6 IN (0, 1) THEN false ELSE {' AND '.join(f'{registry._cross(i)} > 0' for i in range(1, 5))} END AS ok FROM quads_v""",
)
def _(spark, sf_dir):
    """Corners of which some are no number or without end."""
    odd = F.when(F.col("vec_id") % 6 == 0, float("nan")).when(F.col("vec_id") % 6 == 1, float("inf")).otherwise(F.col("x3"))
    at = lambda i: F.struct((odd if i == 2 else F.col(G.X[i])).alias("x"), F.col(G.Y[i]).alias("y"))
    return V.quads(spark, sf_dir).select("vec_id", rules.is_frame_geometry(F.array(*map(at, range(4)))).alias("ok"))


# -- distributions and money

_GRADES = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN ['10', '9.0', '8.50'] WHEN '2' THEN ['9', '9.5', '7_or_lower'] WHEN '3' THEN ['9', '9.0', '8'] WHEN '4' THEN ['9.46', '10_or_higher', '5'] ELSE [] END"
_SHARES = "[0.5::DOUBLE, 0.3::DOUBLE, CASE o_orderkey % 4 WHEN 0 THEN 0.2::DOUBLE WHEN 1 THEN 0.2000001::DOUBLE WHEN 2 THEN -0.1::DOUBLE ELSE 0.3::DOUBLE END]"
_VALUE = "CAST(regexp_extract(g, '^[0-9.]+') AS DECIMAL(6, 3))"


def _distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, letter = F.col("o_orderkey"), F.substring("o_orderpriority", 1, 1)
    lists = {"1": ("10", "9.0", "8.50"), "2": ("9", "9.5", "7_or_lower"), "3": ("9", "9.0", "8"), "4": ("9.46", "10_or_higher", "5")}
    grades = F.array().cast("array<string>")
    chosen = None
    for k, own in lists.items():
        value = F.array(*map(F.lit, own))
        chosen = F.when(letter == k, value) if chosen is None else chosen.when(letter == k, value)
    last = F.when(key % 4 == 0, 0.2).when(key % 4 == 1, 0.2000001).when(key % 4 == 2, -0.1).otherwise(0.3)
    grades = chosen.otherwise(grades)
    shares = F.slice(F.array(F.lit(0.5), F.lit(0.3), last), F.lit(1), F.size(grades))
    return V.read(spark, sf_dir, "orders").select("o_orderkey", F.map_from_arrays(grades, shares).alias("m"))


_TERMS = f"""SELECT o_orderkey, i, g, [0.5, 0.3][i] AS d, {_SHARES}[i] AS p FROM (SELECT o_orderkey, o_orderpriority, unnest({_GRADES}) AS g, generate_subscripts({_GRADES}, 1) AS i FROM orders)"""
_GRADE_OK = f"regexp_full_match(g, '[0-9]+(\\.[0-9]+)?(_or_(lower|higher))?') AND {_VALUE} <= 10 AND ({_VALUE} * 2) % 1 = 0"
_CANON = f"CASE WHEN {_GRADE_OK} THEN CASE WHEN {_VALUE} % 1 = 0 THEN CAST(CAST({_VALUE} AS INT) AS VARCHAR) ELSE CAST(CAST({_VALUE} AS DECIMAL(4, 1)) AS VARCHAR) END || regexp_extract(g, '_or_[a-z]+$') END"


@query(
    "d_distribution_terms",
    "",
    f"""SELECT o_orderkey, coalesce(string_agg(c || '=' || p, ' ' ORDER BY v, b, c) FILTER (c IS NOT NULL), '') AS terms FROM orders LEFT JOIN (SELECT o_orderkey, p, {_CANON} AS c, {_VALUE} AS v,
      CASE WHEN g LIKE '%lower' THEN -1 WHEN g LIKE '%higher' THEN 1 ELSE 0 END AS b FROM ({_TERMS})) USING (o_orderkey)
      WHERE substr(o_orderpriority, 1, 1) <> '3' GROUP BY 1""",
)
def _(spark, sf_dir):
    rows = _distributions(spark, sf_dir).join(V.read(spark, sf_dir, "orders").where("substr(o_orderpriority, 1, 1) <> '3'").select("o_orderkey"), "o_orderkey")
    label = F.transform(F.filter(rules.distribution_terms(F.col("m")), lambda t: t["grade"].isNotNull()), lambda t: F.concat(t["grade"], F.lit("="), t["p"].cast("string")))
    return rows.select("o_orderkey", F.array_join(label, " ").alias("terms"))


@query(
    "v_distribution_checks",
    "",
    f"""SELECT o_orderkey, concat_ws(',', CASE WHEN count(g) = 0 THEN 'empty' END, CASE WHEN bool_or(c IS NULL AND g IS NOT NULL) THEN 'grade' END, CASE WHEN count(c) > count(DISTINCT c) THEN 'twice' END,
      CASE WHEN bool_or(p < 0 OR p > 1) THEN 'probability' END, CASE WHEN abs(coalesce(sum(p), 0) - 1) > 1e-6 THEN 'total' END) AS violations
      FROM orders LEFT JOIN (SELECT *, {_CANON} AS c FROM ({_TERMS})) USING (o_orderkey) GROUP BY 1""",
)
def _(spark, sf_dir):
    rows = _distributions(spark, sf_dir)
    return _names(rules.violations(rows, rules.distribution_checks(F.col("m"))), "o_orderkey")


@query(
    "d_money_arithmetic",
    "",
    """SELECT l_orderkey, l_linenumber, CASE WHEN same THEN CAST(a + b AS VARCHAR) END AS total, CAST(-a AS VARCHAR) AS negated, CASE WHEN same THEN a < b END AS less,
      CAST(CAST(CASE WHEN a >= 0 THEN floor(a * r * 100 + 0.5) ELSE -floor(-a * r * 100 + 0.5) END / 100 AS DECIMAL(18, 2)) AS VARCHAR) AS fee
      FROM (SELECT l_orderkey, l_linenumber, l_linenumber % 4 <> 0 AS same, CAST(l_extendedprice AS DECIMAL(18, 2)) AS a, CAST(l_quantity * 1000 AS DECIMAL(18, 2)) AS b, CAST(l_tax AS DECIMAL(10, 6)) + 0.0005 AS r FROM lineitem)""",
)
def _(spark, sf_dir):
    a = rules.money(F.col("l_extendedprice"), F.lit("USD"))
    b = rules.money(F.col("l_quantity") * 1000, F.when(F.col("l_linenumber") % 4 == 0, "EUR").otherwise("USD"))
    rows = V.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", a.alias("a"), b.alias("b"), (F.col("l_tax").cast("decimal(10,6)") + F.lit("0.0005").cast("decimal(10,6)")).alias("r"))
    text = lambda m: m["amount"].cast("string")
    x, y = F.col("a"), F.col("b")
    return rows.select(
        "l_orderkey", "l_linenumber", text(rules.money_sum(x, y)).alias("total"), text(rules.money_negated(x)).alias("negated"),
        rules.money_less(x, y).alias("less"), text(rules.money_scaled(x, F.col("r"))).alias("fee"),
    )


# -- geometry

_TURN = "{0} + {2} > {1} + {3}".format(*(registry._side(i) for i in range(1, 5)))


@query(
    "g_sides",
    "quads_v",
    "SELECT vec_id, " + ", ".join(f"round({registry._side(i)}, 6) AS {n}" for i, n in enumerate(("top", "right_side", "bottom", "left_side"), 1)) + " FROM quads_v",
)
def _(spark, sf_dir):
    return V.quads(spark, sf_dir).select("vec_id", *(F.round(G.side(i), 6).alias(n) for i, n in enumerate(("top", "right_side", "bottom", "left_side"))))


@query(
    "g_turned_corners",
    "quads_v",
    f"SELECT vec_id, {_TURN} AS turned, " + ", ".join(f"round(CASE WHEN {_TURN} THEN {c}{i % 4 + 1} ELSE {c}{i} END, 6) AS {c}{i}" for i in range(1, 5) for c in "xy") + " FROM quads_v",
)
def _(spark, sf_dir):
    columns = [F.round(c, 6).alias(f"{'xy'[k % 2]}{k // 2 + 1}") for k, c in enumerate(G.quarter_turned())]
    return V.quads(spark, sf_dir).select("vec_id", G.short_edge_first().alias("turned"), *columns)


# -- findings and what is said of them


def _measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements of images, for a third of which no card was located."""
    n = F.col("n_chars")
    located = n % 3 != 0
    geometric = {"perspective": 1 + n % 60 / 100, "margin": n % 30 / 1000, "candidates": (1 + n % 2).cast("double"), "sleeve": 1 + n % 120 / 100, "area": n % 50 / 100}
    plain = {"blur": (n % 600).cast("double"), "short_edge": (500 + n % 1800).cast("double"), "glare": n % 40 / 1000, "exposure": (n % 220).cast("double"), "brightness": (n % 250).cast("double")}
    reason = F.when(n % 9 == 0, "  too dark to see ").when(n % 9 == 3, " ")
    return V.images(spark, sf_dir).select(
        "id", "analysis_id", *(c.alias(k) for k, c in plain.items()), *(F.when(located, c).alias(k) for k, c in geometric.items()), located.alias("located"), reason.alias("why")
    )


_MEASURED = """(SELECT id, (n_chars % 600)::DOUBLE AS blur, (500 + n_chars % 1800)::DOUBLE AS short_edge, n_chars % 40 / 1000.0::DOUBLE AS glare, (n_chars % 220)::DOUBLE AS exposure, (n_chars % 250)::DOUBLE AS brightness,
  CASE WHEN l THEN 1 + n_chars % 60 / 100.0::DOUBLE END AS perspective, CASE WHEN l THEN n_chars % 30 / 1000.0::DOUBLE END AS margin, CASE WHEN l THEN (1 + n_chars % 2)::DOUBLE END AS candidates,
  CASE WHEN l THEN 1 + n_chars % 120 / 100.0::DOUBLE END AS sleeve, CASE WHEN l THEN n_chars % 50 / 100.0::DOUBLE END AS area, l,
  CASE WHEN n_chars % 9 = 0 THEN 'too dark to see' ELSE 'the card has not been located in the photograph' END AS why FROM (SELECT *, n_chars % 3 <> 0 AS l FROM images_v))"""


def _severity_sql(m: str, u: float, p: float, i: float) -> str:
    worse = "<=" if p < i else ">="
    return f"CASE WHEN {m} {worse} {u} THEN 'unusable' WHEN {m} {worse} {p} THEN 'poor' END"


_FINDINGS_SQL = " UNION ALL ".join(
    f"SELECT id, {k} AS k, '{name}' AS condition, {m} AS measurement, {_severity_sql(m, u, p, i)} AS severity, why, l FROM f" for k, (name, m, u, p, i) in enumerate(quality.CONDITIONS)
)


@query(
    "k_findings",
    "images_v",
    f""", f AS {_MEASURED}, g AS ({_FINDINGS_SQL}) SELECT id, condition, CASE WHEN measurement IS NULL THEN 'undetermined' WHEN severity IS NULL THEN 'clear' ELSE 'detected' END AS verdict,
      severity, measurement, CASE WHEN measurement IS NULL THEN why END AS reason FROM g""",
)
def _(spark, sf_dir):
    rows = _measurements(spark, sf_dir)
    return rows.select("id", F.inline(quality.detailed_findings(F.col("why"))))


_SAID = "CASE condition " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in quality.FAULTS.items()) + " END"


@query(
    "k_faults",
    "images_v",
    f""", f AS {_MEASURED}, g AS ({_FINDINGS_SQL}) SELECT id, coalesce(string_agg({_SAID}, ' ' ORDER BY k) FILTER (severity IS NOT NULL), '') AS faults,
      any_value(l) AND NOT bool_or(coalesce(severity = 'unusable', false)) AS straightened FROM g GROUP BY 1""",
)
def _(spark, sf_dir):
    """What a client says is wrong with each picture, and whether it is straightened."""
    rows = _measurements(spark, sf_dir).withColumn("found", quality.detailed_findings(F.col("why")))
    unusable = F.exists("found", lambda f: F.coalesce(f["severity"] == "unusable", F.lit(False)))
    status = F.when(unusable, "unusable").otherwise("good")
    return rows.select("id", F.array_join(quality.faults(F.col("found")), " ").alias("faults"), quality.is_straightened(F.col("located"), status).alias("straightened"))


@query(
    "f_shown_values",
    "",
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '2024-01-31' ELSE 'release date not recorded' END AS released,
      CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN 'true' WHEN 3 THEN '—' WHEN 4 THEN '[' || p_size || ',"a"]' ELSE chr(123) || '"k":' || p_size || '}' END AS shown,
      CASE WHEN p_partkey % 2 = 0 AND p_size BETWEEN 5 AND 45 THEN 'measured' ELSE 'unknown' END AS state,
      CASE WHEN p_partkey % 2 = 0 AND p_size BETWEEN 5 AND 45 THEN CAST(floor((p_size - 5) / 40.0::DOUBLE * 100 + 0.5) AS BIGINT) || '%' ELSE 'Not measured' END AS label,
      CASE p_partkey % 7 WHEN 0 THEN p_size WHEN 1 THEN p_size WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN 0 WHEN 5 THEN p_size END::DOUBLE AS wait FROM part""",
)
def _(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    text = size.cast("string")
    raw = F.when(key % 6 == 0, F.to_json(F.struct(F.col("p_name").alias("v")))).when(key % 6 == 1, F.concat(F.lit('{"v":'), text, F.lit("}"))).when(key % 6 == 2, '{"v":true}')
    raw = raw.when(key % 6 == 3, '{"v":null}').when(key % 6 == 4, F.concat(F.lit('{"v":['), text, F.lit(',"a"]}'))).otherwise(F.concat(F.lit('{"v":{"k":'), text, F.lit("}}")))
    header = F.when(key % 7 == 0, F.concat(F.lit(" "), text)).when(key % 7 == 1, F.concat(text, F.lit(".9s"))).when(key % 7 == 2, F.concat(F.lit("-"), text))
    header = header.when(key % 7 == 3, "Wed, 21 Oct 2015 07:28:00 GMT").when(key % 7 == 4, "-0").when(key % 7 == 5, F.concat(F.lit("\t+"), text))
    rows = V.read(spark, sf_dir, "part").select("p_partkey", F.try_variant_get(F.parse_json(raw), "$.v", "variant").alias("v"), F.when(size % 3 == 0, "2024-01-31").alias("d"), header.alias("h"), "p_size")
    kind = F.when(F.col("p_partkey") % 2 == 0, "identified").otherwise("insufficient_information")
    told = L.certainty(kind, (F.col("p_size") - 5) / F.lit(40.0))
    return rows.select(
        "p_partkey", L.release_date_label(F.col("d")).alias("released"), L.metadata_label(F.col("v")).alias("shown"), told["state"].alias("state"),
        told["label"].alias("label"), L.read_retry_after(F.col("h")).alias("wait"),
    )


# -- image bytes


@query(
    "b_clean_digests",
    "",
    """SELECT vec_id AS id, vec_id % 4 AS kind, CASE vec_id % 4 WHEN 2 THEN 'undecodable' END AS problem, vec_id % 4 <> 2 AS same FROM embeddings""",
)
def _(spark, sf_dir):
    """PNG files of rasters: as they are, with chunks nobody knows, cut short within the pixels; what is stored is the first's bytes."""
    import struct
    import zlib

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    plain = image_bytes.encode_png(V.rasters(spark, sf_dir))
    unknown = F.lit(bytearray(chunk(b"loCa", b"52.5 13.4") + chunk(b"tEXt", b"Author\0me")))
    start = 8 + 25  # signature and header
    body = F.col("body")
    odd = F.concat(F.substring(body, 1, start), unknown, F.substring(body, start + 1, 1 << 30))
    header = F.concat(F.lit(bytearray(image_bytes.PNG)), F.substring(body, 9, 25))
    short = F.concat(header, F.lit(bytearray(chunk(b"IDAT", zlib.compress(b"\0" * 20)) + chunk(b"IEND", b""))))
    kind = F.col("id") % 4
    given = plain.select("id", F.when(kind == 1, odd).when(kind == 2, short).otherwise(body).alias("body"))
    found = image_bytes.check_images(given).join(plain.select("id", F.sha2("body", 256).alias("want")), "id")
    same = F.coalesce(F.sha2("clean", 256) == F.col("want"), F.lit(False))
    return found.select("id", (F.col("id") % 4).alias("kind"), "problem", same.alias("same"))
