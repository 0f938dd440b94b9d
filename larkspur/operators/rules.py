"""Validation: rules that give a boolean each, and rows that carry the names of those they break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_slug(c: Column) -> Column:
    return c.rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$")


def is_language(c: Column) -> Column:
    return c.rlike("^[a-z]{2}$")


def is_identifier(c: Column) -> Column:
    """Not empty, and no white space at the ends, the information separators U+001C to U+001F among it."""
    return c.rlike(r"(?Us)\A[^\s\x1c-\x1f](.*[^\s\x1c-\x1f])?\z")


def is_version(c: Column) -> Column:
    return c.rlike(r"^[a-z0-9]+(?:-[a-z0-9]+)*-v\d+\.\d+\.\d+$") & ~F.contains(c, F.lit("latest"))


def is_unit(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & c.between(0, 1)


#: Halves from 0 to 10, told by their digits: a cast would round what isn't one.
_GRADE = r"\A0*(10|[0-9])(?:\.([05])0*)?(_or_(?:lower|higher))?\z"


def is_grade_key(c: Column) -> Column:
    return canonical_grade(c).isNotNull()


def canonical_grade(c: Column) -> Column:
    """A grade key in its one spelling, 9.0 as 9 and 9.50 as 9.5; null if it isn't one."""
    whole, half, bound = (F.regexp_extract(c, _GRADE, i) for i in (1, 2, 3))
    return F.when(c.rlike(_GRADE) & ~((whole == "10") & (half == "5")), F.concat(whole, F.when(half == "5", ".5").otherwise(""), bound))


def is_storage_key(c: Column) -> Column:
    """Segments joined by single slashes, each of them led by a letter or digit."""
    segment = "[A-Za-z0-9][A-Za-z0-9._-]*"
    return (F.char_length(c) <= 1024) & c.rlike(rf"\A{segment}(/{segment})*\z")


def is_date(c: Column) -> Column:
    """An ISO date that the calendar has, from the year 1 on."""
    return c.rlike(r"\A\d{4}-\d{2}-\d{2}\z") & ~F.startswith(c, F.lit("0000")) & c.try_cast("date").isNotNull()


def is_count(c: Column) -> Column:
    """A whole number that isn't negative, given as text."""
    return c.rlike(r"\A\d+\z")


def is_same_currency(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b) & a.rlike(r"\A[A-Z]{3}\z")


def is_finding(verdict: Column, severity: Column, reason: Column) -> Column:
    """Poor or unusable if detected, no severity otherwise, and a reason if undetermined: white space is none."""
    graded = F.when(verdict == "detected", F.coalesce(severity.isin("poor", "unusable"), F.lit(False))).otherwise(severity.isNull())
    return graded & ((verdict != "undetermined") | F.coalesce(reason.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False)))


def is_complete(conditions: Column, expected: tuple[str, ...]) -> Column:
    """An array of conditions that has each expected one exactly once."""
    return F.array_sort(conditions) == F.array(*map(F.lit, sorted(expected)))


def is_monotone(unusable: Column, poor: Column, ideal: Column) -> Column:
    return ((unusable < poor) & (poor < ideal)) | ((unusable > poor) & (poor > ideal))


def is_band(low: Column, high: Column, least: float, most: float) -> Column:
    """Limits in order and within what they may be."""
    return (F.lit(least) <= low) & (low < high) & (high <= F.lit(most))


def is_whole_pixels(pixels_per_mm: Column, *millimetres: int) -> Column:
    """Whether a card's sides come to whole numbers of pixels, to a billionth, one at least."""
    sides = [pixels_per_mm * mm for mm in millimetres]
    return F.array_min(F.array(*((F.abs(s - F.bround(s)) <= 1e-9) & (F.bround(s) >= 1) for s in sides)))


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rows with `violations`: the names of the rules that don't hold (a null result doesn't)."""
    broken = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    return rows.withColumn("violations", F.array_compact(F.array(*broken)))


def orphans(rows: DataFrame, parents: DataFrame, on: str) -> DataFrame:
    return rows.join(parents.select(on).distinct(), on, "left_anti")


def _absent_or(c: Column, rule: Column) -> Column:
    return c.isNull() | rule


def version_checks() -> dict[str, Column]:
    """What a stored version of the catalogue must hold."""
    counts = [F.col(c) >= 0 for c in ("set_count", "card_count", "external_id_count")]
    return {"counts_are_not_negative": counts[0] & counts[1] & counts[2]}


def session_checks(statuses: tuple[str, ...] = ("active", "expired")) -> dict[str, Column]:
    return {
        "status_is_a_known_session_state": F.col("status").isin(*statuses),
        "expires_after_it_was_created": F.col("expires_at") > F.col("created_at"),
    }


def analysis_checks(statuses: tuple[str, ...], terminal: tuple[str, ...]) -> dict[str, Column]:
    return {
        "status_is_a_known_analysis_state": F.col("status").isin(*statuses),
        "completed_at_accompanies_a_terminal_status": _absent_or(F.col("completed_at"), F.col("status").isin(*terminal)),
    }


#: Fixed values.
SIDES = ("front", "back", "angled_front", "angled_back", "surface_front", "surface_back")


def image_checks(qualities: tuple[str, ...]) -> dict[str, Column]:
    return {
        "side_is_a_known_side": F.col("side").isin(*SIDES),
        "quality_status_is_a_known_status": _absent_or(F.col("quality_status"), F.col("quality_status").isin(*qualities)),
        "dimensions_are_positive": _absent_or(F.col("width"), F.col("width") > 0) & _absent_or(F.col("height"), F.col("height") > 0),
        "quality_score_is_a_unit_interval": _absent_or(F.col("quality_score"), F.col("quality_score").between(0, 1)),
        "sha256_is_lowercase_hex": F.col("sha256").rlike(r"\A[0-9a-f]{64}\z"),
    }


def detection_threshold_checks() -> dict[str, Column]:
    """What thresholds of the detector must hold; bands are ordered pairs of positive numbers."""
    c = F.col
    band = lambda low, high: (low > 0) & (low < high)
    return {
        "work_long_edge": c("work_long_edge") > 0,
        "min_rectangularity": (c("min_rectangularity") > 0) & (c("min_rectangularity") <= 1),
        "approx_epsilon": (c("approx_epsilon") > 0) & (c("approx_epsilon") < 1),
        "sleeve_min_margin": c("sleeve_min_margin") > 0,
        "area fraction": band(c("min_area_fraction"), c("max_area_fraction")),
        "aspect": band(c("min_aspect"), c("max_aspect")),
        "sleeve ratio": band(F.lit(1.0), c("sleeve_max_ratio")),
    }


def is_frame_geometry(corners: Column) -> Column:
    """Four corners (x, y), all of them finite, convex and clockwise."""
    finite = F.forall(corners, lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]) & (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")))
    at = lambda i: F.get(corners, F.lit(i % 4))

    def turns(i: int) -> Column:
        a, b, c = at(i), at(i + 1), at(i + 2)
        return (b["x"] - a["x"]) * (c["y"] - b["y"]) - (b["y"] - a["y"]) * (c["x"] - b["x"]) > 0

    return (F.size(corners) == 4) & finite & turns(0) & turns(1) & turns(2) & turns(3)


# -- distributions


def grade_order(key: Column) -> Column:
    """What grade keys are sorted by: their value, and a tail before the grade itself, a head after it."""
    bound = F.when(F.endswith(key, F.lit("_or_lower")), -1).when(F.endswith(key, F.lit("_or_higher")), 1).otherwise(0)
    return F.struct(F.regexp_extract(key, r"\A([0-9]+(?:\.[0-9]+)?)", 1).try_cast("decimal(3,1)").alias("value"), bound.alias("bound"))


def likely_grade(key: Column, p: Column) -> Column:
    """An aggregate: the key of the largest probability, of equal ones the highest grade."""
    return F.max_by(key, F.struct(p.alias("p"), grade_order(key).alias("order")))


def is_uncertain(p: Column) -> Column:
    """An aggregate: whether no grade has half of all probability."""
    return F.max(p) < 0.5


def distribution_terms(probabilities: Column) -> Column:
    """The terms of a map of grade keys to probabilities, in order: canonical keys, heads and tails beside their grade."""
    terms = F.transform(F.map_entries(probabilities), lambda e: F.struct(canonical_grade(e["key"]).alias("grade"), e["value"].alias("p")))

    def placed(t: Column) -> Column:
        return F.struct(grade_order(t["grade"]).alias("order"), t["grade"].alias("grade"), t["p"].alias("p"))

    ordered = F.array_sort(F.transform(terms, placed))
    return F.transform(ordered, lambda t: F.struct(t["grade"].alias("grade"), t["p"].alias("p")))


def distribution_checks(probabilities: Column) -> dict[str, Column]:
    """Not empty; keys are grades, each once however it is spelt; probabilities from 0 to 1 that come to 1, to a millionth."""
    p = F.map_values(probabilities)
    keys = F.transform(F.map_keys(probabilities), canonical_grade)
    known = F.filter(keys, lambda k: k.isNotNull())
    total = F.aggregate(p, F.lit(0.0), lambda acc, v: acc + v)
    return {
        "empty": F.size(probabilities) > 0,
        "grade": F.forall(keys, lambda k: k.isNotNull()),
        "twice": F.size(F.array_distinct(known)) == F.size(known),
        "probability": F.forall(p, lambda v: v.isNotNull() & ~F.isnan(v) & v.between(0, 1)),
        "total": F.abs(total - 1) <= 1e-6,
    }


# -- money: an amount to the cent and a currency


def money(amount: Column, currency: Column) -> Column:
    return F.struct(F.round(amount.cast("decimal(30,10)"), 2).cast("decimal(18,2)").alias("amount"), currency.alias("currency"))


def _of_one_currency(a: Column, b: Column, value: Column) -> Column:
    return F.when(is_same_currency(a["currency"], b["currency"]), value)


def money_sum(a: Column, b: Column) -> Column:
    """Null where currencies differ."""
    return _of_one_currency(a, b, money(a["amount"] + b["amount"], a["currency"]))


def money_negated(a: Column) -> Column:
    return money(-a["amount"], a["currency"])


def money_scaled(a: Column, factor: Column) -> Column:
    """By an exact rate, to the cent with halves upwards."""
    return money(a["amount"].cast("decimal(20,2)") * factor.cast("decimal(10,6)"), a["currency"])


def money_less(a: Column, b: Column) -> Column:
    """Null where currencies differ: amounts of two currencies have no order."""
    return _of_one_currency(a, b, a["amount"] < b["amount"])
