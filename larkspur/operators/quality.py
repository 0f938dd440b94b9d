"""The quality gate: measurements against threshold triples, folded to findings, a score and a status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Condition, measurement it reads, unusable, poor and ideal threshold.
CONDITIONS = (
    ("blur", "blur", 40.0, 120.0, 500.0),
    ("low_resolution", "short_edge", 640.0, 1000.0, 2000.0),
    ("glare", "glare", 0.03, 0.005, 0.0),
    ("poor_exposure", "exposure", 30.0, 60.0, 200.0),
    ("excessive_darkness", "brightness", 35.0, 60.0, 128.0),
    ("excessive_brightness", "brightness", 225.0, 200.0, 128.0),
    ("severe_perspective_distortion", "perspective", 1.45, 1.12, 1.0),
    ("card_partly_outside_frame", "margin", 0.0, 0.005, 0.02),
    ("multiple_cards", "candidates", 2.0, 1.5, 1.0),
    ("sleeve_obstruction", "sleeve", 2.0, 1.02, 1.0),
    ("insufficient_card_size", "area", 0.06, 0.15, 0.45),
)
SEVERITIES = ("good", "acceptable", "poor", "unusable")
VERDICTS = ("clear", "detected", "undetermined")


def _signed(value: Column, unusable: float, poor: float, ideal: float) -> tuple[Column, float, float, float]:
    """All turned round where smaller is better, so that larger always is."""
    if ideal < poor:
        return -value, -unusable, -poor, -ideal
    return value, unusable, poor, ideal


def severity(value: Column, unusable: float, poor: float, ideal: float) -> Column:
    """Both limits belong to the worse side; null stays undecided."""
    v, u, p, _ = _signed(value, unusable, poor, ideal)
    return F.when(v.isNull(), F.lit(None).cast("string")).when(v <= u, "unusable").when(v <= p, "poor").otherwise("good")


def margin(value: Column, unusable: float, poor: float, ideal: float) -> Column:
    """0 up to unusable, a half at poor, 1 from ideal on, straight in between."""
    v, u, p, i = _signed(value, unusable, poor, ideal)
    low, high = (v - u) / (p - u) * 0.5, 0.5 + (v - p) / (i - p) * 0.5
    return F.when(v.isNull(), F.lit(None).cast("double")).when(v <= u, 0.0).when(v <= p, low).when(v >= i, 1.0).otherwise(high)


def assess(rows: DataFrame) -> DataFrame:
    """rows of measurements with score (least margin of decided conditions), status and findings in order.

    A null measurement is undetermined: it leaves the score alone and counts as acceptable for the status.
    """
    grades = {name: severity(F.col(m), u, p, i) for name, m, u, p, i in CONDITIONS}
    margins = [margin(F.col(m), u, p, i) for _, m, u, p, i in CONDITIONS]
    rank = F.create_map(*(x for i, s in enumerate(SEVERITIES) for x in (F.lit(s), F.lit(i))))
    worst = F.greatest(*(rank[F.coalesce(g, F.lit("acceptable"))] for g in grades.values()))
    findings = F.array(
        *(
            F.struct(
                F.lit(name).alias("condition"),
                F.when(g.isNull(), "undetermined").when(g == "good", "clear").otherwise("detected").alias("verdict"),
                F.when(g != "good", g).alias("severity"),
            )
            for name, g in grades.items()
        )
    )
    return rows.withColumns(
        {"score": F.least(*margins), "status": F.element_at(F.array(*map(F.lit, SEVERITIES)), worst + 1), "findings": findings}
    )


#: Measurements that need a located card, and why they lack one where no detector said.
GEOMETRIC = ("perspective", "margin", "candidates", "sleeve", "area")
NO_GEOMETRY = "the card has not been located in the photograph"

# What a client says of a condition that was detected.
FAULTS = {
    "blur": "It is out of focus.",
    "low_resolution": "It is too small for the detail this needs.",
    "glare": "A reflection is covering part of the card.",
    "poor_exposure": "The light is too flat to make anything out.",
    "excessive_darkness": "It is too dark to read.",
    "excessive_brightness": "It is washed out by the light.",
    "severe_perspective_distortion": "The card is at too much of an angle.",
    "card_partly_outside_frame": "Part of the card is outside the picture.",
    "multiple_cards": "There seems to be more than one card in the picture.",
    "sleeve_obstruction": "A sleeve is covering the card.",
    "insufficient_card_size": "The card is too small in the frame.",
}


def detailed_findings(reason: Column) -> Column:
    """(condition, verdict, severity, measurement, reason) of each condition in order, from a row's measurements.

    A decided one carries what was measured; an undetermined one the reason, which is the detector's where it gave one.
    """
    why = F.when(F.btrim(F.coalesce(reason, F.lit(""))) != "", F.btrim(reason)).otherwise(NO_GEOMETRY)
    found = []
    for name, m, u, p, i in CONDITIONS:
        value = F.col(m).cast("double")
        grade = severity(value, u, p, i)
        found.append(
            F.struct(
                F.lit(name).alias("condition"),
                F.when(grade.isNull(), "undetermined").when(grade == "good", "clear").otherwise("detected").alias("verdict"),
                F.when(grade != "good", grade).alias("severity"), value.alias("measurement"), F.when(grade.isNull(), why).alias("reason"),
            )
        )
    return F.array(*found)


def faults(findings: Column) -> Column:
    """Sentences about what was detected, in order; what couldn't be told is no fault."""
    said = F.create_map(*(F.lit(x) for pair in FAULTS.items() for x in pair))
    return F.transform(F.filter(findings, lambda f: f["verdict"] == "detected"), lambda f: F.try_element_at(said, f["condition"]))


def is_straightened(located: Column, status: Column) -> Column:
    """A photograph is straightened if its card was found and it isn't unusable."""
    return F.coalesce(located & (status != "unusable"), F.lit(False))


def worst_status(status: Column) -> Column:
    """An aggregate: the worst status of a group, good without any."""
    order = F.array(*map(F.lit, SEVERITIES))
    place = F.max(F.array_position(order, status)).cast("int")
    return F.element_at(order, F.coalesce(place, F.lit(1)))


def stored_findings(details: Column) -> Column:
    """(condition, verdict, severity) of a stored record's findings, read tolerantly.

    Entries without a known condition and verdict are left out, an unknown severity is none, and a record
    whose findings aren't a list has none.
    """
    raw = F.try_variant_get(F.try_parse_json(details), "$.findings", "array<variant>")
    part = lambda f, name: F.try_variant_get(f, f"$.{name}", "string")
    found = F.transform(
        F.coalesce(raw, F.array().cast("array<variant>")),
        lambda f: F.struct(
            part(f, "condition").alias("condition"),
            part(f, "verdict").alias("verdict"),
            F.when(part(f, "severity").isin(*SEVERITIES), part(f, "severity")).alias("severity"),
        ),
    )
    known = [name for name, *_ in CONDITIONS]
    return F.filter(found, lambda f: f["condition"].isin(*known) & f["verdict"].isin(*VERDICTS))


def threshold_maps(**stages: dict[str, float]) -> Column:
    """One map of name to threshold, names led by their stage so that stages can't clash."""
    pairs = [(f"{stage}.{name}", value) for stage, own in stages.items() for name, value in own.items()]
    return F.create_map(*(F.lit(x) for pair in pairs for x in pair))


def record(version: Column, detector: Column, thresholds: Column, findings: Column) -> Column:
    """The JSON that is stored: keys without a value are left out."""
    return F.to_json(
        F.struct(version.alias("version"), detector.alias("detector"), thresholds.alias("thresholds"), findings.alias("findings"))
    )
