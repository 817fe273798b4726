"""Recodes and classes (P7, P9-P16, P18, P22, P24) and the tables they go by."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and codes of the domain.
SCENARIOS = {
    "s1": "scenario1", "s2": "scenario3_TO", "s3": "scenario2_TR", "s41": "scenario4_10", "s42": "scenario4_20", "s43": "scenario4_30",
    "s510": "scenario510", "s520": "scenario520", "s530": "scenario530",
}
SCENARIO_LABELS = {
    "scenario0": "Baseline", "scenario1": "AllBuilt", "scenario2_TR": "TreeRisk", "scenario3_TO": "TreeOpp", "scenario4_10": "Green10",
    "scenario4_20": "Green20", "scenario4_30": "Green30", "scenario510": "Target10", "scenario520": "Target20", "scenario530": "Target30",
}
CLIMATE_CASES = {"20_2": "2020", "22_2": "2021", "22_5": "2030", "25_5": "2050", "28_5": "2070"}
LAND_COVER = {
    1: "Broadleaved woodland", 2: "Coniferous Woodland", 3: "Arable and Horticulture", 4: "Improved Grassland", 5: "Neutral Grassland",
    6: "Calcareous Grassland", 7: "Acid Grassland", 8: "Fen, Marsh and Swamp", 9: "Heather", 10: "Heather Grassland", 11: "Bog", 12: "Inland Rock",
    13: "Saltwater", 14: "Freshwater", 15: "Supralittoral Rock", 16: "Supralittoral Sediment", 17: "Littoral Rock", 18: "Littoral Sediment",
    19: "Saltmarsh", 20: "Urban", 21: "Suburban", 100: "Tree Canopy",
}
PARK_USES = {
    "1 Regional Parks": ["Country park"],
    "2 Metropolitan Parks": ["Park", "Nature reserve"],
    "3 District Parks": ["Recreation ground", "Playing fields"],
    "4 Local Parks and Open Spaces": ["Amenity green space", "Formal garden", "Village green", "Public woodland"],
    "5 Small Open Spaces": ["Play space", "Community garden", "Allotments", "Youth area"],
    "6 Pocket Parks": ["Road island/verge", "Civic/market square"],
    "7 Linear Open Spaces": ["Canal", "River", "Walking/cycling route"],
}
PARK_AREAS = [(400, "1 Regional Parks"), (60, "2 Metropolitan Parks"), (20, "3 District Parks"), (2, "4 Local Parks and Open Spaces"), (0.4, "5 Small Open Spaces"), (0, "6 Pocket Parks")]
OPPORTUNITY_USES = ["Disused quarry/gravel pit", "Disused railway trackbed", "Land reclamation", "Other hard surfaced areas", "Other recreational", "Road island/verge", "Vacant land"]
AGES_DYING = ["over mature", "dead"]
CONDITIONS_DYING = ["poor", "vandalised", "dead", "dead stump", "felled", "dead/dying"]
CONDITION_UNKNOWN = "pk"
UNCLASSIFIED = "Unclassified"


def recode(column: Column, table: dict) -> Column:
    """The table's value; null where it has none."""
    return F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(table.items()))), column)


def scenario(code: Column) -> Column:
    """Land-cover scenario of a run's code, with or without the s0_ before it; s2 is tree opportunity and s3 tree risk."""
    return recode(F.regexp_replace(code, "^s0_", ""), SCENARIOS)


def scenario_label(name: Column) -> Column:
    return recode(name, SCENARIO_LABELS)


def climate_year(short_name: Column) -> Column:
    """Year of the climate case in a name that ends in _<deg>_<uhi>."""
    return recode(F.regexp_extract(short_name, r"_(\d+_\d+)$", 1), CLIMATE_CASES)


def effect_type(start: Column, end: Column) -> Column:
    return F.when(start == end, "lc effect").otherwise("climate+lc effect")


def period_parts(run: Column, default: str = "2021_2050") -> tuple[Column, Column]:
    """First and last year of a run's name; without them those of the default."""
    period = F.coalesce(F.nullif(F.regexp_extract(run, r"(\d{4}_\d{4})", 1), F.lit("")), F.lit(default))
    return F.split_part(period, F.lit("_"), F.lit(1)), F.split_part(period, F.lit("_"), F.lit(2))


def signed_effect(name: Column, value: Column, harmful: list[str], helpful: list[str]) -> Column:
    """Excess of harmful scenarios as it is, that of helpful ones as averted; others are null."""
    return F.when(name.isin(harmful), value).when(name.isin(helpful), -value)


def tree_condition(age: Column, condition: Column) -> Column:
    """dying or not dying; null if neither age nor condition is known."""
    age, condition = F.lower(age), F.nullif(F.lower(condition), F.lit(CONDITION_UNKNOWN))
    known = age.isNotNull() | condition.isNotNull()
    return F.when(known, F.when(F.coalesce(age.isin(AGES_DYING), F.lit(False)) | F.coalesce(condition.isin(CONDITIONS_DYING), F.lit(False)), "dying").otherwise("not dying"))


def filled_use(use: Column, name: Column) -> Column:
    """A blank use is Parks where the site's name says so."""
    return F.when((use == "") & name.rlike("(?i)park|garden|open space"), "Parks").otherwise(use)


def park_class_by_name(use: Column) -> Column:
    return F.coalesce(recode(use, {u: c for c, uses in PARK_USES.items() for u in uses}), F.lit(UNCLASSIFIED))


def park_class_by_area(hectares: Column) -> Column:
    out = F.lit(UNCLASSIFIED)
    for least, name in reversed(PARK_AREAS):
        out = F.when(hectares > least, name).otherwise(out)
    return out


def park_class(use: Column, hectares: Column) -> Column:
    """The class by name, whatever the area says."""
    return park_class_by_name(use)


def mask_outside(value: Column, low: float, high: float, fill=None) -> Column:
    """Values outside of [low, high] become the fill."""
    return F.when(value.between(low, high), value).otherwise(F.lit(fill))


def centimetres(metres: Column) -> Column:
    """Whole centimetres, halves to even; null where infinite or not a number."""
    return F.when(F.isnan(metres) | (F.abs(metres) == float("inf")), None).otherwise(F.rint(metres * 100).cast("int"))


def change_status(code: Column, target: int, skip: tuple = (0, 255)) -> Column:
    """Of a transition code from * 1000 + to: target, changed or stable; null where a side is to be skipped."""
    before, after = F.floor(code / 1000), F.pmod(code, F.lit(1000))
    status = F.when(before == after, "stable").when(after == target, "target").otherwise("changed")
    return F.when(~before.isin(*skip) & ~after.isin(*skip), status)
