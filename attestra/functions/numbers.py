"""Alcohol and volume statements, tolerances and sizes, as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import constant, fold, fold_digits, let

_NUMBER = r"(?<![0-9])([0-9]{1,3}(?:[.,][0-9]{1,3})?)"
# The ways in which a percentage is stated, in order of preference.
PERCENT = (
    rf"(?iU){_NUMBER}\s*%\s*(?:alc\.?\s*/\s*vol|alc\.?\s*by\s*vol|alc\.?\s*vol|alcohol\s*by\s*vol|abv|vol)",
    rf"(?iU)(?:alc(?:ohol)?\.?|abv)[\s.:]*{_NUMBER}\s*%",
    rf"(?iU)(?:alc(?:ohol)?\.?)[\s.:]*{_NUMBER}\s*(?:%|percent)?\s*(?:alc\.?\s*)?by\s*vol",
    rf"(?iU){_NUMBER}\s*%\s*(?:alc\.?\s*)?by\s*vol",
)
PROOF = r"(?iU)(?<!\d)(\d{2,3}(?:[.,]\d)?)\s*(?:°\s*)?proof"
# What every statement of alcohol has, and every volume; look-alikes of digits, as ``fold_digits`` has them.
ANY_ALCOHOL = r"(?iU)%|proof|by\s*vol"
ANY_VOLUME = r"(?iU)[0-9oqdil|!sbzg]\s*(?:fl\.?\s*oz|fluid\s*oun|oun|oz|mill|ml|centi|cl|lit(?:er|re)|ltr|(?-i:l)(?![a-z])|(?-i:L)(?![acefhjkmnprt-y])|pint|pt|quart|qt|gal)"
BARE = rf"(?U)^\s*{_NUMBER}\s*%?\s*$"
# Units and their millilitres.
UNITS = {"ml": 1.0, "milliliter": 1.0, "millilitre": 1.0, "cl": 10.0, "centiliter": 10.0, "centilitre": 10.0, "l": 1000.0, "liter": 1000.0, "litre": 1000.0, "ltr": 1000.0, "floz": 29.5735295625, "oz": 29.5735295625, "ounce": 29.5735295625, "fluidounce": 29.5735295625, "pt": 473.176473, "pint": 473.176473, "qt": 946.352946, "quart": 946.352946, "gal": 3785.411784, "gallon": 3785.411784}
VOLUME = r"(?iU)(?<!\d)(\d{1,4}(?:[.,]\d{1,3})?)\s*(fl\.?\s*oz\.?|fluid\s*ounces?|ounces?|oz\.?|milliliters?|millilitres?|ml|centiliters?|centilitres?|cl|liters?|litres?|ltr|l|pints?|pt\.?|quarts?|qt\.?|gallons?|gal\.?)(?![a-z])"
# Authorised sizes in millilitres (27 CFR 5.203 and 4.72).
FILLS = {
    "spirits": (3750, 3000, 2000, 1800, 1750, 1500, 1000, 945, 900, 750, 720, 710, 700, 570, 500, 475, 375, 355, 350, 331, 250, 200, 187, 100, 50),
    "wine": (3000, 2250, 1800, 1500, 1000, 750, 720, 700, 620, 600, 568, 550, 500, 473, 375, 360, 355, 330, 300, 250, 200, 187, 180, 100, 50),
}
_COLOUR = "(?:red|white|rose|pink|blush|amber)"
TABLE_WINE = rf"\b(?:(?:table|light)\s+(?:{_COLOUR}\s+)?wine|{_COLOUR}\s+(?:table|light)\s+wine)\b"


def to_double(c: Column) -> Column:
    """A comma is a decimal sign unless just three digits follow it."""
    return F.when(c.rlike(r"^\d+,\d{3}$"), F.replace(c, F.lit(","), F.lit(""))).when(c.contains(".") , F.replace(c, F.lit(","), F.lit(""))).otherwise(F.replace(c, F.lit(","), F.lit("."))).try_cast("double")


def _first(text: Column, pattern: str, low: float, high: float, above: bool = False) -> Column:
    v = to_double(F.regexp_extract(text, pattern, 1))
    return F.when(((v > low) if above else (v >= low)) & (v <= high), v)


def parse_alcohol(text: Column, allow_bare: bool = False) -> Column:
    """struct(percent, proof, derived); null if nothing is stated. Proof alone gives half of it as percent."""
    def read(t: Column) -> Column:
        stated = F.coalesce(*[_first(t, p, 0, 100) for p in PERCENT])
        return F.struct(stated.alias("stated"), _first(t, PROOF, 0, 200, above=True).alias("proof"), (_first(t, BARE, 0, 100) if allow_bare else F.lit(None).cast("double")).alias("bare"))

    def settled(r: Column) -> Column:
        percent = F.coalesce(r["stated"], F.bround(r["proof"] / 2, 2), r["bare"])
        return F.when(percent.isNotNull(), F.struct(percent.alias("percent"), r["proof"].alias("proof"), (r["stated"].isNull() & r["proof"].isNotNull()).alias("derived")))

    # most texts state nothing: a plain look for a digit and a sign spares them the patterns
    may = text.rlike("[0-9]") if allow_bare else text.rlike("[0-9]") & text.rlike(ANY_ALCOHOL)
    return F.when(may, let(let(fold_digits(text), read), settled))


def consistent(alcohol: Column) -> Column:
    """Whether proof is twice the percentage; null unless both are stated."""
    return F.abs(alcohol["proof"] - 2 * alcohol["percent"]) <= 0.2


def alcohol_matches(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(a - b) <= 0.05, F.lit(False))


def parse_volumes(text: Column) -> Column:
    """array<struct(ml, raw, unit)> of all volumes stated."""
    parts = lambda t: F.arrays_zip(*[F.regexp_extract_all(t, F.lit(VOLUME), i).alias(n) for i, n in enumerate(("raw", "number", "unit"))])
    each = let(fold_digits(text), parts)
    table = constant(UNITS, "map<string,double>")

    def one(x: Column) -> Column:
        u = F.regexp_replace(F.lower(x["unit"]), "[^a-z]", "")
        long = F.regexp_extract(u, "^(milliliter|millilitre|centiliter|centilitre|liter|litre|gallon|quart|pint|ounce)", 1)
        unit = F.when(u.rlike("^fl.*oz$"), F.lit("floz")).when(u.startswith("fluidounce"), F.lit("fluidounce")).when(long != "", long).otherwise(u)
        return F.struct((to_double(x["number"]) * F.try_element_at(table, unit)).alias("ml"), F.trim(x["raw"]).alias("raw"), unit.alias("unit"))

    # held against the limits before it is rounded, half to even
    some = F.filter(F.transform(each, one), lambda v: (v["ml"] > 0) & (v["ml"] <= 60_000))
    found = F.transform(some, lambda v: F.struct(F.bround(v["ml"], 2).alias("ml"), v["raw"].alias("raw"), v["unit"].alias("unit")))
    may = text.isNull() | (text.rlike("[0-9]") & text.rlike(ANY_VOLUME))
    return F.when(may, found).otherwise(F.array().cast("array<struct<ml:double,raw:string,unit:string>>"))


def volumes_match(wanted: Column, read: Column, tolerance: float = 0.01) -> Column:
    return F.abs(wanted - read) <= F.greatest(tolerance * wanted, F.lit(0.5))


def is_standard_fill(beverage: Column, ml: Column) -> Column:
    """Null for malt beverages, which have no authorised sizes."""
    known = lambda kind: F.exists(F.array(*[F.lit(float(s)) for s in FILLS[kind]]), lambda s: F.abs(ml - s) <= F.greatest(0.005 * s, F.lit(0.5)))
    litres = (ml >= 4000) & (F.abs(ml / 1000 - F.bround(ml / 1000)) < 0.005)
    return F.when(beverage == "spirits", known("spirits")).when(beverage == "wine", known("wine") | litres)


def alcohol_required(beverage: Column, class_type: Column) -> Column:
    return (beverage == "spirits") | ((beverage == "wine") & ~fold(class_type).rlike(TABLE_WINE))


def shortest(v: Column) -> Column:
    """A number with at most six significant digits and no more of them than it needs, as notes speak of it: 750, 12.5,
    1e+06. What lies half way between two goes away from zero."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6g", v.cast("double")), r"(\.\d*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")
