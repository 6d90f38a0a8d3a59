"""Column expressions for listing texts. Every function maps Column(s) to a Column."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# How portal Z writes each attribute of a flat.
FEATURE_PATTERNS = {
    "total_area": r"(\d+)\s?m²",
    "rooms": r"(\d+)\s?amb\.?",
    "bedrooms": r"(\d+)\s?dorm\.?",
    "bathrooms": r"(\d+)\s?bañ(?:os|o)",
    "garages": r"(\d+)\s?coch\.?",
}
EXPENSES_PATTERN = r"(\d{1,3}(?:\.\d{3})*)"
ROOMS_IN_TEXT = r"(10|[1-9])(?: amb|amb| dor|dorm|  ambientes)"
RENTAL_PREFIX = "Departamento en Alquiler en"
CITY = "Capital Federal"


def first_match(text: Column, pattern: str) -> Column:
    """First capture of ``pattern``, NULL where nothing matches."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def part(text: Column, separator: str, index: int) -> Column:
    """1-based part of a split text, NULL where there are fewer parts."""
    return F.try_element_at(F.split(text, separator), F.lit(index))


def replace_literal(text: Column, search: str, by: str = "") -> Column:
    return F.replace(text, F.lit(search), F.lit(by))


def listing_code(url: Column) -> Column:
    """Last dash-separated token of a link, up to its first dot."""
    return F.substring_index(F.substring_index(url, "-", -1), ".", 1)


def page_number(url: Column) -> Column:
    return first_match(url, r"pagina-(\d+)").try_cast("bigint")


def neighborhood_of_listing_a(location: Column) -> Column:
    """Portal A: the part before the comma without its prefix, unless the part behind is not the city."""
    before = F.trim(replace_literal(part(location, ",", 1), RENTAL_PREFIX))
    behind = F.trim(part(location, ",", 2))
    return F.when(behind.eqNullSafe(F.lit(CITY)), before).otherwise(behind)


def expenses_z(text: Column) -> Column:
    return first_match(text, EXPENSES_PATTERN)


def expenses_a(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[$.]|expensas", ""))


def to_pesos(currency: Column, amount: Column, rate: Column) -> Column:
    """Dollar amounts become a number text in pesos, to the cent; others stay as written."""
    pesos = try_double(replace_literal(amount, ".")) * rate
    whole = F.concat(pesos.try_cast("decimal(24,0)").cast("string"), F.lit(".0"))
    cents = F.regexp_replace(pesos.try_cast("decimal(24,2)").cast("string"), "0+$", "")
    as_text = F.coalesce(F.when(pesos % 1 == 0, whole).otherwise(cents), pesos.cast("string"))
    return F.when(currency == "USD", as_text).otherwise(amount)


def feature_z(features: Column, attribute: str) -> Column:
    return first_match(features, FEATURE_PATTERNS[attribute]).cast("double")


def _first_item(items: Column, mark: str) -> Column:
    return F.try_element_at(F.filter(items, lambda item: F.contains(item, F.lit(mark))), F.lit(1))


def area_a(items: Column) -> Column:
    return F.trim(replace_literal(_first_item(items, "m²"), "m² cubie."))


def rooms_a(items: Column) -> Column:
    counted = F.trim(replace_literal(_first_item(items, "ambientes"), "ambientes"))
    return F.when(F.array_contains(items, "Monoam."), F.lit("1")).otherwise(counted)


def bedrooms_a(items: Column) -> Column:
    return F.trim(replace_literal(_first_item(items, "dorm"), "dorm."))


def bathrooms_a(items: Column) -> Column:
    return F.trim(F.regexp_replace(_first_item(items, "baño"), "baños?", ""))


def antiquity_a(items: Column) -> Column:
    """Years, '0' for a new building. 'años' also ends 'baños': a list naming several bathrooms first
    gives no number, a property of the portal's data that later steps read as unknown."""
    years = F.trim(replace_literal(_first_item(items, "años"), "años"))
    return F.when(F.array_contains(items, "A Estrenar"), F.lit("0")).otherwise(years)


def try_double(text: Column) -> Column:
    return text.try_cast("double")


def price_number(text: Column) -> Column:
    """Amount text to a number: dots before three digits group thousands, a trailing ``.d``/``.dd`` is decimal."""
    return try_double(F.regexp_replace(text, r"\.(?=\d{3}(\D|$))", ""))


def price_number_literal(text: Column) -> Column:
    """Amount text read as the older reports did: ``.000`` loses its dot, any other ``.0`` is removed."""
    return try_double(replace_literal(replace_literal(text, ".000", "000"), ".0"))


def rooms_in_text(description: Column) -> Column:
    """Smallest number 1..10 that stands right before a word for rooms, found in one pass."""
    named = F.regexp_extract_all(description, F.lit(ROOMS_IN_TEXT), 1)
    return F.array_min(F.transform(named, lambda x: x.cast("double")))


def rooms_from_area(area: Column) -> Column:
    return (
        F.when(area < 30, 1.0).when(area < 50, 2.0).when(area < 80, 3.0)
        .when(area < 120, 4.0).when(area < 200, 5.0).otherwise(6.0)
    )


def bathrooms_from_rooms(rooms: Column) -> Column:
    return F.when(rooms.isin(1, 2, 3), 1.0).when(rooms.isin(4, 5, 6), 2.0).otherwise(3.0)


def room_category(rooms: Column) -> Column:
    from barriometrics.dims import ROOMS_4_PLUS

    return F.when(rooms < 4, rooms.cast("int").cast("string")).otherwise(F.lit(ROOMS_4_PLUS))


def area_category(area: Column) -> Column:
    """Right-closed size classes of the area chart."""
    from barriometrics.dims import AREA_CATEGORIES as names

    return (
        F.when(area <= 30, names[0]).when(area <= 60, names[1]).when(area <= 100, names[2]).otherwise(names[3])
    )


def size_band(area: Column) -> Column:
    """Left-closed size bands of the tenant profile, as an index 0..3."""
    return F.when(area < 30, 0).when(area < 50, 1).when(area < 80, 2).otherwise(3)
