"""Contact addresses cleaned by lookups: phone codes, postal prefixes, states and provinces, street words.

Small tables stand here; larger ones (languages, countries, area codes, calling codes) are read from files that the
caller names, as two or more columns of CSV.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.operators import lookup

#: Codes of states and provinces, first letters of Canadian postal codes, street words, directions (fixed values).
STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware", "DC": "District of Columbia", "FL": "Florida", "GA": "Georgia",
    "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa", "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland", "MA": "Massachusetts", "MI": "Michigan",
    "MN": "Minnesota", "MS": "Mississippi", "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico", "NY": "New York", "NC": "North Carolina",
    "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania", "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah",
    "VT": "Vermont", "VA": "Virginia", "WA": "Washington", "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming",
}
PROVINCES = {
    "AB": "Alberta", "BC": "British Columbia", "MB": "Manitoba", "NB": "New Brunswick", "NL": "Newfoundland and Labrador", "NS": "Nova Scotia", "NT": "Northwest Territories", "NU": "Nunavut", "ON": "Ontario",
    "PE": "Prince Edward Island", "QC": "Quebec", "SK": "Saskatchewan", "YT": "Yukon",
}
POSTAL = {"A": "NL", "B": "NS", "C": "PE", "E": "NB", "G": "QC", "H": "QC", "J": "QC", "K": "ON", "L": "ON", "M": "ON", "N": "ON", "P": "ON", "R": "MB", "S": "SK", "T": "AB", "V": "BC", "X": "NT", "Y": "YT"}
STREETS = {"ave": "Avenue", "av": "Avenue", "blvd": "Boulevard", "cir": "Circle", "cres": "Crescent", "ct": "Court", "dr": "Drive", "hwy": "Highway", "ln": "Lane", "pkwy": "Parkway", "pl": "Place", "rd": "Road", "sq": "Square", "st": "Street", "ter": "Terrace"}
DIRECTIONS = {"n": "North", "s": "South", "e": "East", "w": "West", "ne": "Northeast", "nw": "Northwest", "se": "Southeast", "sw": "Southwest"}


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def codes(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A dimension from a CSV file: all columns as text, under the given names."""
    return spark.read.csv(path).toDF(*columns)


def region_name(code: Column) -> Column:
    """Name of a state or province by code or name; else as it is."""
    tidy = F.upper(F.trim(code))
    return F.coalesce(F.try_element_at(_map(STATES | PROVINCES), tidy), F.trim(code))


def region_country(region: Column) -> Column:
    """US or CA by the name of a state or province."""
    return F.when(region.isin(*STATES.values()), "US").when(region.isin(*PROVINCES.values()), "CA")


def postal_region(postal: Column) -> Column:
    """Province of a Canadian postal code by its first letter; null for other codes."""
    tidy = F.upper(F.regexp_replace(postal, r"[\s-]", ""))
    province = F.try_element_at(_map(PROVINCES), F.try_element_at(_map(POSTAL), F.substring(tidy, 1, 1)))
    return F.when(tidy.rlike(r"^[A-Z]\d[A-Z](\d[A-Z]\d)?$"), province)


def street(c: Column) -> Column:
    """A street with its last word, and a direction at the end, written out."""
    words = F.split(F.trim(F.regexp_replace(c, r"[\s.]+", " ")), " ")
    n = F.size(words)
    whole = lambda table, w: F.coalesce(F.try_element_at(_map(table), F.lower(w)), w)
    last = F.element_at(words, -1)
    turned = F.try_element_at(_map(DIRECTIONS), F.lower(last)).isNotNull() & (n > 2)
    kind_at = F.when(turned, n - 2).otherwise(n - 1)
    out = F.transform(words, lambda w, i: F.when((i == n - 1) & turned, whole(DIRECTIONS, w)).when((i == kind_at) & (n > 1), whole(STREETS, w)).otherwise(w))
    return F.array_join(out, " ")


def address(fields: dict[str, Column]) -> dict[str, Column]:
    """street-address (first line), extended-address (other lines), region, postal-code and country-name, where the
    region may follow from the postal code and the country from the region."""
    lines = F.split(F.trim(fields["street-address"]), r"\s*\n\s*")
    region = F.coalesce(region_name(F.nullif(F.trim(fields["region"]), F.lit(""))), postal_region(fields["postal-code"]))
    return {
        "street_address": street(F.get(lines, F.lit(0))),
        "extended_address": F.nullif(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), ", "), F.lit("")),
        "region": region,
        "postal_code": F.upper(F.trim(fields["postal-code"])),
        "country": F.coalesce(F.nullif(F.trim(fields["country-name"]), F.lit("")), region_country(region)),
    }


def phone_places(df: DataFrame, calling: DataFrame, areas: DataFrame, phone: str) -> DataFrame:
    """df with country by calling code (shortest prefix) and, in the North American plan, locality by area code."""
    digits = df.withColumn("_digits", lookup.phone_digits(F.col(phone)))
    placed = lookup.shortest_prefix(digits, calling, "_digits", "code", "country")
    area = F.when(F.col("_digits").startswith("1") & (F.length("_digits") == 11), F.substring("_digits", 2, 3))
    return lookup.code_names(placed.withColumn("_area", area), areas, "_area", "code", "locality", "locality").drop("_digits", "_area")
