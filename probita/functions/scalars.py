"""Scalar building blocks: text clean-up, lenient parsing, country and date folding, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from probita import fixed_values as V

NUMERIC = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


_SPLIT = "134217729.0D"  # 2^27 + 1 halves a double's digits


def half_even_sql(value: str, digits: int) -> str:
    """Correct decimal rounding of a double, as SQL; ``value`` is a name.

    value * 10^digits is rounded itself, so where it seems to lie half-way its rounding error decides. The error comes
    out exactly in plain arithmetic: 10^digits has few digits, and the value is split in two halves of its digits.
    """
    scale = f"1e{digits}D"
    product, high = f"({value} * {scale})", f"({value} * {_SPLIT} - ({value} * {_SPLIT} - {value}))"
    error = f"(({high} * {scale} - {product}) + ({value} - {high}) * {scale})"
    halfway = f"{product} - floor({product}) = 0.5D"
    return (f"(CASE WHEN {halfway} AND {error} > 0 THEN ceil({product}) WHEN {halfway} AND {error} < 0 THEN floor({product})"
            f" ELSE rint({product}) END) / {scale}")


def half_even(value: Column | str, digits: int = 0) -> Column:
    """Round to the even neighbour on the binary value."""
    value = column(value)
    if digits == 0:
        return F.rint(value)
    # An array of one binds the value, so that it is worked out once.
    return F.transform(F.array(value.cast("double")), lambda _v: _rounded(_v, digits))[0]


def _rounded(v: Column, digits: int) -> Column:
    scale, split = F.lit(float(10**digits)), F.lit(float(2**27 + 1))
    product = v * scale
    high = v * split - (v * split - v)
    error = (high * scale - product) + (v - high) * scale
    halfway = product - F.floor(product) == 0.5
    return F.when(halfway & (error > 0), F.ceil(product).cast("double")).when(halfway & (error < 0), F.floor(product).cast("double")).otherwise(F.rint(product)) / scale


def plain_number(value: Column | str) -> Column:
    """Text of a double without an exponent: at least one decimal, no more than it takes to tell it from its neighbours."""
    text = column(value).cast("double").cast("string")
    decimal = F.rtrim(text.try_cast("decimal(38,17)").cast("string"), F.lit("0"))
    return F.when(text.contains("E"), F.coalesce(F.when(decimal.endswith("."), F.concat(decimal, F.lit("0"))).otherwise(decimal), text)).otherwise(text)


def strip(value: Column | str) -> Column:
    return F.btrim(column(value), F.lit(V.BLANKS))


def known(value: Column | str) -> Column:
    """NULL where the text is empty: an empty attribute counts as unknown."""
    return F.nullif(column(value), F.lit(""))


def clean_marker(value: Column | str) -> Column:
    """Strip, and read both the empty text and the list publisher's null marker as NULL."""
    return F.nullif(known(strip(value)), F.lit(V.LIST_NULL))


def collapse_blanks(value: Column | str) -> Column:
    return strip(F.regexp_replace(F.coalesce(column(value), F.lit("")), r"(?U)\s+", " "))


def token(value: Column | str) -> Column:
    return F.lower(strip(F.coalesce(column(value).cast("string"), F.lit(""))))


def strict_bool(value: Column | str) -> Column:
    """True, false, or NULL for any text outside the two token lists."""
    return (
        F.when(token(value).isin(V.TRUE_TOKENS), F.lit(True))
        .when(token(value).isin(V.FALSE_TOKENS), F.lit(False))
    )


def sector_risk(value: Column | str) -> Column:
    found = F.lit(None).cast("string")
    for text, level in V.SECTOR_RISKS.items():
        found = F.when(token(value) == text, F.lit(level)).otherwise(found)
    return found


def number_or(value: Column | str, default: float = 0.0) -> Column:
    """A number, or ``default`` where the text is no number."""
    text = strip(column(value).cast("string"))
    return F.coalesce(F.when(text.rlike(NUMERIC), text.try_cast("double")), F.lit(float(default)))


def lenient_flag(value: Column | str) -> Column:
    """1 for a number whose whole part is not zero, or for a spelled-out yes; else 0."""
    text = strip(column(value).cast("string"))
    number = F.when(text.rlike(NUMERIC), text.try_cast("double"))
    return (
        F.when(number.isNotNull(), (F.abs(number) >= 1.0).cast("int"))
        .when(F.lower(text).isin(V.LENIENT_TRUE), F.lit(1))
        .otherwise(F.lit(0))
    )


def truthy(value: Column | str) -> Column:
    """Boolean reading of a flag that may be a boolean, a number or a text; unknown is false."""
    text = token(value)
    return text.isin("true", "yes", "y", "1") | F.coalesce(
        F.when(text.rlike(NUMERIC), text.try_cast("double") != 0.0), F.lit(False)
    )


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))


def pad_number(value: Column | str, width: int) -> Column:
    """Left-pad with zeros; longer texts keep all their digits."""
    text = column(value).cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def country_code(value: Column | str) -> Column:
    """Two-letter code where the name or code is in the table, else the upper-cased text."""
    text = strip(column(value))
    table = F.create_map(*[F.lit(part) for pair in V.COUNTRY_CODES.items() for part in pair])
    return F.when(known(value).isNotNull(), F.coalesce(F.try_element_at(table, F.lower(text)), F.upper(text)))


def birth_date(value: Column | str) -> Column:
    """Struct of year, month and day, each NULL where not stated; NULL where no year is found."""
    text = F.lower(strip(known(value)))
    iso = r"^(\d{4})(?:[-/](\d{1,2}))?(?:[-/](\d{1,2}))?$"
    worded = r"^(?:(\d{1,2})\s+)?([a-z]{3,9})\s+(\d{4})$"
    bare = r"(?U)\b(\d{4})\b"

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(text, pattern, group).try_cast("int")

    months = F.array(*[F.lit(m) for m in V.MONTHS])
    month = F.nullif(F.array_position(months, F.substring(F.regexp_extract(text, worded, 2), 1, 3)).cast("int"), F.lit(0))
    return (
        F.when(text.rlike(iso), F.struct(
            part(iso, 1).alias("year"), part(iso, 2).alias("month"), part(iso, 3).alias("day")))
        .when(text.rlike(worded) & month.isNotNull(), F.struct(
            part(worded, 3).alias("year"), month.alias("month"), part(worded, 1).alias("day")))
        .when(text.rlike(bare), F.struct(
            part(bare, 1).alias("year"), F.lit(None).cast("int").alias("month"), F.lit(None).cast("int").alias("day")))
    )


def words(value: Column | str) -> Column:
    """Blank-separated words, no empties."""
    return F.filter(F.split(column(value), r"(?U)\s+"), lambda part: part != "")


def alphanumeric_tokens(value: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(column(value)), F.lit(r"([a-z0-9]+)"), F.lit(1)))


def split_multi(value: Column | str) -> Column:
    """Values of a semicolon-separated field, stripped, blanks dropped."""
    parts = F.transform(F.split(F.coalesce(column(value), F.lit("")), ";"), strip)
    return F.filter(parts, lambda part: part != "")


def first_country(value: Column | str) -> Column:
    text = strip(column(value))
    return F.when(known(text).isNotNull(), F.upper(strip(F.split_part(text, F.lit(";"), F.lit(1)))))


def family_name_last(name: Column | str) -> Column:
    """``LAST, First`` becomes ``First LAST``; only the first comma counts."""
    name = column(name)
    head = F.substring_index(name, ",", 1)
    tail = F.substring(name, F.length(head) + F.lit(2), F.length(name))
    return F.when(F.contains(name, F.lit(",")), F.concat(strip(tail), F.lit(" "), strip(head))).otherwise(strip(name))


def remarks_dob(remarks: Column | str) -> Column:
    return known(F.regexp_extract(column(remarks), "(?U)" + V.DOB_PATTERN, 1))


def remarks_nationality(remarks: Column | str) -> Column:
    return known(strip(F.regexp_extract(column(remarks), "(?U)" + V.NATIONALITY_PATTERN, 1)))


def remarks_aliases(remarks: Column | str) -> Column:
    return F.regexp_extract_all(F.coalesce(column(remarks), F.lit("")), F.lit("(?U)" + V.AKA_PATTERN), F.lit(1))


def blocking_key(name: Column | str) -> Column:
    """First four letters or digits of the lower-cased name; empty where there is none."""
    kept = F.regexp_replace(F.lower(F.coalesce(column(name), F.lit(""))), r"[^\p{L}\p{N}]", "")
    return F.substring(kept, 1, V.KEY_LENGTH)


def query_keys(name: Column | str) -> Column:
    """Keys a query is looked up under: the whole name and each of its words."""
    name = F.coalesce(column(name), F.lit(""))
    keys = F.concat(F.array(blocking_key(name)), F.transform(words(name), blocking_key))
    return F.array_sort(F.array_distinct(F.filter(keys, lambda key: key != "")))


def index_keys(name: Column | str, aliases: Column | str) -> Column:
    """Keys an entry is filed under: the whole name and each whole alias."""
    listed = F.transform(F.coalesce(column(aliases), F.array().cast("array<string>")), blocking_key)
    keys = F.concat(F.array(blocking_key(name)), listed)
    return F.array_sort(F.array_distinct(F.filter(keys, lambda key: key != "")))


def same_or_unknown(left: Column | str, right: Column | str) -> Column:
    left, right = known(left), known(right)
    return (
        F.when(left.isNull() | right.isNull(), F.lit(V.UNKNOWN_ATTRIBUTE))
        .when(F.lower(strip(left)) == F.lower(strip(right)), F.lit(1.0))
        .otherwise(F.lit(0.0))
    )


def country_match(left: Column | str, right: Column | str) -> Column:
    return (
        F.when(known(left).isNull() | known(right).isNull(), F.lit(V.UNKNOWN_ATTRIBUTE))
        .when(country_code(left) == country_code(right), F.lit(1.0))
        .otherwise(F.lit(0.0))
    )


def dates_agree(left: Column, right: Column) -> Column:
    """No stated part of two date structs contradicts the other."""
    def part(name: str) -> Column:
        return F.coalesce(left[name] == right[name], F.lit(True))
    return part("year") & part("month") & part("day")


def dob_match(left: Column | str, right: Column | str) -> Column:
    first, second = birth_date(left), birth_date(right)
    return (
        F.when(known(left).isNull() | known(right).isNull(), F.lit(V.UNKNOWN_ATTRIBUTE))
        .when(first.isNull() | second.isNull(),
              (F.lower(strip(left if not isinstance(left, str) else F.col(left)))
               == F.lower(strip(right if not isinstance(right, str) else F.col(right)))).cast("double"))
        .otherwise(dates_agree(first, second).cast("double"))
    )


def customer_id(value: Column | str) -> Column:
    """The prefixed form of a customer id."""
    text = column(value).cast("string")
    return F.when(text.startswith("CLIENT-"), text).otherwise(F.concat(F.lit("CLIENT-"), text))


def json_text(value: Column | str, kind: str) -> Column:
    """Text form of a payload value: booleans print capitalised, NULL prints empty."""
    text = column(value).cast("string")
    if kind == "boolean":
        text = F.initcap(text)
    return F.coalesce(text, F.lit(""))


def pipe_hash(*parts: Column | str) -> Column:
    texts = [F.coalesce(column(part).cast("string"), F.lit("")) for part in parts]
    return F.sha2(F.concat_ws("|", *texts), 256)
