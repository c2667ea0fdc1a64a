"""Masks, pseudonyms and the field policies that choose between them."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probita import fixed_values as V
from probita.functions.scalars import column, strip, words


def mask_identifier(value: Column | str, keep: int = 2, empty: str = "") -> Column:
    """Stars, with the last ``keep`` characters shown where the value is longer than that."""
    text = F.coalesce(column(value).cast("string"), F.lit(""))
    size = F.length(text)
    return (
        F.when(size == 0, F.lit(empty))
        .when(size <= keep, F.repeat(F.lit("*"), size))
        .otherwise(F.concat(F.repeat(F.lit("*"), size - keep), F.right(text, F.lit(keep))))
    )


def report_reference(value: Column | str) -> Column:
    """The mask of ingestion reports: stripped first, three stars for an empty id."""
    return mask_identifier(strip(F.coalesce(column(value).cast("string"), F.lit(""))), empty="***")


def mask_name(value: Column | str, is_person: Column | bool = True) -> Column:
    """Initials for persons; organisations keep their first word."""
    person = is_person if isinstance(is_person, Column) else F.lit(is_person)
    parts = words(F.coalesce(column(value).cast("string"), F.lit("")))

    def initial(word: Column) -> Column:
        return F.concat(F.substring(word, 1, 1), F.repeat(F.lit("*"), F.length(word) - 1))

    masked = F.transform(parts, lambda word, at: F.when(person | (at > 0), initial(word)).otherwise(word))
    return F.array_join(masked, " ")


def redact(value: Column | str) -> Column:
    text = F.coalesce(column(value).cast("string"), F.lit(""))
    return F.when(text == "", "").otherwise(V.REDACTED)


def keyed_digest(value: Column | str, key: str) -> Column:
    """HMAC-SHA256 in hex: two nested digests over the padded key; the key never becomes a column value."""
    block = key.encode("utf-8")
    if len(block) > 64:
        block = hashlib.sha256(block).digest()
    block = block.ljust(64, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in block))
    outer = F.lit(bytearray(b ^ 0x5C for b in block))
    message = column(value).cast("string").cast("binary")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def pseudonym(value: Column | str, key: str) -> Column:
    """Stable stand-in for an identifier; empty stays empty."""
    text = F.coalesce(column(value).cast("string"), F.lit(""))
    return F.when(text == "", "").otherwise(
        F.concat(F.lit(V.PSEUDONYM_PREFIX), F.substring(keyed_digest(text, key), 1, V.PSEUDONYM_DIGITS)))


def field_class(field: str) -> tuple[str, str]:
    """Sensitivity class and default mask; an unknown field is treated as the most sensitive."""
    return V.FIELD_CLASSES.get(field, V.UNKNOWN_FIELD_CLASS)


def context_for(rights: set[str]) -> str:
    """Context a reader may see: the full record needs the right to sensitive data."""
    return "internal_processing" if "sensitive" in rights else "human_review"


def minimize(entities: DataFrame, context: str, key: str) -> DataFrame:
    """The columns a context may see, masked where its policy says so."""
    policy = V.CONTEXT_TREATMENTS.get(context)
    if policy is None:
        raise ValueError(f"unknown processing context: {context!r}")
    person = F.lower(strip("client_type")) == "individual"
    kept = []
    for field, kind in entities.dtypes:
        treatment = policy.get(field, "omit")
        if treatment == "omit":
            continue
        if treatment == "raw":
            kept.append(F.col(field))
            continue

        def masked(value: Column, mask: str = field_class(field)[1]) -> Column:
            if mask == "pseudonymize":
                return pseudonym(value, key)
            if mask == "mask_identifier":
                return mask_identifier(value)
            if mask == "mask_name":
                return mask_name(value, person)
            return redact(value)

        kept.append((F.transform(field, lambda v: masked(v)) if kind.startswith("array") else masked(F.col(field))).alias(field))
    return entities.select(*kept)
