"""JSON values of unknown type."""

from pyspark.sql import Column, functions as F


def as_text(value: Column, path: str = "$") -> Column:
    return F.try_variant_get(value, path, "string")


def is_true(value: Column, kind: Column | None = None) -> Column:
    """Truth of a JSON value: absent, null, false, zero and empty are false."""
    kind = F.schema_of_variant(value) if kind is None else kind
    return F.coalesce(
        F.when(kind == "VOID", F.lit(False))
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(kind == "STRING", as_text(value) != "")
        .when(kind.startswith("ARRAY"), F.to_json(value) != "[]")
        .when(kind.startswith("OBJECT"), F.to_json(value) != "{}")
        .otherwise(F.try_variant_get(value, "$", "double") != 0),
        F.lit(False),
    )


def as_index(value: Column, kind: Column | None = None) -> Column:
    """A JSON number (cut to whole), true/false, or digits in a string."""
    kind = F.schema_of_variant(value) if kind is None else kind
    text = F.trim(as_text(value))
    digits = F.regexp_replace(text, "_", "").try_cast("bigint")
    return (
        F.when(kind == "STRING", F.when(text.rlike(r"^[+-]?\d+(?:_\d+)*$"), digits))
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("bigint"))
        .when(kind == "BIGINT", F.try_variant_get(value, "$", "bigint"))
        .when(
            kind.startswith("DECIMAL") | (kind == "DOUBLE"),
            F.try_variant_get(value, "$", "double").try_cast("bigint"),
        )
    )
