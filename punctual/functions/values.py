"""Text, JSON and rounding expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def json_scalars(df: DataFrame, column: str, alias: str) -> DataFrame:
    """One row per scalar item of a JSON list held as text.

    NULL, blank or malformed text and top-level values other than a list give
    no rows; null, object and list items are dropped. Booleans read True/False.
    """
    parsed = F.try_parse_json(column)
    lists = df.withColumn("_json", parsed).filter(F.schema_of_variant("_json").startswith("ARRAY"))
    items = lists.lateralJoin(
        df.sparkSession.tvf.variant_explode(F.col("_json").outer()).select(F.col("value").alias("_item"))
    )
    kind = F.schema_of_variant("_item")
    text = F.variant_get("_item", "$", "string")
    return (
        items.filter(~(kind.startswith("OBJECT") | kind.startswith("ARRAY") | kind.startswith("VOID")))
        .withColumn(alias, F.when(kind == "BOOLEAN", F.initcap(text)).otherwise(text))
        .drop("_json", "_item")
    )


def blank_to_unknown(column: str) -> Column:
    value = F.col(column)
    return F.when(F.trim(value) != "", value).otherwise("Unknown")


def natural_key(column: str) -> Column:
    """Sort key ordering '2' before '10' before '10A'.

    A run of digits sorts by its length without leading zeros, then by its
    digits; a leading empty token keeps values that start with a digit ahead of
    those that start with a letter.
    """
    tokens = F.split(F.lower(F.col(column)), r"(?<=\D)(?=\d)|(?<=\d)(?=\D)")

    def number(token: Column) -> Column:
        digits = F.regexp_replace(token, "^0+", "")
        return F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)

    padded = F.transform(tokens, lambda t: F.when(t.rlike(r"^\d+$"), number(t)).otherwise(t))
    return F.when(F.col(column).rlike(r"^\d"), F.concat(F.array(F.lit("")), padded)).otherwise(padded)


def round_doubles(df: DataFrame, digits: int = 2) -> DataFrame:
    """Round the floating-point columns; used by sinks, never inside operators.

    First to six digits more, so that a tie is not decided by the last bit of an interpolation.
    """
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({name: F.round(F.round(name, digits + 6), digits) for name in doubles}) if doubles else df
