"""The narrowest type of every column that loses nothing, from one pass over the table.

Types form a lattice; each value rules out those it does not come back from. The
columns' counts of such values leave, per column, the types that all its values
allow, and the narrowest of these is their meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Whole types from the narrowest up, with their bits.
_WHOLE = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}
_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)

_FRACTION = r"^-?(0|[1-9][0-9]*)\.([0-9]+)$"
_DAY, _TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?$"


def _whole(value: Column, dtype: T.DataType) -> Column | None:
    """The value as a long if it is just that, else NULL; forms are tested first, since a cast that fails is dear."""
    if isinstance(dtype, T.StringType):
        return F.when(value.rlike("^(0|-?[1-9][0-9]{0,18})$"), value.try_cast("bigint"))
    if not isinstance(dtype, _NUMBERS):
        return None
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        plain = (F.abs(value) < 2.0**63) & (value == F.rint(value)) & ((value != 0) | (value.cast("string") == "0.0"))
        return F.when(plain, value.cast("bigint"))
    if isinstance(dtype, T.DecimalType):
        return F.when((F.abs(value) < F.lit(1 << 62)) & (value == F.floor(value)), value.cast("bigint"))
    return value.cast("bigint")


def _returns(value: Column, dtype: T.DataType) -> dict[str, Column]:
    """Whether a value comes back from each further type below its own, narrowest first."""
    if isinstance(dtype, T.StringType):
        def printed(form: str, target: str) -> Column:
            return F.when(value.rlike(form), value.try_cast(target).cast("string") == value)
        return {
            "date": printed(_DAY, "date"), "timestamp_ntz": printed(_TIME, "timestamp_ntz"),
            "double": printed(r"^-?[0-9]+(\.[0-9]+)?(E-?[0-9]+)?$", "double"),
        }
    if isinstance(dtype, T.DoubleType):
        return {"float": value.cast("float").cast("double") == value}
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return {"date": value.cast("date").cast(dtype) == value}
    return {}


def _digits(name: str, dtype: T.DataType) -> tuple[Column, Column, Column] | None:
    """Digits before the point, after it, and whether a value has such a form at all."""
    if isinstance(dtype, T.StringType):
        text, form = F.col(f"`{name}`"), F.lit(_FRACTION)
        return (
            F.length(F.regexp_replace(F.regexp_extract(text, _FRACTION, 1), "^0$", "")),
            F.length(F.regexp_extract(text, _FRACTION, 2)), F.regexp_like(text, form) & ~text.rlike(r"^-0\.0+$"),
        )
    if isinstance(dtype, T.DecimalType):
        text = F.regexp_replace(F.abs(F.col(f"`{name}`")).cast("string"), r"^0+(?=\d)", "")
        whole, part = F.substring_index(text, ".", 1), F.when(F.contains(text, F.lit(".")), F.substring_index(text, ".", -1)).otherwise("")
        return F.length(F.nullif(whole, F.lit("0"))), F.length(F.rtrim(part, F.lit("0"))), F.lit(True)
    return None


def narrowest_types(df: DataFrame) -> DataFrame:
    """``column, type, narrowest, rows, nulls`` of every column.

    A text column comes down to a type if every value is what that type prints; so
    ``007`` and ``1.50`` beside ``2.5`` stay text. Fractions as text become a decimal
    if all have as many digits after the point. A column without values has the
    narrowest type of all, ``void``; nested, binary and other columns keep theirs.
    """
    measured: list[Column] = [F.count(F.lit(1)).alias("rows")]
    choices: list[Column] = []
    read: list[Column] = []  # what several measures share, worked out once per row

    def once(column: Column, name: str) -> Column:
        read.append(column.alias(name))
        return F.col(name)

    for i, f in enumerate(df.schema.fields):
        value, dtype = F.col(f"`{f.name}`"), f.dataType

        def left_over(kept: Column, name: str, value: Column = value) -> Column:
            """Whether no value is ruled out, from a count that is measured under ``name``."""
            measured.append(F.count_if(value.isNotNull() & ~F.coalesce(kept, F.lit(False))).alias(name))
            return F.col(name) == 0

        measured.append(F.count_if(value.isNull()).alias(f"n{i}"))
        options: list[tuple[Column, Column]] = []  # (whether it holds all values, the type), narrowest first
        if isinstance(dtype, T.StringType):
            options.append((left_over(value.isin("true", "false"), f"o{i}"), F.lit("boolean")))
        whole = _whole(value, dtype)
        if whole is not None:
            whole = once(whole, f"__whole{i}")
            all_whole = left_over(whole.isNotNull(), f"w{i}")
            measured += [F.min(whole).alias(f"lo{i}"), F.max(whole).alias(f"hi{i}")]
            for t, bits in _WHOLE.items():
                reach = 1 << (bits - 1)
                options.append((all_whole & (F.col(f"lo{i}") >= -reach) & (F.col(f"hi{i}") < reach if bits < 64 else F.lit(True)), F.lit(t)))
        digits = _digits(f.name, dtype)
        if digits:
            before, after, formed = digits
            after = once(after, f"__after{i}")
            measured += [
                F.max(F.coalesce(before, F.lit(0))).alias(f"b{i}"), F.max(after).alias(f"a{i}"), F.min(after).alias(f"m{i}"),
            ]
            size = F.greatest(F.col(f"b{i}") + F.col(f"a{i}"), F.lit(1))
            fits = left_over(formed, f"f{i}") & (size <= 38)
            if isinstance(dtype, T.StringType):
                fits = fits & (F.col(f"m{i}") == F.col(f"a{i}"))
            options.append((fits, F.concat(F.lit("decimal("), size, F.lit(","), F.col(f"a{i}"), F.lit(")"))))
        for t, kept in _returns(value, dtype).items():
            options.append((left_over(kept, f"{t}{i}"), F.lit(t)))
        choice = F.lit(dtype.simpleString())
        for fits, t in reversed(options):
            choice = F.when(fits, t).otherwise(choice)
        choices.append(F.when(F.col(f"n{i}") == F.col("rows"), "void").otherwise(choice))
    shown = [
        F.struct(
            F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), choice.alias("narrowest"),
            F.col("rows").alias("rows"), F.col(f"n{i}").alias("nulls"),
        )
        for i, (f, choice) in enumerate(zip(df.schema.fields, choices, strict=True))
    ]
    return df.select("*", *read).agg(*measured).select(F.explode(F.array(*shown)).alias("c")).select("c.*")
