"""How values are made comparable."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _holds_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, (T.MapType, T.VariantType)):
        return True
    if isinstance(dtype, T.ArrayType):
        return _holds_map(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(_holds_map(f.dataType) for f in dtype.fields)
    return False


def comparable(col: Column, dtype: T.DataType) -> Column:
    """``col`` in a form Spark can group by and test for equality.

    Maps become entry arrays sorted by key and variants their JSON, at any
    depth; everything else is returned as it is.
    """
    if not _holds_map(dtype):
        return col
    if isinstance(dtype, T.VariantType):
        return F.to_json(col)
    if isinstance(dtype, T.MapType):
        entries = F.transform(
            F.map_entries(col),
            lambda e: F.struct(e["key"].alias("key"), comparable(e["value"], dtype.valueType).alias("value")),
        )
        return F.array_sort(entries)
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda e: comparable(e, dtype.elementType))
    fields = [comparable(col[f.name], f.dataType).alias(f.name) for f in dtype.fields]
    return F.when(col.isNotNull(), F.struct(*fields))


def text_form(col: Column, dtype: T.DataType) -> Column:
    """The printed form of a value; NULL stays NULL.

    Whole numbers print without a fraction and decimals without trailing zeros,
    so ``1``, ``1.0``, ``1.00`` and ``'1'`` all read alike, at any size that an
    integer or decimal type can hold.
    """
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        exact = col.cast("double")
        digits = F.when(exact == F.rint(exact), exact.try_cast("decimal(38,0)"))
        return F.coalesce(digits.cast("string"), col.cast("string"))
    if isinstance(dtype, T.DecimalType):
        return F.regexp_replace(F.regexp_replace(col.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    if isinstance(dtype, (T.MapType, T.ArrayType, T.StructType, T.VariantType)):
        return F.to_json(comparable(col, dtype))
    return col.cast("string")


def cast_or_null(df: DataFrame, column: Column, dtype: T.DataType) -> Column:
    """A column over ``df`` in another type; NULL where, or when, that cannot be done."""
    read = column.try_cast(dtype)
    try:
        df.select(read)
    except AnalysisException:
        return F.lit(None).cast(dtype)
    return read


def read_as(df: DataFrame, name: str, dtype: T.DataType) -> Column:
    """The column ``name`` in another type; see ``cast_or_null``."""
    column = F.col(f"`{name}`")
    return column if df.schema[name].dataType == dtype else cast_or_null(df, column, dtype)
