"""Coercion and field access on loosely typed business records."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANKS = " \t\n\r\x0b\x0c"
_NOT_NUMBERS = (T.DateType, T.TimestampType, T.TimestampNTZType, T.ArrayType, T.MapType, T.StructType, T.BinaryType)


def strip(text: Column) -> Column:
    """Text without surrounding white space."""
    return F.btrim(text, F.lit(BLANKS))


def parse_double(text: Column) -> Column:
    """Text as a number, NULL where it is none.

    Java number literals that are not plain numbers (`5d`, `5f`, hexadecimal) are refused.
    """
    return F.when(~text.rlike(r"[0-9.][dDfF]\s*$|[xX]"), text.try_cast("double"))


def currency_to_double(text: Column) -> Column:
    """Text such as `$1,234.50` as a number, NULL where it is none."""
    return parse_double(F.regexp_replace(text, "[,$£€]", ""))


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def field_type(df: DataFrame, name: str) -> T.DataType | None:
    """Type of a top-level column, None if there is no such column."""
    return next((f.dataType for f in df.schema.fields if f.name == name), None)


def numeric_field(df: DataFrame, name: str) -> Column:
    """A column as double; 0.0 where it is missing, NULL or no number."""
    kind = field_type(df, name)
    if kind is None or isinstance(kind, _NOT_NUMBERS):
        return F.lit(0.0)
    number = parse_double(F.col(name)) if isinstance(kind, T.StringType) else F.col(name).try_cast("double")
    return F.coalesce(number, F.lit(0.0))


#: Places of the lowest bit of each part of an amount, and the size from which amounts have no parts.
_PART_BITS = 34
_LOWEST_BITS = range(-76, 61, _PART_BITS)
_PARTED_BELOW = 2.0 ** 93


def exact_sum(amount: Column) -> Column:
    """Sum of amounts as a double that does not depend on the order of the rows.

    An amount is cut into integers at fixed binary places, which add up to it but for what lies below 2^-76, about 1e-23. The
    integers are added as longs, exactly and in any order, and carried and put together once per group. Where an amount is
    2^93, about 1e28, or more or no number, or where a long is too short for its sum, the plain sum of doubles stands.
    """
    value = amount.cast("double")
    size = F.abs(value)
    parted = F.when(size < _PARTED_BELOW, value)
    rounded = [F.rint(parted * 2.0 ** -low) for low in _LOWEST_BITS]
    parts = [own - above * 2.0 ** _PART_BITS for own, above in zip(rounded, rounded[1:])] + rounded[-1:]
    total, carry = F.lit(0.0), F.lit(0).cast("long")
    for low, part in zip(_LOWEST_BITS, parts):
        held = F.try_add(F.try_sum(part.cast("long")), carry)
        if low != _LOWEST_BITS[-1]:  # digits around zero, so that those above the sum's size vanish
            carry = F.shiftright(F.try_add(held, F.lit(1 << _PART_BITS - 1).cast("long")), _PART_BITS)
            held = held - carry * (1 << _PART_BITS)
        total = total + held.cast("double") * 2.0 ** low
    plain = F.sum(value)
    return F.when(F.max(size) >= _PARTED_BELOW, plain).otherwise(F.coalesce(total, plain))


def truthy(df: DataFrame, name: str) -> Column:
    """True for true flags, numbers other than zero, and text that is not empty."""
    kind = field_type(df, name)
    if kind is None:
        return F.lit(False)
    value = F.col(name)
    if isinstance(kind, T.BooleanType):
        test = value
    elif isinstance(kind, T.NumericType):
        test = value != 0
    elif isinstance(kind, T.StringType):
        test = F.length(value) > 0
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        test = F.size(value) > 0
    else:
        test = value.isNotNull()
    return F.coalesce(test, F.lit(False))


def _same_family(kind: T.DataType, value: object) -> bool:
    if isinstance(value, bool):
        return isinstance(kind, (T.BooleanType, T.NumericType))
    if isinstance(value, (int, float)):
        return isinstance(kind, T.NumericType)
    if isinstance(value, str):
        return isinstance(kind, T.StringType)
    return True


def _equals(df: DataFrame, name: str, value: object) -> Column:
    kind = field_type(df, name)
    if value is None:
        return F.lit(True) if kind is None else F.col(name).isNull()
    if kind is None or not _same_family(kind, value):
        return F.lit(False)
    if isinstance(value, bool) and isinstance(kind, T.NumericType):
        value = int(value)
    return F.col(name).eqNullSafe(F.lit(value))


def template_filter(df: DataFrame, where: dict[str, object]) -> Column:
    """AND over a metric's filter: a list means membership, True means truthy, else equality."""
    test = F.lit(True)
    for name, expected in where.items():
        if isinstance(expected, (list, tuple, set)):
            one = F.lit(False)
            for value in expected:
                one = one | _equals(df, name, value)
        elif expected is True:
            one = truthy(df, name)
        else:
            one = _equals(df, name, expected)
        test = test & one
    return test


def field_reader(df: DataFrame, nested: str = "data") -> Callable[[str], Column | None]:
    """A function from field name to column, looking in the nested record only.

    The nested record may be a struct or a map of text; without one the top level is read.
    """
    kind = field_type(df, nested)
    if isinstance(kind, T.StructType):
        names = set(kind.fieldNames())
        return lambda name: F.col(f"{nested}.`{name}`") if name in names else None
    if isinstance(kind, T.MapType):
        return lambda name: F.col(nested)[name]
    return lambda name: F.col(f"`{name}`") if name in df.columns else None


def first_non_null(read: Callable[[str], Column | None], names: Iterable[str]) -> Column:
    """First value that is not NULL over a list of alias fields, as text."""
    found = [c.cast("string") for c in map(read, names) if c is not None]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def field_values(df: DataFrame, names: Iterable[str], nested: str = "data") -> list[Column]:
    """One text column per field: the nested value if it is truthy, else the top-level value."""
    read = field_reader(df, nested)
    columns = []
    for name in names:
        options = []
        inner = read(name)
        if inner is not None:
            options.append(_truthy_text(inner))
        if nested in df.columns and name in df.columns:
            options.append(_truthy_text(F.col(f"`{name}`")))
        if options:
            columns.append(F.coalesce(*options))
    return columns


def _truthy_text(value: Column) -> Column:
    text = value.cast("string")
    return F.when(~text.isin("", "0", "0.0", "false"), text)
