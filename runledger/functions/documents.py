"""Nested values: JSON text in one agreed form, recursive merging, and look-ups that tell null from missing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, DataType, DateType, DoubleType, FloatType, MapType, StructType, TimestampNTZType, TimestampType

from runledger.functions.dates import long_format
from runledger.functions.numbers import round_even

DIGITS = 2  # of the numbers in lists


def canonical_json(value: Column, kind: DataType) -> Column:
    """A nested value as JSON: keys sorted at all levels, nulls kept, dates in the long format, and the numbers of
    lists rounded to two digits, half to even. A null value is ``null``."""
    ready = _ready(value, kind)
    if isinstance(kind, (StructType, MapType, ArrayType)):
        text = F.to_json(ready, {"ignoreNullFields": "false"})
    else:
        # Only nested values have JSON of their own: the value is taken out of a list.
        text = F.regexp_extract(F.to_json(F.array(ready)), r"(?s)^\[(.*)\]$", 1)
    return F.when(value.isNull(), "null").otherwise(text)


def _ready(value: Column, kind: DataType, listed: bool = False) -> Column:
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        made = F.struct(*[_ready(value.getField(f.name), f.dataType).alias(f.name) for f in fields])
        return F.when(value.isNotNull(), made)
    if isinstance(kind, MapType):
        keys = F.array_sort(F.map_keys(value))
        entries = F.transform(keys, lambda k: F.struct(k.cast("string").alias("key"), _ready(value[k], kind.valueType).alias("value")))
        return F.map_from_entries(entries)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _ready(x, kind.elementType, True))
    if isinstance(kind, (TimestampType, TimestampNTZType, DateType)):
        return long_format(value)
    if listed and isinstance(kind, (DoubleType, FloatType)):
        return round_even(value.cast("double"), DIGITS)
    return value


def merge_nested(left: Column, left_kind: StructType, right: Column, right_kind: StructType) -> Column:
    """Merge two structs; fields of both are merged in turn if both are structs or maps, else the right one stands.

    A field that only one side has is kept. A struct that is null is taken for one without fields, but where both
    are null the result is null. In maps the right side's entries stand before the left side's of the same key.
    """
    ours, theirs = ({f.name: f.dataType for f in kind.fields} for kind in (left_kind, right_kind))
    out = []
    for name in [*ours, *(n for n in theirs if n not in ours)]:
        a, b = left.getField(name) if name in ours else None, right.getField(name) if name in theirs else None
        out.append(_merged(a, ours.get(name), b, theirs.get(name), right).alias(name))
    return F.when(left.isNotNull() | right.isNotNull(), F.struct(*out))


def _merged(a: Column | None, a_kind: DataType | None, b: Column | None, b_kind: DataType | None, right: Column) -> Column:
    if a is None or b is None:
        return b if a is None else a
    if isinstance(a_kind, StructType) and isinstance(b_kind, StructType):
        return merge_nested(a, a_kind, b, b_kind)
    if isinstance(a_kind, MapType) and isinstance(b_kind, MapType):
        kept = F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k))
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.map_concat(kept, b))
    # A field that is there counts also if it is null; it is not there if its struct is not.
    return F.when(right.isNull(), a.cast(b_kind)).otherwise(b)


def recursive_get(document: Column, path: str, default: Column | None = None, sep: str = ".") -> Column:
    """A member of a VARIANT object along a path of names; ``default`` only if it is missing.

    A member that is there and null is found: the result is the variant null. Something on the way that is no object
    has no members.
    """
    found = document
    for name in path.split(sep) if sep else [path]:
        found = F.try_variant_get(found, f'$["{name}"]', "variant")
    return found if default is None else F.coalesce(found, default)
