"""JSON documents as typed columns without loss: what the schema does not name stays in VARIANT columns ``rest``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, StructField, StructType, VariantType

from runledger.sizing import quoted

REST = "rest"


def with_rest(kind: DataType) -> DataType:
    """A schema with a field ``rest`` in every struct: what ``shred`` gives."""
    if isinstance(kind, StructType):
        return StructType([*(StructField(f.name, with_rest(f.dataType)) for f in kind.fields), StructField(REST, VariantType())])
    return ArrayType(with_rest(kind.elementType)) if isinstance(kind, ArrayType) else kind


def member(document: Column, name: str, kind: str = "variant") -> Column:
    """A member of a VARIANT object by its name, dots and dashes included; null if missing or of another kind."""
    return F.try_variant_get(document, f'$["{name}"]', kind)


def _ddl(kind: DataType) -> str:
    if isinstance(kind, StructType):
        return f"struct<{','.join(f'{quoted(f.name)}:{_ddl(f.dataType)}' for f in kind.fields)}>"
    return f"array<{_ddl(kind.elementType)}>" if isinstance(kind, ArrayType) else kind.simpleString()


def shred(df: DataFrame, document: str, schema: StructType) -> DataFrame:
    """The members of a VARIANT column as typed columns by ``schema`` and a column ``rest``, in place of the variant.

    The rest holds each member that the schema does not name, or whose value is null or does not fit the schema's
    type; so no member is lost. It is null if there is none. Structs inside have a ``rest`` of their own, and an
    array's element that is no object keeps its place and stands whole in it.
    """
    others = [F.col(quoted(c)) for c in df.columns if c != document]
    # One cast types the whole document; a value that does not fit is null wherever it stands.
    rows = df.select(*others, document, F.try_variant_get(document, "$", _ddl(schema)).alias("__typed"))
    fields = _fields(F.col("__typed"), F.col(document), schema)
    return rows.select(*others, *[c.alias(name) for name, c in fields.items()])


def _fields(typed: Column, document: Column, schema: StructType) -> dict[str, Column]:
    known = [f.name for f in schema.fields]
    placed = F.filter(F.array(*[F.when(typed.getField(n).isNotNull(), F.lit(n)) for n in known]), lambda x: x.isNotNull())
    members = F.try_variant_get(document, "$", "map<string,variant>")
    left = _once(
        F.struct(members.alias("members"), placed.alias("placed")),
        lambda x: F.map_filter(x["members"], lambda name, _: ~F.array_contains(x["placed"], name)),
    )
    rest = _once(left, lambda x: F.when(F.size(x) > 0, F.to_variant_object(x)))
    columns = {f.name: _value(typed.getField(f.name), document, f.name, f.dataType) for f in schema.fields}
    return {**columns, REST: rest}


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """An expression over a value that is worked out once for the row; a lambda's body works it out for every member."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _value(typed: Column, document: Column, name: str, kind: DataType) -> Column:
    if isinstance(kind, StructType):
        columns = _fields(typed, member(document, name), kind)
        return F.when(typed.isNotNull(), F.struct(*[c.alias(n) for n, c in columns.items()]))
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
        return F.zip_with(typed, member(document, name, "array<variant>"), lambda t, raw: _element(t, raw, kind.elementType))
    return typed


def _element(typed: Column, raw: Column, kind: StructType) -> Column:
    columns = _fields(typed, raw, kind)
    columns[REST] = F.when(typed.isNotNull(), columns[REST]).otherwise(raw)
    return F.struct(*[c.alias(name) for name, c in columns.items()])
