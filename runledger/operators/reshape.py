"""Reshaping of nested reports. Schemas are walked when the plan is built; rows stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from runledger.sizing import quoted


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested fields become top-level columns with joined names; arrays stay whole."""

    def leaves(schema: StructType, path: list[str]) -> Iterable[list[str]]:
        for field in schema.fields:
            here = [*path, field.name]
            if isinstance(field.dataType, StructType):
                yield from leaves(field.dataType, here)
            else:
                yield here

    return df.select(*[F.col(".".join(f"`{p}`" for p in leaf)).alias(sep.join(leaf)) for leaf in leaves(df.schema, [])])


def unwind(df: DataFrame, source: str = "timers", target: str = "timer") -> DataFrame:
    """One row per list item with the other fields copied; an empty or missing list gives no rows."""
    return df.select("*", F.explode(quoted(source)).alias(target)).drop(source)


def nested_value(path: str, default: object = None, sep: str = ".") -> Column:
    """Value at a nested path, or the default where it is null."""
    value = F.col(".".join(f"`{p}`" for p in path.split(sep)))
    return value if default is None else F.coalesce(value, F.lit(default))


def cast_by_pattern(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast every field whose name starts with a match of a pattern, in structs and lists as well.

    Patterns are tried in order and the first match decides; values that do not parse become null.
    """
    compiled = [(re.compile(pattern), kind) for pattern, kind in types.items()]

    def convert(value: Column, name: str, kind: DataType) -> Column:
        for pattern, target in compiled:
            if pattern.match(name):
                return value.try_cast(target)
        if isinstance(kind, StructType):
            inner = [convert(value.getField(f.name), f.name, f.dataType).alias(f.name) for f in kind.fields]
            return F.when(value.isNotNull(), F.struct(*inner))
        if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
            return F.transform(value, lambda item: convert(item, "", kind.elementType))
        return value

    return df.select(*[convert(F.col(quoted(f.name)), f.name, f.dataType).alias(f.name) for f in df.schema.fields])


def merge_reports(
    base: DataFrame,
    update: DataFrame,
    key: str,
    sections: Iterable[str] = ("system", "problem", "result", "git"),
    lists: Iterable[str] = ("timers", "libs"),
) -> DataFrame:
    """Merge an update into each report of the same key.

    Sections take the update's non-null fields one by one, lists are extended, any other field is
    replaced where the update has it. Reports without an update stay as they are.
    """
    new = update.select(*[F.col(quoted(c)).alias(f"__new_{c}") for c in update.columns])
    joined = base.join(new, base[quoted(key)] == new[quoted(f"__new_{key}")], "left")
    result = []
    for field in base.schema.fields:
        name, old = field.name, F.col(quoted(field.name))
        if name == key or name not in update.columns:
            result.append(old)
            continue
        fresh = F.col(quoted(f"__new_{name}"))
        if name in sections:
            present = {f.name for f in update.schema[name].dataType.fields}
            parts = [
                F.coalesce(fresh.getField(f.name), old.getField(f.name)).alias(f.name)
                if f.name in present
                else old.getField(f.name).alias(f.name)
                for f in field.dataType.fields
            ]
            added = [fresh.getField(f.name).alias(f.name) for f in update.schema[name].dataType.fields
                     if f.name not in {g.name for g in field.dataType.fields}]
            result.append(F.struct(*parts, *added).alias(name))
        elif name in lists:
            result.append(F.coalesce(F.concat(old, F.coalesce(fresh, F.slice(old, 1, 0))), old, fresh).alias(name))
        else:
            result.append(F.coalesce(fresh, old).alias(name))
    extra = [F.col(quoted(f"__new_{c}")).alias(c) for c in update.columns if c not in base.columns]
    return joined.select(*result, *extra)


def head_and_tail(df: DataFrame, source: str, head_field: str, head: str) -> DataFrame:
    """Take a field of the first list item as a column and keep the rest of the list."""
    items = F.col(quoted(source))
    first = F.try_element_at(items, F.lit(1))
    rest = F.when(F.size(items) > 0, F.slice(items, F.lit(2), F.size(items))).otherwise(items)
    return df.withColumns({head: first.getField(head_field), source: rest})


def wide_to_long(df: DataFrame, ids: list[str], values: list[str], name: str = "frame", value: str = "walltime") -> DataFrame:
    return df.unpivot(ids, values, name, value)


def timers_to_columns(df: DataFrame, key: str, names: list[str], prefix: str = "walltime_") -> DataFrame:
    """One column per timer name with the report's first duration of that name.

    The timers of a report sit in its own row, so no shuffle is needed.
    """
    def duration(name: str) -> Column:
        hits = F.filter("timers", lambda t: t["name"] == name)
        return F.try_element_at(hits, F.lit(1)).getField("duration").alias(prefix + name)

    return df.select(key, *[duration(n) for n in names])


def one_report_per_timer(df: DataFrame, run_source: str) -> DataFrame:
    """Split a report in one per timer; they share ``index.run_id`` and carry ``index.frame``.

    The run id is a digest of the source path, so a task that runs again writes the same id.
    """
    return df.select("*", F.explode("timers").alias("timer")).select(
        F.sha2(F.col(quoted(run_source)).cast("string"), 256).alias("run_id"),
        F.col("timer.name").alias("frame"),
        *[F.col(quoted(c)) for c in df.columns if c not in ("timers", "result")],
        F.col("timer").alias("result"),
    )


def merge_maps(left: Column, right: Column) -> Column:
    """Merge two maps; the right one wins on a shared key."""
    kept = F.map_filter(left, lambda k, v: ~F.array_contains(F.map_keys(right), k))
    return F.map_concat(kept, right)


def match_unwind_select(
    df: DataFrame, match: Column | None, unwind_from: str | None, columns: list[Column], after: Column | None = None
) -> DataFrame:
    """Filter, unwind, filter again on the item, and project, in that order."""
    result = df if match is None else df.where(match)
    if unwind_from:
        result = result.withColumn(unwind_from, F.explode(quoted(unwind_from)))
    if after is not None:
        result = result.where(after)
    return result.select(*columns)


def attach_constants(df: DataFrame, section: str, values: dict[str, object]) -> DataFrame:
    """Set constant fields in a section of every report."""
    value = F.col(quoted(section))
    for name, constant in values.items():
        value = value.withField(name, F.lit(constant))
    return df.withColumn(section, value)


__all__ = [
    "attach_constants",
    "cast_by_pattern",
    "flatten",
    "head_and_tail",
    "match_unwind_select",
    "merge_reports",
    "nested_value",
    "one_report_per_timer",
    "merge_maps",
    "timers_to_columns",
    "unwind",
    "wide_to_long",
]
