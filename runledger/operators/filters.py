"""Predicates, built when the plan is made so that Catalyst can push them into the scan."""

from __future__ import annotations

import datetime as dt
import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from runledger.functions.dates import from_epoch
from runledger.functions.text import strip_prefix
from runledger.sizing import quoted

# Values that mean "do not filter on this field".
ANY_VALUE = ("", None, "*")


def without_wildcards(filters: dict[str, object]) -> dict[str, object]:
    return {k: v for k, v in filters.items() if v not in ANY_VALUE}


def equal_to(filters: dict[str, object], mapping: dict[str, Column] | None = None) -> Column:
    """All fields equal their values; wildcards are skipped."""
    tests = []
    for name, value in without_wildcards(filters).items():
        column = mapping[name] if mapping and name in mapping else F.col(quoted(name))
        tests.append(column == F.lit(value))
    return reduce(and_, tests, F.lit(True))


def match_rules(**rules: object) -> Column:
    """A list means membership, a scalar equality, None no test; ``_a_b`` names the field ``a-b``."""
    tests = []
    for name, value in rules.items():
        if value is None:
            continue
        field = name[1:].replace("_", "-") if name.startswith("_") else name
        column = F.col(quoted(field))
        tests.append(column.isin(value) if isinstance(value, list) else column == F.lit(value))
    return reduce(and_, tests, F.lit(True))


def between_epochs(column: Column, start: str | int, stop: str | int) -> Column:
    """Inclusive time range given as epoch seconds, in UTC."""
    return column.between(from_epoch(F.lit(int(start))), from_epoch(F.lit(int(stop))))


def newer_than(column: Column, as_of: dt.datetime, months: int = 6) -> Column:
    return column >= F.add_months(F.lit(as_of), -months)


def combine_filters(*levels: dict[str, object]) -> dict[str, object]:
    """Filters of nested test levels; a parent, given first, overrides its children."""
    result: dict[str, object] = {}
    for level in reversed(levels):
        result.update(level)
    return result


def level_filters(
    path: list[dict[str, object]], names: tuple[str, ...] = ("problem.test", "problem.case", "problem.subcase")
) -> dict[str, object]:
    """Filters of a path of nested tests.

    Each level filters its own field by the level's name. ``level`` renames that field; an explicit
    null switches it off. A level's ``filters`` are added, and a parent's win over a child's.
    """
    levels = []
    for depth, item in enumerate(path):
        own: dict[str, object] = dict(item.get("filters", {}))
        field = item.get("level", names[depth] if depth < len(names) else None)
        if field is not None:
            own[str(field)] = item["name"]
        levels.append(own)
    return combine_filters(*levels)


def group_filters(values: dict[str, object], groups: dict[str, str | None]) -> dict[str, object]:
    """Filters given by group alias or by raw field name, as field filters; wildcards are skipped."""
    kept = without_wildcards(values)
    result = {field: kept[alias] for alias, field in groups.items() if field is not None and alias in kept}
    result.update({name: value for name, value in kept.items() if name not in groups or groups[name] is None})
    return result


def with_values(d: dict, required: tuple | None = None, forbidden: tuple | None = None) -> dict:
    """Keep the entries whose value is among the required ones and not forbidden."""
    return {k: v for k, v in d.items() if (not required or v in required) and (not forbidden or v not in forbidden)}


def with_names(d: dict, required: tuple | None = None, forbidden: tuple | None = None) -> dict:
    """Keep the entries whose key is among the required ones and not forbidden."""
    return {k: v for k, v in d.items() if (not required or k in required) and (not forbidden or k not in forbidden)}


def branch_matches(ref: Column, patterns: list[str] | str | None) -> Column:
    """Any pattern matches the start of the full reference or of the short branch name.

    ``*`` stands for any text; the rest of a pattern is a regular expression.
    """
    listed = [patterns] if isinstance(patterns, str) else patterns or ["*"]
    for pattern in listed:
        re.compile(pattern.replace("*", ".*"))
    short = strip_prefix(ref, "refs/heads/")
    tests = [c.rlike("^(?:" + p.replace("*", ".*") + ")") for p in listed for c in (short, ref)]
    return reduce(or_, tests)


def members(df: DataFrame, column: str, selected: DataFrame) -> DataFrame:
    """Rows whose key is in the first column of ``selected``: a semi join, whatever its size."""
    ids = selected.select(F.col(quoted(selected.columns[0])).alias("__id"))
    return df.join(ids, df[quoted(column)] == ids["__id"], "left_semi")
