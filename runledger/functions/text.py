"""String expressions used when reports are normalised."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def normalise_tag(tag: Column) -> Column:
    """``MyTag::solve_Linear x`` becomes ``my-tag-solve-linear-x``."""
    words = F.regexp_replace(tag, "([a-z])([A-Z])", "$1-$2")
    dashed = F.lower(F.replace(F.replace(words, F.lit("::"), F.lit("-")), F.lit(" "), F.lit("-")))
    return F.regexp_replace(dashed, "[_-]+", "-")


def normalised_tag(tag: str) -> str:
    """``normalise_tag`` of one text, for code in Python tasks."""
    words = re.sub("([a-z])([A-Z])", r"\1-\2", tag)
    return re.sub("[_-]+", "-", words.replace("::", "-").replace(" ", "-").lower())


def code_point(number: Column) -> Column:
    """The character of a number below 55,296; ``chr`` of SQL starts again at 256."""
    return F.decode(F.unhex(F.lpad(F.hex(number.cast("long")), 8, "0")), "UTF-32")


def safe_name(name: Column) -> Column:
    """A name usable as a file name; null gives the empty string."""
    return F.coalesce(F.regexp_replace(name, "[^a-zA-Z0-9_-]+", "-"), F.lit(""))


def strip_prefix(text: Column, prefix: str) -> Column:
    return F.when(text.startswith(prefix), F.substr(text, F.lit(len(prefix) + 1))).otherwise(text)


def parse_bool(text: Column) -> Column:
    """yes/true/1 and no/false/0 in any case; anything else is null, for the caller to count."""
    word = F.lower(text)
    return F.when(word.isin("yes", "true", "1"), True).when(word.isin("no", "false", "0"), False)


def line_value(text: Column, prefix: str) -> Column:
    """Rest of the first line that starts with ``prefix``, else the first line; quotes removed.

    White space around the text does not count; lines end with LF, CR or both.
    """
    lines = F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\r\n|\r|\n")
    hit = F.try_element_at(F.filter(lines, lambda line: line.startswith(prefix)), F.lit(1))
    value = F.coalesce(F.substr(hit, F.lit(len(prefix) + 1)), F.try_element_at(lines, F.lit(1)))
    return F.replace(value, F.lit('"'), F.lit(""))


def option_value(options: Column, key: Column) -> Column:
    """Raw text of ``key`` in a list of ``key=value`` options (the last one wins)."""
    hits = F.filter(options, lambda o: F.substring_index(o, "=", 1) == key)
    last = F.try_element_at(hits, F.lit(-1))
    return F.substr(last, F.length(key) + 2)


def typed_option(text: Column) -> Column:
    """A text value as boolean, else integer, else string, in three nullable fields."""
    flag = F.when(F.lower(text) == "true", True).when(F.lower(text) == "false", False)
    number = F.when(flag.isNull(), text.try_cast("bigint"))
    word = F.when(flag.isNull() & number.isNull(), text)
    return F.struct(flag.alias("flag"), number.alias("number"), word.alias("word"))


def series_title(names: list[str], values: list[Column], pair: str = "%s=%s", sep: str = ", ") -> Column:
    """Title of a group from its key names and values; no keys give ``*``."""
    if not names:
        return F.lit("*")
    parts = [F.format_string(pair, F.lit(n), v.cast("string")) for n, v in zip(names, values, strict=True)]
    return F.concat_ws(sep, *parts)


def template_part(text: Column, part: int | None = None, kind: str = "s", sep: str = "_") -> Column:
    """Value of an index template such as ``<mesh|1i>``: part of a separated text, cast by kind.

    ``part`` None takes the whole text. Missing or malformed values give the default of the kind.
    """
    raw = text if part is None else F.try_element_at(F.split(text, sep), F.lit(part + 1))
    if kind == "s":
        return F.coalesce(raw, F.lit(""))
    if kind == "i":
        return F.coalesce(raw.try_cast("bigint"), F.lit(0).cast("bigint"))
    if kind == "f":
        return F.coalesce(raw.try_cast("double"), F.lit(0.0))
    if kind == "b":
        return F.coalesce(parse_bool(raw), F.lit(False))
    raise ValueError(f"unknown template cast {kind!r}")
