"""Schemas of what is read. Every field is nullable; fields a report has beyond these stay in ``rest`` (see ``shred``)."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

TEXT, INT, LONG, REAL, FLAG, TIME = StringType(), IntegerType(), LongType(), DoubleType(), BooleanType(), TimestampNTZType()


def fields(**types: DataType) -> StructType:
    """Nullable fields; two underscores in a name stand for a dash."""
    return StructType([StructField(name.replace("__", "-"), kind) for name, kind in types.items()])


# Report document, fixed by the report format.
REPORT = fields(
    system=fields(name=TEXT, hostname=TEXT, os_name=TEXT, os_version=TEXT, username=TEXT),
    problem=fields(
        application=TEXT,
        test__name=TEXT,
        case__name=TEXT,
        cpu=INT,
        cpus=REAL,
        mesh=TEXT,
        task__size=LONG,
        weak=INT,
        strong=INT,
        stage=TEXT,
        returncode=INT,
    ),
    result=fields(duration=REAL, returncode=INT),
    git=fields(name=TEXT, branch=TEXT, commit=TEXT, datetime=TIME, tag=TEXT, version=TEXT),
    index=MapType(TEXT, TEXT),
    timers=ArrayType(fields(name=TEXT, path=TEXT, duration=REAL)),
    libs=ArrayType(fields(name=TEXT, version=TEXT)),
)

# Status file next to a report.
SIDECAR = fields(returncode=INT, duration=REAL, test__name=TEXT, case__name=TEXT)

# Measured shell step.
MEASURE = fields(duration=REAL, container__duration=REAL)

_PERSON = fields(name=TEXT, email=TEXT, username=TEXT)
_COMMIT = fields(
    id=TEXT,
    tree_id=TEXT,
    distinct=FLAG,
    message=TEXT,
    timestamp=TEXT,
    url=TEXT,
    author=_PERSON,
    committer=_PERSON,
    added=ArrayType(TEXT),
    removed=ArrayType(TEXT),
    modified=ArrayType(TEXT),
)
# Push event, fixed by the hosting service's payload.
PUSH = fields(
    ref=TEXT,
    before=TEXT,
    after=TEXT,
    created=FLAG,
    deleted=FLAG,
    forced=FLAG,
    base_ref=TEXT,
    compare=TEXT,
    commits=ArrayType(_COMMIT),
    head_commit=_COMMIT,
    repository=fields(id=LONG, name=TEXT, full_name=TEXT, html_url=TEXT, default_branch=TEXT),
    pusher=fields(name=TEXT, email=TEXT),
)
