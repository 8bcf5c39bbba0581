"""What several corpus operators need: words, slices of Arrow batches, and the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, types as T

from runledger.session import shared_folder, stored

__all__ = ["PART_BYTES", "add_columns", "as_bytes", "file_system", "free_name", "mixed", "prefix_hashes", "shared_folder", "slices", "stored", "text_slices", "word_hashes", "words"]

# Text that one step of a Python worker looks at; whole documents only, so one long document may exceed it.
SLICE_BYTES = 1 << 20
# The same where arrays over all n-grams, shingles or pieces of the text are made: they take about a hundred bytes for
# a byte of text, and a worker does not give back what it once took.
PART_BYTES = 1 << 18

_LETTERS = bytes(range(48, 58)) + bytes(range(97, 123))
# Lower-cases A-Z and turns every other ASCII character that is no word character into a blank.
WORD_TABLE = bytes(
    c if c > 127 else (c | 32 if 65 <= c <= 90 else (c if c in _LETTERS else 32)) for c in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text: runs of 0-9, a-z and anything beyond ASCII, after lower-casing A-Z."""
    return text.translate(WORD_TABLE).split() if text else []


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it of a folder in the shared place."""
    return fs.FileSystem.from_uri(uri)


def free_name(wanted: str, taken: list[str]) -> str:
    """A column name that no column of a table has."""
    names = {c.lower() for c in taken}
    while wanted.lower() in names:
        wanted += "_"
    return wanted


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def slices(texts: list[bytes | None], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive runs of texts of about ``most`` bytes."""
    return _cuts([len(text or b"") for text in texts], most)


def text_slices(column: pa.Array, most: int = PART_BYTES) -> Iterator[tuple[int, int, list[bytes | None]]]:
    """Such runs of a column's texts, of which only one at a time is held as Python objects."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for begin, end in _cuts(sizes, most):
        yield begin, end, as_bytes(column.slice(begin, end - begin))


def _cuts(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    begin = held = 0
    for at, size in enumerate(sizes):
        held += size
        if held >= most:
            yield begin, at + 1
            begin, held = at + 1, 0
    if begin < len(sizes):
        yield begin, len(sizes)


def add_columns(
    df: DataFrame, text: str, fields: list[T.StructField], work: Callable[[list], dict[str, list]], keep: list[str] | None = None
) -> DataFrame:
    """Append columns computed from one text column, in Arrow batches.

    ``work`` takes a list of texts (bytes or None) and gives a list of values for each new field. ``keep``
    names the columns carried along (all by default); one that has the name of a new field gives way to it.
    Texts go to the workers once, also where the text column is carried along.
    """
    new = {f.name.lower() for f in fields}
    carried = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    source = df.select(*[df[f"`{c}`"] for c in carried])
    schema = T.StructType([*source.schema.fields, *fields])
    if text in carried and source.schema[text].dataType == T.StringType():
        place = carried.index(text)
    else:
        place = len(carried)
        source = df.select(*[df[f"`{c}`"] for c in carried], df[f"`{text}`"].cast("string").alias(free_name("__text", carried)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            for begin, end, texts in text_slices(batch.column(place)):
                part, found = batch.slice(begin, end - begin), work(texts)
                arrays = [part.column(i).cast(target.field(i).type) for i in range(len(carried))]
                arrays += [pa.array(found[f.name], target.field(len(arrays) + i).type) for i, f in enumerate(fields)]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return source.mapInArrow(run, schema)


_RANDOM = np.random.default_rng(20240607)
_BYTE_VALUES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = int(_RANDOM.integers(1, 2**62)) * 2 + 1
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]), 2 * PART_BYTES)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def prefix_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums from which ``(sums[end] - sums[begin]) * inverse[begin]`` hashes any run of bytes."""
    forward, back = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * forward[: len(data)], out=sums[1:])
    return sums, back


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of hashes evenly."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the number of words of each text."""
    joined = b" ".join([t or b"" for t in texts]).translate(WORD_TABLE)
    data = np.frombuffer(b" " + joined + b" ", np.uint8)
    inside = data != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    begin, end = edges[::2], edges[1::2]
    sums, back = prefix_hashes(data)
    hashes = mixed((sums[end] - sums[begin]) * back[begin])
    sizes = np.fromiter((len(t or b"") for t in texts), np.int64, len(texts))
    limits = np.concatenate(([0], np.cumsum(sizes + 1))) + 1
    return hashes, np.diff(np.searchsorted(begin, limits))
