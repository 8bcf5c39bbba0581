"""Token ids in Arrow files of equal-length sequences.

A file is an Arrow IPC file; each of its record batches holds ``BATCH`` sequences of ``LENGTH`` ids as a
fixed-size list, with a mask of the same shape. Any sequence, and so any run of ids, is found by arithmetic and
read through a memory map without a copy. Documents follow each other without gaps; only the last sequence
of a file is padded, with mask false. Files are ordered by their number, documents in them by id.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from runledger.llm.common import PART_BYTES, file_system, shared_folder, text_slices

LENGTH = 1024
BATCH = 64
# Distinct pieces whose ids a Python worker remembers.
REMEMBERED = 1_000_000
# Pieces that the library encodes at once, and bytes of text whose pieces are held at once: its result takes some
# hundred bytes a piece, and a worker does not give back what it once took.
LEARNT, HELD_BYTES = 4096, PART_BYTES

INDEX = T.StructType(
    [
        T.StructField("file_no", T.IntegerType()),
        T.StructField("file", T.StringType()),
        T.StructField("doc_no", T.LongType()),
        T.StructField("first", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
    ]
)


def _plain_pieces() -> re.Pattern:
    """Pieces of lower-cased text below U+0180: the pre-tokenizer's own pattern, with its classes spelled out."""
    kinds: dict[str, str] = {"L": "", "N": ""}
    for char in map(chr, range(0x180)):
        kind = unicodedata.category(char)[0]
        if kind in kinds:
            kinds[kind] += char
    blank = "\\t-\\r \x85\xa0"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{kinds['L']}]+|[{kinds['N']}]|[^{blank}{kinds['L']}{kinds['N']}]+")


class Encoder:
    """Ids of texts by the tokenizers library, which sees each distinct piece once.

    For a tokenizer that lower-cases and then works on pieces by the pattern below, a plain text (nothing from
    U+0180 on, no special token, so that composing characters changes nothing) is cut into pieces here, and the
    library encodes the pieces not seen before. Other texts, and other tokenizers, get whole texts.
    """

    # The pre-tokenizer's pattern in the vocabulary file that the pieces stand for.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    PLAIN = bytes(range(128)) + bytes(range(0x80, 0xC0)) + bytes(range(0xC2, 0xC6))

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = end
        self.dtype = np.dtype(np.uint16 if max(self.tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else np.uint32)
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        split = (parts.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        steps = [x.get("type") for x in (parts.get("normalizer") or {}).get("normalizers", [])]
        self.by_piece = (split.get("pattern") or {}).get("Regex") == self.PATTERN and steps == ["NFC", "Replace", "Lowercase"]
        self.special = [t["content"].encode() for t in parts.get("added_tokens", [])] + ["\u0130".encode()]
        self.pieces = _plain_pieces()
        self._forget()

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.size, self.used = np.zeros(1 << 16, np.int64), 1
        self.begin = np.zeros(1 << 16, np.int64)
        self.flat, self.filled = np.zeros(1 << 18, self.dtype), 1
        self.flat[0], self.size[0] = self.end, 1  # number 0 is the end of a document

    def _remember(self, ids: np.ndarray, sizes: np.ndarray) -> range:
        while self.used + len(sizes) > len(self.size):
            self.size, self.begin = np.resize(self.size, 2 * len(self.size)), np.resize(self.begin, 2 * len(self.begin))
        while self.filled + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.filled : self.filled + len(ids)] = ids
        self.size[self.used : self.used + len(sizes)] = sizes
        self.begin[self.used : self.used + len(sizes)] = self.filled + np.cumsum(sizes) - sizes
        self.used += len(sizes)
        self.filled += len(ids)
        return range(self.used - len(sizes), self.used)

    def _learn(self, pieces: list[str]) -> None:
        for at in range(0, len(pieces), LEARNT):
            some = pieces[at : at + LEARNT]
            coded = self.tokenizer.encode("\n".join(some), add_special_tokens=False)
            sizes = np.bincount(np.array(coded.word_ids, np.int64), minlength=len(some))
            self.number.update(zip(some, self._remember(np.array(coded.ids, self.dtype), sizes), strict=True))

    def _is_plain(self, text: bytes) -> bool:
        return self.by_piece and not text.translate(None, self.PLAIN) and not any(s in text for s in self.special)

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by the end id, and how many each has."""
        if len(self.number) > REMEMBERED or self.filled > 1 << 24:
            self._forget()
        parts = [self.pieces.findall(t.decode().lower()) if t and self._is_plain(t) else None for t in texts]
        unknown = set().union(*[p for p in parts if p]).difference(self.number)
        if unknown:
            self._learn(list(unknown))
        get, order = self.number.__getitem__, []
        for text, part in zip(texts, parts, strict=True):
            if part is not None:
                order.extend(map(get, part))
            elif text:
                ids = self._encode([text.decode("utf-8", "replace")])[0]
                order.extend(self._remember(np.array(ids, self.dtype), np.array([len(ids)])))
            order.append(0)
        numbers = np.array(order, np.int64)
        sizes = self.size[numbers]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.begin[numbers] - (ends - sizes), sizes) + np.arange(total)]
        return ids, np.diff(ends[numbers == 0], prepend=0)


@lru_cache(maxsize=2)
def _encoder(path: str, end: int) -> Encoder:
    return Encoder(path, end)


class _Writer:
    """Cuts a stream of ids into sequences and record batches."""

    def __init__(self, folder: str, name: str, dtype: np.dtype):
        system, path = file_system(folder)
        system.create_dir(path, recursive=True)
        values = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(values, LENGTH)), ("mask", pa.list_(pa.bool_(), LENGTH))])
        self.sink = system.open_output_stream(f"{path}/{name}")
        self.file = ipc.new_file(self.sink, self.schema)
        self.waiting: list[np.ndarray] = []
        self.held = 0
        self.dtype = dtype

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.held += len(ids)
        whole = LENGTH * BATCH
        if self.held >= whole:
            ids = np.concatenate(self.waiting)
            cut = len(ids) - len(ids) % whole
            for at in range(0, cut, whole):
                self._write(ids[at : at + whole], whole)
            self.waiting, self.held = [ids[cut:].copy()], len(ids) - cut

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = pa.array(np.arange(len(ids)) < real)
        lists = [pa.FixedSizeListArray.from_arrays(x, LENGTH) for x in (pa.array(ids), mask)]
        self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.held:
            ids = np.concatenate(self.waiting)
            padded = np.zeros(-(-len(ids) // LENGTH) * LENGTH, self.dtype)
            padded[: len(ids)] = ids
            self._write(padded, len(ids))
        self.file.close()
        self.sink.close()


class SequenceFile:
    """Random access to the ids of one file."""

    def __init__(self, folder: str, name: str):
        system, path = file_system(folder)
        whole = f"{path}/{name}"
        self.source = pa.memory_map(whole) if os.path.exists(whole) else system.open_input_file(whole)
        self.reader = ipc.open_file(self.source)
        self.at, self.batch = -1, None

    def _load(self, at: int) -> pa.RecordBatch:
        if at != self.at:
            self.at, self.batch = at, self.reader.get_batch(at)
        return self.batch

    def sequence(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of one sequence."""
        batch, row = self._load(number // BATCH), number % BATCH
        ids = batch.column(0).flatten().to_numpy(zero_copy_only=True)
        mask = batch.column(1).flatten().to_numpy(zero_copy_only=False)
        return ids[row * LENGTH : (row + 1) * LENGTH], mask[row * LENGTH : (row + 1) * LENGTH]

    def ids(self, first: int, count: int) -> np.ndarray:
        """A run of ids that may go over sequences and batches."""
        whole, parts = LENGTH * BATCH, []
        while count > 0:
            values = self._load(first // whole).column(0).flatten().to_numpy(zero_copy_only=True)
            part = values[first % whole : first % whole + count]
            parts.append(part)
            first, count = first + len(part), count - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate([*parts, np.zeros(0, np.uint16)])

    def close(self) -> None:
        self.source.close()


def write_sequences(docs: DataFrame, tokenizer: str, folder: str, end: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenize whole texts and write them in ascending order of ``doc_id``; returns the stored index.

    Rows are dealt by ranges of ``doc_id`` (ties and repeated rows follow each other, by text; a null id comes
    first) and each task writes one file of its own name, so a repeated attempt spoils nothing: only files
    named in the index count. A null or empty text has the end id alone; an empty table gives no file.
    """
    source = docs.select(docs[f"`{doc_id}`"].alias("doc_no"), F.coalesce(docs[f"`{text}`"].cast("string"), F.lit("")).alias("content"))
    ordered = source.repartitionByRange("doc_no").sortWithinPartitions("doc_no", "content")
    schema = T.StructType([*INDEX.fields[:2], T.StructField("doc_no", source.schema["doc_no"].dataType), *INDEX.fields[3:]])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, first = _encoder(tokenizer, end), None, 0
        number = TaskContext.get().partitionId()
        name = f"tokens-{number:06d}-{uuid.uuid4().hex}.arrow"
        for batch in batches:
            for low, high, texts in text_slices(batch.column(1), HELD_BYTES):
                if writer is None:
                    writer = _Writer(folder, name, encoder.dtype)
                ids, counts = encoder.encode(texts)
                writer.add(ids)
                begin = first + np.cumsum(counts) - counts
                first += len(ids)
                own = batch.column(0).slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(counts), pa.int32()), pa.array([name] * len(counts)), own, pa.array(begin), pa.array(counts)],
                    names=[f.name for f in schema],
                )
        if writer is not None:
            writer.close()

    index = f"{folder}/index"
    ordered.mapInArrow(write, schema).write.parquet(index)
    return docs.sparkSession.read.schema(schema).parquet(index)


def read_sequences(index: DataFrame, folder: str) -> DataFrame:
    """One row per document from its file: ``doc_no``, ``start`` (ids of all documents before it), ``n_tokens``
    and ``ids_crc32`` over the ids as little-endian unsigned 32-bit integers."""
    files = index.groupBy("file_no", "file").agg(F.sum("n_tokens").alias("total"))
    before = F.coalesce(F.sum("total").over(W.orderBy("file_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    files = files.select("file", before.alias("before"))
    rows = index.join(files, "file").select("file", "first", "n_tokens", "doc_no", (F.col("before") + F.col("first")).alias("start"))
    rows = rows.repartition("file").sortWithinPartitions("file", "first")
    schema = T.StructType([index.schema["doc_no"], T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            names, firsts, counts = (batch.column(i).to_pylist() for i in range(3))
            sums = []
            for own, first, count in zip(names, firsts, counts, strict=True):
                if own != name:
                    if file is not None:
                        file.close()
                    name, file = own, SequenceFile(folder, own)
                sums.append(zlib.crc32(file.ids(first, count).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(4), batch.column(2), pa.array(sums, pa.int64())], names=[f.name for f in schema])

    return rows.mapInArrow(read, schema)


def token_table(spark: SparkSession, docs: DataFrame, tokenizer: str, end: int = 1) -> DataFrame:
    """Write all documents in the shared folder and read them back."""
    folder = shared_folder(spark, "tokens")
    index = write_sequences(docs, tokenizer, folder, end)
    return read_sequences(index, folder).withColumnRenamed("doc_no", "doc_id")
