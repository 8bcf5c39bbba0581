"""WARC archives: an index first, then sorted and coalesced byte-range reads.

Records are written as gzip members, one file for each task, while offset, length, URL and digest of every record go
to the index. Readers choose records in the index, sort them by file and offset, join ranges that lie close
together, and fetch each range once.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from runledger.llm.common import file_system, shared_folder, stored

# Ranges closer than this are read at once, up to so many bytes in one read.
GAP = 64 << 10
RANGE = 8 << 20

INDEX = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
    ]
)
RECORD = T.StructType(
    [
        T.StructField("page_id", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.StringType()),
    ]
)


def digest(payload: bytes) -> str:
    """Bare base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(page_id: str | None) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"


def record(page_id: str | None, url: str | None, payload: bytes, name: str, size: int, refers_to: str | None) -> bytes:
    """One record as a gzip member; a revisit has the digest and length of the payload it leaves out."""
    revisit = refers_to is not None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_uri(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        # Header lines may not hold line ends.
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{name}",
        f"X-Payload-Length: {size}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_uri(refers_to)}"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> dict:
    """Fields of ``RECORD`` from one gzip member; a response's digest and length come from its payload."""
    content = zlib.decompress(member, 31)
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    own = fields["WARC-Record-ID"]
    page = own[len("<urn:page:") : -1] if own.startswith("<urn:page:") else None
    out = {"page_id": page, "record_type": fields["WARC-Type"], "refers_to": None}
    if out["record_type"] == "revisit":
        out["refers_to"] = fields["WARC-Refers-To"][len("<urn:page:") : -1]
        return out | {"payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": fields["WARC-Payload-Digest"][5:]}
    payload = block.partition(b"\r\n\r\n")[2]
    return out | {"payload_bytes": len(payload), "payload_digest": digest(payload)}


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Write a record for each page; returns the stored index.

    Of pages with equal payloads of at least ``least`` bytes the one with the largest id is a response (all rows with
    that id, if it is repeated) and the others revisit it; groups are found by counting digests, which combines
    before the shuffle, so only the small digest rows of a hot payload meet. A null html is an empty payload; a page
    without id is always a response; a null url is empty. A task writes a file under a name of its own: an attempt
    that is repeated leaves a file that the index does not name.
    """
    rows = pages.select(
        pages[f"`{page_id}`"].alias("page_id"),
        pages[f"`{url}`"].cast("string").alias("url"),
        F.encode(F.coalesce(pages[f"`{html}`"].cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("sha", F.unhex(F.sha1("payload")))
    groups = rows.filter(F.octet_length("payload") >= least).groupBy("sha").agg(F.max("page_id").alias("head"), F.count(F.lit(1)).alias("n"))
    joined = rows.join(groups.filter("n > 1").drop("n"), "sha", "left")
    refers = F.when(F.col("page_id").isNotNull() & (F.octet_length("payload") >= least) & (F.col("page_id") != F.col("head")), F.col("head"))
    ready = joined.select(F.col("page_id").cast("string"), "url", "payload", refers.cast("string").alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, sink, offset = f"pages-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            if batch.num_rows and sink is None:
                system, path = file_system(folder)
                system.create_dir(path, recursive=True)
                sink = system.open_output_stream(f"{path}/{name}", compression=None)
            out: dict[str, list] = {f.name: [] for f in INDEX}
            for page, address, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sha = digest(payload)
                member = record(page, address, payload, sha, len(payload), refers_to)
                sink.write(member)
                values = (name, offset, len(member), address, sha, "response" if refers_to is None else "revisit")
                for field, value in zip(INDEX, values, strict=True):
                    out[field.name].append(value)
                offset += len(member)
            yield pa.RecordBatch.from_pydict(out, schema=_arrow(INDEX))
        if sink is not None:
            sink.close()

    return stored(ready.mapInArrow(write, INDEX), "warc-index")


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def coalesced(ranges: Iterator[tuple[str, int, int]], gap: int = GAP, most: int = RANGE) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Joins sorted (file, offset, length) to (file, begin, end, members) as long as they lie close together."""
    file, begin, end, members = None, 0, 0, []
    for name, offset, length in ranges:
        if name != file or offset > end + gap or offset + length - begin > most:
            if members:
                yield file, begin, end, members
            file, begin, end, members = name, offset, offset, []
        members.append((offset, length))
        end = max(end, offset + length)
    if members:
        yield file, begin, end, members


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """The records that the index rows name, in the fields of ``RECORD``.

    Index rows are dealt by file and stretch of ``RANGE`` bytes, so one large file keeps many tasks busy.
    """
    stretch = F.floor(F.col("offset") / RANGE)
    chosen = index.select("file", "offset", "length", stretch.alias("stretch")).repartition("file", "stretch").sortWithinPartitions("file", "offset")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int]]:
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = file_system(folder)
        name, source = None, None
        for file, begin, end, members in coalesced(ranges(batches)):
            if file != name:
                if source is not None:
                    source.close()
                name, source = file, system.open_input_file(f"{path}/{file}")
            content = source.read_at(end - begin, begin)
            found = [parse(content[at - begin : at - begin + length]) for at, length in members]
            yield pa.RecordBatch.from_pylist(found, schema=_arrow(RECORD))
        if source is not None:
            source.close()

    return chosen.mapInArrow(read, RECORD)


def archive_table(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back; ids have the type they had."""
    folder = shared_folder(spark, "warc")
    found = read_archives(write_archives(pages, folder), folder)
    kind = pages.schema["page_id"].dataType
    return found.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))
