"""Profiler trees: JSON documents whose nodes nest under ``children``.

A document is walked within its row, without a join or a look at other documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from json import dumps, loads

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.json as pj
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from runledger.functions.numbers import ratio
from runledger.functions.text import normalised_tag
from runledger.sizing import quoted

# Output metric -> profiler field, fixed by the profiler's format.
METRICS = {
    "duration": "cumul-time-sum",
    "executed": "call-count-sum",
    "cnt-alloc": "memory-alloc-called-sum",
    "cnt-dealloc": "memory-dealloc-called-sum",
    "mem-alloc": "memory-alloc-sum",
    "mem-dealloc": "memory-dealloc-sum",
}
TEXTS = [*METRICS.values(), "file-path", "function", "file-line", "cumul-time-min", "cumul-time-max"]


def bracket_shape(json: Column) -> Column:
    """The list brackets of a JSON text, without those inside strings."""
    return F.regexp_replace(F.regexp_replace(json, r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]]++", "")


def bracket_depth(shape: Column) -> Column:
    """Deepest nesting of brackets: an upper bound for the levels of the document's tree."""
    state = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, char: Column) -> Column:
        now = acc["now"] + F.when(char == "[", 1).when(char == "]", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(F.split(shape, ""), state, step, lambda acc: acc["most"])


def tree_levels(documents: DataFrame, json: str) -> int:
    """Most levels of any document. Programs repeat their call trees, so few shapes are measured."""
    shapes = documents.select(bracket_shape(F.col(quoted(json))).alias("shape")).distinct()
    return shapes.agg(F.max(bracket_depth(F.col("shape")))).first()[0] or 0


NODE = {"pos": ArrayType(IntegerType())} | dict.fromkeys(("path", "parent", "tag", "node"), StringType())
NODES = ArrayType(StructType([
    StructField("name", StringType()), StructField("path", StringType()), StructField("texts", StructType([StructField(f, StringType()) for f in TEXTS]))
]))
ODD = ArrayType(StringType())
LEVELS = (4, 8, 16)  # of trees that are read as Arrow columns; deeper ones are walked one by one


def with_nodes(df: DataFrame, json: str, name: str = "nodes", normalise: bool = True) -> DataFrame:
    """Replace a JSON column by the nodes of each document's tree in preorder: an array of ``name``, ``path`` and ``texts``.

    Names are the tags, normalised unless asked otherwise; paths join them. ``texts`` are the fields that metrics are
    made of, see ``node_texts``. The walk starts at the first root child. Text that is no JSON, or nests deeper than a
    parser goes, has no nodes (null). Expressions can walk a tree of unknown depth only by copying it level by level,
    which took many times as long; so documents are walked in Arrow batches.
    """
    others = [F.col(quoted(c)) for c in df.columns if c != json]
    carried = StructType([f for f in df.schema.fields if f.name != json])
    schema = StructType([*carried.fields, StructField("__nodes", NODES), StructField("__odd", ODD)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tags, levels = {}, list(LEVELS)
        kind, odd_kind = to_arrow_type(NODES), to_arrow_type(ODD)
        fields = list(kind.value_type)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            found = _walk_levels(texts, tags, normalise, levels) or _walk_each(texts, tags, normalise)
            ends, missing, (names, paths, *values), odd = found
            structs = [names, paths, pa.StructArray.from_arrays(values, fields=list(fields[2].type))]
            at = pa.array(ends, pa.int32())
            nodes = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays(structs, fields=fields), type=kind, mask=pa.array(missing, pa.bool_()))
            plain = [all(x is None for x in odd[i:j]) for i, j in zip(ends, ends[1:])] if odd else [True] * batch.num_rows
            left = pa.ListArray.from_arrays(at, pa.array(odd or [None] * len(names), pa.string()), type=odd_kind, mask=pa.array(plain, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], nodes, left], names=schema.names)

    rows = df.select(*others, F.col(quoted(json)).cast("string").alias("__json")).mapInArrow(run, schema)
    mended = F.zip_with("__nodes", "__odd", lambda node, odd: F.when(odd.isNull(), node).otherwise(
        F.struct(node["name"].alias("name"), node["path"].alias("path"), node_texts(F.try_parse_json(odd)).alias("texts"))
    ))
    return rows.select(*others, F.when(F.col("__odd").isNull(), F.col("__nodes")).otherwise(mended).alias(name))


def _own_text(fields: dict) -> str:
    return dumps({k: v for k, v in fields.items() if k != "children"})


def _own_values(fields: dict) -> tuple:
    return tuple(map(fields.get, TEXTS))


Found = tuple[Sequence[int], Sequence[bool], list[pa.Array], list[str | None]]


def _walk_each(texts: pa.Array, tags: dict, normalise: bool) -> Found:
    """The nodes of a batch's documents, walked one by one: where each document's nodes end, which documents have none
    as they are no JSON, columns of names, paths and values, and the nodes whose values Spark is to write (``_columns``)."""
    rows, ends, missing = [], [0], []
    for text in texts.to_pylist():
        found = _walk(text, tags, normalise, _own_values)
        rows += found or []
        ends.append(len(rows))
        missing.append(found is None)
    values, odd = _columns([r[4] for r in rows])
    # Column by column: a list of objects per document took three times as long to convert.
    return ends, missing, [pa.array([r[i] for r in rows], pa.string()) for i in (3, 1)] + values, odd


def _walk_levels(texts: pa.Array, tags: dict, normalise: bool, levels: list[int]) -> Found | None:
    """What ``_walk_each`` gives, by a level of all documents at a time; None where a document is not of the profiler's
    format: another type than text in a field that is needed, no object, or more than ``LEVELS`` levels."""
    lines = [f'{{"d": [{t or "{}"}]}}' for t in texts.to_pylist()]
    data = "\n".join(lines).encode()
    whole = False
    while not whole:
        schema = pa.schema([("d", pa.list_(pa.struct([("children", pa.list_(_node_kind(levels[0])))])))])
        how = pj.ParseOptions(schema, newlines_in_values=data.count(b"\n") >= len(lines), unexpected_field_behavior="ignore")
        try:
            heads = pj.read_json(pa.py_buffer(data), pj.ReadOptions(use_threads=False, block_size=len(data) + 1), how).column("d").combine_chunks()
        except pa.ArrowInvalid:
            return None
        one = pc.list_flatten(heads)
        if len(heads) != len(lines) or len(one) != len(lines) or one.null_count or not pc.all(pc.equal(pc.list_value_length(heads), 1)).as_py():
            return None
        children = one.flatten()[0]
        owners = pc.list_parent_indices(children).to_numpy()
        first = np.flatnonzero(np.diff(owners, prepend=-1))
        nodes, above, parents = pc.list_flatten(children).take(pa.array(first)), pa.repeat("", len(first)), []
        columns = []
        while len(nodes) and len(columns) < levels[0]:
            tag, *values, children = nodes.flatten()
            names = _normalised(tag, tags) if normalise else tag
            paths = pc.binary_join_element_wise(above, names, "/")
            columns.append([names, paths, *values])
            parents.append(pc.list_parent_indices(children).to_numpy())
            nodes, above = pc.list_flatten(children), paths.take(pa.array(parents[-1]))
        whole = not len(nodes)
        if not whole and len(levels) == 1:
            return None
        if not whole:
            levels.pop(0)
    # From the last level up, each node's nodes below it; from the first down, its place in preorder.
    sizes = [np.ones(len(c[0]), np.int64) for c in columns]
    for at in range(len(sizes) - 1, 0, -1):
        sizes[at - 1] += np.bincount(parents[at - 1], sizes[at], len(sizes[at - 1])).astype(np.int64)
    counts = np.zeros(len(lines), np.int64)
    counts[owners[first]] = sizes[0] if sizes else 0
    places = []
    for at, size in enumerate(sizes):
        before = np.cumsum(size) - size
        if at:
            parent = parents[at - 1]
            before = places[-1][parent] + 1 + before - before[np.searchsorted(parent, parent)]
        places.append(before)
    order = pa.array(np.argsort(np.concatenate(places))) if places else None
    merged = [pa.concat_arrays(c).take(order) for c in zip(*columns)] or [pa.array([], pa.string())] * (2 + len(TEXTS))
    return np.concatenate([[0], np.cumsum(counts)]), np.zeros(len(lines), bool), merged, []


def _node_kind(levels: int) -> pa.DataType:
    """A node with its tag, its texts and as many levels of nodes; of those below it only tells that they are there."""
    return pa.struct([(f, pa.string()) for f in ("tag", *TEXTS)] + [("children", pa.list_(_node_kind(levels - 1)))] if levels else [])


def _normalised(tag: pa.Array, tags: dict) -> pa.Array:
    coded = tag.dictionary_encode()
    for t in coded.dictionary.to_pylist():
        if t not in tags:
            tags[t] = normalised_tag(t)
    return pa.array([tags[t] for t in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)


def _columns(values: list[tuple]) -> tuple[list[pa.Array], list[str | None]]:
    """The values of nodes as columns of texts, and for each node None, or its fields as JSON text where one of them is
    for Spark to write: a number with a fraction, an object, a list. No JSON texts at all mean that there is no such node."""
    try:
        return [pa.array(v, pa.string()) for v in zip(*values)] or [pa.array([], pa.string()) for _ in TEXTS], []
    except (pa.ArrowInvalid, pa.ArrowTypeError, UnicodeEncodeError):
        pass
    plain, odd = [], []
    for own in values:
        try:
            plain.append([_plain(v) for v in own])
            odd.append(None)
        except ValueError:
            plain.append([None] * len(own))
            odd.append(dumps(dict(zip(TEXTS, own))))
    return [pa.array(v, pa.string()) for v in zip(*plain)], odd


def _plain(value: object) -> str | None:
    """A value as Spark writes it as a text, for those that both write alike."""
    if isinstance(value, str):
        value.encode()  # half of a pair of code units is an error
        return value
    if isinstance(value, bool):
        return str(value).lower()
    if value is None or isinstance(value, int) and abs(value) < 10**18:
        return None if value is None else str(value)
    raise ValueError("not a plain value")


def _walk(text: str | None, tags: dict, normalise: bool, own: Callable[[dict], object] | None = None) -> list[tuple] | None:
    """The nodes of one document, with what ``own`` takes out of a node; ``tags`` remembers normalised tags, which programs repeat."""
    try:
        children = loads(text).get("children") if text else None
    except (ValueError, AttributeError, RecursionError):
        return None
    out, open_ = [], [([0], "", children[0])] if isinstance(children, list) and children else []
    while open_:
        pos, above, node = open_.pop()
        fields = node if isinstance(node, dict) else {}
        tag = fields.get("tag")
        tag = tag if tag is None or isinstance(tag, str) else dumps(tag)
        if normalise and tag is not None:
            if tag not in tags:
                tags[tag] = normalised_tag(tag)
            tag = tags[tag]
        path = None if tag is None or above is None else f"{above}/{tag}"
        out.append((pos, path, above, tag, own and own(fields)))
        inner = fields.get("children")
        if isinstance(inner, list):
            open_ += [([*pos, i], path, inner[i]) for i in range(len(inner) - 1, -1, -1)]
    return out


def tree_rows(df: DataFrame, key: str, json: str, normalise: bool = True, node: bool = True) -> DataFrame:
    """One row per node: key, ``pos`` (sorts them in preorder), ``path``, ``parent``, ``tag`` and, unless ``node`` is
    false, the node without its children; see ``with_nodes``."""
    source = df.select(quoted(key), F.col(quoted(json)).cast("string").alias("__json"))
    names = ["pos", "path", "parent", "tag", *(["node"] if node else [])]
    schema = StructType([source.schema[0], *(StructField(n, NODE[n]) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tags: dict = {}
        for batch in batches:
            owners, rows = [], []
            for at, text in enumerate(batch.column(1).to_pylist()):
                found = _walk(text, tags, normalise, _own_text if node else None) or []
                rows += found
                owners += [at] * len(found)
            columns = [pa.array([r[i] for r in rows], to_arrow_type(f.dataType)) for i, f in enumerate(schema.fields[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners, pa.int32())), *columns], names=schema.names)

    rows = source.mapInArrow(run, schema)
    return rows.withColumn("node", F.try_parse_json("node")) if node else rows


def node_metrics(node: str | Column = "node", processes: Column | None = None) -> list[Column]:
    """Metrics of a profiler node, divided by a process count where one is given."""
    node = F.col(node) if isinstance(node, str) else node
    return _metrics(lambda name: F.try_variant_get(node, f"$.{name}", "string"), processes)


def node_texts(node: Column) -> Column:
    """The fields of a profiler node that metrics are made of, as texts, by one cast; null if it is no object."""
    return F.try_variant_get(node, "$", f"struct<{','.join(f'{quoted(f)}:string' for f in TEXTS)}>")


def text_metrics(texts: Column, processes: Column | None = None) -> list[Column]:
    """What ``node_metrics`` gives, out of ``node_texts``."""
    return _metrics(texts.getField, processes)


def _metrics(field: Callable[[str], Column], processes: Column | None) -> list[Column]:
    metrics = [field(source).try_cast("double") for source in METRICS.values()]
    if processes is not None:
        metrics = [ratio(m, processes) for m in metrics]
    metrics = [m.alias(name) for m, name in zip(metrics, METRICS, strict=True)]
    texts = [field(f).alias(f) for f in ("file-path", "function")]
    spread = ratio(field("cumul-time-min").try_cast("double"), field("cumul-time-max").try_cast("double")).alias("dur-ratio")
    return [*metrics, *texts, field("file-line").try_cast("int").alias("file-line"), spread]


def path_digests(rows: DataFrame) -> DataFrame:
    """Add the MD5 digests of tag, path and parent."""
    return rows.withColumns({f"{c}_hash": F.md5(c) for c in ("tag", "path", "parent")})


def run_from_directory(name: Column) -> Column:
    """Run size and processes from a directory name ``case.cpus.elements``.

    A stand-in for a run that left no profile. Elements may read ``n`` or ``x_n_y``.
    """
    parts = F.split(name, r"\.")
    element = F.split(F.try_element_at(parts, F.lit(3)), "_")
    size = F.when(F.size(element) == 3, F.try_element_at(element, F.lit(2))).otherwise(F.try_element_at(element, F.lit(1)))
    count = F.size(parts)
    return F.struct(
        F.when(count.isin(2, 3), F.try_element_at(parts, F.lit(1))).otherwise(name).alias("name"),
        F.when(count.isin(2, 3), F.try_element_at(parts, F.lit(2)).try_cast("int")).otherwise(0).alias("cpus"),
        F.when(count == 3, size.try_cast("bigint")).otherwise(F.lit(0).cast("bigint")).alias("size"),
    )
