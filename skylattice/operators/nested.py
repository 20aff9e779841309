"""Deeply nested JSON records to related flat tables with parent-child links.

First a merged schema is inferred over all records: every path that occurs, with the kinds of value found there. Then
each array level (an array of objects or of arrays, or a lone object where other records hold an array) becomes a child
table. A child row carries the record id, the key of its parent row and its ordinal in the array. Both passes are
row-local and need no shuffle of the records; only the distinct schema paths are brought together, and their number is
bounded by the schema, not by the data.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.session import materialize

#: Records with more distinct paths than this, all taken together, have data in their keys; they are refused.
MAX_PATHS = 20_000
ARRAY = "[]"
TOO_MANY = "the records have data in their keys; name a narrower payload"


def _reject(_: str) -> None:
    raise ValueError("not JSON")


def parse_object(text: str | None, layers: int = 3) -> dict | None:
    """The JSON object in text, which may itself be kept as JSON text up to `layers` times; None for anything else."""
    value: object = text
    for _ in range(layers):
        if not isinstance(value, str):
            break
        try:
            value = json.loads(value, parse_constant=_reject)
        except (ValueError, RecursionError):
            return None
    return value if isinstance(value, dict) else None


def decoded(value: object) -> object:
    """An object or array kept as JSON text counts as what it holds; other text stays."""
    if isinstance(value, str) and value.lstrip()[:1] in ("{", "[", '"'):
        try:
            inner = json.loads(value, parse_constant=_reject)
        except (ValueError, RecursionError):
            return value
        if isinstance(inner, str):
            inner = decoded(inner)
        if isinstance(inner, (dict, list)):
            return inner
    return value


def kind(value: object) -> str:
    if isinstance(value, dict):
        return "object"
    if isinstance(value, list):
        return "array"
    if value is None:
        return "null"
    return "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string"


def paths(value: object, text_at: frozenset[str]) -> Iterator[tuple[str, str]]:
    """(path, kind) of all values below, without recursion limits; array elements are written as []."""
    stack = [("", value)]
    while stack:
        path, v = stack.pop()
        if path in text_at:
            v = decoded(v)
        yield path, kind(v)
        if isinstance(v, dict):
            stack.extend((f"{path}.{k}" if path else k, x) for k, x in v.items())
        elif isinstance(v, list):
            stack.extend((f"{path}{ARRAY}", x) for x in v)


def infer_schema(records: DataFrame, payload: str, text_at: tuple[str, ...] = ()) -> DataFrame:
    """The merged schema: path, kinds (sorted array). Every record is read; unreadable ones and null add nothing."""
    marked = frozenset(text_at)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, str]] = set()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                record = parse_object(text)
                if record is not None:
                    seen.update(paths(record, marked))
            if len(seen) > 6 * MAX_PATHS:  # six kinds: the merged schema is beyond its bound for certain
                raise ValueError(TOO_MANY)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in seen], pa.string()), pa.array([k for _, k in seen], pa.string())], ["path", "kind"])

    found = records.select(F.col(payload).cast("string")).mapInArrow(run, "path string, kind string")
    return found.groupBy("path").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def merged_schema(records: DataFrame, payload: str, text_at: tuple[str, ...] = ()) -> list[tuple[str, list[str]]]:
    """infer_schema on the driver, refused beyond MAX_PATHS paths."""
    rows = infer_schema(records, payload, text_at).limit(MAX_PATHS + 1).collect()
    if len(rows) > MAX_PATHS:
        raise ValueError(TOO_MANY)
    return [(r.path, list(r.kinds)) for r in rows]


def in_rows(path: str) -> str:
    """A schema path as the rows of tables have it: the elements of an array carry its name, those of an array in an
    array its name and []."""
    return re.sub(r"((?:\[\])+)", lambda m: m[1][2:], path)


def array_levels(schema: list[tuple[str, list[str]]], names: tuple[str, ...] = ()) -> frozenset[str]:
    """Paths that become child tables: those with arrays of objects or arrays somewhere, and those whose last name is in
    names. In other records the same path may hold a lone object, which then is a list of one."""
    kinds = {p: set(k) for p, k in schema}
    holds = lambda p: kinds.get(p + ARRAY, set()) & {"object", "array"}
    return frozenset(in_rows(p + ARRAY) for p, k in kinds.items() if p and ("array" in k and holds(p) or p.rpartition(".")[2] in names))


NODES = "record_id bigint, path string, node_key string, parent_path string, parent_key string, ordinal int, fields map<string,string>"


_text, _encoder = json.encoder.encode_basestring, json.JSONEncoder(ensure_ascii=False)


def as_json(value: object) -> str:
    if isinstance(value, str):
        return _text(value)
    if isinstance(value, bool):
        return "true" if value else "false"
    return repr(value) if isinstance(value, (int, float)) else _encoder.encode(value)


def nodes_of(record: dict, levels: frozenset[str], text_at: frozenset[str]) -> Iterator[tuple[str, str, str, str, int | None, dict]]:
    """The record's rows: one of the root table (path '') and one per element of each array level. Keys are ordinals
    joined by '/': an element's key starts with its parent's. Nulls in an array give no row but keep their place."""
    stack: list[tuple[object, str, str, str, str, int | None]] = [(record, "", "", "", "", None)]
    while stack:
        value, path, key, parent_path, parent_key, ordinal = stack.pop()
        fields: dict[str, str] = {}
        inner = [(value, path, "")]
        while inner:
            v, at, name = inner.pop()
            if at in text_at:
                v = decoded(v)
            level = at + ARRAY if path and at == path and isinstance(v, list) else at
            if level in levels and level != path and isinstance(v, (dict, list)):
                for i, x in enumerate(v if isinstance(v, list) else [v]):
                    if x is not None:
                        stack.append((x, level, f"{key}/{i}" if key else str(i), path, key, i))
            elif isinstance(v, dict):
                inner.extend((x, f"{at}.{k}" if at else k, f"{name}.{k}" if name else k) for k, x in v.items())
            elif v is not None:
                fields[name] = as_json(v)
        yield path, key, parent_path, parent_key, ordinal, fields


def flatten(records: DataFrame, record_id: str, payload: str, text_at: tuple[str, ...] = (), level_names: tuple[str, ...] = ()) -> DataFrame:
    """All flat tables as one DataFrame of rows (record_id, path, node_key, parent_path, parent_key, ordinal, fields).

    A row of table `path` belongs to the row of table `parent_path` with the same record_id and node_key = parent_key.
    fields holds the other values below the row (scalars, arrays of scalars) as JSON text, by path relative to the row. Payloads
    that are null, broken or not an object give no rows; repeated record ids give repeated rows; an empty table gives
    none. A null record_id stays null."""
    return _flattened(records, record_id, payload, text_at, array_levels(merged_schema(records, payload, text_at), level_names))


def _flattened(records: DataFrame, record_id: str, payload: str, text_at: tuple[str, ...], levels: frozenset[str]) -> DataFrame:
    marked = frozenset(text_at)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32()]
        names = ["record_id", "path", "node_key", "parent_path", "parent_key", "ordinal", "fields"]
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):  # very long payloads: small pieces bound what is held
                out, ends, keys, values = [], [0], [], []
                for rid, text in zip(*(c.to_pylist() for c in batch.slice(lo, 500).columns)):
                    record = parse_object(text)
                    if record is None:
                        continue
                    for *row, fields in nodes_of(record, levels, marked):
                        out.append((rid, *row))
                        keys.extend(fields)
                        values.extend(fields.values())
                        ends.append(len(keys))
                if out:
                    fields = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string()))
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*out), types)), fields], names)

    return records.select(F.col(record_id).cast("bigint"), F.col(payload).cast("string")).mapInArrow(run, NODES)


def text_of(value: Column) -> Column:
    """The text that a JSON string holds; other JSON as it stands."""
    return F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")


SCALARS = {"number": "double", "boolean": "boolean", "string": "string"}


def column_type(kinds: set[str], elements: set[str]) -> str | None:
    """The SQL type of a value with these kinds (and, in arrays, elements of those): null for what is a table of its own
    or never has a value, string (JSON text) for a mixture."""
    kinds, elements = kinds - {"null"}, elements - {"null"}
    if kinds == {"array"} and not elements & {"object", "array"}:
        return f"array<{SCALARS[next(iter(elements))] if len(elements) == 1 else 'string'}>"
    if not kinds or kinds <= {"object", "array"}:
        return None
    return SCALARS[next(iter(kinds))] if len(kinds) == 1 else "string"


def tables(records: DataFrame, record_id: str, payload: str, text_at: tuple[str, ...] = (), level_names: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """One typed DataFrame per table, by path ('' is the root): _record_id, _key, _parent_key and _ordinal, then a column
    for every value of the merged schema below the row, by its path relative to the row with '_' for '.', its type from
    the kinds found (a mixture is kept as JSON text). Names that clash get a number. A table joins its parent by
    (_record_id, _parent_key) = (_record_id, _key). Defined cases as in flatten."""
    schema = merged_schema(records, payload, text_at)
    levels = array_levels(schema, level_names)
    kinds = {p: set(k) for p, k in schema}
    nodes = materialize(_flattened(records, record_id, payload, text_at, levels), "nested")
    columns: dict[str, dict[str, set[str]]] = {level: {} for level in ("", *levels)}
    for p, k in kinds.items():
        # an element of an array of scalars stands in its array; all else belongs to the longest level above it
        if p.endswith(ARRAY) and in_rows(p) not in levels:
            continue
        at = in_rows(p)
        level = max((x for x in columns if at == x or not x or at.startswith(x + ".")), key=len)
        kind = column_type(k, kinds.get(p + ARRAY, set()))
        if kind and (at != level or p.endswith(ARRAY)):
            columns[level].setdefault(at[len(level) :].lstrip("."), set()).add(kind)
    out = {}
    for level, names in columns.items():
        taken, chosen = {"_record_id", "_key", "_parent_key", "_ordinal"}, []
        for name, types in sorted(names.items()):
            label = base = name.replace(".", "_") or "value"
            n = 1
            while label.lower() in taken:
                n += 1
                label = f"{base}_{n}"
            taken.add(label.lower())
            kind, value = next(iter(types)) if len(types) == 1 else "string", F.col("fields")[name]
            typed = text_of(value) if kind == "string" else F.from_json(value, kind) if kind.startswith("array") else value.try_cast(kind)
            chosen.append(typed.alias(label))
        out[level] = nodes.where(F.col("path") == level).select(F.col("record_id").alias("_record_id"), F.col("node_key").alias("_key"), F.col("parent_key").alias("_parent_key"), F.col("ordinal").alias("_ordinal"), *chosen)
    return out


# The export of one tracking frame -----------------------------------------------------------------------------------

EXPORT_TEXT = ("adversary_log",)
EXPORT_LEVELS = ("candidates", "terms", "images_saved")


def export_links(exports: DataFrame) -> DataFrame:
    """The flat tables of frame exports with their links: node pose, candidate, term or image, parent_key, child_key
    and the row's fields. Built on flatten: candidates and terms are child tables wherever they stand in
    adversary_log, images_saved is one whether it is a list of entries or an object by modality. Repeated rows of a
    payload count once; other defined cases as in flatten."""
    nodes = flatten(exports, "raw_id", "payload", EXPORT_TEXT, EXPORT_LEVELS)
    fields = F.col("fields")
    text = text_of

    def by_place(c, i):
        return F.try_element_at(F.from_json(c, "array<string>"), F.lit(i + 1))

    root = "drone_pose_world"
    xyz = [
        F.coalesce(by_place(fields[root], i), by_place(fields[f"{root}.pos"], i), F.when(fields[f"{root}.pos"].isNull(), fields[f"{root}.{c}"])).try_cast("double")
        for i, c in enumerate("xyz")
    ]
    numbers = xyz[0].isNotNull() & xyz[1].isNotNull() & xyz[2].isNotNull()
    as_node = lambda node, parent, child, values: F.struct(F.lit(node).alias("node"), parent.alias("parent_key"), child.alias("child_key"), values.alias("fields"))
    none, ordinal = F.lit(""), F.col("ordinal").cast("string")
    last = F.element_at(F.split("path", "\\."), -1)
    under_log = F.col("path").startswith("adversary_log.")
    pose = as_node("pose", none, none, F.create_map(*[x for i, c in enumerate("xyz") for x in (F.lit(c), xyz[i].cast("string"))]))
    entries = F.filter(F.map_entries(fields), lambda e: (e["key"] != "") & ~e["key"].endswith(".meta.w") & ~e["key"].endswith(".meta.h"))
    listed = as_node("image", none, text(fields["modality"]), F.create_map(F.lit("path"), text(fields["path"])))
    named = F.transform(entries, lambda e: as_node("image", none, F.regexp_replace(e["key"], r"\.path$", ""), F.create_map(F.lit("path"), text(e["value"]))))
    rows = (
        F.when((F.col("path") == "") & numbers, F.array(pose))
        .when(under_log & (last == "candidates"), F.array(as_node("candidate", none, ordinal, fields)))
        .when(under_log & (last == "terms"), F.array(as_node("term", F.element_at(F.split("parent_key", "/"), -1), ordinal, fields)))
        .when((F.col("path") == "images_saved") & fields["modality"].isNotNull(), F.array(listed))
        .when(F.col("path") == "images_saved", named)
    )
    out = nodes.select(F.col("record_id").alias("raw_id"), F.explode(rows).alias("r")).select("raw_id", "r.*")
    kept = out.where("node <> 'image' or (fields['path'] <> '' and child_key is not null)")
    return kept.groupBy("raw_id", "node", "parent_key", "child_key").agg(F.first("fields").alias("fields"))
