"""Columnar shredding of nested records, and flat tables put together again from the levels.

A nested record becomes, for every leaf path, a column of values with a repetition level (which
repeated ancestor starts anew) and a definition level (how far down the path is present). The
tables of files, checkers, statements, periods, rows, values and inputs are read back from those sequences
alone; each row keeps the positions of all its repeated ancestors, so children join to parents.

Defined results: a null record or an absent branch gives no rows below it; an empty array gives
none either; a null leaf stays null. A body that cannot be parsed gives one row of ``rejects`` and
nothing else. A file that is delivered several times counts once: the latest delivery wins, ties by
the larger ``delivery_id``. Fields that no table has are kept as JSON text in ``extra``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAF, OBJ, LIST, MAP = "leaf", "obj", "list", "map"

#: The fields of a file record, by our reading of the gold record type.
FILE_SPEC = (OBJ, {
    "id": (LEAF,), "sha256": (LEAF,), "status": (LEAF,), "note": (LEAF,), "extra": (LEAF,),
    "checked_by": (LIST, (LEAF,)),
    "statements": (LIST, (OBJ, {
        "type": (LEAF,), "page_mode": (LEAF,), "scale": (LEAF,), "currency": (LEAF,), "extra": (LEAF,),
        "pages": (LIST, (LEAF,)),
        "periods": (LIST, (OBJ, {k: (LEAF,) for k in ("key", "end_date", "kind", "months", "restated", "audited", "extra")})),
        "rows": (LIST, (OBJ, {
            "label": (LEAF,), "canonical_id": (LEAF,), "extra": (LEAF,),
            "unconfirmed": (LIST, (LEAF,)),
            "values": (MAP, (LEAF,)),
        })),
    })),
})

INPUT_FIELDS = ("input_id", "statement_id", "line_item_id", "canonical_id", "period_key", "reported", "raw_text", "unit_text", "scale", "currency")
INPUTS_SPEC = (OBJ, {"inputs": (MAP, (LIST, (OBJ, {k: (LEAF,) for k in INPUT_FIELDS})))})


class Leaf:
    """Where a leaf lies: its path, the definition level of each repeated ancestor's element, and its own."""

    def __init__(self, path: str, at: tuple[int, ...], full: int):
        self.path, self.at, self.full = path, at, full


def leaves(spec: tuple, path: str = "", level: int = 0, at: tuple[int, ...] = ()) -> list[Leaf]:
    """All leaf paths of a record type with their levels, in the order of the fields."""
    kind = spec[0]
    if kind == LEAF:
        return [Leaf(path, at, level + 1)]
    if kind == OBJ:
        return [x for name, child in spec[1].items() for x in leaves(child, f"{path}.{name}" if path else name, level + 1, at)]
    inner = level + 2
    if kind == MAP:
        return [Leaf(f"{path}.key", (*at, inner), inner + 1), *leaves(spec[1], f"{path}.value", inner, (*at, inner))]
    return leaves(spec[1], f"{path}.item", inner, (*at, inner))


def shred(record: Any, spec: tuple) -> dict[str, tuple[list[int], list[int], list]]:
    """The columns of one record: path -> (repetition levels, definition levels, values)."""
    out: dict[str, tuple[list[int], list[int], list]] = {x.path: ([], [], []) for x in leaves(spec)}
    below: dict[int, list[str]] = {}

    def absent(node: tuple, path: str, r: int, d: int) -> None:
        key = id(node)
        if key not in below:
            below[key] = [x.path for x in leaves(node, path)]
        for p in below[key]:
            column = out[p]
            column[0].append(r)
            column[1].append(d)
            column[2].append(None)

    def write(node: tuple, value: Any, path: str, r: int, d: int, depth: int) -> None:
        kind = node[0]
        if kind == LEAF:
            column = out[path]
            column[0].append(r)
            column[1].append(d if value is None else d + 1)
            column[2].append(value)
        elif kind == OBJ:
            if not isinstance(value, dict):
                absent(node, path, r, d)
                return
            for name, child in node[1].items():
                write(child, value.get(name), f"{path}.{name}" if path else name, r, d + 1, depth)
        elif value is None:
            absent(node, path, r, d)
        elif not value:
            absent(node, path, r, d + 1)
        elif kind == LIST:
            for k, item in enumerate(value):
                write(node[1], item, f"{path}.item", depth + 1 if k else r, d + 2, depth + 1)
        else:
            for k, (name, item) in enumerate(value):
                at = depth + 1 if k else r
                column = out[f"{path}.key"]
                column[0].append(at)
                column[1].append(d + 3)
                column[2].append(name)
                write(node[1], item, f"{path}.value", at, d + 2, depth + 1)

    write(spec, record, "", 0, 0, 0)
    return out


def assemble(levels: dict[str, tuple[list[int], list[int], list]], columns: list[Leaf]) -> Iterator[tuple[tuple[int, ...], list]]:
    """Rows of the table whose leaves are ``columns``: all lie under the same repeated ancestors.

    Yields the position of each repeated ancestor, outermost first, and the values. Only the level
    sequences decide where a row begins; entries that stop above the innermost ancestor are absent.
    """
    first = columns[0]
    depth = len(first.at)
    position = [-1] * depth
    values = [levels[c.path][2] for c in columns]
    for i, (r, d) in enumerate(zip(levels[first.path][0], levels[first.path][1], strict=True)):
        if depth:
            start = max(r, 1) - 1
            if r == 0:
                position = [0] * depth
            else:
                position[start] += 1
                position[start + 1 :] = [0] * (depth - start - 1)
            if d < first.at[-1]:
                continue
        yield tuple(position), [v[i] for v in values]


def _pairs(value: Any) -> list[tuple[str, Any]] | None:
    """A map in either notation of the producers: an object, or a list of {period, value}."""
    if isinstance(value, dict):
        return list(value.items())
    if isinstance(value, list):
        out = []
        for x in value:
            if isinstance(x, dict) and {"period", "value"} <= x.keys():
                out.append((x["period"], x["value"]))
            elif isinstance(x, dict):
                out.extend(x.items())
        return out
    return None


def _text(value: Any) -> str | None:
    """A leaf as text: strings as they are, everything else in JSON notation."""
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _many(value: Any) -> list | None:
    """A repeated field that a producer may write without its brackets."""
    return value if value is None or isinstance(value, list) else [value]


def _common(node: tuple, value: Any) -> Any:
    """Bring one producer's shape to the record type, without loss: unknown fields go to ``extra``."""
    kind = node[0]
    if value is None:
        return None
    if kind == LEAF:
        return _text(value)
    if kind == LIST:
        return [_common(node[1], x) for x in _many(value)]
    if kind == MAP:
        pairs = _pairs(value)
        return None if pairs is None else [(_text(k), _common(node[1], v)) for k, v in pairs]
    if not isinstance(value, dict):
        return {"extra": _text(value)} if "extra" in node[1] else None
    out = {k: _common(child, value.get(k)) for k, child in node[1].items() if k != "extra"}
    if "extra" in node[1]:
        known = node[2] if len(node) > 2 else node[1].keys()
        rest = {k: v for k, v in value.items() if k not in known}
        out["extra"] = json.dumps(rest, ensure_ascii=False, sort_keys=True) if rest else None
    return out


def parse_body(body: str | None) -> list[dict] | None:
    """The files of one delivery, or None for a body that is no whole JSON document."""
    try:
        value = json.loads(body) if body is not None else None
        for _ in range(3):  # some producers quote the document once more
            if isinstance(value, str):
                value = json.loads(value)
    except ValueError:
        return None
    if isinstance(value, dict) and isinstance(value.get("readings"), (list, dict)):
        value = value["readings"]
    files = [x for x in _many(value) or [] if isinstance(x, dict) and x.get("id") is not None]
    return files or None


_COLUMN = "STRUCT<reps: ARRAY<INT>, defs: ARRAY<INT>, vals: ARRAY<STRING>>"
_ARROW_COLUMN = pa.struct([("reps", pa.list_(pa.int32())), ("defs", pa.list_(pa.int32())), ("vals", pa.list_(pa.string()))])


def _packed(levels: dict) -> list[tuple[str, dict]]:
    return [(p, {"reps": r, "defs": d, "vals": v}) for p, (r, d, v) in levels.items()]


def _unpacked(levels: list[tuple[str, dict]]) -> dict:
    return {p: (c["reps"], c["defs"], c["vals"]) for p, c in levels}


def prune(spec: tuple, keep: tuple[str, ...], path: str = "") -> tuple | None:
    """The record type with only the leaves whose path is in ``keep`` or begins with one of it; levels do not change."""
    kind = spec[0]
    if kind == LEAF:
        return spec if any(path == k or path.startswith(f"{k}.") for k in keep) else None
    if kind == OBJ:
        kept = {n: c for n, child in spec[1].items() if (c := prune(child, keep, f"{path}.{n}" if path else n))}
        return (OBJ, kept, frozenset(spec[1])) if kept else None
    inner = prune(spec[1], keep, f"{path}.value" if kind == MAP else f"{path}.item")
    return (kind, inner) if inner else None


def shred_files(deliveries: DataFrame, keep: tuple[str, ...] | None = None) -> DataFrame:
    """(file_id, delivery_id, received_at, levels) for every file of every whole delivery, the latest of each file id.

    ``keep`` names the leaf paths that are wanted; others are never shredded. The bodies are parsed
    once. Which delivery is the latest is settled by a pre-aggregated maximum, so a file that is
    delivered a million times moves one shredded copy a task.
    """
    spec = prune(FILE_SPEC, keep) if keep else FILE_SPEC
    if spec is None:
        raise ValueError(f"no leaf below {keep}")

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, at, bodies = b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()
            out, row = [], []
            for i, body in enumerate(bodies):
                for k, f in enumerate(parse_body(body) or []):
                    out.append((_text(f["id"]), ids[i], k, _packed(shred(_common(spec, f), spec))))
                    row.append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), at.take(pa.array(row, pa.int64())), pa.array([x[2] for x in out], pa.int32()), pa.array([x[3] for x in out], pa.map_(pa.string(), _ARROW_COLUMN))],
                names=["file_id", "delivery_id", "received_at", "place", "levels"],
            )

    all_ = deliveries.select("delivery_id", "received_at", "body").mapInArrow(columns, f"file_id STRING, delivery_id BIGINT, received_at TIMESTAMP, place INT, levels MAP<STRING, {_COLUMN}>")
    order = F.struct("received_at", "delivery_id", "place")
    return all_.groupBy("file_id").agg(F.max(F.struct("received_at", "delivery_id")).alias("at"), F.max_by("levels", order).alias("levels")).select("file_id", "at.delivery_id", "at.received_at", "levels")


def rejects(deliveries: DataFrame) -> DataFrame:
    """(delivery_id, received_at, n_chars) of the deliveries that hold no whole file."""

    @F.pandas_udf("boolean")
    def broken(bodies):  # noqa: ANN001, ANN202
        return bodies.map(lambda b: parse_body(b) is None)

    return deliveries.where(broken("body")).select("delivery_id", "received_at", F.length("body").cast("bigint").alias("n_chars"))


def _positions(names: tuple[str, ...]) -> str:
    return "".join(f", {n} BIGINT" for n in names)


def rebuild(shredded: DataFrame, key: str, prefix: str, fields: dict[str, str], places: tuple[str, ...], spec: tuple = FILE_SPEC) -> DataFrame:
    """The flat table of the repeated ancestor at ``prefix``.

    ``fields`` maps a column name to a leaf name below the prefix, ``places`` names the position of
    each repeated ancestor. Only the named columns of the levels are passed on; nothing is shuffled.
    """
    by_path = {x.path: x for x in leaves(spec)}
    wanted = [by_path[f"{prefix}.{leaf}".strip(".")] for leaf in fields.values()]
    names = list(fields)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys: list = []
            at: list[list[int]] = [[] for _ in places]
            cols: list[list] = [[] for _ in names]
            for owner, levels in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for position, values in assemble(_unpacked(levels), wanted):
                    keys.append(owner)
                    for column, x in zip(at, position, strict=True):
                        column.append(x)
                    for column, x in zip(cols, values, strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array(x, pa.int64()) for x in at), *(pa.array(x, pa.string()) for x in cols)], names=["owner", *places, *names])

    paths = F.array(*[F.lit(x.path) for x in wanted])
    slim = shredded.select(F.col(key).alias("owner"), F.map_filter("levels", lambda k, _: F.array_contains(paths, k)).alias("levels"))
    schema = "owner STRING" + _positions(places) + "".join(f", `{n}` STRING" for n in names)
    return slim.mapInArrow(rows, schema).withColumnRenamed("owner", key)


def files(shredded: DataFrame) -> DataFrame:
    """One row per file: id, sha256 as delivered, status, note, extra."""
    return rebuild(shredded, "file_id", "", {"sha256": "sha256", "status": "status", "note": "note", "extra": "extra"}, ())


def statements(shredded: DataFrame) -> DataFrame:
    """One row per statement of a file, with its position."""
    out = rebuild(shredded, "file_id", "statements.item", {"type": "type", "page_mode": "page_mode", "scale": "scale", "currency": "currency", "extra": "extra"}, ("statement_pos",))
    return out.withColumn("scale", F.expr("try_cast(scale AS BIGINT)"))


def periods(shredded: DataFrame) -> DataFrame:
    """One row per period of a statement, with ``extra`` last."""
    names = ("key", "end_date", "kind", "months", "restated", "audited", "extra")
    out = rebuild(shredded, "file_id", "statements.item.periods.item", {("period_key" if n == "key" else n): n for n in names}, ("statement_pos", "period_pos"))
    return out.withColumns({"end_date": F.expr("try_cast(end_date AS DATE)"), "months": F.expr("try_cast(months AS INT)"), "restated": F.expr("try_cast(restated AS BOOLEAN)"), "audited": F.expr("try_cast(audited AS BOOLEAN)")})


def rows(shredded: DataFrame) -> DataFrame:
    """One row per line of a statement: label and canonical id as typed."""
    return rebuild(shredded, "file_id", "statements.item.rows.item", {"label": "label", "canonical_id": "canonical_id", "extra": "extra"}, ("statement_pos", "row_pos"))


def values(shredded: DataFrame) -> DataFrame:
    """One row per printed value of a line, null values included."""
    return rebuild(shredded, "file_id", "statements.item.rows.item.values", {"period_key": "key", "value": "value"}, ("statement_pos", "row_pos", "value_pos"))


def unconfirmed(shredded: DataFrame) -> DataFrame:
    """One row per period key that a line lists as unconfirmed."""
    return rebuild(shredded, "file_id", "statements.item.rows.item.unconfirmed.item", {"period_key": ""}, ("statement_pos", "row_pos", "unconfirmed_pos"))


def pages(shredded: DataFrame) -> DataFrame:
    """One row per page of a statement."""
    return rebuild(shredded, "file_id", "statements.item.pages.item", {"page": ""}, ("statement_pos", "page_pos")).withColumn("page", F.expr("try_cast(page AS INT)"))


def checked_by(shredded: DataFrame) -> DataFrame:
    """One row per reader who checked a file."""
    return rebuild(shredded, "file_id", "checked_by.item", {"checked_by": ""}, ("checked_by_pos",))


def shred_inputs(metric_values: DataFrame, fields: tuple[str, ...] = INPUT_FIELDS) -> DataFrame:
    """(metric_value_id, levels) of MetricValue.inputs, one row per distinct value; unnamed fields are not read on.

    A repeated delivery of a value has the same content, so any one of them is kept. The levels are
    made before the shuffle, which then moves the named leaves only.
    """
    spec = (OBJ, {"inputs": (MAP, (LIST, (OBJ, {k: (LEAF,) for k in fields})))})

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [_packed(shred({"inputs": x}, spec)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.map_(pa.string(), _ARROW_COLUMN))], names=["metric_value_id", "levels"])

    def leaf(x: Column) -> Column:
        return F.struct(*[x[k].cast("string").alias(k) for k in fields])

    slim = metric_values.select("metric_value_id", F.transform_values("inputs", lambda _, v: F.transform(v, leaf)).alias("inputs"))
    one = slim.dropDuplicates(["metric_value_id"])  # pre-aggregates, so a value repeated often is no hot group
    return one.mapInArrow(columns, f"metric_value_id STRING, levels MAP<STRING, {_COLUMN}>")


def inputs(shredded: DataFrame, fields: tuple[str, ...] = INPUT_FIELDS) -> DataFrame:
    """One row per MetricInput: metric_value_id, role, its position in the role's array, and its fields."""
    spec = (OBJ, {"inputs": (MAP, (LIST, (OBJ, {k: (LEAF,) for k in fields})))})
    roles = rebuild_roles(shredded, fields, spec)
    casts = {"input_id": "BIGINT", "reported": "DECIMAL(38,6)", "scale": "BIGINT"}
    return roles.withColumns({k: F.expr(f"try_cast(`{k}` AS {v})") for k, v in casts.items() if k in fields})


def rebuild_roles(shredded: DataFrame, fields: tuple[str, ...], spec: tuple) -> DataFrame:
    """Inputs with the role of their map entry: the key column ends one repeated level above its items."""
    by_path = {x.path: x for x in leaves(spec)}
    keys = [by_path["inputs.key"]]
    items = [by_path[f"inputs.value.item.{k}"] for k in fields]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owners, role, place = [], [], []
            cols: list[list] = [[] for _ in fields]
            for owner, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                levels = _unpacked(packed)
                names = {at[0]: v[0] for at, v in assemble(levels, keys)}
                for at, found in assemble(levels, items):
                    owners.append(owner)
                    role.append(names[at[0]])
                    place.append(at[1])
                    for column, x in zip(cols, found, strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.string()), pa.array(role, pa.string()), pa.array(place, pa.int64()), *(pa.array(x, pa.string()) for x in cols)], names=["metric_value_id", "role", "position", *fields])

    return shredded.mapInArrow(rows, "metric_value_id STRING, role STRING, position BIGINT" + "".join(f", `{k}` STRING" for k in fields))


def found_leaves(deliveries: DataFrame, metric_values: DataFrame) -> DataFrame:
    """(record_id, branch, position, leaf): every printed row value and every MetricInput, each once."""
    printed = values(shred_files(deliveries, ("statements.item.rows.item.values",))).where("value IS NOT NULL AND value <> ''")
    printed = printed.select(F.col("file_id").alias("record_id"), F.col("statement_pos").cast("string").alias("branch"), F.col("row_pos").alias("position"), F.col("period_key").alias("leaf")).distinct()
    used = inputs(shred_inputs(metric_values, ("input_id",)), ("input_id",))
    used = used.select(F.col("metric_value_id").alias("record_id"), F.col("role").alias("branch"), "position", F.col("input_id").cast("string").alias("leaf"))
    return printed.unionByName(used)
