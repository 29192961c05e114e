"""Adjacency-table shredding of nested JSON into related flat tables.

Every payload becomes rows (key, node, parent, label, ordinal, kind, scalar): an object, an array within an array or a scalar is a
node, ``parent`` is the node that owns it, ``label`` the property it hangs under and ``ordinal`` its place in that property's
array (-1 where there is none). Arrays are shredded under any label. Entity tables come from joining object nodes with their scalar
children, pivoted to columns: one grouped pivot for all labels at once.

Defined results for odd input:
* null payloads have no nodes; unreadable (cut off) or non-object ones have one node of kind ``unreadable`` that says why;
* nesting of any depth is read; NaN and infinities, which some encoders write, are scalars of that name;
* under a label named in ``arrays`` an object counts as the only element of an array, under any label in ``arrays`` or
  ``maps`` a string that holds JSON counts as what it holds (also when it is encoded twice);
* null entries take a place in their array but give no node;
* under a label named in ``maps`` an object is a map: its values are nodes labelled with the map's name, and the map key
  is kept as the scalar child ``key_label``; an array there is treated as an array of objects;
* duplicate keys of one object: the last one counts; empty arrays and objects give no children;
* repeated rows of the input give repeated nodes; the caller's key must be unique for joins to be meaningful.
"""

from __future__ import annotations

import json
import re
from collections.abc import Collection, Iterable, Iterator, Mapping
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parapheur.session import written

NODE_COLUMNS = "node INT, parent INT, label STRING, ordinal INT, kind STRING, scalar STRING"
_BLANK = re.compile(r"[ \t\n\r]*")
_PLAIN = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null|NaN|-?Infinity")


def _deep(text: str):
    """What ``json.loads`` gives, for nesting that exhausts the interpreter's stack."""
    top: list = []
    open_: list = [top]
    key, i, want = None, _BLANK.match(text).end(), "value"

    def put(value) -> None:
        if isinstance(open_[-1], dict):
            open_[-1][key] = value
        else:
            open_[-1].append(value)

    keys: list = []
    while i < len(text):
        c, end = text[i], i + 1
        if want in ("value", "element") and c in "{[":
            new: dict | list = {} if c == "{" else []
            put(new)
            open_.append(new)
            keys.append(key)
            want = "member" if c == "{" else "element"
        elif want in ("element", "next") and c == "]" and isinstance(open_[-1], list) and len(open_) > 1 or want in ("member", "next") and c == "}" and isinstance(open_[-1], dict):
            open_.pop()
            key = keys.pop()
            want = "next"
        elif want in ("member", "key") and c == '"':
            key, end = scanstring(text, i + 1, True)
            end = _BLANK.match(text, end).end()
            if text[end : end + 1] != ":":
                raise ValueError("no colon")
            end, want = end + 1, "value"
        elif want == "next" and c == "," and len(open_) > 1:
            want = "key" if isinstance(open_[-1], dict) else "value"
        elif want in ("value", "element"):
            if c == '"':
                value, end = scanstring(text, i + 1, True)
            else:
                m = _PLAIN.match(text, i)
                if not m:
                    raise ValueError("no value")
                value, end = json.loads(m[0], parse_constant=str), m.end()
            put(value)
            want = "next"
        else:
            raise ValueError("not JSON")
        i = _BLANK.match(text, end).end()
    if len(open_) > 1 or want != "next":
        raise ValueError("cut off")
    return top[0]


def _load(text: str):
    try:
        return json.loads(text, parse_constant=str)
    except RecursionError:
        return _deep(text)


def _opened(value):
    """What a string that holds a JSON object or array holds; other values as they are."""
    while isinstance(value, str):
        head = value.lstrip()[:1]
        if head not in ("{", "[", '"'):
            break
        try:
            inner = _load(value)
        except ValueError:
            break
        if not isinstance(inner, (dict, list, str)) or inner == value:
            break
        value = inner
    return value


def _text(value) -> str:
    if isinstance(value, str):
        return value
    return "true" if value is True else "false" if value is False else repr(value)


def shred_payload(payload: str | None, arrays: frozenset[str], maps: Mapping[str, str], labels: Collection[str] | None = None) -> list[tuple]:
    """Nodes of one payload in document order; an explicit stack keeps deep nesting from exhausting the interpreter's.

    ``labels``: only nodes under these properties are wanted, so nothing else is visited.
    """
    if payload is None:
        return []
    try:
        root = _opened(_load(payload))
    except ValueError as error:
        return [(0, -1, None, -1, "unreadable", str(error)[:200])]
    if not isinstance(root, dict):
        return [(0, -1, None, -1, "unreadable", "not an object")]
    nodes: list[tuple] = [(0, -1, None, -1, "object", None)]
    todo: list[tuple[int, str | None, dict | list]] = [(0, None, root)]

    def add(parent: int, label: str | None, ordinal: int, value, name: str | None = None) -> None:
        if value is None:
            return
        me = len(nodes)
        if isinstance(value, dict):
            nodes.append((me, parent, label, ordinal, "object", None))
            if name is not None and (labels is None or maps[label] in labels):
                nodes.append((me + 1, me, maps[label], -1, "scalar", name))
            todo.append((me, label, value))
        elif isinstance(value, list):
            nodes.append((me, parent, label, ordinal, "array", None))
            todo.append((me, label, value))
        else:
            nodes.append((me, parent, label, ordinal, "scalar", _text(value)))

    while todo:
        me, under, owner = todo.pop()
        if isinstance(owner, list):
            for place, entry in enumerate(owner):
                add(me, under, place, _opened(entry) if under in arrays else entry)
            continue
        for label, value in owner.items():
            if labels is not None and label not in labels:
                continue
            named = label in arrays or label in maps
            if named:
                value = _opened(value)
            if isinstance(value, list):
                for place, entry in enumerate(value):
                    add(me, label, place, _opened(entry) if named else entry)
            elif label in maps and isinstance(value, dict):
                for name, entry in value.items():
                    add(me, label, -1, _opened(entry), name)
            else:
                add(me, label, 0 if label in arrays and isinstance(value, dict) else -1, value)
    return nodes


def shred(df: DataFrame, key: str, payload: str, arrays: Iterable[str], maps: Mapping[str, str] | None = None, labels: Iterable[str] | None = None) -> DataFrame:
    """Adjacency table of ``payload``; columns: key, node, parent, label, ordinal, kind, scalar. No shuffle.

    ``maps`` names the labels whose objects are maps, with the label under which the map key is stored. ``labels`` prunes the
    table to the nodes under these properties, as selecting columns prunes a scan.
    """
    arrays, maps, wanted = frozenset(arrays), dict(maps or {}), None if labels is None else frozenset(labels)
    key_type = df.schema[key].dataType.simpleString()
    names = ["node", "parent", "label", "ordinal", "kind", "scalar"]
    types = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                index: list[int] = []
                rows: list[tuple] = []
                for i, text in enumerate(part.column(1).to_pylist()):
                    found = shred_payload(text, arrays, maps, wanted)
                    rows.extend(found)
                    index.extend([i] * len(found))
                columns = zip(*rows) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(index, pa.int64())), *(pa.array(list(c), t) for c, t in zip(columns, types))],
                    names=[key, *names],
                )

    return df.select(key, payload).mapInArrow(run, f"`{key}` {key_type}, {NODE_COLUMNS}")


def objects(nodes: DataFrame, key: str, labels: Collection[str], scalars: Mapping[str, Column]) -> DataFrame:
    """Every object node under one of ``labels`` with its scalar children: key, node, parent, label, ordinal and the named scalars.

    ``scalars`` gives for each column the condition of its child. The join of objects with their children is a grouped pivot on
    (key, owner): an object contributes a row under its own node number, a child one under its parent's, so one shuffle does all
    entities. An object without such a child has null.
    """
    is_object = F.col("label").isin(list(labels)) & (F.col("kind") == "object")
    is_child = F.lit(False)
    for condition in scalars.values():
        is_child = is_child | condition
    child = (F.col("kind") == "scalar") & is_child
    own = nodes.where(is_object | child)
    owner = F.when(is_object, F.col("node")).otherwise(F.col("parent"))
    of = lambda name: F.max(F.when(is_object, F.col(name))).alias(name)
    pivot = [F.max(F.when(child & condition, F.col("scalar"))).alias(name) for name, condition in scalars.items()]
    return own.groupBy(F.col(key), owner.alias("_owner")).agg(of("parent"), of("label"), of("ordinal"), *pivot).where("label IS NOT NULL").withColumnRenamed("_owner", "node")


KIE_ARRAYS = ("pages", "tables", "candidates", "data", "bbox")
KIE_MAPS = {"field_details": "field"}
_ENTITIES = ("pages", "tables", "field_details", "candidates")


def kie_nodes(documents: DataFrame, labels: Iterable[str] | None = None) -> DataFrame:
    """Adjacency table of the exported result documents."""
    return shred(documents, "record_id", "payload", KIE_ARRAYS, KIE_MAPS, labels)


def _named(*names: str) -> dict[str, Column]:
    return {n: (F.col("label") == n) & (F.col("ordinal") == -1) for n in names}


def kie_entities(nodes: DataFrame, scalars: Collection[str] | None = None) -> dict[str, DataFrame]:
    """The related flat tables of the result documents: documents, pages, tables, cells, details and candidates.

    Each child row has ``record_id`` and the parent's node number (``page_node``, ``table_node``, ``detail_node``); only the pages of
    the document's own ``pages`` count, so entries below unknown extra keys lead nowhere and are left out. ``scalars``: the
    properties that are wanted, all by default.
    """
    key = "record_id"
    columns = _named("page_number", "ocr_confidence", "table_index", "method", "confidence", "field", "selected", "strategy", "value", "strategy_score", "page_confidence", "score", "reason")
    columns |= {name: (F.col("label") == "bbox") & (F.col("ordinal") == i) for i, name in enumerate(("x1", "y1", "x2", "y2"))}
    if scalars is not None:
        columns = {n: c for n, c in columns.items() if n in scalars}
    every = written(objects(nodes, key, _ENTITIES, columns), "objects")

    def entity(label: str, node: str, parent: str, place: str, names: Mapping[str, str]) -> DataFrame:
        own = every.where(F.col("label") == label)
        return own.select(key, F.col("node").alias(node), F.col("parent").alias(parent), F.col("ordinal").alias(place), *[F.col(n).alias(a) for n, a in names.items() if n in columns])

    same = lambda *names: {n: n for n in names}
    pages = entity("pages", "page_node", "_root", "page_pos", same("page_number", "ocr_confidence")).where("_root = 0").drop("_root")
    place = pages.select(key, "page_node", "page_pos")
    tables = entity("tables", "table_node", "page_node", "item_pos", same("table_index", "method", "confidence", "x1", "y1", "x2", "y2")).join(place, [key, "page_node"])
    details = entity("field_details", "detail_node", "page_node", "detail_pos", {"field": "field_name", "selected": "selected"}).join(place, [key, "page_node"])
    names = same("strategy", "strategy_score", "page_confidence", "score", "reason") | {"value": "cand_value"}
    candidates = entity("candidates", "candidate_node", "detail_node", "item_pos", names).join(details.select(key, "detail_node", "page_node", "page_pos", "field_name"), [key, "detail_node"])
    row = nodes.where("label = 'data' AND kind = 'array'").select(key, F.col("node").alias("row_node"), F.col("parent").alias("table_node"), F.col("ordinal").alias("row_pos"))
    cell = nodes.where("label = 'data' AND kind = 'scalar'").select(key, F.col("parent").alias("row_node"), F.col("ordinal").alias("col_pos"), F.col("scalar").alias("cell"))
    cells = cell.join(row, [key, "row_node"]).join(tables.select(key, "table_node", "page_node", "page_pos", "item_pos"), [key, "table_node"]).drop("row_node")
    return {"documents": nodes.where("parent = -1 AND kind = 'object'").select(key), "pages": pages, "tables": tables, "cells": cells, "details": details, "candidates": candidates}


def kie_found(documents: DataFrame) -> DataFrame:
    """One row an object of the exported documents: (record_id, kind, page_pos, field_name, item_pos)."""
    e = kie_entities(kie_nodes(documents, [*_ENTITIES, "field"]), ["field"])

    def rows(df: DataFrame, kind: str, field: Column, item: Column) -> DataFrame:
        return df.select("record_id", F.lit(kind).alias("kind"), "page_pos", F.coalesce(field, F.lit("")).alias("field_name"), item.alias("item_pos"))

    none, no_item = F.lit(""), F.lit(-1)
    return (
        rows(e["pages"], "page", none, no_item)
        .unionByName(rows(e["tables"], "tbl", none, F.col("item_pos")))
        .unionByName(rows(e["details"], "detail", F.col("field_name"), no_item))
        .unionByName(rows(e["candidates"], "candidate", F.col("field_name"), F.col("item_pos")))
    )


def selected_origins(entities: dict[str, DataFrame]) -> DataFrame:
    """The strategy of the first candidate whose value is the selected one, for every detail with a selected value.

    ``origin`` is null where no candidate has that value; the minimum over places is combined on the map side.
    """
    details = entities["details"].select("record_id", "detail_node", "page_pos", "field_name", "selected").where("selected IS NOT NULL")
    candidates = entities["candidates"].select("record_id", "detail_node", F.col("cand_value").alias("selected"), "item_pos", "strategy")
    first = candidates.groupBy("record_id", "detail_node", "selected").agg(F.min(F.struct("item_pos", "strategy")).alias("_f"))
    found = details.join(first, ["record_id", "detail_node", "selected"], "left")
    return found.select("record_id", "page_pos", "field_name", "selected", F.col("_f.strategy").alias("origin"), F.col("_f.item_pos").alias("item_pos"))
