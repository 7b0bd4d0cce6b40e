"""Deeply nested JSON records to flat tables with parent links, by shared inlining.

The schema is a graph of element types. A type becomes a table if it repeats below its parent (array, or object used
as a map), if several parents share it, or if it is recursive; every other descendant occurs at most once under its
parent and is inlined there as a column. Records at different places are one type if they have much the same members. An
object with more than MANY different members over all records is used as a map: its keys are data, not schema. Each row holds its own key, the key of its parent row, the record's id and
its place, so every child leads back to its record.

`infer_graph` finds the graph over all records, in one distributed pass whose result is as large as the schema.
`inline` chooses tables. `shred` makes the rows; `tables` gives one DataFrame per table.

Defined cases: null, blank and invalid JSON, and records that fail the filter, give no row. Null, missing and empty
("" , [] or {}) fields give no row. Null entries of an array keep their place and give no row. A single value where an
array is usual is one entry at 0. A repeated key counts once, with its last value. Records nested too deeply to parse
count as invalid. Equal rows are each shredded: their ids tell them apart. A null id is kept as null. Other columns of
the input are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FENCED = re.compile(r"\A\s*```[^\n`{\[]*\s*(.*?)\s*(?:```)?\s*\Z", re.DOTALL)
OWN = "*"  # stands in a path for the entries of a repeated node
WILD = "\0"  # stands in a path for any key of an object with many
MANY = 64
REPEATED, RECORD, SCALAR, FREE = 1, 2, 4, 8  # how a path occurs


@dataclass(frozen=True)
class Shapes:
    """What the data alone cannot tell: the roots, which objects are maps, which strings hold JSON text."""

    roots: tuple[str, ...] = ()
    wrappers: tuple[str, ...] = ()
    where: tuple[tuple[str, str], ...] = ()
    maps: tuple[str, ...] = ()
    repeated: tuple[str, ...] = ()
    texts: tuple[str, ...] = ()
    records: tuple[str, ...] = ()
    named: tuple[tuple[str, str], ...] = ()  # (path, name): what to call the table of a shared type


@dataclass
class Node:
    """One path of the schema graph: how it occurs, and the paths below it."""

    path: str
    repeated: bool = False
    record: bool = False
    scalar: bool = False
    free: bool = False  # its members are entries, keyed by data
    children: dict[str, Node] = field(default_factory=dict)


def parse(text: str | None) -> object:
    """The JSON value of a text, or None."""
    if text is None or not text.strip():
        return None
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def embedded(value: object) -> object:
    """An object, or one written as JSON text in a string with or without a code fence; all else gives None."""
    if not isinstance(value, str):
        return value if isinstance(value, dict) else None
    found = parse(value)
    if found is None and (m := FENCED.match(value)):
        found = parse(m[1])
    return found if isinstance(found, dict) else None


def body(record: object, shapes: Shapes) -> dict | None:
    """The record's fields with those of its wrappers laid over them, or None if it is not asked for."""
    if not isinstance(record, dict):
        return None
    for w in shapes.wrappers:
        if isinstance(record.get(w), dict):
            record = {k: v for k, v in record.items() if k != w} | record[w] | {k: record[k] for k, _ in shapes.where if k in record}
    return record if all(record.get(k) == v for k, v in shapes.where) else None


def empty(value: object) -> bool:
    return value is None or (isinstance(value, (str, list, dict)) and not value)


def entries(value: object, as_map: bool) -> list[tuple[int, str | None, object]]:
    """(pos, key, entry) of a repeated field; null entries keep their place and are left out."""
    if empty(value):
        return []
    if isinstance(value, list):
        return [(i, None, x) for i, x in enumerate(value) if x is not None]
    if as_map and isinstance(value, dict):
        return [(i, k, x) for i, (k, x) in enumerate(value.items()) if x is not None]
    return [(0, None, value)]


@dataclass
class Seen:
    """How each path occurs in the records of a task."""

    shapes: Shapes
    kinds: dict[str, int] = field(default_factory=dict)
    members: dict[str, set[str]] = field(default_factory=dict)
    free: set[str] = field(default_factory=set)

    def note(self, path: str, kind: int) -> None:
        self.kinds[path] = self.kinds.get(path, 0) | kind

    def walk(self, value: object, path: str) -> None:
        if path in self.shapes.texts:
            value = embedded(value)
        if empty(value):
            return
        if isinstance(value, list) or (path in self.shapes.maps and isinstance(value, dict)):
            self.note(path, REPEATED)
            for _, _, x in entries(value, True):
                if isinstance(x, (dict, list)):
                    self.walk(x, path + OWN if isinstance(x, list) else path + "#")
                else:
                    self.note(path, SCALAR)
            return
        path = path.removesuffix("#")
        if isinstance(value, dict):
            self.note(path, RECORD)
            known = self.members.setdefault(path, set())
            if path not in self.free:
                known.update(value)
                if path and len(known) > MANY:  # from now on its keys are all one
                    self.free.add(path)
                    known.clear()
                    self.kinds = wild(self.kinds, path)
            for k, v in value.items():
                self.walk(v, f"{path}.{WILD if path in self.free else k}" if path else k)
        else:
            self.note(path, SCALAR)


def wild(kinds: dict[str, int], top: str) -> dict[str, int]:
    """The paths with all members of one object taken as one."""
    out: dict[str, int] = {}
    for path, kind in kinds.items():
        if path.startswith(f"{top}."):
            _, dot, rest = path[len(top) + 1 :].partition(".")
            path = f"{top}.{WILD}{dot}{rest}"
        out[path] = out.get(path, 0) | kind
    return out


def without_free_keys(kinds: dict[str, int]) -> dict[str, int]:
    """The union over tasks: an object that one of them took for a map, or that has many members in all, is a map."""
    while True:
        members: dict[str, set[str]] = {}
        for path in kinds:
            above, _, name = path.rpartition(".")
            members.setdefault(above, set()).add(name)
        free = [p for p, names in members.items() if p and len(names) > 1 and (len(names) > MANY or WILD in names)]
        if not free:
            break
        kinds = wild(kinds, min(free, key=lambda p: (p.count("."), p)))
    maps = {p.rpartition(".")[0] for p in kinds if p.endswith(WILD)}
    out: dict[str, int] = {}
    for path, kind in kinds.items():
        if path in maps:
            kind = kind & ~RECORD | REPEATED | FREE
        elif path.endswith(WILD):
            kind &= RECORD | SCALAR
        path = path.replace(f".{WILD}", "")
        out[path] = out.get(path, 0) | kind
    return out


def infer_graph(df: DataFrame, payload: str, shapes: Shapes) -> Node:
    """The schema graph of all records; only distinct paths leave a task, and shapes' hints are added to what is found."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen(shapes)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if (record := body(parse(text), shapes)) is not None:
                    for root in shapes.roots or record:
                        seen.walk(record.get(root), root)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen.kinds), pa.string()), pa.array(list(seen.kinds.values()), pa.int32())], ["path", "kinds"])

    found = df.select(payload).mapInArrow(scan, "path string, kinds int").groupBy("path").agg(F.bit_or("kinds").alias("kinds"))
    return graph_of(without_free_keys({r.path: r.kinds for r in found.collect()}), shapes)  # no object has more than MANY members from a task


def graph_of(kinds: dict[str, int], shapes: Shapes) -> Node:
    """The graph as nodes, hints included."""
    for more, bit in ((shapes.repeated, REPEATED), (shapes.maps, REPEATED), (shapes.records, RECORD), (shapes.texts, RECORD)):
        for p in more:
            kinds[p] = kinds.get(p, 0) | bit
    root = Node("", record=True)
    for path in sorted(kinds):
        node = root
        for part in path.split("."):
            node = node.children.setdefault(part, Node(f"{node.path}.{part}" if node.path else part))
        node.repeated, node.record, node.scalar, node.free = (bool(kinds[path] & k) for k in (REPEATED, RECORD, SCALAR, FREE))
    return root


def shared_types(graph: Node, shapes: Shapes, least: int = 2, alike: float = 0.5) -> dict[str, str]:
    """Path -> name of its type, for records at several places with much the same members: at least `alike` of the members of
    both, and four fifths of those of the smaller one. Records inside each other are no such pair, nor are their parts."""
    groups: list[list[Node]] = []

    def fits(a: Node, b: Node) -> bool:
        if f"{a.path}.".startswith(f"{b.path}.") or f"{b.path}.".startswith(f"{a.path}."):
            return False
        x, y = set(a.children), set(b.children)
        both = len(x & y)
        return both >= least and both >= alike * len(x | y) and both >= 0.8 * min(len(x), len(y))

    def visit(node: Node) -> None:
        for child in node.children.values():
            held = None
            if child.record and len(child.children) >= least:
                held = next((g for g in groups if any(fits(child, n) for n in g)), None)
                if held is None:
                    groups.append([child])
                else:
                    held.append(child)
            if held is None:  # the parts of a known type are shared with it
                visit(child)

    visit(graph)
    names = dict(shapes.named)
    out: dict[str, str] = {}
    for g in groups:
        if len(g) > 1:
            own = next((names[n.path] for n in g if n.path in names), "_or_".join(dict.fromkeys(n.path.replace(".", "_") for n in g)))
            out |= {n.path: own for n in g}
    return out


def inline(graph: Node, shapes: Shapes) -> dict[str, str]:
    """Path -> table for the paths that get one: repeated, shared by several parents, or recursive. The rest is inlined."""
    shared = shared_types(graph, shapes)
    out: dict[str, str] = {}

    def visit(node: Node, above: str, types: tuple[str, ...]) -> None:
        for name, child in node.children.items():
            # a member named as one of its ancestors that holds the same members is that type again
            recursive = name in types and child.record
            table = above
            if child.repeated or child.path in shared or recursive:
                table = shared.get(child.path, f"{above}_{name}" if above else name)
                out[child.path] = table
            visit(child, table, (*types, name))

    visit(graph, "", ())
    return out


def leaves(node: Node, value: dict, own: dict[str, str], prefix: str, out: dict[str, str]) -> None:
    """The inlined descendants of a row as name -> text."""
    for k, v in value.items():
        child = node.children.get(k)
        if child is not None and child.path in own:
            continue
        name = f"{prefix}{k}"
        if isinstance(v, dict) and child is not None:
            leaves(child, v, own, f"{name}_", out)
        elif v is not None:
            out[name] = v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def rows_of(record_id: object, record: dict, graph: Node, own: dict[str, str], shapes: Shapes, with_fields: bool, only: str | None = None) -> Iterator[tuple]:
    """(record id, child, table, key, parent key, parent_pos, pos, member, fields) of each child row of a record, or of those of
    one table."""
    todo: list[tuple[Node, dict, str, int]] = [(graph, record, f"{record_id}", -1)]
    while todo:
        node, value, key, above = todo.pop()
        for name, child in node.children.items():
            got = value.get(name)
            if child.path in shapes.texts:
                got = embedded(got)
            if empty(got):
                continue
            if child.path not in own:
                if isinstance(got, dict):  # inlined: its children belong to this row
                    todo.append((child, got, key, above))
                continue
            if not child.repeated and not isinstance(got, dict):
                continue
            for pos, member, entry in entries(got, child.free or child.path in shapes.maps) if child.repeated else [(0, None, got)]:
                mine = f"{key}/{name}:{pos}"
                if isinstance(entry, dict):
                    todo.append((child, entry, mine, pos if child.repeated else -1))
                if only is not None and own[child.path] != only:
                    continue
                fields: dict[str, str] = {}
                if with_fields:
                    if isinstance(entry, dict):
                        leaves(child, entry, own, "", fields)
                    else:
                        fields["value"] = entry if isinstance(entry, str) else json.dumps(entry, ensure_ascii=False)
                yield record_id, child.path, own[child.path], mine, key, above, pos, member, fields


def shred(df: DataFrame, id_col: str, payload: str, graph: Node, own: dict[str, str], shapes: Shapes, with_fields: bool = True, only: str | None = None) -> DataFrame:
    """One row per child record: id, child (its path), table, key, parent_key, parent_pos, pos, member (key in a map) and,
    if asked for, fields: the inlined columns. `only` names the one table to make. parent_pos is the parent row's pos if the parent repeats, else -1."""
    kind = dict(df.dtypes)[id_col]
    shape = f"id {kind}, child string, `table` string, key string, parent_key string, parent_pos int, pos int, member string"
    shape += ", fields map<string,string>" if with_fields else ""
    width = 9 if with_fields else 8
    types = [None, pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string())]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(width)]
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (record := body(parse(text), shapes)) is not None:
                    for row in rows_of(rid, record, graph, own, shapes, with_fields, only):
                        for column, x in zip(out, row):
                            column.append(x)
            if with_fields:
                out[8] = [list(x.items()) for x in out[8]]
            kinds = [batch.schema.field(0).type, *types[1:width]]
            names = ["id", "child", "table", "key", "parent_key", "parent_pos", "pos", "member", "fields"][:width]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names)

    return df.select(id_col, payload).mapInArrow(split, shape)


def columns(graph: Node, own: dict[str, str], table: str) -> list[str]:
    """The inlined columns of a table, over all paths that share it."""
    out: dict[str, None] = {}

    def gather(node: Node, prefix: str) -> None:
        for name, child in node.children.items():
            if child.path in own:
                continue
            if child.children:
                gather(child, f"{prefix}{name}_")
            if child.scalar or not child.children:
                out[f"{prefix}{name}"] = None

    def visit(node: Node) -> None:
        for child in node.children.values():
            if own.get(child.path) == table:
                if child.scalar:
                    out["value"] = None
                gather(child, "")
            visit(child)

    visit(graph)
    return list(out)


def distinct_names(members: list[str]) -> dict[str, str]:
    """Member path -> column name; Spark holds names that differ only in case for one, so those get a number."""
    out: dict[str, str] = {}
    used: set[str] = set()
    for m in members:
        name, k = f"c_{m}", 1
        while name.lower() in used:
            k += 1
            name = f"c_{m}_{k}"
        used.add(name.lower())
        out[m] = name
    return out


def tables(shredded: DataFrame, graph: Node, own: dict[str, str]) -> dict[str, DataFrame]:
    """A DataFrame per table. Inlined columns are named c_<member path>, so that they clash with none of the keys."""
    keys: list[str | Column] = ["id", "child", "key", "parent_key", "parent_pos", "pos", "member"]
    return {t: shredded.filter(F.col("table") == t).select(*keys, *(F.col("fields")[c].alias(name) for c, name in distinct_names(columns(graph, own, t)).items())) for t in dict.fromkeys(own.values())}


def flatten(df: DataFrame, id_col: str, payload: str, shapes: Shapes, with_fields: bool = True, only: str | None = None) -> tuple[DataFrame, Node, dict[str, str]]:
    """Infer, inline and shred in one call."""
    graph = infer_graph(df, payload, shapes)
    own = inline(graph, shapes)
    return shred(df, id_col, payload, graph, own, shapes, with_fields, only), graph, own


def verdict_paths(names: Iterable[str]) -> tuple[str, ...]:
    return tuple(f"{k}.{x}" for k in names for x in ("reasons", "attempts", "attempts.issues"))


VERDICTS = ("raw_ab", "raw_ba")

#: Shapes of exported result lines.
RESULT_LINES = Shapes(
    roots=("responses", "judge_reasons", *VERDICTS),
    wrappers=("data",),
    where=(("type", "result"),),
    maps=("responses",),
    repeated=("responses.tool_calls", "judge_reasons", *verdict_paths(VERDICTS)),
    texts=VERDICTS,
    named=(("raw_ab", "verdict"),),
)

CHILDREN = ("responses", "responses.tool_calls", "judge_reasons", *VERDICTS, *verdict_paths(VERDICTS))


def children_found(lines: DataFrame) -> DataFrame:
    """The child records of exported result lines: line_id, child, parent_pos, pos."""
    shredded, _, _ = flatten(lines, "line_id", "payload", RESULT_LINES, with_fields=False)
    return shredded.filter(F.col("child").isin(*CHILDREN)).select(F.col("id").alias("line_id"), "child", "parent_pos", "pos")
